"""An index on disk: immutable segments, and one pointer to the list of those that count.

A run appends a segment with the pages that are new and the keys of what is gone; nothing that is stored is rewritten.
A key that is gone hides rows of earlier segments alone, so content may come back. ``optimize`` merges all segments into one,
``vacuum`` removes files that no pointer needs. A segment counts once the next pointer file has been created, exclusively;
readers never see half of one. Other versions of the schema are refused.

Postings are kept by ranges of stems and in their order, in as many partitions as their size asks for."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan import schema
from folioscan.functions.porter import stem_column
from folioscan.functions.text import postings
from folioscan.operators.index import compact, page_id
from folioscan.storage import delete, listing, publish_exclusively, read_text, size_of

TABLES = {"pages": schema.PAGES, "meta": schema.META, "links": schema.LINKS, "dict": schema.DICTIONARY, "postings": schema.POSTINGS, "gone_pages": schema.GONE_PAGES, "gone_files": schema.GONE_FILES}
#: By which key rows of a table are hidden: the table of keys that are gone, and the key of a row.
HIDDEN_BY = {"pages": ("gone_pages", "doc_id", lambda: F.col("doc_id")), "postings": ("gone_pages", "doc_id", lambda: F.col("doc_id")), "links": ("gone_pages", "doc_id", lambda: page_id(F.col("md5_hash"))), "meta": ("gone_files", "file", lambda: F.col("file"))}
READ, WRITE, CREATE = "read", "write", "create"
#: Keys that are gone, up to this number, are told to all tasks.
BROADCAST_GONE = 1_000_000
#: Bytes of stored pages for each partition of postings.
PAGES_BYTES = 64 << 20
#: A run that would leave more segments than this merges them.
MOST_SEGMENTS = 32


class Catalog:
    def __init__(self, spark: SparkSession, root: str, mode: str = READ):
        self.spark, self.root, self.mode = spark, root.rstrip("/"), mode
        if self.current() is None:
            if mode != CREATE:
                raise FileNotFoundError(f"there is no index in {root}")
            publish_exclusively(spark, f"{self.root}/pointers/{0:08d}", json.dumps({"version": schema.SCHEMA_VERSION, "segments": []}))

    def _pointers(self) -> list[str]:
        return listing(self.spark, f"{self.root}/pointers")

    def current(self) -> dict | None:
        names = self._pointers()
        if not names:
            return None
        entry = json.loads(read_text(self.spark, f"{self.root}/pointers/{names[-1]}"))
        if entry["version"] != schema.SCHEMA_VERSION:
            raise ValueError(f"the index has schema version {entry['version']}, this library {schema.SCHEMA_VERSION}")
        return entry

    def records(self) -> int:
        """Pages of the index; counted when they were written."""
        return sum(s["pages"] - s["gone_pages"] for s in self.current()["segments"])

    def _rows(self, name: str, segments: list[dict]) -> DataFrame:
        """Rows of these segments with the segment that holds them."""
        kind = schema.with_segment(TABLES[name])
        paths = [f"{self.root}/{name}/segment={s['name']}" for s in segments if s[name]]
        return self.spark.read.schema(kind).option("basePath", f"{self.root}/{name}").parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def table(self, name: str) -> DataFrame:
        """A table as it is now: without rows of which the key was gone in a later segment."""
        segments = self.current()["segments"]
        rows = self._rows(name, segments)
        if name in HIDDEN_BY:
            keys, column, key = HIDDEN_BY[name]
            number = sum(s[keys] for s in segments)
            if number:
                gone = self._rows(keys, segments).select(F.col(column).alias("_key"), F.col("segment").alias("_since"))
                rows = rows.join(F.broadcast(gone) if number <= BROADCAST_GONE else gone, (key() == F.col("_key")) & (F.col("segment") < F.col("_since")), "left_anti")
        return rows.drop("segment")

    def _segment(self, turn: int, tables: dict[str, DataFrame]) -> dict:
        """Write a segment; how many rows each of its tables has."""
        name, written = f"{turn:08d}-{uuid.uuid4().hex}", {}
        for n, kind in TABLES.items():
            path = f"{self.root}/{n}/segment={name}"
            if n in tables:
                tables[n].select(*[f.name for f in kind.fields]).write.parquet(path)
            elif n == "postings" and written.get("pages"):
                pages_path = f"{self.root}/pages/segment={name}"
                stored = postings(self.spark.read.schema(schema.PAGES).parquet(pages_path)).withColumn("stem", stem_column("term"))
                compact(stored, max(1, math.ceil(size_of(self.spark, pages_path) / PAGES_BYTES))).select(*schema.POSTINGS.names).write.parquet(path)
            else:
                written[n] = 0
                continue
            written[n] = self.spark.read.schema(kind).parquet(path).count()
        return {"name": name} | written

    def _publish(self, turn: int, segments: list[dict]) -> bool:
        done = publish_exclusively(self.spark, f"{self.root}/pointers/{turn:08d}", json.dumps({"version": schema.SCHEMA_VERSION, "segments": segments}))
        if not done:
            for n in TABLES:
                delete(self.spark, f"{self.root}/{n}/segment={segments[-1]['name']}")
        return done

    def _writing(self) -> int:
        if self.mode == READ:
            raise PermissionError("the index was opened for reading")
        return int(self._pointers()[-1]) + 1

    def append(self, tables: dict[str, DataFrame]) -> bool:
        """Add a segment: new rows of pages, meta, links and dict, and gone_pages and gone_files. Postings are made of the
        pages. False if another writer was faster."""
        turn = self._writing()
        segments = self.current()["segments"]
        done = self._publish(turn, [*segments, self._segment(turn, tables)])
        if done and len(segments) >= MOST_SEGMENTS:
            self.optimize()
        return done

    def publish(self, tables: dict[str, DataFrame]) -> bool:
        """Replace the whole index by these tables."""
        turn = self._writing()
        return self._publish(turn, [self._segment(turn, tables)])

    def optimize(self) -> bool:
        """Merge all segments into one, without what is gone, postings sorted anew and none stemmed again."""
        turn = self._writing()
        size = sum(size_of(self.spark, f"{self.root}/pages/segment={s['name']}") for s in self.current()["segments"] if s["pages"])
        tables = {n: self.table(n) for n in ("pages", "meta", "links", "dict")}
        tables["postings"] = compact(self.table("postings"), max(1, math.ceil(size / PAGES_BYTES)))
        return self._publish(turn, [self._segment(turn, tables)])

    def vacuum(self, keep: int = 1) -> int:
        """Remove pointers but the last ``keep``, and segments that none of those names; no writer may be under way, and no
        reader of an older pointer. Returns how many folders and files went."""
        self._writing()
        names = self._pointers()
        old = names[: -max(1, keep)]
        needed = {s["name"] for p in names[-max(1, keep) :] for s in json.loads(read_text(self.spark, f"{self.root}/pointers/{p}"))["segments"]}
        gone = [f"{self.root}/pointers/{p}" for p in old]
        gone += [f"{self.root}/{t}/{n}" for t in TABLES for n in listing(self.spark, f"{self.root}/{t}") if n.startswith("segment=") and n.removeprefix("segment=") not in needed]
        for path in gone:
            delete(self.spark, path)
        return len(gone)

    def close(self) -> None:
        """Nothing is held open."""
