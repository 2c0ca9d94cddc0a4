"""The library for callers: build an index from directories, and ask it."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import packing, porter, render
from folioscan.functions.text import STOPWORDS, boolean_query, folded, remove_stopwords
from folioscan.operators import index as ix
from folioscan.operators import search as se
from folioscan.operators import spelling
from folioscan.operators.catalog import CREATE, READ, TABLES, Catalog
from folioscan.operators.query import parse
from folioscan.schema import COLUMNS, SATURATION
from folioscan.sources.crawl import crawl
from folioscan.sources.roff import read_pages
from folioscan.storage import materialize

MARKS = {None: ("", "", "..."), "html": (render.START, render.END, "..."), "pager": (render.START, render.END, "...")}


def build_index(spark: SparkSession, root: str, directories: list[str] | DataFrame, recreate: bool = False, names_only: bool = False, optimize: bool = False) -> dict[str, int]:
    """Bring the index in ``root`` up to date with the files of these directories; returns the counters of the run.

    Files that are gone go first, so content that lives on under another path is read again in the same run. A file of
    which device, inode, mtime and path are known is not opened. One page is kept of equal contents. Only what changed is
    written, as a segment; a run that finds no change writes nothing."""
    catalog = Catalog(spark, root, CREATE)
    known = spark.createDataFrame([], TABLES["meta"]) if recreate else catalog.table("meta")
    files = materialize(ix.one_per_inode(crawl(spark, directories)), "files")
    gone = materialize(ix.stale_meta(known, files), "gone")
    meta = ix.without_stale_meta(known, files)
    read = materialize(read_pages(ix.new_files(files, meta), names_only), "read")
    whole = read.filter("error is null and name is not null and name_desc is not null and md5_hash is not null")
    same = whole.join(meta.select("file", "md5_hash"), ["file", "md5_hash"], "left_semi")
    changed = whole.join(meta.select("file", "md5_hash"), ["file", "md5_hash"], "left_anti")
    replaced = meta.join(read.filter("error is null").join(same.select("file"), "file", "left_anti").select("file"), "file", "left_semi")
    gone = gone.unionByName(replaced)
    kept = meta.join(gone.select("file"), "file", "left_anti")
    fresh = ix.one_per_content(changed.join(kept.select("md5_hash"), "md5_hash", "left_anti"))
    fresh = materialize(fresh.withColumn("id", ix.page_id(F.col("md5_hash"))), "fresh")
    moved = materialize(ix.touched(kept, same.select("device", "inode", "mtime", "file", "md5_hash")).filter("changed").drop("changed"), "moved")
    counts = read.agg(F.count(F.lit(1)).alias("examined"), F.count_if(F.col("error").isNotNull() | F.col("name").isNull() | F.col("name_desc").isNull()).alias("errors")).first()
    indexed, touched, left = fresh.count(), same.count(), gone.count()
    if indexed or left or recreate or not moved.isEmpty():
        delta = {
            "gone_files": gone.select("file").unionByName(moved.select("file")).distinct(),
            # content goes with the last file that has it
            "gone_pages": gone.filter("id is not null").select(F.col("id").alias("doc_id")).distinct().join(kept.select(F.col("id").alias("doc_id")), "doc_id", "left_anti"),
            "meta": moved.unionByName(fresh.select("device", "inode", "mtime", "file", "md5_hash", "id")),
            "pages": fresh.select(F.col("id").alias("doc_id"), *COLUMNS),
            "links": ix.exploded_links(fresh, "links"),
        }
        words = ix.dictionary(delta["pages"])
        if recreate:
            catalog.publish({n: delta[n] for n in ("pages", "meta", "links")} | {"dict": words})
        else:
            catalog.append(delta | {"dict": words.join(catalog.table("dict"), "word", "left_anti")})
    if optimize:
        catalog.optimize()
    return {"files": files.count(), "examined": counts.examined, "errors": counts.errors, "indexed": indexed, "moved": touched, "links": counts.examined - counts.errors - indexed - touched}


def register_functions(spark: SparkSession) -> None:
    """SQL functions: stem(word), pack(text), unpack(binary); rank_score(share, idf), the rank of a record of which the hits add
    up to this weighted share; and the table function query_words(text), the phrases of a query."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION rank_score(share DOUBLE, idf DOUBLE) RETURNS DOUBLE RETURN round(share * idf / ({SATURATION}D + share), 12)")
    spark.udtf.register("query_words", QueryWords)
    spark.udf.register("stem", porter.stem_column)
    spark.udf.register("pack", packing.packed)
    spark.udf.register("unpack", packing.unpacked)


@F.udtf(returnType="phrase int, place int, word string, stem string, prefix boolean, col int")
class QueryWords:
    """The words of a query, phrase by phrase; no rows for one that cannot be read."""

    def eval(self, text: str):
        try:
            q = parse(text or "")
        except ValueError:
            return
        for i, p in enumerate(q.phrases):
            for k, t in enumerate(p.terms):
                yield i, k, t, porter.stem(t), p.prefix and k == len(p.terms) - 1, p.col


class SuggestionCache:
    """Answers of a suggestion source by query, the ``size`` used last. ``prefixes``: a query that goes on from one
    without answers is not asked again; that is only right for sources that complete prefixes, so it is off by default."""

    def __init__(self, ask, size: int = 1000, prefixes: bool = False):
        self.ask, self.size, self.prefixes = ask, size, prefixes
        self.known: OrderedDict[str, list] = OrderedDict()

    def get(self, query: str) -> list:
        if query not in self.known:
            if self.prefixes and any(not self.known.get(query[:i], [0]) for i in range(1, len(query))):
                return []
            self.known[query] = self.ask(query)
            if len(self.known) > self.size:
                self.known.popitem(last=False)
        self.known.move_to_end(query)
        return self.known[query]


@dataclass(frozen=True)
class Answer:
    """A page of results: its rows, how many they are, whether another page follows, and the query that gave them, which is
    a corrected one where the query asked for gave nothing."""

    rows: list
    has_next: bool
    query: str
    did_you_mean: str | None = None

    @property
    def count(self) -> int:
        return len(self.rows)


class Engine:
    """An index opened for reading. Words are compared by their stems. ``stopwords``: those that a folded query loses."""

    def __init__(self, spark: SparkSession, root: str, stopwords: Iterable[str] = STOPWORDS):
        self.spark, self.stopwords = spark, frozenset(stopwords)
        self.catalog = Catalog(spark, root, READ)

    def search(self, text: str, sections: tuple[str, ...] = (), machine: str | None = None, limit: int | None = 10, offset: int = 0, style: str | None = None, snippets: bool = True, fold: bool = True) -> DataFrame:
        """``fold``: A-Z in lower case, without stop-words, operators recognised in any case. ``style``: None, 'html', 'pager'."""
        if fold:
            text = boolean_query(remove_stopwords(folded(text), self.stopwords) or "")
        request = se.SearchRequest(text, sections, machine, limit, offset, MARKS[style], snippets, stems=True)
        by_stem = self.catalog.table("postings").select("doc_id", "col", "pos", F.col("stem").alias("term"), "n")
        out = se.search(self.catalog.table("pages"), request, by_stem, self.catalog.records())
        if snippets and style == "html":
            out = out.withColumn("snippet", render.html_escape("snippet"))
        if snippets and style == "pager":
            out = out.withColumn("snippet", render.overstrike("snippet"))
        return out

    def page(self, text: str, number: int = 1, size: int = 10, **more) -> tuple[list, bool]:
        """Rows of a page of results, and whether there is a next page."""
        rows = self.search(text, limit=size + 1, offset=(max(1, number) - 1) * size, **more).collect()
        return rows[:size], len(rows) > size

    def ask(self, text: str, number: int = 1, size: int = 10, again: bool = True, **more) -> Answer:
        """A page of results; if there is none at all, what may have been meant, and, with ``again``, its results."""
        rows, following = self.page(text, number, size, **more)
        if rows or number > 1:
            return Answer(rows, following, text)
        meant, changed = self.correct(folded(text))
        if not changed or meant == folded(text):
            return Answer([], False, text)
        if not again:
            return Answer([], False, text, meant)
        rows, following = self.page(meant, number, size, **more)
        return Answer(rows, following, meant, meant)

    def count(self, text: str, **more) -> int:
        """How many pages a query finds."""
        return self.search(text, limit=None, snippets=False, **more).count()

    def sql(self, text: str, **args) -> DataFrame:
        """A statement with named parameters (``:name``) over the tables pages, meta, links, dict and postings of the index."""
        for n in ("pages", "meta", "links", "dict", "postings"):
            self.catalog.table(n).createOrReplaceTempView(n)
        return self.spark.sql(text, args=args)

    def lookup(self, name: str) -> DataFrame:
        return se.lookup(self.catalog.table("pages"), name)

    def spell(self, word: str) -> str | None:
        return spelling.spell(self.spark, self.catalog.table("dict"), [word]).first().word

    def suggest(self, text: str) -> DataFrame:
        return spelling.suggest(self.spark, self.catalog.table("dict"), text)

    def correct(self, text: str) -> tuple[str, bool]:
        return spelling.corrected(self.spark, self.catalog.table("dict"), text)
