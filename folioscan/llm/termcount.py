"""How often every distinct term occurs, in how many records, and which terms are too rare or too common.

Recursive radix spilling: tasks count the terms of their own records, hash them, and spill the partial counts to Parquet
in the shared folder. The spilled counts are partitioned to files by the leading bits of the hash, as many bits as their
number asks for; partitions of more than ``cap`` rows are combined by term, so that a term that every batch of counting has
met becomes one row, and split to files by further bits, again and again. Each partition that results is aggregated out of
core by DuckDB in a task of its own: where the shared folder is one of a mounted file system, DuckDB reads the files itself
and may spill to that folder; elsewhere they are streamed to it, a partition of at most ``cap`` rows being small enough.

Defined results: null texts are no records of the field; empty texts are records without terms; each row counts as a
record of its own, copies included; an empty table gives no terms. Texts are used whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.text import tokens, utf8
from folioscan.storage import listing, materialize, scratch_path
from folioscan.storage import mounted as mounted_path

STEP = 4
FLUSH = 200_000
MOST_TASKS = 1 << 16
SCHEMA = "field string, term string, total bigint, pages bigint"


def partial_counts(docs: DataFrame, fields: list[str], flush: int = FLUSH) -> DataFrame:
    """(field, term, total, pages), each term once for each ``flush`` distinct terms of a task."""

    def emit(batches):
        total, pages = [Counter() for _ in fields], [Counter() for _ in fields]

        def out():
            for i, f in enumerate(fields):
                terms = list(total[i])
                if terms:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f] * len(terms)), pa.array([t.decode() for t in terms]), pa.array(list(total[i].values()), pa.int64()), pa.array([pages[i][t] for t in terms], pa.int64())],
                        ["field", "term", "total", "pages"],
                    )
                total[i].clear()
                pages[i].clear()

        for b in batches:
            for texts in zip(*map(utf8, b.columns)):
                for i, text in enumerate(texts):
                    if text:
                        toks = tokens(text)
                        total[i].update(toks)
                        pages[i].update(set(toks))
                if sum(map(len, total)) > flush:
                    yield from out()
        yield from out()

    return docs.select(*[F.col(f) for f in fields]).mapInArrow(emit, SCHEMA)


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned(F.col("h"), 64 - bits) if bits else F.lit(0).cast("long")


def _written(rows: DataFrame, bits: int, prefixes: int) -> str:
    """Rows in a folder for each prefix of the hash, of which there are so many; each is written by one task."""
    path = scratch_path(rows.sparkSession, "radix")
    rows.withColumn("p", _prefix(bits)).repartition(min(prefixes, MOST_TASKS), "p").write.partitionBy("p").parquet(path)
    return path


def radix_leaves(spilled: DataFrame, cap: int) -> list[tuple[str, set[int]]]:
    """Folders of partitions, and which of their prefixes went on to the next folder. No other partition has more than
    ``cap`` rows: terms that fall together in all bits of the hash would be needed for one.

    The driver sees the partitions that are too large, no more than all rows divided by ``cap``."""
    spark, total = spilled.sparkSession, spilled.count()
    if not total:
        return []
    rows, out = spilled, []
    bits = STEP * max(1, math.ceil(math.log2(max(1, total / cap)) / STEP))
    prefixes = 1 << bits
    while True:
        path = _written(rows, bits, prefixes)
        level = spark.read.schema(f"{SCHEMA}, h bigint, p bigint").parquet(path)
        large = [r.p for r in level.groupBy("p").count().filter(F.col("count") > cap).collect()] if bits < 64 else []
        out.append((path, set(large)))
        if not large:
            return out
        whole = spark.read.schema(f"{SCHEMA}, h bigint, p bigint").option("basePath", path).parquet(*[f"{path}/p={p}" for p in large])
        rows = whole.groupBy("field", "term", "h").agg(F.sum("total").alias("total"), F.sum("pages").alias("pages")).select("field", "term", "total", "pages", "h")
        bits, prefixes = min(64, bits + STEP), len(large) << STEP


ARROW = pa.schema([("field", pa.string()), ("term", pa.string()), ("total", pa.int64()), ("pages", pa.int64())])


def _summed(con, source: str) -> Iterator[pa.RecordBatch]:
    reader = con.sql(f"SELECT field, term, sum(total)::BIGINT AS total, sum(pages)::BIGINT AS pages FROM {source} GROUP BY field, term").to_arrow_reader(100_000)
    for batch in reader:
        yield from pa.Table.from_batches([batch]).cast(ARROW).to_batches()


def _aggregate_files(spill: str, memory: str):
    """Paths of partitions -> their counts; DuckDB reads and spills by itself."""

    def run(batches):
        import duckdb

        for b in batches:
            for path in b.column(0).to_pylist():
                with duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": spill}) as con:
                    yield from _summed(con, f"read_parquet('{path}/*.parquet', hive_partitioning = false)")

    return run


def _aggregate_batches(memory: str):
    """The batches of a partition -> its counts, for file systems that DuckDB cannot read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": ""}) as con:
            con.execute("CREATE TABLE part (field VARCHAR, term VARCHAR, total BIGINT, pages BIGINT)")
            for b in batches:
                con.register("rows_of_batch", pa.Table.from_batches([b]).select(["field", "term", "total", "pages"]))
                con.execute("INSERT INTO part SELECT * FROM rows_of_batch")
                con.unregister("rows_of_batch")
            yield from _summed(con, "part")

    return run


def term_counts(docs: DataFrame, fields: list[str], cap: int = 1_000_000, memory: str = "256MB", flush: int = FLUSH, mounted: bool | None = None) -> DataFrame:
    """(field, term, total, pages) of every distinct term of each field. ``mounted``: False if executors do not see the shared
    folder as one of their own file system though its address says so."""
    spark = docs.sparkSession
    spilled = materialize(partial_counts(docs, fields, flush).withColumn("h", F.xxhash64("field", "term")), "terms")
    levels = radix_leaves(spilled, cap)
    if not levels:
        return spark.createDataFrame([], SCHEMA)
    if mounted is not False and mounted_path(spark, levels[0][0]):
        leaves = [(f"{mounted_path(spark, path)}/{n}",) for path, gone in levels for n in listing(spark, path) if n.startswith("p=") and int(n[2:]) not in gone]
        paths = materialize(spark.createDataFrame(leaves, "path string"), "leaves")  # a table, so that the plan does not grow with them
        spill = mounted_path(spark, scratch_path(spark, "duckdb"))
        return paths.repartition(max(1, min(len(leaves), MOST_TASKS)), "path").mapInArrow(_aggregate_files(spill, memory), SCHEMA)
    out = None
    for path, gone in levels:
        level = spark.read.schema(f"{SCHEMA}, h bigint, p bigint").parquet(path)
        if gone:
            level = level.join(F.broadcast(spark.createDataFrame([(p,) for p in gone], "p bigint")), "p", "left_anti")
        counts = level.select("field", "term", "total", "pages", "p").groupBy("p").applyInArrow(_aggregate_batches(memory), SCHEMA)
        out = counts if out is None else out.unionByName(counts)
    return out


def mark_terms(counts: DataFrame, docs: DataFrame, fields: list[str], rare: int = 1, common: float = 0.1) -> DataFrame:
    """Adds ``records`` (rows whose field is not null) and ``mark``: 'rare' up to ``rare`` records, else 'common' beyond
    the share ``common`` of the records, else null."""
    n = docs.agg(*[F.count(F.col(f)).alias(f"c{i}") for i, f in enumerate(fields)]).first()
    records = F.lit(None).cast("long")
    for i, f in enumerate(fields):
        records = F.when(F.col("field") == f, F.lit(n[f"c{i}"])).otherwise(records)
    mark = F.when(F.col("pages") <= rare, "rare").when(F.col("pages") > F.col("records") * F.lit(common), "common")
    return counts.withColumn("records", records).withColumn("mark", mark)
