"""Processing only what is new or changed since the last successful run.

What has been processed is kept as disjoint intervals of sequence numbers. A run subtracts them from the ranges that are
available, takes the gaps that remain (rows that came late fill gaps below the highest number, and are taken like any
other), and publishes its output together with the merged intervals in one step: a run that fails publishes nothing, so
its rows are taken by the next one, once. Intervals are cut at multiples of 2**BLOCK_BITS, so that they are built, merged
and matched block by block, each block being of bounded size however the numbers are spread.

``subtract`` and ``union`` are the arithmetic of intervals. ``replay`` applies them to a whole history of runs in one plan,
run by run within each block; ``RunLedger`` does so for live runs. A test holds that both agree.

Defined results: rows without a sequence number, an arrival time, a key or a value are not taken; a number is taken once,
by the first run that sees a row of it, with the rows of it that have arrived by then: repeated rows that come later are
not taken again; runs without a start see nothing; empty tables give empty results.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.storage import delete, listing, publish_exclusively, read_text

BLOCK_BITS = 16
#: Runs beyond this number are joined by shuffle rather than broadcast.
RUNS_BROADCAST = 10_000


def block_of(seq: Column) -> Column:
    return F.shiftright(seq, BLOCK_BITS)


def intervals(seqs: DataFrame) -> DataFrame:
    """Distinct (run, seq) -> (block, run, lo, hi): maximal ranges of consecutive numbers of a run within a block."""
    w = Window.partitionBy("block").orderBy("run", "seq")
    starts = (F.lag("seq").over(w).isNull()) | (F.col("seq") != F.lag("seq").over(w) + 1) | (F.col("run") != F.lag("run").over(w))
    return (
        seqs.withColumn("block", block_of(F.col("seq")))
        .withColumn("start", starts.cast("int"))
        .withColumn("island", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy("block", "island")
        .agg(F.first("run").alias("run"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))
        .select("block", "run", "lo", "hi")
    )


Spans = tuple[np.ndarray, np.ndarray]


def union(a: Spans, b: Spans) -> Spans:
    """Two sets of intervals (lo, hi) as sorted disjoint intervals, neighbours joined."""
    lo, hi = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
    if not len(lo):
        return lo, hi
    order = np.lexsort((hi, lo))
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1] + 1
    at = np.flatnonzero(new)
    return lo[at], hi[np.append(at[1:], len(lo)) - 1]


def subtract(available: Spans, processed: Spans) -> Spans:
    """What of sorted disjoint intervals is in no interval of the other sorted disjoint ones: the gaps."""
    lo, hi = available
    plo, phi = processed
    first, last = np.searchsorted(phi, lo, "left"), np.searchsorted(plo, hi, "right")  # those that meet an interval
    pieces = np.maximum(last - first, 0) + 1
    owner = np.repeat(np.arange(len(lo)), pieces)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = first[owner] + k
    begin = np.where(k == 0, lo[owner], phi[np.maximum(at - 1, 0)] + 1) if len(plo) else lo[owner]
    end = np.where(k == pieces[owner] - 1, hi[owner], plo[np.minimum(at, len(plo) - 1)] - 1) if len(plo) else hi[owner]
    keep = begin <= end
    return begin[keep], end[keep]


def _spans(t: pa.Table) -> Spans:
    return tuple(t.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi"))


LEDGER = "block bigint, run int, lo bigint, hi bigint"


def _runs_of_block(t: pa.Table) -> pa.Table:
    """(block, run, lo, hi), the ranges that each run is the first to see -> the gaps that each run takes."""
    t = t.select(["block", "run", "lo", "hi"])
    run, (lo, hi) = t.column("run").to_numpy(), _spans(t)
    none = (np.empty(0, np.int64), np.empty(0, np.int64))
    processed, out = none, []
    for r in np.unique(run):
        available = union((lo[run == r], hi[run == r]), none)
        gaps = subtract(available, processed)
        processed = union(processed, available)
        out.append((np.full(len(gaps[0]), r), *gaps))
    runs, begin, end = (np.concatenate(x) for x in zip(*out))
    block = pa.array(np.full(len(runs), t.column("block")[0].as_py()), pa.int64())
    return pa.table([block, pa.array(runs, pa.int32()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], ["block", "run", "lo", "hi"])


def take_gaps(available: DataFrame) -> DataFrame:
    """Of the ranges (block, run, lo, hi) that each run sees first, what no run before it has taken, run by run in each
    block. A block has at most 2**BLOCK_BITS numbers, so it fits in a task."""
    return available.groupBy("block").applyInArrow(_runs_of_block, LEDGER)


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two sets of intervals (block, lo, hi) as disjoint intervals, neighbours joined."""

    def one(t: pa.Table) -> pa.Table:
        spans = union(_spans(t), (np.empty(0, np.int64), np.empty(0, np.int64)))
        return pa.table([pa.array(np.full(len(spans[0]), t.column("block")[0].as_py()), pa.int64()), pa.array(spans[0]), pa.array(spans[1])], ["block", "lo", "hi"])

    return a.select("block", "lo", "hi").unionByName(b.select("block", "lo", "hi")).groupBy("block").applyInArrow(one, "block bigint, lo bigint, hi bigint")


def locate(rows: DataFrame, spans: DataFrame, seq: str) -> DataFrame:
    """Rows with the run of the interval that holds their number (``taken_by``, null where none does): one linear merge
    of both sides, sorted by number within blocks. ``rows`` must be free of repeated rows; they travel as one column, so
    their names clash with nothing, save that none may be called taken_by."""
    if "taken_by" in rows.columns:
        raise ValueError("a column of the rows is called taken_by")
    row = F.struct(*rows.columns)
    number = F.col(seq)
    left = rows.select(block_of(number).alias("block"), number.alias("at"), F.lit(1).alias("kind"), row.alias("row"), F.lit(None).cast("struct<run:int,hi:bigint>").alias("span"))
    span = F.struct(F.col("run").cast("int").alias("run"), F.col("hi").cast("bigint").alias("hi"))
    right = spans.select("block", F.col("lo").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(left.schema["row"].dataType).alias("row"), span.alias("span"))
    w = Window.partitionBy("block").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        left.unionByName(right)
        .withColumn("span", F.last("span", ignorenulls=True).over(w))
        .filter("kind = 1")
        .select("row.*", F.when(F.col("at") <= F.col("span.hi"), F.col("span.run")).alias("taken_by"))
    )


def successful_runs(runs: DataFrame) -> DataFrame:
    """(run, run_id, started_at), run counting the successful ones by start. The run log is small and of fixed growth."""
    ok = (F.lower(F.btrim(F.col("status"), F.lit(" \t\n\r\f\x0b"))) == "ok") & F.col("finished_at").isNotNull() & F.col("started_at").isNotNull()
    good = runs.filter(ok).select("run_id", F.col("started_at").cast("timestamp_ntz").alias("started_at")).distinct()
    return good.withColumn("run", F.row_number().over(Window.orderBy("started_at", "run_id")))


def first_run(rows: DataFrame, runs: DataFrame, arrived: str) -> DataFrame:
    """Adds ``run``: the first run that starts at or after the arrival of a row. Later rows are left out.

    Each run covers the time since the run before it; days make this an equi-join. Only the small run log is exploded
    to days; it is broadcast up to RUNS_BROADCAST runs.
    """
    w = Window.orderBy("run")
    cover = runs.withColumn("since", F.lag("started_at").over(w))
    first = runs.agg(F.min("started_at").alias("s")).first().s
    if first is None:
        return rows.withColumn("run", F.lit(None).cast("int")).filter("false")
    days = (
        cover.filter("since is not null and since < started_at")
        .withColumn("day", F.explode(F.sequence(F.to_date("since"), F.to_date("started_at"))))
        .select("day", "since", "started_at", F.col("run").alias("later"))
    )
    if runs.count() <= RUNS_BROADCAST:
        days = F.broadcast(days)
    at = F.col(arrived).cast("timestamp_ntz")
    early = rows.filter(at <= F.lit(first)).withColumn("run", F.lit(1))
    late = rows.filter(at > F.lit(first)).withColumn("_at", at).join(days, (F.to_date("_at") == F.col("day")) & (F.col("_at") > F.col("since")) & (F.col("_at") <= F.col("started_at")))
    return early.unionByName(late.select(*rows.columns, F.col("later").alias("run")))


def replay(rows: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (seq, key, value, order_at, arrived) -> (ledger of the intervals each run takes, rows with taken_by)."""
    tagged = (
        first_run(rows.filter("seq is not null and arrived is not null and key is not null and value is not null"), runs, "arrived")
        .groupBy("seq", "key", "value", "order_at")
        .agg(F.min("run").cast("int").alias("seen_by"))
    )
    ledger = take_gaps(intervals(tagged.select("seq", F.col("seen_by").alias("run")).distinct()))
    taken = locate(tagged, ledger, "seq")
    # a row that comes after the run that took its number is a repetition
    return ledger, taken.withColumn("taken_by", F.when(F.col("taken_by") == F.col("seen_by"), F.col("taken_by"))).drop("seen_by")


def changed_keys(taken: DataFrame) -> DataFrame:
    """(run, key, value): for each run the keys whose latest value is new or differs from what the run before saw.

    At most one row per key and run reaches the window, so no key is larger there than the number of runs."""
    w = Window.partitionBy("key").orderBy("run")
    newest = taken.filter("taken_by is not null").groupBy("key", F.col("taken_by").alias("run")).agg(F.max(F.struct("order_at", "seq", "value")).alias("v"))
    state = newest.withColumn("value", F.max("v").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))["value"])
    before = F.lag("value").over(w)
    return state.withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") != F.col("value"))).select("run", "key", "value")


#: So many covered spans, the longest, are told to the scan of the rows; more are left to the exact subtraction.
TOLD_TO_SCAN = 64


class RunLedger:
    """Processed intervals and outputs of live runs, in a folder of any file system Spark can write.

    ``root/outputs/attempt=<name>`` and ``root/spans/<name>`` hold what an attempt wrote; ``root/commits/<n>`` says which of
    them count. A commit is one file, created exclusively and never replaced: a run either counts as a whole or not at
    all. ``vacuum`` removes what no commit needs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _last(self) -> tuple[int, dict | None]:
        names = listing(self.spark, f"{self.root}/commits")
        return (int(names[-1]) + 1, json.loads(read_text(self.spark, f"{self.root}/commits/{names[-1]}"))) if names else (0, None)

    def commits(self) -> DataFrame:
        """(name, run_id) of the runs that count."""
        schema = "name string, run_id bigint"
        return self.spark.read.schema(schema).json(f"{self.root}/commits") if listing(self.spark, f"{self.root}/commits") else self.spark.createDataFrame([], schema)

    def processed(self) -> DataFrame:
        _, last = self._last()
        schema = "block bigint, lo bigint, hi bigint"
        return self.spark.read.schema(schema).parquet(f"{self.root}/spans/{last['name']}") if last else self.spark.createDataFrame([], schema)

    def _covered(self, spans: DataFrame) -> list[tuple[int, int]]:
        """The longest stretches that are covered wholly, over blocks; at most TOLD_TO_SCAN."""
        w = Window.partitionBy("part").orderBy("lo")
        blocks = spans.withColumn("part", F.shiftright("block", 10))  # 2**26 numbers: their spans are joined in one task
        start = F.when(F.col("lo") == F.lag("hi").over(w) + 1, 0).otherwise(1)
        joined = blocks.withColumn("start", start).withColumn("island", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).groupBy("part", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        rows = joined.orderBy(F.desc(F.col("hi") - F.col("lo")), "lo").limit(16 * TOLD_TO_SCAN).collect()
        lo, hi = union((np.array([r.lo for r in rows], np.int64), np.array([r.hi for r in rows], np.int64)), (np.empty(0, np.int64), np.empty(0, np.int64)))
        longest = np.argsort(lo - hi, kind="stable")[:TOLD_TO_SCAN]
        return [(int(lo[i]), int(hi[i])) for i in longest]

    def pending(self, rows: DataFrame, seq: str = "seq") -> DataFrame:
        """Available rows that no committed run has taken, repeated rows once. Stretches that are processed wholly are kept
        out of the scan by a condition on the number, so their row groups are not read; what is left of the available
        numbers is made into ranges, and the processed intervals are subtracted from them."""
        spans = self.processed()
        rows = rows.filter(F.col(seq).isNotNull())
        for lo, hi in self._covered(spans):
            rows = rows.filter((F.col(seq) < lo) | (F.col(seq) > hi))
        rows = rows.distinct()
        available = intervals(rows.select(F.col(seq).alias("seq")).distinct().withColumn("run", F.lit(1)))
        gaps = take_gaps(spans.withColumn("run", F.lit(0)).unionByName(available)).filter("run = 1")
        return locate(rows, gaps, seq).filter("taken_by = 1").drop("taken_by")

    def run(self, rows: DataFrame, process, run_id: int, seq: str = "seq") -> bool:
        """Write ``process(pending rows)`` and publish it with the merged intervals. False if another run was faster."""
        turn, last = self._last()
        name = f"{turn:08d}-{uuid.uuid4().hex}"
        batch = f"{self.root}/batches/{name}"
        self.pending(rows, seq).write.parquet(batch)  # output and intervals see the same rows, whatever arrives meanwhile
        todo = self.spark.read.parquet(batch)
        process(todo).write.parquet(f"{self.root}/outputs/attempt={name}")
        taken = intervals(todo.select(F.col(seq).alias("seq"), F.lit(1).alias("run")).distinct())
        merge(self.processed(), taken).write.parquet(f"{self.root}/spans/{name}")
        done = publish_exclusively(self.spark, f"{self.root}/commits/{turn:08d}", json.dumps({"name": name, "run_id": run_id}))
        delete(self.spark, batch)
        if not done:
            for x in (f"outputs/attempt={name}", f"spans/{name}"):
                delete(self.spark, f"{self.root}/{x}")
        return done

    def outputs(self) -> DataFrame | None:
        """The outputs of all committed runs, with their run_id."""
        if not listing(self.spark, f"{self.root}/commits"):
            return None
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/outputs").join(self.commits().withColumnRenamed("name", "attempt"), "attempt").drop("attempt")

    def vacuum(self) -> int:
        """Remove what failed attempts left and intervals that later ones replace; no run may be under way. Returns how much."""
        _, last = self._last()
        kept = {r.name for r in self.commits().select("name").toLocalIterator()}
        gone = [f"batches/{n}" for n in listing(self.spark, f"{self.root}/batches")]
        gone += [f"spans/{n}" for n in listing(self.spark, f"{self.root}/spans") if not last or n != last["name"]]
        gone += [f"outputs/{n}" for n in listing(self.spark, f"{self.root}/outputs") if n.startswith("attempt=") and n.removeprefix("attempt=") not in kept]
        for x in gone:
            delete(self.spark, f"{self.root}/{x}")
        return len(gone)
