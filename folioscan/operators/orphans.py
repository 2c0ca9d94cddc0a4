"""References to records that do not exist at the moment of the reference.

References and the validity intervals of their targets are co-partitioned by (relation, key), sorted by time and merged
linearly: a running sum over interval starts and ends says, at every reference, how many targets are live. Targets are
aggregated before they are shuffled. A key that holds more than ``hot_share`` of all rows is cut into time slices, each
of which starts from the state carried over from the slices before it. A slice that still holds so many rows (references
of one moment, or without a time) is cut further by rows: its references are spread over parts, each of which gets the
slice's changes and carried state. So no task ever gets more than about ``hot_share`` of all references.

Defined results: a null key refers to nothing and gives no row; a null time finds no live target and gives a row with a
null period; repeated rows count once; intervals that end before they begin are never live; a target without a start is
never live; empty tables give an empty result or, on the side of the targets, only orphans.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.storage import materialize

MISSING, DELETED, LATE = "missing", "deleted", "late"


@dataclass(frozen=True)
class Reference:
    """One foreign key. ``ends`` is None where a target, once there, stays."""

    table: str
    column: str
    rows: DataFrame
    key: Column
    row_id: Column
    time: Column
    targets: DataFrame
    target_key: Column
    starts: Column
    ends: Column | None = None


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _references(refs: list[Reference]) -> DataFrame:
    return _union(
        [
            r.rows.select(F.lit(i).alias("rel"), r.key.alias("key"), r.time.cast("timestamp_ntz").alias("t"), r.row_id.cast("long").alias("row_id")).filter("key is not null")
            for i, r in enumerate(refs)
        ]
    )


def _events(refs: list[Reference]) -> DataFrame:
    """Changes of the number of live targets, one row for each key and moment."""
    parts = []
    for i, r in enumerate(refs):
        keyed = r.targets.select(
            F.lit(i).alias("rel"),
            r.target_key.alias("key"),
            r.starts.cast("timestamp_ntz").alias("s"),
            (F.lit(None) if r.ends is None else r.ends).cast("timestamp_ntz").alias("e"),
        ).filter("key is not null and s is not null")
        if r.ends is None:
            parts.append(keyed.groupBy("rel", "key").agg(F.min("s").alias("t")).withColumns({"delta": F.lit(1).cast("long"), "opened": F.lit(1).cast("long")}))
            continue
        lives = F.col("e").isNull() | (F.col("s") < F.col("e"))
        moments = F.filter(
            F.array(
                F.struct(F.col("s").alias("t"), F.when(lives, 1).otherwise(0).alias("delta"), F.lit(1).alias("opened")),
                F.struct(F.when(lives, F.col("e")).alias("t"), F.lit(-1).alias("delta"), F.lit(0).alias("opened")),
            ),
            lambda x: x["t"].isNotNull(),
        )
        parts.append(
            keyed.distinct().select("rel", "key", F.explode(moments).alias("m")).select("rel", "key", "m.*").groupBy("rel", "key", "t").agg(F.sum("delta").alias("delta"), F.sum("opened").alias("opened"))
        )
    return _union(parts)


@dataclass(frozen=True)
class Hot:
    """Keys that are cut, at most 1 / share of them, and of their slices those that are cut by rows: (rel, key, slot, parts)."""

    keys: list[str]
    slices: list[tuple[int, str, int, int]]
    #: all slices of the keys with references: (rel, key, slot)
    counts: DataFrame


def _hot(rows: DataFrame, slot: Column, share: float, least: int) -> Hot:
    """One pass over the references counts them by key and slice; the rest works on the counts."""
    counts = materialize(rows.groupBy("rel", "key", slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")), "slices")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    bar = max(least, int(total * share) + 1)
    keys = [f"{r.rel}\0{r.key}" for r in counts.groupBy("rel", "key").agg(F.sum("n").alias("n")).filter(F.col("n") >= bar).collect()]
    cut = [(r.rel, r.key, r.slot, -(-r.n // bar)) for r in counts.filter(F.col("n") > bar).collect()] if keys else []
    return Hot(keys, cut, counts)


def find_orphans(refs: list[Reference], hot_share: float = 1 / 256, hot_least: int = 50_000, slice_seconds: int = 86_400) -> DataFrame:
    """Columns ref_table, ref_column, row_id, t, period, status: one row for each reference without a live target."""
    children, events = _references(refs), _events(refs)
    cut = F.coalesce(F.floor(F.unix_micros(F.col("t").cast("timestamp")) / F.lit(slice_seconds * 1_000_000)), F.lit(-(2**62))).cast("long")
    hot = _hot(children, cut, hot_share, hot_least)
    is_hot = F.concat_ws("\0", F.col("rel").cast("string"), "key").isin(hot.keys) if hot.keys else F.lit(False)
    slot = F.when(is_hot, cut).otherwise(F.lit(0)).cast("long").alias("slot")
    zero, whole = F.lit(0).cast("long"), F.lit(0).alias("part")
    changes = events.select("rel", "key", "t", slot, F.lit(1).alias("kind"), F.lit(None).cast("long").alias("row_id"), "delta", "opened", F.lit(1).cast("long").alias("known"))
    asked = children.select("rel", "key", "t", slot, F.lit(2).alias("kind"), "row_id", zero.alias("delta"), zero.alias("opened"), zero.alias("known"))
    if hot.keys:
        before = Window.partitionBy("rel", "key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        slots = hot.counts.filter(is_hot).select("rel", "key", "slot").withColumns({"d": zero, "o": zero, "k": zero})
        carried = (
            changes.filter(is_hot)
            .groupBy("rel", "key", "slot")
            .agg(F.sum("delta").alias("d"), F.sum("opened").alias("o"), F.max("known").alias("k"))
            .unionByName(slots)
            .groupBy("rel", "key", "slot")
            .agg(F.sum("d").alias("d"), F.sum("o").alias("o"), F.max("k").alias("k"))
            .select(
                "rel",
                "key",
                F.lit(None).cast("timestamp_ntz").alias("t"),
                "slot",
                F.lit(0).alias("kind"),
                F.lit(None).cast("long").alias("row_id"),
                F.coalesce(F.sum("d").over(before), zero).alias("delta"),
                F.coalesce(F.sum("o").over(before), zero).alias("opened"),
                F.max("k").over(Window.partitionBy("rel", "key")).alias("known"),
            )
        )
        changes = changes.unionByName(carried)
    if hot.slices:
        spark = children.sparkSession
        cuts = F.broadcast(spark.createDataFrame(hot.slices, "rel int, key string, slot bigint, parts int"))  # at most 1 / share rows
        parts = F.coalesce("parts", F.lit(1))
        asked = asked.join(cuts, ["rel", "key", "slot"], "left").withColumn("part", F.pmod(F.xxhash64("row_id"), parts).cast("int")).drop("parts")
        changes = changes.join(cuts, ["rel", "key", "slot"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    else:
        asked, changes = asked.select("*", whole), changes.select("*", whole)
    stream = asked.unionByName(changes)
    group = Window.partitionBy("rel", "key", "slot", "part")
    upto = group.orderBy(F.col("t").asc_nulls_first(), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = stream.select("rel", "t", "kind", "row_id", F.sum("delta").over(upto).alias("live"), F.sum("opened").over(upto).alias("past"), F.max("known").over(group).alias("known"))
    names = F.array(*[F.struct(F.lit(r.table).alias("ref_table"), F.lit(r.column).alias("ref_column")) for r in refs])
    status = F.when(F.col("past") > 0, DELETED).when(F.col("known") > 0, LATE).otherwise(MISSING)
    return (
        merged.filter("kind = 2 and live <= 0")
        .select("rel", "row_id", "t", F.date_format("t", "yyyy-MM").alias("period"), status.alias("status"))
        .distinct()
        .select(names[F.col("rel")]["ref_table"].alias("ref_table"), names[F.col("rel")]["ref_column"].alias("ref_column"), "row_id", "t", "period", "status")
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans by table, month and cause."""
    return orphans.groupBy("ref_table", "ref_column", "period", "status").agg(F.count(F.lit(1)).alias("orphans"))
