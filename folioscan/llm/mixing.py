"""A mixture of sources in target shares, by Sainte-Lague apportionment of blocks of equal token counts.

The total is cut into blocks of equal size; sources get blocks by highest quotients weight / (2 * blocks + 1), never more
than their documents allow at ``max_repeat`` uses, and at least one. The documents of a source are dealt to shards of about
SHARD_DOCS by hash, so that no task holds a whole source however large it is, and a source's blocks are apportioned to its
shards in the same way (the driver sees one row for each shard). Within a shard, documents stand in a seeded order and form blocks by their cumulative tokens; a quota of
q blocks out of n uses the whole shard q // n times and, once more, q % n blocks in a row from a seeded start; where
no document begins in these, the one that covers their start.

By default the total is the largest at which every source that has both a weight and documents can reach its share, or 1 -
``tolerance`` of it. With a larger total, sources that run out stay below their share and the rest is apportioned to the
others. The report tells the shares, and by ``note`` why a source is not where it should be.

Source names are compared without letter case and outer blanks. Defined results: documents without text, tokens, id or
source, and those of sources that have no target, are not used; repeated rows count once; targets named several times
add up their weights and take the largest max_repeat; null or negative weights count as 0, a null max_repeat as 1;
targets without documents and sources of weight 0 are reported with 0; empty tables give an empty mixture. Tokens are
counted over whole texts.
"""

from __future__ import annotations

import base64
import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions.keys import BLANKS
from folioscan.storage import materialize

MAX_TARGETS = 100_000
SHARD_DOCS = 500_000
MAX_BLOCKS, LEAST_BLOCK = 100_000, 256
#: Sources of which the share is off by more than this part of it are noted.
NOTED = 0.1
#: As ``total_tokens``: the tokens of the largest source that has a weight.
LARGEST = -1

_encodings: dict[str, object] = {}


def encoding(path: str, pattern: str):
    """A byte-pair encoding from a file of ranks; loaded once in each process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def source_key(c: Column) -> Column:
    return F.lower(F.nullif(F.btrim(c, F.lit(BLANKS)), F.lit("")))


def apportion(weights: list[float], caps: list[int], seats: int, least: int = 0) -> list[int]:
    """Sainte-Lague with upper bounds: seats go to the highest weight / (2 * held + 1); ties to the earlier entry. Each
    entry with a weight has ``least`` seats before that, as far as its bound allows."""
    w = np.array(weights, float)
    cap = np.where(w > 0, np.array(caps, np.int64), 0)
    floor = np.minimum(cap, least)
    seats = max(min(seats, int(cap.sum())), int(floor.sum()))
    held = np.zeros(len(w), np.int64)
    if seats <= 0:
        return held.tolist()
    at = lambda x: np.maximum(np.minimum(np.floor((w / x + 1) / 2), cap), floor).astype(np.int64)  # noqa: E731  seats whose quotient is at least x
    lo, hi = float(w[w > 0].min()) / (2 * int(cap.max()) + 2), float(w.max()) * 2
    for _ in range(200):  # a quotient bound that gives away no more than there is, and nearly all of it
        mid = math.sqrt(lo) * math.sqrt(hi)
        if at(mid).sum() > seats:
            lo = mid
        else:
            hi = mid
    held = at(hi * (1 + 1e-9))  # equal quotients are all left to the heap, which settles them in order
    heap = [(-w[i] / (2 * held[i] + 1), i) for i in range(len(w)) if held[i] < cap[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(held.sum())):
        _, i = heapq.heappop(heap)
        held[i] += 1
        if held[i] < cap[i]:
            heapq.heappush(heap, (-w[i] / (2 * held[i] + 1), i))
    return held.tolist()


@dataclass(frozen=True)
class Target:
    source: str
    weight: float
    max_repeat: int


def read_targets(targets: DataFrame) -> list[Target]:
    """The targets, few by nature; more than MAX_TARGETS are refused."""
    rows = (
        targets.select(source_key(F.col("source")).alias("source"), F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"), F.greatest(F.coalesce("max_repeat", F.lit(1)), F.lit(0)).alias("cap"))
        .filter("source is not null")
        .distinct()
        .groupBy("source")
        .agg(F.sum("weight").alias("weight"), F.max("cap").alias("cap"))
        .orderBy("source")
        .limit(MAX_TARGETS + 1)
        .collect()
    )
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    return [Target(r.source, float(r.weight), int(r.cap)) for r in rows]


def token_sizes(docs: DataFrame, doc_id: str, text: str, source: str, names: list[str], ranks: str, pattern: str) -> DataFrame:
    """(doc_id, source, tokens) of the documents of the named sources."""

    def count(batches):
        enc = encoding(ranks, pattern)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), source_key(F.col(source)).alias("source"), F.col(text).cast("string").alias("text"))
    return rows.filter(F.col("source").isin(names) & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).mapInArrow(count, "doc_id bigint, source string, tokens bigint").filter("tokens > 0")


def mixture(docs: DataFrame, targets: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, total_tokens: int | None = None, tolerance: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, shard, block, tokens, repeats) of the documents used, and a report with one row for each target."""
    spark = docs.sparkSession
    wanted = read_targets(targets)
    weighted = [t for t in wanted if t.weight > 0 and t.max_repeat > 0]
    sizes = materialize(token_sizes(docs, doc_id, text, source, [t.source for t in weighted], ranks, pattern), "sizes")
    rows = {r.source: r.n for r in sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    shards = [(s, max(1, math.ceil(n / SHARD_DOCS))) for s, n in rows.items()]
    dealt = sizes.join(F.broadcast(spark.createDataFrame(shards or [("", 1)], "source string, shards int")), "source")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.col("shards")).cast("int")).repartition("source", "shard").groupBy("source", "shard", "doc_id").agg(F.max("tokens").alias("tokens"))
    dealt = materialize(dealt, "dealt")
    parts_of = dealt.groupBy("source", "shard").agg(F.sum("tokens").alias("tokens")).orderBy("source", "shard").collect()  # one for each SHARD_DOCS documents
    have: dict[str, int] = {}
    for r in parts_of:
        have[r.source] = have.get(r.source, 0) + r.tokens
    active = [t for t in weighted if t.source in have]
    all_weight = sum(t.weight for t in active)
    if total_tokens == LARGEST:
        total_tokens = max((have[t.source] for t in active), default=0)
    total = total_tokens if total_tokens is not None else min((int(have[t.source] * t.max_repeat * all_weight / t.weight / (1 - tolerance)) for t in active), default=0)
    block = max(LEAST_BLOCK, math.ceil(total / MAX_BLOCKS))
    by: dict[str, list] = {}
    for r in parts_of:
        by.setdefault(r.source, []).append((r.shard, max(1, round(r.tokens / block))))
    caps = [sum(n for _, n in by[t.source]) * t.max_repeat for t in active]
    rng = np.random.default_rng(seed)
    quotas = []
    for t, q in zip(active, apportion([t.weight for t in active], caps, round(total / block), least=1)):
        parts = by[t.source]
        for (shard, n), k in zip(parts, apportion([n for _, n in parts], [n * t.max_repeat for _, n in parts], q)):
            quotas.append((t.source, shard, n, k // n, k % n, int(rng.integers(n))))
    plan = spark.createDataFrame(quotas, "source string, shard int, blocks int, whole int, more int, first int")

    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id")
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each shard: joined by broadcast while that is small
    plan = F.broadcast(plan) if len(quotas) <= 200_000 else plan
    placed = dealt.withColumn("before", before).join(plan, ["source", "shard"])
    placed = placed.withColumn("block", F.least(F.floor(F.col("before") / block), F.col("blocks") - 1).cast("int"))
    extra = F.pmod(F.col("block") - F.col("first"), F.col("blocks")) < F.col("more")
    # where the blocks in a row are inside one long document, that is used
    own = Window.partitionBy("source", "shard")
    begin = F.col("first") * block
    covers = (F.col("before") <= begin) & (begin < F.col("before") + F.col("tokens")) | (F.col("before") + F.col("tokens") >= F.sum("tokens").over(own)) & (F.sum("tokens").over(own) <= begin)
    placed = placed.withColumn("extra", extra.cast("int")).withColumn("extra", F.when((F.col("more") > 0) & (F.max("extra").over(own) == 0), covers.cast("int")).otherwise(F.col("extra")))
    chosen = placed.withColumn("repeats", F.col("whole") + F.col("extra")).filter("repeats > 0").select("doc_id", "source", "shard", "block", "tokens", "repeats")

    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("repeats"))
    goal = [(t.source, t.weight / all_weight if t in active else 0.0, t.max_repeat, have.get(t.source, 0)) for t in wanted]
    report = (
        spark.createDataFrame(goal, "source string, target_share double, max_repeat int, available_tokens bigint")
        .join(used, "source", "left")
        .select(
            "source",
            "target_share",
            (F.coalesce("used", F.lit(0)) / F.coalesce(F.sum("used").over(Window.partitionBy()), F.lit(1))).alias("share"),
            F.coalesce("used", F.lit(0).cast("long")).alias("tokens"),
            "available_tokens",
            F.coalesce("documents", F.lit(0).cast("long")).alias("documents"),
            "max_repeat",
            F.coalesce("repeats", F.lit(0)).alias("most_repeats"),
        )
        .withColumn("note", _note())
    )
    return chosen, report


def _note() -> Column:
    off = F.abs(F.col("share") - F.col("target_share")) > F.lit(NOTED) * F.col("target_share")
    return (
        F.when(F.col("available_tokens") == 0, F.when(F.col("target_share") == 0, "not asked for, or no documents").otherwise("no documents"))
        .when(F.col("target_share") == 0, "not asked for")
        .when(off & (F.col("share") < F.col("target_share")) & (F.col("tokens") >= F.col("available_tokens") * F.col("max_repeat")), "used up")
        .when(off & (F.col("share") < F.col("target_share")), "its documents are large beside its share, or others took more")
        .when(off, "its documents are large beside its share, or others ran out")
    )
