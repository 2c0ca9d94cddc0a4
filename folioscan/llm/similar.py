"""Pairs of records whose texts resemble each other, by pigeonring filtering.

Resemblance is the share of common shingles (runs of ``size`` consecutive tokens) among all shingles of both. Two shingle
sets with resemblance >= t differ in at most H = (1 - t) / (1 + t) * (|A| + |B|) shingles, the Hamming distance of their
characteristic vectors. Steps:

1. Each text is cut into tokens once; its shingle hashes, and parity bits of them, are written. Records with the same
   token sequence form a class; from here on only one text of each class takes part, so copies never meet in a group.
2. Every shingle is counted exactly: occurrences are sent to buckets of shingles and from there, with their counts, to
   buckets of texts, as long runs of numbers rather than as rows. Shingles that are in one text alone need no partner and
   are left behind. Very frequent ones are nominated by tasks, counted where they lie and told to all tasks, so that no
   bucket gets all occurrences of one.
3. Candidates share a shingle of both prefixes, the rarest shingles of each text (prefix filter: exact, for one order of
   all shingles). The smaller text of a pair needs the shorter prefix. The sizes are part of the join key, as classes of
   which only neighbours can match, and a shingle that more than ``block`` texts have is joined block by block on both
   sides, so a task compares at most block ** 2 pairs for a key.
4. Pigeonring: shingles are hashed to parity bits in RING segments, more bits the larger the set. Of any ring whose
   differences add up to at most H, some segment starts a chain of consecutive segments whose cumulative differences stay
   within 1, 2, 3, ... times H / RING. Parities never show more differences than there are, so pairs without such a chain
   are dropped safely, before their shingles are brought together.
5. The full Hamming check on the whole shingle sets decides.

Defined results: null texts and texts under ``least`` tokens take part in no pair; ids that are null are left out;
repeated ids count once; an empty table gives no pairs. Links have a row for each id, whatever its text. Texts are used whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.text import TokenHashes, mix, shingle_hashes, small_batches, tokens, utf8
from folioscan.storage import materialize

RING = 4
#: Parity bits for each shingle of a set, at least; a power of two of words of 64 bits in each segment.
BITS_FOR_EACH = 2
#: Up to this many copies are told to all tasks; beyond it, texts of representatives are picked by a shuffle.
BROADCAST_COPIES = 1_000_000
#: A task nominates shingles in more than 1 / FREQUENT of its texts (and in LEAST_NOMINATED at least); the TOLD_FREQUENT with
#: most occurrences are told to all tasks. Any other has no more occurrences than the sum of what tasks do not nominate.
FREQUENT, LEAST_NOMINATED, TOLD_FREQUENT = 1000, 50, 200_000
#: Shingles that a bucket holds.
BUCKET = 1_000_000


@dataclass(frozen=True)
class Similarity:
    threshold: float = 0.8
    size: int = 5
    least: int = 20
    #: texts of one shingle, or members of one class, that meet in one task
    block: int = 1_000

    def budget(self, a: Column, b: Column) -> Column:
        """The most shingles in which sets of these sizes may differ; the small term keeps rounding from losing pairs."""
        return F.floor((a + b) * F.lit((1 - self.threshold) / (1 + self.threshold)) + F.lit(1e-9))

    def prefix(self, n: Column, share: float) -> Column:
        """How many shingles of a set of n cannot all be missed by a set that has at least this share of them."""
        return n - F.ceil(n * F.lit(share) - F.lit(1e-9)) + 1

    def size_class(self, n: Column) -> Column:
        """Sets that can match are in the same or in neighbouring classes."""
        return F.floor(F.ln(n.cast("double")) / F.lit(-math.log(self.threshold)) + F.lit(1e-9)).cast("int")


def _sets(column: pa.Array, known: TokenHashes, sim: Similarity) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Shingle sets of all texts of a batch, each sorted, one after the other, and their bounds, empty for null texts and
    those that are too short; and a key of the token sequence of each text that is long enough, else None."""
    toks = [tokens(t) if t else [] for t in utf8(column)]
    keys = [xxhash.xxh3_128_digest(b" ".join(t)) if len(t) >= sim.least else None for t in toks]
    toks = [t if len(t) >= sim.least else [] for t in toks]
    counts = np.array([len(t) for t in toks], np.int64)
    h = known.of(list(chain.from_iterable(toks)))
    n = np.maximum(counts - sim.size + 1, 0)
    first = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else counts
    bounds = np.concatenate(([0], np.cumsum(n)))
    at = np.arange(bounds[-1]) + np.repeat(first - bounds[:-1], n)  # where each shingle begins
    flat = shingle_hashes(h, at, sim.size)
    for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        flat[x:y].sort()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[bounds[:-1][n > 0]] = True
    return flat[new], np.concatenate(([0], np.cumsum(new)))[bounds], keys


def ring_words(n: np.ndarray) -> np.ndarray:
    """Words of 64 bits in the ring of a set of n shingles: RING times a power of two."""
    return RING << np.ceil(np.log2(np.maximum(n * BITS_FOR_EACH, RING * 64) / (RING * 64))).astype(np.int64)


def _rings(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bits of each set, and the bounds of their words. The low bits of a shingle tell its place, so a ring of twice
    the length folds to the shorter one."""
    words = ring_words(np.diff(bounds))
    ends = np.concatenate(([0], np.cumsum(words)))
    owner = np.repeat(np.arange(len(words)), np.diff(bounds))
    at = ends[owner] * 64 + (flat & (words[owner] * 64 - 1).astype(np.uint64)).astype(np.int64)
    bits = (np.bincount(at, minlength=int(ends[-1]) * 64) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view("<i8"), ends


def shingled(docs: DataFrame, sim: Similarity) -> DataFrame:
    """(doc_id, k1, k2, n, ring, sh) of the texts of at least ``least`` tokens; docs has doc_id and text."""

    def emit(batches):
        known = TokenHashes()
        for b in small_batches(batches, 1):
            flat, bounds, keys = _sets(b.column(1), known, sim)
            rings, ends = _rings(flat, bounds)
            k = np.frombuffer(b"".join(x or bytes(16) for x in keys), "<i8").reshape(-1, 2)
            lists = lambda v, e: pa.ListArray.from_arrays(pa.array(e.astype(np.int32)), pa.array(v.view(np.int64)))
            out = pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.ascontiguousarray(k[:, 0])), pa.array(np.ascontiguousarray(k[:, 1])), pa.array(np.diff(bounds).astype(np.int32)), lists(rings, ends), lists(flat, bounds)],
                ["doc_id", "k1", "k2", "n", "ring", "sh"],
            )
            yield out.filter(pa.array([x is not None for x in keys], pa.bool_()))

    return docs.mapInArrow(emit, "doc_id bigint, k1 bigint, k2 bigint, n int, ring array<bigint>, sh array<bigint>")


@dataclass(frozen=True)
class Classes:
    #: (rep, last): of each class the least and the greatest id
    groups: DataFrame
    #: (doc_id, rep) of the classes that have more than one id
    members: DataFrame
    #: (rep, n, ring, sh): a shingle set for each class
    reps: DataFrame


def classes(docs: DataFrame, doc_id: str, text: str, sim: Similarity) -> Classes:
    """Classes of equal token sequences. They are formed on hashes, combined before the shuffle, so that a hot class sends
    one slim row a task. An id must stand for one text; its repeated rows do no harm."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id is not null and text is not null")
    sets = materialize(shingled(base, sim), "sets")
    keyed = sets.select("doc_id", "k1", "k2")
    groups = materialize(keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "classes")
    members = materialize(keyed.join(groups.filter("last > rep").select("k1", "k2", "rep"), ["k1", "k2"]).select("doc_id", "rep").distinct(), "members")
    others = members.filter("doc_id <> rep").select("doc_id")
    if others.count() <= BROADCAST_COPIES:  # sets stay where they are
        reps = sets.join(F.broadcast(others), "doc_id", "left_anti")
    else:
        reps = sets.join(groups.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    return Classes(groups, members, reps.select(F.col("doc_id").alias("rep"), "n", "ring", "sh"))


RUNS = "kind int, bucket int, reps binary, counts binary, tokens binary"


def _run(kind: int, bucket: int, reps: np.ndarray, counts: np.ndarray, tokens: np.ndarray) -> tuple:
    return kind, bucket, reps.astype("<i8").tobytes(), counts.astype("<i4").tobytes(), tokens.view("<i8").tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["kind", "bucket", "reps", "counts", "tokens"])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of an array of lists without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _text_bucket(reps: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(reps.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _parted(kind: int, at: np.ndarray, buckets: int, reps: np.ndarray, counts: np.ndarray, tokens: np.ndarray) -> list[tuple]:
    """Runs for each bucket."""
    order = np.argsort(at, kind="stable")
    ends = np.cumsum(np.bincount(at, minlength=buckets))
    out, begin = [], 0
    for k, end in enumerate(ends.tolist()):
        if end > begin:
            own = order[begin:end]
            out.append(_run(kind, k, reps[own], counts[own], tokens[own]))
        begin = end
    return out


def frequent_shingles(reps: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts have, sorted, and their exact counts; at most TOLD_FREQUENT."""

    def nominate(batches):
        known, n, docs = np.empty(0, np.int64), np.empty(0, np.int64), 0
        for b in batches:
            values, _ = _lists(b.column(0))
            docs += b.num_rows
            known, inverse = np.unique(np.concatenate((known, values)), return_inverse=True)
            n = np.bincount(inverse, np.concatenate((n, np.ones(len(values), np.int64))), len(known)).astype(np.int64)
            if len(known) > BUCKET:  # what falls out here was in few of the texts so far
                keep = n > docs // (2 * FREQUENT) + 1
                known, n = known[keep], n[keep]
        keep = n >= max(LEAST_NOMINATED, docs // FREQUENT)
        yield pa.RecordBatch.from_arrays([pa.array(known[keep]), pa.array(n[keep])], ["token", "n"])

    def count(batches):
        tokens = shared.value
        n = np.zeros(len(tokens), np.int64)
        for b in batches:
            values, _ = _lists(b.column(0))
            at = np.minimum(np.searchsorted(tokens, values), len(tokens) - 1)
            n += np.bincount(at[tokens[at] == values], minlength=len(tokens))
        yield pa.RecordBatch.from_arrays([pa.array(tokens[n > 0]), pa.array(n[n > 0])], ["token", "n"])

    rows = reps.select("sh").mapInArrow(nominate, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(TOLD_FREQUENT).toArrow()
    if not rows.num_rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shared = reps.sparkSession.sparkContext.broadcast(np.sort(rows.column("token").to_numpy()))
    exact = reps.select("sh").mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    order = np.argsort(exact.column("token").to_numpy())
    return exact.column("token").to_numpy()[order], exact.column("n").to_numpy()[order]


def features(reps: DataFrame, sim: Similarity) -> DataFrame:
    """(rep, n, ring, counts, sh): of each text the shingles that other texts have too, rarest first, and in how many texts
    they are. Texts without any are left out."""
    spark = reps.sparkSession
    total = reps.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    buckets = max(12, math.ceil(total / BUCKET))
    tokens, counts = frequent_shingles(reps)
    shared = spark.sparkContext.broadcast((tokens, counts))

    def known(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a shingle is among the frequent ones, and its count."""
        t, n = shared.value
        if not len(t):
            return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
        at = np.minimum(np.searchsorted(t, values), len(t) - 1)
        return t[at] == values, n[at]

    def to_shingles(batches):
        for b in batches:
            values, lens = _lists(b.column(1))
            owner = np.repeat(b.column(0).to_numpy(), lens)
            rest = ~known(values)[0]
            values, owner = values[rest], owner[rest]
            at = ((values.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            if runs := _parted(0, at, buckets, owner, np.zeros(len(at)), values):
                yield _batch(runs)

    def to_texts(batches):
        """Sizes and rings of the texts, and their frequent shingles."""
        for b in batches:
            ids, n = b.column(0).to_numpy(), b.column(2).to_numpy()
            rings, words = _lists(b.column(3))
            at, begins = _text_bucket(ids, buckets), np.cumsum(words) - words
            runs = [_run(1, k, ids[own], n[own], rings[np.repeat(begins[own], words[own]) + _counting(words[own])]) for k in np.unique(at) for own in [np.flatnonzero(at == k)]]
            values, lens = _lists(b.column(1))
            hit, count = known(values)
            owner = np.repeat(ids, lens)[hit]
            yield _batch(runs + _parted(0, _text_bucket(owner, buckets), buckets, owner, count[hit], values[hit]))

    def counted(batches):
        """Of a bucket of shingles, those of several texts go to the texts with their counts."""
        runs = [_read(r) for b in batches for r in _rows(b)]
        owner, values = np.concatenate([r[1] for r in runs]), np.concatenate([r[3] for r in runs])
        order = np.argsort(values, kind="stable")
        owner, values = owner[order], values[order]
        starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        n = np.diff(np.append(starts, len(values)))
        count = np.repeat(n, n)
        keep = count > 1
        if keep.any():
            yield _batch(_parted(0, _text_bucket(owner[keep], buckets), buckets, owner[keep], count[keep], values[keep]))

    def gathered(batches):
        """A bucket of texts: the shingles of each in order, beside its size and ring."""
        runs = [_read(r) for b in batches for r in _rows(b)]
        heads, own = [r for r in runs if r[0] == 1], [r for r in runs if r[0] == 0]
        if not heads or not own:
            return
        ids, n, rings = (np.concatenate([r[k] for r in heads]) for k in (1, 2, 3))
        words = ring_words(n)
        begins = np.cumsum(words) - words
        ids, first = np.unique(ids, return_index=True)
        owner, count, values = (np.concatenate([r[k] for r in own]) for k in (1, 2, 3))
        order = np.lexsort((values, count, owner))
        owner, count, values = owner[order], count[order], values[order]
        new = np.ones(len(owner), bool)  # repeated rows of a text bring its shingles again
        new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
        owner, count, values = owner[new], count[new], values[new]
        texts, lens = np.unique(owner, return_counts=True)
        at = first[np.searchsorted(ids, texts)]
        ends = lambda x: pa.array(np.concatenate(([0], np.cumsum(x))).astype(np.int32))
        ring = pa.ListArray.from_arrays(ends(words[at]), pa.array(rings[np.repeat(begins[at], words[at]) + _counting(words[at])]))
        lists = [pa.ListArray.from_arrays(ends(lens), pa.array(x)) for x in (count.astype(np.int32), values)]
        yield pa.RecordBatch.from_arrays([pa.array(texts), pa.array(n[at].astype(np.int32)), ring, *lists], ["rep", "n", "ring", "counts", "sh"])

    seen = reps.select("rep", "sh").mapInArrow(to_shingles, RUNS).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_streamed(counted), RUNS)
    runs = seen.unionByName(reps.select("rep", "sh", "n", "ring").mapInArrow(to_texts, RUNS))
    return materialize(runs.groupBy("bucket").applyInArrow(_streamed(gathered), "rep bigint, n int, ring array<bigint>, counts array<int>, sh array<bigint>"), "features")


def _streamed(f):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)

    return run


def _counting(lens: np.ndarray) -> np.ndarray:
    """0, 1, ... for each length."""
    return np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)


def _rows(b: pa.RecordBatch):
    return zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("kind", "reps", "counts", "tokens")))


def _read(row: tuple) -> tuple:
    return row[0], np.frombuffer(row[1], "<i8"), np.frombuffer(row[2], "<i4").astype(np.int64), np.frombuffer(row[3], "<i8")


def _folded(ring: Column, words: Column) -> Column:
    """A ring folded to ``words`` words: parities of the halves, again and again."""
    times = (F.size(ring) / words).cast("int")
    place = lambda w: F.aggregate(F.sequence(F.lit(0), times - 1), F.lit(0).cast("long"), lambda s, i: s.bitwiseXOR(F.get(ring, w + i * words)))
    return F.when(F.size(ring) == words, ring).otherwise(F.transform(F.sequence(F.lit(0), words - 1), place))


def ring_holds(segments: list[Column], budget: Column) -> Column:
    """Whether some segment starts a chain of which every beginning of k segments differs in at most k / RING of the budget;
    ``segments``: the differing bits of each."""
    starts = []
    for i in range(RING):
        total, ok = segments[i], segments[i] * RING <= budget
        for k in range(2, RING + 1):
            total = total + segments[(i + k - 1) % RING]
            ok = ok & (total * RING <= budget * k)
        starts.append(ok)
    return reduce(lambda x, y: x | y, starts)


def _whole_ring_holds(a: Column, b: Column, budget: Column) -> Column:
    words = F.least(F.size(a), F.size(b))
    apart = F.zip_with(_folded(a, words), _folded(b, words), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    each = (words / RING).cast("int")
    return ring_holds([F.aggregate(F.slice(apart, each * i + 1, each), F.lit(0), lambda s, x: s + x) for i in range(RING)], budget)


def _cells(rows: DataFrame, first: bool) -> DataFrame:
    """Rows with the cells (i, j) of blocks of their shingle in which they meet others: on the first side a row of block i
    goes to all (i, j), on the second one of block j."""
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    i, j = (own, F.col("o")) if first else (F.col("o"), own)
    return rows.withColumn("cell", i.cast("long") * F.col("parts") + j)


def candidates(feats: DataFrame, sim: Similarity) -> DataFrame:
    """Distinct pairs (a, b), a < b, that share a prefix shingle and whose sizes allow the threshold."""
    t = sim.threshold
    lone = F.col("n") - F.size("sh")  # the rarest of all: they are in no other text

    def side(share: float, s: str, neighbours: list[int]) -> DataFrame:
        take = F.greatest(F.lit(0), sim.prefix(F.col("n"), share) - lone).cast("int")
        first = F.arrays_zip(F.slice("counts", F.lit(1), take).alias("count"), F.slice("sh", F.lit(1), take).alias("token"))
        rows = feats.select("rep", "n", F.explode(first).alias("x")).select("rep", "n", "x.token", F.ceil(F.col("x.count") / sim.block).cast("int").alias("parts"))
        rows = rows.withColumn("class", F.explode(F.array(*[sim.size_class(F.col("n")) + k for k in neighbours])) if neighbours != [0] else sim.size_class(F.col("n")))
        return _cells(rows, s == "a").select("token", "class", "cell", F.col("rep").alias(s), F.col("n").alias(f"{s}_n"))

    # the smaller text, of equal ones that with the lesser id, meets the larger in the class of the larger
    small, large = side(2 * t / (1 + t), "a", [0, 1]), side(t, "b", [0])
    ordered = F.struct("a_n", "a") < F.struct("b_n", "b")
    fits = F.col("a_n") >= F.col("b_n") * F.lit(t - 1e-9)
    return small.join(large, ["token", "class", "cell"]).filter(ordered & fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _beside(pairs: DataFrame, feats: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Pairs with columns of both texts."""
    side = lambda s: feats.select(F.col("rep").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in columns])
    return pairs.join(side("a"), "a").join(side("b"), "b")


def similar_classes(found: Classes, sim: Similarity, report: Callable[[str, DataFrame], None] | None = None) -> DataFrame:
    """(a, b): pairs of class representatives at or above the threshold. ``report`` is told what each step leaves."""
    feats = features(found.reps, sim)
    pairs = candidates(feats, sim)
    budget = sim.budget(F.col("a_n"), F.col("b_n"))
    ringed = materialize(_beside(pairs, feats, ("n", "ring")).filter(_whole_ring_holds(F.col("a_ring"), F.col("b_ring"), budget)).select("a", "b", "a_n", "b_n"), "candidates")
    # the full Hamming check: shingles in one text alone are in the sizes, and in no common part
    common = F.size(F.array_intersect("a_sh", "b_sh"))
    out = _beside(ringed, feats, ("sh",)).filter(F.col("a_n") + F.col("b_n") - 2 * common <= budget).select("a", "b")
    if report:
        report("prefixes and sizes", pairs)
        report("ring", ringed)
        report("similar", out)
    return out


def _expanded(links: DataFrame, members: DataFrame, sizes: DataFrame, rep: str, out: str, block: int) -> DataFrame:
    """Links with each member of the class ``rep`` in its place. Members of large classes are spread over tasks, and the
    link is sent to all of them. Links of classes of one keep their representative."""
    spread = sizes.select(F.col("rep").alias(rep), F.ceil(F.col("ids") / block).cast("int").alias("parts"))
    salted = links.join(spread, rep, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))))
    own = members.join(sizes, "rep").select(F.col("rep").alias(rep), F.col("doc_id").alias(out), F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("ids") / block).cast("int")).cast("int").alias("salt"))
    met = salted.join(own, [rep, "salt"], "left").filter(F.col(out).isNotNull() | F.col("parts").isNull())
    return met.withColumn(out, F.coalesce(out, rep)).drop("salt", "parts")


def similar_pairs(docs: DataFrame, doc_id: str, text: str, sim: Similarity) -> DataFrame:
    """(doc_id_a, doc_id_b): all pairs of records, copies expanded whatever the size of a class: as many rows as there are
    pairs. Where that is too much, ``similar_links`` and ``class_links`` tell the same in one row for each record and one
    for each pair of classes."""
    found = classes(docs, doc_id, text, sim)
    sizes = materialize(found.members.groupBy("rep").agg(F.count(F.lit(1)).alias("ids")), "sizes")
    links = _expanded(similar_classes(found, sim), found.members, sizes, "a", "d_a", sim.block)
    across = _expanded(links, found.members, sizes, "b", "d_b", sim.block).select("d_a", "d_b")
    pairs_of = found.members.select(F.col("rep").alias("a"), F.col("doc_id").alias("d_a"))
    within = _expanded(pairs_of, found.members, sizes, "a", "d_b", sim.block).filter("d_a < d_b").select("d_a", "d_b")
    return across.unionByName(within).select(F.least("d_a", "d_b").alias("doc_id_a"), F.greatest("d_a", "d_b").alias("doc_id_b"))


def class_links(docs: DataFrame, doc_id: str, text: str, sim: Similarity) -> DataFrame:
    """(class_a, class_b): pairs of different texts, each by the least id that has it; see similar_links for the members."""
    return similar_classes(classes(docs, doc_id, text, sim), sim).select(F.col("a").alias("class_a"), F.col("b").alias("class_b"))


def similar_links(docs: DataFrame, doc_id: str, text: str, sim: Similarity) -> DataFrame:
    """One row for each id: its class of copies, how many records share its text, how many other texts resemble it. A record
    without text, or with one under ``least`` tokens, is a class of its own without links."""
    found = classes(docs, doc_id, text, sim)
    links = similar_classes(found, sim).select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    members = found.members.unionByName(found.groups.filter("last = rep").select(F.col("rep").alias("doc_id"), "rep"))
    linked = (
        members.join(members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies")), "rep")
        .join(links, "rep", "left")
        .select("doc_id", F.col("rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    )
    alone = docs.select(F.col(doc_id).cast("long").alias("doc_id")).filter("doc_id is not null").distinct().join(members.select("doc_id"), "doc_id", "left_anti")
    return linked.unionByName(alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("links")))
