import itertools
import random

import pytest
from pyspark.sql import functions as F

from folioscan.llm import similar
from folioscan.llm.similar import Similarity, class_links, classes, ring_holds, similar_classes, similar_links, similar_pairs


def grams(text, k):
    import re

    t = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    return t, {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}


def brute(rows, sim):
    sets = {}
    for i, t in rows:
        toks, g = grams(t, sim.size)
        if t is not None and i is not None and len(toks) >= sim.least:
            sets[i] = g
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= sim.threshold * len(sets[a] | sets[b]) - 1e-12 and (sets[a] or sets[b])}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Émile", "straße"]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        for j in range(rng.randint(1, 4)):
            t = list(base)
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(words)
            if rng.random() < 0.3:
                t = t[3:] + t[:3]
            rows.append((i * 10 + j, rng.choice([" ", "  ", "\n"]).join(w.upper() if w.isascii() and rng.random() < 0.1 else w for w in t)))
    return rows


@pytest.mark.parametrize("sim", [Similarity(0.7, 3, 20), Similarity(0.8, 5, 20), Similarity(0.7, 3, 20, block=2), Similarity(0.5, 2, 6)])
def test_against_brute_force(spark, sim):
    rows = corpus(11) + [(9000, None), (9001, ""), (9002, "too short")]
    got = [tuple(r) for r in similar_pairs(spark.createDataFrame(rows, "doc_id bigint, body string"), "doc_id", "body", sim).collect()]
    assert set(got) == brute(rows, sim) and len(got) == len(set(got))


def test_copies_long_texts_and_clashing_names(spark):
    rng = random.Random(2)
    long = " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(50_000))
    rows = [(1, long), (2, long + " more"), (3, "a b " * 20), (4, "A  b " * 20), (5, "a,b." * 20), (3, "a b " * 20)]
    df = spark.createDataFrame([(i, t, 7, "x", 3) for i, t in rows], "doc_id bigint, desc string, rep int, norm string, token int")
    sim = Similarity(0.7, 3, 20)
    assert sorted(map(tuple, similar_pairs(df, "doc_id", "desc", sim).collect())) == [(1, 2), (3, 4), (3, 5), (4, 5)]
    links = {r.doc_id: (r.class_id, r.copies, r.links) for r in similar_links(df, "doc_id", "desc", sim).collect()}
    assert links == {1: (1, 1, 1), 2: (2, 1, 1), 3: (3, 3, 0), 4: (3, 3, 0), 5: (3, 3, 0)}


def test_links_have_a_row_for_each_id(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(1, text), (2, text), (3, text + " end"), (4, None), (5, ""), (6, "too short"), (6, "too short"), (7, "too short"), (None, text), (None, None)]
    got = sorted(map(tuple, similar_links(spark.createDataFrame(rows, "doc_id bigint, d string"), "doc_id", "d", Similarity(0.7, 3, 20)).collect()))
    assert got == [(1, 1, 2, 1), (2, 1, 2, 1), (3, 3, 1, 1), (4, 4, 1, 0), (5, 5, 1, 0), (6, 6, 1, 0), (7, 7, 1, 0)]


def test_large_classes_keep_all_pairs(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(i, text) for i in range(6)] + [(100, text + " end"), (101, text + " end")]
    rows += rows[:3]  # repeated rows do not make a class larger
    df = spark.createDataFrame(rows, "doc_id bigint, d string")
    for sim in (Similarity(0.7, 3, 20), Similarity(0.7, 3, 20, block=2)):
        got = sorted(map(tuple, similar_pairs(df, "doc_id", "d", sim).collect()))
        assert got == list(itertools.combinations([*range(6), 100, 101], 2))
    assert list(map(tuple, class_links(df, "doc_id", "d", Similarity(0.7, 3, 20)).collect())) == [(0, 100)]


def test_a_class_beyond_a_thousand(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(i, text) for i in range(1201)] + [(5000, text + " end")]
    got = similar_pairs(spark.createDataFrame(rows, "doc_id bigint, d string"), "doc_id", "d", Similarity(0.7, 3, 20))
    assert got.count() == got.distinct().count() == 1202 * 1201 // 2


def test_shingle_in_every_text(spark, monkeypatch):
    """Texts that all share a passage but are not similar, by each way in which frequent shingles are counted."""
    rng = random.Random(8)
    head = " ".join(f"h{i}" for i in range(12))
    rows = [(i, head + " " + " ".join(f"x{rng.randint(0, 400)}" for _ in range(30))) for i in range(200)]
    rows += [(1000 + i, t.replace("x1", "y1", 1)) for i, t in rows[:40]]
    sim, df = Similarity(0.7, 3, 20, block=3), spark.createDataFrame(rows, "doc_id bigint, d string")
    want = brute(rows, sim)
    assert len(want) >= 40
    assert set(map(tuple, similar_pairs(df, "doc_id", "d", sim).collect())) == want
    monkeypatch.setattr(similar, "BROADCAST_COPIES", 0)
    assert set(map(tuple, similar_pairs(df.withColumn("d", F.concat("d", F.lit("."))), "doc_id", "d", sim).collect())) == want


def test_frequent_shingles_are_counted_exactly(spark):
    rows = [(i, [7, i + 1000, *([8] if i % 3 == 0 else [])]) for i in range(900)]
    tokens, counts = similar.frequent_shingles(spark.createDataFrame(rows, "rep bigint, sh array<bigint>").repartition(3))
    assert (tokens.tolist(), counts.tolist()) == ([7, 8], [900, 300])


@pytest.mark.parametrize("length", [100, 500, 2000])
def test_pruning_by_steps(spark, length, capsys):
    """What each step leaves, of texts that share passages without being similar and some that are."""
    rng = random.Random(length)
    pool = [" ".join(f"p{k}_{i}" for i in range(length // 10)) for k in range(12)]  # passages that many texts have
    rows = []
    for i in range(60):
        t = []
        for _ in range(8):
            t += rng.choice(pool).split() if rng.random() < 0.6 else [f"u{rng.randint(0, 10**6)}" for _ in range(length // 10)]
        rows.append((i, " ".join(t)))
        if i % 6 == 0:
            for k in range(3, len(t), 60):
                t[k] = "edit"
            rows.append((1000 + i, " ".join(t)))
    sim, left = Similarity(0.7, 3, 20), {}
    df = spark.createDataFrame(rows, "doc_id bigint, d string")
    got = set(map(tuple, similar_classes(classes(df, "doc_id", "d", sim), sim, lambda step, rows: left.update({step: rows.count()})).collect()))
    assert got == brute(rows, sim) and left["similar"] == len(got) >= 10
    assert left["prefixes and sizes"] >= left["ring"] >= left["similar"]
    assert left["ring"] - left["similar"] <= (left["prefixes and sizes"] - left["similar"]) / 2  # the ring prunes at every length
    with capsys.disabled():
        print(f" {length} words: {left}")


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, d string")
    assert similar_pairs(df, "doc_id", "d", Similarity()).count() == 0


def test_ring_never_drops_a_pair_within_budget(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        a = [rng.getrandbits(64) - 2**63 for _ in range(similar.RING)]
        b = list(a)
        for _ in range(rng.randint(0, 60)):
            i, bit = rng.randrange(similar.RING), rng.randrange(64)
            b[i] = ((b[i] + 2**63) ^ (1 << bit)) - 2**63
        d = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a, b))
        rows.append((a, b, d, rng.randint(0, 60)))
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, d int, budget int")
    apart = [F.bit_count(F.get("a", F.lit(i)).bitwiseXOR(F.get("b", F.lit(i)))) for i in range(similar.RING)]
    rows = df.withColumn("ok", ring_holds(apart, F.col("budget"))).withColumn("whole", similar._whole_ring_holds(F.col("a"), F.col("b"), F.col("budget"))).collect()
    for r in rows:
        assert r.ok == r.whole == (r.d <= r.budget)  # a chain round the whole ring is the whole distance


def test_rings_of_different_lengths(spark):
    """Parities of a set, at any length, differ at most by what the sets differ."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = []
    for n in (60, 130, 260, 700, 2100):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for gone in (0, 1, 7, n // 4):
            b = np.unique(np.concatenate((a[gone:], rng.integers(0, 2**64, gone // 2, dtype=np.uint64))))
            rings, ends = similar._rings(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
            rows.append((rings[ends[0] : ends[1]].tolist(), rings[ends[1] :].tolist(), len(np.setxor1d(a, b))))
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, d int")
    assert len({len(x) for r in rows for x in r[:2]}) > 3 and any(len(r[0]) != len(r[1]) for r in rows)
    assert df.filter(~similar._whole_ring_holds(F.col("a"), F.col("b"), F.col("d"))).count() == 0
    assert df.filter(similar._whole_ring_holds(F.col("a"), F.col("b"), F.lit(-1))).count() == 0
