import random
import re

import pytest

from folioscan.llm.leak import leaks


def words(t):
    return [w.lower() for w in re.findall("[A-Za-z0-9]+", re.sub(r"(?s)\\f.", "", t or ""))]


def longest(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
                best = max(best, new[j + 1])
        row = new
    return best


def data(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["a", "7"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40)))) for i in range(15)]
    docs = []
    for i in range(80):
        t = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.7:
            src = rng.choice(items)[1].split(" ")
            a = rng.randrange(len(src))
            t[5:5] = src[a : a + rng.randint(10, 14)]
        docs.append((i, rng.choice([" ", "\n > ", " — ", "\\fB \\fR"]).join(w.upper() if rng.random() < 0.2 else w for w in t)))
    return docs, items


@pytest.mark.parametrize("block", [16 << 20, 300])
def test_against_brute_force(spark, block):
    docs, items = data(4)
    docs += [(1000, None), (None, items[0][1]), (1001, ""), docs[0]]
    items += [(100, None), (None, "x"), items[0], (101, "font\\fBbreak " * 15)]
    docs += [(1002, "FONTbreak, " * 13)]
    got = leaks(spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, words int, item_id string"), "doc_id", "text", spark.createDataFrame(items, "item_id bigint, text string"), "item_id", "text", block_bytes=block)
    want = {(d, i, n) for d, t in docs for i, u in items if d is not None and i is not None and (n := longest(words(t), words(u))) >= 12}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) and (1002, 101, 13) in want


def test_very_long_text_and_empty_tables(spark):
    item = " ".join(f"q{i}" for i in range(12))
    docs = spark.createDataFrame([(1, "word " * 600_000 + item), (2, "word " * 10)], "doc_id bigint, text string")
    items = spark.createDataFrame([(5, item), (6, item.rsplit(" ", 1)[0])], "item_id bigint, text string")
    assert [tuple(r) for r in leaks(docs, "doc_id", "text", items, "item_id", "text").collect()] == [(1, 5, 12)]
    assert leaks(docs.filter("false"), "doc_id", "text", items, "item_id", "text").count() == 0
    assert leaks(docs, "doc_id", "text", items.filter("false"), "item_id", "text").count() == 0


def test_repeated_words_on_both_sides(spark):
    """Fingerprints that stand everywhere on both sides are met a bounded number at a time."""
    same = "buffer " * 3000
    docs = spark.createDataFrame([(1, same), (2, "x " + same[:7 * 11])], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "buffer " * 900), (2, "buffer " * 12)], "item_id bigint, text string")
    got = sorted(map(tuple, leaks(docs, "doc_id", "text", items, "item_id", "text").collect()))
    assert [r[:2] for r in got] == [(1, 1), (1, 2)] and {r[1]: r[2] for r in got} == {1: 900, 2: 12}
