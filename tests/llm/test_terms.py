import math
import re
from collections import Counter

import numpy as np
import pytest

from folioscan.llm import distinctive, termcount
from folioscan.llm.distinctive import best_terms, fit_two_poisson, term_scores
from folioscan.llm.termcount import mark_terms, radix_leaves, term_counts

ROWS = [(1, "The the cat", "cat"), (2, "a dog Émile ÉMILE", None), (3, None, "x"), (4, "", ""), (5, "the dog", "the"), (5, "the dog", "the"), (6, "z" * 100_000 + " the " * 5000, "!!")]
SCHEMA = "doc_id bigint, desc string, name string"


def toks(t):
    return [x.decode() for x in re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())]


def counted(rows):
    total, pages = Counter(), Counter()
    for _, d, n in rows:
        for f, t in (("desc", d), ("name", n)):
            total.update((f, x) for x in toks(t))
            pages.update({(f, x) for x in toks(t)})
    return {k: (v, pages[k]) for k, v in total.items()}


@pytest.mark.parametrize("cap, mounted", [(1_000_000, None), (2, True), (2, False)])
def test_counts(spark, cap, mounted):
    df = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], SCHEMA + ", field string, total int")
    got = term_counts(df, ["desc", "name"], cap=cap, flush=3, mounted=mounted).collect()
    assert {(r.field, r.term): (r.total, r.pages) for r in got} == counted(ROWS) and len(got) == len(counted(ROWS))


def test_marks(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {(r.field, r.term): (r.mark, r.records) for r in mark_terms(term_counts(df, ["desc", "name"]), df, ["desc", "name"], common=0.5).collect()}
    assert got["desc", "the"] == ("common", 6) and got["desc", "cat"] == ("rare", 6) and got["desc", "dog"] == (None if 3 <= 0.5 * 6 else "common", 6)


def test_a_term_in_every_text(spark):
    rows = [(i, f"the a{i} b{i % 50}", None) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    spilled = termcount.materialize(termcount.partial_counts(df, ["desc"], flush=5).selectExpr("*", "xxhash64(field, term) AS h"), "t")
    assert spilled.filter("term = 'the'").count() > 200  # one row for each flush, all of one hash
    levels = radix_leaves(spilled, 40)
    assert len(levels) > 1 and levels[-1][1] == set()
    for path, gone in levels:  # what is not split further is small, and a term that is alone in its partition is one row there
        sizes = {r.p: r["count"] for r in spark.read.parquet(path).groupBy("p").count().collect()}
        assert all(n <= 40 for p, n in sizes.items() if p not in gone) and all(sizes[p] > 40 for p in gone)
    for cap, mounted in ((1000, None), (40, False)):
        got = term_counts(df, ["desc"], cap=cap, flush=5, mounted=mounted).collect()
        assert {(r.field, r.term): (r.total, r.pages) for r in got} == counted(rows) and len(got) == len(counted(rows))


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert term_counts(df, ["desc"]).count() == 0
    assert term_scores(df, "doc_id", ["desc"]).count() == 0


@pytest.mark.parametrize("frequent, told", [(0.001, 500_000), (0.9, 500_000), (0.001, 2)])
def test_scores(spark, frequent, told):
    rows = [r for i, r in enumerate(ROWS) if i != 5] + [(None, "the cat", "dog")]
    df = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], SCHEMA + ", term string, weight double")
    got = {(r.doc_id, r.term): r for r in term_scores(df, "doc_id", ["desc", "name"], frequent=frequent, told=told).collect()}
    tf = [(i, Counter(toks(d) + toks(n))) for i, d, n in rows]
    df_ = Counter(t for _, c in tf for t in c)
    want = {(i, t): (k, df_[t]) for i, c in tf if i is not None for t, k in c.items()}
    assert {k: (r.tf, r.df) for k, r in got.items()} == want
    for (i, t), r in got.items():
        assert r.weight == pytest.approx(r.tf * math.log(len(rows) / r.df), abs=1e-9) and 0 <= r.elite <= 1


def test_best_with_ties(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (1, "a", 2.0), (1, "c", 1.0), (2, "é", 0.0), (2, "z", 0.0)], "doc_id bigint, term string, weight double")
    assert {r.doc_id: r.term for r in best_terms(df).collect()} == {1: "a", 2: "z"}


def test_two_poisson_finds_the_mixture():
    rng = np.random.default_rng(1)
    records, p, hi, lo = 200_000, 0.1, 6.0, 0.3
    elite = rng.random(records) < p
    k = np.where(elite, rng.poisson(hi, records), rng.poisson(lo, records))
    tf, n = np.unique(k[k > 0], return_counts=True)
    post = fit_two_poisson(np.zeros(len(tf), np.int64), tf, n, 1, records)
    dens = lambda m, x: np.exp(-m) * m**x / math.gamma(x + 1)
    for x, got in zip(tf, post):
        want = p * dens(hi, x) / (p * dens(hi, x) + (1 - p) * dens(lo, x))
        assert got == pytest.approx(want, abs=0.05)
    assert all(a <= b + 1e-9 for a, b in zip(post, post[1:]))


#: Histograms of mandb_rec at sf0.1 (12,000 records): 'a', 'of', and those of rarer terms.
REAL = [
    {1: 1824, 2: 2372, 3: 2263, 4: 1706, 5: 1280, 6: 831, 7: 494, 8: 211, 9: 80, 10: 45, 11: 8, 12: 4, 13: 6, 14: 5, 15: 6, 16: 5, 17: 4, 18: 3, 19: 3, 20: 10, 21: 9, 22: 4, 23: 3, 24: 4, 25: 1, 26: 2, 28: 1},
    {1: 3658, 2: 2786, 3: 1620, 4: 894, 5: 349, 6: 115, 7: 34, 8: 11, 9: 12, 10: 12, 11: 7, 12: 6, 13: 7, 14: 5, 15: 1, 16: 1, 18: 1, 20: 1},
    {1: 836, 2: 44}, {1: 1323, 2: 107, 3: 4}, {1: 2792, 2: 481, 3: 47, 4: 8}, {1: 151, 2: 1}, {1: 1178}, {1: 2}, {1: 668, 2: 17, 3: 1},
]


def fitted(hists, records=12_000):
    owner = np.repeat(np.arange(len(hists)), [len(h) for h in hists])
    return np.split(fit_two_poisson(owner, np.array([k for h in hists for k in h]), np.array([n for h in hists for n in h.values()]), len(hists), records), np.cumsum([len(h) for h in hists])[:-1])


def plain_em(h, rounds, records=12_000):
    """The same mixture, one term, by nothing but rounds from the same start."""
    k, n = np.array([0, *h], float), np.array([records - sum(h.values()), *h.values()], float)
    total, df = (k * n).sum(), n[1:].sum()
    p, lo, hi = df / records / 2, total / records / 2, total / df + 0.5
    of = lambda: 1 / (1 + (1 - p) / p * np.exp(k * np.log(lo / hi) + hi - lo))
    for _ in range(rounds):
        w = (n * of()).sum()
        p, hi, lo = w / records, (n * of() * k).sum() / w, max(1e-12, (total - (n * of() * k).sum()) / (records - w))
    return of()[1:]


def test_two_poisson_is_fitted_to_the_end():
    got = fitted(REAL)
    assert got[0][8] == pytest.approx(0.018, abs=0.001)  # 'a' nine times: 0.98 after 25 rounds
    for i in (0, 1, 6, 8):  # where plain rounds come to an end in reasonable time
        assert got[i] == pytest.approx(plain_em(REAL[i], 20_000), abs=5e-4)


def test_more_rounds_change_nothing(monkeypatch):
    got = fitted(REAL)
    monkeypatch.setattr(distinctive, "TOLERANCE", 1e-9)
    for a, b in zip(got, fitted(REAL)):
        assert a == pytest.approx(b, abs=1e-4)


def test_equal_histograms_and_order_of_entries():
    got = fitted([REAL[2], dict(reversed(REAL[3].items())), REAL[2], REAL[3]])
    assert list(got[0]) == list(got[2]) and list(got[1]) == list(reversed(got[3]))


def test_small_batches_keep_all_rows():
    import pyarrow as pa

    from folioscan.llm.text import small_batches

    texts = ["a" * 10, None, "", "b" * 100, "c", "d" * 7, None]
    b = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["i", "t"])
    parts = list(small_batches([b, b.slice(0, 0)], 1, 12))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts and len(parts) > 2


def test_elite_pages_of_planted_terms(spark, capsys):
    """Pages about a term use it at a higher rate: how many of them the posterior finds, and how many it names wrongly. Both
    can be no better than with the true rates and shares, which the fit does not know."""
    rng = np.random.default_rng(4)
    rows, about = [], {}
    for i in range(600):
        k = int(rng.integers(0, 6)) if i % 2 else None
        about[i] = k
        rows.append((i, " ".join(["common"] * int(rng.poisson(3)) + [f"t{j}" for j in range(6) for _ in range(int(rng.poisson(7.0 if j == k else 0.4)))]), None))
    scored = term_scores(spark.createDataFrame(rows, SCHEMA), "doc_id", ["desc"]).filter("term like 't%'").collect()
    named = {(r.doc_id, r.term) for r in scored if r.elite > 0.5}
    known = {(r.doc_id, r.term) for r in scored if 1 / 12 * math.exp(-7.0) * 7.0**r.tf > 11 / 12 * math.exp(-0.4) * 0.4**r.tf}
    true = {(i, f"t{k}") for i, k in about.items() if k is not None}
    recall, precision = (lambda x: len(x & true) / len(true)), (lambda x: len(x & true) / len(x))
    with capsys.disabled():
        print(f" elite: recall {recall(named):.3f}, precision {precision(named):.3f}; with the true rates {recall(known):.3f}, {precision(known):.3f}")
    assert recall(named) >= recall(known) - 0.02 and precision(named) >= precision(known) - 0.02 and recall(named) > 0.9
