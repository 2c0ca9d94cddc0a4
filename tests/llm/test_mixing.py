import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscan.llm.mixing import apportion, mixture
from folioscan.llm.queries import PIECES, QUERIES, TOKENIZERS

RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
needs_tokenizer = pytest.mark.skipif(not os.path.exists(RANKS), reason="no tokenizer file here")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 30)), min_size=1, max_size=8), st.integers(0, 120))
def test_apportionment_seat_by_seat(parts, seats):
    w, cap = [p[0] for p in parts], [p[1] for p in parts]
    held = [0] * len(w)
    for _ in range(seats):
        best = max(((w[i] / (2 * held[i] + 1), -i) for i in range(len(w)) if w[i] > 0 and held[i] < cap[i]), default=None)
        if best is None:
            break
        held[-best[1]] += 1
    assert apportion(w, cap, seats) == held


def corpus(spark):
    rng = random.Random(1)
    rows = []
    for i in range(1500):
        s = rng.choice(["big"] * 8 + [" Big ", "small", "BIG", "other", None, "untargeted"])
        rows.append((i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(0, 120))), s, 9))
    rows += [(5000, None, "big", 1), (None, "text", "big", 1), (5001, "", "small", 1), rows[3]]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, tokens int")


@needs_tokenizer
def test_shares_and_repeats(spark):
    targets = spark.createDataFrame([("BIG", 3.0, 1), ("small ", 1.0, 2), ("small ", 1.0, 2), ("other", 1.0, None), ("absent", 4.0, 3), ("none", 0.0, 1), (None, 1.0, 1), ("odd", None, 1)], "source string, weight double, max_repeat int")
    chosen, report = mixture(corpus(spark), targets, RANKS, PIECES)
    rows, rep = chosen.collect(), {r.source: r for r in report.collect()}
    assert set(rep) == {"big", "small", "other", "absent", "none", "odd"}
    assert len({r.doc_id for r in rows}) == len(rows)
    assert all(1 <= r.repeats <= rep[r.source].max_repeat for r in rows)
    total = sum(r.tokens * r.repeats for r in rows)
    for s, r in rep.items():
        used = sum(x.tokens * x.repeats for x in rows if x.source == s)
        assert r.tokens == used and r.share == pytest.approx(used / total)
        assert r.share == pytest.approx(r.target_share, abs=0.02)
    assert rep["big"].target_share == pytest.approx(0.6) and rep["absent"].tokens == 0
    again, _ = mixture(corpus(spark), targets, RANKS, PIECES)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    other, _ = mixture(corpus(spark), targets, RANKS, PIECES, seed=5)
    assert sorted(map(tuple, other.collect())) != sorted(map(tuple, rows))


@needs_tokenizer
def test_large_totals_use_each_document_to_its_cap(spark):
    targets = spark.createDataFrame([("big", 1.0, 1), ("small", 1.0, 2)], "source string, weight double, max_repeat int")
    chosen, report = mixture(corpus(spark), targets, RANKS, PIECES, total_tokens=10**9)
    by = {r.source: r for r in report.collect()}
    assert by["big"].tokens == by["big"].available_tokens and by["small"].tokens == 2 * by["small"].available_tokens


@needs_tokenizer
def test_registered_large_mixture_runs_sources_out(spark, tmp_path):
    corpus(spark).write.parquet(f"{tmp_path}/documents.parquet")
    targets = [("big", 1.0, 1), ("small", 8.0, 2), ("other", 1.0, 1)]
    spark.createDataFrame(targets, "source string, weight double, max_repeat int").write.parquet(f"{tmp_path}/mix_target.parquet")
    by = {r.source: r for r in QUERIES["p7_large_report"](spark, str(tmp_path)).collect()}
    assert by["small"].tokens == 2 * by["small"].available_tokens and by["small"].most_repeats == 2 and by["small"].share < by["small"].target_share - 0.05
    assert by["big"].share > by["big"].target_share + 0.05  # what small cannot give
    assert sum(r.tokens for r in by.values()) == pytest.approx(by["big"].available_tokens, rel=0.02)
    rows = QUERIES["p7_large"](spark, str(tmp_path)).collect()
    assert sum(r.tokens * r.repeats for r in rows) == sum(r.tokens for r in by.values())


@needs_tokenizer
def test_empty(spark):
    targets = spark.createDataFrame([("big", 1.0, 1)], "source string, weight double, max_repeat int")
    chosen, report = mixture(corpus(spark).filter("false"), targets, RANKS, PIECES)
    assert chosen.count() == 0 and report.first().tokens == 0
    chosen, report = mixture(corpus(spark), targets.filter("false"), RANKS, PIECES)
    assert chosen.count() == 0 and report.count() == 0


def test_each_entry_has_its_least_seats():
    assert apportion([100.0, 1.0, 0.0, 1.0], [50, 50, 50, 0], 10, least=1) == [9, 1, 0, 0]
    assert apportion([1.0, 1.0, 1.0], [5, 5, 5], 2, least=1) == [1, 1, 1]


@needs_tokenizer
@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_shares_of_the_query(spark, folder):
    """Every source with a weight and documents is used; shares are off by no more than a document and two blocks."""
    if not os.path.exists(folder):
        pytest.skip("no test tables here")
    rows, report = QUERIES["p7_mixture"](spark, folder).collect(), QUERIES["p7_report"](spark, folder).collect()
    total = sum(r.tokens * r.repeats for r in rows)
    longest = {}
    for r in rows:
        longest[r.source] = max(longest.get(r.source, 0), r.tokens)
    for r in report:
        if r.target_share > 0 and r.available_tokens:
            assert r.documents > 0
            assert abs(r.share - r.target_share) * total <= longest[r.source] + 512, r
            assert r.note is not None or abs(r.share - r.target_share) <= 0.1 * r.target_share
        else:
            assert r.tokens == 0 and r.note


@needs_tokenizer
def test_tolerance_allows_more(spark):
    targets = spark.createDataFrame([("big", 1.0, 1), ("small", 1.0, 2)], "source string, weight double, max_repeat int")
    exact, loose = (sum(r.tokens for r in mixture(corpus(spark), targets, RANKS, PIECES, tolerance=t)[1].collect()) for t in (0.0, 0.2))
    assert 1.1 * exact < loose < 1.3 * exact
