import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscan.operators import incremental as inc


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def history(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        h = rng.randint(0, 200)
        rows.append((i, f"f{rng.randint(0, 25)}", rng.choice("abc"), at(h), at(h + rng.choice([0, 0, 1, 40]))))
    rows += [rng.choice(rows) for _ in range(20)]
    rows += [(None, "f1", "a", at(1), at(1)), (900, None, "a", at(1), at(1)), (901, "f1", None, at(1), at(1)), (902, "f1", "a", at(1), None)]
    runs = []
    for i in range(20):
        ok = rng.random() < 0.6
        runs.append((i, at(i * 10), at(i * 10 + 1) if ok or rng.random() < 0.5 else None, rng.choice(["ok", " OK"]) if ok else rng.choice(["failed", None])))
    return rows, runs


def brute(rows, runs):
    good = sorted((r for r in runs if (r[3] or "").strip().lower() == "ok" and r[2] is not None), key=lambda r: (r[1], r[0]))
    out, before = set(), {}
    for run in good:
        best = {}
        for seq, key, value, seen, loaded in rows:
            if None in (seq, key, value, loaded) or loaded > run[1]:
                continue
            best[key] = max(best.get(key, (dt.datetime.min, -1, "")), (seen, seq, value))
        now = {k: v[2] for k, v in best.items()}
        out |= {(run[0], k, v) for k, v in now.items() if before.get(k) != v}
        before = now
    return out, good


ROWS = "seq bigint, key string, value string, order_at timestamp_ntz, arrived timestamp_ntz"
RUNS = "run_id bigint, started_at timestamp_ntz, finished_at timestamp_ntz, status string"


def test_replay_against_brute_force(spark):
    rows, runs = history(3)
    log = inc.successful_runs(spark.createDataFrame(runs, RUNS))
    ledger, taken = inc.replay(spark.createDataFrame(rows, ROWS), log)
    got = inc.changed_keys(taken).join(log, "run").select("run_id", "key", "value").collect()
    want, _ = brute(rows, runs)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    spans = ledger.orderBy("lo").collect()
    assert all(a.hi < b.lo for a, b in zip(spans, spans[1:]))


def test_live_runs_take_what_replay_takes(spark, tmp_path):
    rows, runs = history(5)
    df = spark.createDataFrame([r for r in rows if None not in (r[0], r[1], r[2], r[4])], ROWS)
    want, good = brute(rows, runs)
    good = good[:4]
    book = inc.RunLedger(spark, f"file://{tmp_path}/ledger")
    for k, run in enumerate(good):
        visible = df.filter(F.col("arrived") <= F.lit(run[1]))
        if k == 2:  # a run that breaks after writing its batch leaves nothing behind that counts
            with pytest.raises(RuntimeError):
                book.run(visible, _broken, run[0])
        assert book.run(visible, lambda todo: todo, run[0])
        assert book.pending(visible).count() == 0
    out = book.outputs()
    assert out.count() == out.select("seq").distinct().count()
    _, taken = inc.replay(df, inc.successful_runs(spark.createDataFrame(runs, RUNS)))
    ids = {i + 1: r[0] for i, r in enumerate(good)}
    replayed = {(ids[r.taken_by], r.seq) for r in taken.filter(F.col("taken_by") <= len(good)).collect()}
    assert {(r.run_id, r.seq) for r in out.collect()} == replayed
    spans = book.processed().orderBy("lo").collect()
    assert all(a.hi + 1 < b.lo or a.block != b.block for a, b in zip(spans, spans[1:]))


def _broken(todo):
    raise RuntimeError("stopped")


def test_two_runs_at_once_commit_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x", at(0), at(0))], ROWS)
    book = inc.RunLedger(spark, f"file://{tmp_path}/ledger")

    def late(todo):  # another run commits while this one is still working
        inc.RunLedger(spark, f"file://{tmp_path}/ledger").run(df, lambda t: t, 1)
        return todo

    assert book.run(df, late, 2) is False
    assert [r.run_id for r in book.outputs().collect()] == [1]


def test_merge_across_blocks(spark):
    a = spark.createDataFrame([(0, 1, 3), (0, 10, 12), (1, 65536, 65540)], "block bigint, lo bigint, hi bigint")
    b = spark.createDataFrame([(0, 4, 9), (0, 11, 20), (1, 65542, 65542)], "block bigint, lo bigint, hi bigint")
    assert sorted(map(tuple, inc.merge(a, b).collect())) == [(0, 1, 20), (1, 65536, 65540), (1, 65542, 65542)]


def test_empty(spark):
    runs = inc.successful_runs(spark.createDataFrame([], RUNS))
    _, taken = inc.replay(spark.createDataFrame([(1, "a", "x", at(0), at(0))], ROWS), runs)
    assert inc.changed_keys(taken).count() == 0
    one = inc.successful_runs(spark.createDataFrame([(1, at(0), at(1), "ok")], RUNS))
    _, taken = inc.replay(spark.createDataFrame([], ROWS), one)
    assert inc.changed_keys(taken).count() == 0


def test_clashing_names(spark):
    rows = spark.createDataFrame([(1, 2, 3, 4)], "seq bigint, block int, at int, span int")
    assert inc.locate(rows, spark.createDataFrame([(0, 1, 1, 5)], "block bigint, run int, lo bigint, hi bigint"), "seq").first().asDict() == {"seq": 1, "block": 2, "at": 3, "span": 4, "taken_by": 1}


SPANS = st.lists(st.tuples(st.integers(0, 60), st.integers(0, 8)), max_size=12)


def spans_of(numbers):
    none = (np.empty(0, np.int64), np.empty(0, np.int64))
    a = np.array(sorted(numbers), np.int64)
    return inc.union((a, a), none)


def numbers_of(spans):
    return {n for lo, hi in zip(*spans) for n in range(lo, hi + 1)}


@settings(max_examples=300, deadline=None)
@given(SPANS, SPANS)
def test_interval_arithmetic(a, b):
    a, b = ({n for lo, k in x for n in range(lo, lo + k)} for x in (a, b))
    x, y = spans_of(a), spans_of(b)
    assert all(h + 1 < lo for h, lo in zip(x[1][:-1], x[0][1:]))
    assert numbers_of(inc.union(x, y)) == a | b
    assert numbers_of(inc.subtract(x, y)) == a - b and len(inc.subtract(x, y)[0]) == len(spans_of(a - b)[0])


def test_a_number_is_taken_once_with_what_has_arrived(spark):
    rows = [(1, "a", "x", at(0), at(0)), (1, "a", "x", at(0), at(30)), (1, "a", "later", at(0), at(30)), (2, "a", "y", at(1), at(30))]
    runs = inc.successful_runs(spark.createDataFrame([(1, at(5), at(6), "ok"), (2, at(40), at(41), "ok")], RUNS))
    ledger, taken = inc.replay(spark.createDataFrame(rows, ROWS), runs)
    assert sorted(map(tuple, ledger.collect())) == [(0, 1, 1, 1), (0, 2, 2, 2)]
    assert sorted((r.seq, r.value, r.taken_by) for r in taken.collect() if r.taken_by) == [(1, "x", 1), (2, "y", 2)]


def rows_scanned(df):
    """Rows that the scans of a plan gave out, after it has run."""
    df.collect()
    todo, out = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        if name.startswith("Scan parquet"):
            out += node.metrics().apply("numOutputRows").value()
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return out


def test_a_run_with_nothing_new_reads_no_old_block(spark, tmp_path):
    source = f"{tmp_path}/rows"
    spark.range(200_000).repartitionByRange(8, "id").select(F.col("id").alias("seq"), F.col("id").cast("string").alias("value")).write.parquet(source)
    book = inc.RunLedger(spark, f"file://{tmp_path}/ledger")
    rows = spark.read.parquet(source)
    assert book.run(rows, lambda todo: todo, 1)
    assert rows_scanned(book.pending(rows)) <= 10  # the ledger's own few spans, none of the rows
    spark.range(200_000, 200_010).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("value")).write.mode("append").parquet(source)
    rows = spark.read.parquet(source)
    assert rows_scanned(book.pending(rows)) <= 40
    assert book.run(rows, lambda todo: todo, 2)
    assert {r.run_id: r.n for r in book.outputs().groupBy("run_id").agg(F.count("*").alias("n")).collect()} == {1: 200_000, 2: 10}
    assert book.vacuum() == 1  # the spans of the first run
    assert book.pending(rows).count() == 0


def test_commits_are_exclusive(spark, tmp_path):
    from folioscan.storage import listing, publish_exclusively

    path = f"file://{tmp_path}/commits/00000000"
    assert publish_exclusively(spark, path, "one") and not publish_exclusively(spark, path, "two")
    assert (tmp_path / "commits/00000000").read_text() == "one" and listing(spark, f"file://{tmp_path}/commits") == ["00000000"]
