import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from folioscan.functions.keys import id_key, md5_key, path_key
from folioscan.operators import orphans
from folioscan.operators.orphans import Reference, find_orphans, orphan_report


def day(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def frames(spark, rows, targets):
    r = spark.createDataFrame([(i, k, day(t), "x", 1) for i, k, t in rows], "row_id bigint, key string, t timestamp_ntz, rel string, live int")
    p = spark.createDataFrame([(k, day(s), day(e), 5) for k, s, e in targets], "key string, s timestamp_ntz, e timestamp_ntz, delta int")
    return [Reference("a", "k", r, r.key, r.row_id, r.t, p, p.key, p.s, p.e)]


def brute(rows, targets):
    out = set()
    for i, k, t in rows:
        own = [(s, e) for kk, s, e in targets if kk == k and s is not None]
        if k is None or t is not None and any(s <= t and (e is None or t < e) for s, e in own):
            continue
        status = "deleted" if t is not None and any(s <= t for s, _ in own) else "late" if own else "missing"
        out.add((i, day(t), status))
    return out


@pytest.mark.parametrize("hot", [None, 0.05, 0.008])
def test_against_brute_force(spark, hot):
    rng = random.Random(7)
    keys = ["hot"] * 4 + ["a", "b", "c", "d", None]
    rows = [(i // 2 * 2 if i % 9 == 0 else i, rng.choice(keys), rng.choice([None, *range(30)])) for i in range(400)]
    targets = []
    for _ in range(40):
        s = rng.choice([None, *range(30)])
        targets.append((rng.choice(["hot", "a", "b", "c", None]), s, None if s is None or rng.random() < 0.2 else s + rng.randint(-2, 5)))
    more = {"hot_share": hot, "hot_least": 1, "slice_seconds": 3 * 86_400} if hot else {}
    got = find_orphans(frames(spark, rows, targets), **more)
    assert {(r.row_id, r.t, r.status) for r in got.collect()} == brute(rows, targets)
    assert got.count() == len(brute(rows, targets))


def test_one_key_at_one_moment(spark, monkeypatch):
    """A key of which all references are of one day, or have no time, is cut by rows: no group of the merge is large."""
    rows = [(i, "hot", 3 if i % 2 else None) for i in range(600)] + [(1000 + i, f"k{i}", 3) for i in range(100)]
    targets = [("hot", 1, 2), ("hot", 5, None), ("k1", 1, None)]
    seen = []
    real = orphans.Window.partitionBy

    def watched(*columns):
        seen.append(columns)
        return real(*columns)

    monkeypatch.setattr(orphans.Window, "partitionBy", watched)
    refs = frames(spark, rows, targets)
    got = find_orphans(refs, hot_share=0.02, hot_least=1)
    assert {(r.row_id, r.t, r.status) for r in got.collect()} == brute(rows, targets)
    assert ("rel", "key", "slot", "part") in seen
    cut = orphans._hot(orphans._references(refs), F.when(F.col("t").isNull(), 0).otherwise(1).cast("long"), 0.02, 1)
    assert sorted(s[2:] for s in cut.slices) == [(0, 20), (1, 20)]


def test_empty_tables(spark):
    assert find_orphans(frames(spark, [], [("a", 1, None)])).count() == 0
    found = find_orphans(frames(spark, [(1, "a", 1)], []))
    assert [(r.row_id, r.status, r.period) for r in found.collect()] == [(1, "missing", "2024-01")]
    assert orphan_report(found).first().orphans == 1


def test_targets_that_stay(spark):
    r = spark.createDataFrame([(1, "A ", day(5)), (2, "a", day(1)), (3, " ", day(1))], "row_id bigint, key string, t timestamp_ntz")
    p = spark.createDataFrame([("a", day(3)), ("a\n", day(2))], "key string, s timestamp_ntz")
    got = find_orphans([Reference("a", "k", r, md5_key(r.key), r.row_id, r.t, p, md5_key(p.key), p.s)])
    assert [(x.row_id, x.status) for x in got.collect()] == [(2, "late")]


def test_keys(spark):
    paths = ["/usr//share/man/", "/usr/./share/./man/.", "/usr/share/man", "/", "//", "./a/", ".", "", None, "/usr/share/Man"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(path_key(F.col("p"))).collect()]
    assert got == ["/usr/share/man"] * 3 + ["/", "/", "a", ".", None, None, "/usr/share/Man"]
    ids = [r[0] for r in spark.createDataFrame([(5,), (0,), (-1,), (None,)], "i bigint").select(id_key(F.col("i"))).collect()]
    assert ids == ["5", None, None, None]
