import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_names():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_sql_agrees(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("mandb_rec", "mandb_meta", "mandb_links", "file_cache", "man_dir", "index_run"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    for name in ("p1_found", "p5_found", "rank_and", "match_phrase", "dict_build", "touch_update"):
        df = entry.queries()[name](spark, SMALL)
        cur = con.execute(entry.oracle_sql()[name])
        cols = [d[0] for d in cur.description]
        cell = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
        assert sorted(tuple(map(cell, r)) for r in df.select(*cols).collect()) == sorted(tuple(map(cell, r)) for r in cur.fetchall()), name
