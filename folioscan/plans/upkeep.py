"""Queries over the index's own tables: dangling references and incremental runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions.keys import id_key, md5_key, path_key
from folioscan.operators import incremental as inc
from folioscan.operators.orphans import Reference, find_orphans, orphan_report
from folioscan.storage import materialize, table


def index_references(spark: SparkSession, folder: str) -> list[Reference]:
    meta, links, cache, recs, dirs = (table(spark, folder, t) for t in ("mandb_meta", "mandb_links", "file_cache", "mandb_rec", "man_dir"))
    return [
        Reference("mandb_meta", "id", meta, id_key(meta.id), meta.meta_id, meta.loaded_at, recs, id_key(recs.doc_id), recs.indexed_at, recs.removed_at),
        Reference("mandb_links", "md5_hash", links, md5_key(links.md5_hash), links.link_id, links.added_at, meta, md5_key(meta.md5_hash), meta.loaded_at),
        Reference("file_cache", "parent", cache, path_key(cache.parent), cache.cache_id, cache.seen_at, dirs, path_key(dirs.dir), dirs.added_at, dirs.removed_at),
    ]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_orphans(index_references(spark, folder)).select("ref_table", "ref_column", "row_id", "period").distinct()


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(find_orphans(index_references(spark, folder)))


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    meta = table(spark, folder, "mandb_meta")
    return meta.select(
        F.col("meta_id").alias("seq"),
        F.col("file").alias("key"),
        md5_key(F.col("md5_hash")).alias("value"),
        F.col("seen_at").cast("timestamp_ntz").alias("order_at"),
        F.col("loaded_at").cast("timestamp_ntz").alias("arrived"),
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    runs = inc.successful_runs(table(spark, folder, "index_run"))
    _, taken = inc.replay(_versions(spark, folder), runs)
    return inc.changed_keys(taken).join(F.broadcast(runs.select("run", "run_id")) if runs.count() <= inc.RUNS_BROADCAST else runs.select("run", "run_id"), "run").select("run_id", F.col("key").alias("file"), F.col("value").alias("md5_hash"))


def p5_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """How many intervals and sequence numbers each successful run takes."""
    runs = inc.successful_runs(table(spark, folder, "index_run"))
    ledger, _ = inc.replay(_versions(spark, folder), runs)
    return materialize(ledger, "ledger").join(runs, "run").groupBy("run_id").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("taken"))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p5_found": p5_found, "p5_ledger": p5_ledger}

_BLANK = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_MD5 = f"nullif(lower(trim({{0}}, {_BLANK})), '')"
_DIR = r"nullif(case when {0} is null or {0} = '' then '' else coalesce(nullif(regexp_replace(regexp_replace(regexp_replace({0}, '/(\.?/)+', '/', 'g'), '/\.?$', ''), '^(\./)+', ''), ''), '/') end, '')"

_ORPHANS = f"""
SELECT DISTINCT 'mandb_meta' AS ref_table, 'id' AS ref_column, m.meta_id AS row_id, m.loaded_at AS t,
  CASE WHEN EXISTS (SELECT 1 FROM mandb_rec r WHERE r.doc_id = m.id AND r.indexed_at <= m.loaded_at) THEN 'deleted'
       WHEN EXISTS (SELECT 1 FROM mandb_rec r WHERE r.doc_id = m.id AND r.indexed_at IS NOT NULL) THEN 'late' ELSE 'missing' END AS status
FROM mandb_meta m WHERE m.id > 0 AND NOT EXISTS (
  SELECT 1 FROM mandb_rec r WHERE r.doc_id = m.id AND r.indexed_at <= m.loaded_at AND (r.removed_at IS NULL OR m.loaded_at < r.removed_at))
UNION ALL
SELECT DISTINCT 'mandb_links', 'md5_hash', l.link_id, l.added_at,
  CASE WHEN f.first IS NULL THEN 'missing' ELSE 'late' END
FROM (SELECT *, {_MD5.format('md5_hash')} AS h FROM mandb_links) l
LEFT JOIN (SELECT {_MD5.format('md5_hash')} AS h, min(loaded_at) AS first FROM mandb_meta GROUP BY 1) f ON f.h = l.h
WHERE l.h IS NOT NULL AND NOT coalesce(f.first <= l.added_at, false)
UNION ALL
SELECT DISTINCT 'file_cache', 'parent', c.cache_id, c.seen_at,
  CASE WHEN EXISTS (SELECT 1 FROM dirs d WHERE d.k = c.k AND d.added_at <= c.seen_at) THEN 'deleted'
       WHEN EXISTS (SELECT 1 FROM dirs d WHERE d.k = c.k) THEN 'late' ELSE 'missing' END
FROM (SELECT *, {_DIR.format('parent')} AS k FROM file_cache) c
WHERE c.k IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM dirs d WHERE d.k = c.k AND d.added_at <= c.seen_at AND (d.removed_at IS NULL OR c.seen_at < d.removed_at))
"""
_WITH = f"WITH dirs AS (SELECT {_DIR.format('dir')} AS k, added_at, removed_at FROM man_dir), orphans AS ({_ORPHANS})"

_RUNS = f"""good AS (SELECT DISTINCT run_id, started_at FROM index_run WHERE lower(trim(status, {_BLANK})) = 'ok' AND finished_at IS NOT NULL),
 runs AS (SELECT *, row_number() OVER (ORDER BY started_at, run_id) AS k FROM good),
 versions AS (SELECT DISTINCT meta_id, file, {_MD5.format('md5_hash')} AS h, seen_at, loaded_at FROM mandb_meta WHERE {_MD5.format('md5_hash')} IS NOT NULL)"""

ORACLE = {
    "p1_found": f"{_WITH} SELECT DISTINCT ref_table, ref_column, row_id, strftime(t, '%Y-%m') AS period FROM orphans",
    "p1_report": f"{_WITH} SELECT ref_table, ref_column, strftime(t, '%Y-%m') AS period, status, count(*) AS orphans FROM orphans GROUP BY ALL",
    "p5_found": f"""WITH {_RUNS}, starts AS (SELECT started_at, min(k) AS k FROM runs GROUP BY started_at),
 firsts AS (SELECT meta_id, file, h, seen_at, min(k) AS k FROM versions ASOF JOIN starts ON loaded_at <= started_at GROUP BY ALL),
 newest AS (SELECT file, k, max({{'s': seen_at, 'm': meta_id, 'h': h}}) AS v FROM firsts GROUP BY file, k),
 state AS (SELECT file, k, max(v) OVER (PARTITION BY file ORDER BY k) AS v FROM newest),
 moves AS (SELECT file, k, v.h AS h, lag(v.h) OVER (PARTITION BY file ORDER BY k) AS before FROM state)
SELECT run_id, file, h AS md5_hash FROM moves JOIN runs USING (k) WHERE before IS NULL OR before <> h""",
    "p5_ledger": f"""WITH {_RUNS}, firsts AS (SELECT meta_id, min(k) AS k FROM runs JOIN versions ON loaded_at <= started_at GROUP BY meta_id)
SELECT r.run_id, count(*)::BIGINT AS taken FROM firsts JOIN runs r USING (k) GROUP BY r.run_id""",
}
