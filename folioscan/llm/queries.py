"""Queries of the subpackage over the test tables, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.distinctive import best_terms, term_scores
from folioscan.llm.leak import leaks
from folioscan.llm.mixing import LARGEST, mixture
from folioscan.llm.pii import personal_values, redacted
from folioscan.llm.similar import Similarity, class_links, similar_links, similar_pairs
from folioscan.llm.termcount import mark_terms, term_counts
from folioscan.storage import table

PAGES = Similarity(threshold=0.7, size=3, least=20)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar_pairs(table(spark, folder, "mandb_rec"), "doc_id", "desc", PAGES)


def p2_links(spark: SparkSession, folder: str) -> DataFrame:
    return similar_links(table(spark, folder, "mandb_rec"), "doc_id", "desc", PAGES)


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of different texts, each told by its class; with p2_links the same as p2_found, however large a class is."""
    return class_links(table(spark, folder, "mandb_rec"), "doc_id", "desc", PAGES)


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "mandb_rec")
    return mark_terms(term_counts(pages, ["desc", "name"]), pages, ["desc", "name"])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _marked(spark, folder).filter("mark is not null").select("field", "term", "mark")


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _marked(spark, folder).select("field", "term", "total", "pages", "mark")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return best_terms(term_scores(table(spark, folder, "mandb_rec"), "doc_id", ["desc", "name_desc"], least_df=2)).select("doc_id", "term")


def p4_elite(spark: SparkSession, folder: str) -> DataFrame:
    """For each page the term whose count is most surely that of a page about it, by the two-Poisson posterior."""
    return best_terms(term_scores(table(spark, folder, "mandb_rec"), "doc_id", ["desc", "name_desc"], least_df=2), "elite")


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "benchmark"), "item_id", "text")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id")


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """Each leaked item with the number of documents that hold a passage of it, and the longest passage in words."""
    return _leaks(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("words").alias("longest"))


#: The public tokenizer that measures sizes; the folder is a parameter of the environment.
TOKENIZERS = os.environ.get("FOLIOSCAN_TOKENIZERS", "/opt/tokenizers")
#: Pieces into which a text is cut before byte pairs are merged: letters, digits and other characters apart.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixture(table(spark, folder, "documents"), table(spark, folder, "mix_target"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken", PIECES)


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder)[0]


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder)[1]


def _large_mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """As many tokens as the largest weighted source has: small sources run out, and the others take what they cannot give."""
    return mixture(table(spark, folder, "documents"), table(spark, folder, "mix_target"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken", PIECES, total_tokens=LARGEST)


def p7_large(spark: SparkSession, folder: str) -> DataFrame:
    return _large_mixture(spark, folder)[0]


def p7_large_report(spark: SparkSession, folder: str) -> DataFrame:
    return _large_mixture(spark, folder)[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal_values(table(spark, folder, "documents"), "doc_id", "text")


def p8_redacted(spark: SparkSession, folder: str) -> DataFrame:
    key = os.environ.get("FOLIOSCAN_PSEUDONYM_KEY", "a key for tests").encode()
    return redacted(table(spark, folder, "documents"), "doc_id", "text", key)


QUERIES = {"p7_mixture": p7_mixture, "p7_report": p7_report, "p7_large": p7_large, "p7_large_report": p7_large_report, "p8_found": p8_found, "p8_redacted": p8_redacted, "p6_found": p6_found, "p6_items": p6_items, "p2_found": p2_found, "p2_links": p2_links, "p2_classes": p2_classes, "p3_found": p3_found, "p3_counts": p3_counts, "p4_found": p4_found, "p4_elite": p4_elite}

_TOK = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

_COUNTS = f"""x AS (SELECT 'desc' AS field, doc_id, unnest({_TOK.format('"desc"')}) AS term FROM mandb_rec UNION ALL SELECT 'name', doc_id, unnest({_TOK.format('name')}) FROM mandb_rec),
 counts AS (SELECT field, term, count(*)::BIGINT AS total, count(DISTINCT doc_id)::BIGINT AS pages, any_value(CASE field WHEN 'desc' THEN (SELECT count("desc") FROM mandb_rec) ELSE (SELECT count(name) FROM mandb_rec) END) AS records FROM x GROUP BY field, term)"""

_WORDS = r"regexp_extract_all(lower(regexp_replace(text, '\\f(?s:.)', '', 'g')), '[a-z0-9]+')"
_GRAMS = f"(SELECT {{0}}, unnest(list_distinct(list_transform(range(1, greatest(len(k) - 10, 1)), lambda i: array_to_string(k[i:i + 11], ' ')))) AS g FROM (SELECT {{0}}, {_WORDS} AS k FROM {{1}} WHERE text IS NOT NULL))"

def _pairs(texts: str) -> str:
    """CTEs that end in p(a, b): pairs of the rows (doc_id, k) of a table whose shingles resemble each other."""
    return f"""s AS (SELECT doc_id, list_distinct(list_transform(range(1, len(k) - 1), lambda i: k[i] || ' ' || k[i + 1] || ' ' || k[i + 2])) AS g FROM {texts}),
 x AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
 q AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
 p AS (SELECT a, b FROM q WHERE 10 * c >= 7 * (na + nb - c))"""


_CLASSES = f"""t AS (SELECT doc_id, {_TOK.format('"desc"')} AS k FROM mandb_rec WHERE "desc" IS NOT NULL),
 long AS (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY k) AS rep, count(*) OVER (PARTITION BY k) AS copies FROM t WHERE len(k) >= 20),
 reps AS (SELECT doc_id, k FROM long WHERE doc_id = rep)"""
_PLACES = f"(SELECT DISTINCT {{0}}, i, array_to_string(k[i:i + 11], ' ') AS g FROM (SELECT {{0}}, k, unnest(range(1, greatest(len(k) - 10, 1))) AS i FROM (SELECT {{0}}, {_WORDS} AS k FROM {{1}} WHERE text IS NOT NULL)))"

ORACLE = {
    "p2_links": f"""WITH {_CLASSES}, {_pairs('reps')}, n AS (SELECT rep, count(*) AS links FROM (SELECT a AS rep FROM p UNION ALL SELECT b FROM p) GROUP BY rep)
SELECT m.doc_id, coalesce(rep, m.doc_id) AS class_id, coalesce(copies, 1)::BIGINT AS copies, coalesce(links, 0)::BIGINT AS links FROM mandb_rec m LEFT JOIN long USING (doc_id) LEFT JOIN n USING (rep)""",
    "p2_classes": f"WITH {_CLASSES}, {_pairs('reps')} SELECT a AS class_a, b AS class_b FROM p",
    "p6_items": f"""WITH hits AS (SELECT doc_id, item_id, d.i AS pos, d.i - b.i AS apart FROM {_PLACES.format('doc_id', 'documents')} d JOIN {_PLACES.format('item_id', 'benchmark')} b USING (g)),
 islands AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, item_id, apart ORDER BY pos) AS island FROM hits),
 runs AS (SELECT doc_id, item_id, count(*) + 11 AS words FROM islands GROUP BY doc_id, item_id, apart, island)
SELECT item_id, count(DISTINCT doc_id)::BIGINT AS documents, max(words)::INTEGER AS longest FROM runs GROUP BY item_id""",
    "p6_found": f"""SELECT DISTINCT doc_id, item_id FROM {_GRAMS.format('doc_id', 'documents')} JOIN {_GRAMS.format('item_id', 'benchmark')} USING (g)""",
    "p2_found": f"""WITH t AS (SELECT doc_id, {_TOK.format('"desc"')} AS k FROM mandb_rec WHERE "desc" IS NOT NULL),
 s AS (SELECT doc_id, list_distinct(list_transform(range(1, len(k) - 1), lambda i: k[i] || ' ' || k[i + 1] || ' ' || k[i + 2])) AS g FROM t WHERE len(k) >= 20),
 x AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
 p AS (SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT doc_id_a, doc_id_b FROM p WHERE 10 * c >= 7 * (na + nb - c)""",
    "p3_found": f"""WITH {_COUNTS} SELECT field, term, CASE WHEN pages = 1 THEN 'rare' ELSE 'common' END AS mark FROM counts WHERE pages = 1 OR pages > 0.1 * records""",
    "p3_counts": f"""WITH {_COUNTS} SELECT field, term, total, pages, CASE WHEN pages = 1 THEN 'rare' WHEN pages > 0.1 * records THEN 'common' END AS mark FROM counts""",
    "p4_found": f"""WITH x AS (SELECT doc_id, unnest({_TOK.format("(coalesce(\"desc\", '') || ' ' || coalesce(name_desc, ''))")}) AS term FROM mandb_rec),
 t AS (SELECT doc_id, term, count(*) AS tf FROM x GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM t GROUP BY term HAVING count(*) >= 2),
 s AS (SELECT doc_id, term, round(tf * ln((SELECT count(*) FROM mandb_rec) / df), 9) AS w FROM t JOIN d USING (term))
SELECT doc_id, term FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term) AS r FROM s) WHERE r = 1""",
}
