"""Queries over the pages: text statistics, ranked search, spelling, rendering, and upkeep of the index; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import porter, render
from folioscan.functions.keys import md5_key, path_key
from folioscan.functions.text import STOPWORDS, operators_upper, postings, without_stopwords
from folioscan.operators import incremental as inc
from folioscan.operators import index as ix
from folioscan.operators import spelling
from folioscan.operators.query import parse
from folioscan.operators.search import SearchRequest, lookup, search, snippets
from folioscan.schema import COLUMNS, DICTIONARY_COLUMNS, WEIGHTS
from folioscan.api import register_functions
from folioscan.sources.crawl import crawl
from folioscan.sources.roff import parse_sources, read_pages
from folioscan.storage import materialize, scratch_path, table

WORDS = ["bufer", "dveice", "tabel", "descriptor", "argumnt", "buffre", "hadnel", "deskriptorr", "secton", "zzqqxy"]
NEAR_WORDS = ["bffr", "dscrptor", "argmunet", "hndel", "bufferring"]


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "mandb_rec")


def _dict(spark: SparkSession, folder: str) -> DataFrame:
    return ix.dictionary(_pages(spark, folder))


def _stored_dict(spark: SparkSession, folder: str) -> DataFrame:
    """Written once, as an index keeps it: spelling asks it several times."""
    return materialize(_dict(spark, folder), "dict")


# --- text statistics
def tokenize_counts(spark, folder):
    """Tokens and distinct tokens of each column."""
    return postings(_pages(spark, folder)).groupBy("col", "term").agg(F.count(F.lit(1)).alias("c")).groupBy("col").agg(F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("distinct_tokens"))


def doc_length(spark, folder):
    return postings(_pages(spark, folder)).groupBy("doc_id", "col").agg(F.count(F.lit(1)).alias("n"))


def term_df(spark, folder):
    per_page = postings(_pages(spark, folder)).groupBy("col", "term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    return per_page.groupBy("col", "term").agg(F.sum("tf").alias("hits"), F.count(F.lit(1)).alias("df"))


def vocab_top(spark, folder):
    return _dict(spark, folder).orderBy(F.desc("frequency"), "word").limit(50)


# --- ranked search
SEARCHES = {
    "rank_and": SearchRequest("buffer descriptor"),
    "rank_or": SearchRequest("keyboard OR scheduler OR parity"),
    "rank_not": SearchRequest("table NOT buffer"),
    "rank_multicol": SearchRequest("(driver AND device) OR permission", limit=50),
    "rank_section": SearchRequest("buffer OR table", sections=("1", "4")),
    "rank_machine": SearchRequest("the table", machine="sparc64"),
    "rank_offset": SearchRequest("(the AND and) OR keyboard", sections=("1", "4"), limit=10, offset=12),
    "rank_all": SearchRequest("prompt keyboard", limit=None),
    "match_column": SearchRequest("name_desc:driver", limit=None),
    "match_phrase": SearchRequest('"option number counts" OR "tab separated"', limit=None),
    "match_prefix": SearchRequest("keyb* NOT driver", limit=None),
    "match_near": SearchRequest("buffer NEAR/3 table", limit=None),
}


def _search(name):
    def run(spark, folder):
        return search(_pages(spark, folder), SEARCHES[name]).withColumn("rank", F.round("rank", 9))

    return run


def snippet_rows(spark, folder):
    request = SearchRequest("buffer descriptor", marks=("<", ">", "..."), snippets=True)
    return search(_pages(spark, folder), request).select("doc_id", "snippet")


def snippet_all(spark, folder):
    """A snippet of every page for a query, whether it matches or not."""
    return snippets(_pages(spark, folder), parse("buffer descriptor"), ("<", ">", "..."))


def name_lookup(spark, folder):
    return lookup(_pages(spark, folder), "intro")


def display_name(spark, folder):
    return _pages(spark, folder).select("doc_id", render.display_name("name", "machine").alias("shown"))


def result_text(spark, folder):
    return render.text_line(search(_pages(spark, folder), SEARCHES["rank_and"]).fillna(""))


def result_html(spark, folder):
    return render.html_row(search(_pages(spark, folder), SEARCHES["rank_and"]).fillna(""))


def lookup_text(spark, folder):
    return render.lookup_line(lookup(_pages(spark, folder), "intro").fillna(""))


# --- dictionary and spelling
def _split_time(spark, folder):
    """Start of the middle and of the last successful run: an index before and after."""
    runs = inc.successful_runs(table(spark, folder, "index_run")).orderBy("run").collect()  # the run log is small and of fixed growth
    return runs[len(runs) // 2].started_at, runs[-1].started_at


def dict_build(spark, folder):
    return _dict(spark, folder)


def dict_insert_ignore(spark, folder):
    early, _ = _split_time(spark, folder)
    pages = _pages(spark, folder)
    return ix.add_words(ix.dictionary(pages.filter(F.col("indexed_at") <= F.lit(early))), ix.dictionary(pages))


def edits1(spark, folder):
    words = spark.createDataFrame([(w,) for w in WORDS], "query string")
    return words.select("query", F.posexplode(spelling.edits1(F.col("query"))).alias("i", "candidate"))


def known_word(spark, folder):
    candidates = spark.createDataFrame([(w,) for w in WORDS], "query string").select("query", F.explode(spelling.edits1(F.col("query"))).alias("word"))
    return spelling.known_word(_dict(spark, folder), F.broadcast(candidates))


def spell_d1(spark, folder):
    return spelling.spell(spark, _stored_dict(spark, folder), WORDS)


def spell_d2(spark, folder):
    return spelling.spell(spark, _stored_dict(spark, folder), NEAR_WORDS)


def suggest(spark, folder):
    return spelling.suggest(spark, _dict(spark, folder), "the bufer")


def json_suggest(spark, folder):
    words = suggest(spark, folder)
    one = words.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("frequency")).alias("f"), "suggestion"))), lambda x: x["suggestion"]).alias("words"))  # at most ten
    return one.select(render.json_suggestions(F.lit("the bufer"), F.col("words")).alias("json"))


def query_correction(spark, folder):
    words = "bufer of tabel"
    fixed = spelling.spell(spark, _stored_dict(spark, folder), words.split(" "))
    asked = spark.createDataFrame(list(enumerate(words.split(" "))), "i int, query string")
    return asked.join(fixed, "query").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", F.coalesce("word", "query").alias("w")))), lambda x: x["w"]), " ").alias("corrected"))


# --- strings
def stopword_filter(spark, folder):
    return _pages(spark, folder).select("doc_id", without_stopwords(F.col("name_desc")).alias("kept"))


def boolean_rewrite(spark, folder):
    return _pages(spark, folder).select("doc_id", operators_upper(F.col("name_desc")).alias("query"))


def url_param(spark, folder):
    text = F.concat(F.lit("q="), F.url_encode("name_desc"), F.lit("&p="), F.col("section"), F.lit("&q=2"))
    return _pages(spark, folder).select("doc_id", render.url_param(text, "q").alias("q"), render.url_param(text, "p").alias("p"), render.url_param(text, "x").alias("x"))


def html_escape(spark, folder):
    return _pages(spark, folder).select("doc_id", render.html_escape(F.concat(F.lit("<\x02"), F.col("desc"), F.lit('\x03 & "more">'))).alias("html"))


def pager_overstrike(spark, folder):
    return _pages(spark, folder).select("doc_id", render.overstrike(F.concat(F.lit("see \x02"), F.col("name"), F.lit("\x03 and \x02more\x03."))).alias("shown"))


def highlight(spark, folder):
    return _pages(spark, folder).select("doc_id", render.highlight("name_desc", "er").alias("shown"))


def complete_prefix(spark, folder):
    return _dict(spark, folder).filter(render.starts_with("word", "buf"))


def porter_rows(spark, folder):
    return porter.stems(postings(_pages(spark, folder), DICTIONARY_COLUMNS))


def rank_stemmed(spark, folder):
    """Search with stems on both sides."""
    return search(_pages(spark, folder), SearchRequest("printed buffers", stems=True)).withColumn("rank", F.round("rank", 9))


def content_md5(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.md5(F.col("text")).alias("digest"))


# --- upkeep
def _meta_at(spark, folder, moment) -> DataFrame:
    meta = table(spark, folder, "mandb_meta")
    seen = meta.withColumn("md5_hash", md5_key(F.col("md5_hash"))).filter(F.col("md5_hash").isNotNull() & (F.col("loaded_at") <= F.lit(moment)))
    return ix.latest(seen.select("device", "inode", "mtime", "file", "md5_hash", "id", "seen_at", "meta_id"), ["file"], F.col("seen_at"), F.col("meta_id"), F.struct("device", "inode", "mtime", "id")).drop("seen_at", "meta_id")


def _before(spark, folder):
    return _meta_at(spark, folder, _split_time(spark, folder)[0])


def _after(spark, folder):
    return _meta_at(spark, folder, _split_time(spark, folder)[1])


def _crawl(spark, folder):
    rows = table(spark, folder, "file_cache").select("device", "inode", "mtime", path_key(F.col("parent")).alias("parent"), "file", "seen_at", "cache_id")
    return ix.latest(rows, ["file"], F.col("seen_at"), F.col("cache_id"), F.struct("device", "inode", "mtime", "parent")).drop("seen_at", "cache_id")


def crawl_files(spark, folder):
    return _crawl(spark, folder)


def md5_dedupe(spark, folder):
    return ix.one_per_content(_after(spark, folder).select("md5_hash", "file"))


def inode_dedupe(spark, folder):
    return ix.one_per_inode(_crawl(spark, folder).select("device", "inode", "file"))


def diff_new(spark, folder):
    return ix.new_files(_crawl(spark, folder), _after(spark, folder))


def touch_update(spark, folder):
    return ix.touched(_before(spark, folder), _after(spark, folder))


def upsert_changed(spark, folder):
    before, after = _before(spark, folder), _after(spark, folder)
    changed = after.join(before.select("file", "md5_hash"), ["file", "md5_hash"], "left_anti")
    return ix.upserted(before, changed).select("device", "inode", "mtime", "file", "md5_hash", "id")


def stale_meta(spark, folder):
    """Files that the last month of crawls has not seen."""
    cache = table(spark, folder, "file_cache")
    last = cache.agg(F.max("seen_at").alias("t")).first().t
    return ix.stale_meta(_before(spark, folder), cache.filter(F.col("seen_at") > F.lit(last) - F.expr("INTERVAL 30 DAYS")))


def stale_links(spark, folder):
    return ix.stale_links(table(spark, folder, "mandb_links"), _after(spark, folder), md5_key).select("link_id").distinct()


def stale_pages(spark, folder):
    return ix.stale_pages(_pages(spark, folder), _after(spark, folder)).select("doc_id")


def complete_pages(spark, folder):
    """Pages that may be stored: those with a name, a description and a checksum."""
    return _pages(spark, folder).dropna(subset=["name", "name_desc", "md5_hash"]).select("doc_id")


def links_explode(spark, folder):
    return ix.exploded_links(_pages(spark, folder), "files")


def section_route(spark, folder):
    return ix.routed_lines(table(spark, folder, "documents"))


PARTS = {"lib": "LIBRARY", "return_vals": "RETURN VALUES", "env": "ENVIRONMENT", "files": "FILES", "exit_status": "EXIT STATUS", "diagnostics": "DIAGNOSTICS", "errors": "ERRORS", "desc": "DESCRIPTION"}


def parse_pages(spark, folder):
    """Every page written as page source and parsed again."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[ \t\n\r\f\x0B]+", " "))
    safe = lambda c: F.regexp_replace(F.replace(flat(c), F.lit("\\"), F.lit("\\e")), r"^([.'])", r"\\&$1")
    body = F.concat(*[F.concat(F.lit(f"\n.Sh {h}\n"), safe(c)) for c, h in PARTS.items()])
    source = F.concat(F.lit(".Dd May 1, 2024\n.Dt PAGE "), F.col("section"), F.lit("\n.Os\n.Sh NAME\n.Nm "), flat("name"), F.lit("\n.Nd "), safe("name_desc"), body, F.lit("\n.Sh BUGS\nnone"))
    rows = _pages(spark, folder).select("doc_id", source.alias("source"))
    return parse_sources(rows, "doc_id", "source").select("doc_id", "section", "name", "name_desc", *PARTS)


def _page_name():
    return F.coalesce(F.nullif(F.regexp_replace("name", r"[^A-Za-z0-9_.]+", ""), F.lit("")), F.lit("page"))


def _flat(c: str):
    return F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[ \t\n\r\f\x0B]+", " "))


def _safe(c: str):
    return F.regexp_replace(F.replace(_flat(c), F.lit("\\"), F.lit("\\e")), r"^([.'])", r"\\&$1")


def parse_semantic(spark, folder):
    """Names, aliases, machines and cross references of pages written in the first macro package."""
    alias = F.concat(F.lit("a"), F.col("doc_id").cast("string"))
    source = F.concat(
        F.lit(".\\\" made\n.Dd May 1, 2024\n.Dt PAGE "), F.col("section"), F.lit(" "), F.upper(F.coalesce(F.nullif(F.regexp_replace("machine", r"[^A-Za-z0-9]+", ""), F.lit("")), F.lit("all"))),
        F.lit("\n.Os\n.Sh NAME\n.Nm "), _page_name(), F.lit(" ,\n.Nm "), alias, F.lit("\n.Nd "), _safe("name_desc"),
        F.lit("\n.Sh SYNOPSIS\n.Nm\n.Sh DESCRIPTION\nThe\n.Nm\nof \\fBpage\\fR needs\n.Xr socket 2 .\n.Ss More\n"), _safe("desc"), F.lit("\n.Sh EXIT STATUS\n"), _safe("exit_status"),
    )
    rows = _pages(spark, folder).select("doc_id", source.alias("source"))
    return parse_sources(rows, "doc_id", "source").select("doc_id", "section", "machine", "name", "links", "name_desc", "desc", "exit_status")


MAN_PARTS = {"lib": "LIBRARY", "return_vals": "RETURN VALUE", "env": "ENVIRONMENT", "files": "FILES", "diagnostics": "DIAGNOSTICS", "errors": "ERRORS"}


def parse_plain(spark, folder):
    """The same for the second macro package, which has no columns for environment and diagnostics."""
    alias = F.concat(F.lit("a"), F.col("doc_id").cast("string"), F.lit(", b"), F.col("doc_id").cast("string"))
    body = F.concat(*[F.concat(F.lit(f'\n.SH "{h}"\n'), _safe(c)) for c, h in MAN_PARTS.items()])
    source = F.concat(F.lit(".TH PAGE "), F.col("section"), F.lit("L\n.SH NAME\n"), _page_name(), F.lit(", "), alias, F.lit(" \\- "), _safe("name_desc"), F.lit("\n.SH DESCRIPTION\n.B The page\n"), _safe("desc"), body, F.lit("\n.SH COPYRIGHT\nnone"))
    rows = _pages(spark, folder).select("doc_id", source.alias("source"))
    return parse_sources(rows, "doc_id", "source").select("doc_id", "section", "name", "links", "name_desc", "desc", "lib", "return_vals", "env", "files", "errors")


def read_files(spark, folder):
    """Every page written to a compressed file, crawled, read and parsed again."""
    root = scratch_path(spark, "man").removeprefix("file://")
    source = F.concat(F.lit(".Dt PAGE "), F.col("section"), F.lit("\n.Sh NAME\n.Nm "), _page_name(), F.lit("\n.Nd page "), F.col("doc_id").cast("string"), F.lit("\n.Sh DESCRIPTION\n"), _safe("desc"))

    def write(batches):
        import gzip
        import os

        for b in batches:
            for i, t in zip(b["doc_id"], b["source"]):
                os.makedirs(f"{root}/man{i % 7}", exist_ok=True)
                with gzip.open(f"{root}/man{i % 7}/p{i}.gz", "wb", 1) as f:
                    f.write(t.encode())
            yield b[["doc_id"]]

    _pages(spark, folder).select("doc_id", source.alias("source")).mapInPandas(write, "doc_id bigint").write.format("noop").mode("overwrite").save()
    files = crawl(spark, [root])
    read = read_pages(files)
    return read.select(F.regexp_extract("file", r"([^/]*)$", 1).alias("file"), "section", "name", "name_desc", "desc", F.col("md5_hash").isNotNull().alias("summed"), "error")


def sql_pages(spark, folder):
    """A statement with parameters over the pages of one section."""
    return spark.sql("SELECT doc_id, name FROM {pages} WHERE section = :section AND name_desc LIKE :like", args={"section": "4", "like": "%e%"}, pages=_pages(spark, folder))


def query_words(spark, folder):
    """The phrases of a query by the table function, with the page frequency of each stem."""
    register_functions(spark)
    stems = porter.stemmed(postings(_pages(spark, folder), ["desc"])).select("term", "doc_id").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    words = spark.sql("SELECT phrase, place, word, stem FROM query_words('buffers OR \"printed tables\" NOT keyboards')")
    return words.join(stems, words.stem == stems.term, "left").select("phrase", "place", "word", "stem", F.coalesce("df", F.lit(0).cast("long")).alias("df"))


def run_counters(spark, folder):
    return ix.run_counters(_crawl(spark, folder), _before(spark, folder), _after(spark, folder))


QUERIES = {n: _search(n) for n in SEARCHES} | {
    f.__name__: f
    for f in [
        tokenize_counts, doc_length, term_df, vocab_top, snippet_rows, snippet_all, name_lookup, display_name, result_text, result_html, lookup_text,
        dict_build, dict_insert_ignore, edits1, known_word, spell_d1, spell_d2, suggest, json_suggest, query_correction, stopword_filter,
        boolean_rewrite, url_param, html_escape, pager_overstrike, highlight, complete_prefix, porter_rows, rank_stemmed, content_md5, crawl_files,
        md5_dedupe, inode_dedupe, diff_new, touch_update, upsert_changed, stale_meta, stale_links, stale_pages, complete_pages, links_explode,
        section_route, run_counters, parse_pages, parse_semantic, parse_plain, read_files, sql_pages, query_words,
    ]
}

# --- SQL
_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOK = "regexp_extract_all(" + _FOLD + r", '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
_BLANK = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_MD5 = f"nullif(lower(trim({{0}}, {_BLANK})), '')"


def _x(columns=COLUMNS) -> str:
    parts = [f'SELECT doc_id, {COLUMNS.index(c)} AS col, {_TOK.format(chr(34) + c + chr(34))} AS k FROM mandb_rec' for c in columns]
    return f"toks AS ({' UNION ALL '.join(parts)}), x AS (SELECT doc_id, col, len(k) AS n, unnest(k) AS term, generate_subscripts(k, 1) - 1 AS pos FROM toks WHERE len(k) > 0)"


_DICT = f"{_x(DICTIONARY_COLUMNS)}, dict AS (SELECT term AS word, count(*) AS frequency FROM x GROUP BY term)"
_SHOWN = f"CASE WHEN machine <> '' THEN {_FOLD.format('machine')} || '/' || regexp_extract(name, '[^/]*$') ELSE name END"


def _one(i: int, where: str) -> str:
    return f"SELECT {i} AS leaf, doc_id, col, any_value(n) AS n, count(*) AS tf FROM x WHERE {where} GROUP BY doc_id, col"


def _run(i: int, *terms: str) -> str:
    joins = "".join(f" JOIN x x{k} ON x{k}.doc_id = a.doc_id AND x{k}.col = a.col AND x{k}.pos = a.pos + {k} AND x{k}.term = '{t}'" for k, t in enumerate(terms) if k)
    return f"SELECT {i} AS leaf, a.doc_id, a.col, any_value(a.n) AS n, count(*) AS tf FROM x a{joins} WHERE a.term = '{terms[0]}' GROUP BY a.doc_id, a.col"


def _rank(leaves: list[str], where: str, scored: list[int] | None = None, extra: str = "true", limit: str = "LIMIT 10", more: str = "", x: str | None = None) -> str:
    """The rank formula in SQL: statistics before the filters, one idf for the query."""
    use = ", ".join(map(str, scored if scored is not None else range(len(leaves))))
    weights = ", ".join(f"({COLUMNS.index(c)}, {w})" for c, w in WEIGHTS.items())
    has = ", ".join(f"bool_or(leaf = {i}) AS has{i}" for i in range(len(leaves)))
    return f"""WITH {x or _x()}{more}, h AS ({' UNION ALL '.join(leaves)}), w(col, weight) AS (VALUES {weights}),
 st AS (SELECT leaf, col, sum(tf)::DOUBLE AS g, count(*) AS df FROM h GROUP BY leaf, col),
 idf AS (SELECT coalesce(sum(ln((SELECT count(*) FROM mandb_rec) / df) * weight), 0) AS v FROM st JOIN w USING (col) WHERE leaf IN ({use})),
 sc AS (SELECT doc_id, {has}, sum(CASE WHEN leaf IN ({use}) THEN tf * coalesce(weight, 0) / (g * n) ELSE 0 END) AS tf FROM h JOIN st USING (leaf, col) LEFT JOIN w USING (col) GROUP BY doc_id),
 r AS (SELECT doc_id, section, {_SHOWN} AS name, name_desc, machine, round(tf * (SELECT v FROM idf) / (3.75 + tf), 12) AS rank FROM sc JOIN mandb_rec USING (doc_id) WHERE ({where}) AND {extra})
SELECT doc_id, section, name, name_desc, machine, round(rank, 9) AS rank FROM (SELECT * FROM r ORDER BY rank DESC, doc_id {limit})"""


def _t(i: int, term: str) -> str:
    return _one(i, f"term = '{term}'")


_AND = _rank([_t(0, "buffer"), _t(1, "descriptor")], "has0 AND has1")
_EDITS = """SELECT query, unnest(c) AS candidate, generate_subscripts(c, 1) - 1 AS i FROM (SELECT query, flatten(list_transform(range(0, len(query) + 1), lambda i: list_filter(list_concat(
  [CASE WHEN i < len(query) THEN query[:i] || query[i + 2:] END, CASE WHEN i < len(query) - 1 THEN query[:i] || query[i + 2] || query[i + 1] || query[i + 3:] END],
  flatten(list_transform(range(97, 123), lambda c: [CASE WHEN i < len(query) THEN query[:i] || chr(c::INT) || query[i + 2:] END, query[:i] || chr(c::INT) || query[i + 1:]]))), lambda s: s IS NOT NULL))) AS c FROM {0})"""
_ASKED = lambda ws: "(VALUES " + ", ".join(f"('{w}')" for w in ws) + ") q(query)"


def _spell(words: list[str]) -> str:
    return f"""WITH {_DICT}, asked AS (SELECT * FROM {_ASKED(words)}), e1 AS ({_EDITS.format('asked')}),
 exact AS (SELECT query, query AS word FROM asked JOIN dict ON word = query),
 one AS (SELECT query, arg_min(word, (-frequency, word)) AS word FROM e1 JOIN dict ON word = candidate WHERE query NOT IN (SELECT query FROM exact) GROUP BY query),
 left_over AS (SELECT query AS q0, i AS i0, candidate AS query FROM e1 WHERE query NOT IN (SELECT query FROM exact UNION ALL SELECT query FROM one)),
 c2 AS (SELECT DISTINCT query FROM left_over), e2 AS ({_EDITS.format('c2')}),
 two AS (SELECT q0 AS query, arg_min(word, (i0, -frequency, word)) AS word FROM left_over JOIN e2 USING (query) JOIN dict ON word = candidate GROUP BY q0)
SELECT asked.query, f.word FROM asked LEFT JOIN (SELECT * FROM exact UNION ALL SELECT * FROM one UNION ALL SELECT * FROM two) f USING (query)"""


_SUGGEST = f"""{_DICT}, asked AS (SELECT 'bufer' AS query), e1 AS ({_EDITS.format('asked')}),
 s AS (SELECT 'the ' || word AS suggestion, frequency FROM dict WHERE word IN (SELECT candidate FROM e1) ORDER BY frequency DESC, word LIMIT 10)"""

_TIMES = f"""good AS (SELECT DISTINCT run_id, started_at FROM index_run WHERE lower(trim(status, {_BLANK})) = 'ok' AND finished_at IS NOT NULL),
 runs AS (SELECT *, row_number() OVER (ORDER BY started_at, run_id) AS k, count(*) OVER () AS n FROM good),
 times AS (SELECT max(CASE WHEN k = n // 2 + 1 THEN started_at END) AS t1, max(CASE WHEN k = n THEN started_at END) AS t2 FROM runs)"""


def _state(name: str, t: str) -> str:
    return f"{name} AS (SELECT device, inode, mtime, file, md5_hash, id FROM (SELECT device, inode, mtime, file, {_MD5.format('md5_hash')} AS md5_hash, id, row_number() OVER (PARTITION BY file ORDER BY seen_at DESC, meta_id DESC) AS r FROM mandb_meta WHERE {_MD5.format('md5_hash')} IS NOT NULL AND loaded_at <= (SELECT {t} FROM times)) WHERE r = 1)"


_DIR = r"nullif(case when parent is null or parent = '' then '' else coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(parent, '/(\.?/)+', '/', 'g'), '/\.?$', ''), '^(\./)+', ''), ''), '/') end, '')"
_CRAWL = f"crawl AS (SELECT device, inode, mtime, {_DIR} AS parent, file FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY seen_at DESC, cache_id DESC) AS r FROM file_cache) WHERE r = 1)"
_STATES = f"WITH {_TIMES}, {_state('before', 't1')}, {_state('after', 't2')}, {_CRAWL}"
_STOPS = ", ".join(f"'{w}'" for w in sorted(STOPWORDS))
_ESCAPE = "replace(replace(replace(replace(replace(replace('<' || chr(2) || \"desc\" || chr(3) || ' & \"more\">', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(2), '<b>'), chr(3), '</b>')"

_FLAT = r"nullif(trim(regexp_replace({0}, '[ \t\n\r\f\x0B]+', ' ', 'g')), '')"


def _stem_sql(source: str) -> str:
    """CTEs that end in stems(term, stem) for the terms of a table: the rules of the paper as conditions on text in which a
    y that is a vowel is written Y."""
    v, c = "[aeiouY]", "[^aeiouY]"
    has, more, vowel = (lambda x: f"regexp_matches({x}, '{v}{c}')"), (lambda x: f"regexp_matches({x}, '{v}{c}.*{v}{c}')"), (lambda x: f"regexp_matches({x}, '{v}')")
    short = lambda x: f"regexp_matches({x}, '{c}{v}[^aeiouYwxy]$')"
    cut = lambda x, n: f"{x}[:len({x}) - {n}]"

    def swap(rules: str) -> str:
        pairs = sorted((r.split(":") for r in rules.split()), key=lambda p: -len(p[0]))
        return "CASE " + " ".join(f"WHEN ends_with(w, '{a}') THEN CASE WHEN {has(cut('w', len(a)))} THEN {cut('w', len(a))} || '{b}' ELSE w END" for a, b in pairs) + " ELSE w END"

    four = " ".join(
        f"WHEN ends_with(w, '{a}') THEN CASE WHEN {more(cut('w', len(a)))}{'' if a != 'ion' else f' AND regexp_matches({cut(chr(119), 3)}, {chr(39)}[st]${chr(39)})'} THEN {cut('w', len(a))} ELSE w END"
        for a in sorted(porter.STEP4.split(), key=len, reverse=True)
    )
    steps = [
        f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {cut('w', 2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {cut('w', 1)} ELSE w END AS w, '' AS e",
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {has(cut('w', 3))} THEN {cut('w', 1)} ELSE w END WHEN ends_with(w, 'ed') AND {vowel(cut('w', 2))} THEN {cut('w', 2)} WHEN ends_with(w, 'ing') AND {vowel(cut('w', 3))} THEN {cut('w', 3)} ELSE w END AS w, "
        f"CASE WHEN ends_with(w, 'eed') THEN '' WHEN (ends_with(w, 'ed') AND {vowel(cut('w', 2))}) OR (ends_with(w, 'ing') AND {vowel(cut('w', 3))}) THEN 'x' ELSE '' END AS e",
        f"CASE WHEN e = '' THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN len(w) > 1 AND w[-1] = w[-2] AND regexp_matches(w, '[^aeiouYlsz]$') THEN {cut('w', 1)} WHEN {has('w')} AND NOT {more('w')} AND {short('w')} THEN w || 'e' ELSE w END AS w, '' AS e",
        f"CASE WHEN regexp_matches(w, '[yY]$') AND {vowel(cut('w', 1))} THEN {cut('w', 1)} || 'i' ELSE w END AS w, '' AS e",
        f"{swap(porter.STEP2)} AS w, '' AS e",
        f"{swap(porter.STEP3)} AS w, '' AS e",
        f"CASE {four} ELSE w END AS w, '' AS e",
        f"CASE WHEN ends_with(w, 'e') AND ({more(cut('w', 1))} OR ({has(cut('w', 1))} AND NOT {short(cut('w', 1))})) THEN {cut('w', 1)} ELSE w END AS w, '' AS e",
        f"CASE WHEN ends_with(w, 'll') AND {more('w')} THEN {cut('w', 1)} ELSE w END AS w, '' AS e",
    ]
    marked = "regexp_replace(regexp_replace(term, '([b-df-hj-np-tv-xz])y', '\\1Y', 'g'), 'yy', 'yY', 'g')"
    out = f"p0 AS (SELECT term, {marked} AS w, '' AS e FROM (SELECT DISTINCT term FROM {source}) WHERE regexp_matches(term, '^[a-z]{{3,}}$'))"
    for i, step in enumerate(steps):
        out += f",\n p{i + 1} AS (SELECT term, {step} FROM p{i})"
    return out + f",\n stems AS (SELECT term, lower(w) AS stem FROM p{len(steps)} UNION ALL SELECT DISTINCT term, term FROM {source} WHERE NOT regexp_matches(term, '^[a-z]{{3,}}$'))"


_XS = f"{_x().replace('x AS (SELECT', 'x0 AS (SELECT')}, {_stem_sql('x0')}, x AS (SELECT doc_id, col, n, stem AS term, pos FROM x0 JOIN stems USING (term))"
_PAGE_NAME = "coalesce(nullif(regexp_replace(name, '[^A-Za-z0-9_.]+', '', 'g'), ''), 'page')"
_FLAT_TEXT = r"trim(regexp_replace(coalesce({0}, ''), '[ \t\n\r\f\x0B]+', ' ', 'g'))"


def _joined(*parts: str) -> str:
    return f"nullif(trim(regexp_replace(concat_ws(' ', {', '.join(parts)}), ' +', ' ', 'g')), '')"


def _html_escape(x: str) -> str:
    for _ in range(2):
        x = f"regexp_replace({x}, '([^\\\\])&($|[^a])', '\\1&amp;\\2', 'g')"
    return f"replace(replace(replace({x}, '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def _snippets(words: str) -> str:
    fields = " UNION ALL ".join(f'SELECT doc_id, {i} AS col, "{c}" AS raw FROM mandb_rec' for i, c in enumerate(COLUMNS))
    piece = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+[^0-9A-Za-z\x{80}-\x{10FFFF}]*"
    return f"""f AS ({fields}), g AS (SELECT *, {_TOK.format('raw')} AS t FROM f WHERE raw IS NOT NULL),
 h AS (SELECT *, list_filter(range(0, len(t)), lambda i: t[i + 1] IN ({words})) AS hits FROM g WHERE len(t) > 0),
 w AS (SELECT doc_id, col, raw, t, unnest(CASE WHEN len(hits) > 0 THEN list_transform(hits, lambda i: greatest(0, least(i, len(t) - 40))) ELSE [0::BIGINT] END) AS b FROM h),
 sc AS (SELECT *, len(list_distinct(list_filter(t[b + 1:b + 40], lambda x: x IN ({words})))) AS k FROM w),
 best AS (SELECT *, regexp_extract_all(raw, '{piece}') AS p FROM (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, col, b) = 1)),
 snip AS (SELECT doc_id, CASE WHEN b > 0 THEN '...' ELSE '' END || rtrim(array_to_string(list_transform(range(b + 1, least(b + 40, len(t)) + 1), lambda i: CASE WHEN t[i] IN ({words}) THEN '<' || p[i][:len(t[i])] || '>' || p[i][len(t[i]) + 1:] ELSE p[i] END), ''), ' ')
  || CASE WHEN b + 40 < len(t) THEN '...' ELSE '' END AS snippet FROM best)"""


_MARKED = "'buffer', 'descriptor'"

ORACLE = {
    "snippet_all": f"WITH {_snippets(_MARKED)} SELECT doc_id, snippet FROM snip",
    "snippet_rows": f"WITH {_snippets(_MARKED)} SELECT doc_id, snippet FROM snip WHERE doc_id IN (SELECT doc_id FROM ({_AND}))",
    "porter_rows": f"WITH {_x(DICTIONARY_COLUMNS)}, {_stem_sql('x')} SELECT term, stem FROM stems",
    "rank_stemmed": _rank([_t(0, "print"), _t(1, "buffer")], "has0 AND has1", x=_XS),
    "query_words": f"""WITH {_x(['desc']).replace('x AS (SELECT', 'x0 AS (SELECT')}, {_stem_sql('x0')}, d AS (SELECT stem, count(DISTINCT doc_id) AS df FROM x0 JOIN stems USING (term) GROUP BY stem)
SELECT phrase, place, word, q.stem, coalesce(df, 0)::BIGINT AS df FROM (VALUES (0, 0, 'buffers', 'buffer'), (1, 0, 'printed', 'print'), (1, 1, 'tables', 'tabl'), (2, 0, 'keyboards', 'keyboard')) q(phrase, place, word, stem) LEFT JOIN d USING (stem)""",
    "sql_pages": "SELECT doc_id, name FROM mandb_rec WHERE section = '4' AND name_desc LIKE '%e%'",
    "parse_semantic": f"""SELECT doc_id, section, lower(coalesce(nullif(regexp_replace(machine, '[^A-Za-z0-9]+', '', 'g'), ''), 'all')) AS machine, {_PAGE_NAME} AS name, 'a' || doc_id AS links, {_FLAT.format('name_desc')} AS name_desc,
 {_joined("'The ' || " + _PAGE_NAME + " || ' a' || doc_id || ' of page needs socket(2) More'", _FLAT_TEXT.format('"desc"'))} AS "desc", {_FLAT.format('exit_status')} AS exit_status FROM mandb_rec""",
    "parse_plain": f"""SELECT doc_id, section, {_PAGE_NAME} AS name, 'a' || doc_id || ' b' || doc_id AS links, {_FLAT.format('name_desc')} AS name_desc,
 {_joined("'The page'", *[_FLAT_TEXT.format(x) for x in ('"desc"', 'env', 'diagnostics')])} AS "desc", {', '.join(f'{_FLAT.format(c)} AS {c}' for c in ('lib', 'return_vals', 'files', 'errors'))}, NULL::VARCHAR AS env FROM mandb_rec""",
    "read_files": f"""SELECT 'p' || doc_id || '.gz' AS file, section, {_PAGE_NAME} AS name, 'page ' || doc_id AS name_desc, {_FLAT.format('"desc"')} AS "desc", true AS summed, NULL::VARCHAR AS error FROM mandb_rec""",
    "result_html": f"""SELECT '<div class="result"><a href="/man/' || replace(url_encode(coalesce(name, '')), '%20', '+') || '.html">' || {_html_escape("coalesce(name, '')")} || '(' || section || ')</a> ' || {_html_escape("coalesce(name_desc, '')")} || '<p></p></div>' AS html FROM ({_AND})""",
    "parse_pages": f"SELECT doc_id, section, {_FLAT.format('name')} AS name, {_FLAT.format('name_desc')} AS name_desc, " + ", ".join(f'{_FLAT.format(chr(34) + c + chr(34))} AS "{c}"' for c in PARTS) + " FROM mandb_rec",
    "tokenize_counts": f"WITH {_x()} SELECT col, count(*)::BIGINT AS tokens, count(DISTINCT term)::BIGINT AS distinct_tokens FROM x GROUP BY col",
    "doc_length": f"WITH {_x()} SELECT doc_id, col, count(*)::BIGINT AS n FROM x GROUP BY doc_id, col",
    "term_df": f"WITH {_x()} SELECT col, term, count(*)::BIGINT AS hits, count(DISTINCT doc_id)::BIGINT AS df FROM x GROUP BY col, term",
    "vocab_top": f"WITH {_DICT} SELECT word, frequency FROM dict ORDER BY frequency DESC, word LIMIT 50",
    "rank_and": _AND,
    "rank_or": _rank([_t(0, "keyboard"), _t(1, "scheduler"), _t(2, "parity")], "has0 OR has1 OR has2"),
    "rank_not": _rank([_t(0, "table"), _t(1, "buffer")], "has0 AND NOT has1", [0]),
    "rank_multicol": _rank([_t(0, "driver"), _t(1, "device"), _t(2, "permission")], "(has0 AND has1) OR has2", limit="LIMIT 50"),
    "rank_section": _rank([_t(0, "buffer"), _t(1, "table")], "has0 OR has1", extra="section IN ('1', '4')"),
    "rank_machine": _rank([_t(0, "the"), _t(1, "table")], "has0 AND has1", extra="machine = 'sparc64'"),
    "rank_offset": _rank([_t(0, "the"), _t(1, "and"), _t(2, "keyboard")], "(has0 AND has1) OR has2", extra="section IN ('1', '4')", limit="LIMIT 10 OFFSET 12"),
    "rank_all": _rank([_t(0, "prompt"), _t(1, "keyboard")], "has0 AND has1", limit=""),
    "match_column": _rank([_one(0, "term = 'driver' AND col = 2")], "has0", limit=""),
    "match_phrase": _rank([_run(0, "option", "number", "counts"), _run(1, "tab", "separated")], "has0 OR has1", limit=""),
    "match_prefix": _rank([_one(0, "starts_with(term, 'keyb')"), _t(1, "driver")], "has0 AND NOT has1", [0], limit=""),
    "match_near": _rank(
        [_t(0, "buffer"), _t(1, "table")],
        "doc_id IN (SELECT doc_id FROM near)",
        limit="",
        more=", near AS (SELECT DISTINCT a.doc_id FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.col = b.col AND abs(a.pos - b.pos) BETWEEN 1 AND 4 WHERE a.term = 'buffer' AND b.term = 'table')",
    ),
    "name_lookup": "SELECT doc_id, section, name, name_desc FROM mandb_rec WHERE name = 'intro'",
    "display_name": f"SELECT doc_id, {_SHOWN} AS shown FROM mandb_rec",
    "result_text": f"SELECT coalesce(name, '') || ' (' || section || ')' || chr(9) || coalesce(name_desc, '') || chr(10) AS line FROM ({_AND})",
    "lookup_text": "SELECT coalesce(name, '') || '(' || section || ') - ' || coalesce(name_desc, '') || chr(10) AS line FROM mandb_rec WHERE name = 'intro'",
    "dict_build": f"WITH {_DICT} SELECT word, frequency FROM dict",
    "dict_insert_ignore": f"""WITH {_DICT}, {_TIMES}, old AS (SELECT term AS word, count(*) AS frequency FROM x JOIN mandb_rec USING (doc_id) WHERE indexed_at <= (SELECT t1 FROM times) GROUP BY term)
SELECT word, coalesce(old.frequency, dict.frequency)::BIGINT AS frequency FROM dict LEFT JOIN old USING (word)""",
    "edits1": f"SELECT query, (i)::INT AS i, candidate FROM ({_EDITS.format(_ASKED(WORDS))})",
    "known_word": f"WITH {_DICT}, e1 AS ({_EDITS.format(_ASKED(WORDS))}) SELECT query, arg_min(word, (-frequency, word)) AS word FROM e1 JOIN dict ON word = candidate GROUP BY query",
    "spell_d1": _spell(WORDS),
    "spell_d2": _spell(NEAR_WORDS),
    "suggest": f"WITH {_SUGGEST} SELECT suggestion, frequency FROM s",
    "json_suggest": f"""WITH {_SUGGEST} SELECT '{{"query":"the bufer","suggestions":[' || coalesce(string_agg('"' || suggestion || '"', ',' ORDER BY frequency DESC, suggestion), '') || ']}}' AS json FROM s""",
    "query_correction": f"SELECT string_agg(coalesce(word, query), ' ' ORDER BY CASE query WHEN 'bufer' THEN 0 WHEN 'of' THEN 1 ELSE 2 END) AS corrected FROM ({_spell(['bufer', 'of', 'tabel'])})",
    "stopword_filter": f"SELECT doc_id, nullif(array_to_string(list_filter(string_split(name_desc, ' '), lambda w: w <> '' AND w NOT IN ({_STOPS})), ' '), '') AS kept FROM mandb_rec",
    "boolean_rewrite": "SELECT doc_id, array_to_string(list_transform(string_split(name_desc, ' '), lambda w: CASE WHEN w IN ('and', 'not', 'or') THEN upper(w) ELSE w END), ' ') AS query FROM mandb_rec",
    "url_param": "SELECT doc_id, CASE WHEN section IS NOT NULL THEN name_desc END AS q, CASE WHEN name_desc IS NOT NULL THEN section END AS p, NULL::VARCHAR AS x FROM mandb_rec",
    "html_escape": f"SELECT doc_id, {_ESCAPE} AS html FROM mandb_rec",
    "pager_overstrike": "SELECT doc_id, 'see ' || regexp_replace(name, '(.)', '\\1' || chr(8) || '\\1', 'gs') || ' and ' || regexp_replace('more', '(.)', '\\1' || chr(8) || '\\1', 'g') || '.' AS shown FROM mandb_rec",
    "highlight": "SELECT doc_id, regexp_replace(name_desc, '(?i)(er)', '<strong>\\1</strong>', 'g') AS shown FROM mandb_rec",
    "complete_prefix": f"WITH {_DICT} SELECT word, frequency FROM dict WHERE starts_with(word, 'buf')",
    "content_md5": "SELECT doc_id, md5(text) AS digest FROM documents",
    "crawl_files": f"WITH {_CRAWL} SELECT * FROM crawl",
    "md5_dedupe": f"{_STATES} SELECT md5_hash, min(file) AS file FROM after GROUP BY md5_hash",
    "inode_dedupe": f"{_STATES} SELECT device, inode, min(file) AS file FROM crawl WHERE device IS NOT NULL AND inode IS NOT NULL GROUP BY device, inode UNION ALL SELECT device, inode, file FROM crawl WHERE device IS NULL OR inode IS NULL",
    "diff_new": f"{_STATES} SELECT * FROM crawl c WHERE NOT EXISTS (SELECT 1 FROM after b WHERE b.device = c.device AND b.inode = c.inode AND b.mtime = c.mtime AND b.file = c.file)",
    "touch_update": f"""{_STATES} SELECT CASE WHEN a.inode IS NULL THEN b.device ELSE a.device END AS device, coalesce(a.inode, b.inode) AS inode, CASE WHEN a.inode IS NULL THEN b.mtime ELSE a.mtime END AS mtime, b.file, b.md5_hash, b.id,
 a.inode IS NOT NULL AND (a.device IS DISTINCT FROM b.device OR a.inode IS DISTINCT FROM b.inode OR a.mtime IS DISTINCT FROM b.mtime) AS changed FROM before b LEFT JOIN after a USING (file, md5_hash)""",
    "upsert_changed": f"""{_STATES}, changed AS (SELECT * FROM after a WHERE NOT EXISTS (SELECT 1 FROM before b WHERE b.file = a.file AND b.md5_hash = a.md5_hash))
SELECT * FROM changed UNION ALL SELECT * FROM before WHERE file NOT IN (SELECT file FROM changed)""",
    "stale_meta": f"{_STATES} SELECT device, inode, mtime, file, md5_hash, id FROM before WHERE file NOT IN (SELECT file FROM file_cache WHERE seen_at > (SELECT max(seen_at) FROM file_cache) - INTERVAL 30 DAYS)",
    "stale_links": f"{_STATES} SELECT DISTINCT link_id FROM mandb_links l WHERE NOT EXISTS (SELECT 1 FROM after a WHERE a.md5_hash = {_MD5.format('l.md5_hash')})",
    "stale_pages": f"{_STATES} SELECT doc_id FROM mandb_rec p WHERE NOT EXISTS (SELECT 1 FROM after a WHERE a.id = p.doc_id)",
    "complete_pages": "SELECT doc_id FROM mandb_rec WHERE name IS NOT NULL AND name_desc IS NOT NULL AND md5_hash IS NOT NULL",
    "links_explode": "SELECT regexp_replace(a, '^,|,$', '', 'g') AS link, name AS target, section, machine, md5_hash FROM (SELECT *, unnest(string_split(files, ' ')) AS a FROM mandb_rec) WHERE regexp_replace(a, '^,|,$', '', 'g') <> ''",
    "section_route": """WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS s FROM documents)),
 h AS (SELECT *, regexp_matches(line, '^[A-Z][A-Z]+( [A-Z]+)*$') AS head FROM l),
 g AS (SELECT doc_id, head, coalesce(last_value(CASE WHEN head THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), '') AS heading FROM h)
SELECT doc_id, heading, count(*)::BIGINT AS lines, CASE WHEN heading IN ('NAME', 'SYNOPSIS', 'EXAMPLES', 'EXAMPLE', 'STANDARDS', 'HISTORY', 'AUTHORS', 'BUGS', 'COPYRIGHT') THEN NULL
 ELSE coalesce(map {'LIBRARY': 'lib', 'RETURN VALUE': 'return_vals', 'RETURN VALUES': 'return_vals', 'ENVIRONMENT': 'env', 'FILES': 'files', 'EXIT STATUS': 'exit_status', 'DIAGNOSTICS': 'diagnostics', 'ERRORS': 'errors'}[heading], 'desc') END AS "column"
FROM g WHERE NOT head GROUP BY doc_id, heading""",
    "run_counters": f"""{_STATES}, again AS (SELECT c.file, a.md5_hash FROM crawl c LEFT JOIN after a USING (file) WHERE NOT EXISTS (SELECT 1 FROM before b WHERE b.device = c.device AND b.inode = c.inode AND b.mtime = c.mtime AND b.file = c.file)),
 k AS (SELECT DISTINCT md5_hash, true AS known FROM before)
SELECT count(*) AS examined, count(*) FILTER (known) AS links, count(*) FILTER (md5_hash IS NOT NULL AND known IS NULL) AS indexed, count(*) FILTER (md5_hash IS NULL) AS unread FROM again LEFT JOIN k USING (md5_hash)""",
}
