"""Ranked search over postings.

Postings are filtered by the words of the query before anything is shuffled; what is left is brought together by record
once, and everything else (phrases, frequencies, the boolean condition, ranks) is computed on that partitioning. The
statistics of the whole collection are one row for each phrase and column, which is told to all tasks. They are taken
before the section and machine filters, so filters never change ranks. Without filters the best rows are picked before
anything else is read of their pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import porter
from folioscan.functions.render import display_name
from folioscan.functions.text import postings as postings_of
from folioscan.functions.text import tokens
from folioscan.operators.query import Query, parse
from folioscan.schema import COLUMNS, SATURATION, WEIGHTS
from folioscan.storage import materialize

SNIPPET_TOKENS = 40
#: Results up to this size are told to all tasks that read their pages.
BROADCAST_RESULT = 100_000


@dataclass(frozen=True)
class SearchRequest:
    """``limit`` None: all rows (``offset`` is then ignored); a negative offset counts as 0."""

    query: str
    sections: tuple[str, ...] = ()
    machine: str | None = None
    limit: int | None = 10
    offset: int = 0
    marks: tuple[str, str, str] = ("", "", "...")
    snippets: bool = False
    #: words are compared by their stems; postings then hold stems
    stems: bool = False


def _matches(q: Query) -> Column:
    """Array of (leaf, off): the places of phrases that a posting can fill."""
    out = []
    for i, p in enumerate(q.phrases):
        for off, t in enumerate(p.terms):
            hit = F.col("term").startswith(t) if p.prefix and off == len(p.terms) - 1 else F.col("term") == t
            if p.col is not None:
                hit = hit & (F.col("col") == p.col)
            out.append(F.when(hit, F.struct(F.lit(i).alias("leaf"), F.lit(off).alias("off"))))
    return F.array_compact(F.array(*out))


def _wanted(q: Query) -> Column:
    """Whether a posting has a word of the query: reaches the scan of stored postings as a filter."""
    exact = sorted({t for p in q.phrases for k, t in enumerate(p.terms) if not (p.prefix and k == len(p.terms) - 1)})
    out = F.col("term").isin(exact) if exact else F.lit(False)
    for p in q.phrases:
        if p.prefix:
            out = out | F.col("term").startswith(p.terms[-1])
    return out


def phrase_hits(postings: DataFrame, q: Query) -> DataFrame:
    """(doc_id, leaf, col, tf, n, starts): how often each phrase begins in each column of each record."""
    places = postings.filter(_wanted(q)).select("doc_id", "col", "pos", "n", F.explode(_matches(q)).alias("m"))
    # one shuffle: both groupings below keep to the records
    rows = places.select("doc_id", "col", "n", F.col("m.leaf").alias("leaf"), (F.col("pos") - F.col("m.off")).alias("start"), F.col("m.off").alias("off")).repartition("doc_id")
    sizes = F.array(*[F.lit(len(p.terms)) for p in q.phrases])
    if any(len(p.terms) > 1 for p in q.phrases):
        rows = rows.groupBy("doc_id", "leaf", "col", "start").agg(F.countDistinct("off").alias("k"), F.first("n").alias("n")).filter(F.col("k") == sizes[F.col("leaf")])
    hits = rows.groupBy("doc_id", "leaf", "col")
    starts = F.sort_array(F.collect_set("start")).alias("starts") if q.nears else F.lit(None).cast("array<int>").alias("starts")
    return hits.agg(F.count(F.lit(1)).alias("tf"), F.first("n").alias("n"), starts)


def statistics(hits: DataFrame, records: int, q: Query) -> DataFrame:
    """(leaf, col, share, idf), at most phrases x columns: what a hit counts, and one number for the query, summed over
    phrases and columns, each weighted."""
    weights = F.array(*[F.lit(WEIGHTS.get(c, 0.0)) for c in COLUMNS])
    weight = F.when(F.col("leaf").isin(q.scored()), weights[F.col("col")]).otherwise(F.lit(0.0))
    rows = hits.groupBy("leaf", "col").agg(F.sum("tf").cast("double").alias("g"), F.count(F.lit(1)).alias("df"))
    all_rows = Window.partitionBy(F.lit(0))
    return rows.select("leaf", "col", (weight / F.col("g")).alias("share"), F.sum(F.ln(F.lit(records) / F.col("df")) * weight).over(all_rows).alias("idf"))


def _near(q: Query, i: int, rows: Column) -> Column:
    """Whether both phrases of a NEAR stand in one column with at most ``gap`` words between."""
    near = q.nears[i]
    la, lb = len(q.phrases[near.left].terms), len(q.phrases[near.right].terms)
    close = lambda x, y: ((y - x - la >= 0) & (y - x - la <= near.gap)) | ((x - y - lb >= 0) & (x - y - lb <= near.gap))
    return F.exists(
        rows,
        lambda a: (a["leaf"] == near.left)
        & F.exists(rows, lambda b: (b["leaf"] == near.right) & (b["col"] == a["col"]) & F.exists(a["starts"], lambda x: F.exists(b["starts"], lambda y: close(x, y)))),
    )


def _condition(q: Query, tree: tuple) -> Column:
    kind = tree[0]
    if kind == "p":
        return F.col(f"has{tree[1]}")
    if kind == "near":
        return F.col(f"near{tree[1]}")
    a, b = _condition(q, tree[1]), _condition(q, tree[2])
    return a & b if kind == "and" else a | b if kind == "or" else a & ~b


def ranks(postings: DataFrame, records: int, q: Query, stored: bool) -> DataFrame:
    """(doc_id, rank) of all records that match. Stored postings are cheap to read twice, for the statistics and for the
    ranks; where text has to be cut into words first, its hits are written."""
    hits = phrase_hits(postings, q)
    if not stored:
        hits = materialize(hits, "hits")
    told = hits.join(F.broadcast(statistics(hits, records, q)), ["leaf", "col"])
    aggs = [F.bool_or(F.col("leaf") == i).alias(f"has{i}") for i in range(len(q.phrases))]
    aggs += [F.sum(F.col("tf") * F.col("share") / F.col("n")).alias("tf"), F.max("idf").alias("idf")]
    if q.nears:
        aggs.append(F.collect_list(F.struct("leaf", "col", "starts")).alias("rows"))  # one for each phrase and column of a record
    found = told.groupBy("doc_id").agg(*aggs)
    for i in range(len(q.nears)):
        found = found.withColumn(f"near{i}", _near(q, i, F.col("rows")))
    # rounded, so that the order in which partial sums meet decides no ties
    rank = F.round(F.col("tf") * F.col("idf") / (F.lit(SATURATION) + F.col("tf")), 12)
    return found.filter(_condition(q, q.tree)).select("doc_id", rank.alias("rank"))


def scanned(pages: DataFrame, q: Query, stems: bool = False) -> DataFrame:
    """Postings of the pages that can have a phrase of the query, where no stored postings are at hand. Pages without
    the letters of its words are dropped before they are cut into tokens. ``stems``: the words of the query are stems,
    and so are the terms; only words that begin as one of them can be are stemmed."""
    text = F.concat_ws("\n", *COLUMNS)
    letters = porter.beginning if stems else str
    can = F.lit(False)
    for p in q.phrases:
        every = F.lit(True)
        for t in p.terms:
            every = every & F.rlike(text, F.lit(f"(?i){letters(t)}"))  # (?i) folds ASCII alone; terms hold no signs
        can = can | every
    words = postings_of(pages.filter(can))
    if not stems:
        return words
    begins = F.lit(False)
    for x in sorted({letters(t) for p in q.phrases for t in p.terms}):
        begins = begins | F.col("term").startswith(x)
    return porter.stemmed(words.filter(begins))


def search(pages: DataFrame, request: SearchRequest, postings: DataFrame | None = None, records: int | None = None) -> DataFrame:
    """(doc_id, section, name, name_desc, machine, rank[, snippet]), best first; ties by doc_id. An empty result for a
    query without a word that must occur. ``records``: the number of pages, where it is known."""
    columns = ["doc_id", "section", "name", "name_desc", "machine"]
    try:
        q = parse(request.query)
    except ValueError:
        return pages.select(*columns, F.lit(0.0).alias("rank")).filter("false")
    if request.stems:
        q = q.words(porter.stem)
    stored = postings is not None
    found = ranks(postings if stored else scanned(pages, q, request.stems), pages.count() if records is None else records, q, stored)
    best = lambda df: df.orderBy(F.desc("rank"), "doc_id").offset(max(0, request.offset)).limit(request.limit)
    kept, limited = pages.select(*columns), request.limit is not None and request.limit >= 0
    filtered = bool(request.sections) or request.machine is not None
    if request.sections:
        kept = kept.filter(F.col("section").isin(list(request.sections)))
    if request.machine is not None:
        kept = kept.filter(F.col("machine") == request.machine)
    if limited and not filtered:
        out = kept.join(F.broadcast(best(found)) if request.limit <= BROADCAST_RESULT else best(found), "doc_id")
    else:
        out = kept.join(found, "doc_id")
        out = best(out) if limited else out
    out = out.orderBy(F.desc("rank"), "doc_id").select("doc_id", "section", display_name("name", "machine").alias("name"), "name_desc", "machine", "rank")
    if request.snippets:
        out = out.join(snippets(pages.join(out.select("doc_id"), "doc_id", "left_semi"), q, request.marks, request.stems), "doc_id", "left").orderBy(F.desc("rank"), "doc_id")
    return out


def snippets(pages: DataFrame, q: Query, marks: tuple[str, str, str], stems: bool = False) -> DataFrame:
    """(doc_id, snippet): of all columns, the leftmost window of at most SNIPPET_TOKENS words with most distinct words of
    the query; words of the query between the marks, an ellipsis where the column goes on. For the few rows of a result."""
    exact = sorted({t for p in q.phrases for k, t in enumerate(p.terms) if not (p.prefix and k == len(p.terms) - 1)})
    prefixes = sorted({p.terms[-1] for p in q.phrases if p.prefix})

    def is_hit(t: Column) -> Column:
        out = t.isin(exact) if exact else F.lit(False)
        for x in prefixes:
            out = out | t.startswith(x)
        return out

    fields = F.array(*[F.struct(F.lit(i).alias("col"), F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")).alias("t"), F.col(c).alias("raw")) for i, c in enumerate(COLUMNS)])
    rows = pages.select("doc_id", F.explode(fields).alias("f")).select("doc_id", "f.*").filter(F.size("t") > 0)
    # ``t`` are the words as they are compared, ``size`` of the shown ones may differ from them
    rows = rows.withColumn("size", F.transform("t", F.length))
    if stems:
        rows = rows.withColumn("t", porter.stem_arrays("t"))
    rows = rows.withColumn("hits", F.filter(F.transform("t", lambda t, i: F.when(is_hit(t), i)), lambda i: i.isNotNull()))
    # a best window begins at a hit, or ends with the column
    begins = F.transform(F.when(F.size("hits") > 0, F.col("hits")).otherwise(F.array(F.lit(0))), lambda i: F.greatest(F.lit(0), F.least(i, F.size("t") - SNIPPET_TOKENS)))
    scored = F.transform(begins, lambda b: F.struct(F.size(F.array_distinct(F.filter(F.slice("t", b + 1, SNIPPET_TOKENS), is_hit))).alias("k"), (-b).alias("b")))
    best = rows.withColumn("w", F.array_max(scored)).groupBy("doc_id").agg(F.max(F.struct("w.k", (-F.col("col")).alias("c"), "w.b", "raw", "t", "size")).alias("m"))
    raw = F.regexp_extract_all(F.col("m.raw"), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+[^0-9A-Za-z\x{80}-\x{10FFFF}]*"), F.lit(0))
    begin = -F.col("m.b")
    words = F.arrays_zip(F.slice("m.t", begin + 1, SNIPPET_TOKENS).alias("t"), F.slice("m.size", begin + 1, SNIPPET_TOKENS).alias("size"))
    shown = F.zip_with(F.slice(raw, begin + 1, SNIPPET_TOKENS), words, lambda r, w: F.when(is_hit(w["t"]), F.concat(F.lit(marks[0]), F.substring(r, F.lit(1), w["size"]), F.lit(marks[1]), F.substring(r, w["size"] + 1, F.length(r)))).otherwise(r))
    text = F.rtrim(F.array_join(shown, ""))
    return best.select(
        "doc_id",
        F.concat(F.when(begin > 0, F.lit(marks[2])).otherwise(""), text, F.when(begin + SNIPPET_TOKENS < F.size("m.t"), F.lit(marks[2])).otherwise("")).alias("snippet"),
    )


def lookup(pages: DataFrame, name: str) -> DataFrame:
    """Pages of exactly this name, by section and name."""
    return pages.filter(F.col("name") == name).select("doc_id", "section", "name", "name_desc").orderBy("section", "name", "doc_id")


def page_of(request: SearchRequest, number: int, size: int = 10) -> SearchRequest:
    """The request for a page of results, with one row more, which tells whether there is a next page."""
    from dataclasses import replace

    return replace(request, limit=size + 1, offset=(max(1, number) - 1) * size)
