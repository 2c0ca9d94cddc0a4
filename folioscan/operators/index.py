"""Keeping the index current: dictionary, differences between crawls, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions.text import postings
from folioscan.schema import DICTIONARY_COLUMNS

KEYS = ["device", "inode", "mtime", "file"]


def dictionary(pages: DataFrame) -> DataFrame:
    """(word, frequency): every word of the dictionary columns with all its occurrences."""
    return postings(pages, DICTIONARY_COLUMNS).groupBy(F.col("term").alias("word")).agg(F.count(F.lit(1)).alias("frequency"))


def add_words(known: DataFrame, new: DataFrame, refresh: bool = False) -> DataFrame:
    """Known words keep their frequency, new ones are added. ``refresh``: the new frequencies replace all."""
    return new if refresh else known.unionByName(new.join(known, "word", "left_anti"))


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Of each key the last row in this order, without gathering the rows of a key: one value for each is kept while
    rows are read. Null keys are kept as one key."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("m"))
    return best.select(*keys, *[F.col(f"m.{c}").alias(c) for c in rest]).select(*rows.columns)


def first_of(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Of each key the first row in this order; rows with a null key stay, each by itself."""
    rest = [c for c in rows.columns if c not in keys]
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    best = rows.filter(known).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("m"))
    kept = best.select(*keys, *[F.col(f"m.{c}").alias(c) for c in rest]).select(*rows.columns)
    return kept.unionByName(rows.filter(~known))


def one_per_content(files: DataFrame) -> DataFrame:
    """Of files of equal content the first by path."""
    return first_of(files, ["md5_hash"], F.col("file"))


def one_per_inode(files: DataFrame) -> DataFrame:
    """Of hard links the first by path."""
    return first_of(files, ["device", "inode"], F.col("file"))


def new_files(crawl: DataFrame, meta: DataFrame) -> DataFrame:
    """Crawled files of which meta has no row with the same device, inode, mtime and path."""
    return crawl.join(meta.select(*KEYS), KEYS, "left_anti")


def touched(meta: DataFrame, seen: DataFrame) -> DataFrame:
    """Meta after files of unchanged content have moved: device, inode and mtime of the crawl where path and content are
    the same; ``changed`` tells which rows differ."""
    now = seen.select("file", "md5_hash", *[F.col(c).alias(f"new_{c}") for c in ("device", "inode", "mtime")])
    joined = meta.join(now, ["file", "md5_hash"], "left")
    # a row without a match has all-null new values; inode and mtime of a file are never null
    hit = F.col("new_inode").isNotNull()
    differs = hit & ~(F.col("device").eqNullSafe(F.col("new_device")) & F.col("inode").eqNullSafe(F.col("new_inode")) & F.col("mtime").eqNullSafe(F.col("new_mtime")))
    return joined.select(*[F.when(hit, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("device", "inode", "mtime")], "file", "md5_hash", "id", differs.alias("changed"))


def upserted(meta: DataFrame, parsed: DataFrame) -> DataFrame:
    """Meta with the rows of newly parsed files in place of the old rows of these files."""
    return meta.join(parsed.select("file"), "file", "left_anti").select(*parsed.columns).unionByName(parsed)


def without_stale_meta(meta: DataFrame, crawl: DataFrame) -> DataFrame:
    return meta.join(crawl.select("file"), "file", "left_semi")


def stale_meta(meta: DataFrame, crawl: DataFrame) -> DataFrame:
    """Rows of meta whose file is gone."""
    return meta.join(crawl.select("file"), "file", "left_anti")


def stale_links(links: DataFrame, meta: DataFrame, key=lambda c: c) -> DataFrame:
    """Aliases of content that meta does not have."""
    return links.join(meta.select(key(F.col("md5_hash")).alias("_k")), key(links["md5_hash"]) == F.col("_k"), "left_anti")


def stale_pages(pages: DataFrame, meta: DataFrame) -> DataFrame:
    """Pages that no row of meta refers to."""
    return pages.join(meta.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")


def exploded_links(pages: DataFrame, names: str) -> DataFrame:
    """(link, target, section, machine, md5_hash): a list of aliases, split at blanks, one comma off each end."""
    alias = F.explode(F.split(F.col(names), " "))
    bare = F.regexp_replace(F.col("a"), r"^,|,$", "")
    return pages.select("name", "section", "machine", "md5_hash", alias.alias("a")).select(bare.alias("link"), F.col("name").alias("target"), "section", "machine", "md5_hash").filter("link <> ''")


def run_counters(crawl: DataFrame, meta: DataFrame, contents: DataFrame) -> DataFrame:
    """One row: files seen, files looked at again, those of content that is known under any path, those that are not."""
    again = new_files(crawl, meta).join(contents.select("file", "md5_hash"), "file", "left")
    known = meta.select("md5_hash").distinct().withColumn("known", F.lit(True))
    counted = again.join(known, "md5_hash", "left").agg(
        F.count(F.lit(1)).alias("examined"),
        F.count_if(F.col("known")).alias("links"),
        F.count_if(F.col("md5_hash").isNotNull() & F.col("known").isNull()).alias("indexed"),
        F.count_if(F.col("md5_hash").isNull()).alias("unread"),
    )
    return counted


# Headings of a page and the column their text goes to; None: the text is not kept.
SECTION_OF = {
    "NAME": None,
    "SYNOPSIS": None,
    "EXAMPLES": None,
    "EXAMPLE": None,
    "STANDARDS": None,
    "HISTORY": None,
    "AUTHORS": None,
    "BUGS": None,
    "COPYRIGHT": None,
    "LIBRARY": "lib",
    "RETURN VALUE": "return_vals",
    "RETURN VALUES": "return_vals",
    "ENVIRONMENT": "env",
    "FILES": "files",
    "EXIT STATUS": "exit_status",
    "DIAGNOSTICS": "diagnostics",
    "ERRORS": "errors",
}


def routed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, heading, column, lines): lines of a text under each heading, and where they go; text before any heading,
    and under others, goes to desc."""
    heading = lambda s: F.regexp_like(s, F.lit(r"^[A-Z][A-Z]+( [A-Z]+)*$"))
    lines = docs.select("doc_id", F.split(F.regexp_replace("text", "\r", ""), "\n").alias("l"))
    # fold over the lines of one text: state is the heading above, so no shuffle is needed
    start = F.struct(F.lit("").alias("h"), F.array().cast("array<string>").alias("out"))
    walked = F.aggregate("l", start, lambda s, x: F.when(heading(x), F.struct(x.alias("h"), s["out"].alias("out"))).otherwise(F.struct(s["h"].alias("h"), F.array_append(s["out"], s["h"]).alias("out"))))["out"]
    mapping = F.create_map(*[F.lit(x) for k, v in SECTION_OF.items() for x in (k, v or "")])
    return lines.select("doc_id", F.explode(walked).alias("heading")).groupBy("doc_id", "heading").agg(F.count(F.lit(1)).alias("lines")).withColumn("column", F.nullif(F.coalesce(F.try_element_at(mapping, F.col("heading")), F.lit("desc")), F.lit("")))


def compact(postings: DataFrame, partitions: int) -> DataFrame:
    """Postings by ranges of stems and in their order, so that files and row groups outside a query's words are skipped."""
    return postings.repartitionByRange(partitions, "stem", "doc_id").sortWithinPartitions("stem", "doc_id", "col", "pos")


def page_id(md5: Column) -> Column:
    """The id under which content is stored."""
    return F.xxhash64(md5).bitwiseAND(F.lit(2**63 - 1))
