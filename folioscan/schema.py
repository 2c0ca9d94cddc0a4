"""Tables of the index and the columns that ranking addresses by position."""

from __future__ import annotations

from pyspark.sql import types as T

#: Stored beside every snapshot; a snapshot of another version is refused.
SCHEMA_VERSION = 2

# Searchable columns in order, and their weights in ranking. Column 0 is searched but not ranked.
COLUMNS = ["section", "name", "name_desc", "desc", "lib", "return_vals", "env", "files", "exit_status", "diagnostics", "errors", "md5_hash", "machine"]
WEIGHTS = {
    "name": 2.0,
    "name_desc": 2.0,
    "desc": 0.55,
    "lib": 0.10,
    "return_vals": 0.001,
    "env": 0.20,
    "files": 0.01,
    "exit_status": 0.001,
    "diagnostics": 2.0,
    "errors": 0.05,
    "md5_hash": 0.0,
    "machine": 1.0,
}
#: Saturation of the term frequency part of a rank.
SATURATION = 3.75
#: Columns whose words make the dictionary: all but the checksum.
DICTIONARY_COLUMNS = [c for c in COLUMNS if c != "md5_hash"]

PAGES = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(c, T.StringType()) for c in COLUMNS])
META = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("device", "inode", "mtime")] + [T.StructField("file", T.StringType()), T.StructField("md5_hash", T.StringType()), T.StructField("id", T.LongType())]
)
LINKS = T.StructType([T.StructField(c, T.StringType()) for c in ("link", "target", "section", "machine", "md5_hash")])
DICTIONARY = T.StructType([T.StructField("word", T.StringType()), T.StructField("frequency", T.LongType())])
FILES = T.StructType(
    [T.StructField("device", T.LongType()), T.StructField("inode", T.LongType()), T.StructField("mtime", T.LongType()), T.StructField("parent", T.StringType()), T.StructField("file", T.StringType())]
)
POSTINGS = T.StructType(
    [T.StructField("stem", T.StringType()), T.StructField("term", T.StringType()), T.StructField("doc_id", T.LongType())] + [T.StructField(c, T.IntegerType()) for c in ("col", "pos", "n")]
)
GONE_PAGES = T.StructType([T.StructField("doc_id", T.LongType())])
GONE_FILES = T.StructType([T.StructField("file", T.StringType())])


def with_segment(kind: T.StructType) -> T.StructType:
    return T.StructType([*kind.fields, T.StructField("segment", T.StringType())])
