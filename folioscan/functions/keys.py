"""Normal forms of the keys by which tables refer to each other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\x0b"


def trimmed(c: Column) -> Column:
    """Without surrounding ASCII white space; a blank value becomes null."""
    return F.nullif(F.btrim(c, F.lit(BLANKS)), F.lit(""))


def md5_key(c: Column) -> Column:
    """md5 values are equal whatever their letter case and surrounding white space; blank is no value."""
    return F.lower(trimmed(c))


def path_key(c: Column) -> Column:
    """Paths are equal up to repeated or trailing slashes and ``.`` segments; empty is no value."""
    p = F.regexp_replace(c, r"/(?:\.?/)+", "/")
    p = F.regexp_replace(p, r"/\.?$", "")
    p = F.regexp_replace(p, r"^(?:\./)+", "")
    return F.when(c == "", None).otherwise(F.when(p == "", F.lit("/")).otherwise(p))


def id_key(c: Column) -> Column:
    """Null, 0 and negative ids refer to nothing."""
    return F.when(c > 0, c.cast("string"))
