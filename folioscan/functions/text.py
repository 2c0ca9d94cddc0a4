"""Text as columns: tokens, folding, stop-words, operators of a query."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.schema import COLUMNS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII letters and digits, and every code point from U+0080 on.
TOKEN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"

#: Words that a query may lose. The operators and, or, not are none. Pass another list where it matters.
STOPWORDS = frozenset(
    """about above after again all also am an any are as at be because been before being below between both but by can
    could did do does doing down during each else even ever every few for from further get had has have having he her
    here hers him his how i if in into is it its itself just like made make many may me might more most much must my
    no nor now of off on once one only onto our out over own per said same she should since so some such than that the
    their them then there these they this those though through to too under until up upon us use used uses using very
    was way we were what when where which while who whom why will with within without would yet you your""".split()
) - {"and", "or", "not"}


_FOLD = str.maketrans(UPPER, LOWER)


def folded(text: str) -> str:
    """A-Z in lower case; other letters keep their case."""
    return text.translate(_FOLD)


def read_stopwords(lines: Iterable[str]) -> frozenset[str]:
    """A list of stop-words, one on each line; blank lines and those that begin with # are left out."""
    return frozenset(w for w in (folded(x.strip()) for x in lines) if w and not w.startswith("#"))


def ascii_lower(c: Column) -> Column:
    """Folds A-Z alone; other letters keep their case. Plain ASCII text takes the short way, which is the same there."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(c), F.lit(TOKEN), F.lit(0))


def postings(pages: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(doc_id, col, pos, term, n): every token of every searchable column with its place; n is the column's length.

    Only the columns asked for are read. No shuffle. The length is taken before the tokens are laid out, so that no row
    carries the column's tokens along."""
    wanted = [c for c in COLUMNS if c in (columns or COLUMNS)]
    fields = F.array(*[F.struct(F.lit(COLUMNS.index(c)).alias("col"), tokens(F.col(c)).alias("toks")) for c in wanted])
    return (
        pages.select("doc_id", F.explode(fields).alias("f"))
        .filter("f.toks is not null")
        .select("doc_id", "f.col", F.size("f.toks").alias("n"), "f.toks")
        .select("doc_id", "col", "n", F.posexplode("toks").alias("pos", "term"))
        .select("doc_id", "col", "pos", "term", "n")
    )


def without_stopwords(c: Column, words: Iterable[str] = STOPWORDS) -> Column:
    """Words of ``c``, split at single blanks, that are no stop-words; null when none is left."""
    kept = F.filter(F.split(c, " "), lambda x: (x != "") & ~x.isin(sorted(words)))
    return F.nullif(F.array_join(kept, " "), F.lit(""))


def remove_stopwords(query: str, words: Iterable[str] = STOPWORDS) -> str | None:
    gone = frozenset(words)
    return " ".join(w for w in query.split(" ") if w and w not in gone) or None


OPERATORS = ("and", "not", "or")


def operators_upper(c: Column) -> Column:
    """Words that are an operator in upper case, the rest as it is."""
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.when(w.isin(list(OPERATORS)), F.upper(w)).otherwise(w)), " ")


def boolean_query(query: str, compat: bool = False) -> str:
    """Operators in upper case. ``compat``: as substrings, and an ``or``/``not`` left of a later ``and`` stays a word."""
    if not compat:
        return " ".join(w.upper() if w in OPERATORS else w for w in query.split(" "))
    at = 0
    while True:
        hit = next(((query.find(op, at), op) for op in OPERATORS if query.find(op, at) >= 0), None)
        if hit is None:
            return query
        i, op = hit
        query = query[:i] + op.upper() + query[i + len(op) :]
        at = i + 1
