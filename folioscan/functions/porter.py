"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980), applied to distinct words only."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffixes and what replaces them, in the order of the paper's steps 2 to 4.
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
_TWO = sorted((tuple(x.split(":")) for x in STEP2.split()), key=lambda p: -len(p[0]))
_THREE = sorted((tuple(x.split(":")) for x in STEP3.split()), key=lambda p: -len(p[0]))
_FOUR = sorted(STEP4.split(), key=len, reverse=True)


def _shape(w: str) -> str:
    """'v' or 'c' for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _swap(w: str, rules: list[tuple[str, str]]) -> str:
    for suffix, new in rules:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + new if _measure(stem) > 0 else w
    return w


def stem(word: str) -> str:
    """The stem of a lower-case word; words with anything but a-z, or of under three letters, stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and "v" in _shape(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _TWO), _THREE)
    for suffix in _FOUR:
        if w.endswith(suffix):
            rest = w[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
                w = rest
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def beginning(stem: str) -> str:
    """What every word of this stem, or of a stem that begins with it, begins with: the rules leave at most two letters of
    their own (the le for biliti) at the end of what is left of the word."""
    return stem[:-2]


@lru_cache(maxsize=200_000)
def remembered(word: str) -> str:
    return stem(word)


@F.pandas_udf(T.StringType())
def stem_column(words: pd.Series) -> pd.Series:
    return words.map(remembered, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_arrays(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: [remembered(w) for w in ws], na_action="ignore")


def stems(terms: DataFrame, column: str = "term") -> DataFrame:
    """(term, stem) of the distinct terms."""
    return terms.select(F.col(column).alias("term")).distinct().withColumn("stem", stem_column("term"))


def stemmed(postings: DataFrame) -> DataFrame:
    """Postings with stems in place of terms: words pass through Python in batches, each looked up once; no shuffle."""
    return postings.select("doc_id", "col", "pos", stem_column("term").alias("term"), "n")
