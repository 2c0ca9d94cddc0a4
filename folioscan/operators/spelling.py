"""Corrections and suggestions from the dictionary, by edits of one or two characters.

Candidates are generated rather than the dictionary compared with every word: a word of n letters has 54 n + 25 of them.
Candidates are the small, bounded side of each join; the dictionary is only ever read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions.text import LOWER, ascii_lower

#: Candidates beyond this number are joined by shuffle.
BROADCAST_CANDIDATES = 2_000_000


def edits1(word: Column) -> Column:
    """All strings one edit away, in order: at each place deletion, transposition, then for a to z replacement and
    insertion. With repeats, and with the word itself. Empty for an empty word."""
    n = F.length(word)
    letters = F.array(*[F.lit(c) for c in LOWER])

    def at(i: Column) -> Column:
        head, tail = F.substring(word, F.lit(1), i), F.substring(word, i + 1, n)
        rest = F.substring(word, i + 2, n)
        first, second = F.substring(word, i + 1, F.lit(1)), F.substring(word, i + 2, F.lit(1))
        moved = F.array(F.when(i < n, F.concat(head, rest)), F.when(i < n - 1, F.concat(head, second, first, F.substring(word, i + 3, n))))
        written = F.flatten(F.transform(letters, lambda c: F.array(F.when(i < n, F.concat(head, c, rest)), F.concat(head, c, tail))))
        return F.array_compact(F.concat(moved, written))

    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n), at))).otherwise(F.array().cast("array<string>"))


def count_edits(word: str) -> int:
    return 54 * len(word) + 25 if word else 0


def _small(candidates: DataFrame, words: list[str], twice: bool = False) -> DataFrame:
    bound = sum(count_edits(w) * ((54 * (len(w) + 1) + 25) if twice else 1) for w in words)
    return F.broadcast(candidates) if bound <= BROADCAST_CANDIDATES else candidates


def known_word(dictionary: DataFrame, candidates: DataFrame, by: str = "query") -> DataFrame:
    """(query, word): of the candidates in the dictionary the most frequent; ties by word."""
    return dictionary.join(candidates.distinct(), "word").groupBy(by).agg(F.min(F.struct((-F.col("frequency")).alias("f"), "word")).alias("m")).select(by, F.col("m.word").alias("word"))


def spell(spark, dictionary: DataFrame, words: list[str]) -> DataFrame:
    """(query, word): the word itself if it is known, else the best one edit away, else, in the order in which first edits
    are generated, the best that a second edit gives; null if there is none.

    The dictionary is read once for the words and their neighbours, and a second time only if words are left over; the
    driver sees one row for each word asked for."""
    schema, asked = "query string, word string", sorted(set(words))
    best = {}
    for twice in (False, True):
        left = [w for w in asked if w not in best]
        if not left:
            break
        rows = spark.createDataFrame([(w,) for w in left], "query string").withColumn("low", ascii_lower(F.col("query")))
        if twice:
            first = rows.select("query", F.posexplode(edits1(F.col("low"))).alias("i", "near"))
            near = first.select("query", "i", F.explode(edits1(F.col("near"))).alias("word"))
        else:
            near = rows.select("query", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("i"), F.col("low").alias("word"))), F.transform(edits1(F.col("low")), lambda x: F.struct(F.lit(1).alias("i"), x.alias("word"))))).alias("c")).select("query", "c.*")
        near = near.groupBy("query", "word").agg(F.min("i").alias("i"))
        found = dictionary.join(_small(near, left, twice), "word").groupBy("query").agg(F.min(F.struct("i", (-F.col("frequency")).alias("f"), "word")).alias("m"))
        best |= {r.query: r.word for r in found.select("query", F.col("m.word").alias("word")).collect()}
    return spark.createDataFrame([(w, best.get(w)) for w in asked], schema)


def suggest(spark, dictionary: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(suggestion, frequency): what is before the last blank, and dictionary words one edit away from the last word."""
    head, _, last = query.rpartition(" ")
    near = spark.createDataFrame([(last,)], "t string").select(F.explode(edits1(F.col("t"))).alias("word")).distinct()
    words = dictionary.join(_small(near, [last]), "word", "left_semi").orderBy(F.desc("frequency"), "word").limit(limit)
    return words.select((F.concat(F.lit(f"{head} "), "word") if head else F.col("word")).alias("suggestion"), "frequency")


def corrected(spark, dictionary: DataFrame, query: str) -> tuple[str, bool]:
    """The query with each word corrected where that is possible, and whether any was. For a query without results."""
    terms = [t for t in query.split(" ") if t]
    best = {r.query: r.word for r in spell(spark, dictionary, terms).collect()} if terms else {}
    return " ".join(best.get(t) or t for t in terms), any(best.get(t) for t in terms)
