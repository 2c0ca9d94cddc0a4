import pytest
from pyspark.sql import functions as F

from folioscan.api import SuggestionCache, register_functions
from folioscan.functions.packing import packed, unpacked
from folioscan.functions.text import read_stopwords
from folioscan.sources.config import index_root, page_directories


def test_config():
    text = "# comment\nindex /a\npath /usr/man/ # first\npath /usr/man\npath /opt\nindex /b\n\n"
    assert index_root(text, "index") == "/b" and page_directories(text, "path") == ["/usr/man", "/opt"]
    for bad in ("", "index", "index /a\nindex"):
        with pytest.raises(ValueError):
            index_root(bad, "index")


def test_packing(spark):
    df = spark.createDataFrame([("text é",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(unpacked(packed(F.col("t")))).collect()] == ["text é", "", None]
    assert spark.createDataFrame([(bytearray(b"no"),)], "b binary").select(unpacked("b")).first()[0] is None


def test_sql_functions(spark):
    register_functions(spark)
    assert spark.sql("SELECT stem(w) AS s, unpack(pack(w)) AS u FROM VALUES (:w) AS t(w)", args={"w": "printed"}).first().asDict() == {"s": "print", "u": "printed"}


def test_query_words_and_ranks_in_sql(spark):
    register_functions(spark)
    rows = spark.sql("""SELECT phrase, place, word, stem, prefix FROM query_words('"printing buffers" OR keyb*') ORDER BY 1, 2""").collect()
    assert list(map(tuple, rows)) == [(0, 0, "printing", "print", False), (0, 1, "buffers", "buffer", False), (1, 0, "keyb", "keyb", True)]
    assert spark.sql("SELECT count(*) AS n FROM query_words('(')").first().n == 0
    assert spark.sql("SELECT rank_score(0.25D, 4.0D) AS r").first().r == 0.25


def test_stopwords_from_a_file():
    assert read_stopwords(["The\n", "", "# note", " of "]) == {"the", "of"}


def test_cache():
    asked = []
    cache = SuggestionCache(lambda q: asked.append(q) or (["x"] if q == "a" else []), size=2)
    assert cache.get("a") == ["x"] and cache.get("a") == ["x"] and cache.get("b") == [] and cache.get("bc") == []
    assert asked == ["a", "b", "bc"]
    cache.get("a")
    assert asked[-1] == "a"
    strict = SuggestionCache(lambda q: [], prefixes=True)
    assert strict.get("b") == [] and strict.get("bc") == [] and list(strict.known) == ["b"]
