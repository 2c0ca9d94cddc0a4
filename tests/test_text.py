import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscan.functions import porter, render
from folioscan.functions.text import STOPWORDS, boolean_query, postings, remove_stopwords
from folioscan.operators.query import parse
from folioscan.operators.spelling import count_edits, edits1, spell, suggest
from folioscan.schema import COLUMNS


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_boolean_words():
    assert boolean_query("x or y and z", compat=True) == "x or y AND z"
    assert boolean_query("hand sort", compat=True) == "hAND sORt"
    assert boolean_query("x or y and hand") == "x OR y AND hand"


def test_stopwords():
    assert remove_stopwords("how to  list the files") == "list files"
    assert remove_stopwords("the of") is None
    assert not STOPWORDS & {"and", "or", "not"}
    assert remove_stopwords("mine is yours", ["mine"]) == "is yours"


# Printed examples of the paper.
PAPER = "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc digitizer:digit operator:oper feudalism:feudal decisiveness:decis hopefulness:hope formaliti:formal triplicate:triplic formative:form formalize:formal electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin adjustable:adjust defensible:defens irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt communism:commun activate:activ homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll generalizations:gener oscillators:oscil"


@pytest.mark.parametrize("pair", PAPER.split())
def test_porter(pair):
    word, stem = pair.split(":")
    assert porter.stem(word) == stem


@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyz", max_size=12))
def test_stem_is_no_longer(word):
    assert len(porter.stem(word)) <= len(word)


ENDINGS = ["", "s", "ed", "ing", "y", *(r.split(":")[0] for r in f"{porter.STEP2} {porter.STEP3} {porter.STEP4}".split())]


@given(st.text(alphabet="abceilnstvyz", max_size=6), st.lists(st.sampled_from(ENDINGS), max_size=3))
def test_words_begin_as_their_stems(word, ends):
    word += "".join(ends)
    assert word.startswith(porter.beginning(porter.stem(word)))


def test_parse():
    assert parse("a b OR c NOT d").tree == ("or", ("and", ("p", 0), ("p", 1)), ("not", ("p", 2), ("p", 3)))
    q = parse('name:"Foo bar" NEAR/2 x*')
    assert q.phrases[0].terms == ("foo", "bar") and q.phrases[0].col == COLUMNS.index("name") and q.phrases[1].prefix and q.nears[0].gap == 2
    assert parse("a NOT b").scored() == [0]
    for bad in ("NOT a", "", "(a", "a)", "AND", "a OR", "!!"):
        with pytest.raises(ValueError):
            parse(bad)


def test_postings(spark):
    page = dict.fromkeys(COLUMNS) | {"doc_id": 1, "desc": "The Émile x2, the", "name": ""}
    rows = spark.createDataFrame([page], "doc_id bigint, " + ", ".join(f"`{c}` string" for c in COLUMNS))
    got = [(r.col, r.pos, r.term, r.n) for r in postings(rows).orderBy("pos").collect()]
    assert got == [(3, 0, "the", 4), (3, 1, "Émile", 4), (3, 2, "x2", 4), (3, 3, "the", 4)]


def within_one(a, b):
    """Whether b is at most one deletion, insertion, replacement or swap of neighbours from a."""
    if a == b:
        return True
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) == 1 or (len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]])
    s, t = sorted((a, b), key=len)
    return len(t) - len(s) == 1 and any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


@settings(max_examples=5, deadline=None)
@given(word=st.text(alphabet="abc", min_size=1, max_size=6))
def test_edits(spark, word):
    got = one(spark, word, edits1)
    assert len(got) == count_edits(word)
    assert all(within_one(word, c) for c in got)


def test_edits_order(spark):
    got = one(spark, "ab", edits1)
    assert got[:4] == ["b", "ba", "ab", "aab"] and got[-1] == "abz"
    assert one(spark, "", edits1) == []


def test_spelling(spark):
    d = spark.createDataFrame([("socket", 5), ("pocket", 9), ("rocket", 9), ("list", 3)], "word string, frequency bigint")
    got = {r.query: r.word for r in spell(spark, d, ["Socket", "ocket", "lits", "lissst", "zzzz", ""]).collect()}
    assert got == {"Socket": "socket", "ocket": "pocket", "lits": "list", "lissst": "list", "zzzz": None, "": None}
    assert [r.suggestion for r in suggest(spark, d, "open xocket").collect()] == ["open pocket", "open rocket", "open socket"]


def test_html(spark):
    assert one(spark, 'a<b>"&c\\&d\x02e\x03', render.html_escape) == "a&lt;b&gt;&quot;&amp;c\\&d<b>e</b>"
    assert one(spark, "&x&y", render.html_escape) == "&x&amp;y"


def test_overstrike(spark):
    assert one(spark, "a\x02bc\x03d\x02e\x03", render.overstrike) == "ab\bbc\bcde\be"
    assert one(spark, "plain", render.overstrike) == "plain"


def test_urls(spark):
    get = lambda q, k: one(spark, q, lambda c: render.url_param(c, k))
    assert get("q=a+b%2fc&p=2&q=z", "q") == "a b/c"
    assert get("q=a&p", "p") == "" and get("q=a", "x") is None and get("aq=1", "q") is None


def test_names(spark):
    d = spark.createDataFrame([("a/b/C", "VAX"), ("a/b", ""), ("a/b", None)], "name string, machine string")
    assert [r[0] for r in d.select(render.display_name("name", "machine")).collect()] == ["vax/C", "a/b", "a/b"]
