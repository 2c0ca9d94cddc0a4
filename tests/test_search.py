import math

import pytest

from folioscan.functions import porter
from folioscan.functions.text import postings
from folioscan.operators.query import parse
from folioscan.operators.search import SearchRequest, lookup, scanned, search
from folioscan.schema import COLUMNS, SATURATION, WEIGHTS


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        {"doc_id": 1, "section": "1", "name": "ls", "name_desc": "list files", "desc": "List the files of a directory. Files are listed.", "machine": None},
        {"doc_id": 2, "section": "1", "name": "find", "name_desc": "walk a file tree", "desc": "find files in a directory tree", "machine": ""},
        {"doc_id": 3, "section": "4", "name": "bin/boot", "name_desc": "start the vax", "desc": "files " + "x " * 60 + "tree files", "machine": "VAX"},
        {"doc_id": 4, "section": "9", "name": None, "name_desc": None, "desc": None, "machine": None},
    ]
    rows = [dict.fromkeys(COLUMNS) | r for r in rows]
    return spark.createDataFrame(rows, "doc_id bigint, " + ", ".join(f"`{c}` string" for c in COLUMNS))


def ids(df):
    return [r.doc_id for r in df.collect()]


def test_rank_by_hand(pages):
    got = {r.doc_id: r.rank for r in search(pages, SearchRequest("tree")).collect()}
    w2, w3 = WEIGHTS["name_desc"], WEIGHTS["desc"]
    idf = math.log(4 / 1) * w2 + math.log(4 / 2) * w3
    tf2 = 1 * w2 / (1 * 4) + 1 * w3 / (2 * 6)
    tf3 = 1 * w3 / (2 * 63)
    assert got == {2: round(tf2 * idf / (SATURATION + tf2), 12), 3: round(tf3 * idf / (SATURATION + tf3), 12)}


@pytest.mark.parametrize(
    "query, found",
    [
        ("files", {1, 2, 3}),
        ("files tree", {2, 3}),
        ("files NOT tree", {1}),
        ("(ls OR find) files", {1, 2}),
        ('"list files"', {1}),
        ('"files list"', set()),
        ("name:find", {2}),
        ("desc:vax", set()),
        ("dir*", {1, 2}),
        ("find NEAR/1 in", {2}),
        ("find NEAR/0 in", set()),
        ("in NEAR/1 find", {2}),
        ("nothere", set()),
        ("!!!", set()),
        ("NOT a", set()),
    ],
)
def test_matches(pages, query, found):
    assert set(ids(search(pages, SearchRequest(query, limit=None)))) == found


def test_filters_never_change_ranks(pages):
    every = {r.doc_id: r.rank for r in search(pages, SearchRequest("files", limit=None)).collect()}
    for r in search(pages, SearchRequest("files", sections=("4",))).collect() + search(pages, SearchRequest("files", machine="VAX")).collect():
        assert r.rank == every[r.doc_id] and r.name == "vax/boot"


def test_pages_of_results(pages):
    full = ids(search(pages, SearchRequest("files", limit=None, offset=1)))
    assert len(full) == 3
    assert ids(search(pages, SearchRequest("files", limit=1, offset=1))) == full[1:2]
    assert ids(search(pages, SearchRequest("files", limit=0))) == []
    assert ids(search(pages, SearchRequest("files", limit=2, offset=-5))) == full[:2]


def test_snippets(pages):
    got = {r.doc_id: r.snippet for r in search(pages, SearchRequest("files tree", marks=("<", ">", "..."), snippets=True)).collect()}
    assert got[2] == "find <files> in a directory <tree>"
    assert got[3].startswith("...") and got[3].endswith("<tree> <files>")


def test_lookup(pages):
    assert ids(lookup(pages, "find")) == [2] and ids(lookup(pages, "Find")) == []


def test_empty(pages):
    assert ids(search(pages.filter("false"), SearchRequest("files"))) == []


def rows_to_python(df):
    """Types of the rows that wait beside Python, and the operators below."""
    out, plans = [], [df._jdf.queryExecution().optimizedPlan()]
    while plans:
        plan = plans.pop()
        below = [plan.children().apply(i) for i in range(plan.children().size())]
        if "EvalPython" in plan.nodeName():
            out.append((below[0].schema().simpleString(), below[0].toString()))
        plans += below
    return out


def test_stemming_carries_no_page_along(pages):
    (row, _), = rows_to_python(porter.stemmed(postings(pages)))
    assert "term:string" in row and "array" not in row


def test_only_words_that_begin_so_are_stemmed(pages):
    (row, below), = rows_to_python(scanned(pages, parse("printed buffers").words(porter.stem), stems=True))
    assert "array" not in row and "StartsWith(term" in below


@pytest.mark.parametrize("query", ["files", "listing", "listed tree", '"lists files"', "fil*", "NOT x", "find OR vaxes", "find NOT listing", "desc:listed", "in NEAR/1 finding", "xs", "a", "directories", "directory*"])
def test_stems_without_stored_postings(pages, query):
    request = SearchRequest(query, limit=None, stems=True)
    assert search(pages, request).collect() == search(pages, request, porter.stemmed(postings(pages))).collect()


def test_stems_find_forms(pages):
    assert set(ids(search(pages, SearchRequest("listing", limit=None, stems=True)))) == {1}
    assert set(ids(search(pages, SearchRequest("directories tree", limit=None, stems=True)))) == {2}
