import bz2
import gzip
import os

import pytest

from folioscan.api import Engine, build_index
from folioscan.operators import index as ix
from folioscan.operators.catalog import CREATE, READ, Catalog
from folioscan.sources.crawl import crawl, directories
from folioscan.sources.roff import decompressed, parse_page, split_names
from folioscan.streaming.ingest import ingest

MDOC = """.\\" a comment
.Dd May 1, 2024
.Dt FROB 4 vax
.Os
.Sh NAME
.Nm frob ,
.Nm frobctl
.Nd control the frob, see
.Xr frobd 8
.Sh SYNOPSIS
.Nm
.Fl a
.Sh DESCRIPTION
The
.Nm
driver\\-like \\fBthing\\fR uses
.Xr socket 2 .
.Ss Details
.Pp
More text.
.Sh DIAGNOSTICS
frob0: broken
.Sh BUGS
None.
"""
MAN = """.TH ABC 1L "May 2024"
.SH NAME
abc, abd, abe \\- do the a b c
.SH DESCRIPTION
.B abc
does it.
.SH ENVIRONMENT
HOME is read.
.SH "RETURN VALUE"
Zero.
.SH COPYRIGHT
mine
"""


def test_semantic_page():
    p = parse_page(MDOC)
    assert (p["name"], p["links"], p["section"], p["machine"]) == ("frob", "frobctl", "4", "vax")
    assert p["name_desc"] == "control the frob, see frobd(8)"
    assert p["desc"] == "The frob frobctl driver-like thing uses socket(2) Details More text."
    assert p["diagnostics"] == "frob0: broken"
    assert parse_page(MDOC, names_only=True)["desc"] is None


def test_plain_page():
    p = parse_page(MAN)
    assert (p["name"], p["links"], p["section"], p["name_desc"]) == ("abc", "abd abe", "1", "do the a b c")
    assert p["desc"] == "abc does it. HOME is read." and p["return_vals"] == "Zero." and p["env"] is None
    assert parse_page("no macros at all")["name"] is None and parse_page("")["name"] is None


def test_split_names():
    assert split_names("a, b, c - text") == ("a", ["b", "c"], "text")
    assert split_names("\\&a text") == ("a", [], "text")
    assert split_names("") == (None, [], "")


def test_decompression():
    for packed in (gzip.compress(b"x"), bz2.compress(b"x"), b"x"):
        assert decompressed(packed) == b"x"


def write(path, data, packed=False):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with (gzip.open if packed else open)(path, "wb") as f:
        f.write(data.encode())


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("man"))
    write(f"{root}/man4/frob.4.gz", MDOC, True)
    write(f"{root}/man1/abc.1", MAN)
    write(f"{root}/man1/.hidden", MAN)
    write(f"{root}/man1/broken.1", "nothing")
    os.link(f"{root}/man1/abc.1", f"{root}/man1/abd.1")
    return root


def test_crawl(spark, tree):
    got = {r.file.removeprefix(tree) for r in crawl(spark, [tree, "/does/not/exist"]).collect()}
    assert got == {"/man4/frob.4.gz", "/man1/abc.1", "/man1/abd.1", "/man1/broken.1"}


def test_build_search_and_rebuild(spark, tree, tmp_path):
    root = f"file://{tmp_path}/index"
    first = build_index(spark, root, [tree])
    assert (first["files"], first["indexed"], first["errors"]) == (3, 2, 1)
    engine = Engine(spark, root)
    assert [r.name for r in engine.search("broken frob0").collect()] == ["vax/frob"]
    assert [r.name for r in engine.search("The driver OF socket", style="html").collect()] == ["vax/frob"]
    assert [r.section for r in engine.lookup("abc").collect()] == ["1"]
    assert engine.spell("sokcet") == "socket"
    assert {r.link for r in engine.catalog.table("links").collect()} == {"frobctl", "abd", "abe"}
    assert engine.correct("sokcet zzzzzz") == ("socket zzzzzz", True)
    rows, more = engine.page("the", 1, 1)
    assert len(rows) <= 1 and isinstance(more, bool)

    again = build_index(spark, root, [tree])
    assert again["indexed"] == 0 and again["examined"] == 1  # only the page that cannot be stored

    write(f"{tree}/man1/abc.1", MAN.replace("does it", "does nothing"))
    os.remove(f"{tree}/man4/frob.4.gz")
    third = build_index(spark, root, [tree])
    assert third["indexed"] == 1
    pages = Engine(spark, root).catalog.table("pages").collect()
    assert [p.desc for p in pages] == ["abc does nothing. HOME is read."]
    fresh = f"file://{tmp_path}/fresh"
    build_index(spark, fresh, [tree])
    key = lambda df: sorted(tuple(r) for r in df.collect())
    for t in ("pages", "links"):
        assert key(Engine(spark, root).catalog.table(t)) == key(Engine(spark, fresh).catalog.table(t))


def test_catalog_modes(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Catalog(spark, f"file://{tmp_path}/none", READ)
    Catalog(spark, f"file://{tmp_path}/new", CREATE)
    reader = Catalog(spark, f"file://{tmp_path}/new", READ)
    assert reader.table("pages").count() == 0 and reader.table("postings").count() == 0
    with pytest.raises(PermissionError):
        reader.publish({})


def test_words_keep_their_frequency(spark):
    old = spark.createDataFrame([("a", 1)], "word string, frequency bigint")
    new = spark.createDataFrame([("a", 5), ("b", 2)], "word string, frequency bigint")
    assert sorted(map(tuple, ix.add_words(old, new).collect())) == [("a", 1), ("b", 2)]
    assert sorted(map(tuple, ix.add_words(old, new, refresh=True).collect())) == [("a", 5), ("b", 2)]


def test_aliases(spark):
    p = spark.createDataFrame([("ls", "1", None, "x", ",a, b ,  c,")], "name string, section string, machine string, md5_hash string, l string")
    assert [r.link for r in ix.exploded_links(p, "l").collect()] == ["a", "b", "c"]


def test_stream(spark, tmp_path):
    from folioscan.schema import PAGES

    pages = lambda *rows: spark.createDataFrame([(i, "1", "n", "d", t, *[None] * 7, m, None)[:12] + (m, None) for i, t, m in rows], PAGES)
    src, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    pages((1, "one text", "aa"), (2, "same", "AA "), (3, "third", "bb")).write.mode("append").parquet(src)
    ingest(spark, src, PAGES, out, mark)
    pages((4, "old", "bb"), (5, "new", "cc"), (6, "no sum", None)).write.mode("append").parquet(src)
    ingest(spark, src, PAGES, out, mark)
    assert sorted(r.doc_id for r in spark.read.parquet(f"{out}/pages").collect()) == [1, 3, 5]
    assert spark.read.parquet(f"{out}/postings").filter("term = 'new'").count() == 1


def test_deep_trees_and_long_lists(spark, tmp_path):
    deep = "/".join(f"d{i}" for i in range(70))
    write(f"{tmp_path}/deep/{deep}/page.1", MAN)
    os.symlink(f"{tmp_path}/deep", f"{tmp_path}/deep/d0/loop")
    assert [r.file for r in crawl(spark, [f"{tmp_path}/deep"]).collect()] == [f"{tmp_path}/deep/{deep}/page.1"]
    for i in range(10_001):
        os.mkdir(f"{tmp_path}/m{i}")
    write(f"{tmp_path}/m10000/last.1", MAN)
    lines = spark.createDataFrame([("# note",), ("",)] + [(f" {tmp_path}/m{i} ",) for i in range(10_001)], "value string")
    found = directories(lines)
    assert found.count() == 10_001
    assert [(r.file, r.parent) for r in crawl(spark, found).collect()] == [(f"{tmp_path}/m10000/last.1", str(tmp_path))]


def test_pages_of_any_size(tmp_path):
    from folioscan.sources.roff import read_page

    line = "word " * 200_000
    with gzip.open(f"{tmp_path}/big.1.gz", "wb", 1) as f:
        f.write(b".TH BIG 1\r\n.SH NAME\nbig \\- a big page\n.SH EXAMPLES\n")
        for _ in range(70):
            f.write(line.encode() + b"\n")
        f.write(b".SH DESCRIPTION\nthe end\n")
    page = read_page(f"{tmp_path}/big.1.gz")
    assert (page["name"], page["name_desc"], page["desc"]) == ("big", "a big page", "the end")


def made(name, desc):
    return f".TH X 1\n.SH NAME\n{name} \\- {desc}\n.SH DESCRIPTION\n{desc}\n"


def files_below(path):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs)


def test_stems_and_folding(spark, tmp_path):
    write(f"{tmp_path}/man/a.1", made("a", "printing buffers now"))
    write(f"{tmp_path}/man/b.1", made("b", "Über die Straße"))
    build_index(spark, f"file://{tmp_path}/index", [f"{tmp_path}/man"])
    engine = Engine(spark, f"file://{tmp_path}/index")
    names = lambda q, **more: [r.name for r in engine.search(q, **more).collect()]
    assert names("buffer") == names("Buffers") == names("print") == names('"printed buffer"') == names("prin*") == ["a"]
    assert names("Über") == ["b"] and names("über") == []
    assert "\x02" not in engine.search("print").first().snippet and "<b>printing</b> <b>buffers</b>" in engine.search("print buffer", style="html").first().snippet
    assert Engine(spark, f"file://{tmp_path}/index", stopwords={"printing"}).search("printing").collect() == []
    answer = engine.ask("buffesr")
    assert (answer.query, answer.did_you_mean, answer.count, answer.has_next) == ("buffers", "buffers", 1, False)
    assert engine.ask("buffesr", again=False).rows == [] and engine.ask("zzzzzzzzz").did_you_mean is None and engine.count("die OR now", fold=False) == 2
    assert engine.sql("SELECT name FROM pages WHERE name_desc LIKE :like", like="%buff%").first().name == "a"


def test_segments(spark, tmp_path):
    man, root = f"{tmp_path}/man", f"{tmp_path}/index"
    for i in range(4):
        write(f"{man}/p{i}.1", made(f"p{i}", f"common word{i} text"))
    build_index(spark, f"file://{root}", [man])
    before = files_below(root)
    assert build_index(spark, f"file://{root}", [man])["examined"] == 0
    assert files_below(root) == before  # a run without changes writes nothing
    write(f"{man}/p0.1", made("p0", "common changed text"))
    os.remove(f"{man}/p1.1")
    os.rename(f"{man}/p2.1", f"{man}/moved.1")  # the same content under another path
    os.utime(f"{man}/p3.1", (1, 1))
    counts = build_index(spark, f"file://{root}", [man])
    assert (counts["examined"], counts["indexed"], counts["moved"]) == (3, 2, 1)
    assert set(before) <= set(files_below(root))  # nothing stored was rewritten
    engine = Engine(spark, f"file://{root}")

    def state():
        ranks = {r.name: r.rank for r in engine.search("common OR text", fold=False, snippets=False).collect()}
        return ranks, [r.name for r in engine.search("word0 OR word1", fold=False).collect()], engine.catalog.records(), sorted(r.file.removeprefix(man) for r in engine.catalog.table("meta").collect())

    now = state()
    assert set(now[0]) == {"p0", "p2", "p3"} and now[1:] == ([], 3, ["/moved.1", "/p0.1", "/p3.1"])
    assert {r.mtime for r in engine.catalog.table("meta").filter("file like '%p3.1'").collect()} == {1}
    fresh = f"file://{tmp_path}/fresh"
    build_index(spark, fresh, [man])
    assert {r.name: r.rank for r in Engine(spark, fresh).search("common OR text", fold=False, snippets=False).collect()} == now[0]
    writer = Catalog(spark, f"file://{root}", CREATE)
    assert writer.optimize() and len(writer.current()["segments"]) == 1 and state() == now
    assert writer.vacuum() > 0 and state() == now and len(os.listdir(f"{root}/pages")) == 1
    write(f"{man}/p1.1", made("p1", "common word1 text"))  # what was gone comes back
    build_index(spark, f"file://{root}", [man])
    assert state()[1] == ["p1"] and state()[2] == 4


def test_two_writers_publish_once(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    a, b = Catalog(spark, root, CREATE), Catalog(spark, root, CREATE)
    word = lambda w: spark.createDataFrame([(w, 1)], "word string, frequency bigint")
    turn = a._writing()
    assert b.append({"dict": word("b")})
    assert not a._publish(turn, [a._segment(turn, {"dict": word("a")})])
    assert [r.word for r in a.table("dict").collect()] == ["b"] and len(os.listdir(f"{tmp_path}/index/dict")) == 1
