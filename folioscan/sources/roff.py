"""Reading page sources: decompression, and the two macro packages as far as an index needs them. Pages are read and
decompressed as streams of lines, whatever their size; only the text that is kept is held.

What counts is the title line, section headings, names, the one-line description and cross references; other macros give
their arguments as text. Sections go to columns by heading (operators.index.SECTION_OF)."""

from __future__ import annotations

import bz2
import gzip
import hashlib
import io
import lzma
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.operators.index import SECTION_OF
from folioscan.schema import COLUMNS

PARSED = "file string, device bigint, inode bigint, mtime bigint, links string, error string, " + ", ".join(f"`{c}` string" for c in COLUMNS)
# Headings whose text the second package has no column for.
MAN_WITHOUT = {"ENVIRONMENT", "DIAGNOSTICS"}
_GLYPHS = {"hy": "-", "em": "-", "en": "-", "aq": "'", "dq": '"', "lq": '"', "rq": '"', "oq": "'", "cq": "'", "bu": "*", "co": "(c)", "rs": "\\"}
_ESCAPE = re.compile(r"\\(?:(?P<keep>[- ])|(?P<slash>e)|\((?P<two>..)|\[(?P<long>[^\]]*)\]|f(?:\(..|\[[^\]]*\]|.)|\*(?:\(..|\[[^\]]*\]|.)|s[-+]?\d+|[&|^%/,:cp0~]|\"(?P<comment>.*)|(?P<other>.))")


def opened(raw):
    """A stream of the decompressed content of a binary stream, by its first bytes; plain content as it is."""
    raw = raw if hasattr(raw, "peek") else io.BufferedReader(raw)
    head = raw.peek(6)[:6]
    if head[:2] == b"\x1f\x8b":
        return gzip.GzipFile(fileobj=raw)
    if head[:3] == b"BZh":
        return bz2.BZ2File(raw)
    if head == b"\xfd7zXZ\x00" or head[:3] == b"\x5d\x00\x00":
        return lzma.LZMAFile(raw)
    if head[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True))
    return raw


def decompressed(data: bytes) -> bytes:
    with opened(io.BytesIO(data)) as f:
        return f.read()


def unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        if m["keep"]:
            return m["keep"]
        if m["slash"]:
            return "\\"
        name = m["two"] or m["long"]
        return _GLYPHS.get(name, "") if name else ""

    return _ESCAPE.sub(one, text)


def _arguments(line: str) -> list[str]:
    return [a[1:-1] if len(a) > 1 and a[0] == a[-1] == '"' else a for a in re.findall(r'"[^"]*"|(?:\\.|\S)+', line)]


def _squeezed(parts: list[str]) -> str | None:
    return re.sub(r"[ \t\n\r\f\v]+", " ", " ".join(parts)).strip(" ") or None


def split_names(text: str) -> tuple[str | None, list[str], str]:
    """``a, b, c - what they do`` -> first name, aliases, description."""
    m = re.match(r"[\s-]*((?:[^\s,]+,\s*)*[^\s,]+)(?:\s+(?:-+\s*)?|$)(.*)", text.removeprefix("\\&"), re.S)
    if not m:
        return None, [], ""
    names = [n for n in re.split(r",\s*", m[1]) if n]
    return (names[0] if names else None), names[1:], m[2].strip()


def parse_page(source: str, names_only: bool = False) -> dict:
    """The columns of a page and its aliases (``links``). Without a name or description, the page is incomplete."""
    lines = source.split("\n")
    return parse_lines(lines, any(x.startswith(".Dt") for x in lines), names_only)


def parse_lines(lines: Iterable[str], semantic: bool, names_only: bool = False) -> dict:
    """``semantic``: the page is of the first package; it has a line that begins with .Dt, wherever that stands."""
    parts: dict[str, list[str]] = {}
    rec: dict = dict.fromkeys(COLUMNS)
    names, about, heading = [], [], None

    def add(text: str) -> None:
        if heading == "NAME":
            about.append(text)
        elif heading is not None and not names_only:
            h = "" if not semantic and heading in MAN_WITHOUT else heading
            column = SECTION_OF.get(h, "desc")
            if column:
                parts.setdefault(column, []).append(unescaped(text))

    for line in lines:
        line = line.rstrip("\r\n")
        if line[:1] not in (".", "'"):
            if line.strip():
                add(line)
            continue
        m = re.match(r"[.']\s*([A-Za-z]\w?|\\\"|)", line)
        macro, rest = m[1], line[m.end() :].strip()
        args = _arguments(rest)
        if macro in ("Sh", "SH"):
            heading = " ".join(args).upper() if macro == "SH" else " ".join(args)
        elif macro == "Dt":
            rec["section"] = args[1][:1] if len(args) > 1 else None
            rec["machine"] = args[2].lower() if len(args) > 2 else None
        elif macro == "TH":
            rec["section"] = args[1][:1] if len(args) > 1 else None
        elif semantic and macro == "Nm":
            if heading == "NAME":
                names += [unescaped(a).removesuffix(",") for a in args if a != ","]
            else:
                add(" ".join([*names, *args]))
        elif semantic and macro == "Nd":
            about.append(rest)
        elif macro == "Xr" and len(args) > 1:
            add(f"{args[0]}({args[1][:1]})")
        elif macro in ("", '\\"', "Dd", "Os", "Pp", "PP", "P", "LP", "br", "sp", "Bl", "El", "Bd", "Ed", "nf", "fi", "in", "ta", "if", "de", "ds", "nr"):
            continue
        elif args:
            add(" ".join(a for a in args if not (semantic and re.fullmatch(r"[A-Z][a-z]|Ns|No", a))))
    if semantic:
        names = [n for n in names if n]
        rec["name"], aliases = (names[0] if names else None), names[1:]
        rec["name_desc"] = _squeezed([unescaped(x) for x in about])
    else:
        rec["name"], aliases, desc = split_names(unescaped(" ".join(about)).strip())
        rec["name_desc"] = _squeezed([desc])
    rec["links"] = " ".join(aliases)
    return rec | {c: _squeezed(p) for c, p in parts.items()}


def read_page(path: str, names_only: bool = False) -> dict:
    """A file read twice as a stream of lines: for its checksum and kind, and for its columns."""
    digest, semantic = hashlib.md5(), False
    with open(path, "rb") as raw, opened(raw) as f:
        for line in f:
            digest.update(line)
            semantic = semantic or line.startswith(b".Dt")
    with open(path, "rb") as raw, opened(raw) as f:
        return parse_lines((x.decode("utf-8", "replace") for x in f), semantic, names_only) | {"md5_hash": digest.hexdigest()}


def read_pages(files: DataFrame, names_only: bool = False) -> DataFrame:
    """Files (device, inode, mtime, file) read, checksummed and parsed on the executors; ``error`` tells what failed."""

    def run(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                rec = {"file": r.file, "device": r.device, "inode": r.inode, "mtime": r.mtime, "error": None}
                try:
                    rec |= read_page(r.file, names_only)
                except (OSError, ValueError, EOFError, lzma.LZMAError) as e:
                    rec["error"] = str(e)[:200]
                rows.append(rec)
            yield pd.DataFrame(rows, columns=["file", "device", "inode", "mtime", "links", "error", *COLUMNS])

    return files.select("device", "inode", "mtime", "file").mapInPandas(run, PARSED)


def parse_sources(rows: DataFrame, key: str, source: str) -> DataFrame:
    """Page sources held in a column, parsed: the key, the columns of the page, its aliases. Null sources give no row."""

    def run(batches):
        for b in batches:
            recs = [parse_page(t) | {"k": k} for k, t in zip(b["k"], b["t"])]
            yield pd.DataFrame(recs, columns=["k", "links", *COLUMNS])

    kind = rows.schema[key].dataType.simpleString()
    schema = f"k {kind}, links string, " + ", ".join(f"`{c}` string" for c in COLUMNS)
    return rows.select(F.col(key).alias("k"), F.col(source).alias("t")).filter("t is not null").mapInPandas(run, schema).withColumnRenamed("k", key)
