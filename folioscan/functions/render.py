"""Results as text, HTML, pager output and JSON, and parameters of URLs, all as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions.text import ascii_lower, folded

START, END = "\x02", "\x03"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def display_name(name: Column | str, machine: Column | str) -> Column:
    """``machine/basename`` for a page of one machine, else its name."""
    n, m = _c(name), _c(machine)
    return F.when(m != "", F.concat_ws("/", ascii_lower(m), F.substring_index(n, "/", -1))).otherwise(n)


def html_escape(c: Column | str) -> Column:
    """Entities for &, <, > and the double quote; an & that begins the text or follows a backslash stays. Marks become <b>."""
    x = F.regexp_replace(_c(c), r"(?<!\\)(?<!^)&", "&amp;")
    for raw, shown in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), (START, "<b>"), (END, "</b>")):
        x = F.replace(x, F.lit(raw), F.lit(shown))
    return x


def overstrike(c: Column | str) -> Column:
    """Bold for a pager: each character between the marks is printed, stepped back over, and printed again."""
    parts = F.split(_c(c), START)
    bold = lambda s: F.array_join(F.transform(F.filter(F.split(s, ""), lambda ch: ch != ""), lambda ch: F.concat(ch, F.lit("\b"), ch)), "")
    rest = F.transform(F.slice(parts, 2, 2**30), lambda p: F.concat(bold(F.substring_index(p, END, 1)), F.when(F.instr(p, END) > 0, F.substring(p, F.instr(p, END) + 1, F.length(p))).otherwise("")))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))


def text_line(rows: DataFrame) -> DataFrame:
    """``name (section)<tab>description`` and the snippet, where there is one."""
    head = F.format_string("%s (%s)\t%s\n", "name", "section", "name_desc")
    return rows.select(F.concat(head, F.concat(F.col("snippet"), F.lit("\n\n")) if "snippet" in rows.columns else F.lit("")).alias("line"))


def lookup_line(rows: DataFrame) -> DataFrame:
    return rows.select(F.format_string("%s(%s) - %s\n", "name", "section", "name_desc").alias("line"))


def html_row(rows: DataFrame, base: str = "/man/") -> DataFrame:
    name, desc = html_escape("name"), html_escape("name_desc")
    snippet = html_escape("snippet") if "snippet" in rows.columns else F.lit("")
    return rows.select(F.concat(F.lit(f'<div class="result"><a href="{base}'), F.url_encode("name"), F.lit('.html">'), name, F.lit("("), F.col("section"), F.lit(")</a> "), desc, F.lit("<p>"), snippet, F.lit("</p></div>")).alias("html"))


def json_suggestions(query: Column | str, words: Column | str) -> Column:
    return F.to_json(F.struct(_c(query).alias("query"), _c(words).alias("suggestions")))


def url_decode(c: Column | str) -> Column:
    """``+`` as a blank, then %XX; null where that is malformed."""
    return F.try_url_decode(_c(c))


def url_param(query: Column | str, name: str) -> Column:
    """First value of a parameter of a query string, decoded; null if there is none."""
    pairs = F.filter(F.split(_c(query), "&"), lambda p: F.substring_index(p, "=", 1) == name)
    first = F.get(pairs, F.lit(0))
    return url_decode(F.when(F.instr(first, "=") > 0, F.substring(first, F.lit(len(name) + 2), F.length(first))).otherwise(F.when(first.isNotNull(), "")))


def starts_with(c: Column | str, text: str) -> Column:
    return ascii_lower(_c(c)).startswith(folded(text))


def highlight(c: Column | str, text: str) -> Column:
    """Every occurrence of ``text``, whatever its case, in <strong>."""
    return F.regexp_replace(_c(c), "(?i)(\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E)", "<strong>$1</strong>")


def completion_token(c: Column | str, delimiter: str | None = None) -> Column:
    """What is being typed: the last piece of the text, trimmed."""
    return F.trim(_c(c)) if delimiter is None else F.trim(F.element_at(F.split(_c(c), "\\Q" + delimiter + "\\E"), -1))
