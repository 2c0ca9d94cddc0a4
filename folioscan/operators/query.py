"""Full-text queries: ``"a phrase"``, prefix ``ab*``, ``column:word``, ``a NEAR/5 b``, AND, OR, NOT, parentheses.

NOT binds closest, then AND (also between words that just follow each other), then OR.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from folioscan.functions.text import folded
from folioscan.schema import COLUMNS

_LEX = re.compile(r'\s*(?:(?P<paren>[()])|(?P<near>NEAR(?:/(?P<gap>\d+))?(?=\s))|(?P<op>AND|OR|NOT)(?=[\s()"]|$)|(?:(?P<col>[a-z_0-9]+):)?(?:"(?P<phrase>[^"]*)"|(?P<word>[^\s()"]+)))')
_TOKEN = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
NEAR_GAP = 10


@dataclass(frozen=True)
class Phrase:
    """Consecutive terms; the last one may be a prefix; ``col`` restricts it to one column."""

    terms: tuple[str, ...]
    prefix: bool = False
    col: int | None = None


@dataclass(frozen=True)
class Near:
    left: int
    right: int
    gap: int


@dataclass
class Query:
    phrases: list[Phrase] = field(default_factory=list)
    nears: list[Near] = field(default_factory=list)
    #: nested tuples: ("p", i), ("near", i), ("and", a, b), ("or", a, b), ("not", a, b)
    tree: tuple | None = None

    def words(self, change) -> Query:
        """The same query with changed words."""
        return replace(self, phrases=[replace(p, terms=tuple(change(t) for t in p.terms)) for p in self.phrases])

    def scored(self) -> list[int]:
        """Phrases that count in ranks: those not under the right side of a NOT."""
        out: list[int] = []

        def walk(t):
            if t[0] == "p":
                out.append(t[1])
            elif t[0] == "near":
                out.extend((self.nears[t[1]].left, self.nears[t[1]].right))
            else:
                walk(t[1])
                if t[0] != "not":
                    walk(t[2])

        if self.tree:
            walk(self.tree)
        return sorted(set(out))


def parse(text: str) -> Query:
    """Raises ValueError for a query that has no positive word or is malformed."""
    items, at = [], 0
    while at < len(text.rstrip()):
        m = _LEX.match(text, at)
        if not m:
            raise ValueError(f"cannot read the query from {text[at:]!r}")
        items.append(m)
        at = m.end()
    q = Query()
    i = 0

    def phrase(m) -> Phrase | None:
        col = m["col"]
        body = m["phrase"] if m["phrase"] is not None else m["word"]
        if col is not None and col not in COLUMNS:
            body, col = f"{col} {body}", None
        terms = tuple(_TOKEN.findall(folded(body)))
        return Phrase(terms, body.endswith("*"), COLUMNS.index(col) if col else None) if terms else None

    def atom():
        nonlocal i
        if i >= len(items):
            raise ValueError("the query ends too early")
        m = items[i]
        if m["paren"] == "(":
            i += 1
            t = either()
            if i >= len(items) or items[i]["paren"] != ")":
                raise ValueError("a parenthesis is not closed")
            i += 1
            return t
        if m["op"] or m["near"] or m["paren"]:
            raise ValueError(f"a word is missing before {m.group().strip()!r}")
        i += 1
        p = phrase(m)
        if p is None:
            return None
        q.phrases.append(p)
        return ("p", len(q.phrases) - 1)

    def near():
        nonlocal i
        t = atom()
        while i < len(items) and items[i]["near"]:
            gap = int(items[i]["gap"] or NEAR_GAP)
            i += 1
            r = atom()
            if not t or not r or t[0] == r[0] == "near" or r[0] != "p" or t[0] not in ("p", "near"):
                raise ValueError("NEAR stands between words or phrases")
            left = t[1] if t[0] == "p" else q.nears[t[1]].right
            q.nears.append(Near(left, r[1], gap))
            new = ("near", len(q.nears) - 1)
            t = new if t[0] == "p" else ("and", t, new)
        return t

    def without():
        nonlocal i
        t = near()
        while i < len(items) and items[i]["op"] == "NOT":
            i += 1
            r = near()
            if t is None:
                raise ValueError("a query needs a word that must occur")
            t = ("not", t, r) if r else t
        return t

    def both():
        nonlocal i
        t = without()
        while i < len(items) and items[i]["paren"] != ")" and items[i]["op"] != "OR":
            if items[i]["op"] == "AND":
                i += 1
            r = without()
            t = ("and", t, r) if t and r else t or r
        return t

    def either():
        nonlocal i
        t = both()
        while i < len(items) and items[i]["op"] == "OR":
            i += 1
            r = both()
            t = ("or", t, r) if t and r else t or r
        return t

    q.tree = either()
    if i < len(items):
        raise ValueError("a parenthesis too many")
    if q.tree is None:
        raise ValueError("a query needs a word that must occur")
    return q
