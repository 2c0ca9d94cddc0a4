"""Passages of evaluation items inside training texts, by winnowing.

Of every ``WINDOW`` consecutive k-grams of words, the one with the least hash is kept as a fingerprint. A run of
``span`` = WINDOW + K - 1 words that both sides share contains the same window on both, so both keep the same fingerprint
of it: no shared run of that length is missed. Fingerprints are joined, and each hit is extended to both sides, word by
word, to the whole shared run; runs of at least ``span`` words count.

Words are maximal runs of ASCII letters and digits, without letter case, after font escapes (backslash, f, one
character) have been taken out.

The held-out items go to every task: they are measured first and taken in blocks of at most ``BLOCK_BYTES`` of text, so
what is broadcast is bounded however many items there are; usually there is one block. Texts are neither shuffled nor
collected.

Defined results: null texts and null ids give no rows; texts or items under ``span`` words share nothing; repeated rows
count once; an empty table on either side gives no rows. Texts are used whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.text import mix, utf8
from folioscan.storage import materialize

BLOCK_BYTES = 16 << 20
CHUNK = 1 << 20
HITS = 1 << 20
K = 6
FONT = re.compile(rb"\\f(?:[\x00-\x7f]|[\xc0-\xff][\x80-\xbf]*)")
SCHEMA = "doc_id bigint, item_id bigint, words int"

_LOW = np.zeros(256, np.uint64)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _LOW[_c] = _LOW[bytes([_c]).upper()[0]] = _c
_P = np.uint64(0x9E3779B97F4A7C15)
_PI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


class Powers:
    """Powers of the base of the word hash and of its inverse, as far as they have been needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            grow = lambda base: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))), dtype=np.uint64)
            self.up, self.down = grow(_P), grow(_PI)


def words(texts: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the text) of every word."""
    texts = [FONT.sub(b"", t) if b"\\f" in t else t for t in texts]
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    low = _LOW[buf]
    inside = np.concatenate(([0], (low != 0).view(np.int8)))
    edges = np.flatnonzero(np.diff(inside))
    start, end = edges[0::2], edges[1::2]
    powers.need(len(buf))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(low * powers.up[: len(buf)], dtype=np.uint64)))
    h = mix((total[end] - total[start]) * powers.down[start])
    ends = np.cumsum(np.array([len(t) + 1 for t in texts]))
    return h, np.searchsorted(ends, start, side="right")


def fingerprints(h: np.ndarray, text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, value) of the winnowed k-grams. Windows that reach over the end of a text may keep some more."""
    n = len(h) - K + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for j in range(K):
        g = g * _Q + h[j : j + n]
    g = mix(g)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    g[text[:n] != text[K - 1 :]] = top
    padded = np.concatenate((np.full(window - 1, top), g, np.full(window - 1, top)))
    least = padded[: n + window - 1].copy()  # of the window that begins here
    for j in range(1, window):
        np.minimum(least, padded[j : j + n + window - 1], out=least)
    kept = np.zeros(n, bool)
    for j in range(window):
        kept |= g == least[j : j + n]
    at = np.flatnonzero(kept & (g != top))
    return at, g[at]


class Items:
    """Words and fingerprints of a block of held-out items."""

    def __init__(self, ids: list[int], texts: list[bytes], window: int):
        self.ids = np.array(ids, np.int64)
        self.h, self.text = words(texts, Powers())
        at, value = fingerprints(self.h, self.text, window)
        order = np.argsort(value, kind="stable")
        self.at, self.value = at[order], value[order]

    def hits(self, h: np.ndarray, text: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (in the texts, in the items) at which fingerprints agree, about HITS at a time, however often one is
        repeated on both sides."""
        at, value = fingerprints(h, text, window)
        lo, hi = np.searchsorted(self.value, value, "left"), np.searchsorted(self.value, value, "right")
        met = hi > lo
        at, lo, hi = at[met], lo[met], hi[met]
        ends, begin = np.cumsum(hi - lo), 0
        while begin < len(at):
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + HITS, "right")))
            n = hi[begin:stop] - lo[begin:stop]
            first = np.repeat(lo[begin:stop] - (np.cumsum(n) - n), n)
            i, j = np.repeat(at[begin:stop], n), self.at[first + np.arange(n.sum())]
            # k-grams that follow each other without a word between are of one run: the first stands for all
            order = np.lexsort((i, i - j))
            i, j = i[order], j[order]
            new = np.ones(len(i), bool)
            new[1:] = (i[1:] - j[1:] != i[:-1] - j[:-1]) | (i[1:] - i[:-1] > K) | (text[i[1:]] != text[i[:-1]]) | (self.text[j[1:]] != self.text[j[:-1]])
            yield i[new], j[new]
            begin = stop

    def extend(self, h, text, i, j) -> np.ndarray:
        """Length in words of the whole shared run around each hit."""
        length = np.zeros(len(i), np.int64)
        for step in (1, -1):
            live, k = np.arange(len(i)), 0 if step == 1 else -1
            while len(live):
                a, b = i[live] + k, j[live] + k
                ok = (a >= 0) & (b >= 0) & (a < len(h)) & (b < len(self.h))
                a, b = np.where(ok, a, 0), np.where(ok, b, 0)
                ok &= (h[a] == self.h[b]) & (text[a] == text[i[live]]) & (self.text[b] == self.text[j[live]])
                live = live[ok]
                length[live] += 1
                k += step
        return length


def _longest(pairs: np.ndarray) -> np.ndarray:
    """Of (text, item, words) the most words of each text and item."""
    pairs = pairs[:, np.lexsort((-pairs[2], pairs[1], pairs[0]))]
    new = np.ones(pairs.shape[1], bool)
    new[1:] = (pairs[:2, 1:] != pairs[:2, :-1]).any(axis=0)
    return pairs[:, new]


def _chunks(ids: list, texts: list):
    part, size = [], 0
    for i, t in zip(ids, texts):
        if i is None or not t:
            continue
        part.append((i, t))
        size += len(t)
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def _scan(docs: DataFrame, shared, span: int) -> DataFrame:
    window = span - K + 1

    def scan(batches):
        items, powers = shared.value, Powers()
        for b in batches:
            for part in _chunks(b.column(0).to_pylist(), utf8(b.column(1))):
                h, text = words([t for _, t in part], powers)
                if len(h) < span:
                    continue
                best = np.empty((3, 0), np.int64)
                for i, j in items.hits(h, text, window):
                    run = items.extend(h, text, i, j)
                    keep = run >= span
                    best = _longest(np.concatenate((best, np.stack((text[i[keep]], items.text[j[keep]], run[keep]))), axis=1))
                if not best.shape[1]:
                    continue
                pairs, ids = best, np.array([d for d, _ in part], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[pairs[0]]), pa.array(items.ids[pairs[1]]), pa.array(pairs[2].astype(np.int32))], ["doc_id", "item_id", "words"])

    return docs.mapInArrow(scan, SCHEMA)


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, span: int = 12, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, words): documents and items that share at least ``span`` consecutive words; the longest run."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    items = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).filter("i is not null and t is not null").distinct()
    size = items.agg(F.sum(F.octet_length("t")).alias("n")).first().n
    if not size:
        return spark.createDataFrame([], SCHEMA)
    blocks = math.ceil(size / block_bytes)
    out = None
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).toArrow()
        shared = spark.sparkContext.broadcast(Items(rows.column(0).to_pylist(), utf8(rows.column(1).combine_chunks()), span - K + 1))
        found = _scan(docs, shared, span)
        if blocks > 1:
            found = materialize(found, "leaks")
            shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))
