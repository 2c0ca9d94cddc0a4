"""Tokens and their hashes, for whole Arrow batches at a time.

A token is a maximal run of ASCII letters, ASCII digits and code points from U+0080 on, with A-Z folded to a-z. On UTF-8
bytes that is a run of letters, digits and bytes from 0x80 on, and ``bytes.lower`` folds A-Z alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def small_batches(batches: Iterable[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, so that what is made of a batch fits beside it."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield b.slice(at, stop - at)
            at = stop


def tokens(text: bytes) -> list[bytes]:
    return TOKEN.findall(text.lower())


class TokenHashes(dict):
    """Token -> 64-bit hash, remembered; emptied when it has grown large."""

    LIMIT = 500_000

    def __missing__(self, token: bytes) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        h = self[token] = xxhash.xxh3_64_intdigest(token)
        return h

    def of(self, toks: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, toks), np.uint64, len(toks))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` tokens that begin at the places ``at``."""
    acc = np.zeros(len(at), np.uint64)
    for j in range(size):
        acc = acc * _A + hashes[at + j] * _B + _C
    return mix(acc)
