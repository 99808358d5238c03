"""Words of many texts at once, as flat numpy arrays over Arrow's own buffers.

Tasks see Arrow columns of texts. Each column is cut into pieces of bounded bytes (a single
longer text is a piece of its own), and the words of a piece are found and hashed without a
Python loop over words or documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 21
MASK = (1 << 64) - 1
# Odd multipliers of the polynomial hashes over bytes and over words.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def separators(spec: str) -> np.ndarray:
    """256 flags: 'space' (ASCII white space) or 'nonword' (ASCII other than letters and digits)."""
    code = np.arange(256)
    if spec == "space":
        return (code == 32) | ((code >= 9) & (code <= 13))
    letter = ((code >= 97) & (code <= 122)) | ((code >= 65) & (code <= 90))
    return (code < 128) & ~letter & ~((code >= 48) & (code <= 57))


def byte_values(fold: bool) -> np.ndarray:
    """A 64-bit value for every byte; with ``fold`` A-Z have those of a-z."""
    out = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    if fold:
        out[65:91] = out[97:123]
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def rolled(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash (mod 2^64) of ``values[start:end]`` for every pair, by prefix sums."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    back = powers(pow(base, -1, 1 << 64), len(values) + 1)
    return (total[ends] - total[starts]) * back[starts]


@dataclass
class Piece:
    """Consecutive rows of a column: their bytes, and the row boundaries in them."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[Piece]:
    """The rows of a text column in pieces of about ``limit`` bytes (null: empty)."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    every = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield Piece(lo, every[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


@dataclass
class Words:
    """Words of a piece: byte spans, row of each, and the first word of every row."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def find_words(piece: Piece, seps: np.ndarray) -> Words:
    inside = ~seps[piece.data]
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(piece.rows + 1, np.int64))
    inner = piece.offsets[(piece.offsets > 0) & (piece.offsets < n)]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[inner] = inside[inner]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    stops[inner - 1] = inside[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(starts, ends, np.searchsorted(starts, piece.offsets).astype(np.int64))


def word_hashes(piece: Piece, words: Words, values: np.ndarray) -> np.ndarray:
    """64-bit hash of every word, its length included."""
    h = rolled(values[piece.data], words.starts, words.ends, BYTE_BASE)
    return mix(h + (words.ends - words.starts).astype(np.uint64))


def window_starts(words: Words, n: int) -> np.ndarray:
    """Index of the first word of every window of ``n`` words within one row."""
    left = np.repeat(words.first[1:], words.counts) - np.arange(words.first[-1])
    return np.flatnonzero(left >= n)


def window_hashes(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    return mix(rolled(hashes, starts, starts + n, WORD_BASE) + np.uint64(n))
