"""Words of many texts at once: byte tables, word bounds and 64-bit word hashes in numpy.

A text column of an Arrow batch is read in pieces of about a quarter of a megabyte: some twenty
arrays of 8 bytes a character live at a time, and a reused worker keeps what it once had. A word is a run of bytes that a table maps to something other than 0;
its hash is a polynomial over the mapped bytes modulo 2**64, mixed. No word spans two texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


class Words(NamedTuple):
    """Words of consecutive texts: hash, first and last byte (mapped), bounds, and rows' first words."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    data: np.ndarray


def lower_table(separators: str) -> np.ndarray:
    """Byte table that lower-cases A-Z and maps the bytes of ``separators`` to 0."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(separators.encode("latin-1"))] = 0
    table[0] = 0 if "\0" in separators else 255
    return table


#: Words split at ASCII white space only. Byte 0 takes the value 255, which UTF-8 never uses.
SPACE_WORDS = lower_table(" \t\n\v\f\r")
#: Words of digits, letters and everything beyond ASCII.
ALNUM_WORDS = lower_table("".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * PIECE)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), bounds


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of pieces of at most ``limit`` bytes
    or one row."""
    data, bounds = text_buffers(column)
    row, n = 0, len(bounds) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1)
        last = min(last, n)
        yield row, last, data[bounds[row] : bounds[last]], bounds[row : last + 1] - bounds[row]
        row = last


def _hash_run(mapped: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _power_tables(len(mapped))
    terms = mapped.astype(np.uint64)
    terms *= up[: len(mapped)]
    sums = np.cumsum(terms)
    return mix((sums[ends - 1] - sums[starts] + terms[starts]) * down[starts])


def _hash_words(mapped: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    parts, i = [np.zeros(0, np.uint64)], 0
    while i < len(starts):  # one round, but for a very long text
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + 4 * PIECE, "right")))
        low, high = starts[i], ends[j - 1]
        parts.append(_hash_run(mapped[low:high], starts[i:j] - low, ends[i:j] - low))
        i = j
    return np.concatenate(parts)


def prefix_hashes(found: Words, n: int) -> np.ndarray:
    """Hash of the first ``n`` bytes of each word; shorter words count whole."""
    return _hash_words(found.data, found.starts, np.minimum(found.ends, found.starts + n))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """All words of the texts that ``offsets`` bounds within ``data``."""
    mapped = table[data]
    n = len(mapped)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64), mapped)
    inside = mapped != 0
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | cut[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = _hash_words(mapped, starts, ends)
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets), mapped)


def word_hash(word: bytes, table: np.ndarray) -> int:
    """Hash of one word, as ``words`` gives it."""
    return int(words(np.frombuffer(word, np.uint8), np.array([0, len(word)]), table).hashes[0])


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` per row, where row i holds the entries first[i] to first[i + 1]."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def row_counts(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of set flags per row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
