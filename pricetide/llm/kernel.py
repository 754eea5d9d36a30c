"""Array kernels over Arrow text columns, shared by the text operators of this subpackage.

Words are the maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``. Texts are taken whole and in
slices of about a megabyte, so temporaries stay small; one longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_random = np.random.default_rng(20_240_607)
_BYTE = _random.integers(0, 2**64, 256, np.uint64)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
PLACE = _random.integers(0, 2**64, 64, np.uint64) | np.uint64(1)
_STEP = 0x9E3779B97F4A7C15F39CC0605CEDC835 % 2**64 | 1
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values (two multiply and shift rounds)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA5CB9243F1B7E1D3)
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 256), _STEP, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers


class Slice(NamedTuple):
    """Rows lo to hi of a column: their UTF-8 bytes, and where each text starts and the last one ends."""

    lo: int
    hi: int
    data: np.ndarray
    bounds: np.ndarray


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a text column into slices of about ``limit`` bytes; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, values = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        yield Slice(lo, hi, data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
        lo = hi


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the flags or numbers within each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


class Words(NamedTuple):
    """A hash for each word of a slice, the text it is in, and the number of words of each text."""

    hashes: np.ndarray
    text: np.ndarray
    counts: np.ndarray


def words(part: Slice, lower: bool = False) -> Words:
    """Hash every word of a slice; with ``lower``, A-Z count as a-z."""
    texts = part.hi - part.lo
    inside = ~WHITE[part.data]
    at = np.flatnonzero(inside)
    if not len(at):
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(texts, np.int64))
    begins = np.zeros(len(part.data) + 1, bool)
    begins[part.bounds[:-1]] = True
    begins = begins[:-1]
    begins[1:] |= ~inside[:-1]
    begins[0] = True
    first = np.flatnonzero(begins[at])
    length = np.diff(np.append(first, len(at)))
    within = np.arange(len(at)) - np.repeat(first, length)
    value = (_BYTE_LOWER if lower else _BYTE)[part.data[at]] * _power(int(length.max()))[within]
    hashes = mix(np.add.reduceat(value, first) + length.astype(np.uint64) * PLACE[63])
    text = np.searchsorted(part.bounds, at[first], "right") - 1
    return Words(hashes, text, np.bincount(text, minlength=texts))


def grams(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text, and the place of each run's first word."""
    if len(found.hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(found.text[n - 1 :] == found.text[: len(found.text) - n + 1])
    value = np.zeros(len(at), np.uint64)
    for k in range(n):
        value += found.hashes[at + k] * PLACE[k]
    return mix(value + np.uint64(n)), at


class Sets(NamedTuple):
    """Sorted distinct shingle hashes, text by text; text i has those from bounds[i] to bounds[i + 1]."""

    hashes: np.ndarray
    bounds: np.ndarray


def shingle_sets(part: Slice, n: int) -> Sets:
    """The distinct n-word shingles of each text in lower case; a text of fewer words has its whole sequence as one."""
    found = words(part, lower=True)
    value, at = grams(found, n)
    text = found.text[at]
    few = np.flatnonzero((found.counts > 0) & (found.counts < n))
    if len(few):
        ends = np.cumsum(found.counts)
        own = [int((found.hashes[ends[i] - found.counts[i] : ends[i]] * PLACE[: found.counts[i]]).sum(dtype=np.uint64)) + int(found.counts[i]) for i in few]
        value = np.concatenate([value, mix(np.array([x % 2**64 for x in own], np.uint64))])
        text = np.concatenate([text, few])
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[new], text[new]
    bounds = np.zeros(part.hi - part.lo + 1, np.int64)
    np.cumsum(np.bincount(text, minlength=part.hi - part.lo), out=bounds[1:])
    return Sets(value, bounds)


def sum_ranges(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum modulo 2**64 of each range of values; an empty range gives 0."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def table(batch_columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(batch_columns[f.name], f.type) for f in schema], schema=schema)
