"""Vectorised words and word-sequence hashes over Arrow text columns.

Texts stay one flat byte buffer: words are byte spans found with a 256-entry class table, and a
word's name is a 64-bit polynomial hash of its bytes, so no Python object is made per word.
Everything here runs inside Spark tasks on slices of a batch (``slices``), so memory is bounded by
the slice size or by the longest single text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SEQ = np.uint64(0xD1342543DE82EF95)
_SEQ_INV = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words of `[^\x20\x09-\x0D]+`.
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z are lower-cased: every byte of a
#: character beyond U+007F is 0x80 or more.
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[48:58] = ALNUM_WORDS[97:123] = ALNUM_WORDS[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: spreads the bits of a polynomial hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The flat UTF-8 bytes of a string column and its n + 1 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offs = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return flat[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, most: int = SLICE_BYTES, rows: int = 1 << 30):
    """(first row, bytes, offsets) of successive runs of at most ``rows`` rows of about ``most`` bytes; a longer text is a run of its own."""
    flat, offs = text_bytes(column)
    first, n = 0, len(offs) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + most, side="right")) - 1)
        last = min(last, n, first + rows)
        yield first, flat[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


def word_spans(flat: np.ndarray, offs: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n + 1 offsets of the texts' words."""
    inside = word_bytes[flat]
    edge = np.zeros(len(flat) + 1, dtype=bool)
    edge[offs] = True
    before = np.empty(len(flat), dtype=bool)
    before[:1], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(flat), dtype=bool)
    after[-1:], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lens = ends - starts
    stops = np.cumsum(lens)
    within = np.arange(stops[-1]) - np.repeat(stops - lens, lens)
    table = powers(_MULT, int(lens.max()))
    codes = _BYTE[flat[within + np.repeat(starts, lens)]] * table[within]
    return mix(np.add.reduceat(codes, stops - lens) + lens.astype(np.uint64))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words; runs across texts are for the caller to leave out."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    if size <= 6:
        out = np.zeros(n, dtype=np.uint64)
        for j in range(size):
            out = out * _SEQ + words[j : j + n]
        return mix(out)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * powers(_SEQ, len(words)), out=sums[1:])
    return mix((sums[size:] - sums[:n]) * powers(_SEQ_INV, n))


def whole_hashes(words: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The hash of each text's whole word sequence, its length counted in."""
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * powers(_SEQ, len(words)), out=sums[1:])
    shift = powers(_SEQ_INV, len(words) + 1)
    return mix((sums[offs[1:]] - sums[offs[:-1]]) * shift[offs[:-1]] + np.diff(offs).astype(np.uint64) * _MULT)


def window_starts(offs: np.ndarray, size: int) -> np.ndarray:
    """A mask over all runs of ``size`` words: true where the run lies within one text."""
    total = int(offs[-1]) - size + 1
    if total <= 0:
        return np.zeros(0, dtype=bool)
    ok = np.ones(total, dtype=bool)
    for e in offs[1:-1]:
        ok[max(0, e - size + 1) : e] = False
    return ok


def doc_of(offs: np.ndarray) -> np.ndarray:
    """The text's index for each word."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))
