"""Vectorised text kernels over Arrow string columns: words, 64-bit hashes and shingles without a Python loop over words.

All functions see whole texts. Hashes depend on the bytes only, so they agree between executors, runs and platforms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: An odd multiplier, and the multipliers for word positions in a shingle.
BASE = 0x9E3779B97F4A7C15
POSITION = np.array([0x9DDFEA08EB382D69, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], dtype=np.uint64)

CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_table(predicate) -> np.ndarray:
    return np.array([predicate(b) for b in range(256)], dtype=bool)


#: Word bytes for ``[^\x20\x09-\x0D]+``.
BLANK_WORDS = _byte_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Word bytes for ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM_WORDS = _byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LOWER = LOWER.tobytes()
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: Words of more bytes are hashed one at a time.
LONG_WORD = 64


class Words(NamedTuple):
    """Words of a chunk of documents: byte start and end, the row each belongs to, and words per row."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    per_row: np.ndarray
    buf: np.ndarray
    off: np.ndarray


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of slices of about ``limit`` bytes; a longer text is a slice of its own. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(buf: np.ndarray, off: np.ndarray, table: np.ndarray = BLANK_WORDS, lower: bool = True, breaks: int | None = None) -> Words:
    """Find words. With ``breaks`` (a byte value) rows are the runs between such bytes, for example lines, instead of documents."""
    raw = buf.tobytes()
    if lower:
        raw = raw.translate(_LOWER)
        buf = np.frombuffer(raw, np.uint8)
    n = len(buf)
    if breaks is not None:
        cuts = np.flatnonzero(buf == breaks) + 1
        off = np.unique(np.concatenate([off, cuts]))
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(len(off) - 1, np.int64), buf, off)
    inside = np.frombuffer(raw.translate(table.tobytes()), bool)
    cut = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    cut = np.concatenate([np.zeros(int(inside[0]), np.int64), cut, np.full(int(inside[-1]), n)])
    # rows that end and begin within a word
    joints = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]
    joints = np.unique(joints[inside[joints - 1] & inside[joints]])
    start, end = cut[0::2], cut[1::2]
    if len(joints):
        start, end = np.sort(np.concatenate([start, joints])), np.sort(np.concatenate([end, joints]))
    # the last of rows that share an offset owns what begins there
    per_row = np.diff(np.searchsorted(start, off))
    return Words(start, end, np.repeat(np.arange(len(per_row)), per_row), per_row, buf, off)


def word_hashes(w: Words) -> np.ndarray:
    """One 64-bit hash per word."""
    if not len(w.start):
        return np.zeros(0, np.uint64)
    size = w.end - w.start
    eight = np.ndarray(len(w.buf) + 1, "<u8", np.concatenate([w.buf, np.zeros(8, np.uint8)]), strides=1)  # the eight bytes from every place
    h = mix((eight[w.start] & _FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(BASE))
    rest = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    for done in range(8, LONG_WORD, 8):
        h[rest] = mix(h[rest] * np.uint64(BASE) ^ (eight[w.start[rest] + done] & _FIRST[np.minimum(size[rest] - done, 8)]))
        rest = rest[size[rest] > done + 8]
    for x in np.flatnonzero(size > LONG_WORD):
        h[x] = int.from_bytes(hashlib.blake2b(w.buf[w.start[x] : w.end[x]], digest_size=8).digest(), "little")
    return h


def shingles(h: np.ndarray, per_row: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and their count per row. A row of fewer words, but not none, has its whole sequence as one."""
    n = len(h)
    ends = np.cumsum(per_row)
    count = np.where(per_row >= k, per_row - k + 1, np.minimum(per_row, 1))
    if not n:
        return np.zeros(0, np.uint64), count
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total[: n - j] += h[j:] * POSITION[j]
    starts = ends - per_row
    short = np.flatnonzero((per_row > 0) & (per_row < k))
    for m in range(1, k):
        rows = short[per_row[short] == m]
        if len(rows):
            at = starts[rows]
            s = np.full(len(rows), np.uint64(m), dtype=np.uint64) * np.uint64(BASE)
            for j in range(m):
                s += h[at + j] * POSITION[j]
            total[at] = s
    keep = np.repeat(starts, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    return mix(total[keep]), count


def split_rows(values: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """The values of each row."""
    return np.split(values, np.cumsum(count)[:-1]) if len(count) else []


WIDTHS = (np.uint8, np.uint16, np.uint32, np.int64)


def narrow(c: np.ndarray) -> np.ndarray:
    """Whole numbers as bytes, in the least width that holds them all, the code of the width first."""
    code = next(i for i, t in enumerate(WIDTHS) if not len(c) or (c.min() >= np.iinfo(t).min and c.max() <= np.iinfo(t).max))
    return np.concatenate([np.array([code], np.uint8), c.astype(WIDTHS[code]).view(np.uint8)])


def widen(b: bytes) -> np.ndarray:
    return np.frombuffer(b, WIDTHS[b[0]], offset=1).astype(np.int64)
