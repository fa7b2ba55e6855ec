"""Vectorised views over Arrow text columns: words and word shingles as 64-bit hashes.

Everything here works on the UTF-8 bytes that Arrow hands to a task, in blocks
of bounded size, so that memory does not depend on how long a text is beyond
the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE_LOWER = _BYTE[_LOWER]
SPACE_TABLE = np.zeros(256, dtype=bool)
SPACE_TABLE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SLOT = _rng.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * BLOCK_BYTES)
            up, down = np.full(m, _BASE), np.full(m, _BASE_INV)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray, kind: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of each word of the texts, in order. `space` is the
    table of bytes between words. With `kind`, classes of bytes (1 letter, 2 mark,
    4 other), A-Z count as a-z, and words of letters and marks alone are cut
    between the two."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if not n:
        return np.zeros(0, np.uint64), none, none, none
    gap = space[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = True, gap[:-1]
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = True, gap[1:]
    starts = np.flatnonzero(~gap & (before | edge[:-1]))
    ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
    if kind is not None and len(starts):
        other = np.concatenate(([0], np.cumsum(kind == 4)))
        cut = np.flatnonzero(((kind[1:] | kind[:-1]) == 3) & ~gap[1:] & ~gap[:-1] & ~edge[1:-1]) + 1
        word = np.searchsorted(starts, cut, "right") - 1
        cut = cut[other[ends[word]] == other[starts[word]]]
        starts, ends = np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))
    up, down = _powers.get(n)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((_BYTE if kind is None else _BYTE_LOWER)[raw] * up, out=total[1:])
    word = (total[ends] - total[starts]) * down[starts]
    rows = np.searchsorted(offsets, starts, "right") - 1
    return mix(word + (ends - starts).astype(np.uint64) * _SLOT[7]), rows, starts, ends


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word of the texts, in order; A-Z are lower-cased and
    words are the runs between the six ASCII white-space bytes."""
    hashes, rows, _, _ = word_spans(_LOWER[raw], offsets, SPACE_TABLE, None)
    return hashes, rows


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct word-shingle hashes. A text with fewer
    words has its whole sequence as one shingle; one without words has none."""
    n = len(offsets) - 1
    words, rows = word_hashes(raw, offsets)
    cut = np.searchsorted(rows, np.arange(n + 1))
    full = max(0, len(words) - size + 1)
    shingles = np.zeros(full, dtype=np.uint64)
    for k in range(size):
        shingles += words[k : k + full] * _SLOT[k]
    shingles = mix(shingles)
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b - a >= size:
            s = np.sort(shingles[a : b - size + 1])
            out.append(s if len(s) < 2 else s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            short = (words[a:b] * _SLOT[: b - a]).sum(keepdims=True, dtype=np.uint64)
            out.append(mix(short + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def codepoints(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of the texts."""
    text = raw.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=starts[1:])
    return points, starts[offsets]


#: No letter or digit has a code point from here on.
_TABLE = 0x40000


def lookup(fn, kind) -> np.ndarray:
    """A table over the code points of the planes that hold letters; all higher ones have its last entry."""
    return np.array([fn(chr(c)) for c in range(_TABLE)], dtype=kind)


def through(table: np.ndarray, points: np.ndarray) -> np.ndarray:
    return table[np.minimum(points, _TABLE - 1)]
