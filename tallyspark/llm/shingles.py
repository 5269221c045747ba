"""Sets of word shingles as 64-bit hashes, computed for whole Arrow batches with numpy.

Words are runs of bytes other than the six ASCII blanks; A-Z count as a-z. A text with fewer words
than a shingle has its whole word sequence as its only shingle; one without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
#: Word hashes are computed for so many bytes at a time; a longer word is a block of its own.
HASH_BYTES = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_M = np.uint64(0xD6E8FEB86659FD93)
_TABLE = np.random.default_rng(20_240_501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[ord("A") : ord("Z") + 1] = _TABLE[ord("a") : ord("z") + 1]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_TABLE[_BLANK] = 0
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the hash base and of its inverse; doubled when a longer piece comes."""
    size = max(1 << 16, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        one = np.ones(1, np.uint64)
        _POWERS[size] = tuple(np.cumprod(np.concatenate([one, np.full(size - 1, p, np.uint64)])) for p in (_P, _P_INV))
    return _POWERS[size]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; nulls are empty."""
    texts = pa.array(texts, pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about PIECE_BYTES; a longer text is a piece of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, side="right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def _word_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the words that begin at starts; blanks after a word add nothing."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + HASH_BYTES)))
        part = data[starts[i] : starts[j] if j < len(starts) else len(data)]
        at = starts[i:j] - starts[i]
        pw, inv = _powers(len(part))
        out[i:j] = mix(np.add.reduceat(_TABLE[part] * pw[: len(part)], at) * inv[at])
        i = j
    return out


def shingle_sets(texts: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each piece of rows: first row, end row, sorted distinct hashes, and where each row's begin (one more at the end)."""
    data, offsets = _bytes_of(texts)
    for lo, hi in _pieces(offsets):
        base, end = int(offsets[lo]), int(offsets[hi])
        rows = hi - lo
        piece = data[base:end]
        blank = _BLANK[piece]
        first = np.ones(len(piece), bool)
        first[1:] = blank[:-1]
        own = offsets[lo:hi] - base
        first[own[own < len(piece)]] = True
        starts = np.flatnonzero(first & ~blank)
        if not len(starts):
            yield lo, hi, np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
            continue
        w = _word_hashes(piece, starts)
        of_row = np.searchsorted(starts, np.append(own, len(piece)))  # first word of each row
        count = np.diff(of_row)
        n_sh = np.where(count >= words, count - words + 1, (count > 0).astype(np.int64))
        begins = np.concatenate([[0], np.cumsum(n_sh)])
        out = np.zeros(begins[-1], np.uint64)
        if len(w) >= words:
            g = np.full(len(w) - words + 1, words, np.uint64)
            for j in range(words):
                g = g * _M + w[j : len(w) - words + 1 + j]
            row_of = np.repeat(np.arange(rows), count)
            inside = row_of[: len(g)] == row_of[words - 1 :]
            full = np.repeat(count >= words, n_sh)
            out[full] = g[inside]
        for r in np.flatnonzero((count > 0) & (count < words)):
            g = np.uint64(count[r])
            with np.errstate(over="ignore"):
                for x in w[of_row[r] : of_row[r + 1]]:
                    g = g * _M + x
            out[begins[r]] = g
        out = mix(out)
        for a, b in zip(begins[:-1], begins[1:], strict=True):
            if b - a > 1:
                out[a:b].sort()
        keep = np.ones(len(out), bool)
        keep[1:] = out[1:] != out[:-1]
        keep[begins[:-1][n_sh > 0]] = True
        ends = np.concatenate([[0], np.cumsum(keep)])[begins]
        yield lo, hi, out[keep], ends


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
