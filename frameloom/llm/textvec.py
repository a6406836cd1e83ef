"""Vectorised word hashing: whole Arrow string batches become 64-bit word and shingle hashes without a Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SEGMENT = 1 << 20
_LONG_WORD = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of words for bag-of-words features: ASCII letters and digits, and every byte of a non-ASCII character.
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(_SEGMENT + _LONG_WORD + 1, base, U64)
        out[0] = 1
        return np.cumprod(out, dtype=U64)


_POW: dict[int, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _POW:
        _POW[0], _POW[1] = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a large_string array without nulls."""
    buffers = texts.buffers()
    off = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[off[0] : off[-1]] if buffers[2] is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def spans(data: np.ndarray, off: np.ndarray, letters: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words are runs between ASCII white space, or runs of letters and digits."""
    inside = _ALNUM[data] if letters else ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(off, start, side="right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, prefixes: tuple[int, ...] = ()) -> list[np.ndarray]:
    """Hash of every word, then of its first p bytes for each p of prefixes (0 where the word is no longer than p)."""
    power, inverse = _tables()
    out = [np.zeros(len(start), U64) for _ in range(1 + len(prefixes))]
    size = end - start
    usual = np.flatnonzero(size <= _LONG_WORD)
    with np.errstate(over="ignore"):
        lo = 0
        while lo < len(usual):
            base = start[usual[lo]]
            hi = max(lo + 1, int(np.searchsorted(end[usual], base + _SEGMENT, side="right")))
            rows = usual[lo:hi]
            part = data[base : end[rows[-1]]]
            if len(part) > len(power):  # a long word lies between
                hi = lo + 1
                rows = usual[lo:hi]
                part = data[base : end[rows[-1]]]
            sums = np.zeros(len(part) + 1, U64)
            np.cumsum((part.astype(U64) + U64(1)) * power[: len(part)], out=sums[1:])
            a = start[rows] - base
            for k, most in enumerate((None, *prefixes)):
                n = size[rows] if most is None else np.minimum(size[rows], most)
                h = mix((sums[a + n] - sums[a]) * inverse[a] + n.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(k))
                out[k][rows] = h if most is None else np.where(size[rows] > most, h, U64(0))
            lo = hi
    for i in np.flatnonzero(size > _LONG_WORD):
        for k, most in enumerate((None, *prefixes)):
            out[k][i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]][:most].tobytes(), seed=k)
    return out


def shingles(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every run of k words; a text of fewer words (one at least) is one shingle of all its words."""
    data, off = raw(texts)
    start, end, row = spans(data, off)
    h = hashes(data, start, end)[0]
    n = np.bincount(row, minlength=len(texts)) if len(row) else np.zeros(len(texts), np.int64)
    with np.errstate(over="ignore"):
        odd = mix(np.arange(1, k + 1, dtype=U64)) | U64(1)
        m = max(0, len(h) - k + 1)
        long = mix(sum((h[j : j + m] * odd[j] for j in range(k)), np.zeros(m, U64)))
        whole = row[:m] == row[k - 1 : k - 1 + m] if m else np.zeros(0, bool)
        rows, out = [row[:m][whole]], [long[whole]]
        few = np.flatnonzero((n > 0) & (n < k))
        if len(few):
            at = np.concatenate([[0], np.cumsum(n)])[few]
            total = n[few].astype(U64)
            for j in range(k - 1):
                has = n[few] > j
                total[has] += h[at[has] + j] * odd[j]
            rows.append(few)
            out.append(mix(total))
    return np.concatenate(rows), np.concatenate(out)
