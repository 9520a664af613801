"""Tokens of Arrow string columns as numpy arrays, without a Python object per token.

A token is a maximal run of ASCII letters and digits and of non-ASCII characters in the
lower-cased text; with ``punct`` the runs of other visible characters are tokens too. Its hash
depends on its bytes alone. Null and empty texts have no tokens.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240607)
_T = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_K1, _K2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15 | 1

_CLASS = np.zeros(256, np.uint8)  # 0 space and control, 1 word, 2 other
for _c in range(33, 127):
    _CLASS[_c] = 1 if chr(_c).isalnum() else 2
_CLASS[128:] = 1
_WORD = (_CLASS == 1).astype(np.uint8)

_powers = np.ones(1, np.uint64)


def _pow(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 4096)
        _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, _STEP, np.uint64), dtype=np.uint64)])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * _K1
    h ^= h >> np.uint64(27)
    h *= _K2
    h ^= h >> np.uint64(31)
    return h


class Tokens(NamedTuple):
    lo: int  # first row of the batch that this chunk covers
    buf: np.ndarray  # uint8, the lower-cased bytes of all rows
    offs: np.ndarray  # byte offset of each row, and the end
    start: np.ndarray  # byte offset of each token
    end: np.ndarray
    hash: np.ndarray  # uint64 of each token
    row: np.ndarray  # token offset of each row, and the end

    @property
    def rows(self) -> int:
        return len(self.offs) - 1


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = texts.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def pieces(texts: pa.Array, limit: int = 1 << 20):
    """(first row, rows) of runs of whole rows of at most ``limit`` bytes; a longer text is a run of its own."""
    _, offs = raw(texts)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def tokenize(texts: pa.Array, punct: bool = False, lo: int = 0) -> Tokens:
    buf, offs = raw(pc.utf8_lower(texts))
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return Tokens(lo, buf, offs, z, z, np.zeros(0, np.uint64), np.zeros(len(offs), np.int64))
    kind = (_CLASS if punct else _WORD)[buf]
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    heads = offs[:-1]
    first[heads[heads < n]] = True
    run = np.flatnonzero(first)
    stop = np.append(run[1:], n)
    keep = kind[run] > 0
    start, end = run[keep], stop[keep]
    length = end - start
    inside = np.flatnonzero(kind)
    at = np.zeros(len(start), np.int64)
    np.cumsum(length[:-1], out=at[1:])
    if len(start):
        place = np.arange(len(inside)) - np.repeat(at, length)
        h = mix(np.add.reduceat(_T[buf[inside]] * _pow(int(length.max()))[place], at))
    else:
        h = np.zeros(0, np.uint64)
    return Tokens(lo, buf, offs, start, end, h, np.searchsorted(start, offs))


def chunks(texts: pa.Array, punct: bool = False, limit: int = 1 << 20):
    """``Tokens`` of the whole column, in runs of rows that fit the caches."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for lo, part in pieces(texts, limit):
        yield tokenize(part, punct, lo)


def prefixes(t: Tokens, least: int, most: int):
    """For each length in bytes from least to most: which tokens are longer than it, and the hashes of their beginnings."""
    h = np.zeros(len(t.start), np.uint64)
    length = t.end - t.start
    powers = _pow(most)
    for k in range(most):
        ok = np.flatnonzero(length > k)
        h[ok] += _T[t.buf[t.start[ok] + k]] * powers[k]
        if k + 1 >= least:
            yield (longer := np.flatnonzero(length > k + 1)), mix(h[longer] + np.uint64(977 * (k + 1)))


def word_hash(words: list[str]) -> np.ndarray:
    """The hashes that ``tokenize`` gives to single words."""
    t = tokenize(pa.array([w.lower() for w in words], pa.string()))
    if len(t.hash) != len(words) or not np.array_equal(t.row, np.arange(len(words) + 1)):
        raise ValueError("each entry must be one token")
    return t.hash


def shingles(t: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each row in order, and their offsets by row.

    A row of fewer than n tokens has none.
    """
    if len(t.hash) < n:
        return np.zeros(0, np.uint64), np.zeros(len(t.row), np.int64)
    m = len(t.hash) - n + 1
    h = t.hash[:m].copy()
    for k in range(1, n):
        h = mix(h * np.uint64(3) + t.hash[k : k + m])
    left = np.maximum(np.diff(t.row) - n + 1, 0)
    row = np.repeat(np.arange(t.rows), np.diff(t.row))[:m]
    ok = np.arange(m) + n <= t.row[1:][row]
    return h[ok], np.concatenate([[0], np.cumsum(left)])


def distinct(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each row in ascending order, their counts, and offsets by row."""
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(rows[order].astype(np.uint32), kind="stable")]
    v, r = values[order], rows[order]
    if not len(v):
        return v, np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    new = np.append(True, (v[1:] != v[:-1]) | (r[1:] != r[:-1]))
    at = np.flatnonzero(new)
    return v[at], np.diff(np.append(at, len(v))), np.searchsorted(r[at], np.arange(len(offs)))


def row_sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of each row's values; 0 for empty rows."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offs[1:]] - total[offs[:-1]]
