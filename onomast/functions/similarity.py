"""Word and word-list similarity.

``ratio`` and ``metaphone`` are Arrow batch functions that work on many strings at once; what is
made of them is built from expressions over lists of scored pairs.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType


def _lcs_long(a: str, b: str) -> int:
    """Length of the longest common subsequence, for words that don't fit a machine word."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def lcs(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of longest common subsequences, pairwise, by bit-parallel steps over all pairs at once."""
    out = np.zeros(len(a), np.int64)
    words, ix = np.unique(np.array([*a, *b], object), return_inverse=True) if len(a) else (np.zeros(0, object), np.zeros(0, np.int64))
    size = np.array([len(w) for w in words], np.int64)
    ia, ib = ix[: len(a)], ix[len(a) :]
    fits = (size[ia] <= 63) & (size[ib] <= 63)
    for k in np.flatnonzero(~fits):
        out[k] = _lcs_long(a[k], b[k])
    k = np.flatnonzero(fits)
    if not len(k):
        return out
    short = np.flatnonzero(size <= 63)
    slot = np.zeros(len(words), np.int64)
    slot[short] = np.arange(len(short))
    letters = {c: n for n, c in enumerate(sorted({c for w in words[short] for c in w}))}
    table = np.zeros((len(short), len(letters) + 1), np.uint64)
    spelled = np.full((len(short), max(1, int(size[short].max(initial=0)))), len(letters), np.int64)
    for n, w in enumerate(words[short]):
        for i, c in enumerate(w):
            table[n, letters[c]] |= np.uint64(1 << i)
            spelled[n, i] = letters[c]
    one = np.uint64(1)
    x, y = slot[ia[k]], slot[ib[k]]
    full = (one << size[ia[k]].astype(np.uint64)) - one
    s = full.copy()
    for j in range(int(size[ib[k]].max(initial=0))):
        u = s & table[x, spelled[y, j]]
        s = ((s + u) | (s - u)) & full
    out[k] = size[ia[k]] - np.bitwise_count(s)
    return out


def lcs_table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of longest common subsequences of each word of ``a`` with each of ``b``, all at once."""
    size_a, size_b = (np.array([len(w) for w in x], np.int64) for x in (a, b))
    out = np.zeros((len(a), len(b)), np.int64)
    for i, j in zip(*np.nonzero((size_a > 63)[:, None] | (size_b > 63)[None, :])):
        out[i, j] = _lcs_long(a[i], b[j])
    ra, rb = np.flatnonzero(size_a <= 63), np.flatnonzero(size_b <= 63)
    if not len(ra) or not len(rb):
        return out
    letters = {c: n for n, c in enumerate(sorted({c for w in b[rb] for c in w}))}
    table = np.zeros((len(letters) + 1, len(ra)), np.uint64)  # the places of each letter in the words of a
    for n, w in enumerate(a[ra]):
        for i, c in enumerate(w):
            if c in letters:
                table[letters[c], n] |= np.uint64(1 << i)
    order = rb[np.argsort(-size_b[rb], kind="stable")]  # the longest first, so that each step takes a shorter head
    spelled = np.full((len(order), max(1, int(size_b[order].max()))), len(letters), np.int64)
    for n, w in enumerate(b[order]):
        spelled[n, : len(w)] = [letters[c] for c in w]
    full = (np.uint64(1) << size_a[ra].astype(np.uint64)) - np.uint64(1)
    s = np.repeat(full[None, :], len(order), 0)
    for j in range(int(size_b[order].max())):
        m = int(np.searchsorted(-size_b[order], -j))  # words longer than j
        head = s[:m]
        u = head & table[spelled[:m, j]]
        s[:m] = ((head + u) | (head - u)) & full
    out[np.ix_(ra, order)] = (size_a[ra][None, :] - np.bitwise_count(s)).T
    return out


def ratio_table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``ratios`` of each word of ``a`` with each of ``b``; words are distinct within each."""
    total = np.array([len(w) for w in a], np.float64)[:, None] + np.array([len(w) for w in b], np.float64)[None, :]
    score = np.rint(100 * 2 * lcs_table(a, b) / np.maximum(total, 1)).astype(np.int32)
    score[total == 0] = 100
    _, i, j = np.intersect1d(a.astype(str), b.astype(str), assume_unique=True, return_indices=True) if len(a) and len(b) else ([], [], [])
    score[i, j] = 100
    return score


def ratios(a: list[str | None], b: list[str | None]) -> np.ndarray:
    """Indel similarity 0..100 of each pair, halves rounded to even; 100 if equal, 0 with a null."""
    x, y = [v or "" for v in a], [v or "" for v in b]
    total = np.array([len(p) + len(q) for p, q in zip(x, y)], np.float64)
    score = np.rint(100 * 2 * lcs(x, y) / np.maximum(total, 1))
    same = np.array([p == q for p, q in zip(x, y)], bool)
    void = np.array([p is None or q is None for p, q in zip(a, b)], bool)
    return np.where(void, 0, np.where(same, 100, score)).astype(np.int32)


@F.pandas_udf(IntegerType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(ratios(a.tolist(), b.tolist()), dtype="int32")


def ratio_expr(a: Column, b: Column) -> Column:
    """``ratio`` as one expression, without Python; for few pairs of short words."""
    x, y = F.split(a, ""), F.split(b, "")
    zero = F.array_repeat(F.lit(0), F.length(b) + 1)

    def row(prev, c):
        # one row of the table: each entry from its left, upper and upper-left neighbours
        return F.aggregate(
            F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)),
            lambda acc, j: F.concat(acc, F.array(
                F.when(F.element_at(y, j) == c, F.element_at(prev, j) + 1).otherwise(F.greatest(F.element_at(prev, j + 1), F.element_at(acc, -1)))
            )),
        )

    length = F.element_at(F.aggregate(x, zero, row), -1)
    total = F.length(a) + F.length(b)
    return (
        F.when(a.isNull() | b.isNull(), 0).when(a == b, 100).when((F.length(a) == 0) | (F.length(b) == 0), 0)
        .otherwise(F.bround(200.0 * length / total)).cast("int")
    )


def most_ratio(len_a: Column, len_b: Column) -> Column:
    """The greatest ratio that words of these lengths can have."""
    return F.when(len_a + len_b == 0, 100.0).otherwise(F.bround(200.0 * F.least(len_a, len_b) / (len_a + len_b)))


_VOWELS = "AEIOU"


def metaphone_word(word: str) -> str:
    """The Metaphone code of 1990; letters only, so digits and marks have none."""
    w = re.sub("[^A-Z]", "", word.upper())
    if not w:
        return ""
    if w[:2] in ("AE", "GN", "KN", "PN", "WR"):
        w = w[1:]
    elif w[0] == "X":
        w = "S" + w[1:]
    elif w[:2] == "WH":
        w = "W" + w[2:]
    out = []
    n = len(w)
    for i, c in enumerate(w):
        prev, nxt, then = (w[i - 1] if i else ""), w[i + 1 : i + 2], w[i + 2 : i + 3]
        if c == prev and c != "C":
            continue
        if c in _VOWELS:
            code = c if i == 0 else ""
        elif c == "B":
            code = "" if i == n - 1 and prev == "M" else "B"
        elif c == "C":
            if nxt and nxt in "IEY":
                code = "" if prev == "S" else "X" if nxt == "I" and then == "A" else "S"
            elif nxt == "H":
                code = "K" if prev == "S" or (i == 0 and then and then not in _VOWELS) else "X"
            else:
                code = "K"
        elif c == "D":
            code = "J" if nxt == "G" and then and then in "EIY" else "T"
        elif c == "G":
            if nxt == "H" and not (i + 2 == n or then in _VOWELS) or nxt == "N" and (i + 2 == n or w[i + 2 :] == "ED"):
                code = ""
            elif prev == "D" and nxt and nxt in "EIY":
                code = ""
            elif nxt == "H":
                code = "" if i + 2 == n else "K"
            elif nxt and nxt in "EIY" and prev != "G":
                code = "J"
            else:
                code = "K"
        elif c == "H":
            code = "" if prev and prev in "CSPTG" or (prev in _VOWELS and nxt not in _VOWELS) or not nxt else "H"
        elif c == "K":
            code = "" if prev == "C" else "K"
        elif c == "P":
            code = "F" if nxt == "H" else "P"
        elif c == "Q":
            code = "K"
        elif c == "S":
            code = "X" if nxt == "H" or nxt == "I" and then in ("O", "A") else "S"
        elif c == "T":
            code = "X" if nxt == "I" and then in ("O", "A") else "0" if nxt == "H" else "" if nxt == "C" and then == "H" else "T"
        elif c == "V":
            code = "F"
        elif c in "WY":
            code = c if nxt and nxt in _VOWELS else ""
        elif c == "X":
            code = "KS"
        elif c == "Z":
            code = "S"
        else:
            code = c
        out.append(code)
    return "".join(out)


@F.pandas_udf(StringType())
def metaphone(word: pd.Series) -> pd.Series:
    seen = {w: None if w is None else metaphone_word(w) for w in set(word.tolist())}
    return word.map(lambda w: seen[w]).astype(object)


def phonetic(r: Column, code_ratio: Column, a: Column, b: Column, code_a: Column, code_b: Column, least: int = 90) -> Column:
    """A ratio from ``least`` to 99 becomes 100 if both words have a code and the codes have ratio 100."""
    lift = (r >= least) & (r < 100) & (a != "") & (b != "") & (code_a != "") & (code_b != "") & (code_ratio == 100)
    return F.when(lift, F.lit(100)).otherwise(r)


def ordered_score(scores: Column, total: float = 85.0) -> Column:
    """Score of two word lists from the 0..100 scores of their places, the shorter one padded.

    Place i weighs 1 / (i + 1)**2, all weights summing to ``total``; no places give 0.
    """
    weights = F.transform(scores, lambda s, i: 1.0 / ((i + 1) * (i + 1)).cast("double"))
    whole = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    part = F.aggregate(
        F.zip_with(scores, weights, lambda s, w: s.cast("double") * (F.lit(total) / whole * w) / 100.0), F.lit(0.0), lambda a, x: a + x
    )
    return F.when(F.size(scores) == 0, F.lit(0.0)).otherwise(part)


def greedy_pairs(pairs: Column) -> Column:
    """One-to-one assignment from the highest score; ``pairs`` are structs (score, word1, word2).

    Ties go by word1, then word2. Words are taken as distinct within their lists.
    """
    order = F.array_sort(
        pairs,
        lambda x, y: F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1)
        .when(x["word1"] < y["word1"], -1).when(x["word1"] > y["word1"], 1).when(x["word2"] < y["word2"], -1).when(x["word2"] > y["word2"], 1).otherwise(0),
    )
    return F.aggregate(
        order, F.slice(order, 1, 0),
        lambda acc, p: F.when(F.exists(acc, lambda q: (q["word1"] == p["word1"]) | (q["word2"] == p["word2"])), acc).otherwise(F.concat(acc, F.array(p))),
    )


def assigned_score(pairs: Column, size1: Column, size2: Column, factor: float) -> Column:
    """Sum of the assigned scores over 100 times the longer list, times ``factor``."""
    total = F.aggregate(greedy_pairs(pairs), F.lit(0.0), lambda a, p: a + p["score"].cast("double"))
    return F.try_divide(total, 100.0 * F.greatest(size1, size2)) * factor
