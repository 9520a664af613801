"""An older way of scoring, by words of two names without regard to their order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import LinkConfig
from ..functions.similarity import ratios


def weighted_word_score(r: int, label1: int, label2: int, counts1: dict[int, int], counts2: dict[int, int], single: bool, config: LinkConfig = LinkConfig()) -> float:
    """Score of a word pair from its ratio, labels, and the number of words of each label on both sides.

    A ratio below the least counts 0. Equal labels weigh their share of the name; an important and
    a subsidiary word weigh as the important one on its side; other pairs aren't weighed. If the
    second name is a single word, an important one keeps the plain ratio.
    """
    s = r / 100 if r >= config.unordered_least else 0.0
    weight = {0: config.important_weight / 100, 1: config.subsidiary_weight / 100, 2: config.generic_weight / 100}
    if single and label2 == 0 and label1 == 0:
        return s
    if label1 == label2 and label1 in weight:
        return s * weight[label1] / max(1, counts1.get(label1, 0), counts2.get(label1, 0))
    if {label1, label2} == {0, 1}:
        return s * weight[0] / max(1, (counts1 if label1 == 0 else counts2).get(0, 0))
    return s


def weighted_word_scores(r: Column, label1: Column, label2: Column, important1: Column, important2: Column, same1: Column, same2: Column, single: Column, config: LinkConfig = LinkConfig()) -> Column:
    """``weighted_word_score`` as an expression.

    ``important1`` and ``important2`` count the important words of both names, ``same1`` and
    ``same2`` the words of the label of word 1 in both.
    """
    s = F.when(r >= config.unordered_least, r / 100.0).otherwise(0.0)
    weight = F.when(label1 == 0, config.important_weight / 100).when(label1 == 1, config.subsidiary_weight / 100).otherwise(config.generic_weight / 100)
    mixed = ((label1 == 0) & (label2 == 1)) | ((label1 == 1) & (label2 == 0))
    return (
        F.when(single & (label1 == 0) & (label2 == 0), s)
        .when((label1 == label2) & label1.isin(0, 1, 2), s * weight / F.greatest(F.lit(1), same1, same2))
        .when(mixed, s * (config.important_weight / 100) / F.greatest(F.lit(1), F.when(label1 == 0, important1).otherwise(important2)))
        .otherwise(s)
    )


def name_score(first: list[tuple[str, int]], second: list[tuple[str, int]], config: LinkConfig = LinkConfig()) -> float:
    """Score 0..100 of two labelled word lists: the sum over word pairs that are best for both of their words."""
    if not first or not second:
        return 0.0
    a, b = dict(first), dict(second)
    counts = [{k: sum(v == k for v in d.values()) for k in range(3)} for d in (a, b)]
    cells = [(x, y) for x in a for y in b]
    r = dict(zip(cells, ratios([x for x, _ in cells], [y for _, y in cells])))
    s = {c: weighted_word_score(int(r[c]), a[c[0]], b[c[1]], *counts, len(b) == 1, config) for c in cells}
    top_a = {x: max(b, key=lambda y: (s[x, y], -list(b).index(y))) for x in a}
    top_b = {y: max(a, key=lambda x: (s[x, y], -list(a).index(x))) for y in b}
    one = sum(s[x, top_a[x]] for x in a)
    if len(a) == len(b):
        return 100 * (one + sum(s[top_b[y], y] for y in b)) / 2
    return 100 * (one if len(a) < len(b) else sum(s[top_b[y], y] for y in b))


CELLS = 1 << 20


class _Side:
    """The distinct words of labelled lists: codes and labels row after row, a repeated word first with its last label."""

    def __init__(self, lists: pa.Array, codes: np.ndarray, labels: np.ndarray):
        n = pc.fill_null(lists.value_lengths(), 0).to_numpy()
        row = np.repeat(np.arange(len(n)), n)
        keys = row * (int(codes.max(initial=0)) + 1) + codes
        _, first = np.unique(keys, return_index=True)
        _, back = np.unique(keys[::-1], return_index=True)
        order = np.argsort(first)
        at = first[order]
        self.code, self.label, self.row = codes[at], labels[(len(keys) - 1 - back)[order]], row[at]
        self.n = np.bincount(self.row, minlength=len(n))
        self.start = np.concatenate([[0], np.cumsum(self.n)])
        known = (self.label >= 0) & (self.label <= 2)
        self.counts = np.bincount(self.row[known] * 3 + self.label[known], minlength=3 * len(n)).reshape(-1, 3)


def _row_sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of runs of ``n`` values, compensated for rounding as Python's own."""
    start = np.concatenate([[0], np.cumsum(n)])[:-1]
    total, rest = np.zeros(len(n)), np.zeros(len(n))
    for p in range(int(n.max(initial=0))):
        r = np.flatnonzero(n > p)
        x, t = values[start[r] + p], total[r]
        s = t + x
        rest[r] += np.where(np.abs(t) >= np.abs(x), (t - s) + x, (x - s) + t)
        total[r] = s
    return total + rest


def batch_name_scores(first: pa.Array, second: pa.Array, config: LinkConfig = LinkConfig()) -> np.ndarray:
    """``name_score`` of all rows of a batch at once, on numbered words; rows by runs of at most ``CELLS`` word pairs, or one."""
    flat = [x.flatten() for x in (first, second)]
    coded = pa.concat_arrays([x.field("word").cast(pa.string()) for x in flat]).dictionary_encode(null_encoding="encode")
    words = coded.dictionary.to_pylist()
    codes = np.split(coded.indices.to_numpy().astype(np.int64), [len(flat[0])])
    a, b = (_Side(x, c, pc.fill_null(f.field("label"), -1).to_numpy().astype(np.int64)) for x, c, f in zip((first, second), codes, flat))
    weight = np.array([config.important_weight / 100, config.subsidiary_weight / 100, config.generic_weight / 100])
    cells = np.cumsum(a.n * b.n)
    out, lo = np.zeros(len(first)), 0
    while lo < len(out):
        hi = max(lo + 1, int(np.searchsorted(cells, (cells[lo - 1] if lo else 0) + CELLS, "right")))
        out[lo:hi] = _scored_rows(a, b, lo, hi, words, weight, config)
        lo = hi
    return out


def _scored_rows(a: _Side, b: _Side, lo: int, hi: int, words: list, weight: np.ndarray, config: LinkConfig) -> np.ndarray:
    left = np.arange(a.start[lo], a.start[hi])
    many = b.n[a.row[left]]
    ia = np.repeat(left, many)
    row = a.row[ia]
    heads = np.concatenate([[0], np.cumsum(many)])
    ib = np.arange(len(ia)) - np.repeat(heads[:-1], many) + b.start[row]
    pairs, back = np.unique(a.code[ia] * len(words) + b.code[ib], return_inverse=True)
    x, y = np.divmod(pairs, max(1, len(words)))
    r = ratios([words[k] for k in x], [words[k] for k in y]).astype(np.int64)[back] if len(pairs) else np.zeros(0, np.int64)
    s = np.where(r >= config.unordered_least, r / 100, 0.0)
    la, lb = a.label[ia], b.label[ib]
    same = (la == lb) & (la >= 0) & (la <= 2)
    k = np.where(same, la, 0)
    equal = s * weight[k] / np.maximum(1, np.maximum(a.counts[row, k], b.counts[row, k]))
    mixed = ((la == 0) & (lb == 1)) | ((la == 1) & (lb == 0))
    across = s * weight[0] / np.maximum(1, np.where(la == 0, a.counts[row, 0], b.counts[row, 0]))
    plain = (b.n[row] == 1) & (la == 0) & (lb == 0)
    s = np.where(plain, s, np.where(same, equal, np.where(mixed, across, s)))
    # no score is negative
    top_a, top_b = np.zeros(len(left)), np.zeros(b.start[hi] - b.start[lo])
    np.maximum.at(top_a, ia - a.start[lo], s)
    np.maximum.at(top_b, ib - b.start[lo], s)
    na, nb = a.n[lo:hi], b.n[lo:hi]
    one, two = _row_sums(top_a, na), _row_sums(top_b, nb)
    return np.where((na == 0) | (nb == 0), 0.0, 100 * np.where(na == nb, (one + two) / 2, np.where(na < nb, one, two)))


def name_scores(config: LinkConfig = LinkConfig()):
    """A batch function of two columns of labelled words (arrays of word and label)."""
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(batch_name_scores(a, b, config), pa.float64())

    return F.arrow_udf(run, "double")
