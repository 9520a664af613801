"""Toxicity by a counterfactual-regularised linear classifier.

Features are the distinct words of a text and their beginnings of 3 to 8 bytes, hashed to
``BITS`` bits and kept when they occur in enough labelled documents. Training minimises the weighted logistic loss plus ``PENALTY`` times
the squared change of the score when an identity term in a labelled text is swapped for each
other term of its group, plus an L2 term. A neutral mention of a group thus moves the score as
little as a mention of any other. Terms that no training text holds have no weight.

The classifier is fitted on at most ``MAX_LABELLED`` labelled documents, those of the least
hashed doc_id; near copies in the sample share one vote. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec

BITS = 22
MAX_LABELLED = 20_000
PENALTY = 1.0
RIDGE = 2e-4
THRESHOLD = 0.3
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "lesbian", "bisexual", "straight", "heterosexual", "queer"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "flüchtlinge", "einwanderer"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("étrangers", "réfugiés", "immigrés"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("extranjeros", "refugiados", "inmigrantes"),
)


@dataclass(frozen=True)
class Model:
    """Sorted feature codes, their weights, and the bias."""

    codes: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        table = np.zeros(1 << BITS, bool)
        table[self.codes] = True
        object.__setattr__(self, "table", table)

    def score(self, t: textvec.Tokens) -> np.ndarray:
        """Probability for each row; each distinct feature counts once."""
        z = np.full(t.rows, self.bias)
        if len(self.codes):
            code, offs = features(t, self.table)
            code, _, offs = textvec.distinct(code, offs)
            z += textvec.row_sums(self.weights[np.searchsorted(self.codes, code)], offs)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def features(t: textvec.Tokens, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Feature codes of each row, repeats included, and their offsets; only the wanted ones."""
    rows = np.repeat(np.arange(t.rows), np.diff(t.row))
    codes, of = [], []
    for at, h in [(slice(None), t.hash), *textvec.prefixes(t, 3, 8)]:
        c, r = fold(h), rows[at]
        if wanted is not None:
            ok = wanted[c]
            c, r = c[ok], r[ok]
        codes.append(c)
        of.append(r)
    codes, of = np.concatenate(codes), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return codes[order], np.searchsorted(of[order], np.arange(t.rows + 1))


def fold(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _features(batches):
    """Per labelled text: distinct features, and four least trigram hashes that tell near copies."""
    for batch in batches:
        for t in textvec.chunks(batch.column(2)):
            code, _, at = textvec.distinct(*features(t))
            tri, off = textvec.shingles(t, 3)
            marks = []
            for k in range(4):
                h = textvec.mix(tri + np.uint64(k * 7919 + 1)).view(np.int64)
                marks.append([int(h[a:b].min()) if b > a else None for a, b in zip(off[:-1], off[1:])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(t.lo, t.rows), batch.column(1).slice(t.lo, t.rows),
                 pa.Array.from_buffers(pa.binary(), t.rows, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(code.astype(np.int32))]),
                 pa.array([list(m) for m in zip(*marks)], pa.list_(pa.int64()))],
                names=["doc_id", "toxic", "codes", "marks"],
            )


def _logistic(rows, cols, y, w, size, swaps, penalty, ridge, rounds=400):
    """Accelerated gradient descent on the mean loss; ``swaps``: a row of feature changes for each kind of swap, and their votes."""
    coef, bias = np.zeros(size), 0.0
    total = w.sum()
    per = np.bincount(rows, minlength=len(y))
    change, times = swaps
    rate = 1 / (0.25 * (np.sum(w * (per + 1)) / total) + ridge + 2 * penalty * np.sum(times * (change**2).sum(1)) / total + 1e-9)
    rate *= 4  # the bound is loose; a step that raises the loss halves it
    last, momentum, prev, prev_b = np.inf, 0.0, coef.copy(), bias
    for it in range(rounds):
        momentum = it / (it + 3)
        look, look_b = coef + momentum * (coef - prev), bias + momentum * (bias - prev_b)
        z = np.bincount(rows, look[cols], len(y)) + look_b
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        gap = change @ look
        loss = np.sum(w * (np.logaddexp(0, z) - y * z)) / total + ridge / 2 * look @ look + penalty * np.sum(times * gap**2) / total
        g = w * (p - y) / total
        grad = np.bincount(cols, g[rows], size) + ridge * look
        grad += 2 * penalty / total * ((times * gap) @ change)
        if loss > last * 1.02:
            rate /= 2
            prev, prev_b = coef.copy(), bias
            last = np.inf
            continue
        last = loss
        prev, prev_b, coef, bias = coef, bias, look - rate * grad, look_b - rate * g.sum()
    return coef, bias


def _spans(offs: np.ndarray, many: int = 1_000_000):
    """(first row, end row) of runs of rows with about ``many`` features."""
    lo = 0
    while lo < len(offs) - 1:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + many, "right")) - 1)
        yield lo, hi
        lo = hi


def fit(codes: np.ndarray, offs: np.ndarray, toxic: np.ndarray, votes: np.ndarray, penalty: float = PENALTY, ridge: float = RIDGE) -> Model:
    """Fits the distinct features ``codes[offs[i]:offs[i + 1]]`` of each text to 0/1 labels with the given votes."""
    none = np.zeros(0, np.int64), np.zeros(0)
    if not len(toxic) or not votes.sum():
        return Model(*none, -40.0)
    rate = float((votes * toxic).sum() / votes.sum())
    if rate in (0.0, 1.0):
        return Model(*none, 40.0 * (2 * rate - 1))
    seen, pos = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for lo, hi in _spans(offs):
        part, n = codes[offs[lo] : offs[hi]], np.diff(offs[lo : hi + 1])
        seen += np.bincount(part, np.repeat(votes[lo:hi], n), 1 << BITS)
        pos += np.bincount(part, np.repeat((votes * toxic)[lo:hi], n), 1 << BITS)
    # features that tell the classes apart beyond chance, by a binomial z-score on votes
    often = np.flatnonzero(seen >= max(3.0, 0.002 * votes.sum()))
    z = (pos[often] - seen[often] * rate) / np.sqrt(seen[often] * rate * (1 - rate) + 1e-9)
    keep = np.zeros(1 << BITS, bool)
    keep[often[np.abs(z) >= 4]] = True
    terms = {t: textvec.tokenize(pa.array([t])) for g in IDENTITY_GROUPS for t in g}
    word = {int(fold(t.hash)[0]): k for k, t in terms.items()}
    named = np.zeros(1 << BITS, bool)
    named[list(word)] = True
    keep |= named & (seen > 0)
    del seen, pos
    names = np.flatnonzero(keep)
    if not len(names):
        return Model(*none, float(np.log(rate / (1 - rate))))
    place = np.cumsum(keep) - 1
    rows, cols = [], []
    for lo, hi in _spans(offs):
        part = codes[offs[lo] : offs[hi]]
        ok = keep[part]
        rows.append(np.repeat(np.arange(lo, hi), np.diff(offs[lo : hi + 1]))[ok])
        cols.append(place[part[ok]])
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    # a swap takes the term's own word and beginnings out of a text and puts the other's in
    votes_of: dict[str, float] = {}
    for r, c in zip(*(x[named[names[cols]]] for x in (rows, cols))):
        votes_of[word[int(names[c])]] = votes_of.get(word[int(names[c])], 0.0) + float(votes[r])
    change, times = [], []
    for g in IDENTITY_GROUPS:
        for t in g:
            for other in g:
                if t in votes_of and other != t:
                    d = np.zeros(len(names))
                    for sign, x in ((-1, t), (1, other)):
                        c = np.unique(features(terms[x], keep)[0])
                        d[place[c]] += sign
                    change.append(d)
                    times.append(votes_of[t])
    swaps = np.array(change).reshape(-1, len(names)), np.array(times)
    coef, bias = _logistic(rows, cols, toxic.astype(float), votes.astype(float), len(names), swaps, penalty, ridge)
    return Model(names, coef, float(bias))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, penalty: float = PENALTY) -> Model:
    """Fits the classifier on documents with a 0/1 ``toxic`` label.

    Rows with a null doc_id, label or text don't take part; of repeated labels of one document
    the greatest counts, of repeated rows of one doc_id the least text, so the sample never has more
    than ``max_labelled`` texts. Very long texts count whole, empty ones as texts without features.
    Without any labelled text, as in an empty table, nothing is found toxic. Other columns of
    either table, of whatever names, are ignored; doc_id is a whole number.
    """
    picked = (
        labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    sample = (
        docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    )
    got = sample.mapInArrow(_features, "doc_id long, toxic int, codes binary, marks array<long>").toArrow()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    toxic, count = got["toxic"].to_numpy()[order], got.num_rows
    marks = np.array([[m if m is not None else -k - 1 for m in x] for k, x in enumerate(got["marks"].to_pylist())], np.int64).reshape(-1, 4)[order]
    codes = got["codes"]
    del got
    size = np.concatenate([pc.binary_length(c).to_numpy(zero_copy_only=False) for c in codes.chunks]) // 4 if count else np.zeros(0, np.int64)
    offs = np.concatenate([[0], np.cumsum(size[order])]).astype(np.int64)
    flat, to = np.empty(int(offs[-1]), np.int32), np.empty(count, np.int64)
    to[order] = offs[:-1]
    at = 0
    for chunk in codes.chunks:  # each row to its place, without a second copy of all
        part, ends = textvec.raw(chunk)
        for k in range(len(chunk)):
            flat[to[at + k] : to[at + k] + size[at + k]] = part[ends[k] : ends[k + 1]].view(np.int32)
        at += len(chunk)
    del codes
    times = np.ones(count)
    for k in range(4):
        _, ix, n = np.unique(marks[:, k], return_inverse=True, return_counts=True)
        times = np.maximum(times, n[ix])
    return fit(flat, offs, toxic, 1 / times, penalty)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, toxic)`` for each row of ``docs``, repeated ones and null ids too.

    The score of a null text is null and it isn't toxic. A text without known features, an empty
    one too, scores the bias alone. Very long texts are scored whole. Equal texts score alike. An
    empty table gives an empty result; other columns, of whatever names, are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for t in textvec.chunks(batch.column(1)):
                text = batch.column(1).slice(t.lo, t.rows)
                p = shared.value.score(t)
                void = text.is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(t.lo, t.rows), pa.array(p, mask=void), pa.array((p >= THRESHOLD) & ~void)],
                    names=["doc_id", "score", "toxic"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, toxic boolean")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns of any name, whose text isn't found toxic.

    Null and empty texts and rows of a null doc_id with a clean text stay; rows that repeat go or
    stay together. Very long texts are scored whole. An empty table stays empty; without labels
    all rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            p = [shared.value.score(t) for t in textvec.chunks(batch.column(place))]
            if p:
                yield batch.filter(pa.array(np.concatenate(p) < THRESHOLD) if len(p) else pa.array([], pa.bool_()))

    # empty rows score the bias alone, which stays under the threshold unless most labels are toxic
    full = docs.filter("text is not null and text <> ''")
    return full.mapInArrow(run, docs.schema).unionByName(docs.filter("text is null or text = ''"))
