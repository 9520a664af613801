"""Benchmark decontamination by SimHash of item-sized windows.

Texts are compared as word trigrams. A trigram weighs log((1 + N) / (1 + df)) with df the number of
documents that hold it among all N. For every item length a window of as many words runs over the
text. Windows whose benchmark trigrams alone are too light to reach ``SIMILARITY`` can't pass the
last step and aren't fingerprinted; the trigrams of no item in the others are counted over all
documents in a second pass. These windows get a 64-bit weighted SimHash, and four 16-bit blocks of it are looked
up in the index of the items of that length, which lists the items of each value that a block has:
a pair within ``RADIUS`` bits has a block within ``RADIUS // 4`` bits, and every value that close is
looked up, so no pair within the radius is missed. Flipping bits on the side of the windows keeps
the index at some 40 bytes an item. Candidates are verified by the weighted Jaccard similarity of their trigram sets. Items of
fewer than three words have one shingle, of all their words.

The benchmark is broadcast in slices of at most ``SLICE`` items; its size, not that of the corpus,
decides their number. Each slice scans the corpus three times: to count its trigrams, to find
windows, and to count the other trigrams of these. Only documents with such a window are shuffled,
as word hashes, and joined with the counts of their trigrams.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import fresh, staged

RADIUS = 19
SIMILARITY = 0.5
SLICE = 20_000
_BLOCK_RADIUS = RADIUS // 4
_FLIPS = np.array([sum(1 << b for b in c) for k in range(_BLOCK_RADIUS + 1) for c in combinations(range(16), k)], np.uint16)


def item_shingles(words: np.ndarray, n: int = 3) -> np.ndarray:
    """Trigram hashes of one text in order; of fewer words, one hash of all."""
    n = min(n, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    h = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        h = textvec.mix(h * np.uint64(3) + words[k : k + len(h)])
    return h


def simhash(hashes: np.ndarray, weights: np.ndarray) -> int:
    """64-bit SimHash of distinct weighted shingles."""
    bits = np.unpackbits(textvec.mix(hashes + np.uint64(12345)).view(np.uint8)).reshape(-1, 64)
    return int(np.packbits(weights @ bits > weights.sum() / 2).view(np.uint64)[0])


@dataclass
class Benchmark:
    """The items of one slice, by length, with their index."""

    ids: list[int]
    words: list[int]
    shingles: list[np.ndarray]  # distinct, ascending
    vocab: np.ndarray  # all shingles, ascending
    weight: np.ndarray  # of vocab
    default: float
    lengths: dict[int, np.ndarray] = field(default_factory=dict)
    index: dict[int, tuple] = field(default_factory=dict)

    def __post_init__(self):
        self.total = [float(self.weigh(s).sum()) for s in self.shingles]
        for n in sorted(set(self.words)):
            self.lengths[n] = np.flatnonzero(np.array(self.words) == n)
        # the lengths of the items that hold each shingle of vocab, as pairs sorted by shingle
        at = np.concatenate([np.searchsorted(self.vocab, s) for s in self.shingles])
        pairs = np.unique(at * (max(self.words) + 1) + np.repeat(self.words, [len(s) for s in self.shingles]))
        self.of, self.size = np.divmod(pairs, max(self.words) + 1)
        self.first = np.searchsorted(self.of, np.arange(len(self.vocab) + 1))
        self.least = {n: SIMILARITY * min(self.total[i] for i in ix) for n, ix in self.lengths.items()}

    def weigh(self, h: np.ndarray) -> np.ndarray:
        k = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        return np.where(self.vocab[k] == h, self.weight[k], self.default)

    def blocks(self, n: int) -> tuple:
        """Fingerprints of the items of n words; for each block its distinct values, and where each one's items begin in a list."""
        if n not in self.index:
            ix = self.lengths[n]
            fp = np.array([simhash(self.shingles[i], self.weigh(self.shingles[i])) for i in ix], np.uint64)
            parts = []
            for b in range(4):
                part = (fp >> np.uint64(16 * b)).astype(np.uint16)
                order = np.argsort(part, kind="stable").astype(np.int32)
                values, first = np.unique(part[order], return_index=True)
                parts.append((values, np.append(first, len(ix)), order))
            self.index[n] = fp, parts
        return self.index[n]

    def candidates(self, fp: int, n: int) -> list[tuple[int, int]]:
        """(item, distance) of all items of n words within the radius."""
        of, parts = self.blocks(n)
        found = []
        for b, (values, first, order) in enumerate(parts):
            mine = np.uint16(fp >> (16 * b) & 0xFFFF)
            if len(values) < len(_FLIPS):  # fewer values than flips: each is compared
                at = np.flatnonzero(np.bitwise_count(values ^ mine) <= _BLOCK_RADIUS)
            else:
                near = _FLIPS ^ mine
                at = np.minimum(np.searchsorted(values, near), len(values) - 1)
                at = at[values[at] == near]
            found += [order[first[k] : first[k + 1]] for k in at]
        if not found:
            return []
        some = np.unique(np.concatenate(found))
        far = np.bitwise_count(of[some] ^ np.uint64(fp))
        return [(int(self.lengths[n][k]), int(d)) for k, d in zip(some, far) if d <= RADIUS]

    def similarity(self, i: int, window: np.ndarray, weights: np.ndarray) -> float:
        """Weighted Jaccard similarity of an item and the distinct shingles of a window."""
        both = float(self.weigh(np.intersect1d(self.shingles[i], window, assume_unique=True)).sum())
        return both / (self.total[i] + float(weights.sum()) - both)

    def windows(self, words: np.ndarray):
        """(item length, first word, distinct shingles) of the windows that can reach the similarity."""
        for k in sorted({min(3, n, len(words)) for n in self.lengths}) if len(words) else ():
            sh = item_shingles(words, k)
            at = np.minimum(np.searchsorted(self.vocab, sh), len(self.vocab) - 1)
            place = np.flatnonzero(self.vocab[at] == sh)
            at = at[place]
            many = self.first[at + 1] - self.first[at]
            of_pair = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            sizes, places = self.size[of_pair], np.repeat(place, many)
            for n in np.unique(sizes):
                n = int(n)
                if min(3, n, len(words)) != k:
                    continue
                hit = np.zeros(len(sh))
                mine = places[sizes == n]
                hit[mine] = self.weigh(sh[mine])
                total = np.concatenate([[0.0], np.cumsum(hit)])
                span = min(n, len(words)) - k + 1
                heavy = total[span:] - total[:-span]
                for lo in np.flatnonzero(heavy >= self.least[n] - 1e-6):
                    yield n, int(lo), np.unique(sh[lo : lo + span])

    def others(self, words: np.ndarray) -> np.ndarray | None:
        """Distinct shingles of no item in the windows of a text; None if there is no window."""
        found = [window for _, _, window in self.windows(words)]
        return np.setdiff1d(np.unique(np.concatenate(found)), self.vocab, assume_unique=True) if found else None

    def search(self, words: np.ndarray, others: np.ndarray, weight: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(item, first word, distance, similarity) of the most similar window of each item found.

        ``weight`` are the weights of ``others``, the ascending shingles of no item.
        """
        best: dict[int, tuple] = {}
        for n, lo, window in self.windows(words):
            w = self.weigh(window)
            if len(others):
                k = np.minimum(np.searchsorted(others, window), len(others) - 1)
                w = np.where(others[k] == window, weight[k], w)
            for i, d in self.candidates(simhash(window, w), n):
                s = self.similarity(i, window, w)
                if s >= SIMILARITY and (i not in best or (-s, d, lo) < best[i][:3]):
                    best[i] = (-s, d, lo)
        return [(self.ids[i], lo, d, -s) for i, (s, d, lo) in sorted(best.items())]


def _load(bench: DataFrame) -> tuple[list[int], list[int], list[np.ndarray]]:
    rows = bench.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct().toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
    ids, words, shingles = [], [], []
    for t in textvec.chunks(rows["text"]) if rows.num_rows else ():
        for k, (a, b) in enumerate(zip(t.row[:-1], t.row[1:])):
            if b > a:
                ids.append(rows["item_id"][t.lo + k].as_py())
                words.append(int(b - a))
                shingles.append(np.unique(item_shingles(t.hash[a:b])))
    return ids, words, shingles


def _all_shingles(t: textvec.Tokens, sizes: tuple[int, ...]):
    for n in sizes:
        yield n, *textvec.shingles(t, n)


def _document_counts(docs: DataFrame, vocab: np.ndarray, sizes: tuple[int, ...]) -> tuple[int, np.ndarray]:
    """Number of texts, and of those that hold each shingle of vocab, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        vocab, n = shared.value, 0
        seen = np.zeros(len(vocab), np.int64)
        maybe = _sieve(vocab)
        for batch in batches:
            n += batch.num_rows
            for t in textvec.chunks(batch.column(0)):
                for _, h, offs in _all_shingles(t, sizes):
                    ok = np.flatnonzero(maybe[h >> np.uint64(42)])
                    k = np.minimum(np.searchsorted(vocab, h[ok]), len(vocab) - 1)
                    yes = vocab[k] == h[ok]
                    row = np.searchsorted(offs, ok[yes], "right")
                    pair = np.unique(row.astype(np.int64) * len(vocab) + k[yes])
                    seen += np.bincount(pair % len(vocab), minlength=len(vocab))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], n))], names=["k", "n"])

    got = docs.filter("text is not null").select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    k, n = got["k"].to_numpy(), got["n"].to_numpy()
    out = np.zeros(len(vocab), np.int64)
    out[k[k >= 0]] = n[k >= 0]
    return int(n[k < 0].sum()), out


def _other_counts(docs: DataFrame, others: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """``(h, n)``: the number of texts that hold each of the shingles ``others(h)``, over all documents."""
    top = others.select(F.shiftrightunsigned("h", 42).alias("t")).distinct().toArrow()["t"].to_numpy()
    maybe = np.zeros(1 << 22, bool)
    maybe[top] = True
    shared = docs.sparkSession.sparkContext.broadcast(maybe)

    def run(batches):
        maybe = shared.value
        for batch in batches:
            for t in textvec.chunks(batch.column(0)):
                for _, h, offs in _all_shingles(t, sizes):
                    ok = np.flatnonzero(maybe[h >> np.uint64(42)])
                    row = np.searchsorted(offs, ok, "right")
                    order = np.lexsort((h[ok], row))
                    g, row = h[ok][order], row[order]
                    new = np.ones(len(g), bool)
                    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
                    one, n = np.unique(g[new], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    seen = docs.filter("text is not null").select("text").mapInArrow(run, "h long, n long")
    return seen.groupBy("h").agg(F.sum("n").alias("n")).join(others, "h", "left_semi")


def _sieve(vocab: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 22, bool)
    out[vocab >> np.uint64(42)] = True
    return out


def matches(docs: DataFrame, bench: DataFrame, slice_items: int = SLICE) -> DataFrame:
    """``(doc_id, item_id, first_word, distance, similarity)``: each item that a document holds; ids are whole numbers.

    The window is the most similar one, ties going to the nearer fingerprint and the earlier
    place. A text shorter than an item is one window. Null and token-free texts and items, and
    items of a null id, match nothing; documents of a null doc_id are reported under null. Rows
    that repeat a doc_id are searched each; equal findings are given once. Very long texts are
    searched whole. Empty tables give an empty result; other columns are ignored.
    """
    return _found(docs, bench, slice_items).drop("text_hash").distinct()


def _found(docs: DataFrame, bench: DataFrame, slice_items: int = SLICE) -> DataFrame:
    """The matches of each row, with the hash of its text."""
    spark = docs.sparkSession
    schema = "doc_id long, text_hash long, item_id long, first_word long, distance long, similarity double"
    ids, words, shingles = _load(bench)
    out = spark.createDataFrame([], schema)
    for lo in range(0, len(ids), slice_items):
        part = slice(lo, lo + slice_items)
        vocab = np.unique(np.concatenate(shingles[part]))
        sizes = tuple(sorted({min(3, n) for n in words[part]}))
        count, df = _document_counts(docs, vocab, sizes)
        weight = np.log((1 + count) / (1 + df)) + 1e-3
        shared = spark.sparkContext.broadcast(
            Benchmark(ids[part], words[part], shingles[part], vocab, weight, float(np.log(1 + count) + 1e-3))
        )

        def hopeful_rows(batches, shared=shared, sizes=sizes):
            b = shared.value
            maybe, least = _sieve(b.vocab), min(b.least.values())
            longest = max(b.words)
            for batch in batches:
                cols: list[list] = [[], [], [], []]
                for t in textvec.chunks(batch.column(2)):
                    hopeful = np.zeros(t.rows, bool)
                    for k in sizes:
                        h, offs = textvec.shingles(t, k)
                        at = np.flatnonzero(maybe[h >> np.uint64(42)])
                        p = np.minimum(np.searchsorted(b.vocab, h[at]), len(b.vocab) - 1)
                        yes = b.vocab[p] == h[at]
                        at, w = at[yes], b.weight[p[yes]]
                        if not len(at):
                            continue
                        row = np.searchsorted(offs, at, "right") - 1
                        place = at + row * (2 * longest)  # so that no window spans two rows
                        total = np.concatenate([[0.0], np.cumsum(w)])
                        end = np.searchsorted(place, place + longest)
                        hopeful[row[total[end] - total[:-1] >= least - 1e-6]] = True
                    for r in np.flatnonzero(hopeful):
                        text = t.hash[t.row[r] : t.row[r + 1]]
                        others = b.others(text)
                        if others is not None:
                            own = (batch.column(k)[t.lo + int(r)].as_py() for k in range(2))
                            for c, x in zip(cols, (*own, text.view(np.int64), others.view(np.int64))):
                                c.append(x)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in cols[:2]), *(pa.array(c, pa.list_(pa.int64())) for c in cols[2:])],
                    names=["doc_id", "text_hash", "words", "others"],
                )

        def run(batches, shared=shared, count=count):
            b = shared.value
            for batch in batches:
                cols: list[list] = [[], [], [], [], [], []]
                for doc, row, text, known in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), batch.column(3).to_pylist()):
                    h = np.array([x["h"] for x in known or ()], np.int64).view(np.uint64)
                    n = np.array([x["n"] for x in known or ()], np.int64)
                    order = np.argsort(h)
                    weight = np.log((1 + count) / (1 + n[order])) + 1e-3
                    for found in b.search(text.values.to_numpy().view(np.uint64), h[order], weight):
                        for c, x in zip(cols, (doc, row, *found)):
                            c.append(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 5 + [pa.float64()])],
                    names=["doc_id", "text_hash", "item_id", "first_word", "distance", "similarity"],
                )

        rows = staged(
            docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
            .mapInArrow(hopeful_rows, "doc_id long, text_hash long, words array<long>, others array<long>")
            .withColumn("row", F.monotonically_increasing_id()),
            "windows",
        )
        asked = rows.select("row", F.explode("others").alias("h"))
        counts = _other_counts(docs, asked.select("h").distinct(), sizes)
        known = asked.join(counts, "h").groupBy("row").agg(F.collect_list(F.struct("h", "n")).alias("known"))
        out = out.union(rows.join(known, "row", "left").select("doc_id", "text_hash", "words", "known").mapInArrow(run, schema))
    return out


def decontaminate(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns of any name, whose text holds no benchmark item.

    Each row goes by its own finding: a row of a null doc_id that holds an item goes, a clean one
    stays even if its doc_id repeats that of another that goes. Rows that repeat both go or stay
    together. Null and empty texts stay; an empty table stays empty, and without items all stay.
    """
    mark, key = fresh(docs, "_bad"), fresh(docs, "_key")
    row = lambda text_hash: F.xxhash64(F.col("doc_id").cast("long"), text_hash)
    bad = staged(_found(docs, bench).select(F.col("doc_id").alias(mark), row(F.col("text_hash")).alias(key)).distinct(), "leaks")
    same = (row(F.xxhash64(docs["text"])) == F.col(key)) & docs["doc_id"].cast("long").eqNullSafe(F.col(mark))
    return docs.join(bad, same, "left_anti")
