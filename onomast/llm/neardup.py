"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 128-bit SimHashes are taken of each text: ``a`` over its words weighted by count ** 0.75,
``b`` over its distinct words. Two documents are near-duplicates when ``a`` differs in at most
``RADIUS`` bits and ``b`` in at most ``CHECK`` bits.

The index posts the sixteen bytes of ``a`` by position. ``RADIUS`` flipped bits touch at most
``RADIUS`` bytes, so any pair within it shares at least ``16 - RADIUS`` = 3 positional bytes: the
guaranteed minimum. Lists of single bytes would hold 1/256 of the corpus each, so postings are
made of two positions of the same half: of three shared positions two fall in one half of eight,
so the 2 * C(8, 2) = 56 lists of a document find every pair that reaches the minimum. Within a
list the shared positional bytes of each pair are tallied, pairs below the minimum go, and the
rest are verified by Hamming distance. Nothing is capped: a list of any size is searched whole,
but its near-duplicate pairs are passed on as a forest of the same components.

Cost: 56 postings of 44 bytes a distinct fingerprint in one shuffle; list work is a vectorised
XOR and count. Lists of w-byte postings grow as documents / 256**w.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import components, forest, fresh, staged

BYTES = 16
RADIUS = 13
CHECK = 24
MINIMUM = BYTES - RADIUS
_PAIRS = [(half * 8 + i, half * 8 + j) for half in range(2) for i, j in combinations(range(8), 2)]
_BITS = np.uint64(0x5851F42D4C957F2D)


def _simhash(t: textvec.Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the 16 bytes of a and of b; rows without tokens are all 0."""
    v, n, offs = textvec.distinct(t.hash, t.row)
    words = np.stack([textvec.mix(v + _BITS), textvec.mix(v * _BITS + np.uint64(1))], 1)
    weight = np.rint(16 * n.astype(np.float64) ** 0.75)
    a, b = np.zeros((t.rows, 128), bool), np.zeros((t.rows, 128), bool)
    for i in range(t.rows):
        lo, hi = offs[i], offs[i + 1]
        if lo == hi:
            continue
        both = np.zeros((2, 128))
        total = np.zeros(2)
        for at in range(lo, hi, 65536):  # whole text, in blocks that fit memory
            to = min(hi, at + 65536)
            w = np.stack([weight[at:to], np.ones(to - at)])
            kind = np.float32 if w[0].sum() < 2**24 else np.float64
            both += w.astype(kind) @ np.unpackbits(words[at:to].view(np.uint8), axis=1).astype(kind)
            total += w.sum(1)
        a[i], b[i] = both > total[:, None] / 2
    return np.packbits(a, axis=1), np.packbits(b, axis=1)


def _fingerprint(batches):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for t in textvec.chunks(texts):
            a, b = (x.view(np.int64) for x in _simhash(t))
            empty = np.diff(t.row) == 0
            cols = [pa.array(x[:, k], mask=empty) for x in (a, b) for k in range(2)]
            yield pa.RecordBatch.from_arrays([ids.slice(t.lo, t.rows), *cols], names=["doc_id", "a0", "a1", "b0", "b1"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, a0, a1, b0, b1); null fingerprints for texts without tokens."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprint, "doc_id long, a0 long, a1 long, b0 long, b1 long")


_LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)


def _zero_bytes(d: np.ndarray) -> np.ndarray:
    """Number of zero bytes of each 64-bit word."""
    t = d & _LOW7
    t += _LOW7
    t |= d
    t |= _LOW7
    return np.bitwise_count(np.invert(t, out=t))


def _near(fp: np.ndarray, i, j) -> np.ndarray:
    """Whether pairs of rows of fp (n x 4 uint64) share enough bytes and lie within both radii."""
    d0, d1 = fp[i, 0] ^ fp[j, 0], fp[i, 1] ^ fp[j, 1]
    ok = _zero_bytes(d0) + _zero_bytes(d1) >= MINIMUM
    at = np.nonzero(ok)  # few pairs reach the minimum; only they are verified
    hit = np.bitwise_count(d0[at]) + np.bitwise_count(d1[at]) <= RADIUS
    at = tuple(x[hit] for x in at)
    ok[...] = False
    if len(at[0]):
        i, j = (np.broadcast_to(x, ok.shape)[at] for x in (i, j))
        ok[at] = np.bitwise_count(fp[i, 2] ^ fp[j, 2]) + np.bitwise_count(fp[i, 3] ^ fp[j, 3]) <= CHECK
    return ok


def _search(ids: np.ndarray, fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges with the components of the near pairs of one list: breadth-first over rows not yet reached, then all pairs of a short rest."""
    out = []
    rest = np.arange(len(ids))
    while len(rest) > REST:
        wave, rest = rest[:1], rest[1:]
        while len(wave) and len(rest):
            step = max(1, 500_000 // len(rest))
            block, wave = wave[:step], wave[step:]
            hit = _near(fp, block[:, None], rest[None, :])
            found = hit.any(0)
            if found.any():
                out.append((ids[block[hit[:, found].argmax(0)]], ids[rest[found]]))
                wave = np.concatenate([wave, rest[found]])
                rest = rest[~found]
    i, j = np.triu_indices(len(rest), 1)
    ok = _near(fp, rest[i], rest[j])
    return [*out, (ids[rest[i[ok]]], ids[rest[j[ok]]])]


SMALL, REST = 256, 1024


def _edges(batches):
    """Edges of the lists of one sorted partition; a list never spans two partitions."""
    names = ["a", "b"]

    def work(key, ids, fp):
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(head, len(key)))
        out = []
        few = (size > 1) & (size <= SMALL)
        for n in np.unique(size[few]):
            i, j = np.triu_indices(n, 1)
            every = max(1, 500_000 // len(i))
            heads = head[few & (size == n)]
            for lo in range(0, len(heads), every):
                x = (heads[lo : lo + every, None] + i).ravel()
                y = (heads[lo : lo + every, None] + j).ravel()
                ok = _near(fp, x, y)
                out.append((ids[x[ok]], ids[y[ok]]))
        for h, n in zip(head[size > SMALL], size[size > SMALL]):
            out += _search(ids[h : h + n], fp[h : h + n])
        a = np.concatenate([o[0] for o in out]) if out else np.zeros(0, np.int64)
        b = np.concatenate([o[1] for o in out]) if out else np.zeros(0, np.int64)
        a, b = forest(a, b)
        a, b = a[a != b], b[a != b]
        for lo in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[lo : lo + 100_000]), pa.array(b[lo : lo + 100_000])], names=names)

    held: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        held.append((key, batch.column(1).to_numpy(), np.stack([batch.column(k).to_numpy() for k in range(2, 6)], 1).view(np.uint64)))
        if held[0][0][0] == key[-1]:  # one list so far: wait for its end
            continue
        cols = [np.concatenate(c) for c in zip(*held)]
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        yield from work(*(c[:cut] for c in cols))
        held = [tuple(c[cut:] for c in cols)]
    if held:
        yield from work(*(np.concatenate(c) for c in zip(*held)))


def _byte(position: int):
    word = F.col("a0") if position < 8 else F.col("a1")
    return F.shiftrightunsigned(word, 8 * (position % 8)).bitwiseAND(F.lit(255).cast("long"))


def near_edges(distinct: DataFrame) -> DataFrame:
    """(a, b): for ``distinct(doc_id, a0, a1, b0, b1)``, edges whose components are those of all near pairs."""
    keys = F.array(*(
        (F.lit(n << 16).cast("long") + _byte(i) * 256 + _byte(j)).cast("int") for n, (i, j) in enumerate(_PAIRS)
    ))
    posted = distinct.select(F.explode(keys).alias("key"), "doc_id", "a0", "a1", "b0", "b1")
    return posted.repartition("key").sortWithinPartitions("key").mapInArrow(_edges, "a long, b long")


def _groups(docs: DataFrame) -> DataFrame:
    """``(doc_id, group_id, rows)``, rows the number of rows of the id."""
    fps = staged(
        fingerprints(docs.filter("doc_id is not null")).groupBy("doc_id")
        .agg(F.min(F.struct("a0", "a1", "b0", "b1")).alias("f"), F.count("*").alias("rows")).select("doc_id", "rows", "f.*"),
        "fingerprints",
    )
    cols = ["a0", "a1", "b0", "b1"]
    node = fps.filter("a0 is not null").groupBy(*cols).agg(F.min("doc_id").alias("doc_id"))
    roots = components(near_edges(node.select("doc_id", *cols)))
    named = node.join(roots, node["doc_id"] == roots["node"], "left").select(*cols, F.coalesce("root", "doc_id").alias("group_id"))
    return fps.join(named, cols, "left").select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), "rows")


def groups(docs: DataFrame) -> DataFrame:
    """Near-duplicate groups: ``(doc_id, group_id)`` for each distinct document id, a whole number.

    ``group_id`` is the least doc_id of the group, which is the document that stays. Groups are
    the connected components of the near-duplicate relation. Documents of equal fingerprints,
    exact copies among them, form one node. Null or token-free texts are alone in their groups;
    rows of one doc_id are one document (its least fingerprint counts); a null doc_id is left
    out. Very long texts are hashed whole. An empty table gives an empty result; other columns,
    whatever their names, are ignored.
    """
    return _groups(docs).select("doc_id", "group_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group: the one of the least doc_id, all columns kept.

    Rows with a null doc_id stay. Where rows repeat a doc_id that stays, one of them stays: the
    one of the least text (null first), then of the least JSON of the other columns. Null, empty
    and token-free texts stay. An empty table stays empty; columns of any name are kept.

    The fates of documents are one narrow table, of the ids that go or repeat; the texts are
    joined with it once. Only if an id repeats are its rows read again and grouped.
    """
    mark = fresh(docs, "_mark")
    fate = staged(
        _groups(docs).filter("doc_id <> group_id or rows > 1").select(F.col("doc_id").alias(mark), (F.col("doc_id") != F.col("group_id")).alias("goes")),
        "fate",
    )
    named = docs.filter("doc_id is not null")  # nulls, however many, would meet in one task of the join
    out = named.join(fate.select(mark), named["doc_id"] == F.col(mark), "left_anti").unionByName(docs.filter("doc_id is null"))
    again = fate.filter("not goes").select(mark)
    if again.isEmpty():
        return out
    own = [F.col(f"`{c}`") for c in docs.columns]
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    order = F.struct(F.col("text").isNotNull(), "text", *([F.to_json(F.struct(*rest))] if rest else []))
    one = named.join(again, named["doc_id"] == F.col(mark), "left_semi").groupBy(F.col("doc_id").alias("_id")).agg(F.min_by(F.struct(*own), order).alias("_row"))
    return out.unionByName(one.select("_row.*"))
