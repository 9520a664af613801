"""Nearest neighbours of every vector by a permutation index.

Some vectors, those of the least hashed id, are pivots: ``ROOT`` times the square root of the number
of vectors. A vector is represented by its nearest pivots in order and is posted in the inverted
files of each of them: ``LISTS`` pivots at 50,000 vectors, growing with their eighth root. All vectors
are indexed; queries are those whose id is divisible by ``every``, all of them at 1: within each inverted
file that a query shares, candidates are ranked by the footrule distance of the two orders (a missing pivot counts as one place after the last), the best ``SHARE`` of them are
reranked by Euclidean distance, and the k nearest over all files are kept. Nothing else bounds the
candidates.

With weights w = lists - place, the footrule distance is a constant less twice the sum of
min(w, w') over the pivots of both, which is gathered for all pairs of a file at once from one byte a
pivot. The queries and the rows of an inverted file are each cut into blocks of about ``BLOCK`` and block
pairs are spread over tasks, so no file must fit one executor; files are about LISTS / ROOT times the square
root of the rows, so that is rare.

Work is N * N / every * lists ** 2 / pivots pairs, N ** 1.75, and each vector is shuffled ``lists`` times. Vectors
spread evenly over a sphere in many dimensions allow no much better: their neighbours are hardly
nearer than the rest, so orders of pivots say little (figures in the README). Clustered vectors do
with fewer lists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

ROOT = 4.5
LISTS = 20
SHARE = 0.9
BLOCK = 8192
NEIGHBOURS = 10
EVERY = 50  # of the query op8


def sizes(count: int) -> tuple[int, int]:
    """Numbers of pivots and of lists for so many vectors."""
    pivots = min(count, max(16, round(ROOT * count**0.5)))
    return pivots, min(pivots, 255, max(4, round(LISTS * (count / 50_000) ** 0.125)))


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) with an id and a full, finite vector of the most common length; one row an id."""
    # x - x is 0 for finite numbers alone
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>")).filter(
        "vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and x - x = 0)"
    )
    length = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1)
    return (
        rows.join(F.broadcast(length.select("n")), F.size("embedding") == F.col("n"), "left_semi")
        .groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    )


def wide(x: np.ndarray) -> np.ndarray:
    """The vectors in a type that their squares fit."""
    return x.astype(np.float64) if len(x) and np.abs(x).max() > 1e15 else x


def orders(x: np.ndarray, pivots: np.ndarray, lists: int) -> np.ndarray:
    """The nearest pivots of each row in order; equal distances go to the lower number."""
    if x.dtype != pivots.dtype:
        x, pivots = x.astype(np.float64), pivots.astype(np.float64)
    out = np.empty((len(x), lists), np.int32)
    square = (pivots**2).sum(1)[None, :]
    step = max(1, 4_000_000 // len(pivots))
    for lo in range(0, len(x), step):
        d = square - 2 * (x[lo : lo + step] @ pivots.T)
        near = np.argpartition(d, lists - 1, axis=1)[:, :lists]
        last = np.take_along_axis(d, near, 1).max(1)
        tied = (d <= last[:, None]).sum(1) > lists  # more pivots at the last distance than places
        near.sort(axis=1)
        got = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
        got[tied] = np.argsort(d[tied], axis=1, kind="stable")[:, :lists]
        out[lo : lo + step] = got
    return out


def footrule(mine: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For all pairs of orders the sum of min(w, w'): the footrule distance is lists * (lists + 1) less twice that."""
    lists = mine.shape[1]
    names, at = np.unique(mine, return_inverse=True)
    at = at.reshape(mine.shape)
    weight = np.zeros((len(names), len(other)), np.uint8)  # by pivot of ours and row of theirs
    k = np.minimum(np.searchsorted(names, other), len(names) - 1)
    hit = names[k] == other
    row, place = np.nonzero(hit)
    weight[k[hit], row] = lists - place
    total = np.zeros((len(mine), len(other)), np.uint16)
    for p in range(lists):
        total += np.minimum(weight[at[:, p]], np.uint8(lists - p))
    return total


def _nearest(ids, x, order, other_ids, other_x, other_order, k, share):
    """(query id, neighbour id, distance) of the local k nearest after ranking by footrule; ties go to the lesser id."""
    out = [(ids[:0], other_ids[:0], np.zeros(0))]
    if not len(ids) or not len(other_ids):
        return out[0]
    square, own = (other_x**2).sum(1), (x**2).sum(1)
    keep = max(min(len(other_ids), k + 1), int(np.ceil(share * len(other_ids))))
    slack = 1e-5 * (square.max() + own) if x.dtype == np.float32 else 1e-12 * (square.max() + own)
    rows = max(1, min(256, 2_000_000 // len(other_ids)))
    for lo in range(0, len(ids), rows):
        part = slice(lo, lo + rows)
        near = footrule(order[part], other_order)
        d = square[None, :] - 2 * (x[part] @ other_x.T)
        d[ids[part, None] == other_ids[None, :]] = np.inf
        if keep < len(other_ids):
            cut = np.partition(near, len(other_ids) - keep, axis=1)[:, len(other_ids) - keep]
            d[near < cut[:, None]] = np.inf  # ties with the last kept one are kept
        kk = min(k, d.shape[1])
        last = np.partition(d, kk - 1, axis=1)[:, kk - 1]
        # all that rounding may have put behind the k-th, and all ties with it
        q, c = np.nonzero((d <= (last + slack[part])[:, None]) & np.isfinite(d))
        gap = x[lo + q].astype(np.float64) - other_x[c].astype(np.float64)
        far = np.sqrt((gap * gap).sum(1))
        best = np.lexsort((other_ids[c], far, q))
        q, c, far = q[best], c[best], far[best]
        first = np.searchsorted(q, np.arange(len(ids[part])))
        some = np.arange(len(q)) - first[q] < k
        out.append((ids[lo + q[some]], other_ids[c[some]], far[some]))
    return [np.concatenate(c) for c in zip(*out)]


def neighbours(vectors: DataFrame, k: int = NEIGHBOURS, pivots: int | None = None, lists: int | None = None, share: float = SHARE, every: int = 1) -> DataFrame:
    """``(vec_id, rank, neighbour_id, distance)``: the k nearest others found of each vector whose id is divisible by ``every``.

    vec_id is a whole number. Neighbours are searched among all vectors, whatever their ids.
    Ties go to the lesser id. Rows without an id or with a null, empty or not finite vector, or
    one of a length other than the most common, take no part; rows that repeat an id count once,
    with the least vector. Equal vectors are neighbours at distance 0. An empty table gives an
    empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    base = staged(valid(vectors), "vectors")
    schema = "vec_id long, rank int, neighbour_id long, distance double"
    count = base.count()
    if count < 2:
        return spark.createDataFrame([], schema)
    found, per = sizes(count)
    found = min(count, pivots or found)
    per = min(found, 255, lists or per)
    # some more ids than wanted pass the hash, so that only those are ranked, without their vectors
    hashed = base.select("vec_id", F.shiftrightunsigned(F.xxhash64("vec_id"), 11).alias("h"))
    likely = hashed.filter(F.col("h") <= int(min(1.0, (2 * found + 50) / count) * 2**53))
    picked = likely.orderBy("h", "vec_id").limit(found).select("vec_id")
    first = base.join(picked, "vec_id", "left_semi").toArrow().sort_by("vec_id")
    shared = spark.sparkContext.broadcast(wide(np.array(first["embedding"].to_pylist(), np.float32)))
    found = first.num_rows
    per = min(per, found)
    blocks, query_blocks = (max(1, -(-count * per // (found * BLOCK * n))) for n in (1, every))

    def post(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).values.to_numpy().reshape(batch.num_rows, -1)
            order = orders(wide(x), shared.value, per)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(order), pa.list_(pa.int32()))],
                names=["vec_id", "embedding", "ord"],
            )

    h = F.xxhash64("vec_id", F.lit(3))
    posted = base.mapInArrow(post, "vec_id long, embedding array<float>, ord array<int>").select(
        "*", (F.col("vec_id") % every == 0).alias("query"), F.pmod(h, F.lit(query_blocks)).cast("int").alias("mine"), F.pmod(h, F.lit(blocks)).cast("int").alias("block")
    )
    # a row goes once to each pair of a block of queries and one of rows that it is in
    held = F.transform(F.sequence(F.lit(0), F.lit(query_blocks - 1)), lambda i: F.struct(i.alias("i"), F.col("block").alias("j")))
    asked = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda j: F.struct(F.col("mine").alias("i"), j.alias("j")))
    pairs = posted.select("*", F.explode(F.when(F.col("query"), F.array_union(held, asked)).otherwise(held)).alias("at")).select(
        "vec_id", "embedding", "ord", F.explode("ord").alias("file"), "at.i", "at.j",
        (F.col("query") & (F.col("mine") == F.col("at.i"))).alias("asks"), (F.col("block") == F.col("at.j")).alias("holds"),
    )

    def search(table: pa.Table) -> pa.Table:
        if isinstance(table["embedding"], pa.ChunkedArray):
            table = table.combine_chunks()
        ids = table["vec_id"].to_numpy()
        x = wide(table["embedding"].combine_chunks().values.to_numpy().reshape(len(ids), -1))
        order = table["ord"].combine_chunks().values.to_numpy().reshape(len(ids), -1)
        asks, holds = (table[c].to_numpy(zero_copy_only=False) for c in ("asks", "holds"))
        q, n, d = _nearest(ids[asks], x[asks], order[asks], ids[holds], x[holds], order[holds], k, share)
        return pa.table({"vec_id": q, "neighbour_id": n, "distance": d})

    local = pairs.groupBy("file", "i", "j").applyInArrow(search, "vec_id long, neighbour_id long, distance double")
    best = local.groupBy("vec_id").agg(F.slice(F.sort_array(F.collect_set(F.struct("distance", "neighbour_id"))), 1, k).alias("best"))
    return best.select("vec_id", F.posexplode("best").alias("rank", "b")).select(
        "vec_id", (F.col("rank") + 1).alias("rank"), F.col("b.neighbour_id").alias("neighbour_id"), F.col("b.distance").alias("distance")
    )
