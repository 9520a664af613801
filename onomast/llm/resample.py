"""Importance resampling: a quality classifier by the ratio of two hashed n-gram models.

Word and punctuation tokens and their bigrams are hashed to buckets, whose number is a power of two
that grows as distinct n-grams do, with the root of the bytes of the corpus. The raw model
counts all documents; the target model counts documents labelled good, at most ``MAX_TARGET`` of
them (those of the least hashed doc_id). The log importance weight of a document is the sum over
its n-grams of the log ratio of the two smoothed models. Adding Gumbel noise, drawn from the
doc_id, the text and a seed, and keeping the k greatest sums samples k documents without replacement in
proportion to their weights. By default k is the share of good ones among the labels times the
number of documents.

One scan sums the bytes. Both models come from a second one, whose tasks return one row a bucket
that they saw; scoring is a third. Only (doc_id, weight) pairs are ranked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import staged

LEAST_BUCKETS = 10_000
MAX_TARGET = 50_000
SEED = 17
BRACKET = 1e-4


def buckets(docs: DataFrame) -> int:
    """How many buckets the n-grams of all texts are hashed to: the root of their bytes, at least ``LEAST_BUCKETS``, up to a power of two."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return 1 << (max(LEAST_BUCKETS, int(size**0.5)) - 1).bit_length()


def _buckets(t: textvec.Tokens, many: int):
    """Bucket numbers of words and of bigrams, each with offsets by row."""
    pairs, offs = textvec.shingles(t, 2)
    n = np.uint64(many)
    yield (t.hash % n).astype(np.int64), t.row
    yield (pairs % n).astype(np.int64), offs


def target_ids(labels: DataFrame, most: int = MAX_TARGET) -> np.ndarray:
    """Sorted ids of the documents of the target model."""
    good = (
        labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("q")).filter("q = 1")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").cast("long"))
    )
    return np.sort(good.toArrow()["doc_id"].to_numpy())


def log_ratio(docs: DataFrame, labels: DataFrame, most: int = MAX_TARGET, many: int | None = None) -> np.ndarray:
    """log(target / raw) of each of ``many`` buckets, each count plus one."""
    many = many or buckets(docs)
    shared = docs.sparkSession.sparkContext.broadcast(pa.array(target_ids(labels, most), pa.int64()))

    def count(batches):
        raw, target = np.zeros(many, np.int64), np.zeros(many, np.int64)
        for batch in batches:
            good = pc.is_in(batch.column(0), value_set=shared.value).to_numpy(zero_copy_only=False)
            for t in textvec.chunks(batch.column(1), punct=True):
                for b, offs in _buckets(t, many):
                    raw += np.bincount(b, minlength=many)
                    mine = np.repeat(good[t.lo : t.lo + t.rows], np.diff(offs))
                    target += np.bincount(b[mine], minlength=many)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["b", "raw", "target"])

    got = (
        docs.filter("text is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "b long, raw long, target long")
        .groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    )
    raw, target = np.ones(many), np.ones(many)
    raw[got["b"].to_numpy()] += got["raw"].to_numpy()
    target[got["b"].to_numpy()] += got["target"].to_numpy()
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weights(docs: DataFrame, ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """``(doc_id, log_weight, key)`` of every text; key is the weight plus Gumbel noise.

    The noise is a function of doc_id, text and seed, so a task that runs again draws the same.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        for batch in batches:
            for t in textvec.chunks(batch.column(1), punct=True):
                w = sum(textvec.row_sums(shared.value[b], offs) for b, offs in _buckets(t, len(shared.value)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(t.lo, t.rows) for k in (0, 2)), pa.array(w)], names=["doc_id", "h", "log_weight"])

    rows = docs.filter("text is not null").select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("h"))
    scored = rows.mapInArrow(run, "doc_id long, h long, log_weight double")
    u = (F.shiftrightunsigned(F.xxhash64("h", F.lit(seed)), 12) + 0.5) / F.lit(2.0**52)
    return scored.select("doc_id", "log_weight", (F.col("log_weight") - F.log(-F.log(u))).alias("key"))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The sample: ``(doc_id, log_weight, key)`` of the k documents of the greatest keys.

    Ties go to the smaller doc_id, null last. Null texts aren't drawn; empty texts have weight 0;
    very long texts count whole. Rows of a null doc_id are drawn by their texts. Rows that repeat
    doc_id and text have one key, so they are drawn together but at the cut, where as many as fit
    are. Of repeated labels of a document the better one counts. Without labels the target model is
    uniform and k is all. An empty table gives an empty result; other columns are ignored; doc_id
    is a whole number.
    """
    scored = staged(weights(docs, log_ratio(docs, labels)), "weights")
    n = scored.count()
    if k is None:
        share = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("q")).agg(F.avg("q")).first()[0]
        k = n if share is None else round(share * n)
    if k >= n:
        return scored
    if k <= 0:
        return scored.limit(0)
    at = 1 - k / n
    lo, hi = scored.approxQuantile("key", [max(0.0, at - 2 * BRACKET), min(1.0, at + 2 * BRACKET)], BRACKET)
    above = scored.filter(F.col("key") > hi)
    close = scored.filter(F.col("key").between(lo, hi))
    return above.union(close.orderBy(F.desc("key"), F.asc_nulls_last("doc_id")).limit(k - above.count()))
