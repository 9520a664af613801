"""Shared folder, staged tables and connected components for the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is used on a local master; on any other
    master that would lose data with the machine, so it is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    here = getattr(spark, "_onomast_dir", None)
    if here is None:
        here = spark._onomast_dir = "file://" + tempfile.mkdtemp(prefix="onomast-")
    return here


ARROW_BYTES = 8 << 20


def bounded(spark: SparkSession) -> None:
    """Bounds the bytes of the Arrow batches that go to Python workers.

    Spark bounds their rows alone well: 10,000 long texts may fill an executor. A smaller bound
    that the session has stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = spark.conf.get(key, None)
    if found is None or not found.isdigit() or not 0 < int(found) <= ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, into: list[DataFrame] | None = None) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: lineage ends at replicated files.

    The table is added to ``into``, the tables that the caller will ``unstage``.
    """
    spark = df.sparkSession
    bounded(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._onomast_path = path
    if into is not None:
        into.append(out)
    return out


def unstage(df: DataFrame) -> None:
    """Deletes the files of a ``staged`` table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._onomast_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the table doesn't have."""
    have = {c.lower() for c in df.columns}
    while stem in have:
        stem += "_"
    return stem


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contracts edges (a, b): every node that occurs with the least node of its component."""
    nodes, ix = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = np.arange(len(nodes))
    x, y = ix[: len(a)], ix[len(a) :]
    while True:
        lo = np.minimum(up[x], up[y])
        new = up.copy()
        np.minimum.at(new, up[x], lo)
        np.minimum.at(new, up[y], lo)
        while not np.array_equal(hop := new[new], new):
            new = hop
        if np.array_equal(new, up):
            return nodes, nodes[up]
        up = new


def _contract(batches):
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        count += batch.num_rows
        if count > 2_000_000:
            held = [forest(*(np.concatenate(x) for x in zip(*held)))]
            count = len(held[0][0])
    if held:
        n, r = forest(*(np.concatenate(x) for x in zip(*held)))
        keep = n != r
        for lo in range(0, int(keep.sum()), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(n[keep][lo : lo + 100_000]), pa.array(r[keep][lo : lo + 100_000])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, root)``, root the least node.

    Each partition first contracts its own edges; rounds of large-star and small-star then run
    until no edge changes. Every round is a written table, so a lost executor costs one round.
    """
    contracted = edges.filter("a <> b").mapInArrow(_contract, "a long, b long")
    cur = staged(contracted.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = cur.union(cur.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(low, "a").select(F.col("b").alias("v"), F.least("m", "a").alias("m")).filter("v > m")
            .groupBy("v").agg(F.collect_set("m").alias("ms"))
        )
        # small-star within the same grouping: v's neighbours below it all point to the least of them
        small = large.select("v", F.array_min("ms").alias("r"), F.explode("ms").alias("u"))
        nxt = staged(
            small.select(F.col("v").alias("a"), F.col("r").alias("b"))
            .union(small.filter("u <> r").select(F.col("u").alias("a"), F.col("r").alias("b"))).distinct(),
            "edges",
        )
        done = nxt.count() == cur.count() and nxt.join(cur, ["a", "b"], "left_anti").isEmpty()
        unstage(cur)
        cur = nxt
        if done:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
