"""Stage results written to the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []
_mine = threading.local()  # tables of the thread's open scratch blocks


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on a local master without it, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="onomast-"))
    return _local[0]


def cut(df: DataFrame) -> DataFrame:
    """The table written once and read back: it isn't computed again, survives lost executors, and plans on it stay small."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    if getattr(_mine, "paths", None) is not None:
        _mine.paths.append(path)
    # a column of no type holds only nulls, which files can't
    void = [c for c, kind in df.dtypes if kind == "void"]
    kept = df.drop(*void)
    kept.write.parquet(path)
    back = df.sparkSession.read.schema(kept.schema).parquet(path)
    return back.select(*[F.lit(None).alias(c) if c in void else F.col(f"`{c}`") for c in df.columns]) if void else back


def tasks(spark: SparkSession) -> int:
    """Tasks for work that is more than the bytes of its rows tell."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows shuffled over all cores, for a small file that holds many narrow rows is read by one task or few."""
    return df.repartition(tasks(df.sparkSession), *by)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes, at its end, the tables that ``cut`` wrote within: for work whose results are then collected or written."""
    before = getattr(_mine, "paths", None)
    _mine.paths = []
    try:
        yield
    finally:
        for path in _mine.paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _mine.paths = before
