"""Writing stage tables and results."""

from __future__ import annotations

import os
import shutil
import tempfile
import time

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from . import excel


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without nesting."""
    nested = (ArrayType, MapType, StructType)
    return df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema])


def save_results(df: DataFrame, path: str, fmt: str = "parquet", single: bool = False, mode: str = "overwrite") -> None:
    """Writes Parquet, ORC, JSON lines, CSV, or an Excel workbook; ``single`` makes one file of it."""
    if fmt == "excel":
        write_excel(df, path)
        return
    out = flat(df) if fmt == "csv" else df
    out = out.coalesce(1) if single else out
    writer = out.write.mode(mode)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_excel(df: DataFrame, path: str, sheet: str = "Results") -> int:
    """Writes one workbook by way of the driver, partition by partition, and gives its number of rows.

    A sheet holds 1,048,575 rows; further ones go on in sheets ``Results (continued 2)`` and so on, and
    ``read_excel`` reads them as one table. Nothing is at the path before all is written. Nested columns
    become JSON text, dates and decimals text.
    """
    fs, place = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))
    with tempfile.TemporaryFile() as sheet_file:
        n = excel.write(sheet_file, df.columns, flat(df).toLocalIterator(prefetchPartitions=True), sheet)
        sheet_file.seek(0)
        with fs.open_output_stream(place) as out:
            shutil.copyfileobj(sheet_file, out)
    return n


def checkpointed(df: DataFrame, path: str) -> DataFrame:
    """The table written to the path as Parquet and read back: a stage's result that later runs can start from."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options) -> None:
    flat(df).write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def save_idf(idf: DataFrame, path: str) -> None:
    """Writes an IDF table (fold, word, df, idf) for later runs."""
    idf.select("fold", "word", "df", "idf").write.mode("overwrite").parquet(path)


def load_idf(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``save_idf`` wrote; ``weights_long`` and ``weigh`` take it in place of a count."""
    return spark.read.schema("fold long, word string, df long, idf double").parquet(path)


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The table with a row count that is taken as it is written, without another pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


class Timer:
    """Seconds of named stages."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    def run(self, name: str, action):
        began = time.perf_counter()
        try:
            return action()
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    @property
    def total(self) -> float:
        return sum(self.seconds.values())
