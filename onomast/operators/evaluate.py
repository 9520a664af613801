"""Measures of labels, matches and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_accuracy(df: DataFrame, truth: str = "label", predicted: str = "prediction", padding: int = 3) -> DataFrame:
    """One row, accuracy: share of equal labels where the true one isn't padding; 0 for none."""
    return df.filter(F.col(truth) != padding).agg(F.coalesce(F.avg((F.col(truth) == F.col(predicted)).cast("double")), F.lit(0.0)).alias("accuracy"))


def precision_recall(found: DataFrame, truth: DataFrame, on: list[str]) -> DataFrame:
    """One row: precision, recall and f1 of found pairs against true pairs."""
    both = found.select(*on).distinct().withColumn("f", F.lit(1)).join(truth.select(*on).distinct().withColumn("t", F.lit(1)), on, "full")
    sums = both.agg(F.count("f").alias("found"), F.count("t").alias("true"), F.count(F.expr("f + t")).alias("hit"))
    p, r = F.try_divide(F.col("hit"), F.col("found")), F.try_divide(F.col("hit"), F.col("true"))
    return sums.select(p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def grouping_accuracy(df: DataFrame, truth: str, alias: str = "alias") -> DataFrame:
    """One row, accuracy: share of rows whose alias group is mostly of their true group."""
    sizes = df.groupBy(alias, truth).count().groupBy(alias).agg(F.max("count").alias("most"), F.sum("count").alias("n"))
    return sizes.agg(F.coalesce(F.try_divide(F.sum("most"), F.sum("n")), F.lit(0.0)).alias("accuracy"))


def source_counts(df: DataFrame, column: str = "source") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))
