"""Ingestion and splitting of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LinkConfig
from ..functions import text


def ranked(df: DataFrame, order: list, prefix: int, out: str, first) -> DataFrame:
    """Adds the rank of each row from 1 in the order of ``first`` (a string column) and then ``order``.

    The first characters of the string cut the rows into ranges; rows are numbered within each and
    the sizes of the earlier ranges are added, so no task sees all rows.
    """
    keyed = df.withColumn("_h", first).withColumn("_b", F.substring("_h", 1, prefix))
    sizes = keyed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_b").orderBy("_h", *order))
    return keyed.withColumn("_k", inner).join(before, "_b").withColumn(out, (F.col("_before") + F.col("_k")).cast("long")).drop("_h", "_b", "_k", "_before")


def seeded_rank(df: DataFrame, seed: int, out: str = "rank") -> DataFrame:
    """A shuffle that a seed determines: ranks by the md5 of seed and row_id."""
    return ranked(df, ["row_id"], 3, out, F.md5(F.concat(F.lit(f"{seed}:"), F.col("row_id").cast("string"))))


def folds(df: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """Adds ``fold``: the shuffled rows cut into folds of ``fold_size``."""
    return seeded_rank(df, config.seed, "_rank").withColumn("fold", F.floor((F.col("_rank") - 1) / config.fold_size)).drop("_rank")


def split_names(df: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """A row for each name within the compound names of reference rows; other rows stay as they are.

    Adds original_name, is_separated and part (0-based). A null or emptied reference name gives
    one row of a null name.
    """
    mine = F.col(config.source) == config.reference
    name = F.col(config.name)
    cut = df.withColumn("original_name", name).withColumn("_parts", F.when(mine, text.split_compound(name)).otherwise(F.array(name)))
    out = cut.withColumn("is_separated", F.size("_parts") > 1).select("*", F.posexplode_outer("_parts").alias("part", "_name"))
    return out.withColumn(config.name, F.col("_name")).withColumn("part", F.coalesce("part", F.lit(0))).drop("_parts", "_name")


def part_ids(df: DataFrame) -> DataFrame:
    """Split rows with row_ids of their own, in the order of input row and part; the input's is in input_id.

    They are row_id times the greatest number of parts, plus the part. Where that doesn't fit 64
    bits, rows are numbered in that order instead.
    """
    out = df.withColumn("input_id", F.col("row_id").cast("long"))
    most = df.agg(F.max("part").alias("part"), F.max(F.abs(F.col("row_id").cast("decimal(20,0)"))).alias("id")).first()
    parts = (most["part"] or 0) + 1
    if (int(most["id"] or 0) + 1) * parts < 2**63:
        return out.withColumn("row_id", F.col("input_id") * F.lit(parts).cast("long") + F.col("part"))
    # text that sorts as the numbers do: the sign bit flipped, in hexadecimal
    sortable = F.lpad(F.hex(F.col("input_id").bitwiseXOR(F.lit(-(2**63)).cast("long"))), 16, "0")
    return ranked(out.drop("row_id"), ["part"], 3, "row_id", sortable)


def clean_names(df: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """Adds cleaned_name (upper case) and words (tokens for weighting)."""
    return df.withColumn("cleaned_name", text.upper_or_empty(F.col(config.name))).withColumn("words", text.weighting_words(F.col(config.name)))


def active_owners(df: DataFrame, extra_source: str | None = None, most: int = 100, config: LinkConfig = LinkConfig()) -> DataFrame:
    """Reference rows with an owner role, and the first ``most`` rows of another source."""
    owners = df.filter((F.col("has_owner_role") == 1) & (F.col(config.source) == config.reference))
    if extra_source is None:
        return owners
    return owners.unionByName(df.filter(F.col(config.source) == extra_source).orderBy("row_id").limit(most))


def reference_first(df: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """Reference rows, then inference rows; others go."""
    return df.filter(F.col(config.source) == config.reference).unionByName(df.filter(F.col(config.source) == config.inference))


def with_corpus(names: DataFrame, corpus: DataFrame) -> DataFrame:
    """Both, with nulls for columns that one lacks."""
    return names.unionByName(corpus, allowMissingColumns=True)
