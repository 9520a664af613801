"""The final report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LinkConfig
from ..functions import text

#: Columns of the report in order, by the columns they come from.
REPORT = {
    "name": "Inference Company Name", "source": "Source", "matched_name": "Reference Company Name", "score": "Match Score",
    "category": "Match Category", "alias": "Standardized Alias", "count": "Count",
}
#: Known columns in the order of a detailed table; a table has those of them that it has.
DETAIL = (
    "record_id", "company_id", "row_id", "name", "original_name", "is_separated", "source", "has_owner_role", "has_contractor_role", "role",
    "database_table", "is_demo", "report_column", "cleaned_name", "words", "term_frequency", "tfidf", "normalized_tfidf", "word_vecs", "pos", "pos_num",
    "tfidf_scaled", "label_list", "predicted_labels", "label_names", "cleaned_words", "labels", "matched_id", "matched_name", "score", "category",
    "alias", "history", "count",
)
#: Columns that a second matching pass starts from.
SECOND_PASS = (
    "record_id", "company_id", "row_id", "name", "original_name", "is_separated", "source", "has_owner_role", "has_contractor_role", "role",
    "database_table", "is_demo", "report_column", "words", "tfidf", "label_list", "cleaned_words", "labels", "count",
)


def present(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Those of the columns that the table has, in the given order."""
    return df.select(*[c for c in columns if c in df.columns])


def split_by_score(df: DataFrame, least: float = 50.0) -> tuple[DataFrame, DataFrame]:
    """Rows of at least the score, and the others; a null score is low."""
    high = F.coalesce(F.col("score") >= least, F.lit(False))
    return df.filter(high), df.filter(~high)


def history(active: DataFrame) -> DataFrame:
    """(matched_name, history): all rows of a name among the active names; null names are left out."""
    return active.filter("name is not null").groupBy(F.col("name").alias("matched_name")).agg(F.collect_list("name").alias("history"))


def with_history(matched: DataFrame, active: DataFrame) -> DataFrame:
    """Adds history, empty where the matched name isn't active."""
    return matched.join(history(active), "matched_name", "left").withColumn("history", F.coalesce("history", F.array().cast("array<string>")))


def counted_first(df: DataFrame) -> DataFrame:
    """One row a name key, the first by branch and row_id, with the number of rows of the key; null keys go."""
    keyed = df.withColumn("_key", text.name_key(F.col("name"))).filter("_key is not null")
    w = Window.partitionBy("_key")
    part = [F.col("part")] if "part" in df.columns else []
    return (
        keyed.withColumn("count", F.count("*").over(w)).withColumn("_n", F.row_number().over(w.orderBy("branch", "row_id", *part)))
        .filter("_n = 1").drop("_n", "_key")
    )


def consolidate(df: DataFrame, active: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """Matched rows with their history, then the others without a match, one row a name key with its count."""
    matched, low = split_by_score(df, config.report_threshold)
    low = low.withColumn("matched_name", F.lit("")).withColumn("history", F.array().cast("array<string>"))
    both = with_history(matched, active).withColumn("branch", F.lit(0)).unionByName(low.withColumn("branch", F.lit(1)))
    return counted_first(both)


def finalize(df: DataFrame) -> DataFrame:
    """The seven report columns, best scores first."""
    return df.orderBy(F.desc_nulls_last("score"), "row_id").select(*[F.col(c).alias(v) for c, v in REPORT.items()])


def report(df: DataFrame, active: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    return finalize(consolidate(df, active, config))
