"""Fold-wise term weights.

A fold's document frequencies are those of the corpus plus those of its own rows, so the corpus
is counted once, whatever the number of folds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LinkConfig
from ..functions import arrays


def term_frequency(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, keep.., word, pos, tf): share of each distinct word among the words of its row; pos is its first place."""
    exploded = df.select("row_id", *keep, F.size("words").alias("_n"), F.posexplode("words").alias("_pos", "word"))
    grouped = exploded.groupBy("row_id", *keep, "word").agg(F.min("_pos").alias("pos"), F.count("*").alias("_c"), F.first("_n").alias("_n"))
    return grouped.select("row_id", *keep, "word", "pos", (F.col("_c") / F.col("_n")).alias("tf"))


def document_frequency(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., word, df): rows that hold each word."""
    return df.select(*by, F.explode(F.array_distinct("words")).alias("word")).groupBy(*by, "word").agg(F.count("*").alias("df"))


def corpus_size(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., n): rows, those without words included."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def idf_table(rows: DataFrame, corpus: DataFrame | None = None, config: LinkConfig = LinkConfig()) -> DataFrame:
    """(fold, word, df, idf) for the words of the rows of each fold."""
    own = document_frequency(rows, ("fold",))
    size = corpus_size(rows, ("fold",))
    if corpus is not None:
        theirs = document_frequency(corpus).withColumnRenamed("df", "_df")
        own = own.join(theirs, "word", "left").withColumn("df", F.col("df") + F.coalesce("_df", F.lit(0))).drop("_df")
        size = size.crossJoin(F.broadcast(corpus.agg(F.count("*").alias("_n")))).select("fold", (F.col("n") + F.col("_n")).alias("n"))
    return own.join(size, "fold").select("fold", "word", "df", arrays.modified_idf(F.col("n"), F.col("df"), config.idf_power).alias("idf"))


def weights_long(rows: DataFrame, corpus: DataFrame | None = None, config: LinkConfig = LinkConfig(), idf: DataFrame | None = None) -> DataFrame:
    """(row_id, fold, word, pos, tf, df, idf, tfidf, normalized) of rows with row_id, fold and words.

    ``idf`` is a table (fold, word, df, idf) of an earlier run; words that it lacks have no weight.
    """
    idf = idf_table(rows, corpus, config) if idf is None else idf
    joined = term_frequency(rows, ("fold",)).join(idf, ["fold", "word"]).withColumn("tfidf", F.col("tf") * F.col("idf"))
    total = F.sum("tfidf").over(Window.partitionBy("row_id"))
    return joined.withColumn("normalized", arrays.share_of(F.col("tfidf"), total))


def weigh(rows: DataFrame, corpus: DataFrame | None = None, config: LinkConfig = LinkConfig(), idf: DataFrame | None = None) -> DataFrame:
    """Adds term_frequency, tfidf and normalized_tfidf, arrays of (word, value) in the order of first places.

    A row without words has empty arrays.
    """
    def entries(c):
        ordered = F.array_sort(F.collect_list(F.struct("pos", "word", F.col(c).alias("value"))))
        return F.transform(ordered, lambda e: F.struct(e["word"].alias("word"), e["value"].alias("value")))

    folded = rows if "fold" in rows.columns else rows.withColumn("fold", F.lit(0))
    grouped = weights_long(folded.select("row_id", "fold", "words"), corpus, config, idf).groupBy("row_id").agg(
        entries("tf").alias("term_frequency"), entries("tfidf").alias("tfidf"), entries("normalized").alias("normalized_tfidf")
    )
    out = folded.join(grouped, "row_id", "left")
    empty = F.array().cast("array<struct<word:string,value:double>>")
    for c in ("term_frequency", "tfidf", "normalized_tfidf"):
        out = out.withColumn(c, F.coalesce(c, empty))
    return out


def with_weights(df: DataFrame) -> DataFrame:
    """Rows that have any weight; a null list stays."""
    return df.filter("tfidf is null or size(tfidf) <> 0")


def scaled_weights(df: DataFrame, most: int = 10) -> DataFrame:
    """Adds tfidf_scaled: the first weights, scaled by the least and greatest of the whole table."""
    values = F.slice(arrays.entry_values(F.col("tfidf")), 1, most)
    bounds = df.agg(F.min(F.array_min(values)).alias("_low"), F.max(F.array_max(values)).alias("_high"))
    return df.crossJoin(F.broadcast(bounds)).withColumn(
        "tfidf_scaled", F.transform(values, lambda v: arrays.min_max(v, F.col("_low"), F.col("_high")))
    ).drop("_low", "_high")
