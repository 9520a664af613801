"""Token labels: 0 important, 1 subsidiary, 2 generic; 3 marks no token.

A labeler is a function from rows with ``words`` (raw case) to the same rows with ``label_list``.
"""

from __future__ import annotations

import math
from typing import Protocol

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cut import cut, scratch, spread, tasks
from ..functions import arrays, text


class Labeler(Protocol):
    def __call__(self, df: DataFrame) -> DataFrame: ...


def decode_labels(words: Column, label_list: Column) -> Column:
    """(word, label) for each distinct word, in order.

    Labels 3 are removed first, wherever they are. A word that the labels reach takes its last
    label. If words are left over, each of them, a repeated one too, is important.
    """
    labels = arrays.drop_none_labels(label_list)

    def label(w):
        first = F.array_position(words, w).cast("int")
        last = F.size(words) - F.array_position(F.reverse(words), w).cast("int") + 1
        again = F.size(F.filter(words, lambda x: x == w)) > 1
        short = F.when(again | (first > F.size(labels)), F.lit(0)).otherwise(F.get(labels, first - 1))
        return F.when(F.size(words) > F.size(labels), short).otherwise(F.get(labels, last - 1)).cast("int")

    return F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("word"), label(w).alias("label")))


def label_rows(df: DataFrame, labeler: Labeler) -> DataFrame:
    """Adds label_list, predicted_labels, label_names, cleaned_words and labels to rows with raw words."""
    out = labeler(df)
    kept = arrays.drop_none_labels(F.col("label_list"))
    return (
        out.withColumn("predicted_labels", text.join_labels(kept))
        .withColumn("label_names", F.transform(kept, arrays.label_name))
        .withColumn("cleaned_words", text.matching_words(F.col("words")))
        .withColumn("labels", decode_labels(F.col("cleaned_words"), F.col("label_list")))
    )


def position_labeler(important: int = 2, subsidiary: int = 1) -> Labeler:
    """The first words are important, the next subsidiary, the rest generic."""
    def run(df):
        i = F.transform(F.col("words"), lambda w, i: F.when(i < important, 0).when(i < important + subsidiary, 1).otherwise(2))
        return df.withColumn("label_list", F.slice(i, 1, 10))

    return run


GENERIC = frozenset("INC LLC LTD LLP LP PLC CO CORP CORPORATION COMPANY GMBH AG SA SAS SRL BV NV PTY & AND THE OF GROUP HOLDINGS SERVICES SOLUTIONS INTERNATIONAL ENTERPRISES".split())
SUBSIDIARY = frozenset("NORTH SOUTH EAST WEST CENTRAL NORTHERN SOUTHERN EASTERN WESTERN AMERICA AMERICAS USA US UK EUROPE ASIA APAC EMEA CANADA TEXAS CALIFORNIA DIVISION BRANCH REGION".split())


def rule_labeler(generic: frozenset[str] = GENERIC, subsidiary: frozenset[str] = SUBSIDIARY) -> Labeler:
    """Labels by word lists; a first word is important whatever it is."""
    def run(df):
        def label(w, i):
            c = text.plain_word(F.upper(w))
            return F.when(i == 0, 0).when(c.isin(*sorted(generic)), 2).when(c.isin(*sorted(subsidiary)), 1).otherwise(0)

        return df.withColumn("label_list", F.slice(F.transform(F.col("words"), label), 1, 10))

    return run


_CONTEXT = ("word", "prev", "next", "suffix")


def token_features(df: DataFrame, most: int = 10) -> DataFrame:
    """A row for each of the first tokens: its word, ending, neighbours, place, part of speech and weight."""
    words = F.slice(text.matching_words(F.col("words")), 1, most)
    have = set(df.columns)
    pos = F.col("pos_num") if "pos_num" in have else F.array().cast("array<int>")
    scaled = F.col("tfidf_scaled") if "tfidf_scaled" in have else F.array().cast("array<double>")
    label = [F.col("label_list")] if "label_list" in have else []
    exploded = df.select("row_id", words.alias("_w"), pos.alias("_p"), scaled.alias("_s"), *[x.alias("_l") for x in label]).select("*", F.posexplode("_w").alias("place", "word"))

    def near(k):
        return F.coalesce(F.get("_w", F.col("place") + k), F.lit("#"))

    out = exploded.select(
        "row_id", "place", "word", near(-1).alias("prev"), near(1).alias("next"), F.substring("word", -3, 3).alias("suffix"),
        F.length("word").cast("double").alias("length"), (F.col("place") + 1).cast("double").alias("position"), F.size("_w").cast("double").alias("count"),
        F.coalesce(F.get("_p", F.col("place")) + 1, F.lit(0)).cast("double").alias("pos"), F.coalesce(F.get("_s", F.col("place")), F.lit(0.0)).alias("weight"),
        *[F.get("_l", F.col("place")).cast("double").alias("label") for _ in label],
    )
    return out


def train_labeler(df: DataFrame, features: int = 4096, reg: float = 1e-4, hidden: tuple[int, ...] = ()) -> PipelineModel:
    """Fits token labels 0..3 on rows with words and label_list, with neighbour context.

    The model is multinomial regression, or with ``hidden`` a feed-forward network of hidden layers
    of those sizes (choose fewer ``features`` then: the first layer has as many inputs).
    """
    head = LogisticRegression(maxIter=40, regParam=reg, family="multinomial")
    if hidden:
        head = MultilayerPerceptronClassifier(layers=[features + 5, *hidden, 4], maxIter=60, seed=42)
    stages = [
        FeatureHasher(inputCols=list(_CONTEXT), outputCol="hashed", numFeatures=features),
        VectorAssembler(inputCols=["hashed", "length", "position", "count", "pos", "weight"], outputCol="features"),
        head,
    ]
    with scratch(df.sparkSession):
        return Pipeline(stages=stages).fit(_training_tokens(df, 8 * (features + 8) if hidden else SPARSE_BYTES))


#: Bytes of vectors that a task holds while a model is fitted, and of a token's vector of few values; a network's has all.
TASK_BYTES, SPARSE_BYTES = 64 << 20, 256


def _training_tokens(df: DataFrame, width: int) -> DataFrame:
    """Tokens with a label, so many a partition that vectors of ``width`` bytes stay within a task's bytes, however few tasks
    the names come from."""
    tokens = cut(token_features(spread(df)).filter("label is not null"))
    return tokens.repartition(max(tasks(df.sparkSession), math.ceil(tokens.count() * width / TASK_BYTES)))


def save_labeler(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_labeler(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_labeler(model: PipelineModel) -> Labeler:
    """Labels by a fitted model; rows without words get an empty list."""
    def run(df):
        scored = model.transform(token_features(df.drop("label_list"))).groupBy("row_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("prediction").cast("int").alias("label")))), lambda x: x["label"]).alias("label_list")
        )
        return df.drop("label_list").join(scored, "row_id", "left").withColumn("label_list", F.coalesce("label_list", F.array().cast("array<int>")))

    return run
