"""From raw documents to packed training sequences, stage by stage.

Each stage takes any rows of ``doc_id`` (a whole number), ``text``, ``lang``, ``source`` and ``n_chars``, and further
columns of any name, which all but the last keep. A null in ``lang``, ``source`` or ``n_chars`` changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from onomast.llm import decontam, linededup, neardup, packing, toxicity
from onomast.llm.common import read, staged, unstage


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, finds toxic go.

    Null and empty texts stay. A row of a null doc_id is scored as any other. Very long texts are
    scored whole. Rows that repeat, and other rows of equal texts, go or stay together. An empty
    table stays empty; without labels all stay.
    """
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document holds are deleted; documents of nothing else go.

    Rows of a null doc_id or text, and empty texts, stay as they are. Very long texts are aligned
    whole. Of equal texts that of the least doc_id stays; rows that repeat doc_id and text are one
    document, rows that repeat doc_id alone are in the order of their text hashes. An empty table
    stays empty.
    """
    return linededup.line_dedup(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least doc_id.

    Rows of a null doc_id and documents of null, empty or token-free texts stay. Very long texts
    are hashed whole. Of rows that repeat a doc_id that of the least text, then of the least other
    columns stays. An empty table stays empty.
    """
    return neardup.near_dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts stay. Rows of a null doc_id, and rows that repeat a doc_id, go each by its
    own text. Very long texts are searched whole. Items of a null id or text, or without a word,
    match nothing. An empty table stays empty; without items all stay.
    """
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece of each document, with the sequence that it is packed into and its place there.

    Null texts aren't packed; empty ones are one token, their end mark. A null doc_id is packed
    under null. Very long texts are cut into full pieces and a rest. Rows that repeat are packed as
    often; which of equal lengths comes first goes by doc_id and text hash. An empty table gives an
    empty result.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

ORACLE_SQL = None  # patience diff, SimHash and the classifier can't be put in SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents, each one's result written and read again.

    The table of a stage is deleted once the next one's is written. That of the last but one stays:
    the result is evaluated later.
    """
    docs = read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        if before is not None:
            unstage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
