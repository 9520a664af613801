"""Schemas at stage boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame

ENTRIES = "array<struct<word:string,value:double>>"
LABELLED = "array<struct<word:string,label:int>>"
STAGES = {
    "names": {"row_id": "bigint", "name": "string", "source": "string"},
    "tokens": {"row_id": "bigint", "words": "array<string>"},
    "labelled": {"row_id": "bigint", "name": "string", "source": "string", "labels": LABELLED},
    "matched": {"row_id": "bigint", "name": "string", "source": "string", "matched_name": "string", "score": "double", "category": "string", "alias": "string"},
}


def require(df: DataFrame, stage: str) -> DataFrame:
    """``df``, if it has the columns of the stage in their types."""
    have = dict(df.dtypes)
    wrong = {c: (have.get(c), t) for c, t in STAGES[stage].items() if have.get(c) != t}
    if wrong:
        raise TypeError(f"{stage}: columns (found, expected): {wrong}")
    return df
