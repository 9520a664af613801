"""Reading tables of names."""

from __future__ import annotations

import itertools
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import LinkConfig
from ..cut import cut

EXCEL_ROWS = 8192


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema: StructType | str | None = None, **options) -> DataFrame:
    """A table from Parquet, ORC, CSV, JSON lines, a JSON array (``json_records``), text or Excel, by format or ending."""
    kind = fmt or {"parquet": "parquet", "pq": "parquet", "orc": "orc", "csv": "csv", "tsv": "csv", "json": "json_records", "jsonl": "json", "ndjson": "json", "xlsx": "excel", "xls": "excel"}.get(
        path.rstrip("/").rsplit(".", 1)[-1].lower()
    )
    if kind is None:
        raise ValueError(f"give the format of {path}")
    if kind == "excel":
        return read_excel(spark, path, **options)
    if kind == "json_records":
        kind, options = "json", {"multiLine": True} | options
    if kind == "csv":
        options = {"header": True} | options
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(kind).load(path)


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """The sheet of each workbook below the path, by name or place; the first row of the first one names the columns.

    Workbooks are parsed by the executors, each sheet by one task; sheets that continue the asked one
    are read with it. A column is of whole numbers, numbers or truth values if all its cells are, else
    text; empty cells are null, as are columns that a workbook lacks. Rows without any value are left
    out. Names that are missing or repeat get their number.
    """
    from . import excel

    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def count(frames):
        for frame in frames:
            yield pd.DataFrame({"n": [excel.sheets(content, sheet) for content in frame["content"]]})

    def parse(part):
        def run(frames):
            for frame in frames:
                for name, content in zip(frame["path"], frame["content"]):
                    filled = ((name, part, n, [_shown(v) for v in values], [type(v).__name__ for v in values]) for n, values in excel.rows(content, sheet, part) if any(v is not None for v in values))
                    while found := list(itertools.islice(filled, EXCEL_ROWS)):
                        yield pd.DataFrame(found, columns=["path", "part", "n", "cells", "kinds"])

        return files.mapInPandas(run, "path string, part int, n long, cells array<string>, kinds array<string>")

    most = files.mapInPandas(count, "n int").agg(F.max("n")).first()[0] or 1
    cells = cut(reduce(DataFrame.union, [parse(k) for k in range(most)]))
    head = cells.orderBy("path", "part", "n").first()
    if head is None:
        return spark.createDataFrame([], "name string")
    first = cells.groupBy("path", "part").agg(F.min("n").alias("_n")).withColumnsRenamed({"path": "_path", "part": "_part"})
    body = cells.join(F.broadcast(first), (F.col("path") == F.col("_path")) & (F.col("part") == F.col("_part")) & (F.col("n") > F.col("_n")), "left_semi")
    width = body.agg(F.max(F.size("cells"))).first()[0] or 0
    names: list[str] = []
    for k in range(max(width, len(head["cells"]))):
        name = (head["cells"][k] if k < len(head["cells"]) else None) or f"column{k + 1}"
        names.append(name if name.lower() not in {x.lower() for x in names} else f"{name}_{k + 1}")
    seen = [F.collect_set(F.get("kinds", F.lit(k))).alias(str(k)) for k in range(len(names))]
    kinds = body.agg(*seen).first()
    out = []
    for k, name in enumerate(names):
        have = set(kinds[str(k)]) - {"NoneType"}
        kind = "boolean" if have == {"bool"} else "long" if have == {"int"} else "double" if have and have <= {"int", "float"} else "string"
        out.append(F.get("cells", F.lit(k)).cast(kind).alias(name))
    return body.select(*out)


def _shown(v) -> str | None:
    return None if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def from_pandas(spark: SparkSession, frame: pd.DataFrame) -> DataFrame:
    """A pandas table with missing values as nulls."""
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None)) if len(frame) else spark.createDataFrame([], ", ".join(f"`{c}` string" for c in frame.columns))


def as_table(spark: SparkSession, source, **options) -> DataFrame:
    """A path, a pandas table or a DataFrame as a DataFrame; anything else is a TypeError."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, pd.DataFrame):
        return from_pandas(spark, source)
    if isinstance(source, str):
        return read_table(spark, source, **options)
    raise TypeError(f"a path, a pandas table or a DataFrame is needed, not {type(source).__name__}")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, **options) -> DataFrame:
    """A database table, read in parallel ranges of a numeric key if one is given."""
    options |= {"url": url, "dbtable": table}
    if key is not None and bounds is not None:
        options |= {"partitionColumn": key, "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": partitions}
    return spark.read.format("jdbc").options(**options).load()


def with_row_id(df: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Adds row_id, unless there is one: a hash of the key columns, or else of the place of the row in the read."""
    if "row_id" in df.columns:
        return df
    return df.withColumn("row_id", F.xxhash64(*key) if key else F.monotonically_increasing_id())


def names_table(df: DataFrame, name: str = "CompanyName", source: str = "Source", config: LinkConfig = LinkConfig()) -> DataFrame:
    """Input columns renamed to those that the stages use; what is absent stays absent."""
    renames = {
        name: config.name, source: config.source, "HasOwnerRole": "has_owner_role", "HasContractorRole": "has_contractor_role", "Role": "role",
        "Database Table": "database_table", "isDemo": "is_demo", "Report Column": "report_column", "RecordID_CI": "record_id", "CompanyID": "company_id", "Count": "count",
    }
    return with_row_id(df.withColumnsRenamed({k: v for k, v in renames.items() if k in df.columns}))


_NESTED = {
    "words": "array<string>", "pos": "array<string>", "pos_num": "array<int>", "label_list": "array<int>", "cleaned_words": "array<string>",
    "word_vecs": "array<array<float>>", "labels": "map<string,int>", "tfidf": "map<string,double>",
}


def parse_nested(df: DataFrame, types: dict[str, str] = _NESTED) -> DataFrame:
    """Nested columns that a text format turned to JSON, or to quoted literals, made nested again.

    Only data is read; text that isn't a literal gives null.
    """
    for c, t in types.items():
        if dict(df.dtypes).get(c) == "string":
            df = df.withColumn(c, F.from_json(c, t, {"allowSingleQuotes": "true"}))
    return df
