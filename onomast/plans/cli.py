"""``python -m onomast.plans.cli STAGE --input IN --output OUT``: one stage, or the whole run, from file to file."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import LinkConfig, load_config
from ..cut import scratch
from ..operators import labels as lab
from ..operators import match, names, nlp, weights
from ..sources import readers, sinks
from .pipeline import Pipeline

STAGES = ("weigh", "features", "classify", "train", "match", "corpus", "run")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="onomast")
    p.add_argument("stage", choices=STAGES)
    p.add_argument("--i", "--input", dest="input", required=True)
    p.add_argument("--o", "--output", dest="output", required=True)
    p.add_argument("--corpus")
    p.add_argument("--active")
    p.add_argument("--config")
    p.add_argument("--m", "--mode", dest="mode", choices=("test", "train"), default="test", help="classify: label rows, or fit the model first")
    p.add_argument("--mn", "--model_name", dest="model")
    p.add_argument("--fallback-table", help="match: rows of this database_table are the second pool")
    p.add_argument("--format", default="json", choices=("json", "parquet", "csv", "orc"))
    return p


def checked(args: argparse.Namespace) -> argparse.Namespace:
    """The arguments, if input and output folder exist."""
    if "://" not in args.input and not os.path.exists(args.input):
        raise FileNotFoundError(args.input)
    folder = os.path.dirname(os.path.abspath(args.output))
    if "://" not in args.output and not os.path.isdir(folder):
        raise FileNotFoundError(folder)
    return args


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = checked(parser().parse_args(argv))
    spark = spark or SparkSession.builder.appName("onomast").getOrCreate()
    with scratch(spark):  # the result is a file by then
        _stage(args, spark)


def _stage(args: argparse.Namespace, spark: SparkSession) -> None:
    config = load_config(args.config) if args.config else LinkConfig()
    table = readers.with_row_id(readers.parse_nested(readers.read_table(spark, args.input)))
    labeler = lab.model_labeler(lab.load_labeler(args.model)) if args.model and args.mode == "test" and args.stage != "train" else lab.rule_labeler()
    pipe = Pipeline(spark, config, labeler)
    read = lambda path: None if path is None else readers.read_table(spark, path)
    if args.stage == "train" or args.stage == "classify" and args.mode == "train":
        lab.save_labeler(lab.train_labeler(table), args.model or args.output)
        return
    if args.stage == "weigh":
        out = pipe.weigh(table, read(args.corpus))
    elif args.stage == "features":
        out = nlp.nlp_features(table)
    elif args.stage == "classify":
        out = lab.label_rows(table, labeler)
    elif args.stage == "corpus":
        cut = names.clean_names(names.split_names(table, config), config).withColumn("fold", F.lit(0))
        out = weights.weigh(cut.filter(F.col(config.source) == config.reference), None, config)
    elif args.stage == "match":
        mine, pool = (table.filter(F.col(config.source) == s) for s in (config.inference, config.reference))
        pools = [pool] if args.fallback_table is None else [pool.filter(F.col("database_table") != args.fallback_table), pool.filter(F.col("database_table") == args.fallback_table)]
        out = match.alias(match.cascade(mine, pools, config), config)
    else:
        out = pipe.run(table, read(args.corpus), read(args.active))
    sinks.save_results(out, args.output, args.format)


if __name__ == "__main__":
    main()
