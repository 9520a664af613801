"""Similarity, matching, report and streaming."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from onomast.config import LinkConfig
from onomast.functions import similarity as sim
from onomast.operators import labels, match, report, wordscores
from onomast.operators.match import Scorer, word_pairs
from onomast.plans import catalog
from onomast.plans.pipeline import Pipeline

LABELLED = "row_id long, name string, source string, labels array<struct<word:string,label:int>>"


def score(imp1, imp2, sub1=(), sub2=(), gen1=(), gen2=(), **config):
    row = [list(x) for x in (imp1, sub1, gen1, imp2, sub2, gen2)]
    return Scorer(word_pairs([row]), LinkConfig(**config)).pair(*row)


def test_ratio_examples():
    pairs = [("ELECTRIC", "ELECTRIK", 88), ("ACME", "ACMEE", 89), ("SUPPLIER000000001", "SUPPLIER000000002", 94), ("", "X", 0), (None, "X", 0), ("kitten", "sitting", 62), ("é" * 70, "é" * 69, 99)]
    assert sim.ratios([a for a, _, _ in pairs], [b for _, b, _ in pairs]).tolist() == [r for *_, r in pairs]


@settings(max_examples=60, deadline=None)
@given(st.text("abcé", max_size=90), st.text("abcé", max_size=12))
def test_ratio_against_table(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    want = 100 if a == b else round(200 * table[-1][-1] / max(1, len(a) + len(b)))
    assert sim.ratios([a], [b])[0] == sim.ratios([b], [a])[0] == want


def test_ratio_expression_agrees(spark):
    words = ["ACME", "ACMEE", "", "A", "BRAND12", "BRAND1"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    assert df.filter(sim.ratio_expr(F.col("a"), F.col("b")) != sim.ratio("a", "b")).count() == 0


def test_metaphone():
    codes = {"PHONE": "FN", "ELECTRIC": "ELKTRK", "ELECTRIK": "ELKTRK", "XEROX": "SRKS", "123": "", "": ""}
    for w in ("PHONE", "ELECTRIC", "ELECTRIK", "XEROX", "123", ""):
        assert sim.metaphone_word(w) == codes[w]


def test_ordered_scores():
    assert score(["SCOTT"], ["SCOTT", "ELECTRIC"])[0] == pytest.approx(68)
    assert score(["SCOTT", "ELECTRIC"], ["SCOTT", "ELECTRIK"])[0] == pytest.approx(82.96)
    assert score(["ACME"], ["ACMEE"])[0] == pytest.approx(75.65)
    assert score([], []) == (0.0, None)


@pytest.mark.parametrize("sub1,sub2,gen1,gen2,total,kind", [
    ("", "", "", "", 100, "Match"), ("", "", "INC", "INC", 100, "Match"), ("", "", "INC", "", 95, "Alias"), ("", "", "INC CO", "INC", 97.5, "Alias"),
    ("NORTH", "", "", "", 90, "Subsidiary"), ("NORTH", "SOUTH", "", "", 90, "Subsidiary"), ("NORTH", "", "INC", "", 85, "Subsidiary"),
    ("", "", "ABCDEFGHIJKLM", "ABCDEFGHIJKLMN", 99.8, None),
])
def test_categories(sub1, sub2, gen1, gen2, total, kind):
    got = score(["ACME"], ["ACME"], sub1.split(), sub2.split(), gen1.split(), gen2.split())
    assert got[0] == pytest.approx(total) and got[1] == kind


def test_ieee_gate():
    for n in range(1, 16):
        same = [f"W{k}" for k in range(n)]
        assert score(same, same)[1] == "Match"
    assert sum(score([f"W{k}" for k in range(n)], [f"W{k}" for k in range(n)], compat="ieee")[1] is None for n in range(1, 16)) > 0


def rows_of(spark, seed, n, source, words=("ALPHA", "ALPHAA", "BETA", "ELECTRICAL", "ELECTRIKAL", "GAMMA", "W" * 120, "W" * 121)):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        ws = r.sample(words, r.randint(0, 3))
        lab = [(w, 0) for w in ws] + [(w, 1) for w in r.sample(["NORTH", "SOUTH"], r.randint(0, 1))] + [(w, 2) for w in r.sample(["INC", "CO"], r.randint(0, 2))]
        rows.append((i, " ".join(w for w, _ in lab), source, lab))
    return spark.createDataFrame(rows, LABELLED)


@pytest.mark.parametrize("seed", [1, 2])
def test_tiers_equal_brute_force(spark, seed):
    mine, pool = rows_of(spark, seed, 40, "inference"), rows_of(spark, seed + 10, 50, "reference")
    cols = ["row_id", "matched_id", F.round("score", 6).alias("score"), "category"]
    got, want = match.match(mine, pool).select(*cols), match.brute_force(mine, pool).select(*cols)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def split_rows(spark, seed, n, source):
    """The same few words under all labels, in any split and with repeats."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lab = [(r.choice(["ACME", "NORTH", "ACMEE", "INC", "W" * 70]), r.randrange(3)) for _ in range(r.randint(0, 4))]
        lab.sort(key=lambda x: x[1])
        rows.append((i, "".join(w + " " for w, _ in lab) + str(r.randrange(3)), source, lab))
    return spark.createDataFrame(rows, LABELLED)


@pytest.mark.parametrize("seed,hot", [(1, 4096), (2, 4096), (3, 2)])
def test_label_splits_equal_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(match, "HOT", hot)
    mine, pool = split_rows(spark, seed, 60, "inference"), split_rows(spark, seed + 10, 60, "reference")
    cols = ["row_id", "matched_id", F.round("score", 6).alias("score"), "category"]
    got, want = match.match(mine, pool).select(*cols), match.brute_force(mine, pool).select(*cols)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    rows = mine.collect()
    lists = {x.row_id: [[w for w, k in x.labels if k == c] for c in range(3)] for x in rows}
    named = {x.row_id: x.name for x in rows}
    for x in match.alias(mine).collect():
        a = lists[x.row_id]
        if not any(a):
            assert x.alias == ""
            continue
        alike = [k for k, b in lists.items() if any(b) and Scorer(word_pairs([(*b, *a)]), LinkConfig()).pair(*b, *a)[1] in ("Match", "Alias")]
        assert x.alias == (max((len(named[k]), -k, named[k]) for k in alike)[2] if alike else "")


def test_lists_that_share_all_words_differ(spark):
    rows = [(1, "a", "inference", [("ACME", 0), ("NORTH", 1)]), (2, "bb", "inference", [("ACME", 0), ("NORTH", 0)])]
    pool = [(8, "R1", "reference", [("ACME", 0), ("NORTH", 1)]), (9, "R2", "reference", [("ACME", 0), ("NORTH", 0)])]
    mine = spark.createDataFrame(rows, LABELLED)
    got = {x.row_id: x.matched_name for x in match.match(mine, spark.createDataFrame(pool, LABELLED)).collect()}
    assert got == {1: "R1", 2: "R2"} and {x.row_id: x.alias for x in match.alias(mine).collect()} == {1: "a", 2: "bb"}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abcé", max_size=70), max_size=6, unique=True), st.lists(st.text("abcé", max_size=70), max_size=6, unique=True))
def test_ratio_tables(a, b):
    got = sim.ratio_table(np.array(a, object), np.array(b, object))
    assert got.tolist() == [sim.ratios([x] * len(b), b).tolist() for x in a]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(*[st.lists(st.sampled_from(["ACME", "ACMEE", "ELECTRICALS", "ELECTRIKALS", "ABCDEFGHIJKLMNOPQRSTU", "ABCDEFGHIJKLMNOPQRSTV", "", "X" * 80]), max_size=4)] * 6), max_size=12), st.booleans())
def test_batches_score_as_one_by_one(rows, ieee):
    config = LinkConfig(compat="ieee" if ieee else "tolerant")
    total, kind = match.Batch([pa.array([r[k] for r in rows], pa.list_(pa.string())) for k in range(6)], config).scores()
    for r, s, c in zip(rows, total, kind):
        assert Scorer(word_pairs([r]), config).pair(*r) == (s, c)


def counted_rows(spark, n, source):
    """Rows whose labels count, in an accumulator, how often they are made."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<struct<word:string,label:int>>")
    def make(k):
        seen.add(1)
        return [(f"ACME{k % 3}", 0)] if k % 5 else []

    return spark.range(n).select(F.col("id").alias("row_id"), F.concat(F.lit("n"), F.col("id")).alias("name"), F.lit(source).alias("source"), make("id").alias("labels")), seen


def test_labels_are_made_once(spark):
    """Making labels is most of the work of matching, so it isn't repeated for signatures, joins and the two parts of a report."""
    (mine, own), (pool, other) = counted_rows(spark, 20, "inference"), counted_rows(spark, 10, "reference")
    out = report.report(match.alias(match.match(mine, pool)), spark.createDataFrame([], "name string"))
    assert out.count() == 20 and (own.value, other.value) == (20, 10)
    (mine, own), (pool, other) = counted_rows(spark, 20, "inference"), counted_rows(spark, 10, "reference")
    assert match.cascade(mine, [pool, pool]).count() == 20 and own.value == 20


def test_rows_without_tokens_are_not_one_group(spark):
    """They have no signature to join on, and go to as many tasks as any rows."""
    none = spark.range(50).select(F.col("id").alias("row_id"), F.lit(None).cast("string").alias("sig"))
    assert none.select(match._join_key()).distinct().count() == 50


def test_columns_of_no_type_pass(spark):
    mine, pool = rows_of(spark, 4, 10, "inference").withColumn("nothing", F.lit(None)), rows_of(spark, 5, 20, "reference")
    got = match.alias(match.match(mine, pool))
    assert dict(got.dtypes)["nothing"] == "void" and got.count() == 10 and got.columns[:5] == mine.columns


def test_small_files_go_to_all_cores(spark):
    """One row group of many names is labelled by more than one task."""
    rows = catalog._raw(spark, "/root/testdata/sf0.001")
    assert rows.select(F.spark_partition_id()).distinct().count() > 1


def test_gate_is_an_equi_join(spark):
    mine = rows_of(spark, 3, 5, "inference")
    sig = match.signatures(mine)
    plan = match.gated(sig, sig)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_alias_is_one_step(spark):
    rows = [(1, "ACME", "inference", [("ACME", 0)]), (2, "ACME INC", "inference", [("ACME", 0), ("INC", 2)]), (3, "ACME NORTH INCORPORATED", "inference", [("ACME", 0), ("NORTH", 1)]), (4, "INC", "inference", [("INC", 2)]), (5, "", "inference", [])]
    got = {r.row_id: r.alias for r in match.alias(spark.createDataFrame(rows, LABELLED)).collect()}
    assert got == {1: "ACME INC", 2: "ACME INC", 3: "ACME NORTH INCORPORATED", 4: "", 5: ""}


def test_empty_pool_and_cascade(spark):
    mine, pool = rows_of(spark, 4, 10, "inference"), rows_of(spark, 5, 20, "reference")
    none = match.match(mine, pool.limit(0)).collect()
    assert len(none) == 10 and all(r.score is None and r.matched_name is None for r in none)
    got = match.cascade(mine, [pool.filter("row_id < 5"), pool.filter("row_id >= 5")]).collect()
    assert len(got) == 10 and all(r.pool == 1 or r.score >= 85 - 1e-9 for r in got)


def test_report(spark):
    rows = [(1, "acme", "X Ltd", 100.0, "Match", "acme"), (2, "ACME ", "Y", 40.0, None, ""), (3, "Beta", "X", 40.0, None, ""), (4, None, "X", 90.0, None, ""), (5, "Gamma", None, None, None, "")]
    df = spark.createDataFrame(rows, "row_id long, name string, matched_name string, score double, category string, alias string").withColumn("source", F.lit("inference")).withColumn("count", F.lit(77))
    out = report.report(df, spark.createDataFrame([("X Ltd",), ("X Ltd",), (None,)], "name string")).collect()
    assert [(r[0], r[2], r[3], r[6]) for r in out] == [("acme", "X Ltd", 100.0, 2), ("Beta", "", 40.0, 1), ("Gamma", "", None, 1)]
    assert list(out[0].asDict()) == list(report.REPORT.values())


def test_whole_run(spark):
    rows = [(1, "Acme North Inc", "inference"), (2, "Acme North Co", "inference"), (3, "Zeta Works", "inference"), (4, "Acme (Beta)", "reference"), (5, "Acme North Inc", "reference"), (6, None, "reference")]
    out = Pipeline(spark).run(spark.createDataFrame(rows, "row_id long, name string, source string")).collect()
    got = {r["Inference Company Name"]: r for r in out}
    assert got["Acme North Inc"]["Match Category"] == "Match" and got["Acme North Co"]["Match Category"] == "Alias" and set(got) == {"Acme North Inc", "Acme North Co", "Zeta Works"}


def test_older_scores():
    same = [("ACME", 0), ("NORTH", 1), ("INC", 2)]
    assert wordscores.name_score(same, same) == pytest.approx(100)
    assert wordscores.name_score([], same) == 0 and wordscores.name_score([("ACME", 0)], [("ACME", 0)]) == pytest.approx(100)
