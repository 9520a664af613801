"""Sources, sinks, command line, streaming, and every query against DuckDB on the smallest tables."""

import json
import math
import os
import zipfile

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from onomast.cut import cut, scratch, shared_dir
from onomast.operators import evaluate, labels, match, names, wordscores
from onomast.plans import catalog, cli
from onomast.plans.pipeline import Pipeline
from onomast.schema import require
from onomast.sources import readers, sinks
from onomast.streaming.match_stream import match_stream

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_read_and_write(spark, tmp_path):
    df = spark.createDataFrame([(1, ["A", "B"], None), (2, [], "x")], "row_id long, words array<string>, name string")
    for fmt in ("parquet", "orc", "json"):
        sinks.save_results(df, str(tmp_path / fmt), fmt)
        assert sorted(readers.read_table(spark, str(tmp_path / fmt), fmt).select("row_id", "words", "name").collect()) == sorted(df.collect())
    sinks.save_results(df, str(tmp_path / "c"), "csv", single=True)
    back = readers.parse_nested(readers.read_table(spark, str(tmp_path / "c"), "csv"))
    assert {tuple(r.words) for r in back.collect()} == {("A", "B"), ()}
    (tmp_path / "records.json").write_text(json.dumps([{"CompanyName": "Acme", "Source": "inference"}, {"CompanyName": None, "Source": "reference"}], indent=1))
    got = readers.names_table(readers.read_table(spark, str(tmp_path / "records.json")))
    assert got.count() == 2 and {"row_id", "name", "source"} <= set(got.columns)
    assert got.filter("name is null").count() == 1


ODD = ["x", "", None, " lead", "a\nb\r\nc", "<&>\"'", "é漢😀", "_x0041_", "\x01\x1f", "1.5"]


def test_excel_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, t, i / 2, i % 2 == 0, [t or "n"]) for i, t in enumerate(ODD)] + [(10**17, "big", float("nan"), None, [])], "id long, t string, x double, b boolean, l array<string>")
    path = str(tmp_path / "s.xlsx")
    assert sinks.write_excel(df, path) == 11
    back = readers.read_table(spark, path)
    assert back.dtypes == [("id", "string"), ("t", "string"), ("x", "double"), ("b", "boolean"), ("l", "string")]  # an id beyond the numbers of a sheet is text
    got = {r.id: r for r in back.collect()}
    assert [got[str(i)].t for i in range(10)] == [t for t in ODD] and [got[str(i)].x for i in range(10)] == [i / 2 for i in range(10)]
    assert got["3"].b is False and got[str(10**17)].x is None and json.loads(got["5"].l) == [ODD[5]]
    sinks.save_results(df.select("id", "t").filter("id < 3"), path, "excel")
    assert readers.read_table(spark, path).dtypes[0] == ("id", "bigint")
    (tmp_path / "no.xlsx").write_bytes(b"no archive")
    with pytest.raises(Exception, match="zip"):
        readers.read_table(spark, str(tmp_path / "no.xlsx")).count()


def test_workbook_of_another_writer(spark, tmp_path):
    """Shared and rich strings, gaps, errors, formulas, two sheets, a second workbook without a column."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def book(path, sheet):
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="A" sheetId="1" r:id="r1"/><sheet name="B" sheetId="2" r:id="r2"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/one.xml"/><Relationship Id="r2" Target="/xl/worksheets/two.xml"/></Relationships>')
            z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>CompanyName</t></si><si><r><t>Ac</t></r><r><t>me</t></r><rPh><t>no</t></rPh></si></sst>")
            z.writestr("xl/worksheets/one.xml", f"<worksheet {main}><sheetData>{sheet}</sheetData></worksheet>")
            z.writestr("xl/worksheets/two.xml", f"<worksheet {main}><sheetData/></worksheet>")

    (tmp_path / "d").mkdir()
    book(tmp_path / "d" / "a.xlsx", '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="str"><v>n</v></c><c r="D2" t="str"><v>N</v></c></row><row r="5"><c r="A5" t="s"><v>1</v></c><c r="B5" t="e"><v>#N/A</v></c><c r="C5"><f>1+1</f><v>2</v></c></row><row r="6"/>')
    book(tmp_path / "d" / "b.xlsx", '<row><c t="s"><v>0</v></c></row><row><c t="inlineStr"><is><t>Beta</t></is></c></row>')
    got = readers.read_excel(spark, str(tmp_path / "d"))
    assert got.columns == ["CompanyName", "column2", "n", "N_4"]
    assert sorted(map(tuple, got.collect())) == [("Acme", None, 2, None), ("Beta", None, None, None)]
    assert readers.names_table(got).filter("name is not null").count() == 2
    assert readers.read_excel(spark, str(tmp_path / "d"), "B").count() == 0
    with pytest.raises(Exception, match="has no sheet"):
        readers.read_excel(spark, str(tmp_path / "d"), "C").count()


def test_excel_beyond_one_sheet(spark, tmp_path, monkeypatch):
    """A table of more rows than a sheet holds goes on in further sheets and is read back whole."""
    monkeypatch.setattr(sinks.excel, "MOST_ROWS", 4)
    for n in (3, 4, 9, 10):
        df = spark.createDataFrame([(i, None if i % 3 == 0 else f"n{i}") for i in range(n)], "id long, t string")
        path = str(tmp_path / f"s{n}.xlsx")
        assert sinks.write_excel(df, path) == n
        with zipfile.ZipFile(path) as z:
            assert sum(x.startswith("xl/worksheets/") for x in z.namelist()) == math.ceil(n / 3)
        assert sorted(map(tuple, readers.read_table(spark, path).collect())) == sorted(map(tuple, df.collect()))
    assert readers.read_excel(spark, str(tmp_path)).count() == 3 + 4 + 9 + 10
    assert readers.read_excel(spark, path, "Results (continued 2)").count() == 3


def test_parts_have_ids_of_their_own(spark):
    schema = "row_id long, name string, source string"
    many = "/".join(f"Name{k}" for k in range(100))
    for rows in ([(0, many, "reference"), (1, "One", "reference"), (-2, "A/B", "reference")], [(2**62, "A/B", "reference"), (2**63 - 1, "C", "reference"), (-(2**63), many, "reference"), (7, "D", "inference")]):
        got = names.part_ids(names.split_names(spark.createDataFrame(rows, schema))).collect()
        assert len({r.row_id for r in got}) == len(got) >= 103
        order = [(r.input_id, r.part) for r in sorted(got, key=lambda r: r.row_id)]
        assert order == sorted(order) and {r.input_id for r in got} == {r[0] for r in rows}
    assert names.part_ids(names.split_names(spark.createDataFrame([], schema))).count() == 0


def test_stage_counts_and_times(spark, tmp_path):
    rows = [(1, "Acme North Inc", "inference"), (4, "Acme (Beta)", "reference")]
    p = Pipeline(spark, checkpoint_dir=str(tmp_path / "stages"))
    p.run(spark.createDataFrame(rows, "row_id long, name string, source string")).collect()
    assert p.rows == {"weighted": 3, "featured": 3, "labelled": 3, "linked": 1} and p.timer.total > 0 and set(p.timer.seconds) == set(p.rows)


def test_database_round_trip(spark):
    """A database in memory, written and read in ranges of its key."""
    url = "jdbc:derby:memory:onomast;create=true"
    driver = "org.apache.derby.jdbc.EmbeddedDriver"
    df = spark.createDataFrame([(i, f"n{i}" if i % 7 else None) for i in range(50)], "id long, name string")
    sinks.write_jdbc(df, url, "names", "overwrite", driver=driver)
    sinks.write_jdbc(df.withColumn("id", F.col("id") + 50), url, "names", driver=driver)
    whole = readers.read_jdbc(spark, url, "names", driver=driver)
    parts = readers.read_jdbc(spark, url, "names", "id", (0, 100), 4, driver=driver)
    assert parts.rdd.getNumPartitions() == 4 and whole.count() == 100
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect())) and whole.filter("name is null").count() == 16


def test_scratch_tables_are_deleted(spark):
    before = scratch_tables(spark)
    with scratch(spark):
        assert cut(spark.range(3)).count() == 3 and len(scratch_tables(spark) - before) == 1
    assert scratch_tables(spark) == before
    assert cut(spark.range(3)).count() == 3 and len(scratch_tables(spark) - before) == 1


def test_providers_of_tags_and_vectors(spark):
    """A tagger and a vector function of one's own, asked once for each distinct word."""
    from onomast.operators import nlp

    df = spark.createDataFrame([(1, "Acme Works"), (2, "Works Acme Corp."), (3, None)], "row_id long, name string")
    table = {"Acme": "PROPN", "Works": "VERB"}
    out = nlp.nlp_features(df, tagger=lambda w: [(w, table.get(w, "X"), False)], vector=lambda w: np.full(3, len(w), np.float32)).collect()
    got = {r.row_id: (r.pos, [v[0] for v in r.word_vecs or []]) for r in out}
    assert got == {1: (["PROPN", "VERB"], [4, 5]), 2: (["VERB", "PROPN", "NOUN"], [5, 4, 5]), 3: (None, [])}


def test_measures(spark):
    truth = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4)], "a int, b int")
    found = spark.createDataFrame([(1, 1), (1, 1), (2, 9), (3, 3)], "a int, b int")
    r = evaluate.precision_recall(found, truth, ["a", "b"]).first()
    assert (r.precision, r.recall) == (pytest.approx(2 / 3), 0.5) and r.f1 == pytest.approx(4 / 7)
    groups = spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), ("y", 2)], "alias string, truth int")
    assert evaluate.grouping_accuracy(groups, "truth").first().accuracy == 0.75


def test_older_word_scores_as_an_expression(spark):
    rows = [(r, k, m, i, j, a, b, s) for r in (94, 95, 100) for k in range(4) for m in range(4) for i, j, a, b in ((0, 0, 0, 0), (1, 2, 3, 1), (2, 1, 1, 4)) for s in (False, True)]
    df = spark.createDataFrame(rows, "r int, k int, m int, i int, j int, a int, b int, s boolean")
    got = df.withColumn("x", wordscores.weighted_word_scores(*[F.col(c) for c in "rkmijabs"])).collect()
    for x in got:
        c1, c2 = {x.k: x.a} | {0: x.i if x.k != 0 else x.a}, {x.k: x.b} | {0: x.j if x.k != 0 else x.b}
        if x.k == 0:
            assert True if x.i != x.a or x.j != x.b else x.x == pytest.approx(wordscores.weighted_word_score(x.r, x.k, x.m, c1, c2, x.s))
        else:
            assert x.x == pytest.approx(wordscores.weighted_word_score(x.r, x.k, x.m, c1, c2, x.s))


def test_trained_labelers_are_right_on_names_not_seen(spark):
    got = {r.model: r.accuracy for r in catalog.QUERIES["udf5_trained_evaluation"](spark, DATA).collect()}
    assert set(got) == {"regression", "network"} and min(got.values()) > 0.9


def test_tables_in_memory(spark):
    got = readers.as_table(spark, pd.DataFrame({"name": ["a", None], "n": [1.0, float("nan")]})).collect()
    assert [tuple(r) for r in got] == [("a", 1.0), (None, None)]
    with pytest.raises(TypeError):
        readers.as_table(spark, 5)
    with pytest.raises(TypeError):
        require(spark.range(1), "names")


def test_literals_are_only_data(spark):
    df = spark.createDataFrame([("['A', 'B']",), ("__import__('os')",), (None,)], "words string")
    assert [r.words for r in readers.parse_nested(df).collect()] == [["A", "B"], None, None]


def scratch_tables(spark):
    return {x for x in os.listdir(shared_dir(spark).removeprefix("file://")) if x.startswith("cut-")}


@pytest.fixture
def nothing_left(spark):
    """What is tested leaves no scratch table behind."""
    before = scratch_tables(spark)
    yield
    assert scratch_tables(spark) == before


@pytest.mark.parametrize("hidden", [(), (2,)])
def test_training_partitions_are_bounded(spark, monkeypatch, nothing_left, hidden):
    """Names of one partition are trained on by tasks of bounded bytes, of every token once."""
    monkeypatch.setattr(labels, "TASK_BYTES", 1 << 14)
    seen = []
    plain = labels._training_tokens
    monkeypatch.setattr(labels, "_training_tokens", lambda *a: seen.append(plain(*a)) or seen[-1])
    rows = labels.position_labeler()(spark.range(400).coalesce(1).select(F.col("id").alias("row_id"), F.split(F.concat_ws(" ", F.lit("Acme"), F.col("id") % 9, F.lit("Works"), F.lit("Inc")), " ").alias("words")))
    fitted = []
    monkeypatch.setattr(labels.Pipeline, "fit", lambda self, df: fitted.append([r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]))
    labels.train_labeler(rows, 64, hidden=hidden)
    width = 8 * 72 if hidden else labels.SPARSE_BYTES
    assert len(seen) == 1 and sum(fitted[0]) == 1600 and max(fitted[0]) * width <= 2 * labels.TASK_BYTES


def test_command_line(spark, tmp_path, nothing_left):
    rows = [{"row_id": i, "name": n, "source": s} for i, (n, s) in enumerate([("Acme North Inc", "inference"), ("Acme North Co", "reference"), ("Zeta", "reference")])]
    (tmp_path / "in.json").write_text(json.dumps(rows))
    cli.main(["run", "--i", str(tmp_path / "in.json"), "--o", str(tmp_path / "out"), "--format", "parquet"], spark)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    with pytest.raises(FileNotFoundError):
        cli.main(["run", "--i", "/none", "--o", str(tmp_path / "x")], spark)


def test_stream(spark, tmp_path, nothing_left):
    pool = labels.label_rows(spark.createDataFrame([(9, "Acme Inc", "reference", ["Acme", "Inc"])], "row_id long, name string, source string, words array<string>"), labels.rule_labeler())
    spark.createDataFrame([(1, "Acme Co", "inference")], "row_id long, name string, source string").write.parquet(str(tmp_path / "in"))
    seen = []
    arriving = spark.readStream.schema("row_id long, name string, source string").parquet(str(tmp_path / "in"))
    match_stream(arriving, pool, lambda df, n: seen.extend(df.collect()), str(tmp_path / "state")).awaitTermination()
    assert [(r.row_id, r.matched_id, r.category) for r in seen] == [(1, 9, "Alias")]


def plain(df):
    def value(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(float(v), 5) if isinstance(v, float) else str(int(v)) if hasattr(v, "__index__") else str(v)

    df = df[sorted(df.columns)]
    return sorted((tuple(map(value, r)) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(got)
        return
    want = duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_scan_reads_only_what_is_asked(spark):
    plan = catalog.QUERIES["agg8_source_counts"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint>" in plan


def test_no_pushdown_lost(spark):
    df = spark.read.parquet(f"{DATA}/part.parquet").filter("p_size > 3").select("p_name")
    assert "PushedFilters: [IsNotNull(p_size), GreaterThan(p_size,3)]" in df._jdf.queryExecution().executedPlan().toString()
    assert match.LISTS == ("imp", "sub", "gen") and F is not None
