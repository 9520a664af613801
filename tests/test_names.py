"""Splitting, cleaning, labels and weights on rows worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from onomast.config import LinkConfig, load_config
from onomast.functions import arrays, text
from onomast.operators import labels, names, nlp, weights

SPLITS = {
    "Acme Corp": ["Acme Corp"], "Acme (Beta)": ["Acme", "Beta"], "Acme (Beta/Gamma)": ["Acme", "Beta", "Gamma"], "Acme (APAC)": ["Acme (APAC)"],
    "Acme (APAC/EMEA)": ["Acme", "APAC", "EMEA"], "Acme (123-456789)": ["Acme (123-456789)"], "A/B (X)": ["A/B", "X"], "Acme / Beta": ["Acme", "Beta"],
    "Acme c/o Beta": ["Acme  Beta"], "(Beta)": ["Beta"], "c/o": [None], None: [None], "": [None], "x (  )": ["x", ""], "A\tContractor / Operator B": ["A\t B"],
}


def test_split_names(spark):
    rows = [(i, n, s) for i, n in enumerate(SPLITS) for s in ("reference", "inference")]
    got = names.split_names(spark.createDataFrame(rows, "row_id long, name string, source string")).collect()
    for i, (name, parts) in enumerate(SPLITS.items()):
        mine = sorted((r.part, r.name) for r in got if r.row_id == i and r.source == "reference")
        assert [n for _, n in mine] == parts, name
        other = [r for r in got if r.row_id == i and r.source == "inference"]
        assert [(r.name, r.is_separated) for r in other] == [(name, False)]


def test_words(spark):
    df = spark.createDataFrame([("Scott & Sons, Inc.",), ("A&B - Co",), ("Foo  Bar",), (None,)], "name string")
    got = df.select(text.weighting_words(F.col("name")).alias("w"), text.matching_words(text.raw_words(F.col("name"))).alias("m")).collect()
    assert [r.w for r in got] == [["SCOTT", "AND", "SONS", "INC"], ["A&B", "CO"], ["FOO", "BAR"], []]
    assert [r.m for r in got] == [["SCOTT", "&", "SONS", "INC"], ["A&B", "CO"], ["FOO", "", "BAR"], None]


def test_decoding(spark):
    cases = [("AB", [0, 1], {"A": 0, "B": 1}), ("ABC", [0, 2], {"A": 0, "B": 2, "C": 0}), ("ABA", [1, 2], {"A": 0, "B": 2}), ("ABA", [1, 2, 2], {"A": 2, "B": 2}), ("AB", [0, 3, 1], {"A": 0, "B": 1}), ("", [], {}), ("AAB", [1, 2], {"A": 0, "B": 0})]
    df = spark.createDataFrame([(i, list(w), x) for i, (w, x, _) in enumerate(cases)], "i int, w array<string>, x array<int>")
    for r in df.select("i", labels.decode_labels(F.col("w"), F.col("x")).alias("l")).collect():
        assert [(p.word, p.label) for p in r.l] == list(cases[r.i][2].items())


def test_idf_and_weights(spark):
    df = spark.createDataFrame([(4, 1), (4, 3), (4, 4)], "n int, df int")
    got = [r[0] for r in df.select(arrays.modified_idf(F.col("n"), F.col("df"))).collect()]
    assert got == pytest.approx([0.591073, 0, -0.138867], abs=1e-6)
    rows = spark.createDataFrame([(1, ["A", "B", "A"]), (2, ["B"]), (3, []), (4, ["C"])], "row_id long, words array<string>")
    out = {r.row_id: r for r in weights.weigh(rows).collect()}
    idf = {w: (4 / (1 + n)) ** 0.67 - 1 for w, n in {"A": 1, "B": 2, "C": 1}.items()}
    assert [(e.word, pytest.approx(e.value)) for e in out[1].tfidf] == [("A", 2 / 3 * idf["A"]), ("B", idf["B"] / 3)]
    assert sum(e.value for e in out[1].normalized_tfidf) == pytest.approx(1) and out[3].tfidf == []
    zero = weights.weigh(spark.createDataFrame([(1, ["A"]), (2, ["A"]), (3, ["A"]), (4, [])], "row_id long, words array<string>"))
    assert {r.normalized_tfidf[0].value for r in zero.filter("row_id < 4").collect()} == {None}


def test_corpus_counts_add_up(spark):
    """One count of the corpus gives what counting each fold with the corpus gives."""
    rows = [(i, [w for k, w in enumerate("ABCDE") if (i * 7 + k * 3) % 4 < 2], i % 3) for i in range(30)]
    corpus = [(100 + i, ["A", "E"] if i % 2 else ["B"]) for i in range(9)]
    got = weights.idf_table(spark.createDataFrame(rows, "row_id long, words array<string>, fold long"), spark.createDataFrame(corpus, "row_id long, words array<string>")).collect()
    for r in got:
        docs = [w for _, w, f in rows if f == r.fold] + [w for _, w in corpus]
        df = sum(r.word in d for d in docs)
        assert r.df == df and r.idf == pytest.approx((len(docs) / (1 + df)) ** 0.67 - 1)


def test_folds_are_a_seeded_shuffle(spark):
    df = spark.range(950).withColumnRenamed("id", "row_id")
    a = names.seeded_rank(df, 1)
    assert sorted(r.rank for r in a.collect()) == list(range(1, 951))
    assert sorted(a.repartition(7).collect()) == sorted(names.seeded_rank(df.repartition(5), 1).collect())
    sizes = sorted(r["count"] for r in names.folds(df).groupBy("fold").count().collect())
    assert sizes == [150, 200, 200, 200, 200]
    plan = names.folds(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan


def test_tags():
    assert nlp.word_tags("") == [""] and nlp.word_tags("-") == [] and nlp.word_tags("Corp.") == ["NOUN"]
    assert nlp.word_tags("Smith-Jones") == ["PROPN"] and nlp.word_tags("A&B")[1] == "CCONJ"
    v = nlp.hashed_vector("acme")
    assert v.shape == (300,) and math.isclose(float((v * v).sum()), 1, rel_tol=1e-5) and not nlp.hashed_vector("").any()


def test_features_follow_words(spark):
    df = spark.createDataFrame([(1, "Acme - North Corp."), (2, None), (3, "")], "row_id long, name string")
    got = {r.row_id: r for r in nlp.nlp_features(df).collect()}
    assert got[1].words == ["Acme", "North", "Corp."] and got[1].pos == ["PROPN", "PROPN", "NOUN"] and got[1].pos_num == [13, 13, 9] and len(got[1].word_vecs) == 3
    assert got[2].words is None and got[3].pos == [""]


def test_unknown_tag_is_an_error(spark):
    with pytest.raises(Exception, match="no code for"):
        spark.createDataFrame([("NOPE",)], "t string").select(arrays.pos_code(F.col("t"))).collect()


def test_label_text(spark):
    df = spark.createDataFrame([([],), ([1],), ([0, 2],)], "x array<int>")
    got = df.select(text.join_labels(F.col("x")).alias("t")).select("t", text.parse_labels(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("", []), ("1, ", [1]), ("0, 2", [0, 2])]


def test_trained_labeler_beats_chance(spark):
    rows = spark.createDataFrame([(i, [f"Name{i % 9}", ("North", "South")[i % 2], ("Inc", "Corp")[i % 2]]) for i in range(120)], "row_id long, words array<string>")
    told = labels.position_labeler(1, 1)(rows)
    model = labels.train_labeler(told.filter("row_id < 90"), 256)
    got = labels.model_labeler(model)(rows.filter("row_id >= 90")).collect()
    assert sum(r.label_list == [0, 1, 2] for r in got) >= 28


def test_config(tmp_path):
    f = tmp_path / "c.ini"
    f.write_text("[a]\nfold_size = 50\n[b]\nreference = 'pool'\nunknown = 1\n")
    c = load_config(str(f))
    assert (c.fold_size, c.reference, c.seed) == (50, "pool", LinkConfig().seed)
    with pytest.raises(FileNotFoundError):
        load_config(str(tmp_path / "none.ini"))
