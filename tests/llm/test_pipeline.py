"""The stages one after another, and the queries' results on the smallest tables."""

import pytest

import __spark_entry__
import corpus_pipeline
from onomast.llm import decontam, linededup, neardup, queries, toxicity
from onomast.llm.common import read, staged

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, DATA, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    model = toxicity.train(docs, read(spark, DATA, "labels"))
    want = [
        lambda d: {r.doc_id for r in toxicity.score(d, model).filter("not toxic").collect()},
        lambda d: {r.doc_id for r in linededup.line_dedup(d).collect()},
        lambda d: {r.doc_id for r in neardup.groups(d).filter("doc_id = group_id").collect()},
        lambda d: {r.doc_id for r in d.collect()} - {r.doc_id for r in decontam.matches(d, read(spark, DATA, "benchmark")).collect()},
    ]
    for (name, stage), ids in zip(corpus_pipeline.STAGES[:-1], want):
        out = staged(stage(spark, docs, DATA), name)
        assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == ids(docs) and out.count() <= docs.count()
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    sizes = {r.doc_id: len(r.text.encode()) + 1 for r in docs.collect()}
    got = {}
    for r in packed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    assert got == sizes
    assert sorted(packed.collect()) == sorted(corpus_pipeline.run(spark, DATA).collect())


def test_empty_documents_pass_all_stages(spark):
    docs = read(spark, DATA, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, DATA), name)
        assert docs.count() == 0


def test_odd_documents_pass_all_stages(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing names; each stage's stated result."""
    item = read(spark, DATA, "benchmark").first().text
    ws = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "klmnp"]
    line = [" ".join(ws[(k * 17 + j * 7) % 125] for j in range(12)) for k in range(60)]
    block = "\n".join(line[:6])
    rows = [
        (1, block, "en", "s", 10), (2, "own words here\n" + block, None, None, None), (3, block, "en", "s", 10), (None, block, "en", "s", 10),
        (4, None, "en", "s", 10), (None, None, None, None, None), (5, "", "en", "s", 0), (6, "", "en", "s", 0), (7, "\n".join(line[20:40]), "en", "s", 1),
        (7, "\n".join(line[20:40]), "en", "s", 1), (8, "x " * 300_000, "en", "s", 600_000), (9, line[50] + " " + item, "en", "s", 1),
        (None, line[51] + " " + item, "en", "s", 1), (10, line[52], "en", "s", 1), (10, line[53], "en", "s", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr(
        "*", "1 as key", "'x' as toxic", "2 as _id", "3 as _bad", "4 as group_id", "5 as _mark", "map('a', 1) as m"
    )

    def texts(d):
        return sorted(((-1 if r.doc_id is None else r.doc_id), r.text) for r in d.select("doc_id", "text").collect() if r.text is not None)

    steps = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = staged(stage(spark, docs, DATA), name)
        assert out.columns == docs.columns and out.filter("text is null").count() == 2
        steps.append(texts(out))
        docs = out
    plain = sorted((-1 if i is None else i, t) for i, t, *_ in rows if t is not None)
    assert steps[0] == plain
    assert steps[1] == sorted([x if x[0] != 2 else (2, "own words here") for x in plain if x[0] != 3])
    once = [x for k, x in enumerate(steps[1]) if x not in steps[1][:k] and not (x[0] == 10 and x[1] == max(line[52], line[53]))]
    assert steps[2] == once
    assert steps[3] == [x for x in once if item not in x[1]] and len(steps[3]) == len(once) - 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert sum(r.n_tokens for r in packed) == sum(len(t.encode()) + 1 for _, t in steps[3])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_return_rows(spark, name):
    assert __spark_entry__.queries()[name](spark, DATA).count() > 0 or name == "op2_benchmark_decontamination"
