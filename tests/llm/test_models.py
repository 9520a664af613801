"""Toxicity, resampling, language identification, nearest neighbours, HTML and WARC."""

import gzip
import io
import random
import re
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from onomast.llm import ann, htmlx, langid, queries, resample, textvec, toxicity, warc
from onomast.llm.common import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in rows], DOCS)
    return df.selectExpr("*", "1 as score", "'x' as toxic", "2 as h", "3 as predicted", "4 as family") if extra else df


def sentences(seed, n, words):
    r = random.Random(seed)
    return [" ".join(r.choice(words) for _ in range(r.randint(8, 20))) for _ in range(n)]


MILD = [f"{a}{b}" for a in ("ta", "ri", "mo", "ken", "lu") for b in ("sa", "pel", "dor", "vin", "ket")]


def insulted(seed, n):
    r = random.Random(seed)
    return [f"{s} {r.choice(['idiot', 'scum'])} {r.choice(['moron', 'trash'])}" for s in sentences(seed, n, MILD)]


# --- toxicity


def toxic_tables(spark):
    texts = [(t, 0) for t in sentences(1, 150, MILD)] + [(t, 1) for t in insulted(2, 50)]
    docs = table(spark, [(i, t, "en") for i, (t, _) in enumerate(texts)])
    return docs, spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(texts)], "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    model = toxicity.train(*toxic_tables(spark))
    fresh = [(i, t, "en") for i, t in enumerate(sentences(11, 60, MILD) + insulted(12, 60))]
    got = {r.doc_id: r.toxic for r in toxicity.score(table(spark, fresh), model).collect()}
    assert sum(got[i] for i in range(60)) <= 1 and sum(got[i] for i in range(60, 120)) >= 58


def test_swapped_identities_score_alike():
    """Labels that slight one group pull its term up; the penalty takes that back."""
    r = random.Random(4)
    texts, y = [], []
    for _ in range(600):
        term = r.choice(["muslims", "christians", "jews"])
        toxic = r.random() < (0.6 if term == "muslims" else 0.15)
        texts.append(f"{' '.join(r.choice(MILD) for _ in range(6))} {term}" + (" idiot" if toxic and r.random() < 0.5 else ""))
        y.append(int(toxic))
    t = textvec.tokenize(pa.array(texts))
    codes, _, offs = textvec.distinct(*toxicity.features(t))
    gaps = []
    probe = textvec.tokenize(pa.array(["we met some muslims", "we met some christians"]))
    for penalty in (0.0, 20.0):
        m = toxicity.fit(codes.astype(np.int32), offs, np.array(y), np.ones(len(y)), penalty)
        p = m.score(probe)
        gaps.append(abs(p[0] - p[1]))
    assert gaps[0] > 0.02 and gaps[1] < gaps[0] / 2


def slighted(n=400, seed=9):
    """Texts with identity terms, one of which is labelled toxic more often, and their features."""
    r = random.Random(seed)
    texts, y = [], []
    for _ in range(n):
        term = r.choice(["muslims", "christians", "jews", "hindus"])
        toxic = r.random() < (0.7 if term == "muslims" else 0.1)
        texts.append(f"{' '.join(r.choice(MILD) for _ in range(5))} {term}" + (" idiot scum" if toxic and r.random() < 0.4 else ""))
        y.append(int(toxic))
    return texts, np.array(y)


def fitted(texts, y, penalty):
    codes, _, offs = textvec.distinct(*toxicity.features(textvec.tokenize(pa.array(texts))))
    return toxicity.fit(codes.astype(np.int32), offs, y, np.ones(len(y)), penalty)


def logit(model, texts):
    p = model.score(textvec.tokenize(pa.array(texts)))
    return np.log(p / (1 - p))


def test_penalty_in_use_evens_out_neutral_mentions():
    """With the penalty as in production, a neutral mention of the slighted group is no false positive."""
    texts, y = slighted()
    group = toxicity.IDENTITY_GROUPS[2]
    neutral = {p: [fitted(texts, y, p).score(textvec.tokenize(pa.array([f"we met some {t} there"]))) [0] for t in group[:4]] for p in (0.0, toxicity.PENALTY)}
    assert neutral[0.0][0] > toxicity.THRESHOLD > neutral[toxicity.PENALTY][0]
    assert np.ptp(neutral[toxicity.PENALTY]) < 0.3 * np.ptp(neutral[0.0])
    m = fitted(texts, y, toxicity.PENALTY)
    assert logit(m, ["some muslims idiot scum"])[0] > logit(m, ["some muslims"])[0] + 1


def test_fit_is_the_optimum_over_swapped_sentences():
    """The loss written out over sentences whose term is swapped, minimised by Newton's method, is met."""
    texts, y = slighted(250, 3)
    m = fitted(texts, y, toxicity.PENALTY)

    def matrix(some):
        x = np.zeros((len(some), len(m.codes) + 1))
        x[:, -1] = 1
        for k, t in enumerate(some):
            have = np.unique(toxicity.features(textvec.tokenize(pa.array([t])))[0])
            x[k, :-1] = np.isin(m.codes, have)
        return x

    x, change = matrix(texts), []
    group = toxicity.IDENTITY_GROUPS[2]
    for t in texts:
        term = next(w for w in t.split() if w in group)
        change += [matrix([t.replace(term, o)])[0] - matrix([t])[0] for o in group if o != term]
    change, n = np.array(change), len(y)
    ridge = np.append(np.full(len(m.codes), toxicity.RIDGE), 0)

    def loss(w):
        z = x @ w
        return np.mean(np.logaddexp(0, z) - y * z) + (ridge * w * w).sum() / 2 + toxicity.PENALTY * ((change @ w) ** 2).sum() / n

    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (p - y) / n + ridge * w + 2 * toxicity.PENALTY * change.T @ (change @ w) / n
        hess = (x.T * (p * (1 - p))) @ x / n + np.diag(ridge) + 2 * toxicity.PENALTY * change.T @ change / n
        w = w - np.linalg.solve(hess + 1e-12 * np.eye(len(w)), grad)
    mine = loss(np.append(m.weights, m.bias))
    assert loss(w) - 1e-9 <= mine <= loss(w) + 0.003


def test_repeated_rows_dont_grow_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda codes, offs, y, *rest: seen.append((len(y), len(codes))))
    rows = table(spark, [(1, "zz", "en"), (1, "aa", "en"), (1, "aa", "en"), (2, "bb", "en")] * 50)
    toxicity.train(rows, spark.createDataFrame([(1, 0, 1), (2, 0, 0), (1, 0, 0)], "doc_id long, quality int, toxic int"))
    assert seen == [(2, 2)]


def test_toxicity_edges(spark):
    docs, labels = toxic_tables(spark)
    odd = table(spark, [(None, "idiot scum moron", "en"), (1, None, "en"), (2, "", None), (3, "idiot scum moron " * 9000, "en"), (3, "fine", "en"), (3, "fine", "en")], extra=True)
    rows = toxicity.score(odd, toxicity.train(docs, labels)).collect()
    assert len(rows) == 6 and {r.score for r in rows if r.doc_id == 1} == {None} and [r.toxic for r in rows if r.doc_id is None] == [True]
    kept = toxicity.keep_clean(docs.selectExpr("*", "1 as score", "'x' as toxic", "2 as codes"), labels)
    assert kept.columns[-3:] == ["score", "toxic", "codes"] and 145 <= kept.count() <= 152
    for some in (labels.limit(0), labels.filter("toxic = 0")):
        assert toxicity.keep_clean(docs, some).count() == 200
    assert toxicity.keep_clean(docs.limit(0), labels).count() == 0 == toxicity.score(docs.limit(0), toxicity.train(docs, labels)).count()


# --- resampling


def test_resampling(spark):
    junk = ["&&& ### $$$ " + "zz " * 12 for _ in range(60)]
    rows = [(i, t, "en") for i, t in enumerate(sentences(3, 240, MILD) + junk)]
    labels = spark.createDataFrame([(i, int(i < 240), 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows)
    got = resample.resample(docs, labels).collect()
    ids = {r.doc_id for r in got}
    assert len(got) == len(ids) == 240 and sum(i >= 240 for i in ids) <= 12
    every = sorted(resample.weights(docs, resample.log_ratio(docs, labels)).collect(), key=lambda r: (-r.key, r.doc_id))
    for k in (0, 1, 100, 299, 300, 400):
        assert {r.doc_id for r in resample.resample(docs, labels, k).collect()} == {r.doc_id for r in every[:k]}


def test_log_weights_by_hand(spark):
    """Counts of the n-grams themselves; so few are in buckets of their own."""
    rows = [(1, "a b"), (2, "b b!"), (3, None), (4, ""), (5, "A b, c"), (None, "a a")]
    docs = table(spark, [(i, t, "en") for i, t in rows])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (5, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")

    def grams(t):
        w = re.findall(r"[a-z]+|[^a-z ]+", t.lower())
        return Counter([*w, *zip(w, w[1:])])

    raw = sum((grams(t) for _, t in rows if t), Counter())
    target = grams("a b") + grams("a b, c")
    many = 1 << 18
    size = [sum(c.values()) + many for c in (raw, target)]
    got = {r.doc_id: r.log_weight for r in resample.weights(docs, resample.log_ratio(docs, labels, many=many)).collect()}
    want = {i: sum(n * (np.log((target[g] + 1) / size[1]) - np.log((raw[g] + 1) / size[0])) for g, n in grams(t).items()) for i, t in rows if t is not None}
    assert got == pytest.approx(want)


def test_each_row_has_its_own_noise(spark):
    """Null ids draw by their texts; ids that a double can't tell apart are told apart."""
    big = 2**60
    docs = table(spark, [(None, "x y", "en"), (None, "y x", "en"), (None, "x y", "en"), (big + 1, "good words", "en"), (big + 3, "bad", "en")])
    got = resample.weights(docs, np.zeros(16384)).collect()
    assert len({r.key for r in got}) == 4 and len({r.key for r in got if r.doc_id is None}) == 2
    labels = spark.createDataFrame([(big + 3, 1, 0)], "doc_id long, quality int, toxic int")
    ratio = resample.log_ratio(docs, labels)
    w = {r.doc_id: r.log_weight for r in resample.weights(docs, ratio).collect()}
    assert w[big + 3] > 0 > w[big + 1]


def test_buckets_grow_with_the_corpus(spark):
    assert resample.buckets(table(spark, [])) == 16384 == resample.buckets(table(spark, [(1, "x" * 1000, "en")]))
    assert resample.buckets(spark.range(40).selectExpr("repeat('x', 10000000) as text")) == 32768


def test_resampling_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = table(spark, [(None, "x", "en"), (1, "y y", "en"), (1, "y y", "en"), (2, "long " * 50_000, "en"), (3, None, "en")], extra=True)
    assert resample.resample(rows, none).count() == 4 and resample.resample(rows.limit(0), none).count() == 0


# --- languages

SPEECH = {"en": ["the", "and", "which", "thing", "with", "other"], "de": ["und", "nicht", "schön", "über", "werden", "ich"], "fr": ["être", "les", "où", "garçon", "vous", "eau"], "es": ["niño", "los", "ción", "allá", "usted", "que"]}


def test_languages_held_out(spark):
    rows = [(i * 10 + k, t, lang) for k, lang in enumerate(SPEECH) for i, t in enumerate(sentences(k, 60, SPEECH[lang]))]
    model = langid.train(table(spark, rows))
    assert model.machines == (("germanic", "romance"), ("de", "en"), ("es", "fr"))
    fresh = [(i * 10 + k, t, lang) for k, lang in enumerate(SPEECH) for i, t in enumerate(sentences(k + 50, 40, SPEECH[lang]))]
    got = {r.doc_id: r for r in langid.identify(table(spark, fresh, extra=True), model).collect()}
    assert sum(got[i].predicted == lang for i, _, lang in fresh) >= 157
    assert all(r.family == langid.FAMILIES[r.predicted] for r in got.values())
    odd = [(1, None, "en"), (2, "", None), (3, "...", "de"), (None, "the and which with", None), (5, "und nicht " * 40_000, None)]
    rest = {r.doc_id: r.predicted for r in langid.identify(table(spark, odd), model).collect()}
    assert rest == {1: None, 2: None, 3: None, None: "en", 5: "de"}


def test_machine_is_near_the_optimum():
    """The squared-hinge loss is that of Newton steps on the same loss."""
    r = np.random.default_rng(7)
    x = np.concatenate([r.normal(size=(60, 6)) + 0.4, r.normal(size=(90, 6)) - 0.4]).astype(np.float32)
    y = np.repeat([1.0, -1.0], [60, 90])
    vote = np.where(y > 0, 0.5 / 60, 0.5 / 90)

    def loss(w, b, reg=1e-4):
        return (vote * np.maximum(0, 1 - y * (x @ w + b)) ** 2).sum() + reg / 2 * w @ w

    z = np.column_stack([x, np.ones(len(x))]).astype(float)
    v = np.zeros(7)
    for _ in range(50):
        on = 1 - y * (z @ v) > 0
        reg = np.diag([1e-4] * 6 + [1e-12])
        v = np.linalg.solve(2 * (z[on].T * vote[on]) @ z[on] + reg, 2 * z[on].T @ (vote * y)[on])
    assert loss(*langid.svm(x, y)) <= loss(v[:6], v[6]) * 1.001 + 1e-6


def test_votes_by_trying_all_pairs():
    r = np.random.default_rng(3)
    names = ("a", "b", "c", "d")
    margin = {p: r.normal(size=200) for p in combinations(names, 2)}
    got = langid._vote(names, margin, 200)
    for k in range(200):
        won = {n: sum((margin[n, o][k] >= 0) if (n, o) in margin else (margin[o, n][k] < 0) for o in names if o != n) for n in names}
        total = {n: sum(margin[n, o][k] if (n, o) in margin else -margin[o, n][k] for o in names if o != n) for n in names}
        assert got[k] == max(names, key=lambda n: (won[n], total[n]))


def test_one_and_no_language(spark):
    one = langid.train(table(spark, [(1, "the and", "en"), (2, "the", "en")]))
    assert [r.predicted for r in langid.identify(table(spark, [(1, "xyz", None)]), one).collect()] == ["en"]
    none = langid.train(table(spark, []))
    assert [r.predicted for r in langid.identify(table(spark, [(1, "xyz", None)]), none).collect()] == [None]


def test_trigrams_stay_within_rows():
    a, offs = langid.trigrams(pa.array(["ab", "", "c d"]))
    b, _ = langid.trigrams(pa.array(["c d"]))
    assert offs.tolist() == [0, 2, 2, 5] and a[2:].tolist() == b.tolist()


# --- neighbours


def vectors(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r], 0) for i, r in zip(range(len(x)) if ids is None else ids, x)], "vec_id long, embedding array<float>, label int")


def test_footrule_by_products():
    r = np.random.default_rng(1)
    order = np.array([r.permutation(10)[:4] for _ in range(12)], np.int16)
    near = ann.footrule(order, order).astype(int)
    place = np.full((12, 10), 4)
    place[np.arange(12)[:, None], order] = np.arange(4)
    foot = np.abs(place[:, None] - place[None]).sum(-1)
    assert np.array_equal(foot, 2 * (4 + 3 + 2 + 1) - 2 * near)


@pytest.mark.parametrize("even", [True, False])
def test_recall(spark, even):
    r = np.random.default_rng(2)
    x = r.normal(size=(700, 24)) + (0 if even else 6 * r.normal(size=(12, 24))[r.integers(0, 12, 700)])
    x = x.astype(np.float32)
    d = ((x[:, None].astype(float) - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1)[:, :10]
    got: dict = {}
    rows = ann.neighbours(vectors(spark, x)).collect()
    for row in rows:
        got.setdefault(row.vec_id, {})[row.rank] = row
    hits = sum(len(set(want[i].tolist()) & {v.neighbour_id for v in got[i].values()}) for i in range(700))
    assert hits >= 0.9 * 7000 and all(row.distance == pytest.approx(d[row.vec_id, row.neighbour_id] ** 0.5, rel=1e-5) for row in rows[:200])
    assert all(v[k].distance <= v[k + 1].distance for v in got.values() for k in range(1, len(v)))


def test_blocks_agree(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(150, 8)).astype(np.float32)
    whole = sorted(ann.neighbours(vectors(spark, x), share=1.0).collect())
    monkeypatch.setattr(ann, "BLOCK", 40)
    assert sorted(ann.neighbours(vectors(spark, x), share=1.0).collect()) == whole


@pytest.mark.parametrize("block", [8192, 40])
def test_queries_of_some_ids_find_what_they_find_among_all(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    df = vectors(spark, np.random.default_rng(4).normal(size=(300, 8)).astype(np.float32), range(-30, 270))
    some = sorted(ann.neighbours(df, every=3).collect())
    assert some == sorted(r for r in ann.neighbours(df).collect() if r.vec_id % 3 == 0) and len(some) == 1000
    assert ann.neighbours(df.filter("vec_id % 3 <> 0"), every=3).count() == 0


def test_op8_asks_for_every_fiftieth_id_and_searches_all(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(3000, 16)).astype(np.float32)
    vectors(spark, x).write.parquet(str(tmp_path / "embeddings.parquet"))
    got: dict = {}
    for r in queries.op8_permutation_index(spark, str(tmp_path)).collect():
        got.setdefault(r.vec_id, set()).add(r.neighbour_id)
    assert set(got) == set(range(0, 3000, 50)) and all(len(v) == 10 for v in got.values())
    d = ((x[::50, None].astype(float) - x[None]) ** 2).sum(-1)
    d[np.arange(60), np.arange(0, 3000, 50)] = np.inf
    want = np.argsort(d, axis=1)[:, :10]
    assert sum(len(got[50 * k] & set(w)) for k, w in enumerate(want.tolist())) >= 0.9 * 600


def test_neighbour_edges(spark):
    rows = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [1.0, None]), (None, [1.0, 1.0]), (8, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "2 as block", "3 as n")
    got = {(r.vec_id, r.rank): (r.neighbour_id, round(r.distance, 3)) for r in ann.neighbours(df).collect()}
    assert got == {(1, 1): (2, 0.0), (1, 2): (8, 6.403), (2, 1): (1, 0.0), (2, 2): (8, 6.403), (8, 1): (1, 6.403), (8, 2): (2, 6.403)}
    assert ann.neighbours(df.limit(0)).count() == 0 == ann.neighbours(df.filter("vec_id = 1")).count()


def test_huge_and_infinite_vectors(spark):
    x = [[1e31, 0.0], [2e31, 0.0], [4e31, 0.0], [0.0, 1e31], [-1e38, 1e38]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)] + [(9, [float("inf"), 0.0]), (10, [float("-inf"), 0.0])], "vec_id long, embedding array<float>")
    got = {(r.vec_id, r.rank): (r.neighbour_id, r.distance) for r in ann.neighbours(df, 2).collect()}
    assert len(got) == 10 and got[0, 1] == (1, pytest.approx(1e31, rel=1e-6)) and got[2, 1][0] == 1 and got[0, 2] == (3, pytest.approx(2**0.5 * 1e31, rel=1e-6))


def test_ties_go_to_the_lesser_ids():
    r = np.random.default_rng(8)
    ids = r.permutation(60)
    x = np.ones((60, 4), np.float32)
    order = np.zeros((60, 3), np.int32) + np.arange(3, dtype=np.int32)
    q, n, d = ann._nearest(ids, x, order, ids, x, order, 10, 0.5)
    for i in range(60):
        assert n[q == i].tolist() == [k for k in range(11) if k != i][:10]
    assert not d.any()


def test_fewer_pairs_than_all():
    """The pairs met grow slower than all pairs."""
    met = []
    for n in (2000, 50_000, 10**6, 10**9):
        pivots, lists = ann.sizes(n)
        met.append(lists**2 / pivots)
    assert all(b < 0.62 * a for a, b in zip(met, met[1:])) and met[1] < 0.42


# --- HTML


def page(r, article=True):
    def p():
        return "<p>" + ". ".join(" ".join(r.choice(MILD) for _ in range(9)) for _ in range(3)) + ".</p>"

    body = "".join(p() for _ in range(r.randint(2, 6)))
    tag = "article" if article else "div"
    return f'<html><head><style>p</style></head><body><nav><ul>{"".join(f"<li><a href=x>{r.choice(MILD)}</a></li>" for _ in range(6))}</ul></nav><{tag}><h1>Title</h1>{body}</{tag}><footer>&copy; {r.choice(MILD)}</footer></body></html>'


def test_extraction_held_out(spark):
    r = random.Random(1)
    train = spark.createDataFrame([(i, "u", page(r)) for i in range(60)], "page_id long, url string, html string")
    trees = htmlx.train(train)
    fresh = [(i, "u", page(r, article=False)) for i in range(40)] + [(90, None, None), (91, "u", ""), (None, "u", "plain words"), (92, "u", "<div>" * 3000 + "deep" + "<p>" * 50)]
    df = spark.createDataFrame(fresh, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as nodes")
    got = {x.page_id: x for x in htmlx.extract(df, trees).collect()}
    right = [got[i].text.startswith("Title\n") and "©" not in got[i].text for i in range(40)]
    assert sum(right) >= 38 and got[90].text is None and got[91].text == "" and len(got) == 44
    assert htmlx.extract(df.limit(0), trees).count() == 0
    everything = htmlx.extract(df.filter("page_id = 0"), htmlx.train(train.limit(0))).collect()[0]
    assert "©" in everything.text


def test_parse():
    d = htmlx.parse("<ul><li>a<li>b</ul><p>x<b>y<div>z</div><!-- <p> --><script>if (a<b) {}</script><br>q</nope>&amp;<")
    assert d.tag == ["#root", "ul", "li", "li", "p", "b", "div", "br"] and d.parent == [-1, 0, 1, 1, 0, 4, 0, 0]
    assert htmlx.assemble(d, np.ones(len(d.tag), bool)) == "a\nb\nx y\nz\nq &<"
    assert htmlx.parse("<" * 50_000).end == [1] and htmlx.parse('<a "' * 20_000)


def test_parsing_and_decoding_take_time_in_proportion():
    """Two megabytes of unknown ends, of open inline elements before blocks, and of text in deep inline elements."""
    for html in ("<div>" * 20_000 + "</x>" * 400_000, "<b>" * 100_000 + "<hr>" * 300_000, "<div><b>" * 2 + "<i>w" * 400_000, "<p>" * 300_000, "<ul>" + "<li><b>" * 200_000):
        began = time.perf_counter()
        d = htmlx.parse(html)
        x, own = htmlx.features(d)
        htmlx.assemble(d, htmlx.decode(d, np.ones(len(own)), own))
        assert time.perf_counter() - began < 30


def test_attribute_tokens_of_the_same_letters_differ():
    rows = [htmlx.features(htmlx.parse(f'<p class="{c}">x</p>'))[0][1] for c in ("dates", "sated", "dates")]
    assert (rows[0] == rows[2]).all() and (rows[0] != rows[1]).any()


def test_sample_of_pages_is_the_least_hashed(spark, monkeypatch):
    r = random.Random(3)
    df = spark.createDataFrame([(i, "u", page(r)) for i in range(300)], "page_id long, url string, html string")
    seen = []
    monkeypatch.setattr(htmlx, "boost", lambda x, y, w: seen.append((x.shape, float(x.sum()))))
    for parts in (1, 7):
        htmlx.train(df.repartition(parts), 40)
    assert seen[0] == seen[1]
    want = df.withColumn("h", F.shiftrightunsigned(F.xxhash64("page_id", "html"), 11)).orderBy("h").limit(40).collect()
    assert seen[0][0][0] == sum(int((htmlx.features(htmlx.parse(p.html))[1] > 0).sum()) for p in want)


def test_decoding_is_best_and_consistent():
    r = np.random.default_rng(5)
    for _ in range(60):
        n = 7
        parent = [-1] + [int(r.integers(0, k)) for k in range(1, n)]
        order = []
        stack = [0]
        while stack:  # renumber in document order
            v = stack.pop()
            order.append(v)
            stack += [k for k in range(n - 1, 0, -1) if parent[k] == v]
        new = {v: k for k, v in enumerate(order)}
        up = [-1] * n
        for v in range(1, n):
            up[new[v]] = new[parent[v]]
        end = [k + 1 for k in range(n)]
        for k in range(n - 1, 0, -1):
            end[up[k]] = max(end[up[k]], end[k])
        dom = htmlx.Dom(["div"] * n, up, end, [0] * n, [""] * n, [[]] * n, [0] * n, 0)
        own, margin = r.integers(1, 50, n).astype(float), r.normal(size=n) * 2
        got = htmlx.decode(dom, margin, own)
        p = 1 / (1 + np.exp(-margin))
        yes, no = np.log1p(own) * np.log(p), np.log1p(own) * np.log(1 - p)

        def best(v):
            pure = [sum(x[v : end[v]]) - htmlx.SWITCH for x in (yes, no)]
            kids = [k for k in range(v + 1, end[v]) if up[k] == v]
            return max(*pure, max(yes[v], no[v]) + sum(best(k) for k in kids))

        # the value of what was chosen, by the cheapest way of writing it
        def value(v):
            mine = got[v : end[v]]
            kids = [k for k in range(v + 1, end[v]) if up[k] == v]
            mixed = (yes[v] if got[v] else no[v]) + sum(value(k) for k in kids)
            return max(mixed, (sum(yes[v : end[v]]) if mine[0] else sum(no[v : end[v]])) - htmlx.SWITCH) if mine.all() or not mine.any() else mixed

        assert value(0) == pytest.approx(best(0))


def test_boosting_learns():
    r = np.random.default_rng(6)
    x = r.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    t = htmlx.boost(x[:2000], y[:2000], np.ones(2000))
    assert ((t.margin(x[2000:]) > 0) == y[2000:]).mean() > 0.95


# --- WARC


def test_round_trip(spark):
    rows = [(1, "http://a/é", "<p>ü</p>"), (2, None, ""), (3, "x\ny", "WARC/1.0\r\n\r\n" * 50), (4, "u", None), (None, "v", "z" * 300_000), (5, "u", "<p>"), (5, "u", "<p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as headers", "2 as payload")
    got = sorted(map(str, map(tuple, warc.round_trip(df, new_path(spark, "w")).collect())))
    assert got == sorted(map(str, [(i, None if u is None else " ".join(u.splitlines()), h) for i, u, h in rows if h is not None]))
    assert warc.round_trip(df.limit(0), new_path(spark, "w")).count() == 0


def test_predicates(spark):
    path = new_path(spark, "w")
    df = spark.createDataFrame([(i, f"http{'s' if i % 2 else ''}://h/{i}", f"<p>{i}</p>") for i in range(20)], "page_id long, url string, html string")
    warc.write_warc(warc.page_records(df), path)
    every = warc.read_warc(spark, path)
    assert every.count() == 60 and every.filter("warc_type = 'response'").count() == 20 and every.count() == 60
    for cond in ("warc_type = 'request'", "warc_type in ('metadata', 'request') and target_uri like 'https%'", "http_status = 200", "http_status is null", "content_length > 90 and warc_type <> 'metadata'", "target_uri = 'http://h/4' and warc_type = 'response'"):
        assert sorted(map(str, warc.scan(spark, path, cond).select("record_id").collect())) == sorted(map(str, every.select("*").filter(F.expr(cond)).select("record_id").collect()))
    assert {r.payload for r in warc.scan(spark, path, "warc_type = 'response'", payload="false").collect()} == {None}
    warc.write_warc(warc.page_records(df.limit(1)), path, "overwrite")
    assert warc.read_warc(spark, path).count() == 3


def test_skipped_payloads_are_not_decoded(monkeypatch):
    raw = b"".join(warc.encode(k, "u", None, "application/http; msgtype=response", b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(b"body")) for k in ("response", "revisit", "response"))
    seen = []
    monkeypatch.setattr(warc, "body", lambda b, h: seen.append(1) or b)
    got = list(warc.records(io.BytesIO(raw), False, lambda c, v: c != "warc_type" or v == "revisit"))
    assert len(got) == 1 and not seen
    got = list(warc.records(io.BytesIO(raw), False, lambda c, v: c != "http_status" or v == 404))
    assert [r[0] for r in got] == [] and not seen


@pytest.mark.parametrize("zipped", [False, True, "one"])
def test_odd_files(zipped):
    records = [warc.encode("response", "u", None, "application/http; msgtype=response", b"HTTP/1.0 404 Not Found\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nWiki\r\n5\r\npedia\r\n0\r\n\r\n"), warc.encode("resource", None, None, "text/plain", b"x" * 700_000), warc.encode("response", "u", None, "application/http; msgtype=response", b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(b"hello"))]
    raw = gzip.compress(b"".join(records)) if zipped == "one" else b"".join(gzip.compress(r) if zipped else r for r in records)
    got = list(warc.records(io.BytesIO(raw), bool(zipped)))
    assert [(r[0], r[7], r[9][:9] if r[0] == "response" else len(r[9])) for r in got] == [("response", 404, b"Wikipedia"), ("resource", None, 700_000), ("response", 200, b"hello")]
    assert [r[9] for r in warc.records(io.BytesIO(raw), bool(zipped), lambda c, v: c != "http_status" or v == 200)] == [b"hello"]
    assert list(warc.records(io.BytesIO(b""), False)) == [] and list(warc.records(io.BytesIO(b"junk\n"), False)) == []
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"junk\n"), False, failfast=True))


WHOLE = warc.encode("response", "u", None, "application/http; msgtype=response", b"HTTP/1.1 200 OK\r\n\r\nbody")


@pytest.mark.parametrize("raw, zipped", [
    (gzip.compress(WHOLE) + b"bytes that are no member", True),
    (gzip.compress(WHOLE) + b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03" + b"\xff" * 60, True),
    (gzip.compress(WHOLE) + gzip.compress(WHOLE)[:-20], True),
    (gzip.compress(WHOLE + WHOLE[:-20]), True),
    (WHOLE + WHOLE[:-20], False),
    (WHOLE + WHOLE.replace(b"Content-Length: ", b"Content-Length: 9" + b"9" * 30), False),
    (WHOLE + WHOLE.replace(b"Content-Length: ", "Content-Length: ²".encode()), False),
    (WHOLE + WHOLE.replace(b"Content-Length: ", b"Content-Length: -"), False),
    (WHOLE + b"junk\n", False),
])
@pytest.mark.parametrize("wanted", [lambda c, v: True, lambda c, v: c != "warc_type" or v == "request"])
def test_damaged_files(raw, zipped, wanted):
    """The records before the damage are given; failfast raises, whether payloads are read or skipped."""
    some = 1 if wanted("warc_type", "response") else 0
    assert len(list(warc.records(io.BytesIO(raw), zipped, wanted))) == some
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(raw), zipped, wanted, failfast=True))


def test_odd_but_sound_files():
    odd = WHOLE.replace(b"200 OK", b"99999999999 X")
    odd = odd.replace(b"Content-Length: %d" % len(b"HTTP/1.1 200 OK\r\n\r\nbody"), b"Content-Length: %d" % len(b"HTTP/1.1 99999999999 X\r\n\r\nbody"))
    got = list(warc.records(io.BytesIO(odd + WHOLE), False, failfast=True))
    assert [(r[7], r[9]) for r in got] == [(None, b"body"), (200, b"body")]
    padded = gzip.compress(WHOLE) + b"\0" * 300_000 + gzip.compress(WHOLE) + b"\0" * 1000
    assert len(list(warc.records(io.BytesIO(padded), True, failfast=True))) == 2
    assert warc.uri("s3a://bucket/a b") == "s3://bucket/a b" and warc.uri("/tmp/x") == "file:///tmp/x" and warc.uri("file:/x") == "file:/x" and warc.uri("hdfs://h/x") == "hdfs://h/x"


def test_damaged_files_in_spark(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(WHOLE) + b"no member")
    (tmp_path / "b.warc").write_bytes(WHOLE + WHOLE)
    assert warc.read_warc(spark, str(tmp_path)).count() == 3
    with pytest.raises(Exception, match="gzip member"):
        warc.read_warc(spark, str(tmp_path), mode="failfast").count()


def test_toxicity_fits_on_twenty_thousand_labels(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(toxicity, "fit", lambda codes, offs, toxic, *rest: fitted.append(len(toxic)))
    texts = spark.range(21_000).selectExpr("id as doc_id", "concat('word', id) as text")
    toxicity.train(texts, spark.range(21_000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic"))
    assert fitted == [20_000]
