"""Line dedup, near-dedup, decontamination and packing."""

import random
import time
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from onomast.llm import decontam, linededup, neardup, packing, textvec
from onomast.llm.common import staged

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
    return df.selectExpr("*", "1 as key", "'x' as a", "2 as _id", "3 as `gone`", "4 as group_id", "5 as rank") if extra else df


def prose(seed, words=120, line=12):
    r = random.Random(seed)
    ws = ["".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9))) for _ in range(words)]
    return "\n".join(" ".join(ws[k : k + line]) for k in range(0, words, line))


# --- patience diff


def test_patience():
    assert linededup.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert linededup.patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]
    assert linededup.patience([1, 2], [2, 1]) in ([(0, 1)], [(1, 0)])
    assert linededup.patience([], [1]) == [] and linededup.patience([5, 5, 5], [5, 5]) == [(0, 0), (1, 1)]


def test_patience_is_a_common_subsequence():
    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.randrange(8) for _ in range(r.randrange(12))] for _ in range(2))
        got = linededup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and got == sorted(got) and len({j for _, j in got}) == len({i for i, _ in got}) == len(got)
        assert all(p[1] < q[1] for p, q in zip(got, got[1:]))


def patience_by_definition(a, b):
    """Equal ends, then a longest rising choice of lines unique on both sides, then each gap; the number of lines aligned at this level comes from trying all choices."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    m = 0
    while m < min(len(a), len(b)) - n and a[-1 - m] == b[-1 - m]:
        m += 1
    x, y = a[n : len(a) - m], b[n : len(b) - m]
    once = [(i, y.index(v)) for i, v in enumerate(x) if x.count(v) == 1 == y.count(v)]
    best = []
    for size in range(len(once), 0, -1):
        best = [c for c in combinations(once, size) if all(p[1] < q[1] for p, q in zip(c, c[1:]))]
        if best:
            break
    if not best:
        return {tuple((i, i) for i in range(n)) + tuple((len(a) - m + k, len(b) - m + k) for k in range(m))}
    out = set()
    for chosen in best:
        ways = [()]
        for (i, j), (p, q) in zip([(-1, -1), *chosen], [*chosen, (len(x), len(y))]):
            gaps = patience_by_definition(x[i + 1 : p], y[j + 1 : q])
            ways = [w + tuple((i + 1 + u + n, j + 1 + v + n) for u, v in g) for w in ways for g in gaps]
        for w in ways:
            out.add(tuple(sorted({(i, i) for i in range(n)} | {(i + n, j + n) for i, j in chosen} | set(w) | {(len(a) - m + k, len(b) - m + k) for k in range(m)})))
    return out


def test_patience_is_one_of_the_alignments_by_definition():
    r = random.Random(12)
    some = 0
    for _ in range(400):
        a, b = ([r.randrange(1, 10) for _ in range(r.randrange(10))] for _ in range(2))
        want = patience_by_definition(a, b)
        assert tuple(linededup.patience(a, b)) in want
        some += any(want)
    assert some > 200


def test_blank_lines_do_not_end_a_block():
    a = [1, 2, 3, 4]
    b = [9, 1, None, 2, None, None, 3, 8, 4]
    assert linededup.common_blocks(a, b, [7, 7, 0, 7, 0, 0, 7, 7, 7]) == [1, 3, 6]
    assert linededup.common_blocks(b, a, [7, 7, 7, 7]) == [0, 1, 2] and linededup.common_blocks([], a, [7] * 4) == []


def lines_by_hand(rows):
    """The result by comparing every pair of documents that share a rare run."""
    def hashed(t):
        return [x.strip() or None for x in t.split("\n")]

    out = {}
    first = {}
    for i, t in rows:
        ls = hashed(t)
        ws = [len(x.split()) if x else 0 for x in ls]
        runs = set()
        full = [k for k, x in enumerate(ls) if x]
        for at, k in enumerate(full):
            n, key = ws[k], [ls[k]]
            while n < linededup.RUN_WORDS and (at := at + 1) < len(full):
                n += ws[full[at]]
                key.append(ls[full[at]])
            if n >= linededup.RUN_WORDS:
                runs.add(tuple(key))
        gone = set()
        for other in {first[x] for x in runs if x in first}:
            gone.update(linededup.common_blocks(hashed(dict(rows)[other]), ls, ws))
        for x in runs:
            first.setdefault(x, i)
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        if not gone or left.strip():
            out[i] = left
    return out


def test_line_dedup_against_all_pairs(spark):
    passage = prose(99, 60, 15)
    short = "\n".join(" ".join(prose(98, 12, 12).split()[k : k + 3]) for k in range(0, 12, 3))
    rows = []
    for i in range(40):
        own = prose(i, 60)
        rows.append((i, own + "\n" + passage + "\nEnd." if i % 3 == 0 else short + "\n" + own if i % 5 == 0 else "Head.\n" + own))
    rows += [(50, rows[0][1]), (51, "Head."), (52, "End.\n" + rows[1][1].replace("\n", "\n\n"))]
    got = {r.doc_id: r.text for r in linededup.line_dedup(docs(spark, rows)).collect()}
    assert got == lines_by_hand(rows)
    assert 50 not in got and got[51] == "Head." and passage in got[0] and passage.split("\n")[1] not in got[3]


def lines_against_all_earlier(rows):
    """The result by aligning every document with each earlier one."""
    split = {i: [x.strip() or None for x in t.split("\n")] for i, t in rows}
    out = {}
    for at, (i, t) in enumerate(rows):
        ws = [len(x.split()) if x else 0 for x in split[i]]
        gone = set().union(*(linededup.common_blocks(split[o], split[i], ws) for o, _ in rows[:at]))
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        if not gone or left.strip():
            out[i] = left
    return out


@pytest.mark.parametrize("holders", [2, 64])
def test_line_dedup_against_all_earlier_documents(spark, monkeypatch, holders):
    """Passages that cross, that one text repeats or that end in short lines; frequent and rare."""
    monkeypatch.setattr(linededup, "RARE_HOLDERS", holders)
    parts = [prose(900 + k, 24) for k in range(4)] + [prose(910, 12) + "\nshort\nend", prose(910, 12) + "\nshort\nlast", "a b\n" + prose(911, 12)]
    r = random.Random(5)
    rows = [(0, parts[0] + "\n" + prose(0, 36) + "\n" + parts[1]), (1, prose(1, 36) + "\n" + parts[1]), (2, parts[0] + "\n" + prose(2, 36))]
    rows.append((3, parts[1] + "\n" + prose(3, 36) + "\n" + parts[0]))
    for i in range(4, 60):
        some = [parts[r.randrange(len(parts))] for _ in range(r.randint(1, 4))]
        rows.append((i, "\n".join([x for p in some for x in (p, prose(1000 + 10 * i + len(p), 24))])))
    want = lines_against_all_earlier(rows)
    got = {x.doc_id: x.text for x in linededup.line_dedup(docs(spark, rows)).collect()}
    assert got[3] == prose(3, 36)
    assert got == want


def test_line_dedup_edges(spark):
    body = prose(1)
    rows = [(None, body), (1, None), (2, ""), (3, body), (3, body), (4, body + "\nmore words here"), (5, prose(7, 20_000)), (6, "   \n\n")]
    got = linededup.line_dedup(docs(spark, rows, extra=True))
    assert got.columns[-6:] == ["key", "a", "_id", "gone", "group_id", "rank"]
    kept = sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in got.collect())
    assert len(kept) == 8 and [r.text for r in got.collect() if r.doc_id == 4] == ["more words here"]
    assert all(r.n_chars == len(r.text) for r in got.filter("text is not null").collect())
    assert linededup.line_dedup(docs(spark, [])).count() == 0


def test_line_dedup_of_very_many_lines(spark):
    """A copy of 200,000 lines goes in seconds, and what is new in it stays."""
    lines = [f"line {k} of a text that has very many lines that differ all" for k in range(200_000)]
    df = docs(spark, [(1, "\n".join(lines)), (2, "\n".join([*lines[:150_000], "new", *lines[150_000:]]))])
    began = time.perf_counter()
    got = {r.doc_id: r.text for r in linededup.line_dedup(df).collect()}
    assert got == {1: "\n".join(lines), 2: "new"} and time.perf_counter() - began < 60


def shuffle_bytes(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


@pytest.mark.parametrize("words", [1, 1 << 20])
def test_texts_that_lose_nothing_are_not_shuffled(spark, monkeypatch, words):
    """A few copies among large texts: the join with what they lose moves them alone, or more where flags are few; the result is the same."""
    monkeypatch.setattr(linededup, "WORDS", words, raising=False)
    rows = [(k, prose(7000 + k, 600)) for k in range(200)]
    rows += [(1000 + k, rows[k][1] + "\nsome words of its own") for k in range(4)] + [(None, rows[0][1]), (2000, None)]
    df = docs(spark, rows).repartition(4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = linededup.line_dedup(staged(df, "documents"))
        before = shuffle_bytes(spark)
        kept = {(r.doc_id, r.text) for r in got.collect()}
        moved = shuffle_bytes(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert kept == {(i, "some words of its own" if 1000 <= (i or 0) < 2000 else t) for i, t in rows}
    if words > 1:
        assert moved < 0.1 * sum(len(t) for _, t in rows if t)


# --- near-dedup


def copies(seed, n, share):
    r = random.Random(seed)
    base = prose(seed, 200).split(" ")
    out = [" ".join(base)]
    for _ in range(n):
        out.append(" ".join(w if r.random() > share else f"new{r.randrange(10**6)}" for w in base))
    return out


def test_shared_bytes():
    r = np.random.default_rng(1)
    d = r.integers(0, 2**64, 500, dtype=np.uint64) & r.choice(np.array([0xFF, 0xFF00FF, 2**64 - 1, 0x0101010101010101], np.uint64), 500)
    assert neardup._zero_bytes(d).tolist() == (d.view(np.uint8).reshape(-1, 8) == 0).sum(1).tolist()


def test_every_pair_within_the_radius_meets_in_a_list():
    """Any 16 - RADIUS shared positions hold a posted pair of positions."""
    r = random.Random(3)
    posted = set(neardup._PAIRS)
    for _ in range(2000):
        same = sorted(r.sample(range(16), neardup.MINIMUM))
        assert any((x, y) in posted for k, x in enumerate(same) for y in same[k + 1 :])


def brute_groups(df):
    fp = neardup.fingerprints(df).dropna().distinct().toPandas()
    ids, f = fp.doc_id.to_numpy(), fp[["a0", "a1", "b0", "b1"]].to_numpy().astype(np.int64).view(np.uint64)
    bits = np.bitwise_count(f[:, None, :] ^ f[None, :, :]).astype(int)
    near = (bits[..., :2].sum(-1) <= neardup.RADIUS) & (bits[..., 2:].sum(-1) <= neardup.CHECK)
    from onomast.llm.common import forest

    return dict(zip(*(x.tolist() for x in forest(*(ids[k] for k in np.nonzero(near))))))


def test_groups_against_all_pairs(spark):
    rows = [(k * 1000 + j, t) for k in range(6) for j, t in enumerate(copies(k, 8, 0.03))]
    rows += [(9000 + j, t) for j, t in enumerate(copies(77, 320, 0.04))] + [(20_000 + k, prose(500 + k, 80)) for k in range(60)] + [(30_000, rows[0][1])]
    df = docs(spark, rows)
    got = {r.doc_id: r.group_id for r in neardup.groups(df).collect()}
    want = brute_groups(df)
    assert got == want and got[30_000] == 0 and all(got[20_000 + k] == 20_000 + k for k in range(60))
    assert sum(got[k * 1000 + j] == k * 1000 for k in range(6) for j in range(9)) >= 50
    kept = {r.doc_id for r in neardup.near_dedup(df).collect()}
    assert kept == {d for d, g in got.items() if d == g}


def test_long_lists_keep_their_components():
    r = np.random.default_rng(4)
    base = r.integers(0, 2**64, (3, 4), dtype=np.uint64)
    fp = base[r.integers(0, 3, 2500)]
    flip = np.uint64(1) << r.integers(0, 64, (2500, 4)).astype(np.uint64)
    fp = fp ^ flip
    ids = np.arange(2500)
    from onomast.llm.common import forest

    a, b = (np.concatenate(x) for x in zip(*neardup._search(ids, fp)))
    assert len(set(forest(a, b)[1].tolist())) == 3


def test_near_dedup_edges(spark):
    t = prose(5)
    rows = [(None, t), (None, t), (1, None), (2, ""), (3, "..."), (4, t), (4, t), (5, t), (6, prose(8, 30_000)), (7, "word"), (8, "word")]
    got = neardup.near_dedup(docs(spark, rows, extra=True))
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got.collect()) == [-1, -1, 1, 2, 3, 4, 6, 7]
    assert got.columns[-6:] == ["key", "a", "_id", "gone", "group_id", "rank"]
    assert neardup.groups(docs(spark, [])).count() == 0 == neardup.near_dedup(docs(spark, [])).count()


def test_of_repeated_ids_the_least_row_stays(spark):
    t = prose(5)
    df = spark.createDataFrame([(1, t, "b", 2), (1, t, "a", 9), (1, t, "a", 3), (2, None, "x", 1), (2, "z", "x", 0), (3, "w w", "x", 1)], "doc_id long, text string, source string, n int")
    for parts in (1, 5):
        got = sorted((r.doc_id, r.text, r.source, r.n) for r in neardup.near_dedup(df.repartition(parts)).collect())
        assert got == [(1, t, "a", 3), (2, None, "x", 1), (3, "w w", "x", 1)]


# --- decontamination


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def hand_matches(docs_rows, item_rows):
    """Weighted Jaccard of every item with every window of its length, without fingerprints."""
    tok = {d: textvec.tokenize(pa.array([t])).hash for d, t in docs_rows}
    item = {i: textvec.tokenize(pa.array([t])).hash for i, t in item_rows}
    sets = {d: {int(x) for n in (1, 2, 3) for x in decontam.item_shingles(h, n)} for d, h in tok.items()}
    shing = {i: {int(x) for x in decontam.item_shingles(h)} for i, h in item.items()}
    n = len(docs_rows)
    weight = {v: np.log((1 + n) / (1 + sum(v in s for s in sets.values()))) + 1e-3 for v in set().union(*sets.values(), *shing.values())}
    out = {}
    for d, h in tok.items():
        for i, g in item.items():
            size = min(len(g), len(h))
            for lo in range(len(h) - size + 1 if size else 0):
                w = {int(x) for x in decontam.item_shingles(h[lo : lo + size])}
                sim = sum(weight[x] for x in w & shing[i]) / sum(weight[x] for x in w | shing[i])
                if sim >= decontam.SIMILARITY:
                    out[d, i] = max(out.get((d, i), 0), sim)
    return out


def test_matches_against_all_windows(spark):
    bench = [(k, prose(1000 + k, 18 + k, 9)) for k in range(8)] + [(50, "two words"), (51, "")]
    r = random.Random(1)

    def worn(text, share):
        return " ".join(w if r.random() > share else f"zz{r.randrange(999)}" for w in text.split())

    rows = [(k, prose(k, 90)) for k in range(20)]
    rows += [(100 + k, prose(200 + k, 40) + " " + worn(bench[k % 8][1], (k // 8) * 0.03) + " " + prose(300 + k, 30)) for k in range(24)]
    rows += [(200, bench[3][1]), (201, " ".join(bench[4][1].split()[:-3])), (202, "two words"), (203, "")]
    want = hand_matches(rows, bench[:9])
    got = {(m.doc_id, m.item_id): m for m in decontam.matches(docs(spark, rows), items(spark, bench)).collect()}
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)  # the fingerprint radius may pass over weak ones
    # the most similar window may lie outside the radius, another one within it
    assert all(got[k].similarity <= want[k] + 1e-9 and got[k].distance <= decontam.RADIUS for k in got)
    assert sum(got[k].similarity == pytest.approx(want[k]) for k in got) >= 0.8 * len(got)
    assert all(got[100 + k, k].similarity == pytest.approx(1) and got[100 + k, k].first_word == 40 for k in range(8))
    assert {(100 + k, k) for k in range(8)} <= set(got) and (200, 3) in got and (202, 50) in got
    clean = {x.doc_id for x in decontam.decontaminate(docs(spark, rows), items(spark, bench)).collect()}
    assert clean == {d for d, _ in rows} - {d for d, _ in got}
    sliced = decontam.matches(docs(spark, rows), items(spark, bench), slice_items=3).collect()
    assert {(m.doc_id, m.item_id) for m in sliced} >= {(100 + k, k) for k in range(8)}


def test_edited_copies_weigh_by_true_frequencies(spark):
    """An edited item that many documents hold: the trigrams round the change aren't rarer than the others."""
    words = prose(1501, 20, 20).split()
    edited = " ".join([*words[:10], "changed", *words[11:]])
    rows = [(k, prose(3000 + k, 40)) for k in range(360)] + [(1000 + k, prose(4000 + k, 20) + " " + edited + " " + prose(5000 + k, 20)) for k in range(40)]
    tok = {d: textvec.tokenize(pa.array([t])).hash for d, t in rows}
    item = {int(x) for x in decontam.item_shingles(textvec.tokenize(pa.array([" ".join(words)])).hash)}
    sets = {d: {int(x) for x in decontam.item_shingles(h)} for d, h in tok.items()}
    weight = {v: np.log(401 / (1 + sum(v in s for s in sets.values()))) + 1e-3 for v in item.union(*(sets[1000 + k] for k in range(40)))}
    want = {}
    for d in range(1000, 1040):
        sims = []
        for lo in range(len(tok[d]) - 19):
            w = {int(x) for x in decontam.item_shingles(tok[d][lo : lo + 20])}
            sims.append(sum(weight[x] for x in w & item) / sum(weight[x] for x in w | item))
        want[d] = max(sims)
    got = {m.doc_id: m.similarity for m in decontam.matches(docs(spark, rows), items(spark, [(1, " ".join(words))])).collect()}
    assert min(want.values()) >= decontam.SIMILARITY and got == pytest.approx(want)


def test_blocks_miss_nothing_within_the_radius():
    r = random.Random(9)
    hashes = [np.unique(np.array([r.getrandbits(64) for _ in range(30)], np.uint64)) for _ in range(20)]
    vocab = np.unique(np.concatenate(hashes))
    b = decontam.Benchmark(list(range(20)), [40] * 20, hashes, vocab, np.ones(len(vocab)), 1.0)
    own = [decontam.simhash(h, np.ones(len(h))) for h in hashes]
    for _ in range(300):
        i = r.randrange(20)
        fp = own[i] ^ sum(1 << k for k in r.sample(range(64), r.randint(0, decontam.RADIUS + 2)))
        assert dict(b.candidates(fp, 40)) == {k: (o ^ fp).bit_count() for k, o in enumerate(own) if (o ^ fp).bit_count() <= decontam.RADIUS}


def test_matches_edges(spark):
    t = prose(3, 30)
    rows = [(None, t), (1, None), (2, ""), (3, "..."), (4, t), (4, t), (5, prose(4, 20_000) + " " + t)]
    got = decontam.matches(docs(spark, rows, extra=True), items(spark, [(1, t), (1, t), (2, None), (None, t), (3, "")]))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in got.collect()) == [(-1, 1), (4, 1), (5, 1)]
    assert decontam.matches(docs(spark, []), items(spark, [(1, t)])).count() == 0 == decontam.matches(docs(spark, rows), items(spark, [])).count()
    clean = decontam.decontaminate(docs(spark, rows, extra=True), items(spark, [(1, t)]))
    assert sorted(r.doc_id for r in clean.collect()) == [1, 2, 3] and clean.columns[-6:] == ["key", "a", "_id", "gone", "group_id", "rank"]
    assert decontam.decontaminate(docs(spark, rows), items(spark, [])).count() == 7


def test_each_row_goes_by_its_own_finding(spark):
    leak, clean = "before it " + prose(3, 30), prose(8, 40)
    rows = [(1, leak), (1, clean), (2, clean), (None, leak), (None, clean), (None, None), (3, leak), (3, leak)]
    got = decontam.decontaminate(docs(spark, rows), items(spark, [(1, prose(3, 30))])).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(1, clean), (2, clean), (0, clean), (0, "")])


def test_index_of_many_items_of_one_length_is_small():
    """20,000 items of 40 words take an index of some MB, and a lookup finds what comparing all finds."""
    r = np.random.default_rng(5)
    vocab = np.unique(r.integers(0, 2**63, 30_000, dtype=np.uint64))
    hashes = [np.unique(r.choice(vocab, 38)) for _ in range(20_000)]
    b = decontam.Benchmark(list(range(20_000)), [40] * 20_000, hashes, vocab, np.ones(len(vocab)), 1.0)
    fp, parts = b.blocks(40)
    assert fp.nbytes + sum(x.nbytes for p in parts for x in p) < 4 << 20
    for _ in range(40):
        q = int(fp[r.integers(0, 20_000)]) ^ sum(1 << int(k) for k in r.choice(64, 17, replace=False))
        far = np.bitwise_count(fp ^ np.uint64(q))
        assert dict(b.candidates(q, 40)) == {int(k): int(far[k]) for k in np.flatnonzero(far <= decontam.RADIUS)}


# --- packing


def check_packing(rows, got, capacity):
    want = {}
    for i, t in rows:
        if t is not None:
            n = len(t.encode()) + 1
            for k in range(-(-n // capacity)):
                key = (i, k, min(capacity, n - k * capacity))
                want[key] = want.get(key, 0) + 1
    have = {}
    bins = {}
    for r in got:
        have[r.doc_id, r.piece, r.n_tokens] = have.get((r.doc_id, r.piece, r.n_tokens), 0) + 1
        bins.setdefault(r.sequence_id, []).append((r.position, r.n_tokens))
    assert have == want and sorted(bins) == list(range(len(bins)))
    for b in bins.values():
        at = 0
        for p, n in sorted(b):
            assert p == at
            at += n
        assert at <= capacity
    return bins


def test_packing(spark):
    r = random.Random(6)
    rows = [(i, "é" * r.randint(0, 30) + "x" * r.randint(0, 90)) for i in range(400)]
    rows += [(None, "null id"), (1, None), (2, ""), (2, ""), (3, "y" * 1000), (4, "z" * 63), (4, "z" * 63)]
    df = docs(spark, rows, extra=True)
    bins = check_packing(rows, packing.pack(df, 64).collect(), 64)
    least = -(-sum(n for b in bins.values() for _, n in b) // 64)
    assert len(bins) <= 1.03 * least + 1
    assert packing.pack(docs(spark, [])).count() == 0


def test_more_salts_pack_as_well(spark, monkeypatch):
    monkeypatch.setattr(packing, "PER_SALT", 3)
    r = random.Random(7)
    rows = [(i, "x" * r.randint(0, 70)) for i in range(300)]
    check_packing(rows, packing.pack(docs(spark, rows), 64).collect(), 64)


def test_exact_complements():
    r = np.random.default_rng(2)
    for _ in range(60):
        counts = np.zeros(41, np.int64)
        counts[1:] = r.integers(0, 3, 40) * (r.random(40) < 0.4)
        s = packing.Sums(counts.copy())
        have = [n for n in range(41) for _ in range(counts[n])]
        for gap in range(1, 41):
            got = s.exact(gap)
            some = {sum(c) for k in (1, 2, 3) for c in __import__("itertools").combinations(have, k)}
            assert (got is not None) == (gap in some)
            if got:
                assert sum(got) == gap and all(got.count(n) <= counts[n] for n in got)


def test_plan_uses_up_all_lengths():
    r = np.random.default_rng(3)
    for _ in range(30):
        counts = np.zeros(65, np.int64)
        counts[1:] = r.integers(0, 50, 64)
        used = np.zeros(65, np.int64)
        for held, times in packing.plan(counts, 64):
            assert sum(held) <= 64 and times > 0
            for n in held:
                used[n] += times
        assert np.array_equal(used, counts)
