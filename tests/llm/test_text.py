"""Tokens, shingles and components against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from onomast.llm import common, textvec

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
BOTH = re.compile(r"[0-9a-z\x80-\U0010ffff]+|[!-/:-@\[-`{-~]+")


def spelled(t):
    return [[bytes(t.buf[s:e]).decode() for s, e in zip(t.start[a:b], t.end[a:b])] for a, b in zip(t.row[:-1], t.row[1:])]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB c.é!\n日0", max_size=30)), max_size=6), st.integers(1, 40))
def test_tokens(texts, limit):
    for punct, pattern in ((False, WORD), (True, BOTH)):
        got, at = [], 0
        for t in textvec.chunks(pa.array(texts, pa.string()), punct, limit):
            assert t.lo == at
            at += t.rows
            got += spelled(t)
        assert got == [pattern.findall((x or "").lower()) for x in texts]


def test_hashes_depend_on_the_word_alone():
    a, b = (next(textvec.chunks(pa.array(x))) for x in (["one two", "two"], ["", "x two y" + "z" * 5000, "two"]))
    assert a.hash[1] == a.hash[2] == b.hash[1] == b.hash[-1] and len({*a.hash.tolist()}) == 2
    sliced = pa.array(["drop", "one two", None]).slice(1)
    assert np.array_equal(textvec.tokenize(sliced).hash, a.hash[:2])


def test_shingles_stay_within_rows():
    t = textvec.tokenize(pa.array(["a b c d", "a b", "", "b c d"]))
    h, offs = textvec.shingles(t, 3)
    assert offs.tolist() == [0, 2, 2, 2, 3] and h[1] == h[2] != h[0]


def test_distinct():
    v, n, offs = textvec.distinct(np.array([3, 1, 3, 1, 1], np.uint64), np.array([0, 3, 3, 5]))
    assert v.tolist() == [1, 3, 1] and n.tolist() == [1, 2, 2] and offs.tolist() == [0, 2, 2, 3]


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(7, 7)]
    want = dict(zip(*(x.tolist() for x in common.forest(*map(np.array, zip(*edges))))))
    got = {x.node: x.root for x in common.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {k: v for k, v in want.items() if k != v}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
