"""Batches of older name scores."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from onomast.operators import wordscores

WORDS = st.sampled_from(["ACME", "ACMEE", "NORTH", "INC", "ELECTRICALS", "ELECTRIKALS", "", "X" * 70, "X" * 71, None])
LISTS = st.lists(st.tuples(WORDS, st.sampled_from([0, 0, 1, 2, 3, None])), max_size=5)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(LISTS, LISTS), max_size=9), st.sampled_from([1 << 20, 7]))
def test_batches_of_older_scores_as_one_by_one(rows, cells):
    before, wordscores.CELLS = wordscores.CELLS, cells
    try:
        kind = pa.list_(pa.struct([("word", pa.string()), ("label", pa.int32())]))
        first, second = (pa.array([[{"word": w, "label": k} for w, k in r[side]] for r in rows], kind) for side in (0, 1))
        assert wordscores.batch_name_scores(first, second).tolist() == [wordscores.name_score(a, b) for a, b in rows]
    finally:
        wordscores.CELLS = before
