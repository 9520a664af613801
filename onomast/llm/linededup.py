"""Line dedup by pairwise alignment.

Lines are hashed after trimming. A line of at least ``RUN_WORDS`` words, or a shorter one with the
next or the previous ones that make up as many, is a run: texts written apart hardly agree on so
many words. Runs are ranked by the number of documents that hold them. Two documents overlap when
they share a run, and the rare ones, held by at most ``RARE_HOLDERS`` documents, are looked up
first. Each pair is aligned by patience diff: lines unique in both texts, their longest increasing
subsequence, extended over equal neighbours, and again between them. The stretches of aligned lines
are the common blocks; those with at least ``BLOCK_WORDS`` words are deleted from the later document.

The result is that of aligning each document with every earlier one (by doc_id) that shares a
run. First each document is paired with the first holder of each of its rare runs. What these
alignments delete of frequent lines (licenses, footers) needs no pair of its own; only frequent
runs that are left are then paired with their first holder. Where an occurrence of a run is not
wholly deleted by then (the alignment can't cross another one, or one of the two repeats the
line), the document goes on to the next holders, ``GROWTH`` times as many each round, until the run
is gone or no earlier holder is left. Every line of a common block is in a run within the block, so
no later pair could delete more. Usually the first holders delete nearly all and pairs are fewer
than lines; a run that no holder aligns costs a pair for each one.

Texts that lose nothing aren't shuffled: only those that may lose lines are joined with what they lose.

Lines are equal when their 64-bit hashes are. A wrong deletion takes a collision between the lines
of one pair of aligned documents, not of the corpus: below 1e-15 for a pair of a hundred lines each.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, staged, unstage

RUN_WORDS = 10
BLOCK_WORDS = 10
RARE_HOLDERS = 64
GROWTH = 8
FLAGS = 16
WORDS = 1 << 20
SLICE = 512  # rows whose lines are Python objects at a time


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, given by rising first part, whose second part rises."""
    tops: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back.append(last[at - 1] if at else -1)
        if at == len(tops):
            tops.append(j)
            last.append(k)
        else:
            tops[at], last[at] = j, k
    out = []
    k = last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions (i, j) of equal lines of a and b, rising in both; blank lines are None."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 >= i1 or j0 >= j1:
            continue
        once: dict = {}
        for i in range(i0, i1):
            once[a[i]] = -1 if a[i] in once else i
        seen: dict = {}
        for j in range(j0, j1):
            if once.get(b[j], -1) >= 0:
                seen[b[j]] = -1 if b[j] in seen else j
        anchors = _rising(sorted((once[h], j) for h, j in seen.items() if j >= 0 and h is not None))
        if not anchors:
            continue
        for (i, j), (x, y) in zip([(i0 - 1, j0 - 1), *anchors], [*anchors, (i1, j1)]):
            todo.append((i + 1, x, j + 1, y))
        out += anchors
    return sorted(out)


def common_blocks(first: list, later: list, words: list[int], least: int = BLOCK_WORDS) -> list[int]:
    """Positions of ``later`` in aligned blocks of at least ``least`` words; blank lines between don't end a block."""
    gone: list[int] = []
    block: list[int] = []
    before = (-1, -1)
    for i, j in patience(first, later):
        if any(h is not None for h in first[before[0] + 1 : i]) or any(h is not None for h in later[before[1] + 1 : j]):
            if sum(words[k] for k in block) >= least:
                gone += block
            block = []
        block.append(j)
        before = (i, j)
    return gone + block if sum(words[k] for k in block) >= least else gone


def _slices(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            yield batch.slice(lo, SLICE)


def _align(batches):
    for batch in _slices(batches):
        key, first, later, words = (c.to_pylist() for c in batch.columns)
        keys, places = [], []
        for k, a, b, w in zip(key, first, later, words):
            gone = common_blocks(a, b, w)
            if gone:
                keys.append(k)
                places.append(gone)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(places, pa.list_(pa.int32()))], names=["key", "gone"])


def long_runs(lines: list, words: list[int], least: int = RUN_WORDS):
    """(hash, positions) of the shortest runs of lines, from each line on and up to it, of at least ``least`` words."""
    full = [k for k, h in enumerate(lines) if h is not None]
    for at, k in enumerate(full):
        for step in (1, -1) if words[k] < least else (1,):
            n, end = words[k], at
            while n < least and 0 <= end + step < len(full):
                end += step
                n += words[full[end]]
            if n >= least:
                run = full[min(at, end) : max(at, end) + 1]
                h = lines[run[0]]
                for x in run[1:]:
                    h = (h * 0x9E3779B97F4A7C15 + lines[x] + 1 + 2**63) % 2**64 - 2**63
                yield h, run


def _runs(batches):
    for batch in _slices(batches):
        found = [sorted({r for r, _ in long_runs(h, n)}) for h, n in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "key", "runs"])


def _kept(batches):
    """Of the runs asked for, those of which an occurrence isn't wholly deleted."""
    for batch in _slices(batches):
        key, asked, lines, words, gone = (c.to_pylist() for c in batch.columns)
        left = []
        for a, h, n, g in zip(asked, lines, words, gone):
            a, g = set(a), set(g or ())
            left.append(sorted({x for x, run in long_runs(h, n) if x in a and not g.issuperset(run)}))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.list_(pa.int64()))], names=["key", "left"])


def _masks(batches):
    """For each text whether each of its lines goes, from the places of those that do."""
    for batch in _slices(batches):
        n, places = batch.column(2).to_numpy(), batch.column(3)
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = np.zeros(int(ends[-1]), bool)
        flat[np.repeat(ends[:-1], places.value_lengths().to_numpy()) + places.flatten().to_numpy()] = True
        mask = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), mask], names=["doc_id", "text_hash", "gone"])


def _lines(text):
    return F.split(text, "\n", -1)


def _words(line):
    return F.size(F.filter(F.split(line, r"\s+", -1), lambda w: w != ""))


def deletions(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, gone)``: which lines to delete, one flag a line, for documents that lose any.

    A staged table; those that it was made from are deleted.
    """
    made: list[DataFrame] = []
    base = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    trimmed = F.transform(_lines(F.col("text")), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    lined = staged(
        base.withColumn("l", trimmed).select(
            "doc_id", "text_hash",
            F.transform("l", lambda x: F.when(x != "", F.xxhash64(x))).alias("lines"),
            F.transform("l", _words).alias("words"),
        ).groupBy("doc_id", "text_hash").agg(F.first("lines").alias("lines"), F.first("words").alias("words"))
        .withColumn("key", F.xxhash64("doc_id", "text_hash")),
        "lines", made,
    )
    found = lined.select("doc_id", "text_hash", "key", "lines", "words").mapInArrow(_runs, "doc_id long, text_hash long, key long, runs array<long>")
    held = found.select(F.struct("doc_id", "text_hash", "key").alias("doc"), F.explode("runs").alias("line"))
    firsts = held.groupBy("line").agg(F.min("doc").alias("one"), F.count("*").alias("n")).filter("n > 1")
    shared = staged(held.join(firsts, "line").select("line", "doc", "one", "n"), "shared", made)

    def aligned(pairs: DataFrame) -> DataFrame:
        later = lined.select("key", F.col("lines").alias("b"), "words")
        one = lined.select(F.col("key").alias("one"), F.col("lines").alias("a"))
        return pairs.distinct().join(one, "one").join(later, "key").select("key", "a", "b", "words").mapInArrow(_align, "key long, gone array<int>")

    def merged(found: DataFrame) -> DataFrame:
        return staged(found.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")), "gone", made)

    def kept(asked: DataFrame) -> DataFrame:
        """The (key, line) of those asked for that ``gone`` leaves in place."""
        return (
            asked.groupBy("key").agg(F.collect_set("line").alias("asked")).join(lined, "key").join(gone, "key", "left")
            .select("key", "asked", "lines", "words", "gone").mapInArrow(_kept, "key long, left array<long>")
            .select("key", F.explode("left").alias("line"))
        )

    later = shared.filter("doc.key <> one.key").select(F.col("doc.key").alias("key"), F.col("one.key").alias("one"), "line", "n")
    gone = merged(aligned(later.filter(F.col("n") <= RARE_HOLDERS).select("key", "one")))
    frequent = later.filter(F.col("n") > RARE_HOLDERS)
    left = staged(kept(frequent), "kept", made)
    if not left.isEmpty():
        gone = merged(gone.union(aligned(frequent.join(left, ["key", "line"]).select("key", "one"))))
    left = staged(kept(later), "kept", made)
    by_line = Window.partitionBy("line").orderBy("doc")
    holders = staged(
        shared.join(left.select("line").distinct(), "line", "left_semi")
        .select("line", F.col("doc.key").alias("one"), F.row_number().over(by_line).alias("place")),
        "holders", made,
    )
    left = left.join(holders.select("line", F.col("one").alias("key"), F.col("place").alias("own")), ["line", "key"])
    lo = 2  # the first one is done
    while True:
        todo = staged(left.filter(F.col("own") > lo), "todo", made)
        if todo.isEmpty():
            break
        hi = lo * GROWTH
        some = holders.filter(F.col("place").between(lo, hi - 1))
        gone = merged(gone.union(aligned(todo.join(some, "line").filter("place < own").select("key", "one"))))
        left = todo.join(kept(todo), ["line", "key"], "left_semi")
        lo = hi
    size = lined.select("key", "doc_id", "text_hash", F.size("lines").cast("long").alias("n"))
    out = staged(
        gone.join(size, "key").select("doc_id", "text_hash", "n", "gone").mapInArrow(_masks, "doc_id long, text_hash long, gone array<boolean>"),
        "deletions",
    )
    for table in made:
        unstage(table)
    return out


def parted(docs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two parts: all rows that ``gone`` has, with some others, and rows that it hasn't.

    Told apart without moving a text, by ``FLAGS`` flags a row of ``gone`` (fewer beyond ``WORDS`` words of 64), of
    which its hash sets one: a row whose flag another one set is in the first part, which is then joined exactly.
    """
    words = 1 << min(WORDS.bit_length() - 1, (gone.count() * FLAGS // 64).bit_length())
    word, flags = fresh(docs, "_word"), fresh(docs, "_flags")

    def place(key):
        return key.bitwiseAND(F.lit(words - 1)), F.shiftrightunsigned(key, 58).cast("int")

    at, bit = place(F.xxhash64("doc_id", "text_hash"))
    table = gone.select(at.alias(word), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias(flags)).groupBy(word).agg(F.bit_or(flags).alias(flags))
    at, bit = place(F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")))
    marked = docs.join(F.broadcast(table), at == F.col(word), "left")
    set_ = F.coalesce(F.call_function("shiftrightunsigned", F.col(flags), bit).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    own = [F.col(f"`{c}`") for c in docs.columns]
    return marked.filter(set_).select(*own), marked.filter(~set_).select(*own)


def line_dedup(docs: DataFrame) -> DataFrame:
    """The documents without the blocks of lines that an earlier document has.

    Columns are those of ``docs``, of any name: text loses its deleted lines and, where present,
    n_chars is its new length; doc_id is a whole number. A document of which only blank lines are
    left goes, unless it lost nothing. Rows with a null doc_id or text stay as they are, as do
    empty texts and an empty table. Rows that repeat both are one document; rows that repeat a
    doc_id alone are documents in the order of their text hashes. Very long texts are aligned
    whole, in time that grows with their lines.
    """
    own = docs.columns
    i, h, g = (fresh(docs, c) for c in ("_id", "_hash", "_gone"))
    lost = deletions(docs)
    some, rest = parted(docs, lost)
    gone = lost.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h), F.col("gone").alias(g))
    joined = some.join(gone, (F.col("doc_id") == F.col(i)) & (F.xxhash64("text") == F.col(h)), "left")
    left = F.array_join(F.zip_with(_lines(F.col("text")), F.col(g), lambda x, lost: F.when(~lost, x)), "\n")
    out = joined.withColumn("text", F.when(F.col(g).isNull(), F.col("text")).otherwise(left))
    out = out.filter(F.col(g).isNull() | F.col("text").rlike(r"\S"))
    if "n_chars" in own:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(g).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*[F.col(f"`{c}`") for c in own]).union(rest)
