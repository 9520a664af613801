"""Best-fit packing by exact-complement hashing.

A text of b UTF-8 bytes has b + 1 tokens: its bytes and an end mark. A text of more than
``CAPACITY`` tokens is cut into full pieces and a rest. Which lengths share a sequence depends
on the lengths alone, so the plan is made on their counts: at most ``CAPACITY`` numbers, however
large the corpus. Lengths are taken from the longest down. For the gap that a length leaves, an
index of single, pair and triple sums of the available lengths is asked for an exact complement,
which is consumed as often as the counts allow; only if there is none does the longest length
that fits go in, and the rest of the gap is tried again. The pieces of a length are then numbered
and looked up in the plan. The numbering is salted, a salt for each million pieces, so no length is
counted in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

CAPACITY = 8192
SALTS = 64  # at least
PER_SALT = 1_000_000


class Sums:
    """Which sums of one, two or three available lengths exist; lengths only ever run out.

    The pair and triple sets are bit strings that may still hold sums whose lengths have since run
    out. They never lack one, and a hit is checked against the counts; they are made anew when
    enough lengths have run out.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.renew()

    def renew(self) -> None:
        self.lengths = np.flatnonzero(self.counts)
        self.out = 0
        full = (1 << len(self.counts)) - 1
        self.pairs = self.triples = 0
        single = 0
        for a in self.lengths.tolist():
            single |= 1 << a
        for a in self.lengths.tolist():
            self.pairs |= (single << a) & full
        for a in self.lengths.tolist():
            self.triples |= (self.pairs << a) & full

    def pair(self, gap: int, most: int) -> tuple[int, ...] | None:
        """The pair of the longest first part up to ``most`` that fills the gap."""
        if not self.pairs >> gap & 1:
            return None
        c = self.counts
        a = np.arange(min(most, gap - 1), (gap + 1) // 2 - 1, -1)
        ok = (c[a] > 0) & (c[gap - a] > np.where(a == gap - a, 1, 0))
        k = int(ok.argmax()) if len(ok) else 0
        return (int(a[k]), gap - int(a[k])) if len(ok) and ok[k] else None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """Available lengths, at most three, that fill the gap."""
        c = self.counts
        if gap < len(c) and c[gap]:
            return (gap,)
        if found := self.pair(gap, gap):
            return found
        if not self.triples >> gap & 1:
            return None
        for a in self.lengths[: np.searchsorted(self.lengths, gap)][::-1].tolist():
            if a * 3 < gap:
                break
            if c[a] and self.pairs >> (gap - a) & 1:
                c[a] -= 1
                rest = self.pair(gap - a, a)
                c[a] += 1
                if rest:
                    return (a, *rest)
        return None

    def take(self, a: int, times: int = 1) -> None:
        self.counts[a] -= times
        if not self.counts[a]:
            self.out += 1
            if self.out * 8 > len(self.lengths):
                self.renew()

    def longest(self, most: int) -> int:
        at = np.flatnonzero(self.counts[1 : most + 1])
        return int(at[-1]) + 1 if len(at) else 0


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Contents of sequences and how many have them; ``counts[n]`` pieces of n tokens are used up."""
    sums = Sums(counts.astype(np.int64).copy())
    out = []
    top = capacity
    while top := sums.longest(top):
        held = [top]
        sums.counts[top] -= 1
        gap = capacity - top
        while gap:
            more = sums.exact(gap) or ((n,) if (n := sums.longest(gap)) else ())
            if not more:
                break
            for n in more:
                sums.counts[n] -= 1
            held += more
            gap -= sum(more)
        kinds, uses = np.unique(held, return_counts=True)
        for n, k in zip(kinds, uses):  # taken one by one above; now as a whole, as often as can be
            sums.counts[n] += k
        times = int(min(sums.counts[kinds] // uses))
        for n, k in zip(kinds.tolist(), uses.tolist()):
            sums.take(n, k * times)
        out.append((tuple(held), times))
    return out


def slots(steps: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For runs of the numbered pieces of a length: the first sequence they go to, and where in it."""
    used: dict[int, int] = {}
    rows = []
    base = 0
    for held, times in steps:
        at = 0
        for n in held:
            rows.append((n, used.get(n, 0), base, at))
            used[n] = used.get(n, 0) + times
            at += n
        base += times
    rows.sort()
    n, lo, seq, at = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
    return {"length": n, "lo": lo, "sequence": seq, "position": at}


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, text_hash, piece, n_tokens)`` of every text."""
    n = F.octet_length("text").cast("long") + 1
    cut = docs.filter("text is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), n.alias("n"))
    return cut.select(
        "doc_id", "text_hash", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity))).alias("piece")
    ).select("doc_id", "text_hash", "piece", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("n_tokens"))


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, n_tokens, sequence_id, position)``: where each piece of each text goes; doc_id is a whole number.

    Piece k starts at token k * capacity of its text. Every token of every text is in exactly one
    sequence and none has more than ``capacity``. Empty texts are one token, their end mark; null
    texts have none and aren't packed. A null doc_id is packed under null; rows that repeat are
    packed as often. Pieces of one length are numbered by salt, doc_id, text hash and piece. An
    empty table gives an empty result; other columns are ignored.
    """
    cut = staged(pieces(docs, capacity), "pieces")
    salts = max(SALTS, -(-cut.count() // PER_SALT))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash", "piece"), F.lit(salts)).cast("int"))
    per = staged(cut.groupBy("n_tokens", "salt").agg(F.count("*").alias("n")), "lengths")
    total = per.groupBy("n_tokens").agg(F.sum("n").alias("n")).toArrow()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    counts[total["n_tokens"].to_numpy()] = total["n"].to_numpy()
    where = docs.sparkSession.sparkContext.broadcast(slots(plan(counts, capacity)))
    start = per.select(
        "n_tokens", "salt", (F.sum("n").over(Window.partitionBy("n_tokens").orderBy("salt")) - F.col("n")).alias("start")
    )
    keys = ["n_tokens", "salt"]
    numbered = cut.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id", "text_hash", "piece")))
    ranked = numbered.join(start, keys).select("doc_id", "piece", "n_tokens", (F.col("start") + F.col("k") - 1).alias("rank"))

    def place(batches):
        s = where.value
        key = s["length"] << 44 | s["lo"]
        for batch in batches:
            n, rank = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            at = np.searchsorted(key, n << 44 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(s["sequence"][at] + rank - s["lo"][at]), pa.array(s["position"][at])],
                names=["doc_id", "piece", "n_tokens", "sequence_id", "position"],
            )

    return ranked.mapInArrow(place, "doc_id long, piece long, n_tokens long, sequence_id long, position long")
