"""Matching names by their labelled words.

Rows are first reduced to their distinct label lists, so names that read alike are scored once.
A category needs every important word to score 100, that is to be equal or to sound alike, so all
pairs that can get one meet in an equi-join on the phonetic codes of the important words. Only
what is left without such a pair is compared with all important-word lists of the pool, block by
block, and there the score is that of the important words alone.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import accumulate
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..config import LinkConfig
from ..cut import cut
from ..functions import arrays
from ..functions.similarity import metaphone_word, ratio_table, ratios

LONG = 50
BLOCK = 2048
HOT = 4096


class Scorer:
    """Scores of list pairs one by one: what ``Batch`` does for all rows at once, for small tables and tests."""

    def __init__(self, pairs, config: LinkConfig):
        self.c = config
        todo = sorted({p for p in pairs if p[0] != p[1]})
        r = ratios([a for a, _ in todo], [b for _, b in todo]) if todo else []
        self.plain = dict(zip(todo, (int(x) for x in r)))
        lift = [(a, b) for (a, b), x in self.plain.items() if config.phonetic_least <= x < 100 and a and b]
        codes = {w: metaphone_word(w) for p in lift for w in p}
        same = ratios([codes[a] for a, _ in lift], [codes[b] for _, b in lift]) if lift else []
        self.sound = {p for p, x in zip(lift, same) if x == 100 and codes[p[0]] and codes[p[1]]}

    def word(self, a: str, b: str) -> int:
        return 100 if a == b or (a, b) in self.sound else self.plain[a, b]

    def ordered(self, a: list[str], b: list[str]) -> float:
        n = max(len(a), len(b))
        if not n:
            return 0.0
        w = [1 / (i + 1) ** 2 for i in range(n)]
        whole = reduce(add, w)  # plain sums; Python's own sum compensates for rounding
        pad = lambda x: [*x, *[""] * (n - len(x))]
        return reduce(add, (self.word(x, y) * (self.c.important_weight / whole * k) / 100 for x, y, k in zip(pad(a), pad(b), w)), 0.0)

    def unordered(self, a: list[str], b: list[str], factor: float) -> float:
        scored = []
        for x in dict.fromkeys(a):
            for y in dict.fromkeys(b):
                s = 100 if x == y else self.plain[x, y]
                if s >= self.c.unordered_least:
                    scored.append((-s, x, y))
        used_a, used_b, total = set(), set(), 0
        for s, x, y in sorted(scored):
            if x not in used_a and y not in used_b:
                used_a.add(x)
                used_b.add(y)
                total -= s
        return total / (100 * max(len(a), len(b))) * factor

    def side(self, a: list[str], b: list[str], factor: float) -> float:
        if not len(a) and not len(b):
            return factor
        return self.unordered(a, b, factor) if len(a) and len(b) else 0.0

    def pair(self, imp1, sub1, gen1, imp2, sub2, gen2) -> tuple[float, str | None]:
        s = self.ordered(imp1, imp2)
        if s < self.c.important_weight - self.c.slack:
            return s, None
        sub, gen = self.side(sub1, sub2, self.c.subsidiary_weight), self.side(gen1, gen2, self.c.generic_weight)
        total = s + sub + gen
        full = total >= 100 - self.c.slack if self.c.slack else total == 100
        kind = "Match" if full else None
        if gen < 0.95 * self.c.generic_weight:
            kind = "Alias"
        if sub < 0.95 * self.c.subsidiary_weight:
            kind = "Subsidiary"
        return total, kind


def word_pairs(rows) -> set[tuple[str, str]]:
    """Word pairs that scoring the rows (imp1, sub1, gen1, imp2, sub2, gen2) may ask for."""
    out = set()
    for imp1, sub1, gen1, imp2, sub2, gen2 in rows:
        n = max(len(imp1), len(imp2))
        out.update((imp1[i] if i < len(imp1) else "", imp2[i] if i < len(imp2) else "") for i in range(n))
        out.update((x, y) for a, b in ((sub1, sub2), (gen1, gen2)) for x in a for y in b)
    return out


class Batch:
    """Scores of all rows of a batch at once, on numbered words."""

    def __init__(self, columns: list[pa.Array], config: LinkConfig):
        """``columns``: important, subsidiary and generic words of the first and of the second names."""
        self.c, self.rows = config, len(columns[0])
        flat = [x.flatten() for x in columns]
        coded = pa.concat_arrays([*(x.cast(pa.string()) for x in flat), pa.array([""])]).dictionary_encode()
        words = np.array(coded.dictionary.to_pylist(), object)
        order = np.argsort(words.astype(str), kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        self.words = words[order]  # numbered as they sort
        self.size = np.array([len(w) for w in self.words], np.float64)
        code = rank[coded.indices.to_numpy()]
        self.none = int(code[-1])
        ends = np.cumsum([0, *(len(x) for x in flat)])
        self.lists = [(code[lo:hi], np.concatenate([[0], np.cumsum(pc.fill_null(x.value_lengths(), 0).to_numpy())])) for lo, hi, x in zip(ends[:-1], ends[1:], columns)]

    def ratio(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pairs, back = np.unique(a * len(self.words) + b, return_inverse=True)
        x, y = np.divmod(pairs, len(self.words))
        return np.asarray(ratios(self.words[x].tolist(), self.words[y].tolist()), np.int64)[back] if len(pairs) else np.zeros(0, np.int64)

    def word(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ratios, with those of words that sound alike raised to 100."""
        return lifted(self.words, a, self.words, b, self.ratio(a, b), self.c)

    def ordered(self) -> np.ndarray:
        (a, at), (b, bt) = self.lists[0], self.lists[3]
        na, nb = np.diff(at), np.diff(bt)
        n = np.maximum(na, nb)
        whole = np.array([1.0, *accumulate(1 / (k + 1) ** 2 for k in range(int(n.max(initial=0))))])
        total = np.zeros(self.rows)
        for p in range(int(n.max(initial=0))):
            r = np.flatnonzero(n > p)
            x, y = (np.where(m[r] > p, np.append(v, self.none)[np.minimum(t[r] + p, len(v))], self.none) for v, t, m in ((a, at, na), (b, bt, nb)))
            total[r] += self.word(x, y) * (self.c.important_weight / whole[n[r]] * (1 / (p + 1) ** 2)) / 100
        return total

    def side(self, k: int, rows: np.ndarray, factor: float) -> np.ndarray:
        """Scores of the subsidiary (1) or generic (2) lists of some rows, assigned from the highest ratio down."""
        (a, at), (b, bt) = self.lists[k], self.lists[k + 3]
        na, nb = np.diff(at)[rows], np.diff(bt)[rows]
        out = np.where((na == 0) & (nb == 0), factor, 0.0)
        both = np.flatnonzero((na > 0) & (nb > 0))
        if not len(both):
            return out
        x, xr = _distinct(a, at, rows[both])
        y, yr = _distinct(b, bt, rows[both])
        many = np.bincount(yr, minlength=len(both))
        first = np.concatenate([[0], np.cumsum(many)])
        row = np.repeat(xr, many[xr])
        left = np.repeat(x, many[xr])
        right = y[np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(many[xr])])[:-1], many[xr]) + first[row]]
        # words whose lengths alone keep the ratio below the least aren't compared
        la, lb = self.size[left], self.size[right]
        near = (left == right) | (np.rint(200 * np.minimum(la, lb) / np.maximum(la + lb, 1)) >= self.c.unordered_least)
        row, left, right = row[near], left[near], right[near]
        s = self.ratio(left, right)
        ok = np.flatnonzero(s >= self.c.unordered_least)
        ok = ok[np.lexsort((right[ok], left[ok], -s[ok], row[ok]))]
        row, left, right, s = row[ok], left[ok], right[ok], s[ok]
        total = np.zeros(len(both))
        while len(row):
            head = np.append(True, row[1:] != row[:-1])
            h = np.flatnonzero(head)
            total[row[h]] += s[h]
            of = np.cumsum(head) - 1
            rest = (left != left[h][of]) & (right != right[h][of])
            row, left, right, s = row[rest], left[rest], right[rest], s[rest]
        out[both] = total / (100 * np.maximum(na, nb)[both]) * factor
        return out

    def scores(self) -> tuple[np.ndarray, np.ndarray]:
        """Score and category of each row."""
        c = self.c
        total = self.ordered()
        kind = np.full(self.rows, None, object)
        rows = np.flatnonzero(total >= c.important_weight - c.slack)
        sub, gen = self.side(1, rows, c.subsidiary_weight), self.side(2, rows, c.generic_weight)
        total[rows] = total[rows] + sub + gen
        kind[rows[(total[rows] >= 100 - c.slack) if c.slack else (total[rows] == 100)]] = "Match"
        kind[rows[gen < 0.95 * c.generic_weight]] = "Alias"
        kind[rows[sub < 0.95 * c.subsidiary_weight]] = "Subsidiary"
        return total, kind


def _distinct(codes: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of some rows' lists, and the number among ``rows`` that each belongs to, ascending."""
    n = np.diff(ends)[rows]
    row = np.repeat(np.arange(len(rows)), n)
    at = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n) + ends[rows][row]
    most = int(codes.max(initial=0)) + 1
    row, code = np.divmod(np.unique(row * most + codes[at]), most)
    return code, row


def lifted(names_a: np.ndarray, a: np.ndarray, names_b: np.ndarray, b: np.ndarray, r: np.ndarray, config: LinkConfig) -> np.ndarray:
    """The ratios ``r`` of words ``names_a[a]`` and ``names_b[b]``, 100 from the least on for words of equal sound."""
    near = np.flatnonzero((r >= config.phonetic_least) & (r < 100))
    if not len(near):
        return r
    pairs, back = np.unique(a[near] * np.int64(len(names_b)) + b[near], return_inverse=True)
    x, y = np.divmod(pairs, len(names_b))
    codes = {w: metaphone_word(w) for w in {*names_a[x], *names_b[y]}}
    cx, cy = [codes[w] for w in names_a[x]], [codes[w] for w in names_b[y]]
    same = (ratios(cx, cy) == 100) & np.array([bool(p and q) for p, q in zip(cx, cy)])
    out = r.copy()
    out[near[same[back]]] = 100
    return out


def pair_score(config: LinkConfig = LinkConfig()):
    """A batch function of six word lists (important, subsidiary and generic of both names): score and category."""
    def run(i1: pa.Array, s1: pa.Array, g1: pa.Array, i2: pa.Array, s2: pa.Array, g2: pa.Array) -> pa.Array:
        total, kind = Batch([i1, s1, g1, i2, s2, g2], config).scores()
        return pa.StructArray.from_arrays([pa.array(total, pa.float64()), pa.array(kind, pa.string())], names=["score", "category"])

    return F.arrow_udf(run, "score double, category string")


@F.arrow_udf(ArrayType(StringType()))
def _codes(words: pa.Array) -> pa.Array:
    """What words of one place must agree in to score 100: the phonetic code, or the word if it has none.

    Ratios of words of ``LONG`` letters, or of their codes, may round up to 100; those all agree
    here, and exact scoring tells them apart.
    """
    coded = words.flatten().cast(pa.string()).dictionary_encode()
    code = pa.array(["#" if len(w) >= LONG else metaphone_word(w) or f"={w}" for w in coded.dictionary.to_pylist()], pa.string())
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(words.value_lengths(), 0).to_numpy())]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), code.take(coded.indices))


LISTS = ("imp", "sub", "gen")


def _lists(df: DataFrame) -> DataFrame:
    return df.select("*", *[arrays.words_with_label(F.col("labels"), k).alias(c) for k, c in enumerate(LISTS)])


def signature(imp: Column, sub: Column, gen: Column) -> Column:
    """128 bits that tell the three lists of a name: unlike a hash of their words, it tells where one list ends."""
    return F.md5(F.to_json(F.struct(imp.alias("i"), sub.alias("s"), gen.alias("g"))))


def _own_signature() -> Column:
    """The signature of labelled rows; null for rows without tokens."""
    return F.when(F.size("labels") > 0, signature(*[arrays.words_with_label(F.col("labels"), k) for k in range(3)]))


def signed(rows: DataFrame) -> DataFrame:
    """Labelled rows with their signature, written once: labels and signatures cost more than all that reads them."""
    return cut(rows.withColumn("sig", _own_signature()))


def _join_key() -> Column:
    """The signature; rows without one have keys of their own, so that no task gets all of them."""
    return F.coalesce("sig", F.xxhash64("row_id").cast("string"))


def signatures(rows: DataFrame) -> DataFrame:
    """(sig, imp, sub, gen, row_id, name, longest, longest_id): distinct word lists of labelled rows, with the least row_id
    and its name, and the longest name with its row_id, the least one among equally long names.

    Rows without any token are left out. ``rows`` may have their signatures already.
    """
    rows = rows if "sig" in rows.columns else rows.withColumn("sig", _own_signature())
    # the condition is on the result: on rows it would be evaluated with labels and signatures of its own
    found = rows.groupBy("sig").agg(
        F.min(F.struct("row_id", "name")).alias("_r"), F.any_value("labels").alias("labels"),
        F.max_by("name", F.struct(F.length("name"), -F.col("row_id"))).alias("longest"), F.max_by("row_id", F.struct(F.length("name"), -F.col("row_id"))).alias("longest_id"),
    ).filter("size(labels) > 0")
    return _lists(found).select("sig", *LISTS, "_r.row_id", "_r.name", "longest", "longest_id")


def _keyed(sig: DataFrame) -> DataFrame:
    return sig.filter("size(imp) > 0").withColumn("key", _codes("imp"))


def _better(score: Column, row_id: Column) -> Column:
    return F.struct(score, -row_id)


def gated(left: DataFrame, right: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """Pairs of signatures (l, r structs; score, category) that reach the gate, by an equi-join on codes.

    A key that more than ``HOT`` lists of the pool have is cut into as many parts of that size, and
    each of our lists of that key meets each part, so no task has all pairs of a common name.
    """
    a = _keyed(left).select("key", F.struct(*left.columns).alias("l"))
    b = _keyed(right).select("key", F.struct(*right.columns).alias("r"))
    hot = b.groupBy("key").agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts")).filter("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    a = a.join(hot, "key", "left").select("key", "l", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    b = b.join(hot, "key", "left").select("key", "r", F.pmod(F.xxhash64("r.sig"), parts).cast("int").alias("part"))
    scored = a.join(b, ["key", "part"]).withColumn("s", pair_score(config)(*[F.col(f"r.{c}") for c in LISTS], *[F.col(f"l.{c}") for c in LISTS]))
    return scored.select("l", "r", "s.score", "s.category").filter(F.col("score") >= config.important_weight - config.slack)


def _residual(config: LinkConfig):
    """Per block pair: the best list of the pool for each of ours, by the score of important words."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ours, pool = pdf[pdf["mine"]], pdf[~pdf["mine"]]
        if not len(ours) or not len(pool):
            return pd.DataFrame({"sig": [], "score": [], "ref_id": []}).astype({"sig": "object", "score": "float64", "ref_id": "int64"})
        a, b = ours["imp"].tolist(), pool["imp"].tolist()
        na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        longest = np.maximum(na[:, None], nb[None, :])
        top = int(longest.max(initial=0))
        total = np.zeros((len(a), len(b)))
        for p in range(top):
            wa, ia = np.unique(np.array([x[p] if p < len(x) else "" for x in a], object), return_inverse=True)
            wb, ib = np.unique(np.array([x[p] if p < len(x) else "" for x in b], object), return_inverse=True)
            table = ratio_table(wa, wb).astype(np.float64)
            x, y = np.nonzero((table >= config.phonetic_least) & (table < 100))
            table[x, y] = lifted(wa, x, wb, y, table[x, y], config)
            total += np.where(longest > p, table[ia][:, ib] / (p + 1) ** 2, 0)
        whole = np.concatenate([[1.0], np.cumsum([1 / (k + 1) ** 2 for k in range(max(top, 1))])])
        score = total * config.important_weight / whole[longest] / 100
        # the least row_id among the best
        ids = pool["ref_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        best = order[np.argmax(np.round(score[:, order], 9), axis=1)]
        return pd.DataFrame({"sig": ours["sig"].to_numpy(), "score": score[np.arange(len(a)), best], "ref_id": ids[best]})

    return run


def residual(left: DataFrame, right: DataFrame, config: LinkConfig = LinkConfig(), block: int = BLOCK) -> DataFrame:
    """(sig, score, ref_id): for each signature of left the best of right by important words alone."""
    def pool(df, key, mine):
        lists = df.groupBy("imp").agg(F.min("row_id").alias("ref_id")) if not mine else df.select("imp", "sig")
        return lists.withColumn("block", F.xxhash64("imp"))

    pool_lists = pool(right, "ref_id", False)
    ours = pool(left, "sig", True)
    left_over = ours.count()
    if not left_over:
        return ours.sparkSession.createDataFrame([], "sig string, score double, ref_id long")
    n, m = math.ceil(left_over / block), max(1, math.ceil(pool_lists.count() / block))
    a = ours.select("imp", "sig", F.lit(0).cast("long").alias("ref_id"), F.lit(True).alias("mine"), F.pmod("block", F.lit(n)).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"))
    b = pool_lists.select("imp", F.lit("").alias("sig"), "ref_id", F.lit(False).alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("i"), F.pmod("block", F.lit(m)).cast("int").alias("j"))
    best = a.unionByName(b).groupBy("i", "j").applyInPandas(_residual(config), "sig string, score double, ref_id long")
    top = F.max_by(F.struct("score", "ref_id"), _better(F.round("score", 9), F.col("ref_id")))
    return best.groupBy("sig").agg(top.alias("m")).select("sig", "m.*")


def best_matches(inference: DataFrame, reference: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """(sig, ref_id, matched_name, score, category) of the best reference for each distinct inference list."""
    # each is read several times below; distinct lists are few beside the rows
    left, right = (cut(signatures(x).select("sig", *LISTS, "row_id", "name")) for x in (inference, reference))
    pairs = gated(left, right, config)
    top = cut(pairs.groupBy(F.col("l.sig").alias("sig")).agg(
        F.max_by(F.struct(F.col("r.row_id").alias("ref_id"), F.col("r.name").alias("matched_name"), "score", "category"), _better(F.round("score", 9), F.col("r.row_id"))).alias("m")
    ).select("sig", "m.*"))
    rest = left.join(top.select("sig"), "sig", "left_anti")
    low = cut(residual(rest, right, config).join(right.select(F.col("row_id").alias("ref_id"), F.col("name").alias("matched_name")), "ref_id"))
    return top.unionByName(low.withColumn("category", F.lit(None).cast("string")))


def match(inference: DataFrame, reference: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """Adds matched_id, matched_name, score and category of the best reference row to each inference row.

    Ties go to the least row_id. Rows without tokens, and all rows if the pool has none, have nulls.
    """
    mine = signed(inference)
    found = best_matches(mine, reference, config).withColumnsRenamed({"ref_id": "matched_id", "sig": "_sig"})
    return mine.withColumn("sig", _join_key()).join(found, F.col("sig") == F.col("_sig"), "left").drop("sig", "_sig")


def brute_force(inference: DataFrame, reference: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """What ``match`` gives, by scoring every pair of rows; for small tables and tests."""
    a = _lists(inference.filter("size(labels) > 0")).select(F.col("row_id").alias("l_id"), *[F.col(c).alias(f"l{c}") for c in LISTS])
    b = _lists(reference.filter("size(labels) > 0")).select(F.col("row_id").alias("matched_id"), F.col("name").alias("matched_name"), *[F.col(c).alias(f"r{c}") for c in LISTS])

    @F.pandas_udf("score double, category string")
    def one_by_one(i1: pd.Series, s1: pd.Series, g1: pd.Series, i2: pd.Series, s2: pd.Series, g2: pd.Series) -> pd.DataFrame:
        rows = [tuple(list(x) for x in r) for r in zip(i1, s1, g1, i2, s2, g2)]
        scorer = Scorer(word_pairs(rows), config)
        found = [scorer.pair(*r) for r in rows]
        return pd.DataFrame({"score": [f[0] for f in found], "category": pd.Series([f[1] for f in found], dtype=object)})

    scored = a.crossJoin(b).withColumn("s", one_by_one(*[F.col(f"r{c}") for c in LISTS], *[F.col(f"l{c}") for c in LISTS]))
    top = scored.groupBy("l_id").agg(
        F.max_by(F.struct("matched_id", "matched_name", "s.score", "s.category"), _better(F.round("s.score", 9), F.col("matched_id"))).alias("m")
    ).select("l_id", "m.*")
    return inference.join(top, inference["row_id"] == top["l_id"], "left").drop("l_id")


def alias(rows: DataFrame, config: LinkConfig = LinkConfig(), among: DataFrame | None = None) -> DataFrame:
    """Adds alias: the longest name among all rows that are a Match or Alias of the row, itself included.

    One step, not a closure. Ties go to the least row_id; rows without such a pair have "". The
    rows searched are those of ``among``, by default the same.
    """
    mine = signed(rows)
    lists = cut(signatures(mine if among is None else among))
    own = lists.select("sig", *LISTS, "row_id", "name")
    pairs = gated(own, own, config).filter(F.col("category").isin("Match", "Alias")).select(F.col("l.sig").alias("of"), F.col("r.sig").alias("sig"))
    longest = pairs.join(lists.select("sig", "longest", "longest_id"), "sig").groupBy("of").agg(
        F.max_by("longest", F.struct(F.length("longest"), -F.col("longest_id"))).alias("alias")
    )
    aliased = mine.withColumn("sig", _join_key()).join(longest, F.col("sig") == F.col("of"), "left").drop("sig", "of")
    return aliased.withColumn("alias", F.coalesce("alias", F.lit("")))


def cascade(inference: DataFrame, pools: list[DataFrame], config: LinkConfig = LinkConfig()) -> DataFrame:
    """Matches against the first pool; rows that score less than the threshold, or nothing, against the next one."""
    found = match(inference, pools[0], config).withColumn("pool", F.lit(0))
    own = inference.columns
    for k, pool in enumerate(pools[1:], 1):
        high = F.coalesce(F.col("score") >= config.cascade_threshold - config.slack, F.lit(False))
        again = match(found.filter(~high).select(*own), pool, config).withColumn("pool", F.lit(k))
        found = found.filter(high).unionByName(again)
    return found
