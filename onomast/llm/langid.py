"""Language identification by hierarchical discrimination.

Linear support vector machines over hashed byte trigrams: the first level tells language
families apart, one against one; within the family that wins, one-versus-one machines tell its
languages apart and the majority decides, ties going to the greater sum of margins. All machines
are fitted on at most ``MAX_LABELLED`` documents with a language (those of the least hashed
doc_id); features of a text are its trigram counts over their number, so whole texts of any
length count. Prediction is one pass without a shuffle; each byte costs one lookup of the few
weights of all machines.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec

DIM = 4096
MAX_LABELLED = 4_000
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic",
}


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of each lower-cased text between blanks, and their offsets by row."""
    b, offs = textvec.raw(pc.utf8_lower(texts))
    n = len(b)
    rows = len(offs) - 1
    padded = np.full(n + 2 * rows, 32, np.uint32)  # a blank before and after each text
    at = np.arange(n) + np.repeat(2 * np.arange(rows) + 1, np.diff(offs))
    padded[at] = np.where(textvec._WORD[b] == 0, 32, b)
    code = (padded[:-2] * 0x9E3779B1 + padded[1:-1] * 0x85EBCA6B + padded[2:] * 0xC2B2AE35).astype(np.uint32)
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    code = (code >> np.uint32(20)).astype(np.int64) if n else np.zeros(0, np.int64)
    first = offs + 2 * np.arange(rows + 1)
    ok = np.ones(max(len(padded) - 2, 0), bool)
    for k in (1, 2):  # trigrams across two texts
        cross = first[1:-1] - k
        ok[cross[cross >= 0]] = False
    ok = ok[: len(code)]
    size = np.diff(offs)
    return code[ok[: len(code)]], np.concatenate([[0], np.cumsum(size)])


def svm(x: np.ndarray, y: np.ndarray, reg: float = 1e-4, rounds: int = 250) -> tuple[np.ndarray, float]:
    """L2-regularised squared-hinge linear machine for labels -1 and 1, classes weighted alike."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    vote = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    y = y.astype(np.float32)
    rate = np.float32(1 / (2 * np.sum(vote * (np.einsum('ij,ij->i', x, x) + 1)) + reg))
    reg = np.float32(reg)
    pw, pb = w, b
    for it in range(rounds):
        m = np.float32(it / (it + 3))
        lw, lb = w + m * (w - pw), b + m * (b - pb)
        slack = np.maximum(0, 1 - y * (x @ lw + lb)) * vote * y
        pw, pb = w, b
        w, b = lw - rate * (reg * lw - 2 * (slack @ x)), lb + rate * 2 * slack.sum()
    return w, float(b)


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    languages: dict[str, tuple[str, ...]]
    machines: tuple[tuple[str, str], ...]  # (positive, negative): families, then languages
    weights: np.ndarray  # machines x DIM
    bias: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list, list]:
        """Family and language of each text; None for texts without a letter or digit."""
        code, offs = trigrams(texts)
        n = np.maximum(np.diff(offs), 1)
        margin = {
            m: textvec.row_sums(w[code], offs) / n * SCALE + b for m, w, b in zip(self.machines, self.weights, self.bias)
        }
        family = _vote(self.families, margin, len(offs) - 1)
        lang = np.full(len(offs) - 1, None, object)
        for f, names in self.languages.items():
            at = np.flatnonzero(family == f)
            if len(at):
                lang[at] = _vote(names, {m: s[at] for m, s in margin.items()}, len(at))
        return family.tolist(), lang.tolist()


SCALE = 30.0  # brings trigram shares to about unit length


def _vote(names: tuple[str, ...], margin: dict, rows: int) -> np.ndarray:
    won, total = np.zeros((len(names), rows)), np.zeros((len(names), rows))
    for i, j in combinations(range(len(names)), 2):
        s = margin[names[i], names[j]]
        won[i] += s >= 0
        won[j] += s < 0
        total[i] += s
        total[j] -= s
    if not len(names):
        return np.full(rows, None, object)
    return np.array(names, object)[np.argmax(won + np.tanh(total / 1e3) / 2, axis=0)]


def train(docs: DataFrame, families: dict[str, str] = FAMILIES, most: int = MAX_LABELLED) -> Model:
    """Fits all machines on documents of a known ``lang``; a language of no listed family is its own.

    Null and blank texts, null languages and other columns take no part; of rows that repeat both
    doc_id and text, any may be in the sample, which has at most ``most`` rows. An empty table
    gives a model that finds no language.
    """
    sample = (
        docs.filter("lang is not null and text is not null and text rlike '[^\\\\s]'")
        .select(F.xxhash64("doc_id", "text").alias("h"), "lang", "text")
    )
    known = sample.groupBy("lang").count().toArrow().to_pydict()
    each = max(1, most // max(1, len(known["lang"])))
    # about twice as many rows as wanted pass the hash, so that only those are ranked
    likely = F.lit(False)
    for lang, n in zip(known["lang"], known["count"]):
        cut = int(min(1.0, (2 * each + 50) / n) * 2**53)
        likely = F.when(F.col("lang") == lang, F.shiftrightunsigned("h", 11) <= cut).otherwise(likely)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = sample.filter(likely).withColumn("rank", rank).filter(F.col("rank") <= each)

    def features(batches):
        for batch in batches:
            for lo, part in textvec.pieces(batch.column(1)):
                code, offs = trigrams(part)
                share = np.stack([np.bincount(code[a:b], minlength=DIM) / max(1, b - a) for a, b in zip(offs[:-1], offs[1:])]).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(part)), pa.array([x.tobytes() for x in share], pa.binary()), batch.column(2).slice(lo, len(part))],
                    names=["lang", "share", "h"],
                )

    got = picked.select("lang", "text", "h").mapInArrow(features, "lang string, share binary, h long").toArrow().sort_by([("lang", "ascending"), ("h", "ascending")])
    langs = got["lang"].to_pylist()
    x = textvec.raw(got["share"])[0].view(np.float32).reshape(-1, DIM) * np.float32(SCALE)
    lang = np.array(langs, object)
    family = np.array([families.get(v, v) for v in langs], object)
    names = tuple(sorted(set(family)))
    inside = {f: tuple(sorted(set(lang[family == f]))) for f in names}
    machines, ws, bs = [], [], []
    for of, group in [(family, names), *((lang, inside[f]) for f in names)]:
        for a, b in combinations(group, 2):
            mine = (of == a) | (of == b)
            w, bias = svm(x[mine], np.where(of[mine] == a, 1.0, -1.0))
            machines.append((a, b))
            ws.append(w)
            bs.append(bias)
    return Model(names, inside, tuple(machines), np.array(ws).reshape(-1, DIM), np.array(bs))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, family, predicted)`` for each row, repeated ones and null ids too.

    Both are null for null and empty texts and those without a letter or digit, and where the model
    knows no language. Very long texts count whole. Ties go to the name that sorts first. An empty
    table gives an empty result; other columns, of whatever names, are ignored; doc_id is a whole
    number.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for lo, part in textvec.pieces(batch.column(1)):
                family, lang = shared.value.predict(part)
                b, offs = textvec.raw(part)
                some = textvec.row_sums(textvec._WORD[b], offs) > 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(part)), pa.array(family, pa.string(), mask=~some), pa.array(lang, pa.string(), mask=~some)],
                    names=["doc_id", "family", "predicted"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, family string, predicted string")
