"""Word vectors and parts of speech, computed once for each distinct word."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Word2Vec
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, text

VECTOR = 300

Tagger = Callable[[str], list[tuple[str, str, bool]]]
"""From a word alone to its pieces: text, tag, and whether it is punctuation."""

_PIECE = re.compile(r"\w+(?:\.\w+)*\.?|[^\w\s]")
_LEXICON = {
    "AND": "CCONJ", "OR": "CCONJ", "&": "CCONJ", "THE": "DET", "A": "DET", "AN": "DET", "OF": "ADP", "IN": "ADP", "FOR": "ADP", "BY": "ADP", "AT": "ADP", "ON": "ADP", "TO": "PART",
}


def rule_tagger(word: str) -> list[tuple[str, str, bool]]:
    """Tags by a small lexicon, endings and capitals."""
    out = []
    for m in _PIECE.finditer(word):
        t = m[0]
        up = t.upper()
        if not any(c.isalnum() for c in t) and t != "&":
            out.append((t, "PUNCT", True))
        elif up in _LEXICON:
            out.append((t, _LEXICON[up], False))
        elif t[0].isdigit():
            out.append((t, "NUM", False))
        elif up.endswith(("ING", "IZE", "IFY")) and t.islower():
            out.append((t, "VERB", False))
        elif up.endswith(("AL", "IC", "IVE", "OUS", "ABLE")) and t.islower():
            out.append((t, "ADJ", False))
        elif t.islower():
            out.append((t, "NOUN", False))
        else:
            out.append((t, "PROPN", False))
    return out


def word_tags(word: str, tagger: Tagger = rule_tagger) -> list[str]:
    """Tags of one word.

    An empty word has the empty tag. Punctuation is skipped. ``Corp.`` is a noun. A word with a
    hyphen gives its first proper noun only; others give the tag of each piece.
    """
    pieces = tagger(word)
    if not pieces:
        return [""]
    out = []
    for piece, tag, punct in pieces:
        if piece == "Corp.":
            out.append("NOUN")
        elif punct:
            continue
        elif "-" in word:
            if tag == "PROPN":
                out.append(tag)
                break
        else:
            out.append(tag)
    return out


def hashed_vector(word: str, size: int = VECTOR) -> np.ndarray:
    """Sum of signed hashed character trigrams, of unit length; the empty word is all 0."""
    out = np.zeros(size, np.float32)
    padded = f"<{word.lower()}>"
    for i in range(max(0, len(padded) - 2) if word else 0):
        h = 1469598103934665603
        for c in padded[i : i + 3].encode():
            h = (h ^ c) * 1099511628211 % 2**64
        out[(h >> 8) % size] += 1.0 if h & 1 << 60 else -1.0
    n = float(np.linalg.norm(out))
    return out / n if n else out


def _per_word(words: DataFrame, tagger: Tagger, vector: Callable[[str], np.ndarray] | None) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({
                "word": part["word"], "tags": [word_tags(w, tagger) for w in part["word"]],
                "vector": [vector(w).tolist() if vector else None for w in part["word"]],
            })

    return words.mapInPandas(run, "word string, tags array<string>, vector array<float>")


def nlp_features(df: DataFrame, tagger: Tagger = rule_tagger, vector: Callable[[str], np.ndarray] | None = hashed_vector, name: str = "name") -> DataFrame:
    """Adds words (raw case), word_vecs, pos and pos_num, for rows with row_id and a name.

    ``pos`` joins the tags of the words in order and may be longer or shorter than ``words``. A
    null name has null columns.
    """
    out = df.withColumn("words", text.raw_words(F.col(name)))
    exploded = out.select("row_id", F.posexplode("words").alias("at", "word"))
    table = _per_word(exploded.select("word").distinct(), tagger, vector)
    back = exploded.join(table, "word").groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("at", "tags", "vector"))).alias("_w"))
    pos = F.flatten(F.transform("_w", lambda x: x["tags"]))
    return (
        out.join(back, "row_id", "left").withColumn("word_vecs", F.transform("_w", lambda x: x["vector"])).withColumn("pos", pos)
        .withColumn("pos_num", F.transform("pos", arrays.pos_code)).drop("_w")
    )


def fit_word_vectors(df: DataFrame, size: int = VECTOR, seed: int = 42):
    """Word vectors trained on the names' own tokens; ``getVectors()`` is (word, vector)."""
    return Word2Vec(vectorSize=size, minCount=1, seed=seed, inputCol="words", outputCol="vector", maxIter=1).fit(df.filter("size(words) > 0"))
