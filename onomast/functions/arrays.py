"""Array, lookup and number functions of the name stages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABEL_NAMES = {0: "Important", 1: "Subsidiary", 2: "Generic", 3: "None"}
LABEL_COLOURS = {0: "#2e7d32", 1: "#1565c0", 2: "#9e9e9e", 3: "#ffffff"}
#: The universal part-of-speech tags by number; the empty tag is that of an empty word.
POS_CODES = {
    tag: k for k, tag in enumerate(
        ["", "ADJ", "ADP", "ADV", "AUX", "CONJ", "CCONJ", "DET", "INTJ", "NOUN", "NUM", "PART", "PRON", "PROPN", "PUNCT", "SCONJ", "SYM", "VERB", "X"]
    )
}


def tiles(labels: Column) -> Column:
    """Words with labels (structs word, label) as HTML: a tile of the label's colour for each, its text escaped."""
    colour = F.create_map(*[F.lit(x) for k, v in LABEL_COLOURS.items() for x in (k, v)])

    def tile(p):
        text = F.replace(F.replace(F.replace(p["word"], F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        return F.concat(F.lit('<span style="background:'), colour[p["label"].cast("int")], F.lit('">'), text, F.lit("</span>"))

    return F.array_join(F.transform(labels, tile), " ")


def first_n(a: Column, n: int = 10) -> Column:
    return F.slice(a, 1, n)


def pad_to(a: Column, value: Column, n: int = 10) -> Column:
    """The first n elements, filled up with ``value``."""
    return F.slice(F.concat(a, F.array_repeat(value, n)), 1, n)


def plus_one(a: Column) -> Column:
    return F.transform(a, lambda x: x + 1)


def positions(a: Column) -> Column:
    """1..n for n elements; an empty array for none."""
    return F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a))).otherwise(F.array().cast("array<int>"))


def one_hot(label: Column, classes: int = 4) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == label).cast("int"))


def argmax(p: Column) -> Column:
    """Index from 0 of the first greatest element."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def zip_last_label(words: Column, labels: Column) -> Column:
    """(word, label) for each word up to the shorter list; a repeated word stays first with its last label."""
    n = F.least(F.size(words), F.size(labels))
    head = F.slice(words, F.lit(1), n)

    def last(w):
        return F.get(labels, n - F.array_position(F.reverse(head), w).cast("int"))

    return F.transform(F.array_distinct(head), lambda w: F.struct(w.alias("word"), last(w).alias("label")))


def words_with_label(labelled: Column, label: int) -> Column:
    return F.transform(F.filter(labelled, lambda x: x["label"] == label), lambda x: x["word"])


def count_label(labelled: Column, label: int) -> Column:
    return F.size(F.filter(labelled, lambda x: x["label"] == label))


def entry_values(entries: Column, field: str = "value") -> Column:
    return F.transform(entries, lambda x: x[field])


def drop_none_labels(labels: Column, none: int = 3) -> Column:
    return F.filter(labels, lambda x: x != none)


def lookup(codes: dict, key: Column) -> Column:
    """The number of a key in a fixed table; an unknown key raises, as a missing code is an error."""
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return F.when(key.isNotNull(), F.coalesce(F.try_element_at(table, key), F.raise_error(F.concat(F.lit("no code for "), key.cast("string"))).cast(_kind(codes))))


def _kind(codes: dict) -> str:
    return "int" if isinstance(next(iter(codes.values())), int) else "string"


def label_name(label: Column) -> Column:
    return lookup(LABEL_NAMES, label)


def label_number(name: Column) -> Column:
    return lookup({v: k for k, v in LABEL_NAMES.items()}, name)


def pos_code(tag: Column) -> Column:
    return lookup(POS_CODES, tag)


def modified_idf(n: Column, df: Column, power: float = 0.67) -> Column:
    """(n / (1 + df)) ** power - 1; negative for words in nearly every document."""
    return F.pow(n.cast("double") / (1 + df.cast("double")), F.lit(power)) - 1


def share_of(value: Column, total: Column) -> Column:
    """value / total; null for a total of 0."""
    return F.try_divide(value, total)


def min_max(value: Column, low: Column, high: Column) -> Column:
    """(value - low) / (high - low); null where they're equal."""
    return F.try_divide(value - low, high - low)


def place_weight(i: Column, length: Column, total: float = 85.0) -> Column:
    """Weight of 0-based place i among ``length``: 1 / (i + 1)**2, scaled to sum to ``total``."""
    def square(k):
        return 1.0 / ((k + 1) * (k + 1)).cast("double")

    whole = F.aggregate(F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0))), F.lit(0.0), lambda s, k: s + square(k))
    return square(i) * (F.lit(total) / whole)


def half_even(x: Column) -> Column:
    """Rounding to whole numbers, halves to the even one."""
    return F.bround(x.cast("double"))
