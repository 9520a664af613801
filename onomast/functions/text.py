"""String functions of the name stages, all of them built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = r"^\s+|\s+$"


def upper_or_empty(name: Column) -> Column:
    """Upper case; null becomes the empty string."""
    return F.upper(F.coalesce(name, F.lit("")))


def split_blank(text: Column) -> Column:
    """Parts between single blanks; empty parts stay."""
    return F.split(text, " ", -1)


def ampersand_word(words: Column) -> Column:
    """A token that is just ``&`` becomes ``AND``."""
    return F.transform(words, lambda w: F.when(w == "&", F.lit("AND")).otherwise(w))


def plain_word(word: Column) -> Column:
    return F.regexp_replace(word, "[^A-Za-z0-9&]", "")


def plain_words(words: Column) -> Column:
    """Tokens without anything but ASCII letters, digits and ``&``."""
    return F.transform(words, plain_word)


def drop_empty(words: Column) -> Column:
    return F.filter(words, lambda w: w != "")


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, EDGES, "")


def name_key(name: Column) -> Column:
    """Upper case without outer white space: what counts as the same name in the report."""
    return F.upper(strip(name))


def weighting_words(name: Column) -> Column:
    """Tokens for weighting: upper, split, ``&`` to AND, cleaned, empties dropped."""
    return drop_empty(plain_words(ampersand_word(split_blank(upper_or_empty(name)))))


def raw_words(name: Column) -> Column:
    """Tokens in their own case after `` - `` has become one blank."""
    return split_blank(F.replace(name, F.lit(" - "), F.lit(" ")))


def matching_words(words: Column) -> Column:
    """Raw tokens as compared in matching: upper and cleaned; empties stay."""
    return F.transform(words, lambda w: plain_word(F.upper(w)))


_CARE_OF = r"(?i)\b(c\s*/\s*o|contractor\s*/\s*operator)\b"


def split_slash(text: Column) -> Column:
    """Parts between slashes that aren't part of care-of marks, stripped, empties dropped."""
    parts = F.split(F.regexp_replace(text, _CARE_OF, ""), "/", -1)
    return drop_empty(F.transform(parts, strip))


_CODE = r"^\d{3}-\d{6}$"


def keeps_bracket(bracket: Column) -> Column:
    """Whether a bracket is a region mark or a code, and so belongs to the name."""
    return bracket.contains("APAC") | bracket.contains("EMEA") | bracket.rlike(_CODE)


def split_compound(name: Column) -> Column:
    """The names within a compound name; null gives an empty list."""
    t = strip(name)
    opening = F.instr(t, "(")
    base = strip(F.substring_index(t, "(", 1))
    bracket = F.substring(t, opening + 1, F.length(t) - opening - 1)
    parts = (
        F.when(
            t.endswith(")") & (opening > 0),
            F.when(bracket.contains("/"), F.concat(F.array(base), split_slash(bracket)))
            .when(keeps_bracket(bracket), F.array(t)).otherwise(F.array(base, bracket)),
        )
        .when(t.contains("/"), split_slash(t))
        .otherwise(F.array(t))
    )
    return F.when(name.isNull(), F.array().cast("array<string>")).otherwise(F.transform(drop_empty(parts), strip))


def join_labels(labels: Column) -> Column:
    """Label numbers as text: ``"0, 1"``; one label ends with ``", "``, none is empty."""
    text = F.array_join(F.transform(labels, lambda x: x.cast("string")), ", ")
    return F.when(F.size(labels) == 1, F.concat(text, F.lit(", "))).otherwise(text)


def parse_labels(text: Column) -> Column:
    """The label numbers of ``join_labels`` text."""
    return F.transform(drop_empty(F.transform(F.split(text, ",", -1), strip)), lambda x: x.cast("int"))
