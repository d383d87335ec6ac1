"""Text functions of the search operators, all of them built from column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.operators.barriers import let

WORD = r"[\p{L}\p{N}]+"
BETWEEN = r"[^\p{L}\p{N}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits, in order; null stays null."""
    # what splitting leaves are the words that matching would find, at a fraction of the cost; the ends can be empty
    return F.array_remove(F.split(F.lower(_col(text)), BETWEEN), "")


def identifier_tokens(name: Column | str) -> Column:
    """Tokens of a column or table name: also split before a capital that follows a small letter or digit."""
    return tokens(F.regexp_replace(_col(name), r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2"))


def bigrams(text: Column | str) -> Column:
    """Overlapping pairs of characters of the text without white space, for scripts that don't space words."""
    # characters are taken once a row: a lambda computes a text that it uses anew for each element, and finds a place in it from its start
    chars = F.array_remove(F.split(F.regexp_replace(F.lower(_col(text)), r"\s+", ""), ""), "")
    return let(chars, lambda c: F.when(F.size(c) >= 2, F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.concat(a, b))).otherwise(c))


def term_frequency(words: Column, term: str) -> Column:
    return F.size(words) - F.size(F.array_remove(words, term))


def snippet(text: Column | str, term: str, before: int = 20, width: int = 60) -> Column:
    """``width`` characters from ``before`` characters ahead of the first place of ``term``, without regard to case; null if it has none."""
    t = _col(text)
    at = F.instr(F.lower(t), term.lower())
    return F.when(at > 0, t.substr(F.greatest(at - before, F.lit(1)), F.lit(width)))


def highlight(text: Column | str, term: str, left: str = "<", right: str = ">") -> Column:
    """The text with every whole-word place of ``term`` between marks."""
    import re

    return F.regexp_replace(_col(text), rf"(?i)(?<![\p{{L}}\p{{N}}])({re.escape(term)})(?![\p{{L}}\p{{N}}])", f"{left}$1{right}")
