"""Tokenisers as Column expressions. Each of the five has its own contract; they are not interchangeable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what is stripped from both ends of a word.
EDGE = ".,!?;:\"'()"


def raw_words(text: Column) -> Column:
    """Lower-cased, split at white space; none empty."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda x: x != "")


def strip_edges(word: Column) -> Column:
    return F.btrim(word, F.lit(EDGE))


def words(text: Column) -> Column:
    """Stripped words; a word of punctuation alone stays as an empty one. (Also what BM25 counts.)"""
    return F.transform(raw_words(text), strip_edges)


def letters(text: Column) -> Column:
    """Runs of two or more letters a to z that stand alone, of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b[a-z]{2,}\b"), F.lit(0))


def vector_terms(text: Column) -> Column:
    """Runs of two or more word characters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def content_words(text: Column, stop_words: list[str]) -> Column:
    """Stripped words that are no stop words and were longer than two characters before they were stripped; repeats stay."""
    long = F.filter(raw_words(text), lambda x: F.length(x) > 2)
    return F.filter(F.transform(long, strip_edges), lambda x: ~x.isin(*stop_words))
