"""Scores of text answers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: words of a first sentence that make it a negative answer
NEGATIVE = ["No", "not", "no"]


def says_yes(text: Column) -> Column:
    """Whether the first sentence has none of the negative words."""
    words = F.split(F.replace(F.substring_index(text, ".", 1), F.lit(","), F.lit("")), " ")
    return ~F.arrays_overlap(words, F.array(*map(F.lit, NEGATIVE)))


def soft_vote(same: Column, votes: Column) -> Column:
    """Mean over the votes of min(1, matches / 3) with that vote left out; same of the votes equal the answer."""
    capped = lambda n: F.least(F.lit(1.0), n / 3)
    return (same * capped(same - 1) + (votes - same) * capped(same)) / votes


def levenshtein_similarity(answer: Column, truth: Column, least: float = 0.5) -> Column:
    """1 - distance / longer length of the trimmed lower-case texts, 0 if under least; 1 for two empty texts."""
    a, b = F.lower(F.trim(answer)), F.lower(F.trim(truth))
    s = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when(s >= least, s).otherwise(F.when(s.isNotNull(), 0.0))


def exact_match(answer: Column, truth: Column) -> Column:
    """The trimmed lower-case texts are equal."""
    return F.lower(F.trim(answer)) == F.lower(F.trim(truth))
