"""Captions and answers: clean-up by fixed patterns, and answer normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: head coverings, and the words that may stand before them
COVERINGS = r"(?:hijab|niqab|headscarf|head\s?scarf|head covering|turban)"
COVERING_WORDS = r"(?:(?:black|brown|white|grey|gray|dark|light|patterned|colorful|floral)\s+)*"
#: fixed values: patterns and replacements that take personal descriptions out of captions, in order
NEUTRAL = [
    (rf"(?i)\s*\bwearing (?:a |an )?{COVERING_WORDS}{COVERINGS}\b\s*", " "),
    (rf"(?i)\s*\b(?:in|with) (?:a |an )?{COVERING_WORDS}{COVERINGS}\b\s*", " "),
    (rf"(?i)\b{COVERINGS}\b", "clothing"),
    (r"(?i)\b(?:male|female) student\b", "student"),
    (r"(?i)\s*(?:\band\b|,)\s*(?:a |an )?(?:beard|moustache|mustache)\b", ""),
    (r"(?i)\s*\bwith (?:a |an )?(?:beard|moustache|mustache)\b\s*", " "),
    (r"(?i)\b(?:bearded)\s+", ""),
    (r"(?i)\s*\bor (?:a |an )?(?:beard|moustache|mustache)\b", ""),
    (r"(?i)\b(?:beard|moustache|mustache)\b", "face"),
    (r"(?i)\bhe\b|\bshe\b", "they"),
    (r"(?i)\bhis\b|\bher\b", "their"),
    (r"(?i)\bhim\b", "them"),
    (r"\s{2,}", " "),
    (r"\s+([,.])", "$1"),
]
#: fixed values: words that mark a guess
GUESSES = [
    "possibly",
    "probable", "probably",
    "maybe",
    "perhaps",
    "suggest", "suggests", "suggesting", "suggested",
    "speculate", "speculates", "speculating", "speculated",
    "assume", "assumes", "assuming", "assumed",
    "guess", "guesses", "guessing", "guessed",
    "suppose", "supposes", "supposing", "supposed",
    "appear", "appears", "appeared", "appearing",
    "seem", "seems", "seemed", "seeming",
    "indicate", "indicates", "indicating", "indicated",
    "hint", "hints", "hinting", "hinted",
    "imply", "implies", "implying", "implied",
    "infer", "infers", "inferring", "inferred",
    "expect", "expects", "expecting", "expected",
    "assuming that", "tends to", "tends not to", "seems to", "looks like",
    "sounds like", "appears to",
    " no ", " not ",
]
#: fixed values: words that a remnant of a sentence must not begin with
PREPOSITIONS = [
    "in", "on", "at", "by", "with", "about", "against", "between", "into", "through", "during", "before", "after",
    "above", "below", "to", "from", "up", "down", "for", "of", "under", "over", "as",
]
#: fixed values: a clause (between commas) that holds such a word
DOUBTFUL_CLAUSE = r",?[^,]*\b(?:" + "|".join(GUESSES) + r")\b[^,]*,?"
#: fixed values: articles, number words and marks of answers
ARTICLES = ["a", "an", "the"]
NUMBERS = {"none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
MARKS = [";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", ",", "?", "!"]


def neutralised(text: Column) -> Column:
    """The caption without headwear, beards and gender."""
    for pattern, to in NEUTRAL:
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def without_guesses(text: Column) -> Column:
    """The sentences without their clauses (between commas) that guess or deny; what then begins with a preposition, or is empty, goes."""
    doubtful = lambda s: F.exists(F.array(*map(F.lit, GUESSES)), lambda g: F.contains(s, g))

    def cleaned(s):
        rest = F.trim(F.regexp_replace(s, DOUBTFUL_CLAUSE, ""))
        rest = F.when(F.endswith(rest, F.lit(".")), rest).otherwise(F.concat(rest, F.lit(".")))
        first = F.lower(F.get(F.split(F.trim(rest), r"\s+"), F.lit(0)))
        return F.when((F.trim(rest) != ".") & ~first.isin(PREPOSITIONS), F.trim(rest))

    kept = F.transform(F.split(text, r"(?<=\.)\s+"), lambda s: F.when(doubtful(s), cleaned(s)).otherwise(F.trim(s)))
    return F.trim(F.array_join(F.array_compact(kept), " "))


def normal_answer(text: Column, contractions: dict[str, str] | None = None) -> Column:
    """The answer in lower case without marks (a space where a mark joins two words), articles and single dots; number words as digits;
    contractions as given."""
    t = F.trim(F.replace(F.replace(F.replace(F.lower(text), F.lit(",")), F.lit("?")), F.lit("'s"), F.lit(" 's")))
    t = F.trim(F.regexp_replace(t, r"[\n\t]", " "))
    whole = t
    for m in MARKS:
        loose = F.contains(whole, F.lit(m + " ")) | F.contains(whole, F.lit(" " + m))
        t = F.replace(t, F.lit(m), F.when(loose, F.lit("")).otherwise(F.lit(" ")))
    t = F.regexp_replace(t, r"\.(?!\d)", "")
    words = F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    words = F.filter(F.transform(words, lambda w: F.coalesce(F.element_at(pairs(NUMBERS), w), w)), lambda w: ~w.isin(ARTICLES))
    if contractions:
        words = F.transform(words, lambda w: F.coalesce(F.element_at(pairs(contractions), w), w))
    return F.array_join(words, " ")


def caption_spans(phrases: Column) -> Column:
    """struct(caption, spans): the phrases joined by ". ", and of each phrase [from, to) of its first place, case aside."""
    caption = F.concat(F.array_join(phrases, ". "), F.lit("."))
    return F.struct(caption.alias("caption"), F.transform(phrases, lambda p: F.struct((F.position(F.lower(p), F.lower(caption)) - 1).alias("a"), (F.position(F.lower(p), F.lower(caption)) - 1 + F.length(p)).alias("b"))).alias("spans"))


def choice_index(answer: Column, letters: list[str]) -> Column:
    """Place of the answer's letter among the choices; null if it is none."""
    at = F.array_position(F.array(*map(F.lit, letters)), F.upper(F.trim(answer)))
    return F.when(at > 0, at.cast("int") - 1)


def review_scores(text: Column) -> Column:
    """The two scores on a review's first line, separated by a comma or spaces; nulls unless there are two numbers."""
    parts = F.filter(F.split(F.replace(F.get(F.split(text, "\n"), F.lit(0)), F.lit(","), F.lit(" ")), r"\s+"), lambda p: p != "")
    two = F.transform(parts, lambda p: p.try_cast("double"))
    fine = (F.size(parts) == 2) & two[0].isNotNull() & two[1].isNotNull()
    return F.struct(F.when(fine, two[0]).alias("first"), F.when(fine, two[1]).alias("second"))
