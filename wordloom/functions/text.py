"""Text expressions: tokens, apostrophes, labels, number words."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# A word is a run of letters, marks, digits or underscores, with
# single inner apostrophes or full stops.  Both regex engines used in the
# checks (java.util.regex and RE2) read it the same way.
WORD_PATTERN = r"([\p{L}\p{M}\p{N}_]+(?:[’'.][\p{L}\p{M}\p{N}_]+)*)"
POSSESSIVE = "’s"

# A heading or shouted line, and a line with a digit in it.
SHOUTED_PATTERN = r"[A-Z]{4,}\s([IVXLCM]+\s)?"
DIGIT_PATTERN = r"[0-9]"
VISIBLE_PATTERN = r"\S"

_UNITS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen "
    "fourteen fifteen sixteen seventeen eighteen nineteen"
).split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def spell_number(value: int) -> str:
    """English name of 1..99, hyphenated above twenty."""
    if not 1 <= value <= 99:
        raise ValueError("only 1..99 can be spelled")
    if value < 20:
        return _UNITS[value - 1]
    tens, unit = divmod(value, 10)
    name = _TENS[tens - 2]
    return f"{name}-{_UNITS[unit - 1]}" if unit else name


def words_of(text: Column | str, normalize_apostrophes: bool = False) -> Column:
    """Lower-cased words of a text as an array."""
    col = F.lower(F.col(text) if isinstance(text, str) else text)
    if normalize_apostrophes:
        col = F.translate(col, "’", "'")
    return F.regexp_extract_all(col, F.lit(WORD_PATTERN), F.lit(1))


def ngrams_of(words: Column, n: int) -> Column:
    """All runs of ``n`` neighbouring words, joined by a space.

    An array with fewer than ``n`` words gives an empty array.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    first = F.slice(words, 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))
    return F.coalesce(
        F.transform(first, lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, n)])),
        F.array().cast("array<string>"),
    )


def without_possessive(col: Column | str, normalize_apostrophes: bool = False) -> Column:
    """Drop every ``’s``; with normalized apostrophes it is written ``'s``."""
    col = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(col, "['’]s", "") if normalize_apostrophes else F.replace(col, F.lit(POSSESSIVE), F.lit(""))


def match_or_null(col: Column | str, pattern: str, group: int = 1) -> Column:
    """First match of a group, or NULL (Spark alone would give '')."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col.rlike(pattern), F.regexp_extract(col, pattern, group))


def number_from_word(col: Column | str, max: int = 17) -> Column:
    """1 for ONE .. ``max``; NULL for anything else."""
    col = F.col(col) if isinstance(col, str) else col
    pairs = []
    for i in range(1, max + 1):
        pairs += [F.lit(spell_number(i).upper()), F.lit(i)]
    return F.element_at(F.create_map(*pairs), F.upper(col))


def plain_number(col: Column, digits: int) -> Column:
    """Half-even rounded number as text, without trailing zeros."""
    text = F.bround(col.cast("decimal(38,12)"), digits).cast("string")
    if digits <= 0:
        return text
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def percent_label(col: Column | str, digits: int = 0) -> Column:
    """``12.25`` → ``12.2 %`` (the input is already a percentage)."""
    col = F.col(col) if isinstance(col, str) else col
    return F.concat_ws(" ", plain_number(col, digits), F.lit("%"))


def round_even(col: Column | str, digits: int = 0) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.bround(col, digits)
