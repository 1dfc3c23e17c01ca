"""From raw lines to one cleaned text per section."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wordloom.functions.text import (
    DIGIT_PATTERN,
    SHOUTED_PATTERN,
    VISIBLE_PATTERN,
    match_or_null,
    number_from_word,
)
from wordloom.operators.prefix import CHUNK_ROWS, fill_down, running_section
from wordloom.operators.verbs import aslist

# The two heading families and the codes of the second one.
BOOK_HEADING = r"BOOK ([A-Z]*)"
EPILOGUE_HEADING = r"([A-Z]*)\sEPILOGUE"
FIRST_EPILOGUE, LATER_EPILOGUE = "SIXTEEN", "SEVENTEEN"
# First book of volumes 2, 3, 4 and of the closing part.
VOLUME_STARTS = (4, 9, 12, 16)


def extract_heading(df: DataFrame, col: str, pattern: str, out: str, group: int = 1) -> DataFrame:
    """First match of ``pattern`` in a column, NULL where there is none."""
    return df.withColumn(out, match_or_null(col, pattern, group))


def extract_epilogue(
    df: DataFrame, col: str, out: str = "epilogue", pattern: str = EPILOGUE_HEADING, first: str = "FIRST"
) -> DataFrame:
    """Second heading family, recoded to the number words after the last book."""
    found = match_or_null(col, pattern)
    code = F.when(found == first, FIRST_EPILOGUE).otherwise(LATER_EPILOGUE)
    return df.withColumn(out, F.when(found.isNotNull(), code))


def number_words(df: DataFrame, col: str, max: int = 17) -> DataFrame:
    """Spelled numbers in ``col`` become integers."""
    return df.withColumn(col, number_from_word(col, max))


def bucket(df: DataFrame, col: str, bounds: Sequence, labels: Sequence, out: str) -> DataFrame:
    """``labels[i]`` for the first ``bounds[i]`` above the value, else the last label.

    A NULL falls through to the last label, as in a chain of conditions.
    """
    if len(labels) != len(bounds) + 1:
        raise ValueError("need one more label than bounds")
    chain = None
    for bound, label in zip(bounds, labels):
        test = F.col(col) < bound
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return df.withColumn(out, chain.otherwise(labels[-1]))


def keep_prose(df: DataFrame, text: str, keys: Sequence[str] = ()) -> DataFrame:
    """Drop keyless, blank, shouted and numbered lines."""
    for key in aslist(keys):
        df = df.where(F.col(key).isNotNull())
    col = F.col(text)
    return df.where(col.rlike(VISIBLE_PATTERN) & ~col.rlike(SHOUTED_PATTERN) & ~col.rlike(DIGIT_PATTERN))


def collapse_text(
    df: DataFrame, keys: Sequence[str], text: str, order: str, sep: str = " ", chunk: int = CHUNK_ROWS
) -> DataFrame:
    """One text per key, its lines joined in order.

    Lines are first joined within chunks of the order column, so the last step
    meets a few long pieces per key rather than all of its lines.
    """
    keys = aslist(keys)

    def paste(order_col: str):
        return F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(order_col, text))), lambda x: x[text]), sep
        ).alias(text)

    pieces = (
        df.where(F.col(text).isNotNull())
        .withColumn("__chunk", F.floor(F.col(order) / F.lit(chunk)))
        .groupBy(*keys, "__chunk")
        .agg(paste(order))
    )
    return pieces.groupBy(*keys).agg(paste("__chunk"))


def structure_sections(
    lines: DataFrame, text: str, order: str, marker: str = "chapter", offset: int = -365, by: Sequence[str] = ()
) -> DataFrame:
    """Ordered lines → ``volume, book, chapter, text`` (whole clean-up chain)."""
    by = aslist(by)
    heads = extract_epilogue(extract_heading(lines, text, BOOK_HEADING, "book"), text)
    heads = heads.withColumn("book", F.coalesce("epilogue", "book")).drop("epilogue")
    numbered = running_section(
        heads, F.lower(F.col(text)).contains(marker), order, by=by, offset=offset, out="chapter"
    )
    filled = number_words(fill_down(numbered, ["book"], order, by=by), "book")
    coded = bucket(filled, "book", VOLUME_STARTS, (1, 2, 3, 4, 5), "volume")
    return collapse_text(keep_prose(coded, text, ["book"]), [*by, "volume", "book", "chapter"], text, order)
