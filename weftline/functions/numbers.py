"""Number helpers: thresholds named in text and six-place half-even ratios."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import ascii_digits

# Number words and their values.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7,
    "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13,
    "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18,
    "nineteen": 19, "twenty": 20,
}

# How a question may name qualifying postings.
POSTING_TERMS = (
    "qualifying claims", "qualifying financial postings", "qualifying postings", "financial postings",
)

# How an amount and a count are asked for; every Unicode blank separates.
MONEY_PATTERN = r"(?:above|over|greater than)[\s\x1c-\x1f\x{85}\p{Z}]+(?:eur[\s\x1c-\x1f\x{85}\p{Z}]*)?([\d,]+)"
COUNT_PATTERN = r"(?:at least|more than|over)[\s\x1c-\x1f\x{{85}}\p{{Z}}]+(\d+|[a-z]+)[\s\x1c-\x1f\x{{85}}\p{{Z}}]+(?:{})"


def money_threshold(text: Column) -> Column:
    """The amount after above / over / greater than, thousands separators removed."""
    found = F.regexp_extract(ascii_digits(text), MONEY_PATTERN, 1)
    return F.replace(found, F.lit(","), F.lit("")).try_cast("bigint")


def count_threshold(text: Column, terms: tuple[str, ...] = POSTING_TERMS) -> Column:
    """The count before a posting term, as digits or as a number word up to twenty."""
    found = F.regexp_extract(ascii_digits(text), COUNT_PATTERN.format("|".join(terms)), 1)
    words = F.create_map(*[F.lit(x) for x in chain.from_iterable(NUMBER_WORDS.items())])
    return F.coalesce(found.try_cast("bigint"), F.try_element_at(words, found).cast("bigint"))


def support_package(token: Column) -> Column:
    """The number in a support-package token such as sp05, else null."""
    return F.regexp_extract(token, r"\Asp(\d{1,2})\z", 1).try_cast("int")


def ratio6(numerator: Column, denominator: Column) -> Column:
    """Quotient of two counts rounded half-even to six places; null on a zero denominator."""
    top, bottom = numerator.cast("decimal(18,0)"), denominator.cast("decimal(18,0)")
    return F.bround(F.try_divide(top, bottom), 6).cast("decimal(18,6)")
