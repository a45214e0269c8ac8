"""Text helpers. Java regexes use (?U) so that \\w, \\s, \\b and (?i) follow Unicode."""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every Unicode blank, and the marks that separate request tokens.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
TOKEN_MARKS = ",!?;:()[]{}\"'"

_DECIMALS = [c for c in map(chr, range(0x80, 0x10000)) if unicodedata.decimal(c, None) is not None]
_DIGITS = "".join(_DECIMALS), "".join(str(unicodedata.decimal(c)) for c in _DECIMALS)

# Where a text line ends.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"

# Words and marks that make a text look like SQL. Field values also reject "with".
SQL_WORDS = (
    "alter", "attach", "begin", "commit", "copy", "create", "delete", "drop", "execute", "export", "import",
    "insert", "load", "pragma", "rollback", "select", "truncate", "union", "update", "vacuum",
)
_SQL_MARKS = r";|--|/\*|\*/"
_CTE = r"\bwith\s+[A-Za-z_][A-Za-z0-9_]*\s+as\s*\("

# Identifier formats.
CANONICAL_ID = r"\A[a-z][a-z0-9_-]*:[A-Za-z][A-Za-z0-9_-]*\z"
COUNTRY_CODE = r"\A[A-Z]{2}\z"
PRODUCT_ID = r"\A[A-Za-z][A-Za-z0-9]*\z"
SEMANTIC_VERSION = r"\A(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\z"


@functools.cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Code points that fold to one other, what these are, and those that fold to several, by the Unicode tables."""
    folded = {c: f for c in map(chr, range(0x110000)) if (f := c.casefold()) != c}
    single = {c: f for c, f in folded.items() if len(f) == 1}
    return "".join(single), "".join(single.values()), {c: f for c, f in folded.items() if len(f) > 1}


# Folds that lower() leaves alone in everyday texts.
_COMMON_FOLDS = {"ß": "ss", "ς": "σ", "ſ": "s"}


@functools.cache
def _rare_letters() -> str:
    """A character class with every code point that lower() and the common folds may not fold: few ranges, wider than needed.

    Below U+0530, where lower() is the same in every version of Unicode, these are only the letters with a fold of their own.
    """
    single, _, several = _folds()
    rare = sorted(
        ord(c) for c in (*single, *several) if c not in _COMMON_FOLDS and (ord(c) >= 0x530 or c.lower() != c.casefold())
    )
    ranges = [[rare[0], rare[0]]]
    for c in rare[1:]:
        if c - ranges[-1][1] <= (0x40 if c >= 0x530 else 1):
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in ranges) + "]"


def fold_case(text: Column) -> Column:
    """Full Unicode case folding, the same as Python's for every code point.

    Texts in ASCII are only lower-cased, and the whole table is used where a letter needs it.
    """
    old, new, several = _folds()
    letters = f"[{''.join(several)}]"
    table = F.from_json(F.lit(json.dumps(several)), "map<string,string>")
    parts = F.split(text, f"(?<={letters})|(?={letters})")
    expanded = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(table, p), p)), "")
    lowered = common = F.lower(text)
    for letter, fold in _COMMON_FOLDS.items():
        common = F.replace(common, F.lit(letter), F.lit(fold))
    return (
        F.when(F.octet_length(text) == F.char_length(text), lowered)
        .when(F.rlike(text, F.lit(_rare_letters())), F.translate(expanded, old, new))
        .otherwise(common)
    )


def normalize_term(text: Column) -> Column:
    """Case-folded text with - _ / as blanks and every run of blanks as one."""
    return F.trim(F.regexp_replace(_blanked(fold_case(text), BLANKS + "-_/"), " {2,}", " "))


def _blanked(text: Column, characters: str) -> Column:
    return F.translate(text, characters, " " * len(characters))


def plural_variants(term: Column) -> Column:
    """The normalised term and, where different, its regular plural."""
    base = normalize_term(term)
    plural = (
        F.when(F.endswith(base, F.lit("y")), F.regexp_replace(base, r"y\z", "ies"))
        .when(F.endswith(base, F.lit("s")), base)
        .otherwise(F.concat(base, F.lit("s")))
    )
    return F.when(base == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.array(base, plural))
    )


def boundary_tokens(text: Column) -> Column:
    """Case-folded tokens; listed punctuation separates, a dot stays only before a digit."""
    spaced = F.regexp_replace(_blanked(fold_case(text), BLANKS + TOKEN_MARKS), r"(?U)\.(?!\d)", " ")
    return F.array_remove(F.split(spaced, " +"), "")


def text_lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def looks_like_sql(text: Column, natural_language: bool = False) -> Column:
    """Whether a text carries SQL; in prose, "with" counts only as a common table expression."""
    words = SQL_WORDS if natural_language else [*SQL_WORDS, "with"]
    found = F.rlike(text, F.lit(rf"(?iU)(?:{_SQL_MARKS}|\b(?:{'|'.join(words)})\b)"))
    return found | F.rlike(text, F.lit(f"(?iU){_CTE}")) if natural_language else found


def strip(text: Column) -> Column:
    """The text without blanks of any kind at its ends."""
    return F.btrim(text, F.lit(BLANKS))


def ascii_digits(text: Column) -> Column:
    """Decimal digits of every script as 0 to 9."""
    return F.translate(text, *_DIGITS)


def redact(text: Column, limit: int = 512) -> Column:
    """Mask credentials, then cut to the limit."""
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 0:
        raise ValueError("limit must be a whole number of at least 0")
    return F.left(mask_credentials(text), F.lit(limit))


def mask_credentials(text: Column) -> Column:
    """Credentials masked in four ordered steps, the text whole."""
    # The mask, the credential names and the schemes.
    mask = "[REDACTED]"
    masked = F.regexp_replace(
        text, r"(?iU)(authorization\s*[:=]\s*(?:bearer|basic)\s+)[^\s,;]+", f"$1{mask}"
    )
    masked = F.regexp_replace(
        masked, r"(?iU)\b(basic|bearer)\s+[^\s,;]+", "\x01$1\x01 " + mask
    )
    masked = F.regexp_replace(masked, "\x01(?i:basic)\x01", "Basic")
    masked = F.regexp_replace(masked, "\x01(?i:bearer)\x01", "Bearer")
    masked = F.regexp_replace(
        masked,
        r"(?iU)(\b(?:password|passwd|secret|token|api[_-]?key|credential)\s*[:=]\s*)[^\s,;]+",
        f"$1{mask}",
    )
    return F.regexp_replace(
        masked, r"(?iU)\b([a-z][a-z0-9+.-]*://)([^\s/@:]*):([^\s/@]+)@", f"$1{mask}@"
    )


def local_name(iri: Column) -> Column:
    """The part of an identifier after its last / or #."""
    return F.regexp_extract(iri, r"([^/#]*)\z", 1)


def is_canonical_id(value: Column) -> Column:
    return F.rlike(value, F.lit(CANONICAL_ID))


def is_country_code(value: Column) -> Column:
    return F.rlike(value, F.lit(COUNTRY_CODE))


def is_product_id(value: Column) -> Column:
    return F.rlike(value, F.lit(PRODUCT_ID))


def is_semantic_version(value: Column) -> Column:
    return F.rlike(value, F.lit(SEMANTIC_VERSION))


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of the row as compact JSON with its fields in name order, nulls kept."""
    document = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return F.sha2(document, 256)


def iso_date(text: Column) -> Column:
    """A valid ISO 8601 calendar date (dashed or basic) or week date, else null."""
    year_known = ~F.startswith(text, F.lit("0000"))
    basic = F.regexp_replace(text, r"\A(\d{4})(\d{2})(\d{2})\z", "$1-$2-$3")
    return F.when(
        F.rlike(text, F.lit(r"\A\d{4}-\d{2}-\d{2}\z")), F.when(year_known, text.try_cast("date"))
    ).when(
        F.rlike(text, F.lit(r"\A\d{8}\z")), F.when(year_known, basic.try_cast("date"))
    ).when(F.rlike(text, F.lit(_WEEK_DATE)) & year_known, _week_date(text))


# Fixed value: year, week and weekday, dashed or basic.
_WEEK_DATE = r"\A(\d{4})(?:-W(\d{2})(?:-([1-7]))?|W(\d{2})([1-7])?)\z"


def _week_date(text: Column) -> Column:
    def part(group: int) -> Column:
        return F.nullif(F.regexp_extract(text, _WEEK_DATE, group), F.lit("")).try_cast("int")

    year, week = part(1), F.coalesce(part(2), part(4))
    weekday = F.coalesce(part(3), part(5), F.lit(1))
    first_monday = F.trunc(F.make_date(year, F.lit(1), F.lit(4)), "week")
    monday = F.date_add(first_monday, (week - 1) * 7)
    in_year = (week >= 1) & (F.year(F.date_add(monday, 3)) == year)
    return F.when(in_year, F.date_add(monday, weekday - 1))
