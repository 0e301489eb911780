"""Text rules: town keys, kanji numerals, cleaning and validation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landlens.functions.numeric import let

# Kanji digits 0-9, and white space beyond ASCII.
KANJI_DIGITS = "零一二三四五六七八九"
_WIDE_SPACES = (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
ANY_SPACE = "[\\s" + "".join(chr(c) for c in _WIDE_SPACES) + "]"
CHOME = "丁目"


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Full compatibility normalisation, one Arrow batch at a time."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def kanji_number(value: Column) -> Column:
    """0..99 as a kanji numeral, larger numbers as decimal text."""
    number = value.cast("int")
    digit = lambda n: F.substring(F.lit(KANJI_DIGITS), n + 1, F.lit(1))
    tens, ones = F.floor(number / 10).cast("int"), F.pmod(number, F.lit(10))
    return (
        F.when(number < 10, digit(number))
        .when(number >= 100, number.cast("string"))
        .otherwise(
            F.concat(
                F.when(tens > 1, digit(tens)).otherwise(""),
                F.lit("十"),
                F.when(ones > 0, digit(ones)).otherwise(""),
            )
        )
    )


def _chome_to_kanji(value: Column) -> Column:
    """Rewrite each run of digits directly before 丁目; the text is cut at every 丁目 and glued again."""

    def numeral(digits: Column) -> Column:
        return F.when(F.length(digits) <= 2, let(digits.try_cast("int"), kanji_number)).otherwise(digits)

    def piece(text: Column, index: Column, last: Column) -> Column:
        head = F.regexp_replace(text, "[0-9]+$", "")
        digits = F.regexp_replace(F.substring(text, F.length(head) + 1, F.length(text)), "^0+(?=[0-9])", "")
        changed = F.concat(head, let(digits, numeral))
        return F.when((index < last) & text.rlike("[0-9]$"), changed).otherwise(text)

    def rewrite(text: Column) -> Column:
        glued = let(
            F.split(text, CHOME),
            lambda parts: F.array_join(F.transform(parts, lambda t, i: piece(t, i, F.size(parts) - 1)), CHOME),
        )
        return F.when(text.rlike("[0-9]" + CHOME), glued).otherwise(text)

    return let(value, rewrite)


def normalize_town(raw: Column) -> Column:
    """Comparable town key: compatibility forms resolved, no spaces, no prefecture or ward, numerals in kanji.

    Spark has no NFKC, so that step is an Arrow function: apply it to distinct texts where texts repeat.
    """
    value = F.regexp_replace(nfkc(raw), ANY_SPACE, "")
    value = F.regexp_replace(value, "^東京都", "")
    value = F.regexp_replace(value, "^.+?[区市](?=.)", "")
    return F.coalesce(_chome_to_kanji(value), F.lit(""))


def trimmed(value: Column) -> Column:
    """Trim any white space; empty becomes NULL."""
    return F.nullif(F.regexp_replace(value, f"^{ANY_SPACE}+|{ANY_SPACE}+$", ""), F.lit(""))


def clean_text(value: Column, max_length: int) -> tuple[Column, Column]:
    """(text, error): over-long text is reported, never cut."""
    text = trimmed(value)
    too_long = F.length(text) > max_length
    return F.when(~too_long, text), F.when(too_long, F.lit("text_too_long"))


NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_optional_number(value: Column) -> tuple[Column, Column]:
    """(number, error): blank means NULL, anything not a finite number is an error."""
    text = trimmed(value)
    parsed = F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
    finite = parsed.isNotNull() & (F.abs(parsed) < F.lit(float("inf")))
    return F.when(finite, parsed), F.when(text.isNotNull() & ~finite, F.lit("not_a_number"))


def normalize_enum(value: Column, allowed: tuple[str, ...], default: str = "unknown") -> Column:
    return F.when(value.isin(*allowed), value).otherwise(default)


def bool_like(value: Column) -> Column:
    """true / yes / 1 in any case, with surrounding spaces; everything else is false."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "yes", "1"), F.lit(False))


def contains_text(needle: str, *columns: Column) -> Column:
    """Case-insensitive search over several columns glued together; a NULL column counts as empty."""
    wanted = needle.strip().lower()
    if not wanted:
        return F.lit(True)
    return F.contains(F.lower(F.concat_ws("", *columns)), F.lit(wanted))
