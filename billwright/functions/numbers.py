"""Numbers that arrive as text, and money."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from billwright import rules

AMOUNT = "decimal(18,4)"
MONEY = "decimal(18,2)"
_NUMBER_PREFIX = r"^[\s ﻿]*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)"


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def parse_number(x):
    """Longest numeric prefix after dropping thousands commas; null when there is none."""
    prefix = F.regexp_extract(F.regexp_replace(_c(x).cast("string"), ",", ""), _NUMBER_PREFIX, 1)
    return prefix.try_cast(AMOUNT)


def number_in(df, name):
    """Number in a column of a frame: numeric columns as they are, texts parsed."""
    numeric = isinstance(df.schema[name].dataType, T.NumericType)
    return F.col(name).cast(AMOUNT) if numeric else parse_number(name)


def parse_loose_number(x):
    """Drop every character that is not a digit, dot or minus, then parse; 0 when nothing is left."""
    kept = F.regexp_replace(_c(x).cast("string"), r"[^0-9.-]+", "")
    return F.coalesce(parse_number(kept), F.lit(0).cast(AMOUNT))


def money(x):
    """Two decimals, half up. Callers pass decimals, never doubles."""
    return F.round(_c(x), 2).cast(MONEY)


def blank(x):
    """Null and the empty string are the same thing in sheet data."""
    return F.coalesce(_c(x), F.lit("")) == ""


def or_else(x, *others):
    """First non-empty text."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in (x, *others)])


def clean_quantity(x):
    """Number as it is, empty is 1, number words, first number in the text, else 1.

    The pattern is the intended one (a run of digits and dots).
    """
    text = F.lower(F.trim(_c(x).cast("string")))
    word = F.lit(None).cast(AMOUNT)
    for name, value in rules.NUMBER_WORDS.items():
        word = F.when(text == name, F.lit(value).cast(AMOUNT)).otherwise(word)
    found = F.regexp_extract(text, r"[\d.]+", 0)
    return F.coalesce(text.try_cast(AMOUNT), word, parse_number(found), F.lit(1).cast(AMOUNT))


def nonzero_text(x):
    """Number as text, with 0 and unreadable values as '' (B12). The whole text must be a number."""
    value = F.trim(_c(x).cast("string")).try_cast(AMOUNT)
    return F.when(F.coalesce(value, F.lit(0)) == 0, F.lit("")).otherwise(plain_text(value))


def plain_text(x):
    """Decimal as text without trailing zeros."""
    text = _c(x).cast("string")
    return F.when(
        text.contains("."), F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")
    ).otherwise(text)


def display(value, header):
    """Cell text for display: money with 2 to 3 decimals, quantities with none, the rest as is."""
    value, header = _c(value), F.coalesce(_c(header), F.lit(""))
    clean = F.regexp_replace(F.trim(value), ",", "")
    numeric = clean.rlike(r"^-?\d+(\.\d+)?$")
    number = clean.try_cast("decimal(28,6)")
    is_qty = header.rlike(rules.QTY_COLUMN)
    is_money = header.rlike(rules.MONEY_COLUMN)
    thousandths = F.format_number(F.round(number, 3), 3)
    as_money = F.regexp_replace(thousandths, r"(\.\d\d)0$", "$1")
    as_qty = F.format_number(F.round(number, 0), 0)
    return F.when(numeric & is_qty, as_qty).when(numeric & is_money, as_money).otherwise(value)
