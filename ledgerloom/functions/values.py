"""Typed values: coercion, and whether a printed text carries one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import coerce_date
from .money import minor_in
from .text import SPACE, collapsed, contains_words, loose, trimmed, words

# The field types.
TYPES = ("string", "amount", "date", "integer")


def coerce_integer(raw: Column) -> Column:
    text = trimmed(raw)
    return F.when(F.regexp_like(text, F.lit(r"^-?[0-9]+$")), text.try_cast("bigint"))


def coerce_string(raw: Column) -> Column:
    text = trimmed(raw)
    return F.when(text != "", text)


def coerced(kind: Column, raw: Column) -> Column:
    """The value of a raw text under a field type, as text: minor units, ISO date, digits or the trimmed string; null if it has none."""
    return (
        F.when(kind == "amount", minor_in(raw).cast("string"))
        .when(kind == "date", coerce_date(raw))
        .when(kind == "integer", coerce_integer(raw).cast("string"))
        .when(kind == "string", coerce_string(raw))
    )


def printed_integer(text: Column) -> Column:
    """A whole number with or without a percent sign."""
    return F.nullif(F.regexp_extract(trimmed(text), rf"^(-?[0-9]+){SPACE}*%?$", 1), F.lit("")).try_cast("bigint")


def region_key(kind: Column, text: Column) -> Column:
    """What a region says when read as a type: equal to the ``coerced`` value of the same type exactly if it carries it.

    Computed once for each region and type, so that binding is an equi-join.
    """
    return (
        F.when(kind == "amount", minor_in(text).cast("string"))
        .when(kind == "date", coerce_date(text))
        .when(kind == "integer", printed_integer(text).cast("string"))
        .when(kind == "string", loose(text))
    )


def value_key(kind: Column, value: Column) -> Column:
    """The same for a coerced value."""
    return F.when(kind == "string", loose(value)).otherwise(value)


def carries(kind: Column, text: Column, value: Column) -> Column:
    """Whether one part of the text - a token, three tokens of a date, whole words - carries the value."""
    parts = words(text)
    any_amount = F.exists(parts, lambda t: F.coalesce(minor_in(t).cast("string") == value, F.lit(False)))
    any_integer = F.exists(parts, lambda t: F.coalesce(printed_integer(t).cast("string") == value, F.lit(False)))
    at = F.sequence(F.lit(1), F.size(parts))
    one = F.exists(parts, lambda t: F.coalesce(coerce_date(t) == value, F.lit(False)))
    three = F.exists(at, lambda i: (i + 2 <= F.size(parts)) & F.coalesce(coerce_date(F.array_join(F.slice(parts, i, F.lit(3)), " ")) == value, F.lit(False)))
    return (
        F.when(kind == "amount", any_amount)
        .when(kind == "integer", any_integer)
        .when(kind == "date", one | three)
        .otherwise(contains_words(text, value))
    )


def same_text(a: Column, b: Column) -> Column:
    """Equal amounts if both are amounts, else equal but for case and white space."""
    x, y = minor_in(a), minor_in(b)
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(F.lower(collapsed(a)) == F.lower(collapsed(b)))


def agrees(kind: Column, value: Column, printed: Column) -> Column:
    """Whether a typed value agrees with what the page prints; null never does."""
    return F.coalesce(value_key(kind, value) == region_key(kind, printed), F.lit(False))
