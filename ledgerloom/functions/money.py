"""Amounts as printed: text to exact minor units and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import EXACT, once
from .text import SPACE

# The currency codes an amount may carry and the symbols that stand for one, in order of precedence.
CODES = ("ARS", "USD", "USDT", "EUR", "BRL", "CLP", "COP", "MXN", "PEN", "UYU", "GBP", "NOK", "SEK", "DKK", "CHF", "AUD", "CAD")
SYMBOLS = (("R$", "BRL"), ("$", "USD"), ("€", "EUR"), ("£", "GBP"))

_CODE = f"(?i)(?<![A-Za-z0-9_])({'|'.join(CODES)})(?![A-Z])"
BLANKS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


#: One leading minus, then digits with or without separators, of which the last is the decimal one before one or two digits, or all are one kind before three.
_READABLE = r"^-?(?:[0-9]+|[0-9.,]*[0-9][0-9.,]*[.,][0-9]{1,2}|[0-9.]*\.[0-9]{3}|[0-9,]*,[0-9]{3})$"


def _around_code(raw: Column) -> Column:
    """What stands before and after the first currency code; one part if there is none. Texts without letters skip the search."""
    return F.when(F.regexp_like(raw, F.lit("[A-Za-z]")), F.split(raw, _CODE, 2)).otherwise(F.array(raw))


def _currency(raw: Column) -> Column:
    symbol = F.lit(None).cast("string")
    for mark, iso in reversed(SYMBOLS):
        symbol = F.when(F.contains(raw, F.lit(mark)), iso).otherwise(symbol)
    code = F.when(F.regexp_like(raw, F.lit("[A-Za-z]")), F.nullif(F.upper(F.regexp_extract(raw, _CODE, 1)), F.lit("")))
    return F.coalesce(code, symbol)


def parse_amount(raw: Column, decimals: int = 2) -> Column:
    """struct<minor decimal(38,0), currency, convention>, or null for what is not one amount.

    The last separator is the decimal one, except that three digits after the only kind of separator are thousands.
    Only the first currency code is taken out, so a second one makes the text unreadable; the sign counts at the very start.
    """

    def whole(minor: Column, b: Column) -> Column:
        last = F.regexp_extract(b, "([.,])[0-9]*$", 1)
        convention = F.when(last == "", "integer").when(last == ",", "latin").otherwise("anglo")
        return F.struct(minor.alias("minor"), _currency(raw).alias("currency"), convention.alias("convention"))

    return _parsed(raw, decimals, whole)


def minor_in(raw: Column, decimals: int = 2) -> Column:
    """``parse_amount(raw)["minor"]``, without looking for the currency."""
    return _parsed(raw, decimals, lambda minor, b: F.struct(minor.alias("minor")))["minor"]


def _parsed(raw: Column, decimals: int, shown: Callable[[Column, Column], Column]) -> Column:
    # without code, symbols and white space; what is used many times is bound by one-element transforms, which evaluate it a single time
    body = F.translate(F.replace(F.array_join(_around_code(raw), ""), F.lit("R$"), F.lit("")), "$€£" + BLANKS, "")
    sign = F.when(F.startswith(F.ltrim(raw, F.lit(BLANKS)), F.lit("-")), "-").otherwise("")

    def read(b: Column) -> Column:
        missing = F.lit(decimals) - F.length(F.regexp_extract(b, "[.,]([0-9]{1,2})$", 1))
        digits = F.concat(sign, F.translate(b, "-.,", ""), F.repeat(F.lit("0"), missing))
        if decimals < 2:  # more digits than the currency has are cut
            digits = digits.substr(F.lit(1), F.length(digits) + F.least(missing, F.lit(0)))
        return F.when(F.regexp_like(b, F.lit(_READABLE)), shown(digits.try_cast(EXACT), b))

    found = F.filter(F.transform(F.array(body), read), lambda r: r["minor"].isNotNull())
    # words are told first: an amount has a digit, and no code is longer than four letters or stands beside others
    return F.when(F.regexp_like(raw, F.lit("[0-9]")) & ~F.regexp_like(raw, F.lit("[A-Za-z]{5}")), F.get(found, F.lit(0)))


def sign_suspect(raw: Column) -> Column:
    """True where a minus follows a code or symbol and is therefore read as positive."""
    return F.regexp_like(raw, F.lit(r"[A-Za-z$€£]\s*-\s*[0-9]")) & ~F.regexp_like(raw, F.lit(f"^{SPACE}*-"))


def format_minor(minor: Column, decimals: int = 2) -> Column:
    """Minor units as a plain decimal text."""
    digits = F.abs(minor.cast(EXACT)).cast("string")
    digits = F.when(F.length(digits) <= decimals, F.lpad(digits, decimals + 1, "0")).otherwise(digits)
    sign = F.when(minor < 0, "-").otherwise("")
    if not decimals:
        return F.concat(sign, digits)
    return F.concat(sign, digits.substr(F.lit(1), F.length(digits) - decimals), F.lit("."), digits.substr(F.length(digits) - (decimals - 1), F.lit(decimals)))


def grouped(minor: Column, thousands: str, point: str) -> Column:
    """Minor units with grouped thousands, as either convention prints them."""

    def shown(text: Column) -> Column:
        whole, cents = F.regexp_extract(text, r"^(-?[0-9]+)", 1), F.regexp_extract(text, r"([0-9]{2})$", 1)
        return F.concat(F.regexp_replace(whole, r"(?<=[0-9])(?=([0-9]{3})+$)", thousands), F.lit(point), cents)

    return once(format_minor(minor), shown)


def anglo(minor: Column) -> Column:
    return grouped(minor, ",", ".")


def latin(minor: Column) -> Column:
    return grouped(minor, ".", ",")
