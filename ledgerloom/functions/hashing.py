"""Digests and canonical JSON."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import to_fixed  # noqa: F401  (numbers as text, next to number_text)


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def short_digest(c: Column) -> Column:
    return F.left(digest(c), F.lit(16))


def number_text(x: float | int) -> str:
    """A number as ECMAScript prints it: shortest digits, exponent below 1e-6 and from 1e21."""
    if isinstance(x, bool):
        raise TypeError("a boolean is no number")
    x = float(x)
    if x != x or x in (float("inf"), float("-inf")):
        raise ValueError(f"not finite: {x}")
    if x == 0:
        return "0"
    short = repr(abs(x))
    digits, _, power = short.partition("e")
    whole, _, part = digits.partition(".")
    exponent = int(power or 0) + len(whole)
    both = (whole + part).lstrip("0")
    exponent -= len(whole + part) - len((whole + part).lstrip("0"))
    both = both.rstrip("0")
    sign = "-" if x < 0 else ""
    n = len(both)
    if n <= exponent <= 21:
        return sign + both + "0" * (exponent - n)
    if 0 < exponent <= 21:
        return f"{sign}{both[:exponent]}.{both[exponent:]}"
    if -6 < exponent <= 0:
        return f"{sign}0.{'0' * -exponent}{both}"
    e = exponent - 1
    return f"{sign}{both[0]}{'.' + both[1:] if n > 1 else ''}e{'+' if e >= 0 else '-'}{abs(e)}"


def canonical(value) -> str:
    """One text for one JSON value: keys in NFC, sorted by UTF-16 units; strings in NFC; arrays in order; no white space."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int | float):
        return number_text(value)
    if isinstance(value, str):
        return _quoted(unicodedata.normalize("NFC", value))
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, dict):
        named = sorted((*_key(k), k) for k in value)
        return "{" + ",".join(f"{quoted}:{canonical(value[k])}" for _, quoted, k in named) + "}"
    raise TypeError(f"{type(value).__name__} has no canonical form")


#: One encoder for all texts; ``json.dumps`` makes a new one for each.
_quoted = json.JSONEncoder(ensure_ascii=False).encode


@lru_cache(maxsize=4096)
def _key(k: str) -> tuple[bytes, str]:
    """What a key is sorted by, and its text; certificates name the same few."""
    plain = unicodedata.normalize("NFC", k)
    return plain.encode("utf-16-be", "surrogatepass"), _quoted(plain)


class _Odd(Exception):
    """A number that the C encoder prints otherwise than ``number_text``."""


def _plain_int(text: str) -> int:
    if len(text) > 15:
        raise _Odd(text)
    return int(text)


def _plain_float(text: str) -> float | int:
    x = float(text)
    if not 1e-4 <= abs(x) < 1e15 and x != 0:
        raise _Odd(text)
    return int(x) if x.is_integer() else x


def _no_number(text: str):
    raise _Odd(text)


_plain = json.JSONDecoder(parse_int=_plain_int, parse_float=_plain_float, parse_constant=_no_number).decode
_encoded = json.JSONEncoder(ensure_ascii=False, allow_nan=False, sort_keys=True, separators=(",", ":")).encode


def _written(value) -> str:
    """``canonical`` of a value of plain numbers: ASCII is in NFC and sorts alike in any unit, so the C encoder writes it."""
    out = _encoded(value)
    return out if out.isascii() else canonical(value)


def read(text: str) -> tuple[object, Callable[[object], str]]:
    """A JSON text's value, and what gives the canonical text of it and of any of its parts."""
    try:
        return _plain(text), _written
    except _Odd:
        return json.loads(text), canonical


def canonical_of(text: str | None, without: tuple[str, ...] = ()) -> str | None:
    """Canonical form of a JSON text, top-level keys ``without`` left out; null if it is no JSON or not canonical."""
    if text is None:
        return None
    try:
        value, written = read(text)
        if without and isinstance(value, dict):
            value = {k: v for k, v in value.items() if k not in without}
        return written(value)
    except (ValueError, TypeError, RecursionError):
        return None


def canonical_json(text: Column, without: tuple[str, ...] = ()) -> Column:
    """Spark has no NFC and no canonical JSON, so this is an Arrow UDF over whole columns."""

    def convert(texts: pa.Array) -> pa.Array:
        return pa.array([canonical_of(t, without) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(convert, "string")(text)
