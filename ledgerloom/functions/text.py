"""Text keys and comparisons.

White space is the explicit class below: Java's ``\\s`` is ASCII only and Spark's ``trim`` strips only spaces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white-space characters that trimming, splitting and collapsing recognise.
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", "")


def collapsed(s: Column) -> Column:
    return trimmed(F.regexp_replace(s, f"{SPACE}+", " "))


def reference_key(s: Column) -> Column:
    """Lower-case letters and digits only; null counts as empty."""
    return F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9]+", "")


def loose(s: Column) -> Column:
    """Lower case, every run of other characters one space."""
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def upper_alnum(s: Column) -> Column:
    return F.regexp_replace(F.upper(s), "[^A-Z0-9]+", "")


def words(s: Column) -> Column:
    return F.split(s, f"{SPACE}+")


def contains_words(text: Column, want: Column) -> Column:
    """Whole-word containment of one loose text in another."""
    w = loose(want)
    return (w != "") & F.contains(F.concat(F.lit(" "), loose(text), F.lit(" ")), F.concat(F.lit(" "), w, F.lit(" ")))


def bounded_by_space(text: Column, want: Column) -> Column:
    """A literal occurrence with white space or an end on both sides."""
    pattern = F.concat(F.lit(f"(^|{SPACE})"), F.lit("\\Q"), F.regexp_replace(want, r"\\E", r"\\E\\\\E\\Q"), F.lit("\\E"), F.lit(f"({SPACE}|$)"))
    return F.regexp_like(text, pattern)


def without_thoughts(s: Column) -> Column:
    """Model output without ``<think>`` blocks and code fences."""
    s = F.regexp_replace(s, r"(?is)<think>.*?</think>", "")
    return trimmed(F.regexp_replace(s, r"(?i)```(?:json)?", ""))


def slug(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def tail_after(s: Column, pattern: str, otherwise: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(s, pattern, 1), F.lit("")), F.lit(otherwise))


def quantisation(model: Column) -> Column:
    """The trailing quantisation mark of a model's name."""
    return tail_after(model, r"_(Q\d\w*)$", "unknown")


def parsed_json(s: Column, schema: str, shown: int = 120) -> Column:
    """struct<value, error>: model output as JSON, or the start of what could not be read."""
    clean = without_thoughts(s)
    good = F.try_parse_json(clean).isNotNull()
    return F.struct(
        F.when(good, F.from_json(clean, schema)).alias("value"), F.when(~good, F.concat(F.lit("not JSON: "), F.substring(F.coalesce(clean, F.lit("")), 1, shown))).alias("error")
    )
