"""The column functions as temporary SQL functions: ``register(spark)``, then ``SELECT parse_amount(text) FROM ...``.

A function's body is the SQL form of its column expression, so a query that calls it is planned like one written with columns: nothing is
opaque to the optimizer and nothing runs in Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import dates, geometry, money, numbers, text, values

_BOX = geometry.BOX
#: name: (parameters with types, what it returns, expression over the parameters)
FUNCTIONS = {
    "parse_amount": (("raw string",), "struct<minor:decimal(38,0),currency:string,convention:string>", money.parse_amount),
    "format_minor": (("minor bigint",), "string", money.format_minor),
    "amount_anglo": (("minor bigint",), "string", money.anglo),
    "amount_latin": (("minor bigint",), "string", money.latin),
    "sign_suspect": (("raw string",), "boolean", money.sign_suspect),
    "coerce_date": (("raw string",), "string", dates.coerce_date),
    "coerce_integer": (("raw string",), "bigint", values.coerce_integer),
    "coerced": (("kind string", "raw string"), "string", values.coerced),
    "value_agrees": (("kind string", "value string", "printed string"), "boolean", values.agrees),
    "value_carried": (("kind string", "said string", "value string"), "boolean", values.carries),
    "same_text": (("a string", "b string"), "boolean", values.same_text),
    "reference_key": (("raw string",), "string", text.reference_key),
    "loose_text": (("raw string",), "string", text.loose),
    "upper_key": (("raw string",), "string", text.upper_alnum),
    "without_thoughts": (("raw string",), "string", text.without_thoughts),
    "slug": (("raw string",), "string", text.slug),
    "quantisation": (("model string",), "string", text.quantisation),
    "to_fixed3": (("x double",), "string", lambda x: numbers.to_fixed(x, 3)),
    "within_tolerance": (("difference decimal(38,0)",), "boolean", numbers.within_tolerance),
    "half_up": (("x double",), "bigint", numbers.half_up),
    "milliseconds": (("profiled double", "wall_ms double"), "struct<ms:bigint,source:string>", numbers.milliseconds),
    "box_height": ((f"b {_BOX}",), "double", geometry.height),
    "box_mid_y": ((f"b {_BOX}",), "double", geometry.mid_y),
    "box_union": ((f"a {_BOX}", f"b {_BOX}"), _BOX, geometry.union),
    "box_overlap": ((f"a {_BOX}", f"b {_BOX}"), "double", geometry.v_overlap),
    "box_gap": ((f"a {_BOX}", f"b {_BOX}"), "double", geometry.h_gap),
    "box_iou": ((f"a {_BOX}", f"b {_BOX}"), "double", geometry.iou),
    "box_inside_page": ((f"b {_BOX}", "width double", "height double"), "boolean", geometry.inside_page),
}

_LITERAL = re.compile(r"('(?:[^'\\]|\\.)*')", re.DOTALL)
_PREFIX = re.compile(r"(?<![\w`])(<=>|>=|<=|!=|[=<>+*/%-]|and|or|not)\(")


def body(expression: Column) -> str:
    """SQL text of a column. Operators stand before their operands in it, and are quoted as the functions that they are."""
    parts = _LITERAL.split(expression._jc.node().sql())
    plain = lambda p: re.sub(r"\bInfinity\b", "double('Infinity')", _PREFIX.sub(r"`\1`(", p))
    return "".join(p if k % 2 else plain(p) for k, p in enumerate(parts))


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to the session's SQL; their names."""
    for name, (parameters, returns, expression) in FUNCTIONS.items():
        made = expression(*[F.col(p.split(" ")[0]) for p in parameters])
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(parameters)}) RETURNS {returns} RETURN CAST({body(made)} AS {returns})")
    return list(FUNCTIONS)
