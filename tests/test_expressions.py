"""Golden vectors of the expressions."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, geometry, hashing, money, numbers, text, values


def one(spark, column, **inputs):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint' if isinstance(v, int) else 'double'}" for k, v in inputs.items())
    return spark.createDataFrame([tuple(inputs.values())], schema).select(column.alias("x")).collect()[0]["x"]


AMOUNTS = {
    "2.831,40": (283140, None, "latin"), "2,831.40": (283140, None, "anglo"), "ARS 2.831,40": (283140, "ARS", "latin"), "$2,831.40": (283140, "USD", "anglo"),
    "2831.40": (283140, None, "anglo"), "2.340": (234000, None, "anglo"), "2,340": (234000, None, "latin"), "1.234.567": (123456700, None, "anglo"), "2.34": (234, None, "anglo"),
    "2,34": (234, None, "latin"), "ARS2.831,40": (283140, "ARS", "latin"), "1234": (123400, None, "integer"), "-12.50": (-1250, None, "anglo"), "EUR -5.00": (500, "EUR", "anglo"),
    "$-5": (500, "USD", "integer"), "1.2.3": (1230, None, "anglo"), "R$ 10": (1000, "BRL", "integer"), "€ 1.234,50": (123450, "EUR", "latin"), "usdt 5": (500, "USDT", "integer"),
    " 12 ": (1200, None, "integer"), "99999999999999999999.99": (9999999999999999999999, None, "anglo"),
}
NOT_AMOUNTS = [":%2 VAI", "Jund", "Invoice 4471", "PO-2026-0912", "30-71234567-9", "", None, "Total:AUD 1,562.00", "EUR 5 EUR", "1,234.567", "12.", ".50", "ARSENAL 5", "-"]


def test_parse_amount(spark):
    rows = spark.createDataFrame([(k,) for k in [*AMOUNTS, *NOT_AMOUNTS]], "raw string").select("raw", money.parse_amount(F.col("raw")).alias("p")).collect()
    got = {r["raw"]: r["p"] and (int(r["p"]["minor"]), r["p"]["currency"], r["p"]["convention"]) for r in rows}
    assert got == AMOUNTS | dict.fromkeys(NOT_AMOUNTS)


def test_parse_undoes_format(spark):
    minors = [0, 5, 99, 100, 101, 123456, 283140, 100000000, -283140, 10**17 + 1]
    df = spark.createDataFrame([(m,) for m in minors], "m bigint")
    for shown in (money.format_minor, money.anglo, money.latin):
        back = df.select("m", money.parse_amount(shown(F.col("m")))["minor"].cast("bigint").alias("b")).collect()
        assert all(r["m"] == r["b"] for r in back)


def test_format_minor(spark):
    df = spark.createDataFrame([(283140,), (5,), (-283140,), (0,)], "m bigint")
    assert [r[0] for r in df.select(money.format_minor(F.col("m"))).collect()] == ["2831.40", "0.05", "-2831.40", "0.00"]
    assert [r[0] for r in df.select(money.latin(F.col("m"))).collect()] == ["2.831,40", "0,05", "-2.831,40", "0,00"]


DATES = {
    "2026-05-18": "2026-05-18", "2026-02-31": "2026-02-31", "2026-13-01": None, "2026-00-10": None, "2026-01-32": None, "18 May 2026": "2026-05-18", "5 june 2026": "2026-06-05",
    "99 May 2026": "2026-05-99", "14/03/2026": None, "18 Mai 2026": None, " 2026-05-18﻿": "2026-05-18", "": None, None: None,
}


def test_coerce_date(spark):
    rows = spark.createDataFrame([(k,) for k in DATES], "raw string").select("raw", dates.coerce_date(F.col("raw")).alias("d")).collect()
    assert {r["raw"]: r["d"] for r in rows} == DATES


@pytest.mark.parametrize(("kind", "page", "value", "want"), [
    ("string", "Northwind  Paper, Supply", "northwind paper supply", True), ("string", "Northwind Paper Supply SL", "Northwind Paper Supply", False), ("amount", "EUR 105,00", "10500", True),
    ("date", "18 May 2026", "2026-05-18", True), ("integer", "21%", "21", True), ("integer", "219", "21", False), ("integer", "2.100", "21", False),
])
def test_region_reads_as_value(spark, kind, page, value, want):
    k = F.lit(kind)
    assert bool(one(spark, F.coalesce(values.region_key(k, F.col("p")) == values.value_key(k, F.col("v")), F.lit(False)), p=page, v=value)) is want


@pytest.mark.parametrize(("kind", "page", "value", "want"), [
    ("amount", "Total due 523,14", "52314", True), ("amount", "2.523,14", "52314", False), ("date", "Date: 18 May 2026", "2026-05-18", True), ("date", "issued 2026-05-18 today", "2026-05-18", True),
    ("string", "Vendor Northwind Paper", "northwind paper", True), ("string", "Northwinds Paper", "northwind", False), ("integer", "rate 21%", "21", True),
])
def test_text_carries_value(spark, kind, page, value, want):
    assert one(spark, values.carries(F.lit(kind), F.col("p"), F.col("v")), p=page, v=value) is want


def test_text_keys(spark):
    assert one(spark, text.reference_key(F.col("s")), s="NW 2026-0117") == "nw20260117"
    assert one(spark, text.reference_key(F.col("s")), s=None) == ""
    assert one(spark, text.loose(F.col("s")), s=" Almacén  No. 5 ") == "almac n no 5"
    assert one(spark, text.without_thoughts(F.col("s")), s='<THINK>a\nb</think>```json\n{"a":1}\n```') == '{"a":1}'
    assert one(spark, text.quantisation(F.col("s")), s="MODEL_1B_Q4_0") == "Q4_0"
    assert one(spark, text.quantisation(F.col("s")), s="MODEL") == "unknown"
    assert one(spark, text.bounded_by_space(F.col("a"), F.col("b")), a="due 5.0 now", b="5.0") is True
    assert one(spark, text.bounded_by_space(F.col("a"), F.col("b")), a="due 510 now", b="5.0") is False
    assert one(spark, values.same_text(F.col("a"), F.col("b")), a="1.234,50", b="$1,234.50") is True
    assert one(spark, values.same_text(F.col("a"), F.col("b")), a="A  b", b="a B ") is True


def test_geometry(spark):
    box = lambda *v: geometry.box(*map(F.lit, v))
    row = spark.range(1).select(
        geometry.union(box(10, 10, 20, 20), box(15, 5, 30, 18)).alias("u"), geometry.v_overlap(box(0, 0, 1, 10), box(0, 5, 1, 15)).alias("o"), geometry.v_overlap(box(0, 0, 1, 0), box(0, 0, 1, 5)).alias("z"),
        geometry.h_gap(box(0, 0, 10, 10), box(15, 0, 20, 10)).alias("g"), geometry.h_gap(box(0, 0, 10, 10), box(8, 0, 20, 10)).alias("n"), geometry.h_gap(box(0, 0, 1, 0), box(2, 0, 3, 0)).alias("i"),
        geometry.iou(box(0, 0, 10, 10), box(5, 0, 15, 10)).alias("iou"), geometry.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)).alias("iou0"), geometry.inside_page(box(0, 0, 5, 5), F.lit(4.0), F.lit(9.0)).alias("p"),
    ).collect()[0]
    assert tuple(row["u"]) == (10, 5, 30, 20) and row["o"] == 0.5 and row["z"] == 0 and row["g"] == 0.5 and row["n"] == -0.2 and math.isinf(row["i"])
    assert math.isclose(row["iou"], 1 / 3) and row["iou0"] == 0 and row["p"] is False


def test_exact_numbers(spark):
    q = lambda a, b: F.expr(f"cast('{a}' as decimal(38,0))") if b is None else numbers.truncated_quotient(F.expr(f"cast('{a}' as decimal(38,0))"), F.lit(b))
    row = spark.range(1).select(q("99999999999999999999999", 10000).alias("a"), q("-90909", 100).alias("b"), numbers.half_up(F.lit(-2.5)).alias("h"), numbers.minor_of(F.lit(523.81)).alias("m"), numbers.minor_of(F.lit(0.29)).alias("n")).collect()[0]
    assert int(row["a"]) == 9999999999999999999 and int(row["b"]) == -909 and row["h"] == -2 and row["m"] == 52381 and row["n"] == 29


def test_milliseconds(spark):
    df = spark.createDataFrame([(18.9, 19000.0), (0.019, 19000.0), (None, 7.6)], "p double, w double")
    got = [tuple(r[0]) for r in df.select(numbers.milliseconds(F.col("p"), F.col("w"))).collect()]
    assert got == [(18900, "profiler-raw"), (19000, "wall-clock"), (8, "wall-clock")]


def test_to_fixed(spark):
    assert one(spark, hashing.to_fixed(F.col("x"), 2), x=1.005) == "1.00"


@pytest.mark.parametrize(("x", "want"), [(1.0, "1"), (0.1, "0.1"), (1e21, "1e+21"), (123456789012345680000.0, "123456789012345680000"), (1e-6, "0.000001"), (1e-7, "1e-7"), (-0.0, "0"), (1.5e300, "1.5e+300"), (-12.5, "-12.5"), (100, "100")])
def test_number_text(x, want):
    assert hashing.number_text(x) == want


def test_canonical():
    assert hashing.canonical({"b": [2, 1], "a": {"z": None, "y": True}}) == '{"a":{"y":true,"z":null},"b":[2,1]}'
    assert hashing.canonical({"é": "é"}) == '{"é":"é"}'
    assert list(hashing.canonical({"\U0001f600": 1, "￮": 2})).index("\U0001f600") < list(hashing.canonical({"\U0001f600": 1, "￮": 2})).index("￮")
    with pytest.raises(ValueError):
        hashing.canonical(float("nan"))
    assert hashing.canonical_of("{not json") is None
    assert hashing.canonical_of('{"b":1,"signature":2}', ("signature",)) == '{"b":1}'
