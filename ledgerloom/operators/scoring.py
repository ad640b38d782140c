"""Scores: verdicts and fields against truth, confidence separation, trial outcomes, latency."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import iou
from ..functions.money import parse_amount
from ..functions.numbers import half_up, ratio
from ..functions.text import bounded_by_space, collapsed, trimmed, words
from ..functions.values import agrees
from ..sources.shared import running, settled
from .gate import SPAN_PENALTY, judged
from .reconcile import DECISIONS

# What a trial can come to.
OUTCOMES = ("correct", "step-omission", "result-substitution", "misreference", "tool-error", "turn-cap", "other")
SAME_PLACE = 0.5


def confusion(pairs: DataFrame, levels: tuple[str, ...] = DECISIONS) -> DataFrame:
    """pairs: (expected, actual). Every cell of expected x actual with its count, zeros too."""
    spark = pairs.sparkSession
    grid = spark.createDataFrame([(a, b) for a in levels for b in levels], "expected string, actual string")
    counts = pairs.groupBy("expected", "actual").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["expected", "actual"], "left").select("expected", "actual", F.coalesce("n", F.lit(0)).alias("n"))


def costs(pairs: DataFrame) -> DataFrame:
    """One row: documents confidently wrong (said matched, is not), and the cost of abstention (is matched, said indeterminate)."""
    e, a = F.col("expected"), F.col("actual")
    return pairs.agg(F.count_if((a == "matched") & (e != "matched")).alias("confidently_wrong"), F.count_if((a == "indeterminate") & (e == "matched")).alias("cost_of_abstention"))


def field_outcomes(truth: DataFrame, verdicts: DataFrame) -> DataFrame:
    """truth: (doc_id, key, text); verdicts: (doc_id, key, type, value, verdict). A row for each true field, missing verdicts too."""
    j = truth.join(verdicts, ["doc_id", "key"], "left").withColumn("_right", agrees(F.col("type"), F.col("value"), F.col("text")))  # a column, as two outcomes ask for it
    right = F.col("_right")
    admitted = F.coalesce(F.col("verdict.admitted"), F.lit(False))
    outcome = F.when(admitted, F.when(right, "admitted_right").otherwise("admitted_wrong")).otherwise(F.when(right, "abstained_would_be_right").otherwise("abstained_would_be_wrong"))
    check = F.when(F.col("verdict").isNull(), "missing").when(~admitted, F.col("verdict.check"))
    return j.select("doc_id", "key", outcome.alias("outcome"), check.alias("check"))


def extraction_totals(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of the four outcomes, with coverage and precision; overall, or for each ``by``."""
    four = ("admitted_right", "admitted_wrong", "abstained_would_be_right", "abstained_would_be_wrong")
    t = outcomes.groupBy(*(by or [])).agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in four])
    admitted = F.col(four[0]) + F.col(four[1])
    fields = admitted + F.col(four[2]) + F.col(four[3])
    return t.select(*(by or []), *four, fields.alias("fields"), admitted.alias("admitted"), ratio(admitted, fields).alias("coverage"), ratio(F.col(four[0]), admitted).alias("precision"))


def abstentions_by_check(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter("check is not null").groupBy("check").agg(F.count(F.lit(1)).alias("n"))


def risk_coverage(truth: DataFrame, fields: DataFrame, floors: list[float]) -> DataFrame:
    """The gate run again at each confidence floor (a short list): the totals by floor. A true field without a verdict counts at every floor."""
    read = truth.join(fields, ["doc_id", "key"], "left").withColumn("_right", agrees(F.col("type"), F.col("value"), F.col("text")))  # once, not at every floor
    j = judged(read.withColumn("floor", F.explode(F.array(*map(F.lit, floors)))), F.col("floor"))
    right, admitted = F.col("_right"), F.col("verdict.admitted")
    outcome = F.when(admitted, F.when(right, "admitted_right").otherwise("admitted_wrong")).otherwise(F.when(right, "abstained_would_be_right").otherwise("abstained_would_be_wrong"))
    return extraction_totals(j.select("floor", outcome.alias("outcome")), ["floor"])


def risk_curve(truth: DataFrame, fields: DataFrame) -> DataFrame:
    """(floor, admitted_right, admitted_wrong, coverage, precision) for every confidence floor at which what is admitted changes, in one pass.

    A field that the gate's other checks pass is admitted up to a floor of its own: its confidence, less what a wider binding asks for. Fields
    without a confidence to check are admitted at every floor (the row of floor infinity), the others at none.
    """
    c = F.col
    j = truth.join(fields, ["doc_id", "key"], "left")
    passed = judged(j, F.lit(float("-inf"))).withColumn("right", agrees(c("type"), c("value"), c("text")))
    exempt = F.coalesce(c("source") == "text-layer", F.lit(False))
    upto = F.when(exempt, float("inf")).otherwise(c("confidence") - F.when(c("status") == "span", SPAN_PENALTY).otherwise(0.0))
    counted = passed.groupBy(F.when(c("verdict.admitted"), upto).alias("floor")).agg(F.count_if("right").alias("r"), F.count(F.lit(1)).alias("n"))
    counted = settled(counted, "floors")
    all_fields = counted.agg(F.sum("n")).collect()[0][0]
    sums = running(counted.filter("floor is not null"), [c("floor").desc()], admitted_right=c("r"), admitted=c("n"))
    return sums.select("floor", "admitted_right", (c("admitted") - c("admitted_right")).alias("admitted_wrong"), ratio(c("admitted"), F.lit(all_fields)).alias("coverage"), ratio(c("admitted_right"), c("admitted")).alias("precision"))


def cells(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs: (..., expected, actual, present): right cells of all. An absent cell is wrong even where null is expected."""
    right = F.col("present") & F.col("expected").eqNullSafe(F.col("actual"))
    return pairs.groupBy(*by).agg(F.count_if(right).alias("correct"), F.count(F.lit(1)).alias("total"))


def separability(readings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """readings: (correct boolean, confidence). Spread of confidence for right and wrong readings; separable if they don't overlap."""
    stats = []
    for name, of in (("correct", F.col("correct")), ("incorrect", ~F.col("correct"))):
        x = F.when(of, F.col("confidence"))
        stats += [F.count(x).alias(f"{name}_n"), F.min(x).alias(f"{name}_min"), F.max(x).alias(f"{name}_max"), F.avg(x).alias(f"{name}_mean")]
    return readings.groupBy(*(by or [])).agg(*stats).withColumn("separable", F.col("correct_min") > F.col("incorrect_max"))


def localised(truth: DataFrame, regions: DataFrame, rows: DataFrame) -> DataFrame:
    """truth: (doc_id, key, text, bbox); regions: (doc_id, text, bbox); rows: (doc_id, text) of visual rows.

    correct if a region that covers the text lies where it should, mislocated if only the text is there, else missed. A region
    covers a text that it equals, read as an amount or without case and spacing, or that it holds between spaces: it is met through
    that reading, or through the text's first word, by equi-joins.
    """
    box = regions.schema["bbox"].dataType
    spots = regions.select("doc_id", F.col("text").alias("seen"), F.col("bbox").alias("at")).unionByName(rows.select("doc_id", F.col("text").alias("seen"), F.lit(None).cast(box).alias("at")))

    def reading(text: Column) -> Column:
        minor = parse_amount(text)["minor"].cast("string")
        return F.coalesce(F.concat(F.lit("amount "), minor), F.concat(F.lit("text "), F.lower(collapsed(text))))

    # outer: for an inner explode the optimizer filters by the array first, which reads every text again; null meets nothing
    word = lambda w: F.concat(F.lit("word "), w)
    asked = truth.withColumn("meet", F.explode_outer(F.array(reading(F.col("text")), word(F.get(words(trimmed(F.col("text"))), F.lit(0))))))
    met = spots.withColumn("meet", F.explode_outer(F.array_distinct(F.array_append(F.transform(words(F.col("seen")), word), reading(F.col("seen"))))))
    j = asked.join(met.hint("merge"), ["doc_id", "meet"], "left")  # exploded sides look small to the planner, whose broadcast the driver could not hold
    covers = ~F.startswith("meet", F.lit("word ")) | bounded_by_space(F.col("seen"), F.col("text"))
    there = F.coalesce(iou(F.col("bbox"), F.col("at")) >= SAME_PLACE, F.lit(False))
    found = j.groupBy("doc_id", "key").agg(F.bool_or(F.when(F.col("seen").isNotNull() & covers, there)).alias("there"))
    return found.select("doc_id", "key", F.when(F.col("there"), "correct").when(F.col("there").isNotNull(), "mislocated").otherwise("missed").alias("outcome"))


CALLS = "array<struct<turn:int,name:string,arguments:map<string,string>,returned:map<string,string>,error:string>>"


def classify_calls(stop_reason: Column, n_errors: Column, calls: Column, expected: Column) -> Column:
    """Outcome of a tool-calling trial; calls as CALLS."""
    first = lambda name: F.get(F.filter(calls, lambda c: c["name"] == name), F.lit(0))
    lookup, variance = first("lookup_record"), first("compute_variance")
    returned, supplied = F.try_element_at(lookup["returned"], F.lit("amount")), F.try_element_at(variance["arguments"], F.lit("b"))
    answer = F.try_element_at(variance["returned"], F.lit("variance"))
    return (
        F.when(stop_reason == "turn-cap", "turn-cap")
        .when(n_errors > 0, "tool-error")
        .when(lookup.isNull(), "other")
        .when(variance.isNull(), "step-omission")
        .when(returned.isNull() | supplied.isNull(), "other")
        .when(supplied != returned, "result-substitution")
        .when(~answer.eqNullSafe(expected), "other")
        .otherwise("correct")
    )


STEPS = "array<struct<turn:int,action:string,references:map<string,string>,produced:string>>"


def classify_steps(stop_reason: Column, steps: Column, answer: Column, expected: Column, wanted: dict[str, dict[str, str]]) -> Column:
    """Outcome of a slot-bound trial; steps as STEPS; wanted: the slot that belongs to each parameter of each action."""

    def misses(action: str, param: str, key: str) -> Column:
        return F.exists(steps, lambda s: (s["action"] == action) & ~F.try_element_at(s["references"], F.lit(param)).eqNullSafe(F.lit(key)))

    wrong = F.lit(False)
    for action, params in wanted.items():
        for param, key in params.items():
            wrong = wrong | misses(action, param, key)
    return (
        F.when(stop_reason == "turn-cap", "turn-cap")
        .when(stop_reason != "terminal", "other")
        .when(~F.exists(steps, lambda s: s["action"] == "compute_variance"), "step-omission")
        .when(wrong, "misreference")
        .when(~answer.eqNullSafe(expected), "other")
        .otherwise("correct")
    )


def outcome_counts(trials: DataFrame) -> DataFrame:
    """trials: (outcome). Each possible outcome with its count and share."""
    names = trials.sparkSession.createDataFrame([(o,) for o in OUTCOMES], "outcome string")
    n = trials.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    total = trials.agg(F.count(F.lit(1)).alias("total"))
    joined = names.join(n, "outcome", "left").join(F.broadcast(total))  # one row
    return joined.select("outcome", F.coalesce("n", F.lit(0)).alias("n"), ratio(F.coalesce("n", F.lit(0)), F.col("total")).alias("rate"))


def medians(trials: DataFrame) -> DataFrame:
    """trials: (arm, ms). (arm, median), exact: by counts of equal values, which combine before the shuffle."""
    counts = trials.filter("ms is not null").groupBy("arm", "ms").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("arm")
    ranked = counts.withColumn("upto", F.sum("n").over(w.orderBy("ms"))).withColumn("all", F.sum("n").over(w))
    low, high = F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1  # the middle ranks, the same if odd
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("ms")))
    return ranked.groupBy("arm").agg(half_up((at(low) + at(high)) / 2).cast("bigint").alias("median"))


def latency(trials: DataFrame) -> DataFrame:
    """trials: (arm, ms). One row: whether the gap of medians is beyond the drift within an arm, and the faster arm."""
    arms = medians(trials).join(trials.groupBy("arm").agg((F.max("ms") - F.min("ms")).alias("spread")), "arm")
    out = arms.agg((F.max("median") - F.min("median")).alias("gap"), F.max("spread").alias("spread"), F.min_by("arm", F.struct("median", "arm")).alias("faster"))
    return out.select((F.col("gap") > F.col("spread")).alias("separable"), "gap", "spread", "faster")


def _at_most(failures: np.ndarray, trials: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X <= failures) of a binomial X, failures < trials, by the continued fraction of the incomplete beta function."""
    a, b, x = trials - failures, failures + 1.0, 1.0 - p
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    log = np.frompyfunc(math.lgamma, 1, 1)
    scale = (log(a + b) - log(a) - log(b)).astype(float) + a * np.log(np.maximum(x, 1e-300)) + b * np.log1p(-np.minimum(x, 1 - 1e-16))
    tiny = 1e-300
    c, d = np.ones_like(x), 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    f = d.copy()
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            f = f * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    part = np.exp(scale) * f / a
    return np.where(swap, 1 - part, part)


def upper_bound(failures: np.ndarray, trials: np.ndarray, confidence: float = 0.95) -> np.ndarray:
    """One-sided Clopper-Pearson bounds of failure rates, by bisection of the binomial tail; 1 without trials or without a success."""
    failures, trials = (np.atleast_1d(np.asarray(x, float)) for x in (failures, trials))
    out = np.ones(len(trials))
    open_ = np.flatnonzero(failures < trials)
    f, n = failures[open_], trials[open_]
    low, high = f / n, np.ones(len(n))
    for _ in range(60 if len(n) else 0):
        mid = (low + high) / 2
        over = _at_most(f, n, mid) > 1 - confidence
        low, high = np.where(over, mid, low), np.where(over, high, mid)
    out[open_] = (low + high) / 2
    return out


def upper_bounds(failures: Column, trials: Column, confidence: float = 0.95) -> Column:
    def bound(f: pa.Array, n: pa.Array) -> pa.Array:
        known = np.array([a.is_valid and b.is_valid for a, b in zip(f, n, strict=True)], bool)
        x, y = (v.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False) for v in (f, n))
        return pa.array(upper_bound(x, y, confidence), pa.float64(), mask=~known)

    return F.arrow_udf(bound, "double")(failures, trials)


def upper_bound_without_failures(trials: Column, confidence: float = 0.95) -> Column:
    return F.when(trials == 0, 1.0).otherwise(1 - F.pow(F.lit(1 - confidence), F.try_divide(F.lit(1.0), trials)))


def lineup(runs: DataFrame) -> DataFrame:
    """runs: (model, bytes, ms, tok_per_sec, correct, total): sums and means by model; rates over measured runs only."""
    return runs.groupBy("model").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("bytes").alias("bytes"), F.sum("ms").alias("ms"), F.avg("tok_per_sec").alias("tok_per_sec"), F.sum("correct").alias("correct"), F.sum("total").alias("total")
    )
