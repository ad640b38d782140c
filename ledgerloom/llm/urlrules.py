"""URL filter: hand-written rules decide what they fit; association rules mined by FP-growth decide the rest.

URLs that a hand-written rule fits are the labelled transactions: their host labels and path segments, and the verdict
as one more item. FP-growth mines token combinations; rules {tokens} -> verdict are pruned by support and confidence,
filed in an inverted index under their rarest token, and matched against the tokens of every other URL. The rule
of highest confidence (then support, then fewer tokens) decides; without one the more common label does.

Everything is DataFrame operations, and support and confidence alone decide what is mined. Tokens found in exactly the same labelled rows
are one item: a rule on it fires on any of them. Combinations are mined under their rarest item, over that item's rows,
without the items that all those rows hold: adding one of these changes neither support nor confidence, only the length. So a long path
that many urls share, whole or cut at any depth, gives one rule for each segment and not one for each subset.
Rules that one of their items, or all but one, gives as surely are dropped by joins (no verdict depends on them). Up to
``LITERAL_RULES`` rules are one constant; more are a table, joined to the distinct token lists, broadcast if small.

Defined results: a null url or one without ``://`` has empty host and path, hence no tokens, and gets the default
verdict (``allow`` if no url is labelled); every row gives one row, repeated rows too. Extra columns are left alone.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import bounded, stored

#: (verdict, host, path prefix)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.6
#: So many rules are matched as a constant, more as a table; the verdicts are the same.
LITERAL_RULES = 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct host labels and path segments, numbers as ``#``."""
    part = lambda mark, text, by: F.transform(
        F.filter(F.split(text, by), lambda x: x != ""), lambda x: F.concat(F.lit(mark), F.when(x.rlike(r"^[0-9]+(\.[a-z]+)?$"), F.lit("#")).otherwise(x))
    )
    return F.array_distinct(F.concat(part("h:", host, r"\."), part("p:", path, "/")))


def _constant(value, kind: str) -> Column:
    """One constant, folded once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


@dataclass(frozen=True)
class UrlModel:
    default: str = "allow"
    #: each frequent token's item: the first of the tokens that the same labelled rows hold
    items: dict[str, str] = field(default_factory=dict)
    #: (token, t, v, c, s): rules {items t} -> verdict v with confidence and support, each under its rarest item; stored
    rules: DataFrame | None = None

    @property
    def index(self) -> dict[str, list[tuple[list[str], str, float, float]]]:
        """The rules by their rarest items, if they are few."""
        out: dict[str, list] = {}
        for r in [] if self.rules is None else self.rules.limit(LITERAL_RULES).collect():
            out.setdefault(r["token"], []).append((r["t"], r["v"], r["c"], r["s"]))
        return out

    def held(self, tokens: Column) -> Column:
        """The distinct items of some tokens."""
        of = _constant(self.items, "map<string,string>")
        return F.array_distinct(F.filter(F.transform(tokens, lambda t: of[t]), lambda x: x.isNotNull()))

    def verdict(self, tokens: Column) -> Column:
        return self._best(self.held(tokens), self.index)

    def _best(self, items: Column, index: dict) -> Column:
        if not index:
            return F.lit(self.default)
        index = _constant({k: [dict(zip("tvcs", r, strict=True)) for r in rows] for k, rows in index.items()}, "map<string,array<struct<t:array<string>,v:string,c:double,s:double>>>")
        near = F.flatten(F.filter(F.transform(items, lambda t: index[t]), lambda x: x.isNotNull()))
        fired = F.filter(near, lambda r: F.size(F.array_except(r["t"], items)) == 0)
        best = F.array_max(F.transform(fired, lambda r: F.struct(r["c"].alias("c"), r["s"].alias("s"), (-F.size(r["t"])).alias("n"), r["v"].alias("v"))))
        return F.coalesce(best["v"], F.lit(self.default))

    def judged(self, rows: DataFrame) -> DataFrame:
        """``rows`` with a column ``_mined``: the verdict on the column ``_tokens``."""
        if self.rules is None:
            return rows.withColumn("_mined", F.lit(self.default))
        rows = rows.withColumn("_items", F.array_sort(self.held(F.col("_tokens"))))
        if self.rules.count() <= LITERAL_RULES:
            return rows.withColumn("_mined", self._best(F.col("_items"), self.index)).drop("_items")
        lists = rows.select("_items").distinct()
        fired = lists.select("_items", F.explode("_items").alias("token")).join(bounded(self.rules), "token").filter(F.size(F.array_except("t", "_items")) == 0)
        best = fired.groupBy("_items").agg(F.max(F.struct("c", "s", (-F.size("t")).alias("n"), "v"))["v"].alias("_mined"))
        return rows.join(best, "_items", "left").withColumn("_mined", F.coalesce("_mined", F.lit(self.default))).drop("_items")


def frequent_items(labelled: DataFrame, least: int) -> tuple[dict[str, str], dict[str, int]]:
    """Each token of at least ``least`` rows with its item, and each item's number of rows, the rarest first. Row sets are told apart by counts and two sums of row hashes."""
    of = lambda seed: F.bit_xor(F.xxhash64("at", F.lit(seed)))
    seen = labelled.withColumn("at", F.monotonically_increasing_id()).select("at", F.explode(F.array_distinct("tokens")).alias("token"))
    often = seen.groupBy("token").agg(F.count(F.lit(1)).alias("n"), of(1).alias("x"), of(2).alias("y")).filter(F.col("n") >= least)
    often = often.select("token", "n", F.min("token").over(Window.partitionBy("n", "x", "y")).alias("item")).collect()  # mean tokens / min_support at most
    return {r["token"]: r["item"] for r in often}, dict(sorted({r["item"]: r["n"] for r in often}.items(), key=lambda x: (x[1], x[0])))


def combinations(rows: DataFrame, counts: list[int], verdicts: list[str], least: int) -> DataFrame:
    """rows: (items: numbers, ascending, rarest first; verdict). (t, v, n, k): combinations of two items and more that ``k`` rows of
    verdict v hold, of ``n``; without those in which the rarest item's rows all hold another one."""
    width = len(counts) + len(verdicts)
    later = lambda i: F.slice("items", i + 2, F.size("items"))
    pairs = F.transform("items", lambda x, i: F.transform(later(i), lambda y: F.struct(x.alias("x"), y.alias("y"))))
    met = rows.select(F.inline(F.flatten(pairs))).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    implied = met.filter(F.col("n") == _constant(counts, "array<long>")[F.col("x").cast("int")]).groupBy("x").agg(F.collect_set("y").alias("always"))
    label = F.array_position(_constant(verdicts, "array<string>"), F.col("verdict")) - 1 + len(counts)
    under = rows.select(label.alias("label"), "items", F.posexplode("items").alias("i", "x")).select("label", "x", later(F.col("i")).alias("rest"))
    under = under.join(bounded(stored(implied, "url-implied")), "x", "left")
    under = under.select("label", "x", F.array_except("rest", F.coalesce("always", F.array().cast("array<long>"))).alias("rest")).filter(F.size("rest") > 0)
    baskets = stored(under.select(F.transform(F.array_append("rest", F.col("label")), lambda y: F.col("x") * width + y).alias("basket")), "url-baskets")
    many = baskets.count()
    if not many:
        return rows.sparkSession.createDataFrame([], "t array<long>, v string, n long, k long")
    sets = FPGrowth(itemsCol="basket", minSupport=(least - 0.5) / many).fit(baskets).freqItemsets
    parts = F.array_sort(F.transform("items", lambda i: i % width))
    sets = sets.select(F.floor(F.element_at("items", 1) / width).alias("x"), parts.alias("y"), F.col("freq").alias("k"))
    sets = sets.select(F.concat(F.array("x"), F.filter("y", lambda y: y < len(counts))).alias("t"), (F.element_at("y", -1) - len(counts)).alias("label"), "k")
    sets = stored(sets.filter(F.size("t") > 1), "url-sets")
    name = _constant(verdicts, "array<string>")
    of = sets.filter("label < 0").select("t", F.col("k").alias("n"))
    return sets.filter("label >= 0").select("t", name[F.col("label").cast("int")].alias("v"), "k").join(of, "t").select("t", "v", "n", "k")


def irredundant(rules: DataFrame) -> DataFrame:
    """The rules (t, v, c, ...) but those that one item of theirs, or all but one, gives at least as surely."""
    known = rules.select(F.col("t").alias("less"), "v", F.col("c").alias("sure"))
    several = rules.filter(F.size("t") > 1)
    fewer = F.transform("t", lambda x, i: F.concat(F.slice("t", 1, i), F.slice("t", i + 2, F.size("t"))))
    less = several.select("t", "v", "c", F.explode(F.array_distinct(F.concat(fewer, F.transform("t", lambda x: F.array(x))))).alias("less"))
    same = less.join(known, ["less", "v"]).filter("sure >= c").select("t", "v").distinct()
    return rules.join(same, ["t", "v"], "left_anti")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> UrlModel:
    """Learn from a table (tokens, verdict)."""
    found = {r["verdict"]: r["n"] for r in labelled.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(found.values())
    if not total:
        return UrlModel()
    default = max(sorted(found), key=found.get)
    if len(found) < 2:
        return UrlModel(default)
    least = max(1, math.ceil(min_support * total))
    items, counts = frequent_items(labelled, least)
    if not items:
        return UrlModel(default)
    names, counts, verdicts = list(counts), list(counts.values()), sorted(found)
    number = _constant({t: names.index(x) for t, x in items.items()}, "map<string,long>")
    numbers = F.array_sort(F.array_distinct(F.filter(F.transform("tokens", lambda t: number[t]), lambda x: x.isNotNull())))
    rows = stored(labelled.select(numbers.alias("items"), "verdict"), "url-items")
    single = rows.select(F.explode("items").alias("x"), F.col("verdict").alias("v")).groupBy("x", "v").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= least)
    single = single.select(F.array("x").alias("t"), "v", _constant(counts, "array<long>")[F.col("x").cast("int")].alias("n"), "k")
    rules = single.unionByName(combinations(rows, counts, verdicts, least)).withColumn("c", F.col("k") / F.col("n")).filter(F.col("c") >= min_confidence)
    rules = irredundant(stored(rules, "url-rules"))
    name = _constant(names, "array<string>")
    named = F.transform("t", lambda x: name[x.cast("int")])
    rules = rules.select(named[0].alias("token"), F.array_sort(named).alias("t"), "v", "c", (F.col("k") / F.lit(total)).alias("s"))
    return UrlModel(default, items, stored(rules, "url-rules"))


def judged(pages: DataFrame, rules=RULES, **mining) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parsed = parsed.withColumn("_fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("_tokens", tokens_of(F.col("host"), F.col("path")))
    labelled = parsed.filter(F.col("_fit").isNotNull()).select(F.col("_tokens").alias("tokens"), F.col("_fit.verdict").alias("verdict"))
    model = mine(labelled, **mining)
    ruled = parsed.filter(F.col("_fit").isNotNull()).withColumn("_mined", F.lit(None).cast("string"))
    out = ruled.unionByName(model.judged(parsed.filter(F.col("_fit").isNull())))
    return out.select("page_id", "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce("_fit.verdict", "_mined").alias("verdict"))


def op7_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))
