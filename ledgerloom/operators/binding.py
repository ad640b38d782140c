"""Bind each coerced value to the place on the page that carries it.

values: (doc_id, key, type, value); regions: (doc_id, idx, text, bbox, confidence, source).
A region read as a type has a key that equals the value's key exactly if it carries the value, so exact binding compares keys. So does
binding to a run of regions: an index holds, under the same keys, what the runs of each row can carry. A value in one token (or a date in
three, or a text in its words) is carried by every run over it, of which the one from the row's start to the value's end is the first; only an
amount cut over regions needs runs from elsewhere, and these hold nothing but parts of amounts.

A page and the few values of its template are one row, bound without a join, a sort or a table in between; only boxes go to Python. A page of any
size is one task's work, as in ``layout``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import BOX
from ..functions.money import BLANKS, CODES
from ..functions.numbers import once
from ..functions.text import SPACE, loose
from ..functions.values import region_key, value_key
from .layout import MIN_OVERLAP, ON_PAGE, row_lists

# Why a value is not bound.
ABSENT, NOT_FOUND, NO_REGIONS = "declared absent by the model", "value not found on the page", "no regions were recognised for this document"

#: A text of nothing but digits, separators, signs, blanks, currency symbols and codes: what an amount that is cut over regions consists of.
AMOUNT_PART = rf"(?i)^(?:[-0-9.,$€£]|{SPACE}|R\$|{'|'.join(CODES)})*$"


ENTRIES = "array<struct<type:string,text:string,s:int,e:int>>"


def paged(values: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, regions, values): a row for each document with values, its regions in the recogniser's order."""
    of = F.col("doc_id").cast("string").alias("doc_id")
    v = values.select(of, F.struct(*[k for k in values.columns if k != "doc_id"]).alias("v")).groupBy("doc_id").agg(F.collect_list("v").alias("values"))
    return v.join(regions_of(regions).hint("merge"), "doc_id", "left")


def regions_of(regions: DataFrame) -> DataFrame:
    """(doc_id, regions) of every page, from a row for each region."""
    r = regions.select(F.col("doc_id").cast("string").alias("doc_id"), F.struct("idx", "text", "bbox", "confidence", "source").alias("r"))
    return r.groupBy("doc_id").agg(F.array_sort(F.collect_list("r")).cast(ON_PAGE).alias("regions"))


def rows_of(placed: DataFrame) -> DataFrame:
    """(doc_id, row_id, cells) of every visual row."""
    return placed.groupBy("doc_id", "row_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "bbox", "confidence", "source"))).alias("cells"))


def _flat(nested: Column) -> Column:
    """``flatten``, which asks its argument's type for every row, of a bound variable."""
    return once(nested, F.flatten)


def _tokens(text: Column) -> Column:
    """The words of a text, and empty texts. A pattern to split by would be compiled for every row."""
    return F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " ")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _part(kind: Column, value: Column) -> Column:
    """Digits that stand in a row in every text that reads as this amount (to which up to two zeros may be added), integer or date (its year)."""
    return F.when(kind == "amount", once(_digits(value), lambda d: F.left(d, F.length(d) - 2))).when(kind == "integer", _digits(value)).when(kind == "date", F.left(value, F.lit(4)))


def _any_in(digits: Column, parts: Column) -> Column:
    return F.coalesce(F.exists(parts, lambda p: F.contains(digits, p)), F.lit(False))


def _needs(wanted: Column) -> Column:
    """What entries are worth making for open values (type, match_key) of a page: their types, the digits of the longest amount, the lengths of the texts and the digits that others need."""
    digits = F.transform(wanted, lambda v: F.when(v["type"] == "amount", F.length(_digits(v["match_key"]))))
    lengths = F.transform(wanted, lambda v: F.when(v["type"] == "string", F.size(F.split(v["match_key"], " "))))
    return F.struct(F.array_distinct(F.transform(wanted, lambda v: v["type"])).alias("types"), F.array_max(digits).alias("digits"), F.array_distinct(F.array_compact(lengths)).alias("lengths"), F.array_compact(F.transform(wanted, lambda v: _part(v["type"], v["match_key"]))).alias("parts"))


def _entries(texts: Column, needs: Column, numbers: Column) -> Column:
    """ENTRIES of a visual row's texts: what its runs, from cell s to e, can carry. ``numbers``: whether anything but texts can be there."""
    entry = lambda kind, text, e, s=1: F.struct(F.lit(kind).alias("type"), text.alias("text"), (F.lit(s) if isinstance(s, int) else s).cast("int").alias("s"), e.cast("int").alias("e"))
    of_cell = lambda split: _flat(F.transform(texts, lambda t, i: F.transform(F.filter(split(t), lambda w: w != ""), lambda w: F.struct(w.alias("w"), (i + 1).alias("e")))))
    with_digit = lambda tokens: F.filter(tokens, lambda t: F.regexp_like(t["w"], F.lit("[0-9]")))
    single = lambda kind: F.transform(with_digit(of_cell(_tokens)), lambda t: entry(kind, t["w"], t["e"]))

    def three(tokens):
        parts = F.transform(tokens, lambda t, i: F.slice(tokens, i + 1, F.lit(3)))
        parts = F.filter(parts, lambda p: (F.size(p) == 3) & F.regexp_like(p[0]["w"], F.lit("^[0-9]{1,2}$")))
        return F.transform(parts, lambda p: entry("date", F.concat_ws(" ", F.transform(p, lambda t: t["w"])), p[2]["e"]))

    def said(tokens):
        runs = lambda n: F.filter(F.transform(tokens, lambda w, i: F.slice(tokens, i + 1, n)), lambda p: F.size(p) == n)
        return _flat(F.transform(needs["lengths"], lambda n: F.transform(runs(n), lambda p: entry("string", F.concat_ws(" ", F.transform(p, lambda w: w["w"])), F.element_at(p, -1)["e"]))))

    def cut(like):  # runs of two regions and more that hold parts of amounts only, up to the digits of the longest amount
        stop = lambda s: F.coalesce(F.nullif(F.array_position(F.slice(like, s, F.size(like)), False), F.lit(0)) + s - 1, F.size(like) + 1)
        upto = lambda i: F.when(stop(i + 1) > i + 2, F.sequence(i + 2, stop(i + 1) - 1)).otherwise(F.array().cast("array<bigint>"))
        ends = F.transform(like, lambda x, i: F.transform(upto(i), lambda e: F.struct((i + 1).alias("s"), e.alias("e"))))
        runs = F.transform(_flat(ends), lambda r: entry("amount", F.concat_ws(" ", F.slice(texts, r["s"], (r["e"] - r["s"] + 1).cast("int"))), r["e"], r["s"]))
        return F.filter(runs, lambda r: F.length(F.ltrim(_digits(r["text"]), F.lit("0"))) <= needs["digits"])

    like = F.transform(texts, lambda t: F.regexp_like(t, F.lit(AMOUNT_PART)))
    kinds = (("amount", F.concat(single("amount"), once(like, cut))), ("integer", single("integer")), ("date", F.concat(single("date"), once(of_cell(_tokens), three))), ("string", once(of_cell(lambda t: F.split(loose(t), " ")), said)))
    return F.concat(*[F.when(F.array_contains(needs["types"], kind) & (F.lit(True) if kind == "string" else numbers), of.cast(ENTRIES)).otherwise(F.array().cast(ENTRIES)) for kind, of in kinds])


def span_index(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, row_id, type, match_key, s, e): the first run of each row, from cell s to e, that carries what the key says.

    rows: (doc_id, row_id, cells); wanted: open values (doc_id, type, match_key), which say what is worth an entry.
    """
    needs = wanted.groupBy("doc_id").agg(_needs(F.collect_list(F.struct("type", "match_key"))).alias("needs"))
    texts = F.transform("cells", lambda c: F.coalesce(c["text"], F.lit("")))
    rows = rows.join(needs.hint("merge"), "doc_id").select("doc_id", "row_id", "needs", texts.alias("texts"))
    keyed = rows.select("doc_id", "row_id", F.inline_outer(_entries(F.col("texts"), F.col("needs"), _any_in(_digits(F.array_join("texts", "")), F.col("needs.parts")))))  # outer: an inner one makes all entries once more to filter by their number
    return keyed.select("doc_id", "row_id", "type", region_key(F.col("type"), F.col("text")).alias("match_key"), "s", "e").filter("match_key is not null")


def _index(regions: Column, digits: Column, rows: Column, needs: Column) -> Column:
    """The index of a page: (row_id, s, e, type, match_key) of every entry. digits: those of each region's text."""
    texts = lambda row: F.transform(row, lambda i: F.coalesce(F.get(regions, i)["text"], F.lit("")))
    numbers = lambda row: _any_in(F.array_join(F.transform(row, lambda i: F.get(digits, i)), ""), needs["parts"])
    key = lambda x, n: F.struct(n.alias("row_id"), x["s"].alias("s"), x["e"].alias("e"), x["type"].alias("type"), region_key(x["type"], x["text"]).alias("match_key"))
    made = lambda row, n, known: F.when(known | (F.size(needs["lengths"]) > 0), once(texts(row), lambda t: F.transform(_entries(t, needs, known), lambda x: key(x, n))))
    return _flat(F.array_compact(F.transform(rows, lambda row, n: once(numbers(row), lambda known: made(row, n, known)))))


def _span(regions: Column, cells: Column) -> Column:
    """The regions of a run as one."""
    edge = lambda k, f: f(F.transform(cells, lambda c: c["bbox"][k])).alias(k)
    return F.struct(
        F.array_join(F.transform(cells, lambda c: c["text"]), " ").alias("text"),
        F.struct(edge("x0", F.array_min), edge("y0", F.array_min), edge("x1", F.array_max), edge("y1", F.array_max)).cast(BOX).alias("bbox"),
        F.array_min(F.filter(F.transform(cells, lambda c: c["confidence"]), lambda x: x.isNotNull())).alias("confidence"),
        F.get(cells, F.lit(0))["source"].alias("source"),
    )


def _bound(names: list[str], regions: Column, rows: Column, values: Column, labels: list[tuple[str, str]], whole: bool) -> Column:
    """The values of a page, each with (status, bbox, text, confidence, source, contested, reason). ``whole``: single regions are tried before runs."""
    boxed = lambda r: r["bbox"]["x0"].isNotNull() & r["bbox"]["y0"].isNotNull() & r["bbox"]["x1"].isNotNull() & r["bbox"]["y1"].isNotNull()
    numbers = F.transform(regions, lambda r, i: i)
    none = F.array().cast("array<int>")

    def exact(digits, said, every):
        """Each value with the numbers of the regions that carry it. Of a region without the value's digits, the text is not read."""

        def hits(kind, match):
            read = lambda i, part: F.contains(F.get(digits, i), part) & (region_key(kind, F.get(regions, i)["text"]) == match)
            typed = once(_part(kind, match), lambda part: F.filter(every, lambda i: read(i, part)))
            return F.coalesce(F.when(kind == "string", F.filter(every, lambda i: F.get(said, i) == match)).when(match.isNotNull(), typed), none)

        def of(v):
            match = F.when(v["value"].isNotNull(), value_key(v["type"], v["value"]))
            return once(match, lambda m: F.struct(v.alias("v"), v["type"].alias("type"), m.alias("match_key"), (hits(v["type"], m) if whole else none).alias("hits")))

        return F.transform(values, of)

    def labelled(x):
        """The first hit in a row with the value's label; the first, if none is."""
        first = F.get(x["hits"], F.lit(0))
        if not labels:
            return first
        known = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(text).alias("label")) for k, text in labels])
        says = lambda i: F.exists(F.filter(known, lambda t: t["key"] == x["v"]["key"]), lambda t: F.coalesce(F.contains(loose(F.get(regions, i)["text"]), t["label"]), F.lit(False)))
        near = F.flatten(F.filter(rows, lambda row: F.exists(row, says)))
        return F.when(F.size(x["hits"]) > 1, F.coalesce(F.get(F.array_intersect(x["hits"], near), F.lit(0)), first)).otherwise(first)

    def placed(x, index):
        v = x["v"]
        parts = lambda r: F.struct(*[r[k].alias(k) for k in ("text", "bbox", "confidence", "source")])
        region = F.when(F.size(x["hits"]) > 0, once(F.get(regions, labelled(x)), parts))
        at = F.array_min(F.filter(index, lambda e: (e["type"] == x["type"]) & (e["match_key"] == x["match_key"])))
        cells = lambda a: F.transform(F.slice(F.get(rows, a["row_id"]), a["s"], a["e"] - a["s"] + 1), lambda i: F.get(regions, i))
        span = F.when((F.size(x["hits"]) == 0) & (x["match_key"] != ""), once(at, lambda a: F.when(a.isNotNull(), once(cells(a), lambda c: _span(regions, c)))))

        def shown(p):
            place = F.coalesce(p["region"], p["span"])
            reason = F.when(v["value"].isNull(), ABSENT).when(F.size(rows) == 0, NO_REGIONS).otherwise(NOT_FOUND)
            return F.struct(
                *[v[k].alias(k) for k in names],
                F.when(p["region"].isNotNull(), "region").when(p["span"].isNotNull(), "span").otherwise("unbound").alias("status"),
                *[place[k].alias(k) for k in ("bbox", "text", "confidence", "source")],
                F.when(F.size(x["hits"]) > 1, F.size(x["hits"]).cast("bigint")).alias("contested"),
                F.when(place.isNull(), reason).alias("reason"),
            )

        return once(F.struct(region.alias("region"), span.alias("span")), shown)

    def spread(xs, digits):
        opened = F.filter(xs, lambda x: (F.size(x["hits"]) == 0) & (x["match_key"] != ""))
        index = once(opened, lambda o: F.when(F.size(o) > 0, once(_needs(o), lambda n: _index(regions, digits, rows, n))))
        return once(index, lambda found: F.transform(xs, lambda x: placed(x, found)))

    digits = F.transform(regions, lambda r: F.when(boxed(r), _digits(r["text"])))
    texts = F.exists(values, lambda v: (v["type"] == "string") & v["value"].isNotNull())
    said = F.when(texts, F.transform(regions, lambda r: F.when(boxed(r), loose(r["text"]))))
    return once(digits, lambda d: once(once(said, lambda t: once(numbers, lambda n: exact(d, t, n))), lambda xs: spread(xs, d)))


def bound_pages(pages: DataFrame, labels: DataFrame | None = None, min_overlap: float = MIN_OVERLAP, whole: bool = True) -> DataFrame:
    """pages: a row for each page, with ``regions`` (as ``layout.ON_PAGE``) and ``values``, an array of (key, type, value) with distinct keys; other columns stay.

    Each value gets (status, bbox, text, confidence, source, contested, reason): region, else span, else unbound. labels: (key, label), of a user's size.
    """
    known = [] if labels is None else [tuple(r) for r in labels.select("key", loose(F.col("label")).alias("label")).filter("label is not null").collect()]
    names = pages.schema["values"].dataType.elementType.names
    rows = pages.withColumn("regions", F.coalesce(F.col("regions").cast(ON_PAGE), F.array().cast(ON_PAGE))).withColumn("_rows", row_lists(F.transform("regions", lambda r: r["bbox"]), min_overlap))
    return rows.withColumn("values", _bound(names, F.col("regions"), F.col("_rows"), F.col("values"), known, whole)).drop("_rows")


def each(pages: DataFrame, *columns: str) -> DataFrame:
    """A row for each bound value of a page. Pages without values are left out here, as a filter on their array would be pushed below the shuffle and make all values there."""
    return pages.select("doc_id", *columns, F.inline_outer("values")).filter("status is not null")


def exact(values: DataFrame, placed: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, key, region, matches): the first region that carries the value, one in a row with its label before others."""
    hits = each(bound_pages(paged(values, placed), labels)).filter("status = 'region'")
    return hits.select("doc_id", "key", F.struct("text", "bbox", "confidence", "source").alias("region"), F.coalesce("contested", F.lit(1)).cast("bigint").alias("matches"))


def spans(values: DataFrame, placed: DataFrame) -> DataFrame:
    """(doc_id, key, span): the first run of regions in a row, by row, start and length, that carries the value joined or in part."""
    found = each(bound_pages(paged(values, placed), whole=False)).filter("status = 'span'")
    return found.select("doc_id", "key", F.struct("text", "bbox", "confidence", "source").alias("span"))


def bound(values: DataFrame, regions: DataFrame, labels: DataFrame | None = None, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """values with (status, bbox, text, confidence, source, contested, reason), from rows of values and of regions."""
    return each(bound_pages(paged(values, regions), labels, min_overlap))
