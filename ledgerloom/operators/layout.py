"""Regions of a page into visual rows and reading order, and split numbers joined.

regions: (doc_id, idx, text, bbox struct<x0, y0, x1, y1>, confidence, source); idx is the recogniser's order.
A region's row depends on all rows opened above it, which columns cannot express: pages are dealt by doc_id and sorted, and each task
works on the Arrow columns of many whole pages at a time. All pages take their n-th region in the same step, which looks for the first
fitting row among the anchors of every page at once. Everything else (places in a row, neighbours, joined texts) is sorting and shifting
of whole columns, so no region becomes a Python object.

Defined results: a region without a box (or with an incomplete one) is in no row and comes last; equal middles and left edges keep the recogniser's
order; a page of any size is one task's work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import BOX

#: Least shared height, as a fraction of the lower box, that puts a region in a row.
MIN_OVERLAP = 0.2
#: Regions that a task works on together, in whole pages; and entries of its table of anchors.
BATCH_REGIONS = 50_000
ANCHOR_ENTRIES = 1 << 21
#: A continuation stands within so many heights right of its decimal tail, and shares more than this part of its height.
JOIN_GAP, JOIN_OVERLAP = 0.6, 0.5

REGION = f"doc_id string, idx int, text string, bbox {BOX}, confidence double, source string"
#: Regions of a page in one row, in the recogniser's order.
ON_PAGE = f"array<struct<idx:int,text:string,bbox:{BOX},confidence:double,source:string>>"
_BOX = pa.struct([(k, pa.float64()) for k in ("x0", "y0", "x1", "y1")])


def overlap(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
    """Shared part of two extents as a fraction of the shorter; 0 if that has none."""
    shorter = np.minimum(a1 - a0, b1 - b0)
    shared = np.maximum(0.0, np.minimum(a1, b1) - np.maximum(a0, b0))
    return np.where(shorter > 0, shared / np.where(shorter > 0, shorter, 1.0), 0.0)


def rows_of(page: np.ndarray, y0: np.ndarray, y1: np.ndarray, min_overlap: float = MIN_OVERLAP) -> np.ndarray:
    """The row (from 0) of each region. From the top of its page, a region joins the first row whose anchor it overlaps enough, or opens one.

    page: ascending numbers. In step n every page that has one takes its n-th region.
    """
    order = np.lexsort(((y0 + y1) / 2, page))
    low, high = y0[order], y1[order]
    pages, start, size = np.unique(page, return_index=True, return_counts=True)
    by_size = np.argsort(-size, kind="stable")
    row = np.empty(len(page), np.int32)
    i = 0
    while i < len(pages):
        most = int(size[by_size[i]])
        some = by_size[i : i + max(1, ANCHOR_ENTRIES // most)]
        i += len(some)
        anchor = np.empty((2, len(some), most))
        opened = np.zeros(len(some), np.int64)
        for step in range(most):
            live = int(np.searchsorted(-size[some], -step))  # the pages with more regions than that
            at = start[some[:live]] + step
            width = int(opened[:live].max())
            fits = overlap(anchor[0, :live, :width], anchor[1, :live, :width], low[at][:, None], high[at][:, None]) >= min_overlap
            fits &= np.arange(width) < opened[:live, None]
            home = np.where(fits.any(axis=1), fits.argmax(axis=1), opened[:live]) if width else opened[:live].copy()
            new = np.flatnonzero(home == opened[:live])
            anchor[0, new, opened[new]], anchor[1, new, opened[new]] = low[at[new]], high[at[new]]
            opened[new] += 1
            row[order[at]] = home
    return row


class Pages:
    """Some whole pages: their regions' columns, the number of each one's page, its box, row, place in the row, and all regions in reading order."""

    def __init__(self, table: pa.Table, min_overlap: float):
        self.table = table
        self.page = _numbers(table)
        box = table.column("bbox").combine_chunks()
        edges = [box.field(k) if not box.null_count else pc.if_else(box.is_valid(), box.field(k), None) for k in range(4)]
        self.boxed = np.logical_and.reduce([e.is_valid().to_numpy(zero_copy_only=False) for e in edges])
        self.x0, self.y0, self.x1, self.y1 = (e.fill_null(0.0).to_numpy(zero_copy_only=False) for e in edges)
        has = np.flatnonzero(self.boxed)
        self.row = np.full(len(self.page), np.iinfo(np.int32).max, np.int32)
        self.row[has] = rows_of(self.page[has], self.y0[has], self.y1[has], min_overlap)
        middle = (self.y0 + self.y1) / 2
        flat = ~self.boxed
        self.order = np.lexsort((np.where(flat, 0, middle), np.where(flat, 0, self.x0), self.row, self.page))
        same = self.row[self.order], self.page[self.order]
        self.pos = self._ranks(np.flatnonzero((np.diff(same[0], prepend=-1) != 0) | (np.diff(same[1], prepend=-1) != 0)))
        self.place = self._ranks(np.flatnonzero(np.diff(same[1], prepend=-1)))

    def _ranks(self, heads: np.ndarray) -> np.ndarray:
        """For each region, its number in its run of the reading order; runs begin at ``heads``."""
        n = len(self.order)
        out = np.empty(n, np.int32)
        out[self.order] = np.arange(n) - np.repeat(heads, np.diff(np.append(heads, n)))
        return out


def _numbers(table: pa.Table) -> np.ndarray:
    """0, 0, 1, ...: a number for each run of equal doc_ids."""
    code = table.column("doc_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.cumsum(np.diff(code, prepend=code[:1]) != 0)


def _by_page(regions: DataFrame, work: Callable[[Pages], pa.Table], min_overlap: float, schema: str) -> DataFrame:
    rows = regions.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("idx").cast("int").alias("idx"), "text", F.col("bbox").cast(BOX).alias("bbox"), F.col("confidence").cast("double").alias("confidence"), "source")
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", "idx")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, most = 0, BATCH_REGIONS
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size > most:
                table = pa.Table.from_batches(held)
                page = _numbers(table)
                whole = int(np.searchsorted(page, page[-1]))  # the last page may go on
                if whole:
                    yield from work(Pages(table[:whole], min_overlap)).to_batches()
                held, size = table[whole:].combine_chunks().to_batches(), table.num_rows - whole
                most = max(BATCH_REGIONS, 2 * size)
        if size:
            yield from work(Pages(pa.Table.from_batches(held), min_overlap)).to_batches()

    return rows.mapInArrow(walk, schema)


def _placed(p: Pages) -> pa.Table:
    none = ~p.boxed
    return p.table.append_column("row_id", pa.array(p.row, mask=none)).append_column("pos", pa.array(p.pos, mask=none))


def clustered(regions: DataFrame, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """Regions with ``row_id`` and ``pos`` (from 0); both null for regions without a box."""
    return _by_page(regions, _placed, min_overlap, f"{REGION}, row_id int, pos int")


def reading_order(regions: DataFrame, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """Adds ``place``: rows from the top, each from the left, then regions without a box as recognised."""
    return _by_page(regions, lambda p: _placed(p).append_column("place", pa.array(p.place)), min_overlap, f"{REGION}, row_id int, pos int, place int")


def _joined(p: Pages) -> pa.Table:
    """A continuation ends in a digit and a tail does not, so whether two neighbours join depends on these two alone."""
    table = p.table.take(pa.array(p.order))
    page, boxed, x0, y0, x1, y1 = (a[p.order] for a in (p.page, p.boxed, p.x0, p.y0, p.x1, p.y1))
    text = pc.utf8_trim_whitespace(table.column("text").combine_chunks().fill_null(""))
    tail = pc.match_substring_regex(text, r"[.,]$").to_numpy(zero_copy_only=False)
    more = pc.match_substring_regex(text, r"^(?:[0-9]{1,2}|[0-9]{3}(?:[.,][0-9]{1,2})?)$").to_numpy(zero_copy_only=False)
    tall = np.maximum(y1[:-1] - y0[:-1], y1[1:] - y0[1:])
    near = (x0[1:] - x1[:-1]) / np.where(tall > 0, tall, 1.0) < JOIN_GAP
    joins = tail[:-1] & more[1:] & boxed[:-1] & boxed[1:] & (page[:-1] == page[1:]) & (tall > 0) & near & (overlap(y0[:-1], y1[:-1], y0[1:], y1[1:]) > JOIN_OVERLAP)
    first, gone = np.append(joins, False), np.insert(joins, 0, False)
    nxt = np.minimum(np.arange(len(first)) + 1, len(first) - 1)
    wider = [np.where(first, f(a, a[nxt]), a) for f, a in ((np.minimum, x0), (np.minimum, y0), (np.maximum, x1), (np.maximum, y1))]
    sure = table.column("confidence").combine_chunks()
    filled = sure.fill_null(1.0).to_numpy(zero_copy_only=False)
    is_first = pa.array(first)
    after = text.take(pa.array(nxt))
    columns = {
        "doc_id": table.column("doc_id"), "idx": table.column("idx"),
        "text": pc.if_else(is_first, pc.binary_join_element_wise(text, after, ""), table.column("text").combine_chunks()),
        "bbox": pc.if_else(is_first, pa.StructArray.from_arrays([pa.array(w) for w in wider], fields=list(_BOX)), table.column("bbox").combine_chunks().cast(_BOX)),
        "confidence": pc.if_else(is_first, pa.array(np.minimum(filled, filled[nxt])), sure),
        "source": pc.if_else(is_first, pa.scalar(None, pa.string()), table.column("source").combine_chunks()),
    }
    stay = np.flatnonzero(~gone)
    out = pa.table(columns).take(pa.array(stay))
    heads = np.flatnonzero(np.diff(page[stay], prepend=-1))
    return out.set_column(1, "idx", pa.array((np.arange(len(stay)) - np.repeat(heads, np.diff(np.append(heads, len(stay))))).astype(np.int32)))


def joined_numbers(regions: DataFrame, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """Regions in reading order (``idx`` renumbered), a decimal tail joined to the continuation right of it.

    A join takes the least confidence (a missing one counts as 1) and has no source.
    """
    return _by_page(regions, _joined, min_overlap, REGION)


def _flat(pages: pa.Array, columns: dict[str, pa.Array]) -> pa.Table:
    """Columns of the elements of an array column, with the number of each one's row."""
    size = pc.list_value_length(pages).fill_null(0).to_numpy(zero_copy_only=False)
    return pa.table({"doc_id": np.repeat(np.arange(len(pages)), size), **columns})


def _offsets(page: np.ndarray, pages: int) -> pa.Array:
    """Where each row's elements begin, from the ascending numbers of their rows."""
    return pa.array(np.concatenate([[0], np.cumsum(np.bincount(page, minlength=pages))]).astype(np.int32))


def row_lists(boxes: Column, min_overlap: float = MIN_OVERLAP) -> Column:
    """For an array of a page's boxes in the recogniser's order: its visual rows from the top, each the numbers (from 0) of its regions from the left.

    Boxes alone go to Python. Regions without a box are in no row; a page without any has none.
    """

    def work(pages: pa.Array) -> pa.Array:
        table = _flat(pages, {"bbox": pages.flatten()})
        if not table.num_rows:
            return pa.array([[]] * len(pages), pa.list_(pa.list_(pa.int32())))
        p = Pages(table, min_overlap)
        order = p.order[p.boxed[p.order]]
        page, row = table.column("doc_id").to_numpy(), p.row[order]
        heads = np.flatnonzero((np.diff(page[order], prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
        rows = pa.ListArray.from_arrays(pa.array(np.append(heads, len(order)).astype(np.int32)), pa.array((order - np.searchsorted(page, page[order])).astype(np.int32)))
        return pa.ListArray.from_arrays(_offsets(page[order[heads]], len(pages)), rows)

    return F.arrow_udf(work, "array<array<int>>")(boxes.cast(f"array<{BOX}>"))


def joined_on_page(regions: Column, min_overlap: float = MIN_OVERLAP) -> Column:
    """``joined_numbers`` for an array of a page's regions in the recogniser's order; null gives an empty array."""

    def work(pages: pa.Array) -> pa.Array:
        flat = pages.flatten()
        table = _flat(pages, dict(zip([f.name for f in flat.type], flat.flatten(), strict=True)))
        out = _joined(Pages(table, min_overlap)) if table.num_rows else table
        cells = pa.StructArray.from_arrays([out.column(f.name).combine_chunks().cast(f.type) for f in flat.type], fields=list(flat.type))
        return pa.ListArray.from_arrays(_offsets(out.column("doc_id").to_numpy(), len(pages)), cells)

    return F.arrow_udf(work, ON_PAGE)(regions.cast(ON_PAGE))


def _texts(p: Pages) -> pa.Table:
    order = p.order[p.boxed[p.order]]
    page, row = p.page[order], p.row[order]
    heads = np.flatnonzero((np.diff(page, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    text = p.table.column("text").combine_chunks().take(pa.array(order))
    there = text.is_valid().to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(there)])
    cells = pa.ListArray.from_arrays(pa.array(before[np.append(heads, len(order))].astype(np.int32)), text.drop_null())
    lines = pc.binary_join(cells, "  ")
    tops = np.flatnonzero(np.diff(page[heads], prepend=-1))
    pages = pa.ListArray.from_arrays(pa.array(np.append(tops, len(heads)).astype(np.int32)), lines)
    first = p.table.column("doc_id").combine_chunks().take(pa.array(order[heads[tops]]))
    return pa.table({"doc_id": first, "text": pc.binary_join(pages, "\n")})


def page_text(regions: DataFrame, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """(doc_id, text): cells two spaces apart, rows on lines of their own. A page is one row."""
    return _by_page(regions, _texts, min_overlap, "doc_id string, text string")
