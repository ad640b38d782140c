"""Delimited text files read exactly: strict UTF-8, sniffed delimiter, every line's cells, whatever a file's size.

Spark's CSV source drops blank lines and pads or cuts ragged rows, and quoted line ends make it read a file in one task. Here a
file is read in the byte ranges of Spark's text source (uncompressed files are cut every ``spark.sql.files.maxPartitionBytes``),
twice. The first pass sums up each range: whether its quotes are odd in number, and how many rows end in it if it begins
outside quotes, and if it begins within. A running sum over these summaries, a row for each range, says where each range
truly begins, and the second pass parses all ranges by themselves. Rows that reach over a range's edge come out in pieces, which
are put together afterwards; nothing else moves between tasks.

Defined results: an empty file has no rows; a row may be longer than a range; an unclosed quote holds the rest of its file; a
file that is not UTF-8 gives one row that names its first bad byte, a compressed one an error, too (its ranges can't be told).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import settled

# Candidate delimiters, the earlier one winning ties.
DELIMITERS = ",;\t"
BOM = b"\xef\xbb\xbf"
#: Lines with text that the delimiter is told from.
SNIFFED_LINES = 5
#: Range summaries (some 150 bytes each) up to which they are broadcast to the second pass; beyond, the lines are dealt by range.
BROADCAST_RANGES = 50_000


def count_outside_quotes(line: str, delimiter: str) -> int:
    """Delimiters in the parts of a line that an even number of quotes precedes."""
    return sum(part.count(delimiter) for part in line.split('"')[::2])


def decoded(data: bytes) -> tuple[str, bool]:
    """The text of bytes at hand and whether they had a byte-order mark; a ValueError names the first byte that is not UTF-8."""
    try:
        return data.removeprefix(BOM).decode("utf-8"), data.startswith(BOM)
    except UnicodeDecodeError as e:
        raise ValueError(f"file is not valid UTF-8 at byte {e.start + (len(BOM) if data.startswith(BOM) else 0)}") from None


def sniffed(text: str) -> str:
    """The delimiter that the first lines with text use most."""
    lines = [x for x in text.replace("\r\n", "\n").split("\n") if x][:SNIFFED_LINES]
    return max(DELIMITERS, key=lambda d: sum(count_outside_quotes(x, d) for x in lines))


def grid(text: str, delimiter: str) -> Iterator[list[str]]:
    """Rows of cells. Quotes may open and close anywhere in a cell, hold delimiters and line ends, and double for themselves."""
    row: list[str] = []
    cell: list[str] = []
    parts = text.split('"')
    for k, part in enumerate(parts):
        if k % 2:  # within quotes
            cell.append(part)
            continue
        if k and not part and k < len(parts) - 1:
            cell.append('"')  # a doubled quote
            continue
        for i, line in enumerate(part.replace("\r", "").split("\n")):
            if i:
                row.append("".join(cell))
                yield row
                row, cell = [], []
            first, *more = line.split(delimiter)
            cell.append(first)
            for x in more:
                row.append("".join(cell))
                cell = [x]
    if row or any(cell):
        row.append("".join(cell))
        yield row


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, size, raw): the bytes between line feeds, in order within each range; the source leaves a byte-order mark out."""
    rows = spark.read.option("lineSep", "\n").text(path)
    at = F.col("_metadata")
    return rows.select(at["file_path"].alias("file"), at["file_block_start"].alias("start"), at["file_size"].alias("size"), F.col("value").cast("binary").alias("raw"))


_SUMMARY = "file string, start long, size long, bytes long, odd boolean, ends_even long, ends_odd long, bad long, seen array<array<long>>"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each range: bytes, parity of its quotes, line ends after an even and after an odd number of them, first bad byte, and for its first lines
    with text how often each delimiter stands outside quotes."""
    names = ["file", "start", "size", "bytes", "odd", "ends_even", "ends_odd", "bad", "seen"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())))
    now: dict = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[n]], k) for n, k in zip(names, kinds, strict=True)], names)

    for batch in batches:
        for file, start, size, raw in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "size", "raw")), strict=True):
            if (now.get("file"), now.get("start")) != (file, start):
                if now:
                    yield out()
                now = {"file": file, "start": start, "size": size, "bytes": 0, "odd": False, "ends_even": 0, "ends_odd": 0, "bad": None, "seen": []}
            if now["bad"] is None:
                try:
                    text = raw.decode("utf-8")
                except UnicodeDecodeError as e:
                    now["bad"] = now["bytes"] + e.start
            if now["bad"] is None and len(now["seen"]) < SNIFFED_LINES and text.removesuffix("\r"):
                now["seen"].append([count_outside_quotes(text, d) for d in DELIMITERS])
            now["odd"] ^= bool(raw.count(b'"') % 2)
            now["ends_odd" if now["odd"] else "ends_even"] += 1
            now["bytes"] += len(raw) + 1
    if now:
        yield out()


def ranges(lines: DataFrame) -> DataFrame:
    """For each range of a file: whether it begins ``inside`` quotes, the number of its first ``row``, whether it is the ``last``; and the file's
    delimiter, had_bom, ``ended`` (by a line feed) and error."""
    r = settled(lines.mapInArrow(_summed, _SUMMARY), "ranges")
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    whole = Window.partitionBy("file")
    before = lambda x: F.coalesce(F.sum(x).over(upto), F.lit(0))
    r = r.withColumns({
        "inside": before(F.col("odd").cast("long")) % 2 == 1, "bytes_before": before("bytes"), "lines_before": before(F.size("seen")),
        "last": F.lead("start").over(Window.partitionBy("file").orderBy("start")).isNull(),
        "over": F.first("size").over(whole) - F.sum("bytes").over(whole),
    })
    r = r.withColumn("rows", F.when(F.col("inside"), F.col("ends_odd")).otherwise(F.col("ends_even")))
    first = F.slice("seen", 1, F.greatest(F.lit(0), SNIFFED_LINES - F.col("lines_before")).cast("int"))
    total = lambda k: F.aggregate(first, F.lit(0).cast("long"), lambda a, x: a + x[k])
    votes = [F.sum(total(k)).over(whole).alias(f"votes{k}") for k in range(len(DELIMITERS))]
    # lines are a byte longer with their feed; a mark is three bytes, a missing last feed one
    mark = F.col("over") >= 2
    r = r.select("*", *votes).withColumns({
        "row": before("rows") + 1, "had_bom": mark, "ended": F.col("over").isin(0, 3),
        "bad_byte": F.min(F.col("bad") + F.col("bytes_before") + F.when(mark, len(BOM)).otherwise(0)).over(whole),
    })
    most = F.greatest(*[F.col(f"votes{k}") for k in range(len(DELIMITERS))])
    delimiter = F.coalesce(*[F.when(F.col(f"votes{k}") == most, F.lit(d)) for k, d in enumerate(DELIMITERS)])
    error = F.when(F.col("bad_byte").isNotNull(), F.concat(F.lit("file is not valid UTF-8 at byte "), F.col("bad_byte").cast("string")))
    error = error.when(~F.col("over").isin(-1, 0, 2, 3), "file is compressed or changed while it was read")
    return r.select("file", "start", "inside", "row", "last", "ended", "had_bom", delimiter.alias("delimiter"), error.alias("error"))


_PARSED = "file string, line long, cells array<string>, delimiter string, had_bom boolean, piece long, text string"


def _final(text: str, ended: bool, delimiter: str) -> list[list[str]]:
    """The row that a file's last line ends: none, if that line is not ended and holds nothing."""
    return list(grid(text + ("\n" if ended else ""), delimiter))[:1]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that begin and end in a range with their cells; pieces of rows that reach over its edges as they are."""
    names = ["file", "line", "cells", "delimiter", "had_bom", "piece", "text"]
    kinds = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.int64(), pa.string())
    rows: list[tuple] = []
    waiting: list[str] = []
    at, done = None, ""

    def rest() -> None:
        """What a range leaves open: a piece, or in the last range the file's last row, which nothing can close."""
        file, start, _, last, ended, delimiter, bom = at
        if not waiting:
            if last and not ended and rows and rows[-1][2] is not None and not _final(done, False, delimiter):
                rows.pop()
        elif last and whole:
            rows.extend((file, line, cells, delimiter, bom, None, None) for cells in _final("\n".join(waiting), ended, delimiter))
        else:
            rows.append((file, line, None, delimiter, bom, start, "\n".join(waiting) + ("\n" if ended or not last else "")))

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("file", "start", "inside", "last", "ended", "delimiter", "had_bom", "row", "raw")]
        for *new, row, raw in zip(*columns, strict=True):
            if at != new:
                if at is not None:
                    rest()
                at, line, odd, waiting = new, row, new[2], []
                whole = not odd  # the first row began here
            text = raw.decode("utf-8")
            waiting.append(text)
            odd ^= bool(text.count('"') % 2)
            if odd:
                continue
            file, start, _, _, _, delimiter, bom = at
            done = "\n".join(waiting)
            if not whole:
                rows.append((file, line, None, delimiter, bom, start, done + "\n"))
            elif '"' not in done:
                rows.append((file, line, done.replace("\r", "").split(delimiter), delimiter, bom, None, None))
            else:
                rows.append((file, line, next(grid(done + "\n", delimiter)), delimiter, bom, None, None))
            line, waiting, whole = line + 1, [], True
        if len(rows) > 5000:  # the last one may still prove empty
            yield _batch(rows[:-1], kinds, names)
            del rows[:-1]
    if at is not None:
        rest()
    if rows:
        yield _batch(rows, kinds, names)


def _batch(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, cells, delimiter, had_bom, error): a row for each row of a file (from line 1); one with an error for an unreadable file."""
    lines = _lines(spark, path)
    known = settled(ranges(lines), "ranges")
    good = known.filter("error is null").drop("error")
    if known.count() <= BROADCAST_RANGES:
        met = lines.join(F.broadcast(good), ["file", "start"])  # lines stay in their order
    else:
        met = lines.withColumn("nth", F.monotonically_increasing_id()).join(good, ["file", "start"]).repartition("file", "start").sortWithinPartitions("file", "start", "nth")
    rows = settled(met.select("file", "start", "inside", "last", "ended", "delimiter", "had_bom", "row", "raw").mapInArrow(_parsed, _PARSED), "cells")
    pieces = rows.filter("cells is null").groupBy("file", "line", "delimiter", "had_bom").agg(F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda x: x["text"]), "")

    @F.arrow_udf("array<string>")
    def cells_of(texts: pa.Array, delimiters: pa.Array) -> pa.Array:
        return pa.array([next(grid(t, d)) for t, d in zip(texts.to_pylist(), delimiters.to_pylist(), strict=True)], pa.list_(pa.string()))

    joined = pieces.select("file", "line", cells_of(text, F.col("delimiter")).alias("cells"), "delimiter", "had_bom")
    none = lambda kind: F.lit(None).cast(kind)
    bad = known.filter("error is not null").groupBy("file").agg(F.min("error").alias("error"))
    bad = bad.select("file", none("long").alias("line"), none("array<string>").alias("cells"), none("string").alias("delimiter"), none("boolean").alias("had_bom"), "error")
    whole = rows.filter("cells is not null").select("file", "line", "cells", "delimiter", "had_bom")
    return whole.unionByName(joined).withColumn("error", none("string")).unionByName(bad)
