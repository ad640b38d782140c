"""Fill-in-the-middle over seekable compressed texts.

A text is stored as independent zstandard frames of at most ``FRAME_BYTES`` bytes, cut between characters, with the bytes,
characters and units that lie before each. A unit is a run of ASCII letters or any other single character. A cut after some
number of units is found by binary search over the frames' counts, and only the frame that holds it is decompressed. The
transformed text is again a sequence of frames: those that no cut goes through are taken over as they are, the parts of cut
frames and the marks become frames of their own. Digests stream over frames in order, one decompressed at a time.

Defined results: a null text is empty; a null doc_id has no digits in what is hashed; texts that hold a mark stay plain, so a mark in a
transformed text is never the text's own; repeated rows are alike; an empty table gives no rows. A text is in a task's memory
once, as its cell, and otherwise in compressed frames. Extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import SPACE, buffer_of
from .frames import stored, text_batches

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FRAME_BYTES = 1 << 16
PLAIN_PERCENT, SPM_PERCENT = 10, 20
LEVEL = 3

_LETTER = np.zeros_like(SPACE)
_LETTER[65:91] = _LETTER[97:123] = True


@dataclass
class Frames:
    """A text as independent frames: ``ends[k]`` is where the compressed frame k ends in ``data``; ``starts``, ``chars``, ``units`` count the bytes,
    characters and units that begin before frame k, and last of all; ``inside[k]`` says that frame k begins within a run of letters."""

    data: bytes = b""
    ends: list[int] = field(default_factory=list)
    starts: list[int] = field(default_factory=lambda: [0])
    chars: list[int] = field(default_factory=lambda: [0])
    units: list[int] = field(default_factory=lambda: [0])
    inside: list[bool] = field(default_factory=list)

    def frame(self, k: int) -> memoryview:
        return memoryview(self.data)[self.ends[k - 1] if k else 0 : self.ends[k]]

    def raw(self, k: int) -> bytes:
        return zstandard.decompress(self.frame(k))

    def cut(self, unit: int) -> tuple[int, int]:
        """Bytes and characters before the ``unit``-th unit (from 0), or all of them."""
        if unit >= self.units[-1]:
            return self.starts[-1], self.chars[-1]
        k = int(np.searchsorted(self.units, unit, "right")) - 1
        b = np.frombuffer(self.raw(k), np.uint8)
        at = int(np.flatnonzero(unit_starts(b, self.inside[k]))[unit - self.units[k]])
        return self.starts[k] + at, self.chars[k] + int(np.count_nonzero(b[:at] & 0xC0 != 0x80))

    def parts(self, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        """(k, a, z): bytes [a, z) of frame k, in order, for the bytes [lo, hi) of the text."""
        k = max(int(np.searchsorted(self.starts, lo, "right")) - 1, 0)
        while k < len(self.ends) and self.starts[k] < hi:
            yield k, max(lo - self.starts[k], 0), min(hi, self.starts[k + 1]) - self.starts[k]
            k += 1

    def read(self, lo: int, hi: int) -> Iterator[memoryview]:
        """The bytes [lo, hi), a frame's at a time."""
        for k, a, z in self.parts(lo, hi):
            yield memoryview(self.raw(k))[a:z]


def unit_starts(b: np.ndarray, inside: bool) -> np.ndarray:
    """Which bytes begin a unit; ``inside``: a letter came before."""
    letter = _LETTER[b]
    before = np.concatenate([[inside], letter[:-1]]) if len(b) else letter
    return (b & 0xC0 != 0x80) & ~(letter & before)


def framed(b: np.ndarray, most: int = FRAME_BYTES) -> Frames:
    """The frames of one text's UTF-8 bytes."""
    out, parts, at, size, inside = Frames(), [], 0, 0, False
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    while at < len(b):
        z = min(at + most, len(b))
        while z < len(b) and b[z] & 0xC0 == 0x80:
            z += 1
        part = b[at:z]
        parts.append(pack(part.tobytes()))
        size += len(parts[-1])
        out.ends.append(size)
        out.inside.append(inside)
        out.starts.append(z)
        out.chars.append(out.chars[-1] + int(np.count_nonzero(part & 0xC0 != 0x80)))
        out.units.append(out.units[-1] + int(np.count_nonzero(unit_starts(part, inside))))
        inside, at = bool(_LETTER[part[-1]]), z
    out.data = b"".join(parts)
    return out


class Writer:
    """Frames put one after the other: ranges of another text's frames, and short pieces."""

    def __init__(self):
        self.parts, self.size, self.ends, self.starts = [], 0, [], [0]
        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress

    def _add(self, frame: bytes | memoryview, raw: int) -> None:
        self.parts.append(frame)
        self.size += len(frame)
        self.ends.append(self.size)
        self.starts.append(self.starts[-1] + raw)

    def put(self, raw: bytes | memoryview) -> None:
        if len(raw):
            self._add(self.pack(raw), len(raw))

    def take(self, text: Frames, lo: int, hi: int) -> None:
        """The bytes [lo, hi) of ``text``; whole frames are taken over."""
        for k, a, z in text.parts(lo, hi):
            if (a, z) == (0, text.starts[k + 1] - text.starts[k]):
                self._add(text.frame(k), z)
            else:
                self.put(memoryview(text.raw(k))[a:z])

    def done(self) -> Frames:
        return Frames(b"".join(self.parts), self.ends, self.starts)


def transformed(text: Frames, form: str, first: int, second: int) -> tuple[Frames, int | None, int | None]:
    """The text in this form, cut after so many units, and the characters of its prefix and middle."""
    if form == "plain":
        return text, None, None
    (a, a_chars), (z, z_chars), w = text.cut(first), text.cut(second), Writer()
    prefix, middle, suffix = (PREFIX, 0, a), (MIDDLE, a, z), (SUFFIX, z, text.starts[-1])
    for mark, lo, hi in (prefix, suffix, middle) if form == "psm" else (suffix, prefix, middle):
        w.put(mark)
        w.take(text, lo, hi)
    return w.done(), a_chars, z_chars - a_chars


def restored(output: Frames, form: str) -> Iterator[memoryview]:
    """The text, from the output and its form alone: one pass finds the marks, one reads what is between them in the text's order."""
    if form == "plain":
        yield from output.read(0, output.starts[-1])
        return
    at, before, marks = 0, b"", {}
    for part in output.read(0, output.starts[-1]):
        seen = before + bytes(part)
        for mark in (PREFIX, SUFFIX, MIDDLE):
            k = seen.find(mark)
            if k >= 0:
                marks.setdefault(mark, at - len(before) + k)
        at += len(part)
        before = seen[-2:]
    edges = sorted(marks.values()) + [at]
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from output.read(marks[mark] + len(mark), edges[edges.index(marks[mark]) + 1])


_FRAMES = "data binary, ends array<long>, starts array<long>, chars array<long>, units array<long>, inside array<boolean>"
_KINDS = {"data": pa.binary(), "ends": pa.list_(pa.int64()), "starts": pa.list_(pa.int64()), "chars": pa.list_(pa.int64()), "units": pa.list_(pa.int64()), "inside": pa.list_(pa.bool_())}


def _batch(rows: list[dict], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))


def store(docs: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """(doc_id, marked, data, ends, starts, chars, units, inside) of every row: its text's frames (see ``Frames``), and whether it holds a mark. A stored table."""
    text_batches(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, offs = buffer_of(batch.column("text"))
            rows = [vars(framed(b[lo:hi], frame_bytes)) for lo, hi in zip(offs[:-1], offs[1:], strict=True)]
            out = _batch(rows, _KINDS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("marked"), *out.columns], names=["doc_id", "marked", *_KINDS])

    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.coalesce(F.col("text").contains(mark.decode()), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), marked.alias("marked"), "text")
    return stored(rows.mapInArrow(pack, f"doc_id long, marked boolean, {_FRAMES}"), "frames")


def plans(texts: DataFrame) -> DataFrame:
    """Adds n, form and the cuts ``first`` and ``second`` (units), all fixed by doc_id, the number of units and the marks."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    n = F.element_at("units", -1)
    plain = (n == 0) | F.col("marked") | (h[2] % 100 >= 100 - PLAIN_PERCENT)
    form = F.when(plain, "plain").when(h[3] % 100 < SPM_PERCENT, "spm").otherwise("psm")
    a, z = h[0] % (n + 1), h[1] % (n + 1)
    return texts.withColumns({"n": n, "form": form, "first": F.least(a, z), "second": F.greatest(a, z)})


_OUT = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.binary(), "output_ends": pa.list_(pa.int64()), "output_starts": pa.list_(pa.int64())}


def infilled(docs: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, output_ends, output_starts): ``output`` is the transformed text as a zstandard stream of
    independent frames, of which frame k ends at byte ``output_ends[k]`` and begins at byte ``output_starts[k]`` of the decompressed text."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                out, prefix, middle = transformed(Frames(*(r[k] for k in _KINDS)), r["form"], r["first"], r["second"])
                rows.append(r | {"prefix_chars": prefix, "middle_chars": middle, "output": out.data, "output_ends": out.ends, "output_starts": out.starts})
            yield _batch(rows, _OUT)

    kinds = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary, output_ends array<long>, output_starts array<long>"
    return plans(store(docs, frame_bytes)).mapInArrow(turn, kinds)


def digests(outputs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256), read from the rows of ``infilled`` alone."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]

    def sha256(parts: Iterator[memoryview]) -> str:
        h = hashlib.sha256()
        for part in parts:
            h.update(part)
        return h.hexdigest()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, back = [], []
            for form, *columns in zip(*(batch.column(c).to_pylist() for c in ("form", "output", "output_ends", "output_starts")), strict=True):
                out = Frames(*columns)
                whole.append(sha256(out.read(0, out.starts[-1])))
                back.append(sha256(restored(out, form)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(whole), pa.array(back)], names=[*names, "output_sha256", "restored_sha256"])

    return outputs.mapInArrow(read, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(infilled(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


_SQL_H = "CAST('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), {}, 8) AS BIGINT)"
OP12_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, {", ".join(f"{_SQL_H.format(8 * k + 1)} AS h{k + 1}" for k in range(4))} FROM documents),
f AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS z,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {100 - PLAIN_PERCENT} THEN 'plain' WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:z], '') AS middle, array_to_string(u[z + 1:], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
