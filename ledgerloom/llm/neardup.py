"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, rerank with the original vectors.

From a bounded sample of unit vectors a rotation is learned that makes the signs of the rotated, centred vectors balanced
and close to them (ITQ; several starts give several codes). Every distinct vector is then indexed: its codes are cut into
substrings, each the key of one table. Two vectors are compared if they share a key in any table, and only in the first
such table; the cosine of the original vectors, in double precision, decides.

The length of substrings follows log2 of the number of vectors, so buckets of unrelated vectors stay small; the number of
tables follows from the wanted recall at the threshold itself (closer pairs are found more surely). Centring widens the angle
of a pair where vectors share a direction, so tables are counted by the angles that the sample's centred vectors have; where
that would take ``DEARER`` times the tables, less of the mean is taken off. Pairs at the threshold, made from the sample, then
show the recall, and tables of random directions are added until it is the wanted one.

Equal vectors are one row with a count. Buckets of more than ``GROUP`` rows are split into sub-lists whose pairs are
groups of their own. Tasks return link counts and spanning edges, never all pairs of a group.

Vectors keep their own precision (floats or doubles) and are scaled by their largest component before any norm is taken, so that very
large and very small ones neither overflow nor vanish.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows of null vec_id, link with nothing
(component_id: the own vec_id); vectors of different length don't link; rows repeating a vector link with each other. Extra columns
are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan as bs
from .components import components
from .frames import share, stored
from .topk import finite

THRESHOLD = 0.95
#: Distinct vectors (of each length) that the rotations are learned from, at most (about), and bits of one rotation's code.
SAMPLE = 8192
MAX_BITS = 64
ROUNDS = 30
#: Wanted share of pairs found at the threshold itself, for signs of independent projections.
RECALL = 0.97
#: Times the tables of uncentred vectors that centring may cost, before less is centred; and vectors of the sample that get a partner.
DEARER = 4
PARTNERS = 2048
GROUP = 1024
BROADCAST_BUCKETS = 100_000


def learn_rotation(x: np.ndarray, bits: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """(dim, bits): principal directions of centred x, times the rotation that ITQ settles on."""
    _, w = np.linalg.eigh(x.T @ x)
    w = w[:, ::-1][:, :bits]
    v = x @ w
    r, _ = np.linalg.qr(rng.normal(size=(bits, bits)))
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ vt).T
    return w @ r


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class HammingIndex:
    """Rotations and the cut of their codes into table keys, for vectors of one length."""

    def __init__(self, sample: np.ndarray, n: int, threshold: float, recall: float = RECALL, seed: int = 7):
        unit = unit_rows(sample)
        bits = min(MAX_BITS, sample.shape[1])
        self.length = min(bits, 62, max(8, math.ceil(math.log2(max(n, 2)))))
        self.kind = np.dtype(np.int32 if self.length < 32 else np.int64)
        for part in (1.0, 0.5, 0.25, 0.0):
            self.mean = part * unit.mean(axis=0)
            self.tables = self._tables(np.linalg.norm(unit - self.mean, axis=1), threshold, recall)
            if self.tables <= DEARER * self._tables(np.ones(1), threshold, recall):
                break
        each = max(bits // self.length, 1)
        rng = np.random.default_rng(seed)
        self.rotations = [learn_rotation(unit - self.mean, bits, rng)[:, : each * self.length] for _ in range(math.ceil(self.tables / each))]
        one = unit[rng.permutation(len(unit))[:PARTNERS]]
        aside = rng.normal(size=one.shape)
        aside -= np.sum(aside * one, axis=1, keepdims=True) * one
        aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-300)
        other = threshold * one + math.sqrt(1 - threshold * threshold) * aside
        found = (self.keys(one) == self.keys(other)).any(axis=1)
        while found.mean() < recall:
            self.rotations.append(np.linalg.qr(rng.normal(size=(sample.shape[1], bits)))[0][:, : each * self.length])
            new = [self._signs(x, self.rotations[-1:]).reshape(len(x), each, self.length) for x in (one, other)]
            found |= (new[0] == new[1]).all(axis=2).any(axis=1)
            self.tables = each * len(self.rotations)

    def _tables(self, norms: np.ndarray, threshold: float, recall: float) -> float:
        """Tables that find the wanted share of pairs at the threshold, whose two vectors have these norms, by signs of independent projections."""
        half = math.sqrt((1 - threshold) / 2) / np.maximum(norms, 1e-300)
        same = (1 - 2 * np.arcsin(np.minimum(half, 1)) / math.pi) ** self.length
        few, many = 0, 1
        reached = lambda tables: np.mean(1 - (1 - same) ** tables) >= recall
        while not reached(many):
            few, many = many, 2 * many
            if many > 1 << 24:
                return math.inf
        while many - few > 1:
            middle = (few + many) // 2
            few, many = (few, middle) if reached(middle) else (middle, many)
        return many

    def _signs(self, x: np.ndarray, rotations: list[np.ndarray]) -> np.ndarray:
        unit = unit_rows(x) - self.mean
        return np.concatenate([unit @ r >= 0 for r in rotations], axis=1)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) of whole numbers."""
        signs = self._signs(x, self.rotations)[:, : self.tables * self.length].reshape(len(x), -1, self.length)
        return (signs @ (1 << np.arange(self.length))).astype(self.kind)[:, : self.tables]


def _matrix(column, dim: int) -> np.ndarray:
    """Doubles of an array column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _packed(x: np.ndarray) -> pa.Array:
    """A binary column of the rows of x: cheaper to move through Spark than arrays."""
    x = np.ascontiguousarray(x)
    offsets = np.arange(len(x) + 1, dtype=np.int64) * (x.shape[1] * x.itemsize)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)]).cast(pa.binary())


def _unpacked(column, kind) -> np.ndarray:
    b, offs = bs.buffer_of(column)
    return np.frombuffer(b.tobytes(), kind).reshape(len(offs) - 1, -1)


def indexes(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, recall: float = RECALL) -> dict[int, HammingIndex]:
    """vectors: (vec_id, v, dim). An index for each length of vector, learned from one pass over all lengths."""
    counts = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length
    if not counts:
        return {}
    part = F.create_map(*[F.lit(x) for dim, n in counts.items() for x in (dim, sample / n)])
    rows = vectors.filter(share(F.col("vec_id"), 31) < part[F.col("dim")]).select("vec_id", "v", "dim").toArrow().sort_by([("dim", "ascending"), ("vec_id", "ascending")])
    dims = rows.column("dim").to_numpy()
    return {dim: HammingIndex(_matrix(rows.filter(pa.array(dims == dim)).column("v"), dim), n, threshold, recall) for dim, n in counts.items()}


def links(vectors: DataFrame, index: dict[int, HammingIndex], threshold: float = THRESHOLD, group: int = GROUP) -> DataFrame:
    """vectors: (vec_id, v, dim, copies), distinct. Rows (a, b, copies): where b is null, a links with so many rows more; else an edge."""
    kind = np.float32 if vectors.schema["v"].dataType.elementType.typeName() == "float" else np.float64
    key_kinds = {dim: x.kind for dim, x in index.items()}

    def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = _matrix(part.column("v"), dim)
                keys = index[int(dim)].keys(x)
                column = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), keys.astype(np.int64).ravel())
                cols = [part.column("vec_id"), _packed(x.astype(kind)), part.column("dim"), part.column("copies"), column, _packed(keys)]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "v", "dim", "copies", "keys", "code"])

    coded = stored(vectors.mapInArrow(index_rows, "vec_id long, v binary, dim int, copies long, keys array<long>, code binary"), "coded")
    slim = coded.select("dim", F.posexplode("keys").alias("t", "key"))
    large = stored(slim.groupBy("dim", "t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group), "large-buckets")
    large = large.select("dim", "t", "key", F.ceil(F.col("n") / group).cast("int").alias("ways"))
    if large.count() <= BROADCAST_BUCKETS:
        large = F.broadcast(large)
    rows = coded.select("vec_id", "v", "dim", "copies", "code", F.posexplode("keys").alias("t", "key")).join(large, ["dim", "t", "key"], "left")
    rows = rows.withColumn("own", F.coalesce(F.pmod(F.xxhash64("vec_id"), F.col("ways")), F.lit(0)).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1)))
    rows = rows.select("dim", "t", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "vec_id", "v", "copies", "code")
    by = ["dim", "t", "key", "lo", "hi"]
    rows = rows.repartition(*by).sortWithinPartitions(*by)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            marks = np.stack([table.column(c).to_numpy() for c in by])
            heads = np.concatenate([[0], np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1]) if table.num_rows else np.zeros(1, int)
            rest = table.slice(heads[-1])
            if heads[-1]:
                yield from _compared(table.slice(0, heads[-1]), heads, threshold, kind, key_kinds)
        if rest is not None and rest.num_rows:
            yield from _compared(rest, np.array([0, rest.num_rows]), threshold, kind, key_kinds)

    return rows.mapInArrow(compare, "a long, b long, copies long")


def _compared(table: pa.Table, heads: np.ndarray, threshold: float, kind, key_kinds: dict) -> Iterator[pa.RecordBatch]:
    """Links within each run [heads[k], heads[k + 1]) of rows."""
    size = np.diff(heads)
    keep = np.flatnonzero(size > 1)
    if not len(keep):
        return
    pick = np.repeat(size > 1, size)
    table = table.filter(pa.array(pick))
    bounds = np.concatenate([[0], np.cumsum(size[keep])])
    dims = table.column("dim").to_numpy()
    ids, copies, t, own = (table.column(c).to_numpy() for c in ("vec_id", "copies", "t", "own"))
    halves = table.column("lo").to_numpy() != table.column("hi").to_numpy()
    for dim in np.unique(dims):  # runs of one length lie together
        a, z = np.searchsorted(dims, dim), np.searchsorted(dims, dim, "right")
        part = table.slice(a, z - a)
        x = unit_rows(_unpacked(part.column("v"), kind).astype(np.float64))
        keys = _unpacked(part.column("code"), key_kinds[int(dim)])
        edges = np.searchsorted(bounds, [a, z])
        run = bounds[edges[0] : edges[1] + 1] - a
        p, q = _pairs(x, keys, run, t[a:z], own[a:z], halves[a:z], threshold)
        if len(p):
            i, c = ids[a:z], copies[a:z]
            n = len(i)
            count = np.bincount(p, c[q], n) + np.bincount(q, c[p], n)
            met = np.flatnonzero(count)
            tree_p, tree_q = _spanning(p, q, n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([i[met], i[tree_p]])),
                    pa.array(np.concatenate([i[met], i[tree_q]]), mask=np.concatenate([np.ones(len(met), bool), np.zeros(len(tree_p), bool)])),
                    pa.array(np.concatenate([count[met].astype(np.int64), np.zeros(len(tree_p), np.int64)])),
                ],
                ["a", "b", "copies"],
            )


def _pairs(x, keys, run, t, own, halves, threshold) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the linked rows of each run that share no key in an earlier table."""
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def check(p, q):
        """p, q: pairs of rows of one run."""
        early = ((keys[p] == keys[q]) & (np.arange(keys.shape[1]) < t[p][:, None])).any(axis=1)
        ok = ~early & ~(halves[p] & (own[p] == own[q]))
        p, q = p[ok], q[ok]
        ok = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
        found.append((p[ok], q[ok]))

    size = np.diff(run)
    few = size <= 48
    number = np.repeat(np.where(few, np.arange(len(size)), -1 - np.arange(len(size))), size)
    for shift in range(1, int(size[few].max(initial=0))):
        p = np.flatnonzero((number[:-shift] == number[shift:]) & (number[:-shift] >= 0))
        for k in range(0, len(p), 1 << 16):
            check(p[k : k + (1 << 16)], p[k : k + (1 << 16)] + shift)
    for a, z in zip(run[:-1][~few], run[1:][~few], strict=True):
        for k in range(a, z, 256):
            near = x[k : min(k + 256, z)] @ x[a:z].T >= threshold - 1e-9
            p, q = np.nonzero(near)
            p, q = p + k, q + a
            for m in range(0, len(p), 1 << 16):
                pp, qq = p[m : m + (1 << 16)], q[m : m + (1 << 16)]
                check(pp[pp < qq], qq[pp < qq])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _spanning(p: np.ndarray, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, lowest row it reaches) that join what the pairs join."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[p], low[q])
        new = low.copy()
        np.minimum.at(new, low[p], least)
        np.minimum.at(new, low[q], least)
        new = new[new]
        new = np.minimum(new, new[low])
        if (new == low).all():
            break
        low = new
    at = np.flatnonzero(low != np.arange(n))
    return at, low[at]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vectors: (vec_id, embedding). (vec_id, n_links, component_id, kept) of every row."""
    v = F.col("embedding")
    good = F.coalesce(finite(v) & F.exists(v, lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    if vectors.schema["embedding"].dataType.elementType.typeName() != "float":
        v = v.cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), good.alias("good"))
    linked = rows.filter("good").select("vec_id", "v", *[F.xxhash64("v", F.lit(k)).alias(f"h{k}") for k in (1, 2)])
    distinct = linked.groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "v")).alias("low"), F.count(F.lit(1)).alias("copies"))
    distinct = stored(distinct.select("h1", "h2", "low.vec_id", "low.v", F.size("low.v").alias("dim"), "copies"), "vectors")
    met = stored(links(distinct.select("vec_id", "v", "dim", "copies"), indexes(distinct, threshold), threshold), "links")
    counts = met.filter("b is null").groupBy("a").agg(F.sum("copies").alias("more")).withColumnRenamed("a", "vec_id")
    comps = components(met.filter("b is not null").select("a", "b")).withColumnRenamed("id", "vec_id")
    of = distinct.select("h1", "h2", "vec_id", "copies").join(counts, "vec_id", "left").join(comps, "vec_id", "left")
    of = stored(of.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")), "vector-classes")
    out = linked.select("vec_id", "h1", "h2").join(of, ["h1", "h2"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = rows.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
