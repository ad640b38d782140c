"""Merkle manifest of a dataset as a persistent tree: one version for each tampered leaf, by path copying.

A leaf is the hash of a row. Leaves of one language, ascending by doc_id, are a tree of pairs; the languages' roots, in order,
are one more tree, and its root signs the table. A version with one leaf changed copies that leaf's ancestors and shares every
other node, so it is a list of copied nodes, and its last is the version's root.

Trees are cut into aligned blocks of ``2 ** BLOCK_LEVELS`` nodes. A task builds the nodes of one block, copies the paths of its
tampered leaves up to the block's root, and goes on with the nodes above, which it gets as one row for each block: what lies
beside the way from that block's root up. Those rows come from the same step over the tables of block roots, one level of blocks
after the other (a factor of 1024 each), until every tree is one node. So no task holds more than a block, however many rows a
language has, and what moves is a leaf's hashes (twice) and a block's way up.

Defined results: a null doc_id is the first of its language; rows of equal doc_id are ordered by their leaves, and repeated rows are
leaves of their own; a null language is the first tree; an empty table gives no rows; a tampered row of null n_chars is unchanged. Extra columns
are left alone.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import bounded, stored

#: Levels of a block: 1024 nodes.
BLOCK_LEVELS = 10
#: Rows whose id's crc32 is divisible by this are tampered with.
TAMPERED = 7


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(n_chars: Column) -> Column:
    """Lowercase hex sha256 of a row of ``documents`` with this value of n_chars."""
    return F.sha2(F.concat(*map(_field, (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")))), 256)


def _hashed(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Block:
    """Nodes of one aligned block, level by level. ``alone``: it is its tree's only one, and ends where one node is left."""

    def __init__(self, nodes: list[str], levels: int = BLOCK_LEVELS, alone: bool = True):
        self.levels = [nodes]
        while len(self.levels[-1]) > 1 if alone else len(self.levels) <= levels:
            row = self.levels[-1]
            self.levels.append([_hashed(*row[k : k + 2]) for k in range(0, len(row), 2)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def beside(self, at: int) -> list[tuple[str | None, bool]]:
        """For each level below the root: the sibling of the node above leaf ``at`` (None: it has none), and whether it is on the left."""
        out = []
        for row in self.levels[:-1]:
            out.append((row[at ^ 1] if at ^ 1 < len(row) else None, bool(at & 1)))
            at >>= 1
        return out


def copied(node: str, beside: list[tuple[str | None, bool]]) -> list[str]:
    """The ancestors that a version with this changed node copies, from below; all other nodes are shared with the first version."""
    out = []
    for other, left in beside:
        node = _hashed(node) if other is None else _hashed(other, node) if left else _hashed(node, other)
        out.append(node)
    return out


_BESIDE = "array<struct<node:string,left:boolean>>"
_PAIRS = pa.list_(pa.struct([("node", pa.string()), ("left", pa.bool_())]))


def _ways(ways: list[list[tuple[str | None, bool]]]) -> pa.Array:
    return pa.array([[{"node": node, "left": left} for node, left in way] for way in ways], _PAIRS)


def _nodes(table: pa.Table, levels: int) -> tuple[pa.Table, Block, list[int]]:
    """A block's rows in order, the block, and each row's place in it. Only a tree's first block can be its only one: it is, if it is not
    full, and a full one has the same levels either way."""
    table = table.sort_by("at")
    at = table.column("at").to_pylist()
    alone = at[0] >> levels == 0
    return table, Block(table.column("node").to_pylist(), levels, alone), [k & ((1 << levels) - 1) for k in at]


def _block_roots(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, at, node) of the blocks of nodes (tree, at, node, block), stored."""

    def root(table: pa.Table) -> pa.Table:
        table, block, _ = _nodes(table, levels)
        return pa.table({"tree": table.column("tree")[:1], "at": table.column("block")[:1], "node": [block.root]})

    return stored(nodes.groupBy("tree", "block").applyInArrow(root, "tree long, at long, node string"), "merkle")


def ways_up(nodes: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """nodes: (tree, at, node), ``at`` from 0 without gaps in each tree. Adds ``beside``, from the node up to its tree's root, and that ``root``."""
    if not nodes.agg(F.max("at")).collect()[0][0]:
        return nodes.withColumn("beside", F.array().cast(_BESIDE)).withColumn("root", F.col("node"))
    cut = nodes.withColumn("block", F.shiftright("at", levels))
    above = ways_up(_block_roots(cut, levels), levels).select("tree", F.col("at").alias("block"), "beside", "root")

    def joined(low: pa.Table, up: pa.Table) -> pa.Table:
        low, block, places = _nodes(low, levels)
        rest = [(x["node"], x["left"]) for x in up.column("beside")[0].as_py()]
        ways = [block.beside(k) + rest for k in places]
        return low.select(["tree", "at", "node"]).append_column("beside", _ways(ways)).append_column("root", pa.repeat(up.column("root")[0], len(low)))

    both = cut.groupBy("tree", "block").cogroup(above.groupBy("tree", "block"))
    return both.applyInArrow(joined, f"tree long, at long, node string, beside {_BESIDE}, root string")


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds ``at``: 0, 1, ... within each value of ``tree``, in the given order. Rows are range-sorted and stored with their places;
    only the first place and the number of rows for each (partition, tree) are added up."""
    cols = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    placed = stored(rows.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33).alias("_part")  # the id's upper half is the partition
    runs = placed.groupBy(part, tree).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(tree).orderBy("_part")) - F.col("_n")
    runs = stored(runs.select("_part", F.col(tree).alias("_tree"), "_first", before.alias("_before")), "runs")
    met = placed.join(bounded(runs), (part == F.col("_part")) & F.col(tree).eqNullSafe(F.col("_tree")))
    return met.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("at"))


def manifest(docs: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, tree (its language's place), at (its place there), leaf, tampered_leaf, subroot, root;
    ``beside``, what lies beside the way from the leaf to the root; ``copied``, the nodes that the version with the tampered leaf copies
    (null where nothing is tampered with); ``folded_root``, the root of that version, else the root folded from the leaf."""
    decimal = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    n_chars = F.col("n_chars")
    changed = F.when(F.crc32(decimal) % TAMPERED == 0, leaf(F.when(n_chars.isNotNull(), n_chars + 1)))
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf(n_chars).alias("leaf"), changed.alias("tampered_leaf"))
    leaves = stored(leaves, "leaves")
    langs = leaves.select(F.lit(0).cast("long").alias("all"), "lang").distinct()
    langs = stored(ranked(langs, "all", ["lang"]).select(F.col("lang").alias("_lang"), F.col("at").alias("tree")), "langs")
    rows = ranked(leaves, "lang", ["doc_id", "leaf"]).withColumn("block", F.shiftright("at", levels))
    rows = stored(rows.join(bounded(langs), F.col("lang").eqNullSafe(F.col("_lang"))).drop("lang", "_lang"), "placed")

    roots = _block_roots(rows.select("tree", "at", F.col("leaf").alias("node"), "block"), levels)
    up = stored(ways_up(roots, levels).select("tree", F.col("at").alias("block"), "beside", F.col("root").alias("subroot")), "ways")
    heads = up.filter("block = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.col("subroot").alias("node"))
    heads = stored(ways_up(heads, levels), "heads").select(F.col("at").alias("tree"), F.col("beside").alias("rest"), "root")
    up = up.join(bounded(heads), "tree").select("tree", "block", "subroot", "root", F.concat("beside", "rest").alias("beside"))

    def versions(low: pa.Table, up: pa.Table) -> pa.Table:
        low, block, places = _nodes(low.append_column("node", low.column("leaf")), levels)
        rest = [(x["node"], x["left"]) for x in up.column("beside")[0].as_py()]
        ways = [block.beside(k) + rest for k in places]
        new = low.column("tampered_leaf").to_pylist()
        leaves = low.column("leaf").to_pylist()
        paths = [copied(node if t is None else t, way) for node, t, way in zip(leaves, new, ways, strict=True)]
        folded = [path[-1] if path else node if t is None else t for node, t, path in zip(leaves, new, paths, strict=True)]
        out = low.select(["doc_id", "tree", "at", "leaf", "tampered_leaf"])
        for name in ("subroot", "root"):
            out = out.append_column(name, pa.repeat(up.column(name)[0], len(low)))
        out = out.append_column("beside", _ways(ways))
        out = out.append_column("copied", pa.array([path if t is not None else None for t, path in zip(new, paths, strict=True)], pa.list_(pa.string())))
        return out.append_column("folded_root", pa.array(folded, pa.string()))

    both = rows.groupBy("tree", "block").cogroup(up.groupBy("tree", "block"))
    kinds = f"doc_id long, tree long, at long, leaf string, tampered_leaf string, subroot string, root string, beside {_BESIDE}, copied array<string>, folded_root string"
    return both.applyInArrow(versions, kinds)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text"))
    proof = F.sha2(F.concat_ws("", F.col("beside.node")), 256)
    verified = F.col("folded_root") == F.col("root")
    return rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", verified.alias("verified"))


def _sql_field(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || {value}, '-')"


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_sql_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


_SQL_BITS = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))"
_SQL_CRC = f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: {_SQL_BITS}))"
_SQL_UP = "list_transform(range(1, len(l) + 1, 2), lambda k: sha256(l[k] || coalesce(l[k + 1], '')))"
_SQL_BESIDE = "coalesce(l[i + CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END], '')"
_SQL_FOLD = f"sha256(CASE WHEN i % 2 = 1 THEN node || {_SQL_BESIDE} ELSE {_SQL_BESIDE} || node END)"
#: A tree is its lists of nodes by level; a row goes up by its place (from 1) in each.
OP13_SQL = f"""
WITH RECURSIVE leaves AS (SELECT doc_id, lang, {_sql_leaf("n_chars")} AS leaf, CASE WHEN {_SQL_CRC} % {TAMPERED} = 0 THEN {_sql_leaf("(n_chars + 1)")} END AS changed FROM documents),
placed AS (SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) AS i, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree FROM leaves),
levels AS (SELECT tree, 0 AS level, list(leaf ORDER BY i) AS l FROM placed GROUP BY tree UNION ALL SELECT tree, level + 1, {_SQL_UP} FROM levels WHERE len(l) > 1),
subroots AS (SELECT tree, l[1] AS subroot FROM levels WHERE len(l) = 1),
heads AS (SELECT 0 AS level, list(subroot ORDER BY tree) AS l FROM subroots UNION ALL SELECT level + 1, {_SQL_UP} FROM heads WHERE len(l) > 1),
way AS (SELECT row, tree, 0 AS level, i, coalesce(changed, leaf) AS node, '' AS beside FROM placed
  UNION ALL SELECT row, tree, level + 1, (i + 1) // 2, {_SQL_FOLD}, beside || {_SQL_BESIDE} FROM way JOIN levels USING (tree, level) WHERE len(l) > 1),
low AS (SELECT row, tree, node, beside FROM way JOIN levels USING (tree, level) WHERE len(l) = 1),
rest AS (SELECT row, 0 AS level, tree AS i, node, beside FROM low UNION ALL SELECT row, level + 1, (i + 1) // 2, {_SQL_FOLD}, beside || {_SQL_BESIDE} FROM rest JOIN heads USING (level) WHERE len(l) > 1),
folded AS (SELECT row, node AS folded_root, l[1] AS root, beside FROM rest JOIN heads USING (level) WHERE len(l) = 1)
SELECT doc_id, leaf, subroot, root, sha256(beside) AS proof_sha256, folded_root, folded_root = root AS verified FROM placed JOIN subroots USING (tree) JOIN folded USING (row)
"""
