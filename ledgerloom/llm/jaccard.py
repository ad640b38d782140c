"""N-gram Jaccard join as a blocked sparse matrix product of documents by word n-grams.

The product runs on prefix columns and finds candidate pairs; overlaps are counted in ``verified``. A document's row holds its
distinct 5-word shingles, as 64-bit hashes. Two documents link when 100 * overlap >= 80 * union. The product of the incidence
matrix with its transpose gives overlaps; it is cut down without loss:

* rows with equal shingle sets are one row, and near-copies found cheaply are joined first: rows that share one of four
  min-hash keys are compared with that key's row of smallest doc_id (a star, not all pairs). Pairs already known to be in one
  component are left out of the product; components are all that is asked for.
* in a global order of the columns, rarest first, two rows that link share a column among the first
  n - ceil(0.8 n) + 1 of each, so only these columns enter. Columns common in the corpus come last; the counts that
  say which affect only the order, never the result.
* columns are cut into blocks by hash. A block's task multiplies its part: for each column, all pairs of rows whose sizes
  allow a link and whose remaining columns could still reach the least overlap that the sizes ask for. Very similar rows, which would
  meet in most blocks, meet once, where their first columns are the same. Met pairs are summed over blocks to make each one row.
* a sketch of parities bounds from below in how many elements two sets differ, and rules out most pairs left over.
* what then is left is counted exactly over the whole sets, rebuilt from the texts of just these rows.

A column that more than ``LIST_ROWS`` prefixes hold, by its count over all of them, is split into salted pairs of sub-lists over several tasks.

Rows are told apart by a number given when their shingle sets are stored, and texts are known again by the sets' fingerprints, so ids
may repeat: a doc_id is one document, and links with whatever any of its rows links with.

Defined results: null, empty or blank text: 0 shingles, linked with nothing, its own component; fewer than 5 words: one
shingle of all of them; repeated rows share a class, as do different texts of one doc_id; rows of a null doc_id link with nothing
and have a null component. A very long text passes in windows: a worker needs about 40 bytes for each of its words. Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan as bs
from .components import components
from .frames import drop_ids, marked, stored, text_batches

N = 5
LEAST = 80  # per cent
#: Columns whose place in the order is by count: the most common ones, at most, of so many documents at least.
COMMON_COLUMNS = 1 << 17
COMMON_DOCS = 4
#: The part of all columns, from the smallest hash on, that is counted over all documents, and bytes of text for each block of the count;
#: others count if they are in so many rows of a partition.
COUNTED = 0.375
COUNT_BYTES = 24 << 20
COMMON_ROWS = 3
BLOCK_ENTRIES = 1 << 20
LIST_ROWS = 8192
#: Hash ranges over which columns are counted first, and how many columns are split at most.
COUNT_RANGES = 1 << 16
MOST_SPLIT = 1 << 20
#: Bytes of a text that are cut into words at a time.
WINDOW_BYTES = 2 << 20
#: Documents compared with one copy of another's set before it is sent again.
FAN_OUT = 256
#: Partitions that blocks are dealt to: beyond that many blocks a partition sorts several and works on one after the other.
MOST_PARTITIONS = 1 << 15

_STEP = np.uint64(0xD6E8FEB86659FD93)


def needed(n: np.ndarray) -> np.ndarray:
    """The least overlap of a set of n with any set it links with."""
    return (LEAST * n + 99) // 100


def prefix_length(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n - needed(n) + 1, 0)


def word_hashes(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words end to end, and each text's n + 1 bounds; a long text goes through in windows between words."""
    cuts = bs.cut_before(b, offs, bs.SPACE, WINDOW_BYTES)
    many, parts = np.zeros(len(offs), np.int64), []
    for a, z in zip(cuts[:-1], cuts[1:], strict=True) if cuts is not offs else [(0, len(b))]:
        inner = offs if cuts is offs else np.array([0, z - a])
        s, e = bs.word_spans(b[a:z], inner, ~bs.SPACE)
        parts.append(bs.span_hashes(b[a:z], s, e, bs.FOLDED))
        if cuts is offs:
            return parts[0], bs.slices(bs.owners(offs, s), len(offs) - 1)
        many[np.searchsorted(offs, a, "right")] += len(s)
    return np.concatenate([*parts, np.zeros(0, np.uint64)]), np.cumsum(many)


def shingle_sets(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sorted distinct shingle hashes end to end, and n + 1 bounds."""
    n = len(offs) - 1
    w, at = word_hashes(b, offs)
    count = np.diff(at)
    power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(N - 1, _STEP)]))
    size = np.where(count >= N, count - N + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(bounds[-1], np.uint64)
    for d in range(n):
        a, z, c = bounds[d], bounds[d + 1], count[d]
        if c >= N:
            part = out[a:z]
            for i, j in bs.windows(z - a):
                h = w[at[d] + i : at[d] + j].copy()
                for k in range(1, N):
                    h += w[at[d] + i + k : at[d] + j + k] * power[k]
                part[i:j] = bs.mixed(h + np.uint64(N))
            part.sort()
        elif c:
            out[a] = bs.mixed(np.array([(w[at[d] : at[d + 1]] * power[:c]).sum() + np.uint64(c)], np.uint64))[0]
    if len(out):
        new = np.ones(len(out), bool)
        new[1:] = out[1:] != out[:-1]
        new[bounds[:-1][size > 0]] = True
        bounds = np.concatenate([[0], np.cumsum(new)])[bounds]
        out = out[new]
    return out, bounds


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    b, offs = bs.buffer_of(batch.column("text"))
    for i, j in bs.blocks(offs):
        yield i, j, *shingle_sets(b[offs[i] : offs[j]], offs[i : j + 1] - offs[i])


def slots(spark: SparkSession, n: int) -> np.ndarray:
    """For each partition of a repartitioning by one int column into n, a number that goes there. n: ``MOST_PARTITIONS`` at most."""
    tried, found = 4 * n, []
    while len(found) < n:
        tried *= 2
        at = spark.range(tried).select(F.col("id").cast("int").alias("id"))
        found = at.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).orderBy("p").collect()
    return np.array([r["id"] for r in found], np.int32)


def common_columns(docs: DataFrame, most: int = COMMON_COLUMNS) -> np.ndarray:
    """The hashes of the most common shingles, rarest first.

    Prefixes are filled with the smallest hashes, so hashes in the first ``COUNTED`` of their range are counted one by one over all
    documents, in blocks; of the others those that are common within a partition.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    blocks = max(16, -(-size // COUNT_BYTES))
    partitions = min(blocks, MOST_PARTITIONS)
    slot = slots(docs.sparkSession, partitions)
    cut = np.uint64(int(COUNTED * 2**64))

    def packed(u: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        block = (u % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        heads = np.flatnonzero(np.diff(block[order], prepend=-1))
        which, packs = block[order[heads]], []
        for pick in np.split(order, heads[1:]) if len(heads) else []:
            again = np.flatnonzero(n[pick] > 1)
            head = np.array([len(pick), len(again)], np.int64)
            packs.append(b"".join(x.tobytes() for x in (head, u[pick], n[pick][again].astype(np.int64), again.astype(np.uint32))))
        return pa.RecordBatch.from_arrays([pa.array(slot[which % partitions]), pa.array(which), pa.array(packs, pa.binary())], ["slot", "block", "pack"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, kept, counts, waiting, size, low, low_size = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0, [], 0

        def merge():
            nonlocal kept, counts, waiting, size
            u, c = np.unique(np.concatenate([*waiting, np.zeros(0, np.uint64)]), return_counts=True)
            u, c = u[c > 1], c[c > 1]
            both, at = np.unique(np.concatenate([kept, u]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, c]), len(both)).astype(np.int64)
            kept, waiting, size = both, [], 0
            if len(kept) > 500_000:
                few = np.partition(counts, -250_000)[-250_000]
                kept, counts = kept[counts >= few], counts[counts >= few]

        for batch in batches:
            docs += batch.num_rows
            for _, _, h, _ in _sets(batch):
                first = h < cut
                low.append(h[first])
                low_size += len(low[-1])
                waiting.append(h[~first])
                size += len(waiting[-1])
                if size > 500_000:
                    merge()
                if low_size > 2_000_000:
                    yield packed(*np.unique(np.concatenate(low), return_counts=True))
                    low, low_size = [], 0
        merge()
        often = counts >= max(COMMON_ROWS, docs // 4000)
        u, n = np.unique(np.concatenate([*low, np.zeros(0, np.uint64)]), return_counts=True)
        yield packed(np.concatenate([u, kept[often]]), np.concatenate([n, counts[often]]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(packs: list[bytes]) -> pa.RecordBatch:
            keys, many = [], []
            for raw in packs:
                n, m = np.frombuffer(raw, np.int64, 2)
                keys.append(np.frombuffer(raw, np.uint64, n, 16))
                many.append(np.ones(n, np.int64))
                many[-1][np.frombuffer(raw, np.uint32, m, 16 + 8 * n + 8 * m)] = np.frombuffer(raw, np.int64, m, 16 + 8 * n)
            u, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(at, np.concatenate(many), len(u)).astype(np.int64)
            often = n >= COMMON_DOCS
            return pa.RecordBatch.from_arrays([pa.array(u[often].view(np.int64)), pa.array(n[often])], ["h", "n"])

        now, packs = None, []
        for batch in batches:
            for k, raw in zip(batch.column("block").to_pylist(), batch.column("pack"), strict=True):
                if now is not None and k != now:
                    yield result(packs)
                    packs = []
                now = k
                packs.append(raw.as_py())
        if packs:
            yield result(packs)

    dealt = docs.select("text").mapInArrow(count, "slot int, block long, pack binary").repartition(partitions, "slot").sortWithinPartitions("block")
    top = dealt.mapInArrow(add, "h long, n long").orderBy(F.desc("n"), "h").limit(most).toArrow()
    return top.column("h").to_numpy().view(np.uint64)[::-1].copy()


def parity(h: np.ndarray) -> bytes:
    """Whether each of m hash classes holds an odd number of elements, m the power of two from 64 on that is no less than the set's size."""
    m = 64
    while m < len(h):
        m *= 2
    odd = np.zeros(m, np.uint8)
    for a, z in bs.windows(len(h)):
        at = (bs.mixed(h[a:z] + np.uint64(17)) & np.uint64(m - 1)).astype(np.int64)
        if m <= bs.SPAN:
            odd ^= (np.bincount(at, minlength=m) & 1).astype(np.uint8)
        else:
            np.add.at(odd, at, 1)
    return np.packbits(odd & 1, bitorder="little").tobytes()


def parity_difference(a: bytes, b: bytes) -> int:
    """A number no larger than the count of elements that only one of two sets holds; the longer sketch is folded first."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    i, j = 8 * len(a), 8 * len(b)
    while i > j:
        i //= 2
        x = (x >> i) ^ (x & ((1 << i) - 1))
    while j > i:
        j //= 2
        y = (y >> j) ^ (y & ((1 << j) - 1))
    return (x ^ y).bit_count()


_ROW = "doc_id long, h1 long, h2 long, n long, f1 long, f2 long, keys array<long>, prefix binary, sketch binary"


def fingerprints(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(2, sets): two sums over all elements that tell sets apart."""
    sums = np.zeros((2, len(at) - 1), np.uint64)
    for a, z in bs.windows(len(h)):
        owner = np.searchsorted(at, np.arange(a, z), "right") - 1
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        for f, k in zip(sums, (11, 13), strict=True):
            f[owner[first]] += np.add.reduceat(bs.mixed(h[a:z] + np.uint64(k)), first)
    return sums.view(np.int64)


def min_hash_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(sets, 4)"""
    low = np.full((8, len(at) - 1), np.uint64(2**64 - 1))
    for a, z in bs.windows(len(h)):
        owner = np.searchsorted(at, np.arange(a, z), "right") - 1
        mixed = bs.mixed(h[a:z] * np.uint64(2) + np.uint64(1))
        for c in range(8):
            pick = np.flatnonzero(mixed & np.uint64(7) == c)
            if len(pick):
                first = np.flatnonzero(np.diff(owner[pick], prepend=-1))
                of = owner[pick][first]
                low[c, of] = np.minimum(low[c, of], np.minimum.reduceat(mixed[pick], first))
    return np.stack([bs.mixed(low[2 * c] + low[2 * c + 1] * np.uint64(3) + np.uint64(c)).view(np.int64) for c in range(4)], axis=1)


def rows_of(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(doc_id, h1, h2, n, f1, f2, keys, prefix, sketch): two hashes of the text, set size, fingerprint, four min-hash keys, first columns in the global order, parities."""
    spread = docs.sparkSession.sparkContext.broadcast((np.sort(common), np.argsort(common).astype(np.int64)))  # at most COMMON_COLUMNS

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered, rank = spread.value
        for batch in batches:
            names = ["doc_id", "h1", "h2"]
            for i, j, h, at in _sets(batch):
                n = np.diff(at)
                hot, ranks = np.zeros(len(h), bool), [np.zeros(0, np.int64)]
                for a, z in bs.windows(len(h)) if len(ordered) else []:
                    place = np.minimum(np.searchsorted(ordered, h[a:z]), len(ordered) - 1)
                    hot[a:z] = ordered[place] == h[a:z]
                    ranks.append(rank[place[hot[a:z]]])
                rank_at = np.concatenate([[0], np.cumsum(hot)])[at]
                ranks = np.concatenate(ranks)
                take = prefix_length(n)
                prefix, sketch = [], []
                for d in range(j - i):
                    part = h[at[d] : at[d + 1]]
                    rare = part[np.flatnonzero(~hot[at[d] : at[d + 1]])[: take[d]]]
                    if len(rare) < take[d]:
                        r = np.sort(ranks[rank_at[d] : rank_at[d + 1]])[: take[d] - len(rare)]
                        rare = np.concatenate([rare, common[r]])
                    prefix.append(rare.tobytes())
                    sketch.append(parity(part))
                keys, f = min_hash_keys(h, at), fingerprints(h, at)
                cols = [*(batch.column(c).slice(i, j - i) for c in names), pa.array(n), pa.array(f[0]), pa.array(f[1])]
                cols += [pa.array(list(keys), pa.list_(pa.int64())), pa.array(prefix, pa.binary()), pa.array(sketch, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, [*names, "n", "f1", "f2", "keys", "prefix", "sketch"])

    return _hashed(docs).mapInArrow(build, _ROW)


def _hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, h1, h2): two hashes that tell the texts of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"))


def one_text_each(docs: DataFrame, again: DataFrame) -> DataFrame:
    """(doc_id, text, h1, h2) of rows with an id, equal rows of the doc_ids in ``again`` once."""
    docs = _hashed(docs).filter("doc_id is not null")
    if again.isEmpty():
        return docs
    near = marked(docs, "doc_id", again)
    return near.filter("not _hit").drop("_hit").unionByName(near.filter("_hit").drop("_hit").dropDuplicates(["doc_id", "h1", "h2"]))


def verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs: (a, b) of rows; sets: (row, doc_id, h1, h2, f1, f2), stored; texts: (doc_id, text, h1, h2). The (a, b) of doc_ids whose rows' texts link, counted over whole sets.

    Texts of the rows met are dealt to the pairs' first rows, a row with many partners in several parts, and cut into shingles there.
    What is joined on a row is a stored table or dealt anew, so that adaptive execution can split a row with very many partners.
    """
    pairs = stored(pairs.select("a", "b").distinct(), "pairs")
    fan = stored(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN_OUT).cast("int").alias("fan")), "pair-fans")
    right = pairs.join(fan, "a").select(F.col("b").alias("row"), "a", F.pmod(F.xxhash64("b"), F.col("fan")).cast("int").alias("salt"), F.lit(False).alias("own"))
    left = fan.select(F.col("a").alias("row"), "a", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("salt"), F.lit(True).alias("own"))
    sides = stored(right.unionAll(left).join(sets.select("row", "doc_id", "h1", "h2", "f1", "f2"), "row").drop("row"), "pair-sides")
    ids = stored(sides.select("doc_id").distinct(), "pair-ids")
    rows = marked(texts, "doc_id", ids).filter("_hit").drop("_hit").join(sides, ["doc_id", "h1", "h2"]).drop("h1", "h2")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.desc("own"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, its = np.zeros(0, np.uint64), None
        for batch in batches:
            ids, own, f1, f2 = (batch.column(c).to_pylist() for c in ("doc_id", "own", "f1", "f2"))
            found: tuple[list, list] = ([], [])
            for i, j, h, at in _sets(batch):
                f = fingerprints(h, at).tolist()
                for k in range(i, j):
                    if (f[0][k - i], f[1][k - i]) != (f1[k], f2[k]):  # another text of this id
                        continue
                    other = h[at[k - i] : at[k - i + 1]]
                    if own[k]:
                        mine, its = other.copy(), ids[k]
                        continue
                    if not len(mine) or not len(other):
                        continue
                    small, large = (mine, other) if len(mine) <= len(other) else (other, mine)
                    both = sum(int((large[np.minimum(np.searchsorted(large, small[a:z]), len(large) - 1)] == small[a:z]).sum()) for a, z in bs.windows(len(small)))
                    if 100 * both >= LEAST * (len(mine) + len(other) - both):
                        found[0].append(its)
                        found[1].append(ids[k])
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], ["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def plausible(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches don't rule out a link: sets that link differ in (na + nb) / 9 elements at most.

    rows: (row, n, sketch), one for each row.
    """

    def may_link(na: pa.Array, nb: pa.Array, sa: pa.Array, sb: pa.Array) -> pa.Array:
        most = (100 - LEAST) * (na.to_numpy() + nb.to_numpy()) // (100 + LEAST)
        return pa.array([parity_difference(x, y) <= k for x, y, k in zip(sa.to_pylist(), sb.to_pylist(), most.tolist(), strict=True)], pa.bool_())

    a, b = (rows.select(F.col("row").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "ab")
    both = pairs.select("a", "b").join(a, "a").join(b, "b")
    return both.filter(F.arrow_udf(may_link, "boolean")("na", "nb", "sa", "sb")).select("a", "b")


def star_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): each row with that of the smallest doc_id under each of its min-hash keys, where sizes allow a link.

    Copies are more like what they were copied from than like each other, and an original's id is often the smallest.
    """
    keyed = rows.filter("n > 0").select("doc_id", "row", "n", F.explode(F.array_distinct("keys")).alias("key"))
    low = stored(keyed.groupBy("key").agg(F.min(F.struct("doc_id", "row", "n")).alias("low"), F.count(F.lit(1)).alias("many")).filter("many > 1"), "star-centres")
    pairs = keyed.join(low, "key").select(F.col("low.row").alias("a"), F.col("row").alias("b"), F.col("low.n").alias("na"), F.col("n").alias("nb"))
    return pairs.filter((F.col("a") != F.col("b")) & (LEAST * F.greatest("na", "nb") <= 100 * F.least("na", "nb"))).select("a", "b").distinct()


def split_columns(rows: DataFrame, entries: int, list_rows: int = LIST_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The columns that more than ``list_rows`` prefixes hold, by their counts over all rows, ascending; and into how many lists each is split.

    Counts of ``COUNT_RANGES`` hash ranges rule most columns out; those of the other ranges are counted one by one. With more than
    MOST_SPLIT * list_rows entries the lists get longer, so that at most MOST_SPLIT columns (16 MB) are split.
    """
    list_rows = max(list_rows, entries // MOST_SPLIT)
    shift = np.uint64(64 - int(np.log2(COUNT_RANGES)))

    def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNT_RANGES, np.int64)
        for batch in batches:
            key = np.frombuffer(b"".join(batch.column("prefix").to_pylist()), np.uint64)
            total += np.bincount((key >> shift).astype(np.int64), minlength=COUNT_RANGES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["h", "n"])

    over = lambda counts: counts.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") > list_rows)
    full = np.array([r["h"] for r in over(rows.select("prefix").mapInArrow(by_range, "h long, n long")).collect()], np.int64)  # COUNT_RANGES at most
    if not len(full):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    likely = np.zeros(COUNT_RANGES, bool)
    likely[full] = True

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.frombuffer(b"".join(batch.column("prefix").to_pylist()), np.uint64)
            u, n = np.unique(key[likely[(key >> shift).astype(np.int64)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["h", "n"])

    found = over(rows.select("prefix").mapInArrow(one_by_one, "h long, n long")).toArrow()
    keys, counts = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], -(-counts[order] // list_rows)


def _multiply(key, comp, n, pos, mark, anchors) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of entries that one column after the other brings together, where the bounds allow a link.

    A pair whose first columns of one half of the hashes (``anchors``; ``mark`` tells the entries) are the same is met there, and only there.
    """
    order = np.lexsort((n, key))
    key = key[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ends = np.append(heads[1:], len(key))
    for a, z in zip(heads[ends - heads > 1], ends[ends - heads > 1], strict=True):
        rows = order[a:z]
        if (comp[rows] == comp[rows[0]]).all():
            continue
        m = n[rows]
        stop = np.searchsorted(m, 100 * m // LEAST, "right")  # sizes ascend: partners up to n / 0.8
        width = max(1, min(len(rows), (1 << 19) // len(rows)))
        for i in range(0, len(rows), width):
            x, y = rows[i : i + width], rows[i : stop[min(i + width, len(rows)) - 1]]
            least = -(-LEAST * (n[x][:, None] + n[y][None, :]) // (100 + LEAST))
            rest = np.minimum((n[x] - pos[x])[:, None], (n[y] - pos[y])[None, :])
            ok = rest >= least
            for k, anchor in enumerate(anchors, 1):
                ok = np.where(anchor[x][:, None] == anchor[y][None, :], (mark[x] == k)[:, None] & (mark[y] == k)[None, :], ok)
            ok &= (comp[x][:, None] != comp[y][None, :]) & (np.arange(len(x))[:, None] < np.arange(len(y))[None, :])
            ok &= 100 * n[x][:, None] >= LEAST * n[y][None, :]
            p, q = np.nonzero(ok)
            if len(p):
                yield x[p], y[q]


def product_pairs(rows: DataFrame, held: DataFrame, entries: int, block_entries: int = BLOCK_ENTRIES, list_rows: int = LIST_ROWS) -> DataFrame:
    """rows: (row, comp, n, prefix), comp the number of some row. (a, b) of rows in different components that the first columns don't rule out.

    held: a stored table with all prefixes; entries: how many columns they hold; columns in more than ``list_rows`` of them are split.
    Within a block columns are told apart by 32 bits more: a chance meeting only makes a pair to be checked.
    """
    blocks = max(16, -(-entries // block_entries))
    split_keys, split_into = split_columns(held, entries, list_rows)
    partitions = min(blocks, MOST_PARTITIONS)
    slot = slots(rows.sparkSession, partitions)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, comp, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "comp", "n"))
            parts = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("prefix")]
            size = np.array([len(x) for x in parts], np.int64)
            key = np.concatenate([*parts, np.zeros(0, np.uint64)])
            row = np.repeat(np.arange(len(doc)), size)
            pos = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
            anchors, mark = np.empty((2, len(doc)), np.uint64), np.zeros(len(key), np.uint16)
            for k in range(2):
                half = np.flatnonzero(key >> np.uint64(40) & np.uint64(1) == k)
                of, first = np.unique(row[half], return_index=True)
                anchors[k] = bs.mixed(doc.astype(np.uint64) * np.uint64(2) + np.uint64(k))  # nobody else's
                anchors[k][of] = key[half[first]]
                mark[half[first]] = k + 1
            if len(split_keys) and len(key):
                at = np.minimum(np.searchsorted(split_keys, key), len(split_keys) - 1)
                hit = np.flatnonzero(split_keys[at] == key)
                ways = split_into[at[hit]]
                again = np.repeat(hit, ways)
                other = np.arange(len(again)) - np.repeat(np.cumsum(ways) - ways, ways)
                mine = (bs.mixed(doc[row[again]].astype(np.uint64)) % np.repeat(ways, ways).astype(np.uint64)).astype(np.int64)
                lo, hi = np.minimum(mine, other), np.maximum(mine, other)
                dealt = bs.mixed(key[again] + bs.mixed((lo << 32 | hi).astype(np.uint64)))
                rest = np.setdiff1d(np.arange(len(key)), hit, assume_unique=True)
                key, row, pos, mark = (np.concatenate([x[rest], y]) for x, y in ((key, dealt), (row, row[again]), (pos, pos[again]), (mark, mark[again])))
            block = (key % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            heads = np.flatnonzero(np.diff(block[order], prepend=-1))
            which, packs = block[order[heads]], []
            for pick in np.split(order, heads[1:]) if len(heads) else []:
                used, local = np.unique(row[pick], return_inverse=True)
                moved = np.flatnonzero(comp[used] != doc[used])
                head = np.array([len(used), len(moved), len(pick)], np.int64)
                within = (bs.mixed(key[pick]) >> np.uint64(32)).astype(np.uint32)
                at_most = np.minimum(pos[pick], 16383).astype(np.uint16) | mark[pick] << np.uint16(14)
                packs.append(b"".join(x.tobytes() for x in (head, doc[used], comp[used[moved]], within, moved.astype(np.uint32), n[used].astype(np.uint32), local.astype(np.uint16), at_most, anchors[0][used], anchors[1][used])))
            yield pa.RecordBatch.from_arrays([pa.array(slot[which % partitions]), pa.array(which), pa.array(packs, pa.binary())], ["slot", "block", "pack"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(packs: list[bytes]) -> Iterator[pa.RecordBatch]:
            cols: tuple[list, ...] = ([], [], [], [], [], [], [], [])
            base = 0
            for raw in packs:
                docs, moves, many = np.frombuffer(raw, np.int64, 3)
                at, got = 24, []
                for kind, size in ((np.int64, docs), (np.int64, moves), (np.uint32, many), (np.uint32, moves), (np.uint32, docs), (np.uint16, many), (np.uint16, many), (np.uint64, docs), (np.uint64, docs)):
                    got.append(np.frombuffer(raw, kind, size, at))
                    at += size * np.dtype(kind).itemsize
                comp = got[0].copy()
                comp[got[3]] = got[1]
                for c, x in zip(cols, (got[0], comp, got[4].astype(np.int64), got[2], got[5].astype(np.int64) + base, got[6], got[7], got[8]), strict=True):
                    c.append(x)
                base += docs
            doc, comp, n, key, row, pos, *anchors = (np.concatenate(c) for c in cols)
            mark, pos = pos >> np.uint16(14), (pos & np.uint16(16383)).astype(np.int64)
            seen, pending = np.zeros(0, np.int64), [np.zeros(0, np.int64)]

            def out() -> pa.RecordBatch:
                a, b = doc[seen // len(doc)], doc[seen % len(doc)]
                return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

            for x, y in _multiply(key, comp[row], n[row], pos, mark, [a[row] for a in anchors]):
                a, b = row[x], row[y]
                pending.append(np.minimum(a, b) * len(doc) + np.maximum(a, b))
                if sum(map(len, pending)) > 1_000_000:
                    seen, pending = np.unique(np.concatenate([seen, *pending])), [np.zeros(0, np.int64)]
                    if len(seen) > 1_000_000:
                        yield out()
                        seen = np.zeros(0, np.int64)
            seen = np.unique(np.concatenate([seen, *pending]))
            if len(seen):
                yield out()

        now, packs = None, []
        for batch in batches:
            for k, raw in zip(batch.column("block").to_pylist(), batch.column("pack"), strict=True):
                if now is not None and k != now:
                    yield from result(packs)
                    packs = []
                now = k
                packs.append(raw.as_py())
        if packs:
            yield from result(packs)

    dealt = rows.select("row", "comp", "n", "prefix").mapInArrow(deal, "slot int, block long, pack binary")
    dealt = dealt.repartition(partitions, "slot").sortWithinPartitions("block")
    return dealt.mapInArrow(multiply, "a long, b long").distinct()


def same_id_edges(known: DataFrame, several: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): each doc_id in ``several``, with the documents that stand for its different sets."""
    held = known.select("doc_id", "n", "f1", "f2").join(several, "doc_id", "left_semi").distinct()
    return held.join(sets.select("n", "f1", "f2", F.col("doc_id").alias("b")), ["n", "f1", "f2"]).select(F.col("doc_id").alias("a"), "b")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    text_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows = stored(rows_of(docs, common_columns(docs)).withColumn("row", F.monotonically_increasing_id()), "shingle-rows")
    known = rows.filter("n > 0 and doc_id is not null")
    sets = known.groupBy("n", "f1", "f2").agg(F.min(F.struct("doc_id", "row", "h1", "h2", "keys", "sketch")).alias("low"))
    sets = stored(sets.select("n", "f1", "f2", "low.*"), "shingle-sets")
    sketches = sets.select("row", "n", "sketch")
    of = F.struct("n", "f1", "f2")
    again = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), (F.min(of) != F.max(of)).alias("differ")).filter("k > 1")
    again = stored(again.select("doc_id", "differ"), "repeated-ids")
    texts = one_text_each(docs, again.select("doc_id"))
    near = verified(plausible(star_pairs(sets), sketches), sets, texts)
    near = stored(near.unionAll(same_id_edges(known, again.filter("differ").select("doc_id"), sets)), "near-links")
    joined = components(near).withColumnRenamed("id", "doc_id")
    joined = stored(sets.select("row", "doc_id").join(joined, "doc_id"), "near-components")
    joined = joined.join(joined.groupBy("component").agg(F.min("row").alias("comp")), "component").select("row", "comp")
    copies = known.select("row").join(sets.select("row"), "row", "left_anti")
    # most rows are the only one of their set and in no component yet: they stay where they are
    moved = stored(copies.withColumn("comp", F.lit(None).cast("long")).union(joined), "moved-rows")
    some = marked(known.select("row", "n", "prefix"), "row", moved.select("row"))
    there = some.filter("_hit").join(moved, "row", "left_anti").select("row", F.col("row").alias("comp"), "n", "prefix")
    there = there.unionByName(some.filter("_hit").join(moved.filter("comp is not null"), "row").select("row", "comp", "n", "prefix"))
    entries = some.filter("not _hit").select("row", F.col("row").alias("comp"), "n", "prefix").unionByName(there)
    many = known.agg(F.coalesce(F.sum(F.length("prefix") / 8), F.lit(0))).collect()[0][0]
    far = verified(plausible(product_pairs(entries, known, int(many)), sketches), sets, texts)
    whole = components(near.unionAll(far))
    of = sets.select("n", "f1", "f2", "doc_id").join(whole.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    of = stored(of.select("n", "f1", "f2", F.coalesce("component", "doc_id").alias("component_id")), "set-classes")
    out = known.select("doc_id", "n", "f1", "f2").join(of, ["n", "f1", "f2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.filter("not (n > 0 and doc_id is not null)").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, with their columns, whose id is their class's smallest; a repeated row of that id stays once.

    Rows of a null doc_id all stay.
    """
    of = stored(classes(docs), "classes").filter("doc_id is not null")
    out = stored(of.filter("doc_id != component_id").select("doc_id").distinct(), "dropped")
    once = of.filter("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    return drop_ids(docs, "doc_id", out, once)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
