"""Best-fit packing of token sequences with large-item matching.

Documents are tokenised and cut into pieces of at most ``CAPACITY`` tokens. How many pieces there are of each length is
all that packing depends on, so it is planned on that histogram (at most CAPACITY rows, whatever the input):

* pieces above a third of the capacity share a sequence two at a time at most; from the longest down, each takes the
  longest partner that fits (a maximum matching for this kind of fit);
* the smaller lengths, from the longest down, each go to the tightest gap that holds them, else open new sequences.

Both steps act on whole classes of equal sequences at once. The plan is a list of runs: the pieces of one length whose
rank is in a range go to consecutive sequences at a given offset. Every stored piece has a number of its own (``at``); ranks
come from counts of its hashed salts within each length, so no length and no group of equal rows, however common, meets in one
task; full pieces need no rank.

Defined results: null or empty text is one piece of one token (the closing id); rows are pieces of their own, also when
doc_ids repeat or are null; no documents: no rows. A text that holds a special token's text gets that token's id there, as the
tokenizer does by itself. Very long texts are encoded in parts cut at blanks, with the ids of the whole. Extra columns are left alone.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytescan as bs
from .frames import stored, text_batches

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
#: Units whose ids a Python worker remembers, about 50 bytes each.
CACHE_UNITS = 400_000
#: Pieces of one length and salt (about): the size of a ranking group.
SALT_ROWS = 5_000
#: Bytes of a text that are encoded at a time, up to the next blank.
PART_BYTES = 2 << 20

_LETTER, _DIGIT, _BLANK = (np.zeros(256, bool) for _ in range(3))
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT[48:58] = True
_BLANK[[9, 10, 11, 12, 13, 32]] = True


class UnitTokens:
    """Ids of whole texts by way of the ids of their units, remembered in arrays under 64-bit hashes.

    The tokenizer lower-cases, drops white space and merges only within runs of letters, runs of other marks and single digits.
    These runs are the units; a white-space-bounded word that holds an apostrophe is one unit, as its contractions are cut
    otherwise. Only texts of ASCII and the letters from U+00C0 to U+00FF without a special token's text take this way; all others
    are encoded as they are. No unit, no special token and no normal form reaches over a blank, so texts of more than ``PART_BYTES``
    are cut before blanks and a worker's memory follows the ids, not the encoding's own structures; only a longer word stays whole.
    """

    def __init__(self, path: str, most: int = CACHE_UNITS):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab()
        marks = [re.escape(t.content.encode()) for t in self.model.get_added_tokens_decoder().values()]
        self.marks = re.compile(b"|".join(marks)) if marks else None
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for w, k in vocabulary.items() if w.endswith("</w>")]] = True
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.bits = 17
        self.slots = np.zeros(1 << self.bits, np.int64)  # entry number + 1, by the hash's first bits and linear probing
        self.hashes = np.zeros(0, np.uint64)
        self.begin = self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry number of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.hashes):
            return out
        ask = np.arange(len(h))
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(ask):
            entry = self.slots[slot] - 1
            hit = (entry >= 0) & (self.hashes[entry] == h[ask])
            out[ask[hit]] = entry[hit]
            on = (entry >= 0) & ~hit
            ask, slot = ask[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def _file(self, first: int) -> None:
        """Give the entries from ``first`` on their slots; the table doubles before it is 40 % full."""
        if len(self.hashes) > 0.4 * (1 << self.bits):
            while len(self.hashes) > 0.4 * (1 << self.bits):
                self.bits += 1
            self.slots = np.zeros(1 << self.bits, np.int64)
            first = 0
        todo = np.arange(first, len(self.hashes))
        slot = (self.hashes[todo] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.slots[slot] == 0)
            self.slots[slot[free]] = todo[free] + 1
            on = self.slots[slot] != todo + 1
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)

    def _encode(self, units: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(units, add_special_tokens=False)]

    def _encode_joined(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end, and how many each unit has: units end in one word-ending token each, so one encoding of all can be cut."""
        ids = self._encode([" ".join(units)])[0] if units else np.zeros(0, np.uint32)
        count = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(count) == len(units):
            return ids, count
        each = self._encode(units)
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def _units(self, b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
        """Starts and ends of all units, and which are words with an apostrophe."""
        kind = np.full(len(b), 2, np.int8)
        kind[_LETTER[b]] = 1
        kind[_DIGIT[b]] = 3
        kind[_BLANK[b]] = 0
        high = np.flatnonzero(b == 0xC3)
        mark = (b[high + 1] == 0x97) | (b[high + 1] == 0xB7)  # the signs of multiplication and division are no letters
        kind[high] = kind[high + 1] = np.where(mark, 2, 1)
        start = np.ones(len(b), bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
        start[offs[:-1][offs[:-1] < len(b)]] = True
        s = np.flatnonzero(start)
        e = np.append(s[1:], len(b))
        live = kind[s] != 0
        s, e = s[live], e[live]
        quotes = np.flatnonzero(b == 39)
        odd = np.zeros(len(s), bool)
        if len(quotes):
            ws, we = bs.word_spans(b, offs, ~_BLANK)
            held = np.unique(np.searchsorted(ws, quotes, "right") - 1)
            word = np.searchsorted(ws, s, "right") - 1
            inside = np.isin(word, held)
            odd = inside & (s == ws[word])
            e = np.where(odd, we[word], e)
            live = ~inside | odd
            s, e, odd = s[live], e[live], odd[live]
        return s, e, odd

    def _learn(self, h: np.ndarray, b: np.ndarray, s: np.ndarray, e: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """Entry numbers of new units."""
        order = np.argsort(odd, kind="stable")  # words with an apostrophe last
        h, s, e = h[order], s[order], e[order]
        text = [b[i:j].tobytes().decode() for i, j in zip(s.tolist(), e.tolist())]
        plain = len(text) - int(odd.sum())
        ids, count = self._encode_joined(text[:plain])
        rest = self._encode(text[plain:]) if plain < len(text) else []
        count = np.concatenate([count, np.array([len(x) for x in rest], np.int64)])
        first = len(self.hashes)
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.hashes = np.concatenate([self.hashes, h])
        self.flat = np.concatenate([self.flat, ids, *rest])
        self._file(first)
        out = np.empty(len(order), np.int64)
        out[order] = np.arange(first, len(self.hashes))
        return out

    def _plain(self, b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts end to end, and their bounds."""
        s, e, odd = self._units(b, offs)
        h = bs.span_hashes(b, s, e, bs.FOLDED)
        if len(self.hashes) > self.most:
            self._forget()
        at = self._find(h)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, first, which = np.unique(h[missing], return_index=True, return_inverse=True)
            first = missing[first]
            at[missing] = self._learn(new, b, s[first], e[first], odd[first])[which]
        begin, count = self.begin[at], self.count[at]
        ends = np.cumsum(count)
        ids = self.flat[np.repeat(begin - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[np.searchsorted(s, offs)]

    def _ids(self, b: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """Ids of each part [offs[k], offs[k + 1])."""
        other = (b >= 0x80) | (b < 32) & ~_BLANK[b] | (b == 127)
        high = np.flatnonzero(b[:-1] == 0xC3) if len(b) else np.zeros(0, np.int64)
        other[high] = other[high + 1] = False
        if self.marks is not None:
            other[[m.start() for m in self.marks.finditer(b)]] = True
        hard = np.diff(np.searchsorted(np.flatnonzero(other), offs)) > 0
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(hard)
        easy = np.flatnonzero(~hard)
        if hard.any():
            at = np.flatnonzero(hard).tolist()
            for k, x in zip(at, self._encode([b[offs[k] : offs[k + 1]].tobytes().decode() for k in at]), strict=True):
                out[k] = x
            b = np.concatenate([b[offs[k] : offs[k + 1]] for k in easy] + [b[:0]])
            offs = np.concatenate([[0], np.cumsum(np.diff(offs)[easy])])
        for i, j in bs.blocks(offs):
            ids, bounds = self._plain(b[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            for k in range(j - i):
                out[easy[i + k]] = ids[bounds[k] : bounds[k + 1]]
        return out

    def ids(self, texts: pa.Array, part_bytes: int = PART_BYTES) -> list[np.ndarray]:
        """Ids of each text (null: none), as unsigned 32-bit numbers."""
        b, offs = bs.buffer_of(texts)
        cuts = bs.cut_before(b, offs, _BLANK, part_bytes)
        if cuts is offs:
            return self._ids(b, offs)
        parts: list[np.ndarray] = []
        for k in range(len(cuts) - 1):
            parts += self._ids(b[cuts[k] : cuts[k + 1]], np.array([0, cuts[k + 1] - cuts[k]]))
        at = np.searchsorted(cuts, offs)
        return [np.concatenate([*parts[i:j], np.zeros(0, np.uint32)]) for i, j in zip(at[:-1], at[1:], strict=True)]


_loaded: dict[str, UnitTokens] = {}


_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, and its columns ``keep``."""
    text_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _loaded:
            _loaded[tokenizer_path] = UnitTokens(tokenizer_path)
        tokens = _loaded[tokenizer_path]
        end = np.array([END_ID], np.uint32)
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            of = []
            for n, (doc_id, ids) in enumerate(zip(batch.column("doc_id").to_pylist(), tokens.ids(batch.column("text")), strict=True)):
                ids = np.concatenate([ids, end])
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    of.append(n)
                    for c, x in zip(cols, (doc_id, k, at, len(part), zlib.crc32(part.astype("<u4").tobytes())), strict=True):
                        c.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            kept = [batch.column(c).take(pa.array(of, pa.int64())) for c in keep]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), *kept], [*_PIECE, *keep])

    kinds = "".join(f", `{c}` {kind}" for c, kind in docs.select(*keep).dtypes)
    return docs.select("doc_id", "text", *keep).mapInArrow(cut, f"doc_id long, piece int, start long, length long, ids_crc32 long{kinds}")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, pieces, first sequence, pieces a sequence, offset), and the number of sequences.

    counts: pieces of each length below the capacity. Piece r of a run goes to sequence first + r // each, at
    offset + (r % each) * length.
    """
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    # classes of equal sequences: gap -> list of [first sequence, how many]; filled from the front
    gaps: dict[int, list[list[int]]] = {}
    order: list[int] = []  # gaps with sequences, ascending
    runs: list[tuple[int, int, int, int, int, int]] = []
    n_seq = 0

    def put(gap: int, first: int, many: int) -> None:
        if many and gap:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append([first, many])

    def add(length: int, first: int, many: int, each: int, offset: int) -> None:
        runs.append((length, used[length], many * each, first, each, offset))
        used[length] += many * each
        left[length] -= many * each

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    ascending = large[::-1]
    for a in large:
        while left[a]:
            k = bisect_left(ascending, capacity - a + 1) - 1
            while k >= 0 and not left[ascending[k]]:
                ascending.pop(k)
                k -= 1
            b = ascending[k] if k >= 0 else None
            if b is None or (b == a and left[a] == 1):
                b, many = None, left[a]
                if k >= 0 and ascending[k] == a:  # alone of its length: the next shorter one may do
                    j = k - 1
                    while j >= 0 and not left[ascending[j]]:
                        ascending.pop(j)
                        j -= 1
                    b = ascending[j] if j >= 0 else None
                    many = 1
            elif b == a:
                many = left[a] // 2
            else:
                many = min(left[a], left[b])
            if b == a:
                add(a, n_seq, many, 2, 0)
                put(capacity - 2 * a, n_seq, many)
            else:
                add(a, n_seq, many, 1, 0)
                if b is not None:
                    add(b, n_seq, many, 1, a)
                put(capacity - a - (b or 0), n_seq, many)
            n_seq += many
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            k = bisect_left(order, s)
            if k == len(order):
                each = capacity // s
                many = left[s] // each
                if many:
                    add(s, n_seq, many, each, 0)
                    put(capacity - each * s, n_seq, many)
                    n_seq += many
                if left[s]:
                    each = left[s]
                    add(s, n_seq, 1, each, 0)
                    put(capacity - each * s, n_seq, 1)
                    n_seq += 1
                continue
            gap = order[k]
            first, many = gaps[gap].pop()
            each = gap // s
            full = min(many, left[s] // each)
            if full:
                add(s, first, full, each, capacity - gap)
                put(gap - each * s, first, full)
            elif left[s]:
                each, full = left[s], 1
                add(s, first, 1, each, capacity - gap)
                put(gap - each * s, first, 1)
            if many > full:
                gaps[gap].append([first + full, many - full])
            if not gaps[gap]:
                del gaps[gap]
                order.remove(gap)
    return np.array(runs, np.int64).reshape(-1, 6), n_seq


def packed(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece, and its document's columns ``keep`` (none of these names)."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(TOKENIZER)
    cut = pieces(docs, tokenizer_path, capacity, keep).withColumn("at", F.monotonically_increasing_id())
    return assigned(stored(cut, "pieces"), capacity, keep)


def assigned(cut: DataFrame, capacity: int = CAPACITY, keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces, whose rows are told apart by ``at`` (from 0)."""
    n = cut.count()
    salts = max(1, -(-n // SALT_ROWS))
    salt = F.pmod(F.xxhash64("at"), F.lit(salts)).cast("int")
    short = cut.filter(F.col("length") < capacity).withColumn("salt", salt)
    by_salt = short.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    runs, n_seq = plan(counts, capacity)
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    runs = runs[order]
    key = runs[:, 0] << 44 | runs[:, 1]
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    starts = by_salt.select("length", "salt", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("at")) - 1
    ranked = short.withColumn("within", within).join(starts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within"))

    def seat(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        run = runs[np.searchsorted(key, n << 44 | r, "right") - 1]
        r = r - run[:, 1]
        seq, off = run[:, 3] + r // run[:, 4], run[:, 5] + r % run[:, 4] * n
        return pa.StructArray.from_arrays([pa.array(seq), pa.array(off)], names=["sequence_id", "offset"])

    names = [*_PIECE, *keep]
    seated = ranked.select(*names, F.arrow_udf(seat, "struct<sequence_id:bigint,offset:bigint>")("length", "rank").alias("_s"))
    seated = seated.select(*names, "_s.sequence_id", "_s.offset")
    # full pieces: a sequence each, numbered below zero
    full = cut.filter(F.col("length") == capacity).select(*names, (-1 - F.col("at")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return seated.unionByName(full)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
