"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

Texts are lower-cased and cut between characters into segments of about ``SEGMENT`` bytes. A forward and a backward GRU run over
each segment and ``LEAD`` bytes of its text before and after it, so that states are settled where the segment begins; their joined
states give language probabilities for each byte. A document's probabilities are the mean over the bytes of its letters. Every
byte of every text is labelled.

Learning reads whole texts: of about ``DOCS_PER_LANGUAGE`` documents a language all segments are candidates, and those of smallest
hash, at most ``SEGMENTS_PER_LANGUAGE``, are learned from.

Defined results: ``und`` with score 0 for a null text, one without a letter, and for every text if there is nothing to learn
from; repeated rows are labelled alike; null ids are labelled and not held out. A very long text passes in runs of segments: a worker
needs about three bytes for each of its bytes. Extra columns are left alone.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytescan as bs
from .frames import bounded, held_out, learnable, share, stored, text_batches

#: Documents a language that the network learns from (about), and segments of theirs, at most.
DOCS_PER_LANGUAGE = 500
SEGMENTS_PER_LANGUAGE = 2048
SEGMENT = 128
LEAD = 32
#: Steps of one window: a cut between characters may move a segment's start by three bytes.
BODY = SEGMENT + 3
HIDDEN = 8
STEPS = 240
#: Segments that are run together.
LANES = 4096


@cache
def _is_letter() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def letters(b: np.ndarray) -> np.ndarray:
    """Whether each byte of whole UTF-8 characters belongs to a letter."""
    table = _is_letter()
    out = (b < 128) & table[b]
    head = np.flatnonzero(b >= 0xC0)
    if len(head):
        more = 1 + (b[head] >= 0xE0).astype(np.int64) + (b[head] >= 0xF0)
        code = (b[head] & (0x3F >> more)).astype(np.int64)
        for k in range(1, 4):
            code = np.where(more >= k, code << 6 | b[np.minimum(head + k, len(b) - 1)] & 0x3F, code)
        of = table[np.minimum(code, 0x10FFFF)]
        for k in range(4):
            out[np.minimum(head + k, len(b) - 1)[more >= k]] = of[more >= k]
    return out


@dataclass(frozen=True)
class LangModel:
    languages: list[str]
    p: dict[str, np.ndarray]


def _init(k: int, h: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p["x" + d] = rng.normal(0, 0.3, (3 * h, 256))
        p["u" + d] = rng.normal(0, 0.5 / np.sqrt(h), (3 * h, h))
        p["o" + d] = rng.normal(0, 0.5 / np.sqrt(h), (k, h))
    p["c"] = np.zeros((k, 1))
    return {n: v.astype(np.float32) for n, v in p.items()}


def _run(x: np.ndarray, wx: np.ndarray, u: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (L, h, N) of one direction over bytes x (L, N); gate rows: update, reset, candidate.

    h' = (1 - z) h + z tanh(Wn x + r * (Un h)), gates as tanh(a / 2) / 2 + 1 / 2.
    """
    steps, n = x.shape
    h = u.shape[1]
    state = np.zeros((h, n), np.float32)
    out = np.empty((steps, h, n), np.float32)
    tape = []
    for t in range(steps):
        gx = np.take(wx, x[t], axis=1)
        gu = u @ state
        gate = gx[: 2 * h]
        gate += gu[: 2 * h]
        gate *= 0.5
        np.tanh(gate, out=gate)
        gate += 1
        gate *= 0.5
        z, r = gate[:h], gate[h:]
        cand = gx[2 * h :]
        un = gu[2 * h :]
        cand += r * un
        np.tanh(cand, out=cand)
        if keep:
            tape.append((state, z, r, cand, un))
        new = out[t]
        np.subtract(cand, state, out=new)
        new *= z
        new += state
        state = new
    return out, tape


def _logits(p: dict, hf: np.ndarray, hb: np.ndarray) -> np.ndarray:
    """(L, k, N)"""
    return p["of"] @ hf + p["ob"] @ hb + p["c"]


def _softmax(a: np.ndarray) -> np.ndarray:
    a = np.exp(a - a.max(axis=1, keepdims=True))
    a /= a.sum(axis=1, keepdims=True)
    return a


def _states(p: dict, x: np.ndarray, lead: int, keep: bool) -> tuple:
    """Forward and backward states over x[lead : len(x) - lead], and their tapes."""
    hf, tf = _run(x[: len(x) - lead], p["xf"], p["uf"], keep)
    hb, tb = _run(x[lead:][::-1], p["xb"], p["ub"], keep)
    return hf[lead:], hb[lead:][::-1], tf, tb


def gradients(p: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, y: np.ndarray, lead: int = 0) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over the masked positions of windows x (lead + L + lead, N), mask (L, N), with labels y (N), and its gradients."""
    hf, hb, tf, tb = _states(p, x, lead, True)
    prob = _softmax(_logits(p, hf, hb))
    n = max(mask.sum(), 1)
    at = prob[:, y, np.arange(x.shape[1])]
    loss = -(np.log(at + 1e-9) * mask).sum() / n
    d = prob
    d[:, y, np.arange(x.shape[1])] -= 1
    d = d * (mask / n)[:, None, :].astype(np.float32)
    g = {"c": d.sum(axis=(0, 2))[:, None]}
    for k, states, tape, dd, xs in (("f", hf, tf, d, x[: len(x) - lead]), ("b", hb[::-1], tb, d[::-1], x[lead:][::-1])):
        g["o" + k] = np.einsum("tkn,thn->kh", dd, states)
        dout = p["o" + k].T @ dd
        u = p["u" + k]
        h = u.shape[1]
        gx, gu, carry = np.zeros_like(p["x" + k]), np.zeros_like(u), 0
        for t in range(len(xs) - 1, -1, -1):
            before, z, r, cand, un = tape[t]
            dh = dout[t - lead] + carry if t >= lead else carry
            da = dh * z * (1 - cand**2)
            dz = dh * (cand - before) * z * (1 - z)
            dr = da * un * r * (1 - r)
            back = np.concatenate([dz, dr, da * r])
            gu += back @ before.T
            carry = dh * (1 - z) + u.T @ back
            into = np.concatenate([dz, dr, da])
            for row in range(3 * h):
                gx[row] += np.bincount(xs[t], into[row], 256).astype(np.float32)
        g["x" + k], g["u" + k] = gx, gu
    return float(loss), g


def train(x: np.ndarray, mask: np.ndarray, y: np.ndarray, languages: list[str], steps: int = STEPS, hidden: int = HIDDEN, seed: int = 3, rate: float = 0.03, batch: int = 64) -> LangModel:
    """Learn from labelled windows; every language gets the same share of each step's windows."""
    rng = np.random.default_rng(seed)
    p = _init(len(languages), hidden, seed)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    by = [np.flatnonzero(y == k) for k in range(len(languages))]
    each = max(batch // len(by), 1)
    for t in range(1, steps + 1):
        pick = np.concatenate([rng.choice(i, each) for i in by if len(i)])
        _, g = gradients(p, x[:, pick], mask[:, pick], y[pick], LEAD)
        size = np.sqrt(sum(float((a**2).sum()) for a in g.values()))
        step = rate * min(1, 4 * (1 - t / (steps + 1)))
        for k in p:
            a = g[k] * min(1, 1 / (size + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.999 * v[k] + 0.001 * a * a
            p[k] -= (step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return LangModel(languages, p)


def segments(b: np.ndarray, offs: np.ndarray, length: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each segment; no cut is inside a UTF-8 character."""
    size = np.diff(offs)
    count = -(-size // length)
    owner = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = offs[:-1][owner] + nth * length
    for _ in range(3):
        start -= (b[start] & 0xC0 == 0x80) & (nth > 0)
    stop = np.append(start[1:], 0)[: len(start)]
    last = np.flatnonzero(np.diff(owner, append=-1))
    stop[last] = offs[1:][owner[last]]
    return start, stop, owner


def windows(b: np.ndarray, offs: np.ndarray, start: np.ndarray, stop: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (LEAD + BODY + LEAD, N) around consecutive segments, 0 outside their texts; and the letters (BODY, N) within the segments."""
    at = start - LEAD + np.arange(2 * LEAD + BODY)[:, None]
    live = (at >= offs[:-1][owner]) & (at < offs[1:][owner])
    x = np.where(live, b[np.clip(at, 0, len(b) - 1)], 0)
    at = at[LEAD : LEAD + BODY]
    of = letters(b[start[0] : stop[-1]])
    return x, of[np.clip(at - start[0], 0, len(of) - 1)] & (at < stop)


def probabilities(model: LangModel, b: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, languages): the mean of the byte probabilities over the bytes of letters; 0 without a letter."""
    n, k = len(offs) - 1, len(model.languages)
    total, many = np.zeros((n, k)), np.zeros(n)
    start, stop, owner = segments(b, offs)
    for i in range(0, len(start), LANES):
        own = owner[i : i + LANES]
        x, mask = windows(b, offs, start[i : i + LANES], stop[i : i + LANES], own)
        hf, hb, *_ = _states(model.p, x, LEAD, False)
        prob = _softmax(_logits(model.p, hf, hb))
        prob *= mask[:, None, :]
        for j, part in enumerate(prob.sum(axis=0)):
            total[:, j] += np.bincount(own, part, n)
        many += np.bincount(own, mask.sum(axis=0), n)
    return total / np.maximum(many, 1)[:, None]


def _drawn(most: int):
    """Of each partition and language, the ``most`` windows of smallest hash."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            b, offs = bs.buffer_of(pc.utf8_lower(batch.column("text")))
            langs, ids = np.array(batch.column("lang").to_pylist(), object), batch.column("key").to_numpy().view(np.uint64)
            start, stop, owner = segments(b, offs)
            nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
            h = bs.mixed(ids[owner] + bs.mixed(nth.astype(np.uint64))) >> np.uint64(1)
            for i in range(0, len(start), LANES):
                x, mask = windows(b, offs, start[i : i + LANES], stop[i : i + LANES], owner[i : i + LANES])
                of = langs[owner[i : i + LANES]]
                for lang in set(of.tolist()):
                    pick = np.flatnonzero((of == lang) & mask.any(axis=0))
                    new = (h[i : i + LANES][pick], x[:, pick].T, mask[:, pick].T)
                    both = [np.concatenate(c) for c in zip(kept[lang], new, strict=True)] if lang in kept else new
                    first = np.argsort(both[0], kind="stable")[:most]
                    kept[lang] = tuple(c[first] for c in both)
        for lang, (h, x, mask) in kept.items():
            cols = [pa.array([lang] * len(h), pa.string()), pa.array(h.astype(np.int64)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in mask], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "h", "x", "mask"])

    return draw


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, segments_per_language: int = SEGMENTS_PER_LANGUAGE, **training) -> LangModel:
    """Learn from windows drawn from whole texts of about ``docs_per_language`` documents of each language."""
    text_batches(docs.sparkSession)
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & learnable(F.col("doc_id")))
    part = known.groupBy("lang").agg((docs_per_language / F.count(F.lit(1))).alias("part"))
    rows = known.filter("text is not null").join(bounded(stored(part, "languages")), "lang").filter(share(F.col("doc_id"), 23) < F.col("part"))
    rows = rows.select("lang", "text", F.xxhash64("doc_id").alias("key"))
    drawn = rows.mapInArrow(_drawn(segments_per_language), "lang string, h long, x binary, mask binary")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "x"))
    got = drawn.withColumn("nth", nth).filter(F.col("nth") <= segments_per_language).select("lang", "h", "x", "mask").toArrow()
    got = got.sort_by([("lang", "ascending"), ("h", "ascending"), ("x", "ascending")])
    if not got.num_rows:
        return LangModel([], {})
    langs = got.column("lang").to_pylist()
    languages = sorted(set(langs))
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.uint8).reshape(len(langs), -1).T
    mask = np.frombuffer(b"".join(got.column("mask").to_pylist()), bool).reshape(len(langs), -1).T
    return train(x, mask, np.searchsorted(languages, langs), languages, **training)


def labelled(text: Column, model: LangModel) -> Column:
    """struct<lang, score> of each whole text."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def language(texts: pa.Array) -> pa.Array:
        n = len(texts)
        if not model.languages or not n:
            return pa.StructArray.from_arrays([pa.array(["und"] * n, pa.string()), pa.array(np.zeros(n))], names=["lang", "score"])
        b, offs = bs.buffer_of(pc.utf8_lower(texts))
        prob = probabilities(model, b, offs)
        best = prob.argmax(axis=1)
        names = pa.array(model.languages, pa.string()).take(pa.array(best))
        return pa.StructArray.from_arrays([names, pa.array(np.clip(prob[np.arange(n), best], 0, 1))], names=["lang", "score"])

    return language(text)


def identify(docs: DataFrame, **fitting) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    text_batches(docs.sparkSession)
    model = fit(docs, **fitting)
    out = docs.select("doc_id", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), labelled(F.col("text"), model).alias("l"))
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.when(F.col("letters"), F.col("l.lang")).otherwise("und").alias("lang_pred"),
        F.when(F.col("letters"), F.col("l.score")).otherwise(0.0).alias("score"),
    )


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
