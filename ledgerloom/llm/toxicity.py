"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learned from document labels.

A sentence's score is logistic in its hashed words and word beginnings; a document is toxic with probability 1 - prod(1 - p) over
its sentences. Only documents carry labels; the gradient of the noisy-or likelihood hands each document's label to the
sentences that explain it, so the trained sentence scores locate the offending sentences.

Defined results: a null or empty text has no sentence and scores 0; repeated rows score alike; null ids are
scored and not held out; without labelled rows of both classes every text scores 0. A very long text passes in windows between words: a
worker needs about 40 bytes for each of its sentences. Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan as bs
from .frames import held_out, labelled_sample, learnable, sampled_docs, share, stored, text_batches

#: Labelled documents of each class that the model learns from, at most (about).
PER_CLASS = 3000
BUCKETS = 1 << 18
#: A word gets a weight if it is in so many documents and so many standard errors apart between the classes.
MIN_DOCS = 3
MIN_Z = 4.0
#: Lengths in bytes of the word beginnings that count as features beside whole words.
STEMS = (4, 5, 6, 7, 8)
#: Numbers that the learner on the driver holds for all sentences of its documents, at most (about); with more, fewer documents are drawn.
MOST_NUMBERS = 20_000_000
#: Bytes of one text that are looked at together.
WINDOW_BYTES = 2 << 20
EPOCHS = 120
THRESHOLD = 0.3

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n\r"]] = True


def sentence_words(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start and end byte and sentence number of each word, and text number, start and end byte of each sentence.

    A sentence is a maximal run of bytes without ``. ! ? \\n \\r`` that holds a word.
    """
    s, e = bs.word_spans(b, offs, bs.ALNUM)
    owner = bs.owners(offs, s)
    passed = np.searchsorted(np.flatnonzero(_ENDS[b]), s)
    new = np.ones(len(s), bool)
    new[1:] = (passed[1:] != passed[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(s)) - 1 if len(s) else heads
    return s, e, np.cumsum(new) - 1, owner[heads], s[heads], e[tails]


def features(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """(1 + len(STEMS), words): the bucket of each word and of its first 4, 5, ... bytes (BUCKETS if it is no longer than that)."""
    out = np.full((1 + len(STEMS), len(s)), BUCKETS, np.int32)
    of = np.uint64(BUCKETS)
    out[0] = bs.span_hashes(b, s, e, bs.FOLDED) % of
    for k, n in enumerate(STEMS, 1):
        long = np.flatnonzero(e - s > n)
        out[k, long] = bs.span_hashes(b, s[long], s[long] + n, bs.FOLDED) * np.uint64(2 * n + 1) % of
    return out


def windows(b: np.ndarray, offs: np.ndarray, most: int = 0) -> Iterator[tuple]:
    """Words, their sentences and the sentences' texts, starts and ends as ``sentence_words`` gives them, window by window.

    A window holds several texts, or a part of a long one; a sentence that goes on in the next window is numbered on there:
    (bytes, words' starts, ends and sentences, number of the window's first sentence, texts, starts, ends).
    """
    many, last = 0, (-1, -1)
    for i, j in bs.blocks(offs, most or WINDOW_BYTES):
        cuts = bs.cut_before(b[offs[i] : offs[j]], offs[i : j + 1] - offs[i], ~bs.ALNUM, most or WINDOW_BYTES) + offs[i]
        spans = [(offs[i], offs[j])] if len(cuts) == j - i + 1 else list(zip(cuts[:-1], cuts[1:], strict=True))
        passed = 0
        for a, z in spans:
            inner = offs[i : j + 1] - a if len(spans) == 1 else np.array([0, z - a])
            s, e, sentence, owner, start, end = sentence_words(b[a:z], inner)
            if len(start):
                here = (i + int(owner[0]), passed + int(_ENDS[b[a : a + start[0]]].sum()))
                many -= here == last
                yield b[a:z], s, e, sentence, many, owner + i, start + a, end + a
                many += len(start)
                last = (i + int(owner[-1]), passed + int(_ENDS[b[a : a + start[-1]]].sum()))
            passed += int(_ENDS[b[a:z]].sum())


@dataclass(frozen=True)
class ToxicityModel:
    weight: np.ndarray  # of each bucket, float32
    bias: float

    def sentences(self, b: np.ndarray, offs: np.ndarray, most: int = 0) -> tuple[np.ndarray, ...]:
        """log(1 - p) of each sentence, with its text number, start and end."""
        number, logit, owner, start, end = ([np.zeros(0, np.int64)] for _ in range(5))
        for part, s, e, sentence, first, of, a, z in windows(b, offs, most):
            at = np.append(np.flatnonzero(np.diff(sentence, prepend=-1)), len(s))
            logit.append(bs.run_sums(self.weight[features(part, s, e)].sum(axis=0), at))
            for c, x in ((number, first + np.arange(len(a))), (owner, of), (start, a), (end, z)):
                c.append(x)
        number, logit, owner, start, end = (np.concatenate(c) for c in (number, logit, owner, start, end))
        head = np.flatnonzero(np.diff(number, prepend=-1))
        if len(head) < len(number):  # sentences that went on in a next window
            tail = np.append(head[1:], len(number)) - 1
            logit, owner, start, end = np.add.reduceat(logit, head), owner[head], start[head], end[tail]
        return -np.logaddexp(0, logit + self.bias), owner, start, end

    def probability(self, b: np.ndarray, offs: np.ndarray) -> np.ndarray:
        clean, owner, _, _ = self.sentences(b, offs)
        return -np.expm1(bs.run_sums(clean, bs.slices(owner, len(offs) - 1)))


def train(ids: np.ndarray, sentence: np.ndarray, s_doc: np.ndarray, y: np.ndarray, prior: float = 0.5, epochs: int = EPOCHS, rate: float = 0.3, l2: float = 0.05, start: float = -8.0) -> ToxicityModel:
    """ids, sentence: the features met, with the number of their sentence; s_doc: each sentence's document; y: its label;
    prior: the weight of the toxic class, its share among all labels.
    """
    used, f = np.unique(ids, return_inverse=True)
    n, n_f, n_s = len(y), len(used), len(s_doc)
    w = np.append(np.zeros(n_f), start)
    m, v = np.zeros(n_f + 1), np.zeros(n_f + 1)
    cost = np.where(y > 0, prior / y.sum(), (1 - prior) / (n - y.sum()))[s_doc]
    for t in range(1, epochs + 1):
        logit = np.bincount(sentence, w[f], n_s) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        q = np.exp(np.minimum(np.bincount(s_doc, -np.logaddexp(0, logit), n), -1e-9))
        g = np.where(y[s_doc] > 0, -(q / (1 - q))[s_doc] * p, p) * cost
        grad = np.append(np.bincount(f, g[sentence], n_f), g.sum())
        grad[:-1] += l2 / n * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = rate * min(1, 3 * (1 - t / (epochs + 1)))
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
    weight = np.zeros(BUCKETS + 1, np.float32)
    weight[used] = w[:-1]
    weight[BUCKETS] = 0
    return ToxicityModel(weight, float(w[-1]))


def _presence(batches):
    """Of each feature, the documents of a partition that hold it and the toxic ones among them."""
    total = np.zeros((2, BUCKETS + 1), np.int64)
    for batch in batches:
        b, offs = bs.buffer_of(batch.column("text"))
        y = batch.column("y").to_numpy(zero_copy_only=False)
        for i, j in bs.blocks(offs):
            seen = [np.zeros(0, np.int64)]
            for part, s, e, sentence, _, owner, _, _ in windows(b[offs[i] : offs[j]], offs[i : j + 1] - offs[i]):
                doc = owner[sentence] + i
                seen.append(np.unique((features(part, s, e).astype(np.int64) << 32 | doc).ravel()))
            seen = np.unique(np.concatenate(seen))
            total[0] += np.bincount(seen >> 32, minlength=BUCKETS + 1)
            total[1] += np.bincount((seen >> 32)[y[seen & 0xFFFFFFFF] > 0], minlength=BUCKETS + 1)
    at = np.flatnonzero(total[0][:BUCKETS])
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["feature", "docs", "toxic"])


def bag(b: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """What is learned from one text, as 32-bit numbers: how many sentences it has, then the chosen features met, then the sentence of each."""
    many, of, which = 0, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for part, s, e, sentence, first, owner, _, _ in windows(b, np.array([0, len(b)])):
        f = features(part, s, e)
        k, word = np.nonzero(chosen[f])
        of.append(f[k, word])
        which.append(sentence[word] + first)
        many = first + len(owner)
    of, which = np.concatenate(of), np.concatenate(which)
    order = np.argsort(which, kind="stable")
    return np.concatenate([[many], of[order], which[order]]).astype(np.int32)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, **training) -> ToxicityModel:
    """Learn from about ``per_class`` labelled documents of each class, held-out ids excluded.

    Only features whose share of documents differs between the classes by MIN_Z standard errors get a weight.
    """
    text_batches(docs.sparkSession)
    sample = labelled_sample(labels.select("doc_id", "toxic"), "toxic", per_class)
    prior = labels.filter(F.col("toxic").isin(0, 1) & learnable(F.col("doc_id"))).agg(F.avg("toxic")).collect()[0][0]
    rows = stored(sampled_docs(docs.select("doc_id", "text"), sample).select("y", "text"), "toxicity-sample")
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return ToxicityModel(np.zeros(BUCKETS + 1, np.float32), -1e6)
    found = rows.mapInArrow(_presence, "feature long, docs long, toxic long").groupBy("feature").agg(F.sum("docs").alias("d"), F.sum("toxic").alias("t"))
    held_by = F.col("d") / (n[0] + n[1])
    spread = F.sqrt(held_by * (1 - held_by) * (1 / n[0] + 1 / n[1]))
    apart = F.abs(F.col("t") / n[1] - (F.col("d") - F.col("t")) / n[0])
    kept = found.filter((F.col("d") >= MIN_DOCS) & (apart >= MIN_Z * spread)).select("feature").collect()  # BUCKETS rows at most
    chosen = np.zeros(BUCKETS + 1, bool)
    chosen[[r["feature"] for r in kept]] = True

    def bags(texts: pa.Array) -> pa.Array:
        b, offs = bs.buffer_of(texts)
        return pa.array([bag(b[i:j], chosen).tobytes() for i, j in zip(offs[:-1], offs[1:], strict=True)], pa.binary())

    held = stored(rows.select("y", F.arrow_udf(bags, "binary")("text").alias("bag")).withColumn("at", F.monotonically_increasing_id()), "toxicity-bags")
    drawn = F.struct(share(F.col("bag"), 13).alias("share"), "at")
    sizes = held.groupBy("y").agg(F.sum(F.length("bag") / 4).alias("size"), F.min(drawn).alias("first")).collect()  # a row for each class
    if sum(r["size"] for r in sizes) > MOST_NUMBERS:  # half for each class, and its first document in any case
        picks = [(F.col("y") == r["y"]) & ((share(F.col("bag"), 13) < MOST_NUMBERS / 2 / r["size"]) | (F.col("at") == r["first"]["at"])) for r in sizes]
        held = held.filter(picks[0] | picks[1])
    got = held.select("y", "bag").toArrow()
    got = sorted(zip(got.column("y").to_pylist(), (x.as_py() for x in got.column("bag")), strict=True))
    ids, sentences, sizes, base = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [], 0
    for _, raw in got:
        x = np.frombuffer(raw, np.int32)
        half = 1 + (len(x) - 1) // 2
        ids.append(x[1:half])
        sentences.append(x[half:].astype(np.int64) + base)
        sizes.append(int(x[0]))
        base += int(x[0])
    y = np.array([y for y, _ in got], float)
    return train(np.concatenate(ids), np.concatenate(sentences), np.repeat(np.arange(len(y)), sizes), y, prior, **training)


_SPANS = "array<struct<start:bigint,end:bigint,p:double>>"


def examined(text: Column, model: ToxicityModel, threshold: float = THRESHOLD) -> Column:
    """struct<score, sentences>: the probability that a whole text is toxic, and its offending sentences, as ``located`` gives them."""

    @F.arrow_udf(f"struct<score:double,sentences:{_SPANS}>")
    def toxicity(texts: pa.Array) -> pa.Array:
        b, offs = bs.buffer_of(texts)
        clean, owner, start, end = model.sentences(b, offs)
        score = np.clip(-np.expm1(bs.run_sums(clean, bs.slices(owner, len(offs) - 1))), 0, 1) + 0.0  # no -0.0
        p = -np.expm1(clean)
        bad = np.flatnonzero(p >= threshold)
        base = offs[owner[bad]]
        spans = pa.StructArray.from_arrays([pa.array(start[bad] - base), pa.array(end[bad] - base), pa.array(p[bad])], names=["start", "end", "p"])
        spans = pa.ListArray.from_arrays(bs.slices(owner[bad], len(offs) - 1).astype(np.int32), spans)
        return pa.StructArray.from_arrays([pa.array(score), spans], names=["score", "sentences"])

    return toxicity(text)


def scored(text: Column, model: ToxicityModel) -> Column:
    """Probability that a whole text is toxic."""

    @F.arrow_udf("double")
    def toxicity_score(texts: pa.Array) -> pa.Array:
        return pa.array(np.clip(model.probability(*bs.buffer_of(texts)), 0, 1) + 0.0)

    return toxicity_score(text)


def located(text: Column, model: ToxicityModel, threshold: float = THRESHOLD) -> Column:
    """The offending sentences of a text: start and end byte in its UTF-8 form, and probability."""
    return examined(text, model, threshold)["sentences"]


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **fitting) -> DataFrame:
    """(doc_id, held_out, score, predicted, sentences) of every document: its offending sentences, with start and end byte and probability."""
    model = fit(docs, labels, **fitting)
    out = docs.select("doc_id", examined(F.col("text"), model, threshold).alias("x")).select("doc_id", "x.score", "x.sentences")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "sentences")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **fitting) -> DataFrame:
    """The documents below the threshold, with their columns."""
    model = fit(docs, labels, **fitting)
    return docs.filter(scored(F.col("text"), model) < threshold)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
