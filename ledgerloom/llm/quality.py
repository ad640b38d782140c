"""Quality classifier: random Fourier features over document statistics, ridge by summed normal equations, isotonic calibration.

The features are D cosines that approximate a Gaussian kernel over the standardised statistics of a text.
Each partition of the training rows sums its part of Z'Z and Z'y; the sums (fixed in size, one set for each of at
most ``FIT_PARTITIONS`` partitions) are added and solved once. Learnable rows of fold 3 don't enter the fit: a
monotone function from ridge score to probability, linear between pooled runs, is fitted on them by pooling adjacent violators, each
row weighted by the labels it stands for, so that the threshold means the same share of label 1 whatever was drawn.

Defined results: a null or empty text has all-zero statistics and is scored like any other; repeated rows get
equal scores; null ids are scored and not held out; labels other than 0 or 1 are ignored; without labelled
rows of both classes every score is the share of label 1 (0.5 without any). A very long text is counted in windows; a worker needs
about 40 bytes for each of its distinct words and word pairs. Extra columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan as bs
from .frames import fold, held_out, labelled_sample, sampled_docs, text_batches

#: Labelled documents of each class that the model learns from, at most (about).
PER_CLASS = 6000
FEATURES = 256
RIDGE = 1e-2
FIT_PARTITIONS = 16
THRESHOLD = 0.7
N_STATS = 24
#: Standard deviations from the mean within which the kernel tells statistics apart; those further out count as that far.
REACH = 8
#: Bytes of one text that are counted at a time.
WINDOW_BYTES = 2 << 20

_UPPER, _DIGIT, _PUNCT, _OTHER = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_PUNCT[[ord(c) for c in ".,;:!?'\"()-"]] = True
_OTHER[33:127] = True
_OTHER &= ~(bs.ALNUM | _PUNCT)
_LINE = np.ones(256, bool)
_LINE[10] = _LINE[13] = False


_CLASSES = (_UPPER, _DIGIT, _PUNCT, _OTHER, bs.SPACE, np.arange(256) >= 128, *(np.arange(256) == ord(c) for c in "!|."))
#: Places among the counts of ``_word_counts``.
_WORDS, _LENGTH, _SQUARES, _LONG, _SHORT, _AGAIN, _ALNUM, _ODD_END, _CAPITAL, _COUNTS = range(9, 19)


def _word_counts(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of each text that may be added up over its parts; all words' hashes, and their texts."""
    n = len(offs) - 1
    out = np.zeros((n, _COUNTS))
    for k, of in enumerate(_CLASSES):
        out[:, k] = np.diff(np.searchsorted(np.flatnonzero(of[b]), offs))
    s, e = bs.word_spans(b, offs, ~bs.SPACE)
    owner = bs.owners(offs, s)
    at = bs.slices(owner, n)
    length = (e - s).astype(float)
    h = bs.span_hashes(b, s, e, bs.FOLDED)
    out[:, _WORDS] = np.diff(at)
    for k, x in ((_LENGTH, length), (_SQUARES, length**2), (_LONG, length > 20), (_SHORT, length <= 3)):
        out[:, k] = bs.run_sums(x, at)
    if len(s):
        first, last = b[s], b[e - 1]
        out[:, _AGAIN] = np.bincount(owner[1:][(h[1:] == h[:-1]) & (owner[1:] == owner[:-1])], minlength=n)
        for k, of in ((_ALNUM, bs.ALNUM[first]), (_ODD_END, _OTHER[last]), (_CAPITAL, _UPPER[first] & _UPPER[last])):
            out[:, k] = np.bincount(owner[of], minlength=n)
    return out, h, owner


def _pairs(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of neighbouring words, and their texts."""
    same = owner[1:] == owner[:-1]
    return bs.mixed(h[:-1] + h[1:] * np.uint64(3))[same], owner[1:][same]


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many different values each text has."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n).astype(float)


def _lines(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lines that are not empty, and their texts."""
    s, e = bs.word_spans(b, offs, _LINE)
    return bs.span_hashes(b, s, e), bs.owners(offs, s)


def _shares(size, counts, words, pairs, lines, different_lines) -> np.ndarray:
    """N_STATS numbers of each text from its counts, its different words and word pairs, its lines and different lines."""
    out = np.zeros((len(size), N_STATS))
    per_byte, per_word = np.maximum(size, 1)[:, None], np.maximum(counts[:, _WORDS], 1)
    out[:, :6] = counts[:, :6] / per_byte
    out[:, 6] = np.log1p(size)
    out[:, 7:10] = counts[:, 6:9] / per_byte
    out[:, 10] = np.log1p(counts[:, _WORDS])
    out[:, 11] = counts[:, _LENGTH] / per_word
    out[:, 12] = np.sqrt(np.maximum(counts[:, _SQUARES] / per_word - out[:, 11] ** 2, 0))
    for k, of in ((13, _LONG), (14, _SHORT), (15, _AGAIN), (18, _ALNUM), (19, _ODD_END), (20, _CAPITAL)):
        out[:, k] = counts[:, of] / per_word
    out[:, 16] = words / per_word
    out[:, 17] = pairs / np.maximum(counts[:, _WORDS] - 1, 1)
    out[:, 21] = np.log1p(lines)
    out[:, 22] = np.log1p(size / np.maximum(lines, 1))
    out[:, 23] = (lines - different_lines) / np.maximum(lines, 1)
    return out


def statistics(b: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """N_STATS numbers for each text of a buffer."""
    n = len(offs) - 1
    counts, h, owner = _word_counts(b, offs)
    lines, line_owner = _lines(b, offs)
    many = np.bincount(line_owner, minlength=n).astype(float)
    return _shares(np.diff(offs).astype(float), counts, _distinct(h, owner, n), _distinct(*_pairs(h, owner), n), many, _distinct(lines, line_owner, n))


def long_statistics(b: np.ndarray, window: int) -> np.ndarray:
    """The same of one text, which passes in windows between words and between lines."""
    cuts = lambda marks: bs.cut_before(b, np.array([0, len(b)]), marks, window)
    counts, words, pairs, before = np.zeros((1, _COUNTS)), [], [], np.zeros(0, np.uint64)
    at = cuts(bs.SPACE)
    for a, z in zip(at[:-1], at[1:], strict=True):
        some, h, _ = _word_counts(b[a:z], np.array([0, z - a]))
        counts += some
        if len(h):
            counts[0, _AGAIN] += len(before) > 0 and before[0] == h[0]
            words.append(np.unique(h))
            pairs.append(np.unique(_pairs(np.concatenate([before, h]), np.zeros(len(before) + len(h), np.int64))[0]))
            before = h[-1:]
    at, many, lines = cuts(~_LINE), 0, []
    for a, z in zip(at[:-1], at[1:], strict=True):
        h, _ = _lines(b[a:z], np.array([0, z - a]))
        many += len(h)
        lines.append(np.unique(h))
    different = [len(np.unique(np.concatenate([*x, np.zeros(0, np.uint64)]))) for x in (words, pairs, lines)]
    return _shares(np.array([float(len(b))]), counts, different[0], different[1], np.array([float(many)]), different[2])


def _of_column(texts: pa.Array, window: int = WINDOW_BYTES) -> np.ndarray:
    b, offs = bs.buffer_of(texts)
    parts = []
    for i, j in bs.blocks(offs, window):
        part = b[offs[i] : offs[j]]
        parts.append(long_statistics(part, window) if len(part) > window else statistics(part, offs[i : j + 1] - offs[i]))
    return np.concatenate(parts) if parts else np.zeros((0, N_STATS))


def text_statistics(texts: pa.Array) -> pa.Array:
    x = _of_column(texts)
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, N_STATS, dtype=np.int32), x.ravel())


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray  # ridge scores, ascending
    levels: np.ndarray  # probability from that score on

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -REACH, REACH)
        z = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.w + self.phase)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(self.beta):
            return np.full(len(x), self.levels[0])
        return np.interp(self.features(x) @ self.beta, self.knots, self.levels)


def _constant(p: float) -> QualityModel:
    none = np.zeros(0)
    return QualityModel(none, none, none, none, none, none, np.array([p]))


def isotonic(score: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the mean score and smoothed label share of each pooled run, ascending; rows weigh ``w``, scaled to a mean of 1."""
    order = np.argsort(score, kind="stable")
    w = np.ones(len(y)) if w is None else w / w.mean()
    runs: list[list[float]] = []
    for s, t, u in zip(score[order], y[order], w[order], strict=True):
        runs.append([s * u, t * u, u])
        while len(runs) > 1 and runs[-2][1] * runs[-1][2] >= runs[-1][1] * runs[-2][2]:
            a, b, c = runs.pop()
            runs[-1] = [runs[-1][0] + a, runs[-1][1] + b, runs[-1][2] + c]
    r = np.array(runs)
    return r[:, 0] / r[:, 2], (r[:, 1] + 0.5) / (r[:, 2] + 1)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, features: int = FEATURES, seed: int = 5) -> QualityModel:
    """Learn from about ``per_class`` labelled documents of each class, held-out ids excluded."""
    spark = docs.sparkSession
    text_batches(spark)
    sample = labelled_sample(labels.select("doc_id", "quality"), "quality", per_class)
    rows = sampled_docs(docs.select("doc_id", "text"), sample)
    rows = rows.select((fold(F.col("doc_id")) == 3).alias("calibrates"), "y", "w", F.arrow_udf(text_statistics, "array<double>")("text").alias("x"))
    rows = rows.select("calibrates", "y", "w", "x").cache()
    try:
        return _fit(rows, features, seed)
    finally:
        rows.unpersist()


def _fit(rows: DataFrame, features: int, seed: int) -> QualityModel:
    x = F.col("x")
    sums = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("y"), F.lit(0)).alias("pos"),
        *[F.avg(x[k]).alias(f"m{k}") for k in range(N_STATS)],
        *[F.stddev_pop(x[k]).alias(f"s{k}") for k in range(N_STATS)],
    ).collect()[0]
    if sums["n"] == 0 or sums["pos"] in (0, sums["n"]):
        return _constant(sums["pos"] / sums["n"] if sums["n"] else 0.5)
    mean = np.array([sums[f"m{k}"] for k in range(N_STATS)])
    scale = np.maximum(np.array([sums[f"s{k}"] for k in range(N_STATS)]), 1e-6)
    rng = np.random.default_rng(seed)
    gamma = 1 / np.sqrt(2 * N_STATS)  # kernel width: about the distance between two standardised rows
    model = QualityModel(mean, scale, rng.normal(0, gamma, (N_STATS, features)), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), None, None)
    weight = {1: 0.5 * sums["n"] / sums["pos"], 0: 0.5 * sums["n"] / (sums["n"] - sums["pos"])}

    def partial(batches):
        d = features + 1
        total = np.zeros((d, d + 1))
        for batch in batches:
            x = batch.column("x").combine_chunks() if isinstance(batch.column("x"), pa.ChunkedArray) else batch.column("x")
            x = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
            z = model.features(x)
            w = np.where(y > 0, weight[1], weight[0])[:, None]
            total[:, :d] += z.T @ (z * w)
            total[:, d] += z.T @ (w[:, 0] * y)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    fit_rows = rows.filter(~F.col("calibrates")).select("x", "y").repartition(FIT_PARTITIONS)
    parts = fit_rows.mapInArrow(partial, "part binary").collect()
    d = features + 1
    total = sum(np.frombuffer(p["part"]).reshape(d, d + 1) for p in parts)
    beta = np.linalg.solve(total[:, :d] + RIDGE * np.eye(d), total[:, d])
    held = rows.filter("calibrates").select("x", "y", "w").collect() or rows.select("x", "y", "w").collect()
    score = model.features(np.array([r["x"] for r in held])) @ beta
    knots, levels = isotonic(score, np.array([r["y"] for r in held], float), np.array([r["w"] for r in held], float))
    return QualityModel(mean, scale, model.w, model.phase, beta, knots, np.maximum.accumulate(levels))


def scored(text: Column, model: QualityModel) -> Column:
    """Probability of label 1 for each whole text."""

    @F.arrow_udf("double")
    def quality_score(texts: pa.Array) -> pa.Array:
        return pa.array(np.clip(model.probability(_of_column(texts)), 0, 1))

    return quality_score(text)


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **fitting) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = fit(docs, labels, **fitting)
    out = docs.select("doc_id", scored(F.col("text"), model).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **fitting) -> DataFrame:
    """The documents that reach the threshold, with their columns."""
    model = fit(docs, labels, **fitting)
    return docs.filter(scored(F.col("text"), model) >= threshold)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
