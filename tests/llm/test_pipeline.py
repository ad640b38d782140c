"""The pipeline against a brute-force version in plain Python, and on odd tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import _plain_statistics, _plain_toxicity, brute_classes

import corpus_pipeline
from ledgerloom.llm import frames, mixing, quality, toxicity

WORDS = "the and of to in is that it was for with on this have from they would there what which their".split()
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


def corpus(spark, path):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(WORDS) + rng.choice(["", "s", "ly", "er", "ing"]) for _ in range(60)]
        text = ". ".join(" ".join(w[k : k + 10]) for k in range(0, 60, 10)) + "."
        junk, toxic = i % 5 == 1, i % 5 == 2
        if junk:
            text = " ".join(f"{x}$$$ ###" for x in text.upper().split())
        if toxic:
            text = text.replace(". ", " vilescum. ")
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(not junk), int(toxic)))
    rows += [(1000 + k, rows[5 * k][1] + (" end" if k % 2 else ""), "en", "s0", 1) for k in range(40)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    write(spark, path, rows, labels)
    return rows


def write(spark, path, rows, labels, **more):
    docs = spark.createDataFrame(rows, DOCS)
    for name, value in more.items():
        docs = docs.withColumn(name, value)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")


def mixed(rows):
    """How often each row is taken: places by hash within 1024 ranges, targets by resharing."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows]
    of = lambda x: hashlib.md5(str(x).encode()).hexdigest() if x is not None else "null"
    same = [of("/".join((of(i), of(t), of(s)))) for i, t, _, s, _ in rows]
    nth = collections.Counter()
    spot = []
    for x in same:
        spot.append(int(of(f"{x}/{nth[x]}")[:8], 16) * mixing.BUCKETS / 2**32)
        nth[x] += 1
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows) if r[3] == s) for s in sources}
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sources)}
    free, target, left = set(sources), {}, float(sum(size))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        if not over:
            break
        target |= {s: 3.0 * total[s] for s in over}
        left, free = left - sum(target[s] for s in over), free - over
    target |= share
    inside = collections.Counter()
    for r, n, x in zip(rows, size, spot):
        inside[r[3], int(x)] += n
    out = []
    for r, x in zip(rows, spot):
        mid = sum(inside[r[3], b] for b in range(int(x))) + inside[r[3], int(x)] * (x - int(x))
        out.append(sum(mid + k * total[r[3]] < target[r[3]] for k in range(3)))
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = corpus(spark, tmp_path)
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    model = quality.fit(spark.createDataFrame(rows, DOCS), labels)

    def good(text):
        z = [min(max((x - m) / s, -quality.REACH), quality.REACH) for x, m, s in zip(_plain_statistics(text or ""), model.mean, model.scale)]
        wave = [np.sqrt(2 / len(model.phase)) * np.cos(np.dot(z, w) + p) for w, p in zip(model.w.T, model.phase)] + [1.0]
        return np.interp(np.dot(wave, model.beta), model.knots, model.levels) >= 0.7

    kept = [r for r in rows if good(r[1])]
    toxic = toxicity.fit(spark.createDataFrame(kept, DOCS), labels)
    kept = [r for r in kept if _plain_toxicity(toxic, r[1] or "")[0] < 0.3]
    classes = brute_classes(kept)
    kept = [r for r in kept if classes[r[0]][1] == r[0]]
    assert {i for i in range(400) if i % 5 not in (1, 2)} <= {r[0] for r in kept} and len(kept) < 300
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for r, copies in zip(kept, mixed(kept)):
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want[r[0], 0, 0, len(ids), zlib.crc32(ids.tobytes())] += copies
    before = frames.tables_stored(spark)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert frames.tables_stored(spark) <= before + 3
    out = out.collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == +want
    fill = collections.defaultdict(list)
    for r in out:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fill.values():
        at = 0
        for off, length in sorted(parts):
            assert off == at
            at += length
        assert at <= 4096
    assert len(fill) <= np.ceil(sum(r["length"] for r in out) / 4096) + 1


@pytest.mark.parametrize("case", ["no documents", "no labels", "odd rows"])
def test_odd_tables(spark, tmp_path, case):
    rows = [] if case == "no documents" else [(i, f"word{i} and some more words here", "en", "s", 9) for i in range(6)]
    labels = [(0, 1, 0)] if case == "no documents" else []
    if case == "odd rows":  # null and repeated ids, a long text, clashing columns, labels of one class
        rows += [(None, "a b c d e f", None, None, None), (None, None, None, None, None), (3, "another text of id three", "en", "s", 1), (4, rows[4][1], "en", "s", 9), (9, "long " * 60_000, "en", "t", 1)]
        labels = [(k, 1, 0) for k in range(6)] + [(7, None, 3)]
    write(spark, tmp_path, rows, labels, text_=F.lit("x"), size=F.lit("clash"), _place=F.lit("clash"), row=F.lit("clash"), w=F.lit(1)) if case == "odd rows" else write(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = frames.stored(stage(spark, docs, str(tmp_path)), f"odd{k}")
        assert docs.columns == corpus_pipeline.COLUMNS
    out = corpus_pipeline.packing_stage(spark, docs, str(tmp_path)).collect()
    if case == "odd rows":
        assert {None, 3, 9} <= {r["doc_id"] for r in out}
    assert bool(out) == (case == "odd rows")  # without labels half is the score of all, which the threshold refuses


def test_training_order_reaches_the_sequences(spark, tmp_path):
    """Pieces by mix_file and mix_row follow each other as the curriculum's positions do, copies included."""
    rows = [(i, f"word{i} and some more words of document {i} here", "en", f"s{i % 3}", 9) for i in range(300)] + [(7, "one more", "en", "s1", 1)]
    write(spark, tmp_path, rows, [(0, 1, 0)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    order = [(r["doc_id"], r["text"]) for r in mixing.curriculum(docs).orderBy("mix_position").collect()]
    mix = frames.stored(corpus_pipeline.mixing_stage(spark, docs, str(tmp_path)), "mix")
    out = corpus_pipeline.packing_stage(spark, mix, str(tmp_path)).collect()
    firsts = sorted((r["mix_file"], r["mix_row"], r["doc_id"]) for r in out if r["piece"] == 0)
    assert [i for _, _, i in firsts] == [i for i, _ in order]
    assert len({(f, r) for f, r, _ in firsts}) == len(firsts) == len(order) and all(f.isascii() and f[:5].isdigit() for f, _, _ in firsts)


def test_registered_queries():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names}
