"""The training-data operators against brute force, round trips and held-out accuracy, on small tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import bytescan, chat, components, frames, jaccard, langid, mixing, neardup, packing, quality, topk, toxicity, urlrules

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOCS)


def sentence(rng, words, n=12):
    return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."


WORDS = {
    "en": "the and of to in is that it was for with on this have from they would there what".split(),
    "de": "der und die das nicht ein eine ist mit auf für zu den von über wird sich auch".split(),
    "fr": "le la les et des une est dans pour qui sur avec été être même où ça très".split(),
}


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(4)
    out = []
    for i in range(240):
        lang = list(WORDS)[i % 3]
        out.append((i, " ".join(sentence(rng, WORDS[lang]) for _ in range(6)), lang, f"s{i % 4}"))
    return out


# Shared parts


def test_byte_hashes_tell_words_apart():
    import pyarrow as pa

    texts = ["Ab ab\tAB  x", "", None, "ab", "é ab"]
    b, offs = bytescan.buffer_of(pa.array(texts))
    s, e = bytescan.word_spans(b, offs, ~bytescan.SPACE)
    words = [bytes(b[i:j]).decode() for i, j in zip(s, e, strict=True)]
    assert words == ["Ab", "ab", "AB", "x", "ab", "é", "ab"]
    exact = bytescan.span_hashes(b, s, e)
    folded = bytescan.span_hashes(b, s, e, bytescan.FOLDED)
    assert len(set(exact.tolist())) == 5 and len(set(folded.tolist())) == 3
    long = np.frombuffer(("x" * 3_000_000 + " y").encode(), np.uint8)
    s, e = bytescan.word_spans(long, np.array([0, len(long)]), ~bytescan.SPACE)
    assert len(set(bytescan.span_hashes(long, s, e).tolist())) == 2


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (7, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([(1, 1), (None, 2)], "a bigint, b bigint")).count() == 0


def test_marked_and_dropped(spark):
    df = spark.range(3000).withColumnRenamed("id", "k").union(spark.createDataFrame([(7,), (8,), (None,)], "k bigint"))
    ids, once = spark.range(0, 3000, 3).withColumnRenamed("id", "k"), spark.createDataFrame([(7,), (8,)], "k bigint")
    got = collections.Counter(r["k"] for r in frames.drop_ids(df, "k", ids, once).collect())
    assert got == collections.Counter([k for k in range(3000) if k % 3] + [None])


def test_stored_tables_can_be_dropped(spark):
    from pathlib import Path

    table = frames.stored(spark.range(10), "numbers")
    at = Path(table.inputFiles()[0].removeprefix("file:")).parent
    assert table.count() == 10 and at.exists()
    assert frames.drop_stored(spark) >= 1 and not at.exists() and frames.drop_stored(spark) == 0


# 1, 2, 10


def test_language(spark, prose):
    extra = [(900, None, "en", "a"), (901, "", "fr", "a"), (902, "123 !?", None, "a"), (903, "DER UND DIE NICHT MIT " * 9, None, None), (903, "DER UND DIE NICHT MIT " * 9, None, None), (None, "the and of to in is that", "en", "a")]
    df = docs_of(spark, prose + extra).withColumn("score", F.lit("clash"))
    rows = langid.identify(df, steps=90).collect()
    assert len(rows) == len(prose) + len(extra)
    got = collections.defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r)
    right = [got[i][0]["lang_pred"] == lang for i, _, lang, _ in prose if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(right) >= 0.95 * len(right)
    assert all(got[i][0]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in prose)
    assert [got[k][0]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3 and got[900][0]["score"] == 0
    assert [r["lang_pred"] for r in got[903]] == ["de", "de"] and got[None][0]["lang_pred"] == "en" and not got[None][0]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in rows)
    empty = langid.identify(docs_of(spark, []))
    assert empty.count() == 0
    assert langid.identify(docs_of(spark, [(1, "text", None, "a")])).collect()[0]["lang_pred"] == "und"


def test_backpropagation_gives_the_gradient():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in langid._init(3, 4, 1).items()}
    x, y = rng.integers(97, 110, (7, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    for k, lead in [(k, lead) for k in p for lead in (0, 2)]:
        mask = rng.random((7 - 2 * lead, 5)) < 0.8
        _, g = langid.gradients(p, x, mask, y, lead)
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p[k].shape)
            if k[0] == "x":
                at = (at[0], int(x[rng.integers(0, 7), rng.integers(0, 5)]))
            old = p[k][at]
            p[k][at] = old + 1e-3
            up = langid.gradients(p, x, mask, y, lead)[0]
            p[k][at] = old - 1e-3
            down = langid.gradients(p, x, mask, y, lead)[0]
            p[k][at] = old
            assert abs((up - down) / 2e-3 - g[k][at]) < 2e-4 + 0.02 * abs(g[k][at])


def _language_model(texts, langs, **training):
    import pyarrow as pa

    b, offs = bytescan.buffer_of(pa.array(texts))
    start, stop, owner = langid.segments(b, offs)
    x, mask = langid.windows(b, offs, start, stop, owner)
    names = sorted(set(langs))
    return langid.train(x, mask, np.searchsorted(names, langs)[owner], names, **training)


def _plain_network(model, text):
    """Probabilities of one text, byte by byte in plain Python: each segment with LEAD bytes around it, mean over letters."""
    p = {k: v.astype(float) for k, v in model.p.items()}
    raw = text.lower().encode()
    is_letter = [c.isalpha() for c in text.lower() for _ in c.encode()]
    inside = [False] + [raw[k] & 0xC0 == 0x80 for k in range(1, len(raw))]
    cuts = list(range(0, len(raw), langid.SEGMENT)) + [len(raw)]
    for n in range(1, len(cuts) - 1):
        while inside[cuts[n]]:
            cuts[n] -= 1
    sigmoid = lambda a: 1 / (1 + np.exp(-a))
    byte = lambda k: raw[k] if 0 <= k < len(raw) else 0
    total, many = np.zeros(len(model.languages)), 0
    for a, z in zip(cuts, cuts[1:]):
        states = {}
        for d, order in (("f", range(a - langid.LEAD, a + langid.BODY)), ("b", range(a + langid.BODY + langid.LEAD - 1, a - 1, -1))):
            h = np.zeros(langid.HIDDEN)
            for k in order:
                gx, gu = p["x" + d][:, byte(k)], p["u" + d] @ h
                zg, r = sigmoid(gx[:8] + gu[:8]), sigmoid(gx[8:16] + gu[8:16])
                h = (1 - zg) * h + zg * np.tanh(gx[16:] + r * gu[16:])
                states[d, k] = h
        for k in range(a, z):
            if is_letter[k]:
                e = np.exp(p["of"] @ states["f", k] + p["ob"] @ states["b", k] + p["c"][:, 0])
                total, many = total + e / e.sum(), many + 1
    return total / max(many, 1)


def test_network_against_brute_force():
    import pyarrow as pa

    model = _language_model([" ".join(WORDS["en"])] * 8 + [" ".join(WORDS["fr"])] * 8, ["en"] * 8 + ["fr"] * 8, steps=40)
    texts = ["the", "", "été où " * 40 + "the and", "😀、 123 là", "x" * 130 + "é" * 70, "…" * 90 + "ça"]
    b, offs = bytescan.buffer_of(pa.array([t.lower() for t in texts]))
    prob = langid.probabilities(model, b, offs)
    assert all(np.allclose(prob[k], _plain_network(model, t), atol=1e-4) for k, t in enumerate(texts))


def test_letters_of_bytes():
    text = "aZ9 é×ÿ… 漢、ひ😀𝒜ʼñ\u0301ª"
    b = np.frombuffer(text.encode(), np.uint8)
    assert langid.letters(b).tolist() == [c.isalpha() for c in text for _ in c.encode()]


def test_every_byte_of_a_long_text_counts(spark):
    model = _language_model([" ".join(WORDS["en"])] * 8 + [" ".join(WORDS["de"])] * 8, ["en"] * 8 + ["de"] * 8, steps=60)
    import pyarrow as pa

    long = " ".join(WORDS["en"]) * 300 + " " + " ".join(WORDS["de"]) * 900
    b, offs = bytescan.buffer_of(pa.array([long, "the"]))
    prob = langid.probabilities(model, b, offs)
    assert model.languages[prob[0].argmax()] == "de" and np.allclose(prob.sum(axis=1), 1, atol=1e-3)


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_toxicity(spark, prose):
    rng = random.Random(2)
    rows, labels = [], []
    for i, text, lang, s in prose:
        bad = i % 5 == 0
        if bad:
            parts = text.split(". ")
            for k in range(0, len(parts), 2):
                parts[k] += f" {rng.choice(['scumbag', 'scummy', 'filth', 'filthy'])}"
            text = ". ".join(parts)
        rows.append((i, text, lang, s))
        labels.append((i, 1, int(bad)))
    rows += [(900, None, "en", "a"), (901, "", "en", "a"), (902, "the " * 60_000, "en", "a"), (902, "the " * 60_000, "en", "a"), (None, "filthy", "en", "a")]
    labels += [(5, 1, 0), (77777, 0, 1), (12, None, None), (13, 1, 7)]
    df, lab = docs_of(spark, rows), _labels(spark, labels)
    got = {r["doc_id"]: r for r in toxicity.score(df.withColumn("toxic", F.lit(9)), lab).collect()}
    held = [i for i, *_ in prose if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["predicted"] == (i % 5 == 0) for i in held) >= 0.95 * len(held)
    assert got[900]["score"] == 0 and got[901]["predicted"] == 0 and got[902]["predicted"] == 0 and got[None]["predicted"] == 1
    assert toxicity.score(df, _labels(spark, [])).agg(F.max("score")).collect()[0][0] == 0
    assert toxicity.score(docs_of(spark, []), lab).count() == 0
    model = toxicity.fit(df, lab)
    text = "The and of. A filthy of to. In is that."
    spots = spark.createDataFrame([(text,), (None,)], "text string").select(toxicity.located(F.col("text"), model).alias("s")).collect()
    assert [text[x["start"] : x["end"]] for x in spots[0]["s"]] == ["A filthy of to"] and spots[1]["s"] == []
    kept = {r["doc_id"] for r in toxicity.clean(df, lab).collect()}
    assert sum(i in kept for i in held if i % 5) >= 0.95 * sum(i % 5 > 0 for i in held)


def test_quality(spark, prose):
    rows, labels = [], []
    for i, text, lang, s in prose:
        bad = i % 3 == 0
        rows.append((i, " ".join(f"{w}$$$ ###" for w in text.upper().split()) if bad else text, lang, s))
        labels.append((i, int(not bad), 0))
    rows += [(900, None, "en", "a"), (901, "", "en", "a"), (902, "x" * 300_000, "en", "a"), (903, rows[1][1], "en", "a"), (None, rows[1][1], "en", "a")]
    df = docs_of(spark, rows)
    got = {r["doc_id"]: r for r in quality.score(df, _labels(spark, labels)).collect()}
    held = [i for i, *_ in prose if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["predicted"] == int(i % 3 != 0) for i in held) >= 0.95 * len(held)
    assert got[903]["score"] == got[1]["score"] == got[None]["score"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert quality.score(df, _labels(spark, [])).agg(F.avg("score")).collect()[0][0] == 0.5
    assert quality.score(docs_of(spark, []), _labels(spark, labels)).count() == 0
    assert quality.good(df, _labels(spark, labels)).columns == df.columns
    clash = df.withColumns({c: F.lit("clash") for c in ("quality", "score", "y", "w", "x", "z", "fold", "_score", "predicted", "held_out")})
    assert {(r["doc_id"], r["score"]) for r in quality.score(clash, _labels(spark, labels)).collect()} == {(i, r["score"]) for i, r in got.items()}
    assert quality.good(clash, _labels(spark, labels)).columns == clash.columns


def test_statistics_of_long_texts():
    import pyarrow as pa

    rng = random.Random(3)
    texts = ["", "one", "A a A a  b", "\n\nline one\nline one\r\nline 2 $$ 99\n" * 9, " ".join(rng.choice(WORDS["fr"]) + rng.choice(["", "!", "\n", " |"]) for _ in range(500)), "x" * 400 + " y"]
    want = quality._of_column(pa.array(texts))
    for window in (7, 30, 200):
        assert np.allclose(quality._of_column(pa.array(texts), window), want)


def _plain_statistics(text):
    """The statistics from their meaning, in plain Python."""
    raw = text.encode()
    share = lambda f: sum(map(f, raw)) / max(len(raw), 1)
    alnum = lambda c: chr(c).isalnum() if c < 128 else True
    odd = lambda c: 32 < c < 127 and not alnum(c) and chr(c) not in ".,;:!?'\"()-"
    space = lambda c: c in (32, 9, 10, 11, 12, 13)
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    low = [w.lower() for w in words]
    lines = re.findall(rb"[^\n\r]+", raw)
    n, m, k = max(len(words), 1), max(len(low) - 1, 1), max(len(lines), 1)
    size = [len(w) for w in words]
    mean = sum(size) / n
    upper = lambda c: 65 <= c <= 90
    return [
        share(upper), share(lambda c: 48 <= c <= 57), share(lambda c: c < 128 and chr(c) in ".,;:!?'\"()-"), share(odd), share(space), share(lambda c: c >= 128), np.log1p(len(raw)),
        share(lambda c: c == ord("!")), share(lambda c: c == ord("|")), share(lambda c: c == ord(".")), np.log1p(len(words)), mean, max(sum(x * x for x in size) / n - mean**2, 0) ** 0.5,
        sum(x > 20 for x in size) / n, sum(x <= 3 for x in size) / n, sum(a == b for a, b in zip(low, low[1:])) / n, len(set(low)) / n, len(set(zip(low, low[1:]))) / m,
        sum(alnum(w[0]) for w in words) / n, sum(odd(w[-1]) for w in words) / n, sum(upper(w[0]) and upper(w[-1]) for w in words) / n, np.log1p(len(lines)), np.log1p(len(raw) / k), (len(lines) - len(set(lines))) / k,
    ]


def test_quality_against_a_plain_scorer(spark, prose):
    rows = [(i, t if i % 3 else t.upper().replace(" ", "$ #|"), lang, s) for i, t, lang, s in prose] + [(900, None, "en", "a"), (901, "A b\nA b\r\n\tÉ 9 9", "en", "a")]
    df, labels = docs_of(spark, rows), _labels(spark, [(i, int(i % 3 > 0), 0) for i, *_ in prose])
    model = quality.fit(df, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(df, labels).collect()}
    for i, text, *_ in rows:
        z = [min(max((x - m) / s, -quality.REACH), quality.REACH) for x, m, s in zip(_plain_statistics(text or ""), model.mean, model.scale, strict=True)]
        wave = [np.sqrt(2 / len(model.phase)) * np.cos(np.dot(z, w) + p) for w, p in zip(model.w.T, model.phase, strict=True)] + [1.0]
        assert abs(got[i] - np.interp(np.dot(wave, model.beta), model.knots, model.levels)) < 1e-6, i


def _plain_toxicity(model, text, sentences=False):
    """Sentence by sentence in plain Python: weights of words and their beginnings, joined by noisy-or."""
    import pyarrow as pa

    clean, spots, at = 1.0, [], 0
    for part in re.split(rb"([.!?\n\r])", text.encode()):
        words = [m for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", part)]
        logit = model.bias
        for m in words:
            b, offs = bytescan.buffer_of(pa.array([m[0].decode("latin-1").encode("latin-1")], pa.binary()))
            logit += float(model.weight[toxicity.features(b, np.array([0]), np.array([len(b)]))].sum())
        if words:
            p = 1 / (1 + np.exp(-logit))
            clean *= 1 - p
            if p >= toxicity.THRESHOLD:
                spots.append((at + words[0].start(), at + words[-1].end()))
        at += len(part)
    return 1 - clean, spots


def test_toxicity_against_a_plain_scorer(spark, prose):
    rng = random.Random(2)
    rows = [(i, t.replace(". ", f" {rng.choice(['scumbag', 'filthy', 'filth'])}! ", 2) if i % 4 == 0 else t, lang, s) for i, t, lang, s in prose]
    rows += [(900, "..!\n", "en", "a"), (901, "Filth. " * 40 + "The end? filthy\r\nand of", "en", "a"), (902, None, "en", "a")]
    df, labels = docs_of(spark, rows), _labels(spark, [(i, 1, int(i % 4 == 0)) for i, *_ in prose])
    model = toxicity.fit(df, labels)
    got = {r["doc_id"]: r for r in toxicity.score(df, labels).collect()}
    for i, text, *_ in rows:
        p, spots = _plain_toxicity(model, text or "")
        assert abs(got[i]["score"] - p) < 1e-5 and [(x["start"], x["end"]) for x in got[i]["sentences"]] == spots, i
    import pyarrow as pa

    b, offs = bytescan.buffer_of(pa.array([t for _, t, *_ in rows]))
    want = model.sentences(b, offs)
    chosen = model.weight != 0
    bags = [toxicity.bag(b[i:j], chosen).tolist() for i, j in zip(offs[:-1], offs[1:], strict=True)]
    for most in (9, 50, 400):
        part = model.sentences(b, offs, most)
        assert all(np.allclose(x, y) for x, y in zip(want, part, strict=True)), most
    old, toxicity.WINDOW_BYTES = toxicity.WINDOW_BYTES, 20
    try:
        assert bags == [toxicity.bag(b[i:j], chosen).tolist() for i, j in zip(offs[:-1], offs[1:], strict=True)]
    finally:
        toxicity.WINDOW_BYTES = old
    one = _labels(spark, [(i, 1, 1) for i, *_ in prose])
    assert {str(r["score"]) for r in toxicity.score(df, one).collect()} == {"0.0"}


def test_toxicity_draws_each_class(spark, prose, monkeypatch):
    """However few numbers may be learnt from, each class keeps a document."""
    rows = [(i, t.replace(". ", " filthy! ", 2) if i % 4 == 0 else t, lang, s) for i, t, lang, s in prose]
    df, labels = docs_of(spark, rows), _labels(spark, [(i, 1, int(i % 4 == 0)) for i, *_ in prose])
    for most in (5, 300):
        monkeypatch.setattr(toxicity, "MOST_NUMBERS", most)
        got = {r["doc_id"]: r["score"] for r in toxicity.score(df, labels).collect()}
        assert np.mean([got[i] for i, *_ in rows if i % 4 == 0]) > np.mean([got[i] for i, *_ in rows if i % 4]), most


def test_isotonic_is_monotone():
    knots, levels = quality.isotonic(np.array([0.1, 0.2, 0.2, 0.4, 0.9]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(levels) >= 0).all() and (np.diff(knots) >= 0).all()


def test_quality_means_the_same_when_classes_are_drawn_down(spark):
    """Texts that are good four times in five are scored so, whether six good labels to a bad one are all taken or not."""
    rng = random.Random(5)
    kinds = [("good", 1)] * 880 + [("either", 1)] * 320 + [("either", 0)] * 80 + [("bad", 0)] * 120
    rng.shuffle(kinds)
    loud = {"good": 0, "either": 0.5, "bad": 1}
    text = lambda k: " ".join(f"{w.upper()}$$$ ###" if rng.random() < loud[k] else w for w in (rng.choice(WORDS["en"]) for _ in range(60)))
    df = docs_of(spark, [(i, text(k), "en", "a") for i, (k, _) in enumerate(kinds)])
    labels = _labels(spark, [(i, y, 0) for i, (_, y) in enumerate(kinds)])
    for per_class in (6000, 150):
        got = {r["doc_id"]: r["score"] for r in quality.score(df, labels, per_class=per_class).collect()}
        mean = {k: np.mean([got[i] for i, (x, _) in enumerate(kinds) if x == k]) for k in loud}
        assert mean["good"] > 0.9 and mean["bad"] < 0.2 and abs(mean["either"] - 0.8) < 0.1, (per_class, mean)
    learnt = sum(y for i, (_, y) in enumerate(kinds) if zlib.crc32(str(i).encode()) % 4 != 2)
    drawn = frames.labelled_sample(labels, "quality", 150).filter("y = 1").agg(F.count("y"), F.sum("w")).collect()[0]
    assert drawn[0] < learnt / 3 and abs(drawn[1] - learnt) < 0.25 * learnt


# 3, 5


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


def test_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    v = rng.normal(0, 0.3, (300, 12)).astype(np.float32)
    v[40:90] = v[40]
    v[7] = 0
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [(500, None), (501, [float("nan")] * 12), (502, [1.0, None] * 6), (503, [float("inf")] * 12), (550, [0.5, 0.25]), (600, [1.0, 2.0]), (601, []), (None, rows[3][1]), rows[3]]
    df = _vectors(spark, rows).withColumn("v", F.lit("clash"))
    good = df.filter(topk.finite(F.col("embedding"))).select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    got = sorted(tuple(r) for r in topk.topk(good, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect())
    q = np.floor(v.astype(float) * 256).astype(int)
    want = []
    for i in range(0, 300, 50):
        order = sorted((-int(q[i] @ q[j]), j) for j in range(300) if j != i)[:5]
        want += [(i, r, j, -s) for r, (s, j) in enumerate(order, 1)]
    want += [(550, 1, 600, 128 * 256 + 64 * 512), (600, 1, 550, 128 * 256 + 64 * 512)]
    assert got == sorted(want)
    assert topk.topk(good.limit(0), F.lit(True)).count() == 0


def test_topk_keeps_rows_of_a_repeated_id(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 2)
    rows = [(0, [1, 0]), (0, [0, 1]), (1, [2, 0]), (1, [0, 3]), (2, [1, 1])]
    got = topk.topk(spark.createDataFrame(rows, "vec_id bigint, v array<bigint>"), F.col("vec_id") == 0)
    assert sorted(tuple(r) for r in got.select("rank", "vec_id", "score").collect()) == [(1, 1, 2), (1, 1, 3), (2, 2, 1), (2, 2, 1), (3, 1, 0), (3, 1, 0)]


def test_topk_ranks_each_row_of_a_repeated_query_id(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 3)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rows = [(50, [2, 1])] * 3 + [(i, [i % 4, i]) for i in range(1, 9)]
    got = topk.topk(spark.createDataFrame(rows, "vec_id bigint, v array<bigint>"), F.col("vec_id") == 50).collect()
    order = sorted((-(2 * (i % 4) + i), i) for i in range(1, 9))[:5]
    want = [(50, r, i, -s) for r, (s, i) in enumerate(order, 1)]
    assert sorted(tuple(r) for r in got) == sorted(want * 3) and len({r["vec_id"] for r in got}) == 5


def test_threshold_algorithm_stops_early():
    rng = np.random.default_rng(2)
    c = np.abs(rng.normal(0, 1, (4000, 3)))
    c[:6] += 9
    s, i = topk.threshold_topk(np.arange(4000), c, np.array([-5]), np.ones((1, 3)), 5)
    assert set(i[0]) == set(np.argsort(-c.sum(axis=1))[:5]) and np.allclose(s[0], np.sort(c.sum(axis=1))[::-1][:5])


@pytest.mark.parametrize("size", [2.0**20, 2.0**30, 1e18, 1e38, 1e200])
def test_exact_topk_beyond_doubles(size, monkeypatch):
    monkeypatch.setattr(topk, "FIRST_DEPTH", 3)
    rng = np.random.default_rng(4)
    c = np.floor(rng.normal(0, size, (300, 6)))
    c[5:20] = c[5]
    c[20, 0] = np.nextafter(c[5, 0], np.inf)
    c[21] = 1.0
    q, q_ids = np.concatenate([c[:4], np.floor(rng.normal(0, 3, (2, 6)))]), np.array([0, 1, 2, 3, 900, 901])
    want = [sorted((-sum(int(x) * int(y) for x, y in zip(v, w, strict=True)), i) for i, w in enumerate(c) if i != qi)[:5] for qi, v in zip(q_ids, q, strict=True)]
    assert [[(-s, i) for s, i in b] for b in topk.exact_topk(np.arange(300), c, q_ids, q, 5)] == want


def test_topk_of_huge_components(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 8)
    rows = [(0, [1e18, 1.0]), (1, [1e18, 0.0]), (2, [1e18, 0.5]), (3, [-1e18, 2.0]), (4, [3e-5, 1.0]), (5, [1e300, 0.0]), (6, [1e308, 1.0]), (50, [1.0, 1.0]), (51, [1e16, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    good = df.filter(topk.finite(F.col("embedding"))).select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.topk(good, F.col("vec_id") % 50 == 0, 9).collect()}
    long = 2**63 - 1
    assert [got[0, k] for k in range(1, 7)] == [(5, long), (2, long), (1, long), (51, long), (50, long), (4, 65536)] and got[0, 7] == (3, -long - 1) and (0, 8) not in got
    assert [got[50, k][0] for k in range(1, 8)] == [5, 0, 2, 1, 51, 4, 3] and got[50, 5][1] == long and got[50, 6][1] == 65536
    assert topk.topk(spark.createDataFrame([(0, [2**61, 1]), (1, [3, 1]), (2, [3, 2])], "vec_id bigint, v array<bigint>"), F.col("vec_id") == 0).collect()[0]["score"] == 3 * 2**61 + 2


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP", 24)
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, (150, 32))
    near = [base[k % 12] + rng.normal(0, 0.08, 32) for k in range(160)]
    v = np.concatenate([base, near, base[:5], base[:1] * 2]).astype(np.float32)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    odd = [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, [1.0, None] * 16), (904, [1.0] * 5), (905, [1.0] * 5), (None, rows[0][1])]
    got = {r["vec_id"]: r for r in neardup.near_duplicates(_vectors(spark, rows + odd).withColumn("dim", F.lit(1))).collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    want = link.sum(axis=1)
    n = np.array([got[i]["n_links"] for i in range(len(v))])
    assert (n <= want).all() and n.sum() >= 0.98 * want.sum()
    low = np.arange(len(v))
    for _ in range(20):
        low = np.array([min([low[i], *low[link[i]]]) for i in range(len(v))])
    same = np.mean([got[i]["component_id"] == low[i] for i in range(len(v))])
    assert same > 0.98 and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values() if r["vec_id"] is not None)
    for k in (900, 901, 902, 903):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True)
    assert got[904]["n_links"] == 1 and got[905]["component_id"] == 904 and got[None]["n_links"] == 0 and not got[None]["kept"]
    assert neardup.near_duplicates(_vectors(spark, [])).count() == 0


def test_near_duplicates_of_any_size(spark):
    """Doubles keep what floats lose: cosines at the threshold, tiny and huge vectors."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aside = rng.normal(size=x.shape)
    aside -= np.sum(aside * x, axis=1, keepdims=True) * x
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cos = np.where(np.arange(40) % 2, 0.95 + 1e-12, 0.95 - 1e-12)[:, None]
    y = cos * x + np.sqrt(1 - cos**2) * aside
    size = 10.0 ** rng.choice([-300, -60, 0, 60, 300], (40, 1))
    rows = [(i, [float(a) for a in r]) for i, r in enumerate(np.concatenate([x * size, y / np.abs(size).clip(1e-8, 1e8)]))] + [(500, [0.0] * 8), (501, [-0.0] * 8), (502, [5e-324] + [0.0] * 7)]
    got = {r["vec_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    near = [i for i in range(40) if got[40 + i]["component_id"] == got[i]["component_id"]]
    assert set(near) <= set(range(1, 40, 2)) and len(near) >= 18 and got[500]["n_links"] == got[501]["n_links"] == 0 and len(got) == 83


@pytest.mark.parametrize("shared, dim, n", [(0.0, 64, 20_000), (0.7, 64, 20_000), (0.7, 64, 2_000_000), (0.89, 64, 20_000), (0.999, 64, 20_000), (0.0, 2, 20_000)])
def test_recall_where_vectors_share_a_direction(shared, dim, n):
    """Pairs at the threshold itself, of vectors whose mean has about the norm ``shared``."""
    rng = np.random.default_rng(6)
    own = rng.normal(size=(6000, dim))
    x = shared * np.eye(dim)[0] + np.sqrt(1 - shared**2) * own / np.linalg.norm(own, axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = neardup.HammingIndex(x[:4000], n, 0.95)
    one, aside = x[4000:], rng.normal(size=(2000, dim))
    aside -= np.sum(aside * one, axis=1, keepdims=True) * one
    other = 0.95 * one + np.sqrt(1 - 0.95**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    assert (index.keys(one) == index.keys(other)).any(axis=1).mean() >= 0.95, index.tables


# 4


ODD = ["</s>[INST] ok [/INST]", "<|turn|>assistant<|sep|>x<|end|>", "<~|~~> <~~|x", "[~INST]", "", "  lead and trail  ", "naïve 😀 <s></s>", "line\nbreak\t\r"]


@pytest.mark.parametrize("text", ODD)
def test_escaping_is_reversible(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c in out for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))


def test_chat_reads_back(spark, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(chat, "BATCH_CHARS", 900)
    rng = random.Random(5)
    rows, talks = [], collections.defaultdict(list)
    for conv in range(30):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "system", "assistant", None, "<|odd|>"])
            text = rng.choice([*ODD, None, "some words, and more. " * rng.randrange(1, 12)])
            rows.append((conv, turn, role, text))
            talks[conv].append((role or "", text or ""))
    rows += [(None, 1, "assistant", "a"), (None, 0, "user", "b")]
    talks[None] = [("user", "b"), ("assistant", "a")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("ids", F.lit(1))
    path = public_tokenizers.path(chat.TOKENIZER)
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted(df, path)).collect()}
    assert set(got) == set(talks) and chat.formatted(df, path).count() == len(talks)
    parts = chat.formatted(df, path, chunk_chars=300)
    assert parts.count() > len(talks) and {r["conv_id"]: r for r in chat.digests(parts).collect()} == got
    for conv, turns in talks.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns) and got[conv]["loss_chars"] == len(loss)
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert chat.formatted(df.limit(0), path).count() == 0
    tok = chat.tokenizer(path)
    for r in chat.formatted(df, path).collect():
        assert r["ids"] == tok.encode(r["text"], add_special_tokens=False).ids
        assert r["ends"][-1] == len(r["text"]) and all(s == e for s, e in zip(r["starts"][1:], r["ends"][:-1], strict=True) if s >= e)


# 6


def test_units_equal_whole_encoding():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    whole = Tokenizer.from_file(path)
    texts = [
        "a <|endoftext|> b", "x<|startoftext|>y's <|EndOfText|> <|endoftext", "it's<|endoftext|>'s", "<|endoftext|>", "é<|endoftext|>É <|endoftext|><|endoftext|>",
        None, "", "  ", "it's John's DON'T a.b c,d .,. x., É. é, ﬁ. İstanbul, ΣΑΣ. word word. 12, 3.4 <|endoftext|>. ǅ, \x1cx\x1f, x\x85y.", "́abc, a ́b. ʼn, ªº", "'", "''", "a'", "\n", "é" * 50,
        "It's 'the 'se x's. !'s a'b 123 a1b2c 4,5 ÉCOLE é×2÷3 Öl_x __ -- a--b 'tis ''s rock'n'roll don't\tx\ny\r\nz", "Straße, NAÏVE! \x7f", "你好 world",
    ]
    texts += [" ".join(t or "" for t in texts) * 3, "one-word" * 40]
    tokens = packing.UnitTokens(path)
    assert tokens.ids(pa.array(["a <|endoftext|> b"]))[0].tolist() == [320, 49407, 321]
    for part in (packing.PART_BYTES, packing.PART_BYTES, 7, 64):
        got = tokens.ids(pa.array(texts, pa.string()), part)
        assert [x.tolist() for x in got] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_plan_is_gapless_and_no_worse_than_first_fit():
    rng = np.random.default_rng(0)
    for cap in (10, 50, 100):
        for _ in range(25):
            lens = rng.integers(1, cap, rng.integers(1, 200))
            counts = dict(zip(*(a.tolist() for a in np.unique(lens, return_counts=True)), strict=True))
            runs, n = packing.plan(counts, cap)
            used, fill = dict.fromkeys(counts, 0), collections.defaultdict(list)
            for length, first, many, seq, each, off in runs.tolist():
                assert first == used[length]
                used[length] += many
                for r in range(many):
                    fill[seq + r // each].append((off + r % each * length, length))
            assert used == counts and len(fill) == n
            for parts in fill.values():
                at = 0
                for off, length in sorted(parts):
                    assert off == at
                    at += length
                assert at <= cap
            bins = []
            for x in sorted(lens.tolist(), reverse=True):
                k = next((k for k, b in enumerate(bins) if b + x <= cap), None)
                if k is None:
                    bins.append(x)
                else:
                    bins[k] += x
            assert n <= len(bins)
    assert packing.plan({}, 10)[1] == 0


def test_packing(spark, prose, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "SALT_ROWS", 40)
    path = public_tokenizers.path(packing.TOKENIZER)
    rows = [*prose, (900, None, "en", "a"), (901, "", "en", "a"), (902, "word " * 2600, "en", "a"), (903, "x", "en", "a"), (903, "x", "en", "a"), (None, "y", "en", "a")]
    rows += [(904, "x <|endoftext|> y", "en", "a")] + [(905, "equal rows", "en", "a")] * 300 + [(None, "equal rows", "en", "a")] * 300
    df = docs_of(spark, rows).withColumn("length", F.lit("clash")).withColumn("at", F.lit("clash"))
    cap = 256
    got = packing.packed(df, path, cap).collect()
    tok = Tokenizer.from_file(path)
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), cap):
            part = np.array(ids[k : k + cap], "<u4")
            want[i, k // cap, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    fill = collections.defaultdict(list)
    for r in got:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fill.values():
        at = 0
        for off, length in sorted(parts):
            assert off == at
            at += length
        assert at <= cap
    assert packing.packed(df.limit(0), path, cap).count() == 0


# 7


def test_url_rules(spark):
    urls = ["https://a.example.org/es/1?x", "http://EXAMPLE.org/en/12#t", "http://example.org/en/2", "http://x.com/fr/1", "http://com/de/", "http://xcom/de/1", "http://x.org", None, "no scheme", "ftp://a://b/c", "http://h.net?q", "http://É.ORG/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrules.judged(df).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2][2:] == ("org/", "allow") and got[3][2:] == ("com/fr/", "allow") and got[4][2:] == ("com/de/", "block") and got[5][2] is None
    assert got[6][:3] == ("x.org", "", None) and got[7][:3] == ("", "", None) and got[8][:3] == ("", "", None) and got[9][:2] == ("a:", "//b/c") and got[10][:2] == ("h.net", "")
    assert got[11][0] == "É.org" and all(v[3] in ("allow", "block") for v in got.values()) and len(got) == len(urls)
    assert urlrules.judged(df.limit(0)).count() == 0
    assert {r["verdict"] for r in urlrules.judged(spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x")], "page_id bigint, url string")).collect()} == {"allow"}


def test_url_mining_against_brute_force(spark):
    rng = random.Random(8)
    tokens = ["a", "b", "c", "d", "e"]
    rows = []
    for _ in range(400):
        t = sorted({x for x in tokens if rng.random() < 0.5} or {"a"})
        rows.append((t, "block" if {"a", "b"} <= set(t) or (set(t) == {"e"}) else "allow"))
    model = urlrules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), min_support=0.02, min_confidence=0.6)
    found = {(tuple(r[0]), r[1]): (r[2], r[3]) for rules in model.index.values() for r in rules}
    assert found
    for (t, v), (conf, sup) in found.items():
        n = sum(set(t) <= set(x) for x, _ in rows)
        hit = sum(set(t) <= set(x) and y == v for x, y in rows)
        assert abs(conf - hit / n) < 1e-9 and abs(sup - hit / len(rows)) < 1e-9 and conf >= 0.6 and hit >= 0.02 * len(rows)
    assert (("a", "b"), "block") in found
    judged = spark.createDataFrame([(["a", "b", "z"],), (["c", "d"],), ([],)], "tokens array<string>").select(model.verdict(F.col("tokens")).alias("v")).collect()
    assert [r["v"] for r in judged] == ["block", "allow", "allow"]


def test_every_frequent_host_gets_its_rule(spark, monkeypatch):
    """60 hosts, each on 0.6 % of the labelled urls, seen under com/de/ only; by the constant and by the table of rules."""
    labelled = [f"http://h{k}.com/de/{j}" for k in range(60) for j in range(3)] + [f"http://w{k}.org/{k}" for k in range(320)]
    asked = [f"http://h{k}.net/x" for k in range(60)] + ["http://w1.net/x", "http://other.net", None, None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(labelled + asked + asked[:1])], "page_id bigint, url string")
    want = ["block"] * 180 + ["allow"] * 320 + ["block"] * 60 + ["allow"] * 4 + ["block"]
    for literal in (1000, 5):
        monkeypatch.setattr(urlrules, "LITERAL_RULES", literal, raising=False)
        assert [r["verdict"] for r in sorted(urlrules.judged(df).collect(), key=lambda r: r["page_id"])] == want


def brute_verdicts(labelled, asked, least, confidence, default):
    """The verdict of each token set, from all subsets of its tokens."""
    out = []
    for tokens in asked:
        best = None
        for m in range(1, 1 << len(tokens)):
            t = {x for i, x in enumerate(sorted(tokens)) if m >> i & 1}
            on = [v for x, v in labelled if t <= x]
            for v in set(on):
                if on.count(v) >= least and on.count(v) / len(on) >= confidence:
                    best = max(best or (0,), (on.count(v) / len(on), on.count(v), -len(t), v))
        out.append(best[3] if best else default)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_verdicts_of_merged_and_implied_tokens(spark, seed):
    """Tokens of equal row sets, tokens that others imply, and plain ones, against all subsets."""
    rng = random.Random(seed)
    labelled = []
    for _ in range(300):
        t = {x for x in "abcd" if rng.random() < 0.4}
        t |= {"e", "f", "g"} if "a" in t else set()
        t |= {"p", "q"} if t & {"b", "c"} else set()
        t |= {f"s{k}" for k in range(rng.randrange(5))}
        labelled.append((t, "block" if ("a" in t) == ("b" in t) and rng.random() < 0.9 or "s3" in t else "allow"))
    asked = [{x for x in "abcdefgpq" if rng.random() < 0.4} | {f"s{k}" for k in range(4) if rng.random() < 0.4} | {"new"} for _ in range(40)]
    model = urlrules.mine(spark.createDataFrame([(sorted(t), v) for t, v in labelled], "tokens array<string>, verdict string"), 0.05, 0.6)
    got = spark.createDataFrame([(k, sorted(t)) for k, t in enumerate(asked)], "k int, tokens array<string>").select("k", model.verdict(F.col("tokens")).alias("v")).collect()
    votes = [v for _, v in labelled]
    default = max(sorted(set(votes)), key=votes.count)
    assert [r["v"] for r in sorted(got, key=lambda r: r["k"])] == brute_verdicts(labelled, asked, 15, 0.6, default)


@pytest.mark.parametrize("cut", [False, True])
def test_long_shared_paths_give_few_rules(spark, cut):
    """40 segments that 2 % of the urls share, whole or each cut elsewhere: 2**40 combinations."""
    deep = "/".join(f"seg{k}" for k in range(40)).split("/")
    shared = [f"http://deep.com/de/{'/'.join(deep[: 40 - (j % 20 if cut else 0)])}" for j in range(40)]
    plain = [f"http://w{k % 50}.org/{k}" for k in range(1960)]
    asked = ["http://x.net/seg3/seg7", "http://x.net/seg19", "http://w1.net/q"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(shared + plain + asked)], "page_id bigint, url string")
    got = {r["page_id"]: r["verdict"] for r in urlrules.judged(df).collect()}
    assert [got[2000 + k] for k in range(3)] == ["block", "block", "allow"]
    parsed = df.limit(2000).select(urlrules.tokens_of(urlrules.host_of(F.col("url")), urlrules.path_of(F.col("url"))).alias("tokens"), F.when(F.col("page_id") < 40, "block").otherwise("allow").alias("verdict"))
    assert urlrules.mine(parsed).rules.count() < 150


# 8


def brute_classes(rows):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage = text(40)
    rows = []
    for g in range(12):
        base = text(rng.choice([9, 30, 60, 200]))
        for _ in range(rng.choice([1, 2, 6, 20])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(" ".join(w))
        rows.append(" ".join(text(30) + passage + text(20)))
        rows.append(" ".join(passage + text(g % 4)))
    chain = text(60)
    for k in range(8):
        rows.append(" ".join(chain[k:] + text(0) + [f"t{j}" for j in range(k)]))
    rows += ["One two", "one TWO", "one two three", "", "  \n", "É a b c d", "é a b c d", "a b c d e", "A B C D E", "x " * 30]
    rng.shuffle(rows)
    return [(i, t, "en", "s") for i, t in enumerate(rows)] + [(5000, None, "en", "s")]


def test_jaccard_against_brute_force(spark, copies, monkeypatch):
    df = docs_of(spark, copies + [copies[3]]).withColumn("n", F.lit("clash"))
    rows = jaccard.classes(df).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got == brute_classes(copies) and len(rows) == len(copies) + 1
    kept = [r["doc_id"] for r in jaccard.one_of_each(df).collect()]
    assert sorted(kept) == sorted({c for _, c in got.values()})
    monkeypatch.setattr(jaccard, "FAN_OUT", 2)
    monkeypatch.setattr(jaccard, "COMMON_ROWS", 2)
    monkeypatch.setattr(jaccard.product_pairs, "__defaults__", (64, 3))  # small blocks, columns of more than three rows split
    monkeypatch.setattr(jaccard, "COUNT_RANGES", 16)
    monkeypatch.setattr(jaccard, "MOST_PARTITIONS", 3)  # many blocks in each
    monkeypatch.setattr(jaccard, "WINDOW_BYTES", 40)
    monkeypatch.setattr(bytescan.windows, "__defaults__", (50,))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(df).collect()}
    assert got == brute_classes(copies)


def test_product_alone_finds_every_link(spark, copies, monkeypatch):
    monkeypatch.setattr(jaccard, "star_pairs", lambda rows: rows.select(F.col("row").alias("a"), F.col("row").alias("b")).filter("a < b"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(docs_of(spark, copies)).collect()}
    assert got == brute_classes(copies)


def test_jaccard_odd_tables(spark):
    assert jaccard.classes(docs_of(spark, [])).count() == 0
    rows = jaccard.classes(docs_of(spark, [(None, "a b c d e f", "en", "s"), (1, "a b c d e f", "en", "s"), (1, "a b c d e f", "en", "s")])).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in rows) == [(0, 2, 0), (1, 2, 1), (1, 2, 1)]


def test_jaccard_of_one_id_with_several_texts(spark):
    """Ids 1 (texts A and B), 2 (near A), 3 (near B), 5 (C and D), 4 (near D): each text's links count, and the id joins them."""
    rng = random.Random(12)
    text = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(60))
    a, b, c, d = (text() for _ in range(4))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (5, c), (5, d), (4, d + " more"), (6, c), (7, text()), (7, None), (None, a)]
    df = docs_of(spark, [(i, t, "en", "s") for i, t in rows] + [(5, d, "en", "s")] * 40)
    found = jaccard.classes(df).collect()
    got = sorted({(r["doc_id"] or 0, r["component_id"] or 0) for r in found})
    assert got == [(0, 0), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (7, 7)] and len(found) == len(rows) + 40


def test_long_texts_pass_in_windows(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdef") * rng.randrange(1, 4) for _ in range(n)) for n in (0, 3, 4000, 5, 900)] + ["x" * 300 + " y z"]
    import pyarrow as pa

    b, offs = bytescan.buffer_of(pa.array(texts))
    want = jaccard.shingle_sets(b, offs)
    h = bytescan._long_hash(b, bytescan.EXACT)
    extra = (jaccard.fingerprints(*want), jaccard.min_hash_keys(*want)), [jaccard.parity(want[0][i:j]) for i, j in zip(want[1][:-1], want[1][1:], strict=True)]
    monkeypatch.setattr(jaccard, "WINDOW_BYTES", 100)
    monkeypatch.setattr(bytescan, "SPAN", 64)
    monkeypatch.setattr(bytescan.windows, "__defaults__", (64,))
    got = jaccard.shingle_sets(b, offs)
    assert all((x == y).all() for x, y in zip(want, got, strict=True))
    again = (jaccard.fingerprints(*got), jaccard.min_hash_keys(*got)), [jaccard.parity(got[0][i:j]) for i, j in zip(got[1][:-1], got[1][1:], strict=True)]
    assert all((x == y).all() for x, y in zip(extra[0], again[0], strict=True)) and extra[1] == again[1]
    assert h == bytescan._long_hash(b, bytescan.EXACT)


def test_parity_sketch_is_a_lower_bound():
    rng = np.random.default_rng(5)
    for _ in range(200):
        both = rng.integers(0, 2**63, rng.integers(0, 300)).astype(np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, rng.integers(0, 200)).astype(np.uint64)])) for _ in range(2))
        assert jaccard.parity_difference(jaccard.parity(a), jaccard.parity(b)) <= len(np.setxor1d(a, b))


# 9


def test_targets_match_resharing(spark):
    rng = random.Random(3)
    for _ in range(4):
        sizes = {f"s{k}": rng.choice([0, 10, 200, 5000, 80]) for k in range(9)} | {None: 700}
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
        names = sorted(k for k in sizes if k) + [None]
        weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
        free, target, left = set(names), {}, float(sum(sizes.values()))
        while True:
            share = {k: left * weight[k] / sum(weight[x] for x in free) for k in free}
            over = {k for k in free if share[k] > 3 * sizes[k]}
            if not over:
                break
            for k in over:
                target[k] = 3.0 * sizes[k]
                left -= target[k]
            free -= over
        target |= share
        assert all(abs(got[k] - target[k]) < 1e-6 for k in names)


def test_mixing(spark, prose):
    rows = [(i, t, lang, s if i % 7 else None) for i, t, lang, s in prose] + [(900, None, "en", "s0"), (901, "", "en", "empty"), (None, "a b c", "en", "s0")]
    df = docs_of(spark, rows).withColumn("size", F.lit("clash")).withColumn("target", F.lit("clash"))
    a = mixing.taken(df.select("doc_id", "text", "source")).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, mixing.taken(df).collect()))
    by = collections.defaultdict(lambda: [0, 0.0, 0])
    where = {r["doc_id"]: r["source"] for r in df.collect()}
    for r in a:
        x = by[where[r["doc_id"]]]
        x[0] += r["taken"]
        x[1] = r["target"]
        x[2] = r["source_size"]
        assert r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0
    assert all(abs(n - t) <= 0.12 * t + 1 for n, t, _ in by.values()) and abs(sum(t for _, t, _ in by.values()) - sum(s for _, _, s in by.values())) < 1e-6
    mix = mixing.curriculum(df).collect()
    assert len(mix) == sum(r["taken"] // r["size"] for r in a if r["size"]) + sum(1 for r in mix if not (r["text"] or "").strip())
    assert all(0 <= r["mix_position"] < 1 for r in mix if r["text"]) and set(df.columns) < set(mix[0].asDict())
    parts = mixing.curriculum(df).withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.min("mix_position").alias("a"), F.max("mix_position").alias("b")).orderBy("a").collect()
    assert all(x["b"] <= y["a"] for x, y in zip(parts, parts[1:], strict=False))
    assert mixing.taken(df.limit(0)).count() == 0


def test_columns_with_clashing_names_pass(spark):
    """Whatever the operators name their own columns, the caller's go through."""
    rows = [(i % 50, f"{i % 50} some words of text number {i % 50} here", "en", f"s{i % 2}") for i in range(80)]
    names = ["_place", "_same", "_number", "_slice", "_bits", "_hit", "_source", "_mid", "_copies", "_at", "_salt", "_within", "kept", "size", "h1", "row"]
    df = docs_of(spark, rows).withColumns({c: F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for c in names})
    mix = mixing.curriculum(df).collect()
    one = jaccard.one_of_each(df).collect()
    assert len({r["doc_id"] for r in one}) == len(one) > 40 and len(mix) > 40
    for r in mix + one:
        assert all(r[c] == f"{c} {r['doc_id']}" for c in names)
    assert mixing.curriculum(df).columns == [*df.columns, "mix_copy", "mix_position"] and jaccard.one_of_each(df).columns == df.columns


def test_texts_of_one_id_meet_their_own_rows_only(spark, monkeypatch):
    """Different texts under one id are joined to pair sides by their hashes: a row for each text that was met."""
    rng = random.Random(2)
    base = [rng.choice(WORDS["en"]) + str(k) for k in range(60)]
    rows = [(7, " ".join(base[:k] + [f"x{k}"] + base[k:]), "en", "s") for k in range(1, 41)]
    rows += [(k + 100, t, "en", "s") for k, (_, t, *_) in enumerate(rows[:5])]
    sides = []
    old = jaccard.stored

    def seen(df, name):
        out = old(df, name)
        if name == "pair-sides":
            sides.append(out)
        return out

    monkeypatch.setattr(jaccard, "stored", seen)
    df = docs_of(spark, rows)
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.classes(df).collect()}
    assert got == {(i, 7) for i in [7, *range(100, 105)]}
    texts = jaccard.one_text_each(df, df.filter("doc_id = 7").select("doc_id").distinct())
    for s in sides:
        assert s.join(texts, ["doc_id", "h1", "h2"]).count() == s.count()


def test_mix_of_repeated_ids(spark, monkeypatch):
    """Sources of 1,000 rows under one id or none come within one document of their target; numbers of equal rows are dealt over salts."""
    monkeypatch.setattr(frames.numbered, "__defaults__", (64,))
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice(WORDS["en"]) for _ in range(n))
    rows = [(7, "one two three four five", "en", "a")] * 1000 + [(None, "one two three four five", "en", "b")] * 1000
    rows += [(8, text(1 + k % 9), "en", "c") for k in range(1000)] + [(9, text(5), "en", s) for s in "abcd" for _ in range(20)]
    df = docs_of(spark, rows)
    got = mixing.taken(df).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in got)
    by = collections.Counter()
    for r in got:
        by[r["source_size"], r["target"]] += r["taken"]
    assert len(by) >= 3 and all(abs(n - t) <= 9 + 0.02 * t for (_, t), n in by.items()), by
    again = mixing.taken(docs_of(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    mix = mixing.curriculum(df)
    assert mix.count() == sum(r["taken"] // r["size"] for r in got)
    at = [r["mix_position"] for r in mix.filter("doc_id = 7").collect()]
    assert len(set(at)) > 0.9 * len(at)


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(f"k{k:04d}" if k else None, rng.randrange(100)) for k in range(500)]
    got = frames.running(spark.createDataFrame(rows, "k string, x int").repartition(6), [F.col("k").asc_nulls_last()], upto=F.col("x"), nth=F.lit(1)).collect()
    total = 0
    for n, (r, (k, x)) in enumerate(zip(sorted(got, key=lambda r: r["nth"]), sorted(rows, key=lambda r: (r[0] is None, r[0])), strict=True), 1):
        total += x
        assert (r["k"], r["upto"], r["nth"]) == (k, total, n)
    assert frames.running(spark.createDataFrame([], "k string, x int"), [F.col("k")], s=F.col("x")).count() == 0


def test_numbered_rows(spark):
    rows = spark.createDataFrame([("a", k) for k in range(500)] + [("b", 1), ("c", 2), ("c", 3)], "k string, x int")
    again = rows.groupBy("k").count().filter("count > 1").select("k")
    got = frames.numbered(rows, "k", again, "n", 40).collect()
    assert sorted(r["n"] for r in got if r["k"] == "a") == list(range(500)) and sorted(r["n"] for r in got if r["k"] == "c") == [0, 1] and [r["n"] for r in got if r["k"] == "b"] == [0]


def test_position_inverts_demand(spark):
    u = spark.createDataFrame([(k / 20, n) for k in range(20) for n in range(3)], "u double, n int")
    for r in u.select("u", "n", mixing.position(F.col("u"), F.col("n")).alias("t")).collect():
        a, b = mixing.SCHEDULES[r["n"]]
        assert abs((a * r["t"] + (b - a) * r["t"] ** 2 / 2) / ((a + b) / 2) - r["u"]) < 1e-12


# Against SQL


def test_queries_against_sql(spark):
    from pathlib import Path

    import duckdb

    from ledgerloom.llm import registry

    data = "/root/testdata/sf0.001"
    if not Path(data).exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, data)
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns), name
        assert sorted(map(repr, cur.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*names).collect()), name
