"""Exact deduplication, infilling and the Merkle manifest against plain Python, on odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from ledgerloom.llm import exactdedup, infill, merkle

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

# Exact deduplication


def plain_dedup(rows):
    """(doc_id, keep_id, group_size, kept, sha256) of (doc_id, text) rows, by a dictionary of whole texts."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for text, members in groups.items():
        digest = hashlib.sha256(text.encode()).hexdigest()
        for k, m in enumerate(sorted(members)):
            out.append((m[3], min(members)[3], len(members), k == 0, digest))
    return out


def write_docs(spark, path, rows, mode="overwrite", parts=3):
    spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"n": F.lit(1), "key": F.lit(2), "file": F.lit("x"), "row": F.lit(3)}).repartition(parts).write.mode(mode).parquet(path)


def odd_texts():
    rng = random.Random(3)
    rows = [(i, rng.choice(["a b c", "abc", "a\tb\nc  ", " a b\x0bc", "é \x0c", "é", "", " ", None, "\xa0", "ab c d", "日本 語", "日本語"])) for i in range(120)]
    rows += [(7, "abc"), (7, "abc"), (None, "abc"), (None, "only"), (500, "x " * 300_000), (501, "x" * 300_000)]
    return rows


def dedup_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_exact_dedup_equals_plain(spark, tmp_path):
    rows = odd_texts()
    write_docs(spark, str(tmp_path / "docs"), rows)
    got = exactdedup.deduplicated(spark, str(tmp_path / "docs"))
    assert dedup_rows(got) == sorted(plain_dedup(rows), key=repr)
    assert got.filter("kept").count() == got.select("text_sha256").distinct().count()


@pytest.mark.parametrize("bytes_kept", [0, 1])
def test_colliding_digests_are_told_apart_by_bytes(spark, tmp_path, bytes_kept):
    rows = [(i, f"text {i % 70}" + " " * (i % 3)) for i in range(300)]
    write_docs(spark, str(tmp_path / "docs"), rows)
    got = exactdedup.deduplicated(spark, str(tmp_path / "docs"), key=lambda c: F.substring(c, 1, bytes_kept))
    assert dedup_rows(got) == sorted(plain_dedup(rows), key=repr)


def test_state_lasts_between_calls_and_batches(spark, tmp_path):
    path, store = str(tmp_path / "docs"), str(tmp_path / "store")
    rng = random.Random(5)
    rows = []
    for call in range(3):
        new = [(call * 100 + k, f"text {rng.randrange(40)}" + " " * rng.randrange(3)) for k in range(60)]
        rows += new
        write_docs(spark, path, new, "append")
        got = exactdedup.deduplicated(spark, path, store, batch_bytes=1)  # a file in each batch
        assert dedup_rows(got) == sorted(plain_dedup(rows), key=repr)
    again = exactdedup.deduplicated(spark, path, store)  # nothing new
    assert dedup_rows(again) == sorted(plain_dedup(rows), key=repr)
    assert len(list((tmp_path / "store/entries").glob("batch=*"))) >= 9


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    path, store = str(tmp_path / "docs"), tmp_path / "store"
    rows = [(k, f"t {k % 7}") for k in range(40)]
    write_docs(spark, path, rows)
    exactdedup.deduplicated(spark, path, str(store))
    commits = sorted((store / "entries-log/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()  # stopped after the entries were written, before the batch was committed
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    write_docs(spark, path, [(100 + k, f"t {k % 9}") for k in range(20)], "append")
    rows += [(100 + k, f"t {k % 9}") for k in range(20)]
    assert dedup_rows(exactdedup.deduplicated(spark, path, str(store))) == sorted(plain_dedup(rows), key=repr)


def test_dedup_of_a_file_and_of_nothing(spark, tmp_path):
    write_docs(spark, str(tmp_path / "docs"), [(1, "a"), (2, "a ")], parts=1)
    file = next((tmp_path / "docs").glob("part-*.parquet"))
    assert dedup_rows(exactdedup.deduplicated(spark, str(file))) == sorted(plain_dedup([(1, "a"), (2, "a ")]), key=repr)
    write_docs(spark, str(tmp_path / "none"), [])
    assert exactdedup.deduplicated(spark, str(tmp_path / "none")).count() == 0


# Infilling


def plain_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def fill_texts():
    rng = random.Random(8)
    pieces = ["a", "Word", " ", "\n", "é", "日", "<", "P>", "<S", ">", "𝔘", "\r\n", " ", "9", "_"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))) for i in range(300)]
    rows += [(300 + k, t) for k, t in enumerate(["", None, "<P>", "x<M>y", "<S", "letters" * 50, "é" * 90, "a" * 200 + " " + "b" * 200])]
    return rows + [(5, "again"), (5, "again"), (None, "no id at all"), (400, "word " * 40_000)]


@pytest.mark.parametrize("frame_bytes", [1, 7, 64, 1 << 16])
def test_infilling_equals_plain(spark, frame_bytes):
    rows = fill_texts() if frame_bytes > 7 else fill_texts()[:-1]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"data": F.lit(1), "form": F.lit("x"), "marked": F.lit(3)})
    out = infill.infilled(docs, frame_bytes)
    got = out.collect()
    texts = [zstandard.ZstdDecompressor().stream_reader(r["output"], read_across_frames=True).read().decode() for r in got]
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], t) for r, t in zip(got, texts, strict=True)), key=repr) == sorted((plain_infill(*r) for r in rows), key=repr)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    read = sorted((tuple(r) for r in infill.digests(out).collect()), key=repr)
    assert read == sorted(((*(p := plain_infill(i, t))[:5], sha(p[5]), sha(t or "")) for i, t in rows), key=repr)


def test_a_cut_opens_one_frame_and_whole_frames_are_taken_over():
    text = infill.framed(np.frombuffer(("some words, and " * 500).encode(), np.uint8), 100)
    opened = []

    class Watched(infill.Frames):
        def raw(self, k):
            opened.append(k)
            return super().raw(k)

    seen = Watched(**vars(text))
    at, chars = seen.cut(1000)
    assert len(opened) == 1 and at == chars == sum(map(len, re.findall(r"[A-Za-z]+|[^A-Za-z]", "some words, and " * 500)[:1000]))
    opened.clear()
    out, _, _ = infill.transformed(seen, "psm", 1000, 2000)
    assert len(opened) <= 6 and len(out.ends) >= len(text.ends)
    assert b"".join(infill.restored(out, "psm")) == ("some words, and " * 500).encode()


def test_infilling_nothing(spark):
    assert infill.digests(infill.infilled(spark.createDataFrame([], "doc_id bigint, text string"))).count() == 0


# Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, more=0):
    i, text, lang, source, n = row
    values = [i, source, lang, n if n is None else n + more, text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, k):
    """Root, and what lies beside the way up from node k."""
    beside = []
    while len(nodes) > 1:
        beside.append((nodes[k ^ 1] if k ^ 1 < len(nodes) else None, k & 1))
        nodes, k = [h(*nodes[j : j + 2]) for j in range(0, len(nodes), 2)], k >> 1
    return nodes[0], beside


def plain_manifest(rows):
    """Every version's tree is built anew."""
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for lang in order:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
    leaves = {lang: [plain_leaf(r) for r in trees[lang]] for lang in order}
    subroots = [climb(leaves[lang], 0)[0] for lang in order]
    out = []
    for t, lang in enumerate(order):
        for k, row in enumerate(trees[lang]):
            subroot, low = climb(leaves[lang], k)
            root, high = climb(subroots, t)
            changed = list(leaves[lang])
            if zlib.crc32(str("" if row[0] is None else row[0]).encode()) % 7 == 0:
                changed[k] = plain_leaf(row, 1)
            heads = list(subroots)
            heads[t] = climb(changed, k)[0]
            folded = climb(heads, t)[0]
            out.append((row[0], leaves[lang][k], subroot, root, h(*(n for n, _ in low + high if n)), folded, folded == root))
    return out


def manifest_rows(df):
    names = ("doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", F.col("beside.node")), 256), "folded_root", F.col("folded_root") == F.col("root"))
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def tree_rows(n, langs=("en", "de", None, "é", "zz")):
    rng = random.Random(9)
    rows = [(i, f"text {i}é", langs[min(int(rng.expovariate(1.2)), len(langs) - 1)], rng.choice(["s", None]), rng.choice([None, i, i + 5])) for i in range(n)]
    return rows + [(3, "text 3é", "en", "s", 1), (3, "text 3é", "en", "s", 1), (None, None, None, None, None), (None, "", "en", "", 0), (-4, "", "", "", 0)]


@pytest.mark.parametrize("levels", [1, 2, 4, 10])
def test_manifest_equals_trees_built_anew(spark, levels):
    rows = tree_rows(150)
    docs = spark.createDataFrame(rows, DOCS).withColumns({"at": F.lit(1), "tree": F.lit(2), "block": F.lit(3), "_part": F.lit(4)}).repartition(5)
    assert manifest_rows(merkle.manifest(docs, levels)) == sorted(plain_manifest(rows), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, "x", "en", "s", i) for i in range(n)]
    assert manifest_rows(merkle.manifest(spark.createDataFrame(rows, DOCS), 1)) == sorted(plain_manifest(rows), key=repr)


def test_versions_copy_ancestors_only(spark):
    rows = tree_rows(60)
    got = merkle.manifest(spark.createDataFrame(rows, DOCS), 2).collect()
    for r in got:
        assert (r["copied"] is not None) == (r["tampered_leaf"] is not None)
        if r["copied"] is not None:
            assert len(r["copied"]) == len(r["beside"]) and r["copied"][-1] == r["folded_root"]
    assert any(r["copied"] for r in got)
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
