"""Files read in byte ranges against the same files read whole."""

import random
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom import file_queries
from ledgerloom.sources import delimited


def plain_cells(data):
    """Rows of (line, cells, delimiter, had_bom, error) of one file's bytes, read at once."""
    try:
        text, bom = delimited.decoded(data)
    except ValueError as e:
        return [(None, None, None, None, str(e))]
    d = delimited.sniffed(text)
    return [(n, cells, d, bom, None) for n, cells in enumerate(delimited.grid(text, d), 1)]


def read(spark, folder):
    out = {}
    for r in delimited.read_cells(spark, str(folder)).collect():
        out.setdefault(r["file"].rsplit("/", 1)[-1], []).append((r["line"], r["cells"], r["delimiter"], r["had_bom"], r["error"]))
    return {k: sorted(v, key=repr) for k, v in out.items()}


@pytest.fixture
def cut(spark):
    """Files cut every so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {k: spark.conf.get(k, None) for k in names}

    def set_to(size):
        for k, v in zip(names, (size, 1, 1)):
            spark.conf.set(k, str(v))

    yield set_to
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


FIXED = {
    "empty.csv": b"", "blank.csv": b"\n", "mark.csv": b"\xef\xbb\xbfa,b\n1,2", "quotes.csv": b'a,b\n"",x\n""', "one.csv": b'""', "open.csv": b'a;b\n1;"never\nclosed;\n', "crlf.csv": b'a\tb\r\n"x\r\ny"\t2\r\n',
    "bad.csv": b"a,b\nok,1\n\xc3(,2\n", "late.csv": b"\xef\xbb\xbfab,c\n" + b"x,y\n" * 30 + b"z,\xe2\x82", "long.csv": b'a,"' + b"word, " * 60 + b'\n",c\nd,e,f\n', "blanks.csv": b"\n\n\r\na,b\n\n",
}


@pytest.mark.parametrize("size", [7, 1000])
def test_files_in_ranges_equal_files_read_whole(spark, tmp_path, cut, size):
    for name, data in FIXED.items():
        (tmp_path / name).write_bytes(data[: 80 if size == 7 else None])
    cut(size)
    want = {name: sorted(plain_cells(data[: 80 if size == 7 else None]), key=repr) for name, data in FIXED.items()}
    assert read(spark, tmp_path) == {k: v for k, v in want.items() if v}


def test_ranges_of_any_cut_give_the_rows_of_the_whole():
    """Both passes without Spark, on random files whose lines are dealt to ranges at random."""
    rng = random.Random(11)
    for _ in range(3000):
        text = "".join(rng.choice(['"', '"', ",", ";", "\n", "\r\n", "a", "bc", "é", " ", '""']) for _ in range(rng.randrange(40)))
        if not text:
            continue
        lines = text.encode().removesuffix(b"\n").split(b"\n")
        start, rows = 0, []
        for n, raw in enumerate(lines):
            start = n + 1 if rng.random() < 0.3 else start
            rows.append({"file": "f", "start": start, "size": len(text.encode()), "raw": raw})
        sums = [r for b in delimited._summed(iter([pa.RecordBatch.from_pylist(rows)])) for r in b.to_pylist()]
        inside, row, known = False, 1, {}
        for r in sums:
            known[r["start"]] = {"inside": inside, "row": row, "last": r is sums[-1], "ended": text.endswith("\n"), "delimiter": delimited.sniffed(text), "had_bom": False}
            row += r["ends_odd"] if inside else r["ends_even"]
            inside ^= r["odd"]
        assert sum(r["bytes"] for r in sums) == len(text.encode()) + (not text.endswith("\n"))
        got = [r for b in delimited._parsed(iter([pa.RecordBatch.from_pylist([r | known[r["start"]] for r in rows])])) for r in b.to_pylist()]
        cells = {r["line"]: r["cells"] for r in got if r["cells"] is not None}
        pieces = {}
        for r in sorted((r for r in got if r["cells"] is None), key=lambda r: r["piece"]):
            pieces[r["line"]] = pieces.get(r["line"], "") + r["text"]
        cells |= {n: next(delimited.grid(t, delimited.sniffed(text))) for n, t in pieces.items()}
        assert sorted(cells.items()) == [(n, x) for n, x, *_ in plain_cells(text.encode())], text


def test_ranges_beyond_a_broadcast(spark, tmp_path, cut, monkeypatch):
    monkeypatch.setattr(delimited, "BROADCAST_RANGES", 1)
    data = "".join(f'{k},"two\nlines {k}",x\n' for k in range(60)).encode()
    (tmp_path / "a.csv").write_bytes(data)
    cut(64)
    assert read(spark, tmp_path) == {"a.csv": sorted(plain_cells(data), key=repr)}


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path, cut):
    with (tmp_path / "big.csv").open("w") as f:
        for k in range(60_000):
            f.write(f'PO-{k},"Vendor, {k % 7}","line one\nline two of {k}",{k}.50\n')
    cut(160 << 10)
    rows = delimited.read_cells(spark, str(tmp_path))
    assert delimited._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 15
    got = rows.select(F.count("*"), F.sum(F.size("cells")), F.max("line"), F.count_if(F.col("cells")[2].contains("\nline two of "))).collect()[0]
    assert tuple(got) == (60_000, 240_000, 60_000, 60_000)
    assert rows.filter("cells[0] != concat('PO-', line - 1)").count() == 0


def test_compressed_files_are_refused(spark, tmp_path):
    import gzip

    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(b"a,b\n1,2\n" * 50))
    assert [r["error"] for r in delimited.read_cells(spark, str(tmp_path)).collect()] == ["file is compressed or changed while it was read"]


def test_purchase_order_files_are_whole(spark):
    """one file a clerk, the heading first, however many partitions the rows are dealt to."""
    session = spark.newSession()
    for key, value in {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}.items():
        session.conf.set(key, value)
    folder = Path(file_queries._files(session, "/root/testdata/sf0.001").removeprefix("file:"))
    files = [list(clerk.glob("part-*")) for clerk in folder.glob("clerk=*")]
    assert [len(x) for x in files] == [1] * 14
    assert all(x[0].read_bytes().removeprefix(delimited.BOM).startswith(b"reference") for x in files)
