"""Streams against batches across restarts; curves, replays, raw states and SQL functions against plain versions."""

import decimal
import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, hashing, money, numbers, sql
from ledgerloom.operators import certificates, gate, reconcile, scoring, signing, trace
from ledgerloom.sources import shared, sinks
from ledgerloom.streaming import traces

DOCS = "digest string, path string, route string, read_at timestamp"


def arriving(spark, path, rows, schema):
    """One more file of a stream's source."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def uncommitted(log):
    """As if the run had stopped between writing its last batch and noting it."""
    last = max((p for p in (log / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)


def test_documents_are_stored_exactly_once(spark, tmp_path):
    import datetime

    at = datetime.datetime(2026, 1, 1)
    rng = random.Random(1)
    batches = [[(f"d{rng.randrange(12)}", f"p{b}-{k}", "text", at) for k in range(8)] for b in range(4)]
    table, log = tmp_path / "table", tmp_path / "log"
    for b in batches[:2]:
        arriving(spark, tmp_path / "in", b, DOCS)
    sinks.stream_documents(source(spark, tmp_path / "in", DOCS), str(table), str(log))
    before = sorted(map(tuple, spark.read.parquet(str(table)).select("id", "digest", "path").collect()))
    uncommitted(log)
    sinks.stream_documents(source(spark, tmp_path / "in", DOCS), str(table), str(log))
    assert sorted(map(tuple, spark.read.parquet(str(table)).select("id", "digest", "path").collect())) == before
    uncommitted(log)
    for b in batches[2:]:
        arriving(spark, tmp_path / "in", b, DOCS)
    sinks.stream_documents(source(spark, tmp_path / "in", DOCS), str(table), str(log))
    got = spark.read.parquet(str(table)).collect()
    assert sorted(r["digest"] for r in got) == sorted({d for b in batches for d, *_ in b}) and sorted(r["id"] for r in got) == list(range(1, len(got) + 1))
    assert {(r["id"], r["digest"], r["path"]) for r in got} >= set(before)


def test_repeated_batches_of_a_log_replace_themselves(spark, tmp_path):
    for b in range(3):
        arriving(spark, tmp_path / "in", [(b, k) for k in range(5)], "b int, k int")
    for _ in range(2):
        sinks.stream_into(source(spark, tmp_path / "in", "b int, k int"), str(tmp_path / "out"), str(tmp_path / "log"), form="json")
        uncommitted(tmp_path / "log")
    assert spark.read.json(str(tmp_path / "out")).count() == 15


def test_streamed_heads_equal_batch_heads(spark, tmp_path):
    """Records out of order over batches, one twice, and a restart between."""
    rng = random.Random(4)
    records = [(run, pos, f"body {run} {pos}") for run in range(6) for pos in range(run + 2)]
    rng.shuffle(records)
    parts = [records[:9], records[9:15] + records[:2], records[15:]]
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "3")
    kind = "run_id bigint, pos bigint, body string"
    for k, part in enumerate(parts):
        arriving(spark, tmp_path / "in", part, kind)
        if k == 1:
            uncommitted(tmp_path / "log")
        sinks.stream_into(traces.heads(source(session, tmp_path / "in", kind)), str(tmp_path / "heads"), str(tmp_path / "log"))
    got = {(r["run_id"], r["pos"]): r["head"] for r in spark.read.parquet(str(tmp_path / "heads")).collect()}
    want = {(r["run_id"], k): h for r in trace.chained(spark.createDataFrame(records, kind)).collect() for k, h in enumerate(r["heads"])}
    assert got == want and spark.read.parquet(str(tmp_path / "heads")).count() == len(records)


def test_running_sums_over_ranges(spark):
    rows = [(k, k % 5) for k in random.Random(2).sample(range(1000), 400)]
    got = {r["k"]: (r["a"], r["n"]) for r in shared.running(spark.createDataFrame(rows, "k int, x int").repartition(7), [F.col("k").desc()], a=F.col("x"), n=F.lit(1)).collect()}
    total = 0
    for n, (k, x) in enumerate(sorted(rows, reverse=True), 1):
        total += x
        assert got[k] == (total, n)


def test_risk_curve_is_the_gate_at_every_floor(spark):
    rng = random.Random(6)
    fields, truth = [], []
    for k in range(200):
        value = rng.choice(["a", "b", None])
        fields.append((k % 20, f"f{k}", "string", value, rng.choice(["region", "span", "unbound"]), rng.choice([None, None, "text-layer"]), rng.choice([None, 0.25, 0.5, 0.625, 0.75, 1.0]), rng.choice([None, True, False])))
        truth.append((k % 20, f"f{k}", rng.choice(["a", "b"])))
    truth.append((99, "lost", "a"))
    f = spark.createDataFrame(fields, "doc_id int, key string, type string, value string, status string, source string, confidence double, arithmetic_ok boolean")
    t = spark.createDataFrame(truth, "doc_id int, key string, text string")
    curve = scoring.risk_curve(t, f).collect()
    floors = [r["floor"] for r in curve if r["floor"] != float("inf")]
    swept = {r["floor"]: r for r in scoring.risk_coverage(t, f, floors).collect()}
    assert len(floors) > 5
    for r in curve:
        if r["floor"] in swept:
            s = swept[r["floor"]]
            assert (r["admitted_right"], r["admitted_wrong"], r["coverage"], r["precision"]) == (s["admitted_right"], s["admitted_wrong"], s["coverage"], s["precision"])


def to_fixed(x, places):
    with decimal.localcontext(prec=400):
        return ("-" if x < 0 else "") + str(decimal.Decimal(abs(x)).quantize(decimal.Decimal(1).scaleb(-places), rounding=decimal.ROUND_HALF_UP))


@pytest.mark.parametrize("places", [0, 2, 3, 6])
def test_fixed_decimals_come_from_exact_values(spark, places):
    rng = random.Random(places)
    xs = [0.0, -0.0, 0.5, 0.125, 0.0625, 1.005, 2.5, -2.5, -0.001, 5e-324, 0.9995, 999.9995, 2.0**53 + 2, 2.0**60, 1e20, 123456789012345680000.0]
    xs += [rng.random() for _ in range(30_000)] + [rng.uniform(-1e6, 1e6) for _ in range(10_000)] + [rng.randrange(10**9) / 2 ** rng.randrange(40) for _ in range(10_000)] + [round(rng.random(), 4) for _ in range(10_000)]
    xs += [x for x in (struct.unpack("d", struct.pack("Q", rng.randrange(2**64)))[0] for _ in range(5_000)) if abs(x) < 1e21]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(numbers.to_fixed(F.col("x"), places)).collect()]
    assert got == [to_fixed(x, places) for x in xs]
    odd = spark.createDataFrame([(1e21,), (-1.5e22,), (float("inf"),), (float("-inf"),), (float("nan"),), (None,)], "x double").select(numbers.to_fixed(F.col("x"), places)).collect()
    assert [r[0] for r in odd] == ["1e+21", "-1.5e+22", "Infinity", "-Infinity", "NaN", None]


def test_reasons_print_floors_exactly(spark):
    x = spark.createDataFrame([(0.0005,)], "confidence double")
    said = x.select(gate.reason(F.lit("confidence"), F.lit("span"), F.lit("amount"), F.col("confidence"), F.lit(None), F.lit(None))).collect()[0][0]
    assert said == "read at 0.001, below the 0.65 floor for a amount bound at span width"


def test_sql_functions_equal_columns(spark):
    assert set(sql.register(spark)) == set(sql.FUNCTIONS)
    rows = [("EUR 1.234,50",), ("-5",), ("$1,000",), ("x",), (None,), ("R$ 10,5",)]
    df = spark.createDataFrame(rows, "raw string")
    one = df.select(money.parse_amount(F.col("raw")).alias("p"), money.sign_suspect(F.col("raw")).alias("s")).collect()
    assert spark.sql("SELECT parse_amount(raw) AS p, sign_suspect(raw) AS s FROM {df}", df=df).collect() == one
    b = "named_struct('x0', 0D, 'y0', 0D, 'x1', 10D, 'y1', 10D)"
    a = "named_struct('x0', 20D, 'y0', 5D, 'x1', 30D, 'y1', 15D)"
    got = spark.sql(f"SELECT box_height({b}), box_mid_y({a}), box_union({a}, {b}) AS u, box_overlap({a}, {b}), box_gap({b}, {a}), box_inside_page({a}, 25D, 90D), slug('A b/C'), half_up(2.5D), same_text('A  b', 'a B'), value_carried('date', 'Due 18 May 2026', '2026-05-18')").collect()[0]
    assert got[0] == 10 and got[1] == 10 and tuple(got["u"]) == (0, 0, 30, 15) and tuple(got[3:]) == (0.5, 1.0, False, "a-b-c", 3, True, True)


def test_raw_states(spark):
    rows = [('{"a": {"value": "5", "admitted": true}}',), ('{"a": null}',), ("{}",), ('{"a": {"value": "5", "admitted": false, "check": "binding"}}',), ("not json",), ('{"A": {"admitted": true}}',)]
    got = spark.createDataFrame(rows, "j string").select(reconcile.raw_state(F.col("j"), "a").alias("s")).collect()
    assert [tuple(r["s"]) for r in got] == [("have", "5", None), ("withheld", None, None), ("missing", None, None), ("withheld", "5", "binding"), ("missing", None, None), ("missing", None, None)]


def test_replay_outcomes(spark):
    def certificate(content="x", sdk="1.0", total="5"):
        return json.dumps({
            "version": "1", "producedAt": "then", "document": {"digest": hashlib.sha256(content.encode()).hexdigest()}, "verdict": {"decision": "matched"}, "fields": {"total": {"minor": total}},
            "trace": {"root": "ab" * 32}, "replay": {"sdkVersion": sdk, "model": "m"},
        })

    recorded = spark.createDataFrame([("same", certificate()), ("other", certificate()), ("old", certificate(sdk="0.9")), ("gone", certificate("y"))], "id string, certificate string")
    again = json.loads(certificate()) | {"producedAt": "now", "verdict": {"decision": "mismatch"}}
    made = spark.createDataFrame([("same", json.dumps(again)), ("other", certificate(total="6")), ("old", certificate()), ("gone", certificate("y"))], "id string, certificate string")
    files = spark.createDataFrame([(hashlib.sha256(b"x").hexdigest(),)] * 2, "digest string")
    got = {r["id"]: (r["outcome"], r["detail"]) for r in certificates.replayed(recorded, files, made, "1.0", "m").collect()}
    assert got["same"] == ("match", "1 fields, root abababababab") and got["other"] == ("mismatch", '1 differences, first at fields.total.minor: "5" against "6"')
    assert got["old"][0] == "not comparable" and got["gone"] == ("input missing", f"no file digests to {hashlib.sha256(b'y').hexdigest()[:12]}") and len(got) == 4


def test_replay_reads_each_side_once(spark):
    """certificates meet whole and once; what agrees never becomes rows."""
    made = spark.range(3).select(F.col("id").cast("string").alias("id"), F.lit('{"document": {"digest": "d"}, "replay": {"sdkVersion": "1.0", "model": "m"}}').alias("certificate"))
    out = certificates.replayed(made, spark.createDataFrame([("d",)], "digest string"), made, "1.0", "m")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1
    assert [r["outcome"] for r in out.collect()] == ["match"] * 3


def test_differences_of_values_that_python_takes_for_equal(spark):
    frame = lambda *x: spark.createDataFrame([(str(i), t) for i, t in enumerate(x)], "id string, certificate string")
    a = frame('{"a": {"b": [true, 1]}, "n": 1, "z": 0}', '{"a": 1, "s": "e\u0301"}', '{"v": {"x": 1}, "verdict": 1}', '{"a": {}}', '{"a": [1, 2]}', '{"only": [1]}')
    b = frame('{"z": -0.0, "a": {"b": [1, 1.0]}, "n": 1.0}', '{"a": false, "s": "\u00e9"}', '{"verdict": 2, "v": {"x": true}}', '{"a": {"b": null}}', '{"a": [1]}')
    got = sorted(tuple(r) for r in certificates.differences(a, b, ("verdict",)).collect())
    assert got == [
        ("0", "a.b[0]", "true", "1"), ("1", "a", "1", "false"), ("2", "v.x", "1", "true"), ("3", "a", "{}", None), ("3", "a.b", None, "null"), ("4", "a[1]", "2", None), ("5", "only[0]", "1", None),
    ]


def test_outcomes_read_a_printed_text_once(spark):
    """trimming, reading and comparing are written once into the plan, for all types."""
    rows = [(1, "a", "amount", "123450", "1.234,50 EUR"), (2, "a", "date", "2020-01-05", " 5 January 2020"), (3, "a", "date", "2020-13-05", "2020-13-05"), (4, "a", "integer", "7", " 7%"), (5, "a", "string", "PART 7", " part-7"), (6, "a", "amount", "5", None)]
    read = spark.createDataFrame(rows, "doc_id int, key string, type string, value string, text string")
    verdict = F.struct((F.col("doc_id") % 2 == 0).alias("admitted"), F.lit("confidence").alias("check"))
    out = scoring.field_outcomes(read.select("doc_id", "key", "text"), read.select("doc_id", "key", "type", "value", verdict.alias("verdict")))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[0-9,]*,[0-9]{3})$") == 1 and plan.count("AS _right") == 1
    day = read.select(dates.coerce_date(F.col("text")).alias("day"))._jdf.queryExecution().optimizedPlan().toString()
    assert day.count("regexp_replace") == 1
    assert {r["doc_id"]: r["outcome"] for r in out.collect()} == {
        1: "abstained_would_be_right", 2: "admitted_right", 3: "abstained_would_be_wrong", 4: "admitted_right", 5: "abstained_would_be_right", 6: "admitted_wrong",
    }


def test_minor_in_is_the_amount_that_is_parsed(spark):
    rows = [(x,) for x in ("EUR 1.234,50", "-5", "$1,000", "x", None, "R$ 10,5", "USD 5 EUR", "12.34.5", "1.234", "Total 5", "", " \u00a0-7,5 €")]
    got = spark.createDataFrame(rows, "raw string").select(money.minor_in(F.col("raw")).alias("a"), money.parse_amount(F.col("raw"))["minor"].alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and got[0]["a"] == 123450 and got[11]["a"] == -750


#: RFC 8032, section 7.1: public key, message, signature.
VECTORS = (
    ("d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ("fc51cd8e6218a1a38da47ed00230f0580816ed13ba3303ac5deb911548908025", "af82", "6291d657deec24024827e69c3abe01a30ce548a284743a445e3680d7db5ac3ac18ff9b538d16f290ae67f760984dc6594a7c15e9716ed28dc027beceea1ec40a"),
)


@pytest.mark.parametrize("public, message, signature", VECTORS)
def test_signature_vectors(public, message, signature):
    public, message, signature = map(bytes.fromhex, (public, message, signature))
    assert signing.verified(public, message, signature)
    assert not signing.verified(public, message + b"x", signature) and not signing.verified(public, message, signature[:40])
    for k in (0, 31, 32, 63):
        assert not signing.verified(public, message, signature[:k] + bytes([signature[k] ^ 1]) + signature[k + 1 :])
    high = (int.from_bytes(signature[32:], "little") + signing.ORDER).to_bytes(32, "little")
    assert not signing.verified(public, message, signature[:32] + high)


def test_many_signatures_are_verified_in_tasks(spark):
    """Those that the JVM made, and what it says of each, on certificates altered after they were signed."""
    key, other = signing.new_key(spark), signing.new_key(spark)
    rows = []
    for k in range(12):
        made = signing.sign(spark, {"version": "1", "n": k, "name": "é" * k}, key if k % 2 else other)
        if k % 4 == 1:
            made["n"] = -1
        if k % 4 == 2:
            made["signature"]["sig"] = rows[-1][1]["signature"]["sig"]
        if k == 3:
            made["signature"]["publicKey"] = made["signature"]["publicKey"].replace("A", "B")
        if k == 4:
            del made["signature"]
        rows.append((k, made))
    df = spark.createDataFrame([(k, json.dumps(m)) for k, m in rows] + [(99, "no json"), (100, None), (101, "[1]")], "k int, certificate string")
    got = {r["k"]: r["h"] for r in df.select("k", signing.holds(F.col("certificate")).alias("h")).collect()}
    assert got == {k: signing.signature_holds(spark, json.dumps(m)) for k, m in rows} | {99: False, 100: False, 101: False}
    assert sum(got.values()) >= 4


def test_signed_in_tasks_is_what_the_jvm_accepts(spark):
    rows = [(json.dumps({"version": "1", "n": k, "x": 0.5}),) for k in range(4)] + [(None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(signing.signed(F.col("t"), bytes(range(32))).alias("s")).collect()]
    assert got[4] is None and all(signing.signature_holds(spark, t) and signing.certificate_holds(t) for t in got[:4])
    for public, message, signature in VECTORS[:1]:
        assert signing.signature_of(bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60"), bytes.fromhex(message)) == (bytes.fromhex(public), bytes.fromhex(signature))


def test_keys_met_often_cost_no_sums(monkeypatch):
    """a signature by the base point's table, one under a key met often by the key's, too; both say what they said before."""
    seed = b"a third seed of thirty-two bytes"
    made = [(f"m{k}".encode(), *signing.signature_of(seed, f"m{k}".encode())) for k in range(4)]
    said = lambda: [signing.verified(p, m if k % 2 else m + b"x", s) for k, (m, p, s) in enumerate(made)]
    before, sums, plain = said(), [], signing._sum
    for _ in range(signing.OFTEN):
        signing.verified(made[0][1], made[0][0], made[0][2])
    monkeypatch.setattr(signing, "_sum", lambda p, q: sums.append(1) or plain(p, q))
    assert said() == before == [False, True, False, True]
    assert signing.signature_of(seed, b"m1") == made[1][1:] and not sums


def test_canonical_texts_by_the_encoder(monkeypatch):
    """plain JSON goes through the C encoder; numbers, names and constants that it prints otherwise do not."""
    odd = ["1e3", "-0.0", "-0", "1e-7", "0.00001", "12345678901234567890", "1.0e21", "1e999", "NaN", "-Infinity", "0.1", "100.0", "1.5e300", "123456789012345.6", "1e15", "999999999999999.9"]
    texts = [f'{{"b": [{x}], "a": {{"z": "t\\u0007\\"", "y": null}}}}' for x in odd]
    texts += ['{"\\u00e9": 1, "e\\u0301": "e\\u0301", "z": true}', '{"\\ud83d\\ude00": 1, "\\uffee": 2}', '{"a": 1, "a": 2}', '"\\u2028"', "[]", "{}", "3", "x", "", '{"a": "\\ud800"}', '[true, 1, 1.0, {"10": 1, "9": 2}]']

    def slow(text):
        try:
            return hashing.canonical(json.loads(text))
        except (ValueError, TypeError):
            return None

    assert [hashing.canonical_of(t) for t in texts] == [slow(t) for t in texts]
    monkeypatch.setattr(hashing, "canonical", None)
    assert hashing.canonical_of('{"b": 1.50, "a": [100.0, "x"], "signature": {}}', ("signature",)) == '{"a":[100,"x"],"b":1.5}'


def test_signatures_under_names_with_escapes(spark):
    made = signing._with_signature('{"version": "1", "x": 100.0}', bytes(range(32)))
    rows = [(made,), (made.replace('"signature"', '"\\u0073ignature"'),), ('{"version": "1", "x": 100.0}',), ('{"a": "signature"}',), ('["signature"]',)]
    assert [signing.certificate_holds(t) for (t,) in rows] == [True, True, False, False, False]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(signing.holds(F.col("t"))).collect()]
    assert got == [True, True, False, False, False]
