"""Documents, encodings, stripes, filters and log files: known answers, faults and round trips."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import erasure, filters, wire
from cairn.sources import log_files


def test_strict_json(spark):
    for good in ('{"a": 1.50}', "[]", '"x"', "1e400", "null"):
        wire.strict_json(good)
    assert wire.strict_json('{"a": 1.50}') == {"a": "1.50"}
    bad = ['{"a": 1, "a": 2}', "[1,]", "NaN", "", "{", '"\\ud800"', "[1] x"]
    for text in bad:
        with pytest.raises(ValueError):
            wire.strict_json(text)
    got = spark.createDataFrame([("[1]",), *((b,) for b in bad)], "t string").select(wire.json_valid(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in got] == [True] + [False] * len(bad)


def test_documents(spark):
    body = '<Delete xmlns="http://x/"><Quiet>true</Quiet><Object><Key>a &amp; b</Key></Object><Object><Key>c</Key><VersionId>v</VersionId></Object></Delete>'
    df = spark.createDataFrame([(1, body), (2, "<Delete>"), (3, "<Other/>")], "id long, body string")
    got = wire.document_rows(df, "body", wire.delete_batch, ["Key", "VersionId"]).orderBy("id", "place").collect()
    assert [(r["id"], r["place"], r["Key"], r["VersionId"]) for r in got] == [(1, 0, "a & b", None), (1, 1, "c", "v"), (2, None, None, None), (3, None, None, None)]
    assert got[0]["fault"] is None and got[2]["fault"]
    assert wire.completed_parts("<CompleteMultipartUpload><Part><PartNumber>1</PartNumber><ETag>e</ETag></Part></CompleteMultipartUpload>") == [{"PartNumber": "1", "ETag": "e"}]
    rules = wire.lifecycle_rules("<LifecycleConfiguration><Rule><ID>r</ID><Filter><Prefix>p/</Prefix></Filter><Status>Enabled</Status><Expiration><Days>3</Days></Expiration></Rule></LifecycleConfiguration>")
    assert (rules[0]["ID"], rules[0]["Prefix"], rules[0]["Days"]) == ("r", "p/", "3")
    listed = spark.range(1).select(wire.listing_document("b", F.array(F.struct(F.lit("k<").alias("name"), F.lit(False).alias("is_prefix"), F.lit(3).alias("size"))), F.lit(False)).alias("x")).first()["x"]
    assert "<Key>k&lt;</Key>" in listed and "<KeyCount>1</KeyCount>" in listed


def test_policies():
    text = '{"Statement": {"Effect": "Allow", "Principal": "*", "Action": ["s3:GetObject"], "Resource": "arn:x", "Condition": {"ForAnyValue:StringLikeIfExists": {"aws:k": "v*"}}}}'
    s = wire.policy_statements(text)
    assert s[0]["action"] == ["s3:GetObject"] and s[0]["conditions"] == [{"operator": "StringLike", "set": "ForAnyValue", "if_exists": True, "key": "aws:k", "values": ["v*"]}]
    assert not wire.is_public(s) and wire.is_public([s[0] | {"conditions": []}]) and not wire.may_set([s[0] | {"conditions": []}], True)
    with pytest.raises(ValueError):
        wire.policy_statements('{"Statement": [{"Effect": "Maybe"}]}')
    context = {"aws:username": "ann"}
    assert wire.substitute("home/${aws:username}/${*}", context) == "home/ann/*"
    assert wire.substitute("${aws:x, 'd'}", context) == "d" and wire.substitute("${aws:x}", context) is None


def test_bodies():
    form = b'--B\r\nContent-Disposition: form-data; name="key"\r\n\r\nv\r\n--B\r\nContent-Disposition: form-data; name="file"; filename="f"\r\n\r\nbin\r\n--X\r\n--B--\r\n'
    assert wire.form_fields(form, b"B") == [("key", None, b"v"), ("file", "f", b"bin\r\n--X")]
    assert wire.chunked_body(b"5;chunk-signature=a\r\nhello\r\n1\r\n!\r\n0\r\nx-amz-checksum-crc32: AA\r\n\r\n") == (b"hello!", {"x-amz-checksum-crc32": "AA"})
    for bad in (b"5\r\nhell", b"zz\r\n", b"5\r\nhelloXX0\r\n"):
        with pytest.raises(ValueError):
            wire.chunked_body(bad)
    with pytest.raises(ValueError):
        wire.form_fields(b"--B\r\n", b"B")


def test_signatures(spark):
    # the example key of the published version 4 documentation
    key = wire.signing_key("wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLEKEY", "20120215", "us-east-1", "iam")
    assert key.hex() == "f4780e2d9f65fa895f9c67b32ce1baf0b0d8a43505a000a1a9e090d414db404d"
    good = wire.signature("s", "20240101", "r", "text")
    rows = [("k", "20240101", "r", "text", good), ("k", "20240101", "r", "text!", good), ("other", "20240101", "r", "text", good), ("k", "20240101", "r", "text", None)]
    got = wire.signatures_hold(spark.createDataFrame(rows, "access_key string, date string, region string, to_sign string, signature string"), {"k": "s"}).collect()
    assert [r["holds"] for r in got] == [True, False, False, False]


@pytest.mark.parametrize(("data", "parity"), [(2, 1), (3, 2), (4, 2), (6, 3)])
def test_stripes(data, parity):
    rng = random.Random(data)
    block = rng.randbytes(101)
    chunks = erasure.encode(block, data, parity)
    assert len(chunks) == data + parity and b"".join(chunks[:data])[: len(block)] == block
    for lost in itertools.combinations(range(data + parity), parity):
        assert erasure.rebuild({i: c for i, c in enumerate(chunks) if i not in lost}, data, parity) == chunks
    with pytest.raises(ValueError):
        erasure.rebuild(dict(list(enumerate(chunks))[: data - 1]), data, parity)


def test_filters(spark):
    keys = [f"key{i}" for i in range(500)]
    made = filters.bloom(keys)
    assert all(filters.may_hold(made, k) for k in keys)
    assert sum(filters.may_hold(made, f"no{i}") for i in range(2000)) < 100
    df = spark.createDataFrame([(keys[:5], "key3"), (keys[:5], "other")], "ks array<string>, k string")
    assert [r["x"] for r in df.select(filters.bloom_may_hold(filters.bloom_of(F.col("ks")), F.col("k")).alias("x")).collect()] == [True, False]
    rng = random.Random(1)
    for _ in range(300):
        a, b = sorted(bytes(rng.choice([0, 1, 2, 254, 255]) for _ in range(rng.randrange(1, 6))) for _ in range(2))
        if a < b:
            s = filters.separator(a, b)
            assert a <= s < b and len(s) <= len(a)
    ips = spark.createDataFrame([("2001:db8::1",), ("2001:db9::1",), ("10.0.0.1",), ("x",)], "t string")
    assert [r["x"] for r in ips.select(filters.in_network(F.col("t"), "2001:db8::/32").alias("x")).collect()] == [True, False, False, False]


def test_log_files(spark, tmp_path):
    rng = random.Random(2)
    records = [rng.randbytes(n) for n in (0, 10, 40_000, 32_750, 5, 70_000, 1)]
    data = log_files.write(records)
    for mode in log_files.MODES:
        assert log_files.read(data, mode) == records
    cut = data[:-3]
    assert log_files.read(cut, "tolerate_tail") == log_files.read(cut, "point_in_time") == records[:-1]
    with pytest.raises(ValueError):
        log_files.read(cut, "absolute")
    hurt = bytearray(data)
    hurt[20] ^= 1  # in the second record
    assert log_files.read(bytes(hurt), "point_in_time") == records[:1]
    assert set(log_files.read(bytes(hurt), "skip_corrupted")) < set(records)
    with pytest.raises(ValueError):
        log_files.read(bytes(hurt), "tolerate_tail")
    (tmp_path / "1.log").write_bytes(data)
    got = log_files.read_logs(spark, str(tmp_path / "1.log")).orderBy("place").collect()
    assert [hashlib.md5(r["record"]).digest() for r in got] == [hashlib.md5(r).digest() for r in records]


def test_images(spark, tmp_path):
    rows = spark.range(100).selectExpr("id % 7 as k", "id as v")
    log_files.export_image(rows, str(tmp_path / "image"), ["k", "v"])
    assert sorted(map(tuple, log_files.install_image(spark, str(tmp_path / "image")).collect())) == sorted(map(tuple, rows.collect()))


def test_logs_are_summed_together(monkeypatch):
    """Checksums go over many fragments at once; one by one, six million records take hours."""
    calls = []
    plain = log_files.crcs
    monkeypatch.setattr(log_files, "crcs", lambda *a: calls.append(1) or plain(*a))
    logs = [[b"%d" % (i * k) for i in range(500)] for k in range(4)] + [[b"x" * 70_000] * 3, [], [b""]]
    data = log_files.write_all(logs)
    sums = log_files.sums_of(data)
    assert [log_files.read(d, mode, s) for d, s in zip(data, sums, strict=True) for mode in log_files.MODES] == [r for r in logs for _ in log_files.MODES]
    assert len(calls) == 2


def test_long_logs(monkeypatch):
    """A log of several windows, read with a fault in the second."""
    monkeypatch.setattr(log_files, "WINDOW", 2 * log_files.BLOCK, raising=False)
    records = [bytes([i % 256]) * 9_000 for i in range(40)]
    data = bytearray(log_files.write(records))
    assert all(log_files.read(bytes(data), mode) == records for mode in log_files.MODES)
    data[3 * log_files.BLOCK + 500] ^= 1
    assert log_files.read(bytes(data), "point_in_time") == records[: len(log_files.read(bytes(data), "point_in_time"))]
    after = log_files.read(bytes(data), "skip_corrupted")
    assert len(after) < 40 and after[-20:] == records[-20:]
    with pytest.raises(ValueError):
        log_files.read(bytes(data), "tolerate_tail")


def test_rebuilt_bodies_are_handed_on_in_pieces(spark, monkeypatch):
    """Bodies beyond a piece don't wait for the rest of their batch, and a batch has 1,000 rows at most."""
    from cairn.plans import catalogue

    monkeypatch.setattr(erasure, "PIECE", 100)
    texts = [bytes(k * i % 251 for i in range(k)) for k in (0, 1, 7, 99, 100, 101, 5_000, 100, 3)]
    for lost, whole in (([0, 1], True), ([3, 5], True), ([0, 2, 4], False)):
        df = spark.createDataFrame([(i, t, lost) for i, t in enumerate(texts)], "i int, t binary, lost array<int>").coalesce(1)
        got = {r["i"]: r["r"] for r in df.select("i", erasure.rebuilt(F.col("t"), F.col("lost"), 4, 2).alias("r")).collect()}
        assert [got[i]["body"] for i in range(len(texts))] == [bytearray(t) if whole else None for t in texts]
        assert [got[i]["chunk"] for i in range(len(texts))] == [erasure.chunk_length(len(t), 4) for t in texts]
    catalogue.queries()["erasure_rebuilt"](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
