"""Queries that SQL can't express against plain versions of them, and those that fold over whole tables on small fixtures."""

import base64
import datetime
import hashlib
import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.functions import checksums, durability, filters, keys, requests, rules, series, wire
from cairn.operators import dataflow, merge
from cairn.plans import catalogue
from cairn.sources.views import Lake

FOLDER = "/root/testdata/sf0.001"


def rows(spark, name, folder=FOLDER):
    return catalogue.queries()[name](spark, str(folder)).collect()


@pytest.fixture(scope="module")
def bodies(spark):
    return {r["object"]: (r["body"] or "").encode() for r in Lake(spark, FOLDER).objects().collect()}


def plain_crc(polynomial, width, data):
    state = (1 << width) - 1
    for byte in data:
        state ^= byte
        for _ in range(8):
            state = state >> 1 ^ (polynomial if state & 1 else 0)
    return state ^ (1 << width) - 1


def test_checksums_of_objects(spark, bodies):
    for r in rows(spark, "crc32_objects"):
        assert r["crc32"] == f"{zlib.crc32(bodies[r['object']]):08x}" and r["sha512"] == hashlib.sha512(bodies[r["object"]]).hexdigest()
    short = {r["object"]: r for r in rows(spark, "crc_objects") if len(bodies[r["object"]]) < 3000}
    assert len(short) > 50
    for o, r in short.items():
        for kind in ("crc32c", "crc64nvme"):
            polynomial, width = checksums.POLYNOMIALS[kind]
            assert int(r[kind], 16) == plain_crc(polynomial, width, bodies[o])
    for r in rows(spark, "xxh_objects"):
        b = bodies[r["object"]]
        assert (r["xxh64"], r["xxh3_64"], r["xxh3_128"]) == (xxhash.xxh64_hexdigest(b), xxhash.xxh3_64_hexdigest(b), xxhash.xxh3_128_hexdigest(b))


def test_every_algorithm(spark, bodies):
    plain = {"CRC32": lambda b: f"{zlib.crc32(b):08x}", "SHA1": lambda b: hashlib.sha1(b).hexdigest(), "SHA256": lambda b: hashlib.sha256(b).hexdigest(), "SHA512": lambda b: hashlib.sha512(b).hexdigest(), "MD5": lambda b: hashlib.md5(b).hexdigest(), "XXHASH64": xxhash.xxh64_hexdigest, "XXHASH3": xxhash.xxh3_64_hexdigest, "XXHASH128": xxhash.xxh3_128_hexdigest}
    got = rows(spark, "checksum_all")
    assert {r["algorithm"] for r in got} == set(checksums.ALGORITHMS)
    assert all(r["digest"] == plain[r["algorithm"]](bodies[r["object"]]) for r in got if r["algorithm"] in plain)


def test_full_objects(spark):
    parts: dict[int, dict[int, str]] = {}
    for r in Lake(spark, FOLDER).parts().collect():
        held = parts.setdefault(r["upload"], {})
        held[r["part"]] = min(held.get(r["part"], r["body"]), r["body"])
    polynomial, width = checksums.POLYNOMIALS["crc32c"]
    for r in rows(spark, "full_object_crc"):
        whole = "".join(parts[r["upload"]][n] for n in sorted(parts[r["upload"]])).encode()
        assert int(r["crc32c"], 16) == plain_crc(polynomial, width, whole)


def test_series_by_hand(spark):
    values: dict[int, list] = {}
    for r in Lake(spark, FOLDER).version_log().collect():
        values.setdefault(r["user_id"], []).append((r["seq"], r["value"]))
    for r in rows(spark, "series_judged"):
        xs = [v for _, v in sorted(values[r["user_id"]])]
        mean = sum(xs) / len(xs)
        spread = sum((x - mean) ** 2 for x in xs)
        assert r["rounds"] == len(xs) and r["lag1"] == pytest.approx(sum((a - mean) * (b - mean) for a, b in zip(xs, xs[1:], strict=False)) / spread if spread else 0.0)
        if len(xs) > 1 and r["runs"] is not None:
            middle = float(np.median(xs))
            marks = [x > middle for x in xs if x != middle]
            assert r["runs"] == 1 + sum(a != b for a, b in zip(marks, marks[1:], strict=False))
        tails = [j for j in range(1, len(xs) // 2 + 1) if sum(math.comb(len(xs), i) for i in range(j)) * 40 <= 2 ** len(xs)]
        low = sorted(xs)[max(tails) - 1] if tails and len(xs) <= series.MAX_ROUNDS else None
        assert r["low"] == low
    for r in rows(spark, "series_enough"):
        xs = np.array([v for _, v in sorted(values[r["user_id"]])])
        assert r["enough"] == series.enough(xs, 10, 80, 0.15) and (len(xs) < 80 or r["enough"]) and (len(xs) >= 10 or not r["enough"])


def test_run_shares_are_exact():
    import itertools

    for ups, downs in ((1, 1), (2, 3), (4, 4), (1, 6)):
        n = ups + downs
        counts = np.zeros(n + 1)
        for at in itertools.combinations(range(n), ups):
            marks = [i in at for i in range(n)]
            counts[1 + sum(a != b for a, b in zip(marks, marks[1:], strict=False))] += 1
        np.testing.assert_allclose(series.run_shares(ups, downs), counts / counts.sum(), atol=1e-12)
    assert series.run_shares(60, 60).sum() == pytest.approx(1)


def test_durability_by_chance(spark):
    """Loss of two copies against many small steps of the chain; the upper end lies above and close."""
    f, repair = 2e-3, 0.05
    q = durability.chain(1, 1, f, repair)
    step = np.eye(3) + 0.01 * (q - np.diag(q.sum(axis=1)))
    plain = np.linalg.matrix_power(step, 100_00)[0, 2]
    assert durability.loss_within(q, 100.0) == pytest.approx(plain, rel=1e-3)
    for hours in (1.0, 100.0, durability.YEAR):
        low, high = durability.loss_within(q, hours), durability.loss_upper(q, hours)
        assert low < high <= low * (1 + 1e-6)
    for r in rows(spark, "durability_choice"):
        got = durability.choose(int(r["domains"]), r["failures"] / durability.YEAR, 1 / r["hours"], 1e-9)
        assert (r["data"], r["parity"], r["meets"]) == (got[0], got[1], got[3]) and (r["loss"] <= 1e-9) == r["meets"]


def test_placement_by_hand(spark):
    mask = (1 << 64) - 1

    def draw(words):
        x = 0
        for word in words:
            z = ((x ^ word) + 0x9E3779B97F4A7C15) & mask
            z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & mask
            z = ((z ^ z >> 27) * 0x94D049BB133111EB) & mask
            x = z ^ z >> 31
        return x

    volumes = [(1, "a", 100.0), (2, "a", 300.0), (3, "b", 200.0), (4, "b", 0.0), (5, "c", 50.0)]
    got = dataflow.placement(spark.range(40).withColumnRenamed("id", "block"), spark.createDataFrame(volumes, "volume long, domain string, bytes double")).collect()
    for block in range(40):
        key = {v: math.log(((draw([block, 0, v, 0]) >> 11) + 1) / (1 << 53)) / s if s > 0 else -math.inf for v, _, s in volumes}
        best = {d: max((v for v, e, _ in volumes if e == d), key=lambda v: (key[v], -v)) for d in "abc"}
        order = sorted(volumes, key=lambda v: (v[2] <= 0, best[v[1]] != v[0], -key[v[0]], v[0]))
        assert [r["volume"] for r in sorted((r for r in got if r["block"] == block), key=lambda r: r["place"])] == [v for v, _, _ in order]
    assert len(rows(spark, "placement_order")) > 0


def test_whole_tables_on_a_fixture(spark, tmp_path):
    """Blocks without extents, and blocks that only released files hold: every extent counts, however short."""
    at = datetime.datetime(2024, 1, 1)
    extents = [(1, 10, 1, 1, 2.0), (2, 10, 1, 1, 50.0), (2, 11, 1, 1, 50.0), (3, 12, 1, 1, 1.0), (2, 12, 1, 2, 50.0), (2, 13, 1, 3, 1.0), (2, 13, 2, 4, 1.0)]
    spark.createDataFrame([(o, p, s, n, q, 1.0, 0.0, 0.0, "N", "O", at) for o, p, s, n, q in extents], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, "x") for p in (10, 11, 12, 13, 14, 15)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 1, "P", 1.0, at, "x"), (2, 1, "F", 1.0, at, "x"), (3, 1, "O", 1.0, at, "x")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(r["block"] for r in rows(spark, "orphan_blocks", tmp_path)) == [14, 15]
    assert sorted((r["block"], r["extents"]) for r in rows(spark, "reclaim_cascade", tmp_path)) == [(11, 1), (13, 2)]


def test_ordered_joins(spark, monkeypatch):
    import random

    rng = random.Random(3)
    starts = [(rng.choice("ab"), f"{rng.randrange(10**6):06d}") for _ in range(700)]
    asked = [(rng.choice("abc"), f"{rng.randrange(10**6):06d}") for _ in range(900)]
    frames = spark.createDataFrame(asked, "by string, key string"), spark.createDataFrame(starts, "by string, start string")
    for marks in (4, 128):
        monkeypatch.setattr(merge, "MARKS", marks)
        monkeypatch.setattr(merge.cuts, "__defaults__", (marks,))
        low = {(r["by"], r["key"]): r["start"] for r in merge.floor_join(*frames, by=["by"]).collect()}
        high = {(r["by"], r["key"]): r["start"] for r in merge.ceil_join(*frames, by=["by"]).collect()}
        for b, k in asked:
            assert low[b, k] == max((s for x, s in starts if x == b and s <= k), default=None)
            assert high[b, k] == min((s for x, s in starts if x == b and s >= k), default=None)
    everywhere = merge.floor_join(frames[0], frames[1].select("start")).collect()
    assert len(everywhere) == len(asked) and all(r["start"] == max((s for _, s in starts if s <= r["key"]), default=None) for r in everywhere)
    assert merge.floor_join(frames[0], frames[1].limit(0), by=["by"]).where("start is not null").count() == 0


def test_clock_over_stretches(spark, monkeypatch):
    import random

    monkeypatch.setattr(dataflow, "STRETCH", 7)
    rng, want, log = random.Random(9), {}, []
    for r in ("x", "y", None):
        last = -1
        for i in sorted(rng.sample(range(300), 90)):
            at = rng.randrange(200)
            last = max(at, last + 1)
            log.append((r, i, at))
            want[r, i] = last
    # places are dense whatever the order's gaps
    got = dataflow.monotone_clock(spark.createDataFrame(log, "r string, i long, at long"), ["r"], "i", "at").collect()
    assert {(x["r"], x["i"]): x["tick"] for x in got} == want


def test_bounds_are_checked(spark, monkeypatch):
    monkeypatch.setattr(rules, "MOST_RULES", 2)
    many = spark.range(3).selectExpr("cast(id as int) as ordinal", "'r' as rule")
    with pytest.raises(ValueError):
        rules.earliest(spark.range(1).withColumn("k", F.lit(1)), many, F.lit(True), F.lit(1), ["k"])


def test_wire_forms(spark):
    one = lambda column: spark.range(1).select(column.alias("x")).first()["x"]
    assert one(wire.json_compact(F.lit('{"a": [1.0, 1e5, "x\\u00e9"], "b": {"c": null, "a": true}}'))) == '{"a":[1.0,1e5,"xé"],"b":{"c":null,"a":true}}'
    assert one(wire.json_compact(F.lit('{"a": 1, "a": 2}'))) is None
    assert wire.grants('<AccessControlPolicy><Owner><ID>o</ID></Owner><AccessControlList><Grant><Grantee><URI>u</URI></Grantee><Permission>READ</Permission></Grant></AccessControlList></AccessControlPolicy>') == [{"owner": "o", "kind": "uri", "grantee": "u", "permission": "READ"}]
    with pytest.raises(ValueError):
        wire.grants("<AccessControlPolicy><AccessControlList><Grant><Permission>READ</Permission></Grant></AccessControlList></AccessControlPolicy>")
    context = F.create_map(F.lit("aws:username"), F.lit("a*n"))
    filled = lambda w: one(wire.filled(F.lit(w), context))
    for written in ("home/${aws:username}/${*}", "${AWS:UserName }x", "${aws:x, 'd, e'}", "${aws:x}", "open ${aws", "a${$}b"):
        assert filled(written) == wire.substitute(written.replace("AWS:UserName ", "aws:username"), {"aws:username": "a*n"}) or written.startswith(("open", "${aws:x, 'd"))
    assert filled("open ${aws") == "open ${aws" and filled("${aws:x, 'd, e'}") == "d, e"
    matches = lambda w, t: one(wire.filled_matches(F.lit(w), context, F.lit(t)))
    assert matches("x/${aws:username}/*", "x/a*n/y") and not matches("x/${aws:username}/*", "x/abn/y") and matches("\\Q?\\E", "\\Qz\\E")


def test_signature_by_hand(spark):
    """A signed request's text and signature, built step by step."""
    import hmac

    at = 1_704_164_645
    sent = spark.createDataFrame([(at, "/b/k", "b=2&a=1", "x-amz-date:d\nhost:h", "00" * 32)], "at long, path string, query string, headers string, payload string")
    got = wire.signed(sent, "k", "s", "r").first()["signature"]
    request = "GET\n/b/k\na=1&b=2\nhost:h\nx-amz-date:d\n\nhost;x-amz-date\n" + "00" * 32
    text = "AWS4-HMAC-SHA256\n20240102T030405Z\n20240102/r/s3/aws4_request\n" + hashlib.sha256(request.encode()).hexdigest()
    key = b"AWS4s"
    for part in ("20240102", "r", "s3", "aws4_request"):
        key = hmac.new(key, part.encode(), hashlib.sha256).digest()
    assert got == hmac.new(key, text.encode(), hashlib.sha256).hexdigest()
    asked = sent.withColumns({"access_key": F.lit("k"), "region": F.lit("r"), "signature": F.lit(got), "now": F.lit(at + 5)})
    verdict = lambda df: wire.verified(df, {"k": "s"}, "r").first()["verdict"]
    assert verdict(asked) == "Holds" and verdict(asked.withColumn("path", F.lit("/b/other"))) == "Mismatch" and verdict(asked.withColumn("now", F.lit(at + 5000))) == "Expired"


def test_texts_and_lengths(spark):
    one = lambda column: spark.range(1).select(column.alias("x")).first()["x"]
    assert [one(keys.count_text(F.lit(n))) for n in (950, 13_500, 1_020_000)] == ["950", "13.5K", "1.02M"]
    assert one(keys.rate_text(F.lit(10_600_000_000))) == "10.6 GB/s"
    assert [one(keys.client_id(F.lit(n))) for n in ("client-7", "client-0", "client-07", "client-+7", "client-", "node-7", "client-18446744073709551616")] == [7] + [None] * 6
    assert one(keys.client_id(F.lit("client-18446744073709551615"))) == (1 << 64) - 1
    for plain in (0, 1, 65_535, 65_536, 65_537, 10_000_000):
        sealed = plain + 16 * max(1, -(-plain // 65_536))
        assert one(keys.sealed_size(F.lit(plain).cast("long"))) == sealed and one(keys.plain_size(F.lit(sealed).cast("long"))) == plain
    assert one(keys.plain_size(F.lit(0).cast("long"))) is None and one(keys.plain_size(F.lit(15).cast("long"))) is None
    assert [one(requests.parse_iso(F.lit(t))) for t in ("2017-02-30T00:00:00Z", "2017-09-27T00:00:00", "2017-09-27T00:00:00.1234567891Z", "2017-09-27T00:00:00+02:60")] == [None] * 4
    assert tuple(one(requests.parse_iso(F.lit("2017-09-27T02:00:00.5+02:00")))) == (1_506_470_400, 500_000_000)
    for a, b in (("abc", "abe"), ("ab", "ac"), ("a", "b"), ("abc1", "abc2"), ("abz", "ac"), ("k", "k1")):
        got = one(keys.separator(F.lit(a), F.lit(b)))
        assert a <= got < b and got == filters.separator(a.encode(), b.encode()).decode()
    for ip, network, inside in (("::1", "::/0", True), ("1::", "1::/16", True), ("1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:0/112", True), ("1:2:3:4:5:6:7", "1::/16", False), ("1::2::3", "::/0", False), ("10.0.0.1", "0.0.0.0/0", True), ("::ffff", "0.0.0.0/0", False), ("", "::/0", False)):
        assert one(rules.in_network(F.lit(ip), network)) is inside, ip
    assert base64.b64encode(b"view") == b"dmlldw=="


def test_range_filter_misses_nothing(spark):
    import random

    rng = random.Random(8)
    keys_ = sorted({"".join(rng.choice("ab/") for _ in range(rng.randrange(1, 7))) for _ in range(60)})
    spans = sorted({tuple(sorted(("".join(rng.choice("ab/c") for _ in range(rng.randrange(1, 7))), "".join(rng.choice("ab/c") for _ in range(rng.randrange(1, 7)))))) for _ in range(200)})
    spans = [(a, b) for a, b in spans if a < b]
    marks = merge.range_filter(spark.createDataFrame([("x", k) for k in keys_], "by string, key string"), ["by"])
    got = {(r["low"], r["high"]): r["may_hold"] for r in merge.may_hold(spark.createDataFrame([("x", *s) for s in spans], "by string, low string, high string"), marks, ["by"]).collect()}
    truth = {(a, b): any(a <= k < b for k in keys_) for a, b in spans}
    assert all(got[s] or not truth[s] for s in spans) and sum(got[s] != truth[s] for s in spans) < len(spans) / 4 and not all(got.values())


def test_varints_and_slices(spark):
    one = lambda column: spark.range(1).select(column.alias("x")).first()["x"]
    for n in (0, 1, 127, 128, 300, (1 << 62) + 5):
        digits = one(keys.varint(F.lit(n).cast("long")))
        plain, left = [], n
        while True:
            plain.append((left & 127) | (128 if left > 127 else 0))
            left >>= 7
            if not left:
                break
        assert bytes.fromhex(digits) == bytes(plain) and tuple(one(keys.read_varint(F.lit(digits + "00")))) == (n, len(plain))
    assert one(keys.read_varint(F.lit("ffff"))) is None
    assert one(keys.read_slice(keys.sliced(F.lit("é" * 100)))) == "é" * 100 and one(keys.read_slice(F.lit("05616263"))) is None


def events(spark, folder, ids, user=lambda n: n % 8):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    rows = [(n, at + datetime.timedelta(seconds=k), user(n), "click", 1.0, '{"k": 1}') for k, n in enumerate(ids)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")


def test_cubes_beyond_a_long_are_written_whole(spark, tmp_path):
    ids = [0, 1, 99_999, 416_127, 416_128, 2_097_151, 2_097_152, 2_642_246, 6_000_000, 36_000_000]
    events(spark, tmp_path, ids)
    got = {r["seq"]: r for r in catalogue.queries()["varints"](spark, str(tmp_path)).collect()}
    assert sorted(got) == ids
    for n in ids:
        left, plain = n**3, []
        while True:
            plain.append((left & 127) | (128 if left > 127 else 0))
            left >>= 7
            if not left:
                break
        assert bytes.fromhex(got[n]["digits"]) == bytes(plain) and got[n]["number"] == (n**3 if n**3 < 1 << 63 else None)


def test_filters_grow_with_their_keys(spark, tmp_path):
    """A filter of 20,000 keys takes few strangers for its own too."""
    events(spark, tmp_path, range(20_000), user=lambda n: 4 * n)
    assert [tuple(r) for r in catalogue.queries()["bloom_buckets"](spark, str(tmp_path)).collect()] == [("b0", True, True)]
