"""Expressions and pure functions against known answers and plain models."""

import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.functions import checksums, durability, keys, requests, rules, series
from cairn.operators import dataflow, listing, merge, stats
from cairn.plans import catalogue


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("header", "size", "want"),
    [("bytes=4-7", 11, ("part", 4, 7)), ("bytes=4-", 11, ("part", 4, 10)), ("bytes=-3", 11, ("part", 8, 10)), ("bytes=-0", 11, ("unsatisfiable", None, None)), ("bytes=11-", 11, ("unsatisfiable", None, None)), ("bytes=7-4", 11, ("whole", None, None)), ("bytes=0-1,3-4", 11, ("whole", None, None)), (None, 11, ("whole", None, None)), ("bytes=0-0", 0, ("unsatisfiable", None, None)), ("bytes=-20", 11, ("part", 0, 10)), ("bytes=2-99", 11, ("part", 2, 10)), ("bytes=-", 11, ("whole", None, None))],
)
def test_byte_span(spark, header, size, want):
    df = spark.createDataFrame([(header, size)], "h string, n long")
    assert tuple(df.select(requests.byte_span(F.col("h"), F.col("n")).alias("x")).first()["x"]) == want


def test_crc_vectors():
    check = b"123456789"
    assert int(checksums.crcs("crc32c", [check])[0]) == 0xE3069283
    assert int(checksums.crcs("crc64nvme", [check])[0]) == 0xAE8B14860A799888
    assert int(checksums.crcs("crc32", [check, b""])[0]) == zlib.crc32(check)
    assert int(checksums.crcs("crc32", [b""])[0]) == 0


@pytest.mark.parametrize("kind", list(checksums.POLYNOMIALS))
def test_crc_combines(kind):
    rng = random.Random(1)
    for _ in range(20):
        a, b = (rng.randbytes(rng.randrange(0, 90)) for _ in range(2))
        ca, cb, whole = (int(x) for x in checksums.crcs(kind, [a, b, a + b]))
        assert checksums.combine(kind, ca, cb, len(b)) == whole


def test_xxh(spark):
    assert one(spark, checksums.xxh("xxh64", F.col("t")), t="abc") == xxhash.xxh64_hexdigest(b"abc")


def test_version_ids(spark):
    assert one(spark, keys.version_id(F.col("n")), n=0) == "0" * 13
    assert one(spark, keys.version_id(F.col("n")), n=33) == "0" * 11 + "11"
    assert int(one(spark, keys.parse_version_id(F.col("t")), t="0000000000011")) == 33
    assert int(one(spark, keys.parse_version_id(F.col("t")), t="FZZZZZZZZZZZZ")) == (1 << 64) - 1
    for bad in ("G000000000000", "U000000000000", "short"):
        assert one(spark, keys.parse_version_id(F.col("t")), t=bad) is None


def test_names_and_encoding(spark):
    assert one(spark, keys.percent_encode(F.col("t")), t="foo+1/ a~*(é)") == "foo%2B1/%20a~%2A%28%C3%A9%29"
    assert one(spark, keys.human_size(F.col("n")), n=1 << 20) == "1 MiB"
    assert one(spark, keys.human_size(F.col("n")), n=1536) == "1536 B"
    for name, valid in {"abc": True, "a.b-c": True, "ab": False, "A.bc": False, "a..b": False, "1.2.3.4": False, "xn--aa": False, "aa-s3alias": False}.items():
        assert one(spark, keys.bucket_name_valid(F.col("t")), t=name) is valid, name


def test_tokens_round_trip(spark):
    for key in ("a/b", "ü/☃", "x" * 50, ""):
        df = spark.createDataFrame([(key,)], "k string").select(listing.token("p", F.col("k")).alias("t"))
        assert df.select(listing.token_start(F.col("t")).alias("k")).first()["k"] == key
    assert one(spark, listing.token_start(F.col("t")), t="!!") is None


def test_due_dates(spark):
    day = rules.DAY
    at = lambda start, days: one(spark, rules.due(F.col("s"), F.col("d")), s=start, d=days)
    assert at(0, 0) == 0 and at(1, 0) == day and at(day, 1) == 2 * day and at(day - 1, 30) == 31 * day
    assert at((1 << 63) - 10, 5) == (1 << 63) - 1


def test_wildcards(spark):
    for pattern, text, want in [("a*c", "abbc", True), ("a?c", "abc", True), ("a?c", "abbc", False), ("a.c", "abc", False), ("*", "", True), ("%_", "xy", False), ("a\\*", "a\\b", True)]:
        assert one(spark, F.col("t").rlike(rules.wildcard(pattern)), t=text) is want, pattern


def test_conditions_without_the_key(spark):
    none = F.lit(None).cast("array<string>")
    assert one(spark, rules.condition("StringEquals", none, ["a"]), t="") is False
    assert one(spark, rules.condition("StringEquals", none, ["a"], negated=True), t="") is True
    assert one(spark, rules.condition("StringEquals", none, ["a"], if_exists=True), t="") is True
    assert one(spark, rules.condition("StringEquals", none, ["a"], quantifier="any"), t="") is False
    assert one(spark, rules.condition("Null", none, ["true"]), t="") is True
    assert one(spark, rules.in_cidr(F.col("t"), F.lit("10.1.0.0"), 16), t="10.1.255.3") is True
    assert one(spark, rules.in_cidr(F.col("t"), F.lit("10.1.0.0"), 16), t="no") is False


def test_locks(spark):
    lock = lambda mode, until, hold, bypass: one(spark, rules.locked(F.lit(mode), F.lit(until), F.lit(hold), F.lit(5), F.lit(bypass)), t="")
    assert lock("COMPLIANCE", 9, None, True) is True
    assert lock("GOVERNANCE", 9, None, True) is False
    assert lock("GOVERNANCE", 9, None, False) is True
    assert lock("GOVERNANCE", 4, None, False) is False
    assert lock(None, None, True, True) is True


def test_dip_and_runs():
    n = 20
    assert series.dip(np.arange(n)) == pytest.approx(1 / (2 * n))
    assert series.dip(np.array([0.0] * 10 + [1.0] * 10)) == pytest.approx(0.25)
    assert series.dip(np.ones(8)) == 0.0
    rng = np.random.default_rng(3)
    two = np.concatenate([rng.normal(0, 1, 30), rng.normal(20, 1, 30)])
    assert series.judge(rng.permutation(two))["states"] == 2
    assert series.judge(rng.normal(0, 1, 60))["states"] == 1
    assert series.judge(np.arange(40.0))["order"] == "persistent"
    assert series.judge(np.array([0.0, 1.0] * 20))["order"] == "alternating"
    assert series.median_ranks(5) is None and series.median_ranks(6) == (1, 6)
    assert series.critical_dip(12) == pytest.approx((math.sqrt(10) * 0.1394 + 0.4 * (math.sqrt(15) * 0.1179 - math.sqrt(10) * 0.1394)) / math.sqrt(12))


def test_durability():
    # two copies, rates by hand: (3f + r) / (2 f^2)
    f, r = 1e-3, 0.5
    assert durability.mean_time_to_loss(durability.chain(1, 1, f, r)) == pytest.approx((3 * f + r) / (2 * f * f))
    assert durability.loss_within(durability.chain(1, 0, f, r), 100.0) == pytest.approx(1 - math.exp(-0.1), rel=1e-9)
    loose, tight = durability.choose(15, f / 100, 1.0, 1e-2), durability.choose(15, f / 100, 1.0, 1e-20)
    assert loose[3] and (loose[0] + loose[1]) / loose[0] <= (tight[0] + tight[1]) / tight[0]
    assert durability.choose(0, f, r, 1e-3) is None


def test_histogram_bounds(spark):
    values = [0, 1, 31, 32, 33, 63, 64, 1000, 123_456_789, (1 << 41) - 1, 1 << 41]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", stats.bucket_of(F.col("v")).alias("b"))
    for row in df.withColumn("u", stats.upper_bound(F.col("b"))).collect():
        assert row["u"] >= row["v"]
        assert row["v"] >= 1 << 41 or row["u"] <= row["v"] + max(0, row["v"] >> 5)


def test_clock_model(spark):
    rng, rows, last, want = random.Random(4), [], -1, {}
    for i in range(200):
        at = rng.randrange(150)
        last = max(at, last + 1)
        rows.append(("r", i, at))
        want[i] = last
    got = dataflow.monotone_clock(spark.createDataFrame(rows, "r string, i long, at long"), ["r"], "i", "at").collect()
    assert {x["i"]: x["tick"] for x in got} == want


def test_merge_model(spark):
    rng, rows, model = random.Random(5), [], {}
    for seq in range(500):
        key, marker = f"k{rng.randrange(60)}", rng.random() < 0.3
        rows.append(("b", key, seq, marker))
        model[key] = None if marker else seq
    df = spark.createDataFrame(rows, "bucket string, key string, seq long, marker boolean")
    got = {r["key"]: r["seq"] for r in merge.merge_runs([df.where(F.col("seq") % 4 == k) for k in range(4)], ["bucket", "key"]).collect()}
    assert got == {k: v for k, v in model.items() if v is not None}


def test_shares():
    assert series.share_interval(3, 10) == pytest.approx((0.06674, 0.65245), abs=1e-4)
    assert series.share_interval(0, 5)[0] == 0.0 and series.share_interval(5, 5)[1] == 1.0


def test_series_are_judged_whole(spark, tmp_path):
    """120 rounds of one user are one series, as in the reference; one more is untested."""
    import datetime

    at = datetime.datetime(2024, 1, 1)
    rows = [(n, at + datetime.timedelta(seconds=n), user, "click", float(n % 7 + (n // 60) * 3), '{"k": 1}') for n, user in enumerate([1] * 120 + [2] * 121 + [3] * 9)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["user_id"]: r for r in catalogue.queries()["series_judged"](spark, str(tmp_path)).collect()}
    assert {u: r["rounds"] for u, r in got.items()} == {1: 120, 2: 121, 3: 9}
    assert got[1]["order"] == "persistent" and got[1]["low"] is not None and got[2]["order"] == got[3]["order"] == "untested"


def test_crcs_move_by_steps_made_once(monkeypatch):
    """Combining makes no matrix anew for each row, and long bodies are cut into pieces."""
    def plain_crc(polynomial: int, width: int, data: bytes) -> int:
        state = (1 << width) - 1
        for x in data:
            state ^= x
            for _ in range(8):
                state = state >> 1 ^ (polynomial if state & 1 else 0)
        return state ^ (1 << width) - 1

    rng = np.random.default_rng(3)
    body = rng.integers(0, 256, 3 * checksums.LANE + 7, dtype=np.uint8).tobytes()
    for kind, (polynomial, width) in checksums.POLYNOMIALS.items():
        for cut in (0, 1, checksums.LANE, checksums.LANE + 1, len(body)):
            a, b, whole = (int(x) for x in checksums.crcs(kind, [body[:cut], body[cut:], body]))
            assert whole == plain_crc(polynomial, width, body) and checksums.combine(kind, a, b, len(body) - cut) == whole
            assert int(checksums.moved(kind, np.array([a], np.uint64), np.array([len(body) - cut]))[0]) ^ b == whole
    checksums.combine("crc64nvme", 5, 7, (1 << 12) - 1)
    calls, plain = [], checksums._times
    monkeypatch.setattr(checksums, "_times", lambda *a: calls.append(1) or plain(*a))
    checksums.combine("crc64nvme", 5, 7, (1 << 12) - 1)
    assert len(calls) <= 12


def plain_dip(values) -> float:
    """The dip with every hull made anew: the least over modes of how far steps rise over a minorant before it or fall under a majorant after it."""
    xs = sorted(values)
    n, best = len(xs), math.inf

    def over(points, x):
        """The greatest convex minorant of points at x, as the least of all chords."""
        at = [y for a, y in points if a == x]
        return min(at + [ya + (yb - ya) * (x - a) / (b - a) for a, ya in points for b, yb in points if a < x < b])

    for mode in sorted(set(xs)):
        left = [(x, i) for i, x in enumerate(xs) if x <= mode]
        right = [(-x, n - 1 - i) for i, x in enumerate(xs) if x >= mode]
        gaps = [0.0]
        for points in (left, right):
            for x, i in points:
                if x != max(p[0] for p in points):
                    gaps.append(i + 1 - over(points, x))
        best = min(best, max(gaps))
    return best / (2 * n)


def test_dip_is_found_in_one_pass():
    import time

    rng = np.random.default_rng(6)
    for n in (2, 3, 7, 12, 20):
        for values in (rng.normal(size=n), np.round(rng.normal(size=n)), np.concatenate([rng.normal(size=n), 9 + rng.normal(size=n)])):
            if len(set(values)) > 1:
                assert series.dip(values) == pytest.approx(plain_dip(values.tolist()))
    many = [np.round(rng.exponential(10, 100), 2) for _ in range(100)]
    begun = time.process_time()
    for values in many:
        series.dip(values)
    assert time.process_time() - begun < 1  # a few seconds with every hull made anew


def test_shares_are_solved_once():
    series.share_interval.cache_clear()
    for _ in range(5):
        series.share_interval(31, 67)
    assert series.share_interval.cache_info().misses == 1


def test_series_cross_batches(spark, tmp_path):
    """A series that spans batches of rows is one series, and users without a number are one."""
    import datetime

    at = datetime.datetime(2024, 1, 1)
    rows = [(n, at + datetime.timedelta(seconds=n), user, "click", float(n % 7), '{"k": 1}') for n, user in enumerate([1] * 50 + [2] * 3 + [None] * 20 + [3] * 33)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    bound = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(bound)
    spark.conf.set(bound, "7")
    try:
        for name in ("series_judged", "series_enough"):
            got = {r["user_id"]: r["rounds"] for r in catalogue.queries()[name](spark, str(tmp_path)).collect()}
            assert got == {1: 50, 2: 3, None: 20, 3: 33}
    finally:
        spark.conf.set(bound, before)
