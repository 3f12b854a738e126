"""Queries on statistics, durability, background work and sessions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import durability, series
from cairn.operators import dataflow, stats
from cairn.sources.views import Lake

from .registry import query
from .sql import over

DAY = 86_400_000_000
# the low 64 bits of a product, by halves of the first factor
_MUL = "CAST((CAST({a} AS HUGEINT) % 4294967296 * {b} + ((CAST({a} AS HUGEINT) // 4294967296 * {b}) % 4294967296) * 4294967296) % 18446744073709551616 AS UBIGINT)"


def _mixed(name: str, source: str, start: str, keep: str) -> str:
    """Three steps in SQL that make a SplitMix64 word of a state, as views called name1 to name4."""
    first = f"{name}1 AS (SELECT {keep}, CAST((CAST({start} AS HUGEINT) + 11400714819323198485) % 18446744073709551616 AS UBIGINT) AS z FROM {source})"
    second = f"{name}2 AS (SELECT {keep}, " + _MUL.format(a="xor(z, z >> 30)", b="13787848793156543929") + f" AS z FROM {name}1)"
    third = f"{name}3 AS (SELECT {keep}, " + _MUL.format(a="xor(z, z >> 27)", b="10723151780598845931") + f" AS z FROM {name}2)"
    return ", ".join([first, second, third, f"{name}4 AS (SELECT {keep}, xor(z, z >> 31) AS x FROM {name}3)"])


BUCKET = """CASE WHEN v < 32 THEN v ELSE (floor(log2(v)) - 4) * 32 + ((v >> CAST(floor(log2(v)) - 5 AS INT)) & 31) END"""
LATENCIES = "lat AS (SELECT kind, greatest(size, 0) AS v FROM version_log)"
HIST = f"hist AS (SELECT kind, CAST({BUCKET} AS INT) AS bucket, count(*) AS n, max(v) AS most FROM lat GROUP BY 1, 2)"
BOUND = "CASE WHEN bucket < 32 THEN CAST(bucket AS BIGINT) ELSE ((32 + CAST(bucket % 32 AS BIGINT)) << (bucket // 32 - 1)) + (CAST(1 AS BIGINT) << (bucket // 32 - 1)) - 1 END"


def latencies(lake: Lake) -> DataFrame:
    return lake.version_log().select("kind", F.greatest("size", F.lit(0).cast("long")).alias("v"))


@query("latency_histogram", over("version_log", LATENCIES, HIST, body="SELECT kind, bucket, n, most FROM hist"))
def latency_histogram(lake: Lake) -> DataFrame:
    return stats.histogram(latencies(lake), F.col("v"), ["kind"])


@query("latency_quantiles", over("version_log", LATENCIES, HIST, "run AS (SELECT *, sum(n) OVER (PARTITION BY kind ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY kind) AS total, max(most) OVER (PARTITION BY kind) AS top FROM hist)", body="SELECT kind, " + ", ".join(f"CAST(least(min(CASE WHEN seen >= greatest(1, (total * {p} + 999999) // 1000000) THEN {BOUND} END), max(top)) AS BIGINT) AS q{p}" for p in (500_000, 990_000, 999_000)) + ", CAST(max(total) AS BIGINT) AS n FROM run GROUP BY kind"))
def latency_quantiles(lake: Lake) -> DataFrame:
    return stats.quantiles(stats.histogram(latencies(lake), F.col("v"), ["kind"]), ["kind"], [500_000, 990_000, 999_000])


@query("series_median", over("version_log", body="SELECT user_id, round(median(value), 6) AS median, count(*) AS n FROM version_log GROUP BY user_id"))
def series_median(lake: Lake) -> DataFrame:
    return stats.medians(lake.version_log(), ["user_id"], "value").select("user_id", F.round("median", 6).alias("median"), "n")


@query("series_t_interval", over("version_log", body="SELECT user_id, round(avg(value), 6) AS mean, round((CASE " + " ".join(f"WHEN count(*) = {k + 2} THEN {t}" for k, t in enumerate(series.T95)) + " ELSE 1.96 END) * stddev_samp(value) / sqrt(count(*)) / avg(value), 6) AS spread FROM version_log GROUP BY user_id HAVING count(*) >= 2"))
def series_t_interval(lake: Lake) -> DataFrame:
    g = lake.version_log().groupBy("user_id").agg(F.avg("value").alias("m"), F.count("*").alias("n"), F.stddev_samp("value").alias("s")).where("n >= 2")
    return g.select("user_id", F.round("m", 6).alias("mean"), F.round(stats.t_interval(F.col("n"), F.col("m"), F.col("s")), 6).alias("spread"))


@query("series_lag1", over("version_log", "d AS (SELECT user_id, seq, value - avg(value) OVER (PARTITION BY user_id) AS d FROM version_log)", "p AS (SELECT user_id, d, lead(d) OVER (PARTITION BY user_id ORDER BY seq) AS e FROM d)", body="SELECT user_id, round(CASE WHEN sum(d * d) > 0 THEN coalesce(sum(d * e), 0) / sum(d * d) ELSE 0 END, 6) AS lag1 FROM p GROUP BY user_id"))
def series_lag1(lake: Lake) -> DataFrame:
    return stats.lag1(lake.version_log(), ["user_id"], "seq", "value").select("user_id", F.round("lag1", 6).alias("lag1"))


@query("geo_mean_ratio", over("version_log", body="SELECT kind, round(exp(avg(ln(value))), 6) AS ratio FROM version_log WHERE value > 0 GROUP BY kind"))
def geo_mean_ratio(lake: Lake) -> DataFrame:
    return lake.version_log().where("value > 0").groupBy("kind").agg(F.round(F.exp(F.avg(F.ln("value"))), 6).alias("ratio"))


POINTS = "pts AS (SELECT kind, user_id % 8 + 1 AS depth, avg(value) * (user_id % 8 + 1) AS rate, 1.0 + (user_id % 8) * (user_id % 8) / 9.0 AS latency FROM version_log GROUP BY kind, user_id % 8)"


def points(lake: Lake) -> DataFrame:
    depth = F.col("user_id") % 8
    return lake.version_log().groupBy("kind", depth.alias("k")).agg(F.avg("value").alias("m")).select("kind", (F.col("k") + 1).alias("depth"), (F.col("m") * (F.col("k") + 1)).alias("rate"), (1.0 + F.col("k") * F.col("k") / 9.0).alias("latency"))


@query("saturation_knee", over("version_log", POINTS, body="SELECT kind, arg_max(depth, rate / latency) AS knee FROM pts GROUP BY kind"))
def saturation_knee(lake: Lake) -> DataFrame:
    return points(lake).groupBy("kind").agg(F.max_by("depth", F.col("rate") / F.col("latency")).alias("knee"))


@query("saturation_depth", over("version_log", POINTS, "t AS (SELECT *, max(rate) OVER (PARTITION BY kind) AS top FROM pts)", body="SELECT kind, min(depth) AS depth FROM t WHERE rate * 1.1 >= top * 0.9 GROUP BY kind"))
def saturation_depth(lake: Lake) -> DataFrame:
    """The shallowest depth whose interval (a tenth each way) meets the fastest's."""
    p = points(lake)
    top = p.groupBy("kind").agg(F.max("rate").alias("top"))
    return p.join(top, "kind").where(F.col("rate") * 1.1 >= F.col("top") * 0.9).groupBy("kind").agg(F.min("depth").alias("depth"))


def each_series(lake: Lake, of: Callable[[np.ndarray], tuple], **fields: str) -> DataFrame:
    """(user_id, fields) that a function of each user's values in order returns. Python is dealt rows in order, many users at once, and holds no more than a batch and one series."""
    rows = lake.version_log().select("user_id", "seq", "value").repartition("user_id").sortWithinPartitions("user_id", "seq")
    kinds = {"user_id": pa.int64()} | {name: {"boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "string": pa.string()}[kind] for name, kind in fields.items()}

    def batches(source):
        user, held = None, []

        def made(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], kind, from_pandas=True) for i, kind in enumerate(kinds.values())], names=list(kinds))

        for batch in source:
            if not batch.num_rows:
                continue
            users, values, done = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False).astype(float), []
            ids, null = users.fill_null(0).to_numpy(zero_copy_only=False), users.is_null().to_numpy(zero_copy_only=False)
            cuts = (np.flatnonzero((ids[1:] != ids[:-1]) | (null[1:] != null[:-1])) + 1).tolist()
            for start, end in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                now = None if null[start] else int(ids[start])
                if held and now != user:
                    done.append((user, *of(np.concatenate(held))))
                    held = []
                user = now
                held.append(values[start:end])
            yield made(done)
        if held:
            yield made([(user, *of(np.concatenate(held)))])

    return rows.mapInArrow(batches, "user_id long, " + ", ".join(f"{name} {kind}" for name, kind in fields.items()))


def enclosing(values: np.ndarray) -> tuple[float | None, float | None]:
    """The values between which the median lies with 95% confidence."""
    xs, ranks = np.sort(values), series.median_ranks(len(values))
    return (float(xs[ranks[0] - 1]), float(xs[ranks[1] - 1])) if ranks else (None, None)


@query("series_judged")
def series_judged(lake: Lake) -> DataFrame:
    """Each user's values in order, judged as one series; one beyond MAX_ROUNDS is untested."""
    of = lambda xs: (*series.judge(xs).values(), *enclosing(xs))
    return each_series(lake, of, rounds="int", order="string", lag1="double", runs="int", dip="double", critical="double", states="int", low="double", high="double")


_CHOOSE = "CASE WHEN {k} < 0 OR {k} > {n} THEN 0 ELSE exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1)) END"


def _choose(n: str, k: str) -> str:
    return "(" + _CHOOSE.format(n=f"({n})", k=f"({k})") + ")"


_WAYS = f"CASE WHEN r % 2 = 0 THEN 2 * {_choose('a - 1', 'r // 2 - 1')} * {_choose('b - 1', 'r // 2 - 1')} ELSE {_choose('a - 1', 'r // 2')} * {_choose('b - 1', 'r // 2 - 1')} + {_choose('a - 1', 'r // 2 - 1')} * {_choose('b - 1', 'r // 2')} END / {_choose('a + b', 'a')}"


@query("series_runs", over("version_log", "m AS (SELECT user_id, seq, value, median(value) OVER (PARTITION BY user_id) AS med FROM version_log)", "s AS (SELECT user_id, seq, value > med AS up FROM m WHERE value <> med)", "f AS (SELECT user_id, up, CASE WHEN lag(up) OVER w = up THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY user_id ORDER BY seq))",
    "c AS (SELECT user_id, sum(fresh) AS runs, count(*) FILTER (up) AS a, count(*) FILTER (NOT up) AS b FROM f GROUP BY 1)", "n AS (SELECT user_id, count(*) AS n FROM version_log GROUP BY 1)", f"d AS (SELECT user_id, runs, r, {_WAYS} AS share FROM (SELECT *, unnest(generate_series(2, a + b)) AS r FROM c WHERE a > 0 AND b > 0))",
    "t AS (SELECT user_id, any_value(runs) AS runs, sum(share) FILTER (r <= runs) <= 0.025 + 1e-12 AS few, sum(share) FILTER (r >= runs) <= 0.025 + 1e-12 AS many FROM d GROUP BY 1)", body=f"SELECT user_id, CASE WHEN n <= {series.MAX_ROUNDS} THEN CAST(runs AS BIGINT) END AS runs, coalesce(n <= {series.MAX_ROUNDS} AND few, false) AS few, coalesce(n <= {series.MAX_ROUNDS} AND many, false) AS many FROM n LEFT JOIN t USING (user_id)"))
def series_runs(lake: Lake) -> DataFrame:
    """Runs about each user's median, and whether they are too few or too many for independent rounds."""
    return each_series(lake, series.runs_test, runs="long", few="boolean", many="boolean")


@query("series_medians", over("version_log", "o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS place, count(*) OVER (PARTITION BY user_id) AS n FROM version_log)", "u AS (SELECT DISTINCT user_id, n FROM o)", f"b AS (SELECT user_id, n, i, sum({_choose('n', 'i')} / pow(2, n)) OVER (PARTITION BY user_id ORDER BY i) AS below FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM u))",
    f"j AS (SELECT user_id, n, count(*) FILTER (below <= 0.025 + 1e-12) AS j FROM b WHERE n <= {series.MAX_ROUNDS} GROUP BY 1, 2)", body="SELECT u.user_id, x.value AS low, y.value AS high FROM u LEFT JOIN j USING (user_id) LEFT JOIN o x ON x.user_id = u.user_id AND j > 0 AND x.place = j LEFT JOIN o y ON y.user_id = u.user_id AND j > 0 AND y.place = u.n + 1 - j"))
def series_medians(lake: Lake) -> DataFrame:
    """The values that enclose each user's median with 95% confidence, whatever their distribution."""
    return each_series(lake, enclosing, low="double", high="double")


@query("series_enough")
def series_enough(lake: Lake) -> DataFrame:
    """Whether each user's rounds suffice, and the exact interval of the share of them above the mean of all."""

    def of(xs: np.ndarray) -> tuple:
        low, high = series.share_interval(int((xs > xs.mean()).sum()), len(xs)) if len(xs) <= series.MAX_ROUNDS else (0.0, 1.0)
        return len(xs), series.enough(xs, 10, 80, 0.15), low, high

    return each_series(lake, of, rounds="int", enough="boolean", low="double", high="double")


@query("durability_choice")
def durability_choice(lake: Lake) -> DataFrame:
    """The scheme for each failure rate, repair time and number of domains of a grid."""
    grid = lake.spark.range(6).select(F.explode(F.array(*map(F.lit, (3, 5, 9, 15)))).alias("domains"), (F.lit(0.02) * (F.col("id") + 1)).alias("failures")).select("*", F.explode(F.array(F.lit(2.0), F.lit(24.0), F.lit(168.0))).alias("hours"))

    def of(batches):
        for pdf in batches:
            rows = []
            for d, f, h in zip(pdf["domains"], pdf["failures"], pdf["hours"], strict=True):
                got = durability.choose(int(d), f / durability.YEAR, 1 / h, 1e-9)
                mean = durability.mean_time_to_loss(durability.chain(got[0], got[1], f / durability.YEAR, 1 / h)) if got else None
                rows.append((d, f, h, *(got or (None, None, None, None)), mean))
            yield pd.DataFrame(rows, columns=["domains", "failures", "hours", "data", "parity", "loss", "meets", "mean_hours"])

    return grid.mapInPandas(of, "domains int, failures double, hours double, data int, parity int, loss double, meets boolean, mean_hours double")


# background work


@query("orphan_files", over("files", body="SELECT file, made FROM files WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = file)"))
def orphan_files(lake: Lake) -> DataFrame:
    return dataflow.orphans(lake.files(), lake.table("lineitem").select(F.col("l_orderkey").alias("file")), ["file"]).select("file", "made")


@query("orphan_blocks", over(body="SELECT p_partkey AS block FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)"))
def orphan_blocks(lake: Lake) -> DataFrame:
    """Blocks that no extent names."""
    named = lake.table("lineitem").select(F.col("l_partkey").alias("block"))
    return dataflow.orphans(lake.table("part").select(F.col("p_partkey").alias("block")), named, ["block"])


@query("sweep_release", over("files", body=f"SELECT file, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = file AND l_linestatus = 'O') THEN 'held' WHEN {820_000_000_000_000} > made + 30 * CAST({DAY} AS BIGINT) THEN 'released' ELSE 'young' END AS verdict FROM files"))
def sweep_release(lake: Lake) -> DataFrame:
    marks = lake.table("lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("file"))
    return dataflow.sweep(lake.files(), marks, "file", 820_000_000_000_000, F.col("made") + 30 * DAY).select("file", "verdict")


@query("oldest_released", over("files", body="SELECT file, made FROM files WHERE status = 'F' ORDER BY made, file LIMIT 100"))
def oldest_released(lake: Lake) -> DataFrame:
    return lake.files().where("status = 'F'").orderBy("made", "file").limit(100).select("file", "made")


@query("unsettled_page", over("files", body="SELECT file, made FROM files WHERE status = 'P' AND made < 850000000000000 ORDER BY made, file LIMIT 50"))
def unsettled_page(lake: Lake) -> DataFrame:
    return lake.files().where("status = 'P' and made < 850000000000000").orderBy("made", "file").limit(50).select("file", "made")


SEGMENTS = "seg AS (SELECT l_suppkey AS segment, sum(l_quantity) AS size, coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) AS live, count(*) AS age FROM lineitem GROUP BY 1)"


def segments(lake: Lake) -> DataFrame:
    live = F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0))
    return lake.table("lineitem").groupBy(F.col("l_suppkey").alias("segment")).agg(F.sum("l_quantity").alias("size"), live.alias("live"), F.count("*").alias("age"))


@query("clean_candidates", over(SEGMENTS, body="SELECT segment, round((1 - live / size) * age / (1 + live / size), 6) AS score FROM seg ORDER BY (1 - live / size) * age / (1 + live / size) DESC, segment LIMIT 20"))
def clean_candidates(lake: Lake) -> DataFrame:
    return dataflow.clean_scores(segments(lake)).orderBy(F.desc("score"), "segment").limit(20).select("segment", F.round("score", 6).alias("score"))


CAPACITY = 18_000


@query("clean_plan", over(SEGMENTS, "s AS (SELECT segment % 4 AS device, segment, size, live, (1 - live / size) * age / (1 + live / size) AS score FROM seg)", f"r AS (SELECT *, row_number() OVER w AS place, sum(live) OVER w AS l, sum(size - live) OVER w AS d FROM s WINDOW w AS (PARTITION BY device ORDER BY score DESC, segment ROWS UNBOUNDED PRECEDING))",
    f"e AS (SELECT device, min(place) FILTER (place > ceil(l / {CAPACITY})) AS gain, min(place) FILTER (d >= {CAPACITY} AND place <= ceil(l / {CAPACITY})) AS due FROM r GROUP BY 1)", body="SELECT device, segment, place FROM r JOIN e USING (device) WHERE gain IS NOT NULL AND (due IS NULL OR gain <= due) AND place <= gain"))
def clean_plan(lake: Lake) -> DataFrame:
    """The segments that cleaning each device gains from."""
    scored = dataflow.clean_scores(segments(lake)).withColumn("device", F.col("segment") % 4)
    return dataflow.clean_plan(scored, ["device"], CAPACITY)

@query("generated_words", over("version_log", "a AS (SELECT seq, CAST((77 + " + _MUL.format(a="(seq + 1)", b="11400714819323198485") + "::HUGEINT) % 18446744073709551616 AS UBIGINT) AS z FROM version_log)", "b AS (SELECT seq, " + _MUL.format(a="xor(z, z >> 30)", b="13787848793156543929") + " AS z FROM a)", "c AS (SELECT seq, " + _MUL.format(a="xor(z, z >> 27)", b="10723151780598845931") + " AS z FROM b)", body="SELECT seq, lpad(lower(to_hex(xor(z, z >> 31))), 16, '0') AS word FROM c"))
def generated_words(lake: Lake) -> DataFrame:
    """Reproducible data for benchmarks, drawn by place."""
    return lake.version_log().select("seq", dataflow.generated(F.col("seq"), 77).alias("word"))


@query("reclaimable_segments", over(SEGMENTS, body="SELECT segment, live = 0 AS reclaimable, CAST(live AS BIGINT) AS live FROM seg"))
def reclaimable_segments(lake: Lake) -> DataFrame:
    return dataflow.clean_scores(segments(lake)).select("segment", "reclaimable", F.col("live").cast("long").alias("live"))


@query("reclaim_cascade", over("files", body="SELECT l_partkey AS block, count(*) AS extents FROM lineitem JOIN files ON file = l_orderkey WHERE status = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem l2 JOIN files f2 ON f2.file = l2.l_orderkey WHERE f2.status <> 'F' AND l2.l_partkey = lineitem.l_partkey) GROUP BY 1"))
def reclaim_cascade(lake: Lake) -> DataFrame:
    """Blocks that only released files hold."""
    e = lake.table("lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("block")).join(lake.files().select("file", "status"), "file")
    held = F.count_if(F.col("status") != "F")
    return e.groupBy("block").agg(F.count("*").alias("extents"), held.alias("held")).where("held = 0").select("block", "extents")


_PAIR = "block, volume, domain, bytes"
_CELL = "cell AS (SELECT node AS volume, domain, floor(sum(greatest(bytes, 0))) AS bytes FROM volumes GROUP BY 1, 2)"
_DRAWN = [_CELL, f"pairs AS (SELECT p_partkey AS block, {_PAIR[7:]} FROM part, cell)", _mixed("a", "pairs", "CAST(block AS UBIGINT)", _PAIR), _mixed("b", "a4", "x", _PAIR), _mixed("c", "b4", "xor(x, CAST(volume AS UBIGINT))", _PAIR), _mixed("d", "c4", "x", _PAIR)]


@query("placement_order", over("volumes", *_DRAWN, f"keyed AS (SELECT {_PAIR}, CASE WHEN bytes > 0 THEN ln((CAST(x >> 11 AS DOUBLE) + 1) / 9007199254740992.0) / bytes ELSE -1e300 END AS k FROM d4)", "firsts AS (SELECT *, row_number() OVER (PARTITION BY block, domain ORDER BY k DESC, volume) AS n FROM keyed)",
    body="SELECT block, CAST(row_number() OVER (PARTITION BY block ORDER BY bytes <= 0, n > 1, k DESC, volume) AS INT) AS place, volume, domain FROM firsts"))
def placement_order(lake: Lake) -> DataFrame:
    """Every block's volumes in their order of offer; those of one domain compete for its first place."""
    blocks = lake.table("part").select(F.col("p_partkey").alias("block"))
    # one volume a node: as many rows as the nation table, whose size is fixed
    cell = lake.volumes().groupBy(F.col("node").alias("volume"), "domain").agg(F.floor(F.sum(F.greatest("bytes", F.lit(0.0)))).alias("bytes"))
    return dataflow.placement(blocks, cell).select("block", "place", "volume", "domain")


# clocks, identities and sessions


@query("monotone_clock", over("version_log", "p AS (SELECT bucket, seq, created // 100000000 AS t, row_number() OVER (PARTITION BY bucket ORDER BY seq) AS i FROM version_log)", body="SELECT bucket, seq, i + max(t - i) OVER (PARTITION BY bucket ORDER BY seq ROWS UNBOUNDED PRECEDING) AS tick FROM p"))
def monotone_clock(lake: Lake) -> DataFrame:
    log = lake.version_log().select("bucket", "seq", F.floor(F.col("created") / 100_000_000).alias("at"))
    return dataflow.monotone_clock(log, ["bucket"], "seq", "at").select("bucket", "seq", "tick")


@query("dedupe_identity", over("version_log", body="SELECT user_id, kind, size % 50 AS serial, min(seq) AS seq FROM version_log GROUP BY 1, 2, 3"))
def dedupe_identity(lake: Lake) -> DataFrame:
    log = lake.version_log().select("user_id", "kind", (F.col("size") % 50).alias("serial"), "seq")
    return dataflow.first_of_each(log, ["user_id", "kind", "serial"], "seq")


@query("session_check", over("version_log", "low AS (SELECT user_id, max(seq) // 2 AS low FROM version_log GROUP BY 1)", body="SELECT v.seq, CASE WHEN v.user_id % 10 = 3 THEN 'unknown' WHEN v.seq < l.low THEN 'repeated' WHEN v.kind = 'click' THEN 'answered' ELSE 'new' END AS verdict FROM version_log v JOIN low l USING (user_id)"))
def session_check(lake: Lake) -> DataFrame:
    log = lake.version_log().select("seq", "user_id", "kind")
    low = log.groupBy("user_id").agg(F.floor(F.max("seq") / 2).alias("low"))
    verdict = F.when(F.col("user_id") % 10 == 3, "unknown").when(F.col("seq") < F.col("low"), "repeated").when(F.col("kind") == "click", "answered").otherwise("new")
    return log.join(low, "user_id").select("seq", verdict.alias("verdict"))


GAP = 6 * 3_600_000_000


@query("session_expiry", over("version_log", f"m AS (SELECT user_id, created, CASE WHEN created - lag(created) OVER w > {GAP} OR lag(created) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM version_log WINDOW w AS (PARTITION BY user_id ORDER BY created))", "n AS (SELECT user_id, created, sum(fresh) OVER (PARTITION BY user_id ORDER BY created ROWS UNBOUNDED PRECEDING) AS session FROM m)", body="SELECT user_id, CAST(session AS BIGINT) AS session, min(created) AS first, max(created) AS last, count(*) AS uses FROM n GROUP BY 1, 2"))
def session_expiry(lake: Lake) -> DataFrame:
    return dataflow.sessions(lake.version_log().select("user_id", "created"), "user_id", "created", GAP)


@query("late_writes", over("version_log", "h AS (SELECT bucket, seq, created, max(created) OVER (PARTITION BY bucket ORDER BY seq ROWS UNBOUNDED PRECEDING) AS now FROM version_log)", body=f"SELECT bucket, count(*) FILTER (created + (seq % 5) * CAST(3600000000 AS BIGINT) - CAST(7200000000 AS BIGINT) < now - 3600000000) AS expired, count(*) AS writes FROM h GROUP BY bucket"))
def late_writes(lake: Lake) -> DataFrame:
    """Writes whose handover deadline has passed on their range's clock."""
    h = dataflow.running_max(lake.version_log().select("bucket", "seq", "created"), ["bucket"], "seq", F.col("created"), "now")
    deadline = F.col("created") + (F.col("seq") % 5) * 3_600_000_000 - 7_200_000_000
    return h.groupBy("bucket").agg(F.count_if(deadline < F.col("now") - 3_600_000_000).alias("expired"), F.count("*").alias("writes"))
