"""Queries that replay the command log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import access
from cairn.sources.views import Lake
from cairn.streaming import files, replay

from .registry import query
from .sql import over

#: b0 is unversioned, b1 enabled, b2 enabled and later suspended, b3 suspended.
MODES = "modes AS (SELECT *, CASE WHEN bucket = 'b0' THEN 'unversioned' WHEN bucket = 'b1' OR (bucket = 'b2' AND seq < 5000) THEN 'enabled' ELSE 'suspended' END AS mode FROM version_log)"


def mode() -> Column:
    b = F.col("bucket")
    return F.when(b == "b0", "unversioned").when((b == "b1") | ((b == "b2") & (F.col("seq") < 5000)), "enabled").otherwise("suspended")


@query("command_replay", over("version_log", MODES, "g AS (SELECT bucket, key, max(seq) AS seq, count(*) FILTER (mode = 'enabled') AS kept, max(seq) FILTER (mode <> 'enabled') AS null_seq, arg_max(mode, seq) FILTER (mode <> 'enabled') AS null_mode, arg_max(marker, seq) FILTER (mode <> 'enabled') AS null_marker, max(seq) FILTER (mode = 'enabled') AS kept_seq, arg_max(marker, seq) FILTER (mode = 'enabled') AS kept_marker FROM modes GROUP BY 1, 2)", "h AS (SELECT *, null_seq IS NOT NULL AND NOT (null_mode = 'unversioned' AND null_marker) AS has_null FROM g)",
    body="SELECT bucket, key, seq, kept + CAST(has_null AS BIGINT) AS versions, CASE WHEN has_null AND (kept_seq IS NULL OR null_seq > kept_seq) THEN null_marker ELSE kept_marker END AS marker FROM h"))
def command_replay(lake: Lake) -> DataFrame:
    return replay.replay(lake.version_log(), mode())


@query("suspended_null_versions", over("version_log", MODES, body="SELECT bucket, key, arg_max(seq, seq) AS seq, arg_max(marker, seq) AS marker FROM modes WHERE mode = 'suspended' GROUP BY 1, 2"))
def suspended_null_versions(lake: Lake) -> DataFrame:
    s = lake.version_log().where(mode() == "suspended")
    return s.groupBy("bucket", "key").agg(F.max("seq").alias("seq"), F.max_by("marker", "seq").alias("marker"))


FILE_LOG = "flog AS (SELECT bucket AS range, user_id AS file, seq, created AS moment, CASE WHEN kind = 'error' THEN 'delete' ELSE 'write' END AS op, kind AS content, created + (seq % 5 - 1) * CAST(3600000000 AS BIGINT) AS deadline FROM version_log)"


@query("file_outcomes", over("version_log", FILE_LOG, "n AS (SELECT *, max(moment) OVER (PARTITION BY range ORDER BY seq ROWS UNBOUNDED PRECEDING) AS now, sum(CASE WHEN op = 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY range, file ORDER BY seq ROWS UNBOUNDED PRECEDING) AS epoch FROM flog)", "t AS (SELECT *, op = 'write' AND now <= deadline AS timely FROM n)",
    "m AS (SELECT a.range, a.file, a.seq, any_value(a.op) AS op, any_value(a.content) AS content, any_value(a.timely) AS timely, arg_min(b.content, b.seq) AS made FROM t a LEFT JOIN t b ON b.range = a.range AND b.file = a.file AND b.epoch = a.epoch AND b.seq < a.seq AND b.timely GROUP BY 1, 2, 3)",
    body="SELECT range, file, seq, CASE WHEN op = 'delete' THEN 'deleted' WHEN made IS NOT NULL THEN CASE WHEN made = content THEN 'written' ELSE 'conflict' END WHEN timely THEN 'written' ELSE 'expired' END AS outcome FROM m"))
def file_outcomes(lake: Lake) -> DataFrame:
    log = lake.version_log().select(F.col("bucket").alias("range"), F.col("user_id").alias("file"), "seq", F.col("created").alias("at"), F.when(F.col("kind") == "error", "delete").otherwise("write").alias("op"), F.col("kind").alias("content"), (F.col("created") + (F.col("seq") % 5 - 1) * 3_600_000_000).alias("deadline"))
    return files.file_outcomes(log).select("range", "file", "seq", "outcome")


@query("latest_parts", over("parts", "f AS (SELECT upload, part, count(*) AS puts, max(body) AS body FROM parts GROUP BY 1, 2)", body="SELECT upload, part, puts, md5(body) AS etag FROM f"))
def latest_parts(lake: Lake) -> DataFrame:
    """Parts put again under their number replace what was there; ties in the table go to the greatest text."""
    return lake.parts().groupBy("upload", "part").agg(F.count("*").alias("puts"), F.md5(F.max("body")).alias("etag"))


@query("acl_writes", over("version_log", "q AS (SELECT seq, CASE seq % 6 WHEN 0 THEN NULL WHEN 1 THEN 'private' WHEN 2 THEN 'bucket-owner-full-control' WHEN 3 THEN 'odd' END AS canned, CASE WHEN seq % 6 = 4 THEN 'id=\"' || user_id || '\"' WHEN seq % 6 = 5 THEN 'who' WHEN seq % 6 = 1 AND seq % 4 = 1 THEN 'id=1' END AS granted FROM version_log)",
    body="SELECT seq, CASE WHEN canned = 'odd' THEN 'unknown canned' WHEN granted = 'who' THEN 'malformed grant' WHEN canned IS NOT NULL AND granted IS NOT NULL THEN 'canned and grants' WHEN canned IS NOT NULL THEN 'canned' WHEN granted IS NOT NULL THEN 'grants' ELSE 'none' END AS named, CASE WHEN canned IS NULL AND granted IS NULL THEN true WHEN granted IS NULL THEN canned = 'bucket-owner-full-control' WHEN canned IS NULL AND granted <> 'who' THEN true ELSE false END AS allowed FROM q"))
def acl_writes(lake: Lake) -> DataFrame:
    k = F.col("seq") % 6
    canned = F.when(k == 1, "private").when(k == 2, "bucket-owner-full-control").when(k == 3, "odd")
    granted = F.when(k == 4, F.concat(F.lit('id="'), F.col("user_id").cast("string"), F.lit('"'))).when(k == 5, "who").when((k == 1) & (F.col("seq") % 4 == 1), "id=1")
    headers = F.map_filter(F.create_map(F.lit("x-amz-acl"), canned, F.lit("x-amz-grant-full-control"), granted), lambda _, v: v.isNotNull())
    return lake.version_log().select("seq", access.acl_named(headers).alias("named"), access.object_write_allowed(headers, F.col("user_id").cast("string")).alias("allowed"))


@query("expected_owners", over("version_log", body="SELECT seq, CASE seq % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'invalid' WHEN 2 THEN 'ok' ELSE 'mismatch' END AS verdict FROM version_log"))
def expected_owners(lake: Lake) -> DataFrame:
    owner, k = F.lpad(F.col("user_id").cast("string"), 12, "0"), F.col("seq") % 4
    header = F.when(k == 1, "me").when(k == 2, owner).when(k == 3, "999999999999")
    return lake.version_log().select("seq", access.expected_owner(header, owner).alias("verdict"))
