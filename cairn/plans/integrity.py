"""Queries on checksums and multipart uploads."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn import session
from cairn.functions import checksums, erasure, filters
from cairn.sources import log_files
from cairn.sources.views import Lake

from .registry import query
from .sql import over

DISTINCT_PARTS = "d AS (SELECT upload, part, min(body) AS body FROM parts GROUP BY upload, part)"


def distinct_parts(lake: Lake) -> DataFrame:
    """One body of each part number: a part put again replaces the last; here the least text stands."""
    return lake.parts().groupBy("upload", "part").agg(F.min("body").alias("body"))


@query("multipart_etag", over("parts", DISTINCT_PARTS, body="SELECT upload, md5(unhex(string_agg(md5(body), '' ORDER BY part))) || '-' || count(*) AS etag FROM d GROUP BY upload"))
def multipart_etag(lake: Lake) -> DataFrame:
    parts = F.collect_list(F.struct("part", F.md5("body").alias("md5")))
    return distinct_parts(lake).groupBy("upload").agg(checksums.etag(parts).alias("etag"))


@query("object_etags", over("objects", body="SELECT object, md5(body) AS etag FROM objects"))
def object_etags(lake: Lake) -> DataFrame:
    return lake.objects().select("object", F.md5("body").alias("etag"))


@query("sha256_etag", over("objects", body="SELECT object, sha256(body) AS sha256, sha1(body) AS sha1 FROM objects"))
def sha256_etag(lake: Lake) -> DataFrame:
    return lake.objects().select("object", F.sha2("body", 256).alias("sha256"), F.sha1("body").alias("sha1"))


@query("composite_sha256", over("parts", DISTINCT_PARTS, body="SELECT upload, to_base64(unhex(sha256(unhex(string_agg(sha256(body), '' ORDER BY part))))) || '-' || count(*) AS checksum FROM d GROUP BY upload"))
def composite_sha256(lake: Lake) -> DataFrame:
    parts = F.collect_list(F.struct("part", F.sha2("body", 256).alias("sha")))
    return distinct_parts(lake).groupBy("upload").agg(checksums.composite_sha256(parts).alias("checksum"))


@query("upload_sizes", over("parts", DISTINCT_PARTS, body="SELECT upload, CAST(sum(octet_length(encode(body))) AS BIGINT) AS size, count(*) AS parts FROM d GROUP BY upload"))
def upload_sizes(lake: Lake) -> DataFrame:
    return distinct_parts(lake).groupBy("upload").agg(F.sum(F.octet_length("body").cast("long")).alias("size"), F.count("*").alias("parts"))


MINIMUM = 120  # least bytes of a part that isn't the last, in these queries


@query("complete_upload", over("parts", DISTINCT_PARTS, "l AS (SELECT upload, part AS number, row_number() OVER (PARTITION BY upload ORDER BY part) AS place, CASE WHEN upload % 7 = 3 AND part = 2 THEN 'x' ELSE md5(body) END AS etag, CASE WHEN upload % 7 = 5 THEN -part ELSE part END AS listed FROM d)", "o AS (SELECT *, lag(listed) OVER (PARTITION BY upload ORDER BY place) AS before, place = count(*) OVER (PARTITION BY upload) AS is_last FROM l)",
    "f AS (SELECT o.upload, o.place, CASE WHEN o.before >= o.listed THEN 'InvalidPartOrder' END AS ordering, CASE WHEN d.body IS NULL OR md5(d.body) <> o.etag THEN 'InvalidPart' WHEN NOT is_last AND octet_length(encode(d.body)) < 120 THEN 'EntityTooSmall' END AS fault FROM o LEFT JOIN d ON d.upload = o.upload AND d.part = o.listed)",
    body="SELECT upload, coalesce(max(ordering), arg_min(fault, place) FILTER (fault IS NOT NULL), 'Completed') AS outcome FROM f GROUP BY upload"))
def complete_upload(lake: Lake) -> DataFrame:
    """The outcome of completing each upload with a list of parts: order first, then each part's first fault."""
    d = distinct_parts(lake)
    w = Window.partitionBy("upload")
    place = F.row_number().over(w.orderBy("part"))
    listed = d.select("upload", place.alias("place"), F.when((F.col("upload") % 7 == 3) & (F.col("part") == 2), "x").otherwise(F.md5("body")).alias("etag"), F.when(F.col("upload") % 7 == 5, -F.col("part")).otherwise(F.col("part")).alias("listed"))
    listed = listed.withColumns({"before": F.lag("listed").over(w.orderBy("place")), "is_last": F.col("place") == F.count("*").over(w)})
    met = listed.join(d.select("upload", F.col("part").alias("listed"), "body"), ["upload", "listed"], "left")
    ordering = F.when(F.col("before") >= F.col("listed"), "InvalidPartOrder")
    fault = F.when(F.col("body").isNull() | (F.md5("body") != F.col("etag")), "InvalidPart").when(~F.col("is_last") & (F.octet_length("body") < MINIMUM), "EntityTooSmall")
    faults = met.select("upload", "place", ordering.alias("ordering"), fault.alias("fault"))
    first = F.min(F.when(F.col("fault").isNotNull(), F.struct("place", "fault")))
    return faults.groupBy("upload").agg(F.coalesce(F.max("ordering"), first["fault"], F.lit("Completed")).alias("outcome"))


@query("crc32_objects")
def crc32_objects(lake: Lake) -> DataFrame:
    return lake.objects().select("object", F.lpad(F.lower(F.hex(F.crc32(F.encode("body", "UTF-8")))), 8, "0").alias("crc32"), F.sha2("body", 512).alias("sha512"))


@query("crc_objects")
def crc_objects(lake: Lake) -> DataFrame:
    return lake.objects().select("object", checksums.crc("crc32c", F.col("body")).alias("crc32c"), checksums.crc("crc64nvme", F.col("body")).alias("crc64nvme"))


@query("xxh_objects")
def xxh_objects(lake: Lake) -> DataFrame:
    return lake.objects().select("object", *[checksums.xxh(k, F.col("body")).alias(k) for k in ("xxh64", "xxh3_64", "xxh3_128")])


_TABLE = "[" + ", ".join(str(int(x)) for x in checksums._table(checksums.POLYNOMIALS["crc32c"][0])) + "]"  # by the rule, a byte a step


@query("full_object_crc", "WITH RECURSIVE " + over("parts", DISTINCT_PARTS, "w AS (SELECT upload, hex(encode(string_agg(body, '' ORDER BY part))) AS h FROM d GROUP BY upload)", f"c AS (SELECT {_TABLE} AS t)",
    "run AS (SELECT upload, CAST(0 AS BIGINT) AS i, CAST(4294967295 AS BIGINT) AS state FROM w UNION ALL SELECT r.upload, i + 1, xor(t[(xor(state, CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) & 255) + 1], state >> 8) FROM run r JOIN w ON w.upload = r.upload, c WHERE 2 * i < length(h))",
    body="SELECT run.upload, lpad(lower(to_hex(xor(state, 4294967295))), 8, '0') AS crc32c FROM run JOIN w ON w.upload = run.upload WHERE 2 * i = length(h)").removeprefix("WITH "))
def full_object_crc(lake: Lake) -> DataFrame:
    """An upload's CRC-32C from its parts' alone."""
    d = distinct_parts(lake).select("upload", "part", checksums.crc("crc32c", F.col("body")).alias("crc"), F.octet_length("body").cast("long").alias("size"))
    grouped = d.groupBy("upload").agg(F.collect_list(F.struct("part", "crc", "size")).alias("parts"))
    return grouped.select("upload", checksums.full_object("crc32c", F.col("parts")).alias("crc32c"))


@query("scrub", over("objects", "c AS (SELECT object, md5(body) AS stored, md5(CASE WHEN object % 97 = 0 THEN body || '!' ELSE body END) AS found FROM objects)", body="SELECT object, stored, found FROM c WHERE stored <> found"))
def scrub(lake: Lake) -> DataFrame:
    """Objects whose bytes no longer have their checksum."""
    damaged = F.when(F.col("object") % 97 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body"))
    c = lake.objects().select("object", F.md5("body").alias("stored"), F.md5(damaged).alias("found"))
    return c.where("stored <> found")


@query("stripe_layout", over("objects", "s AS (SELECT object, CAST(octet_length(encode(body)) AS BIGINT) AS len FROM objects)", "c AS (SELECT object, len, greatest(2, ((len + 5) // 6 + 1) // 2 * 2) AS chunk FROM s)", body="SELECT object, len, chunk, i AS data, least(i * chunk, len) AS first, least(least(i * chunk, len) + chunk, len) AS past FROM c, (SELECT unnest(generate_series(0, 5)) AS i)"))
def stripe_layout(lake: Lake) -> DataFrame:
    """The span of each object that each of six data chunks holds: equal chunks of an even length, two bytes at least."""
    s = lake.objects().select("object", F.octet_length("body").cast("long").alias("len"))
    chunk = F.greatest(F.lit(2).cast("long"), F.floor((F.floor((F.col("len") + 5) / 6) + 1) / 2) * 2)
    c = s.withColumn("chunk", chunk).withColumn("data", F.explode(F.sequence(F.lit(0), F.lit(5))))
    first = F.least(F.col("data") * F.col("chunk"), F.col("len"))
    return c.select("object", "len", "chunk", F.col("data").cast("long").alias("data"), first.alias("first"), F.least(first + F.col("chunk"), F.col("len")).alias("past"))


@query("checksum_dispatch", over("objects", "a AS (SELECT object, body, ['MD5', 'sha1', 'Sha256', 'SHA3'][object % 4 + 1] AS algorithm FROM objects)", body="SELECT object, algorithm, CASE upper(algorithm) WHEN 'MD5' THEN md5(body) WHEN 'SHA1' THEN sha1(body) WHEN 'SHA256' THEN sha256(body) END AS digest FROM a"))
def checksum_dispatch(lake: Lake) -> DataFrame:
    """A digest by the algorithm that each row names; an unknown one has none."""
    named = lake.objects().withColumn("algorithm", F.get(F.array(*map(F.lit, ("MD5", "sha1", "Sha256", "SHA3"))), (F.col("object") % 4).cast("int")))
    return named.select("object", "algorithm", checksums.digest(F.col("algorithm"), F.col("body"), ["MD5", "SHA1", "SHA256"]).alias("digest"))


@query("checksum_all")
def checksum_all(lake: Lake) -> DataFrame:
    """Every algorithm in turn."""
    names = list(checksums.ALGORITHMS)
    named = lake.objects().withColumn("algorithm", F.get(F.array(*map(F.lit, names)), (F.col("object") % len(names)).cast("int")))
    return named.select("object", "algorithm", checksums.digest(F.col("algorithm"), F.col("body")).alias("digest"))


@query("fed_digests", over("parts", DISTINCT_PARTS, body="SELECT upload, sha256(string_agg(body, '' ORDER BY part)) AS sha256 FROM d GROUP BY upload"))
def fed_digests(lake: Lake) -> DataFrame:
    """An upload's digest from its parts one after the other, never joined; an upload has 10,000 parts at most."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "body"))), lambda p: p["body"])
    return distinct_parts(lake).groupBy("upload").agg(ordered.alias("bodies")).select("upload", checksums.fed(F.col("bodies")).alias("sha256"))


@query("crc_joined", over("parts", DISTINCT_PARTS, "n AS (SELECT upload, part, body, lead(body) OVER (PARTITION BY upload ORDER BY part) AS after FROM d)", body="SELECT upload, part, true AS crc32, true AS crc32c, true AS crc64nvme FROM n WHERE after IS NOT NULL"))
def crc_joined(lake: Lake) -> DataFrame:
    """Whether the checksums of two parts, combined without their data, are those of the parts one after the other."""
    after = F.lead("body").over(Window.partitionBy("upload").orderBy("part"))
    n = distinct_parts(lake).withColumn("after", after).where("after is not null")
    one = lambda k: checksums.joined(k, checksums.crc(k, F.col("body")), checksums.crc(k, F.col("after")), F.octet_length("after").cast("long")) == checksums.crc(k, F.concat("body", "after"))
    return n.select("upload", "part", *[one(k).alias(k) for k in ("crc32", "crc32c", "crc64nvme")])


@query("erasure_rebuilt", over("objects", "s AS (SELECT object, body, CAST(octet_length(encode(body)) AS BIGINT) AS len FROM objects)", body="SELECT object, CASE WHEN object % 5 <> 4 THEN md5(body) END AS found, greatest(2, ((len + 3) // 4 + 1) // 2 * 2) AS chunk FROM s"))
def erasure_rebuilt(lake: Lake) -> DataFrame:
    """Objects in four data and two parity chunks, rebuilt without two of them, or not at all without three."""
    session.small_batches(lake.spark)
    k = F.col("object") % 5
    lost = F.when(k == 0, F.array(F.lit(0), F.lit(1))).when(k == 1, F.array(F.lit(3), F.lit(5))).when(k == 2, F.array(F.lit(4), F.lit(5))).when(k == 3, F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(2), F.lit(4)))
    return lake.objects().select("object", erasure.rebuilt(F.encode("body", "UTF-8"), lost, 4, 2).alias("r")).select("object", F.md5("r.body").alias("found"), "r.chunk")


@query("bloom_buckets", over("version_log", body="SELECT bucket, true AS held, true AS few_strangers FROM version_log GROUP BY bucket"))
def bloom_buckets(lake: Lake) -> DataFrame:
    """A filter of each bucket's keys: it holds all of them, and takes few others for one."""
    log = lake.version_log().select("bucket", "key").distinct()
    sizes = filters.sizes_of(log, ["bucket"], "key")
    made = filters.filters_of(log, ["bucket"], "key", sizes)
    strangers = log.select("bucket", F.concat("key", F.lit("?")).alias("key"))
    own = filters.held_by(log, made, ["bucket"], "key", sizes).groupBy("bucket").agg(F.bool_and("may_hold").alias("held"))
    others = filters.held_by(strangers, made, ["bucket"], "key", sizes).groupBy("bucket").agg((F.avg(F.col("may_hold").cast("int")) < 0.05).alias("few_strangers"))
    return own.join(others, "bucket")


@query("log_records", over("version_log", "n AS (SELECT user_id, seq, etag, count(*) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS i FROM version_log)", "m AS (SELECT * FROM (VALUES ('absolute'), ('tolerate_tail'), ('point_in_time'), ('skip_corrupted')) t(mode))", "d AS (SELECT mode, user_id, total, CASE user_id % 3 WHEN 0 THEN 0 WHEN 1 THEN total ELSE greatest((total + 1) // 2, 1) END AS lost, user_id % 3 AS damage FROM m, (SELECT DISTINCT user_id, total FROM n))",
    "r AS (SELECT mode, user_id, damage, n.i, n.etag FROM d JOIN n USING (user_id) WHERE damage = 0 OR (damage = 1 AND mode <> 'absolute' AND n.i < lost) OR (damage = 2 AND mode = 'point_in_time' AND n.i < lost))",
    body="SELECT d.user_id, d.mode, NOT (d.damage = 0 OR (d.damage = 1 AND d.mode <> 'absolute') OR (d.damage = 2 AND d.mode = 'point_in_time')) AS refused, count(r.i) AS records, md5(coalesce(string_agg(r.etag, '' ORDER BY r.i), '')) AS digest FROM d LEFT JOIN r ON r.user_id = d.user_id AND r.mode = d.mode WHERE NOT (d.damage = 2 AND d.mode = 'skip_corrupted') GROUP BY ALL"))
def log_records(lake: Lake) -> DataFrame:
    """Each user's log written and read under every recovery mode: whole, with its last record cut, or with one damaged in the middle.

    What reading over damage finds depends on where blocks end, so that is left to the tests.
    """

    def damaged(user: int, whole: bytes, half: bytes) -> bytes:
        data = bytearray(whole)
        if user % 3 == 1:
            del data[-3:]
        elif user % 3 == 2:
            data[len(half) - 1] ^= 0xFF
        return bytes(data)

    def found(user: int, data: bytes, sums: dict[int, int]):
        for mode in log_files.MODES:
            if user % 3 == 2 and mode == "skip_corrupted":
                continue
            try:
                records, refused = log_files.read(data, mode, sums), False
            except ValueError:
                records, refused = [], True
            yield user, mode, refused, len(records), hashlib.md5(b"".join(records)).hexdigest()

    def of(batches):
        for pdf in batches:
            users, logs, held = [], [], 0
            for last, (user, etags) in enumerate(zip(pdf["user_id"], pdf["etags"], strict=True), 1 - len(pdf)):
                users.append(int(user))
                logs.append([e.encode() for e in etags])
                held += sum(map(len, logs[-1]))
                if held < log_files.WINDOW and last:
                    continue
                whole, half = log_files.write_all(logs), log_files.write_all([r[: max((len(r) + 1) // 2, 1)] if u % 3 == 2 else [] for u, r in zip(users, logs, strict=True)])
                data = list(map(damaged, users, whole, half))
                rows = [row for one in zip(users, data, log_files.sums_of(data), strict=True) for row in found(*one)]
                yield pd.DataFrame(rows, columns=["user_id", "mode", "refused", "records", "digest"])
                users, logs, held = [], [], 0

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "etag"))), lambda r: r["etag"])
    logs = lake.version_log().groupBy("user_id").agg(ordered.alias("etags"))
    return logs.mapInPandas(of, "user_id long, mode string, refused boolean, records long, digest string")


@query("range_images", over("version_log", body="SELECT bucket, key, seq, size FROM version_log WHERE key >= '3/' AND key < '7/'"))
def range_images(lake: Lake) -> DataFrame:
    """A range's rows written as an image and installed from it."""
    rows = lake.version_log().where("key >= '3/' and key < '7/'").select("bucket", "key", "seq", "size")
    return log_files.through_image(rows, ["bucket", "key", "seq"])


@query("verified_objects", over(body="SELECT doc_id AS object, n_chars AS stored, CAST(length(text) AS BIGINT) AS found, n_chars = length(text) AS whole FROM documents"))
def verified_objects(lake: Lake) -> DataFrame:
    """Each object's stored length against what its body holds."""
    d = lake.table("documents")
    found = F.length("text").cast("long")
    return d.select(F.col("doc_id").alias("object"), F.col("n_chars").alias("stored"), found.alias("found"), (F.col("n_chars") == found).alias("whole"))
