"""Queries on the key-value engine, listings and navigation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import keys
from cairn.operators import listing, merge
from cairn.sources.views import Lake

from .registry import query
from .sql import over

KEY = ["bucket", "key"]
STARTS = ["0/", "3/", "5/100", "8/"]


@query("list_current", over("version_log", "ranked", body="SELECT bucket, key, seq, created, size, count(*) OVER () > 100 AS truncated FROM ranked WHERE nth = 1 AND NOT marker ORDER BY bucket, key LIMIT 100"))
def list_current(lake: Lake) -> DataFrame:
    live = merge.current(lake.version_log(), KEY).select("bucket", "key", "seq", "created", "size")
    return merge.page(live, KEY, 100)


@query("list_objects_v2", over("version_log", "ranked", """live AS (SELECT * FROM ranked WHERE nth = 1 AND NOT marker AND bucket = 'b1')""", """named AS (SELECT CASE WHEN instr(key, '/') > 0 THEN substr(key, 1, instr(key, '/')) END AS rolled, key, size FROM live)""", body="""
    SELECT coalesce(rolled, key) AS name, rolled IS NOT NULL AS is_prefix, count(*) AS n_keys, CAST(sum(size) AS BIGINT) AS size, count(*) OVER () > 1000 AS truncated FROM named GROUP BY 1, 2 ORDER BY name LIMIT 1000"""))
def list_objects_v2(lake: Lake) -> DataFrame:
    return listing.list_objects(lake.version_log(), "b1", delimiter="/")


@query("list_objects_page", over("version_log", "ranked", """live AS (SELECT * FROM ranked WHERE nth = 1 AND NOT marker AND bucket = 'b2' AND starts_with(key, '4/') AND key > '4/34')""", body="SELECT key AS name, false AS is_prefix, CAST(1 AS BIGINT) AS n_keys, size, (SELECT count(*) FROM live) > 5 AS truncated FROM live ORDER BY key LIMIT 5"))
def list_objects_page(lake: Lake) -> DataFrame:
    return listing.list_objects(lake.version_log(), "b2", prefix="4/", max_keys=5, after="4/34")


@query("list_versions", over("version_log", "ranked", body="SELECT bucket, key, seq, marker, nth = 1 AS is_latest FROM ranked"))
def list_versions(lake: Lake) -> DataFrame:
    return listing.list_versions(lake.version_log()).select("bucket", "key", "seq", "marker", "is_latest")


@query("list_versions_page", over("version_log", body="SELECT key, seq, marker, (SELECT count(*) FROM version_log WHERE bucket = 'b3' AND key > '3/') > 50 AS truncated FROM version_log WHERE bucket = 'b3' AND key > '3/' ORDER BY key, seq DESC LIMIT 50"))
def list_versions_page(lake: Lake) -> DataFrame:
    rows = lake.version_log().where("bucket = 'b3' and key > '3/'").select("key", "seq", "marker", (-F.col("seq")).alias("order"))
    return merge.page(rows, ["key", "order"], 50).drop("order")


@query("list_parts", over("parts", "seen AS (SELECT upload, part, octet_length(encode(body)) AS size, row_number() OVER (PARTITION BY upload ORDER BY part) AS n, count(*) OVER (PARTITION BY upload) AS m FROM parts WHERE part > 1)", body="SELECT upload, part, CAST(size AS BIGINT) AS size, m > 3 AS truncated FROM seen WHERE n <= 3"))
def list_parts(lake: Lake) -> DataFrame:
    return listing.list_parts(lake.parts().select("upload", "part", F.octet_length("body").cast("long").alias("size")), 1, 3)


@query("list_uploads", over("parts", "u AS (SELECT upload, 'k' || (upload % 7) AS key, count(*) AS n_parts FROM parts GROUP BY upload)", body="SELECT key, upload, n_parts, (SELECT count(*) FROM u) > 1000 AS truncated FROM u ORDER BY key, upload LIMIT 1000"))
def list_uploads(lake: Lake) -> DataFrame:
    u = lake.parts().groupBy("upload").agg(F.count("*").alias("n_parts")).select(F.concat(F.lit("k"), F.col("upload") % 7).alias("key"), "upload", "n_parts")
    return merge.page(u, ["key", "upload"], 1000)


@query("keyset_page", over("version_log", body="SELECT bucket, key, seq, (SELECT count(*) FROM version_log WHERE (bucket, key, seq) > ('b1', '5/45', 500)) > 25 AS truncated FROM version_log WHERE (bucket, key, seq) > ('b1', '5/45', 500) ORDER BY bucket, key, seq LIMIT 25"))
def keyset_page(lake: Lake) -> DataFrame:
    return merge.page(lake.version_log().select("bucket", "key", "seq"), ["bucket", "key", "seq"], 25, ("b1", "5/45", 500))


@query("continuation_tokens", over("version_log", "k AS (SELECT DISTINCT key FROM version_log)", body="SELECT key, rtrim(translate(to_base64(encode('a' || key)), '+/', '-_'), '=') AS token, key AS start FROM k"))
def continuation_tokens(lake: Lake) -> DataFrame:
    k = lake.version_log().select("key").distinct().withColumn("token", listing.token("a", F.col("key")))
    return k.withColumn("start", listing.token_start(F.col("token")))


@query("get_point", over("version_log", "ranked", body="SELECT bucket, key, seq, size FROM ranked WHERE nth = 1 AND NOT marker AND bucket = 'b1' AND key = '5/45'"))
def get_point(lake: Lake) -> DataFrame:
    return merge.current(lake.version_log().where("bucket = 'b1' and key = '5/45'"), KEY).select("bucket", "key", "seq", "size")


@query("scan_page", over("version_log", "ranked", "live AS (SELECT bucket, key, seq FROM ranked WHERE nth = 1 AND NOT marker AND bucket = 'b0' AND key >= '2/' AND key < '6/')", body="SELECT bucket, key, seq, (SELECT count(*) FROM live) > 10 AS truncated FROM live ORDER BY key LIMIT 10"))
def scan_page(lake: Lake) -> DataFrame:
    span = lake.version_log().where("bucket = 'b0' and key >= '2/' and key < '6/'")
    return merge.page(merge.current(span, KEY).select("bucket", "key", "seq"), ["key"], 10)


@query("probe_bucket", over("version_log", body="SELECT count(*) > 0 AS remains FROM version_log WHERE bucket = 'b2' AND key > '9/'"))
def probe_bucket(lake: Lake) -> DataFrame:
    return lake.version_log().where("bucket = 'b2' and key > '9/'").limit(1).agg((F.count("*") > 0).alias("remains"))


@query("first_row", over("version_log", body="SELECT bucket, min(key) AS key FROM version_log WHERE key >= '3' GROUP BY bucket"))
def first_row(lake: Lake) -> DataFrame:
    return lake.version_log().where("key >= '3'").groupBy("bucket").agg(F.min("key").alias("key"))


@query("range_route_floor", over("version_log", "k AS (SELECT DISTINCT bucket, key FROM version_log)", body="SELECT bucket, key, CASE WHEN key >= '8/' THEN '8/' WHEN key >= '5/100' THEN '5/100' WHEN key >= '3/' THEN '3/' WHEN key >= '0/' THEN '0/' END AS start FROM k"))
def range_route_floor(lake: Lake) -> DataFrame:
    return merge.floor_of(lake.version_log().select(*KEY).distinct(), STARTS)


@query("range_route_join", over("version_log", "s AS (SELECT bucket, key AS start FROM version_log WHERE marker GROUP BY 1, 2)", "k AS (SELECT DISTINCT bucket, key FROM version_log)", body="SELECT k.bucket, k.key, max(s.start) AS start FROM k LEFT JOIN s ON s.bucket = k.bucket AND s.start <= k.key GROUP BY 1, 2"))
def range_route_join(lake: Lake) -> DataFrame:
    log = lake.version_log()
    starts = log.where("marker").select("bucket", F.col("key").alias("start")).distinct()
    return merge.floor_join(log.select(*KEY).distinct(), starts, by=["bucket"])


@query("split_counts", over("version_log", body="SELECT bucket, count(*) FILTER (key < '5/') AS below, count(*) FILTER (key >= '5/') AS above FROM version_log GROUP BY bucket"))
def split_counts(lake: Lake) -> DataFrame:
    below, above = merge.split_at(lake.version_log(), "5/")
    both = below.select("bucket", F.lit(1).alias("b"), F.lit(0).alias("a")).union(above.select("bucket", F.lit(0), F.lit(1)))
    return both.groupBy("bucket").agg(F.sum("b").alias("below"), F.sum("a").alias("above"))


@query("kway_merge", over("version_log", "ranked", body="SELECT bucket, key, seq, size FROM ranked WHERE nth = 1 AND NOT marker"))
def kway_merge(lake: Lake) -> DataFrame:
    log = lake.version_log().select(*KEY, "seq", "size", "marker")
    return merge.merge_runs([log.where(F.col("seq") % 3 == k) for k in range(3)], KEY).select(*KEY, "seq", "size")


@query("range_delete", over("version_log", body="""SELECT bucket, count(*) AS rows, CAST(sum(seq) AS BIGINT) AS seqs FROM version_log v WHERE NOT EXISTS
    (SELECT 1 FROM (VALUES ('1/', '3/', 400), ('5/', '5/9', 900), ('7/', '8/', 100000)) t(b, e, upto) WHERE v.key >= b AND v.key < e AND v.seq < upto) GROUP BY bucket"""))
def range_delete(lake: Lake) -> DataFrame:
    cleared = lake.spark.createDataFrame([("1/", "3/", 400), ("5/", "5/9", 900), ("7/", "8/", 100000)], "begin string, end string, at long")
    return merge.clear_ranges(lake.version_log(), cleared).groupBy("bucket").agg(F.count("*").alias("rows"), F.sum("seq").alias("seqs"))


@query("merge_operands", over("version_log", body="SELECT bucket, key, string_agg(kind, ',' ORDER BY seq) AS merged, count(*) AS operands FROM version_log GROUP BY bucket, key"))
def merge_operands(lake: Lake) -> DataFrame:
    return merge.fold_operands(lake.version_log(), KEY, "seq", F.col("kind"))


@query("wide_columns", over("version_log", "ranked", body="SELECT bucket, key, json_extract_string(props, '$.k') AS \"value\", json_extract_string(props, '$.k') IS NOT NULL AS present FROM ranked WHERE nth = 1"))
def wide_columns(lake: Lake) -> DataFrame:
    newest = merge.newest(lake.version_log(), KEY)
    wide = F.map_from_entries(F.array_sort(F.map_entries(F.from_json("props", "map<string,string>"))))
    return newest.select(*KEY, F.try_element_at(wide, F.lit("k")).alias("value"), F.map_contains_key(wide, "k").alias("present"))


@query("current_or_null_version", over("version_log", "ranked", "n AS (SELECT bucket, key, max(seq) FILTER (kind = 'signup') AS null_seq FROM version_log GROUP BY 1, 2)", body="SELECT r.bucket, r.key, r.seq AS current_seq, n.null_seq FROM ranked r LEFT JOIN n USING (bucket, key) WHERE nth = 1"))
def current_or_null_version(lake: Lake) -> DataFrame:
    log = lake.version_log()
    return log.groupBy(*KEY).agg(F.max("seq").alias("current_seq"), F.max(F.when(F.col("kind") == "signup", F.col("seq"))).alias("null_seq"))


@query("bucket_usage", over("version_log", "ranked", body="SELECT bucket, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM ranked WHERE nth = 1 AND NOT marker GROUP BY bucket"))
def bucket_usage(lake: Lake) -> DataFrame:
    return merge.current(lake.version_log(), KEY).groupBy("bucket").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


@query("key_range_summary", over("version_log", body="SELECT substr(key, 1, 1) AS prefix, count(*) AS rows, min(key) AS low, max(key) AS high FROM version_log GROUP BY 1"))
def key_range_summary(lake: Lake) -> DataFrame:
    return lake.version_log().groupBy(keys.fixed_prefix(F.col("key"), 1).alias("prefix")).agg(F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))


# navigation


@query("object_extents", over("extents", body='SELECT file, ordinal, start, "end", length, block, volume FROM extents'))
def object_extents(lake: Lake) -> DataFrame:
    return lake.extents()


@query("ranged_read", over("extents", "volumes", "sized AS (SELECT file, max(\"end\") AS size FROM extents GROUP BY file)", "asked AS (SELECT file, size // 4 AS lo, size - size // 4 AS hi FROM sized)", body="""
    SELECT e.file, e.ordinal, greatest(e.start, a.lo) AS first, least(e."end", a.hi) AS past, e.block, e.volume, v.domain FROM extents e JOIN asked a ON e.file = a.file AND e."end" > a.lo AND e.start < a.hi JOIN volumes v ON v.volume = e.volume"""))
def ranged_read(lake: Lake) -> DataFrame:
    w = Window.partitionBy("file")
    e = lake.extents().withColumn("size", F.max("end").over(w))  # the extents' own window already deals by file
    quarter = F.floor(F.col("size") / 4)
    e = e.withColumns({"lo": quarter, "hi": F.col("size") - quarter}).where("end > lo and start < hi")
    return e.join(lake.volumes(), "volume").select("file", "ordinal", F.greatest("start", "lo").alias("first"), F.least("end", "hi").alias("past"), "block", "volume", "domain")


@query("extent_at_offset", over("extents", body='SELECT file, min(ordinal) AS ordinal FROM extents WHERE "end" >= 31 GROUP BY file'))
def extent_at_offset(lake: Lake) -> DataFrame:
    return lake.extents().where("end >= 31").groupBy("file").agg(F.min("ordinal").alias("ordinal"))


@query("file_header", over("version_log", "files", body="SELECT v.seq, f.file, f.owner, f.made, f.status FROM version_log v LEFT JOIN files f ON f.file = v.seq"))
def file_header(lake: Lake) -> DataFrame:
    f = lake.files()
    return lake.version_log().select("seq").join(f, F.col("seq") == F.col("file"), "left")


@query("composite_files", over("files", "extents", "sized AS (SELECT file, max(\"end\") AS size FROM extents GROUP BY file)", body="""
    SELECT f.owner, f.file, s.size, CAST(sum(s.size) OVER (PARTITION BY f.owner ORDER BY f.file ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS start FROM files f JOIN sized s ON s.file = f.file"""))
def composite_files(lake: Lake) -> DataFrame:
    sized = lake.extents().groupBy("file").agg(F.max("end").alias("size"))
    w = Window.partitionBy("owner").orderBy("file").rowsBetween(Window.unboundedPreceding, 0)
    return lake.files().join(sized, "file").select("owner", "file", "size", (F.sum("size").over(w) - F.col("size")).alias("start"))


@query("block_places", over(body="SELECT l_partkey AS block, count(DISTINCT l_suppkey) AS volumes, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS places FROM lineitem GROUP BY 1"))
def block_places(lake: Lake) -> DataFrame:
    places = F.array_sort(F.collect_set(F.col("l_suppkey").cast("string")))
    return lake.table("lineitem").groupBy(F.col("l_partkey").alias("block")).agg(F.size(places).cast("long").alias("volumes"), F.array_join(places, ",").alias("places"))


@query("volume_blocks", over(body="SELECT l_suppkey AS volume, count(DISTINCT l_partkey) AS blocks, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes FROM lineitem GROUP BY 1"))
def volume_blocks(lake: Lake) -> DataFrame:
    return lake.table("lineitem").groupBy(F.col("l_suppkey").alias("volume")).agg(F.countDistinct("l_partkey").alias("blocks"), F.sum(F.col("l_quantity").cast("long")).alias("bytes"))


@query("volume_keys", over(body="SELECT DISTINCT l_suppkey AS volume, l_partkey AS block FROM lineitem"))
def volume_keys(lake: Lake) -> DataFrame:
    return lake.table("lineitem").select(F.col("l_suppkey").alias("volume"), F.col("l_partkey").alias("block")).distinct()


@query("domain_spread", over("volumes", body="SELECT l_orderkey AS file, count(DISTINCT v.domain) AS domains, count(DISTINCT v.node) AS nodes, count(DISTINCT v.volume) AS volumes FROM lineitem JOIN volumes v ON v.volume = l_suppkey GROUP BY 1"))
def domain_spread(lake: Lake) -> DataFrame:
    li = lake.table("lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_suppkey").alias("volume"))
    # a volume is of one node and one domain: sets of each, combined map-side, instead of a row for each distinct count
    each = li.join(lake.volumes(), "volume").groupBy("file").agg(*[F.collect_set(c).alias(c) for c in ("domain", "node", "volume")])
    return each.select("file", *[F.size(c).cast("long").alias(f"{c}s") for c in ("domain", "node", "volume")])


@query("census", over("volumes", body="SELECT domain, count(DISTINCT node) AS nodes, count(*) AS volumes FROM volumes GROUP BY domain"))
def census(lake: Lake) -> DataFrame:
    return lake.volumes().groupBy("domain").agg(F.countDistinct("node").alias("nodes"), F.count("*").alias("volumes"))


@query("owner_bucket_count", over(body="SELECT c_mktsegment AS owner, count(*) AS buckets, count(*) > 300 AS over_quota FROM customer GROUP BY 1"))
def owner_bucket_count(lake: Lake) -> DataFrame:
    return lake.table("customer").groupBy(F.col("c_mktsegment").alias("owner")).agg(F.count("*").alias("buckets"), (F.count("*") > 300).alias("over_quota"))


@query("owned_buckets_page", over("o AS (SELECT c_name AS bucket, c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND starts_with(c_name, 'Customer') AND c_name > 'Customer#000000020')", body="SELECT bucket, id, (SELECT count(*) FROM o) > 15 AS truncated FROM o ORDER BY bucket LIMIT 15"))
def owned_buckets_page(lake: Lake) -> DataFrame:
    o = lake.table("customer").where((F.col("c_mktsegment") == "BUILDING") & F.col("c_name").startswith("Customer")).select(F.col("c_name").alias("bucket"), F.col("c_custkey").alias("id"))
    return merge.page(o, ["bucket"], 15, ("Customer#000000020",))


@query("live_bucket_operations", over("version_log", body="SELECT v.bucket, count(*) AS operations FROM version_log v WHERE EXISTS (SELECT 1 FROM (VALUES ('b0'), ('b2')) g(bucket) WHERE g.bucket = v.bucket) GROUP BY 1"))
def live_bucket_operations(lake: Lake) -> DataFrame:
    gates = lake.spark.createDataFrame([("b0", "open"), ("b1", "closed"), ("b2", "open"), ("b3", "condemned")], "bucket string, state string").where("state = 'open'")
    return lake.version_log().join(gates, "bucket", "left_semi").groupBy("bucket").agg(F.count("*").alias("operations"))


@query("block_layout", over("extents", body='SELECT file, ordinal, p AS piece, greatest(p * 16, start) AS first, least(p * 16 + 16, "end") AS past FROM (SELECT file, ordinal, start, "end", unnest(generate_series(start // 16, ("end" - 1) // 16)) AS p FROM extents WHERE length > 0)'))
def block_layout(lake: Lake) -> DataFrame:
    """Pieces of fixed size that each extent touches."""
    e = lake.extents().where("length > 0")
    cut = e.select("file", "ordinal", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / 16), F.floor((F.col("end") - 1) / 16))).alias("piece"))
    return cut.select("file", "ordinal", "piece", F.greatest(F.col("piece") * 16, "start").alias("first"), F.least(F.col("piece") * 16 + 16, "end").alias("past"))


@query("version_ids", over("version_log", body="SELECT seq, upper(" + " || ".join(f"substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', CAST((seq >> {5 * i}) & 31 AS INT) + 1, 1)" for i in range(12, -1, -1)) + ") AS id, CAST(seq AS BIGINT) AS parsed FROM version_log"))
def version_ids(lake: Lake) -> DataFrame:
    v = lake.version_log().select("seq", keys.version_id(F.col("seq").cast("long")).alias("id"))
    return v.withColumn("parsed", keys.parse_version_id(F.col("id")).cast("long"))


@query("url_encoded_keys", over(body="SELECT DISTINCT url, replace(url_encode(url), '%2F', '/') AS encoded FROM pages"))
def url_encoded_keys(lake: Lake) -> DataFrame:
    return lake.table("pages").select("url").distinct().withColumn("encoded", keys.percent_encode(F.col("url")))


@query("human_sizes", over("version_log", body="""SELECT DISTINCT size * 512 AS size, CASE WHEN size * 512 < 1024 OR (size * 512) % 1024 <> 0 THEN (size * 512) || ' B' WHEN size * 512 >= 1048576 AND (size * 512) % 1048576 = 0 THEN ((size * 512) >> 20) || ' MiB' ELSE ((size * 512) >> 10) || ' KiB' END AS shown FROM version_log WHERE size >= 0"""))
def human_sizes(lake: Lake) -> DataFrame:
    return lake.version_log().where("size >= 0").select((F.col("size") * 512).alias("size")).distinct().withColumn("shown", keys.human_size(F.col("size")))


@query("shared_prefixes", over("version_log", "k AS (SELECT DISTINCT bucket, key FROM version_log)", "n AS (SELECT bucket, key, lead(key) OVER (PARTITION BY bucket ORDER BY key) AS next FROM k)", body="SELECT bucket, key, next, CAST((SELECT count(*) FROM generate_series(1, CAST(least(length(key), length(next)) AS BIGINT)) t(i) WHERE substr(key, 1, CAST(i AS INT)) = substr(next, 1, CAST(i AS INT))) AS INT) AS shared FROM n WHERE next IS NOT NULL"))
def shared_prefixes(lake: Lake) -> DataFrame:
    w = Window.partitionBy("bucket").orderBy("key")
    n = lake.version_log().select(*KEY).distinct().withColumn("next", F.lead("key").over(w)).where("next is not null")
    return n.withColumn("shared", keys.shared_prefix(F.col("key"), F.col("next")))


@query("url_query_pairs", over("p AS (SELECT page_id, split_part(split_part(url, '?', 2), '#', 1) AS q FROM pages WHERE instr(url, '?') > 0)", "e AS (SELECT page_id, unnest(string_split(q, '&')) AS kv FROM p)", body="SELECT page_id, split_part(kv, '=', 1) AS name, url_decode(split_part(kv, '=', 2)) AS \"value\" FROM e WHERE kv <> ''"))
def url_query_pairs(lake: Lake) -> DataFrame:
    q = F.substring_index(F.regexp_extract("url", r"\?([^#]*)", 1), "#", 1)
    return lake.table("pages").where(F.instr("url", "?") > 0).select("page_id", F.explode(keys.query_pairs(q)).alias("p")).select("page_id", "p.name", "p.value")


# named versions, orders and ranges


@query("named_versions", over("version_log", "f AS (SELECT bucket, key, min(seq) AS named FROM version_log GROUP BY 1, 2)", "z AS (SELECT bucket, key, max(seq) AS nulls FROM version_log WHERE bucket IN ('b0', 'b3') GROUP BY 1, 2)", body="SELECT f.bucket, f.key, CASE WHEN f.named % 2 = 0 THEN 'null' ELSE CAST(f.named AS VARCHAR) END AS named, CASE WHEN f.named % 2 = 0 THEN z.nulls ELSE f.named END AS seq, v.marker FROM f LEFT JOIN z USING (bucket, key) LEFT JOIN version_log v ON v.seq = CASE WHEN f.named % 2 = 0 THEN z.nulls ELSE f.named END"))
def named_versions(lake: Lake) -> DataFrame:
    """The version that each request names: by its order, or the null one, which only buckets without versions of their own have."""
    log = lake.version_log().select(*KEY, "seq", "marker")
    first = log.groupBy(*KEY).agg(F.min("seq").alias("first"))
    asked = first.select(*KEY, F.when(F.col("first") % 2 == 0, "null").otherwise(F.col("first").cast("string")).alias("named"))
    nulls = log.where(F.col("bucket").isin("b0", "b3")).groupBy(*KEY).agg(F.max("seq").alias("pointer"))
    order = F.when(F.col("named") == "null", F.col("pointer")).otherwise(F.col("named").try_cast("long"))
    met = asked.join(nulls, KEY, "left").withColumn("seq", order)
    return met.join(log.select(*KEY, "seq", "marker"), [*KEY, "seq"], "left").select(*KEY, "named", "seq", "marker")


@query("reverse_rows", over(body="SELECT DISTINCT l_suppkey AS volume, l_partkey AS block FROM lineitem"))
def reverse_rows(lake: Lake) -> DataFrame:
    """Index rows (a volume's blocks) as keys in byte order, and what they decode to."""
    digits = lambda c: F.lpad(F.lower(F.hex(F.col(c))), 16, "0")
    rows = lake.table("lineitem").select(F.concat(digits("l_suppkey"), digits("l_partkey")).alias("row")).distinct()
    read = lambda at: F.conv(F.substring("row", at, 16), 16, 10).cast("long")
    return rows.select(read(1).alias("volume"), read(17).alias("block"))


@query("range_route_ceil", over("version_log", "s AS (SELECT bucket, key AS start FROM version_log WHERE marker GROUP BY 1, 2)", "k AS (SELECT DISTINCT bucket, key FROM version_log)", body="SELECT k.bucket, k.key, min(s.start) AS start FROM k LEFT JOIN s ON s.bucket = k.bucket AND s.start >= k.key GROUP BY 1, 2"))
def range_route_ceil(lake: Lake) -> DataFrame:
    log = lake.version_log()
    starts = log.where("marker").select("bucket", F.col("key").alias("start")).distinct()
    return merge.ceil_join(log.select(*KEY).distinct(), starts, by=["bucket"])


RANGES = "r AS (SELECT bucket, low, lead(low) OVER (PARTITION BY bucket ORDER BY low) AS high FROM (SELECT bucket, key AS low FROM version_log GROUP BY 1, 2))"


@query("merged_ranges", over("version_log", RANGES, "kept AS (SELECT * FROM r WHERE NOT contains(low, '7'))", "n AS (SELECT *, CASE WHEN lag(high) OVER w = low THEN 0 ELSE 1 END AS fresh FROM kept WINDOW w AS (PARTITION BY bucket ORDER BY low))", "g AS (SELECT *, sum(fresh) OVER (PARTITION BY bucket ORDER BY low) AS n FROM n)", body="SELECT bucket, min(low) AS low, CASE WHEN count(high) = count(*) THEN max(high) END AS high, count(*) AS ranges FROM g GROUP BY bucket, g.n"))
def merged_ranges(lake: Lake) -> DataFrame:
    """Ranges that border on one another as one; those that were taken away leave gaps."""
    lows = lake.version_log().select("bucket", F.col("key").alias("low")).distinct()
    ranges = lows.withColumn("high", F.lead("low").over(Window.partitionBy("bucket").orderBy("low")))
    return merge.merge_ranges(ranges.where(~F.contains(F.col("low"), F.lit("7"))), ["bucket"])


@query("multi_range_page", over("version_log", "ranked", "live AS (SELECT bucket, key, seq FROM ranked WHERE nth = 1 AND NOT marker AND ((key >= '1/' AND key < '2/') OR (key >= '4/2' AND key < '6/') OR key >= '8/'))", "p AS (SELECT *, row_number() OVER (ORDER BY key, bucket) AS n FROM live)", body="SELECT bucket, key, seq, (SELECT key || '/' || bucket FROM p WHERE n = 30) AS next FROM p WHERE n <= 30"))
def multi_range_page(lake: Lake) -> DataFrame:
    """One page over several ranges and three runs: what a range leaves of the limit goes to the next, and the page says where to go on."""
    log = lake.version_log().select(*KEY, "seq", "marker")
    spans = [("1/", "2/"), ("4/2", "6/"), ("8/", None)]
    within = F.lit(False)
    for low, high in spans:
        within = within | ((F.col("key") >= low) & (F.lit(True) if high is None else F.col("key") < high))
    runs = [log.where(within & (F.col("seq") % 3 == k)) for k in range(3)]
    found = merge.page(merge.merge_runs(runs, KEY).select(*KEY, "seq"), ["key", "bucket"], 30)
    last = F.max(F.struct("key", "bucket")).over(Window.partitionBy())
    return found.select(*KEY, "seq", F.when(F.col("truncated"), F.concat_ws("/", last["key"], last["bucket"])).alias("next"))


@query("reverse_page", over("version_log", "ranked", body="SELECT bucket, key, seq FROM ranked WHERE nth = 1 AND NOT marker ORDER BY key DESC, bucket DESC LIMIT 20"))
def reverse_page(lake: Lake) -> DataFrame:
    """A page in the reverse order of keys."""
    return merge.current(lake.version_log(), KEY).select(*KEY, "seq").orderBy(F.desc("key"), F.desc("bucket")).limit(20)


@query("range_meets", over("version_log", RANGES, body="SELECT bucket, low, low <= '4/5' AND (high IS NULL OR high > '4/5') AS holds, low < '6/' AND (high IS NULL OR high > '3/1') AS meets FROM r"))
def range_meets(lake: Lake) -> DataFrame:
    """Whether a range holds a route, and whether it meets a span."""
    lows = lake.version_log().select("bucket", F.col("key").alias("low")).distinct()
    high = F.lead("low").over(Window.partitionBy("bucket").orderBy("low"))
    beyond = lambda at: F.col("high").isNull() | (F.col("high") > at)
    return lows.withColumn("high", high).select("bucket", "low", ((F.col("low") <= "4/5") & beyond("4/5")).alias("holds"), ((F.col("low") < "6/") & beyond("3/1")).alias("meets"))


@query("pruned_merge", over("version_log", "runs AS (SELECT substr(key, 1, 1) AS run, min(key) AS low, max(key) AS high FROM version_log GROUP BY 1)", "ranked", body="SELECT (SELECT count(*) FROM runs WHERE low < '5/6' AND high >= '3/2') AS runs, bucket, count(*) AS keys, CAST(sum(seq) AS BIGINT) AS seqs FROM ranked WHERE nth = 1 AND NOT marker AND key >= '3/2' AND key < '5/6' GROUP BY bucket"))
def pruned_merge(lake: Lake) -> DataFrame:
    """A merge over a span that opens only the runs whose bounds meet it."""
    log = lake.version_log().select(*KEY, "seq", "marker").withColumn("run", F.substring("key", 1, 1))
    bounds = log.groupBy("run").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < '5/6' and high >= '3/2'")
    opened = log.join(bounds.select("run"), "run", "left_semi").where("key >= '3/2' and key < '5/6'")
    live = merge.current(opened, KEY).groupBy("bucket").agg(F.count("*").alias("keys"), F.sum("seq").alias("seqs"))
    return live.crossJoin(F.broadcast(bounds.agg(F.count("*").alias("runs")))).select("runs", "bucket", "keys", "seqs")


@query("write_batches", over("version_log", body="SELECT seq * 4 + i AS sequence, seq AS batch, ['put', 'merge', 'delete', 'delete_range'][i + 1] AS op, CASE i WHEN 2 THEN key || '/old' ELSE key END AS key, CASE i WHEN 0 THEN etag WHEN 1 THEN kind WHEN 3 THEN key || '0' END AS value FROM version_log, (SELECT unnest([0, 1, 2, 3]) AS i) WHERE i < 3 OR marker"))
def write_batches(lake: Lake) -> DataFrame:
    """The entries of write batches as rows, each with its own sequence number."""
    entry = lambda op, key, value: F.struct(F.lit(op).alias("op"), key.alias("key"), value.cast("string").alias("value"))
    k = F.col("key")
    batch = F.array(entry("put", k, F.col("etag")), entry("merge", k, F.col("kind")), entry("delete", F.concat(k, F.lit("/old")), F.lit(None)))
    whole = F.when(F.col("marker"), F.array_append(batch, entry("delete_range", k, F.concat(k, F.lit("0"))))).otherwise(batch)
    rows = lake.version_log().select("seq", F.posexplode(whole).alias("i", "e"))
    return rows.select((F.col("seq") * 4 + F.col("i")).alias("sequence"), F.col("seq").alias("batch"), "e.op", "e.key", "e.value")


@query("object_headers", over("version_log", body="SELECT seq, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.absent') AS absent, len(json_keys(props)) AS headers FROM version_log"))
def object_headers(lake: Lake) -> DataFrame:
    """Headers of stored objects, by name."""
    read = lake.version_log().select("seq", F.from_json("props", "map<string,string>").alias("h"))
    return read.select("seq", F.try_element_at("h", F.lit("k")).alias("k"), F.try_element_at("h", F.lit("absent")).alias("absent"), F.size("h").cast("long").alias("headers"))


_VARINT = "array_to_string(list_transform(list_filter(generate_series(0, 8), lambda i: i = 0 OR (v >> (7 * i)) > 0), lambda i: lpad(lower(to_hex(((v >> (7 * i)) & 127) + CASE WHEN i < 8 AND (v >> (7 * (i + 1))) > 0 THEN 128 ELSE 0 END)), 2, '0')), '')"


@query("varints", over("version_log", "n AS (SELECT seq, seq * seq * seq AS v FROM version_log)", body=f"SELECT seq, {_VARINT} AS digits, v AS number FROM n"))
def varints(lake: Lake) -> DataFrame:
    """Numbers as varints, and read back: cubes, which are written whole whatever their bits; one beyond a long reads as null."""
    n = F.col("seq").cast("decimal(19,0)")
    low, high = keys.halves(n * n * n)
    made = lake.version_log().select("seq", low.alias("low"), high.alias("high")).select("seq", keys.wide_varint(F.col("low"), F.col("high")).alias("digits"))
    return made.select("seq", "digits", keys.read_varint(F.concat("digits", F.lit("ff01")))["number"].alias("number"))


@query("length_prefixed", over("objects", "o AS (SELECT object, substr(body, 1, 500) AS t FROM objects WHERE body IS NOT NULL)", "n AS (SELECT object, t, CAST(octet_length(encode(t)) AS BIGINT) AS v FROM o)", body=f"SELECT object, md5({_VARINT} || lower(to_hex(encode(t)))) AS digest, md5(t) AS read, true AS refused FROM n"))
def length_prefixed(lake: Lake) -> DataFrame:
    """Texts with their length before them, read back; one that is cut is refused. A name or header is 500 characters at most here."""
    o = lake.objects().where("body is not null").select("object", F.substr("body", F.lit(1), F.lit(500)).alias("t"))
    made = o.select("object", "t", keys.sliced(F.col("t")).alias("digits"))
    cut = F.substr("digits", F.lit(1), F.length("digits") - 2)
    return made.select("object", F.md5("digits").alias("digest"), F.md5(keys.read_slice(F.col("digits"))).alias("read"), (keys.read_slice(cut).isNull() | (F.col("t") == "")).alias("refused"))


@query("budgeted_scan", over("version_log", "ranked", "k AS (SELECT bucket, key, marker FROM ranked WHERE nth = 1)", "c AS (SELECT *, sum(CAST(marker AS INT)) OVER (PARTITION BY bucket ORDER BY key ROWS UNBOUNDED PRECEDING) - CAST(marker AS INT) AS before FROM k)", body="SELECT bucket, CAST(before // 3 AS BIGINT) AS step, min(key) AS first, max(key) AS last, count(*) FILTER (NOT marker) AS live FROM c GROUP BY 1, 2"))
def budgeted_scan(lake: Lake) -> DataFrame:
    """The steps of a scan that pauses after three keys without a live version."""
    k = merge.newest(lake.version_log().select(*KEY, "seq", "marker"), KEY)
    barren = F.col("marker").cast("int")
    before = F.sum(barren).over(Window.partitionBy("bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)) - barren
    steps = k.withColumn("step", F.floor(before / 3))
    return steps.groupBy("bucket", "step").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count_if(~F.col("marker")).alias("live"))


_MARKS = "marks AS (SELECT bucket, substr(key, 1, 1 + greatest(coalesce(p, 0), coalesce(q, 0))) AS mark, 1 + greatest(coalesce(p, 0), coalesce(q, 0)) >= length(key) AS whole FROM (SELECT bucket, key, (SELECT count(*) FROM (SELECT unnest(generate_series(1, length(key))) AS i) WHERE substr(key, 1, i) = substr(a, 1, i)) AS p, (SELECT count(*) FROM (SELECT unnest(generate_series(1, length(key))) AS i) WHERE substr(key, 1, i) = substr(b, 1, i)) AS q FROM (SELECT bucket, key, lag(key) OVER w AS a, lead(key) OVER w AS b FROM k WINDOW w AS (PARTITION BY bucket ORDER BY key))))"


@query("range_filters", over("version_log", "k AS (SELECT DISTINCT bucket, key FROM version_log)", _MARKS, "s AS (SELECT DISTINCT bucket, (user_id % 10) || '/' || (user_id + 40) AS low, (user_id % 10) || '/' || (user_id + 43) AS high FROM version_log)", body="SELECT bucket, low, high, EXISTS (SELECT 1 FROM marks m WHERE m.bucket = s.bucket AND mark < high AND (mark >= low OR (NOT whole AND starts_with(low, mark)))) AS may_hold FROM s WHERE low < high"))
def range_filters(lake: Lake) -> DataFrame:
    """Whether a filter of each bucket's cut keys may hold a key of a span."""
    log = lake.version_log()
    lead = F.concat((F.col("user_id") % 10).cast("string"), F.lit("/"))
    spans = log.select("bucket", F.concat(lead, (F.col("user_id") + 40).cast("string")).alias("low"), F.concat(lead, (F.col("user_id") + 43).cast("string")).alias("high")).distinct().where("low < high")
    return merge.may_hold(spans, merge.range_filter(log.select(*KEY), ["bucket"]), ["bucket"])
