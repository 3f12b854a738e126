"""Queries on rules: lifecycle, locks, preconditions, policies, CORS, names and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import keys, requests, rules
from cairn.operators import merge
from cairn.sources.views import Lake

from .registry import query
from .sql import over

KEY = ["bucket", "key"]
#: The lifecycle rules of these queries (ordinal, id, prefix, least size, most size, days, newer kept, marker).
RULES = [(0, "logs", "1/", 10, 100_000, 30, 2, True), (1, "all", "", -1, 1 << 40, 90, 0, False), (2, "tmp", "7/", -1, 5_000, 30, 1, True)]
RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"({o}, '{i}', '{p}', {lo}, {hi}, {d}, {n}, {str(m).lower()})" for o, i, p, lo, hi, d, n, m in RULES) + ") t(ordinal, rule, prefix, lo, hi, days, newer, on_marker))"
DAY = 86_400_000_000


def rule_table(lake: Lake) -> DataFrame:
    return lake.spark.createDataFrame(RULES, "ordinal int, rule string, prefix string, lo long, hi long, days int, newer int, on_marker boolean")


def due_sql(start: str, days: str) -> str:
    return f"CAST(((CAST({start} AS HUGEINT) + {days} * {DAY} + {DAY - 1}) // {DAY}) * {DAY} AS BIGINT)"


def first_sql(source: str, at: str, where: str, ids: str = "bucket, key") -> str:
    return f"SELECT {ids}, due, rule FROM (SELECT {ids}, {at} AS due, rule, row_number() OVER (PARTITION BY {ids} ORDER BY {at}, ordinal) AS n FROM {source} JOIN rules ON {where}) WHERE n = 1"


APPLIES = "starts_with(key, prefix) AND size > lo AND size < hi"


def applies() -> F.Column:
    return F.col("key").startswith(F.col("prefix")) & (F.col("size") > F.col("lo")) & (F.col("size") < F.col("hi"))


@query("lifecycle_expiry", over("version_log", "ranked", RULES_SQL, body=first_sql("(SELECT * FROM ranked WHERE nth = 1 AND NOT marker)", due_sql("created", "days"), APPLIES)))
def lifecycle_expiry(lake: Lake) -> DataFrame:
    live = merge.current(lake.version_log(), KEY)
    return rules.earliest(live, rule_table(lake), applies(), rules.due(F.col("created"), F.col("days")), KEY)


@query("noncurrent_expiry", over("version_log", "old AS (SELECT *, lag(created) OVER w AS since, row_number() OVER w - 2 AS newer_than FROM version_log WINDOW w AS (PARTITION BY bucket, key ORDER BY seq DESC))", RULES_SQL, body=first_sql("(SELECT * FROM old WHERE since IS NOT NULL)", due_sql("since", "days"), APPLIES + " AND newer_than >= newer", "bucket, key, seq")))
def noncurrent_expiry(lake: Lake) -> DataFrame:
    w = Window.partitionBy(*KEY).orderBy(F.desc("seq"))
    old = lake.version_log().withColumns({"since": F.lag("created").over(w), "newer_than": F.row_number().over(w) - 2}).where("since is not null")
    return rules.earliest(old, rule_table(lake), applies() & (F.col("newer_than") >= F.col("newer")), rules.due(F.col("since"), F.col("days")), [*KEY, "seq"])


@query("marker_expiry", over("version_log", "ranked", RULES_SQL, body=first_sql("(SELECT * FROM ranked WHERE nth = 1 AND marker)", f"CASE WHEN on_marker THEN {due_sql('created', '0')} ELSE {due_sql('created', 'days')} END", "starts_with(key, prefix)")))
def marker_expiry(lake: Lake) -> DataFrame:
    top = merge.newest(lake.version_log(), KEY).where("marker")
    at = F.when(F.col("on_marker"), rules.due(F.col("created"), F.lit(0))).otherwise(rules.due(F.col("created"), F.col("days")))
    return rules.earliest(top, rule_table(lake), F.col("key").startswith(F.col("prefix")), at, KEY)


@query("upload_abort", over("files", RULES_SQL, "u AS (SELECT file AS seq, (owner % 10) || '/' || owner AS key, made FROM files)", body=first_sql("u", due_sql("made", "days"), "starts_with(key, prefix)", "key, seq")))
def upload_abort(lake: Lake) -> DataFrame:
    u = lake.files().select(F.col("file").alias("seq"), F.concat_ws("/", (F.col("owner") % 10).cast("string"), F.col("owner").cast("string")).alias("key"), "made")
    return rules.earliest(u, rule_table(lake), F.col("key").startswith(F.col("prefix")), rules.due(F.col("made"), F.col("days")), ["key", "seq"])


@query("expiration_header", over("version_log", "ranked", RULES_SQL, "e AS (" + first_sql("(SELECT * FROM ranked WHERE nth = 1 AND NOT marker)", due_sql("created", "days"), APPLIES) + ")", body="SELECT bucket, key, 'expiry-date=\"' || strftime(make_timestamp(due), '%a, %d %b %Y %H:%M:%S GMT') || '\", rule-id=\"' || rule || '\"' AS header FROM e"))
def expiration_header(lake: Lake) -> DataFrame:
    e = lifecycle_expiry(lake)
    return e.select(*KEY, F.concat(F.lit('expiry-date="'), requests.http_date(F.floor(F.col("due") / 1_000_000)), F.lit('", rule-id="'), "rule", F.lit('"')).alias("header"))


@query("retention_until", over("version_log", body=f"SELECT bucket, key, seq, created + (CASE kind WHEN 'purchase' THEN 2 * 365 WHEN 'view' THEN 30 ELSE 7 END) * CAST({DAY} AS BIGINT) AS until FROM version_log WHERE NOT marker"))
def retention_until(lake: Lake) -> DataFrame:
    """A default period in days, or in years of 365 days."""
    days = F.when(F.col("kind") == "purchase", 2 * 365).when(F.col("kind") == "view", 30).otherwise(7)
    return lake.version_log().where("not marker").select(*KEY, "seq", (F.col("created") + days.cast("long") * DAY).alias("until"))


NOW = 1_704_500_000_000_000  # microseconds
LOCKS = """locks AS (SELECT seq, CASE WHEN kind = 'purchase' THEN 'COMPLIANCE' WHEN kind = 'view' THEN 'GOVERNANCE' END AS mode, CASE WHEN kind IN ('purchase', 'view') THEN created + (seq % 20) * CAST(86400000000 AS BIGINT) END AS until, CASE WHEN seq % 11 = 0 THEN true WHEN seq % 11 = 1 THEN false END AS hold, seq % 2 = 0 AS bypass FROM version_log)"""


def locks(lake: Lake) -> DataFrame:
    has = F.col("kind").isin("purchase", "view")
    return lake.version_log().select(
        "seq",
        F.when(F.col("kind") == "purchase", "COMPLIANCE").when(F.col("kind") == "view", "GOVERNANCE").alias("mode"),
        F.when(has, F.col("created") + (F.col("seq") % 20) * DAY).alias("until"),
        F.when(F.col("seq") % 11 == 0, True).when(F.col("seq") % 11 == 1, False).alias("hold"),
        (F.col("seq") % 2 == 0).alias("bypass"),
    )


@query("lock_protected", over("version_log", LOCKS, body=f"SELECT seq, coalesce(hold, false) OR coalesce(until > {NOW} AND (mode = 'COMPLIANCE' OR NOT bypass), false) AS protected FROM locks"))
def lock_protected(lake: Lake) -> DataFrame:
    return locks(lake).select("seq", rules.locked(F.col("mode"), F.col("until"), F.col("hold"), F.lit(NOW), F.col("bypass")).alias("protected"))


@query("retention_change", over("version_log", LOCKS, body=f"SELECT seq, NOT coalesce(until > {NOW}, false) OR coalesce(mode = 'GOVERNANCE' AND {NOW + 10 * DAY} >= until, false) OR (coalesce(mode = 'GOVERNANCE', false) AND bypass) AS allowed FROM locks"))
def retention_change(lake: Lake) -> DataFrame:
    allowed = rules.may_retain(F.col("mode"), F.col("until"), F.lit("GOVERNANCE"), F.lit(NOW + 10 * DAY), F.lit(NOW), F.col("bypass"))
    return locks(lake).select("seq", allowed.alias("allowed"))


def tagged(lake: Lake) -> DataFrame:
    """Requests with preconditions drawn from the log: some name the tag, some another, weakly or not, some any."""
    tag, k = F.concat(F.lit('"'), "etag", F.lit('"')), F.col("seq") % 7
    return lake.version_log().select(
        "seq", "marker", "etag", F.floor(F.col("created") / 1_000_000).alias("modified"),
        F.when(k == 0, tag).when(k == 1, F.lit('"x", "y"')).when(k == 2, F.concat(F.lit("W/"), tag)).when(k == 3, F.lit("*")).alias("if_match"),
        F.when(F.col("seq") % 5 == 0, F.concat(F.lit("W/"), tag)).when(F.col("seq") % 5 == 1, F.lit('"z"')).alias("if_none_match"),
        F.when(F.col("seq") % 3 == 0, F.lit(1_704_200_000)).alias("unmodified_since"),
        F.when(F.col("seq") % 4 == 0, F.lit(1_704_300_000)).alias("modified_since"),
    )


TAGGED = """tagged AS (SELECT seq, marker, etag, created // 1000000 AS modified, CASE seq % 7 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true END AS im, CASE seq % 5 WHEN 0 THEN true WHEN 1 THEN false END AS inm,
    CASE WHEN seq % 3 = 0 THEN 1704200000 END AS us, CASE WHEN seq % 4 = 0 THEN 1704300000 END AS ms FROM version_log)"""


@query("conditional_read", over("version_log", TAGGED, body="SELECT seq, CAST(CASE WHEN marker THEN 404 WHEN im IS NOT NULL AND NOT im THEN 412 WHEN im IS NULL AND coalesce(modified > us, false) THEN 412 WHEN coalesce(inm, false) THEN 304 WHEN inm IS NULL AND coalesce(modified <= ms, false) THEN 304 ELSE 200 END AS INT) AS status FROM tagged"))
def conditional_read(lake: Lake) -> DataFrame:
    c = F.col
    return tagged(lake).select("seq", requests.read_outcome(~c("marker"), c("etag"), c("modified"), c("if_match"), c("if_none_match"), c("unmodified_since"), c("modified_since")).alias("status"))


@query("conditional_write", over("version_log", TAGGED, body="SELECT seq, CAST(CASE WHEN NOT marker AND coalesce(inm, false) THEN 412 WHEN im IS NOT NULL AND marker THEN 404 WHEN im IS NOT NULL AND NOT im THEN 412 ELSE 200 END AS INT) AS status FROM tagged"))
def conditional_write(lake: Lake) -> DataFrame:
    c = F.col
    return tagged(lake).select("seq", requests.write_outcome(~c("marker"), c("etag"), c("if_match"), c("if_none_match")).alias("status"))


@query("conditional_delete", over("version_log", TAGGED, body="SELECT seq, CAST(CASE WHEN im IS NULL THEN 204 WHEN seq % 9 = 0 THEN 404 WHEN marker THEN 412 WHEN im THEN 204 ELSE 412 END AS INT) AS status FROM tagged"))
def conditional_delete(lake: Lake) -> DataFrame:
    state = F.when(F.col("seq") % 9 == 0, "missing").when(F.col("marker"), "marker").otherwise("present")
    return tagged(lake).select("seq", requests.delete_outcome(state, F.col("etag"), F.col("if_match")).alias("status"))


@query("byte_span", over("version_log", "r AS (SELECT seq, greatest(size, 0) AS size, CAST(seq % 7 AS INT) AS k, seq * 3 AS a FROM version_log)", body="""SELECT seq, CASE WHEN k IN (0, 5) THEN 'whole' WHEN size = 0 THEN 'unsatisfiable' WHEN k IN (1, 2) AND a >= size THEN 'unsatisfiable' WHEN k = 4 THEN 'unsatisfiable' WHEN k = 6 AND 10 >= size THEN 'unsatisfiable' ELSE 'part' END AS kind,
    CASE WHEN size = 0 THEN NULL WHEN k IN (1, 2) AND a < size THEN a WHEN k = 3 THEN greatest(size - 500, 0) WHEN k = 6 AND 10 < size THEN 10 END AS first,
    CASE WHEN size = 0 THEN NULL WHEN k = 1 AND a < size THEN least(a + 99, size - 1) WHEN k = 2 AND a < size THEN size - 1 WHEN k = 3 THEN size - 1 WHEN k = 6 AND 10 < size THEN 10 END AS last FROM r"""))
def byte_span(lake: Lake) -> DataFrame:
    a = F.col("seq") * 3
    text = lambda *x: F.concat(*x)
    k = F.col("seq") % 7
    header = F.when(k == 1, text(F.lit("bytes="), a.cast("string"), F.lit("-"), (a + 99).cast("string"))).when(k == 2, text(F.lit("bytes="), a.cast("string"), F.lit("-"))).when(k == 3, F.lit("bytes=-500")).when(k == 4, F.lit("bytes=-0")).when(k == 5, F.lit("bytes=9-1")).when(k == 6, F.lit("bytes= 10-10 "))
    return lake.version_log().select("seq", requests.byte_span(header, F.greatest("size", F.lit(0).cast("long"))).alias("s")).select("seq", "s.*")


@query("copy_span", over("version_log", body="SELECT seq, CASE WHEN seq % 3 = 0 THEN 'malformed' WHEN seq + 50 < greatest(size, 0) THEN 'ok' ELSE 'outside' END AS verdict FROM version_log"))
def copy_span(lake: Lake) -> DataFrame:
    header = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("bytes="), F.col("seq").cast("string"), F.lit("-"))).otherwise(F.concat(F.lit("bytes="), F.col("seq").cast("string"), F.lit("-"), (F.col("seq") + 50).cast("string")))
    return lake.version_log().select("seq", requests.copy_span(header, F.greatest("size", F.lit(0).cast("long"))).alias("verdict"))


REQUESTS = """req AS (SELECT seq, kind, user_id, bucket || '/' || key AS resource, '10.' || (user_id % 4) || '.' || (seq % 256) || '.' || (seq % 7) AS ip, CASE WHEN seq % 3 = 0 THEN CAST(CAST(size AS VARCHAR) AS VARCHAR) END AS length FROM version_log)"""


def asked(lake: Lake) -> DataFrame:
    s = lambda c: (c if not isinstance(c, str) else F.col(c)).cast("string")
    return lake.version_log().select("seq", "kind", "user_id", F.concat("bucket", F.lit("/"), "key").alias("resource"), F.concat(F.lit("10."), s(F.col("user_id") % 4), F.lit("."), s(F.col("seq") % 256), F.lit("."), s(F.col("seq") % 7)).alias("ip"), F.when(F.col("seq") % 3 == 0, s("size")).alias("length"))


@query("policy_verdict", over("version_log", REQUESTS, "m AS (SELECT seq, (kind IN ('view', 'click') AND regexp_full_match(resource, 'b[0-2]/.*')) AS a1, (user_id = 7) AS a2, (kind = 'click' AND regexp_full_match(resource, 'b./5/.*')) AS d1, coalesce(CAST(length AS DOUBLE) > 20000, false) AS d2 FROM req)", body="SELECT seq, CASE WHEN d1 OR d2 THEN 'deny' WHEN a1 OR a2 THEN 'allow' ELSE 'none' END AS verdict FROM m"))
def policy_verdict(lake: Lake) -> DataFrame:
    r = asked(lake)
    like = lambda p: F.col("resource").rlike(rules.wildcard(p))
    statements = [
        (True, F.col("kind").isin("view", "click") & (like("b0/*") | like("b1/*") | like("b2/*"))),
        (True, F.col("user_id") == 7),
        (False, (F.col("kind") == "click") & like("b?/5/*")),
        (False, rules.condition("NumericGreaterThan", F.when(F.col("length").isNotNull(), F.array("length")), ["20000"])),
    ]
    return rules.verdict(r, statements, ["seq"])


@query("policy_authorize", over("version_log", "v AS (SELECT seq, CASE WHEN kind = 'click' THEN 'deny' WHEN kind = 'view' THEN 'allow' ELSE 'none' END AS verdict, user_id % 5 = 0 AS owner, user_id % 2 = 0 AS public FROM version_log)", body="SELECT seq, CASE WHEN owner AND seq % 13 = 0 THEN true WHEN verdict = 'deny' THEN false WHEN owner THEN true WHEN public THEN false ELSE verdict = 'allow' END AS allowed FROM v"))
def policy_authorize(lake: Lake) -> DataFrame:
    verdict = F.when(F.col("kind") == "click", "deny").when(F.col("kind") == "view", "allow").otherwise("none")
    return lake.version_log().select("seq", rules.authorized(verdict, F.col("user_id") % 5 == 0, F.col("seq") % 13 == 0, F.col("user_id") % 2 == 0, F.lit(True)).alias("allowed"))


@query("condition_operators", over("version_log", REQUESTS, body="""SELECT seq, kind = 'view' AS string_equals, NOT (kind IN ('view', 'click')) AS string_not_equals, starts_with(resource, 'b1/') AS string_like, coalesce(CAST(length AS DOUBLE) < 5000, false) AS numeric_less, coalesce(CAST(length AS DOUBLE) < 5000, true) AS numeric_less_if_exists, coalesce(CAST(length AS DOUBLE) <> 100, true) AS numeric_not, length IS NULL AS is_null,
    coalesce(CAST(length AS DOUBLE) >= 100, true) AS for_all, coalesce(CAST(length AS DOUBLE) >= 100, false) AS for_any FROM req"""))
def condition_operators(lake: Lake) -> DataFrame:
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c))
    c = rules.condition
    return asked(lake).select(
        "seq",
        c("StringEquals", one("kind"), ["view"]).alias("string_equals"),
        c("StringEquals", one("kind"), ["view", "click"], negated=True).alias("string_not_equals"),
        c("StringLike", one("resource"), ["b1/*"]).alias("string_like"),
        c("NumericLessThan", one("length"), ["5000"]).alias("numeric_less"),
        c("NumericLessThan", one("length"), ["5000"], if_exists=True).alias("numeric_less_if_exists"),
        c("NumericEquals", one("length"), ["100"], negated=True).alias("numeric_not"),
        c("Null", one("length"), ["true"]).alias("is_null"),
        c("NumericGreaterThanEquals", one("length"), ["100"], quantifier="all").alias("for_all"),
        c("NumericGreaterThanEquals", one("length"), ["100"], quantifier="any").alias("for_any"),
    )


@query("cidr_v4", over("version_log", REQUESTS, body="SELECT seq, ip, split_part(ip, '.', 2) IN ('0', '1') AS inside, CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) AS number FROM req"))
def cidr_v4(lake: Lake) -> DataFrame:
    return asked(lake).select("seq", "ip", rules.in_cidr(F.col("ip"), F.lit("10.0.0.0"), 15).alias("inside"), rules.ipv4(F.col("ip")).alias("number"))


@query("arn_match", over("version_log", REQUESTS, body="SELECT seq, resource LIKE 'b1/3/%' OR resource LIKE 'b2/%' AS matched FROM req"))
def arn_match(lake: Lake) -> DataFrame:
    arn = F.concat(F.lit("arn:aws:s3:::"), "resource")
    return asked(lake).select("seq", (rules.arn_like(arn, "arn:aws:s3:::b1/3/*") | rules.arn_like(arn, "arn:*:s3:::b2/*")).alias("matched"))


@query("cors_match", over("version_log", "q AS (SELECT seq, 'https://' || bucket || '.example.' || CASE WHEN seq % 2 = 0 THEN 'com' ELSE 'org' END AS origin, CASE seq % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'PUT' ELSE 'DELETE' END AS method, seq % 5 = 0 AS odd FROM version_log)", body="""SELECT seq, CAST(CASE WHEN origin = 'https://b1.example.com' AND method IN ('GET', 'PUT') AND NOT odd THEN 0 WHEN origin LIKE 'https://%.example.com' AND method IN ('GET', 'DELETE') THEN 1 WHEN method = 'GET' AND NOT odd THEN 2 END AS INT) AS rule FROM q"""))
def cors_match(lake: Lake) -> DataFrame:
    origin = F.concat(F.lit("https://"), "bucket", F.lit(".example."), F.when(F.col("seq") % 2 == 0, "com").otherwise("org"))
    method = F.when(F.col("seq") % 3 == 0, "GET").when(F.col("seq") % 3 == 1, "PUT").otherwise("DELETE")
    headers = F.when(F.col("seq") % 5 == 0, F.array(F.lit("X-Other"), F.lit("content-type"))).otherwise(F.array(F.lit("Content-Type")))
    table = [(["https://b1.example.com"], ["GET", "PUT"], ["content-*"]), (["https://*.example.com"], ["GET", "DELETE"], ["*"]), (["*"], ["GET"], ["Content-Type"])]
    return lake.version_log().select("seq", rules.first_allowing(origin, method, headers, table).alias("rule"))


@query("bucket_names", over("n AS (SELECT DISTINCT lower(split_part(split_part(url, '://', 2), '/', 1)) || CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '-s3alias' WHEN 2 THEN '.' ELSE '_x' END AS name FROM pages UNION SELECT * FROM (VALUES ('10.1.2.3'), ('ab'), ('xn--abc'), ('good-name'), ('Bad'), ('a..b')) t(name))", body="SELECT name, length(name) BETWEEN 3 AND 63 AND regexp_full_match(name, '[a-z0-9]([a-z0-9-]*[a-z0-9])?(\\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)*') AND NOT regexp_full_match(name, '[0-9]+(\\.[0-9]+){3}') AND NOT starts_with(name, 'xn--') AND NOT ends_with(name, '-s3alias') AS valid FROM n"))
def bucket_names(lake: Lake) -> DataFrame:
    p = F.col("page_id") % 4
    names = lake.table("pages").select(F.concat(F.lower(F.regexp_extract("url", "://([^/]*)", 1)), F.when(p == 0, "").when(p == 1, "-s3alias").when(p == 2, ".").otherwise("_x")).alias("name"))
    more = lake.spark.createDataFrame([(x,) for x in ("10.1.2.3", "ab", "xn--abc", "good-name", "Bad", "a..b")], "name string")
    return names.union(more).distinct().select("name", keys.bucket_name_valid(F.col("name")).alias("valid"))


@query("tag_checks", over("version_log", "k AS (SELECT DISTINCT kind, key FROM version_log)", body="SELECT kind, key, CASE WHEN length(key) > 5 THEN 'InvalidTagValue' WHEN kind = 'error' THEN 'DuplicateTag' END AS fault FROM k"))
def tag_checks(lake: Lake) -> DataFrame:
    """The first fault of a tag set: names repeat, or a value is too long."""
    k = lake.version_log().select("kind", "key").distinct()
    tags = F.array(F.struct(F.lit("kind").alias("k"), F.col("kind").alias("v")), F.struct(F.when(F.col("kind") == "error", "kind").otherwise("key").alias("k"), F.col("key").alias("v")))
    names = F.transform(tags, lambda t: t["k"])
    long_ = F.exists(tags, lambda t: (F.length(t["v"]) > 5) & (t["v"] != F.col("kind")))
    return k.select("kind", "key", F.when(long_, "InvalidTagValue").when(F.size(F.array_distinct(names)) < F.size(names), "DuplicateTag").alias("fault"))


@query("lifecycle_faults", over(RULES_SQL, body="SELECT rule, CASE WHEN days <= 0 THEN 'days' WHEN lo >= hi THEN 'sizes' WHEN on_marker AND prefix = '' THEN 'scope' END AS fault FROM rules"))
def lifecycle_faults(lake: Lake) -> DataFrame:
    """The first fault of each rule of a lifecycle document."""
    return rule_table(lake).select("rule", F.when(F.col("days") <= 0, "days").when(F.col("lo") >= F.col("hi"), "sizes").when(F.col("on_marker") & (F.col("prefix") == ""), "scope").alias("fault"))


@query("request_operations", over("version_log", body="SELECT seq, CASE kind WHEN 'view' THEN 'GetObject' WHEN 'click' THEN 'ListParts' WHEN 'purchase' THEN 'UploadPart' WHEN 'signup' THEN 'ListObjectsV2' ELSE 'DeleteObject' END AS operation FROM version_log"))
def request_operations(lake: Lake) -> DataFrame:
    kind = F.col("kind")
    method = F.when(kind == "purchase", "PUT").when(kind == "error", "DELETE").otherwise("GET")
    flags = F.when(kind == "click", F.array(F.lit("uploadId"))).when(kind == "purchase", F.array(F.lit("partNumber"), F.lit("uploadId"))).when(kind == "signup", F.array(F.lit("list-type"))).otherwise(F.array().cast("array<string>"))
    return lake.version_log().select("seq", requests.operation(method, kind != "signup", flags).alias("operation"))


@query("http_dates", over("version_log", body="SELECT seq, strftime(make_timestamp((created // 1000000) * 1000000), '%a, %d %b %Y %H:%M:%S GMT') AS http, strftime(make_timestamp((created // 1000000) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS iso, created // 1000000 AS seconds FROM version_log"))
def http_dates(lake: Lake) -> DataFrame:
    s = F.floor(F.col("created") / 1_000_000)
    v = lake.version_log().select("seq", requests.http_date(s).alias("http"), requests.iso_millis(s * 1000).alias("iso"))
    return v.withColumn("seconds", requests.parse_http_date(F.col("http")))


@query("upload_rules_due_first", over("version_log", "ranked", RULES_SQL, "e AS (" + first_sql("(SELECT * FROM ranked WHERE nth = 1 AND NOT marker)", due_sql("created", "days"), APPLIES) + ")", body="SELECT rule, count(*) AS objects, min(due) AS first, max(due) AS last FROM e GROUP BY rule"))
def upload_rules_due_first(lake: Lake) -> DataFrame:
    return lifecycle_expiry(lake).groupBy("rule").agg(F.count("*").alias("objects"), F.min("due").alias("first"), F.max("due").alias("last"))
