"""Queries on what requests carry: routes, documents in XML and JSON, policies, forms, signatures, texts and lengths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import keys, requests, rules, wire
from cairn.operators import listing, merge
from cairn.sources.views import Lake

from .registry import query
from .sql import over


def text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# routes and pages


#: Fixed values of this query: the requests that cycle through the log, by what decides their route.
REQUESTS = [
    (m, b, k, flags, copies)
    for b, k, flags in [
        (False, False, ""), (True, False, ""), (True, True, ""), (True, False, "list-type"), (True, True, "encryption"),
        *[(True, False, s) for s in ("location", "versioning", "tagging", "acl", "ownershipControls", "lifecycle", "cors", "policy", "policyStatus", "object-lock", "publicAccessBlock", "encryption", "versions", "uploads", "delete", "website", "retention", "uploadId")],
        *[(True, True, s) for s in ("tagging", "acl", "retention", "legal-hold", "attributes", "uploads", "uploadId", "partNumber uploadId", "lifecycle", "restore")],
    ]
    for m in ("GET", "PUT", "POST", "DELETE", "HEAD", "OPTIONS", "PATCH")
    for copies in ((False, True) if m == "PUT" else (False,))
]


def _routed(method: str, bucket: bool, key: bool, flags: str, copies: bool) -> str:
    """The same in plain Python, for the SQL text."""
    names = flags.split()
    if method == "OPTIONS":
        return "Preflight" if bucket else requests.REFUSED
    if set(names) & set(requests.NOT_SERVED):
        return requests.MISSING
    if not bucket:
        return "ListBuckets" if method == "GET" else requests.REFUSED
    if key and "encryption" in names:
        return requests.MISSING
    own, other = (requests.OBJECT_ROUTES, requests.BUCKET_ROUTES) if key else (requests.BUCKET_ROUTES, requests.OBJECT_ROUTES)
    named = next((own[n].get(method, requests.REFUSED) for n in own if n in names), None)
    if named is None and any(n in other and n not in own for n in names):
        return requests.REFUSED
    if named == "UploadPart" and "partNumber" not in names:
        return requests.REFUSED
    if named == "UploadPart" and copies:
        return "UploadPartCopy"
    if named is None and key:
        named = "CopyObject" if method == "PUT" and copies else requests.OBJECT_METHODS.get(method, requests.REFUSED)
    if named is None:
        named = "ListObjectsV2" if method == "GET" and "list-type" in names else requests.BUCKET_METHODS.get(method, requests.REFUSED)
    return named


_ROUTES_SQL = "r AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{_routed(*r)}')" for i, r in enumerate(REQUESTS)) + ") t(i, operation))"


@query("request_routes", over("version_log", _ROUTES_SQL, body=f"SELECT seq, operation FROM version_log JOIN r ON r.i = seq % {len(REQUESTS)}"))
def request_routes(lake: Lake) -> DataFrame:
    """Every operation, and the requests that name none: by method, target, subresource and copy source."""
    pick = lambda k, kind: F.get(F.array(*[F.lit(r[k]).cast(kind) for r in REQUESTS]), (F.col("seq") % len(REQUESTS)).cast("int"))
    sent = lake.version_log().select("seq", *[pick(k, kind).alias(name) for k, (name, kind) in enumerate((("method", "string"), ("bucket", "boolean"), ("key", "boolean"), ("flags", "string"), ("copies", "boolean")))])
    names = F.filter(F.split("flags", " "), lambda x: x != "")
    list_type = F.when(F.array_contains(names, "list-type"), "2")
    return sent.select("seq", requests.operation(F.col("method"), F.col("key"), names, F.col("bucket"), F.col("copies"), list_type).alias("operation"))


@query("max_keys", over("version_log", body="SELECT seq, CASE seq % 5 WHEN 0 THEN 1000 WHEN 1 THEN user_id WHEN 2 THEN NULL WHEN 3 THEN 5000 + user_id ELSE NULL END AS asked, least(CASE seq % 5 WHEN 0 THEN 1000 WHEN 1 THEN user_id WHEN 2 THEN NULL WHEN 3 THEN 5000 + user_id ELSE NULL END, 1000) AS \"limit\" FROM version_log"))
def max_keys(lake: Lake) -> DataFrame:
    k = F.col("seq") % 5
    sent = F.when(k == 1, F.concat(F.lit(" "), text("user_id"))).when(k == 2, F.concat(F.lit("-"), text("user_id"))).when(k == 3, text(F.col("user_id") + 5000)).when(k == 4, F.concat(text("user_id"), F.lit("x")))
    return lake.version_log().select("seq", requests.max_keys(sent).alias("m")).select("seq", "m.*")


# documents


def _document(lake: Lake, root: str, item: Column, broken: Column) -> DataFrame:
    """One document of each upload, an item a part; some are cut short."""
    whole = F.concat(F.lit(f"<{root}>"), F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("part", item.alias("x")))), lambda p: p["x"]), ""), F.lit(f"</{root}>"))
    made = lake.parts().groupBy("upload").agg(whole.alias("body"))
    return made.withColumn("body", F.when(broken, F.substr("body", F.lit(1), F.length("body") - 3)).otherwise(F.col("body")))


def cut_short() -> Column:
    return F.col("upload") % 9 == 4


@query("delete_documents", over("parts", "p AS (SELECT DISTINCT upload, part, role FROM parts)", "n AS (SELECT *, row_number() OVER (PARTITION BY upload ORDER BY part, role) - 1 AS place FROM p)", body="SELECT upload, CAST(place AS INT) AS place, 'a&b/' || part || role AS \"Key\", CASE WHEN part % 2 = 0 THEN CAST(part AS VARCHAR) END AS \"VersionId\", false AS broken FROM n WHERE upload % 9 <> 4 UNION ALL SELECT upload, NULL, NULL, NULL, true FROM (SELECT DISTINCT upload FROM parts WHERE upload % 9 = 4)"))
def delete_documents(lake: Lake) -> DataFrame:
    """Objects of batch deletion documents as rows; a malformed document is one row."""
    item = F.concat(F.lit("<Object><Key>a&amp;b/"), text("part"), F.col("role"), F.lit("</Key>"), F.when(F.col("part") % 2 == 0, F.concat(F.lit("<VersionId>"), text("part"), F.lit("</VersionId>"))).otherwise(""), F.lit("</Object>"))
    rows = wire.document_rows(_document(lake, "Delete", F.concat(item), cut_short()), "body", wire.delete_batch, ["Key", "VersionId"])
    return rows.select("upload", "place", "Key", "VersionId", F.col("fault").isNotNull().alias("broken"))


@query("completed_documents", over("parts", "p AS (SELECT DISTINCT upload, part, md5(body) AS etag FROM parts)", "n AS (SELECT *, row_number() OVER (PARTITION BY upload ORDER BY part, etag) - 1 AS place FROM p)", body="SELECT upload, CAST(place AS INT) AS place, CAST(part AS VARCHAR) AS \"PartNumber\", '\"' || etag || '\"' AS \"ETag\" FROM n WHERE upload % 9 <> 4"))
def completed_documents(lake: Lake) -> DataFrame:
    """The listed parts of completion documents as rows."""
    item = F.concat(F.lit("<Part><PartNumber>"), text("part"), F.lit("</PartNumber><ETag>&quot;"), F.md5("body"), F.lit("&quot;</ETag></Part>"))
    rows = wire.document_rows(_document(lake, "CompleteMultipartUpload", item, cut_short()), "body", wire.completed_parts, ["PartNumber", "ETag"])
    return rows.where("fault is null").select("upload", "place", "PartNumber", "ETag")


@query("lifecycle_documents", over("parts", "p AS (SELECT DISTINCT upload, part FROM parts)", "n AS (SELECT *, row_number() OVER (PARTITION BY upload ORDER BY part) - 1 AS place FROM p)", body="SELECT upload, CAST(place AS INT) AS place, 'r' || part AS \"ID\", CASE WHEN part % 3 = 0 THEN 'Disabled' ELSE 'Enabled' END AS \"Status\", part || '/' AS \"Prefix\", CASE WHEN part % 2 = 0 THEN CAST(part * 10 + 1 AS VARCHAR) END AS \"Days\", CASE WHEN part % 2 = 1 THEN CAST(part + 1 AS VARCHAR) END AS \"NoncurrentDays\" FROM n WHERE upload % 9 <> 4"))
def lifecycle_documents(lake: Lake) -> DataFrame:
    """Rules of lifecycle documents as rows."""
    days = F.when(F.col("part") % 2 == 0, F.concat(F.lit("<Expiration><Days>"), text(F.col("part") * 10 + 1), F.lit("</Days></Expiration>"))).otherwise(F.concat(F.lit("<NoncurrentVersionExpiration><NoncurrentDays>"), text(F.col("part") + 1), F.lit("</NoncurrentDays></NoncurrentVersionExpiration>")))
    item = F.concat(F.lit("<Rule><ID>r"), text("part"), F.lit("</ID><Filter><Prefix>"), text("part"), F.lit("/</Prefix></Filter><Status>"), F.when(F.col("part") % 3 == 0, "Disabled").otherwise("Enabled"), F.lit("</Status>"), days, F.lit("</Rule>"))
    fields = ["ID", "Status", "Prefix", "Days", "NoncurrentDays"]
    rows = wire.document_rows(_document(lake, "LifecycleConfiguration", item, cut_short()), "body", wire.lifecycle_rules, fields)
    return rows.where("fault is null").select("upload", "place", *fields)


@query("grant_documents", over("parts", "p AS (SELECT DISTINCT upload, part FROM parts)", "n AS (SELECT *, row_number() OVER (PARTITION BY upload ORDER BY part) - 1 AS place FROM p)", body="SELECT upload, CAST(place AS INT) AS place, 'o' || upload AS owner, CASE WHEN part % 2 = 0 THEN 'id' ELSE 'uri' END AS kind, CASE WHEN part % 2 = 0 THEN 'u' || part ELSE 'http://groups/' || part END AS grantee, CASE WHEN part % 3 = 0 THEN 'READ' ELSE 'FULL_CONTROL' END AS permission FROM n"))
def grant_documents(lake: Lake) -> DataFrame:
    """Grants of access control documents as rows."""
    who = F.when(F.col("part") % 2 == 0, F.concat(F.lit("<Grantee><ID>u"), text("part"), F.lit("</ID></Grantee>"))).otherwise(F.concat(F.lit("<Grantee><URI>http://groups/"), text("part"), F.lit("</URI></Grantee>")))
    item = F.concat(F.lit("<Grant>"), who, F.lit("<Permission>"), F.when(F.col("part") % 3 == 0, "READ").otherwise("FULL_CONTROL"), F.lit("</Permission></Grant>"))
    made = _document(lake, "AccessControlList", item, F.lit(False))
    body = F.concat(F.lit("<AccessControlPolicy><Owner><ID>o"), text("upload"), F.lit("</ID></Owner>"), F.col("body"), F.lit("</AccessControlPolicy>"))
    return wire.document_rows(made.withColumn("body", body), "body", wire.grants, ["owner", "kind", "grantee", "permission"]).where("fault is null").drop("fault")


@query("listing_documents", over("version_log", "ranked", "live AS (SELECT bucket, key, size FROM ranked WHERE nth = 1 AND NOT marker)", "p AS (SELECT bucket, split_part(key, '/', 1) || '/' AS name FROM live GROUP BY 1, 2)", body="SELECT bucket, '<ListBucketResult><Name>' || bucket || '</Name><KeyCount>' || count(*) || '</KeyCount><IsTruncated>false</IsTruncated>' || string_agg('<CommonPrefixes><Prefix>' || name || '</Prefix></CommonPrefixes>', '' ORDER BY name) || '</ListBucketResult>' AS document FROM p GROUP BY bucket"))
def listing_documents(lake: Lake) -> DataFrame:
    """The first page of each bucket's listing as a document, built from expressions."""
    live = merge.current(lake.version_log(), ["bucket", "key"])
    prefix = listing.common_prefix(F.col("key"), "", "/")
    names = live.groupBy("bucket", F.coalesce(prefix, "key").alias("name"), prefix.isNotNull().alias("is_prefix")).agg(F.max("size").alias("size"))
    # a page holds a thousand entries at most, so the array is of bounded size
    first = names.withColumn("n", F.row_number().over(Window.partitionBy("bucket").orderBy("name"))).where(F.col("n") <= listing.MAX_KEYS + 1)
    page = first.groupBy("bucket").agg(F.slice(F.array_sort(F.collect_list(F.struct("name", "is_prefix", "size"))), 1, listing.MAX_KEYS).alias("entries"), (F.count("*") > listing.MAX_KEYS).alias("cut"))
    return page.select("bucket", wire.listing_text(F.col("bucket"), F.col("entries"), F.col("cut")).alias("document"))


@query("json_documents", over(body="SELECT event_id, json_valid(props) AND NOT starts_with(props, '[') AS valid, json_extract_string(props, '$.k') AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS compact, event_id % 4 = 0 AS twice FROM events"))
def json_documents(lake: Lake) -> DataFrame:
    """Strict documents: whether one is valid, a member's value as written, its compact form, and that a name given twice is refused."""
    e = lake.table("events").select("event_id", "props")
    doubled = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"a": 1, "a": '), F.col("props"), F.lit("}"))).otherwise(F.col("props"))
    return e.select("event_id", wire.json_valid(F.col("props")).alias("valid"), F.get_json_object("props", "$.k").alias("k"), wire.json_compact(F.col("props")).alias("compact"), (~wire.json_valid(doubled)).alias("twice"))


@query("tag_headers", over("version_log", body="SELECT seq, CASE seq % 5 WHEN 1 THEN 'Header' WHEN 2 THEN 'Header' WHEN 3 THEN 'TooMany' END AS fault, CASE seq % 5 WHEN 0 THEN 'team=' || kind || ';a b=' || user_id || '/' WHEN 4 THEN 'alone=' END AS tags FROM version_log"))
def tag_headers(lake: Lake) -> DataFrame:
    """Tags that a header names, or its first fault: a second = in a pair, a name twice, more than ten."""
    k = F.col("seq") % 5
    sent = F.when(k == 0, F.concat(F.lit("team="), F.col("kind"), F.lit("&&a+b="), text("user_id"), F.lit("%2F"))).when(k == 1, F.lit("a=b=c")).when(k == 2, F.lit("a=1&a=2")).when(k == 3, F.lit("&".join(f"t{i}=1" for i in range(11)))).otherwise("alone")
    return lake.version_log().select("seq", wire.tags(sent).alias("t")).select("seq", "t.fault", F.array_join(F.transform("t.tags", lambda x: F.concat(x["name"], F.lit("="), x["value"])), ";").alias("tags"))


# policies


def policies(lake: Lake) -> DataFrame:
    """A policy document of each upload: to everyone, to one, with a condition, denying, or malformed."""
    k = F.col("upload") % 5
    principal = F.when(k == 1, F.lit('{"AWS": ["arn:aws:iam::1:user/a", "arn:aws:iam::2:user/b"]}')).otherwise(F.lit('"*"'))
    bound = F.when(k == 2, F.lit(', "Condition": {"IpAddress": {"aws:SourceIp": ["10.0.0.0/16", "192.0.2.0/24"]}}')).otherwise(F.lit(""))
    effect = F.when(k == 3, "Deny").when(k == 4, "Maybe").otherwise("Allow")
    actions = F.array_join(F.transform(F.array_sort(F.collect_set("role")), lambda r: F.concat(F.lit('"s3:Get'), r, F.lit('"'))), ", ")
    made = lake.parts().groupBy("upload").agg(actions.alias("actions"))
    body = F.concat(F.lit('{"Version": "2012-10-17", "Statement": {"Effect": "'), effect, F.lit('", "Principal": '), principal, F.lit(', "Action": ['), F.col("actions"), F.lit('], "Resource": "arn:aws:s3:::b'), text("upload"), F.lit('/*"'), bound, F.lit("}}"))
    return made.select("upload", body.alias("body"))


@query("policy_statements", over("parts", "a AS (SELECT upload, string_agg(DISTINCT 's3:Get' || role, ',' ORDER BY 's3:Get' || role) AS actions FROM parts GROUP BY 1)", body="SELECT upload, CASE WHEN upload % 5 = 4 THEN NULL ELSE upload % 5 <> 3 END AS allow, CASE WHEN upload % 5 <> 4 THEN actions END AS actions, CASE upload % 5 WHEN 4 THEN NULL WHEN 1 THEN 'arn:aws:iam::1:user/a,arn:aws:iam::2:user/b' ELSE '*' END AS principals, CASE WHEN upload % 5 <> 4 THEN 'arn:aws:s3:::b' || upload || '/*' END AS resources, CASE upload % 5 WHEN 4 THEN NULL WHEN 2 THEN 'IpAddress aws:SourceIp 10.0.0.0/16,192.0.2.0/24' ELSE '' END AS conditions, CASE WHEN upload % 5 = 4 THEN NULL ELSE upload % 5 IN (0) END AS public, CASE WHEN upload % 5 = 4 THEN NULL ELSE upload % 5 NOT IN (0) END AS may_set FROM a"))
def policy_statements(lake: Lake) -> DataFrame:
    """Statements of policy documents as rows, whether each policy is public, and whether it may be set where public ones are blocked."""
    return wire.policy_rows(policies(lake), "upload", "body")


@query("policy_variables", over("version_log", body="SELECT seq, CASE seq % 4 WHEN 0 THEN 'home/' || user_id || '/*' WHEN 1 THEN 'b/none' WHEN 2 THEN NULL ELSE 'a*b?' || kind END AS filled, CASE seq % 4 WHEN 0 THEN true WHEN 1 THEN bucket || '/none' = 'b/none' WHEN 2 THEN false ELSE false END AS matched FROM version_log"))
def policy_variables(lake: Lake) -> DataFrame:
    """Written resources with their variables filled in from the request, a default, or nothing; and whether they name its key."""
    k = F.col("seq") % 4
    written = F.when(k == 0, F.lit("home/${aws:userid}/*")).when(k == 1, F.lit("b/${aws:absent, 'none'}")).when(k == 2, F.lit("b/${aws:absent}")).otherwise(F.lit("a${*}b${?}${s3:kind}"))
    asked = F.when(k == 0, F.concat(F.lit("home/"), text("user_id"), F.lit("/x/y"))).when(k == 1, F.concat("bucket", F.lit("/none"))).otherwise(F.concat(F.lit("aXb_"), F.col("kind")))
    context = F.create_map(F.lit("aws:userid"), text("user_id"), F.lit("s3:kind"), F.col("kind"))
    return lake.version_log().select("seq", wire.filled(written, context).alias("filled"), wire.filled_matches(written, context, asked).alias("matched"))


@query("condition_dates", over("version_log", "d AS (SELECT seq, created // 1000000 AS s, bucket, kind FROM version_log)", body="SELECT seq, s = 1704200000 AS equals, s <> 1704200000 AS not_equals, s <= 1704200000 AS at_most, s >= 1704200000 AS at_least, s < 1704200000 AS before, kind = 'view' AS arn_equals, kind <> 'view' AS arn_not, lower(kind) <> 'click' AS not_alike, kind = 'view' AS binary_equals, kind NOT IN ('view', 'click') AS not_like FROM d"))
def condition_dates(lake: Lake) -> DataFrame:
    """The date, ARN, binary and negated operators."""
    instant = F.array(requests.iso_millis(F.floor(F.col("created") / 1_000_000) * 1000))
    at, kind = "2024-01-02T12:53:20Z", F.array("kind")
    arn = F.array(F.concat(F.lit("arn:aws:iam::1:"), "kind"))
    c = rules.condition
    return lake.version_log().select(
        "seq",
        c("DateEquals", instant, [at]).alias("equals"),
        c("DateNotEquals", instant, [at]).alias("not_equals"),
        c("DateLessThanEquals", instant, [at]).alias("at_most"),
        c("DateGreaterThanEquals", instant, [at]).alias("at_least"),
        c("DateLessThan", instant, [at]).alias("before"),
        c("ArnEquals", arn, ["arn:*:iam::?:view"]).alias("arn_equals"),
        c("ArnNotLike", arn, ["arn:aws:iam::1:view"]).alias("arn_not"),
        c("StringNotEqualsIgnoreCase", kind, ["CLICK"]).alias("not_alike"),
        c("BinaryEquals", kind, ["dmlldw=="]).alias("binary_equals"),
        c("StringNotLike", kind, ["v?ew", "cl*"]).alias("not_like"),
    )


@query("cidr_v6", over("version_log", body="SELECT seq, CASE seq % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN user_id % 16 < 8 WHEN 3 THEN false ELSE false END AS inside, seq % 5 = 4 AS outside_v4 FROM version_log"))
def cidr_v6(lake: Lake) -> DataFrame:
    """Addresses of the sixth version in a block, short forms and malformed ones among them."""
    k = F.col("seq") % 5
    ip = F.when(k == 0, F.lit("2001:DB8::1")).when(k == 1, F.lit("2001:db9::1")).when(k == 2, F.concat(F.lit("2001:db8:0:"), F.lower(F.hex((F.col("user_id") % 16) * 4096)), F.lit(":1:2:3:4"))).when(k == 3, F.lit("2001:db8:::1")).otherwise(F.lit("10.9.0.1"))
    asked = lake.version_log().select("seq", ip.alias("ip"))
    return asked.select("seq", rules.in_network(F.col("ip"), "2001:db8::/49").alias("inside"), rules.in_network(F.col("ip"), "10.8.0.0/15").alias("outside_v4"))


@query("action_keys", over(body="SELECT * FROM (VALUES ('s3:DeleteObject', 'object', false), ('s3:GetObject', 'object', false), ('s3:ListBucket', 'bucket', true), ('s3:ListBucketVersions', 'bucket', true), ('s3:PutObject', 'object', false)) t(action, resource, lists)"))
def action_keys(lake: Lake) -> DataFrame:
    """The kind of resource that an action is on, and whether a listing's condition keys (prefix, delimiter, max-keys) belong to it."""
    actions = lake.spark.createDataFrame([(a,) for a in ("s3:GetObject", "s3:PutObject", "s3:DeleteObject", "s3:ListBucket", "s3:ListBucketVersions")], "action string")
    listing_ = F.col("action").rlike("^s3:List(Bucket|BucketVersions|BucketMultipartUploads)$")
    return actions.select("action", F.when(F.col("action").rlike("Object"), "object").otherwise("bucket").alias("resource"), listing_.alias("lists"))


# cross-origin rules


@query("cors_faults", over("version_log", "u AS (SELECT DISTINCT user_id FROM version_log)", body="SELECT user_id, CASE user_id % 9 WHEN 0 THEN 'NoRules' WHEN 1 THEN 'NoOrigin' WHEN 2 THEN 'NoMethod' WHEN 3 THEN 'Method' WHEN 4 THEN 'OriginWildcards' WHEN 5 THEN 'HeaderWildcards' WHEN 6 THEN 'DuplicateId' WHEN 7 THEN 'MaxAge' END AS fault FROM u"))
def cors_faults(lake: Lake) -> DataFrame:
    """The first fault of a bucket's cross-origin rules."""
    k = F.col("user_id") % 9
    some = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    rule = lambda name, origins, methods, headers, age: F.struct(name.alias("id"), origins.alias("origins"), methods.alias("methods"), headers.alias("headers"), age.alias("age"))
    first = rule(F.lit("a"), F.when(k == 1, some()).when(k == 4, some("*x*")).otherwise(some("https://*.example.com")), F.when(k == 2, some()).when(k == 3, some("GET", "get")).otherwise(some("GET")), F.when(k == 5, some("x-*-*")).otherwise(some("*")), F.when(k == 7, F.lit(-1)).otherwise(F.lit(60)))
    second = rule(F.when(k == 6, "a").otherwise("b"), some("*"), some("PUT", "HEAD"), some(), F.lit(None).cast("int"))
    given = F.when(k == 0, F.slice(F.array(first), 1, 0)).otherwise(F.array(first, second))
    return lake.version_log().select("user_id").distinct().select("user_id", rules.cors_fault(given).alias("fault"))


@query("cors_preflight", over("version_log", "q AS (SELECT seq, CASE WHEN seq % 4 <> 0 THEN 'https://' || bucket || '.example.com' END AS origin, seq % 6 <> 1 AS enabled, CASE WHEN seq % 5 = 0 THEN NULL WHEN kind = 'view' THEN 'GET' ELSE 'PUT' END AS method FROM version_log)", body="SELECT seq, CASE WHEN origin IS NULL THEN 'NoOrigin' WHEN NOT enabled THEN 'NotEnabled' WHEN method IS NULL THEN 'NoMethod' WHEN origin = 'https://b1.example.com' OR method = 'GET' THEN 'Allowed' ELSE 'NotAllowed' END AS answer FROM q"))
def cors_preflight(lake: Lake) -> DataFrame:
    origin = F.when(F.col("seq") % 4 != 0, F.concat(F.lit("https://"), "bucket", F.lit(".example.com")))
    method = F.when(F.col("seq") % 5 == 0, F.lit(None)).when(F.col("kind") == "view", "GET").otherwise("PUT")
    table = [(["https://b1.example.com"], ["GET", "PUT"], []), (["*"], ["GET"], [])]
    rule = rules.first_allowing(origin, method, F.lit(None).cast("array<string>"), table)
    return lake.version_log().select("seq", rules.preflight(origin, F.col("seq") % 6 != 1, method, rule).alias("answer"))


# bodies and signatures


@query("form_bodies", over("parts", "f AS (SELECT DISTINCT upload, part, role, body FROM parts)", body="SELECT upload, part, role, md5(body) AS found, CAST(octet_length(encode(body)) AS BIGINT) AS size FROM f"))
def form_bodies(lake: Lake) -> DataFrame:
    """The file that each form upload carries beside its fields."""
    mark = F.concat(F.lit("x"), F.md5("body"))
    sent = F.concat(F.lit("--"), mark, F.lit('\r\nContent-Disposition: form-data; name="key"\r\n\r\n'), F.col("role"), F.lit("\r\n--"), mark, F.lit('\r\nContent-Disposition: form-data; name="file"; filename="a.txt"\r\nContent-Type: text/plain\r\n\r\n'), F.col("body"), F.lit("\r\n--"), mark, F.lit("--\r\n"))
    forms = lake.parts().distinct().select("upload", "part", sent.alias("sent"), mark.alias("mark"))
    return forms.select("upload", "part", wire.form_file(F.encode("sent", "UTF-8"), F.col("mark")).alias("f")).select("upload", "part", F.col("f.key").alias("role"), F.md5("f.file").alias("found"), F.length("f.file").cast("long").alias("size"))


@query("chunked_bodies", over("parts", "f AS (SELECT DISTINCT upload, part, role, body FROM parts)", body="SELECT upload, part, role, md5(body || body) AS found, 'x' || part AS trailer FROM f"))
def chunked_bodies(lake: Lake) -> DataFrame:
    """The content of bodies sent in signed chunks, and a trailer."""
    size = F.lower(F.hex(F.octet_length("body").cast("long")))
    chunk = F.concat(size, F.lit(";chunk-signature=0\r\n"), F.col("body"), F.lit("\r\n"))
    sent = F.concat(chunk, chunk, F.lit("0\r\nx-amz-checksum-crc32: x"), text("part"), F.lit("\r\n\r\n"))
    made = lake.parts().distinct().where("body <> ''").select("upload", "part", "role", sent.alias("sent"))
    whole = made.select("upload", "part", "role", wire.chunked_content(F.encode("sent", "UTF-8")).alias("c"))
    return whole.select("upload", "part", "role", F.md5("c.content").alias("found"), F.col("c.trailer").alias("trailer"))


@query("signed_requests", over("version_log", body="SELECT seq, CASE seq % 6 WHEN 1 THEN 'Mismatch' WHEN 2 THEN 'UnknownKey' WHEN 3 THEN 'Expired' WHEN 4 THEN 'Scope' ELSE 'Holds' END AS verdict FROM version_log"))
def signed_requests(lake: Lake) -> DataFrame:
    """Requests with a canonical form, the text that is signed and its signature: damaged, of an unknown key, late, of another region, or good."""
    at = F.floor(F.col("created") / 1_000_000)
    path = F.concat(F.lit("/"), "bucket", F.lit("/"), "key")
    sent = lake.version_log().select("seq", at.alias("at"), path.alias("path"), F.concat(F.lit("b=2&a="), "kind").alias("query"), F.lit("host:example.com").alias("headers"), F.sha2(text("size"), 256).alias("payload"))
    signed = wire.signed(sent, "key1", "secret1", "eu-test-1")
    k = F.col("seq") % 6
    damaged = signed.select("seq", "at", "path", "query", "headers", "payload", F.when(k == 2, "nobody").otherwise("key1").alias("access_key"), F.when(k == 4, "us-test-9").otherwise("eu-test-1").alias("region"), F.when(k == 1, F.reverse("signature")).otherwise(F.col("signature")).alias("signature"), (F.col("at") + F.when(k == 3, 1000).otherwise(60)).alias("now"))
    return wire.verified(damaged, {"key1": "secret1"}, "eu-test-1").select("seq", "verdict")


# texts, dates and lengths


@query("iso_instants", over("version_log", body="SELECT seq, CASE seq % 6 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE created // 1000000 END AS seconds, CAST(CASE seq % 6 WHEN 0 THEN 0 WHEN 1 THEN 250000000 WHEN 2 THEN 0 WHEN 5 THEN 123456789 END AS INT) AS nanos FROM version_log"))
def iso_instants(lake: Lake) -> DataFrame:
    """Instants of dates with a zone; without one, or with one past 14 hours, a date names none."""
    k, s = F.col("seq") % 6, F.floor(F.col("created") / 1_000_000)
    local = lambda hours: F.date_format(F.timestamp_seconds(s + hours * 3600), "yyyy-MM-dd'T'HH:mm:ss")
    sent = F.when(k == 0, F.concat(local(0), F.lit("Z"))).when(k == 1, F.concat(local(0), F.lit(".25Z"))).when(k == 2, F.concat(local(-7), F.lit("-07:00"))).when(k == 3, local(0)).when(k == 4, F.concat(local(0), F.lit("+14:30"))).otherwise(F.concat(local(14), F.lit(".12345678900+14:00")))
    return lake.version_log().select("seq", requests.parse_iso(sent).alias("t")).select("seq", "t.*")


@query("amz_dates", over("version_log", body="SELECT seq, CASE WHEN seq % 3 <> 1 THEN created // 1000000 END AS seconds FROM version_log"))
def amz_dates(lake: Lake) -> DataFrame:
    written = F.date_format(F.timestamp_seconds(F.floor(F.col("created") / 1_000_000)), "yyyyMMdd'T'HHmmss'Z'")
    sent = F.when(F.col("seq") % 3 == 1, F.replace(written, F.lit("Z"), F.lit(""))).otherwise(written)
    return lake.version_log().select("seq", requests.parse_amz_date(sent).alias("seconds"))


@query("signing_encoding", over(body="SELECT DISTINCT url, url_encode(url) AS encoded FROM pages"))
def signing_encoding(lake: Lake) -> DataFrame:
    """The encoding that signatures use: the slash too."""
    return lake.table("pages").select("url", keys.percent_encode(F.col("url"), slash=True).alias("encoded")).distinct()


_THREE = "CASE WHEN v >= 100 THEN printf('%.0f', v) WHEN v >= 10 THEN printf('%.1f', v) ELSE printf('%.2f', v) END"


@query("quantity_texts", over("version_log", "q AS (SELECT seq, seq * seq * 10 + 1 AS n FROM version_log)", "u AS (SELECT seq, n, CASE WHEN n >= 1000000000 THEN 3 WHEN n >= 1000000 THEN 2 WHEN n >= 1000 THEN 1 ELSE 0 END AS p, n / pow(1000, CASE WHEN n >= 1000000000 THEN 3 WHEN n >= 1000000 THEN 2 WHEN n >= 1000 THEN 1 ELSE 0 END) AS v FROM q)", body=f"SELECT seq, CASE WHEN p = 0 THEN printf('%.0f', v) ELSE {_THREE} || ['K', 'M', 'G'][p] END AS count, CASE WHEN p = 0 THEN printf('%.0f', v) || ' B/s' ELSE {_THREE} || ' ' || ['kB', 'MB', 'GB'][p] || '/s' END AS rate FROM u"))
def quantity_texts(lake: Lake) -> DataFrame:
    n = F.col("seq") * F.col("seq") * 10 + 1
    return lake.version_log().select("seq", keys.count_text(n).alias("count"), keys.rate_text(n).alias("rate"))


@query("client_ids", over("version_log", body="SELECT seq, CASE WHEN seq % 4 = 0 AND user_id > 0 THEN user_id END AS id FROM version_log"))
def client_ids(lake: Lake) -> DataFrame:
    """Clients are named in one spelling: no sign, no leading zero, not zero."""
    k = F.col("seq") % 4
    name = F.when(k == 0, F.concat(F.lit("client-"), text("user_id"))).when(k == 1, F.concat(F.lit("client-0"), text("user_id"))).when(k == 2, F.concat(F.lit("node-"), text("user_id"))).otherwise(F.lit("client-18446744073709551616"))
    return lake.version_log().select("seq", keys.client_id(name).cast("long").alias("id"))


@query("header_ids", over("version_log", "i AS (SELECT DISTINCT kind, user_id % 5 AS k FROM version_log)", body="SELECT kind, k, CASE k WHEN 0 THEN kind || ' one' WHEN 1 THEN url_encode(' ' || kind) WHEN 2 THEN url_encode(kind || '\"') WHEN 3 THEN url_encode(kind || 'é/') ELSE kind || '/~' END AS id FROM i"))
def header_ids(lake: Lake) -> DataFrame:
    """A rule's id as a header can carry it."""
    i = lake.version_log().select("kind", (F.col("user_id") % 5).alias("k")).distinct()
    k = F.col("k")
    given = F.when(k == 0, F.concat("kind", F.lit(" one"))).when(k == 1, F.concat(F.lit(" "), "kind")).when(k == 2, F.concat("kind", F.lit('"'))).when(k == 3, F.concat("kind", F.lit("é/"))).otherwise(F.concat("kind", F.lit("/~")))
    return i.select("kind", "k", keys.header_id(given).alias("id"))


@query("sealed_sizes", over("version_log", "s AS (SELECT seq, seq * 977 AS plain FROM version_log)", body="SELECT seq, plain + 16 * greatest((plain + 65535) // 65536, 1) AS sealed, plain AS opened, CASE WHEN (seq % 65552) < 16 THEN NULL WHEN seq % 65552 = 0 THEN NULL ELSE seq - 16 END AS read FROM s"))
def sealed_sizes(lake: Lake) -> DataFrame:
    """Sealed and plain sizes, and the plain size of a stored one, if any seals to it."""
    s = lake.version_log().select("seq", (F.col("seq") * 977).alias("plain"))
    sealed = keys.sealed_size(F.col("plain")).cast("long")
    return s.select("seq", sealed.alias("sealed"), keys.plain_size(sealed).cast("long").alias("opened"), keys.plain_size(F.col("seq")).cast("long").alias("read"))


_RUN = "greatest(((((n + 9999) // 10000) + u - 1) // u) * u, ((5242880 + u - 1) // u) * u)"


@query("run_sizes", over("version_log", "q AS (SELECT seq, CASE WHEN seq % 4 = 0 THEN NULL ELSE seq * CAST(100000000 AS BIGINT) END AS n, CASE WHEN seq % 3 = 0 THEN CAST(4 * 1024 * 1024 AS BIGINT) WHEN seq % 3 = 1 THEN CAST(64 * 1024 * 1024 AS BIGINT) ELSE CAST(5368709120 AS BIGINT) END AS held, CASE WHEN seq % 5 = 0 THEN 1048576 ELSE 65536 END AS u FROM version_log)",
    "r AS (SELECT seq, ((5242880 + u - 1) // u) * u AS least, (held // u) * u AS most, CASE WHEN n IS NULL THEN (held // u) * u ELSE " + _RUN + " END AS run FROM q)", body="SELECT seq, CASE WHEN run BETWEEN least AND most THEN run END AS run FROM r"))
def run_sizes(lake: Lake) -> DataFrame:
    """The length of an upload's runs by its size, the client's buffer and the block."""
    size = F.when(F.col("seq") % 4 != 0, F.col("seq") * 100_000_000)
    buffer = F.when(F.col("seq") % 3 == 0, F.lit(4 << 20)).when(F.col("seq") % 3 == 1, F.lit((64 << 20) + 77)).cast("long")
    block = F.when(F.col("seq") % 5 == 0, F.lit(1 << 20)).otherwise(F.lit(1000)).cast("long")
    return lake.version_log().select("seq", keys.run_size(size, buffer, block).cast("long").alias("run"))


@query("hash_shares", over("version_log", "h AS (SELECT seq, CAST((CAST(seq AS HUGEINT) * 11400714819323198485) % 18446744073709551616 AS HUGEINT) AS h FROM version_log)", body="SELECT seq, CAST((h * 1000) // 18446744073709551616 AS BIGINT) AS place FROM h"))
def hash_shares(lake: Lake) -> DataFrame:
    """Hashes scaled into a range by their high bits."""
    h = (F.col("seq").cast("decimal(18,0)") * F.lit("11400714819323198485").cast("decimal(20,0)")) % F.lit(str(1 << 64)).cast("decimal(20,0)")
    return lake.version_log().select("seq", keys.in_range(h.cast("decimal(20,0)"), 1000).alias("place"))


@query("key_separators", over("version_log", "k AS (SELECT DISTINCT bucket, key FROM version_log)", "n AS (SELECT bucket, key AS a, lead(key) OVER (PARTITION BY bucket ORDER BY key) AS b FROM k)", "d AS (SELECT *, (SELECT min(i) FROM (SELECT unnest(generate_series(1, least(length(a), length(b)))) AS i) WHERE substr(a, i, 1) <> substr(b, i, 1)) AS i FROM n WHERE b IS NOT NULL)",
    body="SELECT bucket, a, b, CASE WHEN i IS NULL THEN a WHEN ascii(substr(a, i, 1)) + 1 < ascii(substr(b, i, 1)) THEN substr(a, 1, i - 1) || chr(ascii(substr(a, i, 1)) + 1) WHEN i + 1 < length(a) THEN substr(a, 1, i) || chr(ascii(substr(a, i + 1, 1)) + 1) ELSE a END AS separator FROM d"))
def key_separators(lake: Lake) -> DataFrame:
    """The shortest key between each two that follow one another."""
    k = lake.version_log().select("bucket", F.col("key").alias("a")).distinct()
    n = k.withColumn("b", F.lead("a").over(Window.partitionBy("bucket").orderBy("a"))).where("b is not null")
    return n.withColumn("separator", keys.separator(F.col("a"), F.col("b")))


@query("prefix_kinds", over("version_log", "k AS (SELECT DISTINCT key FROM version_log)", body="SELECT key, CASE WHEN length(key) >= 4 THEN substr(key, 1, 4) END AS fixed, substr(key, 1, 4) AS capped, key AS whole FROM k"))
def prefix_kinds(lake: Lake) -> DataFrame:
    """A key's prefix by each extractor: of a size, up to a size, all of it."""
    k = F.col("key")
    return lake.version_log().select("key").distinct().select("key", keys.fixed_prefix(k, 4).alias("fixed"), keys.capped_prefix(k, 4).alias("capped"), k.alias("whole"))
