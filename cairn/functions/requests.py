"""Request semantics as expressions: byte ranges, preconditions, dates, routes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_span(header: Column, size: Column) -> Column:
    """(kind, first, last) of a Range header: whole (absent or malformed), part, or unsatisfiable."""
    a, b = (F.try_to_number(F.nullif(F.regexp_extract(header, r"^\s*bytes=\s*(\d{0,18})\s*-\s*(\d{0,18})\s*$", k), F.lit("")), F.lit("9" * 18)).cast("long") for k in (1, 2))
    well = F.coalesce(header.rlike(r"^\s*bytes=\s*(\d{1,18}\s*-\s*\d{0,18}|-\s*\d{1,18})\s*$") & ~F.coalesce(a > b, F.lit(False)), F.lit(False))
    suffix = a.isNull()
    fits = (size > 0) & F.when(suffix, b > 0).otherwise(a < size)
    first = F.when(suffix, F.greatest(size - b, F.lit(0))).otherwise(a)
    last = F.when(suffix | b.isNull(), size - 1).otherwise(F.least(b, size - 1))
    part = well & fits
    kind = F.when(~well, "whole").when(fits, "part").otherwise("unsatisfiable")
    return F.struct(kind.alias("kind"), F.when(part, first).alias("first"), F.when(part, last).alias("last"))


def copy_span(header: Column, size: Column) -> Column:
    """A copy's source range: ok inside the source, outside past it, malformed otherwise."""
    a, b = (F.try_to_number(F.nullif(F.regexp_extract(header, r"^bytes=(\d{1,18})-(\d{1,18})$", k), F.lit("")), F.lit("9" * 18)).cast("long") for k in (1, 2))
    return F.when(a.isNull() | b.isNull() | (a > b), "malformed").when(b < size, "ok").otherwise("outside")


def names_tag(header: Column, etag: Column, strong: bool) -> Column:
    """Whether a list of entity tags (or *) names the tag; a strong comparison never matches weak tags."""
    items = F.transform(F.split(header, ","), F.trim)
    bare = lambda t: F.regexp_replace(t if strong else F.regexp_replace(t, "^W/", ""), '^"|"$', "")
    named = F.exists(items, lambda t: (t == "*") | ((bare(t) == etag) & (~t.startswith("W/") if strong else F.lit(True))))
    return F.coalesce(named, F.lit(False))


def read_outcome(present: Column, etag: Column, modified: Column, if_match: Column, if_none_match: Column, unmodified_since: Column, modified_since: Column) -> Column:
    """404, 412, 304 or 200, in the order that HTTP gives the preconditions. Instants in seconds; null dates are ignored."""
    failed = F.when(if_match.isNotNull(), ~names_tag(if_match, etag, True)).otherwise(F.coalesce(modified > unmodified_since, F.lit(False)))
    same = F.when(if_none_match.isNotNull(), names_tag(if_none_match, etag, False)).otherwise(F.coalesce(modified <= modified_since, F.lit(False)))
    return F.when(~present, 404).when(failed, 412).when(same, 304).otherwise(200)


def write_outcome(present: Column, etag: Column, if_match: Column, if_none_match: Column) -> Column:
    """A commit: If-None-Match fails on a present match; If-Match needs a present one."""
    taken = present & if_none_match.isNotNull() & names_tag(if_none_match, etag, False)
    return F.when(taken, 412).when(if_match.isNotNull() & ~present, 404).when(if_match.isNotNull() & ~names_tag(if_match, etag, True), 412).otherwise(200)


def delete_outcome(state: Column, etag: Column, if_match: Column) -> Column:
    """state: missing, marker or present."""
    return F.when(if_match.isNull(), 204).when(state == "missing", 404).when(state == "marker", 412).when(names_tag(if_match, etag, True), 204).otherwise(412)


def http_date(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def iso_millis(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_amz_date(text: Column) -> Column:
    """Seconds of a compact UTC date, or null."""
    return F.unix_seconds(F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss'Z'")))


def parse_iso(text: Column) -> Column:
    """(seconds, nanos) of an XML dateTime with its zone, or null: without a zone, beyond nanoseconds, or with a zone past 14 hours it names no instant."""
    pattern = r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})(?:\.(\d{1,9})0*)?(Z|[+-]\d{2}:\d{2})$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    local = F.unix_seconds(F.try_to_timestamp(F.concat_ws(" ", part(1), part(2)), F.lit("yyyy-MM-dd HH:mm:ss")))
    zone = part(4)
    minutes = F.substr(zone, F.lit(2), F.lit(2)).try_cast("int") * 60 + F.substr(zone, F.lit(5), F.lit(2)).try_cast("int")
    within = F.coalesce((F.substr(zone, F.lit(5), F.lit(2)).try_cast("int") < 60) & (minutes <= 14 * 60), F.lit(False))
    east = F.when(zone == "Z", F.lit(0)).when(within, F.when(zone.startswith("-"), -minutes).otherwise(minutes))
    nanos = F.coalesce(F.rpad(F.nullif(part(3), F.lit("")), 9, "0").try_cast("int"), F.lit(0))
    return F.when(text.rlike(pattern) & local.isNotNull() & east.isNotNull(), F.struct((local - 60 * east).alias("seconds"), nanos.alias("nanos")))


def max_keys(text: Column, most: int = 1000) -> Column:
    """(asked, limit) of a page's size: absent is the most; no more than that is served; what is no whole number is null."""
    asked = F.when(text.isNull(), F.lit(most)).when(F.trim(text).rlike(r"^\+?\d{1,18}$"), F.ltrim(F.trim(text), F.lit("+")).try_cast("long")).cast("long")
    return F.struct(asked.alias("asked"), F.least(asked, F.lit(most)).alias("limit"))


def parse_http_date(text: Column) -> Column:
    """Seconds of an HTTP date in its preferred form, or null; the weekday isn't checked."""
    return F.unix_seconds(F.try_to_timestamp(F.regexp_extract(text, r"^\w{3}, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss")))


#: What each method names on a subresource of a bucket, in the order they are looked for.
BUCKET_ROUTES = {
    "location": {"GET": "GetBucketLocation"},
    "versioning": {"GET": "GetBucketVersioning", "PUT": "PutBucketVersioning"},
    "tagging": {"GET": "GetBucketTagging", "PUT": "PutBucketTagging", "DELETE": "DeleteBucketTagging"},
    "acl": {"GET": "GetBucketAcl", "PUT": "PutBucketAcl"},
    "ownershipControls": {"GET": "GetBucketOwnershipControls", "PUT": "PutBucketOwnershipControls", "DELETE": "DeleteBucketOwnershipControls"},
    "lifecycle": {"GET": "GetBucketLifecycleConfiguration", "PUT": "PutBucketLifecycleConfiguration", "DELETE": "DeleteBucketLifecycle"},
    "cors": {"GET": "GetBucketCors", "PUT": "PutBucketCors", "DELETE": "DeleteBucketCors"},
    "policy": {"GET": "GetBucketPolicy", "PUT": "PutBucketPolicy", "DELETE": "DeleteBucketPolicy"},
    "policyStatus": {"GET": "GetBucketPolicyStatus"},
    "object-lock": {"GET": "GetObjectLockConfiguration", "PUT": "PutObjectLockConfiguration"},
    "publicAccessBlock": {"GET": "GetPublicAccessBlock", "PUT": "PutPublicAccessBlock", "DELETE": "DeletePublicAccessBlock"},
    "encryption": {"GET": "GetBucketEncryption", "PUT": "PutBucketEncryption", "DELETE": "DeleteBucketEncryption"},
    "versions": {"GET": "ListObjectVersions"},
    "uploads": {"GET": "ListMultipartUploads"},
    "delete": {"POST": "DeleteObjects"},
}
#: The same of an object.
OBJECT_ROUTES = {
    "tagging": {"GET": "GetObjectTagging", "PUT": "PutObjectTagging", "DELETE": "DeleteObjectTagging"},
    "acl": {"GET": "GetObjectAcl", "PUT": "PutObjectAcl"},
    "retention": {"GET": "GetObjectRetention", "PUT": "PutObjectRetention"},
    "legal-hold": {"GET": "GetObjectLegalHold", "PUT": "PutObjectLegalHold"},
    "attributes": {"GET": "GetObjectAttributes"},
    "uploads": {"POST": "CreateMultipartUpload"},
    "uploadId": {"GET": "ListParts", "PUT": "UploadPart", "POST": "CompleteMultipartUpload", "DELETE": "AbortMultipartUpload"},
}
#: Methods without a subresource, and subresources that are not served.
BUCKET_METHODS = {"GET": "ListObjects", "PUT": "CreateBucket", "DELETE": "DeleteBucket", "HEAD": "HeadBucket", "POST": "PostObject"}
OBJECT_METHODS = {"PUT": "PutObject", "GET": "GetObject", "HEAD": "HeadObject", "DELETE": "DeleteObject"}
NOT_SERVED = ["accelerate", "analytics", "intelligent-tiering", "inventory", "logging", "metrics", "notification", "replication", "requestPayment", "website", "restore"]
REFUSED, MISSING = "MethodNotAllowed", "NotImplemented"


def operation(method: Column, has_key: Column, flags: Column, has_bucket: Column | None = None, copies: Column | None = None, list_type: Column | None = None) -> Column:
    """The operation that a request names by its method, its target and the names in its query, or the fault it is answered with.

    A subresource decides before the method alone does; one that belongs to the other kind of target refuses the request.
    """
    has = lambda name: F.array_contains(flags, name)
    copies = F.lit(False) if copies is None else F.coalesce(copies, F.lit(False))
    listed = has("list-type") if list_type is None else F.coalesce(list_type == "2", F.lit(False))

    def of(table: dict[str, str], otherwise: str = REFUSED) -> Column:
        found = F.lit(otherwise)
        for m, name in table.items():
            found = F.when(method == m, name).otherwise(found)
        return found

    def target(own: dict, other: dict, plain: Column) -> Column:
        strays = F.arrays_overlap(flags, F.array(*[F.lit(x) for x in other if x not in own]))
        named = F.coalesce(*[F.when(has(name), of(methods)) for name, methods in own.items()])
        return F.coalesce(named, F.when(strays, REFUSED), plain)

    of_bucket = target(BUCKET_ROUTES, OBJECT_ROUTES, F.when((method == "GET") & listed, "ListObjectsV2").otherwise(of(BUCKET_METHODS)))
    of_key = target(OBJECT_ROUTES, BUCKET_ROUTES, F.when((method == "PUT") & copies, "CopyObject").otherwise(of(OBJECT_METHODS)))
    of_key = F.when(has("encryption"), MISSING).when((of_key == "UploadPart") & ~has("partNumber"), REFUSED).when((of_key == "UploadPart") & copies, "UploadPartCopy").otherwise(of_key)
    anywhere = F.when(has_key, of_key).otherwise(of_bucket)
    if has_bucket is not None:
        anywhere = F.when(has_bucket | has_key, anywhere).when(method == "GET", "ListBuckets").otherwise(REFUSED)
        preflight = F.when(has_bucket | has_key, "Preflight").otherwise(REFUSED)
    else:
        preflight = F.lit("Preflight")
    return F.when(method == "OPTIONS", preflight).when(F.arrays_overlap(flags, F.array(*map(F.lit, NOT_SERVED))), MISSING).otherwise(anywhere)
