"""Access lists and account checks of requests, as expressions over a map of lower-cased headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Canned access lists, and the headers that grant.
CANNED = ["private", "public-read", "public-read-write", "authenticated-read", "aws-exec-read", "bucket-owner-read", "bucket-owner-full-control", "log-delivery-write"]
GRANTS = ["x-amz-grant-read", "x-amz-grant-write", "x-amz-grant-read-acp", "x-amz-grant-write-acp", "x-amz-grant-full-control"]
GRANTEE = r'\s*(id|uri|emailAddress)\s*=\s*("[^"]+"|[^",]+)\s*'


def acl_named(headers: Column) -> Column:
    """What headers name: none, canned, grants, or a fault (a canned list and grants at once, an unknown list, malformed grants)."""
    canned = F.try_element_at(headers, F.lit("x-amz-acl"))
    given = [F.try_element_at(headers, F.lit(h)) for h in GRANTS]
    granted, malformed = F.lit(False), F.lit(False)
    for g in given:
        granted = granted | g.isNotNull()
        malformed = malformed | F.coalesce(~g.rlike(f"^{GRANTEE}(,{GRANTEE})*$"), F.lit(False))
    fault = F.when(canned.isNotNull() & ~canned.isin(CANNED), "unknown canned").when(malformed, "malformed grant").when(canned.isNotNull() & granted, "canned and grants")
    return F.coalesce(fault, F.when(canned.isNotNull(), "canned").when(granted, "grants").otherwise("none"))


def object_write_allowed(headers: Column, owner: Column) -> Column:
    """Where lists are disabled a write may name none, or the bucket owner's full control and nothing else."""
    kind = acl_named(headers)
    full = F.try_element_at(headers, F.lit("x-amz-grant-full-control"))
    only = F.size(F.filter(F.map_keys(headers), lambda k: k.isin(GRANTS))) == 1
    to_owner = F.regexp_replace(full, r'[\s"]', "") == F.concat(F.lit("id="), owner)
    return F.when(kind == "none", True).when(kind == "canned", F.try_element_at(headers, F.lit("x-amz-acl")) == "bucket-owner-full-control").when(kind == "grants", F.coalesce(only & to_owner, F.lit(False))).otherwise(False)


def expected_owner(header: Column, owner: Column) -> Column:
    """ok, invalid (no account number of 12 digits) or mismatch; an absent header expects nothing."""
    return F.when(header.isNull(), "ok").when(~header.rlike(r"^\d{12}$"), "invalid").when(header == owner, "ok").otherwise("mismatch")
