"""Rule evaluation as expressions: lifecycle dates, locks, policies, conditions, CORS."""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400_000_000  # microseconds
MOST_RULES = 1000


def due(start: Column, days: Column) -> Column:
    """Days after an instant (microseconds), rounded up to midnight UTC; a midnight stays; past all clocks is the last instant."""
    never = F.lit((1 << 63) - 1)
    at = F.try_add(start, F.try_multiply(days.cast("long"), F.lit(DAY)))
    into = F.pmod(at, F.lit(DAY))
    return F.coalesce(F.when(into == 0, at).otherwise(F.try_add(at - into, F.lit(DAY))), never)


def earliest(objects: DataFrame, rules: DataFrame, matches: Column, at: Column, keys: list[str]) -> DataFrame:
    """For each object the earliest due date over the rules that apply; of equal dates the first rule.

    Rules are a document of a thousand rules at most, which is checked, so they go to every task.
    """
    if len(rules.select("ordinal").take(MOST_RULES + 1)) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    met = objects.join(F.broadcast(rules), matches)
    return met.groupBy(*keys).agg(F.min(F.struct(at.alias("at"), F.col("ordinal"), F.col("rule"))).alias("_m")).select(*keys, F.col("_m.at").alias("due"), F.col("_m.rule").alias("rule"))


def locked(mode: Column, until: Column, hold: Column, now: Column, bypass: Column) -> Column:
    """A legal hold always protects; an active retention does unless it is governance and bypassed."""
    return F.coalesce(hold, F.lit(False)) | F.coalesce((until > now) & ((mode == "COMPLIANCE") | ~bypass), F.lit(False))


def may_retain(held_mode: Column, held_until: Column, mode: Column, until: Column, now: Column, bypass: Column) -> Column:
    """No active retention: yes. The same mode for as long or longer: yes. Else only governance, bypassed."""
    active = F.coalesce(held_until > now, F.lit(False))
    longer = F.coalesce((held_mode == mode) & (until >= held_until), F.lit(False))
    return ~active | longer | (F.coalesce(held_mode == "GOVERNANCE", F.lit(False)) & bypass)


def wildcard(pattern: str) -> str:
    """A pattern of * and ? as an anchored regular expression."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) if not c.isalnum() else c for c in pattern) + "$"


def ipv4(text: Column) -> Column:
    """An address as a number, or null."""
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    parts = [F.regexp_extract(text, rf"^{octet}\.{octet}\.{octet}\.{octet}$", k) for k in (1, 2, 3, 4)]
    number = sum((F.try_to_number(F.nullif(p, F.lit("")), F.lit("999")).cast("long") * (1 << (24 - 8 * k)) for k, p in enumerate(parts)), F.lit(0).cast("long"))
    return number


def in_cidr(text: Column, base: Column, bits: int) -> Column:
    shift = 32 - bits
    return F.coalesce(F.shiftright(ipv4(text), shift) == F.shiftright(ipv4(base), shift), F.lit(False))


#: The negated condition operators and what each negates.
OPPOSITES = {
    "StringNotEquals": "StringEquals",
    "StringNotEqualsIgnoreCase": "StringEqualsIgnoreCase",
    "StringNotLike": "StringLike",
    "NumericNotEquals": "NumericEquals",
    "DateNotEquals": "DateEquals",
    "NotIpAddress": "IpAddress",
    "ArnNotEquals": "ArnEquals",
    "ArnNotLike": "ArnLike",
}


def groups6(text: Column) -> Column:
    """The eight 16-bit groups of an IPv6 address, or null; :: stands for as many zeros as are missing."""
    halves = F.split(F.lower(text), "::", -1)
    of = lambda h: F.filter(F.split(h, ":"), lambda g: g != "")
    head, tail = of(F.get(halves, 0)), F.coalesce(of(F.get(halves, 1)), F.array().cast("array<string>"))
    gap = 8 - F.size(head) - F.size(tail)
    shape = F.lower(text).rlike(r"^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?(::([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?)?$") & (F.length(text) > 1)
    filled = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), tail)
    fits = shape & F.when(F.size(halves) == 2, gap > 0).otherwise(gap == 0)
    return F.when(fits, F.transform(filled, lambda g: F.conv(g, 16, 10).cast("int")))


def in_network(text: Column, network: str) -> Column:
    """Whether an address of either family lies in a block; a text that is no address of the block's family doesn't."""
    block = ipaddress.ip_network(network, strict=False)
    if block.version == 4:
        return in_cidr(text, F.lit(str(block.network_address)), block.prefixlen) if block.prefixlen else ipv4(text).isNotNull()
    base = [int.from_bytes(block.network_address.packed[2 * k : 2 * k + 2]) for k in range(8)]
    groups, met = groups6(text), F.lit(True)
    for k in range(-(-block.prefixlen // 16)):
        shift = max(0, 16 * (k + 1) - block.prefixlen)
        met = met & (F.shiftright(F.get(groups, k), shift) == base[k] >> shift)
    return F.coalesce(groups.isNotNull() & met, F.lit(False))


def cors_fault(rules: Column) -> Column:
    """The first fault of a CORS document's rules, or null: an array of (id, origins, methods, headers, age), at most 100 of them."""
    stars = lambda c: F.exists(c, lambda x: F.length(x) - F.length(F.replace(x, F.lit("*"), F.lit(""))) > 1)
    ids = F.transform(rules, lambda r: r["id"])
    twice = lambda r, i: r["id"].isNotNull() & F.array_contains(F.slice(ids, 1, i), r["id"])

    def fault(r: Column, i: Column) -> Column:
        return (
            F.when(F.length(r["id"]) > 255, "IdTooLong")
            .when(F.coalesce(twice(r, i), F.lit(False)), "DuplicateId")
            .when(F.size(r["origins"]) == 0, "NoOrigin")
            .when(F.size(r["methods"]) == 0, "NoMethod")
            .when(F.exists(r["methods"], lambda m: ~m.isin("GET", "PUT", "POST", "DELETE", "HEAD")), "Method")
            .when(stars(r["origins"]), "OriginWildcards")
            .when(stars(r["headers"]), "HeaderWildcards")
            .when(r["age"] < 0, "MaxAge")
        )

    found = F.get(F.filter(F.transform(rules, fault), lambda x: x.isNotNull()), 0)
    return F.when(F.size(rules) == 0, "NoRules").when(F.size(rules) > 100, "TooManyRules").otherwise(found)


def preflight(origin: Column, enabled: Column, method: Column, rule: Column) -> Column:
    """How a preflight is answered: allowed, or the first of what it lacks."""
    return F.when(origin.isNull(), "NoOrigin").when(~enabled, "NotEnabled").when(method.isNull(), "NoMethod").when(rule.isNull(), "NotAllowed").otherwise("Allowed")


def condition(kind: str, values: Column, written: list[str], negated: bool = False, if_exists: bool = False, quantifier: str | None = None) -> Column:
    """A policy condition over a key's values (null when the request has none).

    A missing key: IfExists and ForAllValues hold, ForAnyValue fails, else a negated operator holds and others fail.
    A negated operator holds for a value that matches none of those written.
    """
    tests = {
        "StringEquals": lambda v, w: v == w,
        "StringEqualsIgnoreCase": lambda v, w: F.lower(v) == w.lower(),
        "StringLike": lambda v, w: v.rlike(wildcard(w)),
        "NumericEquals": lambda v, w: v.try_cast("double") == float(w),
        "NumericLessThan": lambda v, w: v.try_cast("double") < float(w),
        "NumericLessThanEquals": lambda v, w: v.try_cast("double") <= float(w),
        "NumericGreaterThan": lambda v, w: v.try_cast("double") > float(w),
        "NumericGreaterThanEquals": lambda v, w: v.try_cast("double") >= float(w),
        "DateEquals": lambda v, w: v.try_cast("timestamp") == F.lit(w).cast("timestamp"),
        "DateLessThanEquals": lambda v, w: v.try_cast("timestamp") <= F.lit(w).cast("timestamp"),
        "DateGreaterThanEquals": lambda v, w: v.try_cast("timestamp") >= F.lit(w).cast("timestamp"),
        "DateLessThan": lambda v, w: v.try_cast("timestamp") < F.lit(w).cast("timestamp"),
        "DateGreaterThan": lambda v, w: v.try_cast("timestamp") > F.lit(w).cast("timestamp"),
        "Bool": lambda v, w: F.lower(v) == w.lower(),
        "BinaryEquals": lambda v, w: F.encode(v, "UTF-8") == F.try_to_binary(F.lit(w), F.lit("base64")),
        "IpAddress": lambda v, w: in_network(v, w),
        "ArnLike": lambda v, w: arn_like(v, w),
    }
    tests["ArnEquals"] = tests["ArnLike"]  # the two are judged alike
    for opposite, positive in OPPOSITES.items():
        if kind == opposite:
            kind, negated = positive, True
    if kind == "Null":
        return values.isNull() == F.lit(written[0].lower() == "true")
    test = tests[kind]

    def met(v: Column) -> Column:
        any_ = F.lit(False)
        for w in written:
            any_ = any_ | F.coalesce(test(v, w), F.lit(False))
        return ~any_ if negated else any_

    present = F.forall(values, met) if quantifier == "all" or (negated and quantifier is None) else F.exists(values, met)
    missing = if_exists or quantifier == "all" or (negated and quantifier != "any")
    return F.when(values.isNull() | (F.size(values) == 0), F.lit(missing)).otherwise(present)


def arn_like(value: Column, written: str) -> Column:
    """Six colon-parted fields, each matched on its own; the last holds all that remains."""
    fields = written.split(":", 5)
    if len(fields) != 6:
        return F.lit(False)
    parts = F.split(value, ":", 6)
    met = F.size(parts) == 6
    for k, w in enumerate(fields):
        met = met & F.coalesce(F.get(parts, k).rlike(wildcard(w)), F.lit(False))
    return met


def verdict(requests: DataFrame, applies: list[tuple[bool, Column]], keys: list[str]) -> DataFrame:
    """allow, deny or none: one applicable denial beats any allowance. Statements become columns, so no join is needed."""
    deny, allow = F.lit(False), F.lit(False)
    for allows, met in applies:
        if allows:
            allow = allow | met
        else:
            deny = deny | met
    return requests.select(*keys, F.when(deny, "deny").when(allow, "allow").otherwise("none").alias("verdict"))


def authorized(verdict: Column, is_owner: Column, own_policy_action: Column, public: Column, restricted: Column) -> Column:
    """The owner may always manage the policy; else a denial refuses, the owner needs no grant, and a restricted public policy grants nobody else."""
    return F.when(is_owner & own_policy_action, True).when(verdict == "deny", False).when(is_owner, True).when(public & restricted, False).otherwise(verdict == "allow")


def first_allowing(origin: Column, method: Column, headers: Column, rules: list[tuple[list[str], list[str], list[str]]]) -> Column:
    """The ordinal of the first CORS rule (origins, methods, headers) that allows the request, or null."""
    found = []
    for k, (origins, methods, allowed) in enumerate(rules):
        from_ = F.lit(False)
        for o in origins:
            from_ = from_ | origin.rlike(wildcard(o))
        by = method.isin(methods)
        patterns = [wildcard(h.lower()) for h in allowed]

        def named(h: Column, patterns: list[str] = patterns) -> Column:
            met = F.lit(False)
            for p in patterns:
                met = met | F.lower(F.trim(h)).rlike(p)
            return met

        asked = F.coalesce(F.forall(headers, _one(named)), F.lit(True))
        found.append(F.when(from_ & by & asked, F.lit(k)))
    return F.coalesce(*found)


def _one(test):
    return lambda h: test(h)
