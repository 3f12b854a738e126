"""Documents and encodings of requests: strict JSON, XML documents, policies, form data, signed chunks, signatures."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _unique(pairs: list[tuple[str, object]]) -> dict:
    names = dict(pairs)
    if len(names) != len(pairs):
        raise ValueError("a name twice")
    return names


def _no_constant(_: str):
    raise ValueError("not a number")


def strict_json(text: str | bytes):
    """A JSON document, or ValueError: names of an object once, numbers as written (as text), no NaN, no lone surrogates."""
    if isinstance(text, bytes):
        text = text.decode("utf-8")  # UnicodeDecodeError is a ValueError
    value = json.loads(text, object_pairs_hook=_unique, parse_int=str, parse_float=str, parse_constant=_no_constant)
    json.dumps(value, ensure_ascii=False).encode("utf-8")
    return value


def json_valid(body: Column) -> Column:
    @F.pandas_udf("boolean")
    def of(texts: pd.Series) -> pd.Series:
        def ok(t) -> bool:
            try:
                strict_json(t if t is not None else "")
            except (ValueError, RecursionError):
                return False
            return True

        return texts.map(ok)

    return of(body)


def _name(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2]


def _fields(element: ET.Element) -> dict[str, str]:
    return {_name(x): (x.text or "").strip() if not len(x) else "" for x in element}


def xml_rows(text: str, root: str, item: str, fields: list[str]) -> list[dict[str, str | None]]:
    """The item elements of a document as rows of their fields, in order; ValueError for another root or malformed text."""
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        raise ValueError("a document type")
    try:
        top = ET.fromstring(text)
    except ET.ParseError as e:
        raise ValueError(str(e)) from e
    if _name(top) != root:
        raise ValueError(f"not a {root}")
    return [{f: _fields(x).get(f) for f in fields} for x in top if _name(x) == item]


def delete_batch(text: str) -> list[dict[str, str | None]]:
    return xml_rows(text, "Delete", "Object", ["Key", "VersionId", "ETag"])


def completed_parts(text: str) -> list[dict[str, str | None]]:
    return xml_rows(text, "CompleteMultipartUpload", "Part", ["PartNumber", "ETag"])


def lifecycle_rules(text: str) -> list[dict[str, str | None]]:
    """Rules with their filter's prefix and periods side by side."""
    xml_rows(text, "LifecycleConfiguration", "Rule", [])
    out = []
    for rule in (x for x in ET.fromstring(text) if _name(x) == "Rule"):
        row = {"ID": None, "Status": None, "Prefix": None, "Days": None, "Date": None, "NoncurrentDays": None, "NewerNoncurrentVersions": None, "DaysAfterInitiation": None}
        row.update({_name(x): (x.text or "").strip() for x in rule.iter() if _name(x) in row and not len(x)})
        out.append(row)
    return out


def document_rows(docs: DataFrame, body: str, parse, fields: list[str]) -> DataFrame:
    """One row an item of each row's document, with its position; a malformed document gives one row that says so."""
    keep = [c for c in docs.columns if c != body]
    kinds = ", ".join(f"{c} {k}" for c, k in docs.dtypes if c != body)

    def each(batches):
        for pdf in batches:
            rows = []
            for record in pdf.to_dict("records"):
                head = {c: record[c] for c in keep}
                try:
                    rows += [head | {"place": i, "fault": None} | {f: item.get(f) for f in fields} for i, item in enumerate(parse(record[body]))]
                except ValueError as e:
                    rows.append(head | {"place": None, "fault": str(e)[:80]} | dict.fromkeys(fields))
            yield pd.DataFrame(rows, columns=[*keep, "place", "fault", *fields])

    return docs.mapInPandas(each, f"{kinds}, place int, fault string, " + ", ".join(f"{f} string" for f in fields))


def listing_document(bucket: str, entries: Column, truncated: Column) -> Column:
    """A ListBucketResult of an array of (name, is_prefix, size)."""
    return listing_text(F.lit(bucket), entries, truncated)


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def listing_text(bucket: Column, entries: Column, truncated: Column) -> Column:
    """The same from expressions alone, of any bucket."""
    of = lambda which, one: F.array_join(F.transform(F.filter(entries, which), one), "")
    contents = of(lambda e: ~e["is_prefix"], lambda e: F.concat(F.lit("<Contents><Key>"), escaped(e["name"]), F.lit("</Key><Size>"), e["size"].cast("string"), F.lit("</Size></Contents>")))
    prefixes = of(lambda e: e["is_prefix"], lambda e: F.concat(F.lit("<CommonPrefixes><Prefix>"), escaped(e["name"]), F.lit("</Prefix></CommonPrefixes>")))
    head = F.concat(F.lit("<ListBucketResult><Name>"), escaped(bucket), F.lit("</Name><KeyCount>"), F.size(entries).cast("string"), F.lit("</KeyCount><IsTruncated>"), truncated.cast("string"), F.lit("</IsTruncated>"))
    return F.concat(head, contents, prefixes, F.lit("</ListBucketResult>"))


#: Most tags of an object, and the longest name and value.
MOST_TAGS, TAG_NAME, TAG_VALUE = 10, 128, 256


def tags(header: Column) -> Column:
    """(fault, tags) of a header of name=value pairs, each side encoded as a form does; a name alone has an empty value."""
    pairs = F.transform(F.filter(F.split(header, "&"), lambda p: p != ""), lambda p: F.split(p, "="))
    decode = lambda x: F.try_url_decode(x)
    read = F.transform(pairs, lambda p: F.struct(decode(F.get(p, 0)).alias("name"), F.coalesce(decode(F.get(p, 1)), F.lit("")).alias("value")))
    names = F.transform(read, lambda t: t["name"])
    form = F.exists(pairs, lambda p: F.size(p) > 2) | F.exists(read, lambda t: t["name"].isNull()) | (F.size(F.array_distinct(names)) < F.size(names))
    name = F.exists(read, lambda t: (F.length(t["name"]) == 0) | (F.length(t["name"]) > TAG_NAME))
    value = F.exists(read, lambda t: F.length(t["value"]) > TAG_VALUE)
    fault = F.when(F.size(pairs) > MOST_TAGS, "TooMany").when(form, "Header").when(name, "InvalidTagKey").when(value, "InvalidTagValue")
    return F.struct(fault.alias("fault"), F.when(fault.isNull(), read).alias("tags"))


def json_compact(body: Column) -> Column:
    """A document without white space, members and numbers as they were written; null if it is malformed."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        def one(t) -> str | None:
            try:
                return _compact(json.loads(t, object_pairs_hook=_Members, parse_int=_Number, parse_float=_Number, parse_constant=_no_constant))
            except (TypeError, ValueError, RecursionError):
                return None

        return texts.map(one)

    return of(body)


class _Number(str):
    """A number as written."""

    __slots__ = ()


class _Members(list):
    """An object's members in their order."""

    __slots__ = ()


def _compact(value) -> str:
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, _Members):
        _unique(value)
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_compact(v)}" for k, v in value) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_compact, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def grants(text: str) -> list[dict[str, str | None]]:
    """Grants of an access control document: the owner, the grantee's kind and name, the permission."""
    xml_rows(text, "AccessControlPolicy", "", [])
    top = ET.fromstring(text)
    owner = next((_fields(x).get("ID") for x in top if _name(x) == "Owner"), None)
    out = []
    for grant in (g for x in top if _name(x) == "AccessControlList" for g in x if _name(g) == "Grant"):
        who = next((_fields(x) for x in grant if _name(x) == "Grantee"), {})
        kind = next((k for k in ("ID", "URI", "EmailAddress") if who.get(k)), None)
        permission = _fields(grant).get("Permission")
        if kind is None or permission not in ("FULL_CONTROL", "READ", "WRITE", "READ_ACP", "WRITE_ACP"):
            raise ValueError("a grant without grantee or permission")
        out.append({"owner": owner, "kind": {"ID": "id", "URI": "uri", "EmailAddress": "email"}[kind], "grantee": who[kind], "permission": permission})
    return out


def policy_statements(text: str) -> list[dict]:
    """Statements of a policy: effect, and actions, resources, principals as lists whether written as one or many."""
    value = strict_json(text)
    many = lambda v: v if isinstance(v, list) else [v]
    out = []
    for s in many(value.get("Statement", [])):
        if s.get("Effect") not in ("Allow", "Deny"):
            raise ValueError("an effect that is neither Allow nor Deny")
        row = {"allow": s["Effect"] == "Allow", "conditions": []}
        for name in ("Action", "Resource", "Principal"):
            negated = f"Not{name}" in s
            if negated and name in s:
                raise ValueError(f"both {name} and Not{name}")
            got = s.get(f"Not{name}" if negated else name, [])
            got = [p for v in got.values() for p in many(v)] if isinstance(got, dict) else many(got)
            row |= {name.lower(): got, f"not_{name.lower()}": negated}
        for operator, keys in s.get("Condition", {}).items():
            base, set_ = operator, None
            if ":" in base:
                set_, base = base.split(":", 1)
            exists = base.endswith("IfExists")
            row["conditions"] += [{"operator": base.removesuffix("IfExists"), "set": set_, "if_exists": exists, "key": k, "values": many(v)} for k, v in keys.items()]
        out.append(row)
    return out


def is_public(statements: list[dict]) -> bool:
    """Whether some allowance is to all principals and no condition narrows it."""
    return any(s["allow"] and not s["conditions"] and (("*" in s["principal"]) != s["not_principal"]) for s in statements)


def may_set(statements: list[dict], block_public: bool) -> bool:
    return not (block_public and is_public(statements))


POLICY = "allow boolean, actions string, principals string, resources string, conditions string, public boolean, may_set boolean"


def policy_rows(docs: DataFrame, key: str, body: str) -> DataFrame:
    """One row a statement of each policy document: its parts, whether the policy is public, and whether it may be set where public ones are blocked; a malformed one is a row of nulls."""

    def one(document: str) -> list[tuple]:
        try:
            statements = policy_statements(document)
        except (TypeError, ValueError, AttributeError):
            return [(None,) * 7]
        public, may = is_public(statements), may_set(statements, True)
        bound = lambda s: ";".join(f"{c['operator']} {c['key']} {','.join(c['values'])}" for c in s["conditions"])
        return [(s["allow"], ",".join(s["action"]), ",".join(s["principal"]), ",".join(s["resource"]), bound(s), public, may) for s in statements]

    def each(batches):
        for pdf in batches:
            rows = [(k, *row) for k, document in zip(pdf[key], pdf[body], strict=True) for row in one(document)]
            yield pd.DataFrame(rows, columns=[key, *(f.split(" ")[0] for f in POLICY.split(", "))])

    return docs.select(key, body).mapInPandas(each, f"{key} {docs.schema[key].dataType.simpleString()}, {POLICY}")


def _pieces(written: Column) -> Column:
    """What a written value is made of, in order: text, and variables with their braces."""
    return F.regexp_extract_all(written, F.lit(r"(?s)\$\{[^}]*\}|(?:(?!\$\{[^}]*\}).)+"), 0)


def _value(piece: Column, context: Column) -> Column:
    """A variable's text: itself for the signs, else the request's, else its default, else null."""
    inside = F.substr(piece, F.lit(3), F.length(piece) - 3)
    name = F.lower(F.trim(F.substring_index(inside, ",", 1)))
    default = F.regexp_extract(inside, r"(?s)^[^,]*, *'(.*)'$", 1)
    has_default = inside.rlike(r"(?s)^[^,]*, *'.*'$")
    return F.when(inside.isin("*", "?", "$"), inside).otherwise(F.coalesce(F.try_element_at(context, name), F.when(has_default, default)))


def _is_variable(piece: Column) -> Column:
    return piece.startswith("${") & piece.endswith("}")


def filled(written: Column, context: Column) -> Column:
    """A policy's text with its variables filled in from a map of lower-cased keys, or null where one has no value."""
    parts = F.transform(_pieces(written), lambda p: F.when(_is_variable(p), _value(p, context)).otherwise(p))
    return F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, ""))


def filled_matches(written: Column, context: Column, text: Column) -> Column:
    """Whether a text matches the written pattern: * and ? count as written, but not where a variable brings them."""
    quoted = lambda p: F.concat(F.lit("\\Q"), F.replace(p, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    wild = lambda p: F.replace(F.replace(quoted(p), F.lit("*"), F.lit("\\E.*\\Q")), F.lit("?"), F.lit("\\E.\\Q"))
    parts = F.transform(_pieces(written), lambda p: F.when(_is_variable(p), quoted(_value(p, context))).otherwise(wild(p)))
    pattern = F.when(~F.exists(parts, lambda p: p.isNull()), F.concat(F.lit("(?s)^"), F.array_join(parts, ""), F.lit("$")))
    return F.coalesce(F.regexp_like(text, pattern), F.lit(False))


def substitute(pattern: str, context: dict[str, str]) -> str | None:
    """A policy string with its variables filled in: ${key}, ${key, 'default'}, and ${*} ${?} ${$} for themselves; None if a key is missing."""
    out, rest = [], pattern
    while True:
        head, mark, rest = rest.partition("${")
        out.append(head)
        if not mark:
            return "".join(out)
        name, closed, rest = rest.partition("}")
        if not closed:
            return None
        key, comma, default = name.partition(",")
        if name in ("*", "?", "$"):
            out.append(name)
        elif key.strip() in context:
            out.append(context[key.strip()])
        elif comma and default.strip()[:1] == default.strip()[-1:] == "'" and len(default.strip()) > 1:
            out.append(default.strip()[1:-1])
        else:
            return None


def form_fields(body: bytes, boundary: bytes) -> list[tuple[str, str | None, bytes]]:
    """(name, file name, content) of each part of multipart/form-data, or ValueError."""
    mark = b"--" + boundary
    parts = (b"\r\n" + body).split(b"\r\n" + mark)
    if len(parts) < 2 or not parts[-1].startswith(b"--"):
        raise ValueError("no closing boundary")
    out = []
    for part in parts[1:-1]:
        head, found, content = part.removeprefix(b"\r\n").partition(b"\r\n\r\n")
        if not found:
            raise ValueError("a part without content")
        given = {}
        for line in head.decode("utf-8").split("\r\n"):
            if line.lower().startswith("content-disposition:"):
                for item in line.split(";")[1:]:
                    k, _, v = item.strip().partition("=")
                    given[k.lower()] = v.strip('"')
        if "name" not in given:
            raise ValueError("a part without a name")
        out.append((given["name"], given.get("filename"), content))
    return out


def chunked_body(data: bytes) -> tuple[bytes, dict[str, str]]:
    """Content and trailers of an aws-chunked body, or ValueError. Chunk extensions are read over."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a cut chunk header")
        digits = data[at:end].split(b";")[0].strip()
        if not digits or any(c not in b"0123456789abcdefABCDEF" for c in digits):
            raise ValueError("a chunk size that is no number")
        size, at = int(digits, 16), end + 2
        if not size:
            break
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk that doesn't end where it says")
        out.append(data[at : at + size])
        at += size + 2
    trailers = {}
    for line in data[at:].split(b"\r\n"):
        if line:
            k, colon, v = line.decode("ascii").partition(":")
            if not colon:
                raise ValueError("a trailer without a name")
            trailers[k.strip().lower()] = v.strip()
    return b"".join(out), trailers


def form_file(body: Column, boundary: Column) -> Column:
    """(key, file) of form uploads; null for a malformed one."""

    @F.pandas_udf("key string, file binary")
    def of(bodies: pd.Series, marks: pd.Series) -> pd.DataFrame:
        def one(b, m):
            try:
                parts = form_fields(bytes(b), m.encode())
            except ValueError:
                return None, None
            named = {name: content for name, _, content in parts}
            return named.get("key", b"").decode(), named.get("file")

        return pd.DataFrame([one(b, m) for b, m in zip(bodies, marks, strict=True)], columns=["key", "file"])

    return of(body, boundary)


def chunked_content(body: Column) -> Column:
    """(content, trailer) of chunked bodies, the trailer being the first by name; null for a malformed one."""

    @F.pandas_udf("content binary, trailer string")
    def of(bodies: pd.Series) -> pd.DataFrame:
        def one(b):
            try:
                content, trailers = chunked_body(bytes(b))
            except ValueError:
                return None, None
            return content, trailers[min(trailers)] if trailers else None

        return pd.DataFrame([one(b) for b in bodies], columns=["content", "trailer"])

    return of(body)


def hmac_sha256(key: bytes, data: bytes) -> bytes:
    return hmac.new(key, data, hashlib.sha256).digest()


def signing_key(secret: str, date: str, region: str, service: str = "s3") -> bytes:
    """The version 4 signing key: a chain of HMACs over date, region, service and a fixed end."""
    key = b"AWS4" + secret.encode()
    for part in (date, region, service, "aws4_request"):
        key = hmac_sha256(key, part.encode())
    return key


def signature(secret: str, date: str, region: str, text: str) -> str:
    return hmac_sha256(signing_key(secret, date, region), text.encode()).hex()


def signatures_hold(requests: DataFrame, secrets: dict[str, str]) -> DataFrame:
    """requests (access_key, date, region, to_sign, signature) with whether each signature is its key's."""

    @F.pandas_udf("boolean")
    def of(keys: pd.Series, dates: pd.Series, regions: pd.Series, texts: pd.Series, given: pd.Series) -> pd.Series:
        return pd.Series([k in secrets and hmac.compare_digest(signature(secrets[k], d, r, t), g or "") for k, d, r, t, g in zip(keys, dates, regions, texts, given, strict=True)])

    return requests.withColumn("holds", of("access_key", "date", "region", "to_sign", "signature"))


SKEW = 900  # seconds that a request's date may be off


def canonical(method: Column, path: Column, query: Column, headers: Column, payload: Column) -> Column:
    """The canonical request: its query by name, its headers as lines of lower-cased names in order, and the names signed."""
    sorted_query = F.array_join(F.array_sort(F.split(query, "&")), "&")
    lines = F.array_sort(F.split(headers, "\n"))
    names = F.array_join(F.transform(lines, lambda h: F.substring_index(h, ":", 1)), ";")
    return F.concat_ws("\n", method, path, sorted_query, F.concat(F.array_join(lines, "\n"), F.lit("\n")), names, payload)


def to_sign(request: Column, at: Column, region: Column) -> Column:
    """The text that is signed: the date, the scope and the canonical request's digest."""
    stamp = F.date_format(F.timestamp_seconds(at), "yyyyMMdd'T'HHmmss'Z'")
    scope = F.concat(F.substr(stamp, F.lit(1), F.lit(8)), F.lit("/"), region, F.lit("/s3/aws4_request"))
    return F.concat_ws("\n", F.lit("AWS4-HMAC-SHA256"), stamp, scope, F.sha2(request, 256))


def _of_request(requests: DataFrame, region: Column) -> DataFrame:
    asked = canonical(F.lit("GET"), F.col("path"), F.col("query"), F.col("headers"), F.col("payload"))
    return requests.withColumns({"to_sign": to_sign(asked, F.col("at"), region), "date": F.date_format(F.timestamp_seconds("at"), "yyyyMMdd")})


def signed(requests: DataFrame, access_key: str, secret: str, region: str) -> DataFrame:
    """requests (at, path, query, headers, payload) with the signature that a client makes."""

    @F.pandas_udf("string")
    def of(dates: pd.Series, texts: pd.Series) -> pd.Series:
        chain = {d: signing_key(secret, d, region) for d in dates.unique()}
        return pd.Series([hmac_sha256(chain[d], t.encode()).hex() for d, t in zip(dates, texts, strict=True)])

    return _of_request(requests, F.lit(region)).withColumn("signature", of("date", "to_sign")).drop("to_sign", "date")


def verified(requests: DataFrame, secrets: dict[str, str], region: str) -> DataFrame:
    """requests (at, path, query, headers, payload, access_key, region, signature, now) with a verdict: Scope for another
    region, Expired where the date is too far off, UnknownKey, Mismatch, or Holds."""
    judged = signatures_hold(_of_request(requests, F.col("region")), secrets)
    verdict = F.when(F.col("region") != region, "Scope").when(F.abs(F.col("now") - F.col("at")) > SKEW, "Expired").when(~F.col("access_key").isin(list(secrets)), "UnknownKey").when(F.col("holds"), "Holds").otherwise("Mismatch")
    return judged.withColumn("verdict", verdict).drop("to_sign", "date", "holds")


def checksum_header(digest_hex: str) -> str:
    return base64.b64encode(bytes.fromhex(digest_hex)).decode()
