"""Listing algebra: prefix and delimiter roll-up, versions, uploads and parts, pages with tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .merge import current, page

MAX_KEYS = 1000


def common_prefix(key: Column, prefix: str, delimiter: str | None) -> Column:
    """What a key rolls up into: all through the first delimiter after the prefix, or null."""
    if not delimiter:
        return F.lit(None).cast("string")
    at = F.locate(delimiter, key, len(prefix) + 1)
    return F.when(at > 0, F.substr(key, F.lit(1), at + F.lit(len(delimiter) - 1)))


def entries(keys: DataFrame, prefix: str = "", delimiter: str | None = None) -> DataFrame:
    """Keys and common prefixes under a prefix: (name, is_prefix, n_keys, size)."""
    rolled = common_prefix(F.col("key"), prefix, delimiter)
    under = keys.where(F.col("key").startswith(prefix)) if prefix else keys
    return under.groupBy(F.coalesce(rolled, F.col("key")).alias("name"), rolled.isNotNull().alias("is_prefix")).agg(F.count("*").alias("n_keys"), F.sum("size").alias("size"))


def list_objects(versions: DataFrame, bucket: str, prefix: str = "", delimiter: str | None = None, max_keys: int = MAX_KEYS, after: str | None = None) -> DataFrame:
    """A page of a bucket's current keys: keys and common prefixes count together."""
    live = current(versions.where(F.col("bucket") == bucket), ["bucket", "key"])
    found = entries(live, prefix, delimiter)
    limit = min(max_keys, MAX_KEYS)
    if after is not None:
        # a marker inside a common prefix skips what that prefix holds
        found = found.where(F.col("name") > after)
    return page(found, ["name"], limit)


def token(kind: str, key: Column) -> Column:
    """An opaque continuation token: URL-safe base64 of a tag and the key, unpadded."""
    plain = F.base64(F.encode(F.concat(F.lit(kind), key), "UTF-8"))
    return F.rtrim(F.translate(plain, "+/", "-_"), F.lit("="))


def token_start(token: Column) -> Column:
    """The key that a token names; null if it is none of ours."""
    text = F.translate(F.trim(token), "-_", "+/")
    padded = F.concat(text, F.repeat(F.lit("="), F.pmod(-F.length(text), F.lit(4))))
    read = F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8")
    return F.when(F.substr(read, F.lit(1), F.lit(1)).isin("a", "p"), F.substr(read, F.lit(2)))


def list_versions(versions: DataFrame) -> DataFrame:
    """All versions with whether each is its key's latest; key ascending, newest first."""
    w = Window.partitionBy("bucket", "key").orderBy(F.desc("seq"))
    return versions.withColumn("is_latest", F.row_number().over(w) == 1)


def list_parts(parts: DataFrame, after: int, limit: int) -> DataFrame:
    """For each upload the page of parts after a marker, with whether more follow."""
    w = Window.partitionBy("upload").orderBy("part")
    seen = parts.where(F.col("part") > after).select("*", F.row_number().over(w).alias("_n"), F.count(F.lit(1)).over(Window.partitionBy("upload")).alias("_all"))
    return seen.where(F.col("_n") <= limit).withColumn("truncated", F.col("_all") > limit).drop("_n", "_all")
