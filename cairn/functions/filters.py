"""Bloom filters as binary columns, key separators and address blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import in_network  # noqa: F401  of either family, as an expression

PROBES = 6


def _bits(key: str, size: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key.encode())
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + k * b & (1 << 64) - 1) * size >> 64 for k in range(PROBES)]


def bloom(keys: list[str], bits_per_key: int = 10) -> bytes:
    size = max(64, len(keys) * bits_per_key)
    flags = np.zeros(-(-size // 8) * 8, np.uint8)
    for key in keys:
        flags[_bits(key, len(flags))] = 1
    return np.packbits(flags).tobytes()


def may_hold(filter_: bytes, key: str) -> bool:
    size = len(filter_) * 8
    return all(filter_[b >> 3] >> (7 - (b & 7)) & 1 for b in _bits(key, size))


def bloom_of(keys: Column) -> Column:
    """The filter of an array of keys."""

    @F.pandas_udf("binary")
    def of(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: bloom(list(x)))

    return of(keys)


def bloom_may_hold(filter_: Column, key: Column) -> Column:
    @F.pandas_udf("boolean")
    def of(filters: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([f is not None and may_hold(bytes(f), k) for f, k in zip(filters, keys, strict=True)])

    return of(filter_, key)


def probes(key: Column, bits: int | Column) -> Column:
    """The bits that a key sets in a filter of a size: two hashes and their sums, as many as PROBES."""
    a, b = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    size = (bits if isinstance(bits, Column) else F.lit(bits)).cast("decimal(20,0)")
    at = lambda k: F.pmod((a.cast("decimal(20,0)") + b.cast("decimal(20,0)") * k).cast("decimal(38,0)"), size).cast("long")
    return F.array(*[at(k) for k in range(PROBES)])


def sizes_of(rows: DataFrame, by: list[str], key: str, per_key: int = 10, least: int = 1 << 14) -> DataFrame:
    """(by, bits): the size of each group's filter by its distinct keys, so that it takes as few others for one whatever their number."""
    return rows.select(*by, key).distinct().groupBy(*by).agg(F.greatest(F.lit(least).cast("long"), F.count("*") * per_key).alias("bits"))


def filters_of(rows: DataFrame, by: list[str], key: str, sizes: DataFrame) -> DataFrame:
    """(by, word, set): the words of one filter for each group, 64 bits a word. Keys are combined map-side, whatever their number."""
    at = rows.select(*by, key).distinct().join(sizes, by).select(*by, F.explode(probes(F.col(key), F.col("bits"))).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    return at.groupBy(*by, F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(bit).alias("set"))


def held_by(rows: DataFrame, filters: DataFrame, by: list[str], key: str, sizes: DataFrame) -> DataFrame:
    """(by, key, may_hold): each distinct key's answer from its group's filter; a group without one holds nothing."""
    sized = rows.select(*by, key).distinct().join(sizes, by, "left")
    asked = sized.withColumn("at", F.explode_outer(probes(F.col(key), F.col("bits")))).withColumn("word", F.floor(F.col("at") / 64))
    met = asked.join(filters, [*by, "word"], "left")
    on = F.call_function("shiftright", F.coalesce("set", F.lit(0).cast("long")), (F.coalesce("at", F.lit(0).cast("long")) % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    return met.groupBy(*by, key).agg(F.bool_and(on).alias("may_hold"))


def separator(a: bytes, b: bytes) -> bytes:
    """The shortest key at least a and below b, where a < b; a itself where none is shorter."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    if n >= min(len(a), len(b)):
        return a
    if a[n] + 1 < b[n]:
        return a[:n] + bytes([a[n] + 1])
    for k in range(n + 1, len(a)):
        if a[k] != 0xFF:
            return a[:k] + bytes([a[k] + 1]) if k + 1 < len(a) else a
    return a
