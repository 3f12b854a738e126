"""Background work on metadata: sweeps, reclaim, cleaning, placement, sessions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_plan(segments: DataFrame, by: list[str], capacity: int) -> DataFrame:
    """The victims that cleaning gains from, with their place in each group: the fewest from the highest score whose live
    data, packed, opens fewer segments than they free; none where the dead space they hold reaches a segment before."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "segment").rowsBetween(Window.unboundedPreceding, 0)
    run = segments.withColumns({"place": F.count("*").over(w), "_live": F.sum("live").over(w), "_dead": F.sum(F.col("size") - F.col("live")).over(w)})
    gains = F.col("place") > F.ceil(F.col("_live") / capacity)
    due = F.col("_dead") >= capacity
    ends = run.groupBy(*by).agg(F.min(F.when(gains, F.col("place"))).alias("_gain"), F.min(F.when(due & ~gains, F.col("place"))).alias("_due"))
    kept = ends.where("_gain is not null and (_due is null or _gain <= _due)").select(*by, "_gain")
    return run.join(kept, by).where(F.col("place") <= F.col("_gain")).select(*by, "segment", "place")


def generated(index: Column, seed: int) -> Column:
    """The 64-bit words of a SplitMix64 stream at places from 0, as hexadecimal: the same anywhere, in any order."""

    @F.pandas_udf("string")
    def of(places: pd.Series) -> pd.Series:
        at = places.to_numpy(np.int64).view(np.uint64) + np.uint64(1)
        z = np.uint64(seed) + at * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        return pd.Series([f"{x:016x}" for x in z.tolist()])

    return of(index)


STRETCH = 1 << 16  # places of a log that one pass takes in order
VOLUMES = 10_000  # that are sent to every task


def orphans(held: DataFrame, named: DataFrame, keys: list[str]) -> DataFrame:
    return held.join(named.select(*keys).distinct(), keys, "left_anti")


def sweep(files: DataFrame, marks: DataFrame, key: str, now: int, deadline: Column) -> DataFrame:
    """held by a mark; else released once past its deadline, young before."""
    met = files.join(marks.select(F.col(key), F.lit(True).alias("_held")).distinct(), key, "left")
    return met.withColumn("verdict", F.when(F.col("_held"), "held").when(F.lit(now) > deadline, "released").otherwise("young")).drop("_held")


def clean_scores(segments: DataFrame) -> DataFrame:
    """Cost-benefit of cleaning each segment: (1 - u) * age / (1 + u), u its live share; an empty one is freed outright."""
    u = F.col("live") / F.col("size")
    return segments.withColumns({"score": (1 - u) * F.col("age") / (1 + u), "reclaimable": F.col("live") == 0})


def monotone_clock(log: DataFrame, keys: list[str], order: str, at: str) -> DataFrame:
    """Each entry's tick: the later of its time and the last tick plus one. With i the place, tick = i + max(at_j - j) up to it.

    A log is dealt to stretches of STRETCH places in its order (a whole number); each runs by itself, and takes over
    from those before it what they add up to: their number of entries and the greatest at_j - j.
    """
    cut = log.withColumn("_part", F.floor(F.col(order) / STRETCH))
    w = Window.partitionBy(*keys, "_part").orderBy(order)
    placed = cut.withColumn("_i", F.row_number().over(w).cast("long"))
    placed = placed.withColumn("_run", F.max(F.col(at) - F.col("_i")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sums = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.max(F.col(at) - F.col("_i")).alias("_most"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    sums = sums.withColumn("_carry", F.max(F.col("_most") - F.col("_from")).over(before)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_from", "_carry")
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    met = placed.join(sums, same)
    return met.select(*log.columns, (F.col("_from") + F.col("_i") + F.greatest(F.col("_run") - F.col("_from"), "_carry")).alias("tick"))


def running_max(log: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """The greatest value up to each entry of its log, dealt to stretches like ``monotone_clock``."""
    cut = log.withColumn("_v", value).withColumn("_part", F.floor(F.col(order) / STRETCH))
    local = cut.withColumn("_run", F.max("_v").over(Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    tops = cut.groupBy(*keys, "_part").agg(F.max("_v").alias("_top"))
    carry = F.max("_top").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.withColumn("_carry", carry).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_carry")
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return local.join(tops, same).select(*log.columns, F.greatest("_run", "_carry").alias(name))


def first_of_each(log: DataFrame, identity: list[str], order: str) -> DataFrame:
    """The first of all entries with one identity: repeats are answered, not applied again."""
    rest = [c for c in log.columns if c not in identity]
    return log.groupBy(*identity).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_f")).select(*identity, "_f.*").select(*log.columns)


def sessions(log: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """Uses of a key, cut where it was idle for longer than gap: (key, session, first, last, uses)."""
    w = Window.partitionBy(key).orderBy(at)
    fresh = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(1))
    marked = log.select(key, at, fresh.alias("_new"))
    numbered = marked.select(key, at, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("session"))
    return numbered.groupBy(key, "session").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("uses"))


def _draw(words: list[np.ndarray]) -> np.ndarray:
    """A chain of SplitMix64 steps over words, all rows at once."""
    x = np.zeros(len(words[0]), np.uint64)
    for word in words:
        z = (x ^ word) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        x = z ^ z >> np.uint64(31)
    return x


def rendezvous_key(block: Column, volume: Column, size: Column) -> Column:
    """ln(u) / bytes with u drawn from both ids: the highest is the first choice, in proportion to bytes."""

    @F.pandas_udf("double")
    def of(blocks: pd.Series, volumes: pd.Series, sizes: pd.Series) -> pd.Series:
        none = np.zeros(len(blocks), np.uint64)
        top = _draw([blocks.to_numpy(np.int64).view(np.uint64), none, volumes.to_numpy(np.int64).view(np.uint64), none]) >> np.uint64(11)
        size = sizes.to_numpy(np.float64)
        drawn = np.log((top.astype(np.float64) + 1) / float(1 << 53))
        return pd.Series(np.where(size > 0, drawn / np.where(size > 0, size, 1), -np.inf))

    return of(block, volume, size)


def placement(blocks: DataFrame, volumes: DataFrame) -> DataFrame:
    """Each block's volumes in the order they are offered: the best of each domain, then the rest, volumes of no bytes last.

    Every block weighs every volume, which is what the order means. A cell's table is small and goes to every task; a
    larger one than VOLUMES is left to Spark to deal out.
    """
    few = volumes.limit(VOLUMES + 1).count() <= VOLUMES
    pairs = blocks.crossJoin(F.broadcast(volumes) if few else volumes)
    keyed = pairs.withColumn("key", rendezvous_key(F.col("block"), F.col("volume"), F.col("bytes")))
    of_domain = F.row_number().over(Window.partitionBy("block", "domain").orderBy(F.desc("key"), "volume"))
    placed = keyed.withColumn("_n", of_domain)
    order = [F.col("bytes") <= 0, F.col("_n") > 1, F.desc("key"), F.col("volume")]
    return placed.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy(*order))).drop("_n")
