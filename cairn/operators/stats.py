"""Histograms, quantiles and series statistics as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.series import T95

SUB_BITS, MAX_EXP = 5, 40
OVERFLOW = (MAX_EXP - SUB_BITS + 2) << SUB_BITS


def bucket_of(value: Column) -> Column:
    """Log-linear bucket: exact below 32, then 32 to each power of two, one for all from 2^41 on."""
    exp = (F.length(F.bin(value)) - 1).cast("int")
    shift = F.greatest(exp - SUB_BITS, F.lit(0))
    sub = F.call_function("shiftright", value, shift).bitwiseAND(F.lit(31).cast("long"))
    return F.when(value < 32, value).when(exp > MAX_EXP, OVERFLOW).otherwise((exp - SUB_BITS + 1) * 32 + sub).cast("int")


def upper_bound(bucket: Column) -> Column:
    """The largest value of a bucket."""
    row, sub = F.floor(bucket / 32).cast("int"), (bucket % 32).cast("long")
    shift = F.greatest(row - 1, F.lit(0))
    return F.when(bucket >= OVERFLOW, F.lit((1 << 63) - 1)).when(row == 0, sub).otherwise(F.call_function("shiftleft", F.lit(32).cast("long") + sub, shift) + F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1)


def histogram(rows: DataFrame, value: Column, keys: list[str]) -> DataFrame:
    """Counts by bucket; two histograms merge by adding counts and taking the larger maximum."""
    return rows.groupBy(*keys, bucket_of(value).alias("bucket")).agg(F.count("*").alias("n"), F.max(value).alias("most"))


def quantiles(hist: DataFrame, keys: list[str], ppms: list[int]) -> DataFrame:
    """The bound of the first bucket at which so many millionths of the values are reached, never above the largest value."""
    w = Window.partitionBy(*keys)
    run = hist.withColumns({"seen": F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(w), "top": F.max("most").over(w)})
    rank = lambda p: F.greatest(F.lit(1), F.floor((F.col("all") * p + 999_999) / 1_000_000))
    return run.groupBy(*keys).agg(*[F.least(F.min(F.when(F.col("seen") >= rank(p), upper_bound(F.col("bucket")))), F.max("top")).alias(f"q{p}") for p in ppms], F.max("all").alias("n"))


def t_interval(n: Column, mean: Column, deviation: Column) -> Column:
    """Relative half-width of the 95% interval of a mean: infinite below two values or for a mean not above zero."""
    t = F.coalesce(F.get(F.array(*map(F.lit, T95)), (n - 2).cast("int")), F.lit(1.96))
    return F.when((n >= 2) & (mean > 0), t * deviation / F.sqrt(n) / mean).otherwise(F.lit(float("inf")))


def lag1(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Lag-1 autocorrelation of each series about its own mean."""
    w = Window.partitionBy(*keys)
    d = rows.withColumn("_d", F.col(value) - F.avg(value).over(w))
    d = d.withColumn("_next", F.lead("_d").over(w.orderBy(order)))
    spread = F.sum(F.col("_d") * F.col("_d"))
    return d.groupBy(*keys).agg(F.when(spread > 0, F.coalesce(F.sum(F.col("_d") * F.col("_next")), F.lit(0.0)) / spread).otherwise(0.0).alias("lag1"))


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.expr(f"percentile({value}, 0.5)").alias("median"), F.count("*").alias("n"))
