"""Ordered key-value semantics as set operations: newest wins, tombstones hide, range deletes, splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.keys import shared_prefix


def newest(versions: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The newest row of each key. max_by over a struct combines map-side, where a window would sort whole groups."""
    rest = [c for c in versions.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.col(order))
    return versions.groupBy(*keys).agg(top.alias("_top")).select(*keys, "_top.*").select(*versions.columns)


def current(versions: DataFrame, keys: list[str], order: str = "seq", marker: str = "marker") -> DataFrame:
    """The newest row of each key, unless it is a delete marker."""
    return newest(versions, keys, order).where(~F.col(marker))


def merge_runs(runs: list[DataFrame], keys: list[str], order: str = "seq", tombstone: str = "marker") -> DataFrame:
    """Sorted runs merged: of equal keys the newest wins, and a tombstone hides the key."""
    return current(reduce(DataFrame.unionByName, runs), keys, order, tombstone)


def clear_ranges(rows: DataFrame, tombstones: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """Rows not cleared by any range tombstone (begin, end, at): older than it with begin <= key < end.

    The key order is cut at some of the tombstones' begins; a tombstone goes to each part that it reaches, so rows meet
    only those of their part, by an equality.
    """
    marks = cuts(tombstones, "begin")
    reached = tombstones.select("begin", "end", "at", F.explode(F.sequence(_part(F.col("begin"), marks), _part(F.col("end"), marks))).alias("_t")).where("begin < end")
    hit = (F.col("_p") == F.col("_t")) & (F.col(key) >= F.col("begin")) & (F.col(key) < F.col("end")) & (F.col(order) < F.col("at"))
    return rows.withColumn("_p", _part(F.col(key), marks)).join(reached, hit, "left_anti").drop("_p")


def fold_operands(rows: DataFrame, keys: list[str], order: str, operand: Column, separator: str = ",") -> DataFrame:
    """Merge operands of each key applied in order; here they append."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), operand.alias("x"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda s: s["x"]), separator).alias("merged"), F.count("*").alias("operands"))


def split_at(rows: DataFrame, at: str, key: str = "key") -> tuple[DataFrame, DataFrame]:
    return rows.where(F.col(key) < at), rows.where(F.col(key) >= at)


def floor_of(rows: DataFrame, starts: list[str], key: str = "key") -> DataFrame:
    """Each row with the greatest start at or below its key (null below all): a literal search while starts are few."""
    lower = [F.when(F.col(key) >= s, F.lit(s)) for s in sorted(starts, reverse=True)]
    return rows.withColumn("start", F.coalesce(*lower) if lower else F.lit(None).cast("string"))


MARKS = 128  # cuts of the key order, so that an ordered pass is dealt to as many tasks


def cuts(starts: DataFrame, column: str, count: int = MARKS) -> list[str]:
    """About evenly spread values of a column: the middle ones of a draw by hash, of bounded size."""
    drawn = sorted(r[0] for r in starts.select(column).where(F.col(column).isNotNull()).distinct().orderBy(F.xxhash64(column), column).limit(8 * count).collect())
    return sorted({drawn[i * len(drawn) // count] for i in range(1, count)}) if len(drawn) >= count else drawn


def _part(key: Column, marks: list[str]) -> Column:
    """The part of the key order that a key lies in: how many marks are at or below it."""
    return F.size(F.filter(F.array(*map(F.lit, marks)), lambda m: m <= key)) if marks else F.lit(0)


def ordered_join(rows: DataFrame, starts: DataFrame, key: str = "key", by: list[str] | None = None, above: bool = False) -> DataFrame:
    """Each row with the greatest start at or below its key, or with ``above`` the least at or above it; null where there is none.

    ``starts`` has a column start and those of by. Both sides are dealt to ranges of the key order; within a range one
    ordered pass carries the nearest start on, and a range without one before a row takes it from the ranges before.
    """
    by = by or []
    marks = cuts(starts, "start")
    part = _part(F.col(key), marks)
    known = starts.select(*by, F.col("start").alias(key), F.col("start").alias("_s")).distinct()
    both = rows.withColumn("_s", F.lit(None).cast("string")).unionByName(known, allowMissingColumns=True).withColumn("_part", part)
    order = [F.desc(key) if above else F.asc(key), F.col("_s").isNull()]
    w = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_near", F.last("_s", ignorenulls=True).over(w)).where("_s is null").drop("_s")
    # of each range its outermost start, carried over the ranges: as many rows as ranges
    ends = known.withColumn("_part", part).groupBy(*by, "_part").agg((F.min("_s") if above else F.max("_s")).alias("_end"))
    # a range is reached from any before it, so each row joins the ranges' ends once they are spread
    all_parts = [F.lit(p) for p in range(len(marks) + 1)]
    grid = ends.select(*by).distinct().withColumn("_part", F.explode(F.array(*all_parts)))
    over_ = Window.partitionBy(*by).orderBy(F.desc("_part") if above else F.asc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = grid.join(ends, [*by, "_part"], "left").withColumn("_carry", F.last("_end", ignorenulls=True).over(over_)).select(*by, "_part", "_carry")
    return near.join(carried, [*by, "_part"], "left").withColumn("start", F.coalesce("_near", "_carry")).select(*rows.columns, "start")


def floor_join(rows: DataFrame, starts: DataFrame, key: str = "key", by: list[str] | None = None) -> DataFrame:
    """floor_of for a table of starts."""
    return ordered_join(rows, starts, key, by)


def ceil_join(rows: DataFrame, starts: DataFrame, key: str = "key", by: list[str] | None = None) -> DataFrame:
    """Each row with the least start at or above its key."""
    return ordered_join(rows, starts, key, by, above=True)


def merge_ranges(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Ranges (low, high) that meet or overlap as one, by their groups; a null high has no end."""
    w = Window.partitionBy(*by).orderBy("low", "high")
    open_ = F.col("high").isNull()
    seen = w.rowsBetween(Window.unboundedPreceding, -1)
    endless, reach = F.max(open_.cast("int")).over(seen), F.max("high").over(seen)
    fresh = F.coalesce(~((endless == 1) | (F.col("low") <= reach)), F.lit(True)).cast("int")
    marked = ranges.withColumn("_new", fresh).withColumn("_n", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_n").agg(F.min("low").alias("low"), F.when(F.max(open_.cast("int")) == 0, F.max("high")).alias("high"), F.count("*").alias("ranges")).drop("_n")


def page(rows: DataFrame, order: list[str], limit: int, after: tuple | None = None) -> DataFrame:
    """A keyset page: rows after the marker in order, at most limit, each with whether more follow."""
    if after is not None:
        strictly = F.lit(False)
        for k in range(len(order)):
            same = F.lit(True)
            for j in range(k):
                same = same & (F.col(order[j]) == F.lit(after[j]))
            strictly = strictly | (same & (F.col(order[k]) > F.lit(after[k])))
        rows = rows.where(strictly)
    top = rows.orderBy(*order).limit(limit + 1)  # one more tells whether the page is cut
    seen = top.select("*", F.row_number().over(Window.orderBy(*order)).alias("_n"), F.count(F.lit(1)).over(Window.partitionBy()).alias("_all"))
    return seen.where(F.col("_n") <= limit).select(*rows.columns, (F.col("_all") > limit).alias("truncated"))


def range_filter(keys: DataFrame, by: list[str], key: str = "key") -> DataFrame:
    """(by, mark, whole): each key cut behind the first character that tells it from its neighbours in order, and whether that left it whole."""
    w = Window.partitionBy(*by).orderBy(key)
    shared = F.greatest(*[F.when(side.isNull(), 0).otherwise(shared_prefix(F.col(key), side)) for side in (F.lag(key).over(w), F.lead(key).over(w))])
    return keys.select(*by, key).distinct().withColumn("_n", shared).select(*by, F.substr(key, F.lit(1), F.col("_n") + 1).alias("mark"), (F.col("_n") + 1 >= F.length(key)).alias("whole"))


def may_hold(spans: DataFrame, marks: DataFrame, by: list[str]) -> DataFrame:
    """spans (by, low, high) with whether the filter holds a mark that may stand for a key in [low, high).

    Either the least mark at or above low is below high, or low begins with a cut mark: that is the greatest below low,
    as no other mark begins with a cut one.
    """
    starts = marks.select(*by, F.col("mark").alias("start"))
    above = ceil_join(spans.withColumn("key", F.col("low")), starts, by=by).withColumnRenamed("start", "_above")
    below = floor_join(above, starts, by=by)
    cut = marks.where("not whole").select(*by, F.col("mark").alias("start"), F.lit(True).alias("_cut"))
    begins = F.col("_cut") & F.startswith("low", "start")
    return below.join(cut, [*by, "start"], "left").select(*by, "low", "high", (F.coalesce(F.col("_above") < F.col("high"), F.lit(False)) | F.coalesce(begins, F.lit(False))).alias("may_hold"))
