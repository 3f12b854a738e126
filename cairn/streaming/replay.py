"""Replay of a command log into versions: a closed form over windows for batches, and a stateful stream that must agree.

Commands are puts and unnamed deletes of (bucket, key) in seq order, each under its bucket's versioning at the time:
enabled adds a version or stacks a marker; suspended replaces the null version by a version or a marker; unversioned
replaces or removes the null version.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "bucket string, key string, seq long, versions long, marker boolean"
STATE = "kept long, has_null boolean, null_marker boolean, seq long, last_marker boolean, last_null boolean"


def replay(log: DataFrame, mode: Column) -> DataFrame:
    """(bucket, key, seq, versions, marker): each key's last command, versions left, and whether the current one is a marker (null if none is left).

    Only the last command outside enabled times decides the null version, so one grouped pass is enough.
    """
    c = log.withColumn("mode", mode)
    enabled = F.col("mode") == "enabled"
    last_null = F.max_by(F.struct("mode", "marker"), F.when(~enabled, F.col("seq")))
    g = c.groupBy("bucket", "key").agg(F.max("seq").alias("seq"), F.count_if(enabled).alias("kept"), last_null.alias("n"), F.max(F.when(~enabled, F.col("seq"))).alias("null_seq"), F.max(F.when(enabled, F.col("seq"))).alias("kept_seq"), F.max_by("marker", F.when(enabled, F.col("seq"))).alias("kept_marker"))
    gone = F.coalesce((F.col("n.mode") == "unversioned") & F.col("n.marker"), F.lit(False))
    null_there = F.col("null_seq").isNotNull() & ~gone
    newest_null = null_there & (F.col("kept_seq").isNull() | (F.col("null_seq") > F.col("kept_seq")))
    return g.select("bucket", "key", "seq", (F.col("kept") + null_there.cast("long")).alias("versions"), F.when(newest_null, F.col("n.marker")).otherwise(F.col("kept_marker")).alias("marker"))


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    kept, has_null, null_marker, seq, kept_marker, null_newer = state.get if state.exists else (0, False, False, -1, False, False)
    kept_marker = None if not kept else kept_marker
    for row in pd.concat(list(batches)).sort_values("seq").itertuples():
        if row.seq <= seq:  # answered before
            continue
        seq = row.seq
        if row.mode == "enabled":
            kept, kept_marker, null_newer = kept + 1, bool(row.marker), False
        elif row.mode == "suspended" or not row.marker:
            has_null, null_marker, null_newer = True, bool(row.marker), True
        else:
            has_null = null_newer = False
    state.update((int(kept), bool(has_null), bool(null_marker), int(seq), bool(kept_marker), bool(null_newer)))
    marker = null_marker if has_null and null_newer else kept_marker
    yield pd.DataFrame({"bucket": [key[0]], "key": [key[1]], "seq": [seq], "versions": [kept + has_null], "marker": pd.array([marker], "boolean")})


def replay_stream(log: DataFrame, mode: Column) -> DataFrame:
    """The same as a stream: each key's state after each micro-batch, commands told apart by seq."""
    return log.withColumn("mode", mode).select("bucket", "key", "seq", "marker", "mode").groupBy("bucket", "key").applyInPandasWithState(_fold, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def settle(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what is there now, and return each key's last state."""
    spark, run = stream.sparkSession, f"{folder.rstrip('/')}/replay-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{run}/out")

    started = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start()
    started.awaitTermination()
    out = spark.read.parquet(f"{run}/out")
    return out.groupBy("bucket", "key").agg(F.max_by(F.struct("seq", "versions", "marker"), F.struct("batch", "seq")).alias("s")).select("bucket", "key", "s.*")


def deduplicated(stream: DataFrame, identity: list[str], at: str, horizon: str) -> DataFrame:
    """Commands told apart by their identity until its mark expires."""
    return stream.withWatermark(at, horizon).dropDuplicatesWithinWatermark(identity)


def usage_windows(stream: DataFrame, at: str, width: str, late: str) -> DataFrame:
    """Bytes and commands of each bucket by window; what comes later than the watermark is refused."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), "bucket").agg(F.count("*").alias("commands"), F.sum("size").alias("bytes")).select(F.col("w.start").alias("start"), "bucket", "commands", "bytes")
