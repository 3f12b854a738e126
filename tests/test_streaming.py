"""Streams settle on what the batch forms give."""

from pyspark.sql import functions as F

from cairn.plans.replay import mode
from cairn.sources.views import Lake
from cairn.streaming import replay


def test_replay_agrees(spark, tmp_path):
    log = Lake(spark, "/root/testdata/sf0.001").version_log().select("bucket", "key", "seq", "marker", "created", "size")
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 5).parquet(str(tmp_path / "log"))
    settled = replay.settle(replay.replay_stream(stream, mode()), str(tmp_path))
    key = lambda r: (r["bucket"], r["key"])
    names = ["bucket", "key", "seq", "versions", "marker"]
    assert sorted(map(tuple, settled.select(names).collect()), key=str) == sorted(map(tuple, replay.replay(log, mode()).select(names).collect()), key=str)


def test_identities_and_windows(spark, tmp_path):
    log = Lake(spark, "/root/testdata/sf0.001").version_log().select("bucket", "seq", "size", F.timestamp_micros("created").alias("at"))
    log.union(log).coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    q = replay.deduplicated(stream, ["seq"], "at", "400 days").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == log.count()
    q = replay.usage_windows(stream, "at", "1 day", "1 hour").writeStream.format("memory").queryName("usage").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("usage").agg(F.sum("commands")).first()[0] == 2 * log.count()
