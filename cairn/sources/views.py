"""Object-store views over star-schema Parquet tables. Each is a DataFrame; the same definitions in SQL are in plans.sql."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXTENT_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


class Lake:
    """Tables of one folder and the views over them."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def version_log(self) -> DataFrame:
        """Puts and delete markers: bucket, key, seq, created (microseconds), size, marker, etag, headers."""
        e = self.table("events")
        return e.select(
            F.concat(F.lit("b"), F.col("user_id") % 4).alias("bucket"),
            F.concat_ws("/", (F.col("user_id") % 10).cast("string"), F.col("user_id").cast("string")).alias("key"),
            F.col("event_id").alias("seq"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("created"),
            F.round(F.col("value") * 100).cast("long").alias("size"),
            (F.col("event_type") == "error").alias("marker"),
            F.md5(F.col("event_id").cast("string")).alias("etag"),
            F.col("event_type").alias("kind"),
            F.col("user_id"),
            F.col("value"),
            F.col("props"),
        )

    def files(self) -> DataFrame:
        o = self.table("orders")
        return o.select(F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("owner"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("made"), F.col("o_orderstatus").alias("status"))

    def extents(self) -> DataFrame:
        """Extents of files in order, each at its running offset: (file, ordinal, start, end, length, block, volume)."""
        li = self.table("lineitem")
        w = Window.partitionBy("l_orderkey").orderBy(*EXTENT_ORDER)
        placed = li.select(F.col("l_orderkey").alias("file"), F.row_number().over(w).alias("ordinal"), F.col("l_quantity").cast("long").alias("length"), F.col("l_partkey").alias("block"), F.col("l_suppkey").alias("volume"), F.sum(F.col("l_quantity").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("end"))
        return placed.select("file", "ordinal", (F.col("end") - F.col("length")).alias("start"), "end", "length", "block", "volume")

    def volumes(self) -> DataFrame:
        """Volumes with their failure domains: a bounded dimension (node and domain are fixed tables)."""
        s, n, r = self.table("supplier"), self.table("nation"), self.table("region")
        return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("volume"), F.col("n_nationkey").alias("node"), F.col("r_name").alias("domain"), F.col("s_acctbal").alias("bytes"))

    def parts(self) -> DataFrame:
        c = self.table("conversations")
        return c.select(F.col("conv_id").alias("upload"), F.col("turn").alias("part"), F.col("role"), F.col("text").alias("body"))

    def objects(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("object"), F.col("text").alias("body"))
