"""Outcomes of a file layer's commands, from windows over its log.

A file is written once, whole: the first write that isn't late makes it, a write of the same content again is answered
the same, another conflicts, and a delete makes room for a new one. A write is late when the range's clock, the latest
time seen, is past the deadline of the blocks it names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators import dataflow


def file_outcomes(log: DataFrame) -> DataFrame:
    """log: range, file, seq, at, op (write or delete), content, deadline. Adds outcome: written, conflict, expired or deleted."""
    of_file = Window.partitionBy("range", "file").orderBy("seq")
    now = dataflow.running_max(log, ["range"], "seq", F.col("at"), "now")
    deletes = F.sum((F.col("op") == "delete").cast("int")).over(of_file.rowsBetween(Window.unboundedPreceding, 0))
    epochs = now.withColumns({"epoch": deletes, "timely": (F.col("op") == "write") & (F.col("now") <= F.col("deadline"))})
    before = Window.partitionBy("range", "file", "epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    made = epochs.withColumn("made", F.first(F.when(F.col("timely"), F.col("content")), ignorenulls=True).over(before))
    outcome = F.when(F.col("op") == "delete", "deleted").when(F.col("made").isNotNull(), F.when(F.col("made") == F.col("content"), "written").otherwise("conflict")).when(F.col("timely"), "written").otherwise("expired")
    return made.withColumn("outcome", outcome).drop("now", "epoch", "timely", "made")
