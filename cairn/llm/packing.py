"""Packing of documents into batches by optimal length buckets.

Lengths are tokens (words between white space, and one end). Texts longer than ``max_tokens`` are cut into pieces before
a word; a piece says at which characters of its text it begins and ends, so that a text's pieces joined are the text.
Dynamic programming over the global histogram of piece lengths chooses at most ``buckets`` boundaries that minimise
padding. Inside a bucket of boundary b, batches take floor(token_budget / b) pieces (one at least).

The histogram has at most ``bins`` lengths: exact up to the point where it would exceed that, rounded up to a step
above (padding is then optimal to within a step). Numbers inside a bucket are exact and gapless: each row is numbered
within its (bucket, shard) and shards' starts come from their counts, so no bucket lies in one task.

Defined results: a null or blank text is its end alone, one token; repeated rows are separate pieces, and which of two
equal ones comes first makes no difference; rows of one id or without one are numbered by their texts' hashes; a very long
text is as many pieces as it needs; an empty table packs nothing. Only the id and the text are read, so other columns
may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Words, pieces, schema_of, small_batches, staged, table_of

MAX_TOKENS = 4096
TOKEN_BUDGET = 32_768
BUCKETS = 12
BINS = MAX_TOKENS  # every length
SHARDS = 1024


_WORDS = table_of()


def _cut(max_tokens: int):
    """Rows (id, h, piece, n_tokens, begin, end) of the pieces of (id, h, text); begin and end count characters."""

    def each(batches):
        for batch in batches:
            for a, b, data, bounds in pieces(batch.column(2)):
                words = Words(data, bounds, _WORDS)
                opens = (data & 0xC0) != 0x80  # the first byte of each character
                before = np.concatenate([[0], np.cumsum(opens)])
                n = words.count + 1
                many = -(-n // max_tokens)
                row = np.repeat(np.arange(b - a), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                token = piece * max_tokens
                # where the piece's first word begins; a piece of the end alone begins where the text ends
                word = words.first[row] + token
                held = (token > 0) & (token < words.count[row])
                at = np.where(token == 0, bounds[row], bounds[row + 1])
                at[held] = words.starts[word[held]]
                begin = before[at] - before[bounds[row]]
                last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
                end = np.where(last, before[bounds[row + 1]] - before[bounds[row]], np.append(begin[1:], 0))
                owner = pa.array(a + row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(owner), batch.column(1).take(owner), pa.array(piece.astype(np.int32)), pa.array(np.minimum(max_tokens, n[row] - token)), pa.array(begin), pa.array(end)],
                    ["id", "h", "piece", "n_tokens", "begin", "end"],
                )

    return each


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """Ascending boundaries of at most ``buckets`` buckets with the least padding, and that padding.

    cost[k, j]: least padding of the first j lengths in k buckets; the last bucket takes lengths i..j-1 at the
    length of the last of them.
    """
    m = len(lengths)
    if not m:
        return [], 0
    n = np.concatenate([[0], np.cumsum(counts)])
    t = np.concatenate([[0], np.cumsum(counts * lengths)])
    best = np.full((min(buckets, m) + 1, m + 1), np.inf)
    best[0, 0] = 0
    cut = np.zeros(best.shape, np.int64)
    for k in range(1, len(best)):
        for j in range(1, m + 1):
            i = np.arange(j)
            cost = best[k - 1, :j] + lengths[j - 1] * (n[j] - n[i]) - (t[j] - t[i])
            cut[k, j] = at = int(cost.argmin())
            best[k, j] = cost[at]
    k, j = int(best[:, m].argmin()), m
    least, marks = int(best[k, m]), []
    while k:
        marks.append(int(lengths[j - 1]))
        j, k = int(cut[k, j]), k - 1
    return marks[::-1], least


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, token_budget: int = TOKEN_BUDGET, buckets: int = BUCKETS, bins: int = BINS, shards: int = SHARDS) -> DataFrame:
    """One row a piece: id, piece (from 0), begin and end (characters of its text), n_tokens, bucket (padded length), batch (within the bucket), slot (within the batch), padding."""
    small_batches(docs.sparkSession, 2000)
    # the text's hash spreads rows that share an id, or have none, over the shards
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    schema = schema_of(id=source.schema["id"].dataType, h="long", piece="int", n_tokens="long", begin="long", end="long")
    cut = source.mapInArrow(_cut(max_tokens), schema)
    pieces_ = staged(cut.withColumn("shard", F.pmod(F.xxhash64("id", "h", "piece"), F.lit(shards)).cast("int")), "pieces")
    step = max(1, -(-max_tokens // bins))
    bound = F.least(F.lit(max_tokens), F.ceil(F.col("n_tokens") / step) * step).cast("long")
    histogram = {r["l"]: r["n"] for r in pieces_.groupBy(bound.alias("l")).agg(F.count("*").alias("n")).collect()}
    lengths = np.array(sorted(histogram), np.int64)
    marks, _ = boundaries(lengths, np.array([histogram[x] for x in lengths.tolist()], np.int64), buckets)
    bucket = F.coalesce(*[F.when(F.col("n_tokens") <= b, F.lit(b)) for b in marks], F.lit(max_tokens)).cast("long")
    placed = pieces_.withColumn("bucket", bucket)
    # a start for each shard of each bucket: at most buckets * shards rows
    counts = placed.groupBy("bucket", "shard").agg(F.count("*").alias("c"))
    starts = counts.select("bucket", "shard", (F.sum("c").over(Window.partitionBy("bucket").orderBy("shard")) - F.col("c")).alias("start"))
    number = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("id", "piece", "n_tokens", "h"))
    numbered = placed.withColumn("k", number).join(F.broadcast(starts), ["bucket", "shard"]).withColumn("k", F.col("start") + F.col("k") - 1)
    size = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.col("bucket")))
    return numbered.select(F.col("id").alias(id_col), "piece", "begin", "end", "n_tokens", "bucket", F.floor(F.col("k") / size).cast("long").alias("batch"), F.pmod("k", size).cast("long").alias("slot"), (F.col("bucket") - F.col("n_tokens")).alias("padding"))
