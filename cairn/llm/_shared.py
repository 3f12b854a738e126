"""Helpers that several operators share: staged tables, Arrow text buffers and vectorised word hashing."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that separate words: space and \t \n \v \f \r.
SPACES = b" \t\n\x0b\x0c\r"
#: Text bytes that the vectorised passes hold at once; a longer single text is a piece of its own.
PIECE_BYTES = 1 << 20

M64 = (1 << 64) - 1


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a default of our own only where the session names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder, and a cluster's machines share none that can be guessed")
    return "file:///tmp/checkpoints"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared checkpoint folder and read it back: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/cairn-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def type_of(df: DataFrame, column: str) -> str:
    """A column's type as SQL names it."""
    return df.schema[column].dataType.simpleString()


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one, so that a verdict on a row can be had beside the row."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def schema_of(**fields: T.DataType | str) -> T.StructType:
    """A schema of fields, each a type or the name of one."""
    parsed = lambda kind: kind if isinstance(kind, T.DataType) else T._parse_datatype_string(kind)
    return T.StructType([T.StructField(name, parsed(kind)) for name, kind in fields.items()])


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch, as texts may be long; a smaller bound that is set already stays."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if not 0 < now <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 on uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers[base]
    if len(have) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


class Words:
    """Words of a run of texts: hash and row of each, and each row's first word and number of words."""

    __slots__ = ("data", "starts", "ends", "hashes", "first", "count")

    def __init__(self, data: np.ndarray, bounds: np.ndarray, in_word: np.ndarray) -> None:
        self.data = data
        n = len(data)
        rows = len(bounds) - 1
        inside = in_word[data]
        before = np.empty(n + 1, bool)
        before[0] = False
        before[1:] = inside
        fresh = before.copy()
        fresh[bounds[bounds <= n]] = False  # a text's end ends its word
        opens = inside & ~fresh[:-1]
        after = np.empty(n + 1, bool)
        after[:n] = inside
        after[n] = False
        closes = before.copy()
        closes[:-1] &= ~after[:-1]
        at_end = bounds[1:]
        closes[at_end] = before[at_end]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes)
        # an empty text's bound repeats its neighbour's and closes nothing twice
        first = np.searchsorted(self.starts, bounds)
        self.first, self.count = first[:rows], np.diff(first)
        run = np.empty(n + 1, np.uint64)
        run[0] = 0
        np.cumsum(_BYTE[data] * _power(_BASE, n), out=run[1:])
        got = (run[self.ends] - run[self.starts]) * _power(_INVERSE, n + 1)[self.starts]
        self.hashes = mix(got + (self.ends - self.starts).astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def table_of(word_bytes: bytes | None = None, not_word: bytes = SPACES) -> np.ndarray:
    """A lookup of 256 flags: which bytes belong to words."""
    flags = np.ones(256, bool)
    flags[list(not_word)] = False
    if word_bytes is not None:
        flags[:] = False
        flags[list(word_bytes)] = True
    return flags


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def pieces(texts: pa.Array, limit: int = PIECE_BYTES):
    """Yield (from row, to row, lower-cased bytes, bounds) over runs of whole texts; A-Z only are lower-cased, null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    rows = len(texts)
    if not rows:
        return
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + rows + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if texts.null_count:  # a null may own bytes: read lengths through the validity
        filled = texts.fill_null(b"")
        yield from pieces(filled, limit)
        return
    at = 0
    while at < rows:
        to = int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1
        to = min(rows, max(to, at + 1))
        part = raw[bounds[at] : bounds[to]]
        yield at, to, LOWER[part], bounds[at : to + 1] - bounds[at]
        at = to
