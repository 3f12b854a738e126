"""Benchmark decontamination: exact occurrences of item windows in documents, by a prefix-filtered join.

A window is ``width`` consecutive words of an item, or all words of a shorter item. Each window is entered under its
rarest word over the whole corpus, the one token that any text holding the window must hold. A document's words meet
that index; each meeting fixes where the window would begin, the text's bounds rule out what doesn't fit, and the rest
is verified word by word.

The index of a block of items is broadcast; blocks hold at most ``block_bytes`` of item text (a longer single item is
a block of its own), and there are as many passes over the documents as blocks.

Defined results: null or wordless texts have n_words 0 and hold nothing; items without words have no windows, items
without an id are left out; items of equal text are counted each, rows of one item id are one item; of words equally
rare the one of the smaller hash, then the first, enters a window. Repeated document rows, rows that share an id and
rows with a null id are judged one by one, whatever the number of blocks. A very long text is a piece of its own, read
whole. An empty table gives an empty result, an empty benchmark leaves every document clean. Other columns may have
any names.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ._shared import Words, pieces, schema_of, small_batches, staged, table_of, whole_row

WORD_BYTES = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_WORDS = table_of(WORD_BYTES)
BLOCK_BYTES = 2 << 20  # of item text: an index holds some hundred times that


def _words_of(texts: list[str | None]):
    for a, _, data, bounds in pieces(pa.array(texts, pa.string())):
        words = Words(data, bounds, _WORDS)
        for r in range(len(bounds) - 1):
            i, n = int(words.first[r]), int(words.count[r])
            yield a + r, words.hashes[i : i + n], [words.word(k) for k in range(i, i + n)]


class Index:
    """Windows by their rarest word."""

    def __init__(self, items: list[int], texts: list[str | None], width: int, counts: dict[int, int]) -> None:
        seen: dict[tuple[bytes, ...], int] = {}
        self.words: list[tuple[bytes, ...]] = []
        self.items: list[list[int]] = []
        hashes = []
        for r, h, words in _words_of(texts):
            size = min(width, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                key = tuple(words[i : i + size])
                w = seen.setdefault(key, len(self.words))
                if w == len(self.words):
                    self.words.append(key)
                    self.items.append([])
                    hashes.append(h[i : i + size])
                if items[r] not in self.items[w]:
                    self.items[w].append(items[r])
        self.sizes = np.array([len(x) for x in hashes], np.int64)
        self.hashes = np.zeros((len(hashes), width), np.uint64)
        place = np.zeros(len(hashes), np.int64)
        for w, h in enumerate(hashes):
            self.hashes[w, : len(h)] = h
            place[w] = min(range(len(h)), key=lambda t: (counts.get(int(h[t]), 0), int(h[t]), t))
        rare = self.hashes[np.arange(len(hashes)), place] if hashes else np.zeros(0, np.uint64)
        order = np.argsort(rare, kind="stable")
        self.windows, self.place = order, place[order]
        self.keys, self.begin = np.unique(rare[order], return_index=True)
        self.many = np.diff(np.append(self.begin, len(order)))
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def matches(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first word, window) of each occurrence."""
        none = np.zeros(0, np.int64)
        h = words.hashes
        if not len(self.keys) or not len(h):
            return none, none, none
        at = np.flatnonzero(self.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[k] == h[at]
        at, k = at[hit], k[hit]
        n = self.many[k]
        entry = np.repeat(self.begin[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else none
        at = np.repeat(at, n)
        window = self.windows[entry]
        begin = at - self.place[entry]
        row = np.searchsorted(words.first, at, side="right") - 1  # the last row that begins there: empty rows own no word
        fits = (begin >= words.first[row]) & (begin + self.sizes[window] <= words.first[row] + words.count[row])
        row, begin, window = row[fits], begin[fits], window[fits]
        for t in range(self.hashes.shape[1]):
            same = (self.sizes[window] <= t) | (h[np.minimum(begin + t, len(h) - 1)] == self.hashes[window, t])
            row, begin, window = row[same], begin[same], window[same]
        exact = np.array([all(words.word(b + t) == x for t, x in enumerate(self.words[w])) for b, w in zip(begin.tolist(), window.tolist(), strict=True)], bool)
        return (row[exact], begin[exact], window[exact]) if len(exact) else (row, begin, window)


def _counted(vocabulary: np.ndarray):
    """Occurrences of the benchmark's words, summed over a partition."""

    def each(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, _, data, bounds in pieces(batch.column(0)):
                h = Words(data, bounds, _WORDS).hashes
                k = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                total += np.bincount(k[vocabulary[k] == h], minlength=len(vocabulary))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "n"])

    return each


def _scan(shared, kind: pa.DataType):
    def each(batches):
        index = shared.value
        for batch in batches:
            for a, b, data, bounds in pieces(batch.column(1)):
                words = Words(data, bounds, _WORDS)
                row, begin, window = index.matches(words)
                edge = np.zeros(len(words.hashes) + 1, np.int64)
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + index.sizes[window], -1)
                inside = np.cumsum(edge)[:-1] > 0
                hits: list[list[int]] = [[] for _ in range(b - a)]
                items: list[set[int]] = [set() for _ in range(b - a)]
                for r in np.unique(row).tolist():
                    first = int(words.first[r])
                    hits[r] = np.flatnonzero(inside[first : first + int(words.count[r])]).tolist()
                for r, w in set(zip(row.tolist(), window.tolist(), strict=True)):
                    items[r].update(index.items[w])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(words.count), pa.array(hits, pa.list_(pa.int32())), pa.array([sorted(x) for x in items], pa.list_(kind))],
                    ["id", "n_words", "hits", "items"],
                )

    return each


def _block(items: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(id, n_words, hits, items) by the windows of a block of items: one pass that counts its words, one that scans."""
    spark = docs.sparkSession
    got = items.toArrow()
    ids, texts = got["id"].to_pylist(), got["text"].to_pylist()
    vocabulary = np.unique(np.concatenate([np.zeros(1, np.uint64), *[h for _, h, _ in _words_of(texts)]]))
    sums = docs.select("text").mapInArrow(_counted(vocabulary), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    counts = {int(vocabulary[k]): n for k, n in zip(sums["k"].to_pylist(), sums["n"].to_pylist(), strict=True)}
    shared = spark.sparkContext.broadcast(Index(ids, texts, width, counts))
    kind = items.schema["id"].dataType
    schema = schema_of(id=docs.schema["id"].dataType, n_words="long", hits="array<int>", items=T.ArrayType(kind))
    return docs.mapInArrow(_scan(shared, to_arrow_type(kind)), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 8, block_bytes: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """One row a document: id, n_words, n_hit (words inside occurring windows), n_items, items (ids of items that occur), and with ``carry`` the whole row."""
    small_batches(docs.sparkSession)
    bench = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text"))
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    of_row = F.struct(F.col(id_col).alias("id"), *([whole_row(docs)] if carry else []))
    source = docs.select(of_row.alias("id"), F.col(text_col).alias("text"))
    if blocks == 1:
        found = _block(bench, source, width)
    else:
        # a number for each row, made once, is what the blocks' findings meet on; one block's index at a time
        numbered = staged(source.withColumn("row", F.monotonically_increasing_id()), "numbered")
        texts, parts = numbered.select(F.col("row").alias("id"), "text"), []
        for b in range(blocks):
            parts.append(staged(_block(bench.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b), texts, width).where((F.size("hits") > 0) | F.lit(b == 0)), "block"))
        whole = functools.reduce(DataFrame.union, parts)
        merged = whole.groupBy(F.col("id").alias("row")).agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        found = numbered.select("row", "id").join(merged, "row")
    return found.select(F.col("id.id").alias(id_col), "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", *(["id.row"] if carry else []))
