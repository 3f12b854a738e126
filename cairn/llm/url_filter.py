"""URL filtering by host and path rules: a sort-merge range join on reversed-host keys.

The key of a host is its labels reversed, each ended by a dot, so that a host and all its subdomains are one interval
of keys and the intervals nest. Each partition is sorted by key and swept once beside the sorted rules; a stack holds
the hosts whose interval is open. A rule fits if its host is on the stack and the path starts with its path; the
longest rule (host and path together) wins, then the longer host; of one rule given twice, block.

Rules are broadcast in blocks of at most ``max_rules`` and about BLOCK_BYTES of text; the best rule so far is carried
from block to block. A page's url is read where it lies, so a host that holds a third of all pages is spread as they are.

Defined results: a url that is null or has no ``://`` has empty host and path and meets no rule unless one has an
empty host; without a rule the verdict is ``default``. A rule without host, path or verdict is none. Very long urls are
read whole, and rules as long are compared by their lengths. Repeated rows are judged one by one; an empty table gives
an empty result, no rules leave every page to ``default``; only id and url are read, so other columns may have any names.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import small_batches, staged, type_of

MAX_RULES = 500_000
BLOCK_BYTES = 32 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class Sweep:
    """One pass over ascending keys beside the sorted rules."""

    def __init__(self, rules: list[tuple[str, dict[str, tuple[str, str]], list[int]]]) -> None:
        self.rules, self.next, self.open, self.key = rules, 0, [], None

    def at(self, key: str) -> list[tuple[str, dict[str, tuple[str, str]], list[int]]]:
        if key != self.key:
            self.key = key
            while self.next < len(self.rules) and self.rules[self.next][0] <= key:
                entry = self.rules[self.next]
                self.next += 1
                while self.open and not entry[0].startswith(self.open[-1][0]):
                    self.open.pop()
                self.open.append(entry)
            while self.open and not key.startswith(self.open[-1][0]):
                self.open.pop()
        return self.open


def sorted_rules(rows: list[tuple[str, str, str]]) -> list[tuple[str, dict[str, tuple[str, str]], list[int]]]:
    """(key, {path: (rule, verdict)}, path lengths from the longest) by key."""
    by_key: dict[str, dict[str, tuple[str, str]]] = {}
    for host, path, verdict in rows:
        key = ".".join(reversed(host.split("."))) + "."
        paths = by_key.setdefault(key, {})
        if path not in paths or verdict == "block":
            paths[path] = (host + path, verdict)
    return [(k, p, sorted({len(x) for x in p}, reverse=True)) for k, p in sorted(by_key.items())]


def _judge(shared):
    def each(batches):
        sweep = Sweep(shared.value)
        for batch in batches:
            best, rules, verdicts = batch.column("best").to_pylist(), batch.column("rule").to_pylist(), batch.column("verdict").to_pylist()
            for i, (key, path) in enumerate(zip(batch.column("key").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                for _, paths, lengths in reversed(sweep.at(key)):
                    for n in lengths:
                        found = paths.get(path[:n]) if n <= len(path) else None
                        if found:
                            host_size = len(found[0]) - n
                            rank = (len(found[0]) << 32) + host_size
                            if rank > best[i]:
                                best[i], (rules[i], verdicts[i]) = rank, found
                            break
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "host", "path", "key")), pa.array(best, pa.int64()), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                ["id", "host", "path", "key", "best", "rule", "verdict"],
            )

    return each


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """One row a page: id, host, path, rule (host and path of the longest that fits, or null), verdict.

    ``rules`` has host, path and verdict (allow or block).
    """
    spark = pages.sparkSession
    small_batches(spark, 5000)
    url = F.col(url_col)
    at = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    at = at.select("*", reversed_key(F.col("host")).alias("key")).sortWithinPartitions("key")
    at = at.select("*", F.lit(-1).cast("long").alias("best"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    rules = rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict").where("host is not null and path is not null and verdict is not null")
    size = rules.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, math.ceil(size["n"] / max_rules), math.ceil(size["bytes"] / BLOCK_BYTES))
    for b in range(blocks):
        rows = [tuple(r) for r in rules.where(F.pmod(F.xxhash64("host", "path"), F.lit(blocks)) == b).collect()]
        shared = spark.sparkContext.broadcast(sorted_rules(rows))
        if b:  # one block's rules in memory at a time
            at = staged(at, "urls").sortWithinPartitions("key")
        at = at.mapInArrow(_judge(shared), f"id {type_of(pages, id_col)}, host string, path string, key string, best long, rule string, verdict string")
    return at.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict")
