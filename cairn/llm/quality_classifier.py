"""Document quality by hierarchical empirical Bayes: a classifier's evidence for the text, joined with what its host
and its path on the host are known for.

Evidence comes from two classifiers. Words, counted over about ``sample`` labelled rows drawn by a hash of the id, or all: the distinct words and pairs of neighbouring
words of a text fall by hash into GRAMS classes; the rate of good rows among those that hold a class, shrunk towards
the rate of all, gives the class's log odds, so that a class met rarely says little; their mean is the text's word
score, a labelled row's without its own part in the counts. Shape, counted over all labelled rows: features of the text (shares of symbols, capitals,
digits, odd words; repetition; word length; size). All features and the word score fall into bins, each bin's smoothed
log odds are counted over these rows, and a text's evidence is their sum, scaled by ``weight`` as features
overlap. Hosts: the global rate of good rows and a prior strength by the method
of moments over hosts shrink each host's rate; paths are shrunk the same way towards their host. Hosts and paths without
labelled rows get the rate above them. The score is the posterior probability with the path's rate as the prior.

A text is kept as the classes of its words in order, two bytes each, which never leave where they were written: the
drawn labels, of bounded number, go to every task. Counts and rates are sums over groups, combined map-side; hosts and
paths are joined as tables of one row each.

Defined results: null texts are empty texts, without words and with the shape of nothing; a null host or path is a
group of its own; a row with several labels counts each time in the sums; a label without its row counts nowhere;
without labels, or with one class only, the score follows the smoothed rates; a score of exactly one half is good. A
very long text is read whole. Repeated rows are scored one by one; an empty table gives an empty result; only the named
columns are read, so others may have any names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Words, pieces, schema_of, small_batches, staged, table_of

GRAMS = 1 << 16  # classes of words and pairs
GRAM_STRENGTH = 10.0  # labelled rows that the rate of all rows counts for beside those of a class
_WORDS = table_of()

#: Upper ends of the bins of each feature; values above fall into one more bin.
EDGES = {
    "symbols": [0.0, 0.002, 0.01, 0.03, 0.1],
    "capitals": [0.005, 0.02, 0.05, 0.15, 0.5],
    "digits": [0.0, 0.005, 0.02, 0.1],
    "marks": [0.005, 0.02, 0.04, 0.08],
    "lines": [0.3, 0.6, 0.9, 0.999],
    "bars": [0.0, 0.0005, 0.004, 0.02],
    "distinct": [0.1, 0.3, 0.5, 0.7, 0.9],
    "word_length": [2.0, 3.5, 5.0, 7.0, 10.0],
    "words": [5.0, 10.0, 50.0, 200.0, 1000.0],
    "word_score": [-2.0, -1.0, -0.5, -0.25, -0.1, 0.0, 0.1, 0.25, 0.5, 1.0],
}
FEATURES = list(EDGES)
SHAPES = FEATURES[:-1]
BY_WORDS = SHAPES[-3:]  # those that come with the words


def features(docs: DataFrame, id_col: str, text_col: str, host: Column, path: Column) -> DataFrame:
    """(id, host, path, bins, text): the bins of the features that don't come with the words."""
    white = " \t\n\x0b\x0c\r"
    base = docs.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.select("id", "host", "path", "text", F.mask("text", F.lit("A"), F.lit("a"), F.lit("0"), F.lit(None)).alias("shape"), F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(white)) != "").alias("ls"))
    size = F.greatest(F.length("text"), F.lit(1))
    left = lambda c, pattern: F.length(c) - F.length(F.regexp_replace(c, pattern, ""))
    drop = lambda c, x: F.length(c) - F.length(F.replace(F.col(c), F.lit(x), F.lit("")))
    values = {
        "symbols": left("text", "[#*$%&|<>]") / size,
        "capitals": drop("shape", "A") / size,
        "digits": drop("shape", "0") / size,
        "marks": left("text", "[.,;:!?]") / size,
        "lines": F.size(F.array_distinct("ls")) / F.greatest(F.size("ls"), F.lit(1)),
        "bars": drop("text", "|") / size,
    }
    bin_of = lambda v, edges: F.coalesce(*[F.when(v <= e, F.lit(i)) for i, e in enumerate(edges)], F.lit(len(edges)))
    return base.select("id", "host", "path", F.array(*[bin_of(values[f], EDGES[f]) for f in SHAPES[:-3]]).alias("bins"), "text")


def _worded(batches):
    """(id, host, path, bins, line): the bins that come with the words too, and the words' classes in order, as 16-bit numbers."""
    edges = [np.array(EDGES[f]) for f in BY_WORDS]
    for batch in (b for b in batches if b.num_rows):
        lines, more = [], []
        for _, _, data, bounds in pieces(batch.column(4)):
            words = Words(data, bounds, _WORDS)
            classes = (words.hashes >> np.uint64(48)).astype(np.uint16)
            letters = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & _WORDS[data])])
            spans = list(zip(words.first.tolist(), words.count.tolist(), strict=True))
            lines += [classes[first : first + n].tobytes() for first, n in spans]
            distinct = np.array([len(np.unique(words.hashes[first : first + n])) for first, n in spans], np.int64)
            least = np.maximum(words.count, 1)
            values = (distinct / least, (letters[bounds[1:]] - letters[bounds[:-1]]) / least, words.count)
            more.append(np.stack([np.searchsorted(e, v) for e, v in zip(edges, values, strict=True)], axis=1))
        bins = np.concatenate([np.array(batch.column(3).to_pylist(), np.int32).reshape(batch.num_rows, -1), np.concatenate(more)], axis=1).astype(np.int32)
        ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * bins.shape[1])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(ends, pa.array(bins.ravel())), pa.array(lines, pa.binary())], ["id", "host", "path", "bins", "line"])


def grams_of(line: bytes) -> np.ndarray:
    """The distinct classes of a text's words and of its pairs of neighbours."""
    words = np.frombuffer(line, np.uint16)
    pairs = (words[:-1].astype(np.uint32) * np.uint32(40_503) + words[1:]).astype(np.uint16)
    return np.unique(np.concatenate([words, pairs]))


def _gram_counts(batches):
    """Good and bad labelled rows that hold each class, summed over a partition."""
    total = np.zeros((2, GRAMS), np.int64)
    for batch in batches:
        for y, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[y, grams_of(line)] += 1
    some = np.flatnonzero(total.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[1, some]), pa.array(total[0, some])], ["g", "good", "bad"])


def _word_bins(shared, labelled: bool):
    """The bin of each row's word score; a labelled row is scored by the counts of the others."""

    def each(batches):
        present, base = shared.value
        edges, prior = np.array(EDGES["word_score"]), math.log(base / (1 - base))
        for batch in batches:
            lines = batch.column(batch.num_columns - 1).to_pylist()
            marks = batch.column(0).to_pylist() if labelled else [None] * len(lines)
            bins = []
            for y, line in zip(marks, lines, strict=True):
                g = grams_of(line)
                good, met = present[1, g], present[0, g] + present[1, g]
                if y is not None:
                    good, met = good - y, met - 1
                rate = (good + GRAM_STRENGTH * base) / (met + GRAM_STRENGTH)
                score = float((np.log(rate / (1 - rate)) - prior).mean()) if len(g) else 0.0
                bins.append(int(np.searchsorted(edges, score)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bins, pa.int32())], [*batch.schema.names[:-1], "word_bin"])

    return each


def _shrunk(groups: DataFrame, prior: Column, strength: Column) -> Column:
    return (F.col("good") + strength * prior) / (F.col("n") + strength)


def strength_of(groups: DataFrame, rate: Column | str) -> float:
    """Prior strength by the method of moments: how little the groups' rates differ beyond chance."""
    p = F.least(F.greatest(F.col(rate) if isinstance(rate, str) else rate, F.lit(1e-3)), F.lit(1 - 1e-3))
    got = groups.where("n > 1").agg(F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - p, 2)).alias("spread"), F.sum(p * (1 - p)).alias("chance"), F.sum(F.col("n") * p * (1 - p)).alias("most")).first()
    if not got["most"]:
        return 10.0
    # share of the variance that lies between groups
    between = max(0.0, (got["spread"] - got["chance"]) / max(1e-9, got["most"] - got["chance"])) if got["most"] > got["chance"] else 0.0
    return min(10_000.0, max(1.0, (1 - between) / max(between, 1e-4)))


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", weight: float = 0.7, sample: int = 100_000) -> DataFrame:
    """One row a document: id, evidence (log odds of the text alone), host_rate, path_rate, score (0 to 1), good (score >= 0.5)."""
    spark = docs.sparkSession
    small_batches(spark, 2000)
    read = features(docs, id_col, text_col, host, path)
    kinds = {c: read.schema[c].dataType for c in ("id", "host", "path", "bins")}
    shaped = staged(read.mapInArrow(_worded, schema_of(**kinds, line="binary")), "shapes")
    marked = staged(labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("y")), "labels")
    known = staged(shaped.select("id", "host", "path", "bins").join(marked, "id"), "known")
    # the words' rows: about ``sample`` of the labels, small enough to go to every task
    share = min(1.0, sample / max(1, marked.count()))
    drawn = marked.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    read_by = shaped.select("id", "line").join(F.broadcast(drawn), "id").select("y", "line")
    held = read_by.mapInArrow(_gram_counts, "g long, good long, bad long").groupBy("g").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()
    present = np.zeros((2, GRAMS))
    present[:, held["g"].to_numpy()] = held["bad"].to_numpy(), held["good"].to_numpy()
    sums = known.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("good"), F.count("*").alias("n")).first()
    good, bad = sums["good"], sums["n"] - sums["good"]
    rate = (good + 1) / (good + bad + 2)
    grams = spark.sparkContext.broadcast((present, rate))
    # each bin's log odds: as many rows as there are bins
    summed = lambda tall: {(r["f"], r["b"]): (r["good"], r["n"] - r["good"]) for r in tall.groupBy("f", "b").agg(F.sum("y").alias("good"), F.count("*").alias("n")).collect()}
    counts = summed(known.select("y", F.posexplode("bins").alias("f", "b")))
    counts |= summed(read_by.mapInArrow(_word_bins(grams, True), "y int, word_bin int").select("y", F.lit(len(SHAPES)).alias("f"), F.col("word_bin").alias("b")))
    totals = {f: tuple(sum(n[k] for (g, _), n in counts.items() if g == f) for k in (0, 1)) for f in range(len(FEATURES))}

    def log_odds(f: int, b: int) -> float:
        (g, x), (ups, downs) = counts.get((f, b), (0, 0)), totals[f]
        size = len(EDGES[FEATURES[f]]) + 1
        return weight * (math.log((g + 0.5) / (ups + 0.5 * size)) - math.log((x + 0.5) / (downs + 0.5 * size)))

    tables = [F.array(*[F.lit(log_odds(f, b)) for b in range(len(EDGES[name]) + 1)]) for f, name in enumerate(FEATURES)]
    evidence = sum((F.get(t, F.get("bins", f)) for f, t in enumerate(tables[:-1])), F.get(tables[-1], F.col("word_bin")))
    paths = staged(known.groupBy("host", "path").agg(F.sum("y").alias("good"), F.count("*").alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    hosts = hosts.select("host", _shrunk(hosts, F.lit(rate), F.lit(strength_of(hosts, F.lit(rate)))).alias("host_rate"))
    hosts = staged(hosts, "hosts").withColumnRenamed("host", "h")
    placed = paths.join(hosts, F.col("host").eqNullSafe(F.col("h")))
    paths = placed.select(F.col("host").alias("ph"), F.col("path").alias("pp"), _shrunk(placed, F.col("host_rate"), F.lit(strength_of(placed, "host_rate"))).alias("path_rate"))
    worded = shaped.select("id", "host", "path", "bins", "line").mapInArrow(_word_bins(grams, False), schema_of(**kinds, word_bin="int"))
    out = worded.select("id", "host", "path", evidence.alias("evidence"))
    out = out.join(hosts, F.col("host").eqNullSafe(F.col("h")), "left").join(paths, F.col("host").eqNullSafe(F.col("ph")) & F.col("path").eqNullSafe(F.col("pp")), "left")
    host_rate = F.coalesce("host_rate", F.lit(rate))
    path_rate = F.coalesce("path_rate", host_rate)
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + F.ln(path_rate) - F.ln(1 - path_rate))))
    return out.select(F.col("id").alias(id_col), "evidence", host_rate.alias("host_rate"), path_rate.alias("path_rate"), posterior.alias("score"), (posterior >= 0.5).alias("good"))
