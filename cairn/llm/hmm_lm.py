"""Hidden Markov language model: Baum-Welch over all training texts, exact scaled forward scores.

A token is a symbol and, within it, a word: words met ``OWN`` times in training (VOCABULARY of them at least, MOST at
most, the most frequent ones) and the text's end are symbols of their own; each other word falls, by its ending, into one of ``CLASSES`` class symbols, inside which its probability
is its smoothed share. States emit symbols, so that a text's probability is its symbols' forward likelihood times its
words' shares in their classes. Word counts come from all training texts by a grouped sum; expected counts of
transitions and emissions are summed across partitions in each round and only the model itself reaches the driver.
The start is free of data: emissions are the symbols' shares with noise. First each text lies in one state as a whole,
then states move within texts; either goes on over all training texts until a round adds less than TOLERANCE to the
log likelihood a token. No text is cut, in training or in scoring.

The ``common`` most frequent words are broadcast with their counts (bounded by that parameter); all others meet their
counts in a join by word hash.

Defined results: a null or blank text is its end alone; without training texts all shares are those of unseen words
and the states are alike; of words equally frequent those of the smaller hash have symbols of their own; a very long
text is one line, held whole by its task; repeated rows are scored one by one; an empty table gives an empty result;
only id, text and ``held`` are read, so other columns may have any names. Words are told apart by 64-bit hashes. Scores
are a function of the rows and not of how they are dealt out, but for the rounding of sums.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Words, pieces, small_batches, staged, table_of, type_of

STATES = 8
VOCABULARY = 4000
COMMON = 100_000
CLASSES = 64
OWN = 50  # training tokens from which a word is a symbol of its own
MOST = 65_000  # words with symbols of their own: symbols are 16 bits
HELD = 1_000_000  # tokens of whole texts that a training pass takes at once
TOLERANCE = 0.005  # nats a token
TASK_TOKENS = 16_000_000  # training tokens of a task: its sums are as large as the model, whatever it has read
SCALED = 12  # steps between scalings
ALPHA = 0.1

_WORDS = table_of()
_COLUMNS = [f"x{k}" for k in range(STATES)]


def _class_of(words: Words) -> np.ndarray:
    """A word's class: a mix of its last three bytes."""
    data, end = words.data, words.ends
    got = np.zeros(len(end), np.int64)
    for k in (1, 2, 3):
        at = end - k
        got = got * 31 + np.where(at >= words.starts, data[np.maximum(at, 0)], 0)
    return (got ^ (got >> 7)) % CLASSES


def _count(batches):
    """Word hashes of a partition with class and count; it lets go of what it has gathered when that grows large."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def summed():
        h, k, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        h, at, back = np.unique(h, return_index=True, return_inverse=True)
        return h, k[at], np.bincount(back, n, len(h)).astype(np.int64)

    def out(h, k, n):
        for a in range(0, len(h), 100_000):
            z = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(h[z].view(np.int64)), pa.array(k[z].astype(np.int32)), pa.array(n[z])], ["h", "k", "n"])

    for batch in batches:
        for _, _, data, bounds in pieces(batch.column(0)):
            words = Words(data, bounds, _WORDS)
            if len(words.hashes):
                h, at, n = np.unique(words.hashes, return_index=True, return_counts=True)
                parts.append((h, _class_of(words)[at], n))
                held += len(h)
        if held > 2_000_000:
            got = summed()
            if len(got[0]) > 1_000_000:
                yield from out(*got)
                parts, held = [], 0
            else:
                parts, held = [got], len(got[0])
    if parts:
        yield from out(*summed())


class Codes:
    """What the encoder needs of the common words, sorted by hash: symbol or -1, and log10 terms."""

    def __init__(self, hashes: np.ndarray, symbols: np.ndarray, base: np.ndarray, inside: np.ndarray, vocabulary: int) -> None:
        self.vocabulary = vocabulary
        order = np.argsort(hashes)
        self.hashes, self.symbols, self.base, self.inside = hashes[order], symbols[order], base[order], inside[order]


def _encode(shared):
    """Rows of symbols, the sums over common words and the other words with their counts."""

    def each(batches):
        codes = shared.value
        first_class = codes.vocabulary
        end = first_class + CLASSES
        for batch in batches:
            for a, b, data, bounds in pieces(batch.column(2)):
                words = Words(data, bounds, _WORDS)
                h = words.hashes
                rows, n = b - a, words.count
                row = np.repeat(np.arange(rows), n)
                k = _class_of(words)
                if len(codes.hashes):
                    at = np.minimum(np.searchsorted(codes.hashes, h), len(codes.hashes) - 1)
                    known = codes.hashes[at] == h
                else:
                    at, known = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
                symbol = np.where(known & (codes.symbols[at] >= 0), codes.symbols[at], first_class + k) if len(codes.hashes) else first_class + k
                # a sum over nothing would be of whole numbers
                base, inside = (np.bincount(row[known], x[at[known]], rows).astype(np.float64) for x in (codes.base, codes.inside))
                n_known = np.bincount(row[known], minlength=rows)
                # each row's symbols and its end
                place = np.arange(len(h)) + row
                line = np.full(len(h) + rows, end, np.uint16)
                line[place] = symbol
                ends = np.concatenate([[0], np.cumsum(n + 1)]) * 2
                rare_row, rare = row[~known], h[~known]
                # equal rare words of a row are one entry
                order = np.lexsort((rare, rare_row))
                rare_row, rare, rare_k = rare_row[order], rare[order], k[~known][order]
                fresh = np.ones(len(rare), bool)
                fresh[1:] = (rare[1:] != rare[:-1]) | (rare_row[1:] != rare_row[:-1])
                begin = np.flatnonzero(fresh)
                times = np.diff(np.append(begin, len(rare)))
                cut = pa.array(np.searchsorted(rare_row[begin], np.arange(rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cut, pa.array(v)) for v in (rare[begin].view(np.int64), times.astype(np.int32), rare_k[begin].astype(np.int32))]
                symbols = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(line.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(n + 1), pa.array(n_known), pa.array(base), pa.array(inside), symbols, *lists],
                    ["id", "held", "n_tokens", "n_known", "base", "inside", "symbols", "rare", "times", "kinds"],
                )

    return each


class Model:
    """Start, transition and emission probabilities; the emissions have a row for each symbol."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def of(counts: np.ndarray, unigram: np.ndarray) -> Model:
        """From expected counts (see ``expected``), smoothed towards the symbols' overall shares."""
        s = STATES
        start, move, emit = counts[:s], counts[s : s + s * s].reshape(s, s), counts[s + s * s :].reshape(-1, s)
        total = emit.sum(axis=0)
        weight = 1.0 + 0.001 * total
        emit = (emit + weight * unigram[:, None]) / (total + weight)
        return Model((start + 1) / (start.sum() + s), (move + 0.1) / (move.sum(axis=1, keepdims=True) + 0.1 * s), emit)


def expected(model: Model, lines: list[np.ndarray]) -> np.ndarray:
    """Expected counts of starts, moves and emissions, in one vector, over whole lines."""
    return _expected(model, lines)[0]


def _expected(model: Model, lines: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """These counts and the lines' log likelihood; each step over all lines that reach it.

    Emissions are taken relative to the symbols' shares, so that forward and backward values stay near 1 between the
    steps at which they are scaled; what the scales were falls out where each step's expectations are made to sum to 1.
    """
    s = STATES
    symbols = len(model.emit)
    share = model.emit.mean(axis=1)
    lines = sorted(lines, key=len, reverse=True)
    lengths = np.array([len(x) for x in lines])
    longest = int(lengths[0])
    live = np.searchsorted(-lengths, -np.arange(longest), side="left")
    off = np.concatenate([[0], np.cumsum(live)])
    # tokens by step, then by line
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    at = np.concatenate(lines)[starts[np.arange(off[-1]) - np.repeat(off[:-1], live)] + np.repeat(np.arange(longest), live)]
    seen = (model.emit / share[:, None])[at]
    move, back, ones = model.move, np.ascontiguousarray(model.move.T), np.ones(s)
    alpha, beta = np.empty((len(at), s)), np.ones((len(at), s))
    o, scales = off.tolist(), [np.log(share)[at].sum()]

    def scaled(x: np.ndarray) -> np.ndarray:
        c = x.dot(ones)
        x /= c[:, None]
        return c

    np.multiply(model.start, seen[: o[1]], out=alpha[: o[1]])
    for t in range(1, longest):
        a, b = o[t], o[t + 1]
        np.matmul(alpha[o[t - 1] : o[t - 1] + b - a], move, out=alpha[a:b])
        alpha[a:b] *= seen[a:b]
        if t % SCALED == 0:
            scales.append(np.log(scaled(alpha[a:b])).sum())
    last = off[lengths - 1] + np.arange(len(lines))
    scales.append(np.log(alpha[last].dot(ones)).sum())
    for t in range(longest - 1, 0, -1):
        a, b = o[t], o[t + 1]
        seen[a:b] *= beta[a:b]
        before = beta[o[t - 1] : o[t - 1] + b - a]
        np.matmul(seen[a:b], back, out=before)
        if t % SCALED == 0:
            scaled(before)
    step = seen[o[1] :]
    before = alpha[np.arange(o[1], len(at)) - np.repeat(live[:-1], live[1:])]
    step /= ((before @ move) * step).dot(ones)[:, None]
    moves = move * (before.T @ step)
    alpha *= beta
    scaled(alpha)
    emitted = np.stack([np.bincount(at, alpha[:, k], symbols) for k in range(s)], axis=1)
    return np.concatenate([alpha[: o[1]].sum(axis=0), moves.ravel(), emitted.ravel()]), float(sum(scales))


def _whole(model: Model, lines: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Expected counts, without moves, and the log likelihood where each line lies in one state as a whole."""
    s = STATES
    flat = np.concatenate(lines).astype(np.int64)
    lengths = np.array([len(x) for x in lines])
    logs = np.add.reduceat(np.log(model.emit)[flat], np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=0) + np.log(model.start)
    top = logs.max(axis=1, keepdims=True)
    share = np.exp(logs - top)
    total = share.sum(axis=1, keepdims=True)
    share /= total
    emit = np.stack([np.bincount(flat, np.repeat(share[:, k], lengths), len(model.emit)) for k in range(s)], axis=1)
    return np.concatenate([share.sum(axis=0), np.zeros(s * s), emit.ravel()]), float((top + np.log(total)).sum())


def forward(model: Model, lines: list[np.ndarray]) -> np.ndarray:
    """Natural log likelihoods of whole lines, each step over all lines that reach it."""
    lengths = np.array([len(x) for x in lines])
    order = np.argsort(-lengths, kind="stable")
    flat = np.concatenate([lines[i] for i in order]).astype(np.int64)
    lengths = lengths[order]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    got = np.zeros(len(lines))
    alpha = model.start * model.emit[flat[starts]]
    ends = np.searchsorted(-lengths, -np.arange(int(lengths[0]) + 1), side="left")
    m = len(lines)
    for t in range(1, int(lengths[0])):
        alive = int(ends[t])
        if alive < m or t % 16 == 0:
            c = alpha.sum(axis=1)
            got[:m] += np.log(c)
            alpha = (alpha / c[:, None])[:alive]
            m = alive
        alpha = (alpha @ model.move) * model.emit[flat[starts[:m] + t]]
    got[:m] += np.log(alpha.sum(axis=1))
    out = np.empty(len(lines))
    out[order] = got
    return out


def _lines(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint16) for x in column]


def _learn(shared, counts_of):
    """A partition's sums: the log likelihood at row -1, then starts, moves and each symbol that it holds."""

    def each(batches):
        model, total, log, lines, held = shared.value, 0.0, 0.0, [], 0

        def add():
            got, more = counts_of(model, lines)
            return total + got, log + more

        for batch in batches:
            for line in _lines(batch.column(0)):
                lines.append(line)
                held += len(line)
                if held > HELD:
                    total, log = add()
                    lines, held = [], 0
        if lines:
            total, log = add()
        if isinstance(total, np.ndarray):
            rows = np.concatenate([np.full((1, STATES), log / STATES), total.reshape(-1, STATES)])
            some = np.flatnonzero(rows.any(axis=1))
            for a in range(0, len(some), 10_000):
                i = some[a : a + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array((i - 1).astype(np.int32)), *(pa.array(np.ascontiguousarray(rows[i, k])) for k in range(STATES))], ["i", *_COLUMNS])

    return each


def _score(shared):
    def each(batches):
        model = shared.value
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forward(model, _lines(batch.column(1))) / math.log(10))], ["row", "symbol_score"])

    return each


def _first_guess(unigram: np.ndarray) -> Model:
    """Sticky states whose emissions are the symbols' shares with noise."""
    s, rng = STATES, np.random.default_rng(7)
    emit = unigram[:, None] * rng.uniform(0.7, 1.3, (len(unigram), s))
    return Model(np.full(s, 1 / s), _sticky(), emit / emit.sum(axis=0))


def _sticky() -> np.ndarray:
    return np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)


def train(encoded: DataFrame, unigram: np.ndarray) -> Model:
    """Whole texts in one state, then Baum-Welch: either over all rows not held out, until the likelihood settles."""
    spark = encoded.sparkSession
    mine = encoded.where(~F.col("held"))
    tokens = mine.agg(F.sum("n_tokens")).first()[0]
    if not tokens:
        s = STATES
        return Model(np.full(s, 1 / s), np.full((s, s), 1 / s), np.repeat(unigram[:, None], s, axis=1))
    # few tasks, as each hands on sums of the model's size; two a core at least
    lines = mine.select("symbols").coalesce(max(2 * spark.sparkContext.defaultParallelism, tokens // TASK_TOKENS))
    model = _first_guess(unigram)
    for counts_of in (_whole, _expected):
        before = -math.inf
        while True:
            shared = spark.sparkContext.broadcast(model)
            schema = ", ".join(["i int", *(f"{c} double" for c in _COLUMNS)])
            sums = lines.mapInArrow(_learn(shared, counts_of), schema).groupBy("i").agg(*[F.sum(c).alias(c) for c in _COLUMNS]).toArrow()
            rows = np.zeros((2 + STATES + len(unigram), STATES))
            rows[sums["i"].to_numpy() + 1] = np.stack([sums[c].to_numpy() for c in _COLUMNS], axis=1)
            shared.unpersist()
            log = float(rows[0].sum()) / tokens
            model = Model.of(rows[1:].ravel(), unigram)
            if counts_of is _whole:
                model.move = _sticky()
            if log - before < TOLERANCE:
                break
            before = log
    return model


def score(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed unigram) and score (log10 of the model's probability).

    ``held`` marks the rows that nothing is learned from.
    """
    spark = docs.sparkSession
    small_batches(spark, 2000)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    counted = source.where(~F.col("held")).select("text").mapInArrow(_count, "h long, k int, n long")
    words = staged(counted.groupBy("h").agg(F.min("k").alias("k"), F.sum("n").alias("n")), "words")
    texts = source.where(~F.col("held")).count()
    whole = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = whole["n"] + texts, whole["v"] + (texts > 0)
    floor = tokens + ALPHA * (distinct + 1)
    base_of = lambda c: np.log10((c + ALPHA) / floor)
    top = words.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, k, n = (top[c].to_numpy() for c in ("h", "k", "n"))
    vocabulary = min(MOST, max(VOCABULARY, int((n >= OWN).sum())))
    symbol = np.where(np.arange(len(h)) < vocabulary, np.arange(len(h)), -1)
    # what falls into each class: all words but those with symbols of their own
    sums = words.groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow()
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    class_n[sums["k"].to_numpy()], class_v[sums["k"].to_numpy()] = sums["n"].to_numpy(), sums["v"].to_numpy()
    own = symbol >= 0
    class_n -= np.bincount(k[own], n[own], CLASSES)
    class_v -= np.bincount(k[own], minlength=CLASSES)
    class_floor = class_n + ALPHA * (class_v + 1)
    inside = np.where(own, 0.0, np.log10((n + ALPHA) / class_floor[k]))
    shared = spark.sparkContext.broadcast(Codes(h.view(np.uint64), symbol, base_of(n), inside, vocabulary))
    schema = f"id {type_of(docs, id_col)}, held boolean, n_tokens long, n_known long, base double, inside double, symbols binary, rare array<long>, times array<int>, kinds array<int>"
    encoded = staged(source.mapInArrow(_encode(shared), schema).withColumn("row", F.monotonically_increasing_id()), "encoded")
    unigram = np.zeros(vocabulary + CLASSES + 1)
    unigram[: own.sum()] = n[own]
    unigram[vocabulary : vocabulary + CLASSES] = class_n
    unigram[-1] = texts
    unigram = (unigram + ALPHA) / (unigram + ALPHA).sum()
    model = spark.sparkContext.broadcast(train(encoded, unigram))
    scored = encoded.select("row", "symbols").mapInArrow(_score(model), "row long, symbol_score double")
    # rare words meet their counts
    rare = encoded.select("row", F.explode(F.arrays_zip("rare", "times", "kinds")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"), F.col("x.kinds").alias("kind"))
    c = F.coalesce("n", F.lit(0))
    floors = F.array(*[F.lit(float(x)) for x in class_floor])
    met = rare.join(words.select("h", "n"), "h", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((c + ALPHA) / F.lit(floor))).alias("more_base"),
        F.sum(F.col("times") * F.log10((c + ALPHA) / F.get(floors, F.col("kind")))).alias("more_inside"),
    )
    out = encoded.select("row", "id", "held", "n_tokens", "n_known", "base", "inside").join(scored, "row").join(met, "row", "left")
    extra = lambda name: F.coalesce(name, F.lit(0))
    return out.select(
        F.col("id").alias(id_col),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("n_known") + extra("more_known") + F.lit(int(texts > 0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + extra("more_base") + F.lit(float(base_of(np.float64(texts))))).alias("base_score"),
        (F.col("symbol_score") + F.col("inside") + extra("more_inside")).alias("score"),
    )
