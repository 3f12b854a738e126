"""Language identification by a word-first backoff model.

A known word scores its smoothed log frequency in each language. An unseen word backs off to its character n-grams,
the longest known ones first and shorter ones where those are unknown too. Texts sum over all their words.

The model is fitted on a bounded sample of the labelled rows (``sample`` rows of each language, picked by a hash of
the id) and holds at most ``max_words`` words and ``max_grams`` n-grams a language; both bounds are parameters.
Every language is learned.

Defined results: a text that is null or has no letter gets ``und`` and score 0; without any labelled row every text
does; of equal scores the language first by name wins. A very long text is read whole, its words counted first.
Repeated rows are judged one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import schema_of, small_batches, whole_row

UNKNOWN = "und"
LONGEST = 4  # characters of an n-gram, word edges included
CACHED = 50_000  # unseen words that a worker remembers
#: Blocks of marks that combine with letters.
_MARKS = r"\u0300-\u036f\u0591-\u05bd\u05bf-\u05c7\u0610-\u061a\u064b-\u065f\u0900-\u0903\u093a-\u094f\u0e31-\u0e4e"
_RUNS = re.compile(rf"[^\W\d_]+(?:[{_MARKS}]+[^\W\d_]*)*")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters with the marks on them; a run of other numerals alone is none."""
    return [w for w in _RUNS.findall((text or "").lower()) if w[0].isalpha() or any(map(str.isalpha, w))]


def grams(word: str, n: int) -> list[str]:
    edged = f" {word} "
    return [edged[i : i + n] for i in range(len(edged) - n + 1)]


class Model:
    """Log frequencies in each language: a matrix row for each known word, n-grams by length beside it."""

    def __init__(self, langs: list[str], words: list[str], word_logs: np.ndarray, by_length: list[dict[str, np.ndarray]]) -> None:
        self.langs, self.by_length = langs, by_length
        self.known = {w: i for i, w in enumerate(words)}
        self.n_known = len(words)
        self.logs = word_logs

    def backoff(self, word: str) -> np.ndarray:
        """Mean log frequency of the word's longest known n-grams; an unknown one gives way to the shorter ones inside it."""
        total, n = np.zeros(len(self.langs)), 0
        todo = grams(word, min(LONGEST, len(word) + 2))
        while todo:
            shorter: list[str] = []
            for g in dict.fromkeys(todo):
                logs = self.by_length[len(g)].get(g)
                if logs is not None:
                    total += logs
                    n += 1
                elif len(g) > 1:
                    shorter += (g[:-1], g[1:])
            todo = shorter
        return total / max(n, 1)

    def rows(self, words: list[str]) -> list[int]:
        """Matrix rows of the words; those of unseen words are worked out once and remembered."""
        if len(self.known) + len(words) > self.n_known + CACHED:
            self.known = {w: i for w, i in self.known.items() if i < self.n_known}
        if len(self.logs) < self.n_known + CACHED + len(words):
            grown = np.zeros((self.n_known + CACHED + len(words), len(self.langs)))
            grown[: len(self.logs)] = self.logs
            self.logs = grown
        found = list(map(self.known.get, words))
        for k, row in enumerate(found):
            if row is None:
                row = len(self.known)
                self.logs[row] = self.backoff(words[k])
                self.known[words[k]] = found[k] = row
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(words_of(text))
        if not counts or not self.langs:
            return UNKNOWN, 0.0
        n = np.fromiter(counts.values(), np.float64, len(counts))
        rows = self.rows(list(counts))  # may replace the matrix
        scores = n @ self.logs[rows]
        best = int(scores.argmax())
        # tempered by the root of the length: the words of a text aren't independent
        shares = np.exp((scores - scores[best]) / np.sqrt(n.sum()))
        return self.langs[best], float(1.0 / shares.sum())


def _logs(tables: list[Counter], keep: list[str]) -> np.ndarray:
    got = np.array([[t[w] for t in tables] for w in keep], np.float64).reshape(len(keep), len(tables)) + 0.5
    return np.log(got / (np.array([t.total() for t in tables]) + 0.5 * (len(keep) + 1)))


def _build(langs: list[str], tables: list[Counter], max_grams: int) -> Model:
    words = sorted(set().union(*tables))
    by_length: list[dict[str, np.ndarray]] = [{}]
    for n in range(1, LONGEST + 1):
        counted = []
        for t in tables:
            c: Counter = Counter()
            for w, k in t.items():
                for g in grams(w, n):
                    c[g] += k
            counted.append(Counter(dict(c.most_common(max_grams))))
        keep = sorted(set().union(*counted))
        by_length.append(dict(zip(keep, _logs(counted, keep), strict=True)))
    return Model(langs, words, _logs(tables, words), by_length)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 2000, max_words: int = 30_000, max_grams: int = 20_000) -> Model:
    """Fit on the rows of docs with a language: about ``sample`` texts of each, chosen by a hash of the id."""
    small_batches(docs.sparkSession)
    labelled = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    sizes = {r["lang"]: r["n"] for r in sizes.collect()}
    langs = sorted(sizes)
    if not langs:
        return _build([], [], max_grams)
    drawn, span = F.pmod(F.xxhash64("id"), F.lit(1 << 30)), 1 << 30
    drawn_rows = labelled.where(F.coalesce(*[F.when(F.col("lang") == g, drawn < int(span * min(1.0, sample / n))) for g, n in sizes.items()], F.lit(False)))

    def counted(batches):
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(words_of(text))
        for lang, words in found.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(words), pa.string()), "word": pa.array(list(words), pa.string()), "n": pa.array(list(words.values()), pa.int64())})

    totals = drawn_rows.select("lang", "text").mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # the most frequent words of each language: Spark keeps no more of a group than the limit asks for, on either side of the shuffle
    ranked = totals.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.desc("word"))))
    tables = {g: Counter() for g in langs}
    for r in ranked.where(F.col("rank") <= max_words).select("lang", "word", "n").toLocalIterator():
        tables[r["lang"]][r["word"]] = r["n"]
    return _build(langs, [tables[g] for g in langs], max_grams)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row a document: id, lang_pred, score (0 to 1), and with ``carry`` the whole row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def each(batches):
        model = shared.value
        for batch in batches:
            got = [model.predict(t) for t in batch.column(1).to_pylist()]
            more = [batch.column(2)] if carry else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g for g, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64()), *more], [*schema.names])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([whole_row(docs)] if carry else []))
    schema = schema_of(id=docs.schema[id_col].dataType, lang_pred="string", score="double", **({"row": docs.schema} if carry else {}))
    return source.mapInArrow(each, schema).withColumnRenamed("id", id_col)
