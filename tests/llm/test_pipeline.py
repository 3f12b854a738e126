"""The corpus pipeline, stage by stage, against plain versions of its decisions; and the queries with SQL equals."""

import glob
import re

import duckdb
import pytest

import corpus_pipeline
from cairn.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.staged(stage(spark, docs, SF), "t")
        assert after.columns == columns and after.join(docs, columns[0], "left_anti").count() == 0, name
        assert 0 < after.count() <= docs.count()
        docs = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, SF).count() == pieces.count()


def test_decisions_take_effect(spark):
    item = next(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect())
    good = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and length(text) between 800 and 2000").select("text").limit(6).collect()]
    rows = [(1, good[0], "en", "s", 1), (2, good[0], "en", "s", 1), (3, good[1] + " " + item, "en", "s", 1), (4, "12 34 " * 40, "en", "s", 1), (5, "too short", "en", "s", 1), (6, good[2], None, None, None), (7, None, None, None, None), (8, good[3], "en", "s", 1), (8, good[3], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert 7 not in ids(corpus_pipeline.good_quality(spark, docs, SF)) and 5 not in ids(corpus_pipeline.good_quality(spark, docs, SF))
    assert ids(corpus_pipeline.known_language(spark, docs, SF)) == [1, 2, 3, 5, 6, 8, 8]
    assert ids(corpus_pipeline.one_of_near_copies(spark, docs, SF)) == [1, 3, 4, 5, 6, 7, 8]
    assert 3 not in ids(corpus_pipeline.not_in_benchmark(spark, docs, SF)) and 6 in ids(corpus_pipeline.not_in_benchmark(spark, docs, SF))
    assert ids(corpus_pipeline.packed(spark, docs.limit(0), SF)) == []


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {f.split('/')[-1][:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = queries.queries()[name](spark, SF).select(names)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_stages_on_odd_rows(spark, odd, empty):
    """Nulls, repeated rows and ids, clashing column names and empty tables; a row's fate doesn't hang on its id."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.staged(stage(spark, odd, SF), "t")
        assert after.columns == odd.columns and after.schema.simpleString() == odd.schema.simpleString(), name
        before = [str(tuple(r)) for r in odd.collect()]
        for r in after.collect():
            before.remove(str(tuple(r)))
        none = stage(spark, empty, SF)
        assert none.columns == odd.columns and none.count() == 0, name
    assert corpus_pipeline.packed(spark, odd, SF).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()


def test_rows_stand_alone(spark):
    """Rows that share an id, or have none, are rejected and kept each for itself."""
    english = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and length(text) between 800 and 2000")
    a, b, c = (r["text"] for r in corpus_pipeline.good_quality(spark, english, SF).orderBy("doc_id").limit(3).collect())
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(1, a, "en"), (1, "too short", "en"), (None, b, "en"), (None, "12 34 " * 40, "en"), (None, c + " " + item, "en"), (2, a, "en"), (1, c, "en"), (None, b, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    left = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert left(corpus_pipeline.good_quality(spark, docs, SF)) == sorted(map(str, (r for i, r in enumerate(rows) if i not in (1, 3))))
    assert left(corpus_pipeline.not_in_benchmark(spark, docs, SF)) == sorted(map(str, (r for i, r in enumerate(rows) if i != 4)))
    once = left(corpus_pipeline.one_of_near_copies(spark, docs.repartition(5), SF))
    assert once == left(corpus_pipeline.one_of_near_copies(spark, docs, SF)) and str(rows[5]) not in once and once.count(str(rows[2])) == 1


def test_whole_pipeline_against_plain(spark, tmp_path):
    """End to end over plain versions of near-dedup and decontamination on a small corpus of known rejects."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:2]:
        kept = stage(spark, kept, SF)
    rows = {r["doc_id"]: r["text"] for r in kept.collect()}
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    def shingles(t):
        w = re.findall("[^\x20\x09-\x0d]+", low(t))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, parent = {i: shingles(t) for i, t in rows.items()}, {i: i for i in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(rows)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    first = [i for i in ids if root(i) == i]
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = cut(r["text"])
        n = min(8, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1 if n else 0)}
    clean = [i for i in first if not any(tuple(w[k : k + n]) in windows for w in (cut(rows[i]),) for n in {len(x) for x in windows} for k in range(len(w) - n + 1))]
    got = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg({"n_tokens": "sum"}).collect()
    assert {r["doc_id"]: r[1] for r in got} == {i: len(re.findall("[^\x20\x09-\x0d]+", rows[i])) + 1 for i in clean}
