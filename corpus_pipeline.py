"""A training corpus from raw documents: quality rules, language ID, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs. All but the last return docs' own columns and
rows, less those it rejects; the last returns pieces placed in batches. Rows are judged one by one, never by their id:
a null id, or one that several rows share, takes no other row along. Null, blank and very long texts, ties and further
columns are as the operators define them; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontaminate, language_id, near_dedup, packing, quality_rules
from cairn.llm._shared import staged, whole_row

ORACLE_SQL = None

#: Least posterior of the best language.
LEAST_SCORE = 0.5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that keep the quality rules; a null or blank text goes. The verdict comes beside the row, without a join."""
    return quality_rules.quality_rules(docs, carry=True).where("kept").select("row.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with letters whose language is plain, by a model learned from the rows with a language; null texts go."""
    found = language_id.predict(docs, language_id.fit(docs), carry=True)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id (nulls last), of one id the one of the smallest hash.

    Rows are nodes by a number of their own. Null and blank texts link with nothing and stay.
    """
    numbered = staged(docs.select(whole_row(docs), F.monotonically_increasing_id().alias("at")), "numbered")
    found = near_dedup.near_duplicates(numbered, id_col="at", text_col="row.text")
    several = staged(found.where("n_shingles > 0").select("at", "component_id"), "groups")
    of_rows = numbered.select("at", F.struct(F.col("row.doc_id").isNull(), "row.doc_id", F.xxhash64("row"), "at").alias("rank"))
    first = several.join(of_rows, "at").groupBy("component_id").agg(F.min_by("at", "rank").alias("at"))
    # written first, so that its size tells whether it can go to every task
    rejected = staged(several.join(first, "at", "left_anti").select("at"), "rejected")
    return numbered.join(rejected, "at", "left_anti").select("row.*")


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without any window of a benchmark item; null and blank texts stay."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=True)
    return found.where("n_items = 0").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in batches of optimal length buckets; a null or blank text is its end alone."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", good_quality),
    ("language_id", known_language),
    ("near_dedup", one_of_near_copies),
    ("decontaminate", not_in_benchmark),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
