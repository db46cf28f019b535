"""The corpus pipeline: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. A stage begins by having driver and executors give
back the memory of the one before, which would add to its own.

Defined cases: columns of any other name are kept as they are. Each row is judged by its
own text, so rows that share a doc_id or have none are told apart; equal rows are near
copies, of which one stays. A null text counts as empty where it is judged and stays
null; null, empty and blank texts are near copies of each other, and the classifier
scores them like any other. Without labels of both kinds, or without benchmark items,
nothing is rejected. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelmill.llm import bpe, decontaminate, near_copies, pii, quality
from pixelmill.llm.common import cut, sweep, tidy, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking accepts; it learns from the labels of those given."""
    tidy(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.fit(docs, labels))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard of 5-word shingles from 0.8, by SimHash and a prefix filter): the one with the smallest doc_id."""
    tidy(spark)
    return near_copies.one_of_each(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule doesn't reject."""
    tidy(spark)
    return decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data; n_chars follows the text."""
    tidy(spark)
    return pii.private(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text that they decode to, as digests."""
    tidy(spark)
    return bpe.encode_decode(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", one_of_each),
    ("benchmark decontamination", clean_of_benchmark),
    ("pii", without_personal_data),
    ("bpe encoding and decoding", tokens),
]

#: Ranking, fingerprints and byte pairs can't be stated in SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; what a stage leaves there is deleted once the next one's input stands."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        sweep(spark, before, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
