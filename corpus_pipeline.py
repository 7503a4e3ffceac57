"""The corpus pipeline: quality rules, near duplicates, repeated passages, personal data, packing.

STAGES lists the stages; run() applies them to documents, each over the written result of the one before.
All but the last return the columns of documents. Part of the subpackage cairn.llm.

Defined cases: a row with a null text has no words and goes in the first stage; repeated rows (equal id and
text) are near duplicates of each other, and one stays; a passage that is removed takes its words
alone, the rest is joined by one space; a document of which nothing is left stays as an empty text;
extra columns are kept up to packing; an empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import jaccard_join, packing, pii, quality, shared, substring_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass operator 9's rules."""
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id (five-word shingles, similarity 0.8)."""
    return jaccard_join.representatives(docs, n=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every word in a 20-word window that starts earlier in the corpus."""
    out = substring_dedup.without_repeats(docs)
    out = out.withColumn("text", F.when(F.col("text").isNotNull(), F.col("__cairn_left")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.without_pii(docs, pii.DEMO_KEY)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("personal data", personal_data),
    ("best-fit packing", best_fit),
]
#: Suffix arrays, keyed permutations and the packing plan have no SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        out = shared.stored(stage(spark, out, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, out, sf_dir)
