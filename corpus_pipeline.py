"""The corpus pipeline: five stages, each from documents to documents.

Defined cases, in every stage: a null or empty text has no words, so the quality rules reject it; a
text of any length is treated whole; of equal rows the near-duplicate stage keeps one, and of rows that
share an id but not the text each is judged for itself; a null id stands after all others; an empty
table stays empty; other columns are kept, whatever their names, but those the last stage adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import decontaminate, mixing, neardup, quality, shared, substrings
from tamis.tables import read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(spark, docs, quality.good_labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.keep_one(spark, docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also stand earlier are cut out."""
    return substrings.remove_repeats(spark, docs, length_col="n_chars")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out."""
    return decontaminate.remove_contamination(spark, docs, read(spark, sf_dir, "benchmark"), length="n_chars")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by calibrated probabilities, with the weight by which each document counts.

    Columns of the input that are named like an added one give way to it."""
    mixed = mixing.mix(spark, docs).where("kept")
    added = {"mix_tokens": "tokens", "mix_topic": "topic", "mix_probability": "probability", "mix_weight": "weight"}
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in added]
    return mixed.select(*own, *[F.col(c).alias(name) for name, c in added.items()])


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_substrings),
    ("benchmark decontamination", benchmark_passages),
    ("mixing sources to target weights", source_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    before = None
    for k, (_, stage) in enumerate(STAGES):
        uri = shared.scratch(spark, f"stage-{k}")
        docs = shared.table(spark, stage(spark, docs, sf_dir), uri)
        if before:
            shared.drop(spark, before)
        before = uri
        shared.release(spark)
    return docs


ORACLE_SQL = None
