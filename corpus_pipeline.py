"""A corpus pipeline over ``documents``: each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumivox.llm import decontaminate, line_dedup, pieces, quality, similar
from lumivox.llm.common import table, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts have the score of padding alone; repeated rows go or stay
    alike; no rows give no rows.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of nearly equal lines one stays; n_chars follows the text.

    The line of the smallest doc_id, then of the smallest number stays. Null texts stay
    null, empty ones and lines without words stay as they are, and so do documents
    without an id; rows that repeat a doc_id with its text stay alike; no rows give no rows.
    """
    left = line_dedup.without_repeated_lines(docs)
    kind = dict(docs.dtypes).get("n_chars")
    return left.withColumn("n_chars", F.length("text").cast(kind)) if kind else left


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest doc_id.

    Groups take five-word shingles and a similarity of 0.8; several SimHashes of each text,
    looked up segment by segment, find whom to compare.
    Null and empty texts are one group; rows that repeat a doc_id stay or go together,
    those without an id stay; no rows give no rows.
    """
    return similar.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a segment of a benchmark item go.

    Null and empty texts stay; each row is judged by its own text, so repeated rows go
    or stay alike; without documents or items nothing goes.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that is left, and what they decode to; null and empty texts have none, repeated rows the same."""
    return pieces.encode_and_decode(docs, pieces.model_bytes(), keep=True)


STAGES = [
    ("quality_classifier", quality_filter),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]
#: No stage is expressible in SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
