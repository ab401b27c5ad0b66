"""The corpus pipeline: quality rules, near-duplicates, secrets, source mix, and sampled pieces.

Each stage takes all that its predecessor kept, written as Parquet and read again, and returns the columns
of ``documents``; the last returns the ids of every document of the mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import mixing, piece_sampling, quality_rules, secret_scan, simhash
from opinara.llm.common import delete, released, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.filter_quality(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class, whatever its id: the one with the least id."""
    return simhash.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by its kind."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.mixed(docs)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_pieces``, ``ids`` and ``lossless`` of every document of the mix."""
    return piece_sampling.encode_sampled(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", drop_low_quality),
    ("simhash", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("piece_sampling", sample_pieces),
]

#: The mix and the sampled pieces have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        with released(spark):  # what a stage writes on the way, once its result is written
            after = stage(spark, docs, sf_dir)
            after.write.parquet(path)
        docs = spark.read.schema(after.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
