"""The corpus pipeline: quality filter, passage dedup, near-duplicate documents, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and hands it to
the next stage. All stages but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, line_dedup, mixing, quality, simhash
from tidewatch.llm.queries import table, vocabulary_path
from tidewatch.session import materialise

LEAST_QUALITY = 0.3


def reject_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below ``LEAST_QUALITY`` go. The model is fitted on all of ``docs``."""
    rows = quality.stored_features(docs.select("doc_id", "text"))
    model = quality.learn(rows, table(spark, sf_dir, "labels"), quality.learning_rows(5, 0))
    return docs.filter(quality.score(model) >= LEAST_QUALITY)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three lines that repeat are cut; documents that lose every line go."""
    cleaned = line_dedup.without_repeats(docs)
    return cleaned.filter("n_removed < n_lines").select(
        *[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id.

    Fingerprints that meet in the middle link documents first; of what they leave, documents with similar sets of
    shingles are found, which may be further apart than a few bits.
    """
    return simhash.keep_one(simhash.first_of_components(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; what is taken 0 times goes."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and the digests of ids and decoded text."""
    return bpe.digests(docs, vocabulary_path(), ids="ids")


STAGES = [
    ("quality classifier", reject_bad),
    ("passage dedup", remove_repeats),
    ("near-duplicate documents", keep_one_of_each),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Fitting a classifier and drawing a mix are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
