"""The corpus pipeline: toxic documents go, frequent lines go, one of each group of near-duplicates stays, contaminated
documents go, and what is left is encoded.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept. The first four return the columns
of documents; the last adds ``ids`` (unsigned 32-bit little-endian, begin and end ids included), ``n_tokens`` and ``decoded``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import decontaminate, linededup, pieces, simhash, toxicity
from marketloom.llm.common import stage
from marketloom.llm.queries import piece_vocabulary, table

#: Size of the Arrow batches between executor and Python worker. The stages share one session, and what a large batch needs
#: outside the heap stays with an executor from stage to stage.
ARROW_BYTES = "4m"


def small_batches(step: Callable) -> Callable:
    """The stage in a session whose Arrow batches hold ``ARROW_BYTES``; a longer text is a batch of its own."""

    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
        return step(spark, docs, sf_dir)

    return run_step


@small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the classifier learns from all labelled documents of the input."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@small_batches
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that ten or more of them share."""
    return linededup.drop_frequent_lines(docs)


@small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of linked fingerprints."""
    return simhash.keep_one(docs)


@small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lie in passages of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their ids and the text that these decode to."""
    encoded = pieces.encode_documents(docs, piece_vocabulary())
    return encoded.withColumn("n_tokens", F.expr("octet_length(ids) div 4"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: The classifier, the fingerprints' components and the tokenizer have no SQL form; tests hold the run to a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents below ``sf_dir``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
