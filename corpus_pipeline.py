"""From raw documents to token ids: toxic texts out, repeated lines out, one document of each group of near-duplicates,
benchmark passages out, byte-level BPE.

Every stage takes (spark, docs, folder of the tables) and returns a DataFrame; ``run`` writes each result as Parquet and
hands the reread table to the next stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm.base import prepare, table, written
from flowspark.llm.bpe import encode_documents
from flowspark.llm.decontaminate import drop_contaminated
from flowspark.llm.line_dedup import dedup_lines
from flowspark.llm.near_dedup import near_duplicates
from flowspark.llm.toxicity import drop_toxic, fit


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the classifier learns from labelled documents of the input."""
    return drop_toxic(docs, fit(prepare(docs, "doc_id", "text"), table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document or line holds."""
    return dedup_lines(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class at a similarity of 0.8: the smallest id.  Rows that repeat an id stay or go together."""
    gone = near_duplicates(docs, percent=80).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")


def drop_benchmark_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the text decoded from them."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic_documents),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark_documents),
    ("bpe", encode),
]

# SQL states neither the classifier nor MinHash, templates and BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
