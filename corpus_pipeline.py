"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read back as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrace.llm import bpe, mixing, private, quality, simhash
from terrace.llm.common import scratch, table


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document that came this far."""
    return bpe.round_trip(docs)


#: Quality rules drop what they reject, one document of each group of near copies
#: stays, personal data is replaced, the mix repeats or leaves out documents, and
#: the texts are encoded.
STAGES = [
    ("quality rules", quality.stage),
    ("near-duplicates", simhash.stage),
    ("personal data", private.stage),
    ("mixing", mixing.stage),
    ("encoding", encode),
]

#: Learned rules, linked components and BPE can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(path := scratch(spark, f"stage-{i}"))
            docs = spark.read.parquet(path)
    return docs
