"""The corpus pipeline: documents are judged, near-copies and repeated passages go, secrets are hidden, the rest is packed.

Every stage takes (spark, docs, sf_dir) with docs in the columns of ``documents`` and returns a frame of the same columns,
the last one the pieces of packed sequences. A stage works on all rows that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelattice.llm import neardup, quality, repeats, secrets
from ridelattice.llm.queries import packed_documents
from ridelattice.llm.text import read
from ridelattice.session import cut_lineage


def _messages(docs: DataFrame) -> DataFrame:
    return docs.withColumnsRenamed({"doc_id": "id", "text": "content"})


def _documents(rows: DataFrame) -> DataFrame:
    docs = rows.withColumnsRenamed({"id": "doc_id", "content": "text"})
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table."""
    return _documents(quality.good_messages(_messages(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate group."""
    return _documents(neardup.one_of_each(_messages(docs)))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has."""
    return _documents(repeats.drop_repeats(_messages(docs)))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets masked."""
    return _documents(secrets.hide_secrets(_messages(docs)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packed_documents(_messages(docs))


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("substring dedup", substring_dedup), ("secret scans", secret_scans), ("packing", packing)]

#: SimHash and tokenizer ids cannot be said in SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages make of ``documents``; what each stage keeps is written to the shared checkpoint folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
