"""From raw documents to token ids: toxicity, exact copies, near copies, benchmark leaks, encoding.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last keep the
columns of documents. Stages are written as Parquet and read again, so that none is computed
twice and lost executors cost one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rastermill.llm import decontaminate, pieces, stages, toxicity
from rastermill.llm.common import saved, table


#: Rows, mostly whole texts, that a task hands to Python at once. With Spark's 10,000 a batch is a whole split, which
#: stands in the executor's native memory and in the worker's for each of its tasks.
ROWS = 1000


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.7 or more by the labelled examples among them. Sets the session's Arrow batches to ROWS."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.keep_exact(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.keep_near(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold half or more of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: Signatures, nearest examples, tiling and piece encoding have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
