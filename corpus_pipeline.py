"""A training corpus from the documents table: five stages, each a function (spark, docs, sf_dir) -> DataFrame.

Every stage gets all rows that the one before kept, as a Parquet table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import bytecnn, decontam, packing, resemblance, secrets
from lintlake.llm.common import materialize, table

QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject: each row is scored by its own text.

    Null and empty texts get the score of no bytes. Repeated rows are scored alike. Without labels of both kinds nothing is rejected. An empty table gives an empty one.
    """
    model = bytecnn.train(docs, table(spark, sf_dir, "labels"))
    return bytecnn.score(docs, model).filter(F.col("score") >= QUALITY).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id.

    Rows are told apart by id and text: rows that share an id, or have none, count each for itself, and of equal rows one stays. Null and
    empty texts are one group. An empty table gives an empty one.
    """
    return resemblance.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark passage, each judged by its own text: ids may be null or repeated. Null and empty texts stay."""
    return decontam.without_passages(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets replaced by a mask and n_chars set anew (null for a null text). Null and empty texts stay as they are; ids play no part."""
    forest = secrets.Forest.fit(secrets.default_findings(spark))
    masked = secrets.redact(docs, forest, path_col="source")
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A batch and slot for every row: null and empty texts have one token, rows of one id or none are each placed. An empty table gives an empty one."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", mask_secrets), ("packing", pack)]
#: SQL can't express the classifier, the fingerprints or the forest.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
