"""The corpus pipeline: classify, dedup, decontaminate, mix, shard.

Each stage takes all rows that the one before it kept, written as Parquet and read again; a stage's
folder is deleted when the next one's is written. Texts of any length go through whole, other columns
stay as they are, whatever their names (but ``shard`` and ``slot``, which the last stage replaces), and an
empty table gives an empty table with the same columns. Nulls, empty texts, ties and repeated rows are
taken as each stage's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import delete, fresh_name, fresh_path, read_table
from tesserae.llm.op2_minhash_dedup import near_duplicates
from tesserae.llm.op3_quality_classifier import accepted
from tesserae.llm.op6_decontaminate import clean
from tesserae.llm.op7_shards import shuffled
from tesserae.llm.op9_mix import mix


#: Percent of similarity from which documents are near-duplicates here.
SIMILARITY = 80


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs less the rows whose doc_id is in dropped; rows with a null doc_id stay."""
    name = fresh_name(docs, "__gone")
    gone = dropped.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier predicts 1; empty and null texts are judged like others. Repeated rows get the same verdict."""
    return accepted(docs, read_table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (``SIMILARITY``), the one with the smallest id. Rows that repeat a doc_id are one document and stay together; null ids and texts without words stay."""
    return _without(docs, near_duplicates(docs, SIMILARITY).where("NOT kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that cover no benchmark item; texts without words and null ids stay."""
    return clean(docs, read_table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each take of the mixture: documents may repeat or be cut; texts without words are never taken."""
    return mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows and columns, with shard and slot; columns of these names are replaced."""
    s = shuffled(docs)
    return s.select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in ("shard", "slot")), "shard", "slot")


STAGES = [("quality classifier", quality), ("near-duplicates", dedup), ("decontamination", decontaminate), ("mixture", mixture), ("sharding", sharding)]

#: A trained discriminant can't be told in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result is the last stage's table."""
    docs, last = read_table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        out = fresh_path(spark, f"stage-{i}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if last:
            delete(spark, last)
        last = out
    return docs
