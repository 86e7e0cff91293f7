"""The corpus pipeline: documents through five of the training-data operators.

Quality rules drop documents; line dedup drops lines that ten documents share
and keeps every document; of each group of near copies the document with the
least id stays; documents contaminated by the benchmark go; the rest is packed.
Each stage's result is written to the shared folder and read by the next.

Every stage takes the columns of documents, in any order and with others among
them, which go; a column named like one that an operator makes is such another.
Nulls may be in any column: a null text fails the quality rules, is one empty
line that stays, is a copy of the other texts without words, is in no benchmark
item and packs as its end token alone; a null doc_id is a document of its own
and comes after all others as the least of a group.  Very long texts are taken
whole.  Repeated rows each count as documents, but one of a group of copies
stays.  An empty table goes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm import decontaminate, lines, near, packing, quality
from passagemill.llm.common import shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.judge(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten of them or more share."""
    cleaned = lines.dedup_lines(docs.select(*COLUMNS))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    judged = decontaminate.judge(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return judged.filter("NOT contaminated").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, in sequences."""
    return packing.pack_pieces(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
