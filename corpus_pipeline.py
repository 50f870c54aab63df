"""A corpus from raw documents to packed sequences: quality rules, line dedup, near-duplicates, mixing, packing.

Every stage but the last returns the columns of what it gets, whatever else they are named; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm import linededup, mixing, neardup, packing, quality
from routeloom.llm.common import new_folder, table, vocabulary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; null and empty texts don't, repeated rows pass alike."""
    return quality.keep_good(docs, vocabulary("piece_bpe_32k.model"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occur before; those of which no word is left go. n_chars follows the text."""
    rows = linededup.dedup_lines(docs).where("n_removed_lines = 0 or text <> ''").select(docs.columns)
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else rows


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, its smallest doc_id; documents without doc_id or words stay."""
    return neardup.keep_firsts(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of domains asks for; those likeliest of good quality at least once."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset; null and empty texts are a piece of their end id."""
    return packing.best_fit(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", good_quality),
    ("line dedup", without_repeated_lines),
    ("near duplicates", without_near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

#: Tokenizers and iterative fits have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
