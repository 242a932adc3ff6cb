"""From raw documents to packed training sequences, in five stages.

All stages decide by row: null and repeated ids are rows like any other, columns other than those named are carried along unread, null texts
count as empty, texts are read whole however long, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import exact_dedup, mixing, near_dedup, packing, quality
from tracewright.llm.common import Scratch, load, text_or_empty

ROW = "pipeline_row"
#: Of the tokens that mixing gets, the share it keeps.
MIX_SHARE = 0.5


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a number of its own for each row, written so that it stays the same: ids may be null or repeated."""
    return Scratch(docs.sparkSession).table(docs.withColumn(ROW, F.monotonically_increasing_id()), "keyed")


def first_of_each(rows: DataFrame, groups: DataFrame, order: Column) -> DataFrame:
    """The row of rows, as keyed() gives them, that is the greatest by order in each group; groups: ROW, group."""
    kept = groups.join(rows.select(ROW, "doc_id"), ROW).groupBy("group").agg(F.max_by(ROW, F.struct(order, F.col(ROW))).alias(ROW))
    return rows.join(kept.select(ROW), ROW, "left_semi").drop(ROW)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; equal texts share their fate, an empty text has the score that its features give it."""
    scored = quality.classify(docs, load(spark, sf_dir, "labels"))
    return scored.where("quality_predicted = 1").select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of identical texts: that of the largest id, one without an id where none has one.

    Null and empty texts are one group; of rows with equal text and id one stays.
    """
    rows = keyed(docs)
    groups = exact_dedup.exact_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"))
    return first_of_each(rows, groups.select(F.col("doc_id").alias(ROW), F.col("keep_id").alias("group")), F.col("doc_id")).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id: word 5-shingles, similarity 0.8.

    Rows without an id stay only where none of the group has one; texts without words have no near duplicates, and all stay.
    """
    rows = keyed(docs)
    groups = near_dedup.near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"))
    return first_of_each(rows, groups.select(F.col("doc_id").alias(ROW), F.col("component_id").alias("group")), -F.col("doc_id")).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of MIX_SHARE of the tokens with the target mix of sources, languages and topics.

    Each row is drawn by its text, id, source and language, so rows equal in these share their fate; null sources and languages
    are a value of their own; rows without tokens go unless their cell has some.
    """
    content = F.concat(F.sha2(text_or_empty(), 256), F.to_json(F.struct("doc_id", "source", "lang")))
    sampled = mixing.mix(docs.select(content.alias("doc_id"), "text", "source", "lang"), share=MIX_SHARE).where("sampled")
    rows = docs.withColumn(ROW, content)
    return rows.join(sampled.select(F.col("doc_id").alias(ROW)).distinct(), ROW, "left_semi").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences; an empty text is one piece of the end token, repeated rows are packed as often as they occur."""
    return packing.pack(docs)


STAGES = [("quality", good), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]

ORACLE_SQL = None  # tests/llm/test_pipeline.py has a plain version: learned scores, hashed signatures and tokenizer ids are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs, scratch = load(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
