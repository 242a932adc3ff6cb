"""Exact deduplication by content-defined chunk recipes (DataFrame and SQL functions only).

A text is cut where its content says so (a sentence or line end after a minimum
length), so equal passages give equal chunks wherever they stand. Chunks are
deduplicated to identifiers: a 64-bit hash, verified by grouping on hash and
content, with an ordinal for contents that share a hash. A document is then the
ordered list of its identifiers, and documents are compared by those short lists;
the text itself moves at most once, in the verification, after equal chunks have
been merged on the map side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, load, text_or_empty

LEAST = -(2**63)


def chunks(text: Column, least: int = 512, most: int = 4096) -> Column:
    """Pieces of text in order: each ends at the first line or sentence end after least characters, or after most."""
    pattern = rf"(?s).{{{least},{most - 2}}}?(?:\n|[.!?]\s)|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def exact_duplicates(
    docs: DataFrame,
    chunk_hash: Callable[[Column], Column] = F.xxhash64,
    least: int = 512,
    most: int = 4096,
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Rows with identical texts form a group; keep_id is its largest doc_id and one row is kept.

    - null text counts as empty; all empty texts are one group;
    - of repeated rows with the group's largest doc_id exactly one is kept;
    - null ids rank below all others; a group of null ids keeps one row, keep_id null;
    - an empty table gives an empty result; other columns of docs are not looked at;
    - chunk_hash may collide: contents with one hash get distinct identifiers.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col("doc_id"), text_or_empty().alias("text"))
    cut = chunks(F.col("text"), least, most)
    light = scratch.table(
        rows.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.sha2("text", 256).alias("text_sha256"),
            F.transform(cut, lambda c: chunk_hash(c)).alias("recipe"),
        ),
        "recipes",
    )
    pieces = rows.select(F.explode(cut).alias("chunk")).select(chunk_hash(F.col("chunk")).alias("hash"), "chunk")
    contents = pieces.groupBy("hash", "chunk").count()
    shared = contents.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    shared = scratch.table(shared, "shared_hashes")
    if shared.isEmpty():
        recipes = light
    else:
        recipes = _resolved(scratch, rows, cut, chunk_hash, contents, shared)
    groups = scratch.table(
        recipes.groupBy("recipe").agg(
            F.max("doc_id").alias("keep_id"),
            F.max_by("row", F.coalesce("doc_id", F.lit(LEAST))).alias("keep_row"),
            F.count("*").alias("group_size"),
        ),
        "groups",
    )
    return recipes.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )


def _resolved(scratch, rows, cut, chunk_hash, contents, shared) -> DataFrame:
    """Recipes in which contents that share a hash carry their ordinal among those as well."""
    ordinals = contents.join(shared, "hash", "left_semi").select(
        "hash", "chunk", F.row_number().over(W.partitionBy("hash").orderBy("chunk")).alias("ordinal")
    )
    numbered = scratch.table(
        rows.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("text", 256).alias("text_sha256"), cut.alias("cut")
        ),
        "numbered",
    )
    placed = numbered.select("row", F.posexplode("cut").alias("at", "chunk")).withColumn("hash", chunk_hash(F.col("chunk")))
    ids = (
        placed.join(ordinals, ["hash", "chunk"], "left")
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("at", "hash", F.coalesce("ordinal", F.lit(0)).alias("ordinal")))).alias("ids"))
    )
    recipe = F.coalesce(
        F.flatten(F.transform("ids", lambda x: F.array(x["hash"].cast("bigint"), x["ordinal"].cast("bigint")))),
        F.array().cast("array<bigint>"),
    )
    return scratch.table(numbered.join(ids, "row", "left").select("row", "doc_id", "text_sha256", recipe.alias("recipe")), "resolved")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(load(spark, sf_dir, "documents"))


OP3_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
