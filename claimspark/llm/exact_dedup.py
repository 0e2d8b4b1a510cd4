"""Exact duplicates: group by a 128-bit hash of the normalised text, keep the smallest id, compare bytes.

Only hashes and ids are grouped. Texts are moved twice: once to fetch the text of the row that stays in
each group of two or more, once to compare the members with it. Rows whose bytes differ in spite of an
equal hash are grouped again by hash and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimspark.llm.common import SPACES
from claimspark.session import materialise


def normalised(text: Column) -> Column:
    """White-space runs become one space; NULL counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=content_hash) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    A NULL or empty text is the empty text, equal to others of its kind. NULL ids rank after all others: a
    group keeps NULL only if it has no other id. Rows that repeat both id and text are one document: each
    counts in ``group_size`` and they stay or go together. Other columns are ignored. An empty table gives an
    empty result. ``hash_of`` maps the normalised text to the grouping hash (tests pass one that collides).
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    texts = texts.withColumn("hash", hash_of(F.col("norm")))
    groups = texts.groupBy("hash").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("size"))
    several = groups.filter("size > 1").withColumnRenamed("hash", "several_hash")
    # The text that stays in each group of several rows; unique join keys, so no hot key.
    stays = texts.join(several, (F.col("hash") == F.col("several_hash")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    stays = materialise(stays.groupBy("hash", "keep_id", "size").agg(F.min("norm").alias("keep_norm")), "exact-stays")
    same = F.col("keep_norm").isNull() | (F.col("norm") == F.col("keep_norm"))
    compared = texts.join(stays, "hash", "left").select(
        "doc_id", "hash", F.sha2("norm", 256).alias("text_sha256"),
        F.when(F.col("keep_norm").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("size"), same.alias("same"), F.when(~same, F.col("norm")).alias("odd_text"),
    )
    compared = materialise(compared, "exact-compared")
    odd = compared.filter("not same").groupBy("hash", "odd_text").agg(F.min("doc_id").alias("odd_id"), F.count("*").alias("odd_size"))
    odd_rows = odd.groupBy("hash").agg(F.sum("odd_size").alias("odd_rows"))
    regular = compared.filter("same").join(odd_rows, "hash", "left").select(
        "doc_id", "keep_id", (F.col("size") - F.coalesce("odd_rows", F.lit(0))).alias("group_size"), "text_sha256"
    )
    irregular = compared.filter("not same").join(odd, ["hash", "odd_text"]).select(
        "doc_id", F.col("odd_id").alias("keep_id"), F.col("odd_size").alias("group_size"), "text_sha256"
    )
    return regular.unionByName(irregular).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
