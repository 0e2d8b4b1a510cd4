"""Code descriptions: precedence between files, and lookup with a fallback source."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimspark.functions.text import clean_text, normalize_procedure_code
from claimspark.operators.joins import salted_join


def description_map(entries: DataFrame, precedence: str = "newest") -> DataFrame:
    """``code, description`` from read entries.

    ``entries`` has ``code, description, file_rank, entry_rank, row_rank``; rank 1 is the newest file.
    Inside a file the last row of a code wins. Between files the newest wins, or the oldest on request.
    """
    if precedence not in ("newest", "oldest"):
        raise ValueError("precedence must be 'newest' or 'oldest'")
    file_order = -F.col("file_rank") if precedence == "newest" else F.col("file_rank")
    rows = entries.select(
        normalize_procedure_code(F.col("code")).alias("code"),
        clean_text(F.col("description")).alias("description"),
        F.struct(file_order.alias("file"), F.col("entry_rank"), F.col("row_rank")).alias("place"),
    ).dropna(subset=["code", "description"])
    return rows.groupBy("code").agg(F.max_by("description", "place").alias("description"))


def attach_descriptions(
    df: DataFrame, first: DataFrame, second: DataFrame, code: str = "procedure_code", spread_by: list[str] | None = None,
    spread: int | None = None,
) -> DataFrame:
    """Add ``description`` from the first map, else from the second, else NULL.

    ``spread_by`` names columns that tell rows of one code apart; all columns by default. ``spread=1`` is a
    plain join, for a ``df`` that is not larger than the maps.
    """
    looked_up = df.withColumn("_code", normalize_procedure_code(F.col(code)))
    for name, source in (("_first", first), ("_second", second)):
        lookup = source.select(F.col("code").alias("_code"), F.col("description").alias(name))
        looked_up = salted_join(looked_up, lookup, ["_code"], by=spread_by or df.columns, how="left", spread=spread)
    return looked_up.withColumn("description", F.coalesce("_first", "_second")).drop("_code", "_first", "_second")


def long_description(spark_code: str, first: DataFrame, second: DataFrame) -> DataFrame:
    """The description of one code as a one-row table."""
    one = first.sparkSession.range(1).select(F.lit(spark_code).alias("procedure_code"))
    return attach_descriptions(one, first, second, spread=1)
