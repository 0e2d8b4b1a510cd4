"""Writers that replace a table only once the new one is complete, and count rows while writing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from claimspark.sources.paths import drop_dir, exists, replace_dir


def _staged(target: str) -> str:
    folder, name = target.rstrip("/").rsplit("/", 1)
    return f"{folder}/.{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, target: str, cluster_by: list[str] | None = None, finish: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Parquet table at ``target``; returns the number of rows, counted during the write.

    With ``cluster_by`` every file holds one range of those columns, sorted, so that later point
    filters skip files and row groups by their statistics. ``finish`` makes the table's rows from those in their place, row by
    row, so what it adds is not moved.
    """
    staged, counted = _staged(target), Observation()
    rows = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by) if cluster_by else df
    rows = finish(rows) if finish else rows
    try:
        rows.observe(counted, F.count(F.lit(1)).alias("rows")).write.parquet(staged)
    except Exception:
        drop_dir(df.sparkSession, staged)
        raise
    replace_dir(df.sparkSession, staged, target.rstrip("/"))
    return counted.get["rows"]


def write_csv(df: DataFrame, target: str) -> None:
    """Small report as CSV with a header line."""
    staged = _staged(target)
    df.write.option("header", True).option("emptyValue", "").csv(staged)
    replace_dir(df.sparkSession, staged, target.rstrip("/"))


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """A cached table, or None when it was never written."""
    return spark.read.parquet(path) if exists(spark, path) else None
