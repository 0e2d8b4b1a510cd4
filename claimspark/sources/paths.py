"""Paths on any file system Spark can read, and streams on them inside tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def base_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def _hadoop(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, jvm_path = _hadoop(spark, path)
    return fs.exists(jvm_path)


def replace_dir(spark: SparkSession, staged: str, target: str) -> None:
    """Put a finished staging folder in place of ``target``; the old one goes only after that."""
    fs, target_path = _hadoop(spark, target)
    old = spark._jvm.org.apache.hadoop.fs.Path(staged + "-replaced")
    had_old = fs.exists(target_path)
    if had_old and not fs.rename(target_path, old):
        raise OSError(f"Cannot set aside {target}")
    fs.mkdirs(target_path.getParent())
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(staged), target_path):
        if had_old:
            fs.rename(old, target_path)
        raise OSError(f"Cannot move {staged} to {target}")
    if had_old:
        fs.delete(old, True)


def drop_dir(spark: SparkSession, path: str) -> None:
    fs, jvm_path = _hadoop(spark, path)
    fs.delete(jvm_path, True)


# Schemes of Spark whose stores Arrow knows under another name.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "viewfs": "viewfs", "wasb": "abfs", "wasbs": "abfss"}


def file_system(path: str):
    """Arrow file system and path for use inside a task. Stores that only Hadoop knows go through libhdfs."""
    from pyarrow import fs

    scheme, _, rest = path.partition("://")
    if rest and scheme in ARROW_SCHEMES:
        path = f"{ARROW_SCHEMES[scheme]}://{rest}"

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def one_task_each(rows: DataFrame, *order: str) -> DataFrame:
    """Each row of a small table to a task of its own; a fixed number of tasks is not merged by adaptive execution."""
    count = max(1, rows.count())
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1
    placed = rows.withColumn("_place", place)
    return placed.repartitionById(count, F.col("_place")).drop("_place")


def open_stream(path: str):
    """Seekable byte stream; reads blocks on demand."""
    system, inner = file_system(path)
    return system.open_input_file(inner)
