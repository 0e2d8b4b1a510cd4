"""Expressions and small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimspark.session import scratch_path

# White space is the blank and the controls 9 to 13, a word is any other run of characters.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Freed memory of this Python worker goes back to the system; workers are used again by later stages and share the executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def partitions(spark: SparkSession) -> int:
    """Tasks a shuffle is dealt to; a guide for the number of pieces of a hot key, never part of a result."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, name: str, key: str, *order: str, dealt: bool = False, pieces: int = 1) -> DataFrame:
    """``df`` written once in the shared folder, dealt by ``key`` and sorted; joins and groups on ``key`` do not move it again.

    ``dealt`` says that a group-by on ``key`` has dealt the rows already. There are ``pieces`` buckets for each shuffle partition: more where rows are large.
    """
    spark = df.sparkSession
    count, table_name = partitions(spark) * pieces, f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = (df if dealt else df.repartition(count, key)).write.bucketBy(count, key).sortBy(key, *order)
    writer.option("path", scratch_path(spark, name)).saveAsTable(table_name)
    return spark.table(table_name)
