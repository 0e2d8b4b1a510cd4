"""Many-to-one lookups that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimspark.session import materialise

BROADCAST_ROWS = 50_000  # of a side that is written and counted first


def default_spread(spark: SparkSession) -> int:
    """Pieces of one key: about the square root of the shuffle partitions, so a hot key fills many tasks and the
    repeated side stays small."""
    return max(4, math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))))


def salted_join(
    left: DataFrame, right: DataFrame, on: list[str], by: list[str], how: str = "inner", spread: int | None = None
) -> DataFrame:
    """Equi-join with every left key split over ``spread`` salts and the right side repeated per salt.

    ``by`` names left columns that differ inside a key; the salt is a hash of them, so a repeated task
    sends its rows to the same place. Meant for a right side that is far smaller than the left one (a
    dimension, a histogram, totals per code). No size is assumed: adaptive execution broadcasts the
    right side only when its measured size allows, and otherwise the salts keep a hot key from landing
    in one task. ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``.
    """
    spread = spread or default_spread(left.sparkSession)
    salt = "_salt"
    split = left.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(spread)).cast("int"))
    repeated = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return split.join(repeated, [*on, salt], how).drop(salt)


def measured_join(left: DataFrame, right: DataFrame, on: list[str], by: list[str], how: str = "inner", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``salted_join`` with a right side that is written and counted first, for lookups into results that are mostly tiny.

    With at most ``broadcast_rows`` rows it goes to every task, so the left side is not shuffled at all and keeps its partitioning. Adaptive
    execution alone learns that size only after it has written the left side's shuffle.
    """
    known = materialise(right, "lookup")
    if known.count() <= broadcast_rows:
        return left.join(F.broadcast(known), on, how)
    return salted_join(left, known, on, by, how)
