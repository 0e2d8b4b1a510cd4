"""Exact ranks and quantiles per group, without sorting a whole group in one task.

Values are first counted per distinct value (map-side combined). Each distinct value then falls
into a bucket that grows with the value, so the count of everything smaller is the count of all
lower buckets plus the smaller values of its own bucket. The first sum runs over bucket totals,
whose number per group is limited by the range of a double; the second runs inside one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

STEPS_PER_DOUBLING = 1024
_EXPONENT_SHIFT = 1100 * STEPS_PER_DOUBLING


def value_bucket(value: Column) -> Column:
    """Bucket number, non-decreasing in ``value``; neighbouring values share a bucket."""
    finite = F.when(F.abs(value) < float("inf"), F.abs(value))
    size = F.coalesce(F.floor(F.log2(finite) * STEPS_PER_DOUBLING) + F.lit(_EXPONENT_SHIFT), F.lit(2**61))
    return F.when(value > 0, size).when(value < 0, -size).when(value == 0, F.lit(0)).cast("long")


def value_counts(df: DataFrame, keys: list[str], value: str, keep_null: bool = False) -> DataFrame:
    """``keys, value, n_equal``: rows per distinct value; NaN counts as NULL.

    NULL is left out, or kept on request as a row that counts nothing.
    """
    if keep_null:
        rows = df.select(*keys, F.when(~F.isnan(value), F.col(value)).alias(value))
    else:
        rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    return rows.groupBy(*keys, value).agg(F.count(value).alias("n_equal"))


def _with_bucket(counts: DataFrame, value: str) -> DataFrame:
    last = F.lit(2**62)
    return counts.withColumn("bucket", F.coalesce(value_bucket(F.col(value)), last))


def _bucket_offsets(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, bucket, n_before, bucket_n, n_total`` from bucketed counts."""
    totals = counts.groupBy(*keys, "bucket").agg(F.sum("n_equal").alias("bucket_n"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns(
        {
            "n_before": F.coalesce(F.sum("bucket_n").over(before), F.lit(0)),
            "n_total": F.sum("bucket_n").over(group),
        }
    )


def _rank_inside(counts: DataFrame, offsets: DataFrame, keys: list[str], value: str) -> DataFrame:
    inside = Window.partitionBy(*keys, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return counts.join(offsets, [*keys, "bucket"]).select(
        *keys,
        value,
        "n_equal",
        (F.col("n_before") + F.sum("n_equal").over(inside)).alias("n_up_to"),
        "n_total",
    )


def running_counts(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, value, n_equal, n_up_to, n_total``; ``n_up_to`` counts rows with a value <= this one.

    A NULL value, if kept in ``counts``, comes after all others.
    """
    bucketed = _with_bucket(counts, value)
    return _rank_inside(bucketed, _bucket_offsets(bucketed, keys), keys, value)


def element_at_rank(rank: Column, value: str) -> Column:
    """Aggregate over ``running_counts`` rows: the value at 0-based sorted position ``rank``."""
    covers = (F.col("n_up_to") - F.col("n_equal") <= rank) & (rank < F.col("n_up_to"))
    return F.max(F.when(covers, F.col(value)))


def interpolate(low: Column, high: Column, weight: Column) -> Column:
    """Linear interpolation measured from the nearer end; the midpoint is the plain mean."""
    step = high - low
    return (
        F.when(low == high, low)
        .when(weight == 0.5, (low + high) / 2)
        .when(weight > 0.5, high - step * (1 - weight))
        .otherwise(low + step * weight)
    )


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """``keys, n_total`` and one interpolated quantile column per entry of ``quantiles``.

    Only the buckets that hold a wanted position are looked at value by value.
    """
    bucketed = _with_bucket(value_counts(df, keys, value), value)
    total = F.col("n_total")
    positions = {name: (total - 1) * F.lit(float(q)) for name, q in quantiles.items()}
    ranks = [edge(p).cast("long") for p in positions.values() for edge in (F.floor, F.ceil)]
    first, last = F.col("n_before"), F.col("n_before") + F.col("bucket_n")
    wanted = _bucket_offsets(bucketed, keys).filter(
        F.exists(F.array(*ranks), lambda rank: (rank >= first) & (rank < last))
    )
    ranked = _rank_inside(bucketed, wanted, keys, value)
    picks = ranked.groupBy(*keys, "n_total").agg(
        *[
            element_at_rank(edge(p).cast("long"), value).alias(f"{name}_{side}")
            for name, p in positions.items()
            for side, edge in (("low", F.floor), ("high", F.ceil))
        ]
    )
    return picks.select(
        *keys,
        "n_total",
        *[
            interpolate(F.col(f"{name}_low"), F.col(f"{name}_high"), p - F.floor(p)).alias(name)
            for name, p in positions.items()
        ],
    )
