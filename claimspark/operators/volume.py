"""Volumes over the last days: distinct claims and beneficiaries in windows that end on each day of service.

An entity is inside a window of n days from one of its days to n - 1 days after it. Of an entity's days in order only those
matter that begin or end an uninterrupted stretch of such windows. The stretches begun up to a day less those whose last day lies n
days back or more are the distinct entities inside, without ever holding them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

WINDOWS = (30, 90, 365)


def _stretches(rows: DataFrame, keys: list[str], name: str, windows: tuple[int, ...]) -> DataFrame:
    """``keys, day`` of each day of a non-NULL entity, and for each window whether a stretch begins or ends there."""
    visits = rows.select(*keys, F.col(f"`entity {name}`").alias("entity"), "day").filter("entity IS NOT NULL")
    visits = visits.repartition(*keys, "entity").distinct()  # moved once for the distinct days and their order
    own = Window.partitionBy(*keys, "entity").orderBy("day")
    visits = visits.select(*keys, "day", F.lag("day").over(own).alias("before"), F.lead("day").over(own).alias("after"))
    found = []
    for n in windows:
        begins = F.col("before").isNull() | (F.datediff("day", "before") >= n)
        ends = F.col("after").isNull() | (F.datediff("after", "day") >= n)
        found += [begins.cast("long").alias(f"{name} begin {n}"), ends.cast("long").alias(f"{name} end {n}")]
    return visits.select(*keys, "day", *found)


def distinct_in_windows(rows: DataFrame, keys: list[str], entities: str | dict[str, str], day: str, windows: tuple[int, ...], name: str = "") -> DataFrame:
    """``keys, day`` of every day in ``rows`` with ``{name}_{n}d``: distinct non-NULL entities of the ``n`` days up to it.

    ``entities`` is a column, counted as ``name``, or several by their names. Rows without a day are left out; NULL keys are a key. All that
    begins and ends on a day of a key is added up to one row, with all entities and windows, before the days of a key are put in order.
    """
    named = {name: entities} if isinstance(entities, str) else entities
    dated = rows.select(*keys, F.col(day).alias("day"), *[F.col(c).alias(f"entity {own}") for own, c in named.items()]).filter("day IS NOT NULL")
    alone = dated.filter(reduce(lambda a, b: a & b, [F.col(f"`entity {own}`").isNull() for own in named])).select(*keys, "day")
    parts = [_stretches(dated, keys, own, windows) for own in named]
    marks = [f"{own} {side} {n}" for own in named for n in windows for side in ("begin", "end")]
    changes = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*parts, alone])
    days = changes.groupBy(*keys, "day").agg(*[F.coalesce(F.sum(f"`{m}`"), F.lit(0)).alias(m) for m in marks])
    order = Window.partitionBy(*keys).orderBy(F.unix_date("day"))

    def inside(own: str, n: int):
        begun = F.sum(f"`{own} begin {n}`").over(order.rowsBetween(Window.unboundedPreceding, 0))
        ended = F.sum(f"`{own} end {n}`").over(order.rangeBetween(Window.unboundedPreceding, -n))
        return (begun - F.coalesce(ended, F.lit(0))).alias(f"{own}_{n}d")

    return days.select(*keys, F.col("day").alias(day), *[inside(own, n) for own in named for n in windows])


def provider_volume(lines: DataFrame, windows: tuple[int, ...] = WINDOWS, keys: tuple[str, ...] = ("provider_id", "procedure_code")) -> DataFrame:
    """For each provider, procedure and day of service the claims and beneficiaries of the last 30, 90 and 365 days.

    Lines without provider, procedure or day are left out. A claim on several days counts once in a window; lines without a claim
    id are claims of their own; lines without a beneficiary count in the claims only.
    """
    known = lines.dropna(subset=[*keys, "service_date"])
    return distinct_in_windows(known, list(keys), {"claims": "claim_key", "beneficiaries": "bene_id"}, "service_date", windows)
