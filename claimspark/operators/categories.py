"""Why a provider's use of a procedure stands out: changes over its months, and reasons put together per provider and procedure.

Like scores and flags, a category sets priorities for review. It says nothing about whether care or billing was right.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimspark.operators.case_mix import PAIR, diagnosis_mix, divergence_of, known_items, own_items, place_mix
from claimspark.operators.claim_lines import lines_with_code
from claimspark.operators.course import month_number, month_of
from claimspark.operators.joins import measured_join
from claimspark.operators.together import codes_beside
from claimspark.operators.utilization import distinct_claims
from claimspark.session import materialise

UTILIZATION, DIAGNOSIS, SITE, TREND, COMBINATION = "utilization", "diagnosis", "site_of_service", "trend", "combination"


@dataclass(frozen=True)
class Limits:
    """When a difference counts as substantial."""

    min_claims: int = 5  # of the pair, for utilization and trend
    ratio: float = 2.0  # to the median of the peers
    percentile: float = 90.0
    min_rows: int = 5  # of the pair, for each of the mixes
    divergence: float = 0.35  # Jensen-Shannon, from 0 to 1
    slack: float = 0.5  # standard deviations a month may differ from the mean without adding to the sum
    decision: float = 4.0  # standard deviations at which the sum tells a change


def provider_months(lines: DataFrame) -> DataFrame:
    """``provider_id, procedure_code, month, claims``: distinct claims; months as numbers. Lines without provider, procedure or day are left out."""
    known = _dated_lines(lines).select(*PAIR, month_number(F.col("service_date")).alias("month"), "claim_type", "source_claim_id")
    # All of a pair's lines meet, so that neither claims nor months are moved again.
    return known.repartition(*PAIR).groupBy(*PAIR, "month").agg(distinct_claims().alias("claims"))


def _dated_lines(lines: DataFrame) -> DataFrame:
    return lines_with_code(lines).dropna(subset=["provider_id", "service_date"])


def procedure_spans(lines: DataFrame) -> DataFrame:
    """``procedure_code, first, last``: the first and last month of ``provider_months``, without counting claims."""
    month = month_number(F.col("service_date"))
    return _dated_lines(lines).groupBy("procedure_code").agg(F.min(month).alias("first"), F.max(month).alias("last"))


def change_points(monthly: DataFrame, limits: Limits = Limits(), spans: DataFrame | None = None) -> DataFrame:
    """``provider_id, procedure_code, months, claims, up_from, up_seen, up_peak, down_from, down_seen, down_peak`` of pairs with ``min_claims`` claims.

    The months of a pair run from the procedure's first to its last, filled with zeros, so that beginning and ending are changes too. Upwards and
    downwards the differences from the pair's own mean, less the slack, are summed and the sum is set back to 0 whenever it falls below (CUSUM). A sum
    with such resets is a running sum less the smallest one so far, so windows over a pair's months are enough. The running sums are made of whole
    numbers and one root, the same in any order of rows. ``seen`` is the first month in which the sum reaches the decision limit, ``from`` the month
    after its last reset until then, ``peak`` its largest value in standard deviations; without a change the months are NULL, without
    spread all are. ``monthly`` has one row a pair and month; rows with NULLs are left out. ``spans`` has the procedures' first and last months; without it
    ``monthly`` is written and read twice.

    Months without claims are not made into rows. From one month with claims to the next the running sums change by the same amount every month, so
    sums, smallest sums and resets of such a stretch are known from its last month; only where the limit is reached inside a stretch are its months tried one by one,
    in one row of the pair. A pair has at most two rows for a month with claims, and one for the stretch before the first.
    """
    known = monthly.dropna(subset=[*PAIR, "month", "claims"]).select(*PAIR, "month", "claims")
    if spans is None:
        known = materialise(known, "provider-months")
        spans = known.groupBy("procedure_code").agg(F.min("month").alias("first"), F.max("month").alias("last"))
    pair, own = Window.partitionBy(*PAIR), Window.partitionBy(*PAIR).orderBy("month")
    square = F.col("claims").cast("decimal(19,0)") * F.col("claims")
    rows = known.withColumns({
        "total": F.sum("claims").over(pair), "squares": F.sum(square).over(pair).cast("decimal(19,0)"),
        "reached": F.sum("claims").over(own), "before": F.lag("month").over(own), "after": F.lead("month").over(own),
    }).filter(F.col("total") >= limits.min_claims)
    rows = measured_join(rows, spans, ["procedure_code"], by=["provider_id"]).withColumn("n", F.col("last") - F.col("first") + 1)
    spread = F.col("n").cast("decimal(19,0)") * F.col("squares") - F.col("total").cast("decimal(19,0)") * F.col("total")
    rows = rows.withColumn("spread", F.sqrt(spread.cast("double")))  # n standard deviations

    def stretch(begin: Column, end: Column, reached: Column) -> Column:
        return F.struct(begin.alias("begin"), end.alias("month"), reached.alias("reached"))

    month, end = F.col("month"), F.coalesce(F.col("after"), F.col("last") + 1) - 1
    ends = F.array_compact(F.array(
        F.when(F.col("before").isNull() & (month > F.col("first")), stretch(F.col("first"), month - 1, F.lit(0).cast("long"))),
        stretch(month, month, F.col("reached")),
        F.when(end > month, stretch(month + 1, end, F.col("reached"))),
    ))
    rows = rows.select(*PAIR, "n", "total", "first", "spread", F.explode(ends).alias("end")).select(*PAIR, "n", "total", "first", "spread", "end.*")

    def running(sign: int, at: Column, reached: Column) -> Column:
        place = at - F.col("first") + 1
        return sign * (F.col("n") * reached - place * F.col("total")) - place * limits.slack * F.col("spread")

    found = []
    for name, sign in (("up", 1), ("down", -1)):
        rows = rows.withColumn("sum", running(sign, F.col("month"), F.col("reached")))
        rows = rows.withColumn(f"{name}_low", F.least(F.lit(0.0), F.min("sum").over(own))).withColumn(name, F.col("sum") - F.col(f"{name}_low"))
        reset = F.last(F.when(F.col(name) <= 0, F.col("month") + 1), ignorenulls=True).over(own)
        rows = rows.withColumn(f"{name}_begin", F.coalesce(reset, "first"))
        seen = (F.col("spread") > 0) & (F.col(name) >= limits.decision * F.col("spread"))
        found += [
            F.min(F.when(seen, F.struct("month", F.col(f"{name}_begin").alias("from"), F.col("begin"), "reached", F.col(f"{name}_low").alias("low")))).alias(name),
            F.max(F.when(F.col("spread") > 0, F.col(name) / F.col("spread"))).alias(f"{name}_peak"),
        ]
    # Ends of one row a pair; the numbers of the pair are the same on all of its months.
    rows = rows.groupBy(*PAIR).agg(*[F.max(c).alias(c) for c in ("n", "total", "first", "spread")], *found)

    def first_seen(name: str, sign: int) -> Column:
        """The first month of the stretch in which the limit is reached; the last one has reached it."""
        change = F.col(name)
        reaches = F.filter(
            F.sequence(change["begin"], change["month"]),
            lambda at: running(sign, at, change["reached"]) - change["low"] >= limits.decision * F.col("spread"),
        )
        return F.when(change.isNotNull(), F.when(change["begin"] == change["month"], change["month"]).otherwise(F.array_min(reaches)))

    return rows.select(
        *PAIR, F.col("n").cast("long").alias("months"), F.col("total").alias("claims"),
        month_of(F.col("up.from")).alias("up_from"), month_of(first_seen("up", 1)).alias("up_seen"), "up_peak",
        month_of(F.col("down.from")).alias("down_from"), month_of(first_seen("down", -1)).alias("down_seen"), "down_peak",
    )


def combination_mix(lines: DataFrame) -> DataFrame:
    """Other procedures on the claims of a provider's procedure, against those of all other providers of it."""
    own = materialise(own_items(known_items(codes_beside(lines), "other_code", "claims")), "codes-beside")
    return divergence_of(own, own.withColumnRenamed("n", "times"))


def anomaly_categories(lines: DataFrame, features: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Every row of ``features`` (one per provider and procedure, from ``anomaly.peer_features``) with its figures and ``categories``.

    ``utilization``: at least ``ratio`` times the peers' median and in the upper ``percentile``; ``diagnosis``, ``site_of_service``, ``combination``:
    the mix of diagnoses, places or procedures on the same claims diverges from that of all other providers of the procedure; ``trend``: a
    change over the months, up or down, the earlier one given. A figure that does not exist (no peers, no places, too few claims) gives no category. ``categories`` is an
    array in this order, empty where nothing stands out.
    """
    changes = change_points(provider_months(lines), limits, procedure_spans(lines))
    up_first = F.col("up_seen").isNotNull() & (F.col("down_seen").isNull() | (F.col("up_seen") <= F.col("down_seen")))
    direction = F.when(up_first, "up").when(F.col("down_seen").isNotNull(), "down")
    changes = changes.select(*PAIR, direction.alias("change"), F.when(up_first, F.col("up_from")).otherwise(F.col("down_from")).alias("change_from"))
    table = features.select(*PAIR, "claim_count", "provider_to_peer_ratio", "peer_percentile").join(changes, PAIR, "left")
    for name, mix in (("diagnosis", diagnosis_mix), ("place", place_mix), ("combination", combination_mix)):
        figures = mix(lines).select(*PAIR, F.col("rows").alias(f"{name}_rows"), F.col("divergence").alias(f"{name}_divergence"), F.col("most_over").alias(f"{name}_most_over"))
        table = table.join(figures, PAIR, "left")

    def differs(name: str) -> Column:
        return (F.col(f"{name}_rows") >= limits.min_rows) & (F.col(f"{name}_divergence") >= limits.divergence)

    above = (F.col("provider_to_peer_ratio") >= limits.ratio) & (F.col("peer_percentile") >= limits.percentile)
    reasons = {
        UTILIZATION: above & (F.col("claim_count") >= limits.min_claims), DIAGNOSIS: differs("diagnosis"), SITE: differs("place"),
        TREND: F.col("change").isNotNull(), COMBINATION: differs("combination"),
    }
    return table.withColumn("categories", F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in reasons.items()])))
