"""Courses over calendar months: robust growth of procedures, and how long a provider stays above its peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimspark.operators.claim_lines import lines_with_code
from claimspark.operators.joins import salted_join
from claimspark.operators.ranks import exact_quantiles
from claimspark.operators.utilization import distinct_claims

THRESHOLD = 2.0  # standard deviations above the peers
MIN_CLAIMS = 2  # claims of a month that can be above


def month_number(month: Column) -> Column:
    return F.year(month) * 12 + F.month(month) - 1


def month_of(number: Column) -> Column:
    return F.make_date(F.floor(number / 12).cast("int"), (number % 12 + 1).cast("int"), F.lit(1))


def procedure_growth(trends: DataFrame) -> DataFrame:
    """``procedure_code, first_month, last_month, months, empty_months, median_claims, monthly_slope, yearly_growth`` from ``procedure_trends``.

    The months from a procedure's first to its last are filled with zeros. The slope is the median of the slopes between every two of
    its months (Theil-Sen), so single months do not move it; a procedure has at most one row a calendar month. ``yearly_growth`` is twelve slopes by the median
    month, NULL where that is 0. With one month the slope is NULL. Rows without procedure or month are left out.
    """
    known = trends.dropna(subset=["procedure_code", "service_month"]).select("procedure_code", month_number(F.col("service_month")).alias("month"), "claim_count")
    spans = known.groupBy("procedure_code").agg(F.min("month").alias("first"), F.max("month").alias("last"), F.count("*").alias("seen"))
    grid = spans.select("procedure_code", F.explode(F.sequence("first", "last")).alias("month"))
    grid = grid.join(known, ["procedure_code", "month"], "left").select("procedure_code", "month", F.coalesce("claim_count", F.lit(0)).alias("claims"))
    later = grid.select("procedure_code", F.col("month").alias("later"), F.col("claims").alias("later_claims"))
    slopes = grid.join(later, "procedure_code").filter("later > month").select("procedure_code", ((F.col("later_claims") - F.col("claims")) / (F.col("later") - F.col("month"))).alias("slope"))
    slope = exact_quantiles(slopes, ["procedure_code"], "slope", {"monthly_slope": 0.5}).drop("n_total")
    level = exact_quantiles(grid.withColumn("claims", F.col("claims").cast("double")), ["procedure_code"], "claims", {"median_claims": 0.5}).drop("n_total")
    rows = spans.join(level, "procedure_code").join(slope, "procedure_code", "left")
    length = F.col("last") - F.col("first") + 1
    return rows.select(
        "procedure_code", month_of(F.col("first")).alias("first_month"), month_of(F.col("last")).alias("last_month"), length.cast("long").alias("months"),
        (length - F.col("seen")).cast("long").alias("empty_months"), "median_claims", "monthly_slope",
        F.when(F.col("median_claims") > 0, F.col("monthly_slope") * 12 / F.col("median_claims")).alias("yearly_growth"),
    )


def monthly_differences(lines: DataFrame) -> DataFrame:
    """``provider_id, procedure_code, month, claims, peers, peer_mean, peer_deviation, difference`` for each month of a provider's procedure.

    Peers are the other providers with claims for the procedure in the month. Their mean and sample standard deviation follow from count, sum and sum of squares of all
    minus the provider's own: whole numbers, added exactly in any order, so nothing cancels. ``difference`` counts
    deviations above the mean; it is NULL with fewer than two peers or without spread among them.
    """
    known = lines_with_code(lines).dropna(subset=["provider_id", "service_date"])
    monthly = known.groupBy("provider_id", "procedure_code", month_number(F.col("service_date")).alias("month")).agg(distinct_claims().alias("claims"))
    exact = F.col("claims").cast("decimal(19,0)")
    totals = monthly.groupBy("procedure_code", "month").agg(F.count("*").alias("n"), F.sum("claims").alias("total"), F.sum(exact * exact).cast("decimal(19,0)").alias("squares"))
    rows = salted_join(monthly, totals, ["procedure_code", "month"], by=["provider_id"])
    rows = rows.select("provider_id", "procedure_code", "month", "claims", (F.col("n") - 1).alias("peers"), (F.col("total") - F.col("claims")).alias("others"), (F.col("squares") - exact * exact).cast("decimal(19,0)").alias("other_squares"))
    peers, others = F.col("peers").cast("decimal(19,0)"), F.col("others").cast("decimal(19,0)")
    spread = (peers * F.col("other_squares") - others * others).cast("double") / (F.col("peers") * (F.col("peers") - 1))
    rows = rows.withColumns({"peer_mean": F.when(F.col("peers") > 0, F.col("others") / F.col("peers")), "peer_deviation": F.when(F.col("peers") > 1, F.sqrt(spread))})
    above = F.when(F.col("peer_deviation") > 0, (F.col("claims") - F.col("peer_mean")) / F.col("peer_deviation"))
    return rows.drop("others", "other_squares").withColumn("difference", above)


def persistence(differences: DataFrame, threshold: float = THRESHOLD, min_claims: int = MIN_CLAIMS) -> DataFrame:
    """``provider_id, procedure_code, months, months_compared, months_above, longest_run, run_from, run_to, largest_difference``.

    A month is above with at least ``threshold`` deviations and ``min_claims`` claims. A run is a stretch of calendar months that are all above; a
    month without claims ends it. Of equally long runs the first is given; without any the run is 0 and its months NULL.
    """
    pair = ["provider_id", "procedure_code"]
    above = F.coalesce((F.col("difference") >= threshold) & (F.col("claims") >= min_claims), F.lit(False))
    rows = differences.withColumn("above", above)
    every = rows.groupBy(*pair).agg(
        F.count("*").alias("months"), F.count("difference").alias("months_compared"), F.count_if("above").alias("months_above"), F.max("difference").alias("largest_difference"),
    )
    place = F.row_number().over(Window.partitionBy(*pair).orderBy("month"))
    runs = rows.filter("above").withColumn("run", F.col("month") - place).groupBy(*pair, "run").agg(F.count("*").alias("length"), F.min("month").alias("from"))
    best = runs.groupBy(*pair).agg(F.min(F.struct((-F.col("length")).alias("shortness"), "from")).alias("best"))
    length, begin = -F.col("best.shortness"), F.col("best.from")
    return every.join(best, pair, "left").select(
        *pair, "months", "months_compared", "months_above", F.coalesce(length, F.lit(0)).alias("longest_run"),
        month_of(begin).alias("run_from"), month_of(begin + length - 1).alias("run_to"), "largest_difference",
    )
