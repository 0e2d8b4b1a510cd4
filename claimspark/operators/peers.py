"""Every provider against all other providers of the same procedure.

What a provider's peers look like depends only on its procedure and its own rate, so the peer
figures are computed once per distinct rate and then attached to the providers. No provider is
ever paired with another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimspark.functions import fixed
from claimspark.operators.joins import measured_join, salted_join
from claimspark.operators.ranks import element_at_rank, interpolate, running_counts, value_counts

PEER_QUANTILES = {"peer_median": 0.5, "peer_p90": 0.9, "peer_p95": 0.95}
COMPARISON_COLUMNS = [
    "provider_id", "procedure_code", "provider_rate", "peer_median", "peer_p90", "peer_p95",
    "rate_ratio", "percentile", "peer_count",
]


def _positions(peers: Column, q: float) -> tuple[Column, Column, Column]:
    """Lower rank, upper rank and weight of quantile ``q`` among ``peers`` sorted values."""
    position = (peers - 1) * F.lit(q)
    return F.floor(position), F.ceil(position), position - F.floor(position)


def peer_figures(stats: DataFrame, keys: list[str] = ["procedure_code"], rate: str = "procedure_rate") -> DataFrame:
    """``keys, rate, peer_count, peer_median, peer_p90, peer_p95, percentile`` per distinct rate.

    One provider with that rate is left out of its own peers. A row with a NULL rate stands for
    providers without a rate: all rates of the group are their peers. ``percentile`` is the share of
    peers with a rate up to the own one, in percent.
    """
    ranked = running_counts(value_counts(stats, keys, rate, keep_null=True), keys, rate)
    total, up_to, has_rate = F.col("n_total"), F.col("n_up_to"), F.col(rate).isNotNull()

    # Sorted elements around each wanted position; leaving one provider out shifts them by at most one.
    picks = {}
    for name, q in PEER_QUANTILES.items():
        for side, rank in zip(("low", "high"), _positions(total - 1, q)[:2]):
            picks[f"{name}_{side}"] = element_at_rank(rank, rate)
            picks[f"{name}_{side}_next"] = element_at_rank(rank + 1, rate)
        for side, rank in zip(("low", "high"), _positions(total, q)[:2]):
            picks[f"{name}_all_{side}"] = element_at_rank(rank, rate)
    elements = ranked.groupBy(*keys).agg(*[c.alias(n) for n, c in picks.items()])

    def without_own(name: str, q: float) -> Column:
        low, high, weight = _positions(total - 1, q)
        own = up_to - 1
        return interpolate(
            F.when(low < own, F.col(f"{name}_low")).otherwise(F.col(f"{name}_low_next")),
            F.when(high < own, F.col(f"{name}_high")).otherwise(F.col(f"{name}_high_next")),
            weight,
        )

    def among_all(name: str, q: float) -> Column:
        return interpolate(F.col(f"{name}_all_low"), F.col(f"{name}_all_high"), _positions(total, q)[2])

    peers = F.when(has_rate, total - 1).otherwise(total)
    share = F.try_divide((up_to - 1).cast("double"), (total - 1).cast("double")) * 100.0
    return salted_join(ranked, elements, keys, by=[rate]).select(
        *keys,
        rate,
        peers.alias("peer_count"),
        *[
            F.when(peers > 0, F.when(has_rate, without_own(n, q)).otherwise(among_all(n, q))).alias(n)
            for n, q in PEER_QUANTILES.items()
        ],
        F.when(has_rate, share).alias("percentile"),
    )


def with_peer_figures(
    stats: DataFrame, keys: list[str] = ["procedure_code"], rate: str = "procedure_rate"
) -> DataFrame:
    """Attach the peer figures to each provider row; ``rate_ratio`` is NULL for a NULL or zero median.

    A third of all providers may share one procedure and rate, so that key is salted by provider where the figures, one row a rate, are too many for every task.
    """

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({"_known": F.col(rate).isNotNull(), "_rate": F.coalesce(F.col(rate), F.lit(0.0))})

    figures = keyed(peer_figures(stats, keys, rate)).drop(rate)
    joined = measured_join(keyed(stats), figures, [*keys, "_known", "_rate"], by=["provider_id"], how="left")
    return joined.drop("_known", "_rate").withColumn("rate_ratio", F.try_divide(F.col(rate), F.col("peer_median")))


def peer_comparison_all(stats: DataFrame) -> DataFrame:
    """The nine comparison fields for every provider and procedure; percentile to two decimals."""
    return (
        with_peer_figures(stats)
        .withColumnRenamed("procedure_rate", "provider_rate")
        .withColumn("percentile", F.rint(F.col("percentile") * 100) / 100)
        .select(*COMPARISON_COLUMNS)
    )


def provider_peer_comparison(stats: DataFrame, provider_id: str, procedure_code: str) -> DataFrame:
    """The comparison of one provider and code as one row, also when either is unknown."""
    of_code = stats.filter(F.col("procedure_code") == procedure_code)
    asked = stats.sparkSession.range(1).select(
        F.lit(provider_id).alias("provider_id"), F.lit(procedure_code).alias("procedure_code")
    )
    # A provider without rows for the code is compared as one without a rate.
    absent = asked.join(of_code, ["provider_id", "procedure_code"], "left_anti")
    rows = of_code.select("provider_id", "procedure_code", "procedure_rate").unionByName(
        absent.withColumn("procedure_rate", F.lit(None).cast("double"))
    )
    return peer_comparison_all(rows).filter(F.col("provider_id") == provider_id)


def peer_list(stats: DataFrame, limit: int = 25) -> DataFrame:
    """Providers with the highest rates of every procedure."""
    order = Window.partitionBy("procedure_code").orderBy(F.desc_nulls_last("procedure_rate"), "provider_id")
    return (
        stats.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .select("procedure_code", "rank", "provider_id", "claim_count", "beneficiary_count", "procedure_rate")
    )


def provider_options(stats: DataFrame) -> DataFrame:
    """Distinct providers in order."""
    return stats.filter(F.col("provider_id").isNotNull()).select("provider_id").distinct().orderBy("provider_id")


def procedure_options(stats: DataFrame, provider_id: str) -> DataFrame:
    """Distinct procedures of one provider in order."""
    own = stats.filter((F.col("provider_id") == provider_id) & F.col("procedure_code").isNotNull())
    return own.select("procedure_code").distinct().orderBy("procedure_code")


def provider_procedure_options(stats: DataFrame) -> DataFrame:
    """Distinct (provider, procedure) pairs of all providers in order."""
    pairs = stats.select("provider_id", "procedure_code").dropna().distinct()
    return pairs.orderBy("provider_id", "procedure_code")


def provider_detail_card(stats: DataFrame) -> DataFrame:
    """Nine metric/value rows per provider and procedure, values as text."""
    values = [
        "provider_id", "procedure_code", "claim_count", "beneficiary_count", "procedure_rate",
        "peer_median", "peer_p90", "peer_p95", "percentile",
    ]
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(m).alias("metric"), F.col(v).cast("string").alias("value"))
            for i, (m, v) in enumerate(zip(fixed.DETAIL_METRICS, values), start=1)
        ]
    )
    figures = with_peer_figures(stats).withColumn("percentile", F.rint(F.col("percentile") * 100) / 100)
    return figures.select("provider_id", "procedure_code", F.inline(cells))
