"""Peer-based anomaly table: features, isolation-forest score, flag and review queue.

Scores and flags set priorities for review. They say nothing about whether care or billing was right.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimspark.operators.forest import Forest, fit_forest
from claimspark.operators.peers import with_peer_figures
from claimspark.operators.ranks import exact_quantiles
from claimspark.session import materialise

FEATURES = ["provider_rate", "peer_median", "provider_to_peer_ratio", "peer_percentile", "claim_count"]
KEY = ["provider_id", "procedure_code"]
ANOMALY_COLUMNS = [
    "provider_id", "provider_id_type", "procedure_code", "claim_count", "beneficiary_count", "provider_rate",
    "peer_median", "provider_to_peer_ratio", "peer_percentile", "anomaly_score", "anomaly_flag",
]
AUTO_THRESHOLD = 0.5


def peer_features(stats: DataFrame) -> DataFrame:
    """Rates against peers; a provider without peers is compared with itself (percentile 100)."""
    rate = F.col("procedure_rate")
    median = F.when(F.col("peer_count") > 0, F.col("peer_median")).otherwise(rate)
    return with_peer_figures(stats).select(
        "provider_id",
        "provider_id_type",
        "procedure_code",
        "claim_count",
        "beneficiary_count",
        rate.alias("provider_rate"),
        median.alias("peer_median"),
        F.try_divide(rate, median).alias("provider_to_peer_ratio"),
        F.when(rate.isNotNull() & (F.col("peer_count") == 0), F.lit(100.0))
        .otherwise(F.col("percentile"))
        .alias("peer_percentile"),
    )


def _filled(features: DataFrame) -> dict:
    return {f"_{name}": F.coalesce(F.col(name).cast("double"), F.lit(0.0)) for name in FEATURES}


def fit_anomaly_model(df: DataFrame, features: list[str], key: list[str]) -> Forest:
    """Reproducible forest over the complete rows of the given numeric columns."""
    return fit_forest(df, features, key)


def label_rows(df: DataFrame, model: Forest, key: list[str], contamination: str | float = "auto") -> DataFrame:
    """``anomaly_score`` and ``anomaly_label`` (-1 unusual, 1 usual) for the complete rows.

    ``auto`` labels scores above one half; a share labels the rows above that quantile of all scores.
    """
    scored = model.with_score(df.dropna(subset=model.features))
    if contamination == "auto":
        threshold = AUTO_THRESHOLD
    else:
        scored = materialise(scored, "scores")
        cut = exact_quantiles(scored, [], "anomaly_score", {"cut": 1.0 - float(contamination)}).first()
        threshold = cut["cut"] if cut else AUTO_THRESHOLD
    return scored.withColumn("anomaly_label", F.when(F.col("anomaly_score") > F.lit(threshold), -1).otherwise(1))


def score_features(features: DataFrame, contamination: str | float = "auto") -> DataFrame:
    """Score and flag a materialised ``peer_features`` table; fewer than two rows score 0."""
    if features.limit(2).count() < 2:
        return features.withColumns({"anomaly_score": F.lit(0.0), "anomaly_flag": F.lit(False)}).select(
            *ANOMALY_COLUMNS
        )
    filled = features.withColumns(_filled(features))
    model = fit_anomaly_model(filled, [f"_{name}" for name in FEATURES], KEY)
    labelled = label_rows(filled, model, KEY, contamination)
    return labelled.withColumn("anomaly_flag", F.col("anomaly_label") == -1).select(*ANOMALY_COLUMNS)


def sort_anomalies(table: DataFrame) -> DataFrame:
    """Highest score first, then highest ratio; rows without a ratio come last."""
    return table.orderBy(F.desc("anomaly_score"), F.desc_nulls_last("provider_to_peer_ratio"), *KEY)


def provider_anomalies(stats: DataFrame, contamination: str | float = "auto") -> DataFrame:
    """Scored table of all provider-procedure pairs, unsorted.

    The features are written once to the shared folder: the sample and the scoring both read them.
    """
    return score_features(materialise(peer_features(stats), "peer-features"), contamination)


def build_provider_anomaly_table(stats: DataFrame, contamination: str | float = "auto") -> DataFrame:
    return sort_anomalies(provider_anomalies(stats, contamination))


def investigation_queue(table: DataFrame, limit: int = 25) -> DataFrame:
    """First rows to review: flagged, or at or above the 90th peer percentile."""
    due = table.filter(F.col("anomaly_flag") | (F.col("peer_percentile") >= 90))
    return (
        sort_anomalies(due)
        .limit(limit)
        .select(
            "provider_id", "procedure_code", "provider_rate", "peer_median", "provider_to_peer_ratio",
            "peer_percentile", "anomaly_score", "anomaly_flag",
        )
    )
