"""Utilization job: processed claim tables -> five derived tables, and the reads on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimspark.operators import anomaly, peers, utilization
from claimspark.operators.claim_lines import combine_claim_lines
from claimspark.session import scratch_path
from claimspark.sources.paths import drop_dir, exists
from claimspark.sources.sinks import read_if_present, write_table

CLAIM_TABLES = {"carrier": "carrier.parquet", "outpatient": "outpatient.parquet", "inpatient": "inpatient.parquet"}
# Derived table -> columns its files are clustered and sorted by; a hot code spreads over many files.
DERIVED = {
    "procedure_stats": ["procedure_code"],
    "diagnosis_procedure_stats": ["procedure_code", "diagnosis_code"],
    "provider_procedure_stats": ["procedure_code", "provider_id"],
    "pos_procedure_stats": ["procedure_code", "place_of_service_code"],
    "procedure_trends": ["procedure_code", "service_month"],
}


def derived_path(derived_dir: str, table: str) -> str:
    return f"{derived_dir.rstrip('/')}/{table}.parquet"


def build_procedure_analytics(spark: SparkSession, processed_dir: str, derived_dir: str) -> dict[str, int]:
    """Write the derived tables and return their row counts.

    Claim lines are written once to the shared folder, because every table reads them, and removed
    at the end. So are the distinct counts of four tables, which move each line once per kind of entity; the table of
    providers moves them once more, for both kinds and its amounts.
    """
    sources = {kind: f"{processed_dir.rstrip('/')}/{name}" for kind, name in CLAIM_TABLES.items()}
    missing = [CLAIM_TABLES[kind] for kind, path in sources.items() if not exists(spark, path)]
    if missing:
        raise FileNotFoundError("Missing standardized claims files: " + ", ".join(missing))
    lines_path, counts_path, providers_path = (scratch_path(spark, name) for name in ("claim-lines", "distinct-counts", "provider-rows"))
    counts = {}
    try:
        # No table looks at claim keys: claims are told by type and id.
        combine_claim_lines({k: spark.read.parquet(p) for k, p in sources.items()}).drop("claim_key").write.parquet(lines_path, compression="zstd")
        lines = spark.read.parquet(lines_path)
        utilization.distinct_counts(lines, ["procedure", "diagnosis", "place", "carrier", "month"]).write.partitionBy("grouping").parquet(counts_path)
        entities = spark.read.parquet(counts_path)

        def save(table: str, df: DataFrame) -> None:
            counts[f"{table}.parquet"] = write_table(df, derived_path(derived_dir, table), cluster_by=DERIVED[table])

        save("procedure_stats", utilization.procedure_stats(lines, entities))
        procedures = spark.read.parquet(derived_path(derived_dir, "procedure_stats"))
        save("diagnosis_procedure_stats", utilization.diagnosis_procedure_stats(lines, procedures, entities))
        # Clustering by ranges runs what it clusters twice, first to see the ranges.
        utilization.provider_procedure_stats(lines).write.parquet(providers_path, compression="zstd")
        save("provider_procedure_stats", spark.read.parquet(providers_path))
        save("pos_procedure_stats", utilization.pos_procedure_stats(lines, entities))
        save("procedure_trends", utilization.procedure_trends(lines, entities))
    finally:
        for path in (lines_path, counts_path, providers_path):
            drop_dir(spark, path)
    return counts


def _derived(spark: SparkSession, derived_dir: str, table: str) -> DataFrame:
    path = derived_path(derived_dir, table)
    if not exists(spark, path):
        raise FileNotFoundError(f"Missing derived tables: {table}.parquet")
    return spark.read.parquet(path)


def get_procedure_codes(spark: SparkSession, derived_dir: str) -> DataFrame | None:
    procedures = read_if_present(spark, derived_path(derived_dir, "procedure_stats"))
    return None if procedures is None else utilization.procedure_codes(procedures)


def get_procedure_details(spark: SparkSession, procedure_code: str, derived_dir: str) -> dict[str, DataFrame]:
    missing = [f"{t}.parquet" for t in DERIVED if not exists(spark, derived_path(derived_dir, t))]
    if missing:
        raise FileNotFoundError("Missing derived tables: " + ", ".join(missing))
    tables = {t: spark.read.parquet(derived_path(derived_dir, t)) for t in DERIVED}
    return utilization.procedure_details(tables, procedure_code)


def get_provider_peer_comparison(
    spark: SparkSession, provider_id: str, procedure_code: str, derived_dir: str
) -> DataFrame:
    stats = _derived(spark, derived_dir, "provider_procedure_stats")
    return peers.provider_peer_comparison(stats, provider_id, procedure_code)


def build_provider_anomaly_table(
    spark: SparkSession, derived_dir: str, contamination: str | float = "auto"
) -> DataFrame:
    stats = _derived(spark, derived_dir, "provider_procedure_stats")
    return anomaly.build_provider_anomaly_table(stats, contamination)
