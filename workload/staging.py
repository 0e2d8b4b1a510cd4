"""Tables that many queries share, written once per session and scale to the shared folder.

They play the part of the processed, derived and landed tables of the real jobs: claim text is parsed
once, policy tables are landed once, and the peer and evidence queries start from derived tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from claimspark.functions import fixed
from claimspark.operators import anomaly, coverage, utilization
from claimspark.operators.claim_lines import lines_with_code
from claimspark.plans.coverage_build import table_names
from claimspark.session import scratch_path
from claimspark.sources.paths import exists
from workload import adapter

# (application, table folder, name) -> path and schema of a table written in this session
_WRITTEN: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def is_staged(spark: SparkSession, sf_dir: str, name: str) -> bool:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    return key in _WRITTEN and exists(spark, f"{_WRITTEN[key][0]}/_SUCCESS")


def staged(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table from the shared folder; it is built on first use and rebuilt if it was removed."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if not is_staged(spark, sf_dir, name):
        path, df = scratch_path(spark, name), build()
        df.write.parquet(path, compression="zstd")
        _WRITTEN[key] = path, df.schema
    path, schema = _WRITTEN[key]
    return spark.read.schema(schema).parquet(path)


def claim_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For jobs that need the joined lines several times; single queries join what they need."""
    return staged(spark, sf_dir, "claim_base", lambda: adapter.claim_base(spark, sf_dir).select(*adapter.BASE_COLUMNS))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "claim_lines", lambda: adapter.lines(spark, sf_dir))


def procedure_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "procedure_stats", lambda: utilization.procedure_stats(lines(spark, sf_dir)))


def provider_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(
        spark, sf_dir, "provider_procedure_stats", lambda: utilization.provider_procedure_stats(lines(spark, sf_dir))
    )


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "provider_anomalies", lambda: anomaly.provider_anomalies(provider_stats(spark, sf_dir)))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(
        spark, sf_dir, "observed_codes", lambda: coverage.code_set(lines_with_code(lines(spark, sf_dir)))
    )


def coverage_tables(spark: SparkSession, sf_dir: str) -> dict[str, dict[str, DataFrame]]:
    built: dict[str, dict[str, DataFrame]] = {}

    def build(kind: str, name: str) -> DataFrame:
        if not built:
            base = claim_base(spark, sf_dir) if is_staged(spark, sf_dir, "claim_base") else None
            built.update(adapter.coverage_tables(spark, sf_dir, base))
        return built[kind][name]

    return {
        kind: {
            name: staged(spark, sf_dir, f"{kind}-{name}", lambda kind=kind, name=name: build(kind, name))
            for name in table_names(kind)
        }
        for kind in fixed.COVERAGE_ARCHIVES
    }


def policy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        return coverage.policy_matches(coverage_tables(spark, sf_dir), codes(spark, sf_dir), F.lit(adapter.AS_OF))

    return staged(spark, sf_dir, "coverage_policy_matches", build)
