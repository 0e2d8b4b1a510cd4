"""The jobs on whole tables: Parquet and archives in, derived tables written by the library's sinks and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimspark.plans import analytics, coverage_build
from claimspark.session import scratch_path, settings
from claimspark.sources.paths import exists
from workload import adapter as a, file_layer, staging

# (application, table folder) -> derived folder and the row counts that the jobs returned
_RUN: dict[tuple[str, str], tuple[str, dict[str, int]]] = {}


def _base(spark: SparkSession, sf: str) -> DataFrame:
    """The lines, joined once for the claim tables and the policy tables; measured partitions of parts and orders that are small are hashed, not sorted."""
    with settings(spark, spark_sql_adaptive_maxShuffledHashJoinLocalMapThreshold="64m"):
        return staging.claim_base(spark, sf)


def derived(spark: SparkSession, sf: str) -> tuple[str, dict[str, int]]:
    """Folder of the derived tables and their row counts; the jobs run once a session, and again if the folder was removed."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RUN or not exists(spark, f"{_RUN[key][0]}/coverage_ncd_relationships.parquet"):
        processed, folder = scratch_path(spark, "processed"), scratch_path(spark, "derived")
        base = _base(spark, sf)
        for kind, name in analytics.CLAIM_TABLES.items():
            a.processed_claims(base, kind).write.parquet(f"{processed}/{name}", compression="zstd")
        counts = analytics.build_procedure_analytics(spark, processed, folder)
        archives = file_layer.policy_archives(spark, sf)
        counts |= coverage_build.build_local_coverage_relationships(spark, archives, folder, as_of=a.AS_OF)
        _RUN[key] = folder, counts
    return _RUN[key]


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def read(spark: SparkSession, sf: str) -> DataFrame:
        return spark.read.parquet(analytics.derived_path(derived(spark, sf)[0], name))

    return read


def job_row_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What the sinks counted while they wrote, one row per derived table."""
    return spark.createDataFrame(sorted(derived(spark, sf)[1].items()), "derived_table string, row_count long")


def coverage_details_all(spark: SparkSession, sf: str) -> DataFrame:
    """All columns of the three relationship tables for one code, as the read of the coverage job gives them."""
    details = coverage_build.load_local_coverage_details(spark, f" {CODE.lower()} ", derived(spark, sf)[0])
    parts = [df.selectExpr(f"'{name}' AS detail", "*") for name, df in details.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows


CODE = "B7-3"
# Written tables and the queries that compute them directly.
TABLES = [*analytics.DERIVED, *(table for table, _, _ in coverage_build.OUTPUTS.values())]
QUERIES = {f"job_{name}": _table(name) for name in TABLES} | {f.__name__: f for f in (job_row_counts, coverage_details_all)}


def oracles(direct: dict[str, str]) -> dict[str, str]:
    """SQL of the queries above from the SQL of the tables themselves."""
    counts = " UNION ALL ".join(f"SELECT '{name}.parquet' AS derived_table, count(*) AS row_count FROM ({direct[name]})" for name in TABLES)
    details = " UNION ALL BY NAME ".join(
        f"SELECT '{detail}' AS detail, * FROM ({direct[table]}) WHERE procedure_code = '{CODE}'" for detail, (table, _, _) in coverage_build.OUTPUTS.items()
    )
    return {f"job_{name}": direct[name] for name in TABLES} | {"job_row_counts": counts, "coverage_details_all": details}
