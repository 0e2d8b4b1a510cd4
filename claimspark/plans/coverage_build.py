"""Coverage job: nested policy archives -> three relationship tables, and the read for one code."""

from __future__ import annotations

import datetime
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from claimspark.functions import fixed
from claimspark.operators import coverage
from claimspark.plans.analytics import derived_path
from claimspark.session import scratch_path
from claimspark.sources.archives import land_bundle
from claimspark.sources.files import list_files
from claimspark.sources.paths import drop_dir, exists
from claimspark.sources.sinks import write_table

OUTPUTS = {
    "policy_matches": ("coverage_policy_matches", coverage.MATCH_COLUMNS, ["procedure_code", "policy_id"]),
    "icd10_relationships": ("coverage_icd10_relationships", coverage.ICD10_COLUMNS, ["procedure_code", "policy_id"]),
    "ncd_relationships": ("coverage_ncd_relationships", coverage.NCD_COLUMNS, ["procedure_code", "source_policy_id"]),
}


def table_names(policy_type: str) -> list[str]:
    if policy_type == "NCD":
        return ["ncd_trkg"]
    prefix = policy_type.lower()
    names = [
        prefix, f"{prefix}_x_hcpc_code", f"{prefix}_related_ncd_documents", f"{prefix}_x_contractor",
        f"{prefix}_x_primary_jurisdiction", "contractor", "contractor_jurisdiction", "state_lookup",
    ]
    if policy_type == "Article":
        names += ["article_x_icd10_covered", "article_x_icd10_noncovered"]
    return names


def land_policy_tables(spark: SparkSession, coverage_dir: str, landing_dir: str) -> coverage.PolicyTables:
    """All policy tables, unpacked once. The contractor table may be absent.

    An archive ``name.zip`` may instead come as ``name.part-0000.zip`` and so on, in the order of the names.
    """
    folder = coverage_dir.rstrip("/")
    parts = {}
    for kind, (archive, _) in fixed.COVERAGE_ARCHIVES.items():
        whole, stem = f"{folder}/{archive}", archive.removesuffix(".zip")
        named = rf"^{re.escape(stem.lower())}\.part-\d+\.zip$"
        parts[kind] = [whole] if exists(spark, whole) else [r["path"] for r in list_files(spark, folder, named).orderBy("name").collect()]
        if not parts[kind]:
            raise FileNotFoundError(f"Missing CMS coverage archive: {whole}")
    return {
        kind: land_bundle(spark, parts[kind], bundle, table_names(kind), f"{landing_dir}/{kind}", optional=("contractor",))
        for kind, (_, bundle) in fixed.COVERAGE_ARCHIVES.items()
    }


def build_local_coverage_relationships(
    spark: SparkSession,
    coverage_dir: str,
    derived_dir: str,
    procedure_codes: Sequence[str] | None = None,
    as_of: datetime.date | None = None,
    landing_dir: str | None = None,
) -> dict[str, int]:
    """Write the relationship tables for the given codes, or for all observed codes; return row counts."""
    landing = landing_dir or scratch_path(spark, "policies")
    tables = land_policy_tables(spark, coverage_dir, landing)
    if procedure_codes is None:
        stats = derived_path(derived_dir, "procedure_stats")
        if not exists(spark, stats):
            raise FileNotFoundError(f"Missing procedure summary: {stats}. Build the utilization tables first.")
        codes = coverage.code_set(spark.read.parquet(stats))
    else:
        codes = coverage.code_list(spark, procedure_codes)
    day = None if as_of is None else F.lit(as_of)
    results = {
        "policy_matches": (coverage.match_rows(tables, codes, day), coverage.finish_matches),
        "icd10_relationships": (coverage.icd10_lists(tables, codes), coverage.finish_icd10),
        "ncd_relationships": (coverage.ncd_rows(tables, codes), coverage.finish_ncd),
    }
    counts = {}
    for name, (df, finish) in results.items():
        table, _, cluster = OUTPUTS[name]
        counts[f"{table}.parquet"] = write_table(df, derived_path(derived_dir, table), cluster_by=cluster, finish=finish)
    if landing_dir is None:
        drop_dir(spark, landing)
    return counts


def load_local_coverage_details(spark: SparkSession, procedure_code: str, derived_dir: str) -> dict[str, DataFrame]:
    """The rows of one code; a table that was never built is empty."""
    details = {}
    for name, (table, columns, _) in OUTPUTS.items():
        path = derived_path(derived_dir, table)
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        whole = spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
        details[name] = coverage.for_code(whole, procedure_code)
    return details
