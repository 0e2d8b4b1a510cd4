"""Ingest job: raw claim files -> typed Parquet tables, source manifest, dictionary and quality report."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from claimspark.functions import fixed, names
from claimspark.operators import quality
from claimspark.session import scratch_path, settings
from claimspark.sources import files
from claimspark.sources.archives import land_csv_member
from claimspark.sources.paths import drop_dir, replace_dir
from claimspark.sources.sinks import write_csv

MANIFEST = (
    "source string, file string, source_url string, collection_url string, download_date string, "
    "release_date string, row_count long, file_size_bytes long, sha256 string, processed_file string"
)


def output_name(source_type: str) -> str:
    return "beneficiaries.parquet" if source_type == "beneficiary" else f"{source_type}.parquet"


def _open_source(spark: SparkSession, path: str, name: str, landing: str) -> DataFrame:
    """Raw text of one input file with ``source_file`` (and ``year`` for yearly files)."""
    if name.lower().endswith(".zip"):
        path = land_csv_member(spark, path, fixed.ARCHIVE_MEMBER.get(name.lower()), f"{landing}/{name}")
    raw = files.read_delimited(spark, path)
    if fixed.SOURCE_TYPE_BY_FILE[name] == "beneficiary":
        return files.with_year(raw)
    return raw.withColumn("source_file", F.lit(name))


def _typed_schema(df: DataFrame, source_type: str) -> list[str]:
    years = ["year"] if "year" in df.columns else []
    return years + [names.canonical_column(source_type, c) for c in quality.source_columns(df)]


def _write_profiled(df: DataFrame, source_type: str, staged: str) -> dict:
    """Append the typed rows to ``staged``; the profile is collected by the same pass."""
    measured = Observation()
    metrics = [m.value.alias(m.alias) for m in quality.quality_metrics(df, source_type)]
    profiled = quality.profile_columns(df, source_type).observe(measured, *metrics)
    profiled.select(*_typed_schema(df, source_type)).write.mode("append").parquet(staged)
    return measured.get


def _one_row(spark: SparkSession, values: dict, df: DataFrame, source_type: str) -> DataFrame:
    """The measured values in the layout of ``quality.wide_profile``."""
    kinds = {m.alias: "date" if m.metric in ("date_min", "date_max") else "long" for m in quality.quality_metrics(df, source_type)}
    kinds |= {"source_file": "string", "duplicate_rows": "long", "file_size_bytes": "long"}
    schema = ", ".join(f"`{name}` {kinds[name]}" for name in values)
    return spark.createDataFrame([tuple(values.values())], schema)


def run_ingest(
    spark: SparkSession,
    raw_dir: str,
    data_dir: str,
    download_date: str = "",
    release_date: str = "",
    max_partition_bytes: int | None = None,
) -> dict[str, int]:
    """Ingest every expected file; nothing in ``data_dir`` changes unless all of them succeed."""
    if max_partition_bytes is not None and max_partition_bytes <= 0:
        raise ValueError("max_partition_bytes must be greater than zero")
    files.require_iso_date("download_date", download_date)
    files.require_iso_date("release_date", release_date)
    expected = list(fixed.SOURCE_TYPE_BY_FILE)
    files.require_inputs(spark, raw_dir, expected)
    splits = {"spark_sql_files_maxPartitionBytes": max_partition_bytes} if max_partition_bytes else {}
    with settings(spark, **splits):
        return _ingest(spark, raw_dir, data_dir, download_date, release_date, expected)


def _ingest(spark: SparkSession, raw_dir: str, data_dir: str, download_date: str, release_date: str, expected: list[str]) -> dict[str, int]:
    root, data = raw_dir.rstrip("/"), data_dir.rstrip("/")
    listing = files.discover_data_files(spark, raw_dir).filter(F.col("name").isin(expected))
    facts = {r["source_file"]: r for r in files.file_facts(listing).collect()}
    landing = scratch_path(spark, "claim-files")
    staged = {output_name(t): f"{data}/processed/.{output_name(t)}-{uuid.uuid4().hex}" for t in fixed.COLUMN_NAMES}
    schemas: dict[str, list[str]] = {}
    headers, row_counts, manifest, reports = {}, {}, [], []
    try:
        for name, source_type in fixed.SOURCE_TYPE_BY_FILE.items():
            raw = _open_source(spark, f"{root}/{name}", name, landing)
            missing = names.missing_columns(raw, fixed.REQUIRED_COLUMNS[source_type])
            if missing:
                raise ValueError(f"{name} is missing required columns: {', '.join(missing)}")
            headers[name] = (source_type, quality.source_columns(raw))
            target = output_name(source_type)
            schema = _typed_schema(raw, source_type)
            if schemas.setdefault(target, schema) != schema:
                raise ValueError(f"Inconsistent standardized schema while appending {name}.")
            measured = _write_profiled(raw, source_type, staged[target])
            if not measured["row_count:"]:
                raise ValueError(f"No data rows found in {name}.")
            row_counts[name] = measured["row_count:"]
            repeats = quality.duplicate_rows(raw).first()["duplicate_rows"]
            size = facts[name]["file_size_bytes"]
            values = {"source_file": name, **measured, "duplicate_rows": repeats, "file_size_bytes": size}
            reports.append(quality.long_report(_one_row(spark, values, raw, source_type), raw, source_type))
            manifest.append(
                (
                    fixed.SOURCE_LABEL, name, fixed.SOURCE_URL_BY_FILE[name], fixed.COLLECTION_URL, download_date,
                    release_date, row_counts[name], size, facts[name]["sha256"], target,
                )
            )
        for target, path in staged.items():
            replace_dir(spark, path, f"{data}/processed/{target}")
    except Exception:
        for path in staged.values():
            drop_dir(spark, path)
        raise
    finally:
        drop_dir(spark, landing)

    report = reports[0]
    for part in reports[1:]:
        report = report.unionByName(part)
    write_csv(spark.createDataFrame(manifest, MANIFEST).coalesce(1), f"{data}/source_manifest.csv")
    write_csv(names.data_dictionary(spark, headers).coalesce(1), f"{data}/data_dictionary.csv")
    write_csv(report.coalesce(1), f"{data}/reports/data_quality_report.csv")
    return row_counts
