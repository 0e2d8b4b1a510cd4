"""Claim file discovery and scans. Text stays text: no schema is ever inferred."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from claimspark.functions import fixed
from claimspark.functions.names import canonical_column, source_type_for, standardize_columns
from claimspark.sources import archives
from claimspark.sources.paths import base_name, exists, one_task_each, open_stream

LISTING = "path string, modificationTime timestamp, length long"
BAD_RECORD = "_corrupt_record"


def list_files(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    """``path, name, length, modificationTime`` of files whose lower-case name matches; contents stay unread."""
    if not exists(spark, directory):
        return spark.createDataFrame([], LISTING).withColumn("name", F.lit(None).cast("string"))
    files = spark.read.format("binaryFile").load(directory).select("path", "modificationTime", "length")
    name = F.url_decode(F.regexp_extract("path", r"([^/]+)$", 1))
    return files.withColumn("name", name).filter(F.lower("name").rlike(pattern))


def discover_data_files(spark: SparkSession, directory: str) -> DataFrame:
    """CSV, Parquet and ZIP files of a folder in path order; an absent folder gives no rows."""
    return list_files(spark, directory, r"\.(csv|parquet|zip)$").orderBy("path")


def header(spark: SparkSession, path: str, delimiter: str = "|") -> list[str]:
    """Column names in the first line of a delimited file."""
    return spark.read.csv(path, sep=delimiter, header=True, escape='"').columns


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    delimiter: str = "|",
    columns: list[str] | None = None,
    multi_line: bool = False,
    bad_rows: str = "fail",
) -> DataFrame:
    """All-text scan; blank cells are NULL. Splits of the scan take the place of chunks.

    ``bad_rows="fail"`` stops on rows with a wrong number of cells; ``"keep"`` puts their text into
    ``_corrupt_record``. The header of every file must equal the first file's. The size of the splits belongs to
    the session; see ``session.settings`` for a change that ends with the job.
    """
    first = path if isinstance(path, str) else path[0]
    columns = columns or header(spark, first, delimiter)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    options = {"sep": delimiter, "header": True, "escape": '"', "multiLine": multi_line, "enforceSchema": False}
    if bad_rows == "keep":
        schema = schema.add(BAD_RECORD, T.StringType())
        options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_RECORD, "enforceSchema": True}
    else:
        options |= {"mode": "FAILFAST"}
    return spark.read.schema(schema).options(**options).csv(path)


def missing_tokens_to_null(df: DataFrame) -> DataFrame:
    """Turn the usual texts for a missing value into NULL (exact match, as the whole-file reader does)."""
    return df.select(*[F.when(~F.col(c).isin(fixed.MISSING_TOKENS), F.col(c)).alias(c) for c in df.columns])


def load_table(
    spark: SparkSession,
    path: str | list[str],
    delimiter: str = "|",
    zip_member: str | None = None,
    missing_tokens: bool = True,
    landing_dir: str | None = None,
) -> DataFrame:
    """One CSV, Parquet or zipped CSV table; any other suffix is an error.

    A list of files with one suffix and header is one table; ZIPs give one member each, landed in a task of their own.
    """
    paths = [path] if isinstance(path, str) else path
    suffixes = {("." + base_name(p).rsplit(".", 1)[-1].lower()) if "." in base_name(p) else "" for p in paths}
    if len(suffixes) != 1:
        raise ValueError(f"Parts of a table need one data format: {sorted(suffixes)}")
    (suffix,) = suffixes
    if suffix == ".parquet":
        return spark.read.parquet(*paths)
    if suffix == ".zip":
        paths = archives.land_csv_members(spark, paths, zip_member, landing_dir)
    elif suffix != ".csv":
        raise ValueError(f"Unsupported data format: {suffix}")
    table = read_delimited(spark, paths, delimiter)
    return missing_tokens_to_null(table) if missing_tokens else table


def scan_claim_file(
    spark: SparkSession,
    path: str,
    delimiter: str = "|",
    zip_member: str | None = None,
    landing_dir: str | None = None,
) -> DataFrame:
    """Partitioned text scan of a CSV or zipped CSV; only blank cells become NULL."""
    lowered = path.lower()
    if lowered.endswith(".zip"):
        path = archives.land_csv_member(spark, path, zip_member, landing_dir)
    elif not lowered.endswith(".csv"):
        raise ValueError(f"Chunked input must be CSV or ZIP: {base_name(path)}")
    return read_delimited(spark, path, delimiter)


def load_source(spark: SparkSession, path: str, landing_dir: str | None = None) -> DataFrame:
    """A known claim file with standard column names."""
    source_type = source_type_for(path)
    member = fixed.ARCHIVE_MEMBER.get(base_name(path).lower())
    return standardize_columns(load_table(spark, path, zip_member=member, landing_dir=landing_dir), source_type)


def scan_yearly_files(spark: SparkSession, paths: list[str], source_type: str = "beneficiary") -> DataFrame:
    """Yearly files as one raw table: ``year`` from the file name first, then ``source_file`` last.

    All headers must agree after standardising, whatever the column order.
    """
    headers = {p: header(spark, p) for p in paths}
    first = {canonical_column(source_type, c) for c in headers[paths[0]]}
    for path, columns in headers.items():
        if {canonical_column(source_type, c) for c in columns} != first:
            raise ValueError(f"Inconsistent standardized schema while appending {base_name(path)}.")
    by_header: dict[tuple, list[str]] = {}
    for path, columns in headers.items():
        by_header.setdefault(tuple(columns), []).append(path)
    parts = [with_year(read_delimited(spark, group, columns=list(c))) for c, group in by_header.items()]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def with_source_file(df: DataFrame) -> DataFrame:
    return df.withColumn("source_file", F.col("_metadata.file_name"))


def with_year(df: DataFrame) -> DataFrame:
    """``year`` as the first column, from a file name such as ``name_2019.csv``."""
    named = with_source_file(df)
    year = F.regexp_extract("source_file", r"_(\d+)\.[^.]*$", 1).cast("int")
    return named.select(year.alias("year"), *df.columns, "source_file")


def require_inputs(spark: SparkSession, directory: str, names: list[str], what: str = "CMS sources") -> None:
    """Every expected file must exist before any job starts."""
    missing = [n for n in names if not exists(spark, f"{directory.rstrip('/')}/{n}")]
    if missing:
        raise FileNotFoundError(f"Missing expected {what}: " + ", ".join(missing))


def require_iso_date(label: str, value: str) -> None:
    if value:
        try:
            date.fromisoformat(value)
        except ValueError as error:
            raise ValueError(f"{label} must use YYYY-MM-DD format") from error


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    """First rows with every column as text."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).limit(rows)


def file_hashes(files: DataFrame) -> DataFrame:
    """``path, sha256`` per file; each file is streamed in blocks by one task, whatever its size."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["path"]:
                state = hashlib.sha256()
                with open_stream(path) as stream:
                    while block := stream.read(1 << 20):
                        state.update(block)
                out.append((path, state.hexdigest()))
            yield pd.DataFrame(out, columns=["path", "sha256"])

    return one_task_each(files.select("path"), "path").mapInPandas(digest, "path string, sha256 string")


def file_facts(files: DataFrame) -> DataFrame:
    """``source_file, source_type, file_size_bytes, sha256`` for a listing of files."""
    from claimspark.functions.names import source_type_column

    return files.join(file_hashes(files), "path").select(
        F.col("name").alias("source_file"),
        source_type_column(F.col("name")).alias("source_type"),
        F.col("length").alias("file_size_bytes"),
        "sha256",
    )
