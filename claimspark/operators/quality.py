"""Profile of raw claim files: missing cells, date bounds, unreadable cells, duplicate rows.

All counts of a file come from one aggregation over the raw text. The functions take a raw table
with a column that names the source file; the remaining columns are the file's own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from claimspark.functions.names import (
    canonical_column, is_code_column, is_date_name, is_number_name, missing_columns,
)
from claimspark.functions.fixed import REQUIRED_COLUMNS
from claimspark.functions.text import clean_text
from claimspark.operators.normalize import typed_value

FILE = "source_file"
REPORT_COLUMNS = ["source_file", "source_type", "metric", "field", "value"]


@dataclass(frozen=True)
class Metric:
    """One aggregate: its report name, the field it describes and the expression."""

    metric: str
    field: str
    value: Column

    @property
    def alias(self) -> str:
        return f"{self.metric}:{self.field}"


def source_columns(df: DataFrame) -> list[str]:
    """The file's own columns: all but the file name, the yearly tag and reader metadata."""
    return [c for c in df.columns if c not in (FILE, "year") and not c.startswith("_")]


def _standard_names(df: DataFrame, source_type: str) -> dict[str, str]:
    return {c: canonical_column(source_type, c) for c in source_columns(df)}


def _is_parsed(name: str) -> bool:
    return is_date_name(name) or is_number_name(name)


def profile_columns(df: DataFrame, source_type: str) -> DataFrame:
    """Typed columns plus what the profile needs: the text of parsed cells, stray white space flags."""
    names = _standard_names(df, source_type)
    tags = [c for c in (FILE, "year") if c in df.columns]
    stripped = df.select(
        *tags,
        *[clean_text(F.col(c)).alias(n) for c, n in names.items()],
        *[F.col(c).alias(f"_raw_{c}") for c in filter(is_code_column, names)],
    )
    return stripped.select(
        *tags,
        *[typed_value(n, F.col(n)).alias(n) for n in names.values()],
        *[F.col(n).alias(f"_text_{n}") for n in names.values() if _is_parsed(n)],
        *[(F.col(n) != F.col(f"_raw_{c}")).alias(f"_stray_{c}") for c, n in names.items() if is_code_column(c)],
    )


def quality_metrics(df: DataFrame, source_type: str) -> list[Metric]:
    """Aggregates over ``profile_columns(df)``; no distinct counts, so they also work with ``observe``."""
    names = _standard_names(df, source_type)
    dates = [n for n in names.values() if is_date_name(n)]
    numbers = [n for n in names.values() if is_number_name(n) and n not in dates]
    tags = ["year"] if "year" in df.columns else []
    metrics = [Metric("row_count", "", F.count(F.lit(1)))]
    metrics += [Metric("null_count", n, F.count_if(F.col(n).isNull())) for n in (*tags, *names.values())]
    for n in dates:
        metrics.append(Metric("date_min", n, F.min(n)))
        metrics.append(Metric("date_max", n, F.max(n)))
    for metric, columns in (("date_parse_failures", dates), ("numeric_parse_failures", numbers)):
        if columns:
            failed = [(F.col(f"_text_{n}").isNotNull() & F.col(n).isNull()).cast("long") for n in columns]
            metrics.append(Metric(metric, "", F.coalesce(F.sum(sum(failed[1:], failed[0])), F.lit(0))))
    metrics += [
        Metric("code_whitespace_rows", c, F.count_if(F.col(f"_stray_{c}"))) for c in names if is_code_column(c)
    ]
    return metrics


def wide_profile(df: DataFrame, source_type: str) -> DataFrame:
    """One row per source file with every aggregate as a column."""
    aggregates = [m.value.alias(m.alias) for m in quality_metrics(df, source_type)]
    return profile_columns(df, source_type).groupBy(FILE).agg(*aggregates)


def row_fingerprint(df: DataFrame) -> list[Column]:
    """Two independent 64-bit hashes of the raw row; the position of a NULL cell counts."""

    def hashed(seed: int) -> Column:
        parts = [p for i, c in enumerate(source_columns(df)) for p in (F.lit(seed + i), F.col(c))]
        return F.xxhash64(*parts)

    return [hashed(0).alias("_row_a"), hashed(1_000_000).alias("_row_b")]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """``source_file, duplicate_rows``: rows beyond the first of each distinct raw row.

    Sixteen bytes per row are shuffled instead of the row, after counting repeats on the map side.
    """
    counts = df.select(FILE, *row_fingerprint(df)).groupBy(FILE, "_row_a", "_row_b").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(FILE).agg(F.sum(F.col("n") - 1).alias("duplicate_rows"))


def percent_text(part: Column, total: Column) -> Column:
    """Share in percent, four decimals, written with at least one decimal."""
    share = F.bround(F.try_divide(F.lit(100.0) * part, total), 4)
    return F.regexp_replace(share.cast("decimal(10,4)").cast("string"), r"(\.\d+?)0+$", "$1")


def long_report(profile: DataFrame, df: DataFrame, source_type: str) -> DataFrame:
    """Long form of ``wide_profile`` (plus any of ``duplicate_rows, file_size_bytes`` present).

    ``df`` is only asked for its column names.
    """
    metrics = quality_metrics(df, source_type)
    total = F.col("`row_count:`")
    truth = {True: "True", False: "False"}

    def row(metric: str, field: str, value: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), F.lit(field).alias("field"), value.cast("string").alias("value"))

    rows = [
        row("file_exists", "", F.lit("True")),
        row("row_count", "", total),
        row("column_count", "", F.lit(len(source_columns(df)))),
        row("required_columns_present", "", F.lit(truth[not missing_columns(df, REQUIRED_COLUMNS[source_type])])),
    ]
    rows += [row(extra, "", F.col(extra)) for extra in ("duplicate_rows", "file_size_bytes") if extra in profile.columns]
    for m in metrics:
        value = F.col(f"`{m.alias}`")
        if m.metric == "row_count":
            continue
        rows.append(row(m.metric, m.field, value))
        if m.metric == "null_count":
            rows.append(row("null_percentage", m.field, percent_text(value, total)))
    report = profile.select(FILE, F.lit(source_type).alias("source_type"), F.inline(F.array(*rows)))
    return report.filter(F.col("value").isNotNull()).select(*REPORT_COLUMNS)


def quality_report(df: DataFrame, source_type: str, file_sizes: DataFrame | None = None) -> DataFrame:
    """The full long-form report of one source; ``file_sizes`` is ``source_file, file_size_bytes``."""
    profile = wide_profile(df, source_type).join(duplicate_rows(df), FILE, "left")
    if file_sizes is not None:
        profile = profile.join(file_sizes.select(FILE, "file_size_bytes"), FILE, "left")
    return long_report(profile, df, source_type)


def null_counts(df: DataFrame, source_type: str) -> DataFrame:
    """``source_file, field, null_count, null_percentage`` for every typed column."""
    profile = wide_profile(df, source_type)
    total = F.col("`row_count:`")
    cells = [
        F.struct(
            F.lit(m.field).alias("field"),
            F.col(f"`{m.alias}`").alias("null_count"),
            F.bround(F.try_divide(F.lit(100.0) * F.col(f"`{m.alias}`"), total), 4).alias("null_percentage"),
        )
        for m in quality_metrics(df, source_type)
        if m.metric == "null_count"
    ]
    return profile.select(FILE, F.inline(F.array(*cells)))


def date_bounds(df: DataFrame, source_type: str) -> DataFrame:
    """``source_file, field, date_min, date_max`` for the date columns that hold a date."""
    fields = [n for n in _standard_names(df, source_type).values() if is_date_name(n)]
    profile = wide_profile(df, source_type)
    cells = [
        F.struct(
            F.lit(n).alias("field"),
            F.col(f"`date_min:{n}`").alias("date_min"),
            F.col(f"`date_max:{n}`").alias("date_max"),
        )
        for n in fields
    ]
    return profile.select(FILE, F.inline(F.array(*cells))).filter(F.col("date_min").isNotNull())


def cell_problems(df: DataFrame, source_type: str) -> DataFrame:
    """``source_file, metric, field, rows``: unreadable dates and numbers, stray white space in codes."""
    wanted = ("date_parse_failures", "numeric_parse_failures", "code_whitespace_rows")
    cells = [
        F.struct(F.lit(m.metric).alias("metric"), F.lit(m.field).alias("field"), F.col(f"`{m.alias}`").cast("long").alias("rows"))
        for m in quality_metrics(df, source_type)
        if m.metric in wanted
    ]
    return wide_profile(df, source_type).select(FILE, F.inline(F.array(*cells)))
