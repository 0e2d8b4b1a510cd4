"""Column names: renaming, required columns, semantic types and type rules by name."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimspark.functions import fixed


def source_type_for(file_name: str) -> str:
    """Source type of a known input file; the name is matched without regard to case."""
    base = file_name.replace("\\", "/").rsplit("/", 1)[-1]
    try:
        return fixed.SOURCE_TYPE_BY_FILE[base.lower()]
    except KeyError:
        raise ValueError(f"Unsupported CMS source file: {base}") from None


def source_type_column(file_name: Column) -> Column:
    """The same lookup for a column of file names or paths; unknown names give NULL."""
    pairs = [F.lit(x) for item in fixed.SOURCE_TYPE_BY_FILE.items() for x in item]
    base = F.lower(F.regexp_extract(file_name, r"([^/\\]+)$", 1))
    return F.try_element_at(F.create_map(*pairs), base)


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def validate_columns(df: DataFrame, required: Iterable[str], what: str = "claim") -> None:
    """Raise when required columns are absent, naming them in order."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"Missing required {what} columns: {', '.join(missing)}")


def standard_name(source_type: str, source_column: str) -> str | None:
    """Standard name of a known column or of a member of a numbered family, whatever its number."""
    if source_type not in fixed.COLUMN_NAMES:
        raise ValueError(f"Unsupported CMS source type: {source_type}")
    known = fixed.COLUMN_NAMES[source_type].get(source_column)
    if known:
        return known
    for prefix, standard in fixed.NUMBERED_FAMILIES.items():
        number = source_column.removeprefix(prefix)
        if number != source_column and re.fullmatch(r"\d+", number):
            return standard + number
    return None


def standardize_columns(df: DataFrame, source_type: str) -> DataFrame:
    """Rename known source columns and keep every other column as it is."""
    names = {c: standard_name(source_type, c) for c in df.columns}
    validate_columns(df, fixed.REQUIRED_COLUMNS[source_type], source_type)
    return df.withColumnsRenamed({c: name for c, name in names.items() if name})


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def canonical_column(source_type: str, source_column: str) -> str:
    """Standard name of one source column; unknown columns are lower-cased."""
    return standard_name(source_type, source_column) or source_column.lower()


def is_date_name(name: str) -> bool:
    return name.endswith(fixed.DATE_SUFFIX) or name in fixed.DATE_NAMES


def is_number_name(name: str) -> bool:
    return name.endswith(tuple(fixed.NUMBER_SUFFIXES)) or name in fixed.NUMBER_NAMES


def is_code_column(source_column: str) -> bool:
    """Source columns whose cells are checked for stray outer white space."""
    name = source_column.upper()
    return name == "REV_CNTR" or name.endswith("_CD") or "HCPCS" in name or "ICD_" in name


def semantic_type_column(source_column: Column, standard_column: Column) -> Column:
    """``date`` / ``numeric`` / ``identifier_or_code`` / ``text_or_category`` by name."""
    number_suffix = "|".join(s.upper() for s in fixed.NUMBER_SUFFIXES)
    lowered = F.lower(standard_column)
    return (
        F.when(source_column.endswith(fixed.DATE_SUFFIX.upper()) | standard_column.isin(fixed.DATE_NAMES), "date")
        .when(
            source_column.rlike(f"({number_suffix})$") | standard_column.isin(fixed.NUMBER_NAMES), "numeric"
        )
        .when(
            F.contains(lowered, F.lit("code"))
            | lowered.rlike("(_id|_npi|_cd)$")
            | source_column.endswith("_CD"),
            "identifier_or_code",
        )
        .otherwise("text_or_category")
    )


def data_dictionary(spark: SparkSession, sources: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """One row per source column of every file; ``sources`` is file -> (source type, header)."""
    rows = [
        (file_name, source_type, position, column, canonical_column(source_type, column))
        for file_name, (source_type, header) in sources.items()
        for position, column in enumerate(header)
    ]
    schema = "source_file string, source_type string, position int, source_column string, standardized_column string"
    return describe_columns(spark.createDataFrame(rows, schema)).orderBy("source_file", "position").drop("position")


def describe_columns(columns: DataFrame) -> DataFrame:
    """Add semantic type, description and definition link to a table of column names."""
    descriptions = F.create_map(*[F.lit(x) for item in fixed.COLUMN_DESCRIPTIONS.items() for x in item])
    codebooks = F.create_map(*[F.lit(x) for item in fixed.CODEBOOK_URL.items() for x in item])
    base_name = F.regexp_replace("standardized_column", r"_\d+$", "")
    return columns.withColumns(
        {
            "semantic_type": semantic_type_column(F.col("source_column"), F.col("standardized_column")),
            "description": F.coalesce(
                F.try_element_at(descriptions, base_name), F.lit(fixed.DEFAULT_DESCRIPTION)
            ),
            "definition_source_url": F.try_element_at(codebooks, F.col("source_type")),
        }
    )
