"""The claim-line model: one row per claim line with resolved provider, codes and claim key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from claimspark.functions import fixed
from claimspark.functions.text import nullable_text

CLAIM_LINE_COLUMNS = [
    "claim_type", "code_system", "procedure_code", "source_claim_id", "bene_id", "provider_id",
    "provider_id_type", "place_of_service_code", "allowed_amount", "service_date", "diagnosis_codes",
    "claim_key",
]


def resolve_provider(df: DataFrame, claim_type: str) -> tuple[Column, Column]:
    """First known identifier of the claim type's list, prefixed with its type; and that type."""
    none = F.lit(None).cast("string")
    choices = [(F.col(c), kind) for c, kind in fixed.PROVIDER_COLUMNS[claim_type] if c in df.columns]
    provider = F.coalesce(*[F.concat(F.lit(kind + ":"), value) for value, kind in choices], none)
    kind = F.coalesce(*[F.when(value.isNotNull(), F.lit(kind)) for value, kind in choices], none)
    return provider, kind


def _diagnosis_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("diagnosis_code_") or c == "line_diagnosis_code"]


def diagnosis_list(df: DataFrame) -> Column:
    """Distinct known diagnosis codes of a line, in column order."""
    columns = _diagnosis_columns(df)
    if not columns:
        return F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.array(*columns)))


def _known_columns(df: DataFrame, claim_type: str) -> DataFrame:
    """The columns a claim line needs, text stripped and blank as NULL, absent ones as typed NULL."""
    is_carrier = claim_type == "carrier"
    columns = set(df.columns)
    text = ["hcpcs_code", "claim_id", "bene_id", "place_of_service_code", *_diagnosis_columns(df)]
    text += [c for c, _ in fixed.PROVIDER_COLUMNS[claim_type] if c in columns]

    def cast_or_null(name: str, kind: str, wanted: bool = True) -> Column:
        known = wanted and name in columns
        return (F.col(name).try_cast(kind) if known else F.lit(None).cast(kind)).alias(name)

    return df.select(
        *[nullable_text(df, c).alias(c) for c in text],
        cast_or_null("line_allowed_charge", "double", is_carrier),
        cast_or_null("claim_from_date", "date"),
    )


def claim_lines(df: DataFrame, claim_type: str) -> DataFrame:
    """Claim lines of one standardised source. Amount and place of service exist for carrier only.

    A line without a claim id gets a key of its own. Such keys are only good for telling
    lines apart: ``operators.utilization`` counts those lines instead of their keys, so no
    result depends on how ids were handed out.
    """
    known = _known_columns(df, claim_type)
    provider_id, provider_type = resolve_provider(known, claim_type)
    row_key = F.concat(F.lit(f"{claim_type}:row:"), F.monotonically_increasing_id().cast("string"))
    place = F.col("place_of_service_code") if claim_type == "carrier" else F.lit(None).cast("string")
    return known.select(
        F.lit(claim_type).alias("claim_type"),
        F.lit(fixed.CODE_SYSTEM).alias("code_system"),
        F.col("hcpcs_code").alias("procedure_code"),
        F.col("claim_id").alias("source_claim_id"),
        "bene_id",
        provider_id.alias("provider_id"),
        provider_type.alias("provider_id_type"),
        place.alias("place_of_service_code"),
        F.col("line_allowed_charge").alias("allowed_amount"),
        F.col("claim_from_date").alias("service_date"),
        diagnosis_list(known).alias("diagnosis_codes"),
        F.coalesce(F.concat(F.lit(f"{claim_type}:"), "claim_id"), row_key).alias("claim_key"),
    )


def combine_claim_lines(sources: dict[str, DataFrame]) -> DataFrame:
    """All lines of the given sources (claim type -> standardised table)."""
    return reduce(DataFrame.unionByName, [claim_lines(df, kind) for kind, df in sources.items()])


def lines_with_code(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("procedure_code").isNotNull() & (F.col("procedure_code") != ""))
