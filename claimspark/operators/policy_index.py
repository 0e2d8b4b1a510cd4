"""The public policy index: one 15-column row per national or local policy document."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from claimspark.functions import fixed
from claimspark.functions.text import col_or_default, first_non_blank, policy_url, strip
from claimspark.operators.joins import salted_join

INDEX_COLUMNS = [
    "policy_type", "policy_id", "display_id", "version", "title", "status", "effective_date",
    "retirement_date", "last_updated", "contractor", "jurisdiction", "source_url", "api_endpoint",
    "fetched_at", "relationship_status",
]


def normalize_policy_records(records: DataFrame, policy_type: str, fetched_at: Column | str) -> DataFrame:
    """Index rows of one policy type from its summary records; absent values become ''."""

    def text(*names: str) -> Column:
        return first_non_blank(*[col_or_default(records, n) for n in names])

    policy_id, version = text("document_id"), text("document_version")
    given_url = text("url")
    url = given_url
    if policy_type == "NCD":
        url = F.when(policy_id != "", policy_url(F.lit("NCD"), policy_id, version)).otherwise(given_url)
    when = F.lit(fetched_at) if isinstance(fetched_at, str) else fetched_at
    return records.select(
        F.lit(policy_type).alias("policy_type"),
        policy_id.alias("policy_id"),
        text("document_display_id").alias("display_id"),
        version.alias("version"),
        text("title").alias("title"),
        text("document_status", "status").alias("status"),
        text("effective_date").alias("effective_date"),
        text("retirement_date").alias("retirement_date"),
        text("last_updated", "updated_on").alias("last_updated"),
        text("contractor_name_type").alias("contractor"),
        F.lit(fixed.NATIONAL if policy_type == "NCD" else "").alias("jurisdiction"),
        url.alias("source_url"),
        F.lit(fixed.POLICY_INDEX_HOST + fixed.POLICY_INDEX_PATHS[policy_type]).alias("api_endpoint"),
        when.alias("fetched_at"),
        F.lit(fixed.INDEX_RELATIONSHIP).alias("relationship_status"),
    )


def build_policy_index(records: dict[str, DataFrame], fetched_at: Column | str) -> DataFrame:
    """NCD, LCD and Article records in one index."""
    parts = [normalize_policy_records(records[k], k, fetched_at) for k in fixed.POLICY_INDEX_PATHS if k in records]
    return reduce(DataFrame.unionByName, parts)


def search_policy_index(index: DataFrame, query: str = "", policy_types: Sequence[str] | None = None) -> DataFrame:
    """Type filter, then literal text search in title and identifiers without regard to case."""
    found = index
    if policy_types:
        found = found.filter(F.col("policy_type").isin(list(policy_types)))
    wanted = query.strip()
    if wanted:
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("title", "policy_id", "display_id")]
        found = found.filter(F.contains(F.lower(F.concat_ws(" ", *parts)), F.lower(F.lit(wanted))))
    return found


def match_policy_codes(policies: DataFrame, procedure_code: str, codes: str = "procedure_codes") -> DataFrame:
    """Policies whose code list holds the code exactly, after trimming and upper-casing both."""
    return policies.filter(F.array_contains(_normal_codes(codes), procedure_code.strip().upper()))


def match_policies_to_codes(
    policies: DataFrame, wanted: DataFrame, codes: str = "procedure_codes", policy: str = "policy_id"
) -> DataFrame:
    """All (policy, wanted code) matches at once, as an equi-join on the listed codes."""
    listed = policies.withColumn("procedure_code", F.explode(F.array_distinct(_normal_codes(codes))))
    return salted_join(listed, wanted.select("procedure_code").distinct(), ["procedure_code"], by=[policy])


def _normal_codes(codes: str) -> Column:
    return F.transform(F.col(codes), lambda c: F.upper(strip(c.cast("string"))))
