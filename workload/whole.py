"""Whole outputs of operators whose older queries show only a part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimspark.operators import policy_index
from workload import adapter as a
from workload.sql_lines import CODE, LINES


def normalized_outpatient(spark: SparkSession, sf: str) -> DataFrame:
    return a.processed_claims(a.claim_base(spark, sf), "outpatient")


def normalized_inpatient(spark: SparkSession, sf: str) -> DataFrame:
    return a.processed_claims(a.claim_base(spark, sf), "inpatient")


def policy_index_search_all(spark: SparkSession, sf: str) -> DataFrame:
    """All columns of the index records found."""
    index = policy_index.build_policy_index(a.policy_records(spark, sf), "2026-01-01T00:00:00+00:00")
    return policy_index.search_policy_index(index, " EN.1", ["LCD", "Article"])


def policy_codes_listed(spark: SparkSession, sf: str) -> DataFrame:
    """The codes themselves of the policies that list one, in order."""
    found = policy_index.match_policy_codes(a.policy_code_lists(spark, sf), " b7-3 ")
    codes = F.array_sort(F.transform("procedure_codes", lambda c: F.upper(F.trim(c))))
    return found.select("policy_id", F.array_join(codes, "|").alias("procedure_codes"))


QUERIES = {f.__name__: f for f in (normalized_outpatient, normalized_inpatient, policy_index_search_all, policy_codes_listed)}

COMMON = f"""CAST(o_custkey AS VARCHAR) AS bene_id, CASE WHEN l_orderkey % 101 <> 0 THEN CAST(l_orderkey AS VARCHAR) END AS claim_id,
  CASE WHEN l_orderkey % 113 <> 0 THEN CAST(l_shipdate AS DATE) END AS claim_from_date,
  CASE WHEN l_suppkey % 10 <> 0 THEN 'ORG' || CAST(l_suppkey % 7 AS VARCHAR) END AS organization_npi,
  CASE WHEN l_partkey % 97 <> 0 THEN {CODE} END AS hcpcs_code, o_orderpriority AS diagnosis_code_1, l_linestatus || o_orderstatus AS diagnosis_code_2,
  'F' || CAST(l_suppkey AS VARCHAR) AS facility_provider_id"""
INDIVIDUAL = "CASE WHEN l_suppkey % 5 <> 0 THEN CAST(l_suppkey AS VARCHAR) END"


def oracles(suppliers: str, one: str, index: str) -> dict[str, str]:
    return {
        "normalized_outpatient": f"""WITH {LINES} SELECT {COMMON}, {INDIVIDUAL} AS rendering_provider_npi,
            CASE WHEN l_suppkey % 15 = 0 THEN 'AT' || CAST(l_suppkey AS VARCHAR) END AS attending_provider_npi,
            CAST(CAST(l_extendedprice AS DECIMAL(18,4)) AS DOUBLE) AS revenue_center_total_charge FROM base WHERE claim_type = 'outpatient'""",
        "normalized_inpatient": f"""WITH {LINES} SELECT {COMMON}, {INDIVIDUAL} AS attending_provider_npi,
            CASE WHEN l_suppkey % 25 = 0 THEN 'OP' || CAST(l_suppkey AS VARCHAR) END AS operating_provider_npi FROM base WHERE claim_type = 'inpatient'""",
        "policy_index_search_all": f"""SELECT * FROM ({index}) WHERE policy_type IN ('LCD', 'Article')
            AND contains(lower(title || ' ' || policy_id || ' ' || display_id), 'en.1')""",
        "policy_codes_listed": f"""WITH {suppliers} SELECT CAST(s_suppkey AS VARCHAR) AS policy_id, string_agg(procedure_code, '|' ORDER BY procedure_code) AS procedure_codes
            FROM pcodes GROUP BY 1 HAVING bool_or({one})""",
    }
