"""SQL of the claim lines behind the test tables, shared by the SQL of all queries."""

from __future__ import annotations

CODE = "replace(p_brand, 'Brand#', 'B') || '-' || CAST(p_size % 8 AS VARCHAR)"
DEC = "DECIMAL(18,4)"

LINES = f"""
base AS (
  SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'carrier' WHEN 1 THEN 'outpatient' ELSE 'inpatient' END AS claim_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
), lines AS (
  SELECT claim_type,
    CASE WHEN l_partkey % 97 <> 0 THEN {CODE} END AS procedure_code,
    CASE WHEN l_orderkey % 101 <> 0 THEN CAST(l_orderkey AS VARCHAR) END AS source_claim_id,
    CAST(o_custkey AS VARCHAR) AS bene_id,
    CASE WHEN l_suppkey % 5 <> 0 THEN 'NPI:' || CAST(l_suppkey AS VARCHAR)
         WHEN claim_type = 'outpatient' AND l_suppkey % 15 = 0 THEN 'NPI:AT' || CAST(l_suppkey AS VARCHAR)
         WHEN claim_type = 'inpatient' AND l_suppkey % 25 = 0 THEN 'NPI:OP' || CAST(l_suppkey AS VARCHAR)
         WHEN l_suppkey % 10 <> 0 THEN 'NPI:ORG' || CAST(l_suppkey % 7 AS VARCHAR)
         WHEN claim_type <> 'carrier' THEN 'CMS_PROVIDER_NUMBER:F' || CAST(l_suppkey AS VARCHAR) END AS provider_id,
    CASE WHEN claim_type = 'carrier' AND l_partkey % 11 <> 0 THEN l_returnflag END AS place_of_service_code,
    CASE WHEN claim_type = 'carrier' AND l_orderkey % 127 <> 0
         THEN CAST(l_extendedprice * (1 - l_discount) AS {DEC}) END AS amount,
    CASE WHEN l_orderkey % 113 <> 0 THEN CAST(l_shipdate AS DATE) END AS service_date,
    CASE WHEN claim_type = 'carrier' AND l_linestatus <> 'F'
         THEN [o_orderpriority, l_linestatus || o_orderstatus, 'LINE']
         ELSE [o_orderpriority, l_linestatus || o_orderstatus] END AS dx
  FROM base
), coded AS (SELECT * FROM lines WHERE procedure_code IS NOT NULL),
exploded AS (SELECT * EXCLUDE (dx), unnest(dx) AS diagnosis_code FROM coded)
"""
CLAIMS = "count(DISTINCT claim_type || ':' || source_claim_id) + count(*) FILTER (WHERE source_claim_id IS NULL)"
KIND = "split_part(provider_id, ':', 1)"
