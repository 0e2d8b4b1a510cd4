"""DuckDB SQL for the registered queries, written against the typed star-schema columns.

The SQL never sees the raw text the Spark side parses, and it compares providers pair by pair, so
it checks the text round trip and the closed-form peer figures independently.
"""

from __future__ import annotations

from claimspark.functions import fixed
from workload import extended, file_layer, jobs, whole as whole_outputs
from workload.sql_lines import CLAIMS, CODE, DEC, KIND, LINES

PROCEDURE_STATS = f"""
pstats AS (
  SELECT procedure_code, '{fixed.CODE_SYSTEM}' AS code_system,
    {CLAIMS} AS claim_count,
    count(DISTINCT bene_id) AS unique_beneficiaries,
    count(DISTINCT provider_id) AS unique_providers,
    CAST(sum(amount) AS DOUBLE) AS total_allowed,
    CAST(sum(amount) AS DOUBLE) / count(amount) AS average_allowed,
    median(CAST(amount AS DOUBLE)) AS median_allowed,
    count(amount) AS allowed_amount_claims,
    min(service_date) AS first_service_date,
    max(service_date) AS last_service_date,
    count(DISTINCT place_of_service_code) AS unique_places_of_service,
    '{fixed.ALLOWED_SCOPE}' AS allowed_amount_scope
  FROM coded GROUP BY procedure_code
), dstats AS (
  SELECT procedure_code, count(DISTINCT diagnosis_code) AS unique_diagnoses FROM exploded GROUP BY 1
), procedures AS (SELECT p.*, coalesce(d.unique_diagnoses, 0) AS unique_diagnoses FROM pstats p LEFT JOIN dstats d USING (procedure_code))
"""
DIAGNOSES = f"""
diagnoses AS (
  SELECT e.procedure_code, diagnosis_code, e.claim_count, beneficiary_count, provider_count,
    100.0::DOUBLE * e.claim_count / t.n AS percentage_of_procedure_claims
  FROM (SELECT procedure_code, diagnosis_code, {CLAIMS} AS claim_count, count(DISTINCT bene_id) AS beneficiary_count,
          count(DISTINCT provider_id) AS provider_count FROM exploded GROUP BY 1, 2) e
  JOIN (SELECT procedure_code, {CLAIMS} AS n FROM coded GROUP BY 1) t USING (procedure_code)
)
"""
PROVIDERS = f"""
providers AS (
  SELECT provider_id, {KIND} AS provider_id_type, procedure_code, {CLAIMS} AS claim_count,
    count(DISTINCT bene_id) AS beneficiary_count, CAST(sum(amount) AS DOUBLE) AS total_allowed,
    CAST({CLAIMS} AS DOUBLE) / nullif(count(DISTINCT bene_id), 0) AS procedure_rate,
    '{fixed.RATE_BASIS}' AS procedure_rate_basis
  FROM coded WHERE provider_id IS NOT NULL GROUP BY ALL
)
"""
PLACES = f"""
places AS (
  SELECT p.procedure_code, place_of_service_code, claim_count, beneficiary_count,
    100.0::DOUBLE * claim_count / n AS percentage_of_carrier_procedure_claims, '{fixed.PLACE_SCOPE}' AS data_scope
  FROM (SELECT procedure_code, place_of_service_code, {CLAIMS} AS claim_count, count(DISTINCT bene_id) AS beneficiary_count
        FROM coded WHERE claim_type = 'carrier' AND place_of_service_code IS NOT NULL GROUP BY 1, 2) p
  JOIN (SELECT procedure_code, {CLAIMS} AS n FROM coded WHERE claim_type = 'carrier' GROUP BY 1) t USING (procedure_code)
)
"""
TRENDS = f"""
trends AS (
  SELECT procedure_code, CAST(date_trunc('month', service_date) AS DATE) AS service_month, {CLAIMS} AS claim_count,
    count(DISTINCT bene_id) AS beneficiary_count
  FROM coded WHERE service_date IS NOT NULL GROUP BY 1, 2
)
"""


def quantile(values: str, count: str, q: float) -> str:
    """Interpolated quantile of a sorted list."""
    p = f"(({count} - 1) * {q}::DOUBLE)"
    low, high = f"{values}[CAST(floor({p}) AS BIGINT) + 1]", f"{values}[CAST(ceil({p}) AS BIGINT) + 1]"
    w = f"({p} - floor({p}))"
    return (
        f"CASE WHEN {low} = {high} THEN {low} WHEN {w} = 0.5 THEN ({low} + {high}) / 2 "
        f"WHEN {w} > 0.5 THEN {high} - ({high} - {low}) * (1 - {w}) ELSE {low} + ({high} - {low}) * {w} END"
    )


PEERS = f"""
{PROVIDERS}, pairs AS (
  SELECT a.provider_id, a.provider_id_type, a.procedure_code, a.claim_count, a.beneficiary_count, a.procedure_rate AS rate,
    list_sort(list(b.procedure_rate) FILTER (WHERE b.procedure_rate IS NOT NULL)) AS others,
    count(b.procedure_rate) AS n, count(*) FILTER (WHERE b.procedure_rate <= a.procedure_rate) AS up_to
  FROM providers a LEFT JOIN providers b ON a.procedure_code = b.procedure_code AND a.provider_id <> b.provider_id
  GROUP BY ALL
), compared AS (
  SELECT *, {quantile('others', 'n', 0.5)} AS peer_median, {quantile('others', 'n', 0.9)} AS peer_p90,
    {quantile('others', 'n', 0.95)} AS peer_p95,
    CASE WHEN rate IS NOT NULL AND n > 0 THEN CAST(up_to AS DOUBLE) / n * 100.0::DOUBLE END AS share
  FROM pairs
)
"""
ROUNDED = "CAST(round_even(share * 100, 0) AS DOUBLE) / 100"
COMPARISON = f"""provider_id, procedure_code, rate AS provider_rate, peer_median, peer_p90, peer_p95,
  rate / nullif(peer_median, 0) AS rate_ratio, {ROUNDED} AS percentile, n AS peer_count"""

# --- coverage ------------------------------------------------------------------------------------

SUPPLIERS = """
pol AS (
  SELECT CASE WHEN s_suppkey % 2 = 1 THEN 'LCD' ELSE 'Article' END AS policy_type, CAST(s_suppkey AS VARCHAR) AS policy_id,
    CAST(s_suppkey % 3 + 1 AS VARCHAR) AS policy_version, * FROM supplier JOIN nation ON s_nationkey = n_nationkey
), pcodes AS (
  SELECT DISTINCT l_suppkey AS s_suppkey, procedure_code FROM (SELECT l_suppkey, CASE WHEN l_partkey % 97 <> 0 THEN """ + CODE + """ END AS procedure_code
    FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE procedure_code IS NOT NULL
), prows AS (SELECT pol.*, procedure_code FROM pol JOIN pcodes USING (s_suppkey) WHERE s_suppkey % 13 <> 0)
"""
CONTEXT = f"""
{SUPPLIERS}, links AS (
  SELECT DISTINCT s_suppkey, unnest([s_nationkey, (s_nationkey * (s_suppkey % 2 + 1)) % 25]) AS nk FROM pol WHERE s_suppkey % 7 <> 0
), named AS (
  SELECT s_suppkey, string_agg(n_name, '; ' ORDER BY n_name) AS contractor FROM (
    SELECT DISTINCT s_suppkey, n_name FROM links JOIN nation ON nk = n_nationkey WHERE n_nationkey % 9 <> 0) GROUP BY 1
), area AS (
  SELECT n_nationkey AS nk, n_regionkey AS rk FROM nation WHERE n_nationkey % 4 NOT IN (0, 1)
  UNION SELECT n_nationkey, (n_regionkey + 1) % 5 FROM nation WHERE n_nationkey % 3 <> 0
), served AS (
  SELECT s_suppkey, string_agg(st, ', ' ORDER BY st) AS served FROM (
    SELECT DISTINCT s_suppkey, substr(r_name, 1, 2) AS st FROM links JOIN area USING (nk) JOIN region ON rk = r_regionkey) GROUP BY 1
), context AS (
  SELECT pol.*, coalesce(contractor, '') AS contractor, coalesce(served, substr(r_name, 1, 2)) AS jurisdiction
  FROM pol JOIN region ON n_regionkey = r_regionkey LEFT JOIN named USING (s_suppkey) LEFT JOIN served USING (s_suppkey)
)
"""
URL = "https://www.cms.gov/medicare-coverage-database/view/"
POLICY_URL = (
    f"CASE policy_type WHEN 'LCD' THEN '{URL}lcd.aspx?lcdid=' ELSE '{URL}article.aspx?articleid=' END "
    "|| policy_id || '&ver=' || policy_version"
)
MATCHES = f"""
{CONTEXT}, matches AS (
  SELECT procedure_code, '{fixed.POLICY_CODE_SYSTEM}' AS code_system, policy_type, policy_id,
    CASE policy_type WHEN 'LCD' THEN 'L' ELSE 'A' END || policy_id AS display_id, policy_version, s_name AS title, 'A' AS status,
    CASE policy_type WHEN 'LCD' THEN '2019-01-01' ELSE '2018-05-05' END AS effective_date,
    CASE policy_type WHEN 'LCD' THEN '2031-01-01' ELSE '2032-02-02' END AS retirement_date,
    contractor, jurisdiction, procedure_code AS short_description, '' AS medium_description,
    'Procedure ' || procedure_code AS long_description,
    'HCPCS/CPT code listed in current ' || policy_type || ' code table' AS relationship_type, {POLICY_URL} AS source_url
  FROM context JOIN pcodes USING (s_suppkey) WHERE s_suppkey % 13 <> 0
)
"""


def index_rows(extra: str = "") -> str:
    return f"""
SELECT CASE doc_id % 3 WHEN 0 THEN 'NCD' WHEN 1 THEN 'LCD' ELSE 'Article' END AS policy_type,
  CAST(doc_id AS VARCHAR) AS policy_id, upper(lang) || '.' || CAST(doc_id AS VARCHAR) AS display_id,
  CASE WHEN n_chars % 4 = 0 THEN '' ELSE CAST(n_chars % 4 AS VARCHAR) END AS version,
  coalesce(text, '') AS title, CASE WHEN n_chars % 2 = 0 THEN 'Final' ELSE 'Active' END AS status,
  '' AS effective_date, '' AS retirement_date, '2026-09-24' AS last_updated, coalesce(source, '') AS contractor,
  CASE doc_id % 3 WHEN 0 THEN '{fixed.NATIONAL}' ELSE '' END AS jurisdiction,
  CASE doc_id % 3 WHEN 0 THEN '{URL}ncd.aspx?ncdid=' || CAST(doc_id AS VARCHAR)
    || CASE WHEN n_chars % 4 = 0 THEN '' ELSE '&ncdver=' || CAST(n_chars % 4 AS VARCHAR) END
    ELSE 'https://example.org/' || CAST(doc_id AS VARCHAR) END AS source_url,
  '{fixed.POLICY_INDEX_HOST}' || CASE doc_id % 3 WHEN 0 THEN '{fixed.POLICY_INDEX_PATHS["NCD"]}'
    WHEN 1 THEN '{fixed.POLICY_INDEX_PATHS["LCD"]}' ELSE '{fixed.POLICY_INDEX_PATHS["Article"]}' END AS api_endpoint,
  '2026-01-01T00:00:00+00:00' AS fetched_at, '{fixed.INDEX_RELATIONSHIP}' AS relationship_status
FROM documents {extra}"""


# --- descriptions and evidence -----------------------------------------------------------------------

DESCRIPTIONS = f"""
first_source AS (
  SELECT {CODE} AS code, arg_max(p_name || ' ' || p_type, (-(p_partkey % 3 + 1)) * 1000000000 + p_partkey) AS d
  FROM part WHERE p_size % 8 <> 0 GROUP BY 1
), second_source AS (
  SELECT {CODE} AS code, arg_max(p_type, (-(p_partkey % 3 + 1)) * 1000000000 + p_partkey) AS d
  FROM part WHERE p_brand <> 'Brand#1' GROUP BY 1
), described AS (
  SELECT procedure_code, coalesce(f.d, s.d) AS description FROM (SELECT DISTINCT procedure_code FROM coded)
  LEFT JOIN first_source f ON f.code = procedure_code LEFT JOIN second_source s ON s.code = procedure_code
)
"""
EVIDENCE = f"""
{LINES}, {PROCEDURE_STATS}, {DESCRIPTIONS}, {MATCHES}, first_rows AS (
  SELECT *, row_number() OVER (PARTITION BY procedure_code ORDER BY policy_type DESC, display_id, policy_id, policy_version) AS place
  FROM matches QUALIFY place <= 5
), cited AS (
  SELECT procedure_code, string_agg('- ' || policy_type || ' ' || display_id || ': ' || title, chr(10) ORDER BY place) AS cited_lines,
    string_agg(source_url, chr(10) ORDER BY place) AS links, min(policy_type) FILTER (WHERE place = 1) AS first_type,
    min(display_id) FILTER (WHERE place = 1) AS first_id
  FROM first_rows GROUP BY 1
), context_rows AS (
  SELECT p.*, description, cited_lines, links, first_type, first_id FROM procedures p
  LEFT JOIN described USING (procedure_code) LEFT JOIN cited USING (procedure_code)
)
"""


def sql_text(value: str) -> str:
    parts = ["'" + p.replace("'", "''") + "'" for p in value.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")"


def whole(value: str) -> str:
    return f"format('{{:,}}', {value})"


def decimals(value: str) -> str:
    return f"coalesce(format('{{:,.2f}}', {value}), 'not available')"


# --- raw text profile -----------------------------------------------------------------------------

# Standard name -> condition under which the typed cell is NULL, on the base rows, per claim type.
COMMON_NULLS = {
    "bene_id": "false",
    "claim_id": "l_orderkey % 101 = 0",
    "claim_from_date": "l_orderkey % 113 = 0",
    "organization_npi": "l_suppkey % 10 = 0",
    "hcpcs_code": "l_partkey % 97 = 0",
    "diagnosis_code_1": "false",
    "diagnosis_code_2": "false",
}
NULLS = {
    "carrier": COMMON_NULLS | {
        "rendering_provider_npi": "l_suppkey % 5 = 0",
        "place_of_service_code": "l_partkey % 11 = 0",
        "line_diagnosis_code": "false",
        "line_allowed_charge": "l_orderkey % 127 = 0",
    },
    "outpatient": COMMON_NULLS | {
        "facility_provider_id": "false",
        "rendering_provider_npi": "l_suppkey % 5 = 0",
        "attending_provider_npi": "l_suppkey % 15 <> 0",
        "revenue_center_total_charge": "false",
    },
    "inpatient": COMMON_NULLS | {
        "facility_provider_id": "false",
        "attending_provider_npi": "l_suppkey % 5 = 0",
        "operating_provider_npi": "l_suppkey % 25 <> 0",
    },
}
FILE = "claim_type || '_' || l_returnflag || '.csv'"


def per_file(kind: str, select: str) -> str:
    return f"SELECT {FILE} AS source_file, {select} FROM base WHERE claim_type = '{kind}' GROUP BY 1"


def union(parts) -> str:
    return " UNION ALL ".join(parts)


QUALITY_NULLS = f"WITH {LINES} " + union(
    per_file(
        kind,
        f"'{field}' AS field, count(*) FILTER (WHERE {condition}) AS null_count, "
        f"CAST(round_even(CAST(100 * count(*) FILTER (WHERE {condition}) AS DECIMAL(38,18)) / count(*), 4) AS DOUBLE) AS null_percentage",
    )
    for kind, fields in NULLS.items()
    for field, condition in fields.items()
)
CODE_COLUMNS = {
    "carrier": ["HCPCS_CD", "ICD_DGNS_CD1", "ICD_DGNS_CD2", "LINE_PLACE_OF_SRVC_CD", "LINE_ICD_DGNS_CD"],
    "outpatient": ["HCPCS_CD", "ICD_DGNS_CD1", "ICD_DGNS_CD2"],
    "inpatient": ["HCPCS_CD", "ICD_DGNS_CD1", "ICD_DGNS_CD2"],
}
QUALITY_FAILURES = f"WITH {LINES} " + union(
    [per_file(k, "'date_parse_failures' AS metric, '' AS field, count(*) FILTER (WHERE l_orderkey % 113 = 0) AS rows") for k in NULLS]
    + [per_file("carrier", "'numeric_parse_failures' AS metric, '' AS field, count(*) FILTER (WHERE l_orderkey % 127 = 0) AS rows")]
    + [per_file("outpatient", "'numeric_parse_failures' AS metric, '' AS field, 0::BIGINT AS rows")]
    + [
        per_file(
            kind,
            f"'code_whitespace_rows' AS metric, '{c}' AS field, "
            + ("count(*) FILTER (WHERE l_partkey % 97 <> 0)" if c == "HCPCS_CD" else "0::BIGINT") + " AS rows",
        )
        for kind, columns in CODE_COLUMNS.items()
        for c in columns
    ]
)

BENEFICIARIES = """
bene AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_custkey AS VARCHAR) AS bene_id,
    CASE WHEN c_custkey % 31 <> 0 THEN CAST(DATE '1930-01-01' + CAST(c_custkey % 9000 AS INTEGER) AS DATE) END AS birth_date,
    CAST(year(o_orderdate) - year(DATE '1930-01-01' + CAST(c_custkey % 9000 AS INTEGER)) AS DOUBLE) AS age_at_end_of_year,
    c_mktsegment AS sex_code, CAST(c_nationkey AS VARCHAR) AS race_code,
    'beneficiary_' || CAST(year(o_orderdate) AS VARCHAR) || '.csv' AS source_file
  FROM orders JOIN customer ON o_custkey = c_custkey
)
"""
BENEFICIARY_FIELDS = ["year", "bene_id", "birth_date", "age_at_end_of_year", "sex_code", "race_code"]
_shares = union(
    f"""SELECT source_file, 'null_count' AS metric, '{f}' AS field, CAST(count(*) - count({f}) AS VARCHAR) AS value FROM bene GROUP BY 1
    UNION ALL SELECT source_file, 'null_percentage', '{f}', CAST(CAST(round_even(CAST(100 * (count(*) - count({f})) AS DECIMAL(38,18)) / count(*), 4) AS DOUBLE) AS VARCHAR)
    FROM bene GROUP BY 1"""
    for f in BENEFICIARY_FIELDS
)
QUALITY_REPORT = f"""WITH {BENEFICIARIES}, rows AS ({_shares}
  UNION ALL SELECT DISTINCT source_file, 'file_exists', '', 'True' FROM bene
  UNION ALL SELECT DISTINCT source_file, 'required_columns_present', '', 'True' FROM bene
  UNION ALL SELECT DISTINCT source_file, 'column_count', '', '5' FROM bene
  UNION ALL SELECT source_file, 'row_count', '', CAST(count(*) AS VARCHAR) FROM bene GROUP BY 1
  UNION ALL SELECT source_file, 'duplicate_rows', '', CAST(count(*) - count(DISTINCT bene_id) AS VARCHAR) FROM bene GROUP BY 1
  UNION ALL SELECT source_file, 'date_min', 'birth_date', CAST(min(birth_date) AS VARCHAR) FROM bene GROUP BY 1
  UNION ALL SELECT source_file, 'date_max', 'birth_date', CAST(max(birth_date) AS VARCHAR) FROM bene GROUP BY 1
  UNION ALL SELECT DISTINCT source_file, 'date_parse_failures', '', '0' FROM bene
  UNION ALL SELECT DISTINCT source_file, 'numeric_parse_failures', '', '0' FROM bene
  UNION ALL SELECT source_file, 'code_whitespace_rows', 'SEX_IDENT_CD', CAST(count(*) AS VARCHAR) FROM bene GROUP BY 1
  UNION ALL SELECT DISTINCT source_file, 'code_whitespace_rows', 'BENE_RACE_CD', '0' FROM bene)
SELECT source_file, 'beneficiary' AS source_type, metric, field, value FROM rows"""

# Raw column, standard column, semantic type.
COMMON_COLUMNS = [
    ("BENE_ID", "bene_id", "identifier_or_code"), ("CLM_ID", "claim_id", "identifier_or_code"),
    ("CLM_FROM_DT", "claim_from_date", "date"), ("ORG_NPI_NUM", "organization_npi", "identifier_or_code"),
    ("HCPCS_CD", "hcpcs_code", "identifier_or_code"), ("ICD_DGNS_CD1", "diagnosis_code_1", "identifier_or_code"),
    ("ICD_DGNS_CD2", "diagnosis_code_2", "identifier_or_code"),
]
OWN_COLUMNS = {
    "carrier": [
        ("PRF_PHYSN_NPI", "rendering_provider_npi", "identifier_or_code"),
        ("LINE_PLACE_OF_SRVC_CD", "place_of_service_code", "identifier_or_code"),
        ("LINE_ICD_DGNS_CD", "line_diagnosis_code", "identifier_or_code"),
        ("LINE_ALOWD_CHRG_AMT", "line_allowed_charge", "numeric"),
    ],
    "outpatient": [
        ("PRVDR_NUM", "facility_provider_id", "identifier_or_code"),
        ("RNDRNG_PHYSN_NPI", "rendering_provider_npi", "identifier_or_code"),
        ("AT_PHYSN_NPI", "attending_provider_npi", "identifier_or_code"),
        ("REV_CNTR_TOT_CHRG_AMT", "revenue_center_total_charge", "numeric"),
    ],
    "inpatient": [
        ("PRVDR_NUM", "facility_provider_id", "identifier_or_code"),
        ("AT_PHYSN_NPI", "attending_provider_npi", "identifier_or_code"),
        ("OP_PHYSN_NPI", "operating_provider_npi", "identifier_or_code"),
    ],
}


def _description(standard: str) -> str:
    base = standard.rstrip("0123456789").rstrip("_") if standard[-1].isdigit() else standard
    return fixed.COLUMN_DESCRIPTIONS.get(base, fixed.DEFAULT_DESCRIPTION)


DATA_DICTIONARY = f"WITH {LINES} " + union(
    f"SELECT DISTINCT {FILE} AS source_file, '{kind}' AS source_type, '{raw}' AS source_column, '{std}' AS standardized_column, "
    f"'{semantic}' AS semantic_type, {sql_text(_description(std))} AS description, '{fixed.CODEBOOK_URL[kind]}' AS definition_source_url "
    f"FROM base WHERE claim_type = '{kind}'"
    for kind, own in OWN_COLUMNS.items()
    for raw, std, semantic in COMMON_COLUMNS + own
)

WITH_LINES = f"WITH {LINES}"
ONE = "procedure_code = 'B7-3'"

ORACLES = {
    "procedure_stats": f"{WITH_LINES}, {PROCEDURE_STATS} SELECT * FROM procedures",
    "procedure_lines": f"""{WITH_LINES} SELECT claim_type, '{fixed.CODE_SYSTEM}' AS code_system, procedure_code, source_claim_id, bene_id,
        provider_id, {KIND} AS provider_id_type, place_of_service_code, CAST(amount AS DOUBLE) AS allowed_amount, service_date,
        array_to_string(dx, '|') AS diagnosis_codes, claim_type || ':' || coalesce(source_claim_id, 'row') AS claim_key FROM lines""",
    "diagnosis_procedure_stats": f"{WITH_LINES}, {DIAGNOSES} SELECT * FROM diagnoses",
    "provider_procedure_stats": f"{WITH_LINES}, {PROVIDERS} SELECT * FROM providers",
    "pos_procedure_stats": f"{WITH_LINES}, {PLACES} SELECT * FROM places",
    "procedure_trends": f"{WITH_LINES}, {TRENDS} SELECT * FROM trends",
    "procedure_codes": f"{WITH_LINES} SELECT procedure_code, {CLAIMS} AS claim_count FROM coded GROUP BY 1 ORDER BY 2 DESC, 1",
    "diagnoses_per_procedure": f"{WITH_LINES} SELECT procedure_code, count(DISTINCT diagnosis_code) AS unique_diagnoses FROM exploded GROUP BY 1",
    "places_per_procedure": f"""{WITH_LINES} SELECT procedure_code, count(DISTINCT place_of_service_code) AS unique_places_of_service
        FROM coded WHERE place_of_service_code IS NOT NULL GROUP BY 1""",
    "top_diagnoses_per_procedure": f"""{WITH_LINES}, {DIAGNOSES} SELECT *, CAST(row_number() OVER (PARTITION BY procedure_code
        ORDER BY claim_count DESC, diagnosis_code) AS INTEGER) AS rank FROM diagnoses QUALIFY rank <= 20""",
    "top_providers_per_procedure": f"""{WITH_LINES}, {PROVIDERS} SELECT * EXCLUDE (procedure_rate_basis), CAST(row_number() OVER (
        PARTITION BY procedure_code ORDER BY claim_count DESC, provider_id) AS INTEGER) AS rank FROM providers QUALIFY rank <= 20""",
    "procedure_detail_summary": f"{WITH_LINES}, {PROCEDURE_STATS} SELECT * FROM procedures WHERE {ONE}",
    "procedure_detail_diagnoses": f"""{WITH_LINES}, {DIAGNOSES} SELECT * FROM diagnoses WHERE {ONE}
        ORDER BY claim_count DESC, diagnosis_code LIMIT 20""",
    "procedure_detail_providers": f"""{WITH_LINES}, {PROVIDERS} SELECT * FROM providers WHERE {ONE}
        ORDER BY claim_count DESC, provider_id LIMIT 20""",
    "procedure_detail_places": f"{WITH_LINES}, {PLACES} SELECT * FROM places WHERE {ONE}",
    "procedure_detail_trends": f"{WITH_LINES}, {TRENDS} SELECT * FROM trends WHERE {ONE}",
    "summarize_procedures": f"{WITH_LINES} SELECT procedure_code, count(*) AS claim_count FROM lines GROUP BY 1",
    "numeric_features": """SELECT l_returnflag AS group_key, avg(l_quantity) AS l_quantity, avg(l_linenumber) AS l_linenumber
        FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1""",
    "peer_comparison_all": f"{WITH_LINES}, {PEERS} SELECT {COMPARISON} FROM compared",
    "peer_comparison_one": f"{WITH_LINES}, {PEERS}, asked AS (SELECT 'NPI:7' AS provider_id, 'B7-3' AS procedure_code) "
    "SELECT * REPLACE (coalesce(peer_count, 0) AS peer_count) FROM asked LEFT JOIN "
    f"(SELECT {COMPARISON} FROM compared) USING (provider_id, procedure_code)",
    "peer_top25": f"""{WITH_LINES}, {PROVIDERS} SELECT procedure_code, CAST(row_number() OVER (PARTITION BY procedure_code
        ORDER BY procedure_rate DESC NULLS LAST, provider_id) AS INTEGER) AS rank, provider_id, claim_count, beneficiary_count,
        procedure_rate FROM providers QUALIFY rank <= 25""",
    "provider_detail_card": f"""{WITH_LINES}, {PEERS}, card AS (SELECT provider_id, procedure_code, {{cells}} AS cell FROM compared)
        SELECT provider_id, procedure_code, cell.position AS position, cell.metric AS metric, cell.value AS value FROM (
        SELECT provider_id, procedure_code, unnest(cell) AS cell FROM card)""".replace(
        "{cells}",
        "["
        + ", ".join(
            f"{{'position': {i}::INTEGER, 'metric': '{m}', 'value': CAST({v} AS VARCHAR)}}"
            for i, (m, v) in enumerate(
                zip(
                    fixed.DETAIL_METRICS,
                    ["provider_id", "procedure_code", "claim_count", "beneficiary_count", "rate", "peer_median",
                     "peer_p90", "peer_p95", ROUNDED],
                ),
                start=1,
            )
        )
        + "]",
    ),
    "provider_options": f"{WITH_LINES}, {PROVIDERS} SELECT DISTINCT provider_id, procedure_code FROM providers",
    "peer_anomaly_features": f"""{WITH_LINES}, {PEERS}, filled AS (SELECT *, CASE WHEN n > 0 THEN peer_median ELSE rate END AS m FROM compared)
        SELECT provider_id, provider_id_type, procedure_code, claim_count, beneficiary_count, rate AS provider_rate, m AS peer_median,
        rate / nullif(m, 0) AS provider_to_peer_ratio, CASE WHEN rate IS NOT NULL AND n = 0 THEN 100.0::DOUBLE ELSE share END AS peer_percentile
        FROM filled""",
    "normalized_carrier": f"""{WITH_LINES} SELECT CAST(o_custkey AS VARCHAR) AS bene_id,
        CASE WHEN l_orderkey % 101 <> 0 THEN CAST(l_orderkey AS VARCHAR) END AS claim_id,
        CASE WHEN l_orderkey % 113 <> 0 THEN CAST(l_shipdate AS DATE) END AS claim_from_date,
        CASE WHEN l_suppkey % 10 <> 0 THEN 'ORG' || CAST(l_suppkey % 7 AS VARCHAR) END AS organization_npi,
        CASE WHEN l_partkey % 97 <> 0 THEN {CODE} END AS hcpcs_code, o_orderpriority AS diagnosis_code_1,
        l_linestatus || o_orderstatus AS diagnosis_code_2, CASE WHEN l_suppkey % 5 <> 0 THEN CAST(l_suppkey AS VARCHAR) END AS rendering_provider_npi,
        CASE WHEN l_partkey % 11 <> 0 THEN l_returnflag END AS place_of_service_code,
        CASE WHEN l_linestatus = 'F' THEN o_orderpriority ELSE 'LINE' END AS line_diagnosis_code,
        CASE WHEN l_orderkey % 127 <> 0 THEN CAST(CAST(l_extendedprice * (1 - l_discount) AS {DEC}) AS DOUBLE) END AS line_allowed_charge
        FROM base WHERE claim_type = 'carrier'""",
    "date_normalisation": """SELECT l_orderkey, CASE WHEN l_orderkey % 17 = 0 OR l_orderkey % 19 = 0 THEN NULL
        ELSE CAST(l_shipdate AS DATE) END AS parsed_date FROM lineitem""",
    "numeric_normalisation": """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 2 THEN -v WHEN 3 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 10 AS DOUBLE)
        WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE v END AS price_amt
        FROM (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS v FROM orders)""",
    "hcpcs_normalisation": f"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN 'B' || CAST(p_partkey AS VARCHAR)
        WHEN 3 THEN 'C' || CAST(p_partkey AS VARCHAR) || '.0' WHEN 4 THEN {CODE} END AS code FROM part""",
    "icd10_normalisation": "SELECT o_orderkey, upper(o_orderpriority) || '.' AS code FROM orders",
    "quality_nulls": QUALITY_NULLS,
    "quality_date_bounds": f"{WITH_LINES} "
    + union(
        per_file(
            k,
            "'claim_from_date' AS field, min(CASE WHEN l_orderkey % 113 <> 0 THEN CAST(l_shipdate AS DATE) END) AS date_min, "
            "max(CASE WHEN l_orderkey % 113 <> 0 THEN CAST(l_shipdate AS DATE) END) AS date_max",
        )
        for k in NULLS
    ),
    "quality_parse_failures": QUALITY_FAILURES,
    "quality_duplicates": f"WITH {BENEFICIARIES} SELECT source_file, count(*) - count(DISTINCT bene_id) AS duplicate_rows FROM bene GROUP BY 1",
    "quality_report_long": QUALITY_REPORT,
    "beneficiary_union_years": f"WITH {BENEFICIARIES} SELECT * EXCLUDE (source_file) FROM bene",
    "data_dictionary": DATA_DICTIONARY,
    "coverage_policy_matches": f"WITH {MATCHES} SELECT * FROM matches",
    "coverage_policy_context": f"""WITH {CONTEXT} SELECT DISTINCT policy_id, CASE WHEN s_suppkey % 13 = 0 THEN '9' ELSE policy_version END AS policy_version,
        CASE WHEN s_suppkey % 13 = 0 THEN '' ELSE contractor END AS contractor,
        CASE WHEN s_suppkey % 13 = 0 THEN '' ELSE jurisdiction END AS jurisdiction, policy_type
        FROM context JOIN pcodes USING (s_suppkey)""",
    "coverage_icd10_relationships": f"""WITH {SUPPLIERS}, dx AS (
        SELECT DISTINCT l_suppkey AS s_suppkey, o_orderpriority, l_returnflag = 'A' AS covered FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT procedure_code, policy_id, policy_version, s_name AS policy_title, o_orderpriority AS icd10_code,
        CASE WHEN covered THEN 'covered ' ELSE 'noncovered ' END || o_orderpriority AS icd10_description,
        CASE WHEN covered THEN '{fixed.DIAGNOSIS_COVERED}' ELSE '{fixed.DIAGNOSIS_NONCOVERED}' END AS code_relationship, {POLICY_URL} AS source_url
        FROM prows JOIN dx USING (s_suppkey) WHERE policy_type = 'Article'""",
    "coverage_ncd_relationships": f"""WITH {SUPPLIERS} SELECT procedure_code, policy_type AS source_policy_type, policy_id AS source_policy_id,
        policy_version AS source_policy_version, '' AS source_policy_title, 'NCD' AS related_policy_type, CAST(r_regionkey AS VARCHAR) AS related_policy_id,
        '1' AS related_policy_version, r_name AS related_policy_title, '2017-07-07' AS effective_date,
        'NCD listed as related to this ' || policy_type AS relationship_type,
        '{URL}ncd.aspx?ncdid=' || CAST(r_regionkey AS VARCHAR) || '&ncdver=1' AS source_url
        FROM prows JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 0""",
    "coverage_details_for_code": f"WITH {MATCHES} SELECT procedure_code, policy_type, policy_id, policy_version, title, jurisdiction FROM matches WHERE {ONE}",
    "policy_index_normalised": index_rows(),
    "policy_index_search": f"""SELECT policy_type, policy_id, display_id, title FROM ({index_rows()}) WHERE policy_type IN ('LCD', 'Article')
        AND contains(lower(title || ' ' || policy_id || ' ' || display_id), 'en.1')""",
    "policy_index_from_json": f"""SELECT 'NCD' AS policy_type, CAST(event_id AS VARCHAR) AS policy_id, '' AS display_id,
        json_extract_string(props, '$.k') AS version, event_type AS title, '' AS status, '' AS effective_date, '' AS retirement_date,
        '' AS last_updated, '' AS contractor, '{fixed.NATIONAL}' AS jurisdiction,
        '{URL}ncd.aspx?ncdid=' || CAST(event_id AS VARCHAR) || '&ncdver=' || json_extract_string(props, '$.k') AS source_url,
        '{fixed.POLICY_INDEX_HOST}{fixed.POLICY_INDEX_PATHS["NCD"]}' AS api_endpoint, '2026-01-01' AS fetched_at,
        '{fixed.INDEX_RELATIONSHIP}' AS relationship_status FROM events""",
    "policy_code_match": f"""WITH {SUPPLIERS} SELECT CAST(s_suppkey AS VARCHAR) AS policy_id, count(*) AS listed_codes FROM pcodes
        GROUP BY 1 HAVING bool_or({ONE})""",
    "policy_code_match_all": f"WITH {SUPPLIERS} SELECT CAST(s_suppkey AS VARCHAR) AS policy_id, procedure_code FROM pcodes",
    "description_lookup": f"{WITH_LINES}, {DESCRIPTIONS} SELECT * FROM described",
    "explanation_prompt": f"""WITH {EVIDENCE} SELECT procedure_code, {sql_text(fixed.PROMPT_RULES)} || 'Procedure summary:' || chr(10) || 'Procedure code: '
        || procedure_code || chr(10) || 'Description: ' || coalesce(description, 'not available') || chr(10) || 'Claim count: ' || {whole('claim_count')}
        || chr(10) || chr(10) || 'Provider/peer summary:' || chr(10) || '{fixed.NO_PROVIDER_NOTE}' || chr(10) || chr(10)
        || 'Anomaly summary:' || chr(10) || '{fixed.ANOMALY_NOTE}' || chr(10) || chr(10)
        || 'Coverage evidence:' || chr(10) || coalesce(cited_lines, '{fixed.NO_COVERAGE_ROWS}') AS prompt,
        '{fixed.EXPLANATION_MODEL}' AS model FROM context_rows""",
    "explanation_text": f"""WITH {EVIDENCE}, {PEERS} SELECT c.provider_id, procedure_code,
        'Observed facts: Observed data for ' || procedure_code || ' show ' || {whole('r.claim_count')} || ' claims and '
        || {whole('unique_beneficiaries')} || ' unique beneficiaries in the local synthetic dataset. The local records describe this service as: '
        || coalesce(description, '{fixed.NO_DESCRIPTION}') || '. The local code summary includes ' || {whole('unique_diagnoses')}
        || ' diagnosis associations. ' || CASE WHEN rate IS NOT NULL AND peer_median IS NOT NULL THEN
        'For the selected provider, the observed rate is ' || {decimals('rate')} || ' versus a peer median of ' || {decimals('peer_median')}
        || '; the rate ratio is ' || {decimals('rate / nullif(peer_median, 0)')} || ' and the peer percentile is ' || {decimals(ROUNDED)} || 'th.'
        WHEN rate IS NOT NULL THEN 'The selected provider''s rate is ' || {decimals('rate')} || ' in the local peer comparison.' ELSE '' END || ' '
        || CASE WHEN first_id IS NOT NULL THEN 'Coverage evidence indicates a relevant ' || first_type || ' entry (' || first_id || ') {fixed.COVERAGE_CAVEAT}'
        ELSE '{fixed.NO_COVERAGE_TEXT}' END || ' ' || {sql_text(fixed.EXPLANATION_CLOSING)} AS explanation,
        {sql_text(fixed.LIMITATIONS)} AS limitations FROM compared c JOIN context_rows r USING (procedure_code)""",
    "evidence_links": f"WITH {EVIDENCE} SELECT procedure_code, coalesce(links, '') AS sources FROM context_rows",
}

ORACLES |= extended.ORACLES
ORACLES["anomaly_categories"] = extended.anomaly_categories_sql(ORACLES["peer_anomaly_features"])
ORACLES["peer_groups"] = f"""{WITH_LINES}, {PROVIDERS}, places AS (
      SELECT provider_id, place_of_service_code AS main_place FROM lines WHERE provider_id IS NOT NULL AND place_of_service_code IS NOT NULL
      GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY provider_id ORDER BY count(*) DESC, place_of_service_code) = 1
    ), pairs AS (SELECT provider_id, provider_id_type, procedure_code, claim_count, beneficiary_count, main_place FROM providers LEFT JOIN places USING (provider_id)),
    peers AS ({' UNION ALL '.join(
        f"SELECT x.provider_id, x.procedure_code, {n} AS peer_level, '{', '.join(level)}' AS peer_group, count(*) AS peers, "
        "CAST(sum(y.claim_count) AS DOUBLE) / nullif(sum(y.beneficiary_count), 0) AS peer_rate FROM pairs x JOIN pairs y ON (x.provider_id <> y.provider_id) AND "
        + " AND ".join(f"x.{c} IS NOT DISTINCT FROM y.{c}" for c in level) + " GROUP BY 1, 2 HAVING count(*) >= 5"
        for n, level in enumerate(extended.PEER_LEVELS))}),
    best AS (SELECT DISTINCT ON (provider_id, procedure_code) * FROM peers ORDER BY provider_id, procedure_code, peer_level)
    SELECT p.*, CAST(peer_level AS INTEGER) AS peer_level, peer_group, peers, peer_rate,
      CASE WHEN peer_rate > 0 AND beneficiary_count > 0 THEN CAST(claim_count AS DOUBLE) / beneficiary_count / peer_rate END AS rate_ratio
    FROM pairs p LEFT JOIN best USING (provider_id, procedure_code)"""
ORACLES |= {f.__name__: ORACLES[same] for f, same in file_layer.SAME_AS.items()}
ORACLES |= jobs.oracles(ORACLES)
ORACLES |= whole_outputs.oracles(SUPPLIERS, ONE, index_rows())


def _forest_sql(trees: int = 100, per_tree: int = 256, seed: int = 42, depth_limit: int = 8) -> str:
    """CTEs that end in ``scored``: the forest drawn from the same digests, one CTE per depth.

    A row is followed through every tree; its path is the depth of its leaf plus the expected rest.
    """
    features = ["provider_rate", "peer_median", "provider_to_peer_ratio", "peer_percentile", "claim_count"]
    wanted = trees * per_tree
    rest = "CASE WHEN n <= 1 THEN 0.0 WHEN n = 2 THEN 1.0 ELSE 2.0 * (ln(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n END"

    def digest(what: str, digits: int) -> str:
        return f"('0x' || substr(md5('{seed}|' || tree || '|' || node || '|{what}'), 1, {digits}))::BIGINT"

    values = [f"coalesce(CAST({f} AS DOUBLE), 0.0)" for f in features]
    pick = "list_extract([x1, x2, x3, x4, x5], feature)"
    steps = [f"""base AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY md5('{seed}|' || provider_id || '|' || procedure_code), provider_id, procedure_code) - 1 AS r,
            {', '.join(f'{v} AS x{i}' for i, v in enumerate(values, 1))} FROM ({ORACLES['peer_anomaly_features']})),
        many AS (SELECT least(count(*), {wanted}) AS n FROM base),
        slots AS (SELECT x1, x2, x3, x4, x5, unnest(range(r, {wanted}, many.n)) AS slot FROM base, many WHERE r < many.n),
        s0 AS MATERIALIZED (SELECT slot // {per_tree} AS tree, 1 AS node, x1, x2, x3, x4, x5 FROM slots, many WHERE slot % {per_tree} < many.n)"""]
    for d in range(depth_limit + 1):
        bounds = ", ".join(f"min(x{i}) AS lo{i}, max(x{i}) AS hi{i}" for i in range(1, 6))
        varying = "[" + ", ".join(f"CASE WHEN hi{i} > lo{i} THEN {i} END" for i in range(1, 6)) + "]"
        lows, highs = (f"[{', '.join(f'{side}{i}' for i in range(1, 6))}]" for side in ("lo", "hi"))
        steps.append(f"""g{d} AS (SELECT tree, node, count(*) AS n, {bounds} FROM s{d} GROUP BY tree, node),
        v{d} AS (SELECT *, list_filter({varying}, lambda i: i IS NOT NULL) AS varying FROM g{d}),
        f{d} AS (SELECT *, CASE WHEN n > 1 AND len(varying) > 0 AND {d} < {depth_limit} THEN list_extract(varying, {digest('feature', 8)} % len(varying) + 1) END AS feature FROM v{d}),
        n{d} AS MATERIALIZED (SELECT tree, node, feature, {d} + {rest} AS path,
            list_extract({lows}, feature) + {digest('threshold', 13)} / CAST(4503599627370496 AS DOUBLE) * (list_extract({highs}, feature) - list_extract({lows}, feature)) AS threshold FROM f{d})""")
        if d < depth_limit:
            steps.append(f"""s{d + 1} AS MATERIALIZED (SELECT s.tree, 2 * s.node + CASE WHEN {pick} <= threshold THEN 0 ELSE 1 END AS node, x1, x2, x3, x4, x5
            FROM s{d} s JOIN n{d} USING (tree, node) WHERE feature IS NOT NULL)""")
    steps.append(f"points AS MATERIALIZED (SELECT DISTINCT x1, x2, x3, x4, x5 FROM base), w0 AS (SELECT x1, x2, x3, x4, x5, unnest(range({trees})) AS tree, 1 AS node FROM points)")
    for d in range(depth_limit + 1):
        step = f"CASE WHEN {pick.replace('feature', 'n.feature')} <= n.threshold THEN 0 ELSE 1 END"
        inner = "" if d == 0 else "WHERE w.feature IS NOT NULL"
        steps.append(f"w{d + 1} AS MATERIALIZED (SELECT x1, x2, x3, x4, x5, w.tree, 2 * w.node + {step} AS node, n.feature, n.path FROM w{d} w JOIN n{d} n ON n.tree = w.tree AND n.node = w.node {inner})")
    ends = " UNION ALL ".join(f"SELECT x1, x2, x3, x4, x5, path FROM w{d + 1} WHERE feature IS NULL" for d in range(depth_limit + 1))
    steps.append(f"""ends AS ({ends}), depths AS (SELECT x1, x2, x3, x4, x5, avg(path) AS depth FROM ends GROUP BY ALL),
        size AS (SELECT least({per_tree}, n) AS n FROM many),
        scored AS (SELECT b.*, round(pow(2.0, -depth / (SELECT {rest} FROM size)), 9) AS anomaly_score FROM base b JOIN depths USING (x1, x2, x3, x4, x5))""")
    return "WITH " + ",\n        ".join(steps)


ORACLES |= {
    "isolation_forest_scores": _forest_sql() + """
        SELECT provider_id, provider_id_type, procedure_code, claim_count, beneficiary_count, provider_rate, peer_median,
               provider_to_peer_ratio, peer_percentile, anomaly_score, anomaly_score > 0.5 AS anomaly_flag FROM scored""",
    "investigation_queue": _forest_sql() + """
        SELECT provider_id, procedure_code, provider_rate, peer_median, provider_to_peer_ratio, peer_percentile, anomaly_score, anomaly_score > 0.5 AS anomaly_flag
        FROM scored WHERE anomaly_score > 0.5 OR peer_percentile >= 90
        ORDER BY anomaly_score DESC, provider_to_peer_ratio DESC NULLS LAST, provider_id, procedure_code LIMIT 25""",
}
