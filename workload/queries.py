"""Registered queries: every library operator over the whole star-schema tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimspark.functions import names, text
from claimspark.operators import (
    anomaly, coverage, descriptions, evidence, peers, policy_index, quality, utilization,
)
from claimspark.operators.claim_lines import lines_with_code
from claimspark.operators.normalize import type_columns
from claimspark.sources import files
from workload import adapter as a, extended, file_layer, jobs, staging, whole




# --- utilization -----------------------------------------------------------------------------


def procedure_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Claim lines from raw text; the per-row part of keys of lines without a claim id is cut off."""
    return a.lines(spark, sf).withColumns(
        {
            "diagnosis_codes": F.array_join("diagnosis_codes", "|"),
            "claim_key": F.regexp_replace("claim_key", r":row:\d+$", ":row"),
        }
    )


def procedure_stats(spark, sf):
    return utilization.procedure_stats(staging.lines(spark, sf))


def diagnosis_procedure_stats(spark, sf):
    return utilization.diagnosis_procedure_stats(staging.lines(spark, sf))


def provider_procedure_stats(spark, sf):
    return utilization.provider_procedure_stats(staging.lines(spark, sf))


def pos_procedure_stats(spark, sf):
    return utilization.pos_procedure_stats(staging.lines(spark, sf))


def procedure_trends(spark, sf):
    return utilization.procedure_trends(staging.lines(spark, sf))


def procedure_codes(spark, sf):
    totals = utilization.claims_per_procedure(staging.lines(spark, sf))
    return utilization.procedure_codes(totals.withColumnRenamed("procedure_claims", "claim_count"))


def diagnoses_per_procedure(spark, sf):
    return utilization.diagnoses_per_procedure(staging.lines(spark, sf))


def places_per_procedure(spark, sf):
    return utilization.places_per_procedure(staging.lines(spark, sf))


def top_diagnoses_per_procedure(spark, sf):
    return utilization.top_diagnoses(diagnosis_procedure_stats(spark, sf))


def top_providers_per_procedure(spark, sf):
    return utilization.top_providers(provider_procedure_stats(spark, sf).drop("procedure_rate_basis"))


def _details(spark, sf, part: str) -> DataFrame:
    lines = staging.lines(spark, sf)
    tables = {
        name: build(lines)
        for name, build in {
            "procedure_stats": utilization.procedure_stats,
            "diagnosis_procedure_stats": utilization.diagnosis_procedure_stats,
            "provider_procedure_stats": utilization.provider_procedure_stats,
            "pos_procedure_stats": utilization.pos_procedure_stats,
            "procedure_trends": utilization.procedure_trends,
        }.items()
    }
    return utilization.procedure_details(tables, "B7-3")[part]


def procedure_detail_summary(spark, sf):
    return _details(spark, sf, "summary")


def procedure_detail_diagnoses(spark, sf):
    return _details(spark, sf, "diagnoses")


def procedure_detail_providers(spark, sf):
    return _details(spark, sf, "providers")


def procedure_detail_places(spark, sf):
    return _details(spark, sf, "places")


def procedure_detail_trends(spark, sf):
    return _details(spark, sf, "trends")


def summarize_procedures(spark, sf):
    return utilization.summarize_procedures(staging.lines(spark, sf), "procedure_code")


def numeric_features(spark, sf):
    lines = a.table(spark, sf, "lineitem").withColumn("group_key", F.nullif("l_returnflag", F.lit("N")))
    return utilization.numeric_features(lines, "group_key", ["l_quantity", "l_linenumber"])


# --- peers and anomalies ---------------------------------------------------------------------


def peer_comparison_all(spark, sf):
    return peers.peer_comparison_all(staging.provider_stats(spark, sf))


def peer_comparison_one(spark, sf):
    return peers.provider_peer_comparison(staging.provider_stats(spark, sf), "NPI:7", "B7-3")


def peer_top25(spark, sf):
    return peers.peer_list(staging.provider_stats(spark, sf))


def provider_detail_card(spark, sf):
    return peers.provider_detail_card(staging.provider_stats(spark, sf))


def provider_options(spark, sf):
    return peers.provider_procedure_options(staging.provider_stats(spark, sf))


def peer_anomaly_features(spark, sf):
    return anomaly.peer_features(staging.provider_stats(spark, sf))


def _rounded(scores: DataFrame) -> DataFrame:
    """Scores to nine places: two engines add the paths in different orders."""
    return scores.withColumn("anomaly_score", F.round("anomaly_score", 9))


def isolation_forest_scores(spark, sf):
    return _rounded(staging.anomalies(spark, sf))


def investigation_queue(spark, sf):
    return anomaly.investigation_queue(_rounded(staging.anomalies(spark, sf)))


# --- ingest: names, typing, profile ------------------------------------------------------------


def normalized_carrier(spark, sf):
    return a.processed_claims(a.claim_base(spark, sf), "carrier")


def date_normalisation(spark, sf):
    """Four notations, unreadable text and blanks, one row per line item."""
    key, day = F.col("l_orderkey"), F.col("l_shipdate").cast("date")
    raw = (
        F.when(key % 17 == 0, F.lit("garbage"))
        .when(key % 19 == 0, F.lit("  "))
        .otherwise(F.upper(a.date_text(day, key % 4)))
    )
    items = a.table(spark, sf, "lineitem").select("l_orderkey", raw.alias("raw_dt"))
    return type_columns(items, keep=("l_orderkey",)).withColumnRenamed("raw_dt", "parsed_date")


def numeric_normalisation(spark, sf):
    """Commas, blanks, signs, exponents and unreadable text, one row per order."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    plain = price.cast("decimal(18,2)").cast("string")
    raw = (
        F.when(key % 8 == 0, F.format_number(price, 2))
        .when(key % 8 == 1, F.concat(F.lit(" +"), plain))
        .when(key % 8 == 2, F.concat(F.lit("-"), plain, F.lit("\t")))
        .when(key % 8 == 3, F.concat(plain, F.lit("e1")))
        .when(key % 8 == 4, F.concat(plain, F.lit("d")))
        .when(key % 8 == 5, F.lit("nan"))
        .when(key % 8 == 6, F.lit(" "))
        .otherwise(plain)
    )
    items = a.table(spark, sf, "orders").select("o_orderkey", raw.alias("price_amt"))
    return type_columns(items, keep=("o_orderkey",))


def hcpcs_normalisation(spark, sf):
    """Untidy code spellings, one row per part."""
    key = F.col("p_partkey")
    raw = (
        F.when(key % 5 == 0, F.concat(key.cast("string"), F.lit(".0")))
        .when(key % 5 == 1, F.concat(F.lit(" b "), key.cast("string")))
        .when(key % 5 == 2, F.lit("NaN "))
        .when(key % 5 == 3, F.concat(F.lit("c"), key.cast("string"), F.lit(".0")))
        .otherwise(F.lower(a.procedure_code_text()))
    )
    return a.table(spark, sf, "part").select("p_partkey", text.normalize_procedure_code(raw).alias("code"))


def icd10_normalisation(spark, sf):
    code = F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit(". "))
    return a.table(spark, sf, "orders").select("o_orderkey", text.normalize_icd10_code(code).alias("code"))


def _over_sources(spark, sf, build) -> DataFrame:
    base = a.claim_base(spark, sf)
    parts = [build(a.raw_claims(base, kind, with_file=True), kind) for kind in a.CLAIM_TYPES]
    return reduce(DataFrame.unionByName, parts)


def quality_nulls(spark, sf):
    return _over_sources(spark, sf, quality.null_counts)


def quality_date_bounds(spark, sf):
    return _over_sources(spark, sf, quality.date_bounds)


def quality_parse_failures(spark, sf):
    return _over_sources(spark, sf, quality.cell_problems)


def quality_duplicates(spark, sf):
    return quality.duplicate_rows(a.raw_beneficiaries(spark, sf))


def quality_report_long(spark, sf):
    return quality.quality_report(a.raw_beneficiaries(spark, sf), "beneficiary")


def beneficiary_union_years(spark, sf):
    raw = a.raw_beneficiaries(spark, sf).drop("source_file")
    return type_columns(names.lower_names(names.standardize_columns(raw, "beneficiary")), keep=("year",))


def data_dictionary(spark, sf):
    """Dictionary rows for every raw claim file found in the data."""

    def columns_of(raw: DataFrame, kind: str) -> DataFrame:
        columns = F.array(
            *[
                F.struct(F.lit(c).alias("source_column"), F.lit(names.canonical_column(kind, c)).alias("standardized_column"))
                for c in quality.source_columns(raw)
            ]
        )
        found = raw.select("source_file").distinct()
        return found.select("source_file", F.lit(kind).alias("source_type"), F.inline(columns))

    return names.describe_columns(_over_sources(spark, sf, columns_of))


def source_manifest(spark, sf):
    """File name, size, hash and row count of every table file."""
    found = files.discover_data_files(spark, sf)
    facts = files.file_facts(found).drop("source_type")
    tables = [r["name"].removesuffix(".parquet") for r in found.filter(F.col("name").endswith(".parquet")).select("name").collect()]
    counts = [
        a.table(spark, sf, t).agg(F.count(F.lit(1)).alias("row_count")).withColumn("source_file", F.lit(f"{t}.parquet"))
        for t in tables
    ]
    return facts.join(reduce(DataFrame.unionByName, counts), "source_file", "full")


# --- coverage ----------------------------------------------------------------------------------


def _codes(spark, sf):
    return staging.codes(spark, sf)


def coverage_policy_matches(spark, sf):
    return coverage.policy_matches(staging.coverage_tables(spark, sf), _codes(spark, sf), F.lit(a.AS_OF))


def coverage_policy_context(spark, sf):
    tables, codes = staging.coverage_tables(spark, sf), _codes(spark, sf)
    parts = []
    for kind in ("LCD", "Article"):
        keys = coverage.policy_keys(coverage.code_rows(tables[kind], kind, codes))
        parts.append(coverage.policy_context(tables[kind], kind, keys, F.lit(a.AS_OF)).withColumn("policy_type", F.lit(kind)))
    return parts[0].unionByName(parts[1])


def coverage_icd10_relationships(spark, sf):
    return coverage.icd10_relationships(staging.coverage_tables(spark, sf), _codes(spark, sf))


def coverage_ncd_relationships(spark, sf):
    return coverage.ncd_relationships(staging.coverage_tables(spark, sf), _codes(spark, sf))


def coverage_details_for_code(spark, sf):
    matches = coverage.for_code(staging.policy_matches(spark, sf), " b7-3 ")
    return matches.select("procedure_code", "policy_type", "policy_id", "policy_version", "title", "jurisdiction")


def policy_index_normalised(spark, sf):
    return policy_index.build_policy_index(a.policy_records(spark, sf), "2026-01-01T00:00:00+00:00")


def policy_index_search(spark, sf):
    found = policy_index.search_policy_index(policy_index_normalised(spark, sf), " EN.1", ["LCD", "Article"])
    return found.select("policy_type", "policy_id", "display_id", "title")


def policy_index_from_json(spark, sf):
    """Index rows from JSON payloads, one payload per event."""
    payload = F.concat(
        F.lit('{"data":[{"document_id":'), F.col("event_id").cast("string"),
        F.lit(',"title":"'), F.col("event_type"),
        F.lit('","document_version":'), F.get_json_object("props", "$.k"), F.lit("}]}"),
    )
    from claimspark.sources.policy_payloads import parse_payloads

    events = a.table(spark, sf, "events").select(payload.alias("payload"))
    return policy_index.normalize_policy_records(parse_payloads(events, "payload", "NCD"), "NCD", "2026-01-01")


def policy_code_match(spark, sf):
    found = policy_index.match_policy_codes(a.policy_code_lists(spark, sf), " b7-3 ")
    return found.select("policy_id", F.size("procedure_codes").cast("long").alias("listed_codes"))


def policy_code_match_all(spark, sf):
    found = policy_index.match_policies_to_codes(a.policy_code_lists(spark, sf), _codes(spark, sf))
    return found.select("policy_id", "procedure_code")


def description_lookup(spark, sf):
    first, second = (descriptions.description_map(e) for e in a.description_entries(spark, sf))
    codes = lines_with_code(staging.lines(spark, sf)).select("procedure_code").distinct()
    return descriptions.attach_descriptions(codes, first, second)


# --- evidence ------------------------------------------------------------------------------------


def _context(spark, sf):
    procedures = staging.procedure_stats(spark, sf)
    return evidence.procedure_context(procedures, staging.policy_matches(spark, sf), description_lookup(spark, sf))


def explanation_prompt(spark, sf):
    return evidence.procedure_explanations(_context(spark, sf)).select("procedure_code", "prompt", "model")


def explanation_text(spark, sf):
    compared = peers.peer_comparison_all(staging.provider_stats(spark, sf))
    texts = evidence.provider_explanations(compared, _context(spark, sf))
    return texts.select("provider_id", "procedure_code", "explanation", "limitations")


def evidence_links(spark, sf):
    texts = evidence.procedure_explanations(_context(spark, sf))
    return texts.select("procedure_code", F.array_join("sources", "\n").alias("sources"))


QUERIES = {
    f.__name__: f
    for f in (
        procedure_stats, procedure_lines, diagnosis_procedure_stats, provider_procedure_stats,
        pos_procedure_stats, procedure_trends, procedure_codes, diagnoses_per_procedure, places_per_procedure,
        top_diagnoses_per_procedure, top_providers_per_procedure, procedure_detail_summary,
        procedure_detail_diagnoses, procedure_detail_providers, procedure_detail_places, procedure_detail_trends,
        summarize_procedures, numeric_features, peer_comparison_all, peer_comparison_one, peer_top25,
        provider_detail_card, provider_options, peer_anomaly_features, isolation_forest_scores,
        investigation_queue, normalized_carrier, date_normalisation, numeric_normalisation,
        hcpcs_normalisation, icd10_normalisation, quality_nulls, quality_date_bounds, quality_parse_failures,
        quality_duplicates, quality_report_long, beneficiary_union_years, data_dictionary, source_manifest,
        coverage_policy_matches, coverage_policy_context, coverage_icd10_relationships,
        coverage_ncd_relationships, coverage_details_for_code, policy_index_normalised, policy_index_search,
        policy_index_from_json, policy_code_match, policy_code_match_all, description_lookup,
        explanation_prompt, explanation_text, evidence_links,
    )
}

QUERIES |= {f.__name__: f for f in file_layer.SAME_AS}

QUERIES |= extended.QUERIES

QUERIES |= jobs.QUERIES

QUERIES |= whole.QUERIES
