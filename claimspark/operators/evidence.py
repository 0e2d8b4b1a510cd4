"""Plain-language evidence texts per procedure or provider, as columns.

The texts repeat counts, peer figures and policy links. They never state a coverage decision.

``explain`` reads these columns, any of which may be missing: ``procedure_code, description,
summary struct<claim_count, unique_beneficiaries, unique_diagnoses>, provider_comparison
struct<provider_rate, peer_median, rate_ratio, percentile>, coverage_evidence
array<struct<policy_type, display_id, policy_id, title, source_url>>, source_links array<string>,
procedure_summary, provider_summary, anomaly_summary``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from claimspark.functions import fixed
from claimspark.functions.text import strip
from claimspark.operators.joins import salted_join

EVIDENCE_FIELDS = ["policy_type", "display_id", "policy_id", "title", "source_url"]
EVIDENCE_TYPE = "array<struct<" + ",".join(f"{f}:string" for f in EVIDENCE_FIELDS) + ">>"


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")


def _field(df: DataFrame, struct: str, name: str, kind: str) -> Column:
    if struct in df.columns and name in df.schema[struct].dataType.fieldNames():
        return F.col(f"{struct}.{name}").cast(kind)
    return F.lit(None).cast(kind)


def _evidence(df: DataFrame) -> Column:
    """Policy rows with every known field present."""
    if "coverage_evidence" not in df.columns:
        return F.array().cast(EVIDENCE_TYPE)
    given = df.schema["coverage_evidence"].dataType.elementType.fieldNames()

    def complete(row: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(*[(row[f] if f in given else none).cast("string").alias(f) for f in EVIDENCE_FIELDS])

    return F.coalesce(F.transform("coverage_evidence", complete), F.array().cast(EVIDENCE_TYPE))


def whole(value: Column) -> Column:
    """Count with thousands commas."""
    return F.format_number(value, 0)


def summary_value(value: Column) -> Column:
    """Two decimals with thousands commas, or ``not available``."""
    return F.coalesce(F.format_number(value, 2), F.lit("not available"))


def plain_value(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def procedure_summary(df: DataFrame) -> Column:
    claims = _field(df, "summary", "claim_count", "long")
    return F.concat(
        F.lit("Procedure code: "), F.col("procedure_code"),
        F.lit("\nDescription: "), F.coalesce(F.nullif(_text(df, "description"), F.lit("")), F.lit("not available")),
        F.lit("\nClaim count: "), F.coalesce(whole(claims), F.lit("not available")),
    )


def provider_summary(df: DataFrame) -> Column:
    parts = [
        ("Provider rate: ", "provider_rate"),
        ("; peer median: ", "peer_median"),
        ("; rate ratio: ", "rate_ratio"),
        ("; peer percentile: ", "percentile"),
    ]
    pieces = [
        p for label, name in parts
        for p in (F.lit(label), plain_value(_field(df, "provider_comparison", name, "double")))
    ]
    given = F.col("provider_comparison").isNotNull() if "provider_comparison" in df.columns else F.lit(False)
    return F.when(given, F.concat(*pieces)).otherwise("")


def evidence_lines(evidence: Column) -> Column:
    """``- TYPE ID: title`` per policy row, or a sentence when there is none."""

    def line(row: Column) -> Column:
        return F.concat(
            F.lit("- "), F.coalesce(row["policy_type"], F.lit("Coverage")),
            F.lit(" "), F.coalesce(row["display_id"], row["policy_id"], F.lit("document")),
            F.lit(": "), F.coalesce(row["title"], F.lit("No title available")),
        )

    lines = F.array_join(F.transform(evidence, line), "\n")
    return F.when(F.size(evidence) > 0, lines).otherwise(fixed.NO_COVERAGE_ROWS)


def evidence_links(evidence: Column) -> Column:
    links = F.transform(evidence, lambda row: row["source_url"])
    return F.filter(links, lambda link: link.isNotNull() & (link != ""))


def explanation_prompt(procedure: Column, coverage: Column, provider: Column, anomaly: Column) -> Column:
    """Evidence-bounded prompt; the provider and anomaly sections are left out when blank."""

    def optional(title: str, body: Column) -> Column:
        return F.when(body != "", F.concat(F.lit(f"{title}:\n"), body, F.lit("\n\n"))).otherwise("")

    return F.concat(
        F.lit(fixed.PROMPT_RULES),
        F.lit("Procedure summary:\n"), procedure, F.lit("\n\n"),
        optional("Provider/peer summary", provider),
        optional("Anomaly summary", anomaly),
        F.lit("Coverage evidence:\n"), coverage,
    )


def _counts_sentence(df: DataFrame) -> Column:
    claims = _field(df, "summary", "claim_count", "long")
    people = _field(df, "summary", "unique_beneficiaries", "long")
    start = F.concat(F.lit("Observed data for "), F.col("procedure_code"))
    known = F.concat(
        start, F.lit(" show "), whole(claims), F.lit(" claims and "), whole(people),
        F.lit(" unique beneficiaries in the local synthetic dataset."),
    )
    return F.coalesce(known, F.concat(start, F.lit(" are available in the local synthetic dataset.")))


def _peer_sentence(df: DataFrame) -> Column:
    rate, median, ratio, percentile = (
        _field(df, "provider_comparison", n, "double")
        for n in ("provider_rate", "peer_median", "rate_ratio", "percentile")
    )
    compared = F.concat(
        F.lit("For the selected provider, the observed rate is "), summary_value(rate),
        F.lit(" versus a peer median of "), summary_value(median),
        F.lit("; the rate ratio is "), summary_value(ratio),
        F.lit(" and the peer percentile is "), summary_value(percentile), F.lit("th."),
    )
    alone = F.concat(
        F.lit("The selected provider's rate is "), summary_value(rate), F.lit(" in the local peer comparison.")
    )
    return F.when(rate.isNotNull() & median.isNotNull(), compared).when(rate.isNotNull(), alone).otherwise("")


def _coverage_sentence(evidence: Column) -> Column:
    first = F.try_element_at(evidence, F.lit(1))

    def named(names: list[str], default: str) -> Column:
        return F.coalesce(*[F.nullif(first[n], F.lit("")) for n in names], F.lit(default))

    found = F.concat(
        F.lit("Coverage evidence indicates a relevant "), named(["policy_type"], "coverage document"),
        F.lit(" entry ("), named(["display_id", "policy_id"], "policy record"),
        F.lit(f") {fixed.COVERAGE_CAVEAT}"),
    )
    return F.when(F.size(evidence) > 0, found).otherwise(fixed.NO_COVERAGE_TEXT)


def explanation_text(df: DataFrame) -> Column:
    """Deterministic explanation built from the evidence columns."""
    described = F.coalesce(F.nullif(_text(df, "description"), F.lit("")), F.lit(fixed.NO_DESCRIPTION))
    diagnoses = _field(df, "summary", "unique_diagnoses", "long")
    diagnosis_sentence = F.concat(
        F.lit("The local code summary includes "), whole(diagnoses), F.lit(" diagnosis associations.")
    )
    return F.concat(
        F.lit("Observed facts: "), _counts_sentence(df),
        F.lit(" The local records describe this service as: "), described, F.lit(". "),
        F.coalesce(diagnosis_sentence, F.lit("")), F.lit(" "),
        _peer_sentence(df), F.lit(" "),
        _coverage_sentence(_evidence(df)), F.lit(" "),
        F.lit(fixed.EXPLANATION_CLOSING),
    )


def explain(df: DataFrame) -> DataFrame:
    """Add ``prompt, explanation, model, sources, limitations``."""
    evidence = _evidence(df)
    links = evidence_links(evidence)
    if "source_links" in df.columns:
        links = F.when(F.size("source_links") > 0, F.col("source_links")).otherwise(links)
    procedure = F.coalesce(F.nullif(_text(df, "procedure_summary"), F.lit("")), procedure_summary(df))
    provider = F.coalesce(F.nullif(_text(df, "provider_summary"), F.lit("")), provider_summary(df))
    prompt = explanation_prompt(procedure, evidence_lines(evidence), provider, _text(df, "anomaly_summary"))
    return df.withColumns(
        {
            "prompt": prompt,
            "explanation": explanation_text(df),
            "model": F.lit(fixed.EXPLANATION_MODEL),
            "sources": links,
            "limitations": F.lit(fixed.LIMITATIONS),
        }
    )


def first_policies(matches: DataFrame, limit: int = 5) -> DataFrame:
    """``code_key, coverage_evidence``: the first policy rows of every code, LCDs before Articles.

    The rows are cut to ``limit`` per code on each task before they are shuffled.
    """
    order = Window.partitionBy("procedure_code").orderBy(
        F.desc("policy_type"), "display_id", "policy_id", "policy_version", "long_description",
        "medium_description", "short_description",
    )
    ranked = matches.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    rows = ranked.groupBy(F.col("procedure_code").alias("code_key")).agg(
        F.array_sort(F.collect_list(F.struct("place", *EVIDENCE_FIELDS))).alias("ranked")
    )
    evidence = F.transform("ranked", lambda r: F.struct(*[r[f].alias(f) for f in EVIDENCE_FIELDS]))
    return rows.select("code_key", evidence.alias("coverage_evidence"))


def procedure_context(
    procedures: DataFrame, matches: DataFrame, descriptions: DataFrame | None = None
) -> DataFrame:
    """Summary, description and first policies of every procedure."""
    context = procedures.select(
        "procedure_code",
        F.upper(strip(F.col("procedure_code"))).alias("code_key"),
        F.struct("claim_count", "unique_beneficiaries", "unique_diagnoses").alias("summary"),
    )
    if descriptions is not None:
        context = context.join(descriptions.select("procedure_code", "description"), "procedure_code", "left")
    joined = context.join(first_policies(matches), "code_key", "left").drop("code_key")
    return joined.withColumn(
        "coverage_evidence", F.coalesce("coverage_evidence", F.array().cast(EVIDENCE_TYPE))
    ).withColumn("anomaly_summary", F.lit(fixed.ANOMALY_NOTE))


def procedure_explanations(context: DataFrame) -> DataFrame:
    """One explanation per procedure, without a provider."""
    return explain(context.withColumn("provider_summary", F.lit(fixed.NO_PROVIDER_NOTE)))


def provider_explanations(comparison: DataFrame, context: DataFrame) -> DataFrame:
    """One explanation per provider and procedure from the all-pairs comparison."""
    compared = comparison.select(
        "provider_id",
        "procedure_code",
        F.struct("provider_rate", "peer_median", "rate_ratio", "percentile").alias("provider_comparison"),
    )
    return explain(salted_join(compared, context, ["procedure_code"], by=["provider_id"]))
