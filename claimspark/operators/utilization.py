"""Utilization tables per procedure, diagnosis, provider, place of service and month.

Every input is the claim-line table of ``operators.claim_lines``. Claims are counted as distinct
(claim type, claim id) pairs plus the lines that carry no claim id, which equals counting distinct
claim keys but does not depend on how row keys were assigned.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimspark.functions import fixed
from claimspark.functions.names import validate_columns
from claimspark.functions.text import avg_money, money, sum_money
from claimspark.operators.claim_lines import lines_with_code
from claimspark.operators.joins import salted_join
from claimspark.operators.ranks import exact_quantiles
from claimspark.session import materialise


def distinct_claims() -> Column:
    claim_id = F.col("source_claim_id")
    with_id = F.count_distinct(F.concat(F.col("claim_type"), F.lit(":"), claim_id))
    return with_id + F.count_if(claim_id.isNull())


# Entities that are counted once per group, and the columns that name them.
ENTITIES = {"claims": ["claim_type", "source_claim_id"], "beneficiaries": ["bene_id"], "providers": ["provider_id"]}
KEYS = ["code_system", "diagnosis_code", "provider_id_key", "provider_id_type", "place_of_service_code", "service_month"]
ROWS_PER_LINE = 4  # about; so many more pieces than a shuffle of lines has, for their groups to fit into a task's memory
# Table -> its keys behind the procedure code, the lines it takes, the entities it counts. Only carrier lines keep their place.
GROUPINGS: dict[str, tuple[list[str], str, list[str]]] = {
    "procedure": (["code_system"], "true", ["claims", "beneficiaries", "providers"]),
    "total": ([], "true", ["claims"]),
    "diagnosis": (["diagnosis_code"], "diagnosis_codes is not null", ["claims", "beneficiaries", "providers"]),
    "provider": (["provider_id_key", "provider_id_type"], "provider_id_key is not null", ["claims", "beneficiaries"]),
    "place": (["place_of_service_code"], "place_of_service_code is not null", ["claims", "beneficiaries"]),
    "carrier": ([], "claim_type = 'carrier'", ["claims"]),
    "month": (["service_month"], "service_month is not null", ["claims", "beneficiaries"]),
}


# Keys that a table has at most one of; groups are told apart by this one text, which is given back its name when only counts are left.
TEXT_KEYS = ["code_system", "diagnosis_code", "provider_id_key", "place_of_service_code"]


def _in_groups(rows: DataFrame, tables: Sequence[str], kept: list[str]) -> DataFrame:
    """``grouping, procedure_code, text, provider_id_type, service_month`` and the columns ``kept``: a row for each group that a line belongs to."""
    types = {f.name: f.dataType for f in rows.schema}

    def group(table: str) -> Column:
        keys, condition, _ = GROUPINGS[table]
        text = next((F.col(k) for k in keys if k in TEXT_KEYS and k != "diagnosis_code"), F.lit(None).cast("string"))
        texts = F.col("diagnosis_codes") if table == "diagnosis" else F.array(text)
        others = [(F.col(k) if k in keys else F.lit(None).cast(types[k])).alias(k) for k in KEYS if k not in TEXT_KEYS]
        return F.when(F.expr(condition), F.struct(F.lit(table).alias("grouping"), texts.alias("texts"), *others))

    groups = rows.select("procedure_code", *kept, F.explode(F.array(*map(group, tables))).alias("group")).filter("group is not null")
    found = groups.select("procedure_code", *kept, "group.*").withColumn("text", F.explode("texts")).drop("texts")
    return found.filter("grouping <> 'diagnosis' or (text is not null and text <> '')")


def _named_keys(counts: DataFrame) -> DataFrame:
    """``counts`` with ``KEYS`` in place of ``text``."""
    owners = {key: [t for t, (keys, _, _) in GROUPINGS.items() if key in keys] for key in TEXT_KEYS}
    texts = {key: F.when(F.col("grouping").isin(tables), F.col("text")) for key, tables in owners.items()}
    return counts.select("grouping", "procedure_code", *[texts.get(k, F.col(k)).alias(k) for k in KEYS], *ENTITIES)


def _taken(tables: Sequence[str]) -> set[str]:
    """Columns that tell the groups of the tables."""
    keys = {"diagnosis_codes" if k == "diagnosis_code" else k for t in tables for k in GROUPINGS[t][0]}
    return keys | ({"claim_type"} if "carrier" in tables else set())


def distinct_counts(lines: DataFrame, tables: Sequence[str]) -> DataFrame:
    """``grouping, procedure_code``, ``KEYS`` and ``claims, beneficiaries, providers`` of each group of the tables, entities counted once.

    Lines, not the groups they belong to, are moved: once for each entity, to the place of (procedure, entity). There an entity is alone with all
    its lines of a procedure, so its groups are told apart without moving again, whatever their number. Only counts travel to the groups.
    """
    taken = {entity: _taken([t for t in tables if entity in GROUPINGS[t][2]]) for entity in ENTITIES}
    used = set().union(*taken.values(), *[ENTITIES[e] for t in tables for e in GROUPINGS[t][2]], ["claim_type", "source_claim_id"])
    sources = {c: (F.col(c), "string") for c in ("code_system", "claim_type", "source_claim_id", "bene_id", "provider_id", "provider_id_type")}
    sources["place_of_service_code"] = (F.when(F.col("claim_type") == "carrier", F.col("place_of_service_code")), "string")
    sources |= {"provider_id_key": (F.col("provider_id"), "string"), "service_month": (F.trunc("service_date", "MM"), "date"), "diagnosis_codes": (F.col("diagnosis_codes"), "array<string>")}
    coded = lines_with_code(lines).select("procedure_code", *[(value if c in used else F.lit(None).cast(kind)).alias(c) for c, (value, kind) in sources.items()])
    place = ["grouping", "procedure_code", "text", *[k for k in KEYS if k not in TEXT_KEYS]]
    pieces = ROWS_PER_LINE * int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    unnamed = _in_groups(coded.filter("source_claim_id is null"), tables, []).groupBy(*place).agg(F.count(F.lit(1)).alias("claims"))
    parts = [unnamed.select(*place, "claims", F.lit(0).alias("beneficiaries"), F.lit(0).alias("providers"))]
    for entity, names in ENTITIES.items():
        own = [t for t in tables if entity in GROUPINGS[t][2]]
        if not own:
            continue
        rows = coded.filter(" and ".join(f"{n} is not null" for n in names)).repartition(pieces, "procedure_code", *names)
        rows = rows.select("procedure_code", *names, *[(F.col(c) if c in taken[entity] else F.lit(None).cast(rows.schema[c].dataType)).alias(c) for c in coded.columns if c not in ("procedure_code", *names)])
        seen = _in_groups(rows, own, names).distinct()
        found = seen.groupBy(*place).agg(F.count(F.lit(1)).alias("n"))
        parts.append(found.select(*place, *[(F.col("n") if e == entity else F.lit(0)).alias(e) for e in ENTITIES]))
    return _named_keys(reduce(DataFrame.unionByName, parts).groupBy(*place).agg(*[F.sum(e).alias(e) for e in ENTITIES]))


def _counts(lines: DataFrame, counts: DataFrame | None, table: str) -> DataFrame:
    """The rows of one table among ``counts``, or counted here."""
    counts = distinct_counts(lines, [table]) if counts is None else counts
    return counts.filter(F.col("grouping") == table).drop("grouping")


def explode_diagnoses(lines: DataFrame) -> DataFrame:
    """One row per line and diagnosis; lines without a diagnosis vanish."""
    exploded = lines.withColumn("diagnosis_code", F.explode("diagnosis_codes")).drop("diagnosis_codes")
    return exploded.filter(F.col("diagnosis_code").isNotNull() & (F.col("diagnosis_code") != ""))


def diagnoses_per_procedure(lines: DataFrame) -> DataFrame:
    return (
        explode_diagnoses(lines_with_code(lines))
        .groupBy("procedure_code")
        .agg(F.count_distinct("diagnosis_code").alias("unique_diagnoses"))
    )


def places_per_procedure(lines: DataFrame) -> DataFrame:
    return (
        lines_with_code(lines)
        .filter(F.col("place_of_service_code").isNotNull())
        .groupBy("procedure_code")
        .agg(F.count_distinct("place_of_service_code").alias("unique_places_of_service"))
    )


def procedure_stats(lines: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """One summary row per procedure code; missing diagnosis and place counts are 0.

    ``allowed_amount_claims`` counts the carrier lines with an amount, not claims. ``counts`` are finished ``distinct_counts``.
    """
    coded = lines_with_code(lines)
    counted = _counts(lines, counts, "procedure").select(
        F.col("procedure_code").alias("code"), F.col("code_system").alias("system"), F.col("claims").alias("claim_count"),
        F.col("beneficiaries").alias("unique_beneficiaries"), F.col("providers").alias("unique_providers"),
    )
    core = coded.groupBy("procedure_code", "code_system").agg(
        sum_money(F.col("allowed_amount")).alias("total_allowed"),
        avg_money(F.col("allowed_amount")).alias("average_allowed"),
        F.count("allowed_amount").alias("allowed_amount_claims"),
        F.min("service_date").alias("first_service_date"),
        F.max("service_date").alias("last_service_date"),
        # NULL places are not counted, so codes without a place get 0 without a join.
        F.count_distinct("place_of_service_code").alias("unique_places_of_service"),
    )
    core = core.join(counted, (F.col("procedure_code") == F.col("code")) & F.col("code_system").eqNullSafe(F.col("system")))
    keys = ["procedure_code", "code_system"]
    medians = exact_quantiles(coded, keys, "allowed_amount", {"median_allowed": 0.5})
    return (
        core.join(medians, keys, "left")
        .join(diagnoses_per_procedure(lines), "procedure_code", "left")
        .select(
            "procedure_code",
            "code_system",
            "claim_count",
            "unique_beneficiaries",
            "unique_providers",
            "total_allowed",
            "average_allowed",
            "median_allowed",
            "allowed_amount_claims",
            "first_service_date",
            "last_service_date",
            F.coalesce("unique_diagnoses", F.lit(0)).alias("unique_diagnoses"),
            "unique_places_of_service",
            F.lit(fixed.ALLOWED_SCOPE).alias("allowed_amount_scope"),
        )
    )


def claims_per_procedure(lines: DataFrame) -> DataFrame:
    """``procedure_code, procedure_claims``: the denominator of the diagnosis percentages."""
    return lines_with_code(lines).groupBy("procedure_code").agg(distinct_claims().alias("procedure_claims"))


def percentage(part: Column, whole: Column) -> Column:
    return F.try_divide(F.lit(100.0) * part, whole)


def diagnosis_procedure_stats(lines: DataFrame, procedures: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Claims per procedure and diagnosis. A claim can hold several diagnoses, so percentages may pass 100.

    ``procedures`` is a finished ``procedure_stats`` table; without it the totals are counted here. ``counts`` are finished ``distinct_counts``.
    """
    if counts is None:
        counts = materialise(distinct_counts(lines, ["diagnosis"] if procedures is not None else ["diagnosis", "total"]), "diagnosis-counts")
    totals = (
        _counts(lines, counts, "total").select("procedure_code", F.col("claims").alias("procedure_claims"))
        if procedures is None
        else procedures.select("procedure_code", F.col("claim_count").alias("procedure_claims"))
    )
    relationships = _counts(lines, counts, "diagnosis").select(
        "procedure_code", "diagnosis_code", F.col("claims").alias("claim_count"), F.col("beneficiaries").alias("beneficiary_count"), F.col("providers").alias("provider_count")
    )
    return salted_join(relationships, totals, ["procedure_code"], by=["diagnosis_code"]).select(
        "procedure_code",
        "diagnosis_code",
        "claim_count",
        "beneficiary_count",
        "provider_count",
        percentage(F.col("claim_count"), F.col("procedure_claims")).alias("percentage_of_procedure_claims"),
    )


def provider_procedure_stats(lines: DataFrame) -> DataFrame:
    """Claims, beneficiaries and claims per beneficiary of each provider and procedure.

    Lines are moved once, to the place of (procedure, provider), where both kinds of entity are told apart and amounts are added up: there are nearly as
    many of these pairs as lines, so counts made elsewhere would be as many rows again.
    """
    keys = ["provider_id", "provider_id_type", "procedure_code"]
    pieces = ROWS_PER_LINE * int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lines_with_code(lines).filter(F.col("provider_id").isNotNull())
    rows = rows.select(*keys, "claim_type", "source_claim_id", "bene_id", "allowed_amount").repartition(pieces, "procedure_code", "provider_id")
    claim_id, none = F.col("source_claim_id"), F.lit(None).cast("string")

    def entity(kind: int, group: Column, name: Column, unnamed: Column, amount: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), group.alias("group"), name.alias("name"), unnamed.alias("unnamed"), amount.alias("amount"))

    claim = entity(0, F.col("claim_type"), F.when(F.col("claim_type").isNotNull(), claim_id), claim_id.isNull().cast("long"), F.col("allowed_amount"))
    person = entity(1, none, F.col("bene_id"), F.lit(0).cast("long"), F.lit(None).cast("double"))
    seen = rows.select(*keys, F.inline(F.array(claim, person))).groupBy(*keys, "kind", "group", "name").agg(
        F.sum("unnamed").alias("unnamed"), F.sum(money(F.col("amount"))).alias("amount")
    )
    named = F.col("name").isNotNull()
    return (
        seen.groupBy(*keys)
        .agg(
            (F.count_if(named & (F.col("kind") == 0)) + F.sum("unnamed")).alias("claim_count"),
            F.count_if(named & (F.col("kind") == 1)).alias("beneficiary_count"),
            F.sum("amount").cast("double").alias("total_allowed"),
        )
        .withColumns(
            {
                "procedure_rate": F.try_divide(
                    F.col("claim_count").cast("double"), F.col("beneficiary_count").cast("double")
                ),
                "procedure_rate_basis": F.lit(fixed.RATE_BASIS),
            }
        )
    )


def pos_procedure_stats(lines: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Carrier claims per procedure and place; the base also counts lines without a place. ``counts`` are finished ``distinct_counts``."""
    if counts is None:
        counts = materialise(distinct_counts(lines.filter("claim_type = 'carrier'"), ["place", "carrier"]), "place-counts")
    totals = _counts(lines, counts, "carrier").select("procedure_code", F.col("claims").alias("carrier_claims"))
    places = _counts(lines, counts, "place").select(
        "procedure_code", "place_of_service_code", F.col("claims").alias("claim_count"), F.col("beneficiaries").alias("beneficiary_count")
    )
    return salted_join(places, totals, ["procedure_code"], by=["place_of_service_code"]).select(
        "procedure_code",
        "place_of_service_code",
        "claim_count",
        "beneficiary_count",
        percentage(F.col("claim_count"), F.col("carrier_claims")).alias("percentage_of_carrier_procedure_claims"),
        F.lit(fixed.PLACE_SCOPE).alias("data_scope"),
    )


def procedure_trends(lines: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Claims and beneficiaries per procedure and calendar month. ``counts`` are finished ``distinct_counts``."""
    return _counts(lines, counts, "month").select(
        "procedure_code", "service_month", F.col("claims").alias("claim_count"), F.col("beneficiaries").alias("beneficiary_count")
    )


def procedure_codes(procedures: DataFrame) -> DataFrame:
    """Observed codes by claim volume, then code."""
    return procedures.select("procedure_code", "claim_count").orderBy(F.desc("claim_count"), "procedure_code")


def top_per_procedure(table: DataFrame, tie_breaker: list[str], limit: int = 20) -> DataFrame:
    """The ``limit`` rows with most claims of every procedure, ranked from 1.

    Spark keeps ``limit`` rows per code on each task before the shuffle, so a hot code stays small.
    """
    order = Window.partitionBy("procedure_code").orderBy(F.desc("claim_count"), *tie_breaker)
    return table.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def top_diagnoses(diagnoses: DataFrame, limit: int = 20) -> DataFrame:
    return top_per_procedure(diagnoses, ["diagnosis_code"], limit)


def top_providers(providers: DataFrame, limit: int = 20) -> DataFrame:
    return top_per_procedure(providers, ["provider_id"], limit)


def procedure_details(tables: dict[str, DataFrame], procedure_code: str) -> dict[str, DataFrame]:
    """Summary, diagnoses, providers, places and trend of one code; the filters reach the scans."""
    one = {name: df.filter(F.col("procedure_code") == procedure_code) for name, df in tables.items()}
    most_claims = F.desc("claim_count")
    return {
        "summary": one["procedure_stats"].limit(1),
        "diagnoses": one["diagnosis_procedure_stats"].orderBy(most_claims, "diagnosis_code").limit(20),
        "providers": one["provider_procedure_stats"].orderBy(most_claims, "provider_id").limit(20),
        "places": one["pos_procedure_stats"].orderBy(most_claims, "place_of_service_code"),
        "trends": one["procedure_trends"].orderBy("service_month"),
    }


def summarize_procedures(df: DataFrame, column: str) -> DataFrame:
    """Rows per code, most frequent first; rows without a code form a group of their own."""
    if column not in df.columns:
        raise KeyError(f"Missing procedure column: {column}")
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("claim_count"))
    return counts.orderBy(F.desc("claim_count"), F.asc_nulls_last(column))


def numeric_features(df: DataFrame, group: str, measures: list[str]) -> DataFrame:
    """Mean of each measure per group; NULL groups are left out and NULL values skipped."""
    missing = sorted({group, *measures} - set(df.columns))
    if missing:
        raise KeyError(f"Missing feature columns: {', '.join(missing)}")
    return df.filter(F.col(group).isNotNull()).groupBy(group).agg(*[F.avg(m).alias(m) for m in measures])
