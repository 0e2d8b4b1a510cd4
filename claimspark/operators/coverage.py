"""Procedure codes against local and national coverage policies.

Policy tables arrive as ``{policy type: {table name: DataFrame}}`` with text columns and an
``ingest_pos`` column that grows with the position in the source file. Identifiers are compared
without outer white space on both sides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from claimspark.functions import fixed
from claimspark.functions.text import (
    col_or_default, first_non_blank, parse_policy_date, policy_url, strip,
)
from claimspark.operators.joins import measured_join, salted_join

PolicyTables = dict[str, dict[str, DataFrame]]
POLICY = ["policy_id", "policy_version"]
CONTRACTOR = ["contractor_id", "contractor_type_id", "contractor_version"]
MATCH_COLUMNS = [
    "procedure_code", "code_system", "policy_type", "policy_id", "display_id", "policy_version", "title",
    "status", "effective_date", "retirement_date", "contractor", "jurisdiction", "short_description",
    "medium_description", "long_description", "relationship_type", "source_url",
]
ICD10_COLUMNS = [
    "procedure_code", "policy_id", "policy_version", "policy_title", "icd10_code", "icd10_description",
    "code_relationship", "source_url",
]
NCD_COLUMNS = [
    "procedure_code", "source_policy_type", "source_policy_id", "source_policy_version",
    "source_policy_title", "related_policy_type", "related_policy_id", "related_policy_version",
    "related_policy_title", "effective_date", "relationship_type", "source_url",
]
LIST_ROWS = 512  # diagnoses of an article in one row
# Date columns in order of preference.
EFFECTIVE = {"LCD": ["rev_eff_date", "orig_det_eff_date"], "Article": ["article_eff_date"]}
RETIRED = {"LCD": ["ent_det_end_date", "rev_end_date"], "Article": ["article_end_date", "date_retired"]}


def code_set(codes: DataFrame, column: str = "procedure_code") -> DataFrame:
    """Distinct upper-case codes without outer white space, blanks left out."""
    code = F.upper(strip(F.col(column).cast("string")))
    return codes.select(code.alias("procedure_code")).filter(F.col("procedure_code") != "").distinct()


def code_list(spark: SparkSession, codes: Sequence[str]) -> DataFrame:
    return code_set(spark.createDataFrame([(c,) for c in codes], "procedure_code string"))


def policy_key(policy_type: str) -> list[Column]:
    prefix = policy_type.lower()
    return [
        strip(F.col(f"{prefix}_id")).alias("policy_id"),
        strip(F.col(f"{prefix}_version")).alias("policy_version"),
    ]


def last_per_key(df: DataFrame, keys: list[str], position: str = "ingest_pos") -> DataFrame:
    """The row that comes last in the source, per key; combined on the map side."""
    rest = [c for c in df.columns if c not in (*keys, position)]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), position).alias("row")).select(*keys, "row.*")


def code_rows(tables: dict[str, DataFrame], policy_type: str, codes: DataFrame) -> DataFrame:
    """Rows of the policy's code table whose code is wanted, with the normalised code."""
    name = f"{policy_type.lower()}_x_hcpc_code"
    table = tables[name]
    if "hcpc_code_id" not in table.columns:
        raise ValueError(f"{name} has no hcpc_code_id column.")
    rows = table.select(
        *policy_key(policy_type),
        F.upper(strip(F.col("hcpc_code_id"))).alias("procedure_code"),
        *[col_or_default(table, f"{size}_description").alias(f"{size}_description") for size in ("short", "medium", "long")],
    )
    return measured_join(rows, codes, ["procedure_code"], by=POLICY, how="left_semi")


def policy_keys(rows: DataFrame) -> DataFrame:
    return rows.select(*POLICY).distinct()


def policy_codes(rows: DataFrame) -> DataFrame:
    """Distinct codes of each policy, moved once: told apart where what else is known of the policy meets them."""
    return rows.select(*POLICY, "procedure_code").repartition(*POLICY).distinct()


def policy_metadata(tables: dict[str, DataFrame], policy_type: str) -> DataFrame:
    """Title, status and dates, one row per policy version."""
    table = tables[policy_type.lower()]

    def first_date(names: list[str]) -> Column:
        return first_non_blank(*[col_or_default(table, n) for n in names])

    rows = table.select(
        *policy_key(policy_type),
        *[col_or_default(table, c).alias(c) for c in ("display_id", "title", "status")],
        first_date(EFFECTIVE[policy_type]).alias("effective_date"),
        first_date(RETIRED[policy_type]).alias("retirement_date"),
        "ingest_pos",
    )
    return last_per_key(rows, POLICY)


def _contractor_key(df: DataFrame) -> list[Column]:
    return [strip(F.col(c)).alias(c) for c in CONTRACTOR]


def _joined_names(df: DataFrame, name: str, separator: str, alias: str) -> DataFrame:
    """Sorted distinct non-blank names of each policy as one text."""
    names = df.select(*POLICY, strip(F.col(name)).alias(name)).filter(F.col(name) != "")
    return names.groupBy(*POLICY).agg(F.array_join(F.array_sort(F.collect_set(name)), separator).alias(alias))


def state_names(tables: dict[str, DataFrame]) -> DataFrame:
    states = tables["state_lookup"].select(strip(F.col("state_id")).alias("state_id"), "state_abbrev", "ingest_pos")
    return last_per_key(states, ["state_id"])


def valid_on(df: DataFrame, as_of: Column) -> DataFrame:
    """Rows in force: started (or no start) and not ended (or no end)."""
    starts = parse_policy_date(strip(col_or_default(df, "active_date")))
    ends = parse_policy_date(strip(col_or_default(df, "term_date")))
    return df.filter((starts.isNull() | (starts <= as_of)) & (ends.isNull() | (ends >= as_of)))


def policy_context(
    tables: dict[str, DataFrame], policy_type: str, keys: DataFrame, as_of: Column | None = None
) -> DataFrame:
    """``policy_id, policy_version, contractor, jurisdiction`` for every key; '' when unknown.

    Jurisdiction comes from the contractors in force, and from the policy's own states otherwise.
    """
    as_of = F.current_date() if as_of is None else as_of
    prefix = policy_type.lower()
    link_table = tables[f"{prefix}_x_contractor"]
    all_links = link_table.select(*policy_key(policy_type), *_contractor_key(link_table)).distinct()
    links = all_links.join(keys, POLICY, "left_semi")  # the keys are as many as the links

    context = keys
    contractors = tables.get("contractor")
    if contractors is not None and {*CONTRACTOR, "contractor_bus_name"} <= set(contractors.columns):
        names = contractors.select(*_contractor_key(contractors), "contractor_bus_name").distinct()
        named = salted_join(links, names, CONTRACTOR, by=POLICY)
        context = context.join(_joined_names(named, "contractor_bus_name", "; ", "contractor"), POLICY, "left")
    else:
        context = context.withColumn("contractor", F.lit(""))

    states = state_names(tables)
    areas = tables["contractor_jurisdiction"]
    if "state_id" in areas.columns:
        in_force = valid_on(areas, as_of).select(*_contractor_key(areas), strip(F.col("state_id")).alias("state_id"))
        area_names = in_force.join(states, "state_id").select(*CONTRACTOR, "state_abbrev").distinct()
        served = salted_join(links, area_names, CONTRACTOR, by=POLICY)
        context = context.join(_joined_names(served, "state_abbrev", ", ", "served"), POLICY, "left")
    else:
        context = context.withColumn("served", F.lit(""))

    own = tables[f"{prefix}_x_primary_jurisdiction"].select(
        *policy_key(policy_type), strip(F.col("state_id")).alias("state_id")
    )
    own_states = own.distinct().join(keys, POLICY, "left_semi").join(states, "state_id")
    context = context.join(_joined_names(own_states, "state_abbrev", ", ", "primary"), POLICY, "left")
    return context.select(
        *POLICY,
        F.coalesce("contractor", F.lit("")).alias("contractor"),
        first_non_blank(F.col("served"), F.col("primary")).alias("jurisdiction"),
    )


def direct_policy_rows(
    tables: dict[str, DataFrame], policy_type: str, rows: DataFrame, as_of: Column | None = None
) -> DataFrame:
    """One row per code-table row whose exact policy version has metadata; ``finish_matches`` makes output rows of them."""
    context = policy_context(tables, policy_type, policy_keys(rows), as_of)
    documents = policy_metadata(tables, policy_type).join(context, POLICY)
    return salted_join(rows, documents, POLICY, by=["procedure_code"]).withColumn("policy_type", F.lit(policy_type))


def match_rows(tables: PolicyTables, codes: DataFrame, as_of: Column | None = None) -> DataFrame:
    """LCD and Article rows for the wanted codes, without the columns that follow from others."""
    parts = [
        direct_policy_rows(tables[kind], kind, code_rows(tables[kind], kind, codes), as_of)
        for kind in ("LCD", "Article")
    ]
    return parts[0].unionByName(parts[1])


def finish_matches(rows: DataFrame) -> DataFrame:
    kind = F.col("policy_type")
    relation = F.when(kind == "LCD", fixed.CODE_LISTED.format(policy_type="LCD")).otherwise(fixed.CODE_LISTED.format(policy_type="Article"))
    return rows.withColumns(
        {
            "code_system": F.lit(fixed.POLICY_CODE_SYSTEM),
            "relationship_type": relation,
            "source_url": policy_url(kind, F.col("policy_id"), F.col("policy_version")),
        }
    ).select(*MATCH_COLUMNS)


def policy_matches(tables: PolicyTables, codes: DataFrame, as_of: Column | None = None) -> DataFrame:
    """LCD and Article rows for the wanted codes."""
    return finish_matches(match_rows(tables, codes, as_of))


def icd10_lists(tables: PolicyTables, codes: DataFrame) -> DataFrame:
    """``procedure_code``, ``POLICY``, ``policy_title`` and ``diagnoses``, arrays of up to ``LIST_ROWS`` diagnoses of the article.

    A code and its diagnoses meet, and move on, as one row instead of one for each diagnosis; ``finish_icd10`` makes rows of them.
    """
    articles = tables["Article"]

    def listed(name: str, label: str) -> DataFrame:
        table = articles[name]
        return table.select(
            *policy_key("Article"),
            col_or_default(table, "icd10_code_id").alias("icd10_code"),
            col_or_default(table, "description").alias("icd10_description"),
            F.lit(label).alias("code_relationship"),
        )

    diagnoses = listed("article_x_icd10_covered", fixed.DIAGNOSIS_COVERED).unionByName(
        listed("article_x_icd10_noncovered", fixed.DIAGNOSIS_NONCOVERED)
    )
    titles = policy_metadata(articles, "Article").select(*POLICY, F.col("title").alias("policy_title"))
    wanted = policy_codes(code_rows(articles, "Article", codes)).join(titles, POLICY, "left")
    place = F.row_number().over(Window.partitionBy(*POLICY).orderBy("icd10_code", "code_relationship"))
    numbered = diagnoses.dropna(subset=POLICY).withColumn("list", F.floor((place - 1) / LIST_ROWS))
    lists = numbered.groupBy(*POLICY, "list").agg(F.collect_list(F.struct("icd10_code", "icd10_description", "code_relationship")).alias("diagnoses"))
    # A policy has no more rows here than there are codes, and its lists are few.
    return wanted.join(lists.drop("list"), POLICY).withColumn("policy_title", F.coalesce("policy_title", F.lit("")))


def finish_icd10(lists: DataFrame) -> DataFrame:
    """One row per procedure code, article and diagnosis."""
    linked = lists.withColumn("source_url", policy_url(F.lit("Article"), F.col("policy_id"), F.col("policy_version")))
    return linked.withColumn("diagnosis", F.explode("diagnoses")).select(*ICD10_COLUMNS[:4], "diagnosis.*", "source_url")


def icd10_relationships(tables: PolicyTables, codes: DataFrame) -> DataFrame:
    """Diagnoses that an article lists as supporting or not supporting each of its codes."""
    return finish_icd10(icd10_lists(tables, codes))


def ncd_metadata(tables: PolicyTables) -> DataFrame:
    table = tables["NCD"]["ncd_trkg"]
    rows = table.select(
        strip(F.col("NCD_id")).alias("related_policy_id"),
        strip(F.col("NCD_vrsn_num")).alias("related_policy_version"),
        col_or_default(table, "NCD_mnl_sect_title").alias("related_policy_title"),
        col_or_default(table, "NCD_efctv_dt").alias("effective_date"),
        "ingest_pos",
    )
    return last_per_key(rows, ["related_policy_id", "related_policy_version"])


def related_ncd_rows(
    tables: PolicyTables, policy_type: str, codes: DataFrame, with_titles: bool = False
) -> DataFrame:
    own = tables[policy_type]
    table = own[f"{policy_type.lower()}_related_ncd_documents"]
    links = table.select(
        *policy_key(policy_type),
        strip(F.col("r_ncd_id")).alias("related_policy_id"),
        strip(col_or_default(table, "r_ncd_version")).alias("related_policy_version"),
    ).filter(~F.col("related_policy_id").isin(fixed.PLACEHOLDER_NCD_IDS))
    wanted = policy_codes(code_rows(own, policy_type, codes))
    if with_titles:
        titles = policy_metadata(own, policy_type).select(*POLICY, F.col("title").alias("source_policy_title"))
        wanted = wanted.join(titles, POLICY, "left")
    else:
        wanted = wanted.withColumn("source_policy_title", F.lit(""))
    described = salted_join(links, ncd_metadata(tables), ["related_policy_id", "related_policy_version"], by=POLICY)
    rows = described.join(wanted, POLICY)  # the codes of a policy are more than its links
    return rows.withColumns({"source_policy_type": F.lit(policy_type), "source_policy_title": F.coalesce("source_policy_title", F.lit(""))}).withColumnsRenamed(
        {"policy_id": "source_policy_id", "policy_version": "source_policy_version"}
    )


def ncd_rows(tables: PolicyTables, codes: DataFrame, with_titles: bool = False) -> DataFrame:
    """``ncd_relationships`` without the columns that follow from others."""
    parts = [related_ncd_rows(tables, kind, codes, with_titles) for kind in ("LCD", "Article")]
    return parts[0].unionByName(parts[1])


def finish_ncd(rows: DataFrame) -> DataFrame:
    relation = F.when(F.col("source_policy_type") == "LCD", fixed.NCD_RELATED.format(policy_type="LCD")).otherwise(fixed.NCD_RELATED.format(policy_type="Article"))
    return rows.withColumns(
        {
            "related_policy_type": F.lit("NCD"),
            "relationship_type": relation,
            "source_url": policy_url(F.lit("NCD"), F.col("related_policy_id"), F.col("related_policy_version")),
        }
    ).select(*NCD_COLUMNS)


def ncd_relationships(tables: PolicyTables, codes: DataFrame, with_titles: bool = False) -> DataFrame:
    """National policies that the LCDs and Articles of the wanted codes refer to."""
    return finish_ncd(ncd_rows(tables, codes, with_titles))


def for_code(table: DataFrame, procedure_code: str) -> DataFrame:
    """Rows of one code; a plain equality, so it reaches a Parquet scan."""
    return table.filter(F.col("procedure_code") == procedure_code.strip().upper())
