"""Claim, beneficiary, policy and description inputs derived from the star-schema test tables.

The raw tables are text with the defects that real extracts have: blank ids and codes, outer white
space, thousands commas, several date notations, unreadable cells, repeated rows, old versions.
Every source row is used.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from claimspark.operators.claim_lines import combine_claim_lines
from claimspark.operators.normalize import normalize_source

AS_OF = datetime.date(2020, 6, 30)
CLAIM_TYPES = ["carrier", "outpatient", "inpatient"]


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; the footer is read for the schema only once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def blank_when(condition: Column, value: Column) -> Column:
    return F.when(condition, F.lit("")).otherwise(value)


def one_of(names: list[str], number: Column) -> Column:
    """Share rows out over the names by a number."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), (number % len(names) + 1).cast("int"))


def procedure_code_text() -> Column:
    """Code text made from brand and size of a part."""
    return F.concat(F.replace("p_brand", F.lit("Brand#"), F.lit("B")), F.lit("-"), (F.col("p_size") % 8).cast("string"))


def date_text(day: Column, choice: Column) -> Column:
    return (
        F.when(choice == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(choice == 1, F.date_format(day, "dd/MM/yyyy"))
        .when(choice == 2, F.date_format(day, "d-M-yyyy"))
        .otherwise(F.concat(F.lit(" "), F.date_format(day, "dd-MMM-yyyy")))
    )


def number_text(value: Column, choice: Column) -> Column:
    return F.when(choice == 0, F.format_number(value, 4)).otherwise(
        F.concat(value.cast("decimal(18,4)").cast("string"), F.lit(" "))
    )


BASE_COLUMNS = [
    "l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus", "ship_day", "charge", "claim_code", "number_form", "blank_place", "o_custkey", "o_orderstatus",
    "o_orderpriority", "claim_type",
]


def claim_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with what the claims need of their orders and parts.

    ``charge`` is the net price of a carrier line and the price of an outpatient line. It and the day are made before lines are moved. Lines
    meet the parts first, and what follows from the part stands in for it when they are moved the second time.
    """
    lines = table(spark, sf_dir, "lineitem")
    number, price = F.col("l_linenumber"), F.col("l_extendedprice")
    kind = F.when(number.isNotNull(), one_of(CLAIM_TYPES, number))  # element_at alone may give the last one for NULL
    lines = lines.withColumns({
        "ship_day": F.col("l_shipdate").cast("date"),
        "charge": F.when(kind == "carrier", price * (1 - F.col("l_discount"))).when(kind == "outpatient", price),
    })
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    part = F.col("l_partkey")
    coded = lines.join(parts, lines.l_partkey == parts.p_partkey).withColumns({
        "claim_code": blank_when(part % 97 == 0, procedure_code_text()), "number_form": (part % 3).cast("int"), "blank_place": part % 11 == 0,
    })
    return coded.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("claim_type", kind)


def raw_claims(base: DataFrame, claim_type: str, with_file: bool = False) -> DataFrame:
    """Raw text lines of one claim type under the source column names, from ``claim_base``."""
    base = base.filter(F.col("claim_type") == claim_type)
    supplier = F.col("l_suppkey")
    day = F.col("ship_day")
    individual = blank_when(supplier % 5 == 0, supplier.cast("string"))
    columns = {
        "BENE_ID": F.col("o_custkey").cast("string"),
        "CLM_ID": blank_when(F.col("l_orderkey") % 101 == 0, F.col("l_orderkey").cast("string")),
        "CLM_FROM_DT": F.when(F.col("l_orderkey") % 113 == 0, F.lit("31-Feb-2019")).otherwise(date_text(day, supplier % 7)),
        "ORG_NPI_NUM": blank_when(supplier % 10 == 0, F.concat(F.lit("ORG"), (supplier % 7).cast("string"))),
        "HCPCS_CD": blank_when(F.col("claim_code") == "", F.concat(F.lit(" "), F.col("claim_code"), F.lit(" "))),
        "ICD_DGNS_CD1": F.col("o_orderpriority"),
        "ICD_DGNS_CD2": F.concat("l_linestatus", "o_orderstatus"),
    }
    if claim_type == "carrier":
        columns |= {
            "PRF_PHYSN_NPI": individual,
            "LINE_PLACE_OF_SRVC_CD": blank_when(F.col("blank_place"), F.col("l_returnflag")),
            "LINE_ICD_DGNS_CD": F.when(F.col("l_linestatus") == "F", F.col("o_orderpriority")).otherwise("LINE"),
            "LINE_ALOWD_CHRG_AMT": F.when(F.col("l_orderkey") % 127 == 0, F.lit("n/a")).otherwise(
                number_text(F.col("charge"), F.col("number_form"))
            ),
        }
    else:
        attending = F.when(supplier % 15 == 0, F.concat(F.lit("AT"), supplier.cast("string"))).otherwise("")
        operating = F.when(supplier % 25 == 0, F.concat(F.lit("OP"), supplier.cast("string"))).otherwise("")
        columns["PRVDR_NUM"] = F.concat(F.lit("F"), supplier.cast("string"))
        if claim_type == "outpatient":
            columns |= {
                "RNDRNG_PHYSN_NPI": individual,
                "AT_PHYSN_NPI": attending,
                "REV_CNTR_TOT_CHRG_AMT": number_text(F.col("charge"), F.col("number_form")),
            }
        else:
            columns |= {"AT_PHYSN_NPI": individual, "OP_PHYSN_NPI": operating}
    if with_file:
        columns["source_file"] = F.concat(F.lit(f"{claim_type}_"), "l_returnflag", F.lit(".csv"))
    return base.select(*[c.alias(n) for n, c in columns.items()])


def processed_claims(base: DataFrame, claim_type: str) -> DataFrame:
    return normalize_source(raw_claims(base, claim_type), claim_type)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All claim lines, through the text round trip."""
    base = claim_base(spark, sf_dir)
    return combine_claim_lines({kind: processed_claims(base, kind) for kind in CLAIM_TYPES})


def raw_beneficiaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly beneficiary rows with repeats: one per order, in the file of the order's year."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("file_year"))
    people = table(spark, sf_dir, "customer")
    joined = orders.join(people, orders.o_custkey == people.c_custkey)
    birth = F.date_add(F.lit(datetime.date(1930, 1, 1)), (F.col("c_custkey") % 9000).cast("int"))
    return joined.select(
        F.col("file_year").cast("int").alias("year"),
        F.col("o_custkey").cast("string").alias("BENE_ID"),
        blank_when(F.col("c_custkey") % 31 == 0, date_text(birth, F.col("c_custkey") % 5)).alias("BENE_BIRTH_DT"),
        (F.col("file_year") - F.year(birth)).cast("string").alias("AGE_AT_END_REF_YR"),
        F.concat(F.lit(" "), F.col("c_mktsegment")).alias("SEX_IDENT_CD"),
        F.col("c_nationkey").cast("string").alias("BENE_RACE_CD"),
        F.concat(F.lit("beneficiary_"), F.col("file_year").cast("string"), F.lit(".csv")).alias("source_file"),
    )


# --- policies --------------------------------------------------------------------------------


def coverage_tables(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> dict[str, dict[str, DataFrame]]:
    """LCDs are the odd suppliers, Articles the even ones, contractors the nations, states and NCDs the regions.

    ``base`` is a finished ``claim_base``; without it the joins are made for each table that takes lines.
    """
    kind_of = one_of(["Article", "LCD"], F.col("s_suppkey"))
    suppliers = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .withColumn("kind", kind_of)
    )
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    claims = (claim_base(spark, sf_dir) if base is None else base).withColumnRenamed("l_suppkey", "s_suppkey").withColumn("kind", kind_of)
    key = F.col("s_suppkey")
    current = (key % 3 + 1).cast("string")

    def text(column: Column, name: str) -> Column:
        return column.cast("string").alias(name)

    contractor_tables = {
        "contractor": nations.select(
            text(F.col("n_nationkey"), "contractor_id"), F.lit("2").alias("contractor_type_id"),
            F.lit("1").alias("contractor_version"),
            blank_when(F.col("n_nationkey") % 9 == 0, F.col("n_name")).alias("contractor_bus_name"),
        ),
        "contractor_jurisdiction": nations.select(
            text(F.col("n_nationkey"), "contractor_id"), F.lit("2").alias("contractor_type_id"),
            F.lit("1").alias("contractor_version"),
            F.explode(F.array(
                F.struct(
                    text(F.col("n_regionkey"), "state_id"),
                    F.when(F.col("n_nationkey") % 4 == 1, "2030-01-01").otherwise("2010-01-01 00:00:00").alias("active_date"),
                    F.when(F.col("n_nationkey") % 4 == 0, "12/31/2015").otherwise("").alias("term_date"),
                ),
                F.struct(
                    text((F.col("n_regionkey") + 1) % 5, "state_id"),
                    F.lit("").alias("active_date"),
                    F.when(F.col("n_nationkey") % 3 == 0, "2020-06-29").otherwise("2020-06-30").alias("term_date"),
                ),
            )).alias("area"),
        ).select("contractor_id", "contractor_type_id", "contractor_version", "area.*"),
        "state_lookup": regions.select(
            text(F.col("r_regionkey"), "state_id"), F.substring("r_name", 1, 2).alias("state_abbrev"),
            F.col("r_regionkey").cast("long").alias("ingest_pos"),
        ),
    }

    def documents(kind: str, own: DataFrame) -> DataFrame:
        """A draft, the current version (twice, the later row counts) and an old version per policy."""
        prefix, letter = kind.lower(), kind[0]
        dates = {
            "LCD": [("rev_eff_date", ""), ("orig_det_eff_date", "2019-01-01"), ("ent_det_end_date", "2031-01-01")],
            "Article": [("article_eff_date", "2018-05-05"), ("article_end_date", ""), ("date_retired", "2032-02-02")],
        }[kind]
        versions = F.array(
            F.struct(F.lit("0").alias("version"), F.lit("Old ").alias("mark"), F.lit(0).alias("step")),
            F.struct(current.alias("version"), F.lit("Draft ").alias("mark"), F.lit(1).alias("step")),
            F.struct(current.alias("version"), F.lit("").alias("mark"), F.lit(2).alias("step")),
        )
        rows = own.withColumn("v", F.explode(versions))
        return rows.select(
            F.concat(F.lit(" "), key.cast("string")).alias(f"{prefix}_id"),
            F.col("v.version").alias(f"{prefix}_version"),
            F.concat(F.lit(letter), key.cast("string")).alias("display_id"),
            F.concat(F.col("v.mark"), F.col("s_name")).alias("title"),
            F.lit("A").alias("status"),
            *[F.lit(value).alias(name) for name, value in dates],
            (key * 10 + F.col("v.step")).cast("long").alias("ingest_pos"),
        )

    def policy_set(kind: str) -> dict[str, DataFrame]:
        prefix = kind.lower()
        own = suppliers.filter(F.col("kind") == kind)
        lines_of = claims.filter(F.col("kind") == kind)
        policy = [text(key, f"{prefix}_id"), current.alias(f"{prefix}_version")]
        codes = lines_of.select("s_suppkey", F.col("claim_code").alias("code")).distinct()
        # Some code rows name a version that has no document and must drop out.
        code_version = F.when(key % 13 == 0, "9").otherwise(current)
        contractors = F.array_distinct(F.array(F.col("s_nationkey"), (F.col("s_nationkey") * (key % 2 + 1)) % 25))
        return {
            prefix: documents(kind, own),
            f"{prefix}_x_hcpc_code": codes.select(
                text(key, f"{prefix}_id"), code_version.alias(f"{prefix}_version"),
                F.concat(F.lit(" "), F.lower("code")).alias("hcpc_code_id"),
                F.concat(F.lit("Procedure "), F.col("code")).alias("long_description"),
                F.col("code").alias("short_description"),
            ),
            # Some links name no contractor.
            f"{prefix}_x_contractor": own.withColumn("nation", F.explode(contractors)).select(
                *policy, blank_when(key % 7 == 0, F.col("nation").cast("string")).alias("contractor_id"),
                F.lit("2").alias("contractor_type_id"), F.lit("1").alias("contractor_version"),
            ),
            f"{prefix}_x_primary_jurisdiction": own.select(*policy, text(F.col("n_regionkey"), "state_id")),
            f"{prefix}_related_ncd_documents": own.select(
                *policy, text(F.col("n_regionkey"), "r_ncd_id"), F.lit("1").alias("r_ncd_version")
            ),
            **contractor_tables,
            "_lines": lines_of,
        }

    lcd, article = policy_set("LCD"), policy_set("Article")
    priorities = article.pop("_lines").select("s_suppkey", "o_orderpriority", "l_returnflag").distinct()
    lcd.pop("_lines")
    for name, wanted in (("covered", F.col("l_returnflag") == "A"), ("noncovered", F.col("l_returnflag") != "A")):
        article[f"article_x_icd10_{name}"] = (
            priorities.filter(wanted).select("s_suppkey", "o_orderpriority").distinct().select(
                text(key, "article_id"), current.alias("article_version"),
                F.col("o_orderpriority").alias("icd10_code_id"),
                F.concat(F.lit(f"{name} "), F.col("o_orderpriority")).alias("description"),
            )
        )
    ncd = {
        "ncd_trkg": regions.select(
            text(F.col("r_regionkey"), "NCD_id"), F.lit("1").alias("NCD_vrsn_num"),
            F.col("r_name").alias("NCD_mnl_sect_title"), F.lit("2017-07-07").alias("NCD_efctv_dt"),
            F.lit("").alias("NCD_trmntn_dt"), F.col("r_regionkey").cast("long").alias("ingest_pos"),
        )
    }
    return {"LCD": lcd, "Article": article, "NCD": ncd}


def policy_records(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Policy index records from the documents, whole texts as titles."""
    docs = table(spark, sf_dir, "documents")
    records = docs.select(
        one_of(["NCD", "LCD", "Article"], F.col("doc_id")).alias("kind"),
        F.col("doc_id").cast("string").alias("document_id"),
        F.when(F.col("n_chars") % 4 != 0, (F.col("n_chars") % 4).cast("string")).alias("document_version"),
        F.concat(F.upper("lang"), F.lit("."), F.col("doc_id").cast("string")).alias("document_display_id"),
        F.col("text").alias("title"),
        F.when(F.col("n_chars") % 2 == 0, "Final").alias("document_status"),
        F.lit("Active").alias("status"),
        F.lit("2026-09-24").alias("updated_on"),
        F.col("source").alias("contractor_name_type"),
        F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("url"),
    )
    return {kind: records.filter(F.col("kind") == kind).drop("kind") for kind in ("NCD", "LCD", "Article")}


def policy_code_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies (suppliers) with the array of the codes on their lines, untidy spelling included."""
    code = blank_when(F.col("l_partkey") % 97 == 0, procedure_code_text())
    untidy = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit(" "), F.lower(code))).otherwise(code)
    listed = claim_base(spark, sf_dir).select("l_suppkey", untidy.alias("code")).filter(F.trim("code") != "")
    return listed.groupBy(
        F.col("l_suppkey").cast("string").alias("policy_id")
    ).agg(F.collect_set("code").alias("procedure_codes"))


def description_entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entries of two description sources. The first lacks texts for one size class."""
    parts = table(spark, sf_dir, "part")
    place = [
        (F.col("p_partkey") % 3 + 1).cast("int").alias("file_rank"),
        F.lit(1).alias("entry_rank"),
        F.col("p_partkey").alias("row_rank"),
    ]
    first = parts.select(
        F.concat(F.lower(procedure_code_text()), F.lit(" ")).alias("code"),
        blank_when(F.col("p_size") % 8 == 0, F.concat_ws(" ", "p_name", "p_type")).alias("description"),
        *place,
    )
    second = parts.select(
        procedure_code_text().alias("code"),
        blank_when(F.col("p_brand") == "Brand#1", F.col("p_type")).alias("description"),
        *place,
    )
    return first, second
