"""Beneficiary context of claims: who was enrolled in which years, and the volume expected from a provider's patients."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from claimspark.operators.joins import salted_join

AGE_BAND = 10


def yearly_context(beneficiaries: DataFrame) -> DataFrame:
    """``bene_id, year, age, sex``: one row for each person and year of the yearly files.

    Of rows that differ, the largest age with its sex counts. Rows without an id or a year are left out.
    """
    rows = beneficiaries.dropna(subset=["bene_id", "year"])
    best = F.max(F.struct(F.col("age_at_end_of_year").cast("int").alias("age"), F.trim("sex_code").alias("sex"))).alias("best")
    return rows.groupBy("bene_id", F.col("year").cast("int").alias("year")).agg(best).select("bene_id", "year", "best.age", "best.sex")


def enrolment_spells(context: DataFrame) -> DataFrame:
    """``bene_id, first_year, last_year, years``: uninterrupted years of a person in the files."""
    place = F.row_number().over(Window.partitionBy("bene_id").orderBy("year"))
    spell = context.withColumn("spell", F.col("year") - place).groupBy("bene_id", "spell")
    return spell.agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count("*").alias("years")).drop("spell")


def expected_volume(lines: DataFrame, context: DataFrame, band: int = AGE_BAND) -> DataFrame:
    """``provider_id, lines_seen, lines_without_context, person_years, expected_lines, observed_to_expected`` for every provider.

    A stratum is a band of ages and a sex (unknown values are strata too). Its rate is the lines per person-year with service over all providers' patients, a person counted once for each
    provider and year; ``expected_lines`` are a provider's person-years times the rates of their strata (indirect standardisation). Lines
    whose beneficiary is not in the files of the year of service are counted apart. Lines without provider or day are left out.
    """
    known = lines.dropna(subset=["provider_id", "service_date"]).select("provider_id", "bene_id", F.year("service_date").alias("year"))
    visits = known.groupBy("provider_id", "bene_id", "year").agg(F.count("*").alias("lines"))
    people = context.select("bene_id", "year", F.floor(F.col("age") / band).alias("age_band"), "sex", F.lit(True).alias("found"))
    placed = visits.join(people, ["bene_id", "year"], "left")
    found = F.col("found").isNotNull()
    cells = placed.groupBy("provider_id", "age_band", "sex", found.alias("in_files")).agg(F.sum("lines").alias("lines"), F.count("*").alias("persons"))
    stratum = [F.coalesce(F.col("age_band").cast("string"), F.lit("?")), F.coalesce("sex", F.lit("?"))]
    cells = cells.withColumn("stratum", F.concat_ws("|", *stratum))
    inside = cells.filter("in_files")
    rates = inside.groupBy("stratum").agg((F.sum("lines") / F.sum("persons")).alias("rate"))
    expected = salted_join(inside, rates, ["stratum"], by=["provider_id"]).groupBy("provider_id").agg(
        F.sum("lines").alias("lines_seen"), F.sum("persons").alias("person_years"), F.sum(F.col("persons") * F.col("rate")).alias("expected_lines"),
    )
    every = cells.groupBy("provider_id").agg(F.coalesce(F.sum(F.when(~F.col("in_files"), F.col("lines"))), F.lit(0)).alias("lines_without_context"))
    rows = every.join(expected, "provider_id", "left").fillna(0, ["lines_seen", "person_years", "expected_lines"])
    ratio = F.when(F.col("expected_lines") > 0, F.col("lines_seen") / F.col("expected_lines"))
    return rows.select("provider_id", "lines_seen", "lines_without_context", "person_years", "expected_lines", ratio.alias("observed_to_expected"))
