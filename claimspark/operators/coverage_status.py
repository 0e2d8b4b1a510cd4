"""What the policies in force on the day of service say about a procedure.

That no policy was found and that a policy lists the service as not covered are different statements; neither is a
coverage determination.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimspark.operators.dated import join_dated, spells

NO_POLICY, LISTED, NOT_COVERED, NO_DAY = "no matching policy", "listed", "listed as not covered", "no day of service"


def policy_spells(periods: DataFrame) -> DataFrame:
    """``procedure_code, listed_as_covered, effective_date, end_date, periods`` from the periods of single policies.

    Policies that follow or overlap one another are one spell, for each of the two kinds of listing.
    """
    return spells(periods, ["procedure_code", "listed_as_covered"], "effective_date", "end_date")


def coverage_status(lines: DataFrame, periods: DataFrame, by: list[str]) -> DataFrame:
    """``lines`` with ``coverage_status``, the spells it rests on and ``also_listed``.

    ``periods`` has ``procedure_code``, ``listed_as_covered`` (boolean), ``effective_date`` and ``end_date`` (inclusive, NULL open). A listing as not
    covered goes before one as covered; ``also_listed`` marks days on which policies differ. Lines without a day or a
    code match no policy; without a day they say so.
    """
    merged = policy_spells(periods)
    out = lines
    for covered, name in ((True, "listed"), (False, "not_covered")):
        own = merged.filter(F.col("listed_as_covered") == covered)
        own = own.select("procedure_code", F.col("effective_date").alias(f"{name}_from"), F.col("end_date").alias(f"{name}_to"))
        found = join_dated(out, own, ["procedure_code"], "service_date", f"{name}_from", f"{name}_to", by=by)
        out = found.withColumn(name, F.col("versions_in_force") > 0).drop("versions_in_force")
    status = (
        F.when(F.col("service_date").isNull(), NO_DAY).when(F.col("not_covered"), NOT_COVERED).when(F.col("listed"), LISTED).otherwise(NO_POLICY)
    )
    return out.withColumns({"coverage_status": status, "also_listed": F.col("listed") & F.col("not_covered")}).drop("listed", "not_covered")
