"""How far a provider's mix of diagnoses or places for a procedure is from that of all its other providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimspark.operators.claim_lines import lines_with_code
from claimspark.operators.joins import measured_join
from claimspark.operators.utilization import explode_diagnoses

PAIR = ["provider_id", "procedure_code"]


def known_items(rows: DataFrame, item: str, weight: str | None = None) -> DataFrame:
    """``provider_id, procedure_code, item, times`` without NULLs."""
    return rows.select(*PAIR, F.col(item).alias("item"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("times")).dropna()


def own_items(known: DataFrame) -> DataFrame:
    """Each item of a pair once, ``n`` times, with the pair's ``rows`` and ``kinds``; ``known_items`` that lie in the place of their pair are not moved."""
    pair = Window.partitionBy(*PAIR)
    own = known.groupBy(*PAIR, "item").agg(F.sum("times").alias("n"))
    return own.withColumns({"rows": F.sum("n").over(pair), "kinds": F.count("*").over(pair)})


def mix_divergence(rows: DataFrame, item: str, weight: str | None = None, placed: DataFrame | None = None) -> DataFrame:
    """``provider_id, procedure_code, rows, kinds, peer_rows, divergence, most_over, over_by`` for rows of provider, procedure and ``item``.

    ``divergence`` is the Jensen-Shannon divergence (base 2, from 0 for equal mixes to 1 for mixes without a common item) between
    the provider's shares and those of all others together, which are the totals minus its own: providers are never paired. Items the
    provider does not have add half their share among the others, so one look at the provider's own items is enough. ``most_over`` is the item whose share
    exceeds the others' most (the first by name), by ``over_by``. Without other rows these three and the divergence are NULL; rows with a NULL in one of the columns are left out.
    A row counts ``weight`` times, without it once. Items are moved once, to the place of their pair, unless ``placed`` has the same rows there already;
    the totals are small lookups.
    """
    known = known_items(rows, item, weight)
    return divergence_of(own_items(known.repartition(*PAIR) if placed is None else known_items(placed, item, weight)), known)


def divergence_of(own: DataFrame, known: DataFrame) -> DataFrame:
    """The figures of ``mix_divergence`` from ``own_items`` and the rows with ``procedure_code, item, times`` that make up the totals."""
    items = known.groupBy("procedure_code", "item").agg(F.sum("times").alias("item_rows"))
    procedures = known.groupBy("procedure_code").agg(F.sum("times").alias("all_rows"))
    sized = measured_join(own, procedures, ["procedure_code"], by=["provider_id"]).withColumn("peer_rows", F.col("all_rows") - F.col("rows")).drop("all_rows")
    shares = measured_join(sized, items, ["procedure_code", "item"], by=["provider_id"])
    shares = shares.withColumns({"p": F.col("n") / F.col("rows"), "q": F.when(F.col("peer_rows") > 0, (F.col("item_rows") - F.col("n")) / F.col("peer_rows"))})
    p, q, middle = F.col("p"), F.col("q"), (F.col("p") + F.col("q")) / 2

    def part(share: Column) -> Column:
        return F.when(share > 0, share * F.log2(share / middle)).otherwise(0.0)

    found = shares.groupBy(*PAIR, "rows", "kinds", "peer_rows").agg(
        F.sum((part(p) + part(q)) / 2).alias("seen"), F.sum("q").alias("common"), F.min(F.struct((q - p).alias("gap"), "item")).alias("over"),
    )
    compared = F.col("peer_rows") > 0
    divergence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("seen") + (1 - F.col("common")) / 2))
    return found.select(
        *PAIR, "rows", "kinds", "peer_rows", F.when(compared, divergence).alias("divergence"),
        F.when(compared, F.col("over.item")).alias("most_over"), F.when(compared, -F.col("over.gap")).alias("over_by"),
    )


def diagnosis_mix(lines: DataFrame) -> DataFrame:
    """Lines are moved with their list of diagnoses, not once for each."""
    coded = lines_with_code(lines).filter("provider_id IS NOT NULL").select(*PAIR, "diagnosis_codes")
    return mix_divergence(explode_diagnoses(coded), "diagnosis_code", placed=explode_diagnoses(coded.repartition(*PAIR)))


def place_mix(lines: DataFrame) -> DataFrame:
    """Places of service exist for carrier lines only."""
    return mix_divergence(lines_with_code(lines), "place_of_service_code")
