"""Procedures billed on one claim more often than their own frequencies let expect.

Codes below the support cannot be in a pair that reaches it and go first. The remaining codes of a claim are dealt into blocks, and
each two blocks of a claim meet in a cell of their own: a claim of ordinary size is one cell, one with very many codes
is many small ones, spread over the tasks and complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from claimspark.session import materialise

BLOCK_CODES = 64  # codes of a claim in one block, on average


def code_pairs(items: DataFrame, claim: str, code: str, block_codes: int = BLOCK_CODES) -> DataFrame:
    """``code_a, code_b, claims_both`` for all pairs of different codes on a claim, a before b; ``items`` has distinct claims and codes."""
    sizes = items.groupBy(F.col(claim).alias("sized")).agg(F.ceil(F.count("*") / block_codes).alias("blocks"))
    dealt = items.join(sizes, F.col(claim) == F.col("sized")).select(
        F.col(claim).alias("claim"), F.col(code).alias("code"), "blocks", F.pmod(F.xxhash64(code), "blocks").alias("block")
    )
    low = dealt.select("claim", F.col("code").alias("x"), F.col("block").alias("low"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("high"))
    high = dealt.select("claim", F.col("code").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("low"), F.col("block").alias("high"))
    met = low.join(high, ["claim", "low", "high"]).filter("low < high OR x < y")
    return met.groupBy(F.least("x", "y").alias("code_a"), F.greatest("x", "y").alias("code_b")).agg(F.count("*").alias("claims_both"))


def codes_beside(lines: DataFrame, claim: str = "claim_key", block_codes: int = BLOCK_CODES) -> DataFrame:
    """``provider_id, procedure_code, other_code, claims``: on how many of a provider's claims with a procedure another one is billed, by whomever.

    Lines without claim, code or provider are not a provider's; their codes are still others on their claims. Blocks of a claim's codes meet
    in cells as in ``code_pairs``. The codes of claims with several ones are written once and read for both sides. Lines are moved once, to their
    claim, and what is found once, to its provider and procedure, where the rows of the two stay.
    """
    items = lines.dropna(subset=[claim, "procedure_code"]).select(F.col(claim).alias("claim"), F.col("procedure_code").alias("code"), "provider_id")
    items = items.repartition("claim")
    billed = items.groupBy("claim", "code").agg(F.collect_set("provider_id").alias("providers"))
    billed = billed.withColumn("codes", F.count("*").over(Window.partitionBy("claim"))).filter("codes > 1")
    billed = materialise(billed.withColumn("blocks", F.ceil(F.col("codes") / block_codes)), "billed-codes")
    block, all_blocks = F.pmod(F.xxhash64("code"), "blocks"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    mine = billed.select("claim", "code", "blocks", F.explode("providers").alias("provider_id"))
    mine = mine.select("claim", "provider_id", F.col("code").alias("procedure_code"), block.alias("one"), F.explode(all_blocks).alias("two"))
    others = billed.select("claim", F.col("code").alias("other_code"), block.alias("two"), F.explode(all_blocks).alias("one"))
    met = mine.join(others, ["claim", "one", "two"]).filter("procedure_code <> other_code")
    met = met.select("provider_id", "procedure_code", "other_code").repartition("provider_id", "procedure_code")
    return met.groupBy("provider_id", "procedure_code", "other_code").agg(F.count("*").alias("claims"))


def billed_together(lines: DataFrame, min_claims: int = 3, claim: str = "claim_key", code: str = "procedure_code", block_codes: int = BLOCK_CODES) -> DataFrame:
    """Pairs of procedures on at least ``min_claims`` common claims, with their measures.

    ``code_a, code_b, claims_both, claims_a, claims_b, support`` (share of all claims with a code), ``confidence_ab`` (share of a's claims with b),
    ``confidence_ba``, ``lift`` (times as often as if the codes were independent). A code counts once a claim. Lines without
    claim or code are left out; lines without a claim id are claims of one line.
    """
    items = lines.dropna(subset=[claim, code]).select(claim, code).distinct()
    counts = items.groupBy(code).agg(F.count("*").alias("claims"))
    frequent = counts.filter(F.col("claims") >= min_claims)
    pairs = code_pairs(items.join(frequent.select(code), code, "left_semi"), claim, code, block_codes).filter(F.col("claims_both") >= min_claims)
    total = items.select(claim).distinct().agg(F.count("*").alias("all_claims"))
    first = frequent.select(F.col(code).alias("code_a"), F.col("claims").alias("claims_a"))
    second = frequent.select(F.col(code).alias("code_b"), F.col("claims").alias("claims_b"))
    both, n = F.col("claims_both").cast("double"), F.col("all_claims").cast("double")
    joined = pairs.join(first, "code_a").join(second, "code_b").withColumn("one", F.lit(1)).join(total.withColumn("one", F.lit(1)), "one")
    return joined.select(
        "code_a", "code_b", "claims_both", "claims_a", "claims_b", (both / n).alias("support"), (both / F.col("claims_a")).alias("confidence_ab"),
        (both / F.col("claims_b")).alias("confidence_ba"), (both * n / (F.col("claims_a").cast("double") * F.col("claims_b"))).alias("lift"),
    )
