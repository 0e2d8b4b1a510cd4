"""Peers by several characteristics, backing off to fewer where a group is too small."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimspark.operators.joins import BROADCAST_ROWS, salted_join
from claimspark.session import materialise

MIN_PEERS = 5


def backed_off_peers(pairs: DataFrame, levels: list[list[str]], min_peers: int = MIN_PEERS) -> DataFrame:
    """Every row of ``pairs`` with the first of ``levels`` in which it has at least ``min_peers`` others.

    ``pairs`` has ``provider_id, procedure_code, claim_count, beneficiary_count`` and the characteristics; ``levels`` are lists of column names from the finest
    to the coarsest. Adds ``peer_level`` (from 0, NULL where no level has enough), ``peer_group`` (its columns), ``peers``, ``peer_rate``
    (claims per beneficiary of the others together: totals minus own) and ``rate_ratio``. All levels are counted in one pass, each row
    once a level; NULL characteristics are a value of their own, rows without provider or procedure are counted but have no peers. The totals are written
    and counted: few go to every task, so that rows stay where they are; more meet the rows by salted keys, so a group of a third of all rows is spread.
    """
    columns = sorted({c for level in levels for c in level})
    known = {c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns}
    sets = F.array(*[
        F.struct(F.lit(n).alias("level"), *[(known[c] if c in level else F.lit("")).alias(f"key {c}") for c in columns]) for n, level in enumerate(levels)
    ])
    own = pairs.select("claim_count", "beneficiary_count", F.explode(sets).alias("set")).select("claim_count", "beneficiary_count", "set.*")
    keys = [f"key {c}" for c in columns]
    totals = own.groupBy("level", *[F.col(f"`{k}`") for k in keys]).agg(F.count("*").alias("members"), F.sum("claim_count").alias("claims"), F.sum("beneficiary_count").alias("people"))
    totals = materialise(totals.filter(F.col("members") > min_peers), "peer-totals")
    few = totals.count() <= BROADCAST_ROWS
    rows, found = pairs, []
    for n, level in enumerate(levels):
        rows = rows.withColumns({f"key {c}": known[c] if c in level else F.lit("") for c in columns})
        of_level = totals.filter(F.col("level") == n).select(*[F.col(f"`{k}`") for k in keys], F.struct("members", "claims", "people").alias(f"totals {n}"))
        rows = rows.join(F.broadcast(of_level), keys, "left") if few else salted_join(rows, of_level, keys, by=["provider_id", "procedure_code"], how="left")
        rows = rows.drop(*keys)
        t = F.col(f"totals {n}")
        facts = F.struct(
            F.lit(n).alias("level"), (t["members"] - 1).alias("peers"), (t["claims"] - F.col("claim_count")).alias("claims"), (t["people"] - F.col("beneficiary_count")).alias("people")
        )
        found.append(F.when(t.isNotNull(), facts))
    names = F.array(*[F.lit(", ".join(level)) for level in levels])
    named = F.col("provider_id").isNotNull() & F.col("procedure_code").isNotNull()
    rows = rows.select(*pairs.columns, F.when(named, F.coalesce(*found)).alias("best"))
    peer_rate = F.when(F.col("best.people") > 0, F.col("best.claims") / F.col("best.people"))
    rate = F.when(F.col("beneficiary_count") > 0, F.col("claim_count") / F.col("beneficiary_count"))
    return rows.select(
        *pairs.columns, F.col("best.level").alias("peer_level"), F.get(names, F.col("best.level")).alias("peer_group"), F.col("best.peers").alias("peers"),
        peer_rate.alias("peer_rate"), F.when(peer_rate > 0, rate / peer_rate).alias("rate_ratio"),
    )


def main_place(lines: DataFrame) -> DataFrame:
    """``provider_id, main_place``: the place of service on most of a provider's lines, the first by name of several."""
    counts = lines.dropna(subset=["provider_id", "place_of_service_code"]).groupBy("provider_id", "place_of_service_code").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("fewness"), "place_of_service_code")).alias("best")
    return counts.groupBy("provider_id").agg(best).select("provider_id", F.col("best.place_of_service_code").alias("main_place"))
