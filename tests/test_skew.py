"""One procedure holds most rows: its work must be spread, and results must stay exact."""

import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimspark.operators import peers, utilization
from claimspark.operators.joins import salted_join
from claimspark.operators.ranks import exact_quantiles, running_counts, value_counts

PARTITIONS = 8


@pytest.fixture(autouse=True)
def fixed_partitions(spark):
    """Plain hash partitions without adaptive merging, so that the spread can be counted."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(PARTITIONS))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) / sum(sizes)


@pytest.fixture(scope="module")
def hot(spark):
    """9 of 10 providers belong to one procedure, half of those with the same rate."""
    rng = random.Random(11)
    rows = []
    for i in range(20_000):
        code = "HOT" if i % 10 else f"C{i % 70}"
        rate = 1.0 if rng.random() < 0.5 else rng.uniform(1, 30)
        rows.append((f"P{i}", "NPI", code, 1, 1, 0.0, rate))
    return spark.createDataFrame(
        rows,
        "provider_id string, provider_id_type string, procedure_code string, claim_count bigint, "
        "beneficiary_count bigint, total_allowed double, procedure_rate double",
    )


def test_ranking_a_hot_code_is_spread(hot):
    ranked = running_counts(value_counts(hot, ["procedure_code"], "procedure_rate"), ["procedure_code"], "procedure_rate")
    assert largest_share(ranked) < 2.5 / PARTITIONS


def test_lookup_of_a_hot_key_is_spread(hot):
    totals = hot.groupBy("procedure_code").agg(F.count(F.lit(1)).alias("n"))
    joined = salted_join(hot, totals, ["procedure_code"], by=["provider_id"])
    assert joined.count() == hot.count()
    assert largest_share(joined) < 3.5 / PARTITIONS
    plain = hot.join(totals, "procedure_code")
    assert largest_share(plain) > 0.85  # what the salt avoids


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.range(500).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([(0, "a"), (3, "b"), (9, "c")], "k long, w string")
    got = sorted(map(tuple, salted_join(left, right, ["k"], by=["v"], how=how).collect()))
    assert got == sorted(map(tuple, left.join(right, "k", how).collect()))


def test_hot_code_results_are_exact(hot):
    frame = hot.select("provider_id", "procedure_code", "procedure_rate").toPandas()
    rates = frame[frame.procedure_code == "HOT"].set_index("provider_id").procedure_rate
    got = {r.provider_id: r for r in peers.peer_comparison_all(hot).filter("procedure_code = 'HOT'").collect()}
    assert len(got) == len(rates)
    for provider in random.Random(2).sample(list(rates.index), 25):
        others = rates.drop(provider)
        assert got[provider].peer_median == others.median()
        assert got[provider].peer_p95 == others.quantile(0.95)
        assert got[provider].percentile == pytest.approx((others <= rates[provider]).mean() * 100, abs=0.005)


def test_hot_code_median_and_counts(spark):
    rng = random.Random(4)
    data = [(f"c{i % 4000}", f"b{i % 900}", f"P{i % 300}", round(rng.uniform(1, 500), 2)) for i in range(20_000)]
    lines = spark.createDataFrame(data, "source_claim_id string, bene_id string, provider_id string, allowed_amount double").selectExpr(
        "'HOT' procedure_code", "'HCPCS/CPT' code_system", "'carrier' claim_type", "*", "'11' place_of_service_code",
        "date'2020-01-01' service_date", "array('D1', bene_id) diagnosis_codes",
    )
    (row,) = utilization.procedure_stats(lines).collect()
    assert (row.claim_count, row.unique_beneficiaries, row.unique_providers, row.unique_diagnoses) == (4000, 900, 300, 901)
    assert row.median_allowed == pd.Series([d[3] for d in data]).median()
    counts = Counter(d[3] for d in data)
    assert exact_quantiles(lines, ["procedure_code"], "allowed_amount", {"top": 1.0}).first().top == max(counts)
