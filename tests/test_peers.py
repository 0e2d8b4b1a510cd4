import math
import random

import numpy as np
import pandas as pd
import pytest

from claimspark.operators import anomaly, peers, ranks
from claimspark.operators.forest import average_path, fit_forest

STATS = (
    "provider_id string, provider_id_type string, procedure_code string, claim_count bigint, beneficiary_count bigint, "
    "total_allowed double, procedure_rate double, procedure_rate_basis string"
)


def stats_of(spark, data):
    return spark.createDataFrame([(p, "NPI", c, n, b, 0.0, r, "basis") for p, c, n, b, r in data], STATS)


@pytest.fixture(scope="module")
def small(spark):
    return stats_of(spark, [("NPI:1", "A123", 10, 5, 2.0), ("NPI:2", "A123", 2, 1, 2.0), ("NPI:3", "A123", 4, 2, 1.0)])


def test_peer_comparison(small, rows):
    (row,) = rows(peers.provider_peer_comparison(small, "NPI:1", "A123"))
    assert (row["provider_rate"], row["peer_median"], row["percentile"], row["peer_count"]) == (2.0, 1.5, 100.0, 2)
    assert row["rate_ratio"] == 1.3333333333333333


def test_unknown_provider_or_code(small, rows):
    (row,) = rows(peers.provider_peer_comparison(small, "NPI:9", "A123"))
    assert (row["provider_rate"], row["peer_median"], row["percentile"], row["peer_count"]) == (None, 2.0, None, 3)
    (row,) = rows(peers.provider_peer_comparison(small, "NPI:1", "none"))
    assert row["provider_id"] == "NPI:1" and row["peer_count"] == 0
    assert all(row[c] is None for c in ("provider_rate", "peer_median", "peer_p90", "peer_p95", "rate_ratio", "percentile"))


def brute_force(frame):
    out = {}
    for code, group in frame.groupby("code"):
        for p, r in zip(group.provider, group.rate):
            others = group.rate[group.provider != p].dropna()
            known = not pd.isna(r)
            median = others.median() if len(others) else None
            out[p, code] = (
                median,
                others.quantile(0.9) if len(others) else None,
                others.quantile(0.95) if len(others) else None,
                r / median if known and median else None,
                np.round((others <= r).mean() * 100, 2) if known and len(others) else None,
                len(others),
            )
    return out


def test_all_pairs_against_brute_force(spark):
    rng = random.Random(5)
    data = []
    for code, size in {"one": 1, "two": 2, "three": 3, "ties": 60, "wide": 130, "zeros": 9}.items():
        for i in range(size):
            rate = {"ties": rng.choice([1.0, 1.5, 2.0]), "zeros": 0.0}.get(code, rng.randint(1, 400) / rng.randint(1, 50))
            data.append((f"P{i}", code, 1, 1, None if rng.random() < 0.1 and size > 3 else rate))
    frame = pd.DataFrame([(p, c, r) for p, c, _, _, r in data], columns=["provider", "code", "rate"])
    expected = brute_force(frame)
    got = peers.peer_comparison_all(stats_of(spark, data)).collect()
    assert len(got) == len(data)
    for r in got:
        values = (r.peer_median, r.peer_p90, r.peer_p95, r.rate_ratio, r.percentile, r.peer_count)
        assert values == expected[r.provider_id, r.procedure_code], (r, expected[r.provider_id, r.procedure_code])


def test_exact_quantiles(spark):
    rng = random.Random(3)
    values = [("k1", rng.uniform(-50, 50)) for _ in range(400)] + [("k1", v) for v in (0.0, -0.0, 1e-300, 1e300, -1e300)]
    values += [("k2", 7.25)] * 5 + [("k2", None), ("k3", None)]
    df = spark.createDataFrame(values, "k string, v double")
    wanted = {"q0": 0.0, "q10": 0.1, "q50": 0.5, "q95": 0.95, "q100": 1.0}
    got = {r.k: r for r in ranks.exact_quantiles(df, ["k"], "v", wanted).collect()}
    assert set(got) == {"k1", "k2"}
    for key in got:
        series = pd.Series([v for k, v in values if k == key]).dropna()
        assert got[key].n_total == len(series)
        for name, q in wanted.items():
            assert got[key][name] == series.quantile(q)
    (overall,) = ranks.exact_quantiles(df, [], "v", {"m": 0.5}).collect()
    assert overall.m == pd.Series([v for _, v in values]).median()


def test_buckets_never_decrease(spark):
    rng = random.Random(8)
    values = sorted([0.0, 1e-308, -1e-308, 1e308, -1e308] + [rng.choice([-1, 1]) * 10 ** rng.uniform(-9, 9) for _ in range(3000)])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    buckets = [r[1] for r in sorted(df.select("v", ranks.value_bucket(df.v)).collect())]
    assert buckets == sorted(buckets) and len(set(buckets)) > 1000


def test_detail_card(small, rows):
    card = [r for r in rows(peers.provider_detail_card(small)) if r["provider_id"] == "NPI:1"]
    assert [(r["metric"], r["value"]) for r in sorted(card, key=lambda r: r["position"])] == [
        ("Provider ID", "NPI:1"), ("Procedure code", "A123"), ("Claim count", "10"), ("Beneficiary count", "5"),
        ("Procedure rate", "2.0"), ("Peer median", "1.5"), ("Peer 90th percentile", "1.9"), ("Peer 95th percentile", "1.95"),
        ("Peer percentile", "100.0"),
    ]


def test_lists(small, rows):
    assert [r["provider_id"] for r in rows(peers.provider_options(small))] == ["NPI:1", "NPI:2", "NPI:3"]
    assert [r["procedure_code"] for r in rows(peers.procedure_options(small, "NPI:2"))] == ["A123"]
    listed = sorted(rows(peers.peer_list(small, 2)), key=lambda r: r["rank"])
    assert [(r["rank"], r["provider_id"]) for r in listed] == [(1, "NPI:1"), (2, "NPI:2")]


# --- anomalies ------------------------------------------------------------------------------------


def test_anomaly_table(spark, rows):
    stats = stats_of(
        spark,
        [("NPI:1", "A123", 20, 10, 4.0), ("NPI:2", "A123", 5, 2, 2.5), ("NPI:3", "A123", 4, 2, 2.0), ("NPI:4", "B456", 3, 1, 3.0)],
    )
    table = anomaly.build_provider_anomaly_table(stats)
    assert table.columns == anomaly.ANOMALY_COLUMNS
    got = {r["provider_id"]: r for r in rows(table)}
    assert [got[f"NPI:{i}"]["peer_median"] for i in (1, 2, 3, 4)] == [2.25, 3.0, 3.25, 3.0]
    assert [got[f"NPI:{i}"]["peer_percentile"] for i in (1, 2, 3, 4)] == [100.0, 50.0, 0.0, 100.0]
    assert got["NPI:1"]["provider_to_peer_ratio"] == pytest.approx(1.7777777) and got["NPI:4"]["provider_to_peer_ratio"] == 1.0
    assert all(isinstance(r["anomaly_flag"], bool) and 0 < r["anomaly_score"] <= 1 for r in got.values())


def test_degenerate_inputs(spark, small, rows):
    assert rows(anomaly.build_provider_anomaly_table(small.limit(0))) == []
    (row,) = rows(anomaly.build_provider_anomaly_table(small.filter("provider_id = 'NPI:1'")))
    assert (row["anomaly_score"], row["anomaly_flag"], row["peer_percentile"]) == (0.0, False, 100.0)
    df = spark.createDataFrame([("a", None)], "k string, x double")
    with pytest.raises(ValueError, match="At least one complete numeric feature row"):
        fit_forest(df, ["x"], ["k"])


def points(spark, n, outliers=1):
    rng = np.random.default_rng(1)
    data = [(f"r{i}", float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(n, 2)))]
    data += [(f"out{i}", 40.0 + i, -40.0) for i in range(outliers)]
    return spark.createDataFrame(data, "k string, x double, y double")


def test_planted_outlier_ranks_first(spark):
    df = points(spark, 200)
    scored = fit_forest(df, ["x", "y"], ["k"]).with_score(df).collect()
    assert max(scored, key=lambda r: r.anomaly_score).k == "out0"
    assert all(0 < r.anomaly_score <= 1 for r in scored)


def test_scores_do_not_depend_on_partitions(spark):
    df = points(spark, 3000, 30)
    scores = []
    for n in (3, 7):
        part = df.repartition(n)
        scores.append({r.k: r.anomaly_score for r in fit_forest(part, ["x", "y"], ["k"], trees=20).with_score(part).collect()})
    assert scores[0] == scores[1]
    values = sorted(scores[0].values())
    assert min(v for k, v in scores[0].items() if k.startswith("out")) > values[len(values) // 2]


def test_contamination_share(spark):
    df = points(spark, 300, 6)
    labelled = anomaly.label_rows(df, anomaly.fit_anomaly_model(df, ["x", "y"], ["k"]), ["k"], 0.02).collect()
    flagged = {r.k for r in labelled if r.anomaly_label == -1}
    assert len(flagged) == math.ceil(306 * 0.02) and {f"out{i}" for i in range(6)} <= flagged


def test_average_path():
    assert average_path(1) == 0 and average_path(2) == 1
    assert average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_queue(spark, rows):
    table = spark.createDataFrame(
        [("p1", "c", 0.6, True, 10.0, None), ("p2", "c", 0.6, False, 95.0, 2.0), ("p3", "c", 0.9, False, 50.0, 1.0)],
        "provider_id string, procedure_code string, anomaly_score double, anomaly_flag boolean, peer_percentile double, provider_to_peer_ratio double",
    ).selectExpr("*", "1.0D provider_rate", "1.0D peer_median")
    assert [r["provider_id"] for r in rows(anomaly.investigation_queue(table))] == ["p2", "p1"]


def test_providers_are_not_shuffled_to_meet_few_rates(spark):
    """The figures per rate are written first, so that a few go to every task; with many the salted join gives the same rows."""
    from claimspark.operators.joins import measured_join

    stats = spark.range(400).selectExpr("concat('p', id) AS provider_id", "concat('c', id % 3) AS procedure_code", "CASE WHEN id % 11 > 0 THEN id % 7 / 2D END AS procedure_rate")
    found = peers.with_peer_figures(stats)
    assert found.count() == 400 and "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    right = spark.range(5).selectExpr("concat('c', id) AS procedure_code", "id AS number")
    few, many = (measured_join(stats, right, ["procedure_code"], by=["provider_id"], how="left", broadcast_rows=n) for n in (10, 0))
    columns = ["provider_id", "procedure_code", "number"]
    assert sorted(few.select(columns).collect()) == sorted(many.select(columns).collect()) and few.count() == 400
