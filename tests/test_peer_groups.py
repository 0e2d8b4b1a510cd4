"""Backed-off peer groups against loops over drawn providers."""

import random

from claimspark.operators.peer_groups import backed_off_peers, main_place
from claimspark.session import settings

LEVELS = [["procedure_code", "kind", "place"], ["procedure_code", "kind"], ["procedure_code"]]


def test_finest_level_with_enough_peers(spark):
    d = random.Random(4)
    rows = [(f"p{i}", code, d.choice(["x", "x", "y", None, f"k{i}"]), d.choice(["1", "2", "3", "", None]), d.randint(0, 30), d.randint(0, 9)) for i in range(60) for code in d.sample(["a", "b", "c", "rare"], 2) if code != "rare" or i < 4]
    frame = spark.createDataFrame(rows, "provider_id string, procedure_code string, kind string, place string, claim_count long, beneficiary_count long")
    got = {(r.provider_id, r.procedure_code): r for r in backed_off_peers(frame, LEVELS, min_peers=4).collect()}
    assert len(got) == len(rows)
    seen = set()
    for row in rows:
        own = dict(zip(frame.columns, row))
        r, expected = got[row[0], row[1]], None
        for n, level in enumerate(LEVELS):
            peers = [p for p in (dict(zip(frame.columns, x)) for x in rows) if p["provider_id"] != row[0] and all(p[c] == own[c] for c in level)]
            if len(peers) >= 4:
                expected = n, peers
                break
        seen.add(expected and expected[0])
        if expected is None:
            assert (r.peer_level, r.peer_group, r.peers, r.peer_rate, r.rate_ratio) == (None,) * 5
            continue
        n, peers = expected
        people = sum(p["beneficiary_count"] for p in peers)
        rate = sum(p["claim_count"] for p in peers) / people if people else None
        assert (r.peer_level, r.peer_group, r.peers, r.peer_rate) == (n, ", ".join(LEVELS[n]), len(peers), rate)
        ratio = row[4] / row[5] / rate if rate and row[5] else None
        assert (r.rate_ratio is None) == (ratio is None) and (ratio is None or abs(r.rate_ratio - ratio) < 1e-12)
    assert seen == {0, 1, 2, None}
    assert backed_off_peers(frame.filter("false"), LEVELS).count() == 0


def test_rows_stay_where_they_are_if_totals_are_few(spark, monkeypatch):
    d = random.Random(5)
    rows = [(f"p{i}", d.choice("abc"), d.choice(["x", "y", None]), d.choice(["1", None]), d.randint(0, 30), d.randint(0, 9)) for i in range(80)]
    rows += [(None, "a", "x", "1", 3, 2), ("q", None, "x", "1", 3, 2)]
    frame = spark.createDataFrame(rows, "provider_id string, procedure_code string, kind string, place string, claim_count long, beneficiary_count long")
    few = backed_off_peers(frame, LEVELS, min_peers=6)
    assert "Exchange hashpartitioning" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr("claimspark.operators.peer_groups.BROADCAST_ROWS", 0)
    found = sorted(map(str, few.collect()))
    with settings(spark, spark_sql_autoBroadcastJoinThreshold=-1):
        many = backed_off_peers(frame, LEVELS, min_peers=6)
        assert "Exchange hashpartitioning" in many._jdf.queryExecution().executedPlan().toString()
        assert found == sorted(map(str, many.collect()))
    assert [r.peer_level for r in few.filter("provider_id IS NULL OR procedure_code IS NULL").collect()] == [None, None]


def test_main_place(spark):
    rows = [("p", "b"), ("p", "a"), ("p", None), ("q", "c"), ("q", "c"), ("q", "a"), (None, "a"), ("r", None)]
    got = main_place(spark.createDataFrame(rows, "provider_id string, place_of_service_code string")).collect()
    assert {(r.provider_id, r.main_place) for r in got} == {("p", "a"), ("q", "c")}
