"""Dated joins, spells, rolling counts and code pairs against plain loops over generated tables."""

import datetime
import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from claimspark.operators import coverage_status as status
from claimspark.operators.dated import LAST_NUMBER, dyadic_pieces, join_dated, spells
from claimspark.operators.together import billed_together
from claimspark.operators.volume import distinct_in_windows, provider_volume

START = datetime.date(2020, 1, 1)
DAY = datetime.timedelta(1)


def day(n):
    return None if n is None else START + n * DAY


def some_periods(seed, count, keys):
    draw = random.Random(seed)
    out = []
    for i in range(count):
        begin = draw.choice([None, *range(60)])
        length = draw.choice([-3, 0, 1, 5, 30, None])
        end = None if length is None else (begin or 0) + length
        out.append((draw.choice(keys), day(begin), day(end), i, f"text {i}"))
    return out


def holds(period, at):
    return (period[1] is None or period[1] <= at) and (period[2] is None or period[2] >= at) and (None in period[1:3] or period[1] <= period[2])


def test_pieces_cover_each_day_once(spark):
    draw = random.Random(1)
    ranges = [(0, 0), (0, LAST_NUMBER), (5, 5), (LAST_NUMBER, LAST_NUMBER), (1, 1022)] + [sorted(draw.sample(range(1000), 2)) for _ in range(60)]
    rows = spark.createDataFrame([tuple(r) for r in ranges], "first_number int, last_number int").withColumn("pieces", dyadic_pieces()).collect()
    for r in rows:
        ends = sorted((p.run << p.level, (p.run + 1 << p.level) - 1) for p in r.pieces)
        assert ends[0][0] == r.first_number and ends[-1][1] == r.last_number
        assert all(a[1] + 1 == b[0] for a, b in itertools.pairwise(ends)) and len(ends) <= 44


def test_join_dated(spark):
    periods = some_periods(2, 120, ["a", "b", "c", None])
    draw = random.Random(3)
    lines = [(i, draw.choice(["a", "a", "b", "c", "d", None]), day(draw.choice([None, *range(-5, 100)]))) for i in range(300)]
    reference = spark.createDataFrame(periods + periods[:5], "code string, effective date, ended date, number int, description string")
    got = join_dated(spark.createDataFrame(lines, "line int, code string, served date"), reference, ["code"], "served", "effective", "ended", by=["line"], order=["number"])
    expected = []
    for line, code, at in lines:
        own = [p for p in periods if p[0] == code and at is not None and code is not None and holds(p, at)]
        best = max(own, key=lambda p: (p[1] or datetime.date.min, p[3]), default=(None,) * 5)
        expected.append((line, code, at, *best[1:], len(own)))
    assert sorted(tuple(r) for r in got.select("line", "code", "served", "effective", "ended", "number", "description", "versions_in_force").collect()) == sorted(expected)


def test_many_versions_of_a_key_are_not_broadcast(spark):
    """Pieces of overlapping versions are counted per run, and no side is broadcast, whatever Spark's estimate of the reference."""
    reference = spark.range(2000).selectExpr("'a' AS code", "date_add(DATE'2020-01-01', CAST(id % 50 AS INT)) AS effective", "date_add(DATE'2020-01-01', CAST(id % 50 + 40 AS INT)) AS ended", "id AS number")
    lines = spark.range(120).selectExpr("id AS line", "'a' AS code", "date_add(DATE'2020-01-01', CAST(id AS INT)) AS served")
    joined = join_dated(lines, reference, ["code"], "served", "effective", "ended", by=["line"], order=["number"])
    expected = {}
    for line in range(120):
        own = [(i % 50, i) for i in range(2000) if i % 50 <= line <= i % 50 + 40]
        expected[line] = (max(own)[1] if own else None, len(own))
    assert {r.line: (r.number, r.versions_in_force) for r in joined.collect()} == expected
    assert "BroadcastExchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_join_dated_without_versions(spark):
    lines = spark.createDataFrame([(1, "a", START)], "line int, code string, served date")
    none = spark.createDataFrame([], "code string, effective date, ended date, description string")
    got = join_dated(lines, none, ["code"], "served", "effective", "ended", by=["line"]).collect()
    assert [tuple(r) for r in got] == [(1, "a", START, None, None, None, 0)]
    assert join_dated(lines.filter("false"), none, ["code"], "served", "effective", "ended", by=["line"]).count() == 0


def test_spells(spark):
    periods = [p[:3] for p in some_periods(4, 25, ["a", "b", None])] + [("c", None, None), ("d", day(3), day(2)), ("e", day(1), day(2)), ("e", day(3), day(4)), ("e", day(6), None)]
    got = spells(spark.createDataFrame(periods, "code string, begin date, until date"), ["code"], "begin", "until").collect()
    early, late = -400, 900
    expected = []
    for code in sorted({p[0] for p in periods if p[0]}):
        own = [p for p in periods if p[0] == code and (None in p[1:] or p[1] <= p[2])]
        held = sorted(n for n in range(early, late) if any(holds(p, day(n)) for p in own))
        runs = [list(g) for _, g in itertools.groupby(enumerate(held), lambda x: x[1] - x[0])]
        for run in runs:
            low, high = run[0][1], run[-1][1]
            inside = sum((p[1] is None and low == early or p[1] is not None and day(low) <= p[1] <= day(high)) for p in own)
            expected.append((code, None if low == early else day(low), None if high == late - 1 else day(high), inside))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_coverage_status(spark):
    periods = [("a", True, day(0), day(9)), ("a", True, day(10), day(20)), ("a", False, day(15), None), ("b", False, None, day(5)), ("c", True, day(4), day(1))]
    lines = [("a", day(5)), ("a", day(15)), ("a", day(30)), ("a", day(-1)), ("b", day(-400)), ("b", day(6)), ("c", day(2)), ("d", day(2)), (None, day(2)), ("a", None)]
    table = spark.createDataFrame([(i, *x) for i, x in enumerate(lines)], "line int, procedure_code string, service_date date")
    got = status.coverage_status(table, spark.createDataFrame(periods, "procedure_code string, listed_as_covered boolean, effective_date date, end_date date"), by=["line"])
    rows = {r.line: r for r in got.collect()}
    assert [rows[i].coverage_status for i in range(10)] == [
        status.LISTED, status.NOT_COVERED, status.NOT_COVERED, status.NO_POLICY, status.NOT_COVERED, status.NO_POLICY, status.NO_POLICY, status.NO_POLICY, status.NO_POLICY, status.NO_DAY,
    ]
    assert [i for i in rows if rows[i].also_listed] == [1]
    assert (rows[0].listed_from, rows[0].listed_to) == (day(0), day(20)) and rows[1].not_covered_to is None


def test_distinct_in_windows(spark):
    draw = random.Random(6)
    rows = [(draw.choice("pq"), draw.choice(["x", "y", "z", None]), day(draw.choice([None, *range(0, 60, draw.choice([1, 3]))]))) for _ in range(150)]
    got = distinct_in_windows(spark.createDataFrame(rows, "who string, what string, at date"), ["who"], "what", "at", (1, 5, 30), "n").collect()
    expected = []
    for who, at in sorted({(w, a) for w, _, a in rows if a}):
        counts = [len({x for w, x, a in rows if w == who and a and x and at - n * DAY < a <= at}) for n in (1, 5, 30)]
        expected.append((who, at, *counts))
    assert sorted(map(tuple, got)) == expected


def test_provider_volume_of_claims_and_people(spark):
    lines = [("p", "c", "k1", "b1", day(0)), ("p", "c", "k1", "b1", day(2)), ("p", "c", "k2", None, day(29)), ("p", "c", "k3", "b2", day(30)), (None, "c", "k4", "b1", day(0)), ("p", "c", "k5", "b1", None)]
    got = provider_volume(spark.createDataFrame(lines, "provider_id string, procedure_code string, claim_key string, bene_id string, service_date date"))
    rows = {r.service_date: r for r in got.collect()}
    assert {d: (r.claims_30d, r.beneficiaries_30d) for d, r in rows.items()} == {day(0): (1, 1), day(2): (1, 1), day(29): (2, 1), day(30): (3, 2)}
    assert rows[day(30)].claims_365d == 3 and rows[day(30)].beneficiaries_90d == 2


def test_provider_volume_moves_lines_once_for_claims_and_once_for_people(spark):
    frame = spark.createDataFrame([("p", "c", "k1", "b1", day(0))], "provider_id string, procedure_code string, claim_key string, bene_id string, service_date date")
    plan = provider_volume(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4  # claims, people, sums a day, days in order


def test_distinct_in_windows_of_several_entities(spark):
    """Days on which all entities are NULL stay, also of a NULL key."""
    rows = [("p", None, None, day(0)), ("p", "k", None, day(1)), ("p", None, "b", day(3)), ("p", "k", "b", day(3)), (None, None, None, day(2)), (None, "k", "b", day(2)), ("p", "k", "b", None)]
    frame = spark.createDataFrame(rows, "who string, claim string, person string, at date")
    got = distinct_in_windows(frame, ["who"], {"claims": "claim", "people": "person"}, "at", (2, 5))
    assert got.columns == ["who", "at", "claims_2d", "claims_5d", "people_2d", "people_5d"]
    assert set(map(tuple, got.collect())) == {("p", day(0), 0, 0, 0, 0), ("p", day(1), 1, 1, 0, 0), ("p", day(3), 1, 1, 1, 1), (None, day(2), 1, 1, 1, 1)}


def test_pairs_of_a_claim_with_many_codes(spark):
    """Blocks of a few codes give the pairs of one block."""
    draw = random.Random(7)
    claims = {f"k{i}": draw.sample([f"c{j}" for j in range(40)], draw.choice([1, 2, 3, 30])) for i in range(60)}
    rows = [(k, c) for k, codes in claims.items() for c in codes + codes[:1]] + [(None, "c1"), ("k0", None)]
    frame = spark.createDataFrame(rows, "claim_key string, procedure_code string")
    singles = Counter(c for codes in claims.values() for c in codes)
    both = Counter(p for codes in claims.values() for p in itertools.combinations(sorted(codes), 2))
    expected = sorted((a, b, n, singles[a], singles[b]) for (a, b), n in both.items() if n >= 4)
    for block_codes in (64, 3):
        got = billed_together(frame, min_claims=4, block_codes=block_codes)
        assert sorted(tuple(r) for r in got.select("code_a", "code_b", "claims_both", "claims_a", "claims_b").collect()) == expected
    some = got.filter(F.col("code_a") == expected[0][0]).filter(F.col("code_b") == expected[0][1]).first()
    a, b, n, n_a, n_b = expected[0]
    assert abs(some.lift - n * 60 / (n_a * n_b)) < 1e-12 and abs(some.confidence_ab - n / n_a) < 1e-12
