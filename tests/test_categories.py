"""Changes over months, procedures on the same claims and anomaly categories against plain loops over drawn lines."""

import datetime
import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from claimspark.operators import case_mix, categories, together
from tests.test_course import LINES, drawn

LIMITS = categories.Limits(min_claims=4, min_rows=3, divergence=0.2, decision=3.0)


def cusum(values, sign, limits):
    """Begin and end of the first change as places, and the largest sum in standard deviations, by the definition."""
    n = len(values)
    mean = sum(values) / n
    spread = math.sqrt(max(0.0, sum(x * x for x in values) / n - mean * mean))
    if spread < 1e-9:
        return None, None, None
    total, begin, first, peak = 0.0, 0, (None, None), 0.0
    for i, x in enumerate(values):
        total = max(0.0, total + sign * (x - mean) / spread - limits.slack)
        if total < 1e-9:
            total, begin = 0.0, i + 1
        peak = max(peak, total)
        if first[1] is None and total >= limits.decision - 1e-9:
            first = begin, i
    return *first, peak


def day(month):
    return None if month is None else datetime.date(month // 12, month % 12 + 1, 1)


def changes(counts, limits):
    months = defaultdict(set)
    for (_, code, month), n in counts.items():
        months[code].add(month)
    out = {}
    for pair in {k[:2] for k in counts}:
        first, last = min(months[pair[1]]), max(months[pair[1]])
        values = [counts.get((*pair, m), 0) for m in range(first, last + 1)]
        if sum(values) < limits.min_claims:
            continue
        row = [len(values), sum(values)]
        for sign in (1, -1):
            begin, seen, peak = cusum(values, sign, limits)
            row += [day(None if begin is None else first + begin), day(None if seen is None else first + seen), peak]
        out[pair] = row
    return out


def close(a, b):
    return a == b or (a is not None and b is not None and abs(a - b) < 1e-9)


def test_changes_against_the_definition(spark):
    d = random.Random(8)
    counts = {}
    for p in range(40):
        level, code = d.choice([1, 4]), d.choice("ab")
        turn, after = d.randint(0, 30), d.choice([0, 1, 4, 12])
        for m in range(24_240, 24_270):
            n = d.randint(0, 2) + (after if m - 24_240 >= turn else level)
            if n and d.random() < 0.9:
                counts[f"p{p}", code, m] = n
    counts |= {("flat", "c", m): 2 for m in range(100, 120)} | {("once", "d", 7): 50, ("few", "a", 24_250): 3}
    rows = [(*k, n) for k, n in counts.items()] + [(None, "a", 24_241, 5), ("p1", "a", None, 5), ("p1", None, 24_241, 5)]
    table = spark.createDataFrame(rows, "provider_id string, procedure_code string, month int, claims long")
    for limits in (LIMITS, categories.Limits()):
        got = {tuple(r)[:2]: tuple(r)[2:] for r in categories.change_points(table, limits).collect()}
        expected = changes(counts, limits)
        assert set(got) == set(expected) and ("few", "a") not in got
        for pair, row in expected.items():
            assert got[pair][:4] == tuple(row[:4]) and got[pair][5:7] == tuple(row[5:7]), pair
            assert close(got[pair][4], row[4]) and close(got[pair][7], row[7])
        assert sum(r[1 + 1] is not None for r in got.values()) > 5 and sum(r[5] is not None for r in got.values()) > 3
        assert got["flat", "c"][2:] == (None,) * 6 == got["once", "d"][2:]
    assert categories.change_points(table.limit(0)).count() == 0


def test_months_without_claims_are_not_rows(spark):
    """Long stretches without claims: the same changes as by the definition, without a grid of months."""
    d = random.Random(21)
    counts = {(f"p{p}", "a", d.choice([0, 1199, *range(500, 520)])): d.randint(1, 9) for p in range(25) for _ in range(6)}
    counts |= {("ends", "a", 0): 1, ("ends", "a", 1199): 1}
    counts |= {("early", "a", m): 3 for m in range(200)} | {("gone", "a", m): 3 for m in range(900)}
    table = spark.createDataFrame([(*k, n) for k, n in counts.items()], "provider_id string, procedure_code string, month int, claims long")
    table = table.withColumn("month", F.col("month") + 24_000)
    limits = categories.Limits(min_claims=2, decision=3.0)
    result = categories.change_points(table, limits)
    got, expected = {tuple(r)[:2]: tuple(r)[2:] for r in result.collect()}, changes({(p, c, m + 24_000): n for (p, c, m), n in counts.items()}, limits)
    assert set(got) == set(expected) and any(r[5] for r in got.values()) and any(r[2] for r in got.values())
    for pair, row in expected.items():
        assert got[pair][:4] == tuple(row[:4]) and got[pair][5:7] == tuple(row[5:7]), pair
        assert close(got[pair][4], row[4]) and close(got[pair][7], row[7])
    assert rows_made(result) <= 2 * len(counts) + len(got)


def rows_made(df):
    """The most rows that one of the explodes of an executed plan gave."""
    found, plans = [], [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        name = plan.nodeName()
        if name == "Generate":
            found.append(plan.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlan":
            plans.append(plan.executedPlan())
        elif name.endswith("QueryStage"):
            plans.append(plan.plan())
        else:
            plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return max(found)


def test_codes_beside_in_small_blocks(spark):
    """A claim with very many codes is many cells; none of its pairs is lost or counted twice."""
    d = random.Random(9)
    rows = [("k", f"c{i}", d.choice(["p", "q"])) for i in range(60)] + [("k", "c1", "r"), ("k", "c1", "r"), ("k", None, "r"), (None, "c1", "r"), ("k", "x", None), ("lone", "c1", "p")]
    rows += [(f"k{d.randint(0, 15)}", f"c{d.randint(0, 5)}", d.choice(["p", "q", None])) for _ in range(120)]
    table = spark.createDataFrame(rows, "claim_key string, procedure_code string, provider_id string")
    expected = Counter()
    codes = defaultdict(set)
    for claim, code, _ in rows:
        if claim and code:
            codes[claim].add(code)
    for claim, code, provider in {r for r in rows if all(r)}:
        expected.update((provider, code, other) for other in codes[claim] - {code})
    for block in (4, 64):
        got = {tuple(r)[:3]: r.claims for r in together.codes_beside(table, block_codes=block).collect()}
        assert got == expected


def test_categories_from_their_figures(spark):
    limits = categories.Limits(min_claims=4, min_rows=3, divergence=0.01, decision=1.5)
    d = random.Random(12)
    rows = [(*r[:-1], f"k{d.randint(0, 250)}") for r in drawn(11, 700)]
    frame = spark.createDataFrame(rows, LINES)
    pairs = sorted({(r[3], r[2]) for r in rows if r[2] and r[3]})
    features = [(p, c, d.choice([3, 4, 50]), d.choice([None, 1.9, 2.0, 7.5]), d.choice([None, 89.0, 90.0, 100.0])) for p, c in pairs]
    features += [("absent", "a", 9, 3.0, 95.0), ("quiet", "a", 9, 1.0, 50.0)]
    table = spark.createDataFrame(features, "provider_id string, procedure_code string, claim_count long, provider_to_peer_ratio double, peer_percentile double")
    got = {(r.provider_id, r.procedure_code): r for r in categories.anomaly_categories(frame, table, limits).collect()}
    assert set(got) == {f[:2] for f in features}
    figures = {}
    for name, mix in (("diagnosis", case_mix.diagnosis_mix(frame)), ("site_of_service", case_mix.place_mix(frame)), ("combination", categories.combination_mix(frame))):
        for r in mix.collect():
            figures[name, r.provider_id, r.procedure_code] = r
    turns = {tuple(r)[:2]: r for r in categories.change_points(categories.provider_months(frame), limits).collect()}
    seen = Counter()
    for provider, code, claims, ratio, percentile in features:
        r, turn = got[provider, code], turns.get((provider, code))
        expected = ["utilization"] if claims >= 4 and (ratio or 0) >= 2 and (percentile or 0) >= 90 else []
        own = {n: figures.get((n, provider, code)) for n in ("diagnosis", "site_of_service", "combination")}
        differs = [n for n, x in own.items() if x and x["rows"] >= 3 and (x.divergence or 0) >= 0.01]
        ends = [(x, n) for n, x in (("up", turn and turn.up_seen), ("down", turn and turn.down_seen)) if x]
        first = min(ends, key=lambda e: (e[0], e[1] == "down"))[1] if ends else None
        expected += [n for n in ("diagnosis", "site_of_service") if n in differs] + (["trend"] if first else []) + [n for n in ("combination",) if n in differs]
        assert (r.categories, r.change, r.change_from) == (expected, first, turn[f"{first}_from"] if first else None)
        seen.update(expected)
    assert set(seen) == {"utilization", "diagnosis", "site_of_service", "trend", "combination"}, seen
    assert got["quiet", "a"].categories == []
