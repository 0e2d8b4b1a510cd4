"""Case mix, growth and persistence against plain loops over drawn lines."""

import datetime
import itertools
import math
import random
import statistics
from collections import Counter, defaultdict

from claimspark.operators import case_mix, course

LINES = (
    "claim_type string, source_claim_id string, procedure_code string, provider_id string, place_of_service_code string, service_date date, diagnosis_codes array<string>, claim_key string"
)


def drawn(seed, n=400):
    d = random.Random(seed)
    rows = []
    for i in range(n):
        provider = d.choice(["p1", "p1", "p1", "p2", "p3", "p4", None])
        month = d.choice([1, 2, 3, 4, 5, 6, 9, 14])
        day = None if d.random() < 0.05 else datetime.date(2020 + (month - 1) // 12, (month - 1) % 12 + 1, d.randint(1, 28))
        code = d.choice(["a", "a", "b", "c", "", None]) if provider != "p4" else "lone"
        codes = [d.choice(["d1", "d2", "d3", provider or "d4"]) for _ in range(d.randint(0, 3))]
        rows.append(("carrier", None if d.random() < 0.1 else f"k{d.randint(0, 300)}", code, provider, d.choice([None, "11", "22"]), day, codes, f"{i}"))
    return rows


def test_mixes(spark):
    rows = drawn(1)
    for found, values in (
        (case_mix.diagnosis_mix(spark.createDataFrame(rows, LINES)), lambda r: r[6]),
        (case_mix.place_mix(spark.createDataFrame(rows, LINES)), lambda r: [r[4]] if r[4] else []),
    ):
        own = defaultdict(Counter)
        for r in rows:
            if r[2] and r[3]:
                own[r[3], r[2]].update(values(r))
        got = {(r.provider_id, r.procedure_code): r for r in found.collect()}
        assert set(got) == {k for k, c in own.items() if c}
        for (provider, code), r in got.items():
            mine, rest = own[provider, code], Counter()
            for (p, c), counts in own.items():
                if c == code and p != provider:
                    rest.update(counts)
            assert (r["rows"], r.kinds, r.peer_rows) == (mine.total(), len(mine), rest.total())
            if not rest:
                assert r.divergence is None and r.most_over is None
                continue
            total = 0
            for x in mine | rest:
                p, q = mine[x] / mine.total(), rest[x] / rest.total()
                total += sum(s * math.log2(2 * s / (p + q)) / 2 for s in (p, q) if s)
            gaps = {x: mine[x] / mine.total() - rest[x] / rest.total() for x in mine}
            assert abs(r.divergence - total) < 1e-12 and abs(r.over_by - max(gaps.values())) < 1e-12
            assert gaps[r.most_over] > max(gaps.values()) - 1e-12


def test_mixes_at_the_ends(spark):
    """No common item is 1, the same shares are 0."""
    rows = [("t", None, c, p, place, None, [], "k") for c, p, place in [("a", "p", "1"), ("a", "q", "2"), ("b", "p", "1"), ("b", "q", "1"), ("b", "q", "1")]]
    got = {(r.procedure_code, r.provider_id): r.divergence for r in case_mix.place_mix(spark.createDataFrame(rows, LINES)).collect()}
    assert got == {("a", "p"): 1.0, ("a", "q"): 1.0, ("b", "p"): 0.0, ("b", "q"): 0.0}
    assert case_mix.place_mix(spark.createDataFrame([], LINES)).count() == 0


def test_growth(spark):
    d = random.Random(2)
    series = {f"c{i}": {m: d.randint(0, 40) + 3 * m * (i % 3) for m in d.sample(range(30), d.randint(1, 20))} for i in range(12)}
    day = lambda m: datetime.date(2019 + m // 12, m % 12 + 1, 1)
    trends = [(c, day(m), n) for c, own in series.items() for m, n in own.items()] + [(None, day(1), 5), ("c0", None, 5)]
    rows = {r.procedure_code: r for r in course.procedure_growth(spark.createDataFrame(trends, "procedure_code string, service_month date, claim_count long")).collect()}
    assert set(rows) == set(series)
    for code, own in series.items():
        months = range(min(own), max(own) + 1)
        values = [own.get(m, 0) for m in months]
        slopes = [(b - a) / (j - i) for (i, a), (j, b) in itertools.combinations(enumerate(values), 2)]
        r = rows[code]
        assert (r.first_month, r.last_month, r.months, r.empty_months) == (day(months[0]), day(months[-1]), len(values), len(values) - len(own))
        assert r.median_claims == statistics.median(values)
        assert (r.monthly_slope is None) == (not slopes) and (not slopes or abs(r.monthly_slope - statistics.median(slopes)) < 1e-12)
        assert r.yearly_growth is None or abs(r.yearly_growth - 12 * r.monthly_slope / r.median_claims) < 1e-12


def test_differences_and_runs(spark):
    rows = drawn(3, 900)
    frame = spark.createDataFrame(rows, LINES)
    claims = defaultdict(set)
    for i, r in enumerate(rows):
        if r[2] and r[3] and r[5]:
            claims[r[3], r[2], r[5].year * 12 + r[5].month - 1].add(r[1] or f"line {i}")
    counts = {k: len(v) for k, v in claims.items()}
    differences = course.monthly_differences(frame)
    got = {(r.provider_id, r.procedure_code, r.month): r for r in differences.collect()}
    assert {k: r.claims for k, r in got.items()} == counts
    scores = {}
    for (provider, code, month), n in counts.items():
        rest = [x for (p, c, m), x in counts.items() if (c, m) == (code, month) and p != provider]
        spread = statistics.stdev(rest) if len(rest) > 1 else 0
        scores[provider, code, month] = (n - statistics.mean(rest)) / spread if spread else None
        r = got[provider, code, month]
        assert r.peers == len(rest) and (r.difference is None) == (not spread) and (not spread or abs(r.difference - scores[provider, code, month]) < 1e-9)
    assert any(z and z > 0.5 for z in scores.values())
    for r in course.persistence(differences, threshold=0.5, min_claims=3).collect():
        own = {m: z for (p, c, m), z in scores.items() if (p, c) == (r.provider_id, r.procedure_code)}
        above = [m for m, z in sorted(own.items()) if z is not None and z >= 0.5 and counts[r.provider_id, r.procedure_code, m] >= 3]
        runs = [[m for _, m in g] for _, g in itertools.groupby(enumerate(above), lambda x: x[1] - x[0])]
        best = max(runs, key=lambda run: (len(run), -run[0]), default=[])
        day = lambda m: datetime.date(m // 12, m % 12 + 1, 1)
        assert (r.months, r.months_above, r.longest_run) == (len(own), len(above), len(best))
        assert (r.run_from, r.run_to) == ((day(best[0]), day(best[-1])) if best else (None, None))


