"""Beneficiary context against plain loops over drawn people and lines."""

import datetime
import itertools
import random
from collections import defaultdict

from claimspark.operators import context


def people(seed):
    d = random.Random(seed)
    rows = [(f"b{d.randint(0, 25)}", d.choice([2019, 2020, 2021, 2023]), str(d.randint(60, 95)) if d.random() < 0.9 else None, d.choice([" F", "M ", None])) for _ in range(90)]
    return rows + [(None, 2020, "70", "F"), ("b1", None, "70", "F")]


SCHEMA = "bene_id string, year int, age_at_end_of_year string, sex_code string"


def plain(rows):
    best = {}
    for bene, year, age, sex in rows:
        if bene and year:
            key = (age is not None, int(age or 0), sex is not None, (sex or "").strip())
            best[bene, year] = max(best.get((bene, year), key), key)
    return {k: (v[1] if v[0] else None, v[3] if v[2] else None) for k, v in best.items()}


def test_one_row_a_year_and_spells(spark):
    rows = people(1)
    got = context.yearly_context(spark.createDataFrame(rows, SCHEMA))
    expected = plain(rows)
    assert {(r.bene_id, r.year): (r.age, r.sex) for r in got.collect()} == expected
    spells = []
    for bene, own in itertools.groupby(sorted(expected), lambda k: k[0]):
        years = [y for _, y in own]
        for _, run in itertools.groupby(enumerate(years), lambda x: x[1] - x[0]):
            run = [y for _, y in run]
            spells.append((bene, run[0], run[-1], len(run)))
    assert sorted(map(tuple, context.enrolment_spells(got).collect())) == sorted(spells)


def test_expected_volume(spark):
    d = random.Random(2)
    rows = people(3)
    known = plain(rows)
    lines = [(d.choice(["p", "p", "q", "r", None]), d.choice([f"b{d.randint(0, 40)}", None]), None if d.random() < 0.1 else datetime.date(d.choice([2019, 2020, 2021, 2022]), 3, 1)) for _ in range(500)]
    lines.append(("alone", "nobody", datetime.date(2020, 1, 1)))
    visits = defaultdict(int)
    for provider, bene, day in lines:
        if provider and day:
            visits[provider, bene, day.year] += 1
    strata = {k: (None if known[k[1:]][0] is None else known[k[1:]][0] // 10, known[k[1:]][1]) for k in visits if k[1:] in known}
    total, persons = defaultdict(int), defaultdict(int)
    for k, s in strata.items():
        total[s] += visits[k]
        persons[s] += 1
    frame = spark.createDataFrame(lines, "provider_id string, bene_id string, service_date date")
    got = context.expected_volume(frame, context.yearly_context(spark.createDataFrame(rows, SCHEMA))).collect()
    assert {r.provider_id for r in got} == {"p", "q", "r", "alone"}
    for r in got:
        own = [k for k in visits if k[0] == r.provider_id]
        inside = [k for k in own if k in strata]
        expected = sum(total[strata[k]] / persons[strata[k]] for k in inside)
        assert (r.lines_seen, r.person_years) == (sum(visits[k] for k in inside), len(inside))
        assert r.lines_without_context == sum(visits[k] for k in own if k not in strata)
        assert abs(r.expected_lines - expected) < 1e-9 and (r.observed_to_expected is None) == (not inside)
    assert abs(sum(r.expected_lines for r in got) - sum(r.lines_seen for r in got)) < 1e-9
