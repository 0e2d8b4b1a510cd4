import datetime

import pytest

from claimspark.operators import utilization as u
from claimspark.operators.claim_lines import CLAIM_LINE_COLUMNS, claim_lines, combine_claim_lines
from claimspark.plans import analytics

D = datetime.date


@pytest.fixture(scope="module")
def sources(spark):
    carrier = spark.createDataFrame(
        [
            ("C1", "b1", "A123", D(2015, 1, 1), "n1", "", "11", 10.0, "D1"),
            ("C1", "b1", "A123", D(2015, 1, 1), "n1", "", "11", 10.0, "D1"),
            ("C2", "b2", "A123", D(2015, 2, 1), "n2", "", "22", 30.0, "D2"),
        ],
        "claim_id string, bene_id string, hcpcs_code string, claim_from_date date, rendering_provider_npi string, "
        "organization_npi string, place_of_service_code string, line_allowed_charge double, diagnosis_code_1 string",
    )
    outpatient = spark.createDataFrame(
        [("O1", "b3", "A123", D(2015, 3, 1), "n1", "", "", "", 999.0, "D2")],
        "claim_id string, bene_id string, hcpcs_code string, claim_from_date date, rendering_provider_npi string, "
        "attending_provider_npi string, organization_npi string, facility_provider_id string, revenue_center_rate double, "
        "diagnosis_code_1 string",
    )
    inpatient = spark.createDataFrame(
        [("I1", "b3", "A123", D(2015, 4, 1), "", "", "", "H1", "D1")],
        "claim_id string, bene_id string, hcpcs_code string, claim_from_date date, attending_provider_npi string, "
        "operating_provider_npi string, organization_npi string, facility_provider_id string, diagnosis_code_1 string",
    )
    return {"carrier": carrier, "outpatient": outpatient, "inpatient": inpatient}


@pytest.fixture(scope="module")
def lines(sources):
    return combine_claim_lines(sources)


def test_claim_line_columns(lines):
    assert lines.columns == CLAIM_LINE_COLUMNS


def test_procedure_stats(lines, rows):
    (row,) = rows(u.procedure_stats(lines))
    assert row["claim_count"] == 4
    assert row["unique_beneficiaries"] == 3
    assert row["unique_providers"] == 3
    assert row["total_allowed"] == 50.0
    assert row["allowed_amount_claims"] == 3
    assert row["median_allowed"] == 10.0
    assert row["average_allowed"] == pytest.approx(50 / 3)
    assert (row["unique_diagnoses"], row["unique_places_of_service"]) == (2, 2)
    assert (row["first_service_date"], row["last_service_date"]) == (D(2015, 1, 1), D(2015, 4, 1))


def test_breakdowns(lines, rows):
    diagnoses = {r["diagnosis_code"]: r for r in rows(u.diagnosis_procedure_stats(lines))}
    assert diagnoses["D1"]["claim_count"] == 2 and diagnoses["D1"]["percentage_of_procedure_claims"] == 50.0
    providers = {r["provider_id"]: r for r in rows(u.provider_procedure_stats(lines))}
    assert set(providers) == {"NPI:n1", "NPI:n2", "CMS_PROVIDER_NUMBER:H1"}
    assert providers["NPI:n1"]["procedure_rate"] == 1.0 and providers["NPI:n1"]["total_allowed"] == 20.0
    assert providers["CMS_PROVIDER_NUMBER:H1"]["total_allowed"] is None
    places = {r["place_of_service_code"]: r["percentage_of_carrier_procedure_claims"] for r in rows(u.pos_procedure_stats(lines))}
    assert places == {"11": 50.0, "22": 50.0}
    assert sum(r["claim_count"] for r in rows(u.procedure_trends(lines))) == 4


def test_blank_claim_ids_count_per_line(spark, rows):
    carrier = spark.createDataFrame(
        [(" ", "b1", "A1", "n1", "D1", "D1"), ("", "b1", "A1", "n1", "D1", "D2"), (None, None, "A1", "n1", "", None)],
        "claim_id string, bene_id string, hcpcs_code string, rendering_provider_npi string, diagnosis_code_1 string, line_diagnosis_code string",
    )
    lines = claim_lines(carrier, "carrier")
    keys = [r["claim_key"] for r in rows(lines)]
    assert len(set(keys)) == 3 and all(k.startswith("carrier:row:") for k in keys)
    (row,) = rows(u.procedure_stats(lines))
    assert (row["claim_count"], row["unique_beneficiaries"], row["total_allowed"], row["unique_places_of_service"]) == (3, 1, None, 0)
    diagnoses = {r["diagnosis_code"]: r["claim_count"] for r in rows(u.diagnosis_procedure_stats(lines))}
    assert diagnoses == {"D1": 2, "D2": 1}
    (provider,) = rows(u.provider_procedure_stats(lines))
    assert provider["procedure_rate"] == 3.0


def test_summaries(spark, rows):
    df = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("A", None), (None, 9.0)], "code string, v double")
    assert [(r["code"], r["claim_count"]) for r in rows(u.summarize_procedures(df, "code"))] == [("A", 2), ("B", 1), (None, 1)]
    assert {r["code"]: r["v"] for r in rows(u.numeric_features(df, "code", ["v"]))} == {"A": 1.0, "B": 2.0}
    with pytest.raises(KeyError, match="Missing procedure column: x"):
        u.summarize_procedures(df, "x")
    with pytest.raises(KeyError, match="Missing feature columns: g, w"):
        u.numeric_features(df, "g", ["v", "w"])


def test_job_and_reads(spark, sources, rows, tmp_path):
    processed, derived = str(tmp_path / "processed"), str(tmp_path / "derived")
    with pytest.raises(FileNotFoundError, match="carrier.parquet, outpatient.parquet, inpatient.parquet"):
        analytics.build_procedure_analytics(spark, processed, derived)
    for kind, df in sources.items():
        df.write.parquet(f"{processed}/{kind}.parquet")
    assert analytics.get_procedure_codes(spark, derived) is None
    for _ in range(2):  # the second run replaces the tables of the first
        counts = analytics.build_procedure_analytics(spark, processed, derived)
    assert counts == {
        "procedure_stats.parquet": 1, "diagnosis_procedure_stats.parquet": 2, "provider_procedure_stats.parquet": 3,
        "pos_procedure_stats.parquet": 2, "procedure_trends.parquet": 4,
    }
    assert rows(analytics.get_procedure_codes(spark, derived)) == [{"procedure_code": "A123", "claim_count": 4}]
    details = analytics.get_procedure_details(spark, "A123", derived)
    assert rows(details["summary"])[0]["claim_count"] == 4
    assert [r["service_month"] for r in rows(details["trends"])] == [D(2015, m, 1) for m in (1, 2, 3, 4)]
    assert {r["place_of_service_code"] for r in rows(details["places"])} == {"11", "22"}
    assert rows(analytics.get_procedure_details(spark, "none", derived)["summary"]) == []
    (compared,) = rows(analytics.get_provider_peer_comparison(spark, "NPI:n1", "A123", derived))
    assert compared["peer_count"] == 2


TABLES = ["procedure", "diagnosis", "provider", "place", "carrier", "month"]
LINE = "claim_type string, code_system string, procedure_code string, source_claim_id string, bene_id string, provider_id string, provider_id_type string, " \
    "place_of_service_code string, allowed_amount double, service_date date, diagnosis_codes array<string>"


def test_groups_are_counted_where_the_lines_of_an_entity_meet(spark):
    rows = [
        (("carrier", "outpatient")[i % 2], None if i % 13 == 0 else "S", ("P", "Q", "", None)[i % 7 % 4], None if i % 5 == 0 else f"c{i % 17}", None if i % 11 == 0 else f"b{i % 6}",
         None if i % 6 == 0 else f"n{i % 4}", (None, "NPI")[i % 3 % 2], None if i % 4 == 0 else f"{i % 3}", None, None if i % 9 == 0 else D(2020, 1 + i % 3, 1 + i % 27),
         None if i % 10 == 0 else [f"D{i % 3}", None, "", f"D{i % 3}"])
        for i in range(300)
    ]
    lines = spark.createDataFrame(rows, LINE)
    shared = u.distinct_counts(lines, TABLES)
    for keys, table in (["code_system"], "procedure"), (["diagnosis_code"], "diagnosis"), (["provider_id_key", "provider_id_type"], "provider"), (["place_of_service_code"], "place"), (["service_month"], "month"):
        want: dict = {}
        for kind, system, code, claim, person, provider, provider_kind, place, _, day, diagnoses in rows:
            if not code or (table == "provider" and provider is None) or (table == "place" and (kind != "carrier" or place is None)) or (table == "month" and day is None):
                continue
            for diagnosis in (d for d in diagnoses or [] if d) if table == "diagnosis" else [None]:
                key = (code, *{"procedure": [system], "diagnosis": [diagnosis], "provider": [provider, provider_kind], "place": [place], "month": [day and day.replace(day=1)]}[table])
                claims, people, unnamed = want.setdefault(key, (set(), set(), []))
                unnamed.append(1) if claim is None else claims.add((kind, claim))
                people.update({person} - {None})
        for counts in (shared, u.distinct_counts(lines, [table])):
            got = {(r["procedure_code"], *(r[k] for k in keys)): (r["claims"], r["beneficiaries"]) for r in counts.filter(f"grouping = '{table}'").collect()}
            assert got == {k: (len(c) + len(n), len(p)) for k, (c, p, n) in want.items()}


def test_lines_move_once_per_entity_for_all_tables(spark, lines):
    plan = u.distinct_counts(lines.localCheckpoint(), TABLES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == len(u.ENTITIES)
    assert "Expand" not in plan and "hashpartitioning(diagnosis" not in plan
    assert plan.count("Exchange hashpartitioning") <= 2 * len(u.ENTITIES) + 2  # the lines, then only counts
