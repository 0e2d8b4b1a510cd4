"""What is moved: lines once for the table of providers, one row per code and article, and nothing for the archives' parts."""

from datetime import date

from pyspark.sql import functions as F

from claimspark.functions.text import parse_date
from claimspark.operators import case_mix, categories, coverage, together, utilization as u
from claimspark.operators.normalize import type_columns
from claimspark.sources import sinks
from workload import adapter, file_layer, staging

LINE = "claim_type string, procedure_code string, source_claim_id string, bene_id string, provider_id string, provider_id_type string, allowed_amount double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_provider_table_moves_lines_once(spark):
    rows = [
        (("carrier", "outpatient")[i % 2], ("P", "Q", "", None)[i % 7 % 4], None if i % 5 == 0 else f"c{i % 17}", None if i % 11 == 0 else f"b{i % 6}",
         None if i % 6 == 0 else f"n{i % 4}", (None, "NPI")[i % 3 % 2], None if i % 3 == 0 else i / 4)
        for i in range(300)
    ]
    want = {}
    for kind, code, claim, person, provider, provider_kind, amount in rows:
        if code and provider:
            claims, people, unnamed, amounts = want.setdefault((provider, provider_kind, code), (set(), set(), [], []))
            unnamed.append(1) if claim is None else claims.add((kind, claim))
            people.update({person} - {None})
            amounts += [amount] * (amount is not None)
    table = u.provider_procedure_stats(spark.createDataFrame(rows, LINE))
    got = {(r["provider_id"], r["provider_id_type"], r["procedure_code"]): (r["claim_count"], r["beneficiary_count"], r["total_allowed"]) for r in table.collect()}
    assert got == {k: (len(c) + len(n), len(p), sum(a) if a else None) for k, (c, p, n, a) in want.items()}
    moved = plan(u.provider_procedure_stats(spark.createDataFrame(rows, LINE).localCheckpoint()))
    assert moved.count("Exchange") == 1


def article_tables(spark, diagnoses):
    key = "article_id string, article_version string"
    return {"Article": {
        "article": spark.createDataFrame([("1", "1", "one", 0), ("2", "1", "two", 1)], f"{key}, title string, ingest_pos long"),
        "article_x_hcpc_code": spark.createDataFrame([(a, "1", c) for a in ("1", "2", "3") for c in ("X1", "X2", "X1", "no")], f"{key}, hcpc_code_id string"),
        "article_x_icd10_covered": spark.createDataFrame([("1", " 1", f"D{i % 20}", f"text {i}") for i in range(diagnoses)] + [("3", "1", "E", "e"), (None, "1", "E", "e")], f"{key}, icd10_code_id string, description string"),
        "article_x_icd10_noncovered": spark.createDataFrame([("1", "1", "D1", "text 1")] * 2, f"{key}, icd10_code_id string, description string"),
    }}


def test_a_code_meets_its_diagnoses_in_lists(spark, monkeypatch):
    monkeypatch.setattr(coverage, "LIST_ROWS", 8)
    tables, codes = article_tables(spark, 40), coverage.code_list(spark, ["x1", "x2"])
    lists = coverage.icd10_lists(tables, codes).collect()
    assert len(lists) == 2 * 6 + 2 * 1  # of 42 and of 1 diagnoses, for two codes each
    assert max(len(r["diagnoses"]) for r in lists) == 8
    rows = coverage.icd10_relationships(tables, codes)
    assert rows.columns == coverage.ICD10_COLUMNS
    found = [(r["procedure_code"], r["policy_id"], r["policy_title"], r["icd10_code"], r["icd10_description"], r["code_relationship"]) for r in rows.collect()]
    yes, no = coverage.fixed.DIAGNOSIS_COVERED, coverage.fixed.DIAGNOSIS_NONCOVERED
    one = [("1", "one", f"D{i % 20}", f"text {i}", yes) for i in range(40)] + [("1", "one", "D1", "text 1", no)] * 2 + [("3", "", "E", "e", yes)]
    assert sorted(found) == sorted((c, *r) for c in ("X1", "X2") for r in one)


def test_sink_makes_rows_in_their_place(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 10).alias("key"), F.array("id", F.col("id") + 100).alias("values"))
    target = str(tmp_path / "table.parquet")
    assert sinks.write_table(df, target, cluster_by=["key"], finish=lambda rows: rows.select("key", F.explode("values").alias("value"))) == 200
    assert sorted(r["value"] for r in spark.read.parquet(target).collect()) == list(range(200))
    keys = [r["key"] for r in spark.read.parquet(target).select("key", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place")).orderBy("file", "place").collect()]
    assert keys == sorted(keys)


def test_parts_without_order_are_not_moved(spark, tmp_path):
    df = spark.range(0, 50, 1, 3).select("id", F.format_string("%02d.csv.gz", F.spark_partition_id()).alias("file"))
    paths = file_layer.named_files(df, str(tmp_path / "parts"), "file", [], ",", "gzip")
    assert len(paths) == 3
    file_layer.pack(spark, [(str(tmp_path / "all.zip"), "inner.zip", "tables/t.csv", path) for path in paths[:1]])
    assert (tmp_path / "all.zip").exists()
    assert spark.read.option("header", True).csv(paths).count() == 50


def test_typed_dates_are_those_of_parse_date(spark):
    cells = ["2020-01-05", " 05/01/2020 10:30", "5-1-2020", "05-Jan-2020T01:02:03", "Jan 5, 2020", "20200105", "31-Feb-2020", "10:30", "", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "n int, claim_from_date string")
    got = {r["n"]: r["claim_from_date"] for r in type_columns(df, keep=("n",)).collect()}
    want = {r["n"]: r["day"] for r in df.select("n", parse_date(F.trim("claim_from_date")).alias("day")).collect()}
    assert got == want and [got[i] for i in range(6)] == [date(2020, 1, 5)] * 6


def test_months_and_mixes_move_lines_once(spark):
    rows = [("carrier", ("P", "Q")[i % 2], None if i % 5 == 0 else f"c{i % 17}", f"n{i % 4}", date(2020, 1 + i % 7, 3), ["D1", f"D{i % 3}", None, ""][: i % 4]) for i in range(200)]
    lines = spark.createDataFrame(rows, "claim_type string, procedure_code string, source_claim_id string, provider_id string, service_date date, diagnosis_codes array<string>")
    lines = lines.withColumn("claim_key", F.coalesce("source_claim_id", F.format_string("row %d", F.monotonically_increasing_id()))).localCheckpoint()
    monthly, spans = categories.provider_months(lines), categories.procedure_spans(lines)
    assert plan(monthly).count("Exchange") == 1
    assert {(r["procedure_code"], r["first"], r["last"]) for r in spans.collect()} == {("P", 24240, 24246), ("Q", 24240, 24246)}
    limits = categories.Limits(min_claims=1, decision=0.5)
    assert sorted(categories.change_points(monthly, limits, spans).collect()) == sorted(categories.change_points(monthly, limits).collect())
    beside = together.codes_beside(lines)
    assert plan(case_mix.own_items(case_mix.known_items(beside, "other_code", "claims"))).count("Exchange") == plan(beside).count("Exchange")
    own = case_mix.own_items(case_mix.known_items(lines.select("provider_id", "procedure_code", F.explode("diagnosis_codes").alias("d")), "d"))
    got = {(r["provider_id"], r["procedure_code"]): (r["rows"], r["kinds"]) for r in own.collect()}
    for pair, (n, kinds) in got.items():
        found = [d for _, code, _, provider, _, codes in rows if (provider, code) == pair for d in codes if d is not None]
        assert (n, kinds) == (len(found), len(set(found)))
    apart = case_mix.diagnosis_mix(lines).select("provider_id", "procedure_code", "rows").collect()
    assert {tuple(r)[:2]: r["rows"] for r in apart} == {pair: sum(d not in (None, "") for _, code, _, p, _, codes in rows if (p, code) == pair for d in codes) for pair in {tuple(r)[:2] for r in apart}}


def test_written_base_leaves_lines_without_number_out(spark, tmp_path):
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame([(1, 2, 3, n, 10.0, 0.5, "A", "F", None) for n in (1, 2, 3, None)], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 4, "F", "1-URGENT")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(2, "Brand#7", 11)], "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    staging.claim_base(spark, str(tmp_path))
    base = staging.claim_base(spark, str(tmp_path))
    assert sorted((r["claim_type"] or "", r["charge"]) for r in base.collect()) == [("", None), ("carrier", 5.0), ("inpatient", None), ("outpatient", 10.0)]
    assert {kind: [r["hcpcs_code"] for r in adapter.processed_claims(base, kind).collect()] for kind in adapter.CLAIM_TYPES} == dict.fromkeys(adapter.CLAIM_TYPES, ["B7-3"])
