"""Cells that real extracts hold and the adapter does not make."""

import datetime

import pytest
from pyspark.sql import functions as F

from claimspark.functions import names, text
from claimspark.operators import forest
from claimspark.operators.ranks import exact_quantiles
from claimspark.session import settings
from claimspark.sources.paths import one_task_each

DAY = datetime.date(2019, 1, 5)


@pytest.mark.parametrize("cell", ["20190105", "2019/01/05", "2019.1.5", "05.01.2019", "5/1/2019", "05-Jan-19", "05-Jan-2019", "January 5, 2019", "Jan 5 2019", "5 Jan 2019", "5 January 2019", "05/01/2019 00:00:00", "2019-01-05T07:30", "05-JAN-2019"])
def test_date_notations(spark, cell):
    assert spark.range(1).select(text.parse_date(F.lit(cell)).alias("d")).first()["d"] == DAY


def test_other_dates(spark):
    cells = {"05-Jan-70": datetime.date(1970, 1, 5), "31.02.2019": None, "20191350": None, "soon": None, "": None, "5 Foo 2019": None}
    for cell, want in cells.items():
        assert spark.range(1).select(text.parse_date(F.lit(cell)).alias("d")).first()["d"] == want
    for cell in ("01/05/2019", "1-5-2019 10:00", "20190105", "2019-01-05 00:00:00", "Jan 5, 2019"):
        assert spark.range(1).select(text.parse_policy_date(F.lit(cell)).alias("d")).first()["d"] == DAY


def test_amounts_of_any_size(spark):
    cells = spark.createDataFrame([("2e15",), ("0.00004",), ("1e999",), ("-1e999",), ("10",), ("1e30",)], "t string")
    numbers = cells.select(text.parse_number(F.col("t")).alias("v"))
    assert [r["v"] for r in numbers.filter("v is null").collect()] == [None, None]
    got = numbers.select(text.sum_money(F.col("v")).alias("s"), text.avg_money(F.col("v")).alias("a")).first()
    assert got["s"] == 2e15 + 10.00004 and got["a"] == (2e15 + 10.00004) / 3
    ranks = spark.createDataFrame([(float("inf"),), (1.0,), (2.0,), (float("-inf"),), (3.0,)], "v double")
    assert exact_quantiles(ranks, [], "v", {"m": 0.5}).first()["m"] == 2.0


def test_family_of_any_number(spark):
    assert names.standard_name("carrier", "ICD_DGNS_CD26") == "diagnosis_code_26" == names.canonical_column("carrier", "ICD_DGNS_CD26")
    assert names.standard_name("carrier", "ICD_DGNS_CDX") is None


def test_forest_uses_the_complete_rows(spark):
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 50 == 0, F.rand(1)).alias("x"))
    samples = forest._tree_samples(rows, ["x"], ["id"], trees=10, per_tree=64, seed=1)
    assert samples.groupBy("tree").count().filter("count = 64").count() == 10
    assert samples.select("x").distinct().count() >= 600  # 1,200 complete rows, 640 places


def test_tasks_and_settings(spark):
    rows = spark.createDataFrame([(f"f{i:02d}",) for i in range(40)], "path string")
    spread = one_task_each(rows, "path").select("path", F.spark_partition_id().alias("p"))
    assert spread.select("p").distinct().count() == 40
    with settings(spark, spark_sql_files_maxPartitionBytes=12345, spark_sql_own_test=1):
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "12345b" or spark.conf.get("spark.sql.files.maxPartitionBytes") == "12345"
    assert spark.conf.get("spark.sql.own.test", None) is None
