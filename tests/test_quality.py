from claimspark.operators import quality


def raw(spark):
    data = [("f1", " A ", "1"), ("f1", "A", "1"), ("f1", "A", "1"), ("f1", None, "1"), ("f1", "1", None), ("f2", "A", "1")]
    return spark.createDataFrame(data, "source_file string, HCPCS_CD string, BENE_ID string").selectExpr("source_file", "BENE_ID", "HCPCS_CD", "'c' CLM_ID")


def test_duplicates_tell_null_positions_apart(spark):
    got = {r.source_file: r.duplicate_rows for r in quality.duplicate_rows(raw(spark)).collect()}
    assert got == {"f1": 1, "f2": 0}


def test_report_lines(spark):
    got = {(r.source_file, r.metric, r.field): r.value for r in quality.quality_report(raw(spark), "carrier").collect()}
    assert got["f1", "null_percentage", "hcpcs_code"] == "20.0"
    assert got["f1", "code_whitespace_rows", "HCPCS_CD"] == "1"
    assert got["f2", "duplicate_rows", ""] == "0"
    assert ("f1", "date_parse_failures", "") not in got


def test_percent_text(spark):
    df = spark.createDataFrame([(1, 3), (0, 5), (5, 5), (1, 1_000_000), (1, 8)], "n long, total long")
    texts = [r[0] for r in df.select(quality.percent_text(df.n, df.total)).collect()]
    assert texts == ["33.3333", "0.0", "100.0", "0.0001", "12.5"]
