import datetime

import pytest
from pyspark.sql import functions as F

from claimspark.functions import names
from claimspark.functions.text import clean_text, normalize_icd10_code, normalize_procedure_code, policy_url
from claimspark.operators.normalize import normalize_source, type_columns

DATES = {
    "01-Jan-2019": "2019-01-01",
    "1-JAN-2019": "2019-01-01",
    " 01-jan-2019\t": "2019-01-01",
    "2019-01-05": "2019-01-05",
    "2019-01-05 10:11:12": "2019-01-05",
    "05/01/2019": "2019-01-05",
    "5-1-2019": "2019-01-05",
    "31-Feb-2019": None,
    "31/02/2019": None,
    "2019-02-31": None,
    "garbage": None,
    "": None,
    None: None,
}
NUMBERS = {
    "1,000": 1000.0, " 5 ": 5.0, "1e3": 1000.0, "+3": 3.0, "-.5": -0.5, "7.": 7.0, "1.0d": None, "1f": None,
    "nan": None, "0x1A": None, "1_000": None, "Infinity": None, "": None, None: None,
}
CODES = {
    " a1001 ": "A1001", "96156.0": "96156", "96156": "96156", "c12.0": "C12.0", "a 12 3": "A123", "NaN": None,
    "none": None, " ": None, None: None, ".0": ".0", "1.5.0": "1.5",
}


def pairs(spark, values, expression, name="x"):
    df = spark.createDataFrame([(v,) for v in values], f"{name} string")
    return {r[0]: r[1] for r in df.select(name, expression(df)).collect()}


def test_dates(spark):
    df = spark.createDataFrame([(v, v) for v in DATES], "raw string, claim_from_date string")
    got = {r[0]: r[1] for r in type_columns(df, keep=("raw",)).collect()}
    assert got == {k: v and datetime.date.fromisoformat(v) for k, v in DATES.items()}


def test_numbers(spark):
    df = spark.createDataFrame([(v, v) for v in NUMBERS], "raw string, line_amt string")
    assert {r[0]: r[1] for r in type_columns(df, keep=("raw",)).collect()} == NUMBERS


def test_procedure_and_diagnosis_codes(spark):
    assert pairs(spark, CODES, lambda d: normalize_procedure_code(F.col("x"))) == CODES
    assert pairs(spark, [" i10.9 "], lambda d: normalize_icd10_code(F.col("x"))) == {" i10.9 ": "I10.9"}
    assert pairs(spark, [" \t", " a b\n"], lambda d: clean_text(F.col("x"))) == {" \t": None, " a b\n": "a b"}


def test_policy_links(spark):
    df = spark.createDataFrame([("LCD", "20", "3"), ("Article", "10", ""), ("NCD", "77", "1")], "t string, i string, v string")
    got = {r[0]: r[1] for r in df.select("t", policy_url(F.col("t"), F.col("i"), F.col("v"))).collect()}
    base = "https://www.cms.gov/medicare-coverage-database/view/"
    assert got == {
        "LCD": base + "lcd.aspx?lcdid=20&ver=3",
        "Article": base + "article.aspx?articleid=10",
        "NCD": base + "ncd.aspx?ncdid=77&ncdver=1",
    }


def test_source_types(spark):
    assert names.source_type_for("/data/beneficiary_2019.csv") == "beneficiary"
    assert names.source_type_for("Carrier.zip") == "carrier"
    with pytest.raises(ValueError, match="Unsupported CMS source file: other.csv"):
        names.source_type_for("other.csv")
    df = spark.createDataFrame([("x/Outpatient.ZIP",), ("nothing.csv",)], "f string")
    assert [r[0] for r in df.select(names.source_type_column(F.col("f"))).collect()] == ["outpatient", None]


def test_standard_names(spark):
    df = spark.createDataFrame([("b1", "c1", "A1", "01", "Z9", "0W", "k")], "BENE_ID string, CLM_ID string, HCPCS_CD string, LINE_PLACE_OF_SRVC_CD string, ICD_DGNS_CD25 string, ICD_PRCDR_CD25 string, Extra_Col string")
    assert names.standardize_columns(df, "carrier").columns == [
        "bene_id", "claim_id", "hcpcs_code", "place_of_service_code", "diagnosis_code_25", "icd10_pcs_procedure_code_25", "Extra_Col",
    ]
    normal = normalize_source(df, "carrier")
    assert normal.columns[-1] == "extra_col"
    assert normal.first()["place_of_service_code"] == "01"


def test_missing_columns(spark):
    df = spark.createDataFrame([("b1",)], "BENE_ID string")
    with pytest.raises(ValueError, match="Missing required carrier columns: CLM_ID, HCPCS_CD"):
        names.standardize_columns(df, "carrier")
    with pytest.raises(ValueError, match="Missing required claim columns: CLM_ID"):
        names.validate_columns(df, ["CLM_ID", "BENE_ID"])
    with pytest.raises(ValueError, match="Unsupported CMS source type: other"):
        names.standardize_columns(df, "other")


def test_data_dictionary(spark, rows):
    table = names.data_dictionary(spark, {"carrier.zip": ("carrier", ["CLM_ID", "ICD_DGNS_CD3", "CLM_FROM_DT", "NCH_AMT", "NOTE"])})
    got = [(r["source_column"], r["standardized_column"], r["semantic_type"]) for r in rows(table)]
    assert got == [
        ("CLM_ID", "claim_id", "identifier_or_code"),
        ("ICD_DGNS_CD3", "diagnosis_code_3", "identifier_or_code"),
        ("CLM_FROM_DT", "claim_from_date", "date"),
        ("NCH_AMT", "nch_amt", "numeric"),
        ("NOTE", "note", "text_or_category"),
    ]
    assert rows(table)[1]["description"] == "Numbered diagnosis code from the source claim."


def test_a_procedure_code_is_stripped_twice_not_for_every_rule(spark):
    cells = {
        " b 12.0\t": "B12.0", "99213.0 ": "99213", "1 2.50.0": "12.50", "12.5.0": "12.5", ".5.0": ".5", "7.0.0": "7.0", "0.0": "0", ".0": ".0", "12.0\u2028": "12",
        "12\n.0": "12\n.0", "NaN ": None, " none": None, "n an": "NAN", "  ": None, "": None, " x ": "X", None: None, "$1.0": "$1.0",
    }
    rows = spark.createDataFrame(list(cells.items()), "cell string, want string").withColumn("code", normalize_procedure_code(F.col("cell")))
    assert [(r["cell"], r["code"]) for r in rows.collect()] == list(cells.items())
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("trim(") <= 2
