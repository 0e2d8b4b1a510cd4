import hashlib
import io
import os
from zipfile import ZIP_DEFLATED, ZipFile

import pytest

from claimspark.functions import fixed
from claimspark.operators.descriptions import attach_descriptions, description_map, long_description
from claimspark.plans.ingest import run_ingest
from claimspark.sources import archives, descriptions, files, sinks


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_discovery(spark, rows, tmp_path):
    for name in ("b.CSV", "a.zip", "c.parquet", "notes.txt"):
        write(tmp_path / name, "x")
    assert [r["name"] for r in rows(files.discover_data_files(spark, str(tmp_path)))] == ["a.zip", "b.CSV", "c.parquet"]
    assert rows(files.discover_data_files(spark, str(tmp_path / "absent"))) == []


def test_load_table_and_missing_texts(spark, rows, tmp_path):
    path = write(tmp_path / "x.csv", "BENE_ID|HCPCS_CD\n01|NA\n b |\n\"q|\"\"r\"|null\n")
    assert rows(files.load_table(spark, path)) == [
        {"BENE_ID": "01", "HCPCS_CD": None}, {"BENE_ID": " b ", "HCPCS_CD": None}, {"BENE_ID": 'q|"r', "HCPCS_CD": None},
    ]
    assert [r["HCPCS_CD"] for r in rows(files.scan_claim_file(spark, path))] == ["NA", None, "null"]
    scan = files.scan_claim_file(spark, path)
    assert scan.count() == 3 and [r[0] for r in scan.select("HCPCS_CD").collect()] == ["NA", None, "null"]
    with pytest.raises(ValueError, match="Unsupported data format: .txt"):
        files.load_table(spark, str(tmp_path / "x.txt"))
    with pytest.raises(ValueError, match="must be CSV or ZIP"):
        files.scan_claim_file(spark, str(tmp_path / "x.parquet"))
    assert rows(files.preview(files.load_table(spark, path), 1)) == [{"BENE_ID": "01", "HCPCS_CD": None}]


def test_uneven_rows(spark, tmp_path):
    path = write(tmp_path / "x.csv", "a|b\n1|2\n1|2|3\n1\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        files.read_delimited(spark, path).collect()
    kept = files.read_delimited(spark, path, bad_rows="keep").collect()
    assert [r[files.BAD_RECORD] for r in kept] == [None, "1|2|3", "1"]


def test_zip_members(spark, rows, tmp_path):
    one, two = tmp_path / "Carrier.zip", tmp_path / "two.zip"
    with ZipFile(one, "w", ZIP_DEFLATED) as archive:
        archive.writestr("carrier.csv", "BENE_ID|CLM_ID|HCPCS_CD|LINE_PLACE_OF_SRVC_CD\nb1|c1|A1234|01\n")
    with ZipFile(two, "w") as archive:
        archive.writestr("a.csv", "X\n1\n")
        archive.writestr("b.csv", "X\n2\n")
    assert rows(files.load_source(spark, str(one)))[0]["place_of_service_code"] == "01"
    assert rows(files.load_table(spark, str(two), zip_member="b.csv")) == [{"X": "2"}]
    with pytest.raises(ValueError, match="Expected one CSV member in two.zip; found 2."):
        files.load_table(spark, str(two))
    with pytest.raises(ValueError, match="CSV member 'c.csv' not found in two.zip."):
        files.load_table(spark, str(two), zip_member="c.csv")


def test_zipped_parts_are_one_table(spark, rows, tmp_path):
    paths = []
    for n in range(5):
        paths.append(str(tmp_path / f"part{n}.zip"))
        with ZipFile(paths[-1], "w", ZIP_DEFLATED) as archive:
            archive.writestr("same.csv", "X|Y\n" + "".join(f"{n}|{i}\n" for i in range(n)))
    assert sorted((r["X"], r["Y"]) for r in rows(files.load_table(spark, paths))) == [(str(n), str(i)) for n in range(5) for i in range(n)]
    with pytest.raises(ValueError, match="one data format"):
        files.load_table(spark, [paths[0], write(tmp_path / "x.csv", "X|Y\n")])
    with ZipFile(paths[2], "a") as archive:
        archive.writestr("second.csv", "X|Y\n")
    with pytest.raises(ValueError, match="Expected one CSV member in part2.zip; found 2."):
        files.load_table(spark, paths)


def nested(path, bundle, members):
    inner = io.BytesIO()
    with ZipFile(inner, "w", ZIP_DEFLATED) as archive:
        for name, text in members.items():
            archive.writestr(name, text)
    with ZipFile(path, "w", ZIP_DEFLATED) as archive:
        archive.writestr(f"data/{bundle}", inner.getvalue())
    return str(path)


def test_bundle_in_parts(spark, tmp_path):
    """Positions grow with the part and the row, whatever the sizes of the parts; a table may be in some of them."""
    lengths = [3, 40, 0, 7]
    paths = []
    for part, n in enumerate(lengths):
        members = {"tables/A.csv": "k,text\n" + "".join(f'{part}-{i},"two\nlines, {i}"\n' for i in range(n))}
        if part in (1, 3):
            members["b.CSV"] = f"k\n{part}\n"
        paths.append(nested(tmp_path / f"all.part-{part:04d}.zip", "all_csv.zip", members))
    landed = archives.land_bundle(spark, paths, "all_csv.zip", ["a", "b", "c"], str(tmp_path / "landed"), optional=("c",))
    assert set(landed) == {"a", "b"}
    ordered = landed["a"].orderBy("ingest_pos").collect()
    assert [r.k for r in ordered] == [f"{part}-{i}" for part, n in enumerate(lengths) for i in range(n)]
    assert ordered[0].text == "two\nlines, 0" and len({r.ingest_pos for r in ordered}) == sum(lengths)
    assert [r.k for r in landed["b"].orderBy("ingest_pos").collect()] == ["1", "3"]
    with pytest.raises(FileNotFoundError, match="c.csv is missing from all_csv.zip"):
        archives.land_bundle(spark, paths, "all_csv.zip", ["a", "c"], str(tmp_path / "again"))


def test_yearly_files(spark, rows, tmp_path):
    a = write(tmp_path / "beneficiary_2019.csv", "BENE_ID|SEX_IDENT_CD\nb1|1\n")
    b = write(tmp_path / "beneficiary_2020.csv", "SEX_IDENT_CD|BENE_ID\n2|b2\n")
    c = write(tmp_path / "beneficiary_2021.csv", "BENE_ID\nb3\n")
    union = files.scan_yearly_files(spark, [a, b])
    assert union.columns == ["year", "BENE_ID", "SEX_IDENT_CD", "source_file"]
    assert sorted((r["year"], r["BENE_ID"], r["SEX_IDENT_CD"]) for r in rows(union)) == [(2019, "b1", "1"), (2020, "b2", "2")]
    with pytest.raises(ValueError, match="Inconsistent standardized schema while appending beneficiary_2021.csv"):
        files.scan_yearly_files(spark, [a, c])


def test_write_table_replaces_and_counts(spark, tmp_path):
    target = str(tmp_path / "t.parquet")
    assert sinks.read_if_present(spark, target) is None
    assert sinks.write_table(spark.range(5), target) == 5
    assert sinks.write_table(spark.range(8), target, cluster_by=["id"]) == 8
    assert sinks.read_if_present(spark, target).count() == 8
    with pytest.raises(Exception):
        sinks.write_table(spark.range(3).selectExpr("raise_error('stop') id"), target)
    assert spark.read.parquet(target).count() == 8
    assert os.listdir(tmp_path) == ["t.parquet"]


# --- ingest job ---------------------------------------------------------------------------------------


def raw_folder(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    for year in range(2019, 2024):
        write(folder / f"beneficiary_{year}.csv", f"BENE_ID|BENE_BIRTH_DT|AGE_AT_END_REF_YR\nb1|01-Jan-1940|79\nb{year}|31-Feb-1950|x\n")
    write(folder / "inpatient.csv", "BENE_ID|CLM_ID|CLM_FROM_DT|ICD_DGNS_CD1\nb1|i1|02-Feb-2020|D1\nb1|i1|02-Feb-2020|D1\n")
    for kind in ("carrier", "outpatient"):
        with ZipFile(folder / f"{kind}.zip", "w") as archive:
            archive.writestr(f"{kind}.csv", 'BENE_ID|CLM_ID|HCPCS_CD|LINE_ALOWD_CHRG_AMT\nb1|c1| A1 |"1,000.50"\nb2||A2|bad\n')
    return folder


def read_csv(spark, path):
    return [r.asDict() for r in spark.read.csv(path, header=True).collect()]


def test_ingest_job(spark, tmp_path):
    raw, data = raw_folder(tmp_path), str(tmp_path / "data")
    counts = run_ingest(spark, str(raw), data, download_date="2026-01-02")
    assert counts == {**{f"beneficiary_{y}.csv": 2 for y in range(2019, 2024)}, "inpatient.csv": 2, "carrier.zip": 2, "outpatient.zip": 2}
    people = spark.read.parquet(f"{data}/processed/beneficiaries.parquet")
    assert people.columns == ["year", "bene_id", "birth_date", "age_at_end_of_year"]
    assert people.count() == 10 and people.filter("birth_date is null").count() == 5
    carrier = spark.read.parquet(f"{data}/processed/carrier.parquet").orderBy("bene_id").collect()
    assert [(r.claim_id, r.hcpcs_code, r.line_allowed_charge) for r in carrier] == [("c1", "A1", 1000.5), (None, "A2", None)]

    manifest = {r["file"]: r for r in read_csv(spark, f"{data}/source_manifest.csv")}
    assert list(manifest["carrier.zip"]) == [
        "source", "file", "source_url", "collection_url", "download_date", "release_date", "row_count", "file_size_bytes",
        "sha256", "processed_file",
    ]
    content = (raw / "carrier.zip").read_bytes()
    assert manifest["carrier.zip"]["sha256"] == hashlib.sha256(content).hexdigest()
    assert manifest["carrier.zip"]["file_size_bytes"] == str(len(content))
    assert manifest["beneficiary_2020.csv"]["processed_file"] == "beneficiaries.parquet"

    report = {(r["source_file"], r["metric"], r["field"] or ""): r["value"] for r in read_csv(spark, f"{data}/reports/data_quality_report.csv")}
    expected = {
        ("carrier.zip", "row_count", ""): "2",
        ("carrier.zip", "column_count", ""): "4",
        ("carrier.zip", "null_count", "claim_id"): "1",
        ("carrier.zip", "null_percentage", "claim_id"): "50.0",
        ("carrier.zip", "null_percentage", "bene_id"): "0.0",
        ("carrier.zip", "numeric_parse_failures", ""): "1",
        ("carrier.zip", "code_whitespace_rows", "HCPCS_CD"): "1",
        ("carrier.zip", "duplicate_rows", ""): "0",
        ("carrier.zip", "required_columns_present", ""): "True",
        ("inpatient.csv", "duplicate_rows", ""): "1",
        ("inpatient.csv", "date_min", "claim_from_date"): "2020-02-02",
        ("beneficiary_2019.csv", "date_parse_failures", ""): "1",
        ("beneficiary_2019.csv", "null_count", "year"): "0",
        ("beneficiary_2019.csv", "date_max", "birth_date"): "1940-01-01",
        ("beneficiary_2019.csv", "file_exists", ""): "True",
    }
    assert {k: report.get(k) for k in expected} == expected
    dictionary = read_csv(spark, f"{data}/data_dictionary.csv")
    assert ("carrier.zip", "CLM_ID", "claim_id") in {(r["source_file"], r["source_column"], r["standardized_column"]) for r in dictionary}


def test_ingest_is_all_or_nothing(spark, tmp_path):
    raw, data = raw_folder(tmp_path), tmp_path / "data"
    with ZipFile(raw / "outpatient.zip", "w") as archive:
        archive.writestr("outpatient.csv", "BENE_ID|CLM_ID\nb1|c1\n")
    with pytest.raises(ValueError, match="outpatient.zip is missing required columns: HCPCS_CD"):
        run_ingest(spark, str(raw), str(data))
    assert [n for n in os.listdir(data / "processed") if n.endswith(".parquet")] == []
    os.remove(raw / "inpatient.csv")
    with pytest.raises(FileNotFoundError, match="Missing expected CMS sources: inpatient.csv"):
        run_ingest(spark, str(raw), str(data))
    with pytest.raises(ValueError, match="release_date must use YYYY-MM-DD format"):
        run_ingest(spark, str(raw), str(data), release_date="1/2/2026")


# --- descriptions -----------------------------------------------------------------------------------------

SHEET = """<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>"""


def workbook(path_or_buffer, sheets, shared=("HCPC", "LONG DESCRIPTION")):
    """A minimal workbook: texts as shared or inline strings, numbers as plain values."""

    def cell(column, row, value):
        ref = f"{'ABCDEFG'[column]}{row}"
        if isinstance(value, (int, float)):
            return f'<c r="{ref}"><v>{value}</v></c>'
        if value in shared:
            return f'<c r="{ref}" t="s"><v>{shared.index(value)}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{value}</t></is></c>'

    with ZipFile(path_or_buffer, "w") as book:
        strings = "".join(f"<si><t>{s}</t></si>" for s in shared)
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{strings}</sst>')
        for number, table in enumerate(sheets, start=1):
            body = "".join(
                f'<row r="{r}">' + "".join(cell(c, r, v) for c, v in enumerate(row) if v is not None) + "</row>"
                for r, row in enumerate(table, start=1)
            )
            book.writestr(f"xl/worksheets/sheet{number}.xml", SHEET.format(body))


def archive_of(folder, name, inner, sheets, mtime):
    workbook(folder / "tmp.xlsx", sheets)
    with ZipFile(folder / name, "w") as archive:
        archive.writestr(inner, (folder / "tmp.xlsx").read_bytes())
    os.remove(folder / "tmp.xlsx")
    os.utime(folder / name, (mtime, mtime))


def as_map(df, precedence="newest"):
    return {r.code: r.description for r in description_map(df, precedence).collect()}


def test_procedure_descriptions(spark, tmp_path):
    head = ["HCPC", "SHORT", "LONG DESCRIPTION"]
    new = [head, ["A1001", None, "Dressing for one wound"], [96156, "x", "Cognitive assessment"], ["B2002", "", "Two wounds"], [None, "", "none"]]
    old = [head, ["A1001", "", "Old text"], ["Z9", "", "Only in the old file"]]
    archive_of(tmp_path, "hcpc2026_oct_anweb.zip", "HCPC2026_ANWEB.xlsx", [[["note"]], new, old], 2_000_000_000)
    archive_of(tmp_path, "HCPC2025_ANWEB.zip", "HCPC2025_anweb.xlsx", [old], 1_900_000_000)
    entries = descriptions.read_procedure_descriptions(spark, str(tmp_path))
    newest = as_map(entries)
    assert newest == {"A1001": "Dressing for one wound", "96156": "Cognitive assessment", "B2002": "Two wounds", "Z9": "Only in the old file"}
    assert as_map(entries, "oldest")["A1001"] == "Old text"
    with pytest.raises(ValueError):
        description_map(entries, "random")


def test_cpt_descriptions_and_lookup(spark, rows, tmp_path):
    write(tmp_path / "cpt_descriptions.csv", "CPT,SHORT DESCRIPTION,LONG DESCRIPTION\n99241,Office consult,\"Office consultation\nfor a patient\"\n99242,,\n")
    with ZipFile(tmp_path / "CPT_more.zip", "w") as archive:
        archive.writestr("a.csv", "Code,Description\n10.0,From archive\n11,First\n11,Last\n")
        archive.writestr("b.csv", "Other,Text\n1,2\n")
    (tmp_path / "cpt_broken.zip").write_bytes(b"not a zip")
    workbook(tmp_path / "my_cpt.xlsx", [[["HCPC", "LONG DESCRIPTION"]], [["code", "description"], [7, "second sheet is not read"]]])
    (tmp_path / "old_cpt.xls").write_bytes(b"binary")
    with ZipFile(tmp_path / "half_cpt.zip", "w") as half:
        half.writestr("a.csv", "CPT,LONG DESCRIPTION\n99999,never seen\n")
        half.writestr("b.xlsx", b"not a workbook")
    entries = descriptions.read_cpt_descriptions(spark, str(tmp_path))
    problems = sorted(r["problem"].split(":")[0] for r in descriptions.skipped_files(entries).collect())
    assert problems == ["cpt_broken.zip", "half_cpt.zip", "old_cpt.xls"]
    assert entries.filter("code = '99999'").count() == 0
    second = description_map(entries)
    assert {r.code: r.description for r in second.collect()} == {"99241": "Office consultation\nfor a patient", "10": "From archive", "11": "Last"}
    first = spark.createDataFrame([("11", "From the first source")], "code string, description string")
    codes = spark.createDataFrame([("11",), (" 99241 ",), ("none",), ("absent",)], "procedure_code string")
    got = {r["procedure_code"]: r["description"] for r in rows(attach_descriptions(codes, first, second))}
    assert got == {"11": "From the first source", " 99241 ": "Office consultation\nfor a patient", "none": None, "absent": None}
    assert rows(long_description("11", first, second))[0]["description"] == "From the first source"
    assert rows(descriptions.find_cpt_files(spark, str(tmp_path / "absent"))) == []


def test_fixed_names_are_consistent():
    assert set(fixed.SOURCE_URL_BY_FILE) == set(fixed.SOURCE_TYPE_BY_FILE)
    assert set(fixed.CODEBOOK_URL) == set(fixed.COLUMN_NAMES) == set(fixed.REQUIRED_COLUMNS)
