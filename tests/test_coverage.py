import datetime
import json
import random
from io import BytesIO
from zipfile import ZIP_DEFLATED, ZipFile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimspark.functions import fixed
from claimspark.operators import coverage, policy_index
from claimspark.plans import coverage_build
from claimspark.sources import policy_payloads


def archive(folder, outer, inner, tables):
    buffer = BytesIO()
    with ZipFile(buffer, "w", ZIP_DEFLATED) as nested:
        for name, records in tables.items():
            nested.writestr(f"tables/{name.upper()}.csv", b"\xef\xbb\xbf" + pd.DataFrame(records).to_csv(index=False).encode())
    with ZipFile(folder / outer, "w", ZIP_DEFLATED) as out:
        out.writestr(f"data/{inner}", buffer.getvalue())


STATES = {f"{n}": name for n, name in enumerate(["AA", "BB", "CC", "DD", "EE"])}
WANTED = ["x1", " X2 ", "x3", "X5", "x3", ""]
DAY = datetime.date(2024, 3, 15)


def draw_tables(seed):
    """Random policy tables of every kind, as lists of records in file order."""
    d = random.Random(seed)

    def maybe(value, share=0.3):
        return "" if d.random() < share else value

    def date():
        return maybe(f"{d.randint(2021, 2027)}-{d.randint(1, 12):02}-{d.randint(1, 28):02}")

    parties = [(f"{n}", f"{d.randint(1, 2)}", "1") for n in range(6)]
    names = ("contractor_id", "contractor_type_id", "contractor_version")
    common = {
        "contractor": [dict(zip(names, p), contractor_bus_name=maybe(d.choice(["North", "South", "West"]))) for p in parties],
        "contractor_jurisdiction": [dict(zip(names, d.choice(parties)), state_id=d.choice([*STATES, "99"]), active_date=date(), term_date=date()) for _ in range(15)],
        "state_lookup": [{"state_id": s, "state_abbrev": "old"} for s in ("1", "3")] + [{"state_id": s, "state_abbrev": n} for s, n in STATES.items()],
    }
    out = {"NCD": {"ncd_trkg": [
        {"NCD_id": f"{d.randint(1, 6)}", "NCD_vrsn_num": f"{d.randint(1, 2)}", "NCD_mnl_sect_title": f"national, {n}", "NCD_efctv_dt": date(), "NCD_trmntn_dt": ""} for n in range(14)
    ]}}
    for kind in ("LCD", "Article"):
        prefix = kind.lower()
        keys = [{f"{prefix}_id": f"{p}", f"{prefix}_version": f"{v}"} for p in range(1, 8) for v in range(1, d.randint(2, 4))]
        dates = {c: date for c in (*coverage.EFFECTIVE[kind], *coverage.RETIRED[kind])}
        tables = {
            prefix: [{**d.choice(keys), "display_id": f"{kind[0]}{n}", "title": f'rule "{n}",\nline two', "status": maybe("A"), **{c: make() for c, make in dates.items()}} for n in range(20)],
            f"{prefix}_x_hcpc_code": [{**d.choice(keys), "hcpc_code_id": d.choice(["x1", " X2", "X3 ", "X4", ""]), "long_description": maybe(f"long {n}"), "short_description": maybe(f"short {n}")} for n in range(30)],
            f"{prefix}_x_contractor": [{**d.choice(keys), **dict(zip(names, d.choice([*parties, ("77", "1", "1")])))} for _ in range(18)],
            f"{prefix}_x_primary_jurisdiction": [{**d.choice(keys), "state_id": d.choice([*STATES, "99"])} for _ in range(9)],
            f"{prefix}_related_ncd_documents": [{**d.choice(keys), "r_ncd_id": d.choice(["0", "", "1", "2", "3", "9"]), "r_ncd_version": f"{d.randint(1, 2)}"} for _ in range(12)],
            **common,
        }
        if kind == "Article":
            for name in ("covered", "noncovered"):
                tables[f"article_x_icd10_{name}"] = [{**d.choice(keys), "icd10_code_id": f"D{d.randint(1, 9)}", "description": maybe(f"{name} text")} for _ in range(15)]
        else:
            del tables["contractor"]  # an optional table
        out[kind] = tables
    return out


def plain_results(tables, day):
    """The three relationship tables by loops over the records."""
    wanted = {c.strip().upper() for c in WANTED} - {""}
    matches, diagnoses, national = [], [], []
    states = {r["state_id"]: r["state_abbrev"] for r in tables["LCD"]["state_lookup"]}
    ncds = {(r["NCD_id"], r["NCD_vrsn_num"]): r for r in tables["NCD"]["ncd_trkg"]}

    def in_force(row):
        return (not row["active_date"] or row["active_date"] <= day.isoformat()) and (not row["term_date"] or row["term_date"] >= day.isoformat())

    for kind in ("LCD", "Article"):
        prefix, own = kind.lower(), tables[kind]
        key = lambda r: (r[f"{prefix}_id"], r[f"{prefix}_version"])
        party = lambda r: (r["contractor_id"], r["contractor_type_id"], r["contractor_version"])
        latest = {key(r): r for r in own[prefix]}
        codes = [(key(r), r["hcpc_code_id"].strip().upper(), r) for r in own[f"{prefix}_x_hcpc_code"] if r["hcpc_code_id"].strip().upper() in wanted]
        for k, code, row in codes:
            if k not in latest:
                continue
            links = {party(r) for r in own[f"{prefix}_x_contractor"] if key(r) == k}
            names = {r["contractor_bus_name"] for r in own.get("contractor", []) if party(r) in links} - {""}
            served = {states[r["state_id"]] for r in own["contractor_jurisdiction"] if party(r) in links and in_force(r) and r["state_id"] in states}
            primary = {states[r["state_id"]] for r in own[f"{prefix}_x_primary_jurisdiction"] if key(r) == k and r["state_id"] in states}
            first = lambda columns: next((latest[k][c] for c in columns if latest[k][c]), "")
            matches.append((
                code, kind, *k, latest[k]["display_id"], latest[k]["title"], latest[k]["status"], first(coverage.EFFECTIVE[kind]), first(coverage.RETIRED[kind]),
                "; ".join(sorted(names)), ", ".join(sorted(served or primary)), row["short_description"], "", row["long_description"],
            ))
        for k, code in {(k, code) for k, code, _ in codes}:
            for r in own[f"{prefix}_related_ncd_documents"]:
                to = r["r_ncd_id"], r["r_ncd_version"]
                if key(r) == k and to[0] not in ("0", "") and to in ncds:
                    national.append((code, kind, *k, *to, ncds[to]["NCD_mnl_sect_title"], ncds[to]["NCD_efctv_dt"]))
            for name, label in (("covered", fixed.DIAGNOSIS_COVERED), ("noncovered", fixed.DIAGNOSIS_NONCOVERED)):
                for r in own.get(f"article_x_icd10_{name}", []):
                    if key(r) == k:
                        diagnoses.append((code, *k, latest.get(k, {}).get("title", ""), r["icd10_code_id"], r["description"], label))
    return sorted(matches), sorted(diagnoses), sorted(national)


@pytest.fixture(scope="module", params=[11, 12])
def drawn(request, tmp_path_factory):
    tables, folder = draw_tables(request.param), tmp_path_factory.mktemp("policies")
    for kind, (outer, inner) in fixed.COVERAGE_ARCHIVES.items():
        archive(folder, outer, inner, tables[kind])
    return tables, folder


def test_coverage_job_against_plain_joins(spark, drawn, tmp_path):
    tables, folder = drawn
    derived = str(tmp_path / "derived")
    counts = coverage_build.build_local_coverage_relationships(spark, str(folder), derived, WANTED, DAY)
    matches, diagnoses, national = plain_results(tables, DAY)
    assert len(matches) > 8 and len(diagnoses) > 5 and len(national) > 3 and len({m[10] for m in matches}) > 2
    written = {name: spark.read.parquet(f"{derived}/{name}") for name in counts}
    blank = lambda *names: [F.coalesce(n, F.lit("")) for n in names]
    got = written["coverage_policy_matches.parquet"]
    assert got.columns == coverage.MATCH_COLUMNS
    got = got.select(*blank("procedure_code", "policy_type", "policy_id", "policy_version", "display_id", "title", "status", "effective_date", "retirement_date", "contractor", "jurisdiction", "short_description", "medium_description", "long_description"))
    assert sorted(map(tuple, got.collect())) == matches
    got = written["coverage_icd10_relationships.parquet"].select(*blank("procedure_code", "policy_id", "policy_version", "policy_title", "icd10_code", "icd10_description", "code_relationship"))
    assert sorted(map(tuple, got.collect())) == diagnoses
    got = written["coverage_ncd_relationships.parquet"].select(*blank("procedure_code", "source_policy_type", "source_policy_id", "source_policy_version", "related_policy_id", "related_policy_version", "related_policy_title", "effective_date"))
    assert sorted(map(tuple, got.collect())) == national
    for code in ("x2 ", "X9"):
        found = coverage_build.load_local_coverage_details(spark, code, derived)
        expected = [[r for r in rows if r[0] == code.strip().upper()] for rows in (matches, diagnoses, national)]
        assert [found[n].count() for n in ("policy_matches", "icd10_relationships", "ncd_relationships")] == list(map(len, expected))
    absent = coverage_build.load_local_coverage_details(spark, "X1", str(tmp_path / "absent"))
    assert absent["ncd_relationships"].columns == coverage.NCD_COLUMNS and absent["ncd_relationships"].count() == 0


def test_jurisdiction_depends_on_the_day(spark, drawn, tmp_path):
    tables, folder = drawn
    landed = coverage_build.land_policy_tables(spark, str(folder), str(tmp_path / "landed"))
    codes = coverage.code_list(spark, WANTED)
    seen = set()
    for day in (datetime.date(2020, 1, 1), datetime.date(2023, 6, 1), datetime.date(2028, 1, 1)):
        rows = coverage.policy_matches(landed, codes, F.lit(day)).select("procedure_code", "policy_type", "policy_id", "policy_version", "jurisdiction").collect()
        expected = [(*m[:4], m[10]) for m in plain_results(tables, day)[0]]
        assert sorted(map(tuple, rows)) == sorted(expected)
        seen.add(tuple(sorted(expected)))
    assert len(seen) > 1
    titles = {r["title"] for r in tables["LCD"]["lcd"]} | {r["title"] for r in tables["Article"]["article"]}
    titled = {r["source_policy_title"] for r in coverage.ncd_relationships(landed, codes, with_titles=True).collect()}
    assert titled - {""} and titled <= titles | {""}


def test_missing_inputs(spark, drawn, tmp_path):
    _, folder = drawn
    with pytest.raises(FileNotFoundError, match="Missing CMS coverage archive"):
        coverage_build.build_local_coverage_relationships(spark, str(tmp_path), str(tmp_path), ["a"])
    with pytest.raises(FileNotFoundError, match="Missing procedure summary"):
        coverage_build.build_local_coverage_relationships(spark, str(folder), str(tmp_path / "none"))
    archive(tmp_path, "ncd.zip", "other.zip", {"x": [{"a": "1"}]})
    with pytest.raises(Exception, match="ncd_csv.zip is missing from ncd.zip"):
        coverage_build.land_bundle(spark, str(tmp_path / "ncd.zip"), "ncd_csv.zip", ["ncd_trkg"])
    with pytest.raises(FileNotFoundError, match="ncd_trkg.csv is missing from other.zip"):
        coverage_build.land_bundle(spark, str(tmp_path / "ncd.zip"), "other.zip", ["ncd_trkg"])


def test_code_table_needs_its_code_column(spark):
    tables = {"lcd_x_hcpc_code": spark.createDataFrame([("1", "1")], "lcd_id string, lcd_version string")}
    with pytest.raises(ValueError, match="lcd_x_hcpc_code has no hcpc_code_id column"):
        coverage.code_rows(tables, "LCD", coverage.code_list(spark, ["A"]))


# --- policy index ---------------------------------------------------------------------------------------


def payload(path, *records):
    path.write_text(json.dumps({"data": list(records)}, indent=1))
    return str(path)


def draw_records(seed):
    """Records of each kind; every field but the id may be absent."""
    d = random.Random(seed)
    fields = {
        "document_version": lambda: d.randint(1, 30), "document_display_id": lambda: f"{d.choice('PQR')}.{d.randint(1, 50)}", "title": lambda: d.choice(["Bone Scan (50%)", "Lamp Use", "Skin Graft"]),
        "effective_date": lambda: "03/04/2025", "retirement_date": lambda: "05/06/2031", "contractor_name_type": lambda: d.choice(["First", "Second"]), "url": lambda: f"https://x/{d.randint(1, 99)}",
        "status": lambda: "Old", "document_status": lambda: "Final", "updated_on": lambda: "2026",
    }
    out, number = {}, 100
    for kind in ("NCD", "LCD", "Article"):
        out[kind] = []
        for _ in range(12):
            number += 1
            out[kind].append({"document_id": number, **{k: make() for k, make in fields.items() if d.random() < 0.7}})
    return out


def test_policy_index(spark, rows, tmp_path):
    records = draw_records(5)
    paths = {kind: payload(tmp_path / f"{kind}.json", *own) for kind, own in records.items()}
    index = policy_index.build_policy_index({k: policy_payloads.read_payloads(spark, p, k) for k, p in paths.items()}, "now")
    got = {r["policy_id"]: r for r in rows(index)}
    assert index.columns == policy_index.INDEX_COLUMNS and len(got) == 36
    for kind, own in records.items():
        for record in own:
            row = got[str(record["document_id"])]
            assert (row["policy_type"], row["title"]) == (kind, record.get("title", ""))
            assert row["jurisdiction"] == ("National" if kind == "NCD" else "") and row["effective_date"] == record.get("effective_date", "")
            assert row["contractor"] == record.get("contractor_name_type", "") and row["last_updated"] == record.get("updated_on", "")

    def search(*args):
        return {r["policy_id"] for r in rows(policy_index.search_policy_index(index, *args))}

    def holds(row, text):
        return any(text.lower() in row[c].lower() for c in ("title", "display_id", "policy_id"))

    for text in ("lamp", "(50%)", "5.%", "P.1", "105"):
        assert search(f" {text} ") == {i for i, r in got.items() if holds(r, text)}
        assert search(text, ["LCD"]) == {i for i, r in got.items() if holds(r, text) and r["policy_type"] == "LCD"}
    assert len(search()) == 36
    path = str(tmp_path / "cache" / "index.parquet")
    assert policy_payloads.load_policy_index(spark, path) is None
    assert policy_payloads.save_policy_index(index, path) == 36
    assert sorted(map(str, rows(policy_payloads.load_policy_index(spark, path)))) == sorted(map(str, rows(index)))


@pytest.mark.parametrize("content", ['{"data": "text"}', '{"other": []}'])
def test_invalid_payload(spark, tmp_path, content):
    (tmp_path / "bad.json").write_text(content)
    with pytest.raises(Exception, match="invalid LCD policy index"):
        policy_payloads.read_payloads(spark, str(tmp_path / "bad.json"), "LCD").collect()


def test_code_membership(spark, rows):
    d = random.Random(8)
    lists = {f"p{n}": [d.choice(["a1", " A1 ", "A11", "b2", "B2x", None]) for _ in range(d.randint(0, 3))] for n in range(25)} | {"none": None}
    policies = spark.createDataFrame(list(lists.items()), "policy_id string, procedure_codes array<string>")
    for code in (" a1 ", "B2", "zz"):
        expected = {p for p, codes in lists.items() if any((c or "").strip().upper() == code.strip().upper() for c in codes or [])}
        assert {r["policy_id"] for r in rows(policy_index.match_policy_codes(policies, code))} == expected
