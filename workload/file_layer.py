"""The file layer on whole tables: raw text files, ZIPs and nested ZIPs are made in tasks, then read by the library."""

from __future__ import annotations

import gzip
import shutil
from collections.abc import Iterator
from zipfile import ZIP_DEFLATED, ZIP_STORED, ZipFile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from claimspark.functions import fixed, names
from claimspark.operators import coverage, descriptions
from claimspark.operators.claim_lines import combine_claim_lines, lines_with_code
from claimspark.operators.normalize import normalize_source, type_columns
from claimspark.plans import coverage_build
from claimspark.session import scratch_path
from claimspark.sources import descriptions as description_files_reader, files
from claimspark.sources.paths import base_name, exists, file_system, one_task_each, open_stream
from workload import adapter as a, staging


ROWS_PER_PART = 200_000


def write_text(df: DataFrame, path: str, delimiter: str = "|") -> str:
    """Delimited text with header; padding and blanks as they are."""
    writer = df.write.option("sep", delimiter).option("header", True).option("emptyValue", "").option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def parts_for(rows: int) -> int:
    """Files or archives for so many rows: each is written, packed and landed in a task of its own."""
    return max(4, -(-rows // ROWS_PER_PART))


def named_files(df: DataFrame, folder: str, name: str, order: list[str], delimiter: str = "|", compression: str = "none") -> list[str]:
    """One file per value of the column ``name``, rows in ``order``; returns the paths. Without order, rows are in place: a value belongs to one task."""
    spark = df.sparkSession
    parts = f"{folder}.parts"
    own = [c for c in df.columns if c not in (name, *[o for o in order if o.startswith("_")])]
    rows = (df.repartition(name).sortWithinPartitions(name, *order) if order else df).select(*own, name)
    writer = rows.write.partitionBy(name).option("sep", delimiter).option("header", True).option("emptyValue", "").option("escape", '"')
    writer = writer.option("compression", compression)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(parts)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm_path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jvm_path(folder))
    paths = []
    for part in fs.globStatus(jvm_path(f"{parts}/{name}=*/part-*")):
        source = part.getPath()
        target = f"{folder}/{source.getParent().getName().removeprefix(name + '=')}"
        if not fs.rename(source, jvm_path(target)):
            raise OSError(f"Cannot name {target}")
        paths.append(target)
    return sorted(paths)


def pack(spark: SparkSession, members: list[tuple[str, str, str, str]]) -> None:
    """Make archives in tasks, one each, from ``(archive, bundle, member, file)``; a bundle is a ZIP inside the ZIP. Files ``.gz`` are unpacked on the way."""
    listed = spark.createDataFrame(members, "archive string, bundle string, member string, file string")
    archives = listed.groupBy("archive", "bundle").agg(F.sort_array(F.collect_list(F.struct("member", "file"))).alias("members"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def fill(book: ZipFile, members) -> None:
            for member, file in ((m["member"], m["file"]) for m in members):
                with open_stream(file) as source, book.open(member, "w", force_zip64=True) as sink:
                    shutil.copyfileobj(gzip.open(source) if file.endswith(".gz") else source, sink, 1 << 20)

        for batch in batches:
            for row in batch.to_dict("records"):
                system, inner = file_system(row["archive"])
                system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(inner) as out, ZipFile(out, "w", ZIP_DEFLATED) as book:
                    if row["bundle"]:
                        book.compression = ZIP_STORED  # the members are packed already
                        with book.open(f"data/{row['bundle']}", "w", force_zip64=True) as nested, ZipFile(nested, "w", ZIP_DEFLATED) as deep:
                            fill(deep, row["members"])
                    else:
                        fill(book, row["members"])
                yield pd.DataFrame([(row["archive"],)], columns=["archive"])

    one_task_each(archives, "archive").mapInPandas(write, "archive string").count()


def _raw(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return a.raw_claims(a.claim_base(spark, sf), kind)


def claim_files_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Carrier text written as many files, scanned and normalised."""
    path = write_text(_raw(spark, sf, "carrier"), scratch_path(spark, "raw") + "/carrier.csv")
    return normalize_source(files.scan_claim_file(spark, path), "carrier")


def zip_claim_files(spark: SparkSession, sf: str) -> DataFrame:
    """Carrier text in many ZIPs with one member each, landed and read as one table."""
    folder, rows = scratch_path(spark, "raw-zip"), _raw(spark, sf, "carrier")
    count = parts_for(a.table(spark, sf, "lineitem").count())
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(count))
    members = named_files(rows.withColumn("file", F.format_string("carrier-%08d.csv", part)).repartition("file"), folder, "file", [])
    archives = [(f"{member.removesuffix('.csv')}.zip", "", base_name(member), member) for member in members]
    pack(spark, archives)
    return normalize_source(files.load_table(spark, [archive for archive, *_ in archives]), "carrier")


def claim_lines_from_files(spark: SparkSession, sf: str) -> DataFrame:
    """Claim lines of all three claim types from text files; keys as in ``procedure_lines``."""
    folder = scratch_path(spark, "raw-lines")
    tables = {}
    for kind in a.CLAIM_TYPES:
        path = write_text(_raw(spark, sf, kind), f"{folder}/{kind}.csv")
        tables[kind] = normalize_source(files.scan_claim_file(spark, path), kind)
    return combine_claim_lines(tables).withColumns({
        "diagnosis_codes": F.array_join("diagnosis_codes", "|"),
        "claim_key": F.regexp_replace("claim_key", r":row:\d+$", ":row"),
    })


def yearly_beneficiary_files(spark: SparkSession, sf: str) -> DataFrame:
    """One file per year, read as a union with the year from the file name."""
    people = a.raw_beneficiaries(spark, sf).drop("year").repartition("source_file")
    paths = named_files(people, scratch_path(spark, "people"), "source_file", [])
    raw = files.scan_yearly_files(spark, paths).drop("source_file")
    return type_columns(names.lower_names(names.standardize_columns(raw, "beneficiary")), keep=("year",))


# (application, table folder) -> folder of the archives made in this session
_POLICY_ARCHIVES: dict[tuple[str, str], str] = {}


def policy_archives(spark: SparkSession, sf: str) -> str:
    """Folder with the policy tables as CSV in parts of nested ZIPs.

    A part holds a stretch of each table's positions, or what one task reads of it where positions do not matter, which moves no rows.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key in _POLICY_ARCHIVES and exists(spark, _POLICY_ARCHIVES[key]):
        return _POLICY_ARCHIVES[key]
    folder = scratch_path(spark, "policy-zip")
    members = []
    for kind, tables in staging.coverage_tables(spark, sf).items():
        archive, bundle = fixed.COVERAGE_ARCHIVES[kind]
        count = parts_for(max(rows.count() for rows in tables.values()))
        for name, rows in tables.items():
            placed = "ingest_pos" in rows.columns
            if placed:
                last = rows.agg(F.max("ingest_pos")).first()[0] or 0
                part = F.floor(F.col("_place") * count / (last + 1)).cast("long")
            else:
                part = F.spark_partition_id()
            rows = rows.withColumnRenamed("ingest_pos", "_place").withColumn("file", F.format_string("%08d.csv.gz", part))
            for file in named_files(rows, f"{folder}/{kind}-{name}", "file", ["_place"] if placed else [], ",", "gzip"):
                number = base_name(file).removesuffix(".csv.gz")
                members.append((f"{folder}/{archive.removesuffix('.zip')}.part-{number}.zip", bundle, f"tables/{name}.csv", file))
    pack(spark, members)
    _POLICY_ARCHIVES[key] = folder
    return folder


def nested_zip_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Policy matches for all observed codes, from nested ZIPs landed as the coverage job does."""
    folder = policy_archives(spark, sf)
    tables = coverage_build.land_policy_tables(spark, folder, scratch_path(spark, "policy-landed"))
    return coverage.policy_matches(tables, staging.codes(spark, sf), F.lit(a.AS_OF))


def description_files(spark: SparkSession, sf: str) -> DataFrame:
    """The second description source as CSV files of different age, read and looked up."""
    first, second = a.description_entries(spark, sf)
    rows = second.select(
        F.col("code").alias("CPT"), F.col("description").alias("LONG DESCRIPTION"), F.col("row_rank").alias("_row"),
        F.concat(F.lit("cpt_"), F.col("file_rank").cast("string"), F.lit(".csv")).alias("file"),
    )
    folder = scratch_path(spark, "descriptions")
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm_path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for n, path in enumerate(named_files(rows, folder, "file", ["_row"], ",")):
        fs.setTimes(jvm_path(path), 1_700_000_000_000 - n * 86_400_000, -1)  # the first is the newest
    maps = (descriptions.description_map(e) for e in (first, description_files_reader.read_cpt_descriptions(spark, folder)))
    codes = lines_with_code(staging.lines(spark, sf)).select("procedure_code").distinct()
    return descriptions.attach_descriptions(codes, *maps)


# Each reads files, so it must give what the query on the tables gives.
SAME_AS = {
    claim_files_scan: "normalized_carrier", zip_claim_files: "normalized_carrier", claim_lines_from_files: "procedure_lines",
    yearly_beneficiary_files: "beneficiary_union_years", nested_zip_tables: "coverage_policy_matches", description_files: "description_lookup",
}
