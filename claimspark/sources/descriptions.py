"""Description files: CSV, XLSX, or ZIP archives holding them.

Readers return ``code, description, file_rank, entry_rank, row_rank, problem`` for
``operators.descriptions.description_map``; file rank 1 is the newest file. Archives and workbooks are
read by one task per file, plain CSV files by Spark's own reader. A file that cannot be read to its end gives
no entries but one row with ``problem``, its name and the reason (see ``skipped_files``).
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby
from xml.etree.ElementTree import ParseError, iterparse
from zipfile import BadZipFile, ZipFile

import pandas as pd
from pyarrow.lib import ArrowInvalid
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from claimspark.functions import fixed
from claimspark.sources.files import list_files
from claimspark.sources.paths import one_task_each, open_stream

ENTRY = "code string, description string, file_rank int, entry_rank int, row_rank long, problem string"


_COLUMNS = ["code", "description", "file_rank", "entry_rank", "row_rank", "problem"]


def newest_first(files: DataFrame) -> DataFrame:
    """Number the listed files from the newest; equal times fall back to the path."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("modificationTime"), F.desc("path"))
    return files.withColumn("file_rank", F.row_number().over(order)).orderBy("file_rank")


def find_procedure_archives(spark: SparkSession, directory: str) -> DataFrame:
    """Quarterly code archives (``anweb`` in the name, ZIP), newest first."""
    return newest_first(list_files(spark, directory, r"anweb.*\.zip$"))


def find_cpt_files(spark: SparkSession, directory: str) -> DataFrame:
    """CPT description files (``cpt`` in the name; CSV, XLSX or ZIP), newest first."""
    return newest_first(list_files(spark, directory, r"cpt.*\.(csv|xlsx|xls|zip)$"))


def pick_columns(header: list[str], code_names: list[str], any_description: bool) -> tuple[int, int] | None:
    """Positions of the code and description columns, or None when either is missing."""
    codes, texts = [], []  # texts: long descriptions rank before others, then the position counts
    for place, title in enumerate(str(h or "").strip().lower() for h in header):
        if title in code_names:
            codes.append(place)
        rank = 0 if "long description" in title else 1 if any_description and "description" in title else 2
        texts.append((rank, place))
    best = min(texts, default=(2, 0))
    return (codes[0], best[1]) if codes and best[0] < 2 else None


# --- workbook cells -----------------------------------------------------------------------------


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _shared_strings(book: ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as source:
        for _, element in iterparse(source):
            if _local(element.tag) == "si":
                out.append("".join(t.text or "" for t in element.iter() if _local(t.tag) == "t"))
                element.clear()
    return out


def _cell_text(cell, shared: list[str]) -> str | None:
    kind = cell.get("t")
    parts = [e.text or "" for e in cell.iter() if _local(e.tag) == ("t" if kind == "inlineStr" else "v")]
    if not parts:
        return None
    return shared[int(parts[0])] if kind == "s" else "".join(parts)


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - ord("A") + 1
    return number - 1


def _sheet_files(book: ZipFile) -> list[str]:
    sheets = [n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
    return sorted(sheets, key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[-1]).group()))


def workbook_rows(stream) -> Iterator[tuple[int, list[str | None]]]:
    """``sheet number, cells`` for every row of an XLSX workbook, streamed sheet by sheet."""
    with ZipFile(stream) as book:
        shared = _shared_strings(book)
        for number, sheet in enumerate(_sheet_files(book)):
            with book.open(sheet) as source:
                for _, element in iterparse(source):
                    if _local(element.tag) != "row":
                        continue
                    cells: dict[int, str | None] = {}
                    for cell in (e for e in element if _local(e.tag) == "c"):
                        reference = cell.get("r")
                        position = _column_number(reference) if reference else len(cells)
                        cells[position] = _cell_text(cell, shared)
                    yield number, [cells.get(i) for i in range(max(cells, default=-1) + 1)]
                    element.clear()


# --- entries of one file --------------------------------------------------------------------------


def _table_entries(
    rows: Iterable[list[str | None]], code_names: list[str], any_description: bool
) -> Iterator[tuple[str, str]]:
    rows = iter(rows)
    columns = pick_columns(next(rows, []), code_names, any_description)
    if columns is None:
        return
    for row in rows:
        code, text = (row[i] if i < len(row) else None for i in columns)
        if code and code.strip() and text and text.strip():
            yield code, text


def _by_sheet(stream) -> Iterator[Iterator[list[str | None]]]:
    """Rows grouped by sheet."""
    for _, group in groupby(workbook_rows(stream), key=lambda item: item[0]):
        yield (cells for _, cells in group)


def _tables_of(stream, name: str) -> Iterator[Iterable[list[str | None]]]:
    if name.lower().endswith(".csv"):
        yield csv.reader(io.TextIOWrapper(stream, encoding="utf-8-sig", newline=""))
    else:
        yield from _by_sheet(stream)


def procedure_archive_entries(stream) -> Iterator[tuple[int, str, str]]:
    """Entries of the first sheet, in name order of the workbooks, that has any."""
    with ZipFile(stream) as archive:
        books = sorted((n for n in archive.namelist() if n.lower().endswith(".xlsx") and "anweb" in n.lower()), key=str.lower)
        for name in books:
            with archive.open(name) as book:
                for rows in _by_sheet(book):
                    found = False
                    for code, text in _table_entries(rows, fixed.PROCEDURE_FILE_CODE_HEADERS, False):
                        found = True
                        yield 0, code, text
                    if found:
                        return


def _first_table_entries(stream, name: str) -> Iterator[tuple[str, str]]:
    """Entries of a CSV file or of the first sheet of a workbook."""
    rows = next(_tables_of(stream, name), iter(()))
    yield from _table_entries(rows, fixed.CPT_FILE_CODE_HEADERS, True)


def cpt_file_entries(stream, name: str) -> Iterator[tuple[int, str, str]]:
    """Entries of a workbook, or of every table of an archive in name order."""
    if not name.lower().endswith(".zip"):
        yield from ((0, code, text) for code, text in _first_table_entries(stream, name))
        return
    with ZipFile(stream) as archive:
        wanted = sorted((n for n in archive.namelist() if n.lower().endswith((".csv", ".xlsx"))), key=str.lower)
        for place, member in enumerate(wanted):
            with archive.open(member) as source:
                yield from ((place, code, text) for code, text in _first_table_entries(source, member))


# --- readers --------------------------------------------------------------------------------------


def _read_with_tasks(files: DataFrame, kind: str) -> DataFrame:
    """One task per file; its rows leave the task once it is read to the end, or one row with the problem."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                try:
                    if row.name.lower().endswith(".xls"):
                        raise ValueError("workbooks of the old binary format are not supported")
                    with open_stream(row.path) as stream:
                        entries = procedure_archive_entries(stream) if kind == "procedure" else cpt_file_entries(stream, row.name)
                        whole = list(_batches(entries, row.file_rank))
                except (BadZipFile, ArrowInvalid, ParseError, UnicodeDecodeError, csv.Error, ValueError) as error:
                    problem = f"{row.name}: {error}"
                    whole = [pd.DataFrame([(None, None, row.file_rank, 0, 0, problem)], columns=_COLUMNS)]
                yield from whole

    return one_task_each(files.select("path", "name", "file_rank"), "file_rank").mapInPandas(read, ENTRY)


def skipped_files(entries: DataFrame) -> DataFrame:
    """``file_rank, problem`` of the files that could not be read."""
    return entries.filter(F.col("problem").isNotNull()).select("file_rank", "problem")


def _batches(entries: Iterator[tuple[int, str, str]], file_rank: int, size: int = 10_000) -> Iterator[pd.DataFrame]:
    rows = []
    for number, (place, code, text) in enumerate(entries):
        rows.append((code, text, file_rank, place, number, None))
        if len(rows) == size:
            yield pd.DataFrame(rows, columns=_COLUMNS)
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=_COLUMNS)


def read_procedure_descriptions(spark: SparkSession, directory: str) -> DataFrame:
    return _read_with_tasks(find_procedure_archives(spark, directory), "procedure")


def _read_cpt_csv(spark: SparkSession, path: str, file_rank: int) -> DataFrame | None:
    table = spark.read.csv(path, header=True, multiLine=True, escape='"')
    columns = pick_columns(table.columns, fixed.CPT_FILE_CODE_HEADERS, True)
    if columns is None:
        return None
    code, text = (F.col(f"`{table.columns[i]}`") for i in columns)
    # A multi-line file is read by one task, so the ids follow the file order.
    return table.select(
        code.alias("code"),
        text.alias("description"),
        F.lit(file_rank).alias("file_rank"),
        F.lit(0).alias("entry_rank"),
        F.monotonically_increasing_id().alias("row_rank"),
        F.lit(None).cast("string").alias("problem"),
    ).dropna(subset=["code", "description"])


def read_cpt_descriptions(spark: SparkSession, directory: str) -> DataFrame:
    files = find_cpt_files(spark, directory)
    is_csv = F.lower("name").endswith(".csv")
    plain = [_read_cpt_csv(spark, r["path"], r["file_rank"]) for r in files.filter(is_csv).collect()]
    packed = _read_with_tasks(files.filter(~is_csv), "cpt")
    return reduce(DataFrame.unionByName, [p for p in plain if p is not None], packed)
