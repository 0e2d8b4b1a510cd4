"""ZIP landing: members are streamed to the shared folder, one task per member, then scanned in parallel."""

from __future__ import annotations

import shutil
import uuid
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from zipfile import ZipFile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from claimspark.session import scratch_path
from claimspark.sources.paths import base_name, exists, file_system, one_task_each, open_stream

_BLOCK = 8 << 20


@contextmanager
def _open_archive(path: str, bundle: str | None = None) -> Iterator[ZipFile]:
    """A ZIP, or the ZIP named ``bundle`` inside it, as a stream."""
    with ExitStack() as stack:
        archive = stack.enter_context(ZipFile(stack.enter_context(open_stream(path))))
        if bundle:
            entry = find_entry(archive.namelist(), bundle)
            if entry is None:
                raise FileNotFoundError(f"{bundle} is missing from {base_name(path)}.")
            archive = stack.enter_context(ZipFile(stack.enter_context(archive.open(entry))))
        yield archive


def find_entry(names: list[str], wanted: str) -> str | None:
    """First entry with that base name, without regard to case or folder."""
    return next((n for n in names if base_name(n).lower() == wanted.lower()), None)


def choose_csv_member(names: list[str], archive: str, member: str | None = None) -> str:
    """The named CSV member, or the only one; anything else is an error."""
    csv_names = [n for n in names if n.lower().endswith(".csv")]
    if member is None:
        if len(csv_names) != 1:
            raise ValueError(f"Expected one CSV member in {archive}; found {len(csv_names)}.")
        return csv_names[0]
    if member not in csv_names:
        raise ValueError(f"CSV member {member!r} not found in {archive}.")
    return member


def entry_names(spark: SparkSession, paths: list[str]) -> list[list[str]]:
    """Entry names of each archive, in their order (tables of contents only, read in one task per archive)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                with _open_archive(row.path) as archive:
                    names = archive.namelist()
                yield pd.DataFrame({"part": row.part, "names": [names]})

    listed = one_task_each(spark.createDataFrame(list(enumerate(paths)), "part int, path string"), "part")
    return [r["names"] for r in listed.mapInPandas(read, "part int, names array<string>").orderBy("part").collect()]


def _move_into_place(system, partial: str, target: str) -> None:
    """Rename; where a file system refuses to overwrite, a complete copy of an earlier attempt stays."""
    try:
        system.move(partial, target)
    except OSError:
        if not system.get_file_info(target).is_file:
            raise
        system.delete_file(partial)


def land_members(members: DataFrame) -> DataFrame:
    """Copy archive members to files. ``members`` is ``path, bundle, member, target``.

    Every member is streamed by its own task under a private name and renamed when complete, so a
    repeated or speculative attempt never leaves a partial file. Returns ``target, bytes``.
    """

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                system, target = file_system(row.target)
                folder = target.rsplit("/", 1)[0]
                system.create_dir(folder, recursive=True)
                partial = f"{folder}/.{uuid.uuid4().hex}.part"
                with _open_archive(row.path, row.bundle or None) as archive, archive.open(row.member) as source:
                    with system.open_output_stream(partial) as sink:
                        shutil.copyfileobj(source, sink, _BLOCK)
                _move_into_place(system, partial, target)
                size = system.get_file_info(target).size
                yield pd.DataFrame([(row.target, size)], columns=["target", "bytes"])

    spread = one_task_each(members, "path", "bundle", "member", "target")
    return spread.mapInPandas(copy, "target string, bytes long")


def land(spark: SparkSession, rows: list[tuple[str, str, str, str]]) -> None:
    members = spark.createDataFrame(rows, "path string, bundle string, member string, target string")
    land_members(members).agg(F.sum("bytes")).collect()


def land_csv_members(
    spark: SparkSession, paths: list[str], member: str | None = None, landing_dir: str | None = None
) -> list[str]:
    """Land one CSV member of each ZIP, all at once, and return the paths of the text files."""
    folder, rows = landing_dir or scratch_path(spark, "landing"), []
    for part, (path, names) in enumerate(zip(paths, entry_names(spark, paths))):
        chosen = choose_csv_member(names, base_name(path), member)
        own = f"{folder}/{part:08d}" if len(paths) > 1 else folder
        rows.append((path, "", chosen, f"{own}/{base_name(chosen)}"))
    land(spark, rows)
    return [target for _, _, _, target in rows]


def land_csv_member(
    spark: SparkSession, path: str, member: str | None = None, landing_dir: str | None = None
) -> str:
    """Land one CSV member of a ZIP and return the path of the text file."""
    return land_csv_members(spark, [path], member, landing_dir)[0]


def land_bundle(
    spark: SparkSession,
    path: str | list[str],
    bundle: str,
    tables: list[str],
    landing_dir: str | None = None,
    optional: tuple[str, ...] = (),
) -> dict[str, DataFrame]:
    """Tables (CSV names without suffix) of a ZIP inside a ZIP, as Parquet-backed DataFrames.

    An archive may come in parts, each with the bundle; a table is what its parts hold, one after the other. Policy CSV
    files hold quoted line ends and so cannot be split; they are rewritten once as Parquet, one task a file, with
    ``ingest_pos``, which grows with the part and with the position of each row in its file.
    """
    paths = [path] if isinstance(path, str) else path
    for p in paths:
        if not exists(spark, p):
            raise FileNotFoundError(f"Missing CMS coverage archive: {p}")
    folder = landing_dir or scratch_path(spark, "landing")
    # The inner archives are inflated once; their members are then read from files that can be positioned freely.
    inner, outer = [f"{folder}/{bundle}.landed/{part:08d}/{bundle}" for part in range(len(paths))], []
    for p, names, target in zip(paths, entry_names(spark, paths), inner):
        entry = find_entry(names, bundle)
        if entry is None:
            raise FileNotFoundError(f"{bundle} is missing from {base_name(p)}.")
        outer.append((p, "", entry, target))
    land(spark, outer)
    contents = entry_names(spark, inner)
    targets: dict[str, list[str]] = {}
    rows = []
    for table in tables:
        for part, names in enumerate(contents):
            if (entry := find_entry(names, f"{table}.csv")) is not None:
                targets.setdefault(table, []).append(f"{folder}/{bundle}/{table}/{part:08d}.csv")
                rows.append((inner[part], "", entry, targets[table][-1]))
        if table not in targets and table not in optional:
            raise FileNotFoundError(f"{table}.csv is missing from {bundle}.")
    land(spark, rows)
    return {table: _to_parquet(spark, files, f"{folder}/{bundle}/{table}.parquet") for table, files in targets.items()}


_ROW_BITS = 33  # of a generated id; the bits above number the partition


def _to_parquet(spark: SparkSession, csv_paths: list[str], parquet: str) -> DataFrame:
    from claimspark.sources.files import read_delimited

    rows = read_delimited(spark, csv_paths, ",", multi_line=True)
    # A multi-line file is inside one task, so the low bits of the generated ids follow its order.
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("long")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    rows.withColumn("ingest_pos", F.shiftleft(part, _ROW_BITS).bitwiseOR(place)).write.mode("overwrite").parquet(parquet)
    return spark.read.parquet(parquet)
