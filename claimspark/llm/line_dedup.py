"""Repeated lines, found with levelled sorted runs of line hashes.

Documents come in batches of ascending ids. The runs hold the 128-bit hash of every line seen so far with the id
that holds it first. A batch reduces its lines to one row per hash, drops by anti-joins with the runs what they know,
and adds the rest as a new sorted run. When a level has ``FAN`` runs they are merged into one of the next level, so
the number of runs grows with the logarithm of the batches. At the end every line of a document is compared
with its first holder. Only hashes and ids are grouped and joined; texts move once, to meet their dropped lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimspark.llm.common import lower_ascii
from claimspark.session import materialise

BATCHES = 4
FAN = 2
MIN_CHARS = 10
_BLANKS = " \t\n\x0b\x0c\r"
_NO_ID = 2**63 - 1  # NULL ids are one document, after all others
_SALTS = (1, 2)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(_BLANKS)))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(F.lit(salt), key).alias(f"h{salt}") for salt in _SALTS]


class LineRuns:
    """Sorted runs of ``h1, h2, owner`` in the shared folder; a hash is in one run only."""

    def __init__(self, fan: int = FAN):
        self.fan, self.levels = fan, []  # runs by level

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> None:
        """Add what no run knows yet; ``keys`` has one row per hash."""
        for run in self.runs():
            keys = keys.join(run.select("h1", "h2"), ["h1", "h2"], "left_anti")
        self._put(0, keys)

    def _put(self, level: int, keys: DataFrame) -> None:
        run = materialise(keys.repartition("h1").sortWithinPartitions("h1", "h2"), f"line-run-{level}")
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan:
            together = reduce(DataFrame.unionByName, self.levels[level])
            self.levels[level] = []
            self._put(level + 1, together)


def _batch_ends(ids: DataFrame, batches: int) -> list[int]:
    """Upper ends of all batches but the last, as quantiles of the ids."""
    shares = [i / batches for i in range(1, batches)]
    return sorted(set(ids.agg(F.percentile_approx("doc", shares, 1000)).first()[0] or [])) if shares else []


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, batches: int, fan: int) -> DataFrame:
    """``doc, h1, h2``: hashes of the lines that a document loses."""
    key = F.col("key")
    lines = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"),
        F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("line"),
    ).select("doc", line_key(F.col("line")).alias("key"))
    lines = materialise(lines.filter(F.length(key) >= min_chars).select("doc", *_hashes(key)), "lines")
    runs = LineRuns(fan)
    ends = _batch_ends(lines, batches)
    for low, high in zip([None, *ends], [*ends, None]):
        batch = lines
        batch = batch.filter(F.col("doc") > low) if low is not None else batch
        batch = batch.filter(F.col("doc") <= high) if high is not None else batch
        runs.add(batch.groupBy("h1", "h2").agg(F.min("doc").alias("owner")))
    owners = reduce(DataFrame.unionByName, runs.runs())
    return lines.join(owners, ["h1", "h2"]).filter("owner <> doc").select("doc", "h1", "h2")


def _seeds(spark: SparkSession) -> list[int]:
    """Seeds with which the plain 64-bit hash of a key equals the two column hashes above."""
    row = spark.range(1).select(*[F.xxhash64(F.lit(s)) for s in _SALTS]).first()
    return [v % 2**64 for v in row]


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, batches: int = BATCHES, fan: int = FAN
) -> DataFrame:
    """``docs`` with the remaining lines as text, and ``line_count`` (before) and ``lines_dropped``.

    A line's key is the line without outer white space, ASCII letters lower-cased. Keys of at least ``min_chars`` code
    points found in several documents lose their lines except in the smallest id holding it. A NULL or empty
    text is one empty line, and NULL becomes empty. Rows that share an id are one document: a line repeated only
    among them stays. Rows with NULL ids are one document after all others. Other columns pass through; columns
    already named like the two counts are replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    gone = dropped_lines(docs, id_col, text_col, min_chars, batches, fan).distinct()
    gone = gone.groupBy("doc").agg(F.collect_list(F.struct("h1", "h2")).alias("gone"))
    own = [c for c in docs.columns if c not in ("line_count", "lines_dropped")]
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("line text"),
        F.struct(*[F.col(f"`{c}`") for c in own if c != text_col]).alias("others"),
    )
    rows = rows.join(gone, "doc", "left").select("others", "line text", "gone")
    seeds = _seeds(spark)
    kept_type = rows.select("others", F.lit("").alias("text"), F.lit(0).cast("long").alias("line_count"), F.lit(0).cast("long").alias("lines_dropped")).schema
    first, second = seeds

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, drops = [], [], []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines = text.split("\n")
                kept = lines
                if gone:
                    hashes = {(g["h1"] % 2**64, g["h2"] % 2**64) for g in gone}
                    kept = []
                    for line in lines:
                        key = line.strip(_BLANKS).encode()
                        key = key.lower()
                        if (xxhash.xxh64_intdigest(key, first), xxhash.xxh64_intdigest(key, second)) not in hashes:
                            kept.append(line)
                texts.append("\n".join(kept))
                counts.append(len(lines))
                drops.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(drops, pa.int64())],
                ["others", "text", "line_count", "lines_dropped"],
            )

    result = rows.mapInArrow(cut, kept_type)
    columns = [(F.col("text") if c == text_col else F.col("others").getField(c)).alias(c) for c in own]
    return result.select(*columns, "line_count", "lines_dropped")
