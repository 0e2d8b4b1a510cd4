"""Joins of days with validity periods, and periods merged into spells.

A period is cut into dyadic pieces: runs of 2^level days that begin at a multiple of their length. It has at most two
pieces a level, and a day lies in exactly one run of each level, so "which periods hold this day" is an equijoin on key, level
and run. Nothing is compared by ranges, and overlapping, nested and open periods need no special care.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimspark.operators.joins import salted_join

FIRST_DAY = "0001-01-01"
TOP_LEVEL = 22  # 2^22 days reach from year 1 beyond year 9999
LAST_NUMBER = (1 << TOP_LEVEL) - 1


def day_number(day: Column) -> Column:
    return F.datediff(day, F.to_date(F.lit(FIRST_DAY)))


def bounds(start: str, end: str) -> list[Column]:
    """First and last day of a period as numbers; a NULL start or end is open."""
    return [
        F.coalesce(day_number(F.col(start)), F.lit(0)).alias("first_number"),
        F.coalesce(day_number(F.col(end)), F.lit(LAST_NUMBER)).alias("last_number"),
    ]


def dyadic_pieces() -> Column:
    """``level`` and ``run`` of the pieces of the days from ``first_number`` to ``last_number``."""
    level = f"""transform(sequence(0, {TOP_LEVEL}), l -> named_struct(
        'level', l, 'low', shiftright(first_number + shiftleft(1, l) - 1, l), 'high', shiftright(last_number + 1, l) - 1))"""
    return F.expr(f"""transform(filter(flatten(transform({level}, p -> array(
        named_struct('level', p.level, 'run', p.low, 'taken', p.low <= p.high AND p.low % 2 = 1),
        named_struct('level', p.level, 'run', p.high, 'taken', p.low <= p.high AND p.high % 2 = 0)))), p -> p.taken),
        p -> named_struct('level', p.level, 'run', p.run))""")


def versions_by_day(days: DataFrame, reference: DataFrame, keys: list[str], day: str, start: str, end: str, order: list[str]) -> DataFrame:
    """For distinct ``keys`` and ``day`` the version of ``reference`` in force, with ``versions_in_force``; days without one are left out.

    Of several, the one with the latest start wins, an open start being the earliest, then the largest ``order``.
    """
    payload = [c for c in reference.columns if c not in keys]
    periods = reference.select(*keys, *payload, *bounds(start, end)).filter("first_number <= last_number")
    ranked = ["first_number", *order]
    periods = periods.groupBy(*keys, "first_number", "last_number", *order).agg(F.max(F.struct(*[c for c in payload if c not in order], *order)).alias("version"))
    pieces = periods.withColumn("piece", F.explode(dyadic_pieces())).select(*keys, *ranked, "last_number", "piece.level", "piece.run")
    # A run keeps its best version and their number, so a day meets at most one row a level, however many periods hold it.
    pieces = pieces.groupBy(*keys, "level", "run").agg(F.max(F.struct(*ranked, "last_number")).alias("best"), F.count("*").alias("versions"))
    levels = [r[0] for r in pieces.select("level").distinct().collect()]  # at most TOP_LEVEL + 1 numbers
    if not levels:
        levels = [0]
    number = day_number(F.col(day))
    runs = F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright(number, n).alias("run")) for n in sorted(levels)])
    probes = days.withColumn("piece", F.explode(runs)).select(*keys, day, "piece.level", "piece.run")
    hits = probes.join(pieces.hint("merge"), [*keys, "level", "run"])
    best = hits.groupBy(*keys, day).agg(F.max("best").alias("best"), F.sum("versions").alias("versions_in_force"))
    best = best.select(*keys, day, *[F.col(f"best.{c}").alias(c) for c in (*ranked, "last_number")], "versions_in_force")
    chosen = best.join(periods.hint("merge"), [*keys, *ranked, "last_number"])
    return chosen.select(*keys, day, *[F.col(f"version.{c}").alias(c) for c in payload], "versions_in_force")


def join_dated(
    lines: DataFrame, reference: DataFrame, keys: list[str], day: str, start: str, end: str, by: list[str], order: list[str] | None = None
) -> DataFrame:
    """Every line with the version of its ``keys`` that is in force on its ``day``, and ``versions_in_force``.

    ``start`` and ``end`` are inclusive dates; NULL is open. Periods that end before they start are never in force. Where periods
    overlap, the one that starts last wins, then the one with the largest ``order`` columns; versions equal in these and in
    both dates count once. Lines without key, day or version keep NULLs and 0. Only distinct days of a key are
    compared with periods; the lines then meet the result by key and day, hot keys split by a hash of ``by``. Pieces, days and
    salts are many times the rows that Spark's estimate for the reference is made from, so these joins are sort-merge joins, never broadcasts.
    """
    order = order or []
    own = [c for c in reference.columns if c not in keys]
    clash = {*own, "versions_in_force"} & set(lines.columns)
    if clash:
        raise ValueError(f"Columns in both tables: {sorted(clash)}")
    days = lines.select(*keys, day).dropna().distinct()
    versions = versions_by_day(days, reference.dropna(subset=keys), keys, day, start, end, order)
    joined = salted_join(lines, versions.hint("merge"), [*keys, day], by=by, how="left")
    return joined.select(*lines.columns, *own, F.coalesce("versions_in_force", F.lit(0).cast("long")).alias("versions_in_force"))


def spells(periods: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Periods of each key merged into maximal spells: ``keys, start, end, periods``, open ends NULL.

    Periods that overlap, or of which one begins the day after the other ends, are one spell. Periods that end before they start and
    rows with a NULL key are left out. Periods of one key and start are merged first, so a key has at most a row a day.
    """
    rows = periods.dropna(subset=keys).select(*keys, *bounds(start, end)).filter("first_number <= last_number")
    rows = rows.groupBy(*keys, "first_number").agg(F.max("last_number").alias("last_number"), F.count("*").alias("periods"))
    own = Window.partitionBy(*keys).orderBy("first_number")
    reached = F.max("last_number").over(own.rowsBetween(Window.unboundedPreceding, -1))
    begins = reached.isNull() | (F.col("first_number") > reached + 1)
    rows = rows.withColumn("begins", begins.cast("int")).withColumn("spell", F.sum("begins").over(own))
    merged = rows.groupBy(*keys, "spell").agg(F.min("first_number").alias("first_number"), F.max("last_number").alias("last_number"), F.sum("periods").alias("periods"))

    def day(number: str, open_value: int) -> Column:
        return F.when(F.col(number) != open_value, F.date_add(F.to_date(F.lit(FIRST_DAY)), F.col(number)))

    return merged.select(*keys, day("first_number", 0).alias(start), day("last_number", LAST_NUMBER).alias(end), "periods")
