"""Typing of standardised claim text: dates, numbers and stripped text, chosen by column name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimspark.functions.names import is_date_name, is_number_name, lower_names, standardize_columns
from claimspark.functions.text import clean_text, parse_date, parse_day, parse_number, without_time


def typed_value(name: str, text: Column) -> Column:
    """Typed form of a stripped cell; an unreadable cell becomes NULL."""
    if is_date_name(name):
        return parse_date(text)
    if is_number_name(name):
        return parse_number(text)
    return text


def type_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Type every column but those in ``keep``.

    Cells are stripped in a projection of their own, so that each is stripped once however often
    the typing rules look at it. So are dates rid of their time of day.
    """
    stripped = df.select(
        *[F.col(c) if c in keep else clean_text(F.col(c).cast("string")).alias(c) for c in df.columns]
    )
    dates = {c for c in df.columns if c not in keep and is_date_name(c)}
    timeless = stripped.select(*[without_time(F.col(c)).alias(c) if c in dates else F.col(c) for c in df.columns])
    return timeless.select(
        *[F.col(c) if c in keep else (parse_day(F.col(c)) if c in dates else typed_value(c, F.col(c))).alias(c) for c in df.columns]
    )


def normalize_source(df: DataFrame, source_type: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw text table -> standard names in lower case -> typed columns."""
    return type_columns(lower_names(standardize_columns(df, source_type)), keep)
