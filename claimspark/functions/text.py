"""Column expressions for cleaning identifiers, codes, dates, numbers and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimspark.functions.fixed import NULL_CODE_TOKENS, POLICY_LINKS

PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
WHITE_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0"


def strip(value: Column) -> Column:
    """Remove leading and trailing white space of any kind, not only blanks."""
    return F.btrim(value, F.lit(WHITE_SPACE))


def clean_text(value: Column) -> Column:
    """Stripped text; blank becomes NULL."""
    return F.nullif(strip(value), F.lit(""))


def nullable_text(df: DataFrame, name: str) -> Column:
    """``clean_text`` of a column, or a typed NULL when the table lacks it."""
    if name not in df.columns:
        return F.lit(None).cast("string")
    return clean_text(F.col(name).cast("string"))


def col_or_default(df: DataFrame, name: str, default: str = "") -> Column:
    """The column with NULL replaced by ``default``; ``default`` when the table lacks it."""
    if name not in df.columns:
        return F.lit(default)
    return F.coalesce(F.col(name).cast("string"), F.lit(default))


def first_non_blank(*values: Column) -> Column:
    """First value that is neither NULL nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


TIME_OF_DAY = r"[ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?$"
DAY_MONTH_NAME = r"^(\d{1,2})[- ]([A-Za-z]{3})[a-z]*\.?[-, ]+(\d{4})$"
MONTH_NAME_DAY = r"^([A-Za-z]{3})[a-z]*\.? (\d{1,2}),? +(\d{4})$"
SHORT_YEAR = r"^(\d{1,2}[- ][A-Za-z]{3}[- ])(\d{2})$"
FIRST_SHORT_YEAR = 69  # 69 to 99 belong to the last century


def _named_month_date(text: Column) -> Column:
    """Dates with a month name, day or month first, in full or by three letters; NULL for other texts."""
    year = F.regexp_extract(text, SHORT_YEAR, 2)
    century = F.when(year.try_cast("int") >= FIRST_SHORT_YEAR, "19").otherwise("20")
    return (
        F.when(text.rlike(DAY_MONTH_NAME), F.try_to_date(F.regexp_replace(text, DAY_MONTH_NAME, "$1-$2-$3"), "d-MMM-yyyy"))
        .when(text.rlike(MONTH_NAME_DAY), F.try_to_date(F.regexp_replace(text, MONTH_NAME_DAY, "$2-$1-$3"), "d-MMM-yyyy"))
        .when(
            text.rlike(SHORT_YEAR),
            F.try_to_date(F.concat(F.replace(F.regexp_extract(text, SHORT_YEAR, 1), F.lit(" "), F.lit("-")), century, year), "d-MMM-yyyy"),
        )
    )


def _year_first_date(text: Column) -> Column:
    return (
        F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), text.try_cast("date"))
        .when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))
        .when(text.rlike(r"^\d{4}[/.]\d{1,2}[/.]\d{1,2}$"), F.try_to_date(F.regexp_replace(text, "[/.]", "-"), "yyyy-M-d"))
    )


def without_time(text: Column) -> Column:
    """Stripped text of a date without the time of day behind it."""
    return F.when(text.rlike(TIME_OF_DAY), F.regexp_replace(text, TIME_OF_DAY, "")).otherwise(text)


def parse_date(text: Column) -> Column:
    """Year first (with dashes, slashes, dots or nothing between), day first (same signs), or with a month name.

    A time of day behind the date is dropped; anything else is NULL. ``text`` is stripped already. The shape is
    checked first, because a failed parse costs far more than a match.
    """
    return parse_day(without_time(text))


def parse_day(day: Column) -> Column:
    """``parse_date`` of a text that is ``without_time``. It mentions the text many times, so where many rows are read that is a column."""
    numbers = F.when(day.rlike(r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{4}$"), F.try_to_date(F.regexp_replace(day, "[/.]", "-"), "d-M-yyyy"))
    return F.coalesce(_year_first_date(day), numbers, _named_month_date(day))


def parse_policy_date(text: Column) -> Column:
    """Dates of policy tables: as ``parse_date``, but numbers with the year last are month-first."""
    day = without_time(text)
    slashed = F.regexp_extract(day, r"^(\d{1,2}[-/.]\d{1,2}[-/.]\d{4})", 1)
    numbers = F.when(slashed != "", F.try_to_date(F.regexp_replace(slashed, "[-.]", "/"), "M/d/yyyy"))
    return F.coalesce(_year_first_date(day), numbers, _named_month_date(day))


def parse_number(text: Column) -> Column:
    """Double after dropping thousands commas; only plain decimal notation within the range of a double is accepted."""
    digits = F.replace(text, F.lit(","), F.lit(""))
    number = F.when(digits.rlike(PLAIN_NUMBER), digits.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def normalize_icd10_code(value: Column) -> Column:
    """Upper case without outer white space; punctuation stays."""
    return F.upper(strip(value))


def normalize_procedure_code(value: Column) -> Column:
    """Upper-case procedure code without blanks; a numeric code loses a trailing ``.0``."""
    text = strip(value)
    # Few mentions of the text, because each is evaluated. What follows the end of the line is one of the ends that are no white space here.
    code = F.regexp_replace(F.replace(text, F.lit(" "), F.lit("")), r"^([0-9]+\.?[0-9]*|\.[0-9]+)\.0$(?s:.*)", "$1")
    return F.when(~F.lower(text).isin("", *NULL_CODE_TOKENS), F.upper(code))


def policy_url(policy_type: Column, policy_id: Column, version: Column) -> Column:
    """Public page of a policy document; the version parameter is left out when blank."""
    versioned = (version.isNotNull()) & (version != "")
    link = F.lit(None).cast("string")
    for kind, (address, id_key, version_key) in POLICY_LINKS.items():
        url = F.concat(F.lit(f"{address}?{id_key}="), F.url_encode(policy_id))
        suffix = F.when(versioned, F.concat(F.lit(f"&{version_key}="), F.url_encode(version))).otherwise("")
        link = F.when(policy_type == kind, F.concat(url, suffix)).otherwise(link)
    return link


def money(value: Column) -> Column:
    """Fixed-point form used inside sums, so that totals do not depend on row order.

    28 digits before and 10 behind the point; amounts beyond that, NaN and infinity are NULL.
    """
    return value.try_cast("decimal(38,10)")


def sum_money(value: Column) -> Column:
    return F.sum(money(value)).cast("double")


def avg_money(value: Column) -> Column:
    return F.try_divide(F.sum(money(value)).cast("double"), F.count(money(value)).cast("double"))
