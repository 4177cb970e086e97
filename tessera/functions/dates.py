"""Timestamp rules: ordered formats, Unix seconds, ambiguity as null. Results are timestamp_ntz; the session runs in UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: accepted formats, in the order they are tried
CHARGEBACK_FORMATS = [d + t for d in ("yyyy/M/d", "d/M/yyyy", "yyyy-M-d", "M-d-yyyy", "d-MMM-yyyy") for t in ("", " H:m:s", " h:m a")]
TRANSACTION_FORMATS = [
    "yyyy-M-d H:m:s",
    "yyyy-M-d",
    "yyyy/M/d",
    "yyyy/M/d H:m:s",
    "d/M/yyyy H:m:s",
    "d/M/yyyy",
    "M-d-yyyy h:m:s a",
    "M-d-yyyy h:m a",
    "M-d-yyyy",
    "d-M-yyyy h:m:s a",
]
DAY_FIRST_FORMATS = ["d/M/yyyy H:m:s", "d/M/yyyy h:m a", "d/M/yyyy"]
MONTH_FIRST_FORMATS = ["M-d-yyyy H:m:s", "M-d-yyyy h:m:s a", "M-d-yyyy h:m a", "M-d-yyyy"]
CLEAR_FORMATS = ["yyyy-M-d H:m:s", "yyyy-M-d", "yyyy/M/d H:m:s", "yyyy/M/d", "d-MMM-yyyy", "d-MMM-yyyy H:m:s", "d-MMM-yyyy h:m a"]
AGE_REFERENCE = "2026-09-15"


def unix_seconds(text: Column) -> Column:
    return F.when(text.rlike(r"\A[0-9]{10}\z"), F.timestamp_seconds(text.try_cast("bigint")).cast("timestamp_ntz"))


def first_format(text: Column, formats: list[str]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats])


def parse_with_formats(col: Column, formats: list[str], unix: bool = True) -> Column:
    """Null or blank is null; ten digits are Unix seconds; else the first format that fits."""
    text = F.trim(col)
    parsed = first_format(text, formats)
    return F.coalesce(unix_seconds(text), parsed) if unix else parsed


def chargeback_timestamp(col: Column) -> Column:
    return parse_with_formats(col, CHARGEBACK_FORMATS)


def transaction_timestamp(col: Column) -> Column:
    return parse_with_formats(col, TRANSACTION_FORMATS)


def unambiguous_date(col: Column) -> Column:
    """a/b/yyyy and a-b-yyyy only where one of a, b is over 12: slashes are day first, hyphens month first."""
    text = F.trim(col)
    numeric = r"\A([0-9]{1,2})[/-]([0-9]{1,2})[/-][0-9]{4}(?: .*)?\z"
    a = F.regexp_extract(text, numeric, 1).try_cast("int")
    b = F.regexp_extract(text, numeric, 2).try_cast("int")
    return (
        F.when(text.rlike(r"\A[0-9]{10}\z"), unix_seconds(text))
        .when(text.rlike(numeric) & (a <= 12) & (b <= 12), F.lit(None).cast("timestamp_ntz"))
        .when(text.rlike(numeric) & (a > 12), first_format(text, DAY_FIRST_FORMATS))
        .when(text.rlike(numeric), first_format(text, MONTH_FIRST_FORMATS))
        .otherwise(first_format(text, CLEAR_FORMATS))
    )


def seconds_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / 1e6


def hours_between(later: Column, earlier: Column) -> Column:
    return seconds_between(later, earlier) / 3600


def whole_days(later: Column, earlier: Column) -> Column:
    return F.floor(seconds_between(later, earlier) / 86400)


def age_years(born: Column, reference: str = AGE_REFERENCE) -> Column:
    return F.floor(whole_days(F.lit(reference).cast("timestamp_ntz"), born) / 365.2425)


def age_days(since: Column, reference: str = AGE_REFERENCE) -> Column:
    return whole_days(F.lit(reference).cast("timestamp_ntz"), since)


def day_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def day_of(ts: Column) -> Column:
    return F.date_trunc("DAY", ts).cast("timestamp_ntz")


def is_night(ts: Column) -> Column:
    return F.coalesce(F.hour(ts).between(0, 5), F.lit(False))


def is_weekend(ts: Column) -> Column:
    return F.coalesce(F.weekday(ts) >= 5, F.lit(False))


def whole_months(days: Column) -> Column:
    return F.bround(days / 30.4375).cast("long")
