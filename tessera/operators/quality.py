"""Validation of cleaned tables, and the gate in front of the features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import numeric as N
from tessera.functions.constants import REQUIRED

_KEYS = {
    "transactions": ("unique nonmissing txn_id", "txn_id", "FAIL", "Complaints are joined to payments on this key."),
    "chargebacks": ("unique complaint_id", "complaint_id", "FAIL", "A complaint has one row."),
    "kyc": ("repeated user_id", "user_id", "WARN", "Several profiles of a user stay; the summary takes one row of them."),
    "merchants": ("repeated merchant_id", "merchant_id", "WARN", "Several entries of a merchant stay; the summary takes one row of them."),
}
_MONEY = {"transactions": "amount", "chargebacks": "disputed_amount", "kyc": "monthly_income", "merchants": "declared_avg_ticket_size"}


def null_counts(df: DataFrame) -> DataFrame:
    """(column, missing, rows), one pass."""
    one = df.agg(N.count_all().alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing"), F.col("_n").alias("rows")) for c in df.columns])))


def duplicate_rows(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row: rows beyond the first of each group of equal (keys of) rows, and rows in all."""
    groups = df.groupBy(*(keys or df.columns)).agg(N.count_all().alias("c"))
    return groups.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("repeats"), F.coalesce(F.sum("c"), F.lit(0)).alias("rows"))


def _line(dataset: str, check: str, n: Column, d: Column, status: Column, details: Column) -> list[Column]:
    return [F.lit(dataset).alias("dataset"), F.lit(check).alias("check"), n.cast("long").alias("numerator"), d.cast("long").alias("denominator"), status.alias("status"), details.alias("details")]


def validate(tables: dict[str, DataFrame]) -> DataFrame:
    """Checks of all cleaned tables: dataset, check, numerator, denominator, percentage, status, details."""
    parts: list[DataFrame] = []
    for dataset, df in tables.items():
        absent = sorted(set(REQUIRED[dataset]) - set(df.columns))
        text = "Absent: " + ", ".join(absent) if absent else "None is absent."
        one = df.sparkSession.range(1)
        parts.append(one.select(*_line(dataset, "required schema columns", F.lit(len(absent)), F.lit(len(REQUIRED[dataset])), F.lit("FAIL" if absent else "PASS"), F.lit(text))))
        again = duplicate_rows(df)
        warn = lambda n, bad: F.when(n > 0, bad).otherwise("PASS")
        parts.append(again.select(*_line(dataset, "remaining exact duplicate rows", F.col("repeats"), F.col("rows"), warn(F.col("repeats"), "WARN"), F.lit("Rows that cleaning made alike, kept on purpose."))))
        money = _MONEY[dataset]
        flat = df.agg(N.count_all().alias("_n"), F.count_if(F.col(money) < 0).alias("_neg"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
        rows = [F.struct(*_line(dataset, f"missing values: {c}", F.col(c), F.col("_n"), warn(F.col(c), "WARN"), F.lit("Counted, not filled."))) for c in df.columns]
        rows.append(F.struct(*_line(dataset, f"negative {money} after cleaning", F.col("_neg"), F.col("_n"), warn(F.col("_neg"), "FAIL"), F.lit("Amounts below zero are null after cleaning."))))
        parts.append(flat.select(F.inline(F.array(*rows))))
        check, key, bad, why = _KEYS[dataset]
        twice = duplicate_rows(df.where(F.col(key).isNotNull()), [key])
        parts.append(twice.select(*_line(dataset, check, F.col("repeats"), F.col("rows"), warn(F.col("repeats"), bad), F.lit(why))))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.withColumn("percentage", N.percentage(F.col("numerator"), F.col("denominator")))


class ValidationFailed(ValueError):
    pass


def gate(checks: DataFrame) -> DataFrame:
    """Raise on any FAIL."""
    failed = [f"{r['dataset']}: {r['check']}" for r in checks.where("status = 'FAIL'").collect()]
    if failed:
        raise ValidationFailed("; ".join(sorted(failed)))
    return checks


def quality_profile(df: DataFrame) -> DataFrame:
    """(column, missing_count, missing_pct, unique_values)."""
    one = df.agg(N.count_all().alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"_m_{c}") for c in df.columns], *[F.count_distinct(F.col(c)).alias(f"_u_{c}") for c in df.columns])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"_m_{c}").alias("missing_count"), N.percentage(F.col(f"_m_{c}"), F.col("_n")).alias("missing_pct"), F.col(f"_u_{c}").alias("unique_values")) for c in df.columns]
    return one.select(F.inline(F.array(*rows)))
