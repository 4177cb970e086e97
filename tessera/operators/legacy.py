"""Older variants of the cleaning rules, kept apart from the cleaners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import dates as D, numeric as N
from tessera.operators.features import chargeback_features


def short_id(col: Column, prefix: str, digits: int) -> Column:
    """The last ``digits`` digits, zero-padded, behind the prefix; null without a digit."""
    only = F.regexp_replace(col, "[^0-9]", "")
    return F.when(only != "", F.concat(F.lit(prefix), F.lpad(F.right(only, F.lit(digits)), digits, "0")))


def exact_label(col: Column, labels: dict[str, str]) -> Column:
    """Case-sensitive label map; an unknown label is null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), F.trim(col))


def loose_unix(col: Column) -> Column:
    """Nine or more digits as Unix seconds."""
    text = F.trim(col)
    return F.when(text.rlike(r"\A[0-9]{9,}\z"), F.timestamp_seconds(text.try_cast("bigint")).cast("timestamp_ntz"))


def signed_money(col: Column) -> Column:
    """Money that keeps its sign."""
    bare = F.regexp_replace(F.regexp_replace(col, r"(?i)INR|₹|\bRs\.?", ""), r"[,\s]", "")
    return F.when(bare.rlike(r"\A-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)\z"), bare.try_cast("double"))


def loose_date(col: Column) -> Column:
    """Date text yyyy-MM-dd; either separator where only one reading is possible, day first otherwise."""
    text = F.trim(F.replace(col, F.lit("-"), F.lit("/")))
    return F.date_format(D.first_format(text, ["yyyy/M/d", "d/M/yyyy", "M/d/yyyy", "d/MMM/yyyy"]), "yyyy-MM-dd")


def trailing_mcc(col: Column) -> Column:
    """Digits of an MCC without one trailing ``.0``."""
    digits = F.regexp_replace(F.regexp_replace(col, r"\.0\z", ""), "[^0-9]", "")
    return F.when(digits != "", digits)


# fixed values: labels of the older chargeback tables, as they are written
REASON_LABELS = {
    "charged twice": "DUPLICATE_DEBIT",
    "DUP_DEBIT": "DUPLICATE_DEBIT",
    "Duplicate Debit": "DUPLICATE_DEBIT",
    "double debit": "DUPLICATE_DEBIT",
    "dup debit": "DUPLICATE_DEBIT",
    "amount mismatch": "AMOUNT_MISMATCH",
    "Wrong Amount": "AMOUNT_MISMATCH",
    "extra amount deducted": "AMOUNT_MISMATCH",
    "incorrect amount": "AMOUNT_MISMATCH",
    "ATO": "ACCOUNT_TAKEOVER",
    "Account Takeover": "ACCOUNT_TAKEOVER",
    "account hacked": "ACCOUNT_TAKEOVER",
    "login compromised": "ACCOUNT_TAKEOVER",
    "Merchant Not Delivered": "SERVICE_NOT_PROVIDED",
    "Service Not Provided": "SERVICE_NOT_PROVIDED",
    "delivery issue": "SERVICE_NOT_PROVIDED",
    "item not received": "SERVICE_NOT_PROVIDED",
    "merchant service issue": "SERVICE_NOT_PROVIDED",
    "no service": "SERVICE_NOT_PROVIDED",
    "not delivered": "SERVICE_NOT_PROVIDED",
    "service failed": "SERVICE_NOT_PROVIDED",
    "Customer Dispute": "CUSTOMER_DISPUTE",
    "customer issue": "CUSTOMER_DISPUTE",
    "dispute raised": "CUSTOMER_DISPUTE",
    "complaint": "CUSTOMER_DISPUTE",
    "FRAUD": "UNAUTHORIZED_TRANSACTION",
    "Fraud Suspected": "UNAUTHORIZED_TRANSACTION",
    "fraud": "UNAUTHORIZED_TRANSACTION",
    "not done by me": "UNAUTHORIZED_TRANSACTION",
    "scam": "UNAUTHORIZED_TRANSACTION",
    "suspicious transaction": "UNAUTHORIZED_TRANSACTION",
    "unauth txn": "UNAUTHORIZED_TRANSACTION",
    "UNAUTHORISED": "UNAUTHORIZED_TRANSACTION",
    "Unauthorized Transaction": "UNAUTHORIZED_TRANSACTION",
    "unauthorized_transaction": "UNAUTHORIZED_TRANSACTION",
}
RESOLUTION_LABELS = {
    "CLOSED": "CLOSED",
    "Closed": "CLOSED",
    "IN_PROGRESS": "IN_PROGRESS",
    "In Progress": "IN_PROGRESS",
    "WIP": "IN_PROGRESS",
    "OPEN": "OPEN",
    "Open": "OPEN",
    "PENDING_BANK": "PENDING_BANK",
    "Pending Bank": "PENDING_BANK",
    "REJECTED": "REJECTED",
    "Rejected": "REJECTED",
    "RESOLVED": "RESOLVED",
    "Resolved": "RESOLVED",
}
SEVERITY_LABELS = {
    "CRIT": "CRITICAL",
    "Critical": "CRITICAL",
    "CRITICAL": "CRITICAL",
    "P1": "CRITICAL",
    "H": "HIGH",
    "High": "HIGH",
    "HIGH": "HIGH",
    "P2": "HIGH",
    "M": "MEDIUM",
    "Medium": "MEDIUM",
    "MEDIUM": "MEDIUM",
    "P3": "MEDIUM",
    "L": "LOW",
    "Low": "LOW",
    "LOW": "LOW",
    "P4": "LOW",
}
CHANNEL_LABELS = {
    "App": "APP",
    "Branch": "BRANCH",
    "CHATBOT": "CHATBOT",
    "chatbot": "CHATBOT",
    "Call Center": "CALL_CENTER",
    "Email": "EMAIL",
    "IVR": "IVR",
    "ivr": "IVR",
}
LABELS = {"reason_code": REASON_LABELS, "resolution_status": RESOLUTION_LABELS, "severity": SEVERITY_LABELS, "channel": CHANNEL_LABELS}


def labelled(chargebacks: DataFrame) -> DataFrame:
    """Category columns by the older label tables; a label that isn't written there is null."""
    return chargebacks.withColumns({c: exact_label(F.col(c), m) for c, m in LABELS.items() if c in chargebacks.columns})


def chargeback_features_false(chargebacks: DataFrame) -> DataFrame:
    """The chargeback features with false wherever a compared value is null."""
    out = chargeback_features(chargebacks)
    return out.withColumn("is_high_value_dispute", N.flag(F.col("is_high_value_dispute")))


def report(audit: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """An audit in the older shape: Issue, Column, Rule_Applied, Rows_Affected, Before_Count, After_Count."""
    sizes = before.agg(N.count_all().alias("Before_Count")).crossJoin(after.agg(N.count_all().alias("After_Count")))  # single rows
    rows = audit.select(F.col("issue").alias("Issue"), F.col("column").alias("Column"), F.col("rule").alias("Rule_Applied"), F.col("numerator").alias("Rows_Affected"))
    return rows.crossJoin(F.broadcast(sizes))
