"""User and merchant risk marts with reasons in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import numeric as N
from tessera.functions.constants import MIN_MERCHANT_TRANSACTIONS, NO_SIGNAL
from tessera.functions.ranks import exact_quantiles
from tessera.operators.guards import require_unique

_FILLED = ("disputed_amount", "chargeback_amount", "total_transaction_value", "average_transaction_value", "unique_merchants", "unique_users")


def key_universe(key: str, *tables: DataFrame) -> DataFrame:
    """Distinct non-null keys of all tables."""
    keys = tables[0].select(key)
    for t in tables[1:]:
        keys = keys.unionByName(t.select(key))
    return keys.where(F.col(key).isNotNull()).distinct()


def fill_counts(df: DataFrame) -> DataFrame:
    """Zero for missing counts and the named values; other columns keep their nulls."""
    return df.withColumns({c: N.zero(F.col(c)) for c in df.columns if c.endswith("_count") or c in _FILLED})


def _with_limits(df: DataFrame, **limits: tuple[str, float]) -> DataFrame:
    """Quantiles of the whole mart (0 over no values) beside every row."""
    one = exact_quantiles(df, limits)
    return df.crossJoin(F.broadcast(one.select(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in limits])))  # one row


def _explained(df: DataFrame, reasons: list[tuple[Column, str]]) -> DataFrame:
    texts = [F.when(N.flag(hit), F.lit(text)) for hit, text in reasons]
    joined = F.concat_ws("; ", *texts)
    count = sum((N.flag(hit).cast("long") for hit, _ in reasons), F.lit(0).cast("long"))
    out = df.withColumn("risk_signal_count", count).withColumn("risk_explanations", F.when(joined == "", F.lit(NO_SIGNAL)).otherwise(joined))
    return out.withColumn("investigation_priority", N.priority(F.col("risk_signal_count")))


# fixed values: the words of the reasons below are compared by readers of the marts
def _shared_reasons() -> list[tuple[Column, str]]:
    return [
        (F.col("high_chargeback_activity_flag"), "high chargeback activity"),
        (F.col("identity_mismatch_count") > 0, "chargeback identity mismatch"),
        (F.col("disconnected_relationship_count") > 0, "disconnected user-merchant relationship"),
    ]


def _dispute_figures(linkage: DataFrame, key: str, amount: str, more: dict[str, str]) -> DataFrame:
    return linkage.where(F.col(key).isNotNull()).groupBy(key).agg(
        N.count_all().alias("chargeback_count"),
        N.total(F.col("disputed_amount")).alias(amount),
        N.bool_sum(F.col("is_high_severity")).alias("high_severity_chargeback_count"),
        *[N.bool_sum(F.col(c)).alias(out) for out, c in more.items()],
        N.bool_sum(F.col("identity_mismatch")).alias("identity_mismatch_count"),
        N.bool_sum(F.col("network_disconnected")).alias("disconnected_relationship_count"),
    )


def user_mart(transactions: DataFrame, linkage: DataFrame, kyc: DataFrame, guard: bool = True) -> DataFrame:
    if guard:
        require_unique(kyc, ["user_id"], "the profile summary has several rows for a user")
    paid = transactions.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        N.count_all().alias("transaction_count"),
        N.total(F.col("amount")).alias("total_transaction_value"),
        N.average(F.col("amount")).alias("average_transaction_value"),
        F.count_distinct("merchant_id").alias("unique_merchants"),
        N.bool_sum(F.col("is_failed_transaction")).alias("failed_transaction_count"),
        N.bool_sum(F.col("is_pending_transaction")).alias("pending_transaction_count"),
        N.bool_sum(F.col("is_high_value_transaction")).alias("high_value_transaction_count"),
        N.bool_sum(F.col("is_user_amount_anomaly")).alias("amount_anomaly_count"),
    )
    disputed = _dispute_figures(linkage, "user_id", "disputed_amount", {"unauthorized_transaction_count": "is_unauthorized_transaction", "account_takeover_count": "is_account_takeover"})
    everyone = key_universe("user_id", transactions, linkage, kyc)
    mart = fill_counts(everyone.join(paid, "user_id", "left").join(disputed, "user_id", "left").join(kyc.where("user_id is not null"), "user_id", "left"))
    mart = _with_limits(mart, _txn=("transaction_count", 0.95), _cb=("chargeback_count", 0.95))
    mart = mart.withColumns(
        {
            "high_transaction_frequency_flag": (F.col("transaction_count") >= F.col("_txn")) & (F.col("transaction_count") > 0),
            "high_chargeback_activity_flag": (F.col("chargeback_count") >= F.col("_cb")) & (F.col("chargeback_count") > 0),
        }
    ).drop("_txn", "_cb")
    own = [(F.col("rejected_kyc_records") > 0, "rejected KYC record"), (F.col("high_risk_kyc_records") > 0, "high-risk KYC segment"), (F.col("unauthorized_transaction_count") > 0, "unauthorized-transaction chargeback")]
    return _explained(mart, [(F.col("high_transaction_frequency_flag"), "unusually high transaction frequency"), *_shared_reasons(), *own])


def merchant_mart(transactions: DataFrame, linkage: DataFrame, reference: DataFrame, least: int = MIN_MERCHANT_TRANSACTIONS, guard: bool = True) -> DataFrame:
    if guard:
        require_unique(reference, ["merchant_id"], "the reference summary has several rows for a merchant")
    paid = transactions.where(F.col("merchant_id").isNotNull()).groupBy("merchant_id").agg(
        N.count_all().alias("transaction_count"),
        N.total(F.col("amount")).alias("total_transaction_value"),
        N.average(F.col("amount")).alias("average_transaction_value"),
        F.count_distinct("user_id").alias("unique_users"),
        N.bool_sum(F.col("is_failed_transaction")).alias("failed_transaction_count"),
    )
    disputed = _dispute_figures(linkage, "merchant_id", "chargeback_amount", {})
    everyone = key_universe("merchant_id", transactions, linkage, reference)
    mart = fill_counts(everyone.join(paid, "merchant_id", "left").join(disputed, "merchant_id", "left").join(reference.where("merchant_id is not null"), "merchant_id", "left"))
    rate = F.try_divide(F.col("chargeback_count").cast("double"), F.col("transaction_count").cast("double"))
    mart = mart.withColumn("chargeback_records_per_transaction", rate).withColumn("chargeback_rate_eligible", F.col("transaction_count") >= least)
    mart = mart.withColumn("chargeback_rate_min_volume", F.when(F.col("chargeback_rate_eligible"), F.col("chargeback_records_per_transaction")))
    mart = mart.withColumn("ticket_size_variance_ratio", F.try_divide(F.col("average_transaction_value"), F.col("declared_avg_ticket_size")))
    mart = _with_limits(mart, _rate=("chargeback_rate_min_volume", 0.90), _cb=("chargeback_count", 0.95))
    mart = mart.withColumns(
        {
            "high_chargeback_rate_flag": N.flag(F.col("chargeback_rate_min_volume") >= F.col("_rate")) & F.col("chargeback_rate_eligible"),
            "high_chargeback_activity_flag": (F.col("chargeback_count") >= F.col("_cb")) & (F.col("chargeback_count") > 0),
        }
    ).drop("_rate", "_cb")
    own = [
        (F.col("high_chargeback_rate_flag"), f"high chargeback activity at at least {least} transactions"),
        (F.col("merchant_reference_inconsistency_flag"), "inconsistent merchant-master records"),
        (F.col("suspended_reference_records") > 0, "suspended merchant-master status"),
    ]
    return _explained(mart, [*_shared_reasons(), *own])


def risk_marts(integrated: dict[str, DataFrame], guard: bool = True) -> dict[str, DataFrame]:
    t, link = integrated["transactions"], integrated["linkage"]
    return {"users": user_mart(t, link, integrated["kyc_summary"], guard), "merchants": merchant_mart(t, link, integrated["merchant_summary"], guard=guard)}
