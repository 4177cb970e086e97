"""Features of each cleaned table for itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import dates as D, numeric as N, ranks as R
from tessera.operators.guards import null_safe_join


def with_threshold(df: DataFrame, value: str, q: float, out: str) -> DataFrame:
    """``out``: value at or over the exact quantile of its column; null stays null."""
    limit = R.exact_quantiles(df, {"_limit": (value, q)}).select(F.coalesce("_limit", F.lit(0.0)).alias("_limit"))
    return df.crossJoin(F.broadcast(limit)).withColumn(out, F.col(value) >= F.col("_limit")).drop("_limit")  # one row


def with_group_figures(df: DataFrame, key: str, **figures: Column) -> DataFrame:
    """Aggregates of the rows of a key beside each of them; null is a key. Aggregated and joined, so that a hot key is no single task."""
    by_key = df.groupBy(key).agg(*[v.alias(k) for k, v in figures.items()])
    return null_safe_join(df, by_key, [key])


def _is(column: str, *values: str) -> Column:
    return N.flag(F.col(column).isin(*values))


def transaction_features(df: DataFrame) -> DataFrame:
    ts = F.col("timestamp")
    dated = df.withColumns({"transaction_date": F.to_date(ts), "transaction_hour": F.hour(ts).cast("long"), "transaction_day_of_week": D.day_name(ts)})
    stated = dated.withColumns({f"is_{s.lower()}_transaction": _is("status", s) for s in ("COMPLETED", "FAILED", "PENDING")})
    valued = with_threshold(stated, "amount", 0.95, "is_high_value_transaction")
    counted = with_group_figures(valued, "user_id", user_transaction_count=N.count_all(), _mean=F.avg("amount"), _spread=F.stddev_samp("amount"))
    counted = with_group_figures(counted, "merchant_id", merchant_transaction_count=N.count_all())
    scored = counted.withColumn("user_amount_zscore", R.zscore(F.col("amount"), F.col("_mean"), F.col("_spread"))).drop("_mean", "_spread")
    return scored.withColumn("is_user_amount_anomaly", N.flag(F.abs("user_amount_zscore") >= 2.5))


def chargeback_features(df: DataFrame) -> DataFrame:
    reported, done = F.col("reported_timestamp"), F.col("bank_response_timestamp")
    timed = df.withColumns({"reporting_delay_hours": D.hours_between(reported, F.col("transaction_timestamp")), "bank_response_delay_hours": D.hours_between(done, reported)})
    flagged = timed.withColumns(
        {
            "bank_response_before_report_flag": N.flag(F.col("bank_response_delay_hours") < 0),
            "is_critical_dispute": _is("severity", "CRITICAL"),
            "is_high_severity": _is("severity", "CRITICAL", "HIGH"),
            "is_open_case": _is("resolution_status", "OPEN", "IN_PROGRESS", "PENDING_BANK"),
            "is_account_takeover": _is("reason_code", "ACCOUNT_TAKEOVER"),
            "is_unauthorized_transaction": _is("reason_code", "UNAUTHORIZED_TRANSACTION"),
        }
    )
    return with_threshold(flagged, "disputed_amount", 0.75, "is_high_value_dispute").withColumn("chargeback_date", F.to_date(reported))


def kyc_features(df: DataFrame, reference: str = D.AGE_REFERENCE) -> DataFrame:
    aged = df.withColumn("age_years", D.age_years(F.col("date_of_birth"), reference))
    flagged = aged.withColumns(
        {
            "age_invalid_flag": N.flag(F.col("age_years") < 18) | N.flag(F.col("age_years") > 120),
            "is_kyc_rejected": _is("kyc_status", "REJECTED"),
            "is_kyc_pending": _is("kyc_status", "PENDING"),
            "is_high_kyc_risk": _is("risk_segment", "HIGH"),
        }
    )
    return with_threshold(flagged, "monthly_income", 0.95, "is_high_income_profile")


def merchant_features(df: DataFrame, reference: str = D.AGE_REFERENCE) -> DataFrame:
    aged = df.withColumn("merchant_age_days", D.age_days(F.col("onboarding_date"), reference))
    flagged = aged.withColumns(
        {
            "future_onboarding_flag": N.flag(F.col("merchant_age_days") < 0),
            "is_active_merchant": _is("merchant_status", "ACTIVE"),
            "is_suspended_merchant": _is("merchant_status", "SUSPENDED"),
        }
    )
    rated = with_threshold(flagged, "declared_avg_ticket_size", 0.95, "is_high_declared_ticket")
    return rated.withColumn("active_missing_mcc", F.col("is_active_merchant") & F.col("mcc").isNull())


def engineer(cleaned: dict[str, DataFrame]) -> dict[str, DataFrame]:
    makers = {"transactions": transaction_features, "chargebacks": chargeback_features, "kyc": kyc_features, "merchants": merchant_features}
    return {name: make(cleaned[name]) for name, make in makers.items()}
