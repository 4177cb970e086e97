"""Exploratory features: velocity, ranks, bands, outliers, group statistics, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions import dates as D, numeric as N, ranks as R

# fixed values: status words of the exploratory grouping
SUCCESS, FAILED, PENDING = ("SUCCESS", "TXN_SUCCESS", "S", "COMPLETED"), ("FAILED", "TXN_FAILED", "FAIL", "F", "DECLINED"), ("PENDING", "PROCESSING", "INITIATED")
SIGNALS = ("negative_amount_flag", "amount_iqr_outlier_flag", "missing_utr_flag", "missing_mcc_flag", "failed_flag", "rapid_user_txn_flag", "is_night")
MERCHANT_REFERENCE = "2026-09-14"


def transaction_eda(df: DataFrame) -> DataFrame:
    """Row features of transactions; null amounts and times give false flags."""
    ts, amount = F.col("timestamp"), F.col("amount")
    dated = df.withColumns(
        {
            "txn_date": F.to_date(ts),
            "txn_year": F.year(ts),
            "txn_month": F.month(ts),
            "txn_day_of_week": F.weekday(ts),
            "txn_day_name": D.day_name(ts),
            "txn_hour": F.hour(ts),
            "is_weekend": D.is_weekend(ts),
            "is_night": D.is_night(ts),
            "negative_amount_flag": N.flag(amount < 0),
            "zero_amount_flag": N.flag(amount == 0),
            "missing_utr_flag": F.col("utr").isNull(),
            "missing_mcc_flag": F.col("mcc").isNull(),
            "amount_abs": F.abs(amount),
        }
    )
    bounds = R.iqr_bounds(df, "amount").select("lower", "upper")
    out = dated.crossJoin(F.broadcast(bounds)).withColumn("amount_iqr_outlier_flag", N.flag((amount < F.col("lower")) | (amount > F.col("upper")))).drop("lower", "upper")
    group = F.when(F.col("status").isin(*SUCCESS), "SUCCESS").when(F.col("status").isin(*FAILED), "FAILED").when(F.col("status").isin(*PENDING), "PENDING").otherwise("OTHER")
    out = out.withColumn("status_group", group).withColumns({f"{g.lower()}_flag": F.col("status_group") == g for g in ("SUCCESS", "FAILED", "PENDING")})
    return signal_counts(velocity(out))


def velocity(df: DataFrame, minutes: float = 5, order: str | None = None) -> DataFrame:
    """Previous transaction of the user and the minutes since; a null user has none. Equal times go by ``order`` (a source order column), then txn_id."""
    w = Window.partitionBy("user_id").orderBy(F.col("timestamp").asc_nulls_last(), *([order] if order else []), "txn_id")
    known = df.where(F.col("user_id").isNotNull()).withColumn("user_prev_txn_timestamp", F.lag("timestamp").over(w))
    before = known.unionByName(df.where(F.col("user_id").isNull()).withColumn("user_prev_txn_timestamp", F.lit(None).cast("timestamp_ntz")))
    since = D.seconds_between(F.col("timestamp"), F.col("user_prev_txn_timestamp")) / 60
    return before.withColumn("minutes_since_prev_user_txn", since).withColumn("rapid_user_txn_flag", N.flag(F.col("minutes_since_prev_user_txn") <= minutes))


def signal_counts(df: DataFrame) -> DataFrame:
    n = sum((F.col(c).cast("int") for c in SIGNALS), F.lit(0))
    return df.withColumn("transaction_signal_count", n).withColumn("multiple_signal_flag", F.col("transaction_signal_count") >= 2)


def amount_percentile(df: DataFrame) -> DataFrame:
    return R.with_percent_rank(df, "amount", "amount_percentile")


def _stats(prefix: str, other: str) -> list[Column]:
    return [
        F.count("txn_id").alias(f"{prefix}_transaction_count"),
        N.total(F.col("amount")).alias(f"{prefix}_total_amount"),
        N.average(F.col("amount")).alias(f"{prefix}_avg_amount"),
        F.max("amount").alias(f"{prefix}_max_amount"),
        F.min("amount").alias(f"{prefix}_min_amount"),
        F.count_distinct(f"{other}_id").alias(f"{prefix}_unique_{other}s"),
        N.bool_sum(F.col("negative_amount_flag")).alias(f"{prefix}_negative_txn_count"),
        N.bool_sum(F.col("missing_utr_flag")).alias(f"{prefix}_missing_utr_count"),
        N.bool_sum(F.col("missing_mcc_flag")).alias(f"{prefix}_missing_mcc_count"),
    ]


def group_stats(df: DataFrame, kind: str) -> DataFrame:
    """Statistics by user or merchant; null keys are in no group."""
    other = "merchant" if kind == "user" else "user"
    out = df.where(F.col(f"{kind}_id").isNotNull()).groupBy(f"{kind}_id").agg(*_stats(kind, other))
    return out.withColumn(f"{kind}_negative_txn_ratio", F.try_divide(F.col(f"{kind}_negative_txn_count").cast("double"), F.col(f"{kind}_transaction_count").cast("double")))


def pair_stats(df: DataFrame) -> DataFrame:
    known = df.where("user_id is not null and merchant_id is not null")
    return known.groupBy("user_id", "merchant_id").agg(
        F.count("txn_id").alias("user_merchant_txn_count"), N.total(F.col("amount")).alias("user_merchant_total_amount"), N.average(F.col("amount")).alias("user_merchant_avg_amount")
    )


def with_group_stats(df: DataFrame) -> DataFrame:
    """User, merchant and pair statistics beside every row; rows of null keys get nulls."""
    out = df
    for kind in ("user", "merchant"):
        out = out.join(group_stats(df, kind), f"{kind}_id", "left")
    return out.join(pair_stats(df), ["user_id", "merchant_id"], "left")


def top_entities(df: DataFrame, kind: str, n: int = 20) -> DataFrame:
    other = "merchant" if kind == "user" else "user"
    rapid = [N.bool_sum(F.col("rapid_user_txn_flag")).alias("rapid_transactions")] if kind == "user" else []
    out = df.where(F.col(f"{kind}_id").isNotNull()).groupBy(f"{kind}_id").agg(
        F.count("txn_id").alias("transactions"),
        N.total(F.col("amount")).alias("total_amount"),
        N.average(F.col("amount")).alias("avg_amount"),
        F.count_distinct(f"{other}_id").alias(f"unique_{other}s"),
        N.bool_sum(F.col("negative_amount_flag")).alias("negative_transactions"),
        *rapid,
        N.bool_sum(F.col("multiple_signal_flag")).alias("multiple_signal_transactions"),
    )
    return out.orderBy(F.col("transactions").desc(), f"{kind}_id").limit(n)


def frequency(df: DataFrame, column: str, keep_null: bool = True) -> DataFrame:
    held = df if keep_null else df.where(F.col(column).isNotNull())
    return held.groupBy(column).agg(N.count_all().alias("count")).orderBy(F.col("count").desc(), F.col(column).asc_nulls_last())


def crosstab(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    out = df.where(F.col(rows).isNotNull()).groupBy(rows).pivot(columns, values).agg(N.count_all())
    return out.na.fill(0)


def describe(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, std, min, exact quartiles, max."""
    c = F.col(column)
    figures = df.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    quartiles = R.exact_quantiles(df, {f"p{100 * k // 4}": (column, k / 4) for k in (1, 2, 3)})
    return figures.crossJoin(F.broadcast(quartiles)).select("count", "mean", "std", "min", "p25", "p50", "p75", "max")  # single rows


def _blank(column: str) -> Column:
    return F.col(column).isNull() | (F.trim(column) == "")


def merchant_eda(df: DataFrame, reference: str = MERCHANT_REFERENCE) -> DataFrame:
    """Merchant features: missing marks, ticket band, age, onboarding parts, status, high tickets."""
    since, ticket = F.col("onboarding_date"), F.col("declared_avg_ticket_size")
    marked = df.withColumns(
        {
            "missing_mcc": _blank("mcc"),
            "missing_category": _blank("merchant_category"),
            "missing_business_type": _blank("business_type"),
            "missing_settlement_account": _blank("settlement_account"),
            "merchant_age_days": D.age_days(since, reference),
            "onboarding_year": F.year(since).cast("long"),
            "onboarding_month": F.month(since).cast("long"),
            "onboarding_quarter": F.quarter(since).cast("long"),
        }
    ).withColumn("merchant_age_months", D.whole_months(F.col("merchant_age_days")))
    status = F.upper("merchant_status")
    marked = marked.withColumns(
        {"is_active": N.flag(status.isin("ACTIVE", "A")), "is_inactive": N.flag(status.isin("INACTIVE", "I")), "is_suspended": N.flag(status.isin("SUSPENDED", "S"))}
    )
    limits = R.exact_quantiles(df, {"_high": ("declared_avg_ticket_size", 0.75)}).crossJoin(df.agg(F.count("declared_avg_ticket_size").alias("_n")))  # single rows
    ranked = R.with_global_rank(marked, "declared_avg_ticket_size", ["merchant_id", "merchant_category"]).crossJoin(F.broadcast(limits))
    high = N.flag(ticket >= F.col("_high"))
    return ranked.withColumns(
        {
            "ticket_size_band": R.quartile_band(F.col("_rank"), F.col("_n")),
            "active_missing_mcc": F.col("is_active") & F.col("missing_mcc"),
            "active_missing_category": F.col("is_active") & F.col("missing_category"),
            "inactive_high_ticket_size": F.col("is_inactive") & high,
            "suspended_high_ticket_size": F.col("is_suspended") & high,
        }
    ).drop("_rank", "_n", "_high")


def category_tickets(df: DataFrame) -> DataFrame:
    out = df.where("merchant_category is not null").groupBy("merchant_category").agg(
        F.count("declared_avg_ticket_size").alias("count"), N.average(F.col("declared_avg_ticket_size")).alias("mean"), F.median("declared_avg_ticket_size").alias("median")
    )
    return out.orderBy(F.col("median").desc_nulls_last(), "merchant_category")


def extreme_tickets(df: DataFrame, n: int = 10, largest: bool = True) -> DataFrame:
    ticket = F.col("declared_avg_ticket_size")
    held = df.where(ticket.isNotNull()).select("merchant_id", "merchant_name", "merchant_category", "declared_avg_ticket_size")
    return held.orderBy(ticket.desc() if largest else ticket.asc(), "merchant_id", "merchant_category").limit(n)
