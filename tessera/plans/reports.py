"""Read queries of the report pages, over the marts. Limits are features of these reports (top-k tables)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import dates as D, numeric as N


def ranked(df: DataFrame, label: str, value: str, n: int = 12) -> DataFrame:
    """Rows with both present, largest first; ties by label."""
    return df.where(F.col(label).isNotNull() & F.col(value).isNotNull()).orderBy(F.col(value).desc(), label).limit(n)


def timeline(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def between(df: DataFrame, ts: str, first: str, last: str) -> DataFrame:
    """Days from first to last, both included."""
    return df.where(F.to_date(ts).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def options(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def counts(df: DataFrame, column: str, out: str = "records") -> DataFrame:
    return df.groupBy(column).agg(N.count_all().alias(out)).orderBy(F.col(out).desc(), F.col(column).asc_nulls_last())


def overview(transactions: DataFrame, linkage: DataFrame, users: DataFrame, merchants: DataFrame) -> DataFrame:
    """One row of headline figures."""
    parts = [
        transactions.agg(N.count_all().alias("transactions"), N.total(F.col("amount")).alias("transaction_value"), N.bool_sum(F.col("is_failed_transaction")).alias("failed_transactions")),
        linkage.agg(N.count_all().alias("chargebacks"), N.total(F.col("disputed_amount")).alias("disputed_value"), N.bool_sum(F.col("identity_mismatch")).alias("identity_mismatches")),
        users.agg(N.count_all().alias("users"), F.count_if(F.col("investigation_priority") != "LOW").alias("users_for_review")),
        merchants.agg(N.count_all().alias("merchants"), F.count_if(F.col("investigation_priority") != "LOW").alias("merchants_for_review")),
    ]
    one = parts[0]
    for p in parts[1:]:
        one = one.crossJoin(F.broadcast(p))  # single rows
    return one


def daily_transactions(transactions: DataFrame) -> DataFrame:
    held = timeline(transactions, "timestamp").withColumn("day", D.day_of(F.col("timestamp")))
    return held.groupBy("day").agg(N.count_all().alias("transactions"), N.total(F.col("amount")).alias("value")).orderBy("day")


def daily_chargebacks(linkage: DataFrame) -> DataFrame:
    held = timeline(linkage, "reported_timestamp").withColumn("day", D.day_of(F.col("reported_timestamp")))
    return held.groupBy("day").agg(N.count_all().alias("chargebacks")).orderBy("day")


def disputed_merchants(merchants: DataFrame, n: int = 10) -> DataFrame:
    held = merchants.where("investigation_priority <> 'LOW'").select("merchant_id", "merchant_name", "chargeback_count", "investigation_priority")
    return held.orderBy(F.col("chargeback_count").desc(), "merchant_id").limit(n)


def queue(df: DataFrame, key: str, n: int = 15) -> DataFrame:
    cols = [key, "investigation_priority", "risk_signal_count", "risk_explanations", "transaction_count", "chargeback_count"]
    return df.select(*cols).orderBy(F.col("risk_signal_count").desc(), F.col("chargeback_count").desc(), key).limit(n)


def candidate_transactions(transactions: DataFrame, n: int = 250) -> DataFrame:
    held = transactions.select("txn_id", "timestamp", "user_id", "merchant_id", "amount", "status", "chargeback_count")
    return held.orderBy(F.col("chargeback_count").desc(), F.col("amount").desc_nulls_last(), "txn_id").limit(n)


def linkage_evidence(linkage: DataFrame, n: int = 300) -> DataFrame:
    held = linkage.select("complaint_id", "txn_id", "user_id", "merchant_id", "reported_timestamp", "linkage_status", "disputed_amount")
    return held.orderBy(F.col("reported_timestamp").desc_nulls_last(), "complaint_id").limit(n)


def filtered_transactions(transactions: DataFrame, status: list[str] | None = None, first: str | None = None, last: str | None = None, least: float | None = None) -> DataFrame:
    out = transactions
    if status:
        out = out.where(F.col("status").isin(status))
    if first and last:
        out = between(out, "timestamp", first, last)
    if least is not None:
        out = out.where(F.col("amount") >= least)
    return out


def kyc_table(users: DataFrame, n: int = 300) -> DataFrame:
    held = users.where("kyc_record_count > 0").select("user_id", "kyc_record_count", "latest_kyc_status", "latest_risk_segment", "rejected_kyc_records", "high_risk_kyc_records", "profile_inconsistency_flag")
    order: list[Column] = [F.col(c).desc_nulls_last() for c in ("rejected_kyc_records", "high_risk_kyc_records", "kyc_record_count")]
    return held.orderBy(*order, "user_id").limit(n)


def merchant_table(merchants: DataFrame, volume: int = 1, priorities: tuple[str, ...] = ("WATCH", "ELEVATED_REVIEW"), by: str = "chargeback_count", n: int = 300) -> DataFrame:
    held = merchants.where((F.col("transaction_count") >= volume) & F.col("investigation_priority").isin(*priorities))
    cols = ["merchant_id", "merchant_name", "merchant_status", "investigation_priority", "transaction_count", "total_transaction_value", "chargeback_count", "chargeback_rate_min_volume"]
    return held.select(*cols).orderBy(F.col(by).desc_nulls_last(), "merchant_id").limit(n)


def most_connected(nodes: DataFrame, n: int = 12) -> DataFrame:
    return nodes.select("node_id", "node_type", "degree", "component_size").orderBy(F.col("degree").desc(), "node_id").limit(n)


def edge_evidence(edges: DataFrame) -> DataFrame:
    return edges.orderBy(F.col("edge_risk_signal").desc(), F.col("chargeback_count").desc(), F.col("transaction_count").desc(), "source", "target")


def check_totals(validation: DataFrame) -> DataFrame:
    return validation.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PASS", "WARN", "FAIL")])


# --- extensions: asked for by the domain's notes, beyond the report pages ---------------------------------------


def rates(transactions: DataFrame, users: DataFrame, linkage: DataFrame) -> DataFrame:
    """One row: failed and pending rates, KYC completion and rejection rates, mean reporting delay."""
    known = F.col("latest_kyc_status").isNotNull()
    parts = [
        transactions.agg(N.percentage(F.count_if("is_failed_transaction"), N.count_all()).alias("failed_rate"), N.percentage(F.count_if("is_pending_transaction"), N.count_all()).alias("pending_rate")),
        users.agg(
            N.percentage(F.count_if(F.col("latest_kyc_status") == "VERIFIED"), F.count_if(known)).alias("kyc_completion_rate"),
            N.percentage(F.count_if(F.col("latest_kyc_status") == "REJECTED"), F.count_if(known)).alias("kyc_rejection_rate"),
        ),
        linkage.agg(F.avg("reporting_delay_hours").alias("mean_reporting_delay_hours"), F.count_if(F.col("reporting_delay_hours") > 168).alias("reported_after_7_days")),
    ]
    return parts[0].crossJoin(F.broadcast(parts[1])).crossJoin(F.broadcast(parts[2]))  # single rows


def category_amounts(merchants: DataFrame) -> DataFrame:
    sums = merchants.groupBy("merchant_category").agg(N.total(F.col("total_transaction_value")).alias("amount"), N.total(F.col("chargeback_amount")).alias("disputed_amount"), F.sum("transaction_count").alias("transactions"), F.sum("chargeback_count").alias("chargebacks"))
    return sums.withColumn("chargeback_ratio", F.try_divide(F.col("chargebacks").cast("double"), F.col("transactions").cast("double")))


def top_disputing_users(users: DataFrame, n: int = 10) -> DataFrame:
    return users.select("user_id", "disputed_amount", "chargeback_count").orderBy(F.col("disputed_amount").desc(), "user_id").limit(n)


def outcome_by_day(transactions: DataFrame) -> DataFrame:
    held = transactions.where("timestamp is not null").withColumn("day", D.day_of(F.col("timestamp")))
    return held.groupBy("day").agg(F.count_if("is_completed_transaction").alias("completed"), F.count_if("is_failed_transaction").alias("failed"), N.average(F.col("amount")).alias("average_value"))


def amount_by_kyc_status(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("latest_kyc_status").agg(N.total(F.col("amount")).alias("amount"), N.count_all().alias("transactions"))


def merchant_spikes(transactions: DataFrame, factor: float = 3.0) -> DataFrame:
    """Merchant days with at least ``factor`` times the merchant's mean daily count."""
    from pyspark.sql import Window

    daily = transactions.where("timestamp is not null and merchant_id is not null").groupBy("merchant_id", D.day_of(F.col("timestamp")).alias("day")).agg(N.count_all().alias("transactions"))
    w = Window.partitionBy("merchant_id")
    both = daily.withColumn("mean_daily", F.sum("transactions").over(w) / F.count("transactions").over(w))
    return both.where(F.col("transactions") >= factor * F.col("mean_daily"))
