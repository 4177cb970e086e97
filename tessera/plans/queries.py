"""Every operator of the engine as a query over the driver tables, with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import dates as D, text as T
from tessera.operators import eda, graph, legacy, quality
from tessera.plans import audit_oracle as A, reports as R
from tessera.plans.ask import ask
from tessera.plans.oracle import sql
from tessera.plans.pipeline import from_driver_tables
from tessera.sources.adapters import raw_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of float additions doesn't show."""
    return df.select(*[F.round(F.col(f"`{c}`"), places).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])


def _add(name: str, make: Callable[[dict[str, DataFrame]], DataFrame], oracle: str | None, more: str = "", network: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: tidy(make(from_driver_tables(spark, sf_dir, network)))
    if oracle:
        ORACLES[name] = sql(oracle, more)


def _rounded(table: str, *columns: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in columns)}) FROM {table}"


# --- cleaning and validation ------------------------------------------------------------------------------------
_add("clean_transactions", lambda t: t["transactions_cleaned"], "SELECT * FROM txn")
_add("clean_kyc", lambda t: t["kyc_cleaned"], "SELECT * FROM kyc")
_add("clean_merchants", lambda t: t["merchants_cleaned"], "SELECT * FROM mch")
_add("clean_chargebacks", lambda t: t["chargebacks_cleaned"], "SELECT * FROM cb")
for _name in A.TABLES:
    _add(f"audit_{_name}", lambda t, n=_name: t[f"{n}_audit"].select("dataset", "issue", "column", "numerator", "denominator", "percentage"), A.audit(_name))
_add(
    "validation_keys",
    lambda t: t["validation"].where("check in ('unique nonmissing txn_id', 'unique complaint_id', 'repeated user_id', 'repeated merchant_id')").select("dataset", "check", "numerator", "denominator", "status"),
    """SELECT 'transactions' AS dataset, 'unique nonmissing txn_id' AS "check", count(txn_id) - count(DISTINCT txn_id) AS numerator, count(txn_id) AS denominator, 'PASS' AS status FROM txn
    UNION ALL SELECT 'chargebacks', 'unique complaint_id', count(complaint_id) - count(DISTINCT complaint_id), count(complaint_id), 'PASS' FROM cb
    UNION ALL SELECT 'kyc', 'repeated user_id', count(user_id) - count(DISTINCT user_id), count(user_id), 'WARN' FROM kyc
    UNION ALL SELECT 'merchants', 'repeated merchant_id', count(merchant_id) - count(DISTINCT merchant_id), count(merchant_id), 'WARN' FROM mch""",
)
_add("validation_all", lambda t: t["validation"].select("dataset", "check", "numerator", "denominator", "percentage", "status"), A.validation())
_add("validation_totals", lambda t: R.check_totals(t["validation"]), f"SELECT count(*) FILTER (status = 'PASS') AS pass, count(*) FILTER (status = 'WARN') AS warn, count(*) FILTER (status = 'FAIL') AS fail FROM ({A.validation()})")
_add("null_profile", lambda t: quality.null_counts(t["chargebacks_cleaned"]), 'SELECT "column", missing, rows FROM (UNPIVOT (SELECT count(*) - count(COLUMNS(*)) FROM cb) ON COLUMNS(*) INTO NAME "column" VALUE missing), (SELECT count(*) AS rows FROM cb)')
_add("quality_profile", lambda t: quality.quality_profile(t["transactions_cleaned"].select("txn_id", "utr", "mcc", "status")), """
    SELECT c AS "column", m AS missing_count, round_even(100.0 * m / n, 2) AS missing_pct, u AS unique_values FROM (
      SELECT 'txn_id' AS c, count(*) - count(txn_id) AS m, count(DISTINCT txn_id) AS u, count(*) AS n FROM txn UNION ALL SELECT 'utr', count(*) - count(utr), count(DISTINCT utr), count(*) FROM txn
      UNION ALL SELECT 'mcc', count(*) - count(mcc), count(DISTINCT mcc), count(*) FROM txn UNION ALL SELECT 'status', count(*) - count(status), count(DISTINCT status), count(*) FROM txn)""")

# --- features, summaries, linkage -------------------------------------------------------------------------------
_add("transaction_features", lambda t: t["transactions_features"], _rounded("txnff", "user_amount_zscore"))
_add("chargeback_features", lambda t: t["chargebacks_features"], _rounded("cbf", "reporting_delay_hours", "bank_response_delay_hours"))
_add("kyc_features", lambda t: t["kyc_features"], "SELECT * FROM kycff")
_add("merchant_features", lambda t: t["merchants_features"], "SELECT * FROM mchf")
_add("kyc_user_summary", lambda t: t["kyc_summary"], _rounded("kycs", "median_monthly_income"))
_add("merchant_reference_summary", lambda t: t["merchant_summary"], _rounded("mchs", "declared_avg_ticket_size"))
_add("transaction_intelligence", lambda t: t["transactions"], _rounded("rich", "user_amount_zscore", "median_monthly_income", "declared_avg_ticket_size"))
_add("chargeback_linkage", lambda t: t["linkage"], _rounded("link", "reporting_delay_hours", "bank_response_delay_hours"))
_add("linkage_status", lambda t: t["linkage"].groupBy("linkage_status").agg(F.count(F.lit(1)).alias("n")), "SELECT linkage_status, count(*) AS n FROM link GROUP BY 1")
_add("integration_audit", lambda t: t["integration_audit"].select("check", "numerator", "denominator", "percentage"), """
    SELECT c AS "check", n AS numerator, d AS denominator, coalesce(round(100.0 * n / nullif(d, 0), 2), 0) AS percentage FROM (
      SELECT 'chargeback records retained after linkage' AS c, count(*) AS n, (SELECT count(*) FROM cb) AS d FROM link
      UNION ALL SELECT 'transactions found for chargebacks', count(*) FILTER (transaction_record_found), count(*) FROM link
      UNION ALL SELECT 'chargebacks missing txn_id', count(*) FILTER (txn_id IS NULL), count(*) FROM link
      UNION ALL SELECT 'chargebacks with identity mismatch', count(*) FILTER (identity_mismatch), count(*) FILTER (transaction_record_found) FROM link
      UNION ALL SELECT 'chargeback pairs disconnected from transaction network', count(*) FILTER (network_disconnected), count(*) FROM link
      UNION ALL SELECT 'exact disputed amount matches', count(*) FILTER (disputed_amount_match), count(disputed_amount_match) FROM link
      UNION ALL SELECT 'transaction rows retained after chargeback aggregation', (SELECT count(*) FROM rich), (SELECT count(*) FROM txn))""")

# --- marts ------------------------------------------------------------------------------------------------------
_add("user_risk_mart", lambda t: t["users"], _rounded("users", "average_transaction_value", "median_monthly_income"))
_add("merchant_risk_mart", lambda t: t["merchants"], _rounded("merchants", "average_transaction_value", "declared_avg_ticket_size", "chargeback_records_per_transaction", "chargeback_rate_min_volume", "ticket_size_variance_ratio"))
_add("key_universe", lambda t: t["users"].select("user_id"), "SELECT user_id FROM users")

# --- graph ------------------------------------------------------------------------------------------------------
_NODES = """
sparse AS (SELECT DISTINCT source, target FROM edges WHERE relationship_type = 'TRANSACTION_RELATIONSHIP' AND source IS NOT NULL AND target IS NOT NULL),
deg AS (SELECT node_id, count(*) AS degree FROM (SELECT source AS node_id FROM sparse UNION ALL SELECT target FROM sparse) GROUP BY 1),
ends AS (SELECT source AS node_id FROM edges WHERE source IS NOT NULL UNION SELECT target FROM edges WHERE target IS NOT NULL)"""
_add("network_edges", lambda t: graph.network_edges(t["transactions"], t["linkage"]), "SELECT * FROM edges")
_add("network_degrees", lambda t: t["nodes"].select("node_id", "node_type", "degree", "risk_signal_count", "investigation_priority"), """
    SELECT e.node_id, CASE WHEN e.node_id LIKE 'USR%' THEN 'USER' ELSE 'MERCHANT' END AS node_type, coalesce(degree, 0) AS degree,
      coalesce(u.risk_signal_count, m.risk_signal_count, 0) AS risk_signal_count, coalesce(u.investigation_priority, m.investigation_priority, 'LOW') AS investigation_priority
    FROM ends e LEFT JOIN deg USING (node_id) LEFT JOIN users u ON u.user_id = e.node_id LEFT JOIN merchants m ON m.merchant_id = e.node_id""", _NODES, network=True)
_PARTS = _NODES + "," + A.COMPONENTS
_add("network_nodes", lambda t: t["nodes"], """
    SELECT p.node_id, CASE WHEN p.node_id LIKE 'USR%' THEN 'USER' ELSE 'MERCHANT' END AS node_type, coalesce(degree, 0) AS degree, component_id, component_size, component_size > 1 AS transaction_connected_component,
      coalesce(u.risk_signal_count, m.risk_signal_count, 0) AS risk_signal_count, coalesce(u.investigation_priority, m.investigation_priority, 'LOW') AS investigation_priority
    FROM parts p LEFT JOIN deg USING (node_id) LEFT JOIN users u ON u.user_id = p.node_id LEFT JOIN merchants m ON m.merchant_id = p.node_id""", _PARTS, network=True)
_add("network_audit", lambda t: t["network_audit"].select("check", "numerator", "denominator", "percentage"), """
    SELECT c AS "check", n AS numerator, d AS denominator, coalesce(round(100.0 * n / nullif(d, 0), 2), 0) AS percentage FROM (
      SELECT 'transaction network nodes' AS c, count(*) AS n, count(*) AS d FROM ends
      UNION ALL SELECT 'transaction network edges', count(*) FILTER (relationship_type = 'TRANSACTION_RELATIONSHIP'), count(*) FROM edges
      UNION ALL SELECT 'chargeback-only relationship edges', count(*) FILTER (relationship_type = 'CHARGEBACK_ONLY'), count(*) FROM edges
      UNION ALL SELECT 'transaction components', count(DISTINCT component_id), count(*) FROM parts)""", _PARTS, network=True)
_add("most_connected", lambda t: R.most_connected(t["nodes"]), """
    SELECT e.node_id, CASE WHEN e.node_id LIKE 'USR%' THEN 'USER' ELSE 'MERCHANT' END AS node_type, coalesce(degree, 0) AS degree, component_size FROM ends e JOIN parts USING (node_id) LEFT JOIN deg USING (node_id)
    ORDER BY degree DESC, e.node_id LIMIT 12""", _PARTS, network=True)
_add("network_components", lambda t: t["nodes"].select("node_id", "component_id", "component_size"), "SELECT node_id, component_id, component_size FROM parts", _PARTS, network=True)
_EGO = """
whole AS (SELECT source, target FROM edges WHERE source IS NOT NULL AND target IS NOT NULL),
ways AS (SELECT source AS a, target AS b FROM whole UNION SELECT target, source FROM whole),
ego AS (SELECT DISTINCT b AS node_id FROM ways WHERE a = 'USR7' UNION SELECT 'USR7'),
top AS (SELECT b AS node_id FROM ways WHERE a = 'USR7' ORDER BY (SELECT count(*) FROM ways w WHERE w.a = ways.b) DESC, b LIMIT 74),
near AS (SELECT node_id FROM ego UNION SELECT w.b FROM ways w JOIN ego ON w.a = ego.node_id AND ego.node_id <> 'USR7'),
chosen AS (SELECT node_id FROM near WHERE (SELECT count(*) FROM near) <= 75 UNION SELECT node_id FROM top WHERE (SELECT count(*) FROM near) > 75 UNION SELECT 'USR7'),
ins AS (SELECT * FROM whole WHERE source IN (SELECT node_id FROM chosen) AND target IN (SELECT node_id FROM chosen))"""
_add("ego_network", lambda t: graph.ego_network(graph.network_edges(t["transactions"], t["linkage"]), "USR7")[0], """
    SELECT node_id, CASE WHEN node_id LIKE 'USR%' THEN 'USER' ELSE 'MERCHANT' END AS node_type, (SELECT count(*) FROM ins WHERE source = node_id OR target = node_id) AS degree,
      node_id = 'USR7' AS is_focus FROM chosen""", _EGO)
_add("edge_evidence", lambda t: R.edge_evidence(graph.ego_network(graph.network_edges(t["transactions"], t["linkage"]), "USR7")[1]),
     "SELECT e.* FROM edges e JOIN ins USING (source, target)", _EGO)

# --- report pages -----------------------------------------------------------------------------------------------
_add("overview", lambda t: R.overview(t["transactions"], t["linkage"], t["users"], t["merchants"]), """
    SELECT * FROM (SELECT count(*) AS transactions, round(fsum(amount), 6) AS transaction_value, count(*) FILTER (is_failed_transaction) AS failed_transactions FROM txnff),
      (SELECT count(*) AS chargebacks, round(fsum(disputed_amount), 6) AS disputed_value, count(*) FILTER (identity_mismatch) AS identity_mismatches FROM link),
      (SELECT count(*) AS users, count(*) FILTER (investigation_priority <> 'LOW') AS users_for_review FROM users),
      (SELECT count(*) AS merchants, count(*) FILTER (investigation_priority <> 'LOW') AS merchants_for_review FROM merchants)""")
_add("daily_transactions", lambda t: R.daily_transactions(t["transactions"]), """SELECT date_trunc('day', "timestamp")::TIMESTAMP AS day, count(*) AS transactions,
    round(coalesce(fsum(amount), 0), 6) AS value FROM txn WHERE "timestamp" IS NOT NULL GROUP BY 1""")
_add("daily_chargebacks", lambda t: R.daily_chargebacks(t["linkage"]), "SELECT date_trunc('day', reported_timestamp)::TIMESTAMP AS day, count(*) AS chargebacks FROM cb WHERE reported_timestamp IS NOT NULL GROUP BY 1")
_add("disputed_merchants", lambda t: R.disputed_merchants(t["merchants"]), "SELECT merchant_id, merchant_name, chargeback_count, investigation_priority FROM merchants WHERE investigation_priority <> 'LOW' ORDER BY chargeback_count DESC, merchant_id LIMIT 10")
for _kind, _table in (("user", "users"), ("merchant", "merchants")):
    _add(f"{_kind}_queue", lambda t, k=_kind, n=_table: R.queue(t[n], f"{k}_id"), f"""SELECT {_kind}_id, investigation_priority, risk_signal_count, risk_explanations, transaction_count, chargeback_count FROM {_table}
        ORDER BY risk_signal_count DESC, chargeback_count DESC, {_kind}_id LIMIT 15""")
_add("status_distribution", lambda t: R.counts(t["transactions"], "status"), "SELECT status, count(*) AS records FROM txn GROUP BY 1")
_add("candidate_transactions", lambda t: R.candidate_transactions(t["transactions"]), """SELECT txn_id, "timestamp", user_id, merchant_id, amount, status, chargeback_count FROM rich
    ORDER BY chargeback_count DESC, amount DESC NULLS LAST, txn_id LIMIT 250""")
_add("filtered_transactions", lambda t: R.filtered_transactions(t["transactions_cleaned"], ["FAILED", "PENDING"], "1996-01-01", "1996-12-31", 1000.0).select("txn_id", "amount"),
     """SELECT txn_id, amount FROM txn WHERE status IN ('FAILED', 'PENDING') AND CAST("timestamp" AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND amount >= 1000""")
_add("status_options", lambda t: R.options(t["transactions_cleaned"], "status"), "SELECT DISTINCT status FROM txn WHERE status IS NOT NULL")
_add("reason_distribution", lambda t: R.counts(t["linkage"], "reason_code"), "SELECT reason_code, count(*) AS records FROM cb GROUP BY 1")
_add("severity_distribution", lambda t: R.counts(t["linkage"], "severity"), "SELECT severity, count(*) AS records FROM cb GROUP BY 1")
_add("linkage_evidence", lambda t: R.linkage_evidence(t["linkage"]), "SELECT complaint_id, txn_id, user_id, merchant_id, reported_timestamp, linkage_status, disputed_amount FROM link ORDER BY reported_timestamp DESC NULLS LAST, complaint_id LIMIT 300")
_add("kyc_status_counts", lambda t: R.counts(t["users"], "latest_kyc_status"), "SELECT latest_kyc_status, count(*) AS records FROM users GROUP BY 1")
_add("risk_segment_counts", lambda t: R.counts(t["users"], "latest_risk_segment"), "SELECT latest_risk_segment, count(*) AS records FROM users GROUP BY 1")
_add("ranked_segments", lambda t: R.ranked(R.counts(t["users"], "latest_risk_segment"), "latest_risk_segment", "records"), "SELECT latest_risk_segment, count(*) AS records FROM users WHERE latest_risk_segment IS NOT NULL GROUP BY 1")
_add("kyc_table", lambda t: R.kyc_table(t["users"]), """SELECT user_id, kyc_record_count, latest_kyc_status, latest_risk_segment, rejected_kyc_records, high_risk_kyc_records, profile_inconsistency_flag FROM users
    WHERE kyc_record_count > 0 ORDER BY rejected_kyc_records DESC NULLS LAST, high_risk_kyc_records DESC NULLS LAST, kyc_record_count DESC, user_id LIMIT 300""")
_add("merchant_table", lambda t: R.merchant_table(t["merchants"]), """SELECT merchant_id, merchant_name, merchant_status, investigation_priority, transaction_count, total_transaction_value, chargeback_count,
    round(chargeback_rate_min_volume, 6) AS chargeback_rate_min_volume FROM merchants WHERE transaction_count >= 1 AND investigation_priority IN ('WATCH', 'ELEVATED_REVIEW')
    ORDER BY chargeback_count DESC, merchant_id LIMIT 300""")

# --- questions --------------------------------------------------------------------------------------------------


def _ask(name: str, question: str, oracle: str, columns: list[str]) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        answer = ask(spark, question, from_driver_tables(spark, sf_dir))
        return tidy(answer.data.select(*columns))

    QUERIES[name] = query
    ORACLES[name] = sql(oracle)


_ask("ask_chargeback", "why cbk703 ?", "SELECT complaint_id, txn_id, user_id, linkage_status FROM link WHERE complaint_id = 'CBK703'", ["complaint_id", "txn_id", "user_id", "linkage_status"])
_ask("ask_transaction", "look at TXN7", "SELECT complaint_id, txn_id, linkage_status FROM link WHERE txn_id = 'TXN7'", ["complaint_id", "txn_id", "linkage_status"])
_ask("ask_user", "Why is USR7 an investigation candidate?", """SELECT txn_id, "timestamp", merchant_id, amount, status, chargeback_count FROM rich WHERE user_id = 'USR7'""", ["txn_id", "timestamp", "merchant_id", "amount", "status", "chargeback_count"])
_ask("ask_merchant", "and MCH5?", """SELECT txn_id, "timestamp", user_id, amount, status, chargeback_count FROM rich WHERE merchant_id = 'MCH5'""", ["txn_id", "timestamp", "user_id", "amount", "status", "chargeback_count"])
_ask("ask_disconnected", "Find disconnected user-merchant relationships.", "SELECT complaint_id, user_id, merchant_id FROM link WHERE network_disconnected", ["complaint_id", "user_id", "merchant_id"])
_ask("ask_mismatch", "Why does this not match?", "SELECT complaint_id, user_id, transaction_user_id FROM link WHERE identity_mismatch", ["complaint_id", "user_id", "transaction_user_id"])
_ask("ask_low_volume", "merchants with high chargeback activity", "SELECT merchant_id, chargeback_count, transaction_count FROM merchants WHERE chargeback_count > 0 AND transaction_count <= (SELECT quantile_cont(transaction_count, 0.25) FROM merchants)", ["merchant_id", "chargeback_count", "transaction_count"])
_ask("ask_broad_users", "Find users connected to more than 8 merchants.", "SELECT user_id, unique_merchants FROM users WHERE unique_merchants > 8", ["user_id", "unique_merchants"])

# --- exploration ------------------------------------------------------------------------------------------------
_EDA = """
lim AS (SELECT quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM txn),
e0 AS (SELECT t.*, coalesce(hour("timestamp") BETWEEN 0 AND 5, false) AS is_night, coalesce(isodow("timestamp") >= 6, false) AS is_weekend, coalesce(amount < 0, false) AS negative_amount_flag,
  utr IS NULL AS missing_utr_flag, mcc IS NULL AS missing_mcc_flag, coalesce(amount < q1 - 1.5 * (q3 - q1) OR amount > q3 + 1.5 * (q3 - q1), false) AS amount_iqr_outlier_flag,
  CASE WHEN status = 'COMPLETED' THEN 'SUCCESS' WHEN status = 'FAILED' THEN 'FAILED' WHEN status = 'PENDING' THEN 'PENDING' ELSE 'OTHER' END AS status_group,
  date_diff('second', lag("timestamp") OVER (PARTITION BY user_id ORDER BY "timestamp" NULLS LAST, txn_id), "timestamp") / 60.0 AS minutes_since_prev_user_txn FROM txn t, lim),
e1 AS (SELECT *, coalesce(minutes_since_prev_user_txn <= 5, false) AS rapid_user_txn_flag FROM e0),
e2 AS (SELECT *, CAST(negative_amount_flag AS INT) + CAST(amount_iqr_outlier_flag AS INT) + CAST(missing_utr_flag AS INT) + CAST(missing_mcc_flag AS INT) + CAST(status_group = 'FAILED' AS INT)
  + CAST(rapid_user_txn_flag AS INT) + CAST(is_night AS INT) AS transaction_signal_count FROM e1)"""
_EDA_COLUMNS = "txn_id is_night is_weekend negative_amount_flag missing_utr_flag missing_mcc_flag amount_iqr_outlier_flag status_group minutes_since_prev_user_txn rapid_user_txn_flag transaction_signal_count".split()
_add("eda_transactions", lambda t: eda.transaction_eda(t["transactions_cleaned"]).select(*_EDA_COLUMNS), f"SELECT {', '.join(_EDA_COLUMNS)} FROM e2".replace("minutes_since_prev_user_txn,", "round(minutes_since_prev_user_txn, 6) AS minutes_since_prev_user_txn,"), _EDA)
_add("eda_top_signals", lambda t: eda.transaction_eda(t["transactions_cleaned"]).orderBy(F.col("transaction_signal_count").desc(), F.col("amount_abs").desc_nulls_last(), "txn_id").limit(30).select("txn_id", "amount", "transaction_signal_count"),
     "SELECT txn_id, amount, transaction_signal_count FROM e2 ORDER BY transaction_signal_count DESC, abs(amount) DESC NULLS LAST, txn_id LIMIT 30", _EDA)
_SUM = "round(coalesce(fsum(amount), 0), 6)"
_AVG = "round(round(fsum(amount), 6) / nullif(count(amount), 0), 6)"
for _kind, _other in (("user", "merchant"), ("merchant", "user")):
    _add(f"eda_{_kind}_stats", lambda t, k=_kind: eda.group_stats(eda.transaction_eda(t["transactions_cleaned"]), k), f"""SELECT {_kind}_id, count(txn_id) AS {_kind}_transaction_count, {_SUM} AS {_kind}_total_amount, {_AVG} AS {_kind}_avg_amount,
        max(amount) AS {_kind}_max_amount, min(amount) AS {_kind}_min_amount, count(DISTINCT {_other}_id) AS {_kind}_unique_{_other}s, count(*) FILTER (negative_amount_flag) AS {_kind}_negative_txn_count,
        count(*) FILTER (missing_utr_flag) AS {_kind}_missing_utr_count, count(*) FILTER (missing_mcc_flag) AS {_kind}_missing_mcc_count,
        CAST(count(*) FILTER (negative_amount_flag) AS DOUBLE) / count(txn_id) AS {_kind}_negative_txn_ratio FROM e2 WHERE {_kind}_id IS NOT NULL GROUP BY 1""", _EDA)
    _add(f"eda_top_{_kind}s", lambda t, k=_kind: eda.top_entities(eda.transaction_eda(t["transactions_cleaned"]), k).select(f"{k}_id", "transactions", "total_amount", "multiple_signal_transactions"),
         f"SELECT {_kind}_id, count(txn_id) AS transactions, {_SUM} AS total_amount, count(*) FILTER (transaction_signal_count >= 2) AS multiple_signal_transactions FROM e2 WHERE {_kind}_id IS NOT NULL GROUP BY 1 ORDER BY transactions DESC, {_kind}_id LIMIT 20", _EDA)
_add("eda_pair_stats", lambda t: eda.pair_stats(t["transactions_cleaned"]), f"SELECT user_id, merchant_id, count(txn_id) AS user_merchant_txn_count, {_SUM} AS user_merchant_total_amount, {_AVG} AS user_merchant_avg_amount FROM txn WHERE user_id IS NOT NULL AND merchant_id IS NOT NULL GROUP BY 1, 2")
_add("eda_status_crosstab", lambda t: eda.crosstab(eda.transaction_eda(t["transactions_cleaned"]), "status", "status_group", ["SUCCESS", "FAILED", "PENDING", "OTHER"]), """SELECT status, count(*) FILTER (status_group = 'SUCCESS') AS "SUCCESS",
    count(*) FILTER (status_group = 'FAILED') AS "FAILED", count(*) FILTER (status_group = 'PENDING') AS "PENDING", count(*) FILTER (status_group = 'OTHER') AS "OTHER" FROM e2 GROUP BY 1""", _EDA)
_add("eda_describe", lambda t: eda.describe(t["transactions_cleaned"], "amount"), """SELECT count(amount) AS "count", round(avg(amount), 6) AS mean, round(stddev_samp(amount), 6) AS std, min(amount) AS "min", round(quantile_cont(amount, 0.25), 6) AS p25,
    round(quantile_cont(amount, 0.5), 6) AS p50, round(quantile_cont(amount, 0.75), 6) AS p75, max(amount) AS "max" FROM txn""")
_add("eda_percentile", lambda t: eda.amount_percentile(t["transactions_cleaned"]).select("txn_id", "amount_percentile"), """SELECT txn_id, CASE WHEN amount IS NOT NULL THEN
    round((rank() OVER (ORDER BY amount NULLS LAST) + (count(*) OVER (PARTITION BY amount) - 1) / 2.0) / (SELECT count(amount) FROM txn), 6) END AS amount_percentile FROM txn""")
_add("eda_frequency", lambda t: eda.frequency(t["merchants_cleaned"], "mcc"), 'SELECT mcc, count(*) AS "count" FROM mch GROUP BY 1')
_MERCHANT = """
mb AS (SELECT *, row_number() OVER (ORDER BY declared_avg_ticket_size NULLS LAST, merchant_id, merchant_category) AS r, count(declared_avg_ticket_size) OVER () AS n,
  (SELECT quantile_cont(declared_avg_ticket_size, 0.75) FROM mch) AS high, date_diff('day', onboarding_date, TIMESTAMP '2026-09-14') AS age FROM mch)"""
_add("eda_merchants", lambda t: eda.merchant_eda(t["merchants_cleaned"]).select("merchant_id", "merchant_category", "ticket_size_band", "merchant_age_days", "merchant_age_months", "onboarding_quarter", "missing_mcc", "suspended_high_ticket_size", "inactive_high_ticket_size"), """
    SELECT merchant_id, merchant_category, CASE WHEN declared_avg_ticket_size IS NULL THEN NULL ELSE ['LOW', 'MEDIUM', 'HIGH', 'VERY_HIGH'][1 + CAST(r > 1 + (n - 1) / 4.0 AS INT) + CAST(r > 1 + (n - 1) / 2.0 AS INT)
      + CAST(r > 1 + (n - 1) * 3 / 4.0 AS INT)] END AS ticket_size_band, age AS merchant_age_days, CAST(round_even(age / 30.4375, 0) AS BIGINT) AS merchant_age_months, quarter(onboarding_date) AS onboarding_quarter,
      mcc IS NULL AS missing_mcc, merchant_status = 'SUSPENDED' AND coalesce(declared_avg_ticket_size >= high, false) AS suspended_high_ticket_size,
      merchant_status = 'INACTIVE' AND coalesce(declared_avg_ticket_size >= high, false) AS inactive_high_ticket_size FROM mb""", _MERCHANT)
_add("eda_category_tickets", lambda t: eda.category_tickets(t["merchants_cleaned"]), """SELECT merchant_category, count(declared_avg_ticket_size) AS "count", round(round(fsum(declared_avg_ticket_size), 6) / count(declared_avg_ticket_size), 6) AS mean,
    round(median(declared_avg_ticket_size), 6) AS median FROM mch GROUP BY 1""")
for _name, _largest in (("largest", True), ("smallest", False)):
    _add(f"eda_{_name}_tickets", lambda t, x=_largest: eda.extreme_tickets(t["merchants_cleaned"], largest=x), f"""SELECT merchant_id, merchant_name, merchant_category, declared_avg_ticket_size FROM mch WHERE declared_avg_ticket_size IS NOT NULL
        ORDER BY declared_avg_ticket_size {'DESC' if _largest else 'ASC'}, merchant_id, merchant_category LIMIT 10""")

# --- older cleaning variants ------------------------------------------------------------------------------------


def _legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey").cast("string")
    return o.select(
        "o_orderkey",
        legacy.short_id(F.concat(F.lit("txn-"), key), "TXN", 4).alias("short_id"),
        legacy.exact_label(F.col("o_orderstatus"), {"F": "FAILED", "O": "OPEN"}).alias("label"),
        legacy.signed_money(F.concat(F.lit("Rs. -"), key, F.lit(",5"))).alias("money"),
        legacy.loose_unix(F.concat(F.lit("9"), F.lpad(key, 8, "0"))).alias("moment"),
        legacy.trailing_mcc(F.concat(F.lit("MCC "), key, F.lit(".0"))).alias("mcc"),
        legacy.loose_date(F.date_format("o_orderdate", "d-M-yyyy")).alias("day"),
    )


QUERIES["legacy_variants"] = _legacy
ORACLES["legacy_variants"] = """SELECT o_orderkey, 'TXN' || lpad(right(CAST(o_orderkey AS VARCHAR), 4), 4, '0') AS short_id, CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'OPEN' END AS label,
  -CAST(CAST(o_orderkey AS VARCHAR) || '5' AS DOUBLE) AS money, make_timestamp((900000000 + o_orderkey) * 1000000) AS moment, CAST(o_orderkey AS VARCHAR) AS mcc, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders"""



def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = legacy.labelled(raw_tables(spark, sf_dir)["chargebacks"])
    return rows.select(F.trim("complaint_text").alias("note"), "reason_code", "resolution_status", "severity", "channel")


QUERIES["legacy_labels"] = _labels
ORACLES["legacy_labels"] = sql("""SELECT 'note ' || k AS note, CASE p % 7 WHEN 0 THEN 'DUPLICATE_DEBIT' WHEN 2 THEN 'ACCOUNT_TAKEOVER' WHEN 3 THEN 'SERVICE_NOT_PROVIDED' WHEN 4 THEN 'CUSTOMER_DISPUTE'
  WHEN 5 THEN 'UNAUTHORIZED_TRANSACTION' END AS reason_code, CASE p % 6 WHEN 1 THEN 'IN_PROGRESS' WHEN 4 THEN 'REJECTED' END AS resolution_status, CASE p % 5 WHEN 1 THEN 'HIGH' END AS severity,
  CAST(NULL AS VARCHAR) AS channel FROM cb0""")
_add("legacy_chargeback_features", lambda t: legacy.chargeback_features_false(t["chargebacks_cleaned"]).select("complaint_id", "is_high_value_dispute", "bank_response_before_report_flag", "is_open_case"),
     "SELECT complaint_id, coalesce(is_high_value_dispute, false) AS is_high_value_dispute, bank_response_before_report_flag, is_open_case FROM cbf")
_add("legacy_report", lambda t: legacy.report(t["merchants_audit"], t["merchants_cleaned"], t["merchants_cleaned"]).drop("Rule_Applied"),
     f'SELECT issue AS "Issue", "column" AS "Column", numerator AS "Rows_Affected", (SELECT count(*) FROM mch) AS "Before_Count", (SELECT count(*) FROM mch) AS "After_Count" FROM ({A.audit("merchants")})')

# --- extensions: not in the surveyed pages ----------------------------------------------------------------------
_add("ext_category_amounts", lambda t: R.category_amounts(t["merchants"]), """SELECT merchant_category, round(fsum(total_transaction_value), 6) AS amount, round(fsum(chargeback_amount), 6) AS disputed_amount,
    CAST(sum(transaction_count) AS BIGINT) AS transactions, CAST(sum(chargeback_count) AS BIGINT) AS chargebacks, round(CAST(sum(chargeback_count) AS DOUBLE) / nullif(sum(transaction_count), 0), 6) AS chargeback_ratio FROM merchants GROUP BY 1""")
_add("ext_top_disputing_users", lambda t: R.top_disputing_users(t["users"]), "SELECT user_id, disputed_amount, chargeback_count FROM users ORDER BY disputed_amount DESC, user_id LIMIT 10")
_add("ext_outcome_by_day", lambda t: R.outcome_by_day(t["transactions"]), f"""SELECT date_trunc('day', "timestamp")::TIMESTAMP AS day, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed, {_AVG} AS average_value
    FROM txn WHERE "timestamp" IS NOT NULL GROUP BY 1""")
_add("ext_amount_by_kyc_status", lambda t: R.amount_by_kyc_status(t["transactions"]), f"SELECT latest_kyc_status, {_SUM} AS amount, count(*) AS transactions FROM rich GROUP BY 1")
_add("ext_rates", lambda t: R.rates(t["transactions"], t["users"], t["linkage"]), """
    SELECT * FROM (SELECT round_even(100.0 * count(*) FILTER (status = 'FAILED') / count(*), 2) AS failed_rate, round_even(100.0 * count(*) FILTER (status = 'PENDING') / count(*), 2) AS pending_rate FROM txn),
      (SELECT round_even(100.0 * count(*) FILTER (latest_kyc_status = 'VERIFIED') / count(latest_kyc_status), 2) AS kyc_completion_rate, round_even(100.0 * count(*) FILTER (latest_kyc_status = 'REJECTED') / count(latest_kyc_status), 2) AS kyc_rejection_rate FROM users),
      (SELECT round(avg(reporting_delay_hours), 6) AS mean_reporting_delay_hours, count(*) FILTER (reporting_delay_hours > 168) AS reported_after_7_days FROM cbf)""")
_add("ext_merchant_spikes", lambda t: R.merchant_spikes(t["transactions"], 2.0), """SELECT * FROM (SELECT merchant_id, day, transactions, round(CAST(sum(transactions) OVER (PARTITION BY merchant_id) AS DOUBLE) / count(*) OVER (PARTITION BY merchant_id), 6) AS mean_daily
    FROM (SELECT merchant_id, date_trunc('day', "timestamp")::TIMESTAMP AS day, count(*) AS transactions FROM txn WHERE "timestamp" IS NOT NULL AND merchant_id IS NOT NULL GROUP BY 1, 2))
    WHERE transactions >= 2 * mean_daily""")


def _formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", T.human_number(F.col("o_totalprice").cast("decimal(18,2)")).alias("short"), T.inr(F.col("o_totalprice")).alias("money"), D.day_name(F.col("o_orderdate")).alias("day_name"))


QUERIES["display_formats"] = _formats
ORACLES["display_formats"] = """
WITH c AS (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents FROM orders),
  unit AS (SELECT *, CASE WHEN cents >= 100000000 THEN 10000000 WHEN cents >= 100000 THEN 10000 ELSE 100 END AS u FROM c),
  even AS (SELECT *, cents // u + CAST(2 * (cents % u) > u OR (2 * (cents % u) = u AND (cents // u) % 2 = 1) AS BIGINT) AS q FROM unit)
SELECT o_orderkey, CASE u WHEN 100 THEN format('{:,}', q) ELSE format('{:,}', q // 10) || '.' || (q % 10) || CASE u WHEN 10000 THEN 'K' ELSE 'M' END END AS short,
  format('₹{:,.2f}', o_totalprice) AS money, strftime(o_orderdate, '%A') AS day_name FROM even"""


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = from_driver_tables(spark, sf_dir)
    rows = eda.with_group_stats(eda.transaction_eda(t["transactions_cleaned"]))
    return tidy(rows.select("txn_id", "user_transaction_count", "user_total_amount", "merchant_unique_users", "merchant_avg_amount", "user_merchant_txn_count", "user_merchant_total_amount"))


QUERIES["eda_group_stats"] = _groups
ORACLES["eda_group_stats"] = sql(f"""SELECT txn_id, user_transaction_count, user_total_amount, merchant_unique_users, merchant_avg_amount, user_merchant_txn_count, user_merchant_total_amount FROM txn
  LEFT JOIN (SELECT user_id, count(txn_id) AS user_transaction_count, {_SUM} AS user_total_amount FROM txn WHERE user_id IS NOT NULL GROUP BY 1) USING (user_id)
  LEFT JOIN (SELECT merchant_id, count(DISTINCT user_id) AS merchant_unique_users, {_AVG} AS merchant_avg_amount FROM txn WHERE merchant_id IS NOT NULL GROUP BY 1) USING (merchant_id)
  LEFT JOIN (SELECT user_id, merchant_id, count(txn_id) AS user_merchant_txn_count, {_SUM} AS user_merchant_total_amount FROM txn WHERE user_id IS NOT NULL AND merchant_id IS NOT NULL GROUP BY 1, 2) USING (user_id, merchant_id)""")
_add("merchant_value_table", lambda t: R.merchant_table(t["merchants"], by="total_transaction_value").select("merchant_id", "transaction_count", "total_transaction_value"), """SELECT merchant_id, transaction_count, total_transaction_value FROM merchants
    WHERE transaction_count >= 1 AND investigation_priority IN ('WATCH', 'ELEVATED_REVIEW') ORDER BY total_transaction_value DESC, merchant_id LIMIT 300""")
