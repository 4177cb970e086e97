"""The pipeline's tables stated independently in DuckDB SQL over the driver tables.

Cleaned tables are stated from the driver keys, not from the messy texts, so they check what the
cleaners recover.
"""

from __future__ import annotations

_FLAG = "coalesce({}, false)"

CTES = """
first_supplier AS (SELECT l_orderkey, min(l_suppkey) AS s FROM lineitem GROUP BY l_orderkey),
txn AS (
  SELECT 'TXN' || o_orderkey AS txn_id,
    CASE WHEN o_orderkey % 61 <> 0 THEN o_orderdate + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 60) + to_seconds(o_orderkey % 59) END AS "timestamp",
    'USR' || o_custkey AS user_id, 'MCH' || s AS merchant_id,
    CASE WHEN o_orderkey % 53 <> 0 AND o_orderkey % 41 <> 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS amount,
    CASE WHEN o_orderkey % 19 <> 0 THEN 'UTR' || (o_orderkey * 7 + 1) END AS utr,
    CASE WHEN o_orderkey % 23 = 0 THEN '54' WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(5000 + o_custkey % 1000 AS VARCHAR) END AS mcc,
    CASE WHEN o_orderkey % 97 = 0 THEN 'REVERSED' WHEN o_orderstatus = 'F' THEN 'FAILED' WHEN o_orderstatus = 'O' THEN 'COMPLETED' ELSE 'PENDING' END AS status,
    (o_orderkey % 41 = 0 AND o_orderkey % 53 <> 0) AS amount_invalid_flag, (o_orderkey % 53 = 0) AS amount_parse_failure_flag,
    (o_orderkey % 61 = 0) AS timestamp_parse_failure_flag, (o_orderkey % 23 <> 0 AND o_orderkey % 29 <> 0) AS mcc_valid,
    (o_orderkey % 97 = 0) AS status_unmapped_flag
  FROM orders LEFT JOIN first_supplier ON l_orderkey = o_orderkey),
kyc0 AS (
  SELECT c_custkey AS k, v, c_name, c_mktsegment, n_name, n_regionkey, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS bal,
    TIMESTAMP '1950-01-15' + to_days(CAST(c_custkey * 13 % 20000 AS INT)) AS b,
    TIMESTAMP '2023-01-01 08:00:00' + to_days(CAST((c_custkey * 37 + v * 11) % 900 AS INT)) + to_hours(c_custkey % 12) AS t
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN (SELECT unnest([0, 1]) AS v) x ON v = 0 OR c_custkey % 7 = 0),
kyc AS (
  SELECT 'USR' || k AS user_id, c_name AS full_name, CASE WHEN k % 11 = 0 THEN 'ABC12' ELSE 'ABCDE' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') || 'F' END AS pan,
    CASE WHEN k % 13 = 0 THEN '1234' ELSE lpad(CAST(k * 7919 AS VARCHAR), 12, '3') END AS aadhaar,
    CASE WHEN k % 4 IN (0, 3) OR day(b) > 12 THEN b END AS date_of_birth,
    regexp_replace(upper(n_name), '[^A-Z0-9]+', '_', 'g') AS city, 'REGION_' || n_regionkey AS state,
    CASE WHEN bal >= 0 THEN bal END AS monthly_income, upper(c_mktsegment) AS occupation,
    CASE WHEN k % 17 <> 0 THEN t END AS signup_timestamp,
    CASE (k + v) % 4 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'VERIFIED' WHEN 2 THEN 'PENDING' ELSE 'REJECTED' END AS kyc_status,
    CASE (k + v * 2) % 5 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'UNKNOWN' ELSE 'ELEVATED' END AS risk_segment,
    (k % 11 <> 0) AS pan_valid, (k % 13 <> 0) AS aadhaar_valid, (bal < 0) AS monthly_income_invalid_flag, false AS monthly_income_parse_failure_flag,
    (k % 4 IN (1, 2) AND day(b) <= 12) AS date_of_birth_parse_failure_flag, false AS signup_timestamp_parse_failure_flag,
    false AS kyc_status_unmapped_flag, ((k + v * 2) % 5 = 4) AS risk_segment_unmapped_flag
  FROM kyc0),
mch0 AS (
  SELECT s_suppkey AS k, v, s_name, n_name, n_regionkey, CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS bal, TIMESTAMP '2019-03-01' + to_days(CAST(s_suppkey * 29 % 3000 AS INT)) AS t
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN (SELECT unnest([0, 1]) AS v) x ON v = 0 OR s_suppkey % 6 = 0),
mch AS (
  SELECT 'MCH' || k AS merchant_id, s_name AS merchant_name, CASE WHEN k % 9 = 0 THEN NULL WHEN k % 8 = 0 THEN '54' ELSE CAST(4000 + k % 500 AS VARCHAR) END AS mcc,
    CASE (k + v) % 4 WHEN 0 THEN 'FOOD_DRINK' WHEN 1 THEN 'TRAVEL' WHEN 2 THEN 'RETAIL' ELSE 'UTILITIES' END AS merchant_category,
    CASE k % 3 WHEN 0 THEN 'SOLE_PROP' WHEN 1 THEN 'PRIVATE_LTD' ELSE 'LLP' END AS business_type,
    regexp_replace(upper(n_name), '[^A-Z0-9]+', '_', 'g') AS city, 'REGION_' || n_regionkey AS state, t AS onboarding_date,
    CASE WHEN k % 10 = 0 THEN 'ACC1' ELSE 'ACC' || lpad(CAST(k AS VARCHAR), 8, '0') END AS settlement_account,
    CASE (k + v) % 5 WHEN 2 THEN 'INACTIVE' WHEN 3 THEN 'SUSPENDED' ELSE 'ACTIVE' END AS merchant_status,
    CASE WHEN bal >= 0 THEN bal END AS declared_avg_ticket_size, (k % 9 <> 0 AND k % 8 <> 0) AS mcc_valid, (k % 10 <> 0) AS settlement_account_valid,
    (bal < 0) AS declared_avg_ticket_size_invalid_flag, false AS declared_avg_ticket_size_parse_failure_flag, false AS onboarding_date_parse_failure_flag,
    false AS merchant_status_unmapped_flag
  FROM mch0),
cb0 AS (
  SELECT event_id AS k, date_trunc('second', ts) AS r, CAST(CAST(floor(value * 100) AS DECIMAL(18,0)) / 100 AS DECIMAL(18,2)) AS cents, user_id AS u,
    event_id % ((SELECT count(*) FROM orders) // 20) AS o, event_id % (SELECT count(*) FROM supplier) AS mm, CAST(regexp_extract(props, '[0-9]+') AS INT) AS p
  FROM events WHERE event_type = 'error'),
cb1 AS (
  SELECT c.*, o_custkey, s, CASE WHEN k % 12 = 0 THEN r + to_hours(5) ELSE r - to_hours(k % 200) END AS tt,
    CASE WHEN k % 5 <> 0 THEN r + to_hours(k % 90 - 10) END AS bb, CASE WHEN k % 37 <> 0 THEN CASE WHEN k % 14 = 0 THEN -cents ELSE cents END END AS d
  FROM cb0 c LEFT JOIN orders ON o_orderkey = o LEFT JOIN first_supplier ON l_orderkey = o),
cb AS (
  SELECT 'CBK' || k AS complaint_id, CASE WHEN k % 17 = 0 THEN NULL WHEN k % 13 = 0 THEN 'TXN9' || lpad(CAST(k AS VARCHAR), 11, '0') ELSE 'TXN' || o END AS txn_id,
    'USR' || CASE WHEN k % 3 = 0 THEN o_custkey ELSE u END AS user_id, 'MCH' || CASE WHEN k % 3 = 0 THEN s ELSE mm END AS merchant_id,
    tt AS transaction_timestamp, CASE WHEN r >= tt THEN r END AS reported_timestamp, CASE WHEN d >= 0 THEN CAST(d AS DOUBLE) END AS disputed_amount,
    CASE p % 7 WHEN 0 THEN 'DUPLICATE_DEBIT' WHEN 1 THEN 'AMOUNT_MISMATCH' WHEN 2 THEN 'ACCOUNT_TAKEOVER' WHEN 3 THEN 'SERVICE_NOT_PROVIDED' WHEN 4 THEN 'CUSTOMER_DISPUTE'
      WHEN 5 THEN 'UNAUTHORIZED_TRANSACTION' ELSE 'OTHER_REASON' END AS reason_code,
    'note ' || k AS complaint_text,
    CASE p % 6 WHEN 0 THEN 'CLOSED' WHEN 1 THEN 'IN_PROGRESS' WHEN 2 THEN 'OPEN' WHEN 3 THEN 'PENDING_BANK' WHEN 4 THEN 'REJECTED' ELSE 'RESOLVED' END AS resolution_status,
    CASE WHEN bb >= tt THEN bb END AS bank_response_timestamp,
    CASE p % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' ELSE 'HIGH' END AS severity,
    CASE p % 3 WHEN 0 THEN 'APP' WHEN 1 THEN 'CALL_CENTER' ELSE 'WALK_IN' END AS channel,
    coalesce(d < 0, false) AS disputed_amount_invalid_flag, (k % 37 = 0) AS disputed_amount_parse_failure_flag, false AS transaction_timestamp_parse_failure_flag,
    false AS reported_timestamp_parse_failure_flag, false AS bank_response_timestamp_parse_failure_flag, (r < tt) AS reported_before_transaction_flag,
    coalesce(bb < tt, false) AS bank_response_before_transaction_flag, (p % 7 = 6) AS reason_code_unmapped_flag, false AS resolution_status_unmapped_flag,
    false AS severity_unmapped_flag, (p % 3 = 2) AS channel_unmapped_flag
  FROM cb1),
txnf AS (
  SELECT *, CAST("timestamp" AS DATE) AS transaction_date, hour("timestamp") AS transaction_hour, dayname("timestamp") AS transaction_day_of_week,
    status = 'COMPLETED' AS is_completed_transaction, status = 'FAILED' AS is_failed_transaction, status = 'PENDING' AS is_pending_transaction,
    amount >= (SELECT coalesce(quantile_cont(amount, 0.95), 0) FROM txn) AS is_high_value_transaction,
    count(*) OVER (PARTITION BY user_id) AS user_transaction_count, count(*) OVER (PARTITION BY merchant_id) AS merchant_transaction_count,
    (amount - avg(amount) OVER (PARTITION BY user_id)) / nullif(stddev_samp(amount) OVER (PARTITION BY user_id), 0) AS user_amount_zscore
  FROM txn),
txnff AS (SELECT *, coalesce(abs(user_amount_zscore) >= 2.5, false) AS is_user_amount_anomaly FROM txnf),
cbf AS (
  SELECT *, date_diff('second', transaction_timestamp, reported_timestamp) / 3600.0 AS reporting_delay_hours,
    date_diff('second', reported_timestamp, bank_response_timestamp) / 3600.0 AS bank_response_delay_hours,
    coalesce(bank_response_timestamp < reported_timestamp, false) AS bank_response_before_report_flag, severity = 'CRITICAL' AS is_critical_dispute,
    severity IN ('CRITICAL', 'HIGH') AS is_high_severity, resolution_status IN ('OPEN', 'IN_PROGRESS', 'PENDING_BANK') AS is_open_case,
    reason_code = 'ACCOUNT_TAKEOVER' AS is_account_takeover, reason_code = 'UNAUTHORIZED_TRANSACTION' AS is_unauthorized_transaction,
    disputed_amount >= (SELECT coalesce(quantile_cont(disputed_amount, 0.75), 0) FROM cb) AS is_high_value_dispute, CAST(reported_timestamp AS DATE) AS chargeback_date
  FROM cb),
kycf AS (
  SELECT *, CAST(floor(date_diff('day', date_of_birth, TIMESTAMP '2026-09-15') / 365.2425) AS BIGINT) AS age_years FROM kyc),
kycff AS (
  SELECT *, coalesce(age_years < 18, false) OR coalesce(age_years > 120, false) AS age_invalid_flag, kyc_status = 'REJECTED' AS is_kyc_rejected, kyc_status = 'PENDING' AS is_kyc_pending,
    risk_segment = 'HIGH' AS is_high_kyc_risk, monthly_income >= (SELECT coalesce(quantile_cont(monthly_income, 0.95), 0) FROM kyc) AS is_high_income_profile FROM kycf),
mchf AS (
  SELECT *, date_diff('day', onboarding_date, TIMESTAMP '2026-09-15') AS merchant_age_days, onboarding_date > TIMESTAMP '2026-09-15' AS future_onboarding_flag,
    merchant_status = 'ACTIVE' AS is_active_merchant, merchant_status = 'SUSPENDED' AS is_suspended_merchant,
    declared_avg_ticket_size >= (SELECT coalesce(quantile_cont(declared_avg_ticket_size, 0.95), 0) FROM mch) AS is_high_declared_ticket,
    merchant_status = 'ACTIVE' AND mcc IS NULL AS active_missing_mcc FROM mch),
kyc_sum AS (
  SELECT user_id, count(*) AS kyc_record_count, string_agg(DISTINCT kyc_status, ' | ' ORDER BY kyc_status) AS kyc_status_values, count(DISTINCT kyc_status) AS kyc_status_count,
    string_agg(DISTINCT risk_segment, ' | ' ORDER BY risk_segment) AS risk_segment_values, count(DISTINCT risk_segment) AS risk_segment_count,
    count(*) FILTER (is_kyc_rejected) AS rejected_kyc_records, count(*) FILTER (is_high_kyc_risk) AS high_risk_kyc_records, count(*) FILTER (is_kyc_pending) AS pending_kyc_records,
    median(monthly_income) AS median_monthly_income, string_agg(DISTINCT city, ' | ' ORDER BY city) AS city_values, string_agg(DISTINCT occupation, ' | ' ORDER BY occupation) AS occupation_values,
    count(*) FILTER (NOT pan_valid) AS invalid_pan_records, count(*) FILTER (NOT aadhaar_valid) AS invalid_aadhaar_records
  FROM kycff GROUP BY user_id),
kyc_last AS (
  SELECT user_id, kyc_status AS latest_kyc_status, risk_segment AS latest_risk_segment, signup_timestamp AS latest_signup_timestamp FROM kycff
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY signup_timestamp DESC NULLS LAST, kyc_status DESC, risk_segment DESC) = 1),
kycs AS (SELECT *, (kyc_status_count > 1 OR risk_segment_count > 1) AS profile_inconsistency_flag FROM kyc_sum JOIN kyc_last USING (user_id)),
mchs0 AS (
  SELECT merchant_id, count(*) AS merchant_reference_record_count,
    CASE WHEN min(merchant_name) = max(merchant_name) THEN min(merchant_name) ELSE 'MULTIPLE_VALUES' END AS merchant_name,
    CASE WHEN min(merchant_category) = max(merchant_category) THEN min(merchant_category) ELSE 'MULTIPLE_VALUES' END AS merchant_category,
    min(business_type) AS business_type, CASE WHEN min(merchant_status) = max(merchant_status) THEN min(merchant_status) ELSE 'MULTIPLE_VALUES' END AS merchant_status,
    min(mcc) AS mcc, min(city) AS city, min(state) AS state, median(declared_avg_ticket_size) AS declared_avg_ticket_size,
    string_agg(DISTINCT merchant_status, ' | ' ORDER BY merchant_status) AS merchant_status_values, string_agg(DISTINCT merchant_category, ' | ' ORDER BY merchant_category) AS merchant_category_values,
    count(DISTINCT merchant_status) AS merchant_status_count, count(DISTINCT merchant_category) AS merchant_category_count,
    count(*) FILTER (NOT mcc_valid) AS invalid_mcc_records, count(*) FILTER (is_suspended_merchant) AS suspended_reference_records
  FROM mchf GROUP BY merchant_id),
mchs AS (SELECT *, (merchant_status_count > 1 OR merchant_category_count > 1) AS merchant_reference_inconsistency_flag FROM mchs0),
link0 AS (
  SELECT c.*, t.user_id AS transaction_user_id, t.merchant_id AS transaction_merchant_id, t.amount AS transaction_amount, t.status AS transaction_status, t."timestamp" AS matched_transaction_timestamp
  FROM cbf c LEFT JOIN txn t ON c.txn_id IS NOT DISTINCT FROM t.txn_id),
link1 AS (
  SELECT l.*, transaction_user_id IS NOT NULL AS transaction_record_found, transaction_user_id IS NOT NULL AS txn_id_match,
    CASE WHEN transaction_user_id IS NOT NULL THEN coalesce(l.user_id = transaction_user_id, false) END AS user_id_match,
    CASE WHEN transaction_user_id IS NOT NULL THEN coalesce(l.merchant_id = transaction_merchant_id, false) END AS merchant_id_match,
    NOT EXISTS (SELECT 1 FROM txn t WHERE t.user_id IS NOT DISTINCT FROM l.user_id AND t.merchant_id IS NOT DISTINCT FROM l.merchant_id) AS network_disconnected,
    CASE WHEN disputed_amount IS NOT NULL AND transaction_amount IS NOT NULL THEN round(disputed_amount, 2) = round(transaction_amount, 2) END AS disputed_amount_match,
    (disputed_amount_invalid_flag OR reported_before_transaction_flag OR bank_response_before_transaction_flag) AS data_quality_anomaly
  FROM link0 l),
link2 AS (SELECT *, user_id_match AND merchant_id_match AS user_merchant_pair_match, transaction_record_found AND NOT (coalesce(user_id_match, false) AND coalesce(merchant_id_match, false)) AS identity_mismatch FROM link1),
link AS (
  SELECT *, CASE WHEN txn_id IS NULL THEN 'MISSING_TXN_ID' WHEN NOT transaction_record_found THEN 'UNMATCHED_TRANSACTION' WHEN identity_mismatch THEN 'IDENTITY_MISMATCH'
    WHEN network_disconnected THEN 'RELATIONSHIP_MISMATCH' ELSE 'MATCHED_IDENTITIES' END AS linkage_status FROM link2),
by_txn AS (
  SELECT txn_id, count(*) AS chargeback_count, round(coalesce(fsum(disputed_amount), 0), 6) AS chargeback_amount,
    count(*) FILTER (is_high_severity) AS high_severity_chargeback_count, count(*) FILTER (identity_mismatch) AS identity_mismatch_count,
    count(*) FILTER (network_disconnected) AS disconnected_relationship_count FROM link GROUP BY txn_id),
rich AS (
  SELECT t.*, k.* EXCLUDE (user_id), m.* EXCLUDE (merchant_id, mcc), m.mcc AS mcc_merchant, coalesce(chargeback_count, 0) AS chargeback_count, coalesce(chargeback_amount, 0) AS chargeback_amount,
    coalesce(high_severity_chargeback_count, 0) AS high_severity_chargeback_count, coalesce(identity_mismatch_count, 0) AS identity_mismatch_count,
    coalesce(disconnected_relationship_count, 0) AS disconnected_relationship_count
  FROM txnff t LEFT JOIN kycs k USING (user_id) LEFT JOIN mchs m USING (merchant_id) LEFT JOIN by_txn b USING (txn_id)),
user_paid AS (
  SELECT user_id, count(*) AS transaction_count, round(coalesce(fsum(amount), 0), 6) AS total_transaction_value,
    round(fsum(amount), 6) / nullif(count(amount), 0) AS average_transaction_value, count(DISTINCT merchant_id) AS unique_merchants,
    count(*) FILTER (is_failed_transaction) AS failed_transaction_count, count(*) FILTER (is_pending_transaction) AS pending_transaction_count,
    count(*) FILTER (is_high_value_transaction) AS high_value_transaction_count, count(*) FILTER (is_user_amount_anomaly) AS amount_anomaly_count
  FROM txnff WHERE user_id IS NOT NULL GROUP BY user_id),
user_cb AS (
  SELECT user_id, count(*) AS chargeback_count, round(coalesce(fsum(disputed_amount), 0), 6) AS disputed_amount,
    count(*) FILTER (is_high_severity) AS high_severity_chargeback_count, count(*) FILTER (is_unauthorized_transaction) AS unauthorized_transaction_count,
    count(*) FILTER (is_account_takeover) AS account_takeover_count, count(*) FILTER (identity_mismatch) AS identity_mismatch_count,
    count(*) FILTER (network_disconnected) AS disconnected_relationship_count FROM link WHERE user_id IS NOT NULL GROUP BY user_id),
users0 AS (
  SELECT user_id, coalesce(transaction_count, 0) AS transaction_count, coalesce(total_transaction_value, 0) AS total_transaction_value,
    coalesce(average_transaction_value, 0) AS average_transaction_value, coalesce(unique_merchants, 0) AS unique_merchants, coalesce(failed_transaction_count, 0) AS failed_transaction_count,
    coalesce(pending_transaction_count, 0) AS pending_transaction_count, coalesce(high_value_transaction_count, 0) AS high_value_transaction_count,
    coalesce(amount_anomaly_count, 0) AS amount_anomaly_count, coalesce(chargeback_count, 0) AS chargeback_count, coalesce(disputed_amount, 0) AS disputed_amount,
    coalesce(high_severity_chargeback_count, 0) AS high_severity_chargeback_count, coalesce(unauthorized_transaction_count, 0) AS unauthorized_transaction_count,
    coalesce(account_takeover_count, 0) AS account_takeover_count, coalesce(identity_mismatch_count, 0) AS identity_mismatch_count,
    coalesce(disconnected_relationship_count, 0) AS disconnected_relationship_count,
    k.* EXCLUDE (user_id) REPLACE (coalesce(kyc_record_count, 0) AS kyc_record_count, coalesce(kyc_status_count, 0) AS kyc_status_count, coalesce(risk_segment_count, 0) AS risk_segment_count)
  FROM (SELECT user_id FROM txn UNION SELECT user_id FROM cb UNION SELECT user_id FROM kyc) a LEFT JOIN user_paid USING (user_id) LEFT JOIN user_cb USING (user_id) LEFT JOIN kycs k USING (user_id)
  WHERE user_id IS NOT NULL),
users1 AS (
  SELECT *, transaction_count >= (SELECT quantile_cont(transaction_count, 0.95) FROM users0) AND transaction_count > 0 AS high_transaction_frequency_flag,
    chargeback_count >= (SELECT quantile_cont(chargeback_count, 0.95) FROM users0) AND chargeback_count > 0 AS high_chargeback_activity_flag FROM users0),
users2 AS (
  SELECT *, concat_ws('; ', CASE WHEN high_transaction_frequency_flag THEN 'unusually high transaction frequency' END, CASE WHEN high_chargeback_activity_flag THEN 'high chargeback activity' END,
    CASE WHEN identity_mismatch_count > 0 THEN 'chargeback identity mismatch' END, CASE WHEN disconnected_relationship_count > 0 THEN 'disconnected user-merchant relationship' END,
    CASE WHEN rejected_kyc_records > 0 THEN 'rejected KYC record' END, CASE WHEN high_risk_kyc_records > 0 THEN 'high-risk KYC segment' END,
    CASE WHEN unauthorized_transaction_count > 0 THEN 'unauthorized-transaction chargeback' END) AS why FROM users1),
users AS (
  SELECT * EXCLUDE (why, n), n AS risk_signal_count, CASE WHEN why = '' THEN 'No elevated analytical signals in the available data.' ELSE why END AS risk_explanations,
    CASE WHEN n = 0 THEN 'LOW' WHEN n <= 2 THEN 'WATCH' ELSE 'ELEVATED_REVIEW' END AS investigation_priority
  FROM (SELECT *, CASE WHEN why = '' THEN 0 ELSE len(string_split(why, '; ')) END AS n FROM users2)),
mch_paid AS (
  SELECT merchant_id, count(*) AS transaction_count, round(coalesce(fsum(amount), 0), 6) AS total_transaction_value,
    round(fsum(amount), 6) / nullif(count(amount), 0) AS average_transaction_value, count(DISTINCT user_id) AS unique_users,
    count(*) FILTER (is_failed_transaction) AS failed_transaction_count FROM txnff WHERE merchant_id IS NOT NULL GROUP BY merchant_id),
mch_cb AS (
  SELECT merchant_id, count(*) AS chargeback_count, round(coalesce(fsum(disputed_amount), 0), 6) AS chargeback_amount,
    count(*) FILTER (is_high_severity) AS high_severity_chargeback_count, count(*) FILTER (identity_mismatch) AS identity_mismatch_count,
    count(*) FILTER (network_disconnected) AS disconnected_relationship_count FROM link WHERE merchant_id IS NOT NULL GROUP BY merchant_id),
merchants0 AS (
  SELECT merchant_id, coalesce(transaction_count, 0) AS transaction_count, coalesce(total_transaction_value, 0) AS total_transaction_value,
    coalesce(average_transaction_value, 0) AS average_transaction_value, coalesce(unique_users, 0) AS unique_users, coalesce(failed_transaction_count, 0) AS failed_transaction_count,
    coalesce(chargeback_count, 0) AS chargeback_count, coalesce(chargeback_amount, 0) AS chargeback_amount, coalesce(high_severity_chargeback_count, 0) AS high_severity_chargeback_count,
    coalesce(identity_mismatch_count, 0) AS identity_mismatch_count, coalesce(disconnected_relationship_count, 0) AS disconnected_relationship_count,
    m.* EXCLUDE (merchant_id) REPLACE (coalesce(merchant_reference_record_count, 0) AS merchant_reference_record_count, coalesce(merchant_status_count, 0) AS merchant_status_count,
      coalesce(merchant_category_count, 0) AS merchant_category_count)
  FROM (SELECT merchant_id FROM txn UNION SELECT merchant_id FROM cb UNION SELECT merchant_id FROM mch) a LEFT JOIN mch_paid USING (merchant_id) LEFT JOIN mch_cb USING (merchant_id)
    LEFT JOIN mchs m USING (merchant_id) WHERE merchant_id IS NOT NULL),
merchants1 AS (
  SELECT *, CAST(chargeback_count AS DOUBLE) / nullif(transaction_count, 0) AS chargeback_records_per_transaction, transaction_count >= 5 AS chargeback_rate_eligible,
    CASE WHEN transaction_count >= 5 THEN CAST(chargeback_count AS DOUBLE) / transaction_count END AS chargeback_rate_min_volume,
    average_transaction_value / nullif(declared_avg_ticket_size, 0) AS ticket_size_variance_ratio FROM merchants0),
merchants2 AS (
  SELECT *, coalesce(chargeback_rate_min_volume >= (SELECT coalesce(quantile_cont(chargeback_rate_min_volume, 0.9), 0) FROM merchants1), false) AND chargeback_rate_eligible AS high_chargeback_rate_flag,
    chargeback_count >= (SELECT quantile_cont(chargeback_count, 0.95) FROM merchants1) AND chargeback_count > 0 AS high_chargeback_activity_flag FROM merchants1),
merchants3 AS (
  SELECT *, concat_ws('; ', CASE WHEN high_chargeback_activity_flag THEN 'high chargeback activity' END, CASE WHEN identity_mismatch_count > 0 THEN 'chargeback identity mismatch' END,
    CASE WHEN disconnected_relationship_count > 0 THEN 'disconnected user-merchant relationship' END,
    CASE WHEN high_chargeback_rate_flag THEN 'high chargeback activity at at least 5 transactions' END,
    CASE WHEN merchant_reference_inconsistency_flag THEN 'inconsistent merchant-master records' END,
    CASE WHEN suspended_reference_records > 0 THEN 'suspended merchant-master status' END) AS why FROM merchants2),
merchants AS (
  SELECT * EXCLUDE (why, n), n AS risk_signal_count, CASE WHEN why = '' THEN 'No elevated analytical signals in the available data.' ELSE why END AS risk_explanations,
    CASE WHEN n = 0 THEN 'LOW' WHEN n <= 2 THEN 'WATCH' ELSE 'ELEVATED_REVIEW' END AS investigation_priority
  FROM (SELECT *, CASE WHEN why = '' THEN 0 ELSE len(string_split(why, '; ')) END AS n FROM merchants3)),
paid_edges AS (SELECT user_id, merchant_id, count(*) AS transaction_count, round(coalesce(fsum(amount), 0), 6) AS transaction_amount FROM txn GROUP BY 1, 2),
cb_edges AS (
  SELECT user_id, merchant_id, count(*) AS chargeback_count, round(coalesce(fsum(disputed_amount), 0), 6) AS chargeback_amount,
    count(*) FILTER (identity_mismatch) AS identity_mismatch_count, count(*) FILTER (network_disconnected) AS disconnected_relationship_count FROM link GROUP BY 1, 2),
edges AS (
  SELECT coalesce(p.user_id, c.user_id) AS source, coalesce(p.merchant_id, c.merchant_id) AS target, coalesce(transaction_count, 0) AS transaction_count,
    coalesce(transaction_amount, 0) AS transaction_amount, coalesce(chargeback_count, 0) AS chargeback_count, coalesce(chargeback_amount, 0) AS chargeback_amount,
    coalesce(identity_mismatch_count, 0) AS identity_mismatch_count, coalesce(disconnected_relationship_count, 0) AS disconnected_relationship_count,
    CASE WHEN coalesce(transaction_count, 0) > 0 THEN 'TRANSACTION_RELATIONSHIP' ELSE 'CHARGEBACK_ONLY' END AS relationship_type,
    (coalesce(identity_mismatch_count, 0) > 0 OR coalesce(disconnected_relationship_count, 0) > 0) AS edge_risk_signal
  FROM paid_edges p FULL JOIN cb_edges c ON p.user_id IS NOT DISTINCT FROM c.user_id AND p.merchant_id IS NOT DISTINCT FROM c.merchant_id)
"""


def sql(select: str, more: str = "") -> str:
    return "WITH RECURSIVE " + CTES.strip() + (",\n" + more.strip() if more else "") + "\n" + select
