"""Driver tables in the roles of the four raw payment sources, with messy spellings.

Every value is a fixed expression of its row's key, so each cleaned table can be stated
independently in SQL. ``raw_tables`` gives all-string tables as a raw file would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"src_{name}")


def _id(key: str, prefix: str, by: str) -> str:
    low = prefix.lower()
    return (
        f"CASE WHEN {key} IS NULL THEN 'N/A' ELSE CASE {by} % 5 WHEN 0 THEN concat('{prefix}', {key}) WHEN 1 THEN concat('{low}-', {key})"
        f" WHEN 2 THEN concat('{prefix} ', {key}) WHEN 3 THEN concat(' {low}_', {key}) ELSE cast({key} AS string) END END"
    )


def _pick(by: str, *words: str) -> str:
    return f"CASE {by} % {len(words)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


def _money(amount: str, by: str) -> str:
    text = f"cast({amount} AS string)"
    return f"CASE {by} % 4 WHEN 0 THEN {text} WHEN 1 THEN concat('Rs. ', {text}) WHEN 2 THEN concat('INR ', {text}) ELSE concat('₹', {text}) END"


def _moment(ts: str, by: str, formats: dict[int, str]) -> str:
    arms = " ".join(f"WHEN {k} THEN date_format({ts}, '{f}')" for k, f in formats.items())
    unix = f"unix_seconds(cast({ts} AS timestamp))"  # ten digits from 2001-09-09 on
    return f"CASE {by} % {len(formats) + 1} {arms} ELSE CASE WHEN {unix} >= 1000000000 THEN cast({unix} AS string) ELSE date_format({ts}, 'yyyy/MM/dd HH:mm:ss') END END"


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "orders", "lineitem")
    amount = "cast(CASE WHEN o_orderkey % 41 = 0 THEN -o_totalprice ELSE o_totalprice END AS decimal(18,2))"
    moment = _moment("t", "o_orderkey", {0: "yyyy-MM-dd HH:mm:ss", 1: "dd/MM/yyyy HH:mm:ss", 2: "MM-dd-yyyy hh:mm:ss a"})
    return spark.sql(f"""
        WITH first_supplier AS (SELECT l_orderkey, min(l_suppkey) AS s FROM src_lineitem GROUP BY l_orderkey),
        base AS (SELECT *, o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 AS int), cast(o_orderkey % 60 AS int), cast(o_orderkey % 59 AS int)) AS t
                 FROM src_orders LEFT JOIN first_supplier ON l_orderkey = o_orderkey),
        rows AS (SELECT o_orderkey AS k,
            {_id("o_orderkey", "TXN", "o_orderkey")} AS txn_id,
            CASE WHEN o_orderkey % 61 = 0 THEN '31/02/2020' ELSE {moment} END AS timestamp,
            {_id("o_custkey", "USR", "o_orderkey")} AS user_id, {_id("s", "MCH", "o_orderkey")} AS merchant_id,
            CASE WHEN o_orderkey % 53 = 0 THEN 'unknown' ELSE {_money(amount, "o_orderkey")} END AS amount,
            CASE WHEN o_orderkey % 19 = 0 THEN 'null' ELSE concat('utr', o_orderkey * 7 + 1) END AS utr,
            CASE WHEN o_orderkey % 23 = 0 THEN '54' WHEN o_orderkey % 29 = 0 THEN '' ELSE concat('MCC-', 5000 + o_custkey % 1000) END AS mcc,
            CASE WHEN o_orderkey % 97 = 0 THEN ' reversed? ' WHEN o_orderstatus = 'F' THEN {_pick("o_orderkey", "F", "failed", "Txn Failed", "declined")}
                 WHEN o_orderstatus = 'O' THEN {_pick("o_orderkey", "s", "Success", "TXN_SUCCESS", "completed")}
                 ELSE {_pick("o_orderkey", "p", "Processing", "initiated")} END AS status
            FROM base)
        SELECT txn_id, timestamp, user_id, merchant_id, amount, utr, mcc, status FROM rows
        UNION ALL SELECT txn_id, timestamp, user_id, merchant_id, amount, utr, mcc, status FROM rows WHERE k % 25 = 0""")


def raw_kyc(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "customer", "nation")
    born = "CASE k % 4 WHEN 0 THEN date_format(b, 'yyyy-MM-dd') WHEN 1 THEN date_format(b, 'd/M/yyyy') WHEN 2 THEN date_format(b, 'M-d-yyyy') ELSE date_format(b, 'd-MMM-yyyy') END"
    return spark.sql(f"""
        WITH base AS (SELECT c_custkey AS k, v, c_name, c_acctbal, c_mktsegment, n_name, n_regionkey,
                timestamp_ntz '1950-01-15 00:00:00' + make_dt_interval(cast(c_custkey * 13 % 20000 AS int)) AS b,
                timestamp_ntz '2023-01-01 08:00:00' + make_dt_interval(cast((c_custkey * 37 + v * 11) % 900 AS int), cast(c_custkey % 12 AS int)) AS t
            FROM src_customer JOIN src_nation ON n_nationkey = c_nationkey
            JOIN (SELECT explode(array(0, 1)) AS v) ON v = 0 OR c_custkey % 7 = 0),
        rows AS (SELECT k, v, {_id("k", "USR", "k")} AS user_id, c_name AS full_name,
            CASE WHEN k % 11 = 0 THEN 'abc12' ELSE concat('abcde ', lpad(cast(k % 10000 AS string), 4, '0'), '-f') END AS pan,
            CASE WHEN k % 13 = 0 THEN '1234' ELSE concat_ws(' ', substr(lpad(cast(k * 7919 AS string), 12, '3'), 1, 4), substr(lpad(cast(k * 7919 AS string), 12, '3'), 5)) END AS aadhaar,
            {born} AS date_of_birth, concat(' ', lower(n_name), ' ') AS city, concat('Region-', n_regionkey) AS state,
            {_money("cast(c_acctbal AS decimal(18,2))", "k")} AS monthly_income, c_mktsegment AS occupation,
            CASE WHEN k % 17 = 0 THEN 'NA' ELSE date_format(t, 'yyyy-MM-dd HH:mm:ss') END AS signup_timestamp,
            CASE (k + v) % 4 WHEN 0 THEN 'kyc done' WHEN 1 THEN 'Approved' WHEN 2 THEN 'under-review' ELSE 'reject' END AS kyc_status,
            CASE (k + v * 2) % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'unknown' ELSE 'elevated' END AS risk_segment
            FROM base)
        SELECT user_id, full_name, pan, aadhaar, date_of_birth, city, state, monthly_income, occupation, signup_timestamp, kyc_status, risk_segment FROM rows
        UNION ALL SELECT user_id, full_name, pan, aadhaar, date_of_birth, city, state, monthly_income, occupation, signup_timestamp, kyc_status, risk_segment
        FROM rows WHERE k % 31 = 0""")


def raw_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "supplier", "nation")
    return spark.sql(f"""
        WITH base AS (SELECT s_suppkey AS k, v, s_name, s_acctbal, n_name, n_regionkey, timestamp_ntz '2019-03-01 00:00:00' + make_dt_interval(cast(s_suppkey * 29 % 3000 AS int)) AS t
            FROM src_supplier JOIN src_nation ON n_nationkey = s_nationkey JOIN (SELECT explode(array(0, 1)) AS v) ON v = 0 OR s_suppkey % 6 = 0)
        SELECT {_id("k", "MCH", "k")} AS merchant_id, s_name AS merchant_name,
            CASE WHEN k % 9 = 0 THEN 'NONE' WHEN k % 8 = 0 THEN 'mcc 54' ELSE concat('mcc-', 4000 + k % 500, '.0') END AS mcc,
            CASE (k + v) % 4 WHEN 0 THEN 'Food & Drink' WHEN 1 THEN 'travel' WHEN 2 THEN 'Retail' ELSE 'utilities' END AS merchant_category,
            {_pick("k", "sole prop", "Private Ltd", "llp")} AS business_type, lower(n_name) AS city, concat('region ', n_regionkey) AS state,
            date_format(t, 'yyyy/MM/dd') AS onboarding_date,
            CASE WHEN k % 10 = 0 THEN 'acc-1' ELSE concat('acc-', lpad(cast(k AS string), 8, '0')) END AS settlement_account,
            CASE (k + v) % 5 WHEN 0 THEN 'live' WHEN 1 THEN 'Active' WHEN 2 THEN 'closed' WHEN 3 THEN 'Hold' ELSE 'a' END AS merchant_status,
            {_money("cast(s_acctbal AS decimal(18,2))", "k")} AS declared_avg_ticket_size
        FROM base""")


def raw_chargebacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "events", "orders", "lineitem", "supplier")
    return spark.sql(f"""
        WITH first_supplier AS (SELECT l_orderkey, min(l_suppkey) AS s FROM src_lineitem GROUP BY l_orderkey),
        sizes AS (SELECT (SELECT count(*) FROM src_orders) div 20 AS n, (SELECT count(*) FROM src_supplier) AS m),
        base AS (SELECT event_id AS k, ts, cast(floor(value * 100) AS decimal(18,0)) / 100 AS cents, user_id AS u, event_id % n AS o, event_id % m AS mm, cast(get_json_object(props, '$.k') AS int) AS p
            FROM src_events CROSS JOIN sizes WHERE event_type = 'error'),
        linked AS (SELECT b.*, o_custkey, s FROM base b LEFT JOIN src_orders ON o_orderkey = o LEFT JOIN first_supplier ON l_orderkey = o),
        rows AS (SELECT k, {_id("k", "CBK", "k")} AS complaint_id,
            CASE WHEN k % 17 = 0 THEN '' WHEN k % 13 = 0 THEN concat('TXN9', lpad(cast(k AS string), 11, '0')) ELSE {_id("o", "TXN", "k")} END AS txn_id,
            {_id("CASE WHEN k % 3 = 0 THEN o_custkey ELSE u END", "USR", "k")} AS user_id,
            {_id("CASE WHEN k % 3 = 0 THEN s ELSE mm END", "MCH", "k")} AS merchant_id,
            {_moment("CASE WHEN k % 12 = 0 THEN date_trunc('SECOND', ts) + make_dt_interval(0, 5) ELSE date_trunc('SECOND', ts) - make_dt_interval(0, cast(k % 200 AS int)) END", "k", {0: "yyyy-MM-dd HH:mm:ss", 1: "dd/MM/yyyy HH:mm:ss", 2: "MM-dd-yyyy HH:mm:ss"})} AS transaction_timestamp,
            {_moment("date_trunc('SECOND', ts)", "k", {0: "yyyy/MM/dd HH:mm:ss", 1: "d-MMM-yyyy HH:mm:ss"})} AS reported_timestamp,
            CASE WHEN k % 37 = 0 THEN 'tbd' ELSE {_money("cast(CASE WHEN k % 14 = 0 THEN -cents ELSE cents END AS decimal(18,2))", "k")} END AS disputed_amount,
            CASE p % 7 WHEN 0 THEN 'charged twice' WHEN 1 THEN 'Wrong-Amount' WHEN 2 THEN 'ATO' WHEN 3 THEN 'not delivered' WHEN 4 THEN 'complaint'
                WHEN 5 THEN 'fraud' ELSE 'other reason' END AS reason_code,
            concat('  note ', k, ' ') AS complaint_text,
            CASE p % 6 WHEN 0 THEN 'closed' WHEN 1 THEN 'WIP' WHEN 2 THEN 'open' WHEN 3 THEN 'pending bank' WHEN 4 THEN 'Rejected' ELSE 'resolved' END AS resolution_status,
            CASE WHEN k % 5 = 0 THEN 'none' ELSE date_format(date_trunc('SECOND', ts) + make_dt_interval(0, cast(k % 90 - 10 AS int)), 'yyyy-MM-dd HH:mm:ss') END AS bank_response_timestamp,
            CASE p % 5 WHEN 0 THEN 'crit' WHEN 1 THEN 'P2' WHEN 2 THEN 'm' WHEN 3 THEN 'low' ELSE 'high' END AS severity,
            CASE p % 3 WHEN 0 THEN 'app' WHEN 1 THEN 'call center' ELSE 'walk-in' END AS channel
            FROM linked)
        SELECT complaint_id, txn_id, user_id, merchant_id, transaction_timestamp, reported_timestamp, disputed_amount, reason_code, complaint_text,
            resolution_status, bank_response_timestamp, severity, channel FROM rows""")


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "transactions": raw_transactions(spark, sf_dir),
        "kyc": raw_kyc(spark, sf_dir),
        "merchants": raw_merchants(spark, sf_dir),
        "chargebacks": raw_chargebacks(spark, sf_dir),
    }
