"""SQL twins of the cleaning audits, the validation table and the components of the whole graph."""

from __future__ import annotations

from tessera.functions.constants import REQUIRED

TABLES = {"transactions": "txn", "kyc": "kyc", "merchants": "mch", "chargebacks": "cb"}
MONEY = {"transactions": "amount", "kyc": "monthly_income", "merchants": "declared_avg_ticket_size", "chargebacks": "disputed_amount"}
FLAGS = {
    "transactions": ("amount_invalid_flag", "amount_parse_failure_flag", "timestamp_parse_failure_flag", "mcc_valid", "status_unmapped_flag"),
    "kyc": (
        "pan_valid",
        "aadhaar_valid",
        "monthly_income_invalid_flag",
        "monthly_income_parse_failure_flag",
        "date_of_birth_parse_failure_flag",
        "signup_timestamp_parse_failure_flag",
        "kyc_status_unmapped_flag",
        "risk_segment_unmapped_flag",
    ),
    "merchants": (
        "mcc_valid",
        "settlement_account_valid",
        "declared_avg_ticket_size_invalid_flag",
        "declared_avg_ticket_size_parse_failure_flag",
        "onboarding_date_parse_failure_flag",
        "merchant_status_unmapped_flag",
    ),
    "chargebacks": (
        "disputed_amount_invalid_flag",
        "disputed_amount_parse_failure_flag",
        "transaction_timestamp_parse_failure_flag",
        "reported_timestamp_parse_failure_flag",
        "bank_response_timestamp_parse_failure_flag",
        "reported_before_transaction_flag",
        "bank_response_before_transaction_flag",
        "reason_code_unmapped_flag",
        "resolution_status_unmapped_flag",
        "severity_unmapped_flag",
        "channel_unmapped_flag",
    ),
}
#: raw rows, and those that repeat another one
RAW = {
    "transactions": ("(SELECT count(*) + count(*) FILTER (o_orderkey % 25 = 0) FROM orders)", "(SELECT count(*) FILTER (o_orderkey % 25 = 0) FROM orders)"),
    "kyc": ("(SELECT count(*) + count(*) FILTER (k % 31 = 0) FROM kyc0)", "(SELECT count(*) FILTER (k % 31 = 0) FROM kyc0)"),
    "merchants": ("(SELECT count(*) FROM mch0)", "0"),
    "chargebacks": ("(SELECT count(*) FROM cb0)", "0"),
}
#: ids by the rows whose spelling cleaning changes; the number in an id decides on its spelling
_NO = "CAST(substr({}, 4) AS BIGINT)"
CHANGED = {
    "transactions": {c: f"{_NO.format('txn_id')} % 5 <> 0 AND {c} IS NOT NULL" for c in ("txn_id", "user_id", "merchant_id")} | {"utr": "utr IS NOT NULL"},
    "kyc": {"user_id": f"{_NO.format('user_id')} % 5 <> 0"},
    "merchants": {"merchant_id": f"{_NO.format('merchant_id')} % 5 <> 0"},
    "chargebacks": {c: f"{_NO.format('complaint_id')} % 5 <> 0 AND {c} IS NOT NULL" for c in ("complaint_id", "user_id", "merchant_id")}
    | {"txn_id": f"{_NO.format('complaint_id')} % 5 <> 0 AND txn_id IS NOT NULL AND {_NO.format('complaint_id')} % 13 <> 0"},
}
VALIDITY = {"mcc": "invalid MCC", "pan": "invalid PAN", "aadhaar": "invalid Aadhaar", "settlement_account": "invalid settlement account"}


def _columns(dataset: str) -> list[str]:
    return [*REQUIRED[dataset], *FLAGS[dataset]]


def audit(dataset: str) -> str:
    table, (raw, repeats) = TABLES[dataset], RAW[dataset]
    n = f"(SELECT count(*) FROM {table})"
    count = lambda hit: f'(SELECT count(*) FROM {table} WHERE {hit})'
    lines = [("exact duplicates removed", "ALL", repeats, raw)]
    for column, hit in CHANGED[dataset].items():
        lines.append(("ID standardization", column, count(hit), raw))
        lines.append(("missing identifier", column, count(f"{column} IS NULL"), n))
    for flag in FLAGS[dataset]:
        if flag.endswith("_valid"):
            column = flag.removesuffix("_valid")
            lines.append((VALIDITY[column], column, count(f"{column} IS NOT NULL AND NOT {flag}"), raw))
        elif flag.endswith("_before_transaction_flag"):
            lines.append(("impossible chronology", flag.replace("_before_transaction_flag", "_timestamp"), count(flag), raw))
        else:
            for end, issue in (("_parse_failure_flag", ""), ("_invalid_flag", "invalid negative monetary values"), ("_unmapped_flag", "unmapped category values")):
                if flag.endswith(end):
                    column = flag.removesuffix(end)
                    lines.append((issue or ("monetary parse failures" if column == MONEY[dataset] else "timestamp parse failures"), column, count(flag), raw))
    lines += [("missing values after cleaning", c, count(f'"{c}" IS NULL'), n) for c in _columns(dataset)]
    rows = " UNION ALL ".join(f"SELECT '{dataset}' AS dataset, '{dataset} {i}' AS issue, '{c}' AS \"column\", {a} AS numerator, {d} AS denominator" for i, c, a, d in lines)
    return f"SELECT *, coalesce(round(100.0 * numerator / nullif(denominator, 0), 2), 0) AS percentage FROM ({rows})"


KEYS = {
    "transactions": ("unique nonmissing txn_id", "txn_id", "FAIL"),
    "chargebacks": ("unique complaint_id", "complaint_id", "FAIL"),
    "kyc": ("repeated user_id", "user_id", "WARN"),
    "merchants": ("repeated merchant_id", "merchant_id", "WARN"),
}


def validation() -> str:
    lines = []
    for dataset, table in TABLES.items():
        n = f"(SELECT count(*) FROM {table})"
        lines.append((dataset, "required schema columns", "0", str(len(REQUIRED[dataset])), "FAIL"))
        lines.append((dataset, "remaining exact duplicate rows", f"({n} - (SELECT count(*) FROM (SELECT DISTINCT * FROM {table})))", n, "WARN"))
        lines += [(dataset, f"missing values: {c}", f'(SELECT count(*) FROM {table} WHERE "{c}" IS NULL)', n, "WARN") for c in _columns(dataset)]
        lines.append((dataset, f"negative {MONEY[dataset]} after cleaning", f"(SELECT count(*) FROM {table} WHERE {MONEY[dataset]} < 0)", n, "FAIL"))
        check, key, bad = KEYS[dataset]
        lines.append((dataset, check, f"(SELECT count({key}) - count(DISTINCT {key}) FROM {table})", f"(SELECT count({key}) FROM {table})", bad))
    rows = " UNION ALL ".join(f"SELECT '{s}' AS dataset, '{c}' AS \"check\", {a} AS numerator, {d} AS denominator, '{bad}' AS bad" for s, c, a, d, bad in lines)
    return f"""SELECT dataset, "check", numerator, denominator, coalesce(round(100.0 * numerator / nullif(denominator, 0), 2), 0) AS percentage,
        CASE WHEN numerator > 0 THEN bad ELSE 'PASS' END AS status FROM ({rows})"""


#: components of all observed pairs: the first by a search from its smallest node, the few others by all reachable pairs
COMPONENTS = """
pways AS (SELECT source AS a, target AS b FROM sparse UNION SELECT target, source FROM sparse),
first_part AS (SELECT min(a) AS node FROM pways UNION SELECT w.b FROM first_part f JOIN pways w ON w.a = f.node),
others AS (SELECT * FROM pways WHERE a NOT IN (SELECT node FROM first_part)),
others_reach AS (SELECT a, a AS b FROM others UNION SELECT r.a, w.b FROM others_reach r JOIN others w ON w.a = r.b),
named AS (SELECT node AS node_id, (SELECT min(a) FROM pways) AS component_id FROM first_part WHERE node IS NOT NULL UNION ALL SELECT a, min(b) FROM others_reach GROUP BY a),
parts AS (SELECT node_id, component_id, count(*) OVER (PARTITION BY component_id) AS component_size
  FROM (SELECT e.node_id, coalesce(n.component_id, e.node_id) AS component_id FROM ends e LEFT JOIN named n USING (node_id)))"""
