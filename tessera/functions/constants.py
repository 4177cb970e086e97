"""Fixed values of the payment-risk domain: null words, required columns, category synonyms, reasons."""

from __future__ import annotations

NULL_WORDS = ("", "NA", "N/A", "NULL", "NONE", "NAN", "<NA>")

REQUIRED = {
    "transactions": "txn_id timestamp user_id merchant_id amount utr mcc status".split(),
    "kyc": "user_id full_name pan aadhaar date_of_birth city state monthly_income occupation signup_timestamp kyc_status risk_segment".split(),
    "merchants": "merchant_id merchant_name mcc merchant_category business_type city state onboarding_date settlement_account merchant_status declared_avg_ticket_size".split(),
    "chargebacks": (
        "complaint_id txn_id user_id merchant_id transaction_timestamp reported_timestamp disputed_amount reason_code complaint_text"
        " resolution_status bank_response_timestamp severity channel"
    ).split(),
}

# canonical value: the tokens that mean it
TXN_STATUS = {
    "COMPLETED": "S SUCCESS TXN_SUCCESS COMPLETED",
    "FAILED": "F FAILED FAIL TXN_FAILED DECLINED",
    "PENDING": "PENDING P PROCESSING INITIATED",
}
KYC_STATUS = {
    "VERIFIED": "VERIFIED V APPROVED DONE KYC_DONE",
    "PENDING": "PENDING P IN_PROGRESS UNDER_REVIEW",
    "REJECTED": "REJECTED R REJECT FAILED",
}
RISK_SEGMENT = {"LOW": "LOW", "MEDIUM": "MEDIUM", "HIGH": "HIGH", "UNKNOWN": "UNKNOWN"}
MERCHANT_STATUS = {
    "ACTIVE": "ACTIVE A ENABLED LIVE",
    "INACTIVE": "INACTIVE I DISABLED CLOSED",
    "SUSPENDED": "SUSPENDED S BLOCKED HOLD",
}
REASON = {
    "DUPLICATE_DEBIT": "CHARGED_TWICE DUP_DEBIT DUPLICATE_DEBIT DOUBLE_DEBIT",
    "AMOUNT_MISMATCH": "AMOUNT_MISMATCH WRONG_AMOUNT EXTRA_AMOUNT_DEDUCTED INCORRECT_AMOUNT",
    "ACCOUNT_TAKEOVER": "ATO ACCOUNT_TAKEOVER ACCOUNT_HACKED LOGIN_COMPROMISED",
    "SERVICE_NOT_PROVIDED": "MERCHANT_NOT_DELIVERED SERVICE_NOT_PROVIDED DELIVERY_ISSUE ITEM_NOT_RECEIVED MERCHANT_SERVICE_ISSUE NO_SERVICE NOT_DELIVERED SERVICE_FAILED",
    "CUSTOMER_DISPUTE": "CUSTOMER_DISPUTE CUSTOMER_ISSUE DISPUTE_RAISED COMPLAINT",
    "UNAUTHORIZED_TRANSACTION": "FRAUD FRAUD_SUSPECTED NOT_DONE_BY_ME SCAM SUSPICIOUS_TRANSACTION UNAUTH_TXN UNAUTHORISED UNAUTHORIZED_TRANSACTION",
}
RESOLUTION = {
    "CLOSED": "CLOSED",
    "IN_PROGRESS": "IN_PROGRESS WIP",
    "OPEN": "OPEN",
    "PENDING_BANK": "PENDING_BANK",
    "REJECTED": "REJECTED",
    "RESOLVED": "RESOLVED",
}
SEVERITY = {"CRITICAL": "CRIT CRITICAL P1", "HIGH": "H HIGH P2", "MEDIUM": "M MEDIUM P3", "LOW": "L LOW P4"}
CHANNEL = {k: k for k in ("APP", "BRANCH", "CHATBOT", "CALL_CENTER", "EMAIL", "IVR")}

MIN_MERCHANT_TRANSACTIONS = 5
NO_SIGNAL = "No elevated analytical signals in the available data."
PII = ("full_name", "pan", "aadhaar", "settlement_account")
