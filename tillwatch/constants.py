"""Vocabularies, lookup tables and default parameters.

Everything in this module is a fixed value that has to agree between producers and
consumers of failed-payment tables. No logic lives here.
"""

from __future__ import annotations

# --- vocabularies (fixed values) -------------------------------------------------------
METHODS = ["card", "upi", "netbanking", "wallet", "cardless_emi", "emandate"]
ERROR_CODES = ["BAD_REQUEST_ERROR", "GATEWAY_ERROR", "SERVER_ERROR"]
ERROR_SOURCES = [
    "customer", "business", "internal", "gateway", "issuer_bank",
    "customer_psp", "network", "beneficiary_bank", "issuer", "bank",
]
ERROR_STEPS = [
    "payment_initiation", "card_enrollment_check", "payment_authentication",
    "payment_authorization", "payment_capture", "mandate_creation", "payment_creation",
    "payment_request", "payment_request_beneficiary_details",
    "payment_response_beneficiary_details", "payment_debit_request",
    "payment_debit_response", "payment_credit_request", "payment_credit_response",
    "payment_status_request", "payment_status_response", "payment_response",
    "refund_request", "payment_authentication_request",
    "payment_authentication_response", "payment_eligibility_check",
]
REMEDIATION_CLASSES = [
    "retry_same", "wait", "customer_fix", "different_instrument", "different_method",
    "different_instrument_or_method", "customer_contact_issuer_bank",
    "merchant_action", "merchant_contact_razorpay", "terminal",
]
ACTIONS = [
    "no_action", "wait_bank_recovery", "recovery_link_now", "recovery_link_backoff",
    "switch_method", "escalate_human", "reconcile",
]
POSTURES = [
    "monitor", "retry_with_backoff", "failover_method",
    "escalate_to_oncall", "contact_provider", "no_action",
]
CONFIDENCES = ["low", "medium", "high"]
DOWNTIME_METHODS = ["card", "netbanking", "upi"]
DOWNTIME_STATUSES = ["scheduled", "started", "resolved", "updated"]
DOWNTIME_SEVERITIES = ["high", "medium", "low"]
DOWNTIME_EVENTS = [
    "payment.downtime.started", "payment.downtime.updated", "payment.downtime.resolved",
]

# Methods whose failures can name a bank; the others share one entity per method.
BANK_SCOPED_METHODS = ["card", "upi", "netbanking", "emandate"]

# Steps a method can report (fixed values). UPI depends on the flow.
STEPS_BY_METHOD = {
    "card": ["payment_initiation", "card_enrollment_check", "payment_authentication",
             "payment_authorization", "payment_capture"],
    "netbanking": ["payment_initiation", "payment_authentication", "payment_authorization"],
    "wallet": ["payment_initiation", "payment_eligibility_check", "payment_authentication",
               "payment_authorization"],
    "cardless_emi": ["payment_initiation", "payment_eligibility_check",
                     "payment_authentication", "payment_authorization"],
    "emandate": ["payment_initiation", "payment_authentication", "payment_authorization"],
    "upi": ["mandate_creation", "payment_initiation", "payment_creation", "payment_request",
            "payment_request_beneficiary_details", "payment_response_beneficiary_details",
            "payment_debit_request", "payment_debit_response", "payment_credit_request",
            "payment_credit_response", "payment_status_request", "payment_status_response",
            "payment_response", "refund_request"],
}

# Ordered keyword rules for the step (fixed values): first valid match wins.
STEP_KEYWORDS = [
    ("capture", "payment_capture"),
    ("enroll", "card_enrollment_check"),
    ("eligib", "payment_eligibility_check"),
    ("mandate", "mandate_creation"),
    ("authoris", "payment_authorization"),
    ("authoriz", "payment_authorization"),
    ("authenticat", "payment_authentication"),
    ("otp", "payment_authentication"),
    ("pin", "payment_authentication"),
    ("refund", "refund_request"),
]
SERVER_ERROR_REASON = "server_error"
SERVER_ERROR_MARKER = "razorpay's server"
GATEWAY_ERROR_MARKERS = ["technical error", "downtime", "gateway", "core banking system", "cbs"]

# System-side source per method (fixed values).
SYSTEM_SOURCE_BY_METHOD = {
    "card": "issuer_bank", "upi": "network", "netbanking": "issuer_bank",
    "wallet": "issuer", "cardless_emi": "issuer", "emandate": "issuer_bank",
}
SOURCE_BY_CLASS = {
    "customer_fix": "customer",
    "customer_contact_issuer_bank": "customer",
    "merchant_action": "business",
    "merchant_contact_razorpay": "internal",
}

# --- reason classes (fixed values): reason | candidate classes | reviewed-defect flag ---
REASON_CLASS_TABLE = [
    ("amount_less_than_minimum_amount", ("merchant_action",), None),
    ("authentication_failed", ("customer_fix",), None),
    ("authorisation_declined_by_psp", ("customer_fix", "different_instrument"), None),
    ("bank_account_invalid", ("different_instrument_or_method",), None),
    ("bank_account_validation_failed", ("customer_fix",), None),
    ("bank_cutoff_in_progress", ("retry_same",), None),
    ("bank_not_available", ("retry_same",), None),
    ("bank_not_enabled", ("merchant_contact_razorpay",), None),
    ("bank_technical_error", ("different_instrument_or_method",), None),
    ("beneficiary_account_does_not_exist", ("merchant_contact_razorpay",), None),
    ("beneficiary_account_dormant", ("merchant_contact_razorpay",), None),
    ("capture_failed", ("retry_same",), None),
    ("card_declined", ("customer_contact_issuer_bank",), None),
    ("card_expired", ("different_instrument_or_method",), None),
    ("card_network_not_enabled", ("merchant_contact_razorpay",), None),
    ("card_not_enrolled", ("customer_fix", "different_instrument_or_method"), None),
    ("card_number_invalid", ("customer_fix",), None),
    ("card_type_invalid", ("customer_fix",), None),
    ("collect_on_mcc_blocked", ("different_method",), None),
    ("collect_request_pending", ("customer_fix",), None),
    ("compliance_violation", ("customer_contact_issuer_bank", "merchant_contact_razorpay"), None),
    ("credit_limit_exceeded", ("different_method",), None),
    ("credit_limit_expired", ("different_method",), None),
    ("credit_limit_inactive", ("customer_fix", "different_method"), None),
    ("credit_limit_not_approved", ("different_method",), None),
    ("credit_not_permitted", ("customer_fix",), None),
    ("credit_failed", ("customer_fix",), None),
    ("debit_declined", ("customer_contact_issuer_bank",), None),
    ("deemed_transaction", ("wait",), None),
    ("debit_instrument_blocked", ("different_instrument_or_method",), None),
    ("debit_instrument_inactive", ("different_instrument_or_method",), None),
    ("duplicate_refund_id", ("merchant_action",), None),
    ("duplicate_request", ("merchant_action",), None),
    ("duplicate_rrn_found", ("retry_same",), None),
    ("emi_greater_than_max_amount", ("different_instrument_or_method",), None),
    ("emi_plan_unavailable", ("different_instrument_or_method",), None),
    ("funds_blocked_by_mandate", ("customer_fix",), None),
    ("funds_blocked_by_mandate", ("customer_fix",), None),
    ("gateway_technical_error", ("different_method", "wait"), None),
    ("incorrect_atm_pin", ("customer_fix",), None),
    ("incorrect_card_details", ("customer_fix",), None),
    ("incorrect_card_expiry_date", ("customer_fix",), None),
    ("incorrect_cardholder_name", ("customer_fix",), None),
    ("incorrect_cvv", ("customer_fix",), None),
    ("incorrect_otp", ("customer_fix",), None),
    ("incorrect_pin", ("customer_fix",), None),
    ("input_validation_failed", ("merchant_action", "merchant_contact_razorpay"), None),
    ("insufficient_funds", ("different_instrument_or_method",), None),
    ("international_transaction_not_allowed", ("merchant_contact_razorpay",), None),
    ("invalid_amount", ("merchant_action",), None),
    ("invalid_currency", ("merchant_contact_razorpay",), None),
    ("invalid_device", ("customer_fix",), None),
    ("invalid_email", ("customer_fix",), None),
    ("invalid_mobile_number", ("customer_fix",), None),
    ("invalid_order_id", ("merchant_action",), None),
    ("invalid_response_from_gateway", ("customer_fix",), "defect"),
    ("invalid_request", ("merchant_action",), None),
    ("invalid_user_details", ("customer_fix",), None),
    ("invalid_vpa", ("customer_fix",), None),
    ("issuer_technical_error", ("different_method", "wait"), None),
    ("issuer_technical_error", ("retry_same",), None),
    ("live_mode_not_enabled", ("merchant_action",), None),
    ("mandate_creation_declined", ("retry_same",), None),
    ("mandate_creation_expired", ("retry_same",), None),
    ("mandate_creation_failed", ("retry_same",), None),
    ("mandate_creation_timeout", ("retry_same",), None),
    ("mcc_amount_limit_exceeded", ("merchant_contact_razorpay",), None),
    ("merchant_not_activated", ("merchant_contact_razorpay",), None),
    ("mismatch_in_transaction_details", ("merchant_contact_razorpay",), "defect"),
    ("mobile_number_invalid", ("customer_contact_issuer_bank", "customer_fix"), None),
    ("order_already_paid", ("merchant_action",), None),
    ("order_payment_method_mismatch", ("merchant_action",), None),
    ("order_amount_mismatch", ("merchant_action",), None),
    ("otp_attempts_exceeded", ("different_instrument_or_method",), None),
    ("otp_expired", ("customer_fix",), None),
    ("payment_amount_tampered", ("customer_fix",), None),
    ("payment_cancelled", ("retry_same",), None),
    ("payment_collect_request_expired", ("retry_same",), None),
    ("payment_declined", ("customer_contact_issuer_bank",), None),
    ("payment_declined_due_to_high_traffic", ("retry_same",), None),
    ("payment_failed", ("different_method",), None),
    ("payment_method_not_enabled", ("merchant_contact_razorpay",), None),
    ("payment_method_not_enabled", ("merchant_action",), None),
    ("payment_pending", ("wait",), None),
    ("payment_pending_approval", ("merchant_action",), None),
    ("payment_risk_check_failed", ("different_instrument_or_method",), None),
    ("payment_session_expired", ("retry_same",), None),
    ("payment_timed_out", ("retry_same",), None),
    ("pin_attempts_exceeded", ("different_instrument_or_method",), None),
    ("pin_not_set", ("customer_fix",), None),
    ("psp_app_ not_available", ("different_instrument",), None),
    ("psp_app_not_supported", ("different_instrument",), None),
    ("psp_not_available", ("different_instrument",), None),
    ("psp_not_available", ("different_instrument",), None),
    ("psp_not_registered", ("different_instrument",), None),
    ("record_not_found", ("retry_same",), None),
    ("recurring_payment_not_enabled", ("merchant_contact_razorpay",), None),
    ("refund_limit_crossed", ("merchant_action",), None),
    ("reqauth_mandate_not_acknowledged", ("retry_same",), None),
    ("request_timed_out", ("retry_same",), None),
    ("server_error", ("merchant_contact_razorpay", "wait"), None),
    ("transaction_daily_count_exceeded", ("different_instrument_or_method", "wait"), None),
    ("transaction_daily_limit_exceeded", ("different_instrument", "wait"), None),
    ("transaction_limit_exceeded", ("different_instrument_or_method",), None),
    ("transaction_frequency_limit_exceeded", ("different_method",), None),
    ("transaction_on_vpa_restricted", ("different_instrument",), None),
    ("upi_app_technical_error", ("different_instrument", "retry_same"), None),
    ("upi_autopay_not_supported_on_psp", ("different_instrument",), None),
    ("upi_collect_not_enabled", ("merchant_action",), None),
    ("upi_intent_not_enabled", ("merchant_action",), None),
    ("user_not_eligible", ("different_method",), None),
    ("user_not_registered_for_netbanking", ("customer_contact_issuer_bank",), None),
    ("vpa_resolution_failed", ("different_instrument_or_method",), None),
    ("verification_failed", ("retry_same",), None),
]

# Stored answers for the reasons the table cannot settle (fixed values):
# reason | remediation class | confidence
EXTERNAL_ANSWER_TABLE = [
    ("authorisation_declined_by_psp", "customer_fix", "high"),
    ("card_not_enrolled", "customer_fix", "high"),
    ("compliance_violation", "merchant_contact_razorpay", "low"),
    ("credit_limit_inactive", "customer_fix", "high"),
    ("gateway_technical_error", "different_method", "medium"),
    ("input_validation_failed", "merchant_action", "high"),
    ("invalid_response_from_gateway", "retry_same", "low"),
    ("issuer_technical_error", "different_method", "medium"),
    ("mismatch_in_transaction_details", "merchant_action", "high"),
    ("mobile_number_invalid", "customer_fix", "high"),
    ("payment_method_not_enabled", "merchant_contact_razorpay", "high"),
    ("server_error", "wait", "high"),
    ("transaction_daily_count_exceeded", "different_instrument_or_method", "high"),
    ("transaction_daily_limit_exceeded", "different_instrument_or_method", "medium"),
    ("upi_app_technical_error", "retry_same", "low"),
]

# Coarse reasons that hide several mechanisms (fixed values).
CATCH_ALL_REASONS = [
    "payment_failed", "server_error", "bank_technical_error", "gateway_technical_error",
    "card_declined", "payment_declined", "issuer_technical_error", "debit_declined",
]

# Method-specific reasons, most frequent first (fixed values).
METHOD_REASONS = {
    "card": [
        "card_declined", "incorrect_cvv", "incorrect_pin", "card_expired",
        "incorrect_card_expiry_date", "card_number_invalid", "incorrect_card_details",
        "otp_attempts_exceeded", "pin_attempts_exceeded", "debit_instrument_blocked",
        "debit_instrument_inactive", "transaction_limit_exceeded",
        "transaction_daily_limit_exceeded", "transaction_daily_count_exceeded",
        "incorrect_cardholder_name", "card_not_enrolled", "card_type_invalid",
        "capture_failed", "card_network_not_enabled",
    ],
    "upi": [
        "psp_not_available", "invalid_vpa", "pin_not_set", "authorisation_declined_by_psp",
        "transaction_on_vpa_restricted", "vpa_resolution_failed", "upi_app_technical_error",
        "psp_app_not_supported", "psp_not_registered", "psp_app_ not_available",
        "mobile_number_invalid", "collect_request_pending",
        "payment_collect_request_expired", "invalid_device",
        "transaction_frequency_limit_exceeded", "mcc_amount_limit_exceeded",
        "collect_on_mcc_blocked", "incorrect_atm_pin", "upi_collect_not_enabled",
        "upi_intent_not_enabled", "upi_autopay_not_supported_on_psp",
        "mandate_creation_failed", "mandate_creation_declined", "mandate_creation_expired",
        "mandate_creation_timeout", "reqauth_mandate_not_acknowledged",
        "funds_blocked_by_mandate",
    ],
    "wallet": ["invalid_mobile_number"],
    "cardless_emi": [
        "user_not_eligible", "credit_limit_exceeded", "emi_plan_unavailable",
        "credit_limit_inactive", "credit_limit_expired", "credit_limit_not_approved",
        "emi_greater_than_max_amount",
    ],
    "bank": [
        "bank_not_available", "bank_technical_error", "bank_account_invalid",
        "debit_declined", "bank_cutoff_in_progress", "credit_failed",
        "credit_not_permitted", "bank_account_validation_failed",
        "user_not_registered_for_netbanking", "beneficiary_account_does_not_exist",
        "beneficiary_account_dormant", "bank_not_enabled",
        "mismatch_in_transaction_details",
    ],
}
REASON_BUCKET_BY_METHOD = {
    "card": "card", "upi": "upi", "wallet": "wallet", "cardless_emi": "cardless_emi",
    "netbanking": "bank", "emandate": "bank",
}
ZIPF_EXPONENT = 1.2

# --- text masking (fixed values): patterns and placeholders, applied in this order ------
BANK_NAMES = [
    "State Bank of India", "HDFC Bank", "ICICI Bank", "Axis Bank",
    "Punjab National Bank", "Kotak Mahindra Bank", "Bank of Baroda", "Canara Bank",
    "Union Bank of India", "IDFC FIRST Bank", "Yes Bank", "IndusInd Bank",
]
MASK_RULES = [
    (r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:\d{2})?\b", "<TIMESTAMP>"),
    (r"(?i)(?:Rs\.|INR|₹)\s?\d[\d,]*\.\d{2}", "<AMOUNT>"),
    (r"\bpay_[A-Za-z0-9]{6,}\b", "<PAYMENT_ID>"),
    (r"\border_[A-Za-z0-9]{6,}\b", "<ORDER_ID>"),
    (r"\bcust_[A-Za-z0-9]{6,}\b", "<CUSTOMER_ID>"),
    (r"\b[a-z]{2,12}_[A-Za-z0-9]{6,}\b", "<ID>"),
    (r"\b[A-Za-z][A-Za-z0-9._-]*@[A-Za-z][A-Za-z0-9]*\b", "<VPA>"),
    (r"\b\d{12}\b", "<RRN>"),
    (r"(\bBIN\s+)\d{6}\b", "$1<CARD_BIN>"),
    (r"\b(?:" + "|".join(sorted(BANK_NAMES, key=len, reverse=True)) + r")\b", "<BANK>"),
]

# --- incident detection defaults (fixed values) -----------------------------------------
BUCKET_SECONDS = 900
HISTORY_BUCKETS = 16
MIN_HISTORY = 8
FIXED_THRESHOLD = 3
Z_THRESHOLD = 3.0
P_THRESHOLD = 1e-3
EWMA_ALPHA = 0.2
ZERO_SD = 1e-9
MAX_GAP_BUCKETS = 1
OPEN_ENDED_DAYS = 3650
TEST_FRACTION = 0.2
OUTLIER_MAX_COUNT = 2
DEDUP_TTL_SECONDS = 86400

# --- policy (fixed values) ----------------------------------------------------------------
CHASE_ACTIONS = ["recovery_link_now", "recovery_link_backoff", "switch_method"]
LADDER = ["recovery_link_now", "recovery_link_backoff", "switch_method", "escalate_human"]
RECONCILE_REASONS = ["order_already_paid", "duplicate_request", "duplicate_refund_id"]
BASE_ACTION_BY_CLASS = {
    "retry_same": "recovery_link_now",
    "wait": "recovery_link_backoff",
    "customer_fix": "recovery_link_now",
    "different_instrument": "recovery_link_now",
    "different_method": "switch_method",
    "different_instrument_or_method": "switch_method",
    "customer_contact_issuer_bank": "recovery_link_now",
    "merchant_action": "escalate_human",
    "merchant_contact_razorpay": "escalate_human",
    "terminal": "no_action",
}
GUARDRAILS = [
    "terminal_reason_blocklist", "active_incident_suppression", "amount_floor",
    "attempt_cap", "per_customer_contact_cap", "contact_cooldown", "quiet_hours",
]

# --- recovery model (fixed values) ----------------------------------------------------------
LEVELS = ["pessimistic", "central", "optimistic"]
UPLIFT_MULTIPLIER = {"pessimistic": 0.6, "central": 1.0, "optimistic": 1.4}
FLOOR_MULTIPLIER = {"pessimistic": 0.8, "central": 1.0, "optimistic": 1.2}
SELF_RECOVERY = {
    "retry_same": 0.30, "wait": 0.25, "customer_fix": 0.15, "different_instrument": 0.10,
    "different_method": 0.08, "different_instrument_or_method": 0.10,
    "customer_contact_issuer_bank": 0.05, "merchant_action": 0.03,
    "merchant_contact_razorpay": 0.02, "terminal": 0.01,
}
ACTION_CEILING = {
    "retry_same": 0.80, "wait": 0.65, "customer_fix": 0.60, "different_instrument": 0.45,
    "different_method": 0.55, "different_instrument_or_method": 0.50,
    "customer_contact_issuer_bank": 0.30, "merchant_action": 0.55,
    "merchant_contact_razorpay": 0.40, "terminal": 0.02,
}
NATIVE_FIT = 1.0
OTHER_FIT = 0.35
GENERIC_FLOOR = 0.20
INCIDENT_RATE = 0.70
POLICIES = ["do_nothing", "notify_all", "notify_all_once", "guarded"]

# --- outbound requests and audit (fixed values) ----------------------------------------------
CURRENCY = "INR"
RESTRICTABLE_METHODS = ["card", "netbanking", "upi", "wallet"]
REFERENCE_ID_LENGTH = 40
AUDIT_SCHEMA_VERSION = 1

# Site-specific strings; pass your own where stored keys or draws must line up.
REFERENCE_PREFIX = "fplink_"
DRAW_SALT = "recovery-draw"
