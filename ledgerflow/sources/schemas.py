"""Declared schemas and constraints of the practice database, as data.

One ``StructType`` per table plus the constraint tables (NOT NULL, enums,
VARCHAR limits, unique keys, foreign keys) that the data-quality jobs and the
change jobs are driven by.  Ids are strings (UUID text).
"""

from __future__ import annotations

from pyspark.sql import types as T

S, I, B, D = T.StringType(), T.IntegerType(), T.BooleanType(), T.DateType()
TS = T.TimestampNTZType()


def dec(p: int, s: int) -> T.DecimalType:
    return T.DecimalType(p, s)


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


_STAMPS = (("created_at", TS), ("updated_at", TS))

TABLES: dict[str, T.StructType] = {
    "users": _struct(
        ("id", S), ("email", S), ("password_hash", S), ("first_name", S),
        ("last_name", S), ("phone", S), ("role", S), ("is_verified", B),
        ("verification_token", S), ("reset_password_token", S),
        ("reset_password_expires", TS), ("last_login", TS), *_STAMPS),
    "accountants": _struct(
        ("id", S), ("user_id", S), ("qualification", S), ("experience_years", I),
        ("specializations", T.ArrayType(S)), ("bio", S), ("rating", dec(3, 2)),
        ("total_reviews", I), ("is_active", B), ("hourly_rate", dec(10, 2)),
        ("availability_status", S), *_STAMPS),
    "customers": _struct(
        ("id", S), ("user_id", S), ("date_of_birth", D),
        ("national_insurance_number", S), ("address_line1", S),
        ("address_line2", S), ("city", S), ("county", S), ("postcode", S),
        ("country", S), ("employment_status", S), ("is_first_time_filer", B),
        ("preferred_contact_method", S), *_STAMPS),
    "tax_returns": _struct(
        ("id", S), ("customer_id", S), ("accountant_id", S), ("tax_year", S),
        ("status", S), ("situation_type", S), ("total_income", dec(12, 2)),
        ("total_tax_due", dec(12, 2)), ("total_refund", dec(12, 2)),
        ("submission_deadline", D), ("filed_date", TS), ("hmrc_reference", S),
        ("notes", S), ("price", dec(10, 2)), ("payment_status", S), *_STAMPS),
    "income_sources": _struct(
        ("id", S), ("tax_return_id", S), ("source_type", S), ("employer_name", S),
        ("gross_income", dec(12, 2)), ("tax_deducted", dec(12, 2)),
        ("ni_contributions", dec(12, 2)), ("start_date", D), ("end_date", D),
        ("created_at", TS)),
    "expenses": _struct(
        ("id", S), ("tax_return_id", S), ("category", S), ("description", S),
        ("amount", dec(10, 2)), ("expense_date", D), ("receipt_url", S),
        ("is_approved", B), ("created_at", TS)),
    "documents": _struct(
        ("id", S), ("tax_return_id", S), ("uploaded_by", S), ("document_type", S),
        ("original_name", S), ("file_path", S), ("file_size", I), ("mime_type", S),
        ("is_processed", B), ("created_at", TS)),
    "messages": _struct(
        ("id", S), ("tax_return_id", S), ("sender_id", S), ("recipient_id", S),
        ("subject", S), ("message", S), ("is_read", B), ("message_type", S),
        ("created_at", TS)),
    "payments": _struct(
        ("id", S), ("tax_return_id", S), ("customer_id", S), ("amount", dec(10, 2)),
        ("currency", S), ("payment_method", S), ("payment_status", S),
        ("stripe_payment_intent_id", S), ("transaction_id", S), ("paid_at", TS),
        ("created_at", TS)),
    "reviews": _struct(
        ("id", S), ("customer_id", S), ("accountant_id", S), ("tax_return_id", S),
        ("rating", I), ("review_text", S), ("is_approved", B), ("created_at", TS)),
    "contact_inquiries": _struct(
        ("id", S), ("first_name", S), ("last_name", S), ("email", S), ("phone", S),
        ("subject", S), ("message", S), ("inquiry_type", S), ("status", S),
        ("assigned_to", S), ("responded_at", TS), ("created_at", TS)),
    "notifications": _struct(
        ("id", S), ("user_id", S), ("title", S), ("message", S),
        ("notification_type", S), ("is_read", B), ("action_url", S),
        ("created_at", TS)),
    "audit_logs": _struct(
        ("id", S), ("user_id", S), ("action", S), ("table_name", S),
        ("record_id", S), ("old_values", S), ("new_values", S),
        ("ip_address", S), ("user_agent", S), ("created_at", TS)),
    "system_settings": _struct(
        ("id", S), ("setting_key", S), ("setting_value", S), ("description", S),
        ("is_public", B), *_STAMPS),
}

# ---------------------------------------------------------------------------
# Fixed values that must equal the declared database for right results.
# ---------------------------------------------------------------------------

# NOT NULL columns per table (primary keys included).
NOT_NULL: dict[str, list[str]] = {
    "users": ["id", "email", "password_hash", "first_name", "last_name", "role"],
    "accountants": ["id"],
    "customers": ["id"],
    "tax_returns": ["id", "tax_year", "status"],
    "income_sources": ["id", "source_type", "gross_income"],
    "expenses": ["id", "category", "description", "amount", "expense_date"],
    "documents": ["id", "document_type", "original_name", "file_path"],
    "messages": ["id", "message"],
    "payments": ["id", "amount", "payment_status"],
    "reviews": ["id", "rating"],
    "contact_inquiries": ["id", "first_name", "last_name", "email", "subject", "message"],
    "notifications": ["id", "title", "message"],
    "audit_logs": ["id", "action"],
    "system_settings": ["id", "setting_key"],
}

# CHECK (col IN (...)) enums of the DDL, then the value lists the request
# validators enforce.
RETURN_STATUSES = ["pending", "in_progress", "review", "completed", "filed", "cancelled"]
PAYMENT_STATUSES = ["pending", "paid", "refunded", "failed"]
ROLES = ["customer", "accountant", "admin"]
AVAILABILITY = ["available", "busy", "offline"]
CONTACT_METHODS = ["email", "phone", "sms"]
MESSAGE_TYPES = ["general", "query", "update", "system"]
PAYMENT_ROW_STATUSES = ["pending", "processing", "completed", "failed", "refunded"]
INQUIRY_STATUSES = ["new", "in_progress", "resolved", "closed"]
NOTIFICATION_TYPES = ["info", "success", "warning", "error"]
SITUATION_TYPES = ["self-employed", "freelancer", "landlord", "investor",
                   "high-earner", "first-time", "other"]
INCOME_SOURCE_TYPES = ["employment", "self_employment", "rental", "dividends",
                       "interest", "other"]
INQUIRY_TYPES = ["general", "tax-return", "account", "billing", "technical", "feedback"]
REGISTRATION_ROLES = ["customer", "accountant"]
ALLOWED_UPLOAD_TYPES = ["pdf", "jpg", "jpeg", "png", "doc", "docx", "xls", "xlsx"]
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
MAX_UPLOAD_FILES = 5
DEFAULT_PRICE = "169.00"
DEFAULT_DEADLINE = "2024-01-31"
DEFAULT_PAGE_SIZE = 20

# (table, column) -> allowed values.  The first nine are DDL CHECKs; the last
# three are route validators.
ENUMS: dict[tuple[str, str], list[str]] = {
    ("users", "role"): ROLES,
    ("accountants", "availability_status"): AVAILABILITY,
    ("customers", "preferred_contact_method"): CONTACT_METHODS,
    ("tax_returns", "status"): RETURN_STATUSES,
    ("tax_returns", "payment_status"): PAYMENT_STATUSES,
    ("messages", "message_type"): MESSAGE_TYPES,
    ("payments", "payment_status"): PAYMENT_ROW_STATUSES,
    ("contact_inquiries", "status"): INQUIRY_STATUSES,
    ("notifications", "notification_type"): NOTIFICATION_TYPES,
    ("tax_returns", "situation_type"): SITUATION_TYPES,
    ("income_sources", "source_type"): INCOME_SOURCE_TYPES,
    ("contact_inquiries", "inquiry_type"): INQUIRY_TYPES,
}

# VARCHAR(n) limits of the DDL.
VARCHAR: dict[str, dict[str, int]] = {
    "users": {"email": 255, "password_hash": 255, "first_name": 100, "last_name": 100,
              "phone": 20, "role": 20, "verification_token": 255,
              "reset_password_token": 255},
    "accountants": {"qualification": 100, "availability_status": 20},
    "customers": {"national_insurance_number": 20, "address_line1": 255,
                  "address_line2": 255, "city": 100, "county": 100, "postcode": 20,
                  "country": 100, "employment_status": 50,
                  "preferred_contact_method": 20},
    "tax_returns": {"tax_year": 10, "status": 20, "situation_type": 50,
                    "hmrc_reference": 100, "payment_status": 20},
    "income_sources": {"source_type": 50, "employer_name": 255},
    "expenses": {"category": 100, "receipt_url": 500},
    "documents": {"document_type": 50, "original_name": 255, "file_path": 500,
                  "mime_type": 100},
    "messages": {"subject": 255, "message_type": 20},
    "payments": {"currency": 3, "payment_method": 50, "payment_status": 20,
                 "stripe_payment_intent_id": 255, "transaction_id": 255},
    "contact_inquiries": {"first_name": 100, "last_name": 100, "email": 255,
                          "phone": 20, "subject": 255, "inquiry_type": 50, "status": 20},
    "notifications": {"title": 255, "notification_type": 50, "action_url": 500},
    "audit_logs": {"action": 100, "table_name": 100},
    "system_settings": {"setting_key": 100},
}

# Trimmed-length rules of the request validators: (table, column) -> (min, max).
REQUEST_LENGTHS: dict[tuple[str, str], tuple[int | None, int | None]] = {
    ("contact_inquiries", "first_name"): (2, 50),
    ("contact_inquiries", "last_name"): (2, 50),
    ("contact_inquiries", "subject"): (5, 255),
    ("contact_inquiries", "message"): (10, 2000),
    ("users", "first_name"): (2, 50),
    ("users", "last_name"): (2, 50),
    ("income_sources", "employer_name"): (None, 255),
}

# UNIQUE keys (primary keys and declared UNIQUE) plus the application rule of
# one return per customer and tax year.
UNIQUE: dict[str, list[list[str]]] = {
    **{t: [["id"]] for t in TABLES},
    "users": [["id"], ["email"]],
    "system_settings": [["id"], ["setting_key"]],
    "tax_returns": [["id"], ["customer_id", "tax_year"]],
}

# REFERENCES of the DDL: (child, column, parent, on_delete_cascade).
FOREIGN_KEYS: list[tuple[str, str, str, bool]] = [
    ("accountants", "user_id", "users", True),
    ("customers", "user_id", "users", True),
    ("tax_returns", "customer_id", "customers", True),
    ("tax_returns", "accountant_id", "accountants", False),
    ("income_sources", "tax_return_id", "tax_returns", True),
    ("expenses", "tax_return_id", "tax_returns", True),
    ("documents", "tax_return_id", "tax_returns", True),
    ("documents", "uploaded_by", "users", False),
    ("messages", "tax_return_id", "tax_returns", True),
    ("messages", "sender_id", "users", False),
    ("messages", "recipient_id", "users", False),
    ("payments", "tax_return_id", "tax_returns", True),
    ("payments", "customer_id", "customers", False),
    ("reviews", "customer_id", "customers", False),
    ("reviews", "accountant_id", "accountants", False),
    ("reviews", "tax_return_id", "tax_returns", False),
    ("contact_inquiries", "assigned_to", "users", False),
    ("notifications", "user_id", "users", False),
    ("audit_logs", "user_id", "users", False),
]

# Declared defaults applied by the insert jobs.
DEFAULTS: dict[str, dict[str, str]] = {
    "users": {"role": "customer", "is_verified": "false"},
    "accountants": {"rating": "0.00", "total_reviews": "0", "is_active": "true",
                    "availability_status": "available"},
    "customers": {"country": "United Kingdom", "is_first_time_filer": "false",
                  "preferred_contact_method": "email"},
    "tax_returns": {"status": "pending", "price": DEFAULT_PRICE, "payment_status": "pending"},
    "income_sources": {"tax_deducted": "0.00", "ni_contributions": "0.00"},
    "expenses": {"is_approved": "false"},
    "documents": {"is_processed": "false"},
    "messages": {"is_read": "false", "message_type": "general"},
    "payments": {"currency": "GBP"},
    "reviews": {"is_approved": "false"},
    "contact_inquiries": {"inquiry_type": "general", "status": "new"},
    "notifications": {"notification_type": "info", "is_read": "false"},
    "system_settings": {"is_public": "false"},
}

# Raw schemas of the driver's parquet test tables (read without inference).
_L, _Dbl = T.LongType(), T.DoubleType()
RAW: dict[str, T.StructType] = {
    "region": _struct(("r_regionkey", I), ("r_name", S)),
    "nation": _struct(("n_nationkey", I), ("n_name", S), ("n_regionkey", I)),
    "customer": _struct(("c_custkey", _L), ("c_name", S), ("c_nationkey", I),
                        ("c_acctbal", _Dbl), ("c_mktsegment", S)),
    "supplier": _struct(("s_suppkey", _L), ("s_name", S), ("s_nationkey", I),
                        ("s_acctbal", _Dbl)),
    "part": _struct(("p_partkey", _L), ("p_name", S), ("p_brand", S), ("p_type", S),
                    ("p_size", I), ("p_retailprice", _Dbl)),
    "orders": _struct(("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", S),
                      ("o_totalprice", _Dbl), ("o_orderdate", TS),
                      ("o_orderpriority", S)),
    "lineitem": _struct(("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L),
                        ("l_linenumber", I), ("l_quantity", _Dbl),
                        ("l_extendedprice", _Dbl), ("l_discount", _Dbl), ("l_tax", _Dbl),
                        ("l_returnflag", S), ("l_linestatus", S), ("l_shipdate", TS)),
    "events": _struct(("event_id", _L), ("ts", TS), ("user_id", _L), ("event_type", S),
                      ("value", _Dbl), ("props", S)),
    "documents": _struct(("doc_id", _L), ("text", S), ("lang", S), ("source", S),
                         ("n_chars", _L)),
    "embeddings": _struct(("vec_id", _L), ("embedding", T.ArrayType(T.FloatType())),
                          ("label", I)),
    "pages": _struct(("page_id", _L), ("url", S), ("html", S)),
    "benchmark": _struct(("item_id", _L), ("text", S)),
    "labels": _struct(("doc_id", _L), ("quality", I), ("toxic", I)),
    "conversations": _struct(("conv_id", _L), ("turn", _L), ("role", S), ("text", S)),
}
