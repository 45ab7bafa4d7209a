"""Named queries: data-quality checks and request validation.

The oracles state the declared limits, patterns and messages again, as plain
per-rule ``SELECT ... WHERE`` statements that share nothing with the jobs, so a
wrong limit in the jobs' own tables (``sources.schemas``) shows as a difference.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..sources import schemas as SC
from ..sources.standins import STANDIN_COLUMNS, VIEW_OF, Domain
from .registry import register

S = F.col
PRACTICE = ["tax_returns", "customers", "accountants", "users", "income_sources", "expenses",
            "documents", "messages", "reviews", "contact_inquiries"]
ALL_VIEWS = tuple(VIEW_OF.get(t, t) for t in PRACTICE)
NO_ROWS = ("SELECT CAST(NULL AS VARCHAR) AS table_name, CAST(NULL AS VARCHAR) AS row_key, "
           "CAST(NULL AS VARCHAR) AS column_name, CAST(NULL AS VARCHAR) AS rule, "
           "CAST(NULL AS VARCHAR) AS value WHERE false")


# The declared constraints and request rules, for the columns of
# the stand-ins.
REQUIRED = {"tax_returns": ["id", "tax_year", "status"], "customers": ["id"], "accountants": ["id"],
            "users": ["id", "email", "first_name", "last_name", "role"],
            "income_sources": ["source_type", "gross_income"], "expenses": ["category", "amount", "expense_date"],
            "documents": ["id", "document_type"], "messages": ["id", "message"], "reviews": ["id", "rating"],
            "contact_inquiries": ["id", "subject"]}
LISTED = [("users", "role", "'customer', 'accountant', 'admin'"),
          ("tax_returns", "status", "'pending', 'in_progress', 'review', 'completed', 'filed', 'cancelled'"),
          ("tax_returns", "payment_status", "'pending', 'paid', 'refunded', 'failed'"),
          ("contact_inquiries", "status", "'new', 'in_progress', 'resolved', 'closed'"),
          ("tax_returns", "situation_type", "'self-employed', 'freelancer', 'landlord', 'investor', "
           "'high-earner', 'first-time', 'other'"),
          ("income_sources", "source_type", "'employment', 'self_employment', 'rental', 'dividends', "
           "'interest', 'other'"),
          ("contact_inquiries", "inquiry_type", "'general', 'tax-return', 'account', 'billing', "
           "'technical', 'feedback'")]
BOUNDED = [("users", "email", 255), ("users", "first_name", 100), ("users", "last_name", 100), ("users", "phone", 20),
           ("users", "role", 20), ("customers", "country", 100), ("customers", "employment_status", 50),
           ("tax_returns", "tax_year", 10), ("tax_returns", "status", 20), ("tax_returns", "situation_type", 50),
           ("tax_returns", "payment_status", 20), ("income_sources", "source_type", 50),
           ("expenses", "category", 100), ("documents", "document_type", 50), ("documents", "mime_type", 100),
           ("contact_inquiries", "subject", 255), ("contact_inquiries", "inquiry_type", 50),
           ("contact_inquiries", "status", 20)]
TRIMMED = [("contact_inquiries", "subject", 5, 255), ("users", "first_name", 2, 50), ("users", "last_name", 2, 50)]
KEYS = [("users", "id"), ("users", "email"), ("tax_returns", "id"), ("tax_returns", "customer_id,tax_year"),
        ("customers", "id"), ("accountants", "id"), ("documents", "id"), ("messages", "id"), ("reviews", "id"),
        ("contact_inquiries", "id")]
REFERENCES = [("accountants", "user_id", "users"), ("customers", "user_id", "users"),
              ("tax_returns", "customer_id", "customers"), ("tax_returns", "accountant_id", "accountants"),
              ("income_sources", "tax_return_id", "tax_returns"), ("expenses", "tax_return_id", "tax_returns"),
              ("documents", "tax_return_id", "tax_returns"), ("documents", "uploaded_by", "users"),
              ("messages", "tax_return_id", "tax_returns"), ("messages", "sender_id", "users"),
              ("messages", "recipient_id", "users"), ("reviews", "customer_id", "customers"),
              ("reviews", "tax_return_id", "tax_returns"), ("contact_inquiries", "assigned_to", "users")]
TAX_YEAR = "^[0-9]{4}-[0-9]{2}$"
UK_MOBILE = r"^(\+?44|0)7[0-9]{9}$"
UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
ISO_DATE = r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?)?$"
LOWER_EMAIL = r"^[a-z0-9_.!#$%&'*+/=?^`{|}~-]+@([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z0-9]([a-z0-9-]*[a-z0-9])?$"
BLANKS_AROUND = r"^[\s\x0B]+|[\s\x0B]+$"
SAID = {
    "first_name": "First name must be between 2 and 50 characters",
    "last_name": "Last name must be between 2 and 50 characters",
    "email": "Please provide a valid email",
    "phone": "Please provide a valid UK phone number",
    "subject": "Subject must be between 5 and 255 characters",
    "message": "Message must be between 10 and 2000 characters",
    "role": "Role must be either customer or accountant",
    "tax_year": "Tax year must be in format YYYY-YY (e.g., 2023-24)",
    "situation_type": "Invalid situation type",
    "submission_deadline": "Invalid submission deadline format",
}

# Rules that the stand-ins as they are meet everywhere or nowhere are asked over
# a form of the column that has both: deadlines, of which some are written the
# British way, and user ids, of which the verified users' are UUID text.
DEADLINE_SQL = """(SELECT * REPLACE (CASE WHEN id % 37 = 0 THEN STRFTIME(submission_deadline, '%d/%m/%Y')
  WHEN id % 37 = 1 THEN CAST(submission_deadline AS VARCHAR) || 'T09:30Z'
  ELSE CAST(submission_deadline AS VARCHAR) END AS submission_deadline) FROM tax_returns)"""
USER_ID_SQL = """(SELECT * REPLACE (CASE WHEN is_verified THEN REGEXP_REPLACE(MD5(id),
  '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') ELSE id END AS id) FROM users)"""


def _deadline_texts(returns):
    iso = S("submission_deadline").cast("string")
    return returns.withColumn("submission_deadline", F.when(
        S("id") % 37 == 0, F.date_format("submission_deadline", "dd/MM/yyyy")).when(
        S("id") % 37 == 1, F.concat(iso, F.lit("T09:30Z"))).otherwise(iso))


def _cols(t):
    return STANDIN_COLUMNS[VIEW_OF.get(t, t)]


def _key(t):
    cols = _cols(t)
    return "CAST(id AS VARCHAR)" if "id" in cols else "CAST(tax_return_id AS VARCHAR)"


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _trim(x: str) -> str:
    return f"REGEXP_REPLACE({x}, {_sql_str(BLANKS_AROUND)}, '', 'g')"


def _row_sql(t, col, rule, bad, source=None) -> str:
    return (f"SELECT '{t}' AS table_name, {_key(t)} AS row_key, '{col}' AS column_name, "
            f"'{rule}' AS rule, CAST({col} AS VARCHAR) AS value "
            f"FROM {source or VIEW_OF.get(t, t)} WHERE COALESCE({bad}, false)")


def _union_sql(parts) -> str:
    parts = list(parts)
    return "\nUNION ALL\n".join(parts) if parts else NO_ROWS


def _in_list(vals) -> str:
    return "(" + ", ".join(_sql_str(v) for v in vals) + ")"


NOT_NULL_SQL = _union_sql(_row_sql(t, c, "not_null", f"{c} IS NULL")
                          for t, cols in REQUIRED.items() for c in cols)
ENUM_SQL = _union_sql(_row_sql(t, c, "enum", f"{c} IS NOT NULL AND {c} NOT IN ({v})") for t, c, v in LISTED)
RATING_SQL = _row_sql("reviews", "rating", "range_1_5", "rating < 1 OR rating > 5")
AMOUNT_SQL = _union_sql(_row_sql(t, c, "non_negative", f"{c} < 0") for t, c in (
    ("tax_returns", "total_income"), ("tax_returns", "total_tax_due"),
    ("income_sources", "gross_income"), ("income_sources", "tax_deducted")))
LENGTH_SQL = _union_sql(
    [_row_sql(t, c, "length", f"LENGTH({_trim(c)}) NOT BETWEEN {lo} AND {hi}") for t, c, lo, hi in TRIMMED]
    + [_row_sql(t, c, f"varchar_{n}", f"LENGTH(CAST({c} AS VARCHAR)) > {n}") for t, c, n in BOUNDED])


def _pattern_sql(t, c, rule, pattern, transform="{}", source=None):
    v = transform.format(f"CAST({c} AS VARCHAR)")
    return _row_sql(t, c, rule, f"NOT REGEXP_MATCHES({v}, {_sql_str(pattern)})", source)


def _tables(d: Domain):
    return d.practice_tables()


@register("dq_not_null", views=ALL_VIEWS, oracle=NOT_NULL_SQL)
def dq_not_null(d: Domain):
    """NOT NULL columns that hold NULL (users without a last name here)."""
    return Q.dq_not_null(_tables(d))


@register("dq_enum", views=ALL_VIEWS, oracle=ENUM_SQL)
def dq_enum(d: Domain):
    """Values outside the CHECK lists and the route lists."""
    return Q.dq_enum(_tables(d))


@register("dq_rating_range", views=ALL_VIEWS, oracle=RATING_SQL)
def dq_rating_range(d: Domain):
    return Q.dq_rating_range(_tables(d))


@register("dq_amount_range", views=ALL_VIEWS, oracle=AMOUNT_SQL)
def dq_amount_range(d: Domain):
    return Q.dq_amount_range(_tables(d))


@register("dq_string_length", views=ALL_VIEWS, oracle=LENGTH_SQL)
def dq_string_length(d: Domain):
    return Q.dq_string_length(_tables(d))


@register("dq_tax_year", views=ALL_VIEWS,
          oracle=_pattern_sql("tax_returns", "tax_year", "tax_year_format", TAX_YEAR))
def dq_tax_year(d: Domain):
    return Q.dq_tax_year(_tables(d))


@register("dq_iso_date", views=ALL_VIEWS,
          oracle=_pattern_sql("tax_returns", "submission_deadline", "iso_date",
                              ISO_DATE, source=DEADLINE_SQL))
def dq_iso_date(d: Domain):
    """Deadlines that are not ISO dates, some being written dd/mm/yyyy."""
    return Q.dq_iso_date({"tax_returns": _deadline_texts(d.tax_returns)})


@register("dq_email", views=ALL_VIEWS,
          oracle=_pattern_sql("users", "email", "email_format", LOWER_EMAIL,
                              "LOWER(" + _trim("{}") + ")"))
def dq_email(d: Domain):
    """E-mails that are not well formed (the stand-in names carry a '#')."""
    return Q.dq_email(_tables(d))


@register("dq_uk_phone", views=ALL_VIEWS, oracle=_pattern_sql("users", "phone", "uk_mobile", UK_MOBILE))
def dq_uk_phone(d: Domain):
    """Phone numbers that are not UK mobile numbers (a missing one passes)."""
    return Q.dq_uk_phone(_tables(d))


@register("dq_uuid", views=ALL_VIEWS,
          oracle=_pattern_sql("users", "id", "uuid", UUID, source=USER_ID_SQL))
def dq_uuid(d: Domain):
    """Ids that are not UUID text: those of the users not verified."""
    dashed = F.regexp_replace(F.md5("id"), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return Q.dq_uuid({"users": d.users.withColumn("id", F.when(S("is_verified"), dashed).otherwise(S("id")))})


def _unique_sql(t, key):
    cols = key.split(",")
    value = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)  # NULL when a part is
    return (f"SELECT '{t}' AS table_name, '{key}' AS key_columns, v AS key_value, COUNT(*) AS n "
            f"FROM (SELECT {value} AS v FROM {VIEW_OF.get(t, t)}) WHERE v IS NOT NULL GROUP BY v HAVING COUNT(*) > 1")


UNIQUE_SQL = _union_sql(_unique_sql(t, k) for t, k in KEYS)


@register("dq_unique", views=ALL_VIEWS, oracle=UNIQUE_SQL)
def dq_unique(d: Domain):
    """Duplicate keys (repeated customer / tax year pairs here)."""
    return Q.dq_unique(_tables(d))


FK_SQL = _union_sql(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{parent}' AS parent_table, "
    f"CAST(x.{c} AS VARCHAR) AS value, COUNT(*) AS n_rows FROM {VIEW_OF.get(t, t)} x "
    f"LEFT JOIN (SELECT DISTINCT id AS pid FROM {VIEW_OF.get(parent, parent)}) p ON p.pid = x.{c} "
    f"WHERE x.{c} IS NOT NULL AND p.pid IS NULL GROUP BY x.{c}" for t, c, parent in REFERENCES)


@register("dq_foreign_key", views=ALL_VIEWS, oracle=FK_SQL)
def dq_foreign_key(d: Domain):
    """References without a parent row, per distinct value."""
    return Q.dq_foreign_key(_tables(d))


@register("error_classes", views=ALL_VIEWS, oracle=f"""
SELECT 'not_null' AS rule, '23502' AS sqlstate, 'Required field missing' AS message,
  (SELECT COUNT(*) FROM ({NOT_NULL_SQL}) a) AS violations
UNION ALL
SELECT 'unique', '23505', 'Duplicate entry', (SELECT COUNT(*) FROM ({UNIQUE_SQL}) b)
UNION ALL
SELECT 'foreign_key', '23503', 'Referenced resource not found', (SELECT COUNT(*) FROM ({FK_SQL}) c)""")
def error_classes(d: Domain):
    """Violations per constraint class with the client message of the class."""
    t = _tables(d)
    viol = (Q.dq_not_null(t).select(S("rule"))
            .unionByName(Q.dq_unique(t).select(F.lit("unique").alias("rule")))
            .unionByName(Q.dq_foreign_key(t).select(F.lit("foreign_key").alias("rule"))))
    counts = viol.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))
    return Q.class_counts(counts)


def _errors_text(df):
    return df.select("id", "valid", F.array_join("errors", "; ").alias("errors"))


def _msg_sql(field):
    return _sql_str(SAID[field])


def _errors_sql(rules) -> str:
    """``array_join`` of the failed rules' messages, in order."""
    parts = [f"CASE WHEN NOT COALESCE({ok}, false) THEN {_msg_sql(f)} END" for f, ok in rules]
    return "ARRAY_TO_STRING(LIST_FILTER([" + ", ".join(parts) + "], lambda x: x IS NOT NULL), '; ')"


def _len_sql(c, lo, hi):
    return f"LENGTH({_trim(c)}) BETWEEN {lo} AND {hi}"


EMAIL_OK = f"REGEXP_MATCHES(LOWER({_trim('email')}), {_sql_str(LOWER_EMAIL)})"
INQ_RULES = [("first_name", _len_sql("first_name", 2, 50)), ("last_name", _len_sql("last_name", 2, 50)),
             ("email", EMAIL_OK), ("subject", _len_sql("subject", 5, 255)),
             ("message", _len_sql("message", 10, 2000))]
REG_RULES = [("email", EMAIL_OK), ("first_name", _len_sql("first_name", 2, 50)),
             ("last_name", _len_sql("last_name", 2, 50)),
             ("phone", f"phone IS NULL OR REGEXP_MATCHES(phone, {_sql_str(UK_MOBILE)})"),
             ("role", "role IS NULL OR role IN ('customer', 'accountant')")]
RET_RULES = [("tax_year", f"REGEXP_MATCHES(tax_year, {_sql_str(TAX_YEAR)})"),
             ("situation_type", f"situation_type IN ({LISTED[4][2]})"),
             ("submission_deadline", "submission_deadline IS NULL OR REGEXP_MATCHES("
              f"CAST(submission_deadline AS VARCHAR), {_sql_str(ISO_DATE)})")]


def _valid_sql(errors):
    return f"SELECT id, errors = '' AS valid, errors FROM (SELECT id, {errors} AS errors FROM src)"


@register("validate_inquiries", views=("messages", "users"), oracle=f"""
WITH src AS (
  SELECT m.id, u.first_name, u.last_name, u.email, CONCAT('Message ', CAST(m.seq AS VARCHAR)) AS subject,
    m.message FROM messages m JOIN users u ON m.sender_id = u.id)
{_valid_sql(_errors_sql(INQ_RULES))}""")
def validate_inquiries(d: Domain):
    """Every message re-read as a contact-form submission by its sender."""
    people = d.users.select(S("id").alias("__uid"), "first_name", "last_name", "email")
    src = (d.messages.join(people, S("sender_id") == S("__uid"))
           .select("id", "first_name", "last_name", "email",
                   F.concat(F.lit("Message "), S("seq").cast("string")).alias("subject"),
                   "message"))
    return _errors_text(Q.validate_inquiries(src))


@register("validate_registrations", views=("users",), oracle=f"""
WITH src AS (SELECT * FROM users)
{_valid_sql(_errors_sql(REG_RULES))}""")
def validate_registrations(d: Domain):
    return _errors_text(Q.validate_registrations(d.users))


@register("validate_returns", views=("tax_returns",), oracle=f"""
WITH src AS (SELECT * FROM {DEADLINE_SQL})
{_valid_sql(_errors_sql(RET_RULES))}""")
def validate_returns(d: Domain):
    """Every return re-read as a create request, some with a dd/mm/yyyy deadline."""
    return _errors_text(Q.validate_returns(_deadline_texts(d.tax_returns)))
