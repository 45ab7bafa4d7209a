"""Named queries: change application, derived change batches, new snapshots.

Each change batch is derived from the stand-in tables by a business rule
(e.g. "every return in review is completed by its accountant"), so the work
grows with the tables; the query's result is the whole new state.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as C
from ..sources.standins import AS_OF_EVENTS, AS_OF_RETURNS, Domain
from .registry import register

S = F.col
R = f"TIMESTAMP '{AS_OF_RETURNS}'"
E = f"TIMESTAMP '{AS_OF_EVENTS}'"


def updated_sql(table: str, hit: str, sets: dict[str, str], new_cols: dict[str, str] = (),
                touch: str | None = R, source: str | None = None) -> str:
    """Oracle text: the table with ``sets`` applied where ``hit`` holds."""
    repl = ", ".join(f"CASE WHEN __hit THEN {v} ELSE {k} END AS {k}" for k, v in sets.items())
    extra = [f"CASE WHEN __hit THEN {v} END AS {k}" for k, v in dict(new_cols).items()]
    if touch:
        extra.append(f"CASE WHEN __hit THEN {touch} END AS updated_at")
    cols = "* EXCLUDE (__hit)" + (f" REPLACE ({repl})" if repl else "")
    src = source or f"(SELECT t.*, COALESCE({hit}, false) AS __hit FROM {table} t)"
    return f"SELECT {cols}{''.join(', ' + x for x in extra)} FROM {src} s_"


# -- returns ---------------------------------------------------------------------

def _status_changes(d: Domain):
    tr = d.tax_returns
    by_accountant = tr.filter(S("status") == "review").select(
        "id", F.lit("completed").alias("status"), F.lit("accountant").alias("actor_role"),
        S("accountant_id").alias("actor_accountant_id"))
    invalid = tr.filter(S("status") == "cancelled").select(
        "id", F.lit("archived").alias("status"), F.lit("admin").alias("actor_role"),
        F.lit(None).cast("long").alias("actor_accountant_id"))
    return by_accountant.unionByName(invalid)


STATUS_HIT = "t.status = 'review' AND t.accountant_id IS NOT NULL"


@register("set_status", views=("tax_returns",),
          oracle=updated_sql("tax_returns", STATUS_HIT, {"status": "'completed'"}))
def set_status(d: Domain):
    """Returns in review completed by their accountant; an invalid target
    status (archived) and unassigned returns are rejected."""
    return C.set_status(d.tax_returns, _status_changes(d), AS_OF_RETURNS).state


def _status_sequence(d: Domain):
    """Up to three changes a return, in order; the middle one is invalid."""
    late = d.tax_returns.filter(S("status") == "review").select("id", "accountant_id")
    staff = F.lit(None).cast("long")
    return (late.select("id", F.lit(1).alias("seq"), F.lit("completed").alias("status"),
                        F.lit("accountant").alias("actor_role"), S("accountant_id").alias("actor_accountant_id"))
            .unionByName(late.select("id", F.lit(3).alias("seq"), F.lit("archived").alias("status"),
                                     F.lit("admin").alias("actor_role"), staff.alias("actor_accountant_id")))
            .unionByName(late.filter(S("id") % 2 == 0).select(
                "id", F.lit(2).alias("seq"), F.lit("in_progress").alias("status"),
                F.lit("admin").alias("actor_role"), staff.alias("actor_accountant_id"))))


@register("set_status_sequence", views=("tax_returns",), oracle=f"""
WITH chg AS (
  SELECT t.id, c.seq, c.status FROM tax_returns t, (VALUES (1, 'completed'), (2, 'in_progress'), (3, 'archived')) c(seq, status)
  WHERE t.status = 'review' AND (c.seq <> 2 OR t.id % 2 = 0)
    AND (c.seq <> 1 OR t.accountant_id IS NOT NULL) AND c.status <> 'archived'),
fin AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS back FROM chg)
SELECT t.* REPLACE (COALESCE(f.status, t.status) AS status), CASE WHEN f.id IS NOT NULL THEN {R} END AS updated_at
FROM tax_returns t LEFT JOIN fin f ON f.id = t.id AND f.back = 1""")
def set_status_sequence(d: Domain):
    """Several status changes per return in one batch: the last valid one holds,
    the invalid one after it is refused without hiding it."""
    return C.set_status(d.tax_returns, _status_sequence(d), AS_OF_RETURNS, seq="seq").state


@register("set_status_fates", views=("tax_returns",), oracle="""
WITH late AS (SELECT id, accountant_id FROM tax_returns WHERE status = 'review')
SELECT id, 3 AS seq, 'archived' AS status, 'invalid_status' AS fate FROM late
UNION ALL SELECT id, 1, 'completed', 'not_assigned' FROM late WHERE accountant_id IS NULL
UNION ALL SELECT id, 1, 'completed', 'superseded' FROM late WHERE accountant_id IS NOT NULL AND id % 2 = 0""")
def set_status_fates(d: Domain):
    """What became of the changes of that batch that do not show in the state."""
    got = C.set_status(d.tax_returns, _status_sequence(d), AS_OF_RETURNS, seq="seq")
    return (got.rejects.select("id", "seq", "status", S("reason").alias("fate"))
            .unionByName(got.superseded.select("id", "seq", "status", F.lit("superseded").alias("fate"))))


@register("touch_updated_at", views=("tax_returns",), oracle=f"""
SELECT id, status, updated_at FROM ({updated_sql("tax_returns", STATUS_HIT,
                                                 {"status": "'completed'"})}) x""")
def touch_updated_at(d: Domain):
    """The trigger's effect alone: updated_at is as_of exactly on changed rows."""
    return (C.set_status(d.tax_returns, _status_changes(d), AS_OF_RETURNS).state
            .select("id", "status", "updated_at"))


@register("audit_diff", views=("tax_returns",), oracle=f"""
SELECT 'UPDATE' AS action, 'tax_returns' AS table_name, id AS record_id,
  '{{"status":"review","updated_at":null}}' AS old_values,
  '{{"status":"completed","updated_at":"{AS_OF_RETURNS}"}}' AS new_values
FROM tax_returns t WHERE {STATUS_HIT}""")
def audit_diff(d: Domain):
    """Audit rows between the snapshot before and after the status batch."""
    before = d.tax_returns.withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    after = C.set_status(d.tax_returns, _status_changes(d), AS_OF_RETURNS).state
    return C.audit_diff(before, after, "tax_returns")


@register("assign_accountant", views=("tax_returns", "accountants"), oracle=updated_sql(
    "tax_returns", "", {"accountant_id": "accountant_id", "status": "'in_progress'"},
    source="""(SELECT t.*, COALESCE(t.status = 'pending' AND a.is_active, false) AS __hit
               FROM tax_returns t LEFT JOIN accountants a ON t.accountant_id = a.id)"""))
def assign_accountant(d: Domain):
    """Pending returns confirmed to their accountant (status in_progress);
    inactive or missing accountants are rejected."""
    tr = d.tax_returns
    chg = tr.filter(S("status") == "pending").select("id", "accountant_id")
    return C.assign_accountant(tr, chg, d.accountants, AS_OF_RETURNS).state


@register("set_payment_status", views=("tax_returns",), oracle=updated_sql(
    "tax_returns", "t.payment_status = 'failed'", {"payment_status": "'pending'"}))
def set_payment_status(d: Domain):
    """Failed payments reset to pending; 'chargeback' is not a payment status."""
    tr = d.tax_returns
    chg = (tr.filter(S("payment_status") == "failed")
           .select("id", F.lit("pending").alias("payment_status"))
           .unionByName(tr.filter(S("payment_status") == "refunded")
                        .select("id", F.lit("chargeback").alias("payment_status"))))
    return C.set_payment_status(tr, chg, AS_OF_RETURNS).state


@register("set_calculations", views=("tax_returns", "income_sources"), oracle=updated_sql(
    "tax_returns", "",
    {"total_income": "CAST(inc_total AS DECIMAL(12,2))",
     "total_tax_due": "CAST(inc_tax AS DECIMAL(12,2))"},
    new_cols={"total_refund": "CAST(NULL AS DECIMAL(12,2))"},
    source="""(SELECT t.*, COALESCE(t.status = 'filed' AND i.inc_total IS NOT NULL, false) AS __hit,
                      i.inc_total, i.inc_tax
               FROM tax_returns t LEFT JOIN (SELECT tax_return_id, SUM(gross_income) AS inc_total,
                                                    SUM(tax_deducted) AS inc_tax
                                             FROM income_sources GROUP BY tax_return_id) i
               ON t.id = i.tax_return_id)""").replace(
    "* EXCLUDE (__hit)", "* EXCLUDE (__hit, inc_total, inc_tax)"))
def set_calculations(d: Domain):
    """Filed returns take income and tax due from their income lines; a return
    without income lines is rejected (income required)."""
    tr = d.tax_returns
    inc = (d.income_sources.groupBy("tax_return_id")
           .agg(F.sum("gross_income").alias("total_income"),
                F.sum("tax_deducted").alias("total_tax_due")))
    chg = (tr.filter(S("status") == "filed").select("id")
           .join(inc, S("id") == S("tax_return_id"), "left").drop("tax_return_id"))
    return C.set_calculations(tr, chg, AS_OF_RETURNS).state


@register("mark_filed", views=("tax_returns",), oracle=updated_sql(
    "tax_returns", "t.status = 'completed'", {"status": "'filed'", "filed_date": R},
    new_cols={"hmrc_reference": "CONCAT('HMRC-', CAST(id AS VARCHAR))"}))
def mark_filed(d: Domain):
    """Completed returns filed now with a reference."""
    tr = d.tax_returns
    chg = tr.filter(S("status") == "completed").select(
        "id", F.concat(F.lit("HMRC-"), S("id").cast("string")).alias("hmrc_reference"))
    return C.mark_filed(tr, chg, AS_OF_RETURNS).state


@register("set_notes", views=("tax_returns",), oracle=updated_sql(
    "tax_returns", "t.status = 'review'", {},
    new_cols={"notes": "CONCAT('Review for ', tax_year)"}))
def set_notes(d: Domain):
    tr = d.tax_returns
    chg = tr.filter(S("status") == "review").select(
        "id", F.concat(F.lit("Review for "), S("tax_year")).alias("notes"))
    return C.set_notes(tr, chg, AS_OF_RETURNS).state


@register("insert_returns", views=("tax_returns", "customers"), oracle=f"""
SELECT *, CAST(NULL AS TIMESTAMP) AS updated_at FROM tax_returns
UNION ALL BY NAME
SELECT -id AS id, id AS customer_id, '2001-02' AS tax_year, 'first-time' AS situation_type,
  DATE '2024-01-31' AS submission_deadline, CAST(169.00 AS DECIMAL(10,2)) AS price,
  'pending' AS status, 'pending' AS payment_status, {R} AS created_at, {R} AS updated_at
FROM customers WHERE is_first_time_filer""")
def insert_returns(d: Domain):
    """A 2001-02 return for every first-time filer, with the defaults."""
    new = d.customers.filter(S("is_first_time_filer")).select(
        (-S("id")).alias("id"), S("id").alias("customer_id"), F.lit("2001-02").alias("tax_year"),
        F.lit("first-time").alias("situation_type"),
        F.lit(None).cast("date").alias("submission_deadline"),
        F.lit(None).cast("decimal(10,2)").alias("price"))
    return C.insert_returns(d.tax_returns, new, AS_OF_RETURNS)


@register("create_returns_dedup", views=("tax_returns", "customers"), oracle="""
WITH req AS (
  SELECT id AS seq, customer_id, tax_year FROM tax_returns WHERE status = 'filed'
  UNION ALL SELECT 1000000000 + id, id, '2001-02' FROM customers
  UNION ALL SELECT 2000000000 + id, id, '2001-02' FROM customers WHERE is_first_time_filer)
SELECT r.*, CASE
  WHEN NOT EXISTS (SELECT 1 FROM customers c WHERE c.id = r.customer_id) THEN 'no_customer_profile'
  WHEN EXISTS (SELECT 1 FROM tax_returns t WHERE t.customer_id = r.customer_id AND t.tax_year = r.tax_year)
    THEN 'duplicate_year'
  WHEN r.seq <> (SELECT MIN(r2.seq) FROM req r2 WHERE r2.customer_id = r.customer_id AND r2.tax_year = r.tax_year)
    THEN 'duplicate_in_batch'
  ELSE 'accepted' END AS outcome
FROM req r""")
def create_returns_dedup(d: Domain):
    """Return requests classified: filed years again (duplicate), a new year
    for every customer, and a second request from first-time filers."""
    tr, cu = d.tax_returns, d.customers
    req = (tr.filter(S("status") == "filed").select(S("id").alias("seq"), "customer_id", "tax_year")
           .unionByName(cu.select((F.lit(1_000_000_000) + S("id")).alias("seq"),
                                  S("id").alias("customer_id"), F.lit("2001-02").alias("tax_year")))
           .unionByName(cu.filter(S("is_first_time_filer")).select(
               (F.lit(2_000_000_000) + S("id")).alias("seq"), S("id").alias("customer_id"),
               F.lit("2001-02").alias("tax_year"))))
    return C.create_returns_dedup(tr, req, cu, "seq")


INCOME_TYPE_SQL = """CASE situation_type WHEN 'landlord' THEN 'rental' WHEN 'investor' THEN 'dividends'
  WHEN 'self-employed' THEN 'self_employment' WHEN 'freelancer' THEN 'freelance' ELSE 'employment' END"""


@register("insert_income", views=("tax_returns", "income_sources"), oracle=f"""
SELECT *, CAST(NULL AS VARCHAR) AS employer_name, CAST(NULL AS DECIMAL(12,2)) AS ni_contributions
FROM income_sources
UNION ALL BY NAME
SELECT * FROM (
  SELECT id AS tax_return_id, {INCOME_TYPE_SQL} AS source_type, total_income AS gross_income,
    CAST(NULL AS DECIMAL(12,2)) AS tax_deducted, CAST(NULL AS VARCHAR) AS employer_name,
    CAST(0.00 AS DECIMAL(12,2)) AS ni_contributions, {R} AS created_at
  FROM tax_returns WHERE status = 'pending') n
WHERE source_type <> 'freelance' AND gross_income >= 0""")
def insert_income(d: Domain):
    """One income line per pending return from its situation; 'freelance' is
    not a source type and is rejected; tax deducted left out stays NULL."""
    tr = d.tax_returns
    st = (F.when(S("situation_type") == "landlord", "rental")
          .when(S("situation_type") == "investor", "dividends")
          .when(S("situation_type") == "self-employed", "self_employment")
          .when(S("situation_type") == "freelancer", "freelance").otherwise("employment"))
    new = tr.filter(S("status") == "pending").select(
        S("id").alias("tax_return_id"), st.alias("source_type"),
        S("total_income").alias("gross_income"),
        F.lit(AS_OF_RETURNS).cast("timestamp_ntz").alias("created_at"))
    return C.insert_income(d.income_sources, new).state


# -- inquiries -------------------------------------------------------------------

@register("insert_inquiries", views=("contact_inquiries", "request_log"), oracle=f"""
SELECT * FROM contact_inquiries
UNION ALL BY NAME
SELECT -id AS id, 'general' AS inquiry_type, CONCAT('Failed login from client ', CAST(client AS VARCHAR)) AS subject,
  'new' AS status, {E} AS created_at
FROM request_log WHERE status >= 400""")
def insert_inquiries(d: Domain):
    """Every failed request becomes a new inquiry (type defaults to general)."""
    rl = d.request_log
    new = rl.filter(S("status") >= 400).select(
        (-S("id")).alias("id"),
        F.concat(F.lit("Failed login from client "), S("client").cast("string")).alias("subject"),
        F.lit(None).cast("string").alias("inquiry_type"))
    return C.insert_inquiries(d.inquiries, new, AS_OF_EVENTS)


@register("set_inquiry_status", views=("contact_inquiries",), oracle=updated_sql(
    "contact_inquiries",
    "(t.status = 'new' AND t.assigned_to IS NOT NULL) OR t.status = 'resolved'",
    {"status": "CASE WHEN status = 'new' THEN 'in_progress' ELSE 'closed' END",
     "responded_at": E}, touch=None))
def set_inquiry_status(d: Domain):
    """Assigned new inquiries start, resolved ones close; responded_at = now."""
    ci = d.inquiries
    chg = (ci.filter((S("status") == "new") & S("assigned_to").isNotNull())
           .select("id", F.lit("in_progress").alias("status"))
           .unionByName(ci.filter(S("status") == "resolved")
                        .select("id", F.lit("closed").alias("status"))))
    return C.set_inquiry_status(ci, chg, AS_OF_EVENTS).state


@register("assign_inquiry", views=("contact_inquiries", "users"), oracle="""
WITH asked AS (SELECT id, CASE WHEN id % 8 = 0 THEN 's3' ELSE 's1' END AS who FROM contact_inquiries WHERE status = 'new'),
done AS (SELECT asked.id, who FROM asked JOIN users u ON u.id = asked.who WHERE u.role = 'admin')
SELECT t.* REPLACE (COALESCE(done.who, t.assigned_to) AS assigned_to,
                    CASE WHEN done.id IS NOT NULL THEN 'in_progress' ELSE t.status END AS status)
FROM contact_inquiries t LEFT JOIN done ON done.id = t.id""")
def assign_inquiry(d: Domain):
    """New inquiries handed to user s3 (an admin) or s1 (not one); only admins
    may take inquiries, so the others stay as they were."""
    ci = d.inquiries
    chg = ci.filter(S("status") == "new").select(
        "id", F.when(S("id") % 8 == 0, "s3").otherwise("s1").alias("assigned_to"))
    return C.assign_inquiry(ci, chg, d.users, AS_OF_EVENTS).state


# -- users and accountants ---------------------------------------------------------

@register("update_profile", views=("users",), oracle=updated_sql(
    "users", "t.last_name IS NULL", {"last_name": "'Unknown'"}))
def update_profile(d: Domain):
    """Users without a last name get one; first_name absent (NULL) stays, and
    the batch's e-mail column is not an allowed field."""
    us = d.users
    chg = us.filter(S("last_name").isNull()).select(
        "id", F.lit(None).cast("string").alias("first_name"),
        F.lit("Unknown").alias("last_name"), F.lit("x@example.com").alias("email"))
    return C.update_profile(us, chg, AS_OF_RETURNS).state


@register("update_profile_sequence", views=("users",), oracle=f"""
WITH chg AS (
  SELECT id, 1 AS seq, 'Alpha' AS fn, CAST(NULL AS VARCHAR) AS ln FROM users WHERE last_name IS NULL
  UNION ALL SELECT id, 2, NULL, 'Unknown' FROM users WHERE last_name IS NULL
  UNION ALL SELECT id, 3, 'Beta', NULL FROM users WHERE last_name IS NULL AND is_verified),
seen AS (
  SELECT id, last_value(fn IGNORE NULLS) OVER w AS fn, last_value(ln IGNORE NULLS) OVER w AS ln,
         row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS back
  FROM chg WINDOW w AS (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT u.* REPLACE (COALESCE(s.fn, u.first_name) AS first_name, COALESCE(s.ln, u.last_name) AS last_name),
       CASE WHEN s.id IS NOT NULL THEN {R} END AS updated_at
FROM users u LEFT JOIN seen s ON s.id = u.id AND s.back = 1""")
def update_profile_sequence(d: Domain):
    """First and last name given in different changes of one batch: each column
    keeps the last value that a change gave it."""
    late = d.users.filter(S("last_name").isNull())
    none = F.lit(None).cast("string")
    chg = (late.select("id", F.lit(1).alias("seq"), F.lit("Alpha").alias("first_name"), none.alias("last_name"))
           .unionByName(late.select("id", F.lit(2).alias("seq"), none.alias("first_name"),
                                    F.lit("Unknown").alias("last_name")))
           .unionByName(late.filter("is_verified").select(
               "id", F.lit(3).alias("seq"), F.lit("Beta").alias("first_name"), none.alias("last_name"))))
    return C.update_profile(d.users, chg, AS_OF_RETURNS, seq="seq").state


@register("set_accountant_active", views=("accountants",), oracle=updated_sql(
    "accountants", "t.experience_years < 2", {"is_active": "false"}))
def set_accountant_active(d: Domain):
    ac = d.accountants
    chg = ac.filter(S("experience_years") < 2).select("id", F.lit(False).alias("is_active"))
    return C.set_accountant_active(ac, chg, AS_OF_RETURNS).state


REG_SQL = """
  SELECT event_id AS seq, LOWER(TRIM(CONCAT('Client', CAST(user_id AS VARCHAR), '@Example.com'))) AS email,
    'Client' AS first_name, CAST(user_id AS VARCHAR) AS last_name,
    CASE WHEN value > 200 THEN 'admin' WHEN value > 100 THEN 'accountant' ELSE 'customer' END AS role
  FROM events WHERE event_type = 'signup'
  UNION ALL
  SELECT s_suppkey, LOWER(TRIM(UPPER(CONCAT(LOWER(s_name), '@example.com')))), 'Again', 'Supplier', 'accountant'
  FROM supplier"""


@register("register_users", views=("users",), oracle=f"""
WITH req AS ({REG_SQL}),
fit AS (SELECT seq, email, row_number() OVER (PARTITION BY email ORDER BY seq) AS turn
        FROM req r WHERE role IN ('customer', 'accountant')
          AND email NOT IN (SELECT LOWER(email) FROM users WHERE email IS NOT NULL))
SELECT r.*, CASE WHEN f.turn = 1 THEN 'accepted' WHEN f.turn > 1 THEN 'duplicate_in_batch'
                 WHEN r.role = 'admin' THEN 'invalid_role' ELSE 'email_exists' END AS outcome
FROM req r LEFT JOIN fit f ON f.seq = r.seq AND f.email = r.email""")
def register_users(d: Domain):
    """Sign-up events as registrations plus suppliers registering again:
    admin role refused, existing e-mails refused, repeats in the batch refused."""
    ev = d.raw("events").filter(S("event_type") == "signup")
    req = ev.select(
        S("event_id").alias("seq"),
        F.concat(F.lit("Client"), S("user_id").cast("string"), F.lit("@Example.com")).alias("email"),
        F.lit("Client").alias("first_name"), S("user_id").cast("string").alias("last_name"),
        F.when(S("value") > 200, "admin").when(S("value") > 100, "accountant").alias("role"))
    again = d.raw("supplier").select(
        S("s_suppkey").alias("seq"),
        F.upper(F.concat(F.lower(S("s_name")), F.lit("@example.com"))).alias("email"),
        F.lit("Again").alias("first_name"), F.lit("Supplier").alias("last_name"),
        F.lit("accountant").alias("role"))
    req = req.unionByName(again)
    return C.register_users(d.users, req, AS_OF_RETURNS, "seq").outcomes


@register("verify_users", views=("users", "reviews"), oracle=updated_sql(
    "", "", {"is_verified": "true", "verification_token": "CAST(NULL AS VARCHAR)"},
    source="""(SELECT t.*, COALESCE(t.verification_token IN
                 (SELECT CONCAT('tok-c', CAST(customer_id AS VARCHAR)) FROM reviews), false) AS __hit
               FROM (SELECT u.*, CASE WHEN NOT is_verified THEN CONCAT('tok-', id) END
                     AS verification_token FROM users u) t)"""))
def verify_users(d: Domain):
    """Unverified users hold a token; customers who wrote a review confirm it."""
    us = d.users.withColumn("verification_token",
                            F.when(~S("is_verified"), F.concat(F.lit("tok-"), S("id"))))
    tokens = d.reviews.select(
        F.concat(F.lit("tok-c"), S("customer_id").cast("string")).alias("verification_token"))
    return C.verify_users(us, tokens, AS_OF_RETURNS).state


@register("soft_delete_users", views=("users", "customers", "tax_returns"), oracle=updated_sql(
    "", "", {"email": f"CONCAT(email, '_deleted_', PRINTF('%.6f', EPOCH({R})))",
             "is_verified": "false"},
    source="""(SELECT t.*, t.id IN (SELECT c.user_id FROM customers c WHERE NOT EXISTS
                 (SELECT 1 FROM tax_returns r WHERE r.customer_id = c.id)) AS __hit FROM users t)"""))
def soft_delete_users(d: Domain):
    """Customers who never had a return are soft-deleted by an admin."""
    cu, tr = d.customers, d.tax_returns
    idle = (cu.join(tr.select(S("customer_id").alias("__c")), S("id") == S("__c"), "left_anti")
            .select(S("user_id").alias("id"), F.lit("admin-1").alias("actor_id"),
                    F.lit("admin").alias("actor_role")))
    return C.soft_delete_users(d.users, idle, AS_OF_RETURNS).state


# -- deletes ---------------------------------------------------------------------

DELETE_IDS_SQL = """SELECT id FROM tax_returns WHERE status = 'cancelled' OR (status = 'filed' AND tax_year = '1995-96')"""


def _left_and_gone_sql(tables: dict[str, tuple[str, str]], gone: dict[str, str], blocked: str) -> str:
    """Rows left per table, each deleted row by its key, and what is blocked.

    ``tables``: name -> (view, key); ``gone``: name -> condition of a deleted row.
    """
    parts = []
    for name, (view, key) in tables.items():
        cond = gone.get(name, "false")
        parts.append(f"SELECT '{name}' AS table_name, CAST(NULL AS VARCHAR) AS record_id, 'left' AS outcome, "
                     f"COUNT(*) AS n_rows FROM {view} WHERE NOT COALESCE({cond}, false)")
        if name in gone:
            parts.append(f"SELECT '{name}', CAST({key} AS VARCHAR), 'deleted', COUNT(*) FROM {view} "
                         f"WHERE {cond} GROUP BY {key}")
    return "\nUNION ALL ".join(parts + [blocked])


def _left_and_gone(done: C.Deletion, root: str):
    """The same rows from a :class:`Deletion`."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(t).alias("table_name"), F.lit(None).cast("string").alias("record_id"),
                     F.lit("left").alias("outcome"), "n_rows") for t, df in done.state.items()]
    parts.append(done.gone.groupBy("table_name", "record_id").agg(F.count(F.lit(1)).alias("n_rows"))
                 .select("table_name", "record_id", F.lit("deleted").alias("outcome"), "n_rows"))
    parts.append(done.blocked.select(
        F.lit(root).alias("table_name"), S("root_id").cast("string").alias("record_id"),
        F.concat(F.lit("blocked by "), S("blocked_by")).alias("outcome"),
        F.lit(1).cast("bigint").alias("n_rows")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


OF_RETURN = {"income_sources": ("income_sources", "tax_return_id"), "expenses": ("expenses", "tax_return_id"),
             "documents": ("documents_meta", "id"), "messages": ("messages", "id")}


@register("delete_returns", views=("tax_returns", "reviews", "income_sources", "expenses",
                                   "documents_meta", "messages"), oracle=f"""
WITH req AS ({DELETE_IDS_SQL}),
blocked AS (SELECT id FROM req WHERE id IN (SELECT tax_return_id FROM reviews)),
go AS (SELECT id FROM req WHERE id NOT IN (SELECT id FROM blocked))
""" + _left_and_gone_sql(
    {"tax_returns": ("tax_returns", "id"), "reviews": ("reviews", "id"), **OF_RETURN},
    {"tax_returns": "id IN (SELECT id FROM go)",
     **{t: "tax_return_id IN (SELECT id FROM go)" for t in OF_RETURN}},
    "SELECT 'tax_returns', CAST(id AS VARCHAR), 'blocked by reviews.tax_return_id', 1 FROM blocked"))
def delete_returns(d: Domain):
    """Cancelled returns and the filed 1995-96 ones are deleted with their
    children; returns that have reviews are blocked.  Every deleted row by its
    key, every blocked return, and the rows left per table."""
    tr = d.tax_returns
    ids = tr.filter((S("status") == "cancelled")
                    | ((S("status") == "filed") & (S("tax_year") == "1995-96"))).select("id")
    tables = {"tax_returns": tr, "reviews": d.reviews, "income_sources": d.income_sources,
              "expenses": d.expenses, "documents": d.documents, "messages": d.messages}
    return _left_and_gone(C.delete_rows(tables, "tax_returns", ids), "tax_returns")


CASCADE_SQL = """
WITH req AS (SELECT id AS uid FROM users WHERE NOT is_verified),
cu AS (SELECT c.id AS cid, c.user_id AS uid FROM customers c JOIN req ON c.user_id = req.uid),
ac AS (SELECT a.id AS aid, a.user_id AS uid FROM accountants a JOIN req ON a.user_id = req.uid),
rt AS (SELECT t.id AS rid, cu.uid FROM tax_returns t JOIN cu ON t.customer_id = cu.cid),
blk AS (
  SELECT DISTINCT ac.uid, 'tax_returns.accountant_id' AS ref FROM tax_returns t JOIN ac ON t.accountant_id = ac.aid
          WHERE NOT EXISTS (SELECT 1 FROM rt WHERE rt.rid = t.id AND rt.uid = ac.uid)
  UNION SELECT dm.uploaded_by, 'documents.uploaded_by' FROM documents_meta dm WHERE dm.uploaded_by IN (SELECT uid FROM req)
          AND NOT EXISTS (SELECT 1 FROM rt WHERE rt.rid = dm.tax_return_id AND rt.uid = dm.uploaded_by)
  UNION SELECT p.sender_id, 'messages.sender_id' FROM messages p WHERE p.sender_id IN (SELECT uid FROM req)
          AND NOT EXISTS (SELECT 1 FROM rt WHERE rt.rid = p.tax_return_id AND rt.uid = p.sender_id)
  UNION SELECT p.recipient_id, 'messages.recipient_id' FROM messages p WHERE p.recipient_id IN (SELECT uid FROM req)
          AND NOT EXISTS (SELECT 1 FROM rt WHERE rt.rid = p.tax_return_id AND rt.uid = p.recipient_id)
  UNION SELECT DISTINCT cu.uid, 'reviews.customer_id' FROM reviews r JOIN cu ON r.customer_id = cu.cid
  UNION SELECT DISTINCT rt.uid, 'reviews.tax_return_id' FROM reviews r JOIN rt ON r.tax_return_id = rt.rid
  UNION SELECT DISTINCT req.uid, 'contact_inquiries.assigned_to' FROM contact_inquiries ci JOIN req ON ci.assigned_to = req.uid),
go AS (SELECT uid FROM req WHERE uid NOT IN (SELECT uid FROM blk)),
go_r AS (SELECT rid FROM rt WHERE uid IN (SELECT uid FROM go))
""" + _left_and_gone_sql(
    {"users": ("users", "id"), "customers": ("customers", "id"), "accountants": ("accountants", "id"),
     "tax_returns": ("tax_returns", "id"), "reviews": ("reviews", "id"),
     "contact_inquiries": ("contact_inquiries", "id"), **OF_RETURN},
    {"users": "id IN (SELECT uid FROM go)", "customers": "user_id IN (SELECT uid FROM go)",
     "accountants": "user_id IN (SELECT uid FROM go)", "tax_returns": "id IN (SELECT rid FROM go_r)",
     **{t: "tax_return_id IN (SELECT rid FROM go_r)" for t in OF_RETURN}},
    "SELECT 'users', CAST(uid AS VARCHAR), 'blocked by ' || ref, 1 FROM blk")


@register("cascade_users", views=("users", "customers", "accountants", "tax_returns", "reviews",
                                  "income_sources", "expenses", "documents_meta", "messages",
                                  "contact_inquiries"), oracle=CASCADE_SQL)
def cascade_users(d: Domain):
    """Delete every unverified user with the foreign-key rules: profiles,
    returns and their children cascade; users still referenced through a
    non-cascading key are blocked.  Every deleted row by its key, every block
    with the reference behind it, and the rows left per table."""
    tables = {"users": d.users, "customers": d.customers, "accountants": d.accountants,
              "tax_returns": d.tax_returns, "reviews": d.reviews,
              "income_sources": d.income_sources, "expenses": d.expenses,
              "documents": d.documents, "messages": d.messages,
              "contact_inquiries": d.inquiries}
    req = d.users.filter(~S("is_verified")).select("id")
    return _left_and_gone(C.delete_rows(tables, "users", req), "users")
