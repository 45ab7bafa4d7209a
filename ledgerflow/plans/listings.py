"""Named queries: filters, projections, joined views, paging, the activity feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as FL
from ..operators import joins as J
from ..operators import paging as P
from ..operators import setops as SO
from ..sources.standins import AS_OF_RETURNS, EVENT_SHIFT_DAYS, Domain
from .registry import register

R = f"TIMESTAMP '{AS_OF_RETURNS}'"

# the return with the people behind it: customer required, accountant optional
PARTIES_SQL = """
FROM tax_returns r
JOIN (SELECT customers.id AS cid, u.* FROM customers, users u WHERE u.id = customers.user_id) payer
  ON payer.cid = r.customer_id
LEFT JOIN (SELECT accountants.id AS aid, experience_years, u.* EXCLUDE (id)
           FROM accountants LEFT JOIN users u ON u.id = user_id) expert
  ON expert.aid = r.accountant_id"""


def _named(alias: str) -> str:
    return f"COALESCE({alias}.first_name, '') || ' ' || COALESCE({alias}.last_name, '')"


SUMMARY_SQL = f"""
SELECT r.id, r.tax_year, r.status, r.created_at, {_named("payer")} AS customer_name,
  payer.email AS customer_email, {_named("expert")} AS accountant_name,
  r.total_income, r.total_tax_due, r.price, r.payment_status
{PARTIES_SQL}"""
LISTING_SQL = f"""
SELECT r.*, {_named("payer")} AS customer_name, payer.email AS customer_email,
  {_named("expert")} AS accountant_name, expert.email AS accountant_email
{PARTIES_SQL}"""
PARTY_VIEWS = ("tax_returns", "customers", "users", "accountants")


# -- 2.2 filters and projections ---------------------------------------------------

@register("filter_returns", views=("tax_returns",), oracle="""
SELECT * FROM tax_returns WHERE status = 'filed' AND tax_year = '1996-97'""")
def filter_returns(d: Domain):
    return FL.filter_eq(d.tax_returns, {"status": "filed", "tax_year": "1996-97",
                                        "payment_status": "all"})


@register("filter_users", views=("users",), oracle="""
SELECT * FROM users WHERE role = 'customer' AND is_verified = true""")
def filter_users(d: Domain):
    return FL.filter_users(d.users, role="customer", is_verified="true")


@register("filter_inquiries", views=("contact_inquiries",), oracle="""
SELECT * FROM contact_inquiries WHERE status = 'resolved' AND inquiry_type = 'error'""")
def filter_inquiries(d: Domain):
    return FL.filter_eq(d.inquiries, {"status": "resolved", "inquiry_type": "error"})


@register("search_users", views=("users",), oracle="""
SELECT * FROM users
WHERE first_name ILIKE '%0_12%' OR last_name ILIKE '%0_12%' OR email ILIKE '%0_12%'""")
def search_users(d: Domain):
    """Substring search; ``_`` in the text stays a one-character wildcard."""
    return FL.search(d.users, ["first_name", "last_name", "email"], "0_12")


@register("lookup_return", views=("tax_returns", "reviews"), oracle="""
SELECT * FROM tax_returns WHERE id IN (SELECT tax_return_id FROM reviews WHERE rating = 5)""")
def lookup_return(d: Domain):
    """Returns looked up by a derived key set (semi join)."""
    keys = d.reviews.filter(F.col("rating") == 5).select("tax_return_id")
    return FL.lookup(d.tax_returns, "id", keys)


@register("returns_by_customer", views=("tax_returns",), oracle="""
SELECT * FROM tax_returns
QUALIFY ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY created_at DESC NULLS FIRST, id) <= 3""")
def returns_by_customer(d: Domain):
    """Every customer's three newest returns (the per-customer list, limit 3)."""
    return P.top_per_group(d.tax_returns, "customer_id",
                           [F.col("created_at").desc_nulls_first(), F.col("id")], 3)


@register("returns_by_accountant", views=("tax_returns",), oracle="""
SELECT * FROM tax_returns WHERE accountant_id IS NOT NULL AND status = 'filed'""")
def returns_by_accountant(d: Domain):
    """Every accountant's filed returns, newest first within the accountant."""
    tr = d.tax_returns.filter(F.col("accountant_id").isNotNull())
    return P.ordered(FL.filter_model(tr, {"status": "filed"}), "created_at", "desc",
                     group="accountant_id")


@register("owner_listing", views=("tax_returns",), oracle="""
SELECT * FROM tax_returns WHERE customer_id = (SELECT MIN(customer_id) FROM tax_returns WHERE customer_id > 0)
  AND payment_status = 'paid'""")
def owner_listing(d: Domain):
    """One customer's paid returns, newest first, uncut (the owner's own list)."""
    first = d.tax_returns.filter("customer_id > 0").agg(F.min("customer_id").alias("c")).first()["c"]
    return FL.by_owner(d.tax_returns, "customer_id", first, {"status": None, "payment_status": "paid"})


@register("returns_of_customers", views=("tax_returns",), oracle="""
SELECT * FROM tax_returns WHERE customer_id IS NOT NULL""")
def returns_of_customers(d: Domain):
    """Every customer's whole list, newest first within the customer (no limit)."""
    tr = d.tax_returns.filter(F.col("customer_id").isNotNull())
    return P.ordered(FL.filter_model(tr, {"status": None, "tax_year": ""}), "created_at", "desc",
                     group="customer_id")


@register("live_tokens", views=("contact_inquiries",), oracle="""
SELECT * FROM contact_inquiries WHERE responded_at > TIMESTAMP '2024-01-20 00:00:00'""")
def live_tokens(d: Domain):
    """Rows whose expiry column lies after the clock (NULL drops out)."""
    return FL.not_expired(d.inquiries, "responded_at", "2024-01-20 00:00:00")


@register("active_accountants", views=("accountants",), oracle="""
SELECT * FROM accountants WHERE is_active = true""")
def active_accountants(d: Domain):
    return FL.active(d.accountants)


@register("public_user", views=("users",), oracle="""
SELECT id, email, first_name AS "firstName", last_name AS "lastName", phone, role,
  is_verified AS "isVerified", created_at AS "createdAt" FROM users""")
def public_user(d: Domain):
    return FL.public_user(d.users)


@register("public_return", views=("tax_returns",), oracle="""
SELECT id, customer_id AS "customerId", accountant_id AS "accountantId", tax_year AS "taxYear",
  status, situation_type AS "situationType", total_income AS "totalIncome",
  total_tax_due AS "totalTaxDue", submission_deadline AS "submissionDeadline",
  filed_date AS "filedDate", price, payment_status AS "paymentStatus", created_at AS "createdAt"
FROM tax_returns""")
def public_return(d: Domain):
    return FL.public_return(d.tax_returns)


@register("admin_user_columns", views=("users",), oracle="""
SELECT id, email, first_name, last_name, phone, role, is_verified, created_at FROM users""")
def admin_user_columns(d: Domain):
    return FL.select_cols(d.users, FL.ADMIN_USER_COLUMNS)


# -- 2.3 joins --------------------------------------------------------------------

@register("return_summary", views=PARTY_VIEWS, oracle=SUMMARY_SQL)
def return_summary(d: Domain):
    return J.return_summary(d.tax_returns, d.customers, d.users, d.accountants)


@register("declared_view", views=PARTY_VIEWS, oracle=SUMMARY_SQL)
def declared_view(d: Domain):
    """The summary view registered as a temp view and read back by name."""
    from ..sources.tables import register_views
    names = register_views(d.spark, {"tax_returns": d.tax_returns, "customers": d.customers,
                                     "users": d.users, "accountants": d.accountants},
                           prefix="lf_")
    return d.spark.table(names["tax_return_summary"])


@register("return_full_details", views=PARTY_VIEWS, oracle=f"""
SELECT r.*, {_named("payer")} AS customer_name, payer.email AS customer_email, payer.phone AS customer_phone,
  {_named("expert")} AS accountant_name, expert.email AS accountant_email,
  expert.experience_years AS accountant_experience
{PARTIES_SQL}""")
def return_full_details(d: Domain):
    return J.return_details(d.tax_returns, d.customers, d.users, d.accountants)


@register("return_listing", views=PARTY_VIEWS, oracle=f"{LISTING_SQL} WHERE r.payment_status = 'paid'")
def return_listing(d: Domain):
    return J.return_listing(d.tax_returns, d.customers, d.users, d.accountants,
                            {"status": "all", "payment_status": "paid", "tax_year": "all"})


@register("return_documents", views=("documents_meta", "users"), oracle="""
SELECT dm.*, CONCAT(u.first_name, ' ', u.last_name) AS uploaded_by_name
FROM documents_meta dm JOIN users u ON dm.uploaded_by = u.id""")
def return_documents(d: Domain):
    return J.return_documents(d.documents, d.users)


@register("return_messages", views=("messages", "users"), oracle="""
SELECT m.*, CONCAT(s.first_name, ' ', s.last_name) AS sender_name,
  CONCAT(r.first_name, ' ', r.last_name) AS recipient_name
FROM messages m JOIN users s ON m.sender_id = s.id JOIN users r ON m.recipient_id = r.id""")
def return_messages(d: Domain):
    return J.return_messages(d.messages, d.users)


@register("document_owner", views=("documents_meta", "tax_returns"), oracle="""
SELECT dm.id, dm.tax_return_id, dm.uploaded_by, tr.customer_id, tr.accountant_id
FROM documents_meta dm JOIN tax_returns tr ON dm.tax_return_id = tr.id""")
def document_owner(d: Domain):
    return J.document_owner(d.documents, d.tax_returns)


@register("return_parties", views=("tax_returns", "customers", "accountants"), oracle="""
SELECT tr.id, tr.customer_id, tr.accountant_id, c.user_id AS customer_user_id,
  a.user_id AS accountant_user_id
FROM tax_returns tr LEFT JOIN customers c ON tr.customer_id = c.id
LEFT JOIN accountants a ON tr.accountant_id = a.id""")
def return_parties(d: Domain):
    return J.return_parties(d.tax_returns, d.customers, d.accountants)


@register("customer_profile", views=("users", "customers"), oracle="""
SELECT u.*, c.country, c.employment_status, c.is_first_time_filer
FROM users u LEFT JOIN customers c ON u.id = c.user_id WHERE u.role = 'customer'""")
def customer_profile(d: Domain):
    return J.profile(d.users, d.customers, "customer")


@register("accountant_profile", views=("users", "accountants"), oracle="""
SELECT u.*, a.experience_years, a.rating, a.is_active, a.hourly_rate
FROM users u LEFT JOIN accountants a ON u.id = a.user_id WHERE u.role = 'accountant'""")
def accountant_profile(d: Domain):
    return J.profile(d.users, d.accountants, "accountant")


@register("inquiry_listing", views=("contact_inquiries", "users"), oracle="""
SELECT ci.*, CONCAT(u.first_name, ' ', u.last_name) AS assigned_to_name
FROM contact_inquiries ci LEFT JOIN users u ON ci.assigned_to = u.id
WHERE ci.inquiry_type = 'purchase'""")
def inquiry_listing(d: Domain):
    return J.inquiry_listing(d.inquiries, d.users, {"status": "all", "inquiry_type": "purchase"})


@register("inquiry_detail", views=("contact_inquiries", "users"), oracle="""
SELECT ci.*, CONCAT(u.first_name, ' ', u.last_name) AS assigned_to_name, u.email AS assigned_to_email
FROM contact_inquiries ci LEFT JOIN users u ON ci.assigned_to = u.id""")
def inquiry_detail(d: Domain):
    return J.inquiry_detail(d.inquiries, d.users)


@register("customers_of_users", views=("users", "customers", "accountants"), oracle="""
SELECT u.id AS user_id, u.role, c.id AS customer_id, a.id AS accountant_id
FROM users u LEFT JOIN customers c ON c.user_id = u.id LEFT JOIN accountants a ON a.user_id = u.id""")
def customers_of_users(d: Domain):
    return J.profile_ids(d.users, d.customers, d.accountants)


# -- 2.6 sorts, limits, pages -----------------------------------------------------

@register("page_users", views=("users",), oracle="""
SELECT id, email, first_name, last_name, phone, role, is_verified, created_at FROM users
WHERE role = 'customer'
ORDER BY created_at DESC NULLS FIRST, id LIMIT 20 OFFSET 20""")
def page_users(d: Domain):
    """Second page of customers, newest first, 20 per page."""
    us = FL.select_cols(FL.filter_users(d.users, role="customer", is_verified="all"),
                        FL.ADMIN_USER_COLUMNS)
    return P.page(FL.search(us, ["first_name", "last_name", "email"], ""), "created_at",
                  "DESC", 2, 20, P.USER_SORTS)


@register("page_returns", views=PARTY_VIEWS, oracle=f"""
SELECT * EXCLUDE (place) FROM (
  SELECT x.*, row_number() OVER (ORDER BY created_at DESC NULLS FIRST, id) AS place FROM ({LISTING_SQL}) x
  WHERE x.status = 'filed') WHERE place BETWEEN 41 AND 60""")
def page_returns(d: Domain):
    """Third page of filed returns with party names, newest first."""
    return J.return_listing_page(d.tax_returns, d.customers, d.users, d.accountants,
                                 {"status": "filed"}, "created_at", "DESC", 3, 20,
                                 P.RETURN_SORTS)


@register("page_inquiries", views=("contact_inquiries", "users"), oracle="""
SELECT ci.*, CONCAT(u.first_name, ' ', u.last_name) AS assigned_to_name
FROM contact_inquiries ci LEFT JOIN users u ON ci.assigned_to = u.id
WHERE ci.status = 'new'
ORDER BY ci.created_at DESC NULLS FIRST, ci.id LIMIT 20""")
def page_inquiries(d: Domain):
    return J.inquiry_listing_page(d.inquiries, d.users, {"status": "new", "inquiry_type": "all"},
                                  "created_at", "desc", 1, 20, P.INQUIRY_SORTS)


FEED_SQL = f"""
SELECT type, description, timestamp FROM (
  SELECT 'contact_inquiry' AS type, 'Inquiry: ' || subject AS description,
         created_at - to_days({EVENT_SHIFT_DAYS}) AS timestamp FROM contact_inquiries
  UNION ALL SELECT 'tax_return_created', 'Tax return for ' || tax_year, created_at FROM tax_returns
  UNION ALL SELECT 'user_registration', {_named("users")}, created_at FROM users) happened
WHERE {R} - timestamp <= INTERVAL '7 days'"""


def _shifted_inquiries(d: Domain):
    """Inquiries moved onto the returns' clock (the two test clocks differ)."""
    return d.inquiries.withColumn(
        "created_at", F.col("created_at") - F.expr(f"INTERVAL '{EVENT_SHIFT_DAYS}' DAY"))


@register("recent_activity_top10", views=("users", "tax_returns", "contact_inquiries"),
          oracle=f"""
SELECT * FROM ({FEED_SQL}) f ORDER BY timestamp DESC NULLS FIRST, type, description LIMIT 10""")
def recent_activity_top10(d: Domain):
    return SO.recent_activity(d.users, d.tax_returns, _shifted_inquiries(d), AS_OF_RETURNS, 10)


@register("income_oldest_first", views=("income_sources",), oracle="""
SELECT * FROM income_sources ORDER BY tax_return_id, created_at""")
def income_oldest_first(d: Domain):
    return P.ordered(d.income_sources, "created_at", "asc", group="tax_return_id")


@register("expenses_latest_first", views=("expenses",), oracle="""
SELECT * FROM expenses ORDER BY tax_return_id, expense_date DESC NULLS FIRST""")
def expenses_latest_first(d: Domain):
    return P.ordered(d.expenses, "expense_date", "desc", group="tax_return_id")


# -- 2.7 set operations -----------------------------------------------------------

@register("activity_feed", views=("users", "tax_returns", "contact_inquiries"), oracle=FEED_SQL)
def activity_feed(d: Domain):
    return SO.activity_feed(d.users, d.tax_returns, _shifted_inquiries(d), AS_OF_RETURNS)


