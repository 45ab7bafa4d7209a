"""Stand-in views: the driver's TPC-H-like test tables seen as practice tables.

The test data holds no tax tables, so each practice table is derived from a
driver table by one SQL text.  The same text runs in Spark (driver tables
bound as DataFrame parameters) and in DuckDB (driver tables are views there),
which is what makes the two engines comparable.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import RAW

# The stand-in mapping (shared by both engines).  `{name}` marks
# a driver table.
STANDIN_SQL: dict[str, str] = {
    "tax_returns": """
SELECT o.o_orderkey AS id, CASE WHEN o.o_orderkey % 250 = 9 THEN -o.o_orderkey ELSE o.o_custkey END AS customer_id, l.suppkey AS accountant_id,
  CONCAT(CAST(YEAR(o.o_orderdate) AS STRING), CASE WHEN o.o_orderkey % 300 = 5 THEN '/' ELSE '-' END, LPAD(CAST((YEAR(o.o_orderdate)+1) % 100 AS STRING), 2, '0')) AS tax_year,
  CASE WHEN o.o_orderstatus='F' THEN 'filed'
       WHEN o.o_orderstatus='P' THEN CASE WHEN o.o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'in_progress'
                                          WHEN o.o_orderpriority='3-MEDIUM' THEN 'review' ELSE 'completed' END
       WHEN o.o_orderpriority='5-LOW' THEN 'cancelled' ELSE 'pending' END AS status,
  CASE o.o_orderkey % 7 WHEN 0 THEN 'self-employed' WHEN 1 THEN 'freelancer' WHEN 2 THEN 'landlord' WHEN 3 THEN 'investor'
       WHEN 4 THEN 'high-earner' WHEN 5 THEN 'first-time' ELSE 'other' END AS situation_type,
  CAST(CASE WHEN o.o_orderkey % 400 = 3 THEN -o.o_totalprice ELSE o.o_totalprice END AS DECIMAL(12,2)) AS total_income,
  CAST(CASE WHEN o.o_orderstatus='F' THEN l.tax_amt END AS DECIMAL(12,2)) AS total_tax_due,
  MAKE_DATE(CAST(YEAR(o.o_orderdate)+1 AS INT), 1, 31) AS submission_deadline,
  CASE WHEN o.o_orderstatus='F' THEN o.o_orderdate + (CAST(o.o_orderkey % 600 AS INT) * INTERVAL '1' DAY) END AS filed_date,
  CAST(169 + o.o_orderkey % 50 AS DECIMAL(10,2)) AS price,
  CASE o.o_orderkey % 8 WHEN 0 THEN 'pending' WHEN 1 THEN 'refunded' WHEN 2 THEN 'failed' WHEN 3 THEN 'pending' ELSE 'paid' END AS payment_status,
  o.o_orderdate AS created_at
FROM {orders} o LEFT JOIN (SELECT l_orderkey, MIN(l_suppkey) AS suppkey, SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS tax_amt
                         FROM {lineitem} GROUP BY l_orderkey) l ON o.o_orderkey=l.l_orderkey""",
    "customers": """
SELECT c_custkey AS id, CONCAT('c', CAST(c_custkey AS STRING)) AS user_id, c_nationkey AS country,
  c_mktsegment AS employment_status, c_custkey % 5 = 0 AS is_first_time_filer FROM {customer}""",
    "accountants": """
SELECT s_suppkey AS id, CONCAT('s', CAST(s_suppkey AS STRING)) AS user_id, CAST(s_suppkey % 30 AS INT) AS experience_years,
  CAST((s_suppkey % 11) * 0.5 AS DECIMAL(3,2)) AS rating, s_suppkey % 7 <> 0 AS is_active,
  CAST(50 + s_suppkey % 60 AS DECIMAL(10,2)) AS hourly_rate FROM {supplier}""",
    "users": """
SELECT CONCAT('c', CAST(c_custkey AS STRING)) AS id,
  CASE WHEN c_custkey % 89 = 2 THEN LOWER(c_name) ELSE CONCAT(LOWER(c_name),'@example.com') END AS email, SUBSTRING(c_name,1,8) AS first_name,
  CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 71 = 1 THEN 'X' ELSE SUBSTRING(c_name,10,9) END AS last_name, 'customer' AS role,
  c_custkey % 3 <> 0 AS is_verified, DATE '2001-08-01' - CAST(c_custkey * 7 % 2400 AS INT) AS created_on,
  CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN CONCAT('07', LPAD(CAST(c_custkey AS STRING), 9, '0'))
    WHEN 2 THEN CONCAT('+447', LPAD(CAST(c_custkey AS STRING), 9, '0')) ELSE CONCAT('020 7946 ', CAST(c_custkey AS STRING)) END AS phone FROM {customer}
UNION ALL
SELECT CONCAT('s', CAST(s_suppkey AS STRING)), CONCAT(LOWER(s_name),'@example.com'), SUBSTRING(s_name,1,8), SUBSTRING(s_name,10,9),
  CASE WHEN s_suppkey % 25 = 3 THEN 'admin' ELSE 'accountant' END, s_suppkey % 4 <> 0,
  DATE '2001-08-01' - CAST(s_suppkey * 11 % 2400 AS INT), NULL FROM {supplier}""",
    "income_sources": """
SELECT l_orderkey AS tax_return_id,
  CASE l_returnflag WHEN 'A' THEN 'employment' WHEN 'N' THEN 'rental' ELSE 'dividends' END AS source_type,
  CAST(l_extendedprice AS DECIMAL(12,2)) AS gross_income,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(12,2)) AS tax_deducted,
  l_shipdate AS created_at FROM {lineitem}""",
    "expenses": """
SELECT l_orderkey AS tax_return_id, CASE l_returnflag WHEN 'A' THEN 'travel' WHEN 'N' THEN 'office_costs' ELSE 'professional_fees' END AS category,
  CAST(l_quantity AS DECIMAL(10,2)) AS amount, CAST(l_shipdate AS DATE) AS expense_date, l_linestatus='F' AS is_approved FROM {lineitem}""",
    "documents_meta": """
SELECT x.doc_id AS id, x.tax_return_id,
  CASE WHEN o.o_custkey IS NOT NULL AND x.doc_id % 3 = 0 THEN CONCAT('c', CAST(o.o_custkey AS STRING))
       ELSE CONCAT('c', CAST(x.doc_id % (SELECT COUNT(*) + 5 FROM {customer}) AS STRING)) END AS uploaded_by,
  x.source AS document_type,
  CASE x.doc_id % 6 WHEN 0 THEN x.lang WHEN 1 THEN 'pdf' WHEN 2 THEN 'JPG' WHEN 3 THEN 'docx' ELSE 'png' END AS mime_type,
  CASE WHEN x.doc_id % 50 = 9 THEN x.n_chars + 20000000 ELSE x.n_chars END AS file_size, x.doc_id % 2 = 0 AS is_processed
FROM (SELECT d.*, CASE WHEN d.doc_id % 20 < 7 THEN d.doc_id - d.doc_id % 20 ELSE d.doc_id * 7 END
             % (SELECT MAX(o_orderkey) + 40 FROM {orders}) AS tax_return_id FROM {documents} d) x
LEFT JOIN {orders} o ON o.o_orderkey = x.tax_return_id""",
    "messages": """
SELECT m.conv_id*100+m.turn AS id, m.conv_id AS tax_return_id,
  CASE WHEN m.role='user' THEN m.payer ELSE m.expert END AS sender_id,
  CASE WHEN m.role='user' THEN m.expert ELSE m.payer END AS recipient_id, m.text AS message, m.turn AS seq
FROM (SELECT v.*, CONCAT('c', CAST(v.conv_id % (SELECT COUNT(*) FROM {customer}) + 1 AS STRING)) AS payer,
             CONCAT('s', CAST(v.conv_id % (SELECT COUNT(*) FROM {supplier}) AS STRING)) AS expert FROM {conversations} v) m""",
    "reviews": """
SELECT o_orderkey AS id, o_custkey AS customer_id, o_orderkey AS tax_return_id, CAST(CASE WHEN o_orderkey % 500 = 7 THEN 6 ELSE o_orderkey % 5 + 1 END AS INT) AS rating,
  o_orderkey % 3 <> 0 AS is_approved FROM {orders} WHERE o_orderstatus='F'""",
    "contact_inquiries": """
SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 'general' ELSE event_type END AS inquiry_type, CASE WHEN event_id % 97 = 1 THEN 'Hi' ELSE CONCAT('Question about ', event_type) END AS subject,
  CASE event_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'resolved' ELSE 'closed' END AS status,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE CONCAT('s', CAST(event_id % (SELECT COUNT(*) + 1 FROM {supplier}) AS STRING)) END AS assigned_to, ts AS created_at,
  CASE WHEN event_id % 4 <> 0 THEN ts + (CAST(event_id % 72 AS INT) * INTERVAL '1' HOUR) END AS responded_at FROM {events}""",
    "request_log": """
SELECT event_id AS id, user_id AS client, ts, CASE event_type WHEN 'error' THEN 401 ELSE 200 END AS status FROM {events}""",
}

# Driver tables each stand-in reads.
DEPS: dict[str, list[str]] = {
    "tax_returns": ["orders", "lineitem"],
    "customers": ["customer"],
    "accountants": ["supplier"],
    "users": ["customer", "supplier"],
    "income_sources": ["lineitem"],
    "expenses": ["lineitem"],
    "documents_meta": ["documents", "orders", "customer"],
    "messages": ["conversations", "customer", "supplier"],
    "reviews": ["orders"],
    "contact_inquiries": ["events", "supplier"],
    "request_log": ["events"],
}

# Columns of each stand-in (as both engines produce them).
STANDIN_COLUMNS: dict[str, list[str]] = {
    "tax_returns": ["id", "customer_id", "accountant_id", "tax_year", "status", "situation_type",
                    "total_income", "total_tax_due", "submission_deadline", "filed_date", "price",
                    "payment_status", "created_at"],
    "customers": ["id", "user_id", "country", "employment_status", "is_first_time_filer"],
    "accountants": ["id", "user_id", "experience_years", "rating", "is_active", "hourly_rate"],
    "users": ["id", "email", "first_name", "last_name", "role", "is_verified", "created_on",
              "phone", "created_at"],
    "income_sources": ["tax_return_id", "source_type", "gross_income", "tax_deducted",
                       "created_at"],
    "expenses": ["tax_return_id", "category", "amount", "expense_date", "is_approved"],
    "documents_meta": ["id", "tax_return_id", "uploaded_by", "document_type", "mime_type",
                       "file_size", "is_processed"],
    "messages": ["id", "tax_return_id", "sender_id", "recipient_id", "message", "seq"],
    "reviews": ["id", "customer_id", "tax_return_id", "rating", "is_approved"],
    "contact_inquiries": ["id", "inquiry_type", "subject", "status", "assigned_to", "created_at",
                          "responded_at"],
    "request_log": ["id", "client", "ts", "status"],
}

# Practice table name -> stand-in view name (they differ for documents only).
VIEW_OF = {"documents": "documents_meta"}

# Fixed clocks of the test data: orders end 2001-08-01, events cover January
# 2024.  The activity feed shifts inquiries back by the gap between the two.
AS_OF_RETURNS = "2001-08-02 00:00:00"
AS_OF_EVENTS = "2024-01-31 00:00:00"
EVENT_SHIFT_DAYS = 8217


def duckdb_view_sql(name: str) -> str:
    """The stand-in text with driver tables named as DuckDB views."""
    body = STANDIN_SQL[name].format(**{d: d for d in DEPS[name]})
    if name == "users":
        # users carries a date; queries need created_at as a timestamp
        body = f"SELECT *, CAST(created_on AS TIMESTAMP) AS created_at FROM ({body}) u_"
    return body


def with_views(*names: str) -> str:
    """A ``WITH`` prefix that defines the named stand-ins for DuckDB."""
    parts = [f"{n} AS ({duckdb_view_sql(n)}\n)" for n in names]
    return "WITH " + ",\n".join(parts) + "\n"


class Domain:
    """Lazy access to the driver tables and their stand-in practice views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._raw: dict[str, DataFrame] = {}
        self._views: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = (self.spark.read.schema(RAW[name])
                               .parquet(f"{self.sf_dir}/{name}.parquet"))
        return self._raw[name]

    def view(self, name: str) -> DataFrame:
        if name not in self._views:
            df = self.spark.sql(STANDIN_SQL[name], **{d: self.raw(d) for d in DEPS[name]})
            if name == "users":
                df = df.withColumn("created_at", F.col("created_on").cast("timestamp_ntz"))
            self._views[name] = df
        return self._views[name]

    # convenient attribute names
    @cached_property
    def tax_returns(self) -> DataFrame:
        return self.view("tax_returns")

    @cached_property
    def customers(self) -> DataFrame:
        return self.view("customers")

    @cached_property
    def accountants(self) -> DataFrame:
        return self.view("accountants")

    @cached_property
    def users(self) -> DataFrame:
        return self.view("users")

    @cached_property
    def income_sources(self) -> DataFrame:
        return self.view("income_sources")

    @cached_property
    def expenses(self) -> DataFrame:
        return self.view("expenses")

    @cached_property
    def documents(self) -> DataFrame:
        return self.view("documents_meta")

    @cached_property
    def messages(self) -> DataFrame:
        return self.view("messages")

    @cached_property
    def reviews(self) -> DataFrame:
        return self.view("reviews")

    @cached_property
    def inquiries(self) -> DataFrame:
        return self.view("contact_inquiries")

    @cached_property
    def request_log(self) -> DataFrame:
        return self.view("request_log")

    def practice_tables(self) -> dict[str, DataFrame]:
        """The stand-ins under their practice-table names."""
        names = ["tax_returns", "customers", "accountants", "users", "income_sources",
                 "expenses", "documents", "messages", "reviews", "contact_inquiries"]
        return {n: self.view(VIEW_OF.get(n, n)) for n in names}
