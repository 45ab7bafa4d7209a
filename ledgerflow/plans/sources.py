"""Named queries: declared-schema scans and the upload policy."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import scratch_folder
from ..sources import schemas as SC
from ..sources import sinks, tables
from ..sources.uploads import upload_manifest as _manifest
from ..sources.standins import Domain
from .registry import register

S = F.col


@register("scan_table", oracle="SELECT * FROM orders")
def scan_table(d: Domain):
    """A table read with its declared schema (no inference, no sampling)."""
    return d.raw("orders")


def _scratch(d: Domain) -> str:
    """A new folder beside the session's checkpoints, which all executors share; it goes with the driver."""
    return f"{scratch_folder(d.spark)}/{uuid.uuid4().hex}"


@register("write_table", views=("tax_returns",), oracle="""
SELECT id, customer_id AS "customerId", accountant_id AS "accountantId", tax_year AS "taxYear",
  status, situation_type AS "situationType", total_income AS "totalIncome",
  total_tax_due AS "totalTaxDue", submission_deadline AS "submissionDeadline",
  filed_date AS "filedDate", price, payment_status AS "paymentStatus", created_at AS "createdAt"
FROM tax_returns""")
def write_table(d: Domain):
    """Returns written in client form, partitioned by tax year, and read back."""
    path = _scratch(d)
    sinks.write(d.tax_returns, path, partition_cols=["tax_year"], client_form=True)
    back = d.spark.read.parquet(path)
    return back.withColumn("taxYear", S("taxYear").cast("string"))


@register("declared_scan", views=("tax_returns",), oracle="""
SELECT CAST(id AS VARCHAR) AS id, CAST(customer_id AS VARCHAR) AS customer_id, CAST(accountant_id AS VARCHAR) AS accountant_id,
  tax_year, status, total_income, CAST(NULL AS VARCHAR) AS hmrc_reference, price, created_at
FROM tax_returns WHERE status = 'filed'""")
def declared_scan(d: Domain):
    """A practice table read with its declared schema: columns it lacks are NULL,
    the filter and the column list reach the scan."""
    base = _scratch(d)
    have = {f.name: S(f.name).cast(f.dataType).alias(f.name) for f in SC.TABLES["tax_returns"].fields
            if f.name in d.tax_returns.columns}
    sinks.write(d.tax_returns.select(*have.values()), f"{base}/tax_returns")
    got = tables.load(d.spark, base, "tax_returns").filter(S("status") == "filed")
    return got.select("id", "customer_id", "accountant_id", "tax_year", "status", "total_income",
                      "hmrc_reference", "price", "created_at")


def _in(vals):
    return "(" + ", ".join(f"'{v}'" for v in vals) + ")"


@register("upload_manifest", views=("documents_meta",), oracle=f"""
WITH f AS (
  SELECT tax_return_id AS batch_id, id AS file_id, CONCAT(document_type, '.', mime_type) AS file_name,
    file_size AS size FROM documents_meta),
g AS (
  SELECT f.*, LOWER(REGEXP_EXTRACT(REGEXP_EXTRACT(file_name, '([^/\\\\]*)$', 1), '^.+\\.([^.]*)$', 1)) AS ext
  FROM f),
h AS (
  SELECT g.*, CASE WHEN ext NOT IN {_in(SC.ALLOWED_UPLOAD_TYPES)} THEN 'file_type_not_allowed'
                   WHEN size > {SC.MAX_UPLOAD_BYTES} THEN 'file_too_large' END AS file_reason
  FROM g),
b AS (SELECT batch_id AS b, COUNT(*) AS n, COUNT(file_reason) AS bad FROM h GROUP BY batch_id),
r AS (
  SELECT h.*, CASE WHEN b.n > {SC.MAX_UPLOAD_FILES} THEN 'too_many_files'
                   WHEN h.file_reason IS NOT NULL THEN h.file_reason
                   WHEN b.bad > 0 THEN 'batch_rejected' END AS reason
  FROM h JOIN b ON h.batch_id = b.b)
SELECT batch_id, file_id, file_name, ext, size, 'other' AS document_type, reason IS NULL AS accepted, reason
FROM r""")
def upload_manifest(d: Domain):
    """Document rows read as an upload: one batch per return, file name from
    source and language; the policy's type, size and count rules."""
    dm = d.documents
    files = dm.select(S("tax_return_id").alias("batch_id"), S("id").alias("file_id"),
                      F.concat(S("document_type"), F.lit("."), S("mime_type")).alias("file_name"),
                      S("file_size").alias("size"))
    return _manifest(files)
