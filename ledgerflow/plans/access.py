"""Named queries: entitlements (who may see or delete what)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access as AC
from ..operators import changes as C
from ..sources.standins import Domain
from .registry import register

S = F.col


@register("visible_returns", views=("users", "customers", "accountants", "tax_returns"), oracle="""
SELECT u.id AS user_id, t.id AS object_id, 'row' AS scope
FROM users u JOIN customers c ON c.user_id = u.id JOIN tax_returns t ON t.customer_id = c.id
WHERE u.role = 'customer'
UNION ALL
SELECT u.id, t.id, 'row'
FROM users u JOIN accountants a ON a.user_id = u.id JOIN tax_returns t ON t.accountant_id = a.id
WHERE u.role = 'accountant'
UNION ALL
SELECT id, NULL, 'all' FROM users WHERE role = 'admin'""")
def visible_returns(d: Domain):
    """(user, return) view grants; admins hold one 'all' grant each."""
    return AC.visible_returns(d.users, d.customers, d.accountants, d.tax_returns)


@register("visible_documents", views=("users", "customers", "accountants", "tax_returns",
                                      "documents_meta"), oracle="""
SELECT DISTINCT * FROM (
  SELECT u.id AS user_id, dm.id AS object_id, 'row' AS scope
  FROM documents_meta dm JOIN tax_returns t ON dm.tax_return_id = t.id
  JOIN customers c ON t.customer_id = c.id JOIN users u ON u.id = c.user_id WHERE u.role = 'customer'
  UNION
  SELECT u.id, dm.id, 'row'
  FROM documents_meta dm JOIN tax_returns t ON dm.tax_return_id = t.id
  JOIN accountants a ON t.accountant_id = a.id JOIN users u ON u.id = a.user_id WHERE u.role = 'accountant')
UNION ALL
SELECT id, NULL, 'all' FROM users WHERE role = 'admin'""")
def visible_documents(d: Domain):
    """(user, document) view grants through the document's return."""
    return AC.visible_documents(d.users, d.customers, d.accountants, d.tax_returns, d.documents,
                                "view")


DOC_REQUESTS_SQL = """
  SELECT dm.id, CONCAT('c', CAST(t.customer_id AS VARCHAR)) AS user_id
  FROM documents_meta dm JOIN tax_returns t ON dm.tax_return_id = t.id"""


def _doc_requests(d: Domain):
    """Each document asked for by its return's customer user."""
    r = d.tax_returns.select(S("id").alias("__rid"), "customer_id")
    return (d.documents.join(r, S("tax_return_id") == S("__rid"))
            .select("id", F.concat(F.lit("c"), S("customer_id").cast("string")).alias("user_id")))


@register("delete_documents", views=("users", "customers", "accountants", "tax_returns",
                                     "documents_meta"), oracle=f"""
WITH req AS ({DOC_REQUESTS_SQL}),
ok AS (
  SELECT r.id FROM req r JOIN users u ON u.id = r.user_id
  JOIN documents_meta dm ON dm.id = r.id JOIN tax_returns t ON dm.tax_return_id = t.id
  LEFT JOIN accountants a ON a.id = t.accountant_id
  WHERE u.role = 'admin' OR dm.uploaded_by = r.user_id OR (u.role = 'accountant' AND a.user_id = r.user_id))
SELECT * FROM documents_meta WHERE id NOT IN (SELECT id FROM ok)""")
def delete_documents(d: Domain):
    """Each return's customer asks to delete its documents: only uploads of
    their own go (a plain customer may not delete others' uploads)."""
    grants = AC.visible_documents(d.users, d.customers, d.accountants, d.tax_returns,
                                  d.documents, "delete")
    return C.delete_documents(d.documents, _doc_requests(d), grants).state


@register("owned_resources", views=("users", "tax_returns", "documents_meta"), oracle=f"""
WITH req AS ({DOC_REQUESTS_SQL})
SELECT r.id, r.user_id, CASE
  WHEN u.role = 'admin' THEN 'allowed'
  WHEN dm.uploaded_by IS NULL THEN 'not_found'
  WHEN dm.uploaded_by = r.user_id THEN 'allowed' ELSE 'denied' END AS outcome
FROM req r LEFT JOIN documents_meta dm ON dm.id = r.id LEFT JOIN users u ON u.id = r.user_id""")
def owned_resources(d: Domain):
    """Owner check (uploader owns a document) with admin bypass."""
    req = _doc_requests(d)
    return AC.owned(req, d.documents, "uploaded_by", d.users, user_col="user_id", res_col="id")
