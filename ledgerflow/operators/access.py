"""Role-based row visibility as entitlement joins.

A user sees a return when they are an admin, its customer, or its assigned
accountant.  Instead of building every (admin, row) pair - a cross product
that grows with admins x rows - admins get one grant row with scope ``all``
and a NULL object id; row grants carry scope ``row``.  Checking a batch of
requests is then two equi-joins: on (user, object) for row grants and on the
user alone for ``all`` grants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

S = F.col

GRANT_COLUMNS = ["user_id", "object_id", "scope"]


def _role_users(us: DataFrame, role: str) -> DataFrame:
    return us.filter(S("role") == F.lit(role)).select(S("id").alias("__uid"))


def _all_grants(us: DataFrame, obj_type) -> DataFrame:
    return _role_users(us, "admin").select(
        S("__uid").alias("user_id"), F.lit(None).cast(obj_type).alias("object_id"),
        F.lit("all").alias("scope"))


def _profile_users(us: DataFrame, profiles: DataFrame, role: str) -> DataFrame:
    """(profile id, user id) of the profiles whose user has the role."""
    return (profiles.select(S("id").alias("__pid"), S("user_id"))
            .join(_role_users(us, role), S("user_id") == S("__uid"), "left_semi"))


def _party_grants(objects: DataFrame, key: str, parties: DataFrame) -> DataFrame:
    """Grants of one kind of party: (object_id, party key) rows joined to its users.

    One narrow join per kind, so the few accountants can be broadcast (by file
    size, or by AQE from the measured size) and their hot keys are never
    shuffled, while the many customers are joined by a shuffle.
    """
    return (objects.filter(S(key).isNotNull()).select("object_id", S(key).alias("__key"))
            .join(parties, S("__key") == S("__pid"))
            .select("user_id", "object_id", F.lit("row").alias("scope")))


def visible_returns(us: DataFrame, cu: DataFrame, ac: DataFrame, tr: DataFrame) -> DataFrame:
    """Grants (user_id, object_id = return id, scope) for viewing returns."""
    objects = tr.select(S("id").alias("object_id"), "customer_id", "accountant_id")
    return (_party_grants(objects, "customer_id", _profile_users(us, cu, "customer"))
            .unionByName(_party_grants(objects, "accountant_id", _profile_users(us, ac, "accountant")))
            .unionByName(_all_grants(us, tr.schema["id"].dataType)))


def visible_documents(us: DataFrame, cu: DataFrame, ac: DataFrame, tr: DataFrame,
                      docs: DataFrame, action: str = "view") -> DataFrame:
    """Grants for documents.

    view:   admin, the return's customer, the return's assigned accountant.
    delete: admin, the uploader (any role), the return's assigned accountant;
            the return's customer alone may not delete.
    A document needs its return (inner join); its parties are then matched
    to users, one join per kind of party.
    """
    ret = tr.select(S("id").alias("__rid"), "customer_id", "accountant_id")
    cols = [S("id").alias("object_id"), S("tax_return_id")]
    cols += [S("uploaded_by")] if "uploaded_by" in docs.columns else []
    objects = docs.select(*cols).join(ret, S("tax_return_id") == S("__rid"))
    rows = _party_grants(objects, "accountant_id", _profile_users(us, ac, "accountant"))
    if action == "delete":
        uploader = us.select(S("id").alias("__pid"), S("id").alias("user_id"))
        rows = rows.unionByName(_party_grants(objects, "uploaded_by", uploader))
    else:
        rows = rows.unionByName(_party_grants(objects, "customer_id", _profile_users(us, cu, "customer")))
    return rows.distinct().unionByName(_all_grants(us, docs.schema["id"].dataType))


def check_access(requests: DataFrame, grants: DataFrame, user_col: str = "user_id",
                 obj_col: str = "object_id") -> DataFrame:
    """Requests with an ``allowed`` flag from row grants or an ``all`` grant.

    Grants are cut to the requested objects before they are made distinct.
    """
    asked = requests.select(S(obj_col).alias("__asked"))
    rows = (grants.filter(S("scope") == "row")
            .select(S("user_id").alias("__gu"), S("object_id").alias("__go"))
            .join(asked, S("__go") == S("__asked"), "left_semi")
            .distinct().withColumn("__row", F.lit(True)))
    every = (grants.filter(S("scope") == "all").select(S("user_id").alias("__au")).distinct()
             .withColumn("__all", F.lit(True)))
    j = (requests.join(rows, (S(user_col) == S("__gu")) & (S(obj_col) == S("__go")), "left")
         .join(every, S(user_col) == S("__au"), "left"))
    allowed = F.coalesce(S("__row"), F.lit(False)) | F.coalesce(S("__all"), F.lit(False))
    return j.select(*requests.columns, allowed.alias("allowed"))


def owned(requests: DataFrame, resources: DataFrame, owner_col: str, us: DataFrame,
          user_col: str = "user_id", res_col: str = "resource_id") -> DataFrame:
    """Generic owner check with admin bypass.

    Outcome per request: ``allowed`` for admins or the owner, ``not_found``
    when the resource has no owner (or does not exist), ``denied`` otherwise.
    """
    own = resources.select(S("id").alias("__res"), S(owner_col).alias("__owner"))
    roles = us.select(S("id").alias("__u"), S("role").alias("__role"))
    j = (requests.join(own, S(res_col) == S("__res"), "left")
         .join(roles, S(user_col) == S("__u"), "left"))
    outcome = (F.when(S("__role") == "admin", F.lit("allowed"))
               .when(S("__owner").isNull(), F.lit("not_found"))
               .when(S("__owner") == S(user_col), F.lit("allowed"))
               .otherwise(F.lit("denied")))
    return j.select(*requests.columns, outcome.alias("outcome"))
