"""The application's writes as batch jobs: apply a DataFrame of changes.

Form: ``apply_x(current, changes, as_of) -> Applied``.  One helper does the
work for every update rule:

1. every change of the batch is checked on its own (request rules, unknown
   key, rules on the row as stored before the batch), so a refused change
   never hides an accepted one;
2. the accepted changes of a key are folded column by column: the last one
   that gives a column a value wins (``max_by`` on the order column, an
   aggregate with a map-side partial step, so a key changed a million times
   in one batch costs one partial row per task);
3. the folded changes, one row per key, are joined onto the whole table
   (broadcast when the batch measured small, else a shuffle join) and every
   changed row gets ``updated_at = as_of`` (the update trigger's effect).

Every change ends in exactly one place: it shapes the new state, it is
``superseded`` by later accepted changes, or it is in ``rejects``.  Without an
order column a key may have one accepted change only; more are refused.

The result is a new snapshot; ``sources.sinks.write_snapshot`` writes it next
to the old one and swaps, so a path is never overwritten while it is read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import deleted_email, stable_uuid, ts_lit
from ..session import BROADCAST_BYTES, cut_and_measure, cut_for_join, cut_lineage
from ..sources import schemas as SC
from .util import present

S = F.col

# A rule: (reason, predicate that must hold).  Predicates read change columns
# as ``chg_<name>`` and the targeted row as ``cur_<name>``.
Rule = tuple[str, Column]


@dataclass
class Applied:
    state: DataFrame
    rejects: DataFrame
    superseded: DataFrame | None = None  # accepted, but later changes took every column


@dataclass
class Last:
    """A column's new value from the change (``chg_*``); the last one given wins.

    ``when``: whether a change gives the column a value (always, if left out).
    """

    value: Column
    when: Column | None = None


@dataclass
class FromRow:
    """A column's new value from the row's own columns, once it has any accepted change."""

    value: Column


def _chg(df: DataFrame, key: str) -> DataFrame:
    return df.select(S(key).alias("__key"),
                     *[S(x).alias("chg_" + x) for x in df.columns if x != key])


NO_ORDER = "duplicate_key_without_order"


def apply_changes(current: DataFrame, changes: DataFrame, key: str,
                  set_cols: dict[str, Column | Last | FromRow], rules: list[Rule] = (), as_of=None,
                  touch: bool = True, seq: str | None = None,
                  cur_cols: list[str] | None = None,
                  validations: list[Rule] = (), max_broadcast: int = BROADCAST_BYTES) -> Applied:
    """Apply ``changes`` to ``current`` (rows targeted by ``key``).

    ``set_cols``: column -> ``Last`` or ``FromRow`` (a plain expression over
    ``chg_*`` is ``Last``).  Reject reasons are checked in the order the
    application checks them: ``validations`` (the request alone: role gate,
    field rules), then ``not_found``, then ``rules`` (need the targeted row,
    read as ``cur_<name>``; list those columns in ``cur_cols``).  See
    :data:`Rule`.  ``seq`` orders the changes of a key (ties by their other
    columns).

    The batch is written once to the checkpoint folder and measured there; a
    small one is broadcast, so the table is scanned but never shuffled.
    """
    batch, size = cut_and_measure(_chg(changes, key))
    small = size <= max_broadcast
    wide = F.broadcast if small else (lambda df: df)
    sets = {c: v if isinstance(v, (Last, FromRow)) else Last(v) for c, v in set_cols.items()}
    chg_cols = [x for x in batch.columns if x != "__key"]

    def refuse(df: DataFrame, checks) -> DataFrame:
        reason = F.lit(None).cast("string")
        for name, ok in reversed(list(checks)):
            reason = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(reason)
        return df.withColumn("reason", reason)

    # changes on existing rows, with what the rules read of those rows
    need = sorted(set(cur_cols or []) - {key}) if rules else []
    target = current.select(S(key).alias("__cur_key"), *[S(x).alias("cur_" + x) for x in need])
    asked = refuse(batch, validations)
    found = refuse(target.join(wide(asked.filter(S("reason").isNull()).drop("reason")),
                               S("__key") == S("__cur_key"), "inner").drop("__cur_key"), rules)
    # rules without a row are known from the batch alone; then the join that
    # applies the changes finds the rows too
    accepted = (found if rules else asked).filter(S("reason").isNull()).select("__key", *chg_cols)

    order = F.struct(*[S(x) for x in ([f"chg_{seq}"] if seq else [])
                       + [c for c, t in batch.dtypes if c not in ("__key", f"chg_{seq}")
                          and not t.startswith("map")]])
    if not chg_cols:
        order = F.struct(F.lit(0).alias("one"))
    folds = [F.count(F.lit(1)).alias("__n")]
    for col, v in sets.items():
        if isinstance(v, Last):
            gives = F.lit(True) if v.when is None else F.coalesce(v.when, F.lit(False))
            folds.append(F.max_by(F.struct(v.value.alias("v"), order.alias("o")), F.when(gives, order))
                         .alias("__set_" + col))
    folded = accepted.groupBy("__key").agg(*folds)
    clear = folded if seq else folded.filter(S("__n") == 1)
    j = current.join(wide(clear), S(key) == S("__key"), "left")
    hit = S("__n").isNotNull()

    def new_value(col: str) -> tuple[Column, Column]:
        v = sets[col]
        if isinstance(v, FromRow):
            return hit, v.value
        return S("__set_" + col).isNotNull(), S("__set_" + col)["v"]

    out_cols = []
    for col in current.columns:
        if col in sets:
            given, value = new_value(col)
            out_cols.append(F.when(given, value).otherwise(S(col)).alias(col))
        elif touch and col == "updated_at" and as_of is not None:
            out_cols.append(F.when(hit, ts_lit(as_of)).otherwise(S(col)).alias(col))
        else:
            out_cols.append(S(col))
    for col in sets:
        if col not in current.columns:
            given, value = new_value(col)
            out_cols.append(F.when(given, value).alias(col))
    if touch and as_of is not None and "updated_at" not in current.columns:
        out_cols.append(F.when(hit, ts_lit(as_of)).cast("timestamp_ntz").alias("updated_at"))

    # where every other change went (computed only when asked for)
    def said(df: DataFrame) -> DataFrame:
        return df.select(S("__key").alias(key), "reason", *[S(x).alias(x[4:]) for x in chg_cols])

    known = current.select(S(key).alias("__cur_key"))
    valid = asked.filter(S("reason").isNull())
    missing = valid.join(known, S("__key") == S("__cur_key"), "left_anti").withColumn("reason", F.lit("not_found"))
    rejects = said(asked.filter(S("reason").isNotNull())).unionByName(said(missing))
    if rules:
        rejects = rejects.unionByName(said(found.filter(S("reason").isNotNull())))
    taken = found.filter(S("reason").isNull()).select("__key", *chg_cols)
    if not seq:
        twice = taken.groupBy("__key").count().filter("count > 1").select("__key")
        rejects = rejects.unionByName(said(taken.join(twice, "__key", "left_semi")
                                           .withColumn("reason", F.lit(NO_ORDER))))
        return Applied(j.select(*out_cols), rejects, said(taken.withColumn("reason", F.lit(None).cast("string")))
                       .drop("reason").limit(0))
    last = folded.withColumnRenamed("__key", "__fk")
    lasting = F.lit(False)
    for col, v in sets.items():
        if isinstance(v, Last):
            lasting = lasting | F.coalesce(S("__set_" + col)["o"] == order, F.lit(False))
    if all(isinstance(v, FromRow) for v in sets.values()):
        lasting = F.lit(True)
    over = (taken.join(last, S("__key") == S("__fk")).filter(~lasting)
            .withColumn("reason", F.lit("superseded")))
    return Applied(j.select(*out_cols), rejects, said(over).drop("reason"))


def touch_updated_at(df: DataFrame, changed: Column, as_of) -> DataFrame:
    """``updated_at = as_of`` on changed rows (the BEFORE UPDATE trigger)."""
    old = S("updated_at") if "updated_at" in df.columns else F.lit(None).cast("timestamp_ntz")
    return df.withColumn("updated_at", F.when(changed, ts_lit(as_of)).otherwise(old))


# -- returns ---------------------------------------------------------------------

def _role_gate(changes: DataFrame, roles) -> list[Rule]:
    """The route's role gate, when the batch says who acts (``actor_role``)."""
    if "actor_role" not in changes.columns:
        return []
    return [("forbidden_role", S("chg_actor_role").isin(list(roles)))]


def _assigned_rule(changes: DataFrame) -> tuple[list[Rule], list[str]]:
    """Accountants may act only on the returns assigned to them
    (``actor_accountant_id`` = the acting accountant's profile id)."""
    if "actor_role" not in changes.columns:
        return [], []
    is_acc = S("chg_actor_role") == F.lit("accountant")
    mine = S("chg_actor_accountant_id") == S("cur_accountant_id")
    return [("not_assigned", ~is_acc | mine)], ["accountant_id"]


STAFF = ("accountant", "admin")


def set_status(current: DataFrame, changes: DataFrame, as_of, seq=None) -> Applied:
    """changes: id, status[, actor_role, actor_accountant_id].  Accountants and
    admins only; an accountant only on an assigned return."""
    checks = _role_gate(changes, STAFF) + [
        ("invalid_status", S("chg_status").isin(SC.RETURN_STATUSES))]
    rules, cur = _assigned_rule(changes)
    return apply_changes(current, changes, "id", {"status": S("chg_status")}, rules, as_of,
                         seq=seq, cur_cols=cur, validations=checks)


def assign_accountant(current: DataFrame, changes: DataFrame, accountants: DataFrame,
                      as_of, seq=None) -> Applied:
    """changes: id, accountant_id.  Only active accountants; status becomes
    in_progress whatever it was."""
    act = (accountants.filter(S("is_active") == F.lit(True))
           .select(S("id").alias("__act")).withColumn("__active", F.lit(True)))
    chg = changes.join(act, S("accountant_id") == S("__act"), "left").drop("__act")
    return apply_changes(current, chg, "id",
                         {"accountant_id": S("chg_accountant_id"),
                          "status": F.lit("in_progress")}, [], as_of, seq=seq,
                         validations=_role_gate(changes, ["admin"]) + [
                             ("inactive_accountant", S("chg___active") == F.lit(True))])


def set_payment_status(current: DataFrame, changes: DataFrame, as_of, seq=None) -> Applied:
    return apply_changes(current, changes, "id", {"payment_status": S("chg_payment_status")},
                         [], as_of, seq=seq, validations=[
                             ("invalid_payment_status",
                              S("chg_payment_status").isin(SC.PAYMENT_STATUSES))])


def set_calculations(current: DataFrame, changes: DataFrame, as_of, seq=None) -> Applied:
    """Overwrite income, tax due, refund (a missing value becomes NULL)."""
    def col(name):
        return (S("chg_" + name) if name in changes.columns else F.lit(None)).cast("decimal(12,2)")
    checks = _role_gate(changes, STAFF) + [
        ("income_required", S("chg_total_income").isNotNull()),
        ("negative_amount", (col("total_income") >= 0)
         & F.coalesce(col("total_tax_due") >= 0, F.lit(True))
         & F.coalesce(col("total_refund") >= 0, F.lit(True)))]
    rules, cur = _assigned_rule(changes)
    return apply_changes(current, changes, "id",
                         {"total_income": col("total_income"),
                          "total_tax_due": col("total_tax_due"),
                          "total_refund": col("total_refund")}, rules, as_of, seq=seq,
                         cur_cols=cur, validations=checks)


def mark_filed(current: DataFrame, changes: DataFrame, as_of, seq=None) -> Applied:
    """changes: id, hmrc_reference (required: not NULL, not the empty string;
    blanks count as a value, as the route's check does not trim)."""
    checks = _role_gate(changes, STAFF) + [
        ("reference_required", F.length(S("chg_hmrc_reference")) > 0)]
    rules, cur = _assigned_rule(changes)
    return apply_changes(current, changes, "id",
                         {"status": F.lit("filed"), "filed_date": ts_lit(as_of),
                          "hmrc_reference": S("chg_hmrc_reference")},
                         rules, as_of, seq=seq, cur_cols=cur, validations=checks)


def set_notes(current: DataFrame, changes: DataFrame, as_of, seq=None) -> Applied:
    return apply_changes(current, changes, "id", {"notes": S("chg_notes")}, [], as_of, seq=seq)


def insert_returns(current: DataFrame, new: DataFrame, as_of, batch_id: str | None = None) -> DataFrame:
    """New returns with the declared and route defaults.

    status pending, payment pending, price 169.00 and deadline 2024-01-31
    when not given; created_at / updated_at = as_of.  Rows without an id get
    one from the batch and their place in it (:func:`_named`), so two rows of
    one customer and tax year stay two returns.
    """
    if "id" not in new.columns:
        new = _named(new, "tax_returns", batch_id)
    else:
        given_ids = new.filter(S("id").isNotNull())
        new = given_ids.unionByName(
            _named(new.filter(S("id").isNull()).drop("id"), "tax_returns", batch_id)
            .withColumn("id", S("id").cast(new.schema["id"].dataType)), allowMissingColumns=True)

    def given(name, default: Column):
        return F.coalesce(S(name), default) if name in new.columns else default
    rows = new.select(
        S("id").cast(current.schema["id"].dataType).alias("id"),
        S("customer_id").cast(current.schema["customer_id"].dataType).alias("customer_id"),
        S("tax_year"), S("situation_type"),
        given("submission_deadline", F.lit(SC.DEFAULT_DEADLINE).cast("date"))
        .alias("submission_deadline"),
        given("price", F.lit(SC.DEFAULT_PRICE)).cast("decimal(10,2)").alias("price"),
        F.lit("pending").alias("status"), F.lit("pending").alias("payment_status"),
        ts_lit(as_of).alias("created_at"), ts_lit(as_of).alias("updated_at"))
    wanted = list(dict.fromkeys(current.columns + ["updated_at"]))
    rows = rows.select(*present(rows, wanted))
    base = current if "updated_at" in current.columns else current.withColumn(
        "updated_at", F.lit(None).cast("timestamp_ntz"))
    return base.unionByName(rows, allowMissingColumns=True)


def create_returns_dedup(current: DataFrame, requests: DataFrame, customers: DataFrame,
                         order_col: str = "seq") -> DataFrame:
    """Classify return requests: accepted, or the reason they are refused.

    Refused: no customer profile; a return for (customer, tax_year) already
    exists; an earlier request in the same batch asked for the same pair.
    The duplicate checks are joins on the pair (semi / anti), the in-batch
    rule a ``min`` of the order column per pair (a partial aggregate).
    """
    cust = customers.select(S("id").alias("__cid")).withColumn("__has_profile", F.lit(True))
    existing = (current.select(S("customer_id").alias("__ec"), S("tax_year").alias("__ey"))
                .distinct().withColumn("__exists", F.lit(True)))
    first = (requests.groupBy(S("customer_id").alias("__fc"), S("tax_year").alias("__fy"))
             .agg(F.min(order_col).alias("__first")))
    j = (requests.join(cust, S("customer_id") == S("__cid"), "left")
         .join(existing, (S("customer_id") == S("__ec")) & (S("tax_year") == S("__ey")), "left")
         .join(first, (S("customer_id") == S("__fc")) & (S("tax_year") == S("__fy")), "left"))
    outcome = (F.when(S("__has_profile").isNull(), F.lit("no_customer_profile"))
               .when(S("__exists").isNotNull(), F.lit("duplicate_year"))
               .when(S(order_col) != S("__first"), F.lit("duplicate_in_batch"))
               .otherwise(F.lit("accepted")))
    return j.select(*requests.columns, outcome.alias("outcome"))


def _named(new: DataFrame, table: str, batch_id: str | None) -> DataFrame:
    """New rows with an id of their own, from the batch and their place in it.

    Content cannot name a row: the same line may come twice, in this batch or
    the next.  ``request_seq`` is a row's place where the batch has it; else
    rows are numbered and fixed by a checkpoint, so a retried task cannot
    number them anew.  A batch without an id of its own gets a random one.
    """
    if "request_seq" not in new.columns:
        new = cut_lineage(new.withColumn("request_seq", F.monotonically_increasing_id()))
    batch = batch_id or uuid.uuid4().hex
    return (new.withColumn("id", stable_uuid(F.lit(table), F.lit(batch), S("request_seq")))
            .drop("request_seq"))


def insert_income(current: DataFrame, new: DataFrame, returns: DataFrame | None = None,
                  batch_id: str | None = None) -> Applied:
    """Add income rows: source type in the list, gross >= 0, tax deducted >= 0
    when given.  A missing ``tax_deducted`` is stored as NULL (the insert
    names the column), ``ni_contributions`` takes its 0.00 default.

    With ``returns`` and actor columns (``actor_role``, ``actor_customer_id``,
    ``actor_accountant_id``) the request is also checked after the field
    rules: the return must exist, and a customer must own it, an accountant
    be assigned to it (admins may add to any).
    """
    def opt(name, typ):
        return (S(name) if name in new.columns else F.lit(None)).cast(typ)
    actor_cols = present(new, ["actor_role", "actor_customer_id", "actor_accountant_id"])
    if "id" not in new.columns and "id" in current.columns:
        new = _named(new, "income_sources", batch_id)
    rows = new.select(
        *[S(x) for x in present(new, ["id", "tax_return_id", "source_type", "created_at"])],
        *[S(x) for x in actor_cols],
        opt("gross_income", "decimal(12,2)").alias("gross_income"),
        opt("tax_deducted", "decimal(12,2)").alias("tax_deducted"),
        opt("employer_name", "string").alias("employer_name"),
        F.lit("0.00").cast("decimal(12,2)").alias("ni_contributions"))
    reason = (F.when(~F.coalesce(S("source_type").isin(SC.INCOME_SOURCE_TYPES), F.lit(False)),
                     F.lit("invalid_source_type"))
              .when(~F.coalesce(S("gross_income") >= 0, F.lit(False)), F.lit("invalid_gross_income"))
              .when(S("tax_deducted") < 0, F.lit("invalid_tax_deducted"))
              .when(F.length(F.trim(S("employer_name"))) > 255, F.lit("employer_name_too_long")))
    if returns is not None and "actor_role" in new.columns:
        r = returns.select(S("id").alias("__rid"), S("customer_id").alias("__rc"),
                           S("accountant_id").alias("__ra"))
        rows = rows.join(r, S("tax_return_id") == S("__rid"), "left")
        role = S("actor_role")
        may = ((role == "admin")
               | ((role == "customer") & (S("actor_customer_id") == S("__rc")))
               | ((role == "accountant") & (S("actor_accountant_id") == S("__ra"))))
        reason = (reason.when(S("__rid").isNull(), F.lit("return_not_found"))
                  .when(~F.coalesce(may, F.lit(False)), F.lit("access_denied")))
    rows = rows.withColumn("reason", reason)
    rows = rows.drop(*[c for c in ("__rid", "__rc", "__ra") if c in rows.columns])
    good = rows.filter(S("reason").isNull()).drop("reason", *actor_cols)
    base = current
    for name, typ in (("employer_name", "string"), ("ni_contributions", "decimal(12,2)")):
        if name not in base.columns:
            base = base.withColumn(name, F.lit(None).cast(typ))
    good = good.select(*present(good, base.columns))
    return Applied(base.unionByName(good, allowMissingColumns=True),
                   rows.filter(S("reason").isNotNull()))


# -- inquiries -------------------------------------------------------------------

def insert_inquiries(current: DataFrame, new: DataFrame, as_of, batch_id: str | None = None
                     ) -> DataFrame:
    """New inquiries: type defaults to general, status new, created now.
    Rows without an id get one of their own (see ``_named``)."""
    if "id" not in new.columns and "id" in current.columns:
        new = _named(new, "contact_inquiries", batch_id)
    rows = new.select(
        *[S(x) for x in new.columns if x not in ("inquiry_type", "status", "created_at")],
        F.coalesce(S("inquiry_type") if "inquiry_type" in new.columns else F.lit(None),
                   F.lit("general")).alias("inquiry_type"),
        F.lit("new").alias("status"), ts_lit(as_of).alias("created_at"))
    return current.unionByName(rows.select(*present(rows, current.columns)),
                               allowMissingColumns=True)


def set_inquiry_status(current: DataFrame, changes: DataFrame, as_of, seq=None) -> Applied:
    """Set status; ``responded_at = as_of`` whenever the new status is not new
    (also when it was already set)."""
    return apply_changes(
        current, changes, "id",
        {"status": S("chg_status"),
         "responded_at": Last(ts_lit(as_of), S("chg_status") != F.lit("new"))},
        [], as_of, touch=False, seq=seq,
        validations=_role_gate(changes, ["admin"]) + [
            ("invalid_status", S("chg_status").isin(SC.INQUIRY_STATUSES))])


def assign_inquiry(current: DataFrame, changes: DataFrame, users: DataFrame, as_of,
                   seq=None) -> Applied:
    """changes: id, assigned_to.  The assignee must be an admin; a new inquiry
    becomes in_progress, any other status stays."""
    admins = (users.filter(S("role") == F.lit("admin")).select(S("id").alias("__adm"))
              .withColumn("__is_admin", F.lit(True)))
    chg = changes.join(admins, S("assigned_to") == S("__adm"), "left").drop("__adm")
    return apply_changes(
        current, chg, "id",
        {"assigned_to": S("chg_assigned_to"),
         "status": FromRow(F.when(S("status") == F.lit("new"), F.lit("in_progress"))
                           .otherwise(S("status")))},
        [], as_of, touch=False, seq=seq,
        validations=_role_gate(changes, ["admin"]) + [
            ("invalid_admin_user", S("chg___is_admin") == F.lit(True))])


# -- users, accountants, settings -------------------------------------------------

PROFILE_FIELDS = ["first_name", "last_name", "phone"]


def update_profile(current: DataFrame, changes: DataFrame, as_of, seq=None) -> Applied:
    """Only first name, last name and phone may change; a NULL (absent) field
    keeps its value; any other column in the batch is ignored."""
    allowed = [x for x in PROFILE_FIELDS if x in changes.columns and x in current.columns]
    batch = changes.select("id", *allowed, *([seq] if seq else []))
    return apply_changes(current, batch, "id",
                         {x: Last(S("chg_" + x), S("chg_" + x).isNotNull()) for x in allowed},
                         [], as_of, seq=seq)


def set_accountant_active(current: DataFrame, changes: DataFrame, as_of, seq=None) -> Applied:
    """changes: id, is_active.  A missing flag is stored as NULL, as the
    update passes it through unchecked; unknown ids are rejected."""
    return apply_changes(current, changes, "id", {"is_active": S("chg_is_active")}, [], as_of,
                         seq=seq, validations=_role_gate(changes, ["admin"]))


def set_setting(current: DataFrame, changes: DataFrame, as_of, seq=None) -> Applied:
    """changes: setting_key, setting_value.  Unknown keys are rejected."""
    return apply_changes(current, changes, "setting_key",
                         {"setting_value": S("chg_setting_value")}, [], as_of, seq=seq)


@dataclass
class Registration:
    users: DataFrame        # accepted users
    customers: DataFrame    # one profile row per accepted customer
    accountants: DataFrame  # one profile row per accepted accountant
    outcomes: DataFrame     # every request with 'accepted' or the refusal reason


def register_users(users: DataFrame, requests: DataFrame, as_of, order_col: str = "seq"
                   ) -> Registration:
    """Registrations against the existing users.

    Refused: a role other than customer / accountant, an e-mail that exists
    (compared lower-cased), and a request whose e-mail an earlier request of
    the batch has taken: the first by ``order_col`` among those that pass the
    other checks (a ``min`` per e-mail, a partial aggregate), so a refused
    request never stands in the way.  Role defaults to customer.  Each
    accepted user gets one profile row of its role.
    """
    req = (requests.withColumn("email", F.lower(F.trim(S("email"))))
           .withColumn("role", F.coalesce(S("role"), F.lit("customer"))))
    existing = (users.select(F.lower(S("email")).alias("__em")).distinct()
                .withColumn("__taken", F.lit(True)))
    refused = (F.when(~S("role").isin(SC.REGISTRATION_ROLES), F.lit("invalid_role"))
               .when(S("__taken").isNotNull(), F.lit("email_exists")))
    checked = (req.join(existing, S("email") == S("__em"), "left")
               .withColumn("__refused", refused))
    first = (checked.filter(S("__refused").isNull())
             .groupBy(S("email").alias("__fe")).agg(F.min(order_col).alias("__first")))
    j = checked.join(first, S("email") == S("__fe"), "left")
    outcome = (F.when(S("__refused").isNotNull(), S("__refused"))
               .when(S(order_col) != S("__first"), F.lit("duplicate_in_batch"))
               .otherwise(F.lit("accepted")))
    outcomes = j.select(*req.columns, outcome.alias("outcome"))
    ok = outcomes.filter(S("outcome") == "accepted")
    # e-mails are unique after the checks above: they name the new users
    uid = S("id") if "id" in req.columns else stable_uuid(F.lit("users"), S("email"))
    new_users = ok.select(uid.alias("id"), "email", "first_name", "last_name",
                          *present(ok, ["phone"]), "role",
                          F.lit(False).alias("is_verified"), ts_lit(as_of).alias("created_at"))
    cust = (new_users.filter(S("role") == "customer")
            .select(S("id").alias("user_id"), ts_lit(as_of).alias("created_at")))
    acc = (new_users.filter(S("role") == "accountant")
           .select(S("id").alias("user_id"), F.lit(True).alias("is_active"),
                   ts_lit(as_of).alias("created_at")))
    return Registration(new_users, cust, acc, outcomes)


def verify_users(current: DataFrame, tokens: DataFrame, as_of) -> Applied:
    """tokens: verification_token.  Matching users become verified and their
    token is cleared; unknown tokens are rejected."""
    hits = (current.filter(S("verification_token").isNotNull())
            .join(tokens.select(S("verification_token").alias("__tok")).distinct(),
                  S("verification_token") == S("__tok"), "left_semi")
            .select("id"))
    state = apply_changes(current, hits, "id",
                          {"is_verified": FromRow(F.lit(True)),
                           "verification_token": FromRow(F.lit(None).cast("string"))}, [], as_of).state
    rejects = tokens.join(current.select(S("verification_token").alias("__tok")),
                          S("verification_token") == S("__tok"), "left_anti")
    return Applied(state, rejects)


def soft_delete_users(current: DataFrame, requests: DataFrame, as_of) -> Applied:
    """requests: id, actor_id, actor_role.  Rewrites the e-mail and clears the
    verified flag; an admin cannot delete their own account."""
    return apply_changes(
        current, requests, "id",
        {"email": FromRow(deleted_email(S("email"), as_of)), "is_verified": FromRow(F.lit(False))},
        [("cannot_delete_self",
          ~((S("chg_actor_role") == F.lit("admin")) & (S("chg_actor_id") == S("__key"))))],
        as_of)


# -- deletes ---------------------------------------------------------------------

@dataclass
class Deletion:
    """What a delete of root rows does under the declared foreign keys.

    ``state``: the tables without the deleted rows; ``gone``: (table_name,
    record_id) of every deleted row (rows of tables without an id go by their
    parent's key); ``blocked``: (root_id, blocked_by) of the roots that stay.
    """

    state: dict[str, DataFrame]
    gone: DataFrame
    blocked: DataFrame


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def delete_rows(tables: dict[str, DataFrame], root: str, ids: DataFrame, fks=None) -> Deletion:
    """Delete rows of ``root`` (``ids``: one column) as one statement each.

    ``fks`` are (child, column, parent, cascades) edges, by default the declared
    ones; edges of tables or columns not given are left out.  Cascading edges
    are followed from the asked rows outwards, a frontier of newly reached
    (root, row) pairs at a time, until no frontier is left; a pair is reached
    once, so cycles end.  Only tables that others refer to need their rows
    named; the rest go by the columns that point at named rows.

    A row that refers to a reached row through another edge, and does not go
    with the same root itself, blocks that root: it stays with all that would
    have gone with it.  A row that several roots reach goes if one of them does.

    Each round joins the narrow (key, reference) columns of the children with
    the frontier, which is checkpointed and broadcast only if it measured small.
    NULL references point at nothing; asked ids without a row are ignored.
    """
    edges = [e for e in (fks or SC.FOREIGN_KEYS)
             if e[0] in tables and e[2] in tables and e[1] in tables[e[0]].columns]
    named = {root} | {parent for _, _, parent, _ in edges}

    def text(c: str) -> Column:
        return S(c).cast("string")

    asked = ids.select(S(ids.columns[0]).cast("string").alias("k")).distinct()
    start = (tables[root].select(text("id").alias("k")).join(asked, "k", "left_semi").distinct()
             .select(S("k").alias("uid"), "k"))
    reached: dict[str, list[DataFrame]] = {}
    frontier = {root: cut_for_join(start)}
    while frontier:
        for t, rows in frontier.items():
            reached.setdefault(t, []).append(rows)
        steps: dict[str, list[DataFrame]] = {}
        for child, col, parent, cascades in edges:
            if cascades and child in named and parent in frontier:
                steps.setdefault(child, []).append(
                    tables[child].select(text("id").alias("k"), text(col).alias("__ref"))
                    .join(frontier[parent].select("uid", S("k").alias("__up")), S("__ref") == S("__up"))
                    .select("uid", "k"))
        frontier = {}
        for child, parts in steps.items():
            new = _all(parts)
            if child in reached:
                new = new.join(_all(reached[child]), ["uid", "k"], "left_anti")
            if len(parts) > 1 or child in reached:
                new = new.distinct()
            new, size = cut_and_measure(new)
            if size:
                frontier[child] = F.broadcast(new) if size <= BROADCAST_BYTES else new

    # every reached row with its root, and the references that may block it
    owners = cut_for_join(_all([_all(rows).select(F.lit(t).alias("kind"), "k", "uid")
                                for t, rows in reached.items()]))
    goes_by = {t: [("id", t)] if t in named else
               [(col, parent) for child, col, parent, cascades in edges
                if cascades and child == t and parent in reached] for t in tables}
    width = max(len(x) for x in goes_by.values())
    refs = []
    for t, df in tables.items():
        entries = [F.struct(F.lit(f"{t}.{col}").alias("blocked_by"), F.lit(parent).alias("rkind"),
                            text(col).alias("ref"))
                   for child, col, parent, cascades in edges
                   if child == t and not cascades and parent in reached]
        if entries:
            own = goes_by[t] + [(None, None)] * (width - len(goes_by[t]))
            at = [F.struct(F.lit(parent).cast("string").alias("kind"),
                           (text(col) if col else F.lit(None).cast("string")).alias("k")).alias(f"at{i}")
                  for i, (col, parent) in enumerate(own)]
            refs.append(df.select(F.explode(F.array(*entries)).alias("r"), *at)
                        .select("r.*", *[f"at{i}" for i in range(width)]).filter(S("ref").isNotNull()))
    if refs:
        hits = _all(refs).join(owners, (S("rkind") == S("kind")) & (S("ref") == S("k"))).drop("kind", "k")
        for i in range(width):
            own = owners.select(S("kind").alias("__kind"), S("k").alias("__k"), S("uid").alias("__uid"))
            hits = hits.join(own, (S(f"at{i}.kind") == S("__kind")) & (S(f"at{i}.k") == S("__k"))
                             & (S("uid") == S("__uid")), "left_anti")
        blocked = hits.select("uid", "blocked_by").distinct()
    else:
        blocked = start.select("uid", F.lit("").alias("blocked_by")).limit(0)
    blocked = cut_lineage(blocked)
    stays = blocked.select("uid").distinct()
    doomed = {t: cut_for_join(_all(rows).join(stays, "uid", "left_anti").select("k").distinct())
              for t, rows in reached.items()}

    state, gone = {}, []
    for t, df in tables.items():
        left = df
        for col, parent in goes_by[t]:
            if parent in doomed:
                keys = doomed[parent].select(S("k").cast(df.schema[col].dataType).alias("__k"))
                if t not in named:
                    gone.append(left.join(keys, S(col) == S("__k"), "left_semi")
                                .select(F.lit(t).alias("table_name"),
                                        text("id" if "id" in df.columns else col).alias("record_id")))
                left = left.join(keys, S(col) == S("__k"), "left_anti")
        state[t] = left
    gone += [keys.select(F.lit(t).alias("table_name"), S("k").alias("record_id"))
             for t, keys in doomed.items()]
    root_type = tables[root].schema["id"].dataType
    return Deletion(state, _all(gone), blocked.select(S("uid").cast(root_type).alias("root_id"), "blocked_by"))


def delete_returns(tables: dict[str, DataFrame], ids: DataFrame) -> tuple[dict, DataFrame]:
    """Delete returns and their children; a return with reviews is blocked.

    ``ids``: one column of return ids.  Returns (new tables, blocked ids).
    """
    done = delete_rows(tables, "tax_returns", ids)
    return done.state, done.blocked.select(S("root_id").alias("id")).distinct()


def delete_documents(docs: DataFrame, requests: DataFrame, grants: DataFrame) -> Applied:
    """requests: id (document), user_id (actor); ``grants``: delete grants as
    built by ``access.visible_documents(..., action="delete")``.  Permitted
    rows go, the other requests are rejected."""
    from .access import check_access

    checked = check_access(requests, grants, user_col="user_id", obj_col="id")
    ok = checked.filter(S("allowed")).select(S("id").alias("__del")).distinct()
    rejects = (checked.filter(~S("allowed")).drop("allowed")
               .withColumn("reason", F.lit("access_denied")))
    return Applied(docs.join(ok, S("id") == S("__del"), "left_anti"), rejects)


def cascade_users(tables: dict[str, DataFrame], user_ids: DataFrame
                  ) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete users with the declared foreign-key rules (:func:`delete_rows`).

    Returns (new tables, blocked users with the reference that blocks them).
    """
    done = delete_rows(tables, "users", user_ids)
    return done.state, done.blocked.select(S("root_id").alias("user_id"), "blocked_by")


# -- audit -------------------------------------------------------------------------

def _named_col(name: str) -> Column:
    """The column of just this name, whatever signs it holds."""
    return S("`" + name.replace("`", "``") + "`")


def _row_hash(cols: list[str]) -> Column:
    """96-bit fingerprint of a row's compared columns; NULLs are flagged, so
    (NULL, 1) and (1, NULL) differ."""
    parts = [x for c in map(_named_col, cols) for x in (c, c.isNull())]
    return F.struct(F.xxhash64(*parts).alias("h64"), F.hash(*parts).alias("h32"))


def _padded(df: DataFrame, other: DataFrame, cols: list[str]) -> DataFrame:
    for x in cols:
        if x not in df.columns:
            df = df.withColumn(x, F.lit(None).cast(other.schema[x].dataType))
    return df


def audit_diff(before: DataFrame, after: DataFrame, table: str, key: str = "id",
               cols: list[str] | None = None, typed: bool = False) -> DataFrame:
    """One audit row per inserted, updated or deleted row between snapshots.

    Only (key, row fingerprint) of each snapshot is joined (a full outer join
    of two narrow columns), which finds the inserted, deleted and changed
    keys; the full rows are then fetched for those keys alone (the key set
    is checkpointed and broadcast when it measured small) and turned into JSON objects:
    the whole row for inserts and deletes, the changed columns for updates.

    The objects are JSON text of text values, or with ``typed`` VARIANT values
    that keep numbers, booleans, dates, times and nulls (:mod:`.audit` reads them).
    """
    # a column that one snapshot lacks counts as NULL there
    cols = cols or [x for x in dict.fromkeys(before.columns + after.columns) if x != key]
    before, after = _padded(before, after, cols), _padded(after, before, cols)
    hb = before.select(S(key).alias("__bk"), _row_hash(cols).alias("__bh"))
    ha = after.select(S(key).alias("__ak"), _row_hash(cols).alias("__ah"))
    keys = (hb.join(ha, S("__bk") == S("__ak"), "full_outer")
            .filter(S("__bk").isNull() | S("__ak").isNull() | (S("__bh") != S("__ah")))
            .select(F.coalesce(S("__ak"), S("__bk")).alias("__ck")))
    keys = cut_for_join(keys)
    b = (before.join(keys, S(key) == S("__ck"), "left_semi")
         .select(S(key).alias("__bk"), *[_named_col(x).alias("b_" + x) for x in cols]))
    a = (after.join(keys, S(key) == S("__ck"), "left_semi")
         .select(S(key).alias("__ak"), *[_named_col(x).alias("a_" + x) for x in cols]))
    j = b.join(a, S("__bk") == S("__ak"), "full_outer")
    diff = [~_named_col("b_" + x).eqNullSafe(_named_col("a_" + x)) for x in cols]
    changed = reduce(lambda p, q: p | q, diff)
    action = (F.when(S("__bk").isNull(), F.lit("INSERT"))
              .when(S("__ak").isNull(), F.lit("DELETE"))
              .when(changed, F.lit("UPDATE")))

    def obj(prefix, only_changed):
        entries = []
        for x, d in zip(cols, diff):
            val = _named_col(prefix + x).cast("variant" if typed else "string")
            keep = d if only_changed else F.lit(True)
            entries.append(F.when(keep, F.struct(F.lit(x).alias("k"), val.alias("v"))))
        named = F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))
        return F.to_variant_object(named) if typed else F.to_json(named)

    none = F.lit(None).cast("variant" if typed else "string")
    upd = S("__bk").isNotNull() & S("__ak").isNotNull()
    return (j.withColumn("action", action).filter(S("action").isNotNull())
            .select(S("action"), F.lit(table).alias("table_name"),
                    F.coalesce(S("__ak"), S("__bk")).alias("record_id"),
                    F.when(S("__bk").isNull(), none)
                    .when(upd, obj("b_", True)).otherwise(obj("b_", False)).alias("old_values"),
                    F.when(S("__ak").isNull(), none)
                    .when(upd, obj("a_", True)).otherwise(obj("a_", False)).alias("new_values")))


def create_returns(current: DataFrame, requests: DataFrame, customers: DataFrame, as_of,
                   order_col: str = "seq") -> Applied:
    """The whole create-return request flow as one job.

    Validation split (tax year format, situation type, ISO deadline), then
    the duplicate checks (profile, existing year, repeat in the batch), then
    the insert with defaults.  Rejects carry the outcome and, for invalid
    requests, the validation messages.
    """
    from .quality import validate_returns

    req = requests
    if "submission_deadline" not in req.columns:
        req = req.withColumn("submission_deadline", F.lit(None).cast("date"))
    checked = validate_returns(req)
    valid = checked.filter(S("valid")).drop("valid", "errors")
    invalid = (checked.filter(~S("valid")).drop("valid")
               .withColumn("outcome", F.lit("invalid")))
    outcomes = create_returns_dedup(current, valid, customers, order_col)
    accepted = outcomes.filter(S("outcome") == "accepted").drop("outcome", order_col)
    state = insert_returns(current, accepted, as_of)
    refused = (outcomes.filter(S("outcome") != "accepted")
               .withColumn("errors", F.array().cast("array<string>")))
    return Applied(state, refused.unionByName(invalid, allowMissingColumns=True))
