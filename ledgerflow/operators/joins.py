"""Joined views: returns with their parties, documents, messages, profiles.

All joins are equi-joins, inner or left outer.  The person tables are reduced
to the few columns a view needs (and renamed) *before* joining, the fact table
(returns, documents, messages) is joined once per dimension, and names are
built after the joins so a missing party still gives the database's ``' '``.

Dimension sides go through a size check: a side proven small is broadcast;
otherwise the join shuffles, with unassigned (NULL-key) rows routed around the
shuffle so they cannot pile up in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import full_name
from ..session import BROADCAST_BYTES, cut_and_measure, cut_lineage
from .filters import SECRET_USER_COLUMNS, filter_eq, lookup
from .util import left_join_split_nulls, pg_order, present, salted_join

S = F.col


def _people(us: DataFrame, prefix: str, extra=("email", "phone")) -> DataFrame:
    """Users reduced to id, name parts and ``extra`` columns, all prefixed."""
    cols = ["first_name", "last_name", *present(us, extra)]
    return us.select(S("id").alias(f"{prefix}uid"),
                     *[S(x).alias(prefix + x) for x in cols])


def dim_join(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str,
             how: str = "left") -> DataFrame:
    """Join a fact to a dimension.

    The planner broadcasts the dimension when its files are small, AQE when its
    shuffle stage measured small; otherwise both sides shuffle, AQE splits
    skewed partitions, and a left join keeps NULL fact keys off one task.
    """
    if how == "left":
        return left_join_split_nulls(fact, dim, fact_key, dim_key)
    return fact.join(dim, S(fact_key) == S(dim_key), how)


def customer_dim(cu: DataFrame, us: DataFrame) -> DataFrame:
    """customer id -> the customer's user (inner: customers without user drop)."""
    people = _people(us, "cu_")
    return (cu.select(S("id").alias("cu_id"), S("user_id").alias("cu_user_id"))
            .join(people, S("cu_user_id") == S("cu_uid"), "inner")
            .drop("cu_uid", "cu_user_id"))


def accountant_dim(ac: DataFrame, us: DataFrame) -> DataFrame:
    """accountant id -> the accountant's user (left: user may be missing).

    Users are cut to the accountants' first (a semi join on the few
    accountants), so the users table is not sorted for them.
    """
    ids = ac.select(S("user_id").alias("__au"))
    people = _people(us.join(ids, S("id") == S("__au"), "left_semi"), "ac_")
    acc = ac.select(S("id").alias("ac_id"), S("user_id").alias("ac_user_id"),
                    *[S(x).alias("ac_" + x) for x in present(ac, ["qualification",
                                                                   "experience_years"])])
    return (acc.join(people, S("ac_user_id") == S("ac_uid"), "left")
            .drop("ac_uid", "ac_user_id"))


def _with_parties(tr: DataFrame, cu: DataFrame, us: DataFrame, ac: DataFrame,
                  salt_buckets: int = 0) -> DataFrame:
    """Returns with their customer's user (inner) and accountant's user (left).

    ``salt_buckets`` > 0 salts the customer join (a customer known to hold a
    large share of the returns); by default AQE splits skewed partitions.
    """
    cdim = customer_dim(cu, us)
    if salt_buckets:
        out = salted_join(tr, cdim, "customer_id", "cu_id", "inner", salt_buckets, "id")
    else:
        out = dim_join(tr, cdim, "customer_id", "cu_id", "inner")
    return dim_join(out, accountant_dim(ac, us), "accountant_id", "ac_id", "left")


def _party_columns(df: DataFrame, wanted: dict[str, str]) -> list:
    cols = []
    for out_name, src in wanted.items():
        if src == "@customer_name":
            cols.append(full_name("cu_first_name", "cu_last_name").alias(out_name))
        elif src == "@accountant_name":
            cols.append(full_name("ac_first_name", "ac_last_name").alias(out_name))
        elif src in df.columns:
            cols.append(S(src).alias(out_name))
    return cols


SUMMARY_RETURN_COLUMNS = ["id", "tax_year", "status", "created_at", "updated_at"]
SUMMARY_TAIL_COLUMNS = ["total_income", "total_tax_due", "price", "payment_status"]


def return_summary(tr: DataFrame, cu: DataFrame, us: DataFrame, ac: DataFrame,
                   salt_buckets: int = 0) -> DataFrame:
    """The declared summary view: a return with customer and accountant names."""
    j = _with_parties(tr, cu, us, ac, salt_buckets)
    return j.select(*present(j, SUMMARY_RETURN_COLUMNS),
                    *_party_columns(j, {"customer_name": "@customer_name",
                                        "customer_email": "cu_email",
                                        "accountant_name": "@accountant_name"}),
                    *present(j, SUMMARY_TAIL_COLUMNS))


def return_details(tr: DataFrame, cu: DataFrame, us: DataFrame, ac: DataFrame,
                   ids=None) -> DataFrame:
    """Every return column plus customer and accountant contact details."""
    if ids is not None:
        tr = lookup(tr, "id", ids)
    j = _with_parties(tr, cu, us, ac)
    return j.select(*[S(x) for x in tr.columns],
                    *_party_columns(j, {"customer_name": "@customer_name",
                                        "customer_email": "cu_email",
                                        "customer_phone": "cu_phone",
                                        "accountant_name": "@accountant_name",
                                        "accountant_email": "ac_email",
                                        "accountant_qualification": "ac_qualification",
                                        "accountant_experience": "ac_experience_years"}))


def return_listing(tr: DataFrame, cu: DataFrame, us: DataFrame, ac: DataFrame,
                   filters: dict | None = None) -> DataFrame:
    """The admin return list: filters first (pushed to the scan), then names."""
    tr = filter_eq(tr, filters)
    j = _with_parties(tr, cu, us, ac)
    return j.select(*[S(x) for x in tr.columns],
                    *_party_columns(j, {"customer_name": "@customer_name",
                                        "customer_email": "cu_email",
                                        "accountant_name": "@accountant_name",
                                        "accountant_email": "ac_email"}))


def return_documents(docs: DataFrame, us: DataFrame, ids=None) -> DataFrame:
    """Documents with the uploader's name; an unknown uploader drops the row."""
    if ids is not None:
        docs = lookup(docs, "tax_return_id", ids)
    people = _people(us, "up_", extra=())
    j = docs.join(people, S("uploaded_by") == S("up_uid"), "inner")
    order = "created_at" if "created_at" in docs.columns else "id"
    return (j.select(*[S(x) for x in docs.columns],
                     full_name("up_first_name", "up_last_name").alias("uploaded_by_name"))
            .orderBy(pg_order(order, "desc"), S("id").asc()))


def return_messages(msgs: DataFrame, us: DataFrame, ids=None,
                    max_broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """Messages with sender and recipient names; a missing party drops it."""
    if ids is not None:
        msgs = lookup(msgs, "tax_return_id", ids)
    order = "created_at" if "created_at" in msgs.columns else "seq"
    in_order = [S("tax_return_id").asc(), pg_order(order, "asc"), S("id").asc()]
    if ids is None:
        # users written narrow and measured: while they are small the messages
        # are read once and move for the final sort alone
        people, size = cut_and_measure(_people(us, "", extra=()).select(
            S("uid"), full_name("first_name", "last_name").alias("name")))
        if size <= max_broadcast:
            j = msgs
            for party in ("sender", "recipient"):
                side = people.select(S("uid").alias("__" + party), S("name").alias(party + "_name"))
                j = j.join(F.broadcast(side), S(party + "_id") == S("__" + party), "inner").drop("__" + party)
            return j.orderBy(*in_order)
    # else names are joined to ids alone: the few senders hold many messages each,
    # and the texts should not be shuffled on them; the text comes in last
    names = (msgs.select(S("id").alias("__mid"), "sender_id", "recipient_id")
             .join(_people(us, "snd_", extra=()), S("sender_id") == S("snd_uid"), "inner")
             .join(_people(us, "rcp_", extra=()), S("recipient_id") == S("rcp_uid"), "inner")
             .select("__mid", full_name("snd_first_name", "snd_last_name").alias("sender_name"),
                     full_name("rcp_first_name", "rcp_last_name").alias("recipient_name")))
    return msgs.join(names, S("id") == S("__mid"), "inner").drop("__mid").orderBy(*in_order)


def document_owner(docs: DataFrame, tr: DataFrame) -> DataFrame:
    """Each document with the customer and accountant of its return."""
    r = tr.select(S("id").alias("__rid"), "customer_id", "accountant_id")
    return (docs.join(r, S("tax_return_id") == S("__rid"), "inner")
            .select(S("id"), S("tax_return_id"), *present(docs, ["uploaded_by"]),
                    S("customer_id"), S("accountant_id")))


def return_parties(tr: DataFrame, cu: DataFrame, ac: DataFrame) -> DataFrame:
    """Each return with its customer's and accountant's user ids (left joins)."""
    c = cu.select(S("id").alias("__cid"), S("user_id").alias("customer_user_id"))
    a = ac.select(S("id").alias("__aid"), S("user_id").alias("accountant_user_id"))
    j = dim_join(tr.select("id", "customer_id", "accountant_id"), c, "customer_id", "__cid")
    j = dim_join(j, a, "accountant_id", "__aid")
    return j.select("id", "customer_id", "accountant_id", "customer_user_id",
                    "accountant_user_id")


CUSTOMER_PROFILE_COLUMNS = ["date_of_birth", "national_insurance_number", "address_line1",
                            "address_line2", "city", "county", "postcode", "country",
                            "employment_status", "is_first_time_filer",
                            "preferred_contact_method"]
ACCOUNTANT_PROFILE_COLUMNS = ["qualification", "experience_years", "specializations", "bio",
                              "rating", "total_reviews", "is_active", "hourly_rate",
                              "availability_status"]


def profile(us: DataFrame, prof: DataFrame, role: str) -> DataFrame:
    """Users of ``role`` with their profile columns (left join; no secrets).

    Admins (or any other role) get the user row only.
    """
    users = us.filter(S("role") == F.lit(role)).drop(*SECRET_USER_COLUMNS)
    wanted = {"customer": CUSTOMER_PROFILE_COLUMNS,
              "accountant": ACCOUNTANT_PROFILE_COLUMNS}.get(role)
    if not wanted or prof is None:
        return users
    p = prof.select(S("user_id").alias("__puid"), *present(prof, wanted))
    return users.join(p, S("id") == S("__puid"), "left").drop("__puid")


def inquiry_listing(ci: DataFrame, us: DataFrame, filters: dict | None = None) -> DataFrame:
    """Inquiries (filtered) with the assignee's name (``' '`` if unassigned)."""
    ci = filter_eq(ci, filters)
    people = _people(us, "as_", extra=())
    j = dim_join(ci, people, "assigned_to", "as_uid", "left")
    return j.select(*[S(x) for x in ci.columns],
                    full_name("as_first_name", "as_last_name").alias("assigned_to_name"))


def inquiry_detail(ci: DataFrame, us: DataFrame, ids=None) -> DataFrame:
    """Inquiries with the assignee's name and email."""
    if ids is not None:
        ci = lookup(ci, "id", ids)
    people = _people(us, "as_", extra=("email",))
    j = dim_join(ci, people, "assigned_to", "as_uid", "left")
    return j.select(*[S(x) for x in ci.columns],
                    full_name("as_first_name", "as_last_name").alias("assigned_to_name"),
                    S("as_email").alias("assigned_to_email"))


def profile_ids(us: DataFrame, cu: DataFrame, ac: DataFrame) -> DataFrame:
    """user id -> the customer id and accountant id that belong to it."""
    c = cu.select(S("user_id").alias("__cu"), S("id").alias("customer_id"))
    a = ac.select(S("user_id").alias("__au"), S("id").alias("accountant_id"))
    return (us.select(S("id").alias("user_id"), "role")
            .join(c, S("user_id") == S("__cu"), "left")
            .join(a, S("user_id") == S("__au"), "left")
            .select("user_id", "role", "customer_id", "accountant_id"))


def return_listing_page(tr: DataFrame, cu: DataFrame, us: DataFrame, ac: DataFrame,
                        filters: dict | None = None, sort: str = "created_at",
                        direction: str = "DESC", page_no: int = 1, limit: int = 20,
                        allowed=None, max_broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """One page of the admin return list, names joined for that page only.

    Equal to ``page(return_listing(...))``:

    1. the first rows in page order are taken from a narrow projection (a
       per-task top-k), some more than the page needs, and cut to those that
       survive the inner join with their customer's user (semi joins on the
       customers they name, broadcast while those rows measure small, so a deep
       page shuffles instead); only if too many fell out is it done again, with
       as many more as the share that survived asks for;
    2. the page's ids fetch the full rows (broadcast semi join: the returns
       are scanned, not shuffled), checkpointed once (at most ``limit``
       rows) so later steps do not re-run the sort;
    3. customers, accountants and users are cut to the page's parties by
       broadcast semi joins (scans of at most ``2 * limit`` matching rows),
       and those tiny pieces are joined.
    """
    from .paging import page

    f = filter_eq(tr, filters)
    need = page_no * limit
    fetch = need + max(limit, 100)
    while True:
        first, size = cut_and_measure(page(f.select("id", sort, "customer_id"), sort, direction, 1, fetch,
                                           allowed))
        few = F.broadcast if size <= max_broadcast else (lambda df: df)
        named = (cu.select(S("id").alias("__ck"), S("user_id").alias("__cu"))
                 .join(few(first.select(S("customer_id").alias("__fc"))),
                       S("__ck") == S("__fc"), "left_semi"))
        users = (us.select(S("id").alias("__uk"))
                 .join(few(named.select(S("__cu").alias("__nu"))),
                       S("__uk") == S("__nu"), "left_semi"))
        known = named.join(few(users), S("__cu") == S("__uk"), "left_semi").select("__ck")
        narrow = cut_lineage(first.join(few(known), S("customer_id") == S("__ck"), "left_semi")
                             .select("id", sort))
        # both frames hold at most ``fetch`` rows
        kept = narrow.count()
        if kept >= need or first.count() < fetch:
            break
        fetch = max(2 * fetch, min(64 * fetch, 2 * fetch * need // max(kept, 1)))
    top = page(narrow, sort, direction, page_no, limit, allowed).select(S("id").alias("__pid"))
    # the page (at most `limit` rows) is read by every later step: materialize
    # it once so the sort and the table scan are not re-run per reference
    rows = cut_lineage(f.join(F.broadcast(top), S("id") == S("__pid"), "left_semi"))
    # the page's parties: at most `limit` customers and accountants
    cu_s = cu.select(S("id").alias("cu_id"), S("user_id").alias("cu_user_id")).join(
        F.broadcast(rows.select(S("customer_id").alias("__pc"))),
        S("cu_id") == S("__pc"), "left_semi")
    ac_s = ac.select(S("id").alias("ac_id"), S("user_id").alias("ac_user_id")).join(
        F.broadcast(rows.select(S("accountant_id").alias("__pa"))),
        S("ac_id") == S("__pa"), "left_semi")
    # semi joins ignore repeats, so the tiny key lists need no distinct
    uids = (cu_s.select(S("cu_user_id").alias("__u"))
            .unionByName(ac_s.select(S("ac_user_id").alias("__u"))))
    us_s = us.join(F.broadcast(uids), S("id") == S("__u"), "left_semi")
    cdim = (F.broadcast(cu_s).join(_people(us_s, "cu_"), S("cu_user_id") == S("cu_uid"), "inner")
            .drop("cu_uid", "cu_user_id"))
    adim = (ac_s.join(F.broadcast(_people(us_s, "ac_")), S("ac_user_id") == S("ac_uid"), "left")
            .drop("ac_uid", "ac_user_id"))
    j = (rows.join(F.broadcast(cdim), S("customer_id") == S("cu_id"), "inner")
         .join(F.broadcast(adim), S("accountant_id") == S("ac_id"), "left"))
    out = j.select(*[S(x) for x in tr.columns],
                   *_party_columns(j, {"customer_name": "@customer_name",
                                       "customer_email": "cu_email",
                                       "accountant_name": "@accountant_name",
                                       "accountant_email": "ac_email"}))
    d = "desc" if str(direction).lower() == "desc" else "asc"
    return out.orderBy(pg_order(sort, d), S("id").asc())


def inquiry_listing_page(ci: DataFrame, us: DataFrame, filters: dict | None = None,
                         sort: str = "created_at", direction: str = "DESC", page_no: int = 1,
                         limit: int = 20, allowed=None) -> DataFrame:
    """One page of the inquiry list, the assignee joined for that page only.

    The assignee join is a left join (it drops no inquiry), so the page can
    be taken from the inquiries alone (a per-task top-k) and only its rows
    joined with the few users they name.
    """
    from .paging import page

    # the page (at most `limit` rows) is read twice below: materialize it once
    top = cut_lineage(page(filter_eq(ci, filters), sort, direction, page_no, limit, allowed))
    people = _people(us, "as_", extra=()).join(
        F.broadcast(top.select(S("assigned_to").alias("__a"))),
        S("as_uid") == S("__a"), "left_semi")
    j = top.join(F.broadcast(people), S("assigned_to") == S("as_uid"), "left")
    d = "desc" if str(direction).lower() == "desc" else "asc"
    return (j.select(*[S(x) for x in ci.columns],
                     full_name("as_first_name", "as_last_name").alias("assigned_to_name"))
            .orderBy(pg_order(sort, d), S("id").asc()))
