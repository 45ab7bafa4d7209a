"""Hand-made rows (FIXTURES.md section 2) typed by the declared schemas."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from ledgerflow.sources.schemas import TABLES

T = dt.datetime
AS_OF = T(2024, 1, 31)


def table(spark, name, rows: list[dict], schema=None):
    """Rows as dicts; missing columns are NULL."""
    schema = schema or TABLES[name]
    cols = schema.fieldNames()
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], schema)


def users(spark):
    return table(spark, "users", [
        dict(id="u1", email="ann@example.com", first_name="Ann", last_name="Lee", role="customer",
             is_verified=True, phone="07700900123", created_at=T(2024, 1, 30)),
        dict(id="u2", email="bob@example.com", first_name="Bob", last_name=None, role="customer",
             is_verified=False, created_at=T(2023, 1, 1), password_hash="x",
             reset_password_token="t2", reset_password_expires=T(2024, 2, 1)),
        dict(id="u3", email="cat@example.com", first_name="Cat", last_name="Ng", role="accountant",
             is_verified=True, created_at=T(2023, 6, 1), reset_password_token="t3",
             reset_password_expires=T(2024, 1, 1)),
        dict(id="u4", email="dan@example.com", first_name="Dan", last_name="Oz", role="accountant",
             is_verified=True, created_at=T(2023, 6, 1)),
        dict(id="u5", email="eve@example.com", first_name="Eve", last_name="Ray", role="admin",
             is_verified=True, phone="+44 20 1234 5678", created_at=T(2022, 1, 1)),
        dict(id="u6", email="ANN@example.com", first_name="Ann", last_name="Two", role="customer",
             is_verified=True, created_at=T(2024, 1, 2)),
        dict(id="u7", email="gus@example.com_deleted_1", first_name="Gus", last_name="Old",
             role="customer", is_verified=False, created_at=T(2020, 1, 1)),
    ])


def accountants(spark):
    return table(spark, "accountants", [
        dict(id="a1", user_id="u3", rating=Decimal("4.50"), is_active=True, experience_years=5),
        dict(id="a2", user_id="u4", rating=None, is_active=True, experience_years=1),
        dict(id="a3", user_id="u4", rating=Decimal("3.00"), is_active=False, experience_years=9),
        dict(id="a4", user_id="u3", rating=Decimal("5.00"), is_active=None),
    ])


def customers(spark):
    return table(spark, "customers", [
        dict(id="c1", user_id="u1", city="Leeds"),
        dict(id="c2", user_id="u2"),
        dict(id="c9", user_id="u-missing"),
    ])


STATUSES = ["pending", "in_progress", "review", "completed", "filed", "cancelled"]
PAYMENTS = ["pending", "paid", "refunded", "failed"]


def returns(spark):
    rows = []
    n = 0
    for s in STATUSES:
        for p in PAYMENTS:
            n += 1
            rows.append(dict(
                id=f"r{n:02d}", customer_id="c1" if n % 2 else "c2",
                accountant_id=None if n % 5 == 0 else ("a1" if n % 3 else "a2"),
                tax_year="2022-23" if n < 12 else "2023-24", status=s, payment_status=p,
                situation_type="other", total_income=Decimal(str(1000 * n)),
                price=Decimal("169.00") if n != 7 else None,
                submission_deadline=dt.date(2024, 1, 31) if n != 9 else None,
                created_at=T(2023, 1, 1) + dt.timedelta(days=14 * n),
                filed_date=(T(2024, 1, 31) if n == 17 else T(2024, 1, 31, 0, 0, 1) if n == 18
                            else T(2024, 1, 10) if s == "filed" else None)))
    rows.append(dict(id="r99", customer_id="c1", accountant_id=None, tax_year="2023-24",
                     status="pending", payment_status="paid", price=Decimal("169.00"),
                     created_at=AS_OF - dt.timedelta(days=7)))
    return table(spark, "tax_returns", rows)


def inquiries(spark):
    return table(spark, "contact_inquiries", [
        dict(id="i1", first_name="Jo", last_name="Bloggs", email="jo@example.com",
             subject="Hello there", message="A question about fees.", inquiry_type="general",
             status="new", assigned_to=None, created_at=T(2024, 1, 24)),
        dict(id="i2", first_name="Al", last_name="Xu", email="al@example.com",
             subject="Help me", message="Need help with my return.", inquiry_type="billing",
             status="in_progress", assigned_to="u5", created_at=T(2024, 1, 23, 23, 59),
             responded_at=T(2024, 1, 24, 1, 59)),
        dict(id="i3", first_name="Mo", last_name="Ali", email="mo@example.com",
             subject="Thanks a lot", message="Thank you for everything!", inquiry_type="feedback",
             status="resolved", assigned_to="u3", created_at=T(2023, 12, 1),
             responded_at=T(2023, 12, 2)),
        dict(id="i4", first_name="Sam", last_name="Ko", email="sam@example.com",
             subject="Account", message="Locked out of my account.", inquiry_type="account",
             status="closed", assigned_to="u5", created_at=T(2024, 1, 1)),
    ])
