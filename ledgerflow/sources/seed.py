"""Default settings and sample rows as DataFrames (the seed script's data)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .schemas import TABLES

# The default system settings (key, value, description, public).
# The site's own name and e-mail domain are replaced by neutral placeholders.
DEFAULT_SETTINGS = [
    ("site_name", "Tax Practice", "Website name", True),
    ("default_tax_return_price", "169.00", "Default price for tax returns in GBP", False),
    ("max_file_upload_size", "10485760", "Maximum file upload size in bytes (10MB)", False),
    ("allowed_file_types", "pdf,jpg,jpeg,png,doc,docx,xls,xlsx", "Allowed file types for uploads",
     False),
    ("tax_year_deadline", "2024-01-31", "Self Assessment deadline", True),
    ("support_email", "support@example.com", "Support email address", True),
    ("support_phone", "+44 20 1234 5678", "Support phone number", True),
]


def settings(spark: SparkSession) -> DataFrame:
    rows = [(f"setting-{i + 1}", k, v, d, p, None, None)
            for i, (k, v, d, p) in enumerate(DEFAULT_SETTINGS)]
    return spark.createDataFrame(rows, TABLES["system_settings"])


def seed(spark: SparkSession) -> dict[str, DataFrame]:
    """The default settings plus one row of each core table, typed by the
    declared schemas (sample people; password hashes are not seeded)."""
    import datetime as dt
    from decimal import Decimal

    now = dt.datetime(2024, 1, 1)
    users = [
        ("u-admin", "admin@example.com", "", "Admin", "User", "+44 20 1234 5678", "admin", True,
         None, None, None, None, now, now),
        ("u-acc", "accountant@example.com", "", "Priya", "Malik", "+44 7700 900123",
         "accountant", True, None, None, None, None, now, now),
        ("u-cust", "customer@example.com", "", "Owen", "Hughes", "+44 7700 900456", "customer",
         True, None, None, None, None, now, now),
    ]
    acc = [("a-1", "u-acc", "Chartered Accountant (ACA)", 10, ["self-employed", "landlord"],
            "Sample accountant", Decimal("4.80"), 0, True, Decimal("75.00"), "available", now,
            now)]
    cust = [("c-1", "u-cust", dt.date(1985, 6, 15), None, "123 High Street", None, "London",
             None, "SW1A 1AA", "United Kingdom", "employed", False, "email", now, now)]
    ret = [("r-1", "c-1", "a-1", "2023-24", "in_progress", "self-employed", None, None, None,
            dt.date(2024, 1, 31), None, None, None, Decimal("169.00"), "paid", now, now)]
    inq = [("i-1", "Jane", "Doe", "jane@example.com", None, "Question about my return",
            "I would like to know more about the service.", "general", "new", None, None, now)]
    return {
        "users": spark.createDataFrame(users, TABLES["users"]),
        "accountants": spark.createDataFrame(acc, TABLES["accountants"]),
        "customers": spark.createDataFrame(cust, TABLES["customers"]),
        "tax_returns": spark.createDataFrame(ret, TABLES["tax_returns"]),
        "contact_inquiries": spark.createDataFrame(inq, TABLES["contact_inquiries"]),
        "system_settings": settings(spark),
    }
