"""Typed audit rows: what they keep, and that a log gives back either snapshot."""

import datetime as dt
import decimal as dc
import random
import tempfile

from ledgerflow.operators import audit as A

SCHEMA = ("id string, amount decimal(12,2), n int, big long, f double, ok boolean, day date, "
          "at timestamp_ntz, note string, `odd name.x` string, tags array<string>")
T = dt.datetime(2024, 2, 29, 12, 30, 15, 250)


def _row(r, i):
    pick = lambda *xs: r.choice([None, *xs])
    return (f"k{i}", pick(dc.Decimal("1.50"), dc.Decimal("100.00"), dc.Decimal("-0.01")), pick(1, 2),
            pick(2**53 + 1, -(2**62)), pick(0.1, 2.5), pick(True, False), pick(T.date()), pick(T),
            pick("", 'a "quote"', "null", "1"), pick("x", ""), pick([], ["a", None]))


def _snapshots(spark):
    r = random.Random(5)
    before = [_row(r, i) for i in range(60)]
    after = [b if i % 3 else _row(r, i) for i, b in enumerate(before) if i % 7]
    after += [_row(r, i) for i in range(60, 70)]
    return (before, after, spark.createDataFrame(before, SCHEMA), spark.createDataFrame(after, SCHEMA))


def _set(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


def test_log_gives_back_both_snapshots(spark):
    before, after, b, a = _snapshots(spark)
    path = tempfile.mkdtemp(prefix="ledgerflow-audit-") + "/log"
    A.audit_log(b, a, "t").write.parquet(path)
    log = spark.read.parquet(path)
    assert log.schema["old_values"].dataType.typeName() == "variant"
    old, new = {r[0]: r for r in before}, {r[0]: r for r in after}
    want = {k: "INSERT" if k not in old else "DELETE" if k not in new else "UPDATE"
            for k in {**old, **new} if old.get(k) != new.get(k)}
    assert {r.record_id: r.action for r in log.collect()} == want
    undone, redone = A.undo(a, log, "t"), A.redo(b, log, "t")
    assert undone.schema.simpleString() == b.schema.simpleString()
    assert _set(undone) == sorted(before, key=lambda r: r[0]) and _set(redone) == sorted(after, key=lambda r: r[0])
    # rows of another table and an empty log change nothing
    assert _set(A.undo(a, log, "other")) == sorted(after, key=lambda r: r[0])
    assert _set(A.redo(b, log.limit(0), "t")) == sorted(before, key=lambda r: r[0])


def test_types_and_nulls_of_an_update(spark):
    b = spark.createDataFrame([("a", dc.Decimal("1.50"), True, None, "7")],
                              "id string, v decimal(12,2), ok boolean, day date, note string")
    a = spark.createDataFrame([("a", None, True, T.date(), "8")], b.schema)
    r = A.audit_log(b, a, "t").selectExpr(
        "to_json(old_values) o", "to_json(new_values) n", "schema_of_variant(old_values) so",
        "schema_of_variant(new_values) sn").first()
    assert r.o == '{"day":null,"note":"7","v":1.5}' and r.n == '{"day":"2024-02-29","note":"8","v":null}'
    assert r.so == "OBJECT<day: VOID, note: STRING, v: DECIMAL(2,1)>"
    assert r.sn == "OBJECT<day: DATE, note: STRING, v: VOID>"
    log = A.audit_log(b, a, "t").select(A.has("new_values", "v").alias("v"), A.has("new_values", "ok").alias("ok"),
                                        A.value("new_values", "day", "date").alias("day")).first()
    assert (log.v, log.ok, log.day) == (True, False, T.date())


def test_empty_and_equal_snapshots(spark):
    _, after, _, a = _snapshots(spark)
    none = a.limit(0)
    assert A.audit_log(a, a, "t").count() == 0 and A.audit_log(none, none, "t").count() == 0
    log = A.audit_log(none, a, "t")
    assert _set(A.redo(none, log, "t")) == sorted(after, key=lambda r: r[0]) and A.undo(a, log, "t").count() == 0
