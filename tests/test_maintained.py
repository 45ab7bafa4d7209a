import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import aggregates as A
from ledgerflow.operators import changes as C
from ledgerflow.operators import filters as FL
from ledgerflow.operators import incremental as I
from ledgerflow.operators import postings as PO
from ledgerflow.session import store

CLOCK = "2024-01-31 00:00:00"
RETURNS = ("id bigint, accountant_id bigint, status string, payment_status string, price decimal(10,2), "
           "total_income decimal(12,2), updated_at timestamp_ntz")


def returns(spark, rng, n=60):
    return spark.createDataFrame([
        (i, rng.choice([None, 1, 2, 3]), rng.choice(["pending", "in_progress", "review", "completed", "filed"]),
         rng.choice(["paid", "pending", None]), rng.choice([None, Decimal("10.50")]),
         rng.choice([None, Decimal("-3.25"), Decimal("99.10")]), None) for i in range(n)], RETURNS)


def rows(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=str)


def test_summary_follows_batches_as_a_recount_does(spark):
    rng = random.Random(4)
    now = returns(spark, rng).cache()
    for group in (None, ["accountant_id"]):
        state, kept = now, I.return_parts(now, group)
        for step in range(3):
            chg = spark.createDataFrame(
                [(rng.randrange(70), rng.choice(["filed", "pending", "nonsense"])) for _ in range(12)],
                "id bigint, status string").dropDuplicates(["id"])
            if step == 1:  # one accountant loses every return: its group must go
                ids = [r.id for r in state.filter("accountant_id = 3").collect()]
                chg = spark.createDataFrame([(i, 1, True) for i in ids], "id bigint, accountant_id bigint, x boolean").drop("x")
                act = spark.createDataFrame([(1, True)], "id bigint, is_active boolean")
                def job(r, c):
                    return C.assign_accountant(r, c, act, CLOCK).state
            else:
                def job(r, c):
                    return C.set_status(r, c, CLOCK).state
            kept = store(I.after_changes(kept, state, chg, job, group=group))
            state = store(job(state, chg))
            assert rows(I.return_stats(kept)) == rows(A.return_stats(state, group=group))
            if step == 1 and group:
                assert 3 not in {r.accountant_id for r in kept.collect()}


def test_inserts_deletes_and_empty_batches(spark):
    rng = random.Random(5)
    now = returns(spark, rng)
    more = returns(spark, rng, 7)
    kept = I.maintained(I.return_parts(now), I.delta(now.limit(0), more))
    assert rows(I.return_stats(kept)) == rows(A.return_stats(now.unionByName(more)))
    gone = I.maintained(I.return_parts(now, ["accountant_id"]), I.delta(now, now.limit(0), ["accountant_id"]), ["accountant_id"])
    assert gone.collect() == []
    none = spark.createDataFrame([], "id bigint, status string")
    same = I.after_changes(I.return_parts(now), now, none, lambda r, c: C.set_status(r, c, CLOCK).state)
    assert rows(I.return_stats(same)) == rows(A.return_stats(now))


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(6)
    names = ["Ann", "Änn", "ANNA", "KelvinK", "a%b_c", "İstanbul", "", None, "x", "Joanna  Smith", "an_na\\d"]
    return spark.createDataFrame(
        [(i if i % 9 else None, rng.choice(names), rng.choice(names), f"user{i:03d}@Example.com") for i in range(80)]
        + [(1, "Joanna", "twice", None)], "id bigint, first_name string, last_name string, email string").cache()


@pytest.fixture(scope="module")
def postings(people):
    return PO.build(people, "id", ["first_name", "last_name", "email"])


@pytest.mark.parametrize("text", ["ann", "ANNA", "oan%smi", "a_na", "user01", "er0__@ex", "änn", "kelvink", "%", "_",
                                  "x", "", None, "no such", "istanbul", "user%example%com", "USER07"])
def test_postings_find_what_the_scan_finds(people, postings, text):
    cols = ["first_name", "last_name", "email"]
    got, want = PO.search(people, "id", cols, text, postings), FL.search(people, cols, text)
    assert rows(got) == rows(want)


def test_postings_are_sorted_and_read_by_trigram(spark, people):
    postings = PO.build(people, "id", ["email"])
    plan = postings.filter(F.col("gram") == "exa")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gram,exa)" in plan
    assert PO.needed("ab%cde_F") == ["cde"] and PO.needed("ab_c%") == [] and PO.needed("éab") == []
    assert PO.build(people.limit(0), "id", ["email"]).collect() == []
