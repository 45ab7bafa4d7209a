"""Deletes along a declared reference graph, and repeated keys, against plain Python."""

import random
from collections import Counter

from ledgerflow.operators import changes as C
from ledgerflow.operators import quality as Q

# users <- teams <- projects <- tasks (three cascading levels), tasks <- tasks
# and teams <- users (a cycle), notes without an id, and plain references
EDGES = [("teams", "owner", "users", True), ("users", "home_team", "teams", True),
         ("projects", "team", "teams", True), ("projects", "lead", "users", False),
         ("tasks", "project", "projects", True), ("tasks", "parent", "tasks", True),
         ("tasks", "assignee", "users", False), ("notes", "task", "tasks", True),
         ("notes", "author", "users", False), ("bills", "project", "projects", False)]
SHAPE = {"users": "id int, home_team int", "teams": "id int, owner int", "projects": "id int, team int, lead int",
         "tasks": "id int, project int, parent int, assignee int", "notes": "task int, author int",
         "bills": "id int, project int"}


def columns(t):
    return [x.split()[0] for x in SHAPE[t].split(", ")]


def closure(data, uid):
    """(table, place) of the rows that go with one user, rows as dicts."""
    go = {("users", i) for i, r in enumerate(data["users"]) if r["id"] == uid}
    while True:
        more = {(c, i) for c, col, p, cascades in EDGES if cascades for i, r in enumerate(data[c])
                if r[col] is not None and any(data[t][j]["id"] == r[col] for t, j in go if t == p)} - go
        if not more:
            return go
        go |= more


def slow(data, asked):
    blocked, gone = set(), set()
    for uid in sorted({a for a in asked if any(r["id"] == a for r in data["users"])}):
        go = closure(data, uid)
        blocks = {f"{c}.{col}" for c, col, p, cascades in EDGES if not cascades
                  for i, r in enumerate(data[c]) if (c, i) not in go and r[col] is not None
                  and any(data[t][j]["id"] == r[col] for t, j in go if t == p)}
        blocked |= {(uid, b) for b in blocks}
        gone |= set() if blocks else go
    return blocked, gone


def random_rows(rng):
    size = {"users": 12, "teams": 7, "projects": 8, "tasks": 14, "notes": 12, "bills": 2}
    refers = {(c, col): p for c, col, p, _ in EDGES}

    def cell(t, col, i):
        if col == "id":
            return i
        # sparse references, so that some users go and some are blocked
        return rng.randrange(size[refers[t, col]]) if rng.random() < (0.25 if t in ("users", "tasks") else 0.6) else None

    return {t: [{col: cell(t, col, i) for col in columns(t)} for i in range(n)] for t, n in size.items()}


def frames(spark, data):
    return {t: spark.createDataFrame([tuple(r[c] for c in columns(t)) for r in rows], SHAPE[t])
            for t, rows in data.items()}


def check(spark, data, asked):
    tables = frames(spark, data)
    done = C.delete_rows(tables, "users", spark.createDataFrame([(a,) for a in asked], "id int"), EDGES)
    blocked, gone = slow(data, asked)
    assert {tuple(r) for r in done.blocked.collect()} == blocked
    assert Counter(map(tuple, done.gone.collect())) == Counter(
        (t, str(data[t][i].get("id", data[t][i].get("task")))) for t, i in gone)
    for t, df in done.state.items():
        left = [tuple(r[c] for c in columns(t)) for i, r in enumerate(data[t]) if (t, i) not in gone]
        assert Counter(map(tuple, df.collect())) == Counter(left)
    return blocked, gone


def test_random_graphs_equal_plain_closure(spark):
    kinds = [check(spark, random_rows(random.Random(seed)), [0, 3, 5, 5, 8, 11, 99]) for seed in (1, 2, 6)]
    assert any(b for b, _ in kinds) and any(g for _, g in kinds)


def test_chain_and_cycle(spark):
    data = {"users": [dict(id=0, home_team=None), dict(id=1, home_team=0)],
            "teams": [dict(id=0, owner=0), dict(id=1, owner=1)],        # 0 -> team 0 -> user 1 -> team 1
            "projects": [dict(id=0, team=1, lead=1)],                    # lead goes too, so it blocks nothing
            "tasks": [dict(id=0, project=0, parent=1, assignee=None), dict(id=1, project=None, parent=0, assignee=0)],
            "notes": [dict(task=1, author=0), dict(task=None, author=None)], "bills": []}
    blocked, gone = check(spark, data, [0])
    assert not blocked and len(gone) == 8
    data["bills"] = [dict(id=0, project=0)]
    assert check(spark, data, [0]) == ({(0, "bills.project")}, set())


def test_nothing_asked(spark):
    data = random_rows(random.Random(3))
    assert check(spark, data, [99]) == (set(), set())


def test_unique_equals_plain_counts(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "a|b", None, "x"]), rng.choice(["c", "b|c", None]), "s") for i in range(300)]
    rows += [(7, None, None, "s")] * 50 + [(None, "q", "q", "s")] * 3
    df = spark.createDataFrame(rows, "id int, a string, b string, print string")
    sets = {"t": [["id"], ["a", "b"], ["missing"]], "u": [["print"]]}
    got = Counter(tuple(r) for r in Q.dq_unique({"t": df, "u": df.limit(1)}, sets).collect())
    want = Counter()
    for cols, at in (("id", [0]), ("a,b", [1, 2])):
        n = Counter(tuple(r[i] for i in at) for r in rows if None not in [r[i] for i in at])
        want.update(("t", cols, "|".join(map(str, k)), c) for k, c in n.items() if c > 1)
    assert got == want and want["t", "id", "7", 51] == 1
    assert ("t", "a,b", "a|b|c") in {x[:3] for x in got}  # ("a", "b|c") and ("a|b", "c") stay two keys


def test_unique_prints_that_meet_by_chance_are_told_apart(spark, monkeypatch):
    df = spark.createDataFrame([(i,) for i in range(40)] + [(3,)], "id int")
    monkeypatch.setattr(Q.F, "xxhash64", lambda c: Q.F.lit(1).cast("bigint"))
    assert [(r.key_value, r.n) for r in Q.dq_unique({"users": df}, {"users": [["id"]]}).collect()] == [("3", 2)]


def test_unique_of_unique_keys_and_of_no_rows(spark):
    df = spark.range(1000).toDF("id")
    assert Q.dq_unique({"users": df}, {"users": [["id"]]}).collect() == []
    assert Q.dq_unique({"users": df.limit(0)}, {"users": [["id"]]}).collect() == []
