"""The declarative replay equals running the log operation by operation."""

import random

from pyspark.sql import functions as F

from regspark.operators import oplog
from regspark.plans import apply
from regspark.schema import CREATE, DELETE_KEY, DELETE_VALUE, SET

SCHEMA = "seq long, op string, path string, name string, number long"


def replay(ops):
    keys, values = set(), {}
    for _, op, path, name, number in ops:
        p = path.lower()
        parts = p.split("\\")
        if op in (CREATE, SET):
            keys |= {"\\".join(parts[: i + 1]) for i in range(len(parts))}
        if op == SET:
            values[p, name.lower()] = number
        if op == DELETE_VALUE:
            values.pop((p, name.lower()), None)
        if op == DELETE_KEY:
            below = lambda x: x == p or x.startswith(p + "\\")  # noqa: E731, B023
            keys = {k for k in keys if not below(k)}
            values = {k: v for k, v in values.items() if not below(k[0])}
    return keys, values


def random_log(rng, n):
    out = []
    for seq in range(1, n + 1):
        path = "\\".join(rng.choice("abAB") for _ in range(rng.randint(1, 3)))
        op = rng.choice([CREATE, SET, SET, DELETE_VALUE, DELETE_KEY])
        out.append((seq, op, path, rng.choice(["", "x", "X"]) if op in (SET, DELETE_VALUE) else None, seq if op == SET else None))
    return out


def frame(spark, ops):
    return spark.createDataFrame(ops, SCHEMA).withColumn("path_norm", F.lower("path"))


def check(spark, logs):
    """All logs at once: each under a first part of its own."""
    many = [(s, op, f"l{i}\\{p}", n, x) for i, log in enumerate(logs) for s, op, p, n, x in log]
    df = frame(spark, many)
    keys = {r[0] for r in apply.live_keys(df).select("path_norm").collect()}
    values = {(r[0], r[1].lower()): r[2] for r in apply.live_values(df, ["number"]).select("path_norm", "name", "number").collect()}
    for i, log in enumerate(logs):
        k, v = replay([(s, op, f"l{i}\\{p}", n, x) for s, op, p, n, x in log])
        top = f"l{i}"
        assert {x for x in keys if x == top or x.startswith(top + "\\")} - {top} == k - {top}, log
        assert {x: y for x, y in values.items() if x[0].split("\\")[0] == top} == v, log


def test_random_logs(spark):
    rng = random.Random(7)
    check(spark, [random_log(rng, rng.randint(1, 9)) for _ in range(400)])


def test_named_cases(spark):
    k = "K"
    check(spark, [
        [(1, SET, k, "", 1), (2, CREATE, k, None, None)],
        [(1, CREATE, k, None, None), (2, DELETE_KEY, k, None, None), (3, CREATE, k, None, None)],
        [(1, DELETE_KEY, k, None, None), (2, SET, "K\\Sub", "x", 5)],
        [(1, SET, "K\\Sub", "x", 5), (2, DELETE_KEY, k, None, None)],
        [(1, SET, k, "v", 1), (2, DELETE_VALUE, k, "V", None)],
        [(1, SET, k, "v", 1), (2, SET, k, "V", 2)],
    ])


def test_optimizer_keeps_values(spark):
    rng = random.Random(3)
    for _ in range(3):
        log = random_log(rng, 60)
        df = frame(spark, log)
        small = oplog.optimize(df).select(df.columns)
        want = {(r[0], r[1].lower()): r[2] for r in apply.live_values(df, ["number"]).select("path_norm", "name", "number").collect()}
        # value names that differ in case only are apart in the optimizer, so the later one wins in the replay
        got = {(r[0], r[1].lower()): r[2] for r in apply.live_values(small, ["number"]).select("path_norm", "name", "number").collect()}
        assert got == want


def test_empty_log(spark):
    df = frame(spark, [])
    assert apply.live_keys(df).count() == 0 and apply.live_values(df, ["number"]).count() == 0


def test_applied_and_snapshot(spark):
    keys = spark.createDataFrame([("A",), ("A\\B",)], "path string")
    values = spark.createDataFrame([("A", "x", 1)], "key_path string, name string, number long")
    base = apply.snapshot_ops(keys, values, ["number"], F.lit(0).cast("long"))
    log = frame(spark, [(1, DELETE_KEY, "A\\B", None, None), (2, SET, "A", "y", 2)])
    ops = base.unionByName(log)
    assert {r[0] for r in apply.live_keys(ops).select("path").collect()} == {"A"}
    r = apply.applied(apply.live_values(base, ["number"]), apply.live_values(ops, ["number"]), ["path_norm", "name"], ["number"]).first()
    assert (r.n_created, r.n_deleted, r.n_changed, r.n_same) == (1, 0, 0, 1)


def test_deletes_above_hold_only_deletes(spark):
    """Each operation meets only keys at depths where something is deleted, and no task sorts what is below one key."""
    ops = frame(spark, [(i, SET, f"all\\u{i % 3}\\k{i}", "x", i) for i in range(1, 40)] + [(20, DELETE_KEY, "all\\u1", None, None), (10, DELETE_KEY, "ALL\\u2", None, None), (50, DELETE_KEY, "", None, None)])
    met = oplog.deletes_above(ops.select("seq", "path_norm"), ops)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BuildRight" in plan and "SortMergeJoin" not in plan
    assert {(r.top, r["del"]) for r in met.collect()} == {("all\\u1", 20), ("all\\u2", 10), ("", 50)}
    gone = {r.seq for r in oplog.shadowed(ops).collect()}
    assert gone == {i for i in range(1, 20) if i % 3 == 1} | {i for i in range(1, 10) if i % 3 == 2}
