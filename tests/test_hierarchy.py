"""The tree's upsert on literal cases."""

from __future__ import annotations

from itemloom.operators import hierarchy

KNOWN = "id long, code string, parent_id long, name string"
NEW = "code string, parent_code string, name string, place int"


def run(spark, known, new):
    rows, faults = hierarchy.upsert(spark.createDataFrame(known, KNOWN), spark.createDataFrame(new, NEW), ["name"], "place")
    return {r["code"]: (r["id"], r["parent_id"], r["name"], r["action"]) for r in rows.collect()}, {(r["code"], r["fault"]) for r in faults.collect()}


def test_ids_parents_first_at_any_depth(spark):
    new = [("a.b.c.d", "a.b.c", "four", 1), ("a.b.c", "a.b", "three", 1), ("z", None, "root", 2), ("a", None, "root", 1), ("a.b", "a", "two", 1), ("a.c", "a", "two", 0)]
    got, faults = run(spark, [], new)
    assert got == {"a": (1, None, "root", "insert"), "z": (2, None, "root", "insert"), "a.c": (3, 1, "two", "insert"), "a.b": (4, 1, "two", "insert"), "a.b.c": (5, 4, "three", "insert"), "a.b.c.d": (6, 5, "four", "insert")} and faults == set()
    again, faults = run(spark, [(i, c, p, n) for c, (i, p, n, _) in got.items()], new)
    assert again == {c: (*v[:3], "keep") for c, v in got.items()} and faults == set()  # a second run writes nothing


def test_updates_moves_and_absent_rows(spark):
    known = [(5, "a", None, "A"), (7, "b", None, "B"), (9, "a.x", 5, "X"), (12, "old", 5, "O")]
    got, _ = run(spark, known, [("a", None, "A2", 1), ("b", None, "B", 2), ("a.x", "b", "X", 1), ("b.y", "b", "Y", 2)])
    assert got == {"a": (5, None, "A2", "update"), "b": (7, None, "B", "keep"), "a.x": (9, 7, "X", "update"), "b.y": (13, 7, "Y", "insert"), "old": (12, 5, "O", "absent")}


def test_faults_keep_what_hangs_on_them_out(spark):
    new = [("a", None, "A", 1), ("m", "gone", "M", 1), ("m.n", "m", "N", 1), ("x", "y", "X", 1), ("y", "x", "Y", 1), ("x.z", "x", "Z", 1), ("s", "s", "S", 1), ("t", None, "T", 1), ("t", "a", "T", 2), ("t.u", "t", "U", 1)]
    got, faults = run(spark, [(1, "m.n", None, "kept")], new)
    assert got == {"a": (2, None, "A", "insert"), "m.n": (1, None, "kept", "absent")}
    assert faults == {("m", "parent_missing"), ("m.n", "below_missing"), ("x", "cycle"), ("y", "cycle"), ("x.z", "cycle"), ("s", "cycle"), ("t", "repeated_code"), ("t.u", "parent_missing")}


def test_numbers_follow_the_order_over_many_ranges(spark):
    d = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = hierarchy.numbered(d, ["k"], "n", 5).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r["k"], r["n"]) for r in got} == {(k, k + 5) for k in range(1000)}


def test_numbering_holds_no_range_in_a_window(spark):
    d = hierarchy.numbered(spark.range(100).selectExpr("99 - id AS k").repartition(3), ["k"], "n", 7)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "row_number" not in plan  # one over the ranges' counts, none over their rows
    assert {(r["k"], r["n"]) for r in d.collect()} == {(k, k + 7) for k in range(100)}
