"""Operators on small literal tables, against plain Python models."""

from __future__ import annotations

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from itemloom import functions as fn
from itemloom.operators import constraints, digests, documents, review, sequence, writes


def model_of_anomalies(numbers):
    out, seen, before = [], set(), None
    for n in numbers:
        warnings, confidence = [], "medium"
        if before is not None:
            if n in seen:
                warnings.append("duplicate")
                confidence = "low"
            if n <= before:
                warnings.append("reverse")
                confidence = "low"
            elif n != before + 1:
                warnings.append("gap")
                confidence = "medium"
        seen.add(n)
        before = n
        out.append((",".join(warnings), confidence))
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(1, 9), min_size=1, max_size=25))
def test_anomalies(spark, numbers):
    df = spark.createDataFrame([(1, k, n) for k, n in enumerate(numbers)], "g long, k long, n long")
    got = [(r["warnings"], r["confidence"]) for r in sequence.anomalies(df, ["g"], ["k"], "n").orderBy("k").collect()]
    assert got == model_of_anomalies(numbers)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-5, 9), min_size=1, max_size=40))
def test_running_total_over_blocks(spark, values):
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(values)], "g string, k long, v long")
    got = [r["running_total"] for r in sequence.running_total(df, ["g"], "k", "v", block=4).orderBy("k").collect()]
    assert got == [sum(values[: k + 1]) for k in range(len(values))]


def test_swap_up(spark):
    df = spark.createDataFrame([(1, k) for k in (10, 20, 30)], "g long, p long")
    new = lambda p: [r["new_position"] for r in sequence.swap_up(df, ["g"], "p", F.col("p") == p).orderBy("p").collect()]
    assert new(30) == [1, 3, 2] and new(10) == [1, 2, 3]


def test_islands_and_fill_down(spark):
    df = spark.createDataFrame([("a", k) for k in (1, 2, 3, 7, 8, 11)], "g string, k long")
    assert sorted((r["first"], r["last"]) for r in sequence.islands(df, ["g"], "k").collect()) == [(1, 3), (7, 8), (11, 11)]
    got = sequence.fill_down(df, ["g"], "k", F.col("k").isin(2, 8)).orderBy("k").collect()
    assert [(r["heading_no"], r["child_no"]) for r in got] == [(None, None), (2, None), (2, 1), (2, 2), (8, None), (8, 1)]


def test_strict_pass_needs_explicit_lists(spark):
    df = spark.createDataFrame([("auto_pass", "high", [], []), ("auto_pass", "high", None, []), ("auto_pass", "low", [], []), (None, "high", [], []), ("auto_pass", "high", ["x"], [])], "s string, c string, i array<string>, k array<string>")
    got = [r[0] for r in df.select(review.strict_pass(F.col("s"), F.col("c"), F.col("i"), F.col("k"))).collect()]
    assert got == [True, False, False, False, False]


def test_freshness_needs_a_zone(spark):
    df = spark.createDataFrame([("2024-01-01T00:10:00+00:00",), ("2024-01-01T00:10:00",), ("2023-12-31T23:00:00Z",), (None,), ("x+00:00",)], "t string")
    assert [r[0] for r in df.select(fn.fresh(F.col("t"), "2024-01-01T00:20:00Z", 15)).collect()] == [True, False, False, False, False]


def test_writes(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, version long")
    ch = spark.createDataFrame([(1, "x", 1), (2, "y", 5), (3, "z", 1)], "k long, v string, version long")
    got = {r["k"]: (r["v"], r["version"], r["outcome"]) for r in writes.guarded_update(t, ch, ["k"], "version", ["v"]).collect()}
    assert got == {1: ("x", 2, "updated"), 2: ("b", 1, "conflict")}
    assert {r["k"]: r["v"] for r in writes.insert_or_ignore(t, ch, ["k"]).collect()} == {1: "a", 2: "b", 3: "z"}
    got = {r["k"]: (r["v"], r["outcome"]) for r in writes.upsert(t, ch, ["k"], ["v"], F.col("_old_v") == "a").collect()}
    assert got == {1: ("x", "updated"), 2: ("b", "preserved"), 3: ("z", "inserted")}
    gone = {r["k"]: r["deleted_at"] for r in writes.soft_delete(t, ["k"], ch.filter("k = 1"), "T").collect()}
    assert gone == {1: "T", 2: None}


def test_constraints(spark):
    t = spark.createDataFrame([(1, 5, None), (2, None, "x"), (3, 9, "y")], "k long, n long, s string")
    got = sorted((r["k"], r["rule"]) for r in constraints.violations(t, ["k"], {"small": F.col("n") < 6, "named": F.col("s").isNotNull()}).collect())
    assert got == [(1, "named"), (3, "small")]
    other = t.withColumn("s", F.lit("x"))
    assert sorted((r["k"], r["column"]) for r in constraints.changed_columns(t, other, ["k"], ["n", "s"]).collect()) == [(1, "s"), (3, "s")]


def test_digest_is_free_of_order_and_sees_every_column(spark):
    rows = [(k, str(k % 3), None if k % 5 else 1.5) for k in range(50)]
    cols = [F.col(c) for c in ("a", "b", "c")]
    one = lambda r: digests.table_digest(spark.createDataFrame(r, "a long, b string, c double"), cols).first()["digest"]
    assert one(rows) == one(rows[::-1])
    assert one(rows) != one([(0, "0", 1.6), *rows[1:]]) and one(rows) != one([*rows, rows[0]])


def test_strict_documents(spark):
    f = {"k": "int", "s": "str"}
    assert documents.object_fault('{"k": 1, "s": "x"}', f) is None
    assert [documents.object_fault(t, f) for t in (None, '{"k": 1, "s": "x"} x', "[1]", '{"k": 1}', '{"k": true, "s": "x"}')] == ["missing", "not_json", "not_object", "keys", "type:k"]
    df = spark.createDataFrame([('{"b": 1, "a": "é"}',)], "t string")
    assert documents.canonical(df, "t").first()["canonical"] == '{"a":"é","b":1}' and json.loads(documents.canonical_json('{"z":[1, 2]}')) == {"z": [1, 2]}
    assert len(documents.signed(df, "t", b"key").first()["signature"]) == 64
