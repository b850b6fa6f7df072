"""Adoption of re-audits, bound classifications, required pictures and code lists on literal cases."""

from __future__ import annotations

from itemloom.operators import adoption, layout

A, B = "a" * 64, "b" * 64
DRAFT = "job int, no string, version long, edited_sha256 string, status string, approval_source string, reviewed_at string, deleted boolean"
RESULT = "job int, no string, run_id string, version long, edited_sha256 string, audit_status string"
AUDIT = "job int, no string, version long, edited_sha256 string, status string, decision string, run_id string"
KEY = ["job", "no"]


def test_a_result_is_adopted_once(spark):
    d = spark.createDataFrame([(1, "1", 2, A, "draft", None, None, False), (1, "2", 1, A, "draft", None, None, None), (1, "3", 1, A, "draft", None, None, True), (1, "4", 3, A, "draft", None, None, False)], DRAFT)
    told = spark.createDataFrame([(1, "4", 3, A, "completed", "not_passed", "old"), (1, "1", 1, A, "completed", "passed", "older"), (1, "2", 1, A, "failed", "error", None)], AUDIT)
    rows = [("1", "r1", 2, A, "auto_pass"), ("1", "r2", 2, A, "disputed"), ("1", "r3", 2, B, "auto_pass"), ("1", "r4", 3, A, "auto_pass"), ("2", "r5", 1, A, "disputed"), ("3", "r6", 1, A, "auto_pass"), ("4", "r7", 3, A, "auto_pass"), ("2", " ", 1, A, "auto_pass"), ("2", "x" * 201, 1, A, "auto_pass"), ("2", "r8", 0, A, "auto_pass"), ("2", "r9", 1, "A" * 64, "auto_pass"), ("9", "ra", 1, A, "auto_pass")]
    results = spark.createDataFrame([(1, *r) for r in rows], RESULT)
    first = adoption.adoption(d, told, results, KEY)
    got = {r["run_id"]: r["outcome"] for r in first.collect()}
    assert got == {"r1": "passed", "r2": "later", "r3": "stale", "r4": "stale", "r5": "not_passed", "r6": "stale", "r7": "done", " ": "invalid", "x" * 201: "invalid", "r8": "invalid", "r9": "invalid", "ra": "stale"}
    after = adoption.adopted(d, first, KEY, "now")
    assert {r["no"]: (r["version"], r["status"], r["approval_source"], r["reviewed_at"]) for r in after.collect()} == {"1": (3, "approved", "ai_second_pass", "now"), "2": (1, "needs_fix", None, "now"), "3": (1, "draft", None, None), "4": (3, "draft", None, None)}
    both = adoption.completed_reaudits(told, first)
    second = adoption.adoption(after, both, results, KEY)
    assert {r["run_id"]: r["outcome"] for r in second.collect() if r["run_id"] in ("r1", "r2", "r5")} == {"r1": "done", "r2": "done", "r5": "done"}
    assert {r["run_id"] for r in second.filter("outcome IN ('passed', 'not_passed')").collect()} == {"r4"}  # it was made for the version that is now there
    used = adoption.adoption(d, told, spark.createDataFrame([(1, "1", "old", 2, A, "auto_pass"), (1, "2", "same", 1, A, "auto_pass"), (1, "1", "same", 2, A, "auto_pass")], RESULT), KEY)
    assert {(r["no"], r["run_id"]): r["outcome"] for r in used.collect()} == {("1", "old"): "used", ("1", "same"): "passed", ("2", "same"): "used"}


def test_only_exact_classifications_bind(spark):
    d = spark.createDataFrame([(1, str(k), s, a, v, A) for k, (s, a, v) in enumerate([("approved", "human", 2), ("approved", "ai_second_pass", 1), ("draft", None, 1), ("approved", "robot", 1), ("approved", "human", None)] + [("approved", "human", 1)] * 6)], "job int, no string, status string, approval_source string, version long, edited_sha256 string")
    c = [(0, "0", 2, A, "p", ["q"]), (10, "0", 1, A, "p", ["q"]), (11, "0", 2, B, "p", ["q"]), (1, "1", 1, A, "p", []), (2, "2", 1, A, "p", []), (3, "3", 1, A, "p", []), (4, "4", None, A, "p", []), (5, "5", 1, A, "off", []), (6, "6", 1, A, "p", ["p"]), (7, "7", 1, A, "p", ["q", "q"]), (8, "8", 1, A, "p", ["q", "r", "s"]), (9, "9", 1, A, "p", ["gone"]), (12, "10", 1, A, "p", None)]
    c = spark.createDataFrame([(i, 1, *r) for i, *r in c], "classification_id int, job int, no string, approved_draft_version long, edited_sha256 string, primary_code string, related_codes array<string>")
    points = spark.createDataFrame([("p", True), ("q", True), ("r", True), ("s", True), ("off", False)], "code string, is_active boolean")
    got = adoption.bound_classifications(d, c, points, "job", "no")
    assert {(r["classification_id"], tuple(r["related_codes"])) for r in got.collect()} == {(0, ("q",)), (1, ())}


def test_required_pictures(spark):
    q = spark.createDataFrame([(1, "passed", "single_choice"), (2, "passed", "single_choice"), (3, "passed", "solution"), (4, "pending", "single_choice"), (5, "passed", "solution"), (6, "passed", "multiple_choice")], "q int, figure_review_status string, question_type_code string")
    o = spark.createDataFrame([(1, layout.IMAGE_OPTION), (1, f" {layout.IMAGE_OPTION} "), (2, "text"), (2, layout.IMAGE_OPTION), (4, layout.IMAGE_OPTION)], "q int, content string")
    a = spark.createDataFrame([(1, "complete_question", "a", 1, 1), (2, "complete_question", "b", 1, 2), (3, "question_figure", "c", 1, 3), (4, "complete_question", "d", 1, 4)], "q int, kind string, path string, display_order int, asset_id int")
    got = {r["q"]: (r["has_required_image"], r["image_options"], r["n_options"], r["required_image_missing"]) for r in layout.required_content(q, o, a, "q").collect()}
    assert got == {1: (True, True, 0, False), 2: (True, False, 2, True), 3: (True, False, 0, False), 4: (False, False, 0, False), 5: (True, False, 0, True), 6: (True, True, 0, True)}


def test_results_are_dealt_three_times_and_digests_travel_packed(spark):
    d = spark.createDataFrame([(1, "1", 1, A, "draft", None, None, False)], DRAFT)
    results = spark.createDataFrame([(1, "1", "r", 1, A, "auto_pass"), (1, "2", "", 1, "odd é", "auto_pass"), (1, "3", None, None, None, "auto_pass")], RESULT)
    told = spark.createDataFrame([(1, "1", 2, A, "completed", "passed", "old")], AUDIT)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = adoption.adoption(d, told, results, KEY)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 6  # three of the results, one of each other side
        assert {tuple(r) for r in got.collect()} == {(1, "1", "r", 1, A, "passed"), (1, "2", "", 1, "odd é", "invalid"), (1, "3", None, None, None, "invalid")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    texts = [A, A.upper(), "", " " * 33, "é" * 16, None, "a" * 63, " " * 33 + A]
    back = spark.createDataFrame([(t,) for t in texts], "t string").select("t", adoption._packed("t").alias("p")).withColumn("u", adoption._unpacked("p")).collect()
    assert all(r["t"] == r["u"] for r in back) and len({bytes(r["p"]) for r in back if r["p"] is not None}) == 7
