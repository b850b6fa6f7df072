"""Batches, states, runners, generations and streams on literal rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from itemloom import functions as fn
from itemloom import streaming
from itemloom.operators import batches, runners, stages
from itemloom.sources import generations


def reasons(df, *key):
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r["reasons"] for r in df.collect()}


def test_split_plan(spark):
    ok = [(1, [0.1, 0.1, 0.5, 0.5])]
    rows = [
        (1, 1, 1, 2, "high", [], ok), (1, 2, 2, 2, "0.5", ["w"], ok),
        (2, 1, 2, 2, "sure", None, [(9, [0.1, 0.1, 0.5, 0.5])]), (2, 2, 2, 3, "1.5", [], [(1, [0.5, 0.1, 0.5, 0.5])]), (3, 1, 1, 1, None, [], []),
    ]
    d = spark.createDataFrame(rows, "job_id long, position long, question_no long, declared long, confidence string, warnings array<string>, regions array<struct<page_number int, bbox array<double>>>")
    pages = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "job_id long, page_number long")
    got = batches.split_plan(d, pages)
    assert reasons(got, "job_id", "position") == {
        (1, 1): [], (1, 2): [], (2, 1): ["number", "page", "warnings", "confidence"], (2, 2): ["count", "box", "confidence"], (3, 1): ["no_region", "confidence"],
    }
    assert {r["job_id"]: r["valid"] for r in batches.batch_verdict(got).collect()} == {1: True, 2: False, 3: False}


def test_candidates_and_audits(spark):
    schema = "job_id long, position long, source_question_no string, stem_markdown string, question_type_code string, options array<struct<code string, content string>>, subquestions array<struct<label string, stem_markdown string>>, source_pages array<int>, figure_required boolean, extraction_confidence string"
    ab = [("A", "x"), ("B", "y")]
    rows = [
        (1, 1, "1", "s", "single_choice", ab, [], [1], False, "high"), (1, 2, "2", " ", "single_choice", [("a", "x"), ("A ", "y")], [], [2, 1], True, "high"),
        (1, 3, "2", "s", "solution", ab, [("(1)", "x"), ("(1) ", "y")], [1], None, "sure"), (1, 5, "5", "s", "fill_blank", [], [], [1], False, "low"),
    ]
    expected = spark.createDataFrame([(1, k, k, [1]) for k in range(1, 5)], "job_id long, position long, question_no long, pages array<int>")
    q = spark.createDataFrame(rows, schema)
    assert reasons(batches.candidates(q, expected), "position") == {
        1: [], 2: ["repeated", "stem", "option_codes", "pages"], 3: ["number", "repeated", "options", "labels", "confidence", "figure"], 4: ["missing"], 5: ["unexpected", "number", "pages"],
    }
    schema = "job_id long, position long, source_question_no string, audit_status string, text_match boolean, structure_match boolean, formula_match boolean, figure_check string, issues array<string>, suggested_corrections array<string>, evidence_page int, audit_confidence string"
    yes = (True, True, True)
    rows = [(1, 1, "1", "auto_pass", *yes, "not_applicable", [], [], 1, "high"), (1, 2, "2", "auto_pass", *yes, "failed", [], [], 2, "high"), (1, 3, "2", "disputed", *yes, "not_applicable", [], None, 1, "low")]
    e = spark.createDataFrame(rows, schema)
    got = batches.audits(e, q.filter("position < 5"))
    assert reasons(got, "position") == {1: [], 2: ["verdict"], 3: ["lists", "no_issue"]}
    declared = spark.createDataFrame([(1, 2, 1, 0), (2, 1, 0, 0)], "job_id long, n_auto_pass long, n_disputed long, n_human_required long")
    assert {r["job_id"]: r["matches"] for r in batches.declared_counts(e, declared).collect()} == {1: True, 2: False}
    points = spark.createDataFrame([("01.01.01",)], "code string")
    schema = "q long, stem_markdown string, question_type_code string, primary_knowledge_point_code string, options array<struct<code string, content string>>, figure_required boolean, has_crop boolean, has_figure boolean"
    pics = [("A", batches.IMAGE_OPTION), ("B", batches.IMAGE_OPTION)]
    rows = [(1, "s", "single_choice", "01.01.01", ab, False, None, None), (2, "", "single_choice", "9", [("A", "x")], True, False, False), (3, "s", "single_choice", "01.01.01", pics, False, False, None)]
    got = batches.approval_reasons(spark.createDataFrame(rows, schema), batches.TYPES, points)
    assert reasons(got, "q") == {1: [], 2: ["empty_stem", "knowledge_point", "too_few_options", "missing_figure"], 3: ["missing_crop"]}
    forms = spark.createDataFrame([(1, ["a", "b"], [1, 0]), (2, ["a"], [0, 1]), (3, ["a", "b"], [0, 0])], "q long, t array<string>, i array<int>")
    assert {(r["q"], r["valid"]) for r in batches.form_rows(forms, ["q"], ["t", "i"], "i").collect()} == {(1, True), (2, False), (3, False)}


def test_pipeline_stage(spark):
    base = dict(status="pending", admitted=False, artifacts_readable=True, render_completed=True, render_matches=True, candidate_numbers=["1", "2"], crop_numbers=["2", "1"], crops_reviewed=True, audit_numbers=["1", "2"])
    cases = {
        "ready": {}, "completed": dict(status="completed", admitted=True), "in_progress": dict(status="processing"), "needs_review": dict(admitted=True), "unavailable": dict(artifacts_readable=None),
        "needs_render": dict(render_matches=None), "needs_candidates": dict(candidate_numbers=None), "needs_crops": dict(crop_numbers=["1"]), "needs_crop_review": dict(crops_reviewed=False), "needs_ai_review": dict(audit_numbers=None),
        "not_found": dict(status=None), "failed": dict(status="failed"),
    }
    schema = "want string, status string, admitted boolean, artifacts_readable boolean, render_completed boolean, render_matches boolean, candidate_numbers array<string>, crop_numbers array<string>, crops_reviewed boolean, audit_numbers array<string>"
    rows = [(k, *(base | v).values()) for k, v in cases.items()]
    assert all(r["stage"] == r["want"] for r in stages.pipeline_stage(spark.createDataFrame(rows, schema)).collect())


def test_effective_content_and_finalize(spark):
    schema = "n long, candidate_sha256 string, audit_eligible boolean, audit_anchored boolean, draft_status string, approval_source string, evidence_valid boolean, draft_candidate_sha256 string, draft_changed boolean"
    rows = [
        (1, "c", True, True, None, None, None, None, None), (2, "c", True, False, None, None, None, None, None), (3, "c", True, True, "approved", "ai_second_pass", True, "c", False),
        (4, "c", True, True, "approved", "ai_second_pass", False, "c", False), (5, "c", False, True, "approved", "human", True, "c", True), (6, "c", False, True, "approved", "human", True, "x", True), (7, "c", True, True, "pending", None, None, "c", False),
    ]
    got = {r["n"]: (r["content"], r["content_source"], r["content_reason"]) for r in stages.effective_content(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        1: ("candidate", "pristine", None), 2: ("candidate", "rejected", "batch_ai_approval_not_anchored"), 3: ("draft", "ai_approved", None), 4: ("candidate", "rejected", "ai_approval_provenance_invalid"),
        5: ("draft", "human_edited", None), 6: ("candidate", "rejected", "human_review_source_changed"), 7: ("candidate", "rejected", "human_approval_status_invalid"),
    }
    rows = [("2", "pending", None, True, None, False, True, True), ("10", "pending", None, True, None, False, True, True), ("3", "approved", "human", True, True, True, None, None), ("4", "pending", None, True, None, True, True, True)]
    rows += [("5", "approved", "human", True, False, False, True, True), ("6", "approved", "ai_second_pass", False, True, False, True, True), ("7", "approved", None, True, True, False, True, True), ("8", "pending", None, False, None, False, True, True)]
    d = spark.createDataFrame(rows, "no string, status string, approval_source string, bound boolean, evidence_valid boolean, touched boolean, strict boolean, anchored boolean").selectExpr("1 AS job", "*")
    r = stages.finalize_report(stages.finalize_plan(d, "job"), "job", "no").first()
    assert (r["promoted"], r["pending"], r["rejected"], r["n_kept"], r["n_human"], r["n_ai"], r["complete"]) == ("2,10", "4,8", "5,6,7", 1, 1, 2, False)


def test_versions_navigation_protection(spark):
    chain = spark.createDataFrame([(1, 1, None, "superseded", "a"), (1, 2, 1, "current", "b"), (2, 1, None, "current", "x")], "k long, version_no long, previous_version long, version_status string, t string")
    new = spark.createDataFrame([(1, "c"), (2, "x"), (3, "n")], "k long, t string")
    got = sorted((tuple(r) for r in stages.append_versions(chain, new, ["k"], ["t"]).collect()), key=str)
    assert got == sorted([(1, 1, None, "superseded", "a"), (1, 2, 1, "superseded", "b"), (1, 3, 2, "current", "c"), (2, 1, None, "current", "x"), (3, 1, None, "current", "n")], key=str)
    again = stages.append_versions(spark.createDataFrame(got, chain.schema), new, ["k"], ["t"])
    assert sorted((tuple(r) for r in again.collect()), key=str) == got
    d = spark.createDataFrame([(1, n, n == 2) for n in (1, 2, 3)], "g long, n long, gone boolean")
    assert [r["next_no"] for r in stages.next_after(d, ["g"], "n", F.col("gone")).orderBy("n").collect()] == [3, 3, 1]
    old = spark.createDataFrame([(1, "done", "a", None), (2, "done", "a", None), (3, "open", "a", None), (4, "done", "a", None)], "k long, s string, t string, deleted string")
    now = spark.createDataFrame([(1, "done", "a", "x"), (2, "done", "b", None), (3, "open", "z", None)], old.schema)
    got = {(r["k"], r["violation"]) for r in stages.protected_changes(old, now, ["k"], F.col("s") == "done", ["deleted"]).collect()}
    assert got == {(2, "changed"), (4, "deleted")}


def test_scalars(spark):
    d = spark.createDataFrame([("3",), ("2 - 4",), ("4-2",), ("0-1",), ("1-99",), (None,), ("x",)], "t string")
    assert [tuple(r["p"]) if r["p"] else None for r in d.select(fn.page_range(F.col("t"), F.lit(9)).alias("p")).collect()] == [(3, 3), (2, 4), None, None, None, None, None]
    d = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double")
    assert [r[0] for r in d.select(fn.half_even(F.col("x"))).collect()] == [0, 2, 2, 0]
    d = spark.createDataFrame([("Check  the\tCROP edge",), ("ocr and crop",), ("other",)], "t string")
    assert [r[0] for r in d.select(fn.first_keyword(F.col("t"), [(["crop", "edge"], "crop"), (["ocr"], "text")])).collect()] == ["crop", "crop", None]
    d = spark.createDataFrame([("a/b.png",), ("/a.png",), ("a/../b.png",), ("a\\b.png",), ("a.jpg",), (None,), ("..a.png",)], "p string")
    assert [r[0] for r in d.select(fn.safe_path(F.col("p"))).collect()] == [True, False, False, False, False, False, True]
    d = spark.createDataFrame([("abcdef", "(1)", ""), ("abc", "", "s")], "t string, l string, s string")
    assert [tuple(r) for r in d.select(fn.shortened(F.col("t"), 4), fn.labelled(F.col("l"), F.col("s"))).collect()] == [("abc…", "(1)"), ("abc", "s")]
    d = spark.createDataFrame([("2025-01-01T00:04:00Z",), ("2025-01-01T00:06:00Z",), ("2025-01-01T00:00:00",), ("x",)], "t string")
    assert [r[0] for r in d.select(fn.zoned_time(F.col("t"), "2025-01-01 00:00:00")).collect()] == [True, False, False, False]


def test_runners(spark):
    class Broken:
        def run(self, stage, prompt):
            if "2" in prompt:
                raise TimeoutError
            return f"{stage}:{prompt}"

    d = spark.createDataFrame([(1, "q1"), (2, "q2"), (3, None)], "k long, prompt string")
    got = {r["k"]: (r["answer"], r["answer_error"]) for r in runners.run_stage(d, Broken(), "audit").collect()}
    assert got == {1: ("audit:q1", None), 2: (None, "TimeoutError"), 3: (None, None)}
    got = {r["k"]: r["answer"] for r in runners.run_stage(d, runners.RecordedRunner({("split", "q1"): "yes", "q2": "any"}), "split").collect()}
    assert got == {1: "yes", 2: "any", 3: None}
    d = d.select("k", runners.prompt("Do it", number=F.col("k"), text=F.col("prompt")).alias("prompt"))
    rec = d.select("k", F.when(F.col("k") == 1, F.sha2("prompt", 256)).otherwise("old").alias("prompt_sha256"), F.lit("a").alias("answer"))
    assert {r["k"]: r["answer"] for r in runners.recorded_answers(d, rec, ["k"]).collect()} == {1: "a", 2: None, 3: None}


def test_a_dead_writer_bricks_no_store(spark, tmp_path):
    root, df = str(tmp_path / "store"), spark.range(2)
    first = generations.publish(spark, root, {"t": df})
    (tmp_path / "store" / "log" / f"{2:012d}").touch()  # a writer died between create and close
    assert generations.current(spark, root) == first
    second = generations.publish(spark, root, {"t": spark.range(7)}, expected=first["number"])
    assert generations.current(spark, root) == second and second["number"] == 2 and generations.read(spark, root, "t").count() == 7
    with pytest.raises(generations.Conflict):
        generations._claim(spark, root, second | {"folder": "late"})
    assert generations.current(spark, root) == second
    third = generations.publish(spark, root, {"t": df})
    assert third["number"] == 3
    generations.prune(spark, root, keep=1)
    assert generations.read(spark, root, "t").count() == 2


def test_objects_with_floats():
    from itemloom.operators.documents import object_fault

    fields = {"a": "float", "n": "int"}
    cases = {'{"a": 1.5, "n": 2}': None, '{"a": 1, "n": 2}': None, '{"a": true, "n": 2}': "type:a", '{"a": 1e999, "n": 2}': "type:a", '{"a": 1, "n": 2.0}': "type:n", '{"a": 1, "n": 2} x': "not_json", "[]": "not_object", '{"a": 1}': "keys"}
    assert {t: object_fault(t, fields) for t in cases} == cases


def test_recovery_ends_or_raises(spark):
    left, waited = [3], []
    retry = lambda jobs: left.__setitem__(0, left[0] - 1)
    assert stages.recovery_loop(lambda: spark.range(max(left[0], 0)), retry, waited.append) == 3 and waited == [1, 2]
    with pytest.raises(RuntimeError):
        stages.recovery_loop(lambda: spark.range(1), lambda jobs: None, lambda n: None, most=2)


def test_generations(spark, tmp_path):
    root = f"{tmp_path}/store"
    assert generations.current(spark, root) is None and generations.read(spark, root, "t") is None
    a, b = spark.range(3).withColumnRenamed("id", "k"), spark.range(5).withColumnRenamed("id", "k")
    first = generations.publish(spark, root, {"t": a, "u": b})
    second = generations.publish(spark, root, {"t": b}, expected=1)
    assert generations.read(spark, root, "t").count() == 5 and generations.read(spark, root, "u").count() == 5
    assert generations.read(spark, root, "t", first).count() == 3
    with pytest.raises(generations.Conflict):
        generations.publish(spark, root, {"t": a}, expected=1)

    def none_negative(tables):
        return tables["t"].filter("k < 0")

    with pytest.raises(generations.Rejected):
        generations.publish(spark, root, {"t": b.withColumn("k", -F.col("k"))}, checks=[none_negative])
    assert generations.current(spark, root) == second
    (tmp_path / "store" / "log" / "000000000003").write_text("{")  # a writer that died in its log entry
    assert generations.current(spark, root) == second
    (tmp_path / "store" / "log" / "000000000003").unlink()
    generations.prune(spark, root, keep=1)
    assert generations.read(spark, root, "t").count() == 5 and generations.read(spark, root, "u").count() == 5


def test_artifacts_and_intake(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for name, data in {"a.pdf": b"%PDF-1", "b.pdf": b"%PDF-1", "c.pdf": b"nope", "d.txt": b"%PDF-2", "e.pdf": b"", "f.pdf": b"%PDF-3"}.items():
        (d / name).write_bytes(data)
    known = spark.createDataFrame([(b"%PDF-3",)], "b binary").select(F.sha2("b", 256).alias("sha256"))
    got = {r["path"][-5:]: (r["outcome"], r["archive_path"]) for r in generations.intake(spark, str(d), known, "TJ", 2025, "YK").collect()}
    assert {k: v[0] for k, v in got.items()} == {"a.pdf": "new", "b.pdf": "repeated", "c.pdf": "bad_header", "d.txt": "bad_name", "f.pdf": "known"}
    assert got["a.pdf"][1].startswith("raw_papers/TJ/2025/2025-TJ-YK-") and got["b.pdf"][1] is None
    now = generations.artifacts(spark, str(d))
    before = spark.createDataFrame(now.collect(), now.schema)
    (d / "c.pdf").write_bytes(b"else")
    (d / "f.pdf").unlink()
    spark.catalog.clearCache()
    assert sorted(r["path"][-5:] for r in generations.changed_artifacts(before, generations.artifacts(spark, str(d))).collect()) == ["c.pdf", "f.pdf"]


def test_streams(spark, tmp_path):
    rows = [(1, "2025-01-01 00:00:00"), (1, "2025-01-01 00:05:00"), (2, "2025-01-01 00:06:00"), (2, "2025-01-01 00:06:00")]
    d = spark.createDataFrame(rows, "k long, t string").select("k", F.to_timestamp("t").alias("ts"))
    d.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in")
    q = streaming.heartbeats(stream, "k", "ts").writeStream.format("memory").queryName("beats").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r["k"]: r["expired"] for r in streaming.leases(spark.table("beats"), "k", "2025-01-01 00:10:30").collect()}
    assert got == {1: True, 2: False}
    seen = []
    q = streaming.recover(stream, f"{tmp_path}/cp", lambda jobs, n: seen.append(sorted(r["k"] for r in jobs.collect())), "k = 1")
    q.awaitTermination(60)
    assert seen == [[1, 1]]
