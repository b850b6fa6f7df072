"""The rule catalogue: every CHECK is broken once, every trigger forbids its event, and a table is read once."""

from __future__ import annotations

import re

import pytest

from itemloom.operators import catalogue

HEX, LONG = "a" * 64, "x" * 600
TEXTS = ["", " ", "x", "/abs", "raw_papers/../b", "a" + chr(92) + "b", "G" * 64, HEX, "a" * 32, LONG, "pending", "[", "1234"]
NUMBERS = [-1, 0, 1, 7, 301, 1800]
#: Rows for rules over several columns, and for rules whose breaking value is not among TEXTS and NUMBERS.
JOINT = {
    "pages": [{"page_start": 3}, {"page_start": 3, "page_end": 2}], "progress": [{"rendered_pages": 5, "total_pages": 4}, {"analyzed_pages": 5, "total_pages": 4}, {"processed_questions": 5, "question_count": 4}],
    "completed": [{"status": "completed"}, {"stage": "completed", "status": "failed"}], "failed": [{"status": "failed"}, {"status": "failed", "decision": "error"}, {"status": "failed", "decision": "passed", "error_message": "e"}],
    "root": [{"level": 1, "parent_id": 7}], "answer": [{"answer_status": "missing", "answer_markdown": "x"}, {"answer_status": "provided", "answer_markdown": " "}],
    "no_analysis": [{"analysis_review_status": "passed"}], "analysis": [{"analysis_markdown": "x", "analysis_review_status": "not_applicable"}],
    "usable": [{"usability_status": "usable", "ocr_review_status": "pending"}, {"usability_status": "usable", "answer_review_status": "not_applicable"}],
    "approved_draft_version": [{"approved_draft_version": 2, "reviewed_draft_version": 2}], "approval": [{"status": "pending", "approval_source": "human"}, {"status": "approved"}],
    "claim": [{"status": "processing"}, {"status": "failed", "claim_token": HEX}], "lease": [{"status": "processing", "claim_token": HEX, "claimed_at": "t"}], "stage_of_status": [{"status": "completed", "stage": "failed"}],
    "admitted": [{"stage": "admitted_pending_finalize"}], "backed_up": [{"stage": "processing", "backup_sha256": HEX}], "backup": [{"backup_sha256": HEX}], "finalize_backup": [{"finalize_backup_relative_path": "x"}],
    "no_lease": [{"status": "failed", "lease_expires_at": "t"}], "approval_evidence": [{"approval_evidence_json": "["}],
}
WORDS = {"NOT", "OR", "AND", "IN", "IS", "NULL", "BETWEEN", "RLIKE", "length", "trim", "startswith", "endswith", "contains", "chr", "coalesce", "false", "true", "try_parse_json"}


def columns_of(rule: str) -> set[str]:
    return set(re.findall(r"\b[a-z_][a-z_0-9]*\b", re.sub(r"'[^']*'", "", rule), re.I)) - WORDS


def numeric(column: str, rules: dict[str, str]) -> bool:
    return any(re.search(rf"(?<![(\w]){column} (=|>|>=|<=|<) (\d|[a-z_]+\b(?!'))|(?<![(\w]){column} (BETWEEN|IN) \(?\d", re.sub(r"'[^']*'", "''", r)) for r in rules.values()) and not column.endswith(("_markdown", "_status")) or column == "parent_id"


@pytest.mark.parametrize("table", sorted(catalogue.CHECKS))
def test_every_check_is_broken_once(spark, table):
    rules = catalogue.CHECKS[table]
    columns = sorted(set().union(*map(columns_of, rules.values())))
    kind = {c: "long" if numeric(c, rules) else "string" for c in columns}
    rows = [{}]
    for rule in rules.values():
        own = columns_of(rule)
        if len(own) == 1:
            (c,) = own
            rows += [{c: v} for v in (NUMBERS if kind[c] == "long" else TEXTS)]
    rows += [r for name in rules for r in JOINT.get(name, []) if r.keys() <= set(columns)]
    df = spark.createDataFrame([(k, *(r.get(c) for c in columns)) for k, r in enumerate(rows)], ", ".join(["k long", *(f"`{c}` {kind[c]}" for c in columns)]))
    got = catalogue.breaks(df, table, ["k"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Join" not in plan and "Exchange" not in plan
    found = got.collect()
    assert {r["rule"] for r in found} == set(rules)  # each is broken by some row
    assert 0 not in {r["k"] for r in found}  # nulls break none
    kept = {name: sum(1 for k in range(len(rows)) if (k, name) not in {(r["k"], r["rule"]) for r in found}) for name in rules}
    assert all(kept.values())


def test_literal_rows(spark):
    d = spark.createDataFrame([(1, "raw_papers/a.pdf"), (2, "raw_papers/../a.pdf"), (3, "other/a.pdf"), (4, "raw_papers" + chr(92) + "a")], "k int, stored_path string")
    rule = catalogue.CHECKS["source_papers"]["stored_path"]
    assert [r[0] for r in d.orderBy("k").selectExpr(rule).collect()] == [True, False, False, False]
    d = spark.createDataFrame([("exports/x/练习.md",), ("exports/练习.md",), ("exports/a/b.md",), ("/exports/x/练习.md",)], "output_path string")
    assert [r[0] for r in d.selectExpr(catalogue.CHECKS["basket_exports"]["output_path"]).collect()] == [True, False, False, False]


def changes(spark, table, schema, old, new, key=("id",), **finished):
    keys = {k: spark.createDataFrame([(x,) for x in v], "key long") for k, v in finished.items()}
    d = catalogue.forbidden_changes(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), table, list(key), keys)
    return {(r[0], r["event"], r["trigger"]) for r in d.collect()}


@pytest.mark.parametrize("table", [t for t, x in catalogue.TRIGGERS.items() if x[0].through == (("question_id", "question"),)])
def test_rows_of_a_finished_question_are_frozen(spark, table):
    name = catalogue.TRIGGERS[table][0].name.removesuffix("_insert")
    old = [(1, 10, "a"), (2, 10, "a"), (3, 20, "a"), (4, 20, "a"), (5, 20, "a"), (6, 10, "same")]
    new = [(1, 10, "b"), (3, 20, "b"), (5, 10, "a"), (6, 10, "same"), (7, 10, "a"), (8, 20, "a")]  # 2 and 4 go, 5 moves to 10
    got = changes(spark, table, "id long, question_id long, body string", old, new, question=[10, 10])
    assert got == {(1, "update", f"{name}_update"), (2, "delete", f"{name}_delete"), (5, "update", f"{name}_update"), (7, "insert", f"{name}_insert")}


def test_other_triggers(spark):
    q = "id long, stem_markdown string, usability_status string"
    assert changes(spark, "questions", q, [(1, "a", "draft"), (2, "a", "draft"), (3, "a", "draft"), (4, "a", "draft")], [(1, "a", "usable"), (2, "b", "draft"), (4, "c", "draft")], question=[1, 2, 3]) == {(2, "update", "question_update"), (3, "delete", "question_delete")}
    j = "id long, status string"
    assert changes(spark, "import_jobs", j, [(1, "completed"), (2, "completed"), (3, "pending")], [(1, "failed"), (2, "failed"), (3, "failed")], job=[1, 3]) == {(1, "update", "completed_job_status")}
    r = "import_job_id long, status string, applied_at string, model string, question_count long, input_digest string, taxonomy_digest string, output_sha256 string, output_byte_size long, completed_at string"
    row = lambda i, s, a, m: (i, s, a, m, 1, "d", "t", "o", 2, "c")
    got = changes(spark, "import_knowledge_classification_runs", r, [row(1, "completed", None, "m"), row(2, "completed", "t", "m"), row(3, "failed", None, "m"), row(4, "completed", None, "m")], [row(1, "completed", "t", "m"), row(2, "completed", "u", "m"), row(4, "completed", None, "n")], key=("import_job_id",))
    assert got == {(2, "update", "applied_run"), (4, "update", "completed_output")}  # 1 is applied, which is allowed; 3 may go
    got = changes(spark, "import_knowledge_classification_runs", r, [row(1, "completed", None, "m")], [row(9, "pending", None, "m")], key=("import_job_id",))
    assert got == {(1, "delete", "completed_run")}
    w = "import_job_id long, status string"
    got = changes(spark, "import_web_admission_runs", w, [(1, "completed"), (2, "processing"), (3, "processing"), (4, "completed")], [(1, "failed"), (2, "completed"), (3, "completed"), (5, "completed"), (6, "failed")], key=("import_job_id",), done=[3])
    assert got == {(1, "update", "completed_admission"), (2, "update", "completed_without_job_update"), (4, "delete", "completed_admission_delete"), (5, "insert", "completed_without_job")}
    a = "id long, import_job_id long, question_id long"
    assert changes(spark, "question_assets", a, [(1, 1, 10), (2, 2, 20)], [(1, 1, 20), (2, 2, 30), (3, 1, 40), (4, 2, 10)], job=[1], question=[10]) == {(1, "update", "asset_update"), (3, "insert", "asset_insert"), (4, "insert", "asset_insert")}
    s = "question_id long, import_job_id long"
    assert changes(spark, "question_sources", s, [(1, 1), (2, 2)], [(2, 1), (3, 1)], key=("question_id",), job=[1]) == {(1, "delete", "source_delete"), (2, "update", "source_update"), (3, "insert", "source_insert")}
    for table in ("corrected_draft_reaudits", "candidate_knowledge_classifications", "candidate_knowledge_classification_drafts"):
        got = changes(spark, table, "id long, import_job_id long, status string", [(1, 1, "completed"), (2, 1, "completed")], [(1, 1, "failed")], applied=[1])
        assert {e for _, e, _ in got} == ({"update"} if table == "corrected_draft_reaudits" else {"update", "delete"})
