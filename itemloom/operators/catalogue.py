"""The bank's rules as data: CHECK rules and triggers of every table, compiled to one pass over a table and one comparison of two states.

A CHECK is a Spark SQL condition on a row; null counts as kept. ``breaks`` applies all rules of a table in one scan. A trigger forbids an
event (insert, update, delete) for rows that a condition shields; ``forbidden_changes`` compares an old and a new state of a table by its
key once, and says for each changed row which trigger forbids that. Triggers of rows that belong to a finished admission take the
finished keys as a table; it is joined, never collected.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_of(column: str, *values: str) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def length_of(column: str, n: int) -> str:
    return f"length({column}) = {n}"


def digest(column: str) -> str:
    return f"{column} RLIKE '^[0-9a-f]{{64}}$'"


def said(column: str, least: int = 1, most: int | None = None) -> str:
    size = f"length(trim({column}))"
    return f"{size} >= {least}" if most is None else f"{size} BETWEEN {least} AND {most}"


def inside(column: str) -> str:
    """A relative path that does not climb and has no backslash."""
    return f"NOT startswith({column}, '/') AND NOT contains({column}, '..') AND NOT contains({column}, chr(92))"


def given(*columns: str) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in columns)


def when(condition: str, then: str) -> str:
    return f"NOT ({condition}) OR ({then})"


def together(a: str, b: str) -> str:
    return f"({a} IS NULL) = ({b} IS NULL)"


_ACTIVE = {"is_active": "is_active IN (0, 1)"}
_RUN = {"status": one_of("status", "pending", "processing", "completed", "failed")}
_DELETION = {"deletion_reason": one_of("deletion_reason", "unreadable", "incomplete", "duplicate", "unneeded", "other"), "deletion_note": "length(deletion_note) <= 500"}
_ORDER = {"display_order": "display_order > 0"}
_ANSWER = {
    "answer_status": one_of("answer_status", "provided", "missing"),
    "answer": "(answer_status = 'missing' AND answer_markdown = '') OR (answer_status = 'provided' AND length(trim(answer_markdown)) > 0)",
}
_QUESTION_NO = {"source_question_no": said("source_question_no", 1, 3)}
_PROGRESS = {"processed_questions": "processed_questions >= 0", "question_count": "question_count > 0", "progress": "processed_questions <= question_count"}
_ENVELOPE = {
    "error_message": "length(error_message) <= 300", "codex_run_id": "length(codex_run_id) BETWEEN 1 AND 200", "input_crop_generation_id": length_of("input_crop_generation_id", 32),
    "input_manifest_sha256": length_of("input_manifest_sha256", 64), "input_manifest_signature": length_of("input_manifest_signature", 64), "output_sha256": length_of("output_sha256", 64), "output_byte_size": "output_byte_size > 0",
}

#: The CHECK rules of every table that has any, by table and name.
CHECKS: dict[str, dict[str, str]] = {
    "regions": _ACTIVE, "exam_types": _ACTIVE, "question_types": _ACTIVE,
    "difficulty_levels": {"level": "level BETWEEN 1 AND 5"},
    "source_papers": {
        "sha256": digest("sha256"), "file_size": "file_size > 0", "original_filename": said("original_filename"), "stored_path": f"startswith(stored_path, 'raw_papers/') AND {inside('stored_path')}",
        "exam_year": "exam_year BETWEEN 1900 AND 9999", "paper_name": said("paper_name"),
    },
    "import_jobs": {
        "page_start": "page_start > 0", "page_end": "page_end > 0", "status": one_of("status", "pending", "processing", "needs_review", "completed", "failed"),
        "pages": f"(page_start IS NULL AND page_end IS NULL) OR ({given('page_start', 'page_end')} AND page_start <= page_end)",
    },
    "import_page_render_runs": _RUN | {
        "dpi": "dpi = 300", "total_pages": "total_pages > 0", "rendered_pages": "rendered_pages >= 0", "manifest_sha256": digest("manifest_sha256"), "manifest_byte_size": "manifest_byte_size > 0",
        "published_batch_id": "length(published_batch_id) BETWEEN 1 AND 100", "source_pdf_sha256": digest("source_pdf_sha256"), "progress": "rendered_pages <= total_pages",
    },
    "import_layout_analysis_runs": _RUN | {
        "total_pages": "total_pages > 0", "analyzed_pages": "analyzed_pages >= 0", "detected_questions": "detected_questions >= 0", "manifest_sha256": length_of("manifest_sha256", 64), "manifest_byte_size": "manifest_byte_size > 0",
        "published_batch_id": "length(published_batch_id) BETWEEN 1 AND 64", "source_pdf_sha256": length_of("source_pdf_sha256", 64), "render_manifest_sha256": length_of("render_manifest_sha256", 64), "progress": "analyzed_pages <= total_pages",
        "completed": when("status = 'completed'", f"{given('total_pages')} AND analyzed_pages = total_pages AND {given('manifest_sha256', 'manifest_byte_size', 'published_batch_id', 'source_pdf_sha256', 'render_manifest_sha256')}"),
    },
    "import_upload_receipts": {"token": said("token", 1, 200)},
    "import_question_split_runs": _RUN | {
        "question_count": "question_count >= 0", "processed_pages": "processed_pages >= 0", "codex_run_id": "length(codex_run_id) BETWEEN 1 AND 200", "result_manifest_sha256": digest("result_manifest_sha256"),
        "render_manifest_sha256": length_of("render_manifest_sha256", 64), "source_pdf_sha256": length_of("source_pdf_sha256", 64), "crop_manifest_sha256": length_of("crop_manifest_sha256", 64),
        "crop_generation_id": length_of("crop_generation_id", 32), "crop_manifest_signature": length_of("crop_manifest_signature", 64),
        "completed": when("status = 'completed'", f"{given('question_count')} AND question_count > 0 AND processed_pages > 0 AND {given('codex_run_id', 'result_manifest_sha256', 'render_manifest_sha256', 'source_pdf_sha256', 'crop_manifest_sha256', 'crop_generation_id', 'crop_manifest_signature', 'completed_at')}"),
    },
    "import_candidate_extraction_runs": _RUN | _PROGRESS | _ENVELOPE | {
        "completed": when("status = 'completed'", f"{given('question_count')} AND processed_questions = question_count AND {given('codex_run_id', 'input_crop_generation_id', 'input_manifest_sha256', 'input_manifest_signature', 'output_sha256', 'output_byte_size', 'completed_at')}"),
    },
    "import_candidate_audit_runs": _RUN | _PROGRESS | _ENVELOPE | {
        "input_candidate_sha256": length_of("input_candidate_sha256", 64), "input_candidate_byte_size": "input_candidate_byte_size > 0",
        "completed": when("status = 'completed'", f"{given('question_count')} AND processed_questions = question_count AND {given('codex_run_id', 'input_candidate_sha256', 'input_candidate_byte_size', 'input_crop_generation_id', 'input_manifest_sha256', 'input_manifest_signature', 'output_sha256', 'output_byte_size', 'completed_at')}"),
    },
    "tag_definitions": _ACTIVE | {"category": one_of("category", "task", "method", "error", "scenario")},
    "knowledge_points": _ACTIVE | {"level": "level BETWEEN 1 AND 3", "sort_order": "sort_order > 0", "root": "(level = 1 AND parent_id IS NULL) OR level > 1"},
    "questions": _ANSWER | _DELETION | {
        "stem": said("stem_markdown"), "exam_year": "exam_year BETWEEN 1900 AND 9999", "score": "score >= 0", "source_file_path": "NOT startswith(source_file_path, '/')",
        "no_analysis": "analysis_markdown IS NOT NULL OR analysis_review_status = 'not_applicable'", "analysis": "analysis_markdown IS NULL OR analysis_review_status <> 'not_applicable'",
        "usable": when("usability_status = 'usable'", " AND ".join([one_of(f"{x}_review_status", "passed", "not_applicable") for x in ("ocr", "formula", "figure")] + [f"{x}_review_status = 'passed'" for x in ("answer", "tag")] + ["(analysis_markdown IS NULL OR analysis_review_status = 'passed')"])),
    },
    "question_options": _ORDER,
    "subquestions": _ORDER | _ANSWER | {"score": "score >= 0"},
    "question_formulas": _ORDER,
    "question_figures": _ORDER | {"relative_path": "NOT startswith(relative_path, '/')", "source_type": one_of("source_type", "original", "cropped", "redrawn", "generated")},
    "question_sources": {"source_question_no": said("source_question_no")},
    "question_assets": _ORDER | {
        "asset_kind": one_of("asset_kind", "complete_question", "question_figure"), "relative_path": inside("relative_path"), "width": "width > 0", "height": "height > 0", "byte_size": "byte_size > 0",
        "sha256": digest("sha256"), "review_status": one_of("review_status", "ai_review_passed"),
    },
    "question_reviews": {"review_item": one_of("review_item", "ocr", "formula", "figure", "answer", "analysis", "tag", "usability"), "reviewer": said("reviewer")},
    "question_versions": {"version_no": "version_no > 0"},
    "baskets": {"basket_key": said("basket_key"), "name": said("name")},
    "basket_items": {"position": "position > 0"},
    "basket_exports": {"question_count": "question_count > 0", "output_path": f"startswith(output_path, 'exports/') AND endswith(output_path, '/练习.md') AND length(output_path) >= length('exports/') + length('/练习.md') AND {inside('output_path')}", "sha256": digest("sha256")},
    "candidate_review_drafts": _DELETION | {
        "source_question_no": said("source_question_no"), "source_candidate_sha256": length_of("source_candidate_sha256", 64), "status": one_of("status", "pending", "draft", "approved", "needs_fix", "needs_recrop"), "version": "version > 0",
        "approval_source": one_of("approval_source", "human", "ai_second_pass"), "approval_evidence": "approval_evidence_json IS NULL OR try_parse_json(approval_evidence_json) IS NOT NULL",
    },
    "corrected_draft_reaudits": _QUESTION_NO | {
        "reviewed_draft_version": "reviewed_draft_version > 0", "edited_sha256": digest("edited_sha256"), "status": one_of("status", "processing", "completed", "failed"),
        **{c: length_of(c, 64) for c in ("source_candidate_sha256", "source_snapshot_sha256", "batch_audit_output_sha256", "crop_manifest_sha256", "crop_manifest_signature", "crop_sha256", "audit_output_sha256")},
        "crop_generation_id": length_of("crop_generation_id", 32), "crop_relative_path": "crop_relative_path RLIKE '^question_crops/Q[0-9]{3}[.]png$'", "crop_byte_size": "crop_byte_size > 0",
        "fresh_model_run_id": "length(fresh_model_run_id) BETWEEN 1 AND 200", "audit_output_byte_size": "audit_output_byte_size > 0", "decision": one_of("decision", "passed", "not_passed", "error"), "confidence": one_of("confidence", "low", "medium", "high"),
        "approved_draft_version": "approved_draft_version > reviewed_draft_version", "error_message": "length(error_message) <= 300",
        "completed": when("status = 'completed'", f"{given('fresh_model_run_id', 'audit_output_sha256', 'audit_output_byte_size', 'decision', 'confidence', 'reviewed_at')} AND error_message IS NULL AND (decision = 'passed') = (approved_draft_version IS NOT NULL)"),
        "failed": when("status = 'failed'", f"coalesce(decision = 'error', false) AND {given('error_message')}"),
    },
    "candidate_knowledge_classifications": _QUESTION_NO | {
        "approved_draft_version": "approved_draft_version > 0", "edited_sha256": digest("edited_sha256"), "classifier": said("classifier", 1, 100), "reviewer": said("reviewer", 1, 100), "classifier_run_id": said("classifier_run_id", 1, 200),
        "evidence_sha256": digest("evidence_sha256"), "reason": "length(reason) <= 200",
    },
    "import_knowledge_classification_runs": _RUN | _PROGRESS | {
        "stage": one_of("stage", "waiting", "level2", "proposal", "verifier", "publishing", "review_ready"), "model": said("model", 1, 100), "input_digest": digest("input_digest"), "taxonomy_digest": digest("taxonomy_digest"),
        "output_sha256": digest("output_sha256"), "output_byte_size": "output_byte_size > 0", "error_message": "length(error_message) <= 100", "claim_token": length_of("claim_token", 64),
        "completed": when("status = 'completed'", f"{given('question_count')} AND processed_questions = question_count AND {given('input_digest', 'taxonomy_digest', 'output_sha256', 'output_byte_size', 'completed_at')} AND error_message IS NULL"),
    },
    "candidate_knowledge_classification_drafts": _QUESTION_NO | {
        "approved_draft_version": "approved_draft_version > 0", "edited_sha256": length_of("edited_sha256", 64), "status": one_of("status", "pending", "approved"), "approval_source": one_of("approval_source", "local_double_pass", "human"),
        "human_review_note": "length(human_review_note) <= 200", "version": "version > 0",
        **{f"{p}_related": f"{p}_related_codes_json IS NULL OR try_parse_json({p}_related_codes_json) IS NOT NULL" for p in ("proposal", "verifier", "final")},
        **{f"{p}_confidence": one_of(f"{p}_confidence", "low", "medium", "high") for p in ("proposal", "verifier")}, **{f"{p}_reason": f"length({p}_reason) BETWEEN 1 AND 200" for p in ("proposal", "verifier")},
        "approval": f"(status = 'pending' AND approval_source IS NULL) OR (status = 'approved' AND {given('approval_source', 'reviewed_at')})",
    },
    "import_web_admission_runs": {
        "status": one_of("status", "processing", "completed", "failed"), "stage": one_of("stage", "preparing_backup", "processing", "admitted_pending_finalize", "completed", "failed"), "claim_token": digest("claim_token"), "expected_count": "expected_count > 0",
        **{f"{p}backup_relative_path": f"{said(f'{p}backup_relative_path', 1, 500)} AND {inside(f'{p}backup_relative_path')}" for p in ("", "finalize_")}, **{f"{p}backup_sha256": digest(f"{p}backup_sha256") for p in ("", "finalize_")},
        **{c: length_of(c, 64) for c in ("pre_backup_source_digest", "backup_snapshot_digest", "finalize_source_digest", "finalize_backup_snapshot_digest")}, **{c: digest(c) for c in ("question_code_digest", "formal_batch_digest")},
        **{c: f"{c} >= 0" for c in ("inserted_count", "already_present_count", "eligible_count")}, "safe_error": "length(safe_error) <= 100",
        "claim": "(status = 'processing') = (claim_token IS NOT NULL)", "lease": when("status = 'processing'", given("claimed_at", "heartbeat_at", "lease_expires_at")),
        "stage_of_status": " OR ".join(f"(status = '{s}' AND {one_of('stage', *stages)})" for s, stages in (("processing", ("preparing_backup", "processing", "admitted_pending_finalize")), ("failed", ("processing", "failed", "admitted_pending_finalize")), ("completed", ("completed",)))),
        "completed": when("stage = 'completed'", f"status = 'completed' AND claim_token IS NULL AND {given('completed_at', 'question_code_digest', 'formal_batch_digest', 'inserted_count', 'already_present_count')} AND eligible_count = expected_count AND {given('finalize_backup_relative_path', 'finalize_backup_sha256')} AND safe_error IS NULL"),
        "admitted": when("stage IN ('admitted_pending_finalize', 'completed')", f"{given('question_code_digest', 'inserted_count', 'already_present_count')} AND eligible_count = expected_count"),
        "backed_up": when("stage IN ('processing', 'admitted_pending_finalize', 'completed')", given("backup_relative_path", "backup_sha256")),
        "backup": together("backup_relative_path", "backup_sha256"), "finalize_backup": together("finalize_backup_relative_path", "finalize_backup_sha256"), "no_lease": "status = 'processing' OR lease_expires_at IS NULL",
    },
}


@dataclass(frozen=True)
class Trigger:
    """Forbids *event* of a row if *old* (a condition on its old state) and *changed* (on ``old`` and ``new``, structs) hold, and, where
    *through* names columns, if its old or new value of one is among the finished keys of that kind (``finished`` of ``forbidden_changes``).
    *exempt* columns may change."""

    name: str
    event: str
    old: str = "true"
    changed: str = "true"
    through: tuple[tuple[str, str], ...] = ()  # (column, kind of key)
    absent: bool = False  # forbidden if the key is NOT among the finished ones
    exempt: tuple[str, ...] = ()


def _of_question(what: str) -> tuple[Trigger, ...]:
    return tuple(Trigger(f"{what}_{e}", e, through=(("question_id", "question"),)) for e in ("insert", "update", "delete"))


_OUTPUT = ("status", "question_count", "model", "input_digest", "taxonomy_digest", "output_sha256", "output_byte_size", "completed_at")
#: The triggers, by table. Finished keys are of kind job and question (of a completed admission), applied (jobs whose
#: classification is applied) and done (completed jobs).
TRIGGERS: dict[str, tuple[Trigger, ...]] = {
    "corrected_draft_reaudits": (Trigger("completed_reaudit", "update", "old.status = 'completed'"),),
    "candidate_knowledge_classifications": (Trigger("classification_update", "update"), Trigger("classification_delete", "delete")),
    "import_knowledge_classification_runs": (
        Trigger("applied_run", "update", "old.applied_at IS NOT NULL"),
        Trigger("completed_run", "delete", "old.status = 'completed' OR old.applied_at IS NOT NULL"),
        Trigger("completed_output", "update", "old.status = 'completed'", " OR ".join(f"new.{c} <> old.{c}" for c in _OUTPUT)),
    ),
    "candidate_knowledge_classification_drafts": tuple(Trigger(f"applied_draft_{e}", e, through=(("import_job_id", "applied"),)) for e in ("update", "delete")),
    "import_web_admission_runs": (
        Trigger("completed_admission", "update", "old.status = 'completed'"),
        Trigger("completed_admission_delete", "delete", "old.status = 'completed'"),
        Trigger("completed_without_job", "insert", changed="new.status = 'completed'", through=(("import_job_id", "done"),), absent=True),
        Trigger("completed_without_job_update", "update", changed="new.status = 'completed'", through=(("import_job_id", "done"),), absent=True),
    ),
    "import_jobs": (Trigger("completed_job_status", "update", "old.status = 'completed'", "new.status <> 'completed'", through=(("id", "job"),)),),
    "questions": (
        Trigger("question_update", "update", through=(("id", "question"),), exempt=("usability_status", "deleted_at", "deletion_reason", "deletion_note", "updated_at")),
        Trigger("question_delete", "delete", through=(("id", "question"),)),
    ),
    "question_sources": tuple(Trigger(f"source_{e}", e, through=(("import_job_id", "job"),)) for e in ("insert", "update", "delete")),
    "question_options": _of_question("option"), "subquestions": _of_question("subquestion"), "question_formulas": _of_question("formula"), "question_figures": _of_question("figure"), "question_tags": _of_question("tag"),
    "question_related_knowledge_points": _of_question("knowledge"), "question_reviews": _of_question("review"), "question_versions": _of_question("version"),
    "question_assets": tuple(Trigger(f"asset_{e}", e, through=(("import_job_id", "job"), ("question_id", "question"))) for e in ("insert", "update", "delete")),
}


def breaks(df: DataFrame, table: str, key: list[str]) -> DataFrame:
    """key, rule of every CHECK of *table* that a row of *df* breaks; rules on columns that *df* lacks raise, as the table would."""
    broken = F.array_compact(F.array(*[F.when(~F.expr(r), F.lit(n)) for n, r in CHECKS[table].items()]))
    return df.select(*key, F.explode(broken).alias("rule"))


def forbidden_changes(old: DataFrame, new: DataFrame, table: str, key: list[str], finished: dict[str, DataFrame]) -> DataFrame:
    """key, event, trigger of every change from *old* to *new* that a trigger of *table* forbids.

    *finished*: for each kind of key that the triggers go through, a frame of one column ``key``."""
    o = old.select(*key, F.struct(*old.columns).alias("old"), F.lit(True).alias("_o"))
    n = new.select(*key, F.struct(*new.columns).alias("new"), F.lit(True).alias("_n"))
    d = o.join(n, key, "full").withColumn("event", F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "delete").otherwise("update"))
    same = lambda skip: F.struct(*[F.col(f"old.{c}") for c in old.columns if c not in skip]).eqNullSafe(F.struct(*[F.col(f"new.{c}") for c in old.columns if c not in skip]))
    d = d.filter((F.col("event") != "update") | ~same(()))
    for column, kind in sorted({t for x in TRIGGERS[table] for t in x.through}):
        done = finished[kind].select("key").distinct()
        for side in ("old", "new"):
            mark = done.select(F.col("key").alias(f"_{side}_key"), F.lit(True).alias(f"_{side}_{column}_{kind}"))
            d = d.join(mark, F.col(f"{side}.{column}") == F.col(f"_{side}_key"), "left").drop(f"_{side}_key")

    def forbids(t: Trigger) -> Column:
        hit = (F.col("event") == t.event) & F.coalesce(F.expr(t.old), F.lit(False)) & F.coalesce(F.expr(t.changed), F.lit(False))
        marks = [F.coalesce(F.col(f"_{side}_{c}_{k}"), F.lit(False)) for c, k in t.through for side in (("new",) if t.absent else ("old", "new"))]
        if marks:
            hit = hit & (~reduce(or_, marks) if t.absent else reduce(or_, marks))
        return hit & ~same(t.exempt) if t.exempt and t.event == "update" else hit

    found = F.array_compact(F.array(*[F.when(forbids(t), F.lit(t.name)) for t in TRIGGERS[table]]))
    return d.select(*key, "event", F.explode(found).alias("trigger"))
