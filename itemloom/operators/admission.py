"""Strict admission: approval evidence, assessment of each question, batch gates, claims and completion.

Inputs are joined row tables; what a rule needs is a named column. Reason texts must equal the reference's, they are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itemloom.functions import item_code, reason_list, zoned_time
from itemloom.operators.review import strict_pass

#: Reasons that stop a whole batch, methods of a person's approval, an option's code (in lower case), stages in which an admission may be applied.
UNSAFE = [
    "empty_stem", "invalid_question_type", "missing_knowledge_point", "missing_question_crop", "missing_approved_figure",
    "answer_status_not_passed", "analysis_status_not_passed", "answer_analysis_sha256_mismatch",
]
HUMAN_METHODS = ["workbench", "workbench_quick", "existing_approval"]
OPTION_CODE = r"^[a-z0-9][a-z0-9_.-]{0,15}$"
OPEN_STAGES = ["pending", "processing", "admitted_pending_finalize", "failed"]


def holds(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def human_evidence(source: Column, method: Column, evidence_time: Column, reviewed_at: Column, keys: Column, now: str) -> Column:
    """Whether a person's approval is in order: exactly a method and a time, which is the draft's, with a zone and not ahead of *now*."""
    exact = F.array_sort(keys) == F.array(F.lit("method"), F.lit("reviewed_at"))
    return holds((source == "human") & exact & method.isin(HUMAN_METHODS) & (evidence_time == reviewed_at) & zoned_time(reviewed_at, now))


def ai_evidence(drafts: DataFrame, runs: DataFrame, reaudits: DataFrame, job: str = "job_id", number: str = "question_no") -> DataFrame:
    """*drafts* with evidence_valid for approvals by a second pass.

    *drafts*: status, approval_source, deleted_at, version, reviewed_at, candidate_sha256 and snapshot_sha256 (of the draft),
    edited_sha256, candidate_now, candidate_text_sha256, audit_now (what they must be today), strict (the audit's entry passed strictly), and
    the evidence's fields ev_method, ev_audit_sha256, ev_candidate_sha256, ev_snapshot_sha256, ev_edited_sha256, ev_run_id, ev_reviewed_at, ev_version,
    ev_reaudit_id. *runs*: one audit run a job. *reaudits*: re-audits of corrected drafts by id.
    A batch approval must name the completed run of just this candidate and audit, and leave the text as it was; a corrected draft's
    must equal its re-audit in every field."""
    r = runs.select(job, F.col("status").alias("_rs"), F.col("run_id").alias("_run"), F.col("input_sha256").alias("_in"), F.col("output_sha256").alias("_out"))
    a = reaudits.select(F.col("reaudit_id").alias("_id"), *[F.col(c).alias(f"_a_{c}") for c in (job, number, "status", "decision", "candidate_sha256", "snapshot_sha256", "audit_sha256", "edited_sha256", "run_id", "version", "reviewed_at")])
    d = drafts.join(r, job, "left").join(a, F.col("ev_reaudit_id") == F.col("_id"), "left")
    base = (F.col("status") == "approved") & (F.col("approval_source") == "ai_second_pass") & F.col("deleted_at").isNull()
    base = base & (F.col("candidate_sha256") == F.col("candidate_now")) & (F.col("snapshot_sha256") == F.col("candidate_text_sha256"))
    named = (F.col("ev_audit_sha256") == F.col("audit_now")) & (F.col("ev_candidate_sha256") == F.col("candidate_now")) & (F.col("ev_snapshot_sha256") == F.col("candidate_text_sha256"))
    own = named & (F.col("ev_edited_sha256") == F.col("edited_sha256")) & (F.col("ev_reviewed_at") == F.col("reviewed_at")) & (F.col("ev_version") == F.col("version"))
    batch = (F.col("_rs") == "completed") & (F.col("_in") == F.col("candidate_now")) & (F.col("_out") == F.col("audit_now")) & (F.col("edited_sha256") == F.col("candidate_text_sha256"))
    batch = batch & F.col("strict") & (F.col("ev_run_id") == F.col("_run"))
    same = [(job, job), (number, number), ("candidate_sha256", "candidate_now"), ("snapshot_sha256", "candidate_text_sha256"), ("audit_sha256", "audit_now"), ("edited_sha256", "edited_sha256"), ("run_id", "ev_run_id"), ("version", "version"), ("reviewed_at", "reviewed_at")]
    again = (F.col("_a_status") == "completed") & (F.col("_a_decision") == "passed")
    for theirs, ours in same:
        again = again & (F.col(f"_a_{theirs}") == F.col(ours))
    ok = base & own & F.when(F.col("ev_method") == "batch_auto_pass", batch).when(F.col("ev_method") == "corrected_draft_reaudit", again)
    return d.withColumn("evidence_valid", holds(ok)).select(*drafts.columns, "evidence_valid")


def assembled(candidates: DataFrame, drafts: DataFrame, audits: DataFrame, crops: DataFrame, figures: DataFrame, key: list[str]) -> DataFrame:
    """Candidates with their draft's, audit's columns (null where there is none), has_crop and has_figure; figures may be many."""
    marks = [(crops, "has_crop"), (figures, "has_figure")]
    d = candidates.join(drafts, key, "left").join(audits, key, "left")
    for df, name in marks:
        d = d.join(df.select(*key).distinct().withColumn(f"_{name}", F.lit(True)), key, "left").withColumn(name, F.col(f"_{name}").isNotNull()).drop(f"_{name}")
    return d


def assess(rows: DataFrame, types: DataFrame, points: DataFrame) -> DataFrame:
    """*rows* with reasons (in the order of the rules), eligible and unsafe.

    Columns read: content_reason (null: usable), uses_draft, deleted, stem, type_code, codes (array: primary and related), has_crop, figure_required,
    has_figure, audit_status, audit_confidence, issues, corrections, has_answer, answer_status, has_analysis, analysis_status,
    answer_digest, answer_digest_now. *types*, *points*: code (active ones)."""
    t = types.select(F.col("code").alias("type_code"), F.lit(True).alias("_type")).distinct()
    p = points.select("code").distinct().withColumn("_point", F.lit(True))
    lists = rows.select("codes").distinct().select("codes", F.explode("codes").alias("code")).join(p, "code", "left")
    lists = lists.groupBy("codes").agg(F.every(F.col("_point").isNotNull()).alias("_known"))  # equal lists are looked up once
    d = rows.join(t, "type_code", "left").join(lists, "codes", "left").select(*rows.columns, "_type", "_known")
    audited = ~holds(F.col("uses_draft")) & ~strict_pass(F.col("audit_status"), F.col("audit_confidence"), F.col("issues"), F.col("corrections"))
    said = holds(F.col("has_answer")) | holds(F.col("has_analysis"))
    empty = lambda a: holds(F.size(a) == 0)
    parts = [
        F.col("content_reason"),
        F.when(audited & ~holds(F.col("audit_status") == "auto_pass"), F.coalesce("audit_status", F.lit("audit_missing"))),
        F.when(audited & ~holds(F.col("audit_confidence") == "high"), "audit_confidence_not_high"),
        F.when(audited & ~empty("issues"), "audit_issues_present"),
        F.when(audited & ~empty("corrections"), "audit_corrections_present"),
        F.when(holds(F.col("deleted")), "candidate_deleted"),
        F.when(~holds(F.length(F.regexp_replace("stem", r"(?U)\s+", "")) > 0), "empty_stem"),
        F.when(F.col("_type").isNull(), "invalid_question_type"),
        F.when(~holds((F.size("codes") == 0) | F.col("_known")), "missing_knowledge_point"),
        F.when(~holds(F.col("has_crop")), "missing_question_crop"),
        F.when(holds(F.col("figure_required")) & ~holds(F.col("has_figure")), "missing_approved_figure"),
        F.when(holds(F.col("has_answer")) & ~holds(F.col("answer_status") == "passed"), "answer_status_not_passed"),
        F.when(holds(F.col("has_analysis")) & ~holds(F.col("analysis_status") == "passed"), "analysis_status_not_passed"),
        F.when(said & ~holds(F.col("answer_digest") == F.col("answer_digest_now")), "answer_analysis_sha256_mismatch"),
    ]
    d = d.withColumn("reasons", F.array_compact(F.array(*parts))).drop("_type", "_known")
    return d.withColumns({"eligible": F.size("reasons") == 0, "unsafe": F.arrays_overlap("reasons", F.array(*[F.lit(x) for x in UNSAFE]))})


def batch_gate(assessed: DataFrame, job: str) -> DataFrame:
    """job, n, n_eligible, aborts (a row is unsafe), strict (all rows eligible, numbers each once)."""
    d = assessed.groupBy(job).agg(F.count(F.lit(1)).alias("n"), F.count_if("eligible").alias("n_eligible"), F.max("unsafe").alias("aborts"), F.count_distinct("question_no").alias("_numbers"))
    return d.select(job, "n", "n_eligible", "aborts", ((F.col("n") == F.col("n_eligible")) & (F.col("n") == F.col("_numbers"))).alias("strict"))


def exact_batches(jobs: DataFrame, formal: DataFrame, expected: DataFrame, job: str) -> DataFrame:
    """*jobs* (job, source_sha256) with exact: its formal rows (job, question_no, question_code) are those expected, each once, with codes as computed."""
    f = formal.join(jobs.select(job, "source_sha256"), job).withColumn("_ok", F.col("question_code") == item_code("Q-", F.col("source_sha256"), F.col("question_no")))
    own = f.groupBy(job, "question_no").agg(F.count(F.lit(1)).alias("_n"), F.every(holds(F.col("_ok"))).alias("_ok"))
    e = expected.select(job, "question_no").distinct().withColumn("_e", F.lit(True))
    both = own.join(e, [job, "question_no"], "full").groupBy(job).agg(F.every(holds(F.col("_e") & F.col("_ok") & (F.col("_n") == 1))).alias("_exact"))
    return jobs.join(both, job, "left").withColumn("exact", holds(F.col("_exact"))).drop("_exact")


def admission_page(pages: DataFrame) -> DataFrame:
    """*pages* with stage, can_apply and drift.

    Columns read: job_status, run_status, run_stage (null: no run), exact, n, n_eligible, evidence_complete, bound_evidence_complete."""
    drift = holds(F.col("run_status") == "completed") & ~holds((F.col("job_status") == "completed") & (F.col("run_stage") == "completed") & F.col("exact"))
    drift = drift | holds((F.col("job_status") == "completed") & F.col("run_status").isNotNull() & (F.col("run_status") != "completed"))
    done = ~drift & holds((F.col("job_status") == "completed") & F.col("exact"))
    stage = F.when(drift, "drift").when(done, "completed").otherwise(F.coalesce("run_stage", F.lit("pending")))
    can = (F.col("job_status") == "needs_review") & (F.col("n") > 0) & (F.col("n") == F.col("n_eligible")) & F.col("evidence_complete") & F.col("bound_evidence_complete") & stage.isin(OPEN_STAGES)
    return pages.withColumns({"stage": stage, "can_apply": ~drift & ~done & holds(can), "drift": drift})


def claimed_update(runs: DataFrame, changes: DataFrame, key: str, values: list[str]) -> DataFrame:
    """*runs* (key, claim_token, status, *values*) after *changes* by whoever holds the claim; outcome: updated, lost or kept."""
    c = changes.select(key, F.col("claim_token").alias("_t"), *[F.col(v).alias(f"_{v}") for v in values])
    d = runs.join(c, key, "left")
    hit = holds((F.col("_t") == F.col("claim_token")) & (F.col("status") == "processing"))
    out = {v: F.when(hit, F.col(f"_{v}")).otherwise(F.col(v)) for v in values}
    state = F.when(hit, "updated").when(F.col("_t").isNotNull(), "lost").otherwise("kept")
    return d.withColumns(out | {"outcome": state}).select(*runs.columns, "outcome")


def complete_run(runs: DataFrame, results: DataFrame, key: str, digests: list[str]) -> DataFrame:
    """Completion of runs, once: processing runs whose result has every digest become completed; completed ones never change (conflict if other
    digests are offered), others are refused."""
    r = results.select(key, *[F.col(x).alias(f"_{x}") for x in digests], F.lit(True).alias("_r"))
    d, same, whole = runs.join(r, key, "left"), F.lit(True), F.lit(True)
    for x in digests:
        same, whole = same & F.col(x).eqNullSafe(F.col(f"_{x}")), whole & holds(F.col(f"_{x}").rlike("^[0-9a-f]{64}$"))
    hit = holds(F.col("_r") & (F.col("status") == "processing")) & whole
    state = F.when(F.col("_r").isNull(), "kept").when(hit, "completed").when((F.col("status") == "completed") & same, "present").when(F.col("status") == "completed", "conflict").otherwise("refused")
    out = {x: F.when(hit, F.col(f"_{x}")).otherwise(F.col(x)) for x in digests} | {"status": F.when(hit, "completed").otherwise(F.col("status")), "outcome": state}
    return d.withColumns(out).select(*runs.columns, "outcome")


def auto_pass(drafts: DataFrame, entries: DataFrame, key: list[str], at: str) -> DataFrame:
    """*drafts* after a batch's strict passes were applied to untouched pending ones (version + 1), with eligible and changed.

    *drafts*: status, approval_source, reviewed_at, version, touched, deleted_at; *entries*: key, audit_status, audit_confidence, issues, corrections."""
    e = entries.select(*key, strict_pass(F.col("audit_status"), F.col("audit_confidence"), F.col("issues"), F.col("corrections")).alias("eligible"))
    d = drafts.join(e, key, "left").withColumn("eligible", holds(F.col("eligible")) & F.col("deleted_at").isNull())
    d = d.withColumn("changed", F.col("eligible") & (F.col("status") == "pending") & ~holds(F.col("touched")))
    new = {"status": F.lit("approved"), "approval_source": F.lit("ai_second_pass"), "reviewed_at": F.lit(at), "version": F.col("version") + 1}
    return d.withColumns({k: F.when(F.col("changed"), v).otherwise(F.col(k)) for k, v in new.items()})


def replace_children(children: DataFrame, new: DataFrame, parent: str, position: str) -> DataFrame:
    """*children* in which each parent that *replaced* rows of *new* name has just these, in order of position, numbered from 1."""
    kept = children.join(new.select(parent).distinct(), parent, "left_anti")
    order = F.row_number().over(W.partitionBy(parent).orderBy(position)).cast("long")
    return kept.unionByName(new.withColumn(position, order).select(*children.columns))


def same_children(a: DataFrame, b: DataFrame, parent: str, columns: list[str]) -> DataFrame:
    """parent, equal: whether both tables have the same rows of it, each as often (put a position among *columns* where order counts)."""
    side = lambda df, n: df.select(parent, *columns, F.lit(n).alias("_n"))
    d = side(a, 1).unionByName(side(b, -1)).groupBy(parent, *columns).agg(F.sum("_n").alias("_n"))
    return d.groupBy(parent).agg(F.every(F.col("_n") == 0).alias("equal"))


def one_version_each(rows: DataFrame, expected: DataFrame, job: str) -> DataFrame:
    """job, question_no, n, fault (missing, unexpected, repeated, or null) of formal rows against the numbers expected of each job."""
    e = expected.select(job, "question_no").distinct().withColumn("_e", F.lit(True))
    d = rows.groupBy(job, "question_no").agg(F.count(F.lit(1)).alias("n")).join(e, [job, "question_no"], "full")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return d.select(job, "question_no", F.coalesce("n", F.lit(0)).cast("long").alias("n"), fault.alias("fault"))


def edited_structure(options: Column, related: Column, subquestions: Column, choice: Column) -> Column:
    """Reasons against an edited text's structure: options array<struct<code, content>>, related array<string>, subquestions array<struct<label, stem>>."""
    codes = F.transform(options, lambda o: F.lower(F.regexp_replace(o["code"], r"(?U)^\s+|\s+$", "")))
    return reason_list({
        "options": ~holds(F.forall(options, lambda o: o["code"].isNotNull() & o["content"].isNotNull())),
        "option_code": ~holds(F.forall(codes, lambda c: holds(c.rlike(OPTION_CODE)))),
        "repeated_codes": ~holds(F.size(codes) == F.size(F.array_distinct(codes))),
        "related": ~holds(F.forall(related, lambda c: c.isNotNull())),
        "too_few_options": choice & ~holds(F.size(options) >= 2),
        "subquestions": ~holds(F.forall(subquestions, lambda s: s["label"].isNotNull() & s["stem"].isNotNull())),
    })
