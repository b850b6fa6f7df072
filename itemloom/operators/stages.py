"""State derivation over one joined row a job or question: next stage, anchors, effective content, finalising, lifecycles.

All rules are first-match chains of conditions; the time is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itemloom.functions import all_of
from itemloom.operators.review import first_rule


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def batch_numbers(entries: DataFrame, job: str, number: str) -> DataFrame:
    """job, numbers (sorted), whole: whether every number is canonical and none repeats. A job has at most some hundred entries."""
    good = _true(F.col(number).rlike("^[1-9][0-9]{0,2}$"))
    d = entries.groupBy(job).agg(F.sort_array(F.collect_set(number)).alias("numbers"), F.count(F.lit(1)).alias("_n"), F.every(good).alias("_good"))
    return d.select(job, "numbers", (F.col("_good") & (F.size("numbers") == F.col("_n"))).alias("whole"))


def pipeline_stage(jobs: DataFrame) -> DataFrame:
    """*jobs* with stage and next_action.

    Columns read: status, admitted, artifacts_readable, render_completed, render_matches, candidate_numbers, crop_numbers, audit_numbers (arrays of
    texts, null where there is no valid batch) and crops_reviewed. The first rule that holds decides."""
    same = lambda a: _true(F.sort_array(F.col(a)) == F.sort_array("candidate_numbers"))
    rules = [
        (F.col("status").isNull(), "not_found", "check_job_id"),
        (F.col("status") == "completed", "completed", "none"),
        (F.col("status") == "needs_review", "needs_review", "manual_review"),
        (F.col("status") == "processing", "in_progress", "wait_or_recover"),
        (F.col("status") == "failed", "failed", "manual_review"),
        (_true(F.col("admitted")), "needs_review", "manual_review"),
        (~_true(F.col("artifacts_readable")), "unavailable", "check_artifacts"),
        (~(_true(F.col("render_completed")) & _true(F.col("render_matches"))), "needs_render", "render_pages"),
        (F.col("candidate_numbers").isNull(), "needs_candidates", "provide_candidate_questions"),
        (~same("crop_numbers"), "needs_crops", "provide_crop_plan"),
        (~_true(F.col("crops_reviewed")), "needs_crop_review", "review_crops"),
        (~same("audit_numbers"), "needs_ai_review", "provide_ai_audit"),
    ]
    return jobs.withColumns({
        "stage": first_rule([(c, s) for c, s, _ in rules], "ready"),
        "next_action": first_rule([(c, a) for c, _, a in rules], "run_strict_admission"),
    })


def anchor_state(status: Column, stored: list[Column], now: list[Column]) -> Column:
    """none without a completed run, valid if every stored upstream digest is today's, else stale (a missing digest is stale)."""
    return F.when(~_true(status == "completed"), "none").when(_true(all_of([a == b for a, b in zip(stored, now, strict=True)])), "valid").otherwise("stale")


def effective_content(questions: DataFrame) -> DataFrame:
    """*questions* with content (which text counts: candidate or draft), content_source and content_reason (null: usable).

    Columns read: candidate_sha256, audit_eligible, audit_anchored, draft_status (null: no draft), approval_source, evidence_valid (the
    approval's evidence was made for this candidate, audit and version), draft_candidate_sha256, draft_changed."""
    no_draft, ai = F.col("draft_status").isNull(), _true(F.col("approval_source") == "ai_second_pass")
    fresh = _true(F.col("draft_candidate_sha256") == F.col("candidate_sha256"))
    reason = (
        F.when(no_draft & ~(_true(F.col("audit_eligible")) & _true(F.col("audit_anchored"))), "batch_ai_approval_not_anchored")
        .when(no_draft, None)
        .when(~_true(F.col("draft_status") == "approved"), "human_approval_status_invalid")
        .when(ai & ~_true(F.col("evidence_valid")), "ai_approval_provenance_invalid")
        .when(ai, None)
        .when(~_true(F.col("evidence_valid")), "human_approval_evidence_invalid")
        .when(~fresh, "human_review_source_changed")
    )
    d = questions.withColumn("content_reason", reason)
    draft = F.col("content_reason").isNull() & ~no_draft
    name = F.when(F.col("content_reason").isNotNull(), "rejected").when(no_draft, "pristine").when(ai, "ai_approved").when(_true(F.col("draft_changed")), "human_edited").otherwise("human_approved")
    return d.withColumns({"content": F.when(draft, "draft").otherwise("candidate"), "content_source": name})


def finalize_plan(drafts: DataFrame, job: str) -> DataFrame:
    """*drafts* with outcome: kept (approved on valid evidence), promoted (untouched, pending, strictly passed and anchored), pending, or
    rejected (approved, but its evidence or its binding to the candidate is invalid, or its source is none that may approve): one rejected row
    stops its job.

    Columns read: status, approval_source, bound (it is about the candidate as it is now), evidence_valid, touched, strict, anchored."""
    promote = _true(F.col("status") == "pending") & _true(F.col("bound")) & ~_true(F.col("touched")) & _true(F.col("strict")) & _true(F.col("anchored"))
    sound = _true(F.col("bound")) & _true(F.col("evidence_valid")) & _true(F.col("approval_source").isin("human", "ai_second_pass"))
    return drafts.withColumn("outcome", F.when((F.col("status") == "approved") & sound, "kept").when(F.col("status") == "approved", "rejected").when(promote, "promoted").otherwise("pending"))


def finalize_report(plan: DataFrame, job: str, number: str) -> DataFrame:
    """One row a job: counts by outcome and by source, the numbers promoted, pending and rejected in order, complete.

    n_changed counts rows whose text differs from the candidate (touched); complete needs no pending and no rejected row."""
    listed = lambda s: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("outcome") == s, F.col(number).cast("long")))), lambda n: n.cast("string")), ",")
    counts = [F.count_if(F.col("outcome") == s).alias(f"n_{s}") for s in ("kept", "promoted", "pending", "rejected")]
    ok = F.col("outcome").isin("kept", "promoted")
    human, ai = F.count_if(ok & _true(F.col("approval_source") == "human")), F.count_if((F.col("outcome") == "promoted") | ((F.col("outcome") == "kept") & _true(F.col("approval_source") == "ai_second_pass")))
    return plan.groupBy(job).agg(*counts, human.alias("n_human"), ai.alias("n_ai"), F.count_if(ok & _true(F.col("touched"))).alias("n_changed"), listed("promoted").alias("promoted"), listed("pending").alias("pending"), listed("rejected").alias("rejected"), F.every(ok).alias("complete"))


def knowledge_overlay(draft_codes: Column, evidence_codes: Column, active: Column) -> Column:
    """The draft's codes if all of them are active, else those of the evidence (if there are any)."""
    own = F.size(F.array_except(draft_codes, active)) == 0
    return F.when(_true(own) | evidence_codes.isNull(), draft_codes).otherwise(evidence_codes)


def related_codes(primary: Column, related: Column) -> Column:
    """Related codes each once in their order, without the primary."""
    return F.array_remove(F.array_distinct(related), primary)


def classification_review(old: Column, new: Column, allowed: Column) -> Column:
    """What a person's choice does to a classification: rejected (not allowed), confirmed (as it was) or changed."""
    return F.when(~_true(F.array_contains(allowed, new)), "rejected").when(old.eqNullSafe(new), "confirmed").otherwise("changed")


def append_versions(chain: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """*chain* (key, version_no, previous_version, version_status, *columns*) with a new version of each key of *new* whose columns
    differ from the current one (all of a key without versions); what was current is superseded."""
    now = chain.filter("version_status = 'current'").select(*key, F.col("version_no").alias("_v"), *[F.col(c).alias(f"_{c}") for c in columns])
    d = new.join(now, key, "left")
    same = F.col("_v").isNotNull()
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    add = d.filter(~same).select(*key, (F.coalesce("_v", F.lit(0)) + 1).cast("long").alias("version_no"), F.col("_v").cast("long").alias("previous_version"), F.lit("current").alias("version_status"), *columns)
    old = chain.join(add.select(*key, F.lit(True).alias("_new")), key, "left")
    old = old.withColumn("version_status", F.when(F.col("_new"), "superseded").otherwise(F.col("version_status"))).select(*key, "version_no", "previous_version", "version_status", *columns)
    return old.unionByName(add)


def admissions(wanted: DataFrame, known: DataFrame, code: str, digest: str) -> DataFrame:
    """code, outcome of a repeatable admission: insert, present (same digest) or conflict."""
    k = known.select(code, F.col(digest).alias("_d"), F.lit(True).alias("_k"))
    d = wanted.select(code, digest).join(k, code, "left")
    return d.select(code, F.when(F.col("_k").isNull(), "insert").when(F.col(digest).eqNullSafe(F.col("_d")), "present").otherwise("conflict").alias("outcome"))


def reaudit_state(drafts: DataFrame, audits: DataFrame, key: list[str]) -> DataFrame:
    """*drafts* (key, version, edited_sha256) with reaudit: adopted, failed or running of the re-audit made for just this version and
    content, else needed. Re-audits of older versions never count."""
    a = audits.groupBy(*key, "version", "edited_sha256").agg(F.max_by("status", "run_no").alias("_s"))
    d = drafts.join(a, [*key, "version", "edited_sha256"], "left")
    return d.withColumn("reaudit", F.when(F.col("_s") == "passed", "adopted").when(F.col("_s").isin("failed", "running"), F.col("_s")).otherwise("needed")).drop("_s")


def next_after(df: DataFrame, group: list[str], number: str, gone: Column, name: str = "next_no") -> DataFrame:
    """*df* with the number to show after each row: the next that is not *gone*, else the first that isn't (null: none left)."""
    live = F.when(~_true(gone), F.col(number))
    w = W.partitionBy(*group).orderBy(number)
    behind = F.first(live, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    return df.withColumn(name, F.coalesce(behind, F.min(live).over(W.partitionBy(*group))))


def guidance(parts: list[Column], most: int = 8) -> Column:
    """Review hints: given in order, empty ones dropped, each once, at most *most*."""
    return F.slice(F.array_distinct(F.array_compact(F.concat(*parts))), 1, most)


def protected_changes(old: DataFrame, new: DataFrame, key: list[str], protected: Column, exempt: list[str]) -> DataFrame:
    """key, violation (changed or deleted) of rows that *protected* (on the old row) shields; *exempt* columns may change."""
    columns = [c for c in old.columns if c not in key and c not in exempt]
    n = new.select(*key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_n"))
    d = old.filter(_true(protected)).join(n, key, "left")
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return d.withColumn("violation", F.when(F.col("_n").isNull(), "deleted").when(differs, "changed")).filter("violation IS NOT NULL").select(*key, "violation")


def cascade(parents_gone: DataFrame, child: DataFrame, key: str, how: str) -> DataFrame:
    """What a parent's deletion does to *child*: cascade drops its rows, null empties the reference, restrict returns the rows that forbid it."""
    if how == "cascade":
        return child.join(parents_gone.select(key), key, "left_anti")
    if how == "restrict":
        return child.join(parents_gone.select(key), key, "left_semi")
    if how == "null":
        gone = parents_gone.select(key).distinct().withColumn("_gone", F.lit(True))
        return child.join(gone, key, "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).select(*child.columns)
    raise ValueError(how)


STAGES = ("render", "layout", "split", "candidates", "audit", "admission")


def stage_board(jobs: DataFrame, runs: dict[str, DataFrame], job: str, counts: dict[str, DataFrame] | None = None) -> DataFrame:
    """*jobs* with ``<stage>_<column>`` of each stage's one run a job (null where there is none) and ``n_<name>`` rows of each of *counts*."""
    for stage, df in runs.items():
        jobs = jobs.join(df.select(job, *[F.col(c).alias(f"{stage}_{c}") for c in df.columns if c != job]), job, "left")
    for name, df in (counts or {}).items():
        jobs = jobs.join(df.groupBy(job).agg(F.count(F.lit(1)).alias(f"n_{name}")), job, "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)).cast("long"))
    return jobs


def claimable(stage: str) -> Column:
    """Whether a job of the board may be claimed for *stage*: the stage before is completed with its digest, this one is not running or done,
    and everything it starts from is anchored. Columns: job_status, ``<stage>_status``, ``<stage>_output_sha256``."""
    before = STAGES[STAGES.index(stage) - 1] if stage != "render" else None
    before = "render" if stage == "split" else before  # layout is optional
    free = ~_true(F.col(f"{stage}_status").isin("processing", "completed"))
    ready = F.lit(True) if before is None else _true((F.col(f"{before}_status") == "completed") & F.col(f"{before}_output_sha256").isNotNull())
    return free & ready & _true(F.col("job_status").isin("pending", "needs_review"))


def retryable(receipts: DataFrame, board: DataFrame, job: str) -> DataFrame:
    """Pending jobs that came with a receipt and whose automatic work broke off: not rendered, or rendered and not split; failed work never."""
    d = board.join(receipts.select(job).distinct(), job, "left_semi")
    render, split = F.col("render_status"), F.col("split_status")
    unsplit = split.isNull() | split.isin("pending", "processing")
    return d.filter(_true(F.col("job_status") == "pending") & unsplit & (render.isNull() | render.isin("processing", "completed"))).select(job)


def recovery_loop(pending, retry, wait, most: int = 100) -> int:
    """Retry until nothing retryable is left: *pending*() gives a DataFrame of jobs, *retry*(it) works on them, *wait*(n) backs off before the
    n-th round. A round that leaves the jobs as they were still counts; after *most* rounds it raises."""
    for n in range(most):
        jobs = pending()
        if jobs.isEmpty():
            return n
        if n:
            wait(n)
        retry(jobs)
    raise RuntimeError(f"jobs are left after {most} rounds")


def review_summary(rows: DataFrame, group: list[str]) -> DataFrame:
    """total, n_deleted, n_high, n_medium, n_figures, n_focus (a hint is given) by group; deleted rows count as total and deleted only.

    Columns read: deleted, confidence, figure_required, hints."""
    live = ~_true(F.col("deleted"))
    n = lambda c: F.count_if(live & _true(c))
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("total"), F.count_if(~live).alias("n_deleted"), n(F.col("confidence") == "high").alias("n_high"), n(F.col("confidence") == "medium").alias("n_medium"), n(F.col("figure_required")).alias("n_figures"), n(F.size("hints") > 0).alias("n_focus"))


def with_status(rows: DataFrame, status: str | None = None, column: str = "audit_status") -> DataFrame:
    """Rows of one status, those that need a person by default; ``all`` for every row."""
    wanted = status or "human_required"
    return rows if wanted == "all" else rows.filter(F.col(column) == wanted)
