"""Carrier queries for strict admission: evidence, assessment, gates, completion, children, replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemloom.operators import admission, stages, writes
from itemloom.sources import table

NOW = "2024-01-30 12:00:00"


def _k():
    """A document's key, which gives its job, number and flags."""
    return F.col("doc_id")


def _flag(n: int, rest: int = 0):
    return _k() % n == rest


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select("doc_id").distinct()


def _pick(values: list, n: int):
    """values[k] where doc_id % n = k, null beyond them."""
    out = F.when(_flag(n, 0), F.lit(values[0]))
    for k, v in enumerate(values[1:], 1):
        out = out.when(_flag(n, k), F.lit(v))
    return out


_TIMES = ["2024-01-30T11:00:00Z", "2024-01-30T13:00:00+01:00", "2024-01-30T12:04:00Z", "2024-01-30T12:06:00Z", "2024-01-30T11:00:00", "never"]
_METHODS = ["workbench", "workbench_quick", "existing_approval", "other"]


def human_evidence_check(spark, sf_dir):
    """A person's approvals with other sources, methods, times and keys."""
    d = _docs(spark, sf_dir).withColumns({"source": _pick(["human", "human", "ai"], 3), "method": _pick(_METHODS, 5), "t": _pick(_TIMES, 7)})
    keys = F.when(_flag(11), F.array(F.lit("method"))).when(_flag(11, 1), F.array(F.lit("method"), F.lit("reviewed_at"), F.lit("x"))).otherwise(F.array(F.lit("reviewed_at"), F.lit("method")))
    other = F.when(_flag(13), "2024-01-30T10:00:00Z").otherwise(F.col("t"))
    return d.select("doc_id", admission.human_evidence(F.col("source"), F.col("method"), other, F.col("t"), keys, NOW).alias("valid"))


def ai_evidence_check(spark, sf_dir):
    """Second-pass approvals: batch ones against their run, corrected drafts against their re-audit."""
    c = lambda x: F.lit(x)
    k, sha = _k(), lambda x: F.concat(F.lit(x), _k().cast("string"))
    d = _docs(spark, sf_dir).select(
        "doc_id", (k % 10).alias("job_id"), k.cast("string").alias("question_no"), F.when(_flag(17), "pending").otherwise("approved").alias("status"), F.when(_flag(19), "human").otherwise("ai_second_pass").alias("approval_source"),
        F.when(_flag(23), "x").alias("deleted_at"), (k % 4 + 2).alias("version"), c("t").alias("reviewed_at"), c("c").alias("candidate_sha256"), F.when(_flag(29), "old").otherwise("c").alias("candidate_now"),
        sha("s").alias("snapshot_sha256"), sha("s").alias("candidate_text_sha256"), F.when(_flag(3), sha("e")).otherwise(sha("s")).alias("edited_sha256"), c("a").alias("audit_now"), (k % 7 != 0).alias("strict"),
        F.when(_flag(2), "batch_auto_pass").when(_flag(31), "other").otherwise("corrected_draft_reaudit").alias("ev_method"), c("a").alias("ev_audit_sha256"), F.when(_flag(29), "old").otherwise("c").alias("ev_candidate_sha256"), sha("s").alias("ev_snapshot_sha256"),
        F.when(_flag(3), sha("e")).otherwise(sha("s")).alias("ev_edited_sha256"), F.when(_flag(2), F.concat(F.lit("run"), (k % 10).cast("string"))).otherwise(sha("r")).alias("ev_run_id"), c("t").alias("ev_reviewed_at"), (k % 4 + F.when(_flag(37), 1).otherwise(2)).alias("ev_version"), k.alias("ev_reaudit_id"),
    )
    runs = spark.range(10).select(F.col("id").alias("job_id"), F.when(F.col("id") == 4, "failed").otherwise("completed").alias("status"), F.concat(F.lit("run"), F.col("id").cast("string")).alias("run_id"), c("c").alias("input_sha256"), F.when(F.col("id") == 6, "old").otherwise("a").alias("output_sha256"))
    again = d.filter("doc_id % 41 <> 0").select(
        _k().alias("reaudit_id"), "job_id", "question_no", F.when(_flag(43), "failed").otherwise("completed").alias("status"), F.when(_flag(5), "rejected").otherwise("passed").alias("decision"), F.col("candidate_now").alias("candidate_sha256"),
        "snapshot_sha256", c("a").alias("audit_sha256"), "edited_sha256", F.col("ev_run_id").alias("run_id"), "version", "reviewed_at",
    )
    return admission.ai_evidence(d, runs, again).select("doc_id", "evidence_valid")


def _assessed(spark, sf_dir):
    """Documents as candidates, their labels as audits, joined with drafts, crops and figures; every reason occurs."""
    base, key = _docs(spark, sf_dir), ["doc_id"]
    candidates = base.select(
        "doc_id", F.floor(_k() / 8).alias("job_id"), (_k() % 8 + 1).alias("question_no"), F.when(_flag(53), " 　").otherwise("stem").alias("stem"), _pick(["single_choice", "solution", "old", "fill_blank"], 23).alias("_t"),
        F.when(_flag(47), F.array(F.lit("K1"), F.lit("K9"))).otherwise(F.array(F.lit("K1"))).alias("codes"), _flag(6).alias("figure_required"), _flag(9).alias("has_answer"), _flag(10).alias("has_analysis"), F.lit("d").alias("answer_digest_now"),
    ).withColumn("type_code", F.coalesce("_t", F.lit("solution"))).drop("_t")
    drafts = base.filter("doc_id % 4 = 0").select("doc_id", (_k() % 12 != 0).alias("uses_draft"), F.when(_flag(12), "human_approval_status_invalid").alias("content_reason"), _flag(20).alias("deleted"))
    issues = F.when(_flag(7), F.array(F.lit("x"))).when(_flag(11), None).otherwise(F.array().cast("array<string>"))
    audits = base.filter("doc_id % 59 <> 0").select(
        "doc_id", _pick(["disputed", "human_required"], 5).alias("_s"), F.when(_flag(3), "medium").otherwise("high").alias("audit_confidence"), issues.alias("issues"), F.when(_flag(17), F.array(F.lit("y"))).otherwise(F.array().cast("array<string>")).alias("corrections"),
        F.when(_flag(18), "failed").otherwise("passed").alias("answer_status"), F.when(_flag(20), "failed").otherwise("passed").alias("analysis_status"), F.when(_flag(27), "old").otherwise("d").alias("answer_digest"),
    ).withColumn("audit_status", F.coalesce("_s", F.lit("auto_pass"))).drop("_s")
    crops, figures = base.filter("doc_id % 31 <> 0"), base.filter("doc_id % 12 = 0").union(base.filter("doc_id % 24 = 0"))
    types = spark.createDataFrame([("single_choice",), ("fill_blank",), ("solution",)], "code string")
    points = spark.createDataFrame([("K1",), ("K2",)], "code string")
    return admission.assess(admission.assembled(candidates, drafts, audits, crops, figures, key), types, points)


def admission_reasons(spark, sf_dir):
    return _assessed(spark, sf_dir).select("doc_id", F.array_join("reasons", ",").alias("reasons"), "eligible", "unsafe")


def admission_gate(spark, sf_dir):
    return admission.batch_gate(_assessed(spark, sf_dir), "job_id")


_AUDITED = "doc_id % 59 <> 0"
_USES = "(doc_id % 4 = 0 AND doc_id % 12 <> 0)"
_ISSUES_EMPTY = f"({_AUDITED} AND doc_id % 7 <> 0 AND doc_id % 11 <> 0)"
_STRICT = f"({_AUDITED} AND doc_id % 5 > 1 AND doc_id % 3 <> 0 AND {_ISSUES_EMPTY} AND doc_id % 17 <> 0)"
_OPEN = f"(NOT {_USES} AND NOT {_STRICT})"
_RULES = [
    ("doc_id % 12 = 0", "'human_approval_status_invalid'"),
    (f"{_OPEN} AND (NOT {_AUDITED} OR doc_id % 5 < 2)", f"CASE WHEN NOT {_AUDITED} THEN 'audit_missing' WHEN doc_id % 5 = 0 THEN 'disputed' ELSE 'human_required' END"),
    (f"{_OPEN} AND (NOT {_AUDITED} OR doc_id % 3 = 0)", "'audit_confidence_not_high'"), (f"{_OPEN} AND NOT {_ISSUES_EMPTY}", "'audit_issues_present'"), (f"{_OPEN} AND (NOT {_AUDITED} OR doc_id % 17 = 0)", "'audit_corrections_present'"),
    ("doc_id % 20 = 0", "'candidate_deleted'"), ("doc_id % 53 = 0", "'empty_stem'"), ("doc_id % 23 = 2", "'invalid_question_type'"), ("doc_id % 47 = 0", "'missing_knowledge_point'"), ("doc_id % 31 = 0", "'missing_question_crop'"),
    ("doc_id % 6 = 0 AND doc_id % 12 <> 0", "'missing_approved_figure'"), (f"doc_id % 9 = 0 AND (NOT {_AUDITED} OR doc_id % 18 = 0)", "'answer_status_not_passed'"), (f"doc_id % 10 = 0 AND (NOT {_AUDITED} OR doc_id % 20 = 0)", "'analysis_status_not_passed'"),
    (f"(doc_id % 9 = 0 OR doc_id % 10 = 0) AND (NOT {_AUDITED} OR doc_id % 27 = 0)", "'answer_analysis_sha256_mismatch'"),
]
_ASSESS = f"""d AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL),
a AS (SELECT doc_id, concat_ws(',', {", ".join(f"CASE WHEN {c} THEN {n} END" for c, n in _RULES)}) AS reasons FROM d),
r AS (SELECT doc_id, reasons, reasons = '' AS eligible, regexp_matches(reasons, '{"|".join(admission.UNSAFE)}') AS unsafe FROM a)"""


def exact_batches(spark, sf_dir):
    """Customers as jobs, their orders as formal rows: some lost, repeated or with another code."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), (k % 900 + 1).alias("question_no"), k)
    jobs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), F.sha2(F.col("c_name"), 256).alias("source_sha256"))
    f = o.join(jobs, "job_id").select("job_id", "question_no", "o_orderkey", F.concat(F.lit("Q-"), F.substring("source_sha256", 1, 16), F.lit("-"), F.format_string("%03d", F.col("question_no"))).alias("question_code"))
    f = f.withColumn("question_code", F.when(k % 40 == 1, "Q-other").otherwise(F.col("question_code"))).filter("o_orderkey % 30 <> 3")
    f = f.unionByName(f.filter("o_orderkey % 50 = 7")).drop("o_orderkey")
    return admission.exact_batches(jobs, f, o, "job_id").select("job_id", "exact")


def version_matches(spark, sf_dir):
    """Formal rows against the numbers expected of each job: missing, unexpected and repeated ones."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), k.alias("question_no"))
    rows = o.filter("question_no % 7 <> 0")
    return admission.one_version_each(rows.union(rows.filter("question_no % 11 = 0")), o.filter("question_no % 5 <> 0"), "job_id")


def admission_pages(spark, sf_dir):
    """What an admission page shows: stage, drift, and whether it can be applied."""
    p = _docs(spark, sf_dir).withColumns({
        "job_status": _pick(["needs_review", "completed", "processing"], 3), "run_status": _pick(["completed", "processing", "failed"], 5), "run_stage": F.when(_flag(5), F.when(_flag(2), "completed").otherwise("admitted_pending_finalize")).when(_flag(5, 1), "processing").when(_flag(5, 2), "failed"),
        "exact": _k() % 4 < 2, "n": F.lit(3).cast("long"), "n_eligible": F.when(_flag(7), 2).otherwise(3).cast("long"), "evidence_complete": _k() % 11 != 0, "bound_evidence_complete": F.when(_flag(13), None).otherwise(_k() % 17 != 0),
    })
    return admission.admission_page(p).select("doc_id", "stage", "can_apply", "drift")


def claimed_updates(spark, sf_dir):
    """Only the holder of a claim changes a run that is being processed."""
    k = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("t"), (k % 3).cast("string")).alias("claim_token"), F.when(F.col("o_orderstatus") == "O", "processing").otherwise("completed").alias("status"), F.lit("a").alias("stage"))
    return admission.claimed_update(runs, runs.filter("o_orderkey % 2 = 0").select("o_orderkey", F.lit("t1").alias("claim_token"), F.lit("b").alias("stage")), "o_orderkey", ["stage"])


def run_completion(spark, sf_dir):
    """Completion of runs by digest, once: present again, conflicting, refused or incomplete results."""
    k, sha = F.col("o_orderkey"), F.sha2(F.col("o_orderkey").cast("string"), 256)
    status = F.when(F.col("o_orderstatus") == "O", "processing").when(F.col("o_orderstatus") == "F", "completed").otherwise("pending")
    runs = table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), F.when(status == "completed", sha).alias("output_sha256"))
    results = runs.filter("o_orderkey % 7 <> 0").select("o_orderkey", F.when(k % 5 == 0, F.sha2(F.lit("x"), 256)).when(k % 5 == 1, "short").otherwise(sha).alias("output_sha256"))
    return admission.complete_run(runs, results, "o_orderkey", ["output_sha256"])


def auto_pass_apply(spark, sf_dir):
    """A batch's strict passes applied to untouched pending drafts alone."""
    drafts = _docs(spark, sf_dir).select("doc_id", _pick(["pending", "pending", "approved"], 3).alias("status"), F.when(_flag(3, 2), "human").alias("approval_source"), F.when(_flag(3, 2), "t0").alias("reviewed_at"), (_k() % 4).alias("version"), _flag(5).alias("touched"), F.when(_flag(13), "x").alias("deleted_at"))
    entries = _docs(spark, sf_dir).filter("doc_id % 11 <> 0").select("doc_id", F.when(_flag(7), "disputed").otherwise("auto_pass").alias("audit_status"), F.lit("high").alias("audit_confidence"), F.array().cast("array<string>").alias("issues"), F.when(_flag(17), None).otherwise(F.array().cast("array<string>")).alias("corrections"))
    return admission.auto_pass(drafts, entries, ["doc_id"], "t1").drop("deleted_at", "touched")


def replaced_children(spark, sf_dir):
    """Customers' lists of orders of which some are replaced and numbered anew; a lost parent keeps its rows."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("value"))
    new = o.filter("parent % 3 = 0 AND position % 2 = 0").withColumn("value", F.lit("new"))
    return admission.replace_children(o, new, "parent", "position")


def replay_check(spark, sf_dir):
    """Whether a repeated admission would write just the children that are there."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("position"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")).alias("value"))
    again = o.withColumn("value", F.when(F.col("position") % 41 == 0, "other").otherwise(F.col("value"))).filter("position % 53 <> 0")
    return admission.same_children(o, again.union(again.filter("position % 61 = 0")), "parent", ["position", "value"])


def admission_outcomes(spark, sf_dir):
    """A repeatable admission: what is inserted, present or in conflict."""
    k = F.col("p_partkey")
    want = table(spark, sf_dir, "part").select(F.concat(F.lit("Q-"), k.cast("string")).alias("code"), F.sha2("p_name", 256).alias("digest"))
    known = table(spark, sf_dir, "part").filter(k % 3 != 0).select(F.concat(F.lit("Q-"), k.cast("string")).alias("code"), F.when(k % 4 == 0, "old").otherwise(F.sha2("p_name", 256)).alias("digest"))
    return stages.admissions(want, known, "code", "digest")


def restricted_parents(spark, sf_dir):
    """Rows that forbid a parent's deletion, and rows whose reference is emptied by it."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("nation"))
    gone = table(spark, sf_dir, "nation").filter("n_nationkey % 4 = 0").select(F.col("n_nationkey").cast("long").alias("nation"))
    cut = stages.cascade(gone, c, "nation", "null").select("c_custkey", "nation", F.lit("null").alias("how"))
    return cut.unionByName(stages.cascade(gone, c, "nation", "restrict").select("c_custkey", "nation", F.lit("restrict").alias("how")))


def reused_crops(spark, sf_dir):
    """Incremental work: a question is reused if its plan and all its source pages are unchanged."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("plan"), F.col("o_orderstatus").alias("page_sha"))
    old = o.filter(k % 5 != 0).withColumn("page_sha", F.when(k % 7 == 0, None).otherwise(F.col("page_sha"))).withColumn("plan", F.when(k % 11 == 0, "x").otherwise(F.col("plan")))
    return writes.classify_reuse(old, o, ["o_orderkey"], ["plan", "page_sha"])


_FNS = (human_evidence_check, ai_evidence_check, admission_reasons, admission_gate, exact_batches, version_matches, admission_pages, claimed_updates, run_completion, auto_pass_apply, replaced_children, replay_check, admission_outcomes, restricted_parents, reused_crops)
QUERIES = {f.__name__: f for f in _FNS}
_D = "(SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)"
ORACLE_SQL = {
    "human_evidence_check": f"SELECT doc_id, doc_id % 3 < 2 AND doc_id % 5 < 3 AND doc_id % 7 < 3 AND doc_id % 11 > 1 AND (doc_id % 13 <> 0) AS valid FROM {_D}",
    "ai_evidence_check": f"""
WITH d AS (SELECT * FROM {_D}), b AS (SELECT doc_id, doc_id % 17 <> 0 AND doc_id % 19 <> 0 AND doc_id % 23 <> 0 AND doc_id % 29 <> 0 AND doc_id % 37 <> 0 AS base FROM d)
SELECT doc_id, base AND CASE WHEN doc_id % 2 = 0 THEN doc_id % 10 <> 4 AND doc_id % 10 <> 6 AND doc_id % 3 <> 0 AND doc_id % 7 <> 0
  WHEN doc_id % 31 = 0 THEN false ELSE doc_id % 41 <> 0 AND doc_id % 43 <> 0 AND doc_id % 5 <> 0 END AS evidence_valid FROM b""",
    "admission_reasons": f"WITH {_ASSESS} SELECT * FROM r",
    "admission_gate": f"WITH {_ASSESS} SELECT doc_id // 8 AS job_id, count(*) AS n, count(*) FILTER (WHERE eligible) AS n_eligible, bool_or(unsafe) AS aborts, bool_and(eligible) AS strict FROM r GROUP BY 1",
    "exact_batches": """
WITH o AS (SELECT o_custkey AS job_id, o_orderkey % 900 + 1 AS no, o_orderkey AS k FROM orders), f AS (SELECT * FROM o WHERE k % 30 <> 3 UNION ALL SELECT * FROM o WHERE k % 30 <> 3 AND k % 50 = 7),
n AS (SELECT job_id, no, count(*) AS n, bool_and(k % 40 <> 1) AS ok FROM f GROUP BY ALL), e AS (SELECT DISTINCT job_id, no FROM o),
x AS (SELECT e.job_id, bool_and(coalesce(n.n = 1 AND n.ok, false)) AS exact FROM e LEFT JOIN n USING (job_id, no) GROUP BY e.job_id)
SELECT c_custkey AS job_id, coalesce(exact, false) AS exact FROM customer LEFT JOIN x ON job_id = c_custkey""",
    "version_matches": """
SELECT o_custkey AS job_id, o_orderkey AS question_no, CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 11 = 0 THEN 2 ELSE 1 END::BIGINT AS n,
  CASE WHEN o_orderkey % 7 = 0 THEN 'missing' WHEN o_orderkey % 5 = 0 THEN 'unexpected' WHEN o_orderkey % 11 = 0 THEN 'repeated' END AS fault FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 5 <> 0""",
    "admission_pages": f"""
WITH p AS (SELECT doc_id, doc_id % 3 AS j, doc_id % 5 AS r, doc_id % 4 < 2 AS exact FROM {_D}),
q AS (SELECT *, (r = 0 AND NOT (j = 1 AND doc_id % 2 = 0 AND exact)) OR (j = 1 AND r IN (1, 2)) AS drift FROM p),
s AS (SELECT *, NOT drift AND j = 1 AND exact AS done, CASE WHEN drift THEN 'drift' WHEN j = 1 AND exact THEN 'completed' WHEN r = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'completed' ELSE 'admitted_pending_finalize' END WHEN r = 1 THEN 'processing' WHEN r = 2 THEN 'failed' ELSE 'pending' END AS stage FROM q)
SELECT doc_id, stage, NOT drift AND NOT done AND j = 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND stage IN ('pending', 'processing', 'admitted_pending_finalize', 'failed') AS can_apply, drift FROM s""",
    "claimed_updates": """
WITH r AS (SELECT o_orderkey, 't' || (o_orderkey % 3) AS claim_token, CASE WHEN o_orderstatus = 'O' THEN 'processing' ELSE 'completed' END AS status, o_orderkey % 2 = 0 AS asked FROM orders)
SELECT o_orderkey, claim_token, status, CASE WHEN asked AND claim_token = 't1' AND status = 'processing' THEN 'b' ELSE 'a' END AS stage,
  CASE WHEN NOT asked THEN 'kept' WHEN claim_token = 't1' AND status = 'processing' THEN 'updated' ELSE 'lost' END AS outcome FROM r""",
    "run_completion": """
WITH r AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'O' THEN 'processing' WHEN 'F' THEN 'completed' ELSE 'pending' END AS s FROM orders),
o AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'kept' WHEN s = 'processing' AND k % 5 <> 1 THEN 'completed' WHEN s = 'completed' AND k % 5 > 1 THEN 'present' WHEN s = 'completed' THEN 'conflict' ELSE 'refused' END AS outcome FROM r)
SELECT k AS o_orderkey, CASE WHEN outcome = 'completed' THEN 'completed' ELSE s END AS status, CASE WHEN outcome = 'completed' THEN CASE WHEN k % 5 = 0 THEN sha256('x') ELSE sha256(k::VARCHAR) END WHEN s = 'completed' THEN sha256(k::VARCHAR) END AS output_sha256, outcome FROM o""",
    "auto_pass_apply": f"""
WITH d AS (SELECT doc_id, doc_id % 3 AS m, doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND doc_id % 17 <> 0 AND doc_id % 13 <> 0 AS eligible FROM {_D}), c AS (SELECT *, eligible AND m < 2 AND doc_id % 5 <> 0 AS changed FROM d)
SELECT doc_id, CASE WHEN changed OR m = 2 THEN 'approved' ELSE 'pending' END AS status, CASE WHEN changed THEN 'ai_second_pass' WHEN m = 2 THEN 'human' END AS approval_source, CASE WHEN changed THEN 't1' WHEN m = 2 THEN 't0' END AS reviewed_at,
  doc_id % 4 + changed::INT AS version, eligible, changed FROM c""",
    "replaced_children": """
WITH o AS (SELECT o_custkey AS parent, o_orderkey AS position, o_orderpriority AS value FROM orders), n AS (SELECT * FROM o WHERE parent % 3 = 0 AND position % 2 = 0)
SELECT * FROM o WHERE parent NOT IN (SELECT parent FROM n) UNION ALL SELECT parent, row_number() OVER (PARTITION BY parent ORDER BY position), 'new' FROM n""",
    "replay_check": "SELECT o_custkey AS parent, bool_and(o_orderkey % 41 <> 0 AND o_orderkey % 53 <> 0 AND o_orderkey % 61 <> 0) AS equal FROM orders GROUP BY 1",
    "admission_outcomes": "SELECT 'Q-' || p_partkey AS code, CASE WHEN p_partkey % 3 = 0 THEN 'insert' WHEN p_partkey % 4 = 0 THEN 'conflict' ELSE 'present' END AS outcome FROM part",
    "restricted_parents": """
SELECT c_custkey, CASE WHEN c_nationkey % 4 <> 0 THEN c_nationkey::BIGINT END AS nation, 'null' AS how FROM customer UNION ALL SELECT c_custkey, c_nationkey::BIGINT, 'restrict' FROM customer WHERE c_nationkey % 4 = 0""",
    "reused_crops": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'new' WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN 'recrop' ELSE 'reuse' END AS action FROM orders",
}
