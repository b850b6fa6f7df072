"""Carrier queries for batches, states and lifecycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemloom.functions import first_keyword, shortened
from itemloom.operators import batches, stages, writes
from itemloom.sources import table


def _joined(a, sep=","):
    return F.array_join(a, sep)


def split_plan_check(spark, sf_dir):
    """Turns as questions of a plan on pages 1 to 3, some wrong; the reasons against each."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    size = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    box = F.when(F.col("turn") % 4 == 3, F.array(F.lit(0.5), F.lit(0.1), F.lit(0.5), F.lit(0.9))).otherwise(F.array(F.lit(0.0), F.lit(0.1), F.lit(1.0), F.lit(0.9)))
    region = F.struct((F.col("turn") % 4 + 1).cast("int").alias("page_number"), box.alias("bbox"))
    q = c.join(size, "conv_id").select(
        "conv_id", (F.col("turn") + 1).alias("position"), F.when(F.col("turn") == 1, 1).otherwise(F.col("turn") + 1).alias("question_no"), (F.col("n") + (F.col("conv_id") % 6 == 0).cast("int")).alias("declared"),
        F.when(F.col("turn") % 5 == 4, "sure").when(F.col("turn") % 2 == 0, "high").otherwise("0.75").alias("confidence"), F.array().cast("array<string>").alias("warnings"),
        F.when((F.col("conv_id") % 4 == 0) & (F.col("turn") == 0), F.array().cast("array<struct<page_number int, bbox array<double>>>")).otherwise(F.array(region)).alias("regions"),
    )
    pages = c.select("conv_id").distinct().withColumn("page_number", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])))
    return batches.split_plan(q, pages, "conv_id").select("conv_id", "position", _joined(F.col("reasons")).alias("reasons"))


def audit_entry_check(spark, sf_dir):
    """Documents as audited questions: the verdict must follow from the checks."""
    d = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select("doc_id").distinct()
    k = F.col("doc_id")
    e = d.select(
        F.lit(1).alias("job_id"), k.alias("position"), k.cast("string").alias("source_question_no"),
        F.when(k % 3 == 0, "auto_pass").when(k % 3 == 1, "disputed").otherwise("human_required").alias("audit_status"), (k % 7 != 0).alias("text_match"), F.lit(True).alias("structure_match"), F.lit(True).alias("formula_match"),
        F.when(k % 2 == 0, "passed").otherwise("not_applicable").alias("figure_check"), F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("i"))).alias("issues"),
        F.array().cast("array<string>").alias("suggested_corrections"), (k % 4).cast("int").alias("evidence_page"), F.when(k % 11 == 0, "medium").otherwise("high").alias("audit_confidence"),
    )
    q = d.select(F.lit(1).alias("job_id"), k.alias("position"), k.cast("string").alias("source_question_no"), (k % 6 < 3).alias("figure_required"), F.array((k % 4).cast("int")).alias("source_pages"))
    # one job of all documents: no window is taken over it, so it is no single task
    return batches.audits(e, q).select(F.col("position").alias("doc_id"), _joined(F.col("reasons")).alias("reasons"))


def effective_content(spark, sf_dir):
    """Documents as questions with drafts in every state."""
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.lit("c").alias("candidate_sha256"), (k % 2 == 0).alias("audit_eligible"), (k % 3 != 0).alias("audit_anchored"),
        F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, "pending").otherwise("approved").alias("draft_status"), F.when(k % 4 < 2, "ai_second_pass").otherwise("human").alias("approval_source"),
        (k % 7 != 0).alias("evidence_valid"), F.when(k % 9 == 0, "old").otherwise("c").alias("draft_candidate_sha256"), (k % 8 < 6).alias("draft_changed"),
    )
    return stages.effective_content(d).select("doc_id", "content", "content_source", "content_reason")


def finalize_report(spark, sf_dir):
    """Turns as drafts: approvals on valid evidence stay, untouched strict ones are promoted, the rest waits or stops its job."""
    k = F.col("conv_id") + F.col("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct().select(
        "conv_id", "turn", F.when(k % 4 == 0, "approved").otherwise("pending").alias("status"), F.when(k % 4 == 0, F.when(k % 3 == 0, "human").when(k % 3 == 1, "ai_second_pass")).alias("approval_source"), (k % 17 != 0).alias("bound"),
        F.when(k % 13 != 0, k % 4 == 0).alias("evidence_valid"), (k % 5 == 0).alias("touched"), (k % 7 != 0).alias("strict"), (F.col("conv_id") % 11 != 0).alias("anchored"),
    )
    return stages.finalize_report(stages.finalize_plan(c, "conv_id"), "conv_id", "turn")


def pipeline_stages(spark, sf_dir):
    """Orders as jobs with every kind of artifact; the stage that each is in and what comes next."""
    k = F.col("o_orderkey")
    numbers = lambda c: F.when(c, F.array(F.lit("1"), F.lit("2")))
    d = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "pending").when(F.col("o_orderstatus") == "P", "processing").otherwise("pending").alias("status"), (k % 13 == 0).alias("admitted"), (k % 17 != 0).alias("artifacts_readable"), (k % 3 != 0).alias("render_completed"),
        (k % 19 != 0).alias("render_matches"), numbers(k % 5 != 0).alias("candidate_numbers"), F.when(k % 7 == 0, F.array(F.lit("1"))).otherwise(F.array(F.lit("2"), F.lit("1"))).alias("crop_numbers"), (k % 11 != 0).alias("crops_reviewed"), numbers(k % 4 != 0).alias("audit_numbers"),
    )
    return stages.pipeline_stage(d).select("o_orderkey", "stage", "next_action")


def anchor_states(spark, sf_dir):
    """Whether a completed run still rests on today's digests."""
    k = F.col("o_orderkey")
    old = F.when(k % 6 == 0, F.lit(None).cast("string")).when(k % 5 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2(k.cast("string"), 256))
    state = stages.anchor_state(F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed"), [old], [F.sha2(k.cast("string"), 256)])
    return table(spark, sf_dir, "orders").select("o_orderkey", state.alias("state"))


def append_versions(spark, sf_dir):
    """Customers as versioned items; those whose balance or segment is another now get a new version."""
    k = F.col("c_custkey")
    chain = table(spark, sf_dir, "customer").select("c_custkey", F.lit(1).cast("long").alias("version_no"), F.lit(None).cast("long").alias("previous_version"), F.lit("current").alias("version_status"), "c_mktsegment").filter(k % 6 != 0)
    new = table(spark, sf_dir, "customer").filter(k % 4 != 0).select("c_custkey", F.when(k % 5 == 0, "NEW").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return stages.append_versions(chain, new, ["c_custkey"], ["c_mktsegment"])


def optimistic_update(spark, sf_dir):
    """Changes apply only to the version they were made from."""
    k = F.col("o_orderkey")
    t = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (k % 3).alias("version"))
    changes = t.filter(k % 4 != 0).select("o_orderkey", F.lit("X").alias("o_orderstatus"), (k % 2).alias("version"))
    return writes.guarded_update(t, changes, ["o_orderkey"], "version", ["o_orderstatus"])


def cascade_delete(spark, sf_dir):
    """Lines left by order after orders were deleted with their lines."""
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    left = stages.cascade(gone, table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "cascade")
    return left.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))


def next_after_deleted(spark, sf_dir):
    """What to show after each turn if the second of three is deleted: the next one left, else the first."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    return stages.next_after(c, ["conv_id"], "turn", F.col("turn") % 3 == 1)


def protected_changes(spark, sf_dir):
    """Changes of finished orders that immutability forbids; their priority may change."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    k = F.col("o_orderkey")
    now = o.filter(k % 11 != 0).withColumns({"o_totalprice": F.when(k % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")), "o_orderpriority": F.lit("x")})
    return stages.protected_changes(o, now, ["o_orderkey"], F.col("o_orderstatus") == "F", ["o_orderpriority"])


def reaudit_states(spark, sf_dir):
    """Drafts and the re-audits made for their very version and content."""
    k = F.col("o_orderkey")
    d = table(spark, sf_dir, "orders").select("o_orderkey", (k % 3).alias("version"), F.sha2((k % 10).cast("string"), 256).alias("edited_sha256"))
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_orderkey") % 2).alias("version"), F.sha2((F.col("l_orderkey") % 10).cast("string"), 256).alias("edited_sha256"), (F.col("l_partkey") * 10_000 + F.col("l_linenumber")).alias("run_no"))
    a = a.withColumn("status", F.when(F.col("run_no") % 3 == 0, "passed").when(F.col("run_no") % 3 == 1, "failed").otherwise("running"))
    return stages.reaudit_state(d, a, ["o_orderkey"]).select("o_orderkey", "reaudit")


def keyword_actions(spark, sf_dir):
    """The action of the first rule with a keyword in a name, else the name itself, shortened."""
    rules = [(["small", "1"], "check size"), (["bolt", "2"], "check kind")]
    return table(spark, sf_dir, "part").select("p_partkey", first_keyword(F.col("p_name"), rules, shortened(F.col("p_name"), 8)).alias("action"))


_ALL = (split_plan_check, audit_entry_check, effective_content, finalize_report, pipeline_stages, anchor_states, append_versions, optimistic_update, cascade_delete, next_after_deleted, protected_changes, reaudit_states, keyword_actions)
QUERIES = {f.__name__: f for f in _ALL}
_CASES = "SELECT {0}, concat_ws(',', {1}) AS reasons FROM {2}"


def _reasons(key: str, rules: dict[str, str], source: str) -> str:
    return _CASES.format(key, ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules.items()), source)


ORACLE_SQL = {
    "split_plan_check": "WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations) "
    + _reasons(
        "conv_id, turn + 1 AS position",
        {"number": "turn = 1", "count": "conv_id % 6 = 0", "no_region": "conv_id % 4 = 0 AND turn = 0", "page": "turn % 4 = 3", "box": "turn % 4 = 3", "confidence": "turn % 5 = 4"},
        "c",
    ),
    "audit_entry_check": "WITH d AS (SELECT DISTINCT doc_id, doc_id % 6 < 3 AS fig, doc_id % 2 = 0 AS p FROM documents WHERE doc_id IS NOT NULL) "
    + _reasons(
        "doc_id",
        {
            "figure_check": "fig <> p",
            "verdict": "(doc_id % 3 = 0) <> (doc_id % 7 <> 0 AND fig = p AND doc_id % 11 <> 0 AND (doc_id % 3 = 0 OR doc_id % 5 = 0))",
            "no_issue": "doc_id % 3 <> 0 AND doc_id % 5 = 0",
        },
        "d",
    ),
    "effective_content": """
WITH d AS (SELECT doc_id, doc_id % 5 = 0 AS nd, doc_id % 4 < 2 AS ai FROM documents),
r AS (SELECT *, CASE WHEN nd AND NOT (doc_id % 2 = 0 AND doc_id % 3 <> 0) THEN 'batch_ai_approval_not_anchored' WHEN nd THEN NULL WHEN doc_id % 5 = 1 THEN 'human_approval_status_invalid'
  WHEN ai AND doc_id % 7 = 0 THEN 'ai_approval_provenance_invalid' WHEN ai THEN NULL WHEN doc_id % 7 = 0 THEN 'human_approval_evidence_invalid' WHEN doc_id % 9 = 0 THEN 'human_review_source_changed' END AS content_reason FROM d)
SELECT doc_id, CASE WHEN content_reason IS NULL AND NOT nd THEN 'draft' ELSE 'candidate' END AS content,
  CASE WHEN content_reason IS NOT NULL THEN 'rejected' WHEN nd THEN 'pristine' WHEN ai THEN 'ai_approved' WHEN doc_id % 8 < 6 THEN 'human_edited' ELSE 'human_approved' END AS content_source, content_reason FROM r""",
    "finalize_report": """
WITH c AS (SELECT DISTINCT conv_id, turn, conv_id + turn AS k FROM conversations),
o AS (SELECT *, CASE WHEN k % 4 = 0 AND k % 3 < 2 AND k % 17 <> 0 AND k % 13 <> 0 THEN 'kept' WHEN k % 4 = 0 THEN 'rejected' WHEN k % 17 <> 0 AND k % 5 <> 0 AND k % 7 <> 0 AND conv_id % 11 <> 0 THEN 'promoted' ELSE 'pending' END AS o FROM c)
SELECT conv_id, count(*) FILTER (WHERE o = 'kept') AS n_kept, count(*) FILTER (WHERE o = 'promoted') AS n_promoted, count(*) FILTER (WHERE o = 'pending') AS n_pending, count(*) FILTER (WHERE o = 'rejected') AS n_rejected,
  count(*) FILTER (WHERE o = 'kept' AND k % 3 = 0) AS n_human, count(*) FILTER (WHERE o = 'promoted' OR (o = 'kept' AND k % 3 = 1)) AS n_ai, count(*) FILTER (WHERE o = 'kept' AND k % 5 = 0) AS n_changed,
  coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (WHERE o = 'promoted'), '') AS promoted, coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (WHERE o = 'pending'), '') AS pending,
  coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (WHERE o = 'rejected'), '') AS rejected, bool_and(o IN ('kept', 'promoted')) AS complete FROM o GROUP BY conv_id""",
    "pipeline_stages": """
WITH j AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN 1 WHEN o_orderkey % 13 = 0 THEN 2 WHEN o_orderkey % 17 = 0 THEN 3 WHEN o_orderkey % 3 = 0 OR o_orderkey % 19 = 0 THEN 4 WHEN o_orderkey % 5 = 0 THEN 5
  WHEN o_orderkey % 7 = 0 THEN 6 WHEN o_orderkey % 11 = 0 THEN 7 WHEN o_orderkey % 4 = 0 THEN 8 ELSE 9 END AS i FROM orders)
SELECT k AS o_orderkey, ['in_progress', 'needs_review', 'unavailable', 'needs_render', 'needs_candidates', 'needs_crops', 'needs_crop_review', 'needs_ai_review', 'ready'][i] AS stage,
  ['wait_or_recover', 'manual_review', 'check_artifacts', 'render_pages', 'provide_candidate_questions', 'provide_crop_plan', 'review_crops', 'provide_ai_audit', 'run_strict_admission'][i] AS next_action FROM j""",
    "anchor_states": "SELECT o_orderkey, CASE WHEN o_orderstatus IS DISTINCT FROM 'F' THEN 'none' WHEN o_orderkey % 6 <> 0 AND o_orderkey % 5 <> 0 THEN 'valid' ELSE 'stale' END AS state FROM orders",
    "append_versions": """
WITH c AS (SELECT *, c_custkey % 6 <> 0 AS had, c_custkey % 4 <> 0 AND (c_custkey % 6 = 0 OR c_custkey % 5 = 0) AS add, CASE WHEN c_custkey % 5 = 0 THEN 'NEW' ELSE c_mktsegment END AS now FROM customer)
SELECT c_custkey, 1::BIGINT AS version_no, NULL::BIGINT AS previous_version, CASE WHEN add THEN 'superseded' ELSE 'current' END AS version_status, c_mktsegment FROM c WHERE had
UNION ALL SELECT c_custkey, CASE WHEN had THEN 2 ELSE 1 END, CASE WHEN had THEN 1 END, 'current', now FROM c WHERE add""",
    "optimistic_update": """
WITH t AS (SELECT o_orderkey, o_orderstatus, o_orderkey % 3 AS v, o_orderkey % 4 <> 0 AS asked, o_orderkey % 4 <> 0 AND o_orderkey % 2 = o_orderkey % 3 AS hit FROM orders)
SELECT o_orderkey, CASE WHEN hit THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN hit THEN v + 1 ELSE v END AS version, CASE WHEN hit THEN 'updated' WHEN asked THEN 'conflict' ELSE 'kept' END AS outcome FROM t""",
    "cascade_delete": "SELECT l_orderkey, count(*) AS n_lines FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') GROUP BY l_orderkey",
    "next_after_deleted": """
WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations)
SELECT conv_id, turn, coalesce((SELECT min(n.turn) FROM c n WHERE n.conv_id = c.conv_id AND n.turn > c.turn AND n.turn % 3 <> 1), (SELECT min(n.turn) FROM c n WHERE n.conv_id = c.conv_id AND n.turn % 3 <> 1)) AS next_no FROM c""",
    "protected_changes": "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'deleted' ELSE 'changed' END AS violation FROM orders WHERE o_orderstatus = 'F' AND (o_orderkey % 11 = 0 OR o_orderkey % 5 = 0)",
    "reaudit_states": """
WITH a AS (SELECT l_orderkey, max(l_partkey * 10000 + l_linenumber) % 3 AS s FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN s IS NULL OR o_orderkey % 3 <> o_orderkey % 2 THEN 'needed' WHEN s = 0 THEN 'adopted' WHEN s = 1 THEN 'failed' ELSE 'running' END AS reaudit FROM orders LEFT JOIN a ON l_orderkey = o_orderkey""",
    "keyword_actions": """
SELECT p_partkey, CASE WHEN contains(lower(p_name), 'small') OR contains(p_name, '1') THEN 'check size' WHEN contains(lower(p_name), 'bolt') OR contains(p_name, '2') THEN 'check kind'
  WHEN length(p_name) > 8 THEN p_name[1:7] || '…' ELSE p_name END AS action FROM part""",
}
