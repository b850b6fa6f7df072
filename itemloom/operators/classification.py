"""Classification of items by two model passes and a person: output rules, agreement, review, counters and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.functions import reason_list
from itemloom.operators.batches import LEVELS, no, unique

#: The reviewer that goes with each source of an approval, and a reason's greatest length.
REVIEWERS = {"local_double_pass": "local_double_pass", "human": "teacher_human_review"}
MAX_REASON = 200


def level2_reasons(code: Column, allowed: Column, confidence: Column, reason: Column) -> Column:
    """Reasons against a choice of topic among *allowed* codes."""
    return reason_list({"code": no(F.array_contains(allowed, code)), "confidence": no(confidence.isin(LEVELS)), "reason": no(F.length(reason).between(1, MAX_REASON))})


def level3_reasons(primary: Column, related: Column, allowed: Column, confidence: Column, reason: Column) -> Column:
    """Reasons against a choice of points: all below the topic that was chosen, two related ones at most, each once, none the primary."""
    within = F.forall(related, lambda c: F.coalesce(F.array_contains(allowed, c), F.lit(False)))
    return reason_list({
        "code": no(F.array_contains(allowed, primary)),
        "related": no((F.size(related) <= 2) & unique(related) & within),
        "primary_in_related": F.coalesce(F.array_contains(related, primary), F.lit(False)),
        "confidence": no(confidence.isin(LEVELS)),
        "reason": no(F.length(reason).between(1, MAX_REASON)),
    })


def evidence_entry(number: Column, primary: Column, related: Column, reason: Column, source: Column, reviewer: Column) -> Column:
    """Reasons against an entry of classification evidence; without source and reviewer it is of the older shape."""
    older = source.isNull() & reviewer.isNull()
    pair = F.lit(False)
    for s, r in REVIEWERS.items():
        pair = pair | ((source == s) & (reviewer == r))
    return reason_list({
        "number": no(number.rlike("^[1-9][0-9]{0,2}$")),
        "primary": primary.isNull(),
        "related": no((F.size(related) <= 2) & unique(related) & F.forall(related, lambda c: c.isNotNull())),
        "primary_in_related": F.coalesce(F.array_contains(related, primary), F.lit(False)),
        "reason": no(F.length(reason) <= MAX_REASON),
        "reviewer": no(older | pair),
    })


def double_pass(first: Column, second: Column, related_first: Column, related_second: Column, sure_first: Column, sure_second: Column, level2: Column) -> Column:
    """approved if both passes give the same primary and related points and they and the topic's choice are sure, else pending."""
    sure = (sure_first == "high") & (sure_second == "high") & (level2 == "high")
    return F.when(F.coalesce((first == second) & (related_first == related_second) & sure, F.lit(False)), "approved").otherwise("pending")


def review(rows: DataFrame) -> DataFrame:
    """*rows* after a person's choice: status, approval_source, human_note (null: as it was), changed.

    Columns read: status, approval_source, final_primary, final_related, primary, related (chosen), approve, proposal_reason."""
    changed = ~F.col("primary").eqNullSafe(F.col("final_primary")) | ~F.col("related").eqNullSafe(F.col("final_related"))
    was = F.coalesce(F.col("status") == "approved", F.lit(False))
    d = rows.withColumns({"changed": changed, "_approve": F.coalesce("approve", F.lit(False)), "_was": was})
    status = F.when(F.col("_approve") | (F.col("_was") & ~F.col("changed")), "approved").otherwise("pending")
    source = F.when(status == "pending", None).when(F.col("changed") | (F.col("_approve") & ~F.col("_was")), "human").otherwise(F.col("approval_source"))
    head = F.when(status == "approved", F.concat(F.lit("reviewed: "), F.col("primary"))).otherwise(F.concat(F.lit("draft: "), F.col("primary")))
    note = F.when(F.col("changed") | F.coalesce(source == "human", F.lit(False)), F.substring(F.concat(head, F.lit("; proposal: "), F.coalesce("proposal_reason", F.lit(""))), 1, MAX_REASON))
    return d.withColumns({"_s": status, "_source": source, "_note": note}).select(*[c for c in rows.columns if c not in ("status", "approval_source")], F.col("_s").alias("status"), F.col("_source").alias("approval_source"), F.col("_note").alias("human_note"), "changed")


def with_names(rows: DataFrame, points: DataFrame, codes: list[str]) -> DataFrame:
    """*rows* with ``<code>_name`` for each of the *codes*: one dictionary (code, name), joined once for each of them."""
    for c in codes:
        rows = rows.join(points.select(F.col("code").alias(c), F.col("name").alias(f"{c}_name")), c, "left")
    return rows


def review_order(rows: DataFrame, status: str = "status", number: str = "question_no") -> DataFrame:
    """Pending ones first, then by number (one that is none comes first)."""
    return rows.orderBy(F.when(F.col(status) == "pending", 0).otherwise(1), F.col(number).try_cast("int").asc_nulls_first(), number)


def counters(drafts: DataFrame, job: str) -> DataFrame:
    """job, n, n_pending, n_approved, n_auto (approved by the two passes alone)."""
    return drafts.groupBy(job).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "pending").alias("n_pending"), F.count_if(F.col("status") == "approved").alias("n_approved"), F.count_if(F.coalesce(F.col("approval_source") == "local_double_pass", F.lit(False))).alias("n_auto"))
