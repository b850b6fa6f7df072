"""Constraint checks: rows that break a rule, keys that repeat, references that lead nowhere."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """key, rule: one row for each rule that a row breaks (a rule that is null counts as kept, as CHECK does)."""
    broken = F.array_compact(F.array(*[F.when(~r, F.lit(n)) for n, r in rules.items()]))
    return df.select(*key, F.explode(broken).alias("rule"))


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once (rows with a null in the key never do) with their count."""
    return df.dropna(subset=key).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def dangling(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """relation, missing: values of a reference that its parent lacks, with the number of rows."""
    c = child.select(F.col(child_key).cast("long").alias("missing")).filter("missing is not null").groupBy("missing").agg(F.count(F.lit(1)).alias("n"))
    p = parent.select(F.col(parent_key).cast("long").alias("missing"))
    return c.join(p, "missing", "left_anti").select(F.lit(name).alias("relation"), "missing", "n")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def same_sets(a: DataFrame, b: DataFrame, key: list[str], member: str) -> DataFrame:
    """key, equal: whether both sides have the same members, each once."""
    x = a.groupBy(*key, member).agg(F.count(F.lit(1)).alias("na"))
    y = b.groupBy(*key, member).agg(F.count(F.lit(1)).alias("nb"))
    return x.join(y, [*key, member], "full").groupBy(*key).agg(F.every(F.coalesce((F.col("na") == 1) & (F.col("nb") == 1), F.lit(False))).alias("equal"))


def changed_columns(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """key, column: each column of a row in both whose value changed, nulls compared as values."""
    o = old.select(*key, *[F.col(c).alias(f"_{c}") for c in columns])
    both = new.select(*key, *columns).join(o, key)
    names = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in columns]))
    return both.select(*key, F.explode(names).alias("column"))


#: Domains of the bank's state columns.
REVIEW_DONE = "passed"
SHA256 = "^[0-9a-f]{64}$"


def paired(a: str, b: str) -> Column:
    """Both given or neither."""
    return F.col(a).isNull() == F.col(b).isNull()


def completed_run(anchors: list[str], done: str, total: str) -> Column:
    """A completed run has all its anchors and has processed everything."""
    whole = F.col(done).eqNullSafe(F.col(total))
    for a in anchors:
        whole = whole & F.col(a).isNotNull()
    return (F.col("status") != "completed") | whole


def table_rules(name: str) -> dict[str, Column]:
    """The CHECK rules of a table by name. Columns are made when asked for, as they need a session."""
    c = F.col
    rules = {
        "import_jobs": lambda: {"page_range": paired("page_start", "page_end"), "page_order": c("page_start").isNull() | ((c("page_start") >= 1) & (c("page_start") <= c("page_end")))},
        "import_layout_analysis_runs": lambda: {"completed": completed_run(["source_manifest_sha256", "output_manifest_sha256", "completed_at"], "processed_pages", "total_pages"), "digest": c("output_manifest_sha256").rlike(SHA256)},
        "import_question_split_runs": lambda: {"completed": completed_run(["input_manifest_sha256", "output_manifest_sha256", "generation_id", "completed_at"], "processed_questions", "total_questions"), "generation": c("generation_id").rlike("^[0-9a-f]{32}$")},
        "questions": lambda: {
            "answer": (c("answer_status") == "missing") == (F.length(F.coalesce(c("answer_markdown"), F.lit(""))) == 0),
            "usable": (c("usability_status") != "usable") | reduce(and_, [c(x).eqNullSafe(REVIEW_DONE) for x in ("text_review_status", "figure_review_status", "answer_review_status")]),
            "deletion": (c("deleted_at").isNull() & c("deletion_reason").isNull() & c("deletion_note").isNull()) | (c("deletion_reason").isNotNull()),
        },
        "corrected_draft_reaudits": lambda: {"decision": (c("status") == "completed") == c("decision").isNotNull(), "version": c("approved_draft_version").isNull() | (c("approved_draft_version") == c("reviewed_draft_version") + 1)},
        "candidate_knowledge_classification_drafts": lambda: {"approval": (c("status") == "approved") == (c("approval_source").isNotNull() & c("reviewed_at").isNotNull())},
        "import_web_admission_runs": lambda: {"claim": (c("status") == "processing") == (c("claim_token").isNotNull() & c("lease_expires_at").isNotNull()), "token": c("claim_token").rlike(SHA256), "completed": (c("status") != "completed") | ((c("stage") == "completed") & c("completed_at").isNotNull())},
        "knowledge_points": lambda: {"level": c("level").between(1, 3), "root": (c("level") > 1) | c("parent_id").isNull()},
    }
    return rules[name]()


def runs_without_job(runs: DataFrame, jobs: DataFrame, job: str) -> DataFrame:
    """Completed runs whose job is not completed (or is none)."""
    return runs.filter("status = 'completed'").join(jobs.filter("status = 'completed'").select(job), job, "left_anti")
