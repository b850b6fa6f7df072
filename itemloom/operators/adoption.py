"""Corrected drafts and what is bound to them: adoption of a re-audit's result, and classifications of exactly the approved text.

A result is made for one version and content of a draft. It is adopted once: the draft's row and the re-audit's row change together, and a
result that comes again finds the finished re-audit and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values.
SECOND_PASS, APPROVAL_SOURCES, MAX_RELATED = "ai_second_pass", ("human", "ai_second_pass"), 2
HEX64 = "^[0-9a-f]{64}$"


def _holds(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _packed(name: str) -> Column:
    """A digest as bytes, half as long to move; a text that is none stays as it is, but longer than any digest, so that no two texts become the same."""
    c = F.col(name)
    return F.when(c.rlike(HEX64), F.unhex(c)).otherwise(F.concat(F.repeat(F.lit(" "), F.lit(33)), c).cast("binary"))


def _unpacked(name: str) -> Column:
    c = F.col(name)
    return F.when(F.length(c) == 32, F.lower(F.hex(c))).otherwise(F.substring(c.cast("string"), 34, 2**31 - 1))


def adoption(drafts: DataFrame, reaudits: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """key, run_id, outcome of each of *results* (key, run_id, version, edited_sha256, audit_status).

    *drafts*: key, version, edited_sha256, deleted; *reaudits*: key, version, edited_sha256, status, decision, run_id. Outcomes: invalid (no bounded
    run id, version or digest), stale (there is no such live draft now), done (it has been re-audited with that version and content),
    used (the run id belongs to another re-audit), later (an earlier result, by run id, for the same draft is adopted now), passed, not_passed."""
    whole = _holds(F.length("run_id").between(1, 200) & (F.length(F.trim("run_id")) > 0)) & _holds(F.col("version") >= 1) & _holds(F.col("edited_sha256").rlike(HEX64))
    same = [*key, "version", "_sha"]
    sha = _packed("edited_sha256").alias("_sha")
    finished = reaudits.filter("status = 'completed'").select(*key, "version", sha).distinct().withColumn("_done", F.lit(True))
    runs = reaudits.filter("run_id IS NOT NULL").select(F.col("run_id").alias("_run")).distinct().withColumn("_used", F.lit(True))
    live = drafts.filter(~_holds(F.col("deleted"))).select(*key, "version", sha).withColumn("_live", F.lit(True))
    # Results that can't be adopted get runs of their own, so that empty run ids do not meet in one task. Run ids are looked up first: all that
    # goes by draft and content then follows one exchange.
    d = results.withColumn("_whole", whole)
    d = d.select(*key, "version", sha, "audit_status", "_whole", F.when(F.col("_whole"), F.col("run_id")).otherwise(F.xxhash64(*key, "version").cast("string")).alias("_run"), F.when(~F.col("_whole"), F.col("run_id")).alias("_odd"))
    d = d.join(runs, "_run", "left").join(finished, same, "left").join(live, same, "left")
    out = F.when(~F.col("_whole"), "invalid").when(F.col("_done"), "done").when(F.col("_live").isNull(), "stale").when(F.col("_used"), "used")
    d = d.withColumn("_out", out)
    first = F.row_number().over(W.partitionBy(*same, "_out").orderBy("_run"))
    again = F.row_number().over(W.partitionBy("_run", "_out").orderBy(*key))  # one run id is for one re-audit
    verdict = F.when(_holds(F.col("audit_status") == "auto_pass"), "passed").otherwise("not_passed")
    d = d.withColumn("_n", first).withColumn("_m", again)
    run = F.when(F.col("_whole"), F.col("_run")).otherwise(F.col("_odd")).alias("run_id")
    return d.select(*key, run, "version", _unpacked("_sha").alias("edited_sha256"), F.coalesce("_out", F.when(F.col("_n") > 1, "later").when(F.col("_m") > 1, "used"), verdict).alias("outcome"))


def adopted(drafts: DataFrame, outcomes: DataFrame, key: list[str], now: str) -> DataFrame:
    """*drafts* after the *outcomes* of ``adoption``: a passed one approves the draft under its next version, one not passed sends it back; all
    other rows stay as they are. Columns that change: version, status, approval_source, reviewed_at."""
    sha = _packed("edited_sha256")
    o = outcomes.filter(F.col("outcome").isin("passed", "not_passed")).select(*key, "version", sha.alias("_sha"), F.col("outcome").alias("_o"))
    d = drafts.withColumn("_sha", sha).drop("edited_sha256").join(o, [*key, "version", "_sha"], "left").withColumn("edited_sha256", _unpacked("_sha"))
    hit, passed = F.col("_o").isNotNull() & ~_holds(F.col("deleted")), F.col("_o") == "passed"
    new = {
        "version": F.when(hit & passed, F.col("version") + 1).otherwise(F.col("version")),
        "status": F.when(hit & passed, "approved").when(hit, "needs_fix").otherwise(F.col("status")),
        "approval_source": F.when(hit & passed, SECOND_PASS).when(~hit, F.col("approval_source")),
        "reviewed_at": F.when(hit, F.lit(now)).otherwise(F.col("reviewed_at")),
    }
    return d.select(*[new.get(c, F.col(c)).alias(c) for c in drafts.columns])


def completed_reaudits(reaudits: DataFrame, outcomes: DataFrame) -> DataFrame:
    """*reaudits* with a completed row for each adopted result."""
    new = outcomes.filter(F.col("outcome").isin("passed", "not_passed")).withColumns({"status": F.lit("completed"), "decision": F.col("outcome")})
    return reaudits.unionByName(new.select(*reaudits.columns))


def bound_classifications(drafts: DataFrame, classifications: DataFrame, points: DataFrame, job: str, number: str) -> DataFrame:
    """job, number, classification_id, primary_code, related_codes of the classifications that bind an approved draft exactly: by job, number,
    approved version and digest of the edited text.

    *drafts*: job, number, status, approval_source, version, edited_sha256; *classifications*: classification_id, job, number,
    approved_draft_version, edited_sha256, primary_code, related_codes (array; null: unreadable); *points*: code, is_active. Its codes must be
    active, the related ones at most two, distinct and not the primary one. Codes are looked up by a join, not in a list."""
    d = drafts.filter((F.col("status") == "approved") & F.col("approval_source").isin(*APPROVAL_SOURCES) & F.col("version").isNotNull())
    d = d.select(job, number, F.col("version").alias("approved_draft_version"), "edited_sha256").join(classifications, [job, number, "approved_draft_version", "edited_sha256"])
    own = F.concat(F.array("primary_code"), "related_codes")
    sound = _holds((F.size("related_codes") <= MAX_RELATED) & (F.size(F.array_distinct(own)) == F.size(own)) & ~F.exists(own, lambda c: c.isNull()))
    d = d.filter(sound).withColumn("_code", F.explode(own))
    active = points.filter("is_active").select(F.col("code").alias("_code")).distinct().withColumn("_active", F.lit(True))
    d = d.join(active, "_code", "left").groupBy("classification_id", job, number, "primary_code", "related_codes").agg(F.every(F.col("_active").isNotNull()).alias("_ok"))
    return d.filter("_ok").select(job, number, "classification_id", "primary_code", "related_codes")
