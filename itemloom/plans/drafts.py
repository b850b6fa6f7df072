"""Carrier queries for corrected drafts, bound classifications, required pictures and fresh times."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemloom.functions import fresh
from itemloom.operators import adoption, layout
from itemloom.sources import table, work_folder

_SHA = lambda c: F.sha2(c.cast("string"), 256)
_text = lambda no, version: F.sha2(F.concat_ws("/", "o_orderpriority", no.cast("string"), version.cast("string")), 256)


def _drafts(spark, sf_dir):
    """Orders as drafts: the version is the number of their lines, the text their priority."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("version"))
    o = table(spark, sf_dir, "orders").join(n, "o_orderkey")
    return o.select(
        F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("no"), "version", _text(F.col("o_orderkey"), F.col("version")).alias("edited_sha256"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("draft").alias("status"),
        F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_orderkey") % 5 == 0, "robot").otherwise("human")).alias("approval_source"), F.lit(None).cast("string").alias("reviewed_at"), (F.col("o_orderkey") % 29 == 0).alias("deleted"),
    )


def _results(spark, sf_dir):
    """Lines as results for drafts of every third order: of any version up to its own, some with a run id that is empty or another one's."""
    k, line = F.col("l_orderkey"), F.col("l_linenumber").cast("long")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("job"), "o_orderpriority")
    li = table(spark, sf_dir, "lineitem").filter(k % 3 == 0).groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part"))
    run = F.when(F.col("part") % 17 == 0, "").otherwise(F.concat(F.lit("run-"), (k * 10 + line).cast("string")))
    return li.join(o, "l_orderkey").select("job", k.alias("no"), run.alias("run_id"), line.alias("version"), _text(k, line).alias("edited_sha256"), F.when(F.col("part") % 2 == 0, "auto_pass").otherwise("disputed").alias("audit_status"))


def _told(spark, outcomes):
    """Outcomes as they are read by what follows, written once: the text's digest only of those that are adopted."""
    path = work_folder(spark, "outcomes")
    outcomes.withColumn("edited_sha256", F.when(F.col("outcome").isin("passed", "not_passed"), F.col("edited_sha256"))).write.parquet(path)
    return spark.read.schema(outcomes.schema).parquet(path)


def reaudit_adoption(spark, sf_dir):
    """Two rounds of the same results: what each came to, and the drafts that changed; the second round changes none."""
    d, r, key = _drafts(spark, sf_dir), _results(spark, sf_dir), ["job", "no"]
    none = d.select(*key, "version", "edited_sha256", "status", F.lit("").alias("decision"), F.lit("").alias("run_id")).filter("false")
    first = _told(spark, adoption.adoption(d, none, r, key))
    after, told = adoption.adopted(d, first, key, "t1"), adoption.completed_reaudits(none, first)
    second = _told(spark, adoption.adoption(after, told, r, key))
    twice = adoption.adopted(after, second, key, "t2")
    changed = twice.filter("reviewed_at IS NOT NULL").select("no", F.lit(None).cast("long").alias("line"), F.concat_ws("/", "status", "approval_source", F.col("version").cast("string"), "reviewed_at").alias("what"))
    said = lambda o, n: o.select("no", F.col("version").alias("line"), F.concat(F.lit(n), "outcome").alias("what"))
    return said(first, "first ").unionByName(said(second, "second ")).unionByName(changed)


def bound_classifications(spark, sf_dir):
    """Classifications made for a version and a text; those for others, with inactive codes or the same code twice do not bind."""
    k = F.col("no")
    d = _drafts(spark, sf_dir)
    code = lambda n: F.concat(F.lit("K"), (k % n).cast("string"))
    related = F.when(k % 13 == 0, None).when(k % 11 == 0, F.array(code(5), code(7), code(9))).when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(code(5), code(7)))
    c = d.select((k + 10).alias("classification_id"), "job", "no", F.when(k % 6 == 0, F.col("version") + 1).otherwise(F.col("version")).alias("approved_draft_version"), F.when(k % 7 == 0, _SHA(k)).otherwise(F.col("edited_sha256")).alias("edited_sha256"), code(3).alias("primary_code"), related.alias("related_codes"))
    points = table(spark, sf_dir, "nation").select(F.concat(F.lit("K"), F.col("n_nationkey").cast("string")).alias("code"), (F.col("n_nationkey") != 4).alias("is_active"))
    got = adoption.bound_classifications(d, c, points, "job", "no")
    return got.select("job", "no", "classification_id", "primary_code", F.array_join("related_codes", ",").alias("related"))


def required_pictures(spark, sf_dir):
    """Which orders need a picture and lack one; their lines are options (pictures or texts) and assets."""
    k = F.col("o_orderkey")
    q = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "passed").when(F.col("o_orderstatus") == "F", "pending").alias("figure_review_status"), F.when(k % 2 == 0, "single_choice").otherwise("solution").alias("question_type_code"))
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("long").alias("asset_id")).agg(F.min("l_partkey").alias("part"))
    options = li.filter("o_orderkey % 5 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, f" {layout.IMAGE_OPTION} ").when(F.col("part") % 2 == 0, layout.IMAGE_OPTION).otherwise("text").alias("content"))
    assets = li.filter("part % 3 <> 0").select("o_orderkey", "asset_id", F.when(F.col("part") % 2 == 0, "complete_question").otherwise("question_figure").alias("kind"), F.col("part").cast("string").alias("path"), F.col("part").alias("display_order"))
    return layout.required_content(q, options, assets, "o_orderkey")


def fresh_times(spark, sf_dir):
    """Times as texts with a zone, without one, or unreadable: only those with one can be fresh, in whatever zone."""
    k = F.col("event_id")
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k % 5 == 0, at).when(k % 7 == 0, F.concat(at, F.lit(" noon"))).when(k % 3 == 0, F.concat(at, F.lit("+02:00"))).when(k % 11 != 0, F.concat(at, F.lit("Z")))
    return table(spark, sf_dir, "events").select("event_id", fresh(text, "2024-01-20 12:00:00", 60 * 24 * 3).alias("fresh"))


QUERIES = {f.__name__: f for f in (reaudit_adoption, bound_classifications, required_pictures, fresh_times)}
_D = """d AS (SELECT o_custkey AS job, o_orderkey AS no, n AS version, n AS sha, o_orderstatus = 'F' AS done, o_orderkey % 29 = 0 AS deleted
  FROM orders JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) USING (o_orderkey))"""
ORACLE_SQL = {
    "reaudit_adoption": f"""
WITH {_D}, r AS (SELECT l_orderkey AS no, CAST(l_linenumber AS BIGINT) AS line, max(l_partkey) AS part FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY ALL),
f AS (SELECT no, line, d.version, CASE WHEN part % 17 = 0 THEN 'invalid' WHEN line <> d.version OR deleted THEN 'stale' WHEN part % 2 = 0 THEN 'passed' ELSE 'not_passed' END AS o FROM r JOIN d USING (no))
SELECT no, line, 'first ' || o AS what FROM f
UNION ALL SELECT no, line, 'second ' || CASE WHEN o IN ('passed', 'not_passed') THEN 'done' ELSE o END FROM f
UNION ALL SELECT no, NULL, CASE WHEN o = 'passed' THEN 'approved/ai_second_pass/' || (version + 1) || '/t1' ELSE 'needs_fix/' || version || '/t1' END FROM f WHERE o IN ('passed', 'not_passed')""",
    "bound_classifications": f"""
WITH {_D}, c AS (SELECT *, 'K' || (no % 3) AS p, CASE WHEN no % 13 = 0 THEN NULL WHEN no % 11 = 0 THEN ['K' || (no % 5), 'K' || (no % 7), 'K' || (no % 9)] WHEN no % 4 = 0 THEN [] ELSE ['K' || (no % 5), 'K' || (no % 7)] END AS r
  FROM d WHERE done AND no % 5 <> 0 AND no % 6 <> 0 AND no % 7 <> 0)
SELECT job, no, no + 10 AS classification_id, p AS primary_code, array_to_string(r, ',') AS related FROM c
WHERE r IS NOT NULL AND len(r) <= 2 AND len(list_distinct(r || [p])) = len(r) + 1 AND NOT list_contains(r || [p], 'K4')""",
    "required_pictures": f"""
WITH l AS (SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS a, min(l_partkey) AS part FROM lineitem GROUP BY ALL),
o AS (SELECT k, count(*) AS n, bool_and(k % 3 = 0 OR part % 2 = 0) AS pictures FROM l WHERE k % 5 <> 0 GROUP BY k),
q AS (SELECT o_orderkey, o_orderstatus = 'O' AS need, o_orderkey % 2 = 0 AS choice, CASE WHEN coalesce(pictures, true) THEN 0 ELSE n END AS n FROM orders LEFT JOIN o ON k = o_orderkey)
SELECT o_orderkey, need AS has_required_image, need AND choice AND n = 0 AS image_options, CAST(n AS BIGINT) AS n_options,
  need AND NOT EXISTS (SELECT 1 FROM l WHERE l.k = o_orderkey AND part % 3 <> 0 AND (part % 2 = 0) = (need AND choice AND n = 0)) AS required_image_missing FROM q""",
    "fresh_times": """
WITH e AS (SELECT event_id AS k, date_trunc('second', ts) AS t FROM events)
SELECT k AS event_id, k % 5 <> 0 AND k % 7 <> 0 AND (k % 3 = 0 OR k % 11 <> 0) AND CASE WHEN k % 3 = 0 THEN t - INTERVAL 2 HOUR ELSE t END > TIMESTAMP '2024-01-17 12:00:00' AS fresh FROM e""",
}
