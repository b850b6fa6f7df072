"""Carrier queries for job boards, states, leases, review and write semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.functions import item_code, reason_list
from itemloom.operators import constraints, review, writes
from itemloom.operators.digests import group_digest
from itemloom.operators.sequence import latest
from itemloom.sources import table

NOW = "2024-01-30 12:00:00"


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs with one left-joined aggregate a stage (one shuffle of the lines for all of them)."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[F.count_if(F.col("l_returnflag") == f).alias(f"n_{n}") for f, n in (("R", "render"), ("A", "layout"), ("N", "split"))])
    return table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")


STAGES = """(SELECT o.*, l_orderkey, n_render, n_layout, n_split FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS n_render,
  count(*) FILTER (WHERE l_returnflag = 'A') AS n_layout, count(*) FILTER (WHERE l_returnflag = 'N') AS n_split FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""


def optional_stage_board(spark, sf_dir):
    n = ("n_render", "n_layout", "n_split")
    return _stages(spark, sf_dir).select("o_orderkey", "o_orderstatus", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in n], F.col("l_orderkey").isNotNull().alias("started"))


def next_action_state(spark, sf_dir):
    """First matching rule over one joined row a job."""
    d = _stages(spark, sf_dir)
    rules = [
        (F.col("l_orderkey").isNull(), "render"), (F.col("o_orderstatus") == "P", "review"), (F.col("n_layout") == 0, "layout"),
        (F.col("n_split") == 0, "split"), ((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT"), "audit"), (F.col("n_render") > 2, "admit"),
    ]
    return d.select("o_orderkey", review.first_rule(rules, "done").alias("next_action"))


def recovery_scan(spark, sf_dir):
    """Jobs whose work was interrupted: started and not split, or split without a layout."""
    d = _stages(spark, sf_dir).filter("o_orderstatus <> 'F' AND ((n_split IS NULL) OR (n_render > 0 AND n_split = 0) OR (n_split > 0 AND n_layout = 0))")
    return d.select("o_orderkey", "o_orderstatus")


def _last_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return latest(e, ["user_id"], ["ts", "event_id"], ["ts", "event_id", "event_type"])


def lease_expiry(spark, sf_dir):
    """A lease of 300 seconds from the last event blocks while it runs."""
    d = _last_events(spark, sf_dir)
    return d.select("user_id", "event_id", (F.col("ts") + F.expr("INTERVAL 300 SECONDS") > F.lit(NOW).cast("timestamp_ntz")).alias("blocked"))


def stale_processing(spark, sf_dir):
    """Keys without a sign of life for 15 minutes."""
    d = _last_events(spark, sf_dir)
    return d.filter(F.col("ts") < F.lit(NOW).cast("timestamp_ntz") - F.expr("INTERVAL 15 MINUTES")).select("user_id", "event_type")


def _perturbed(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    new = o.filter("o_orderkey % 11 <> 0").withColumns({
        "o_orderstatus": F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")),
        "o_totalprice": F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")),
    }).withColumn("o_orderkey", F.when(F.col("o_orderkey") % 13 == 0, -F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey")))
    return o, new


PERTURBED = """(SELECT CASE WHEN o_orderkey % 13 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END AS o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 11 <> 0)"""


def incremental_reuse(spark, sf_dir):
    o, new = _perturbed(spark, sf_dir)
    return writes.classify_reuse(o, new, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


def null_safe_drift(spark, sf_dir):
    o, new = _perturbed(spark, sf_dir)
    return constraints.changed_columns(o, new, ["o_orderkey"], ["o_orderstatus", "o_totalprice", "o_orderpriority"]).groupBy("column").agg(F.count(F.lit(1)).alias("n_changed"))


def insert_or_ignore(spark, sf_dir):
    o, new = _perturbed(spark, sf_dir)
    return writes.insert_or_ignore(o, new, ["o_orderkey"]).select("o_orderkey", "o_orderstatus", "o_totalprice")


def upsert_preserve(spark, sf_dir):
    """Rows under review take new values, others keep theirs."""
    o, new = _perturbed(spark, sf_dir)
    return writes.upsert(o, new, ["o_orderkey"], ["o_orderstatus", "o_totalprice"], F.col("_old_o_orderstatus").isin("P", "O"))


def positional_reconcile(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("v"))
    new = li.filter("l_linenumber < 6 OR l_orderkey % 2 = 0").select("l_orderkey", F.when(F.col("l_linenumber") == 2, F.lit(9)).otherwise(F.col("l_linenumber")).alias("l_linenumber"), (F.col("v") + F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(0)).alias("v"))
    return writes.reconcile_children(li, new, ["l_orderkey"], "l_linenumber", "v")


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


def _reasons():
    return reason_list({
        "unlabelled": F.col("quality").isNull(), "toxic": F.col("toxic") == 1, "low_quality": F.col("quality") == 0,
        "too_short": F.col("n_chars") < 500, "empty_source": F.coalesce(F.col("source"), F.lit("")) == "",
    })


REASONS = "concat_ws(',', CASE WHEN quality IS NULL THEN 'unlabelled' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN n_chars < 500 THEN 'too_short' END, CASE WHEN coalesce(source, '') = '' THEN 'empty_source' END)"


def eligibility_reasons(spark, sf_dir):
    r = _reasons()
    return _labelled(spark, sf_dir).select("doc_id", F.array_join(r, ",").alias("reasons"), (F.size(r) == 0).alias("eligible"))


def strict_batch_gate(spark, sf_dir):
    return review.gate(_labelled(spark, sf_dir), ["source"], _reasons())


def review_progress(spark, sf_dir):
    d = _labelled(spark, sf_dir)
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("quality").isNull()).alias("pending"), F.count_if(F.col("toxic") == 1).alias("disputed"), F.count_if(F.col("quality") == 1).alias("passed"), F.count_if(F.col("n_chars") > 5000).alias("focus"))


def status_histogram_check(spark, sf_dir):
    """Declared against calculated counts of a fixed domain."""
    calc = review.status_counts(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_returnflag", ["A", "N"])
    declared = table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.count_if(F.col("l_returnflag").isin("A", "N") & (F.col("l_quantity") > 1)).alias("declared"))
    return calc.join(declared, "l_linestatus").select("*", (F.col("declared") == F.col("n_a") + F.col("n_n")).alias("matches"))


def double_pass_agreement(spark, sf_dir):
    """Two passes: by the language's column and by the text's letters."""
    t = F.col("text")
    b = F.when(t.rlike("[ñ¿¡]"), "es").when(t.rlike("[äöüß]"), "de").when(t.rlike("[èêç]"), "fr").otherwise("en")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", b.alias("second"), (F.col("n_chars") > 300).alias("sure"))
    return d.select("doc_id", "second", review.agreement(F.col("lang"), F.col("second"), F.lit(True), F.col("sure")).alias("outcome"))


def provenance_binding(spark, sf_dir):
    """Evidence counts only if number and content digest are those of the text it was made for."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    e = table(spark, sf_dir, "documents").filter("doc_id % 3 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("sha"), F.lit(True).alias("_e"))
    return d.join(e, ["doc_id", "sha"], "left").select("doc_id", "sha", F.col("_e").isNotNull().alias("bound"))


def deterministic_codes(spark, sf_dir):
    """Codes from a digest and a number; a code is new, present, or in conflict with other content."""
    d = table(spark, sf_dir, "documents").select(F.sha2("source", 256).alias("sha"), (F.col("doc_id") % 1000).alias("no"), "doc_id", "n_chars")
    mine = d.groupBy("sha", "no").agg(F.min("doc_id").alias("doc_id"), F.min_by("n_chars", "doc_id").alias("n_chars")).withColumn("code", item_code("Q-", F.col("sha"), F.col("no")))
    bank = mine.filter("doc_id % 4 <> 0").select("code", (F.col("n_chars") + F.when(F.col("doc_id") % 10 == 1, 1).otherwise(0)).alias("stored"))
    outcome = F.when(F.col("stored").isNull(), "insert").when(F.col("stored") == F.col("n_chars"), "present").otherwise("conflict")
    return mine.join(bank, "code", "left").select("code", "doc_id", outcome.alias("outcome"))


def content_dedup(spark, sf_dir):
    """Equal texts share a digest; the smallest id stands for them."""
    d = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"))
    return d.select("doc_id", "sha", "n_copies")


def batch_digest(spark, sf_dir):
    """A digest of each customer's orders, free of their order."""
    return group_digest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")])


QUERIES = {f.__name__: f for f in (optional_stage_board, next_action_state, recovery_scan, lease_expiry, stale_processing, incremental_reuse, null_safe_drift, insert_or_ignore, upsert_preserve, positional_reconcile, eligibility_reasons, strict_batch_gate, review_progress, status_histogram_check, double_pass_agreement, provenance_binding, deterministic_codes, content_dedup, batch_digest)}
_LAST = "(SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"
_LABELLED = "documents d LEFT JOIN labels l USING (doc_id)"
ORACLE_SQL = {
    "optional_stage_board": f"SELECT o_orderkey, o_orderstatus, coalesce(n_render, 0) AS n_render, coalesce(n_layout, 0) AS n_layout, coalesce(n_split, 0) AS n_split, l_orderkey IS NOT NULL AS started FROM {STAGES}",
    "next_action_state": f"""
SELECT o_orderkey, CASE WHEN l_orderkey IS NULL THEN 'render' WHEN o_orderstatus = 'P' THEN 'review' WHEN n_layout = 0 THEN 'layout' WHEN n_split = 0 THEN 'split'
  WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'audit' WHEN n_render > 2 THEN 'admit' ELSE 'done' END AS next_action FROM {STAGES}""",
    "recovery_scan": f"SELECT o_orderkey, o_orderstatus FROM {STAGES} WHERE o_orderstatus <> 'F' AND ((n_split IS NULL) OR (n_render > 0 AND n_split = 0) OR (n_split > 0 AND n_layout = 0))",
    "lease_expiry": f"SELECT user_id, event_id, ts + INTERVAL 300 SECOND > TIMESTAMP '{NOW}' AS blocked FROM {_LAST}",
    "stale_processing": f"SELECT user_id, event_type FROM {_LAST} WHERE ts < TIMESTAMP '{NOW}' - INTERVAL 15 MINUTE",
    "incremental_reuse": f"""
SELECT n.o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'new' WHEN n.o_orderstatus IS NOT DISTINCT FROM o.o_orderstatus AND n.o_totalprice IS NOT DISTINCT FROM o.o_totalprice THEN 'reuse' ELSE 'recrop' END AS action
FROM {PERTURBED} n LEFT JOIN orders o USING (o_orderkey)""",
    "null_safe_drift": f"""
SELECT c AS "column", count(*) AS n_changed FROM (
  SELECT unnest([CASE WHEN n.o_orderstatus IS DISTINCT FROM o.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN n.o_totalprice IS DISTINCT FROM o.o_totalprice THEN 'o_totalprice' END,
    CASE WHEN n.o_orderpriority IS DISTINCT FROM o.o_orderpriority THEN 'o_orderpriority' END]) AS c FROM {PERTURBED} n JOIN orders o USING (o_orderkey)) WHERE c IS NOT NULL GROUP BY c""",
    "insert_or_ignore": f"""
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders UNION ALL
SELECT o_orderkey, o_orderstatus, o_totalprice FROM {PERTURBED} n WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = n.o_orderkey)""",
    "upsert_preserve": f"""
WITH d AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, o.o_orderkey IS NOT NULL AS had, n.o_orderkey IS NOT NULL AS has, o.o_orderstatus AS os, n.o_orderstatus AS ns, o.o_totalprice AS op, n.o_totalprice AS np
  FROM orders o FULL JOIN {PERTURBED} n ON o.o_orderkey = n.o_orderkey),
t AS (SELECT *, has AND (NOT had OR coalesce(os IN ('P', 'O'), false)) AS take FROM d)
SELECT o_orderkey, CASE WHEN take THEN ns ELSE os END AS o_orderstatus, CASE WHEN take THEN np ELSE op END AS o_totalprice,
  CASE WHEN NOT had THEN 'inserted' WHEN NOT has THEN 'kept' WHEN take THEN 'updated' ELSE 'preserved' END AS outcome FROM t""",
    "positional_reconcile": """
WITH o AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS v FROM lineitem GROUP BY ALL),
n AS (SELECT l_orderkey, CASE WHEN l_linenumber = 2 THEN 9 ELSE l_linenumber END AS l_linenumber, v + CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END AS v FROM o WHERE l_linenumber < 6 OR l_orderkey % 2 = 0)
SELECT coalesce(o.l_orderkey, n.l_orderkey) AS l_orderkey, coalesce(o.l_linenumber, n.l_linenumber) AS l_linenumber, o.v AS old_value, n.v AS new_value,
  CASE WHEN o.l_orderkey IS NULL THEN 'insert' WHEN n.l_orderkey IS NULL THEN 'delete' WHEN o.v IS NOT DISTINCT FROM n.v THEN 'same' ELSE 'update' END AS action
FROM o FULL JOIN n ON o.l_orderkey = n.l_orderkey AND o.l_linenumber = n.l_linenumber""",
    "eligibility_reasons": f"SELECT doc_id, {REASONS} AS reasons, {REASONS} = '' AS eligible FROM {_LABELLED}",
    "strict_batch_gate": f"SELECT source, count(*) AS n, count(*) FILTER (WHERE {REASONS} = '') AS n_eligible, bool_and({REASONS} = '') AS admitted FROM {_LABELLED} GROUP BY source",
    "review_progress": f"""
SELECT lang, count(*) AS total, count(*) FILTER (WHERE quality IS NULL) AS pending, count(*) FILTER (WHERE toxic = 1) AS disputed, count(*) FILTER (WHERE quality = 1) AS passed,
  count(*) FILTER (WHERE n_chars > 5000) AS focus FROM {_LABELLED} GROUP BY lang""",
    "status_histogram_check": """
WITH c AS (SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'A') AS n_a, count(*) FILTER (WHERE l_returnflag = 'N') AS n_n, count(*) FILTER (WHERE coalesce(l_returnflag, '') NOT IN ('A', 'N')) AS n_other,
  count(*) AS total, count(*) FILTER (WHERE l_returnflag IN ('A', 'N') AND l_quantity > 1) AS declared FROM lineitem GROUP BY 1)
SELECT *, declared = n_a + n_n AS matches FROM c""",
    "double_pass_agreement": """
WITH d AS (SELECT doc_id, lang, CASE WHEN regexp_matches(text, '[ñ¿¡]') THEN 'es' WHEN regexp_matches(text, '[äöüß]') THEN 'de' WHEN regexp_matches(text, '[èêç]') THEN 'fr' ELSE 'en' END AS second, n_chars > 300 AS sure FROM documents)
SELECT doc_id, second, CASE WHEN coalesce(lang = second AND sure, false) THEN 'approved' WHEN lang IS DISTINCT FROM second THEN 'disputed' ELSE 'pending' END AS outcome FROM d""",
    "provenance_binding": "SELECT doc_id, sha256(text) AS sha, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS bound FROM documents",
    "deterministic_codes": """
WITH m AS (SELECT sha256(source) AS sha, doc_id % 1000 AS no, min(doc_id) AS doc_id FROM documents GROUP BY ALL),
c AS (SELECT 'Q-' || substr(sha, 1, 16) || '-' || lpad(no::VARCHAR, 3, '0') AS code, doc_id FROM m)
SELECT code, doc_id, CASE WHEN doc_id % 4 = 0 THEN 'insert' WHEN doc_id % 10 = 1 THEN 'conflict' ELSE 'present' END AS outcome FROM c""",
    "content_dedup": "SELECT min(doc_id) AS doc_id, sha256(text) AS sha, count(*) AS n_copies FROM documents GROUP BY sha256(text)",
    "batch_digest": """
WITH t AS (SELECT o_custkey, concat_ws('|', coalesce(o_orderkey::VARCHAR, '\\N'), coalesce(o_orderstatus, '\\N'), coalesce(o_orderpriority, '\\N')) AS t FROM orders)
SELECT o_custkey, sha256(string_agg(t, chr(10) ORDER BY t)) AS digest, count(*) AS n_rows FROM t GROUP BY o_custkey""",
}
