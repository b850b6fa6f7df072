"""Carrier queries for deletion over references, the rule catalogue and the taxonomy's written upsert."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.operators import catalogue, hierarchy, references
from itemloom.operators.references import Reference
from itemloom.sources import table

_REFERENCES = [
    Reference("customer", "nation", "nation", "cascade"), Reference("orders", "customer", "customer", "cascade"), Reference("lines", "order", "orders", "cascade"),
    Reference("lines", "part", "part", "cascade"), Reference("holds", "order", "orders", "restrict"), Reference("events", "customer", "customer", "null"), Reference("orders", "follows", "orders", "null"),
]
_KEYS = {"nation": "nation", "customer": "customer", "orders": "order", "lines": "line", "part": "part", "holds": "hold", "events": "event"}


def _bank(spark, sf_dir):
    """The star schema as tables that refer to each other; some orders follow the one before, urgent ones of a large total are held."""
    o = table(spark, sf_dir, "orders")
    return {
        "nation": table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("nation")),
        "customer": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_nationkey").cast("long").alias("nation")),
        "orders": o.select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("customer"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") - 1).alias("follows")),
        "lines": table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.col("l_orderkey").alias("order"), F.col("l_partkey").alias("part")),
        "part": table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part")),
        "holds": o.filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 300_000)).select((F.col("o_orderkey") + 1_000_000).alias("hold"), F.col("o_orderkey").alias("order")),
        "events": table(spark, sf_dir, "events").select(F.col("event_id").alias("event"), F.col("user_id").alias("customer")),
    }


def cascade_graph(spark, sf_dir):
    """Customers are deleted with their orders and lines, unless one of their orders is held; events lose their customer, orders the one they follow."""
    bank = _bank(spark, sf_dir)
    done = references.deletion(bank, _KEYS, _REFERENCES, "customer", bank["customer"].filter("customer % 7 = 3"))
    return (
        done["deleted"].select(F.lit("deleted").alias("what"), "relation", "key")
        .unionByName(done["nulled"].select(F.concat(F.lit("nulled "), "column").alias("what"), "relation", "key"))
        .unionByName(done["forbidden"].select(F.concat(F.lit("forbids "), F.col("root").cast("string")).alias("what"), "relation", "key"))
    )


def catalogue_breaks(spark, sf_dir):
    """CHECK rules that rows of the given tables break when read as jobs, assets, papers, drafts and runs."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    jobs = o.select(k.alias("key"), F.when(k % 3 != 0, k % 11).alias("page_start"), F.when(k % 5 != 0, k % 7).alias("page_end"), F.when(F.col("o_orderstatus") == "P", "paused").when(F.col("o_orderstatus") == "F", "completed").otherwise("pending").alias("status"))
    sha = F.when(k % 9 == 0, F.upper(F.sha2(F.col("o_orderpriority"), 256))).when(k % 10 == 0, F.md5("o_orderpriority")).otherwise(F.sha2(F.col("o_orderpriority"), 256))
    assets = o.select(k.alias("key"), F.when(k % 4 == 0, "figure").otherwise("question_figure").alias("asset_kind"), F.concat(F.when(k % 6 == 0, "../").when(k % 8 == 0, "/").otherwise(""), "o_orderpriority").alias("relative_path"), (k % 5).alias("width"), (k % 7).alias("height"), F.floor("o_totalprice").cast("long").alias("byte_size"), sha.alias("sha256"), F.lit("ai_review_passed").alias("review_status"), (k % 13).alias("display_order"))
    d = table(spark, sf_dir, "documents")
    papers = d.select(F.col("doc_id").alias("key"), F.sha2("text", 256).alias("sha256"), (F.col("n_chars") - 100).alias("file_size"), F.substring("text", 1, 1).alias("original_filename"), F.concat(F.when(F.col("lang") == "en", "raw_papers/").otherwise("raw/"), F.col("source")).alias("stored_path"), (F.col("n_chars") % 9000 + 1500).alias("exam_year"), F.col("lang").alias("paper_name"))
    points = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), (F.col("n_nationkey") % 5).alias("level"), F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("parent_id"), (F.col("n_nationkey") % 3).alias("sort_order"), (F.col("n_nationkey") % 4).alias("is_active"))
    drafts = o.select(k.alias("key"), *[F.lit(None).cast("string").alias(c) for c in ("deletion_note", "source_question_no", "source_candidate_sha256")], F.lower(F.substring("o_orderpriority", 3, 6)).alias("deletion_reason"), F.lit("approved").alias("status"), (k % 6).alias("version"), F.when(k % 2 == 0, "human").otherwise("robot").alias("approval_source"), F.lit(None).cast("string").alias("approval_evidence_json"))
    rows = {"import_jobs": jobs, "question_assets": assets, "source_papers": papers, "knowledge_points": points, "candidate_review_drafts": drafts}
    found = [catalogue.breaks(df, name, ["key"]).withColumn("relation", F.lit(name)) for name, df in rows.items()]
    return reduce(DataFrame.unionByName, found).select("relation", "key", "rule")


def trigger_breaks(spark, sf_dir):
    """Changes that triggers forbid: lines as options of orders, of which those in state F belong to a finished admission; orders as jobs."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    old = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("question_id"), F.col("part").alias("body"))
    new = old.filter("id % 11 <> 0").withColumn("body", F.when(F.col("id") % 7 == 0, F.col("body") + 1).otherwise(F.col("body"))).unionByName(old.filter("id % 13 = 0").withColumn("id", F.col("id") + 10_000_000_000))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending").alias("status"))
    finished = o.filter("status = 'completed'").select(F.col("id").alias("key"))
    options = catalogue.forbidden_changes(old, new, "question_options", ["id"], {"question": finished})
    jobs = catalogue.forbidden_changes(o, o.withColumn("status", F.when(F.col("id") % 5 == 0, "failed").otherwise(F.col("status"))), "import_jobs", ["id"], {"job": finished.filter("key % 2 = 0")})
    return options.unionByName(jobs)


def _tree(spark, sf_dir):
    """Regions, nations, customers and orders as one tree of four levels; a few orders name a customer that is none or go round, some come twice."""
    code = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    above = F.when(k % 101 == 0, "C0").when(k % 103 == 0, code("O", "o_orderkey")).when(k % 107 == 0, F.concat(F.lit("O"), (k - k % 5).cast("string"))).otherwise(code("C", "o_custkey"))
    return (
        table(spark, sf_dir, "region").select(code("R", "r_regionkey").alias("code"), F.lit(None).cast("string").alias("parent_code"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("place"))
        .unionByName(table(spark, sf_dir, "nation").select(code("N", "n_nationkey").alias("code"), code("R", "n_regionkey").alias("parent_code"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("place")))
        .unionByName(table(spark, sf_dir, "customer").select(code("C", "c_custkey").alias("code"), code("N", "c_nationkey").alias("parent_code"), F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("place")))
        .unionByName(o.select(code("O", "o_orderkey").alias("code"), above.alias("parent_code"), F.col("o_orderpriority").alias("name"), k.alias("place")))
        .unionByName(o.filter(k % 109 == 0).select(code("O", "o_orderkey").alias("code"), F.lit("R0").alias("parent_code"), F.lit("again").alias("name"), k.alias("place")))
    )


def tree_upsert(spark, sf_dir):
    """A tree written over known rows: regions and nations are known (one nation under no region), every fourth customer too, one code is gone."""
    known = (
        table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("code"), F.lit(None).cast("long").alias("parent_id"), F.col("r_name").alias("name"))
        .unionByName(table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 10).cast("long").alias("id"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"), F.when(F.col("n_nationkey") != 7, F.col("n_regionkey") + 1).cast("long").alias("parent_id"), F.col("n_name").alias("name")))
        .unionByName(table(spark, sf_dir, "customer").filter("c_custkey % 4 = 0").select((F.col("c_custkey") + 100).alias("id"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("code"), (F.col("c_nationkey") + 10).cast("long").alias("parent_id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).otherwise("old").alias("name")))
        .unionByName(table(spark, sf_dir, "region").filter("r_regionkey = 0").select(F.lit(50).cast("long").alias("id"), F.lit("X").alias("code"), F.lit(None).cast("long").alias("parent_id"), F.lit("gone").alias("name")))
    )
    rows, faults = hierarchy.upsert(known, _tree(spark, sf_dir), ["name"], "place")
    return rows.unionByName(faults.select(F.lit(None).cast("long").alias("id"), "code", F.lit(None).cast("long").alias("parent_id"), F.lit(None).cast("string").alias("name"), F.col("fault").alias("action")))


QUERIES = {f.__name__: f for f in (cascade_graph, catalogue_breaks, trigger_breaks, tree_upsert)}
_SHA = "CASE WHEN k % 9 = 0 THEN upper(sha256(p)) WHEN k % 10 = 0 THEN md5(p) ELSE sha256(p) END"
_ORDER_PARENT = "CASE WHEN o_orderkey % 101 = 0 THEN 'C0' WHEN o_orderkey % 103 = 0 THEN 'O' || o_orderkey WHEN o_orderkey % 107 = 0 THEN 'O' || (o_orderkey - o_orderkey % 5) ELSE 'C' || o_custkey END"
ORACLE_SQL = {
    "tree_upsert": f"""
WITH RECURSIVE new AS (
  SELECT 'R' || r_regionkey AS code, CAST(NULL AS VARCHAR) AS parent, r_name AS name, CAST(r_regionkey AS BIGINT) AS place FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name, n_nationkey FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, c_mktsegment, c_custkey FROM customer
  UNION ALL SELECT 'O' || o_orderkey, {_ORDER_PARENT}, o_orderpriority, o_orderkey FROM orders UNION ALL SELECT 'O' || o_orderkey, 'R0', 'again', o_orderkey FROM orders WHERE o_orderkey % 109 = 0),
known AS (
  SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, 'R' || r_regionkey AS code, CAST(NULL AS BIGINT) AS parent_id, r_name AS name FROM region
  UNION ALL SELECT n_nationkey + 10, 'N' || n_nationkey, CASE WHEN n_nationkey <> 7 THEN n_regionkey + 1 END, n_name FROM nation
  UNION ALL SELECT c_custkey + 100, 'C' || c_custkey, c_nationkey + 10, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE 'old' END FROM customer WHERE c_custkey % 4 = 0
  UNION ALL SELECT 50, 'X', NULL, 'gone'),
once AS (SELECT * FROM new WHERE code NOT IN (SELECT code FROM new GROUP BY code HAVING count(*) > 1)),
up AS (SELECT code, CAST(1 AS BIGINT) AS depth FROM once WHERE parent IS NULL UNION ALL SELECT once.code, depth + 1 FROM once JOIN up ON once.parent = up.code),
lost AS (SELECT * FROM once WHERE code NOT IN (SELECT code FROM up)),
below AS (SELECT code, 'parent_missing' AS fault FROM lost WHERE parent NOT IN (SELECT code FROM once) UNION ALL SELECT lost.code, 'below_missing' FROM lost JOIN below ON lost.parent = below.code),
ids AS (SELECT code, parent, once.name AS name, k.id AS old, coalesce(k.id, (SELECT max(id) FROM known) + row_number() OVER (PARTITION BY k.id IS NULL ORDER BY depth, place, code)) AS id, k.parent_id AS old_parent, k.name AS old_name
  FROM once JOIN up USING (code) LEFT JOIN (SELECT id, code, parent_id, name FROM known) k USING (code))
SELECT i.id, i.code, p.id AS parent_id, i.name, CASE WHEN i.old IS NULL THEN 'insert' WHEN i.name IS NOT DISTINCT FROM i.old_name AND p.id IS NOT DISTINCT FROM i.old_parent THEN 'keep' ELSE 'update' END AS action FROM ids i LEFT JOIN ids p ON p.code = i.parent
UNION ALL SELECT id, code, parent_id, name, 'absent' FROM known WHERE code NOT IN (SELECT code FROM ids)
UNION ALL SELECT NULL, code, NULL, NULL, 'repeated_code' FROM new GROUP BY code HAVING count(*) > 1
UNION ALL SELECT NULL, code, NULL, NULL, fault FROM below UNION ALL SELECT NULL, code, NULL, NULL, 'cycle' FROM lost WHERE code NOT IN (SELECT code FROM below)""",
    "catalogue_breaks": f"""
WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, o_totalprice AS t FROM orders),
j AS (SELECT k, CASE WHEN k % 3 <> 0 THEN k % 11 END AS a, CASE WHEN k % 5 <> 0 THEN k % 7 END AS b, s FROM o),
n AS (SELECT n_nationkey AS k, n_nationkey % 5 AS level, CASE WHEN n_regionkey > 0 THEN n_regionkey END AS parent FROM nation),
d AS (SELECT doc_id, coalesce(substr(text, 1, 1), 'x') AS f, n_chars, n_chars % 9000 + 1500 AS y, coalesce(lang, 'x') AS lang FROM documents),
f AS (
  SELECT 'import_jobs' AS relation, k AS key, unnest([CASE WHEN a = 0 THEN 'page_start' END, CASE WHEN b = 0 THEN 'page_end' END, CASE WHEN s = 'P' THEN 'status' END,
    CASE WHEN (a IS NULL) <> (b IS NULL) OR coalesce(a > b, false) THEN 'pages' END]) AS rule FROM j
  UNION ALL SELECT 'question_assets', k, unnest([CASE WHEN k % 4 = 0 THEN 'asset_kind' END, CASE WHEN k % 6 = 0 OR k % 8 = 0 THEN 'relative_path' END, CASE WHEN k % 5 = 0 THEN 'width' END, CASE WHEN k % 7 = 0 THEN 'height' END,
    CASE WHEN floor(t) <= 0 THEN 'byte_size' END, CASE WHEN NOT regexp_full_match({_SHA}, '[0-9a-f]{{64}}') THEN 'sha256' END, CASE WHEN k % 13 = 0 THEN 'display_order' END]) FROM o
  UNION ALL SELECT 'source_papers', doc_id, unnest([CASE WHEN n_chars <= 100 THEN 'file_size' END, CASE WHEN f IN ('', ' ') THEN 'original_filename' END, CASE WHEN lang <> 'en' THEN 'stored_path' END,
    CASE WHEN y NOT BETWEEN 1900 AND 9999 THEN 'exam_year' END]) FROM d
  UNION ALL SELECT 'knowledge_points', k, unnest([CASE WHEN level NOT BETWEEN 1 AND 3 THEN 'level' END, CASE WHEN NOT ((level = 1 AND parent IS NULL) OR level > 1) THEN 'root' END, CASE WHEN k % 3 = 0 THEN 'sort_order' END, CASE WHEN k % 4 > 1 THEN 'is_active' END]) FROM n
  UNION ALL SELECT 'candidate_review_drafts', k, unnest(['deletion_reason', CASE WHEN k % 6 = 0 THEN 'version' END, CASE WHEN k % 2 <> 0 THEN 'approval_source' END]) FROM o)
SELECT * FROM f WHERE rule IS NOT NULL""",
    "trigger_breaks": """
WITH li AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS q FROM lineitem GROUP BY ALL), f AS (SELECT o_orderkey AS q FROM orders WHERE o_orderstatus = 'F')
SELECT CASE WHEN e = 'insert' THEN id + 10000000000 ELSE id END AS id, e AS event, 'option_' || e AS trigger
FROM (SELECT id, unnest([CASE WHEN id % 11 = 0 THEN 'delete' WHEN id % 7 = 0 THEN 'update' END, CASE WHEN id % 13 = 0 THEN 'insert' END]) AS e FROM li WHERE q IN (SELECT q FROM f)) WHERE e IS NOT NULL
UNION ALL SELECT o_orderkey, 'update', 'completed_job_status' FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0 AND o_orderkey % 5 = 0""",
    "cascade_graph": """
WITH doomed AS (SELECT c_custkey AS c FROM customer WHERE c_custkey % 7 = 3),
held AS (SELECT o_orderkey AS o, o_custkey AS c FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000),
gone AS (SELECT c FROM doomed WHERE c NOT IN (SELECT c FROM held)),
o AS (SELECT o_orderkey AS o FROM orders WHERE o_custkey IN (SELECT c FROM gone))
SELECT 'deleted' AS what, 'customer' AS relation, c AS key FROM gone
UNION ALL SELECT DISTINCT 'deleted', 'orders', o FROM o
UNION ALL SELECT DISTINCT 'deleted', 'lines', l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o FROM o)
UNION ALL SELECT DISTINCT 'nulled customer', 'events', event_id FROM events WHERE user_id IN (SELECT c FROM gone)
UNION ALL SELECT DISTINCT 'nulled follows', 'orders', o_orderkey FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey - 1 IN (SELECT o FROM o) AND o_orderkey NOT IN (SELECT o FROM o)
UNION ALL SELECT 'forbids ' || c, 'holds', o + 1000000 FROM held WHERE c IN (SELECT c FROM doomed)""",
}
