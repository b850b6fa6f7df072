"""Carrier queries for the item bank: listing, facets, children, assets, baskets, deletion, export."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itemloom.functions import safe_path
from itemloom.operators import basket, manifests, runners, search, sequence, writes
from itemloom.sources import table


def _bank(spark, sf_dir):
    """Parts as questions, nations as papers, brands as types, K0..K13 as points; suppliers of a part's lines give its related points."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    q = part.select(
        k.alias("question_id"), (k % 40).alias("import_job_id"), F.when(k % 13 == 0, "x").otherwise((k % 90).cast("string")).alias("question_no"), (k % 25).alias("paper_id"), F.col("p_brand").alias("type_code"),
        F.concat(F.lit("K"), (k % 10).cast("string")).alias("primary_code"), F.when(k % 3 == 0, "passed").when(k % 3 == 1, "pending").alias("figure_review_status"), F.when(k % 7 == 0, "2024-01-01").alias("deleted_at"),
    )
    related = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_partkey").alias("question_id"), F.concat(F.lit("K"), (F.col("l_suppkey") % 10).cast("string")).alias("code"))
    papers = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("paper_id"), F.col("n_name").alias("paper_name"), (2000 + F.col("n_nationkey") % 5).cast("long").alias("exam_year"))
    types = part.select(F.col("p_brand").alias("code"), F.concat(F.lit("type "), "p_brand").alias("name"), F.lit(True).alias("is_active")).distinct()
    points = spark.range(14).select(F.concat(F.lit("K"), F.col("id").cast("string")).alias("code"), F.concat(F.lit("point "), F.col("id").cast("string")).alias("name"), (F.col("id") != 12).alias("is_active"))
    return q, related, papers, types, points


BANK = """q AS (SELECT p_partkey AS question_id, p_partkey % 40 AS import_job_id, CASE WHEN p_partkey % 13 = 0 THEN 'x' ELSE (p_partkey % 90)::VARCHAR END AS question_no,
  p_partkey % 25 AS paper_id, p_brand AS type_code, 'K' || (p_partkey % 10) AS primary_code, p_partkey % 3 = 0 AS has_figure, p_partkey % 7 <> 0 AS live FROM part),
rel AS (SELECT l_partkey AS question_id, 'K' || (l_suppkey % 10) AS code FROM lineitem WHERE l_linenumber = 1)"""


def bank_listing(spark, sf_dir):
    """Live questions of one point (as primary or related) with a figure, from papers whose name holds a text; newest first."""
    q, related, papers, types, points = _bank(spark, sf_dir)
    mine = q.filter("question_id % 11 = 0").select("question_id")
    rows = search.listing(q, related, papers, types, points, mine, knowledge="K3", has_figure="true", source="A")
    return search.in_order(rows).limit(300).select("question_id", "type_name", "point_name", "paper_name", "exam_year", "has_figure", "in_basket")


def bank_listing_by_type(spark, sf_dir):
    """Live questions of one type, with and without a figure."""
    q, related, papers, types, points = _bank(spark, sf_dir)
    return search.listing(q, related, papers, types, points, question_type="Brand#13").select("question_id", "question_no", "point_name", "has_figure", "in_basket")


def used_points(spark, sf_dir):
    """Points that a live question has; K10 to K13 are never used, and few lines are looked at."""
    q, related, _, _, points = _bank(spark, sf_dir)
    return search.used_points(q.filter("question_id % 5 = 0"), related, points).select("code", "name")


def filter_checks(spark, sf_dir):
    """Which filters are refused before anything is searched."""
    _, _, _, types, points = _bank(spark, sf_dir)
    cases = [("knowledge", "K3"), ("knowledge", "K12"), ("knowledge", ""), ("question_type", "Brand#13"), ("question_type", "none"), ("has_figure", "true"), ("has_figure", ""), ("source", ""), ("source", "x" * 101), ("source", "a\tb")]
    rows = []
    for name, value in cases:
        try:
            search.check_filters(types, points, **{name: value})
            rows.append((name, value, True))
        except search.BadFilter:
            rows.append((name, value, False))
    return spark.createDataFrame(rows, "name string, value string, accepted boolean")


def children_lists(spark, sf_dir):
    """Customers with their orders in order; some have none."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority")
    d = search.with_children(c, o, "c_custkey", "o_orderkey", ["o_orderpriority"], "orders")
    return d.select("c_custkey", F.array_join(F.transform("orders", lambda x: F.concat_ws(":", x["o_orderkey"].cast("string"), x["o_orderpriority"])), ",").alias("orders"), F.size("orders").cast("long").alias("n"))


def _crops(spark, sf_dir):
    k = F.col("page_id")
    path = F.when(k % 9 == 0, "../x.png").when(k % 31 == 0, "/abs.png").when(k % 37 == 0, "a\\b.png").when(k % 41 == 0, "crops/a.jpg").otherwise(F.concat(F.lit("crops/Q"), k.cast("string"), F.lit(".png")))
    return table(spark, sf_dir, "pages").filter("page_id IS NOT NULL").select("page_id", F.floor(k / 4).alias("job"), path.alias("relative_path"), F.sha2(k.cast("string"), 256).alias("sha256"), (k % 5).alias("width"), F.lit(3).alias("height"), F.when(k % 8 != 0, "pending").alias("review_status"))


def whole_crop_scan(spark, sf_dir):
    """Crops of the jobs all of whose paths are safe."""
    d = _crops(spark, sf_dir)
    return search.keep_whole(d, "job", ~safe_path(F.col("relative_path"))).select("page_id", "job", "relative_path")


def safe_figure_scan(spark, sf_dir):
    """Figures that can be shown; unsafe ones go, the rest stays."""
    return manifests.safe_figures(_crops(spark, sf_dir)).select("page_id", "relative_path")


def verified_assets(spark, sf_dir):
    """Assets whose entry in the manifest and whose file are what the table says."""
    k, d = F.col("doc_id"), table(spark, sf_dir, "documents")
    path = F.concat(F.lit("d/"), k.cast("string")).alias("path")
    assets = d.select(path, F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("width"))
    manifest = d.filter(k % 5 != 0).select(path, F.sha2("text", 256).alias("sha256"), (F.col("n_chars") + (k % 7 == 0).cast("int")).alias("width"))
    files = d.select(path, F.when(k % 11 != 0, F.sha2("text", 256)).alias("sha256"))
    return search.verified_assets(assets, manifest, files, ["sha256", "width"]).select("path", "verified")


def _items(spark, sf_dir):
    """Orders in baskets; positions follow the key."""
    o = table(spark, sf_dir, "orders")
    row = [(F.col("o_custkey") % 20).alias("basket_id"), F.col("o_orderkey").alias("question_id")]
    items = basket.compact(o.filter("o_orderkey % 6 = 0").select(*row, F.col("o_orderkey").alias("position")))
    return basket.add(items, o.filter("o_orderkey % 10 = 0").select(*row))


ITEMS = """base AS (SELECT o_custkey % 20 AS basket_id, o_orderkey AS question_id, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) AS position FROM orders WHERE o_orderkey % 6 = 0),
items AS (SELECT * FROM base UNION ALL
  SELECT o_custkey % 20 AS b, o_orderkey, coalesce((SELECT max(position) FROM base WHERE basket_id = o_custkey % 20), 0) + row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey)
  FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey % 6 <> 0)"""


def basket_after_deletion(spark, sf_dir):
    """Baskets after questions were deleted: gone, and positions 1..n again."""
    items = _items(spark, sf_dir)
    q = items.select("question_id").distinct().withColumns({c: F.lit(None).cast("string") for c in ("deleted_at", "deletion_reason", "deletion_note")})
    return basket.delete_questions(q, items, q.filter("question_id % 4 = 0"), "2024-02-01", "duplicate")[1].select("basket_id", "question_id", F.col("position").cast("long").alias("position"))


def deletion_and_restore(spark, sf_dir):
    """Marks after a deletion, of which some were marked before, and a restoring that clears the time alone."""
    k = F.col("p_partkey")
    q = table(spark, sf_dir, "part").select(k.alias("question_id"), F.when(k % 6 == 0, "2023-01-01").alias("deleted_at"), F.when(k % 6 == 0, "old").alias("deletion_reason"), F.lit(None).cast("string").alias("deletion_note"))
    items = q.select(F.lit(1).cast("long").alias("basket_id"), "question_id", F.col("question_id").alias("position"))
    q, _ = basket.delete_questions(q, items, q.filter("question_id % 4 = 0"), "2024-02-01", "duplicate", "note")
    return basket.restore_questions(q, q.filter("question_id % 8 = 0"))


def basket_move(spark, sf_dir):
    """One question moves up past its live neighbour; another at the edge stays."""
    items = spark.range(60).select((F.col("id") % 3).alias("basket_id"), F.col("id").alias("question_id"), (F.floor(F.col("id") / 3) + 1).alias("position"))
    live = spark.range(60).filter("id % 5 <> 0").select(F.col("id").alias("question_id"))
    return basket.move(basket.move(items, live, 1, 31, up=True), live, 2, 2, up=True)


def basket_export(spark, sf_dir):
    """The export ledger: digest and length of each basket's Markdown."""
    k = F.col("question_id")
    items = _items(spark, sf_dir)
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id")).withColumns({"deleted_at": F.when(k % 9 == 0, "x"), "stem_markdown": F.concat(F.lit("Stem "), k.cast("string")), "paper_name": F.when(k % 4 != 0, "paper"), "exam_year": F.when(k % 7 != 0, (2000 + k % 3).cast("int"))})
    options = q.filter("question_id % 3 = 0").select("question_id", F.posexplode(F.array(*[F.lit(c) for c in "BCA"])).alias("display_order", "code")).withColumn("content", F.concat(F.lit("option "), "code"))
    return basket.ledger(basket.export_markdown(items, q, options), "2024-02-01")


def _ranked(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("position", F.row_number().over(w).cast("long"))


def reconciled_children(spark, sf_dir):
    """Customers' orders set anew by position: ids that stay, new ones without, and references to surplus ones emptied."""
    o = _ranked(spark, sf_dir)
    old = o.filter("position <= 6").select(F.col("o_custkey").alias("parent"), "position", F.col("o_orderkey").alias("child_id"))
    new = o.filter("position <= o_custkey % 10").select(F.col("o_custkey").alias("parent"), "position", F.col("o_orderpriority").alias("value"))
    refs = old.select(F.col("child_id").alias("asset"), "child_id")
    children, kept = writes.reconciled(old, new, ["parent"], "position", ["value"], "child_id", refs, "child_id")
    return children.select("parent", "position", "child_id", "value").unionByName(kept.select(F.lit(-1).cast("long").alias("parent"), F.col("asset").alias("position"), "child_id", F.lit("asset").alias("value")))


def budget_overflows(spark, sf_dir):
    """Where a source's running total of characters passes its cap, and which caps its totals pass."""
    d = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select("source", "doc_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    first = sequence.first_overflow(d, ["source"], "doc_id", "n_chars", 20_000).select("source", F.lit("running").alias("cap"), F.col("doc_id").alias("at"), F.col("running").cast("double").alias("total"))
    caps = sequence.over_caps(d, ["source"], {"rows": (F.count(F.lit(1)), 40), "chars": (F.sum("n_chars"), 50_000), "longest": (F.max("n_chars"), 1 << 40)})
    return first.unionByName(caps.select("source", "cap", F.lit(None).cast("long").alias("at"), "total"))


def stage_prompts(spark, sf_dir):
    """Prompts of two stages: the same bytes for the same rows."""
    o = table(spark, sf_dir, "orders").filter("o_custkey % 3 = 0").select("o_custkey", F.col("o_orderkey").cast("string").alias("no"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("text"))
    one = lambda s: runners.stage_prompts(o, s, "o_custkey", "no", ["text"]).withColumn("stage", F.lit(s))
    return one("transcribe").unionByName(one("audit")).select("o_custkey", "stage", F.sha2("prompt", 256).alias("sha256"), F.length("prompt").cast("long").alias("length"))


_FNS = (reconciled_children, budget_overflows, stage_prompts, bank_listing, bank_listing_by_type, used_points, filter_checks, children_lists, whole_crop_scan, safe_figure_scan, verified_assets, basket_after_deletion, deletion_and_restore, basket_move, basket_export)
QUERIES = {f.__name__: f for f in _FNS}
_BAD_PATH = "page_id % 9 = 0 OR page_id % 31 = 0 OR page_id % 37 = 0 OR page_id % 41 = 0"
_PATH = "CASE WHEN page_id % 9 = 0 THEN '../x.png' WHEN page_id % 31 = 0 THEN '/abs.png' WHEN page_id % 37 = 0 THEN 'a\\b.png' WHEN page_id % 41 = 0 THEN 'crops/a.jpg' ELSE 'crops/Q' || page_id || '.png' END"
_ROWS = "'{\"no\":\"' || o_orderkey || '\",\"text\":' || CASE WHEN o_orderkey % 4 <> 0 THEN '\"' || o_orderpriority || '\"' ELSE 'null' END || '}'"
ORACLE_SQL = {
    "reconciled_children": """
WITH o AS (SELECT o_custkey AS parent, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, o_orderkey, o_orderpriority FROM orders)
SELECT parent, position, CASE WHEN position <= 6 THEN o_orderkey END AS child_id, o_orderpriority AS value FROM o WHERE position <= parent % 10
UNION ALL SELECT -1, o_orderkey, CASE WHEN position <= parent % 10 THEN o_orderkey END, 'asset' FROM o WHERE position <= 6""",
    "budget_overflows": """
WITH d AS (SELECT source, doc_id, coalesce(n_chars, 0) AS n, sum(coalesce(n_chars, 0)) OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT source, count(*) AS rows, sum(n) AS chars FROM d GROUP BY source)
SELECT source, 'running' AS cap, min(doc_id) AS at, min(r)::DOUBLE AS total FROM d WHERE r > 20000 GROUP BY source UNION ALL SELECT source, 'rows', NULL, rows::DOUBLE FROM g WHERE rows > 40 UNION ALL SELECT source, 'chars', NULL, chars::DOUBLE FROM g WHERE chars > 50000""",
    "stage_prompts": f"""
WITH t(stage, task) AS (VALUES {", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in runners.TASKS.items() if k in ("transcribe", "audit"))}),
q AS (SELECT o_custkey, string_agg({_ROWS}, ',' ORDER BY o_orderkey) AS rows FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1), p AS (SELECT o_custkey, stage, '{{"task":"' || task || '","questions":[' || rows || ']}}' AS prompt FROM q, t)
SELECT o_custkey, stage, sha256(prompt) AS sha256, length(prompt) AS length FROM p""",
    "bank_listing": f"""
WITH {BANK} SELECT question_id, 'type ' || type_code AS type_name, 'point ' || substr(primary_code, 2) AS point_name, n_name AS paper_name, (2000 + n_nationkey % 5)::BIGINT AS exam_year, has_figure, question_id % 11 = 0 AS in_basket
FROM q JOIN nation ON n_nationkey = paper_id WHERE live AND has_figure AND (primary_code = 'K3' OR EXISTS (SELECT 1 FROM rel r WHERE r.question_id = q.question_id AND r.code = 'K3')) AND contains(lower(n_name), 'a')
ORDER BY exam_year DESC, import_job_id DESC, TRY_CAST(question_no AS INTEGER) ASC NULLS FIRST, question_id LIMIT 300""",
    "bank_listing_by_type": f"""
WITH {BANK} SELECT question_id, question_no, 'point ' || substr(primary_code, 2) AS point_name, has_figure, false AS in_basket FROM q WHERE live AND type_code = 'Brand#13' AND paper_id IN (SELECT n_nationkey FROM nation)""",
    "used_points": f"""
WITH {BANK}, l AS (SELECT * FROM q WHERE live AND question_id % 5 = 0) SELECT 'K' || r AS code, 'point ' || r AS name FROM range(14) t(r)
WHERE EXISTS (SELECT 1 FROM l WHERE primary_code = 'K' || r) OR EXISTS (SELECT 1 FROM rel JOIN l USING (question_id) WHERE rel.code = 'K' || r)""",
    "filter_checks": """
WITH v(name, value) AS (VALUES ('knowledge', 'K3'), ('knowledge', 'K12'), ('knowledge', ''), ('question_type', 'Brand#13'), ('question_type', 'none'), ('has_figure', 'true'), ('has_figure', ''), ('source', ''), ('source', repeat('x', 101)), ('source', concat('a', chr(9), 'b')))
SELECT name, value, CASE name WHEN 'knowledge' THEN value IN (SELECT 'K' || r FROM range(14) t(r) WHERE r <> 12) WHEN 'question_type' THEN value IN (SELECT p_brand FROM part) WHEN 'has_figure' THEN value IN ('true', 'false')
  ELSE length(value) <= 100 AND NOT regexp_matches(value, '[\\x00-\\x1f]') END AS accepted FROM v""",
    "children_lists": """
SELECT c_custkey, coalesce(string_agg(o_orderkey || ':' || o_orderpriority, ',' ORDER BY o_orderkey), '') AS orders, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
    "whole_crop_scan": f"""
WITH p AS (SELECT page_id, page_id // 4 AS job, {_PATH} AS relative_path FROM pages WHERE page_id IS NOT NULL)
SELECT * FROM p WHERE job NOT IN (SELECT job FROM p WHERE {_BAD_PATH})""",
    "safe_figure_scan": f"SELECT page_id, {_PATH} AS relative_path FROM pages WHERE page_id IS NOT NULL AND NOT ({_BAD_PATH}) AND page_id % 5 >= 1 AND page_id % 8 <> 0",
    "verified_assets": "SELECT 'd/' || doc_id AS path, coalesce(text IS NOT NULL AND n_chars IS NOT NULL AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0, false) AS verified FROM documents",
    "basket_after_deletion": f"WITH {ITEMS} SELECT basket_id, question_id, row_number() OVER (PARTITION BY basket_id ORDER BY position, question_id) AS position FROM items WHERE question_id % 4 <> 0",
    "deletion_and_restore": """
WITH k AS (SELECT p_partkey AS question_id, p_partkey % 6 = 0 AS old, p_partkey % 4 = 0 AS gone FROM part)
SELECT question_id, CASE WHEN question_id % 8 = 0 THEN NULL WHEN old THEN '2023-01-01' WHEN gone THEN '2024-02-01' END AS deleted_at, CASE WHEN old THEN 'old' WHEN gone THEN 'duplicate' END AS deletion_reason,
  CASE WHEN gone AND NOT old THEN 'note' END AS deletion_note FROM k""",
    "basket_move": """
WITH i AS (SELECT r % 3 AS basket_id, r AS question_id, r // 3 + 1 AS position FROM range(60) t(r)),
s AS (SELECT question_id, row_number() OVER (ORDER BY position) AS place FROM i WHERE basket_id = 1 AND question_id % 5 <> 0), me AS (SELECT place FROM s WHERE question_id = 31)
SELECT basket_id, question_id, coalesce(CASE s.place - me.place WHEN 0 THEN me.place - 1 WHEN -1 THEN me.place END, position) AS position FROM i LEFT JOIN s USING (question_id) CROSS JOIN me""",
    "basket_export": f"""
WITH {ITEMS}, n AS (SELECT basket_id, question_id AS k, row_number() OVER (PARTITION BY basket_id ORDER BY position, question_id) AS no FROM items WHERE question_id % 9 <> 0),
b AS (SELECT basket_id, no, concat('## ', no, chr(10), 'Stem ', k, chr(10), CASE WHEN k % 3 = 0 THEN concat('- B. option B', chr(10), '- C. option C', chr(10), '- A. option A', chr(10)) ELSE '' END,
  '> ', CASE WHEN k % 4 <> 0 THEN 'paper' ELSE '?' END, ', ', CASE WHEN k % 7 <> 0 THEN (2000 + k % 3)::VARCHAR ELSE 'year unknown' END) AS t FROM n),
m AS (SELECT basket_id, count(*) AS n_questions, concat('# Questions', chr(10), chr(10), string_agg(t, chr(10) || chr(10) ORDER BY no), chr(10)) AS markdown FROM b GROUP BY basket_id)
SELECT basket_id, n_questions, sha256(markdown) AS output_sha256, length(markdown) AS output_chars, '2024-02-01' AS exported_at FROM m""",
}
