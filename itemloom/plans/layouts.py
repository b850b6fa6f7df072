"""Carrier queries for page layout, labels, taxonomies and figures."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itemloom.functions import half_even, page_range
from itemloom.operators import labels, layout, taxonomy
from itemloom.sources import table


def ink_columns(spark, sf_dir):
    """Suppliers as pages, quantities as ink: two bands are left out to make gutters (the second for every third page only)."""
    s = F.col("l_suppkey")
    gone = F.col("l_quantity").between(15 + s % 5, 21 + s % 5) | ((s % 3 == 0) & F.col("l_quantity").between(33, 38))
    ink = table(spark, sf_dir, "lineitem").filter(~gone).groupBy(s.alias("page"), F.col("l_quantity").cast("long").alias("x")).agg(F.count(F.lit(1)).alias("ink"))
    long = lambda v: F.lit(v).cast("long")
    box = {"width": long(250), "height": long(300), "sample_width": long(100), "scale": F.lit(0.5), "top": long(3), "bottom": long(103)}
    pages = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), *[c.alias(n) for n, c in box.items()], F.when(F.col("s_suppkey") % 7 != 0, long(1)).alias("left"), F.when(F.col("s_suppkey") % 7 != 0, long(51)).alias("right"))
    got = layout.columns(ink, pages, ["page"])
    return got.select("page", F.col("column_index").cast("long").alias("column_index"), "l", "t", "r", "b")


def layout_regions(spark, sf_dir):
    """Turns as pages of one or two columns; an anchor on two of three pages; each covers what follows up to the next."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    cols = c.withColumn("column_index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turn") % 2)))
    cols = cols.select("conv_id", "turn", "column_index", (F.col("column_index") * 500).alias("l"), F.lit(10).cast("long").alias("t"), F.when(F.col("turn") % 2 == 0, 1000).otherwise((F.col("column_index") + 1) * 500).cast("long").alias("r"), F.lit(900).cast("long").alias("b"))
    a = c.filter("turn % 3 <> 1").select("conv_id", "turn", ((F.col("turn") + F.col("conv_id")) % (F.col("turn") % 2 + 1)).alias("column_index"), F.lit(0).cast("long").alias("x"), (10 + (F.col("conv_id") * 7 + F.col("turn") * 13) % 700).alias("y"), ((F.col("turn") * 5 + F.col("conv_id")) % 7 + 1).cast("string").alias("question_no"))
    got = layout.regions(a, cols, ["conv_id"], "turn")
    return got.select("conv_id", "anchor_no", "question_no", F.col("region_no").cast("long").alias("region_no"), "turn", "l", "t", "r", "b", "warnings", "confidence").withColumn("anchor_no", F.col("anchor_no").cast("long"))


def main_anchors(spark, sf_dir):
    """Parts as words on pages of two columns; those that are a number at a column's left edge are anchors."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 20).alias("page"), (F.col("p_partkey") * 37 % 1000).alias("x"), (F.col("p_partkey") * 91 % 1000).alias("y"), F.concat((F.col("p_partkey") % 120).cast("string"), F.when(F.col("p_size") % 2 == 0, F.lit(".")).otherwise(F.lit(".5"))).alias("word"))
    cols = spark.createDataFrame([(page, k, 500 * k, 20, 500 * k + 500, 950) for page in range(20) for k in range(2)], "page long, column_index long, l long, t long, r long, b long")
    return layout.anchors(p, cols, ["page"])


def crop_plan_sizes(spark, sf_dir):
    """Size of each order's crop: the widest of its regions, their heights stacked with separators."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 50).alias("l"), (F.col("l_partkey") % 50 + 10 + F.col("l_suppkey") % 90).alias("r"), F.lit(0).cast("long").alias("t"), F.col("l_quantity").cast("long").alias("b"))
    return layout.crop_sizes(li, ["l_orderkey"], separator=12)


def display_assets(spark, sf_dir):
    """Lines as assets of orders: one complete picture for orders with image options, else every figure, each path once."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") != "O").alias("has_figure"), (F.col("o_orderkey") % 3 == 0).alias("image_options"))
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("long").alias("asset_id")).agg(F.min("l_partkey").alias("part"))
    li = li.select("o_orderkey", "asset_id", F.when(F.col("part") % 2 == 0, "complete_question").otherwise("question_figure").alias("kind"), F.concat(F.lit("p"), (F.col("part") % 4).cast("string")).alias("path"), (F.col("part") % 3).alias("display_order"))
    return layout.display_assets(o, li, "o_orderkey").select("o_orderkey", "position", "path", "asset_id")


def subquestion_labels(spark, sf_dir):
    """Turns with labels (a main, then two children); every fifth conversation has them out of order."""
    n = (F.floor(F.col("turn") / 3) + 1).cast("string")
    main = F.concat(F.lit("（"), n, F.lit("）"))
    label = F.when(F.col("turn") % 3 == 0, main).when(F.col("turn") % 3 == 1, F.concat(main, F.lit("①"))).otherwise(F.concat(main, F.lit("(ii)")))
    label = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 2), F.concat(main, F.lit("④"))).otherwise(label)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct().withColumn("label", label)
    got = labels.group_labels(c, ["conv_id"], "turn")
    return got.select("conv_id", "turn", F.col("main_no").cast("long").alias("main_no"), F.col("child_no").cast("long").alias("child_no"), "needs_review")


def taxonomy_lines(spark, sf_dir):
    """A Markdown file for each region: a module, its nations as topics, their suppliers as points; then it is parsed."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name")
    rank = F.lpad(F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")).cast("string"), 2, "0")
    n = n.withColumn("code", F.concat(F.lit("01."), rank))
    line = lambda df, kind, no, text: df.select(F.col("n_regionkey").cast("string").alias("path"), F.col("n_nationkey").cast("long").alias("a"), F.lit(kind).alias("b"), F.col(no).cast("long").alias("c"), text.alias("line"))
    head = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.lit(-1).alias("n_nationkey"), "r_name")
    topics = line(n, 0, "n_nationkey", F.concat(F.lit("### "), "code", F.lit(" "), "n_name"))
    points = line(n.join(table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey")), 1, "s_suppkey", F.concat(F.lit("- "), "s_name", F.lit("  ")))
    lines = line(head, 0, "n_nationkey", F.concat(F.lit("## 01 "), "r_name")).unionByName(topics).unionByName(points)
    lines = lines.withColumn("line_no", F.row_number().over(W.partitionBy("path").orderBy("a", "b", "c")).cast("long")).select("path", "line_no", "line")
    got = taxonomy.parse(lines, 1)
    return got.select("path", "code", "name", F.col("level").cast("long").alias("level"), "parent_code", "sort_order")


def page_ranges(spark, sf_dir):
    """Page ranges from texts: a, or a-b with a <= b, at most the number of pages."""
    d = F.col("o_orderkey")
    text = F.when(d % 4 == 0, (d % 9).cast("string")).when(d % 4 == 1, F.concat_ws("-", (d % 7).cast("string"), (d % 11).cast("string"))).when(d % 4 == 2, F.concat_ws(" - ", (d % 5).cast("string"), F.lit("8"))).otherwise(F.lit("all"))
    got = table(spark, sf_dir, "orders").select("o_orderkey", page_range(text, F.lit(8)).alias("p"))
    return got.select("o_orderkey", F.col("p.start").cast("long").alias("first_page"), F.col("p.stop").cast("long").alias("last_page"))


def half_even_pixels(spark, sf_dir):
    """Halves go to the even pixel."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q")).select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), half_even(F.col("q") * 2.5).alias("px"))


QUERIES = {f.__name__: f for f in (ink_columns, layout_regions, main_anchors, crop_plan_sizes, display_assets, subquestion_labels, taxonomy_lines, page_ranges, half_even_pixels)}
ORACLE_SQL = {
    "ink_columns": """
WITH p AS (SELECT s_suppkey AS page, CASE WHEN s_suppkey % 7 <> 0 THEN 1 END AS lo, CASE WHEN s_suppkey % 7 <> 0 THEN 51 END AS hi FROM supplier),
i AS (SELECT l_suppkey AS page, CAST(l_quantity AS BIGINT) AS x, count(*) AS ink FROM lineitem WHERE NOT (l_quantity BETWEEN 15 + l_suppkey % 5 AND 21 + l_suppkey % 5 OR (l_suppkey % 3 = 0 AND l_quantity BETWEEN 33 AND 38)) GROUP BY 1, 2),
e AS (SELECT page, unnest(generate_series(lo, hi - 1)) AS x FROM p WHERE lo IS NOT NULL),
q AS (SELECT e.page, e.x, e.x - row_number() OVER (PARTITION BY e.page ORDER BY e.x) AS run FROM e LEFT JOIN i ON i.page = e.page AND i.x = e.x WHERE coalesce(ink, 0) <= 1),
r AS (SELECT page, min(x) AS a, max(x) + 1 AS z FROM q GROUP BY page, run HAVING count(*) >= 4),
c AS (SELECT page, z - a AS n, 1 + (a + z - 2) // 2 AS c FROM r),
k AS (SELECT page, c, row_number() OVER (PARTITION BY page ORDER BY n DESC, c DESC) AS rn FROM c WHERE c > 1 + 50 * 0.15 AND c < 51 - 50 * 0.15),
g AS (SELECT page, list(c ORDER BY c) AS cuts FROM k WHERE rn <= 2 GROUP BY page),
h AS (SELECT p.page, lo, hi, CASE WHEN lo IS NULL OR g.cuts IS NULL THEN [] WHEN len(cuts) = 2 AND NOT ((cuts[1] - 1) / 50 BETWEEN 0.2 AND 0.45 AND (cuts[2] - 1) / 50 BETWEEN 0.55 AND 0.8) THEN cuts[1:1] ELSE cuts END AS cuts FROM p LEFT JOIN g USING (page)),
d AS (SELECT page, lo, [lo] || cuts || [hi] AS edges, unnest(generate_series(1, len(cuts) + 1)) AS k FROM h)
SELECT page, CAST(k - 1 AS BIGINT) AS column_index, CAST(CASE WHEN lo IS NULL THEN 0 ELSE edges[k] * 2 END AS BIGINT) AS l, CAST(CASE WHEN lo IS NULL THEN 0 ELSE 6 END AS BIGINT) AS t,
  CAST(CASE WHEN lo IS NULL THEN 250 ELSE edges[k + 1] * 2 END AS BIGINT) AS r, CAST(CASE WHEN lo IS NULL THEN 300 ELSE 206 END AS BIGINT) AS b FROM d""",
    "layout_regions": """
WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) AS slot, CASE WHEN turn % 2 = 0 THEN 1000 ELSE (k + 1) * 500 END AS r FROM (SELECT conv_id, turn, unnest(generate_series(0, turn % 2)) AS k FROM c)),
a AS (SELECT c.conv_id, slot, 10 + (c.conv_id * 7 + c.turn * 13) % 700 AS y, (c.turn * 5 + c.conv_id) % 7 + 1 AS no FROM c JOIN s ON s.conv_id = c.conv_id AND s.turn = c.turn AND s.k = (c.turn + c.conv_id) % (c.turn % 2 + 1) WHERE c.turn % 3 <> 1),
n AS (SELECT *, row_number() OVER w AS anchor_no, lead(slot) OVER w AS nslot, lead(y) OVER w AS ny, lag(no) OVER w AS pno, row_number() OVER (PARTITION BY conv_id, no ORDER BY slot, y) > 1 AS seen FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY slot, y)),
z AS (SELECT n.conv_id, anchor_no, no, pno, seen, s.slot, s.turn, s.k, s.r, CASE WHEN s.slot = n.slot THEN y ELSE 10 END AS t, CASE WHEN s.slot = nslot THEN ny ELSE 900 END AS b
  FROM n JOIN s ON s.conv_id = n.conv_id AND s.slot >= n.slot AND (nslot IS NULL OR s.slot <= nslot))
SELECT conv_id, anchor_no, CAST(no AS VARCHAR) AS question_no, row_number() OVER (PARTITION BY conv_id, anchor_no ORDER BY slot) AS region_no, turn, CAST(k * 500 AS BIGINT) AS l, CAST(t AS BIGINT) AS t, CAST(r AS BIGINT) AS r, CAST(b AS BIGINT) AS b,
  CASE WHEN pno IS NULL THEN '' ELSE concat_ws(',', CASE WHEN seen THEN 'duplicate' END, CASE WHEN no <= pno THEN 'reverse' END, CASE WHEN no > pno + 1 THEN 'gap' END) END AS warnings,
  CASE WHEN pno IS NULL OR no > pno + 1 THEN 'medium' WHEN seen OR no <= pno THEN 'low' ELSE 'medium' END AS confidence FROM z WHERE b > t""",
    "main_anchors": """
WITH p AS (SELECT p_partkey % 20 AS page, p_partkey * 37 % 1000 AS x, p_partkey * 91 % 1000 AS y, p_partkey % 120 AS n FROM part WHERE p_size % 2 = 0 AND p_partkey % 120 > 0)
SELECT page, CAST(CASE WHEN x <= 80 THEN 0 ELSE 1 END AS BIGINT) AS column_index, CASE WHEN x BETWEEN 495 AND 500 THEN 500 ELSE x END AS x, greatest(y, 20) AS y, CAST(n AS VARCHAR) AS question_no FROM p WHERE (x <= 80 OR x BETWEEN 495 AND 580) AND y < 950""",
    "crop_plan_sizes": """
SELECT l_orderkey, count(*) AS n_regions, max(10 + l_suppkey % 90) AS width, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) + 12 * (count(*) - 1) AS height,
  max(10 + l_suppkey % 90) * (CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) + 12 * (count(*) - 1)) AS pixels FROM lineitem GROUP BY l_orderkey""",
    "display_assets": """
WITH l AS (SELECT l_orderkey AS o_orderkey, CAST(l_linenumber AS BIGINT) AS asset_id, min(l_partkey) AS part FROM lineitem GROUP BY 1, 2),
a AS (SELECT o_orderkey, asset_id, 'p' || (part % 4) AS path, part % 3 AS d, o_orderkey % 3 = 0 AS one FROM l JOIN orders USING (o_orderkey) WHERE o_orderstatus <> 'O' AND (part % 2 = 0) = (o_orderkey % 3 = 0)),
f AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey, path ORDER BY d, asset_id) AS rn FROM a),
p AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY d, asset_id) AS position FROM f WHERE rn = 1)
SELECT o_orderkey, position, path, asset_id FROM p WHERE NOT one OR position = 1""",
    "subquestion_labels": """
WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations),
m AS (SELECT conv_id, turn, turn // 3 + 1 AS m, CASE WHEN conv_id % 5 = 0 AND turn = 2 THEN 4 WHEN turn % 3 > 0 THEN turn % 3 END AS c FROM c),
l AS (SELECT *, coalesce(lag(m) OVER w, 0) AS pm, coalesce(lag(c) OVER w, 0) AS pc FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
k AS (SELECT *, bool_and((m = pm + 1 AND coalesce(c, 1) = 1) OR (m = pm AND coalesce(c = pc + 1, false))) OVER (PARTITION BY conv_id) AS ok FROM l)
SELECT conv_id, turn, CASE WHEN ok THEN CAST(m AS BIGINT) END AS main_no, CASE WHEN ok THEN CAST(c AS BIGINT) END AS child_no, NOT ok AS needs_review FROM k""",
    "taxonomy_lines": """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation),
s AS (SELECT n_regionkey, i, s_name, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) AS j FROM n JOIN supplier ON s_nationkey = n_nationkey)
SELECT CAST(r_regionkey AS VARCHAR) AS path, '01' AS code, r_name AS name, 1::BIGINT AS level, NULL AS parent_code, 1::BIGINT AS sort_order FROM region
UNION ALL SELECT CAST(n_regionkey AS VARCHAR), printf('01.%02d', i), n_name, 2, '01', i FROM n
UNION ALL SELECT CAST(n_regionkey AS VARCHAR), printf('01.%02d.%02d', i, j), s_name, 3, printf('01.%02d', i), j FROM s""",
    "page_ranges": """
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 9 WHEN 1 THEN o_orderkey % 7 WHEN 2 THEN o_orderkey % 5 END AS a, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 9 WHEN 1 THEN o_orderkey % 11 WHEN 2 THEN 8 END AS b FROM orders)
SELECT o_orderkey, CASE WHEN a >= 1 AND a <= b AND b <= 8 THEN CAST(a AS BIGINT) END AS first_page, CASE WHEN a >= 1 AND a <= b AND b <= 8 THEN CAST(b AS BIGINT) END AS last_page FROM t""",
    "half_even_pixels": "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CAST(round_even(min(l_quantity) * 2.5, 0) AS BIGINT) AS px FROM lineitem GROUP BY 1, 2",
}
