"""Carrier queries for boxes on pages: layouts against their pages and columns, and crop plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemloom.operators import boxes
from itemloom.sources import table, tasks_for


def _pages(spark, sf_dir):
    """Suppliers as rendered pages of 1,000 by 900 pixels, of job s_nationkey."""
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("job"), F.col("s_suppkey").alias("page"), F.lit(1000).cast("long").alias("width"), F.lit(900).cast("long").alias("height"))


def _columns(spark, sf_dir):
    """Two columns a page, three on every third page, of which the third overlaps the second on every sixth."""
    p = _pages(spark, sf_dir).withColumn("column_index", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("page") % 3 == 0, 2).otherwise(1).cast("long"))))
    left = F.when(F.col("page") % 3 == 0, F.col("column_index") * 330 - F.when((F.col("page") % 6 == 0) & (F.col("column_index") == 2), 200).otherwise(0)).otherwise(F.col("column_index") * 500)
    right = F.when(F.col("page") % 3 == 0, F.col("column_index") * 330 + 330).otherwise(F.col("column_index") * 500 + 500)
    return p.select("job", "page", "column_index", left.alias("l"), F.lit(20).cast("long").alias("t"), right.alias("r"), F.lit(880).cast("long").alias("b"))


def _regions(spark, sf_dir):
    """Lines as regions of the question of their order, on the page of their supplier; a page in fifty is another one's number."""
    x, y = F.col("l_partkey") * 37 % 960, F.col("l_partkey") * 53 % 860
    page = F.when(F.col("l_partkey") % 50 == 0, F.col("l_suppkey") + 1_000_000).otherwise(F.col("l_suppkey"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    # Hardly any line comes twice, so lines are dealt by order before they are grouped: grouped first, each reading task would hold all of its part.
    li = li.repartition(tasks_for(li), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"), F.max("l_quantity").cast("long").alias("q"))
    return li.select(page.alias("page"), F.col("l_orderkey").alias("question_no"), F.col("l_linenumber").cast("long").alias("region_no"), x.alias("l"), y.alias("t"), (x + F.col("q") * 3 - 4).alias("r"), (y + F.col("q")).alias("b"))


def region_columns(spark, sf_dir):
    """How many columns of its page each region lies in, and the first of them."""
    got = boxes.containing(_regions(spark, sf_dir), _columns(spark, sf_dir).drop("job"), ["page"], "column_index")
    return got.groupBy("question_no", "region_no").agg(F.count(F.lit(1)).alias("n_columns"), F.min("column_index").alias("column_index"))


def region_page_faults(spark, sf_dir):
    """Regions that are off their page, in no column or in several, or before their predecessor; a job is a question here, its pages all."""
    pages = _pages(spark, sf_dir).drop("job").withColumn("book", F.lit(1))
    got = boxes.region_faults(_regions(spark, sf_dir).withColumn("book", F.lit(1)), _columns(spark, sf_dir).drop("job").withColumn("book", F.lit(1)), pages, ["book"], "page", cell=200)
    return got.select("question_no", "region_no", "fault")


def layout_page_faults(spark, sf_dir):
    """Analysed pages against rendered ones and their columns, with one thing wrong here and there."""
    p, s = _pages(spark, sf_dir), F.col("page")
    wrong = lambda n, good, bad: F.when(s % n == 0, bad).otherwise(good)
    analysed = p.filter(s % 17 != 0).select(
        "job", wrong(19, s, s + 1_000_000).alias("page"), wrong(5, F.col("width"), F.lit(999)).alias("width"), "height", wrong(7, F.when(s % 3 == 0, 3).otherwise(2), F.lit(4)).alias("column_count"),
        wrong(11, F.lit(True), F.lit(None)).alias("text_layer"), wrong(13, F.lit("high"), F.lit("sure")).alias("confidence"), F.col("width").alias("overlay_width"), wrong(9, F.col("height"), F.lit(1)).alias("overlay_height"), (s % 8).alias("overlay_bytes"),
    )
    return boxes.page_faults(analysed, p, _columns(spark, sf_dir), ["job", "page"])


def crop_plan_faults(spark, sf_dir):
    """Lines as regions of items (orders) of a job (a customer): numbers repeat, lack or exceed what is expected, budgets break."""
    o = table(spark, sf_dir, "orders")
    number = F.when(F.col("o_orderkey") % 31 == 0, 0).otherwise(F.col("o_orderkey") % 40 + 1)
    items = o.select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("item"), number.cast("long").alias("question_no"))
    expected = o.select(F.col("o_custkey").alias("job"), (F.col("o_orderkey") % 39 + 1).alias("question_no"))
    r = _regions(spark, sf_dir).join(o.select(F.col("o_orderkey").alias("question_no"), F.col("o_custkey").alias("job")), "question_no")
    r = r.select("job", F.col("question_no").alias("item"), (F.col("page") % 5).alias("page_number"), "l", "t", "r", "b").filter("item % 23 <> 0")
    r = r.repartition(tasks_for(table(spark, sf_dir, "lineitem")), "job", "page_number")
    pages = o.select(F.col("o_custkey").alias("job")).distinct().withColumn("page_number", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).withColumns({"width": F.lit(1000), "height": F.lit(880)})
    return boxes.crop_plan_faults(items, r, expected, pages, ["job"], 12, 60, 20_000, 150_000)


QUERIES = {f.__name__: f for f in (region_columns, region_page_faults, layout_page_faults, crop_plan_faults)}
_PAGES = "SELECT CAST(s_nationkey AS BIGINT) AS job, s_suppkey AS page, CAST(1000 AS BIGINT) AS width, CAST(900 AS BIGINT) AS height FROM supplier"
_COLUMNS = """
SELECT job, page, k AS column_index, CASE WHEN page % 3 = 0 THEN k * 330 - CASE WHEN page % 6 = 0 AND k = 2 THEN 200 ELSE 0 END ELSE k * 500 END AS l, 20 AS t,
  CASE WHEN page % 3 = 0 THEN k * 330 + 330 ELSE k * 500 + 500 END AS r, 880 AS b
FROM p, (SELECT unnest(range(3)) AS k) WHERE k < 2 OR page % 3 = 0"""
_REGIONS = """
SELECT CASE WHEN part % 50 = 0 THEN supp + 1000000 ELSE supp END AS page, l_orderkey AS question_no, CAST(l_linenumber AS BIGINT) AS region_no, part * 37 % 960 AS l, part * 53 % 860 AS t, part * 37 % 960 + q * 3 - 4 AS r, part * 53 % 860 + q AS b
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(l_suppkey) AS supp, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY ALL)"""
_WITH = f"WITH p AS ({_PAGES}), c AS ({_COLUMNS}), g AS ({_REGIONS}), inside AS (SELECT question_no, region_no, count(*) AS n, min(column_index) AS column_index FROM g JOIN c ON g.page = c.page AND g.l < g.r AND g.t < g.b AND c.l <= g.l AND g.r <= c.r AND c.t <= g.t AND g.b <= c.b GROUP BY ALL)"
_BOX = "CASE WHEN NOT (l < r AND t < b) THEN 'order' WHEN NOT (l >= 0 AND t >= 0 AND r <= width AND b <= height) THEN 'outside' END"
ORACLE_SQL = {
    "region_columns": f"{_WITH} SELECT question_no, region_no, n AS n_columns, column_index FROM inside",
    "region_page_faults": f"""{_WITH},
d AS (SELECT g.*, column_index, CASE WHEN width IS NULL THEN 'unknown_page' WHEN {_BOX} IS NOT NULL THEN {_BOX} WHEN n IS NULL THEN 'no_column' WHEN n > 1 THEN 'several_columns' END AS f
  FROM g LEFT JOIN (SELECT page, width, height FROM p) USING (page) LEFT JOIN inside USING (question_no, region_no)),
o AS (SELECT *, CASE WHEN f IS NULL THEN page * 10000000 + column_index * 100000 + t END AS place FROM d),
w AS (SELECT *, lag(place) OVER (PARTITION BY question_no ORDER BY region_no) AS before FROM o)
SELECT question_no, region_no, coalesce(f, CASE WHEN place < before THEN 'backwards' END) AS fault FROM w WHERE f IS NOT NULL OR place < before""",
    "layout_page_faults": f"""WITH p AS ({_PAGES}), c AS ({_COLUMNS}),
a AS (SELECT job, CASE WHEN page % 19 = 0 THEN page + 1000000 ELSE page END AS page, page AS s FROM p WHERE page % 17 <> 0),
n AS (SELECT job, page, count(*) AS n FROM c GROUP BY ALL),
d AS (SELECT coalesce(a.job, p.job) AS job, coalesce(a.page, p.page) AS page, a.s, p.page AS r, n FROM a FULL JOIN p ON a.job = p.job AND a.page = p.page LEFT JOIN n ON n.job = coalesce(a.job, p.job) AND n.page = coalesce(a.page, p.page)),
f AS (SELECT job, page, unnest([CASE WHEN r IS NULL THEN 'not_rendered' END, CASE WHEN s IS NULL THEN 'not_analysed' END] || CASE WHEN s IS NULL OR r IS NULL THEN [] ELSE [
  CASE WHEN s % 5 = 0 THEN 'size' END, CASE WHEN s % 7 = 0 THEN 'column_count' END, CASE WHEN s % 11 = 0 THEN 'text_layer' END, CASE WHEN s % 13 = 0 THEN 'confidence' END, CASE WHEN s % 9 = 0 THEN 'overlay_size' END, CASE WHEN s % 8 = 0 THEN 'overlay_bytes' END] END) AS fault FROM d)
SELECT * FROM f WHERE fault IS NOT NULL
UNION ALL SELECT job, page, 'column_overlap' FROM (SELECT *, lag(r) OVER (PARTITION BY page ORDER BY column_index) AS before FROM c) WHERE l < before""",
    "crop_plan_faults": f"""WITH g AS ({_REGIONS}),
i AS (SELECT o_custkey AS job, o_orderkey AS item, CASE WHEN o_orderkey % 31 = 0 THEN 0 ELSE o_orderkey % 40 + 1 END AS question_no FROM orders),
e AS (SELECT DISTINCT o_custkey AS job, o_orderkey % 39 + 1 AS question_no FROM orders),
r AS (SELECT i.job, i.item, page % 5 AS page_number, l, t, r, b, 1000 AS width, 880 AS height FROM g JOIN i ON g.question_no = i.item WHERE i.item % 23 <> 0),
x AS (SELECT *, CASE WHEN page_number > 3 THEN 'unknown_page' ELSE {_BOX} END AS bad FROM r),
z AS (SELECT job, item, count(*) AS n, max(r - l) FILTER (WHERE bad IS NULL) * (sum(b - t) FILTER (WHERE bad IS NULL) + 12 * (count(*) FILTER (WHERE bad IS NULL) - 1)) AS pixels FROM x GROUP BY ALL),
j AS (SELECT i.*, n, pixels, count(*) OVER (PARTITION BY i.job, i.question_no) > 1 AS again, e.job IS NOT NULL AS wanted FROM i LEFT JOIN z USING (job, item) LEFT JOIN e ON e.job = i.job AND e.question_no = i.question_no),
f AS (SELECT job, question_no, unnest([CASE WHEN question_no < 1 THEN 'number' END, CASE WHEN question_no >= 1 AND again THEN 'repeated' END, CASE WHEN n IS NULL THEN 'no_region' END, CASE WHEN pixels > 20000 THEN 'pixels' END, CASE WHEN question_no >= 1 AND NOT wanted THEN 'unexpected' END]) AS fault FROM j
  UNION ALL SELECT job, question_no, bad FROM x JOIN i USING (job, item))
SELECT DISTINCT job, question_no, fault FROM f WHERE fault IS NOT NULL
UNION ALL SELECT job, question_no, 'missing' FROM e WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.job = e.job AND i.question_no = e.question_no)
UNION ALL SELECT job, NULL, 'regions_budget' FROM z GROUP BY job HAVING sum(n) > 60
UNION ALL SELECT job, NULL, 'pixels_budget' FROM z GROUP BY job HAVING sum(pixels) > 150000""",
}
