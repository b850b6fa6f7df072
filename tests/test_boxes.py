"""Containment by cells, layout and crop-plan faults on literal cases."""

from __future__ import annotations

import numpy as np

from itemloom.operators import boxes
from itemloom.plans import geometry
from itemloom.sources import tasks_for

BOX = "page int, id int, l long, t long, r long, b long"


def test_containment_equals_every_pair(spark):
    rng = np.random.default_rng(4)
    corner = rng.integers(0, 900, (160, 2))
    inner = [(int(k % 3), k, int(x), int(y), int(x + w), int(y + h)) for k, ((x, y), (w, h)) in enumerate(zip(corner[:120], rng.integers(-3, 60, (120, 2)), strict=True))]
    outer = [(int(k % 3), k, int(x), int(y), int(x + w), int(y + h)) for k, ((x, y), (w, h)) in enumerate(zip(corner[120:], rng.integers(0, 700, (40, 2)), strict=True))]
    want = {(i[1], o[1]) for i in inner for o in outer if i[0] == o[0] and o[2] <= i[2] < i[4] <= o[4] and o[3] <= i[3] < i[5] <= o[5]}
    c = spark.createDataFrame(outer, BOX).withColumnRenamed("id", "box")
    for cell in (16, 256, 5000):
        d = boxes.containing(spark.createDataFrame(inner, BOX), c, ["page"], "box", cell)
        got = [(r["id"], r["box"]) for r in d.collect()]
        assert set(got) == want and len(got) == len(want)
    assert "Cartesian" not in d._jdf.queryExecution().toString() and "NestedLoop" not in d._jdf.queryExecution().toString()
    assert boxes.containing(spark.createDataFrame([(0, 1, None, 0, 5, 5)], BOX), c, ["page"], "box").count() == 0


def regions_of(spark, rows):
    cols = spark.createDataFrame([(1, 1, 0, 0, 0, 50, 100), (1, 1, 1, 50, 0, 100, 100), (1, 2, 0, 0, 0, 60, 100), (1, 2, 1, 40, 0, 100, 100)], "job int, page int, column_index int, l long, t long, r long, b long")
    pages = spark.createDataFrame([(1, 1, 100, 100), (1, 2, 100, 100)], "job int, page int, width int, height int")
    d = spark.createDataFrame([(1, *r) for r in rows], "job int, question_no int, region_no int, page int, l long, t long, r long, b long")
    return {(r["question_no"], r["region_no"]): r["fault"] for r in boxes.region_faults(d, cols, pages, ["job"], "page").collect()}


def test_regions_lie_in_one_column_and_in_order(spark):
    assert regions_of(spark, [(1, 1, 1, 0, 0, 50, 40), (1, 2, 1, 50, 0, 100, 30), (1, 3, 2, 0, 0, 30, 30)]) == {}
    assert regions_of(spark, [(1, 1, 1, 50, 0, 100, 40), (1, 2, 1, 0, 0, 50, 30)]) == {(1, 2): "backwards"}
    assert regions_of(spark, [(1, 1, 2, 0, 0, 30, 30), (1, 2, 1, 0, 0, 50, 30)]) == {(1, 2): "backwards"}
    assert regions_of(spark, [(1, 1, 1, 0, 40, 50, 60), (1, 2, 1, 0, 30, 50, 40)]) == {(1, 2): "backwards"}
    assert regions_of(spark, [(1, 1, 1, 40, 0, 60, 40)]) == {(1, 1): "no_column"}  # across the border of two columns
    assert regions_of(spark, [(1, 1, 2, 45, 0, 55, 40)]) == {(1, 1): "several_columns"}
    assert regions_of(spark, [(1, 1, 9, 0, 0, 5, 5), (2, 1, 1, 5, 5, 5, 9), (3, 1, 1, 0, 0, 101, 5)]) == {(1, 1): "unknown_page", (2, 1): "order", (3, 1): "outside"}


def test_crop_plans(spark):
    items = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, None), (1, 4, 2), (1, 5, 9)], "job int, item int, question_no long")
    regions = spark.createDataFrame([(1, 1, 1, 0, 0, 10, 10), (1, 1, 1, 0, 20, 10, 30), (1, 2, 7, 0, 0, 10, 10), (1, 3, 1, 0, 0, 10, 10), (1, 5, 1, 0, 0, 90, 90), (1, 5, 1, 5, 5, 5, 5)], "job int, item int, page_number int, l long, t long, r long, b long")
    expected = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "job int, question_no long")
    pages = spark.createDataFrame([(1, 1, 100, 100)], "job int, page_number int, width int, height int")
    got = {(r["question_no"], r["fault"]) for r in boxes.crop_plan_faults(items, regions, expected, pages, ["job"], 5, 5, 1000, 8000).collect()}
    assert got == {(1, "repeated"), (1, "unknown_page"), (None, "number"), (2, "no_region"), (9, "unexpected"), (9, "pixels"), (9, "order"), (3, "missing"), (None, "regions_budget"), (None, "pixels_budget")}
    assert boxes.crop_plan_faults(items.limit(0), regions.limit(0), expected.limit(0), pages, ["job"], 5, 5, 1000, 8000).count() == 0


def exchanges(d):
    return d._jdf.queryExecution().optimizedPlan().toString().count("Join "), d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_a_crop_plan_is_read_once(spark):
    items = spark.range(10).selectExpr("id % 2 AS job", "id AS item", "id % 3 AS question_no")
    regions = spark.range(40).selectExpr("id % 2 AS job", "id % 10 AS item", "id % 3 AS page_number", "id % 50 AS l", "0L AS t", "id + 1 AS r", "9L AS b")
    pages = spark.range(2).selectExpr("id AS job", "0L AS page_number", "100L AS width", "100L AS height")
    d = boxes.crop_plan_faults(items, regions, items.select("job", "question_no"), pages, ["job"], 5, 5, 1000, 8000)
    assert exchanges(d)[0] <= 2  # with the pages and with the items; all else is one grouping
    assert "collect_set" not in d._jdf.queryExecution().optimizedPlan().toString()
    null = spark.createDataFrame([(1, None)], "job long, question_no long")
    got = boxes.crop_plan_faults(items.limit(0), regions.limit(0), null, pages, ["job"], 5, 5, 1000, 8000).collect()
    assert [tuple(r) for r in got] == [(1, None, "missing")]


def test_the_rows_of_a_task_do_not_grow_with_the_table(spark, tmp_path):
    d = spark.range(40_000).selectExpr("id % 9000 AS l_orderkey", "CAST(id % 7 AS INT) AS l_linenumber", "id % 200 AS l_partkey", "id % 10 AS l_suppkey", "CAST(id % 50 AS DOUBLE) AS l_quantity")
    d.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tasks_for(spark.read.parquet(f"{tmp_path}/lineitem.parquet"), n) for n in (1000, 5000, 10**6)] == [40, 8, 4]
    plan = geometry._regions(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(l_orderkey" in plan  # dealt by order, before the grouping
