"""Layout, labels and taxonomies on literal cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemloom.operators import labels, layout, taxonomy

PAGES = "page long, width long, height long, sample_width long, scale double, left long, top long, right long, bottom long"


#: Quiet stretches (from, to) of a content from 0 to 1000 and the right edges of the columns that follow, worked out by hand. The content
#: is 1000 high, so up to 10 dark pixels are quiet; a gutter is 25 wide at least, its centre between 150 and 850.
GUTTERS = [
    ([], [1000]),
    ([(480, 520)], [500, 1000]),
    ([(490, 514)], [1000]),  # 24 wide
    ([(490, 515)], [502, 1000]),  # 25 wide
    ([(100, 150)], [1000]),  # centre 125
    ([(125, 175)], [1000]),  # centre 150 is the edge
    ([(830, 880)], [1000]),
    ([(310, 350), (650, 690)], [330, 670, 1000]),  # thirds
    ([(180, 220), (530, 570)], [200, 550, 1000]),  # 0.20 and 0.55 still are
    ([(170, 210), (650, 690)], [190, 1000]),  # 0.19 is not: the left one alone counts
    ([(310, 350), (790, 830)], [330, 1000]),  # 0.81 is not
    ([(310, 360), (490, 520), (650, 700)], [335, 675, 1000]),  # the two longest of three
    ([(300, 340), (480, 520), (660, 700)], [500, 1000]),  # equal ones: the two later, which are no thirds
]


def test_columns(spark):
    pages, ink, want = [], [], []
    for page, (quiet, edges) in enumerate(GUTTERS):
        pages.append((page, 1000, 1000, 1000, 1.0, 0, 0, 1000, 1000))
        ink += [(page, x, 11) for x in range(1000) if not any(a <= x < b for a, b in quiet)]
        ink += [(page, x, 10) for a, b in quiet for x in range(a, b) if x % 2]
        want += [(page, k, a, 0, b, 1000) for k, (a, b) in enumerate(zip([0, *edges], edges, strict=False))]
    pages += [(90, 300, 400, 300, 1.0, None, None, None, None), (91, 2000, 3000, 1000, 0.5, 21, 41, 981, 1400)]  # blank; shrunk to half
    ink += [(91, x, 99) for x in range(21, 981) if not 480 <= x < 521]
    want += [(90, 0, 0, 0, 300, 400), (91, 0, 42, 82, 1000, 2800), (91, 1, 1000, 82, 1962, 2800)]
    got = layout.columns(spark.createDataFrame(ink, "page long, x long, ink long"), spark.createDataFrame(pages, PAGES), ["page"])
    assert sorted(tuple(r) for r in got.select("page", "column_index", "l", "t", "r", "b").collect()) == sorted(want)


def test_anchors_and_regions(spark):
    cols = spark.createDataFrame([(1, 1, 0, 0, 10, 500, 900), (1, 1, 1, 500, 10, 1000, 900), (1, 2, 0, 0, 10, 1000, 900)], "job long, page long, column_index long, l long, t long, r long, b long")
    words = [(1, 1, 4, 20, "1."), (1, 1, 90, 60, "2.5"), (1, 1, 300, 80, "7."), (1, 1, 510, 300, "2、"), (1, 2, 3, 5, "4题"), (1, 2, 3, 950, "5.")]
    words = spark.createDataFrame(words, "job long, page long, x long, y long, word string")
    found = layout.anchors(words, cols, ["job", "page"])
    assert sorted((r["page"], r["column_index"], r["y"], r["question_no"]) for r in found.collect()) == [(1, 0, 20, "1"), (1, 1, 300, "2"), (2, 0, 10, "4")]
    got = [tuple(r) for r in layout.regions(found, cols, ["job"], "page").orderBy("anchor_no", "region_no").drop("job").collect()]
    assert got == [
        (1, "1", 1, 1, 0, 20, 500, 900, "", "medium"), (1, "1", 2, 1, 500, 10, 1000, 300, "", "medium"),
        (2, "2", 1, 1, 500, 300, 1000, 900, "", "medium"),
        (3, "4", 1, 2, 0, 10, 1000, 900, "gap", "medium"),
    ]  # fmt: skip  # the piece of 2 on page 2 has no height
    size = layout.crop_sizes(layout.regions(found, cols, ["job"], "page"), ["anchor_no"], separator=12).orderBy("anchor_no").first()
    assert (size["width"], size["height"], size["n_regions"]) == (500, 880 + 290 + 12, 2)


def test_boxes_and_assets(spark):
    d = spark.createDataFrame([((5, 5, 95, 60), 100, 60), ((9, 5, 9, 6), 100, 60), ((-1, 5, 9, 6), 100, 60)], "b struct<l long, t long, r long, b long>, w long, h long")
    got = d.select(layout.box_fault(F.col("b"), F.col("w"), F.col("h")).alias("f"), layout.with_margin(F.col("b"), F.col("w"), F.col("h"), 8).alias("m")).collect()
    assert [r["f"] for r in got] == [None, "order", "outside"] and tuple(got[0]["m"]) == (0, 0, 100, 60)
    known = spark.createDataFrame([("1", "a.png", "s1"), ("2", "b.png", "s2")], "q string, path string, sha string")
    new = spark.createDataFrame([("1", "a.png", "s1"), ("2", "b.png", "s9"), ("3", "a.png", "s1"), ("4", "d.png", "s1")], "q string, path string, sha string")
    out = {r["q"]: r["outcome"] for r in layout.register_assets(known, new, ["q", "path"], "path", ["sha"]).collect()}
    assert out == {"1": "registered", "2": "changed", "3": "path_taken", "4": "new"}
    q = spark.createDataFrame([(1, True, True), (2, True, False), (3, False, False)], "q long, has_figure boolean, image_options boolean")
    a = [(1, "complete_question", "c1", 1, 1), (1, "complete_question", "c2", 2, 2), (2, "question_figure", "f", 2, 3), (2, "question_figure", "f", 1, 4), (2, "question_figure", "g", 3, 5), (3, "question_figure", "h", 1, 6)]
    a = spark.createDataFrame(a, "q long, kind string, path string, display_order long, asset_id long")
    assert sorted((r["q"], r["position"], r["path"], r["asset_id"]) for r in layout.display_assets(q, a, "q").collect()) == [(1, 1, "c1", 1), (2, 1, "f", 4), (2, 2, "g", 5)]


def test_label_groups(spark):
    cases = [
        (["（1）", "（2）"], [(1, None), (2, None)]),
        (["(1)(i)", "(1)(II)", "（2）①", "（2）②"], [(1, 1), (1, 2), (2, 1), (2, 2)]),
        (["（1）", "（1）①", "（2）"], [(1, None), (1, 1), (2, None)]),
        (["（2）"], None), (["（1）", "（3）"], None), (["（1）①", "（1）"], None), (["（1）①", "（1）③"], None), (["（1）", "（2）", "（1）"], None),
        (["（1）", "（1）"], None), (["A"], None), ([" (1) ", None], None), (["（1）②"], None), (["（1）", "（2）⑪"], None),
    ]
    rows = [(k, p, x) for k, (names, _) in enumerate(cases) for p, x in enumerate(names)]
    got = labels.group_labels(spark.createDataFrame(rows, "q long, p long, label string"), ["q"], "p").orderBy("q", "p").collect()
    for k, (names, want) in enumerate(cases):
        mine = [r for r in got if r["q"] == k]
        assert {r["needs_review"] for r in mine} == {want is None}
        assert [(r["main_no"], r["child_no"]) for r in mine] == (want or [(None, None)] * len(names))
    stems = spark.createDataFrame([(" （1）(iv) find x",), ("plain",)], "s string").select(labels.stored_label(F.col("s")).alias("l"), labels.without_label(F.col("s")).alias("t")).collect()
    assert [tuple(r) for r in stems] == [("（1）(iv)", "find x"), ("", "plain")]


GOOD = "# Title\n- stray\n## 01 Sets\n### 01.01 Basics\n- member\n- subset \n### 01.02 Ops\n- union\n## 02 Logic\n### 02.01 Terms\n- and\n## Notes\n- not parsed"


def test_taxonomy(spark):
    lines = taxonomy.lines_of(spark.createDataFrame([("a.md", GOOD)], "path string, value string"))
    got = [tuple(r) for r in taxonomy.parse(lines, 2).orderBy("line_no").select("code", "name", "level", "parent_code", "sort_order").collect()]
    assert got == [
        ("01", "Sets", 1, None, 1), ("01.01", "Basics", 2, "01", 1), ("01.01.01", "member", 3, "01.01", 1), ("01.01.02", "subset", 3, "01.01", 2),
        ("01.02", "Ops", 2, "01", 2), ("01.02.01", "union", 3, "01.02", 1), ("02", "Logic", 1, None, 2), ("02.01", "Terms", 2, "02", 1), ("02.01.01", "and", 3, "02.01", 1),
    ]
    assert taxonomy.faults(lines, 2).count() == 0
    assert taxonomy.hierarchy_faults(taxonomy.parse(lines, 2)).count() == 0
    assert [r["fault"] for r in taxonomy.faults(lines, 3).collect()] == ["modules_missing"]
    bad = "## 01 A\n- early\n### 01.01 T\n- x\n- x\n### 02.01 U\n- y\n### 1.2 V\n### 01.03 W\n## 02 B\n## 02 B"
    lines = taxonomy.lines_of(spark.createDataFrame([("b.md", bad)], "path string, value string"))
    assert sorted(((r["line_no"], r["fault"]) for r in taxonomy.faults(lines, 2).collect()), key=str) == sorted(
        [(2, "bullet_outside_topic"), (5, "repeated_name"), (6, "topic_outside_module"), (8, "bad_topic_heading"), (9, "topic_without_points"), (11, "repeated_code")], key=str
    )
    a = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", None)], "code string, name string")
    b = spark.createDataFrame([("1", "x"), ("2", "z"), ("4", "w")], "code string, name string")
    assert {r["code"]: r["action"] for r in taxonomy.changes(a, b, ["name"]).collect()} == {"1": "keep", "2": "update", "3": "absent", "4": "insert"}
