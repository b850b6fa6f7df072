"""The item bank on a batch of 23 questions: listing, facets, baskets, deletion, export."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from itemloom.operators import basket, search

Q = "question_id long, import_job_id long, question_no string, paper_id long, type_code string, primary_code string, figure_review_status string, deleted_at string, deletion_reason string, deletion_note string, stem_markdown string"


@pytest.fixture(scope="module")
def bank(spark):
    kind = lambda n: "single_choice" if n <= 12 else "fill_blank" if n <= 20 else "solution"
    q = [(n, 1, str(n), 1, kind(n), f"0{n % 3 + 1}", "passed" if n in (3, 16) else "not_required", "2025" if n == 12 else None, None, None, f"stem {n}") for n in range(1, 24)]
    dic = "code string, name string, is_active boolean"
    return {
        "questions": spark.createDataFrame(q, Q), "related": spark.createDataFrame([(5, "01"), (6, "04"), (12, "05")], "question_id long, code string"),
        "papers": spark.createDataFrame([(1, "Mock 100%_A", 2025)], "paper_id long, paper_name string, exam_year int"),
        "types": spark.createDataFrame([(c, c.upper(), True) for c in ("single_choice", "fill_blank", "solution", "multiple_choice")], dic),
        "points": spark.createDataFrame([(f"0{k}", f"point {k}", k != 6) for k in range(1, 7)], dic),
    }


def numbers(df):
    return [int(r["question_no"]) for r in search.in_order(df).collect()]


def test_listing(spark, bank):
    assert numbers(search.listing(**bank)) == [n for n in range(1, 24) if n != 12]
    assert numbers(search.listing(**bank, has_figure="true")) == [3, 16]
    assert len(numbers(search.listing(**bank, has_figure="false"))) == 20
    assert numbers(search.listing(**bank, question_type="solution", source="0%_a")) == [21, 22, 23]
    assert numbers(search.listing(**bank, source="100_")) == [] and len(numbers(search.listing(**bank, source=""))) == 22
    assert numbers(search.listing(**bank, knowledge="01")) == [3, 5, 6, 9, 15, 18, 21]
    assert numbers(search.listing(**bank, knowledge="04")) == [6]
    mine = search.listing(**bank, basket=spark.createDataFrame([(7,), (7,)], "question_id long"))
    assert numbers(mine.filter("in_basket")) == [7] and mine.count() == 22
    assert sorted(r["code"] for r in search.used_points(bank["questions"], bank["related"], bank["points"]).collect()) == ["01", "02", "03", "04"]


def test_bad_filters(bank):
    known = bank["types"], bank["points"]
    search.check_filters(*known, knowledge="01", question_type="solution", source="", has_figure="true")
    for bad in ({"knowledge": ""}, {"knowledge": "06"}, {"question_type": "essay"}, {"has_figure": ""}, {"source": "x" * 101}, {"source": "a\n"}):
        with pytest.raises(search.BadFilter):
            search.check_filters(*known, **bad)


def test_basket(spark, bank):
    rows = lambda df: sorted(tuple(r) for r in df.select(*basket.ITEM).collect())
    items = spark.createDataFrame([(1, 5, 1), (1, 12, 2), (1, 7, 3), (2, 5, 1)], "basket_id long, question_id long, position long")
    live = search.live(bank["questions"])
    more = basket.add(items, spark.createDataFrame([(1, 5), (1, 2), (3, 9)], "basket_id long, question_id long"))
    assert rows(more) == [(1, 2, 4), (1, 5, 1), (1, 7, 3), (1, 12, 2), (2, 5, 1), (3, 9, 1)]
    assert rows(basket.move(items, live, 1, 7, up=True)) == [(1, 5, 2), (1, 7, 1), (1, 12, 2), (2, 5, 1)]
    assert rows(basket.move(items, live, 1, 5, up=False)) == [(1, 5, 2), (1, 7, 1), (1, 12, 2), (2, 5, 1)]
    assert rows(basket.move(items, live, 1, 5, up=True)) == rows(items) == rows(basket.move(items, live, 1, 7, up=False))
    questions, left = basket.delete_questions(bank["questions"], items, spark.createDataFrame([(5,), (12,)], "question_id long"), "2026", "duplicate")
    assert rows(left) == [(1, 7, 1)]
    assert {(r["question_id"], r["deleted_at"], r["deletion_reason"]) for r in questions.filter("deleted_at IS NOT NULL").collect()} == {(5, "2026", "duplicate"), (12, "2025", None)}
    back = basket.restore_questions(questions, spark.createDataFrame([(5,)], "question_id long")).filter("question_id = 5").first()
    assert (back["deleted_at"], back["deletion_reason"]) == (None, "duplicate")


def test_export(spark, bank):
    items = spark.createDataFrame([(1, 7, 1), (1, 12, 2), (1, 5, 9)], "basket_id long, question_id long, position long")
    options = spark.createDataFrame([(7, 2, "B", "no"), (7, 1, "A", "yes")], "question_id long, display_order long, code string, content string")
    got = basket.export_markdown(items, bank["questions"].join(bank["papers"], "paper_id"), options)
    r = got.first()
    assert r["markdown"] == "# Questions\n\n## 1\nstem 7\n- A. yes\n- B. no\n> Mock 100%_A, 2025\n\n## 2\nstem 5\n> Mock 100%_A, 2025\n"
    assert basket.ledger(got, "now").first()["n_questions"] == 2
    kids = search.with_children(bank["questions"].filter("question_id IN (5, 7)"), options, "question_id", "display_order", ["code"], "options").orderBy("question_id").collect()
    assert [[o["code"] for o in r["options"]] for r in kids] == [[], ["A", "B"]]


def test_whole_jobs_and_assets(spark):
    d = spark.createDataFrame([(1, True), (1, False), (2, True), (3, None)], "job long, ok boolean")
    assert {r["job"] for r in search.keep_whole(d, "job", ~F.col("ok")).collect()} == {2}
    a = spark.createDataFrame([("p", "s", 10), ("q", "s", 10), ("r", "s", 10), ("t", "s", 10)], "path string, sha256 string, width long")
    m = spark.createDataFrame([("p", "s", 10), ("q", "s", 11), ("r", "s", 10)], "path string, sha256 string, width long")
    f = spark.createDataFrame([("p", "s"), ("q", "s"), ("r", "z"), ("t", "s")], "path string, sha256 string")
    assert {r["path"]: r["verified"] for r in search.verified_assets(a, m, f, ["sha256", "width"]).collect()} == {"p": True, "q": False, "r": False, "t": False}
