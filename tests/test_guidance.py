"""Review hints: literal cases with results worked out by hand."""

from itemloom.operators import guidance as g

SCHEMA = (
    "id int, question_type string, label_faults boolean, warnings array<string>, notes array<string>, needs_texts array<string>, needs_review boolean, confidence string, has_crop boolean, crop_status string, "
    "crop_warnings array<string>, figure_statuses array<string>, figure_required boolean, options array<string>, has_audit boolean, audit_status string, audit_confidence string, issues array<string>, corrections array<string>"
)
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def guided(spark, **given):
    row = spark.createDataFrame([tuple(given.get(n, 1 if n == "id" else None) for n in NAMES)], SCHEMA)
    return g.review_guidance(row).collect()[0]


def test_nothing_to_say_gives_no_focus(spark):
    r = guided(spark)
    assert not r["focus"] and r["priority_items"] == [] and len(r["basic_items"]) == 3
    assert g.review_guidance(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hints_come_in_order_and_once(spark):
    r = guided(spark, question_type="solution", label_faults=True, warnings=["LaTeX broken", "Crop  is　tight", "", None], notes=["公式 missing", " two \n words "], confidence="Medium")
    assert r["priority_items"] == [g.LABELS, g.TOPICS[3][1], g.CROP, "核对并处理：two words", "候选识别置信度为中，请重点对照原题核查"]
    assert r["basic_items"][1] == "检查小问数量、顺序、编号和公式"


def test_long_hints_are_cut_by_code_points_and_lists_end_at_eight(spark):
    r = guided(spark, warnings=["𝛼" * 500, *[f"x{k}" for k in range(20)]], figure_required=True)
    assert len(r["priority_items"][0]) == g.LENGTH and r["priority_items"][0].endswith("𝛼…")
    assert len(r["priority_items"]) == 8 and g.NO_FIGURE not in r["priority_items"]
    assert guided(spark, warnings=["y" * 173])["priority_items"] == ["核对并处理：" + "y" * 173]


def test_a_mark_without_text_and_odd_confidences(spark):
    assert guided(spark, needs_review=True)["priority_items"] == [g.MARKED]
    assert guided(spark, needs_review=True, needs_texts=["ocr"])["priority_items"] == [g.TOPICS[3][1]]
    assert guided(spark, confidence="??")["priority_items"] == ["候选识别置信度为异常，请重点对照原题核查"]
    assert guided(spark, confidence="")["priority_items"] == guided(spark, confidence="high")["priority_items"] == []


def test_an_audit_speaks_only_if_it_is_there_and_unnamed_doubts_only_alone(spark):
    assert guided(spark, audit_status="human_required", issues=["a"])["priority_items"] == []
    assert guided(spark, has_audit=True, audit_status="human_required")["priority_items"] == [g.AUDIT]
    assert guided(spark, has_audit=True, audit_status="auto_pass")["priority_items"] == []
    r = guided(spark, has_audit=True, audit_confidence="low", issues=["a"], corrections=["a"])
    assert r["priority_items"] == ["核对并处理：a", "按建议复核：a", g.AUDIT_CONFIDENCE]


def test_required_figures(spark):
    passed = g.PASSED
    assert guided(spark, figure_required=True)["priority_items"] == [g.NO_FIGURE]
    assert guided(spark, figure_required=True, figure_statuses=[passed, None])["priority_items"] == [g.FIGURE_PENDING]
    r = guided(spark, figure_required=True, figure_statuses=[passed])
    assert not r["focus"] and r["basic_items"][-1] == g.BASIC_FIGURE
    options = {"options": [f" {g.IMAGE_OPTION}\n", g.IMAGE_OPTION]}
    assert guided(spark, **options, figure_statuses=[passed])["priority_items"] == [g.NO_FIGURE]
    assert guided(spark, **options, has_crop=True, crop_status=passed)["priority_items"] == []
    assert guided(spark, **options, has_crop=True, crop_warnings=["", "b"])["priority_items"] == [g.CROP, g.FIGURE_PENDING]
    assert guided(spark, options=[g.IMAGE_OPTION, "A"])["basic_items"][-1] != g.BASIC_FIGURE
