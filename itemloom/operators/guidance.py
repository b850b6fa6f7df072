"""Review hints of a question: technical notes become short actions, in order and each once; a question that has any is marked for focus.

Everything is an expression over the row, so a plan of it is one projection. Columns read by `review_guidance`: question_type, label_faults
(boolean), warnings, notes, needs_texts (arrays of strings), needs_review (boolean), confidence, has_crop (boolean), crop_status, crop_warnings,
figure_statuses (array), figure_required (boolean), options (array of their contents), has_audit (boolean), audit_status, audit_confidence,
issues, corrections. Null arrays count as empty, null booleans as false; other columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What results must hold.
MOST, LENGTH = 8, 180
CROP = "检查裁图是否缺边、混入相邻题或遗漏题图"
TOPICS = (
    ("小问|子问|subquestion", "检查小问数量、顺序和编号是否完整"),
    ("图像选项|配图|题图|图片|图形|image option", "检查题干与配图是否完整、方向和选项对应是否正确"),
    ("知识点|题型|knowledge|question type", "确认题型和主、关联知识点是否准确"),
    ("ocr|latex|公式|符号|识别", "对照原题检查文字、符号和 LaTeX 公式"),
)
CROP_WORDS = "裁图|裁切|crop"
PREFIX, CORRECTION_PREFIX = "核对并处理：", "按建议复核："
LABELS = "请核对小问层级标签"
MARKED = "按候选题的人工复核标记，对照原题逐项确认"
CONFIDENCE, CONFIDENCE_NAMES, ODD = "候选识别置信度为{}，请重点对照原题核查", {"medium": "中", "low": "低"}, "异常"
AUDIT_CONFIDENCE = "AI 复核置信度不足，请结合原题证据人工确认"
AUDIT = "AI 复核要求人工确认，请对照原题逐项核查"
NO_FIGURE = "必要配图缺失，请检查题干与配图是否完整、方向和选项对应是否正确"
FIGURE_PENDING = "必要配图审核尚未通过，请检查题干与配图是否完整、方向和选项对应是否正确"
IMAGE_OPTION, PASSED = "见原页选项图", "ai_review_passed"
BASIC = "对照原题检查题干文字、数字、符号和 LaTeX 公式"
BASIC_BY_TYPE = (
    (("single_choice", "multiple_choice"), "核对选项数量、顺序和内容"),
    (("fill_blank",), "检查填空位置和题干完整性"),
    (("solution",), "检查小问数量、顺序、编号和公式"),
)
BASIC_ALWAYS = ("确认题型和主、关联知识点是否准确", "核对来源页码是否准确")
BASIC_FIGURE = "检查配图完整性及其与题图对应关系"

#: White space as Unicode has it, spelled so that Java and RE2 agree.
SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def compact(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def action(text: Column, source: str = "general") -> Column:
    """The action that a hint asks for (null: none); what no topic knows is quoted, cut to LENGTH code points."""
    short = compact(text)
    if source == "crop":
        return F.when(text.isNotNull(), CROP)
    prefix = CORRECTION_PREFIX if source == "correction" else PREFIX
    room = LENGTH - len(prefix) - 1
    out = F.when(F.lower(short).rlike(CROP_WORDS), CROP)
    for words, said in TOPICS:
        out = out.when(F.lower(short).rlike(words), said)
    return out.when(F.length(short) > room, F.concat(F.lit(prefix), F.substring(short, 1, room), F.lit("…"))).when(short != "", F.concat(F.lit(prefix), short))


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def _actions(name: str, source: str = "general") -> Column:
    return F.transform(_list(name), lambda x: action(x, source))


def _if(condition: Column, said: Column | str) -> Column:
    return F.array(F.when(_true(condition), said))


def _doubtful(confidence: Column) -> Column:
    return ~confidence.isin("", "high")


def _kept(items: Column) -> Column:
    return F.slice(F.array_distinct(F.array_compact(items)), 1, MOST)


def review_guidance(rows: DataFrame) -> DataFrame:
    """*rows* with priority_items (at most MOST), focus (whether there are any) and basic_items."""
    confidence = F.lower(F.col("confidence"))
    name = F.lit(ODD)
    for k, v in CONFIDENCE_NAMES.items():
        name = F.when(confidence == k, v).otherwise(name)
    audited, crop = _true(F.col("has_audit")), _true(F.col("has_crop"))
    none = F.array().cast("array<string>")
    before, after = CONFIDENCE.split("{}")
    first = F.concat(
        _if((F.col("question_type") == "solution") & F.col("label_faults"), LABELS),
        _actions("warnings"), _actions("notes"), _actions("needs_texts"),
        _if(F.col("needs_review") & (F.size(_list("needs_texts")) == 0), MARKED),
        _if(_doubtful(F.col("confidence")), F.concat(F.lit(before), name, F.lit(after))),
        F.when(crop, _actions("crop_warnings", "crop")).otherwise(none),
        F.when(audited, F.concat(_actions("issues", "issue"), _actions("corrections", "correction"))).otherwise(none),
        _if(audited & _doubtful(F.col("audit_confidence")), AUDIT_CONFIDENCE),
    )
    pictured = (F.size(_list("options")) > 0) & F.forall(_list("options"), lambda x: _true(compact(x) == IMAGE_OPTION))
    figures = _list("figure_statuses")
    unpassed = lambda c: ~_true(c == PASSED)
    available = F.when(pictured, crop).otherwise(F.size(figures) > 0)
    pending = F.when(pictured & crop, unpassed(F.col("crop_status"))).otherwise(F.exists(figures, unpassed))
    required = _true(F.col("figure_required")) | pictured
    d = rows.withColumn("_first", _kept(first))
    unnamed = _if(audited & _unpassed_audit(F.col("audit_status")) & (F.size("_first") == 0), AUDIT)
    d = d.withColumn("priority_items", _kept(F.concat("_first", unnamed, F.array(F.when(required & ~available, NO_FIGURE).when(required & pending, FIGURE_PENDING)))))
    by_type = F.lit(None).cast("string")
    for types, said in BASIC_BY_TYPE:
        by_type = F.when(F.col("question_type").isin(*types), said).otherwise(by_type)
    basic = F.array_compact(F.array(F.lit(BASIC), by_type, *map(F.lit, BASIC_ALWAYS), F.when(required, BASIC_FIGURE)))
    return d.withColumn("focus", F.size("priority_items") > 0).withColumn("basic_items", basic).drop("_first")


def _unpassed_audit(status: Column) -> Column:
    return ~_true(status == "auto_pass")
