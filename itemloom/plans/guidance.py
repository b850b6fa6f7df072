"""Review hints of whole documents as questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemloom.operators import guidance as g
from itemloom.sources import table

_HINTS = ("", "Check the crop", "subquestion 2 of 3", "Knowledge point in doubt", "OCR noise", "配图 unclear", "layout of the page")
_STRINGS = "array<string>"


def review_focus(spark, sf_dir):
    """Hints and focus of every document, whose text is a warning of its own (quoted, as no topic knows it)."""
    d = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL")
    k = F.col("doc_id")
    hint = lambda n: F.element_at(F.array(*map(F.lit, _HINTS)), ((F.floor(k / n) % len(_HINTS)) + 1).cast("int"))
    when = lambda n, c: F.when(k % n == 0, c).otherwise(F.array().cast(_STRINGS))
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.floor(k / n) % len(values) + 1).cast("int"))
    rows = d.select(
        "doc_id", pick(("single_choice", "fill_blank", "solution", "proof"), 1).alias("question_type"), (k % 3 == 0).alias("label_faults"),
        when(2, F.array("text")).alias("warnings"), when(5, F.array(hint(1), hint(3))).alias("notes"), when(7, F.array(hint(2))).alias("needs_texts"), (k % 11 == 0).alias("needs_review"),
        pick(("high", "high", "", "Low", "medium", "odd"), 4).alias("confidence"), (k % 4 == 1).alias("has_crop"), pick(("ai_review_passed", "pending"), 8).alias("crop_status"), when(9, F.array(hint(1))).alias("crop_warnings"),
        F.when(k % 6 == 0, F.array(F.lit("ai_review_passed"), pick(("ai_review_passed", "pending"), 6))).alias("figure_statuses"), (k % 10 == 3).alias("figure_required"),
        F.when(k % 13 == 0, F.array(F.lit(" 见原页选项图 "), pick(("见原页选项图", "A"), 13))).alias("options"), (k % 3 == 1).alias("has_audit"), pick(("auto_pass", "human_required"), 3).alias("audit_status"),
        pick(("high", "low"), 5).alias("audit_confidence"), when(8, F.array("source")).alias("issues"), when(8, F.array("text", hint(1))).alias("corrections"),
    )
    out = g.review_guidance(rows)
    return out.select("doc_id", "focus", F.size("priority_items").alias("n_items"), F.array_join("priority_items", "\n").alias("items"), F.array_join("basic_items", "\n").alias("basics"))


def _pick(values, n):
    return f"[{', '.join(repr(v) for v in values)}][(doc_id // {n}) % {len(values)} + 1]"


def _action(prefix):
    room = g.LENGTH - len(prefix) - 1
    topics = " ".join(f"WHEN regexp_matches(lower(c), '{w}') THEN '{said}'" for w, said in ((g.CROP_WORDS, g.CROP), *g.TOPICS))
    return f"CASE {topics} WHEN length(c) > {room} THEN '{prefix}' || substring(c, 1, {room}) || '…' WHEN c <> '' THEN '{prefix}' || c END"


def _actions(values, prefix=g.PREFIX):
    return f"list_transform(list_transform({values}, lambda x: trim(regexp_replace(x, '{g.SPACE}', ' ', 'g'), ' ')), lambda c: {_action(prefix)})"


def _when(n, values, prefix=g.PREFIX):
    return f"CASE WHEN doc_id % {n} = 0 THEN {_actions(values, prefix)} ELSE [] END"


def _kept(items):
    return f"list_filter(list_filter({items}, lambda v: v IS NOT NULL), lambda v, i: list_position(list_filter({items}, lambda u: u IS NOT NULL), v) = i)[1:{g.MOST}]"


_BEFORE, _AFTER = g.CONFIDENCE.split("{}")
_CONFIDENCE = _pick(("high", "high", "", "Low", "medium", "odd"), 4)
_NAME = f"CASE lower({_CONFIDENCE}) {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in g.CONFIDENCE_NAMES.items())} ELSE '{g.ODD}' END"
_TYPE = _pick(("single_choice", "fill_blank", "solution", "proof"), 1)
_PARTS = f"""[CASE WHEN {_TYPE} = 'solution' AND doc_id % 3 = 0 THEN '{g.LABELS}' END] || {_when(2, "[text]")} || {_when(5, f"[{_pick(_HINTS, 1)}, {_pick(_HINTS, 3)}]")} || {_when(7, f"[{_pick(_HINTS, 2)}]")}
  || [CASE WHEN doc_id % 11 = 0 AND doc_id % 7 <> 0 THEN '{g.MARKED}' END] || [CASE WHEN {_CONFIDENCE} NOT IN ('', 'high') THEN '{_BEFORE}' || {_NAME} || '{_AFTER}' END]
  || [CASE WHEN doc_id % 4 = 1 AND doc_id % 9 = 0 THEN '{g.CROP}' END]
  || CASE WHEN doc_id % 3 = 1 AND doc_id % 8 = 0 THEN {_actions("[source]")} || {_actions(f"[text, {_pick(_HINTS, 1)}]", g.CORRECTION_PREFIX)} ELSE [] END
  || [CASE WHEN doc_id % 3 = 1 AND {_pick(("high", "low"), 5)} NOT IN ('', 'high') THEN '{g.AUDIT_CONFIDENCE}' END]"""
_BASIC = " ".join(f"WHEN {_TYPE} IN ({', '.join(repr(t) for t in types)}) THEN '{said}'" for types, said in g.BASIC_BY_TYPE)

QUERIES = {"review_focus": review_focus}
ORACLE_SQL = {
    "review_focus": f"""WITH a AS (SELECT doc_id, {_PARTS} AS raw, doc_id % 13 = 0 AND {_pick(("x", "A"), 13)} = 'x' AS pictured, doc_id % 4 = 1 AS crop FROM documents WHERE doc_id IS NOT NULL),
  b AS (SELECT *, {_kept("raw")} AS first, pictured OR doc_id % 10 = 3 AS required, CASE WHEN pictured THEN crop ELSE doc_id % 6 = 0 END AS available,
    CASE WHEN pictured AND crop THEN {_pick(("p", "n"), 8)} = 'n' ELSE doc_id % 6 = 0 AND {_pick(("p", "n"), 6)} = 'n' END AS pending FROM a),
  c AS (SELECT *, first || [CASE WHEN doc_id % 3 = 1 AND {_pick(("p", "n"), 3)} = 'n' AND len(first) = 0 THEN '{g.AUDIT}' END,
    CASE WHEN required AND NOT available THEN '{g.NO_FIGURE}' WHEN required AND pending THEN '{g.FIGURE_PENDING}' END] AS both_parts FROM b),
  d AS (SELECT *, {_kept("both_parts")} AS items FROM c)
  SELECT doc_id, len(items) > 0 AS focus, len(items)::INTEGER AS n_items, array_to_string(items, chr(10)) AS items,
  array_to_string(list_filter(['{g.BASIC}', CASE {_BASIC} END, {', '.join(repr(x) for x in g.BASIC_ALWAYS)}, CASE WHEN required THEN '{g.BASIC_FIGURE}' END], lambda v: v IS NOT NULL), chr(10)) AS basics FROM d""",
}
