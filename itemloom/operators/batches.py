"""Validators of model output, on typed rows: each gives reasons, and a batch is valid if none of its rows has one.

JSON texts become rows by ``documents.strict_object`` first (exact keys, nothing behind the value), then ``from_json`` and ``explode``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itemloom.functions import is_question_number, reason_list, strip
from itemloom.operators.review import strict_pass

#: Domains of the documents' fields, and the text that stands for an option shown as a picture.
LEVELS = ["low", "medium", "high"]
STATUSES = ["auto_pass", "disputed", "human_required"]
CHOICE = ["single_choice", "multiple_choice"]
TYPES = [*CHOICE, "fill_blank", "solution"]
IMAGE_OPTION = "见原页选项图"
EMPTY = ["answer_markdown", "analysis_markdown", "primary_knowledge_point_code", "related_knowledge_point_codes"]
MAX_STEM, MAX_ITEM, MAX_OPTIONS, MAX_SUBQUESTIONS, MAX_PAGES, MAX_FINDINGS, MAX_TEXT = 30_000, 10_000, 20, 30, 20, 50, 500
AUDITOR, AUDIT_KIND = "independent_codex_visual_second_pass", "candidate_text_vs_verified_single_question_crops"


def no(c: Column) -> Column:
    """Not *c*, with null as false."""
    return ~F.coalesce(c, F.lit(False))


def unique(a: Column) -> Column:
    return F.size(a) == F.size(F.array_distinct(a))


def texts_within(a: Column, most: int, length: int) -> Column:
    return (F.size(a) <= most) & F.forall(a, lambda x: x.isNotNull() & (F.length(x) <= length))


def findings(a: Column) -> Column:
    """A list of findings: none empty, none too long, not too many."""
    return texts_within(a, MAX_FINDINGS, MAX_TEXT) & F.forall(a, lambda x: ~blank(x))


def blank(c: Column) -> Column:
    return F.length(strip(F.coalesce(c, F.lit("")))) == 0


def split_plan(questions: DataFrame, pages: DataFrame, job: str = "job_id", max_questions: int = 200, max_regions: int = 1000) -> DataFrame:
    """job, position, question_no, reasons of a split plan.

    *questions*: job, position (its place in the plan, from 1), question_no, declared (the plan's count), confidence, warnings
    array<string>, regions array<struct<page_number, bbox array<double>>>; *pages*: job, page_number. A job's pages and questions are
    bounded, so its page numbers travel as one array."""
    known = pages.groupBy(job).agg(F.collect_set(F.col("page_number").cast("long")).alias("_pages"))
    whole = W.partitionBy(job)
    d = questions.join(known, job, "left").withColumn("_pages", F.coalesce("_pages", F.array().cast("array<bigint>")))
    d = d.withColumns({"_n": F.count(F.lit(1)).over(whole), "_total": F.sum(F.coalesce(F.size("regions"), F.lit(0))).over(whole)})

    def box(r):
        a, at = r["bbox"], lambda i: F.get(r["bbox"], i)
        inside = (at(0) >= 0) & (at(0) < at(2)) & (at(2) <= 1) & (at(1) >= 0) & (at(1) < at(3)) & (at(3) <= 1)
        return F.coalesce((F.size(a) == 4) & inside, F.lit(False))

    score = F.col("confidence").try_cast("double")
    rules = {
        "number": no(F.col("question_no") == F.col("position")),
        "count": no((F.col("_n") == F.col("declared")) & F.col("_n").between(1, max_questions)),
        "no_region": no(F.size("regions") > 0),
        "page": no(F.forall("regions", lambda r: F.coalesce(F.array_contains(F.col("_pages"), r["page_number"].cast("long")), F.lit(False)))),
        "box": no(F.forall("regions", box)),
        "too_many_regions": no(F.col("_total") <= max_regions),
        "warnings": no(texts_within(F.col("warnings"), 20, 500)),
        "confidence": no(F.col("confidence").isin(LEVELS) | (score.between(0, 1) & ~F.isnan(score))),
    }
    return d.select(job, "position", "question_no", reason_list(rules).alias("reasons"))


def candidates(questions: DataFrame, expected: DataFrame, job: str = "job_id") -> DataFrame:
    """job, position, source_question_no, reasons of transcribed questions.

    *questions*: job, position, source_question_no, stem_markdown, question_type_code, options array<struct<code, content>>, subquestions
    array<struct<label, stem_markdown>>, source_pages array<int>, figure_required, extraction_confidence, warnings. *expected*: job, position,
    question_no, pages (sorted). A position on one side only is a row with its reason."""
    e = expected.select(job, "position", F.col("question_no").alias("_no"), F.col("pages").alias("_pages"))
    d = questions.withColumn("_got", F.lit(True)).join(e, [job, "position"], "full")
    d = d.withColumn("_copies", F.count(F.when(F.col("_got"), F.col("source_question_no"))).over(W.partitionBy(job, "source_question_no")))
    codes = F.transform("options", lambda o: F.lower(strip(o["code"])))
    labels = F.transform("subquestions", lambda s: strip(s["label"]))
    choice = F.col("question_type_code").isin(CHOICE)
    pages = F.col("source_pages")
    rules = {
        "missing": F.col("_got").isNull(),
        "unexpected": F.col("_no").isNull(),
        "number": no(is_question_number(F.col("source_question_no")) & (F.col("source_question_no") == F.col("_no").cast("string"))),
        "repeated": F.col("_copies") > 1,
        "stem": blank(F.col("stem_markdown")) | (F.length("stem_markdown") > MAX_STEM),
        "type": no(F.col("question_type_code").isin(TYPES)),
        "options": no(F.when(choice, F.size("options") >= 2).otherwise(F.size("options") == 0)),
        "option_text": no(F.forall("options", lambda o: ~blank(o["code"]) & ~blank(o["content"]) & (F.length(o["code"]) <= 16) & (F.length(o["content"]) <= MAX_ITEM)) & (F.size("options") <= MAX_OPTIONS)),
        "option_codes": no(unique(codes)),
        "labels": no(unique(labels) & F.forall("subquestions", lambda s: ~blank(s["label"]) & ~blank(s["stem_markdown"]) & (F.length(s["label"]) <= 50) & (F.length(s["stem_markdown"]) <= MAX_ITEM)) & (F.size("subquestions") <= MAX_SUBQUESTIONS)),
        "pages": no(F.size(pages).between(1, MAX_PAGES) & (F.sort_array(F.array_distinct(pages)) == pages) & (pages.cast("array<bigint>") == F.col("_pages").cast("array<bigint>"))),
        "confidence": no(F.col("extraction_confidence").isin(LEVELS)),
        "figure": F.col("figure_required").isNull(),
    }
    if "warnings" in questions.columns:
        rules["warnings"] = no(texts_within(F.col("warnings"), 20, 500))
    for c in EMPTY:
        if c in questions.columns:  # fields that a transcription must leave empty
            rules[f"filled:{c}"] = no(F.length(F.concat_ws("", F.col(c))) == 0) | F.col(c).isNull()
    reasons = F.when(F.col("_got").isNull(), F.array(F.lit("missing"))).otherwise(reason_list(rules))
    return d.select(job, "position", "source_question_no", reasons.alias("reasons"))


def audit_heads(heads: DataFrame, questions: DataFrame, job: str = "job_id") -> DataFrame:
    """job, reasons of what an audit says of itself: auditor, scope_kind, scope_pages, question_count, sample_nos, sample_reason, global_findings,
    knowledge_checks (of its entries). *questions*: job, source_question_no, source_pages."""
    own = questions.groupBy(job).agg(F.sort_array(F.collect_set("source_question_no")).alias("_nos"), F.count(F.lit(1)).alias("_n"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("source_pages")))).alias("_pages"))
    d = heads.join(own, job, "left")
    rules = {
        "auditor": no(F.col("auditor") == AUDITOR),
        "scope": no((F.col("scope_kind") == AUDIT_KIND) & (F.col("scope_pages") == F.col("_pages"))),
        "question_count": no((F.col("question_count") == F.col("_n")) & F.col("question_count").between(1, 200) & (F.size("_nos") == F.col("_n"))),
        "sample": no((F.size("sample_nos") <= MAX_FINDINGS) & unique(F.col("sample_nos")) & (F.size(F.array_except("sample_nos", "_nos")) == 0) & ~blank(F.col("sample_reason")) & (F.length("sample_reason") <= 1000)),
        "findings": no(findings(F.col("global_findings"))),
        "knowledge": no(F.forall("knowledge_checks", lambda x: F.coalesce(x == "not_reviewed", F.lit(False)))),
    }
    return d.select(job, reason_list(rules).alias("reasons"))


def audits(entries: DataFrame, questions: DataFrame, job: str = "job_id") -> DataFrame:
    """job, position, source_question_no, reasons of an audit's entries against the questions it is about.

    *entries*: job, position, source_question_no, audit_status, text_match, structure_match, formula_match, figure_check, issues,
    suggested_corrections, evidence_page, audit_confidence. *questions*: job, position, source_question_no, figure_required, source_pages.
    auto_pass holds exactly if every check passed; any other status must name its issues."""
    q = questions.select(job, "position", F.col("source_question_no").alias("_no"), F.col("figure_required").alias("_figure"), F.get("source_pages", 0).alias("_page"))
    d = entries.withColumn("_got", F.lit(True)).join(q, [job, "position"], "full")
    wanted = F.when(F.col("_figure"), "passed").otherwise("not_applicable")
    passed = F.col("text_match") & F.col("structure_match") & F.col("formula_match") & (F.col("figure_check") == wanted)
    passed = F.coalesce(passed, F.lit(False)) & strict_pass(F.lit("auto_pass"), F.col("audit_confidence"), F.col("issues"), F.col("suggested_corrections"))
    rules = {
        "number": no(F.col("source_question_no") == F.col("_no")),
        "status": no(F.col("audit_status").isin(STATUSES)),
        "matches": F.col("text_match").isNull() | F.col("structure_match").isNull() | F.col("formula_match").isNull(),
        "figure_check": no(F.when(F.col("_figure"), F.col("figure_check").isin("passed", "failed")).otherwise(F.col("figure_check") == "not_applicable")),
        "lists": no(findings(F.col("issues")) & findings(F.col("suggested_corrections"))),
        "evidence_page": no(F.col("evidence_page") == F.col("_page")),
        "confidence": no(F.col("audit_confidence").isin(LEVELS)),
        "verdict": no((F.col("audit_status") == "auto_pass") == passed),
        "no_issue": no((F.col("audit_status") == "auto_pass") | (F.size("issues") > 0)),
    }
    reasons = F.when(F.col("_got").isNull(), F.array(F.lit("missing"))).otherwise(reason_list(rules))
    return d.select(job, "position", "source_question_no", reasons.alias("reasons"))


def declared_counts(entries: DataFrame, declared: DataFrame, job: str = "job_id") -> DataFrame:
    """job, matches: whether the declared counts (n_<status>) are those of the entries."""
    own = entries.groupBy(job).agg(*[F.count_if(F.col("audit_status") == s).alias(f"_{s}") for s in STATUSES])
    d = declared.join(own, job, "left")
    ok = F.lit(True)
    for s in STATUSES:
        ok = ok & F.coalesce(F.coalesce(f"_{s}", F.lit(0)) == F.col(f"n_{s}"), F.lit(False))
    return d.select(job, ok.alias("matches"))


def approval_reasons(question: DataFrame, types: list[str], points: DataFrame) -> DataFrame:
    """*question* with reasons why a person may not approve it (empty: it may be).

    It has stem_markdown, question_type_code, primary_knowledge_point_code, options array<struct<code, content>>, figure_required, has_crop,
    has_figure; *points*: code (the active ones)."""
    known = points.select(F.col("code").alias("_code")).distinct()
    d = question.join(known, F.col("primary_knowledge_point_code") == F.col("_code"), "left")
    options, choice = F.col("options"), F.col("question_type_code").isin(CHOICE)
    codes = F.transform(options, lambda o: F.lower(strip(o["code"])))
    pictures = (F.size(options) > 0) & F.forall(options, lambda o: strip(o["content"]) == IMAGE_OPTION)
    rules = {
        "empty_stem": blank(F.col("stem_markdown")),
        "type": no(F.col("question_type_code").isin(types)),
        "knowledge_point": F.col("_code").isNull(),
        "too_few_options": choice & no(F.size(options) >= 2),
        "repeated_codes": choice & no(unique(codes)),
        "missing_crop": F.coalesce(pictures, F.lit(False)) & no(F.col("has_crop")),
        "missing_figure": F.coalesce(F.col("figure_required"), F.lit(False)) & no(F.col("has_figure")),
    }
    return d.withColumn("reasons", reason_list(rules)).drop("_code")


def edit_reasons(old: DataFrame, new: DataFrame, key: list[str], fixed: list[str], free: list[str]) -> DataFrame:
    """key, reasons against an edit: fixed fields stay, and something must change."""
    o = old.select(*key, *[F.col(c).alias(f"_{c}") for c in [*fixed, *free]])
    d = new.join(o, key)
    differs = F.lit(False)
    for c in free:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    rules = {f"fixed:{c}": ~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in fixed} | {"unchanged": ~differs}
    return d.select(*key, reason_list(rules).alias("reasons"))


def form_rows(df: DataFrame, key: list[str], arrays: list[str], index: str) -> DataFrame:
    """Parallel arrays as rows (key, position from 1, one column an array) with valid: equal lengths, and *index* unique and in range."""
    sizes = [F.size(a) for a in arrays]
    equal = F.lit(True)
    for s in sizes[1:]:
        equal = equal & (s == sizes[0])
    ok = F.coalesce(equal & unique(F.col(index)) & F.forall(index, lambda i: (i >= 0) & (i < F.size(index))), F.lit(False))
    d = df.withColumn("valid", ok).select(*key, "valid", F.posexplode(F.arrays_zip(*arrays)).alias("_k", "_z"))
    return d.select(*key, "valid", (F.col("_k") + 1).alias("position"), *[F.col(f"_z.{a}").alias(a) for a in arrays])


def batch_verdict(rows: DataFrame, job: str = "job_id") -> DataFrame:
    """job, n, n_bad, valid: a batch is valid if it has rows and none has a reason."""
    bad = F.size("reasons") > 0
    return rows.groupBy(job).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_bad")).withColumn("valid", F.col("n_bad") == 0)
