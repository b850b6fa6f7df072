"""Signed documents and older shapes: crop manifest, crop review, upload manifest, legacy audit, figures; typed rows in, reasons out.

A signature is HMAC-SHA256 of the document's canonical text without it (``documents.signed``); the caller has it as a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemloom.functions import is_sha256, reason_list, safe_path
from itemloom.operators.batches import no, texts_within, unique

#: Review states of a crop, states that a review may give, shapes of run ids and generation ids, and the limits.
CROP_STATES = ["pending_ai_review", "ai_review_passed", "needs_fix", "needs_recrop"]
REVIEW_STATES = ["ai_review_passed", "needs_recrop"]
RUN_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,199}$"
GENERATION_ID = "^[0-9a-f]{32}$"
MAX_QUESTIONS, MAX_WARNINGS, MAX_WARNING_LENGTH = 1000, 20, 500

_BOX = T.ArrayType(T.IntegerType())
_REGIONS = T.ArrayType(T.StructType([T.StructField("page_number", T.IntegerType()), T.StructField("bbox", _BOX)]))


def _struct(**fields: str) -> T.StructType:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "b": T.BooleanType(), "ss": T.ArrayType(T.StringType()), "ii": T.ArrayType(T.IntegerType())}
    return T.StructType([T.StructField(k, kinds[v] if isinstance(v, str) else v) for k, v in fields.items()])


#: What each model call must give back; a text is checked by ``documents.strict_object`` first and read by ``from_json`` with these.
OUTPUT_SCHEMAS = {
    "split": _struct(version="i", import_job_id="l", question_count="i", questions=T.ArrayType(_struct(question_no="i", regions=T.ArrayType(T.StructType([T.StructField("page_number", T.IntegerType()), T.StructField("bbox_normalized", T.ArrayType(T.DoubleType()))])), warnings="ss", confidence="s"))),
    "transcribe": _struct(version="i", import_job_id="l", source_paper_id="l", question_count="i", questions=T.ArrayType(_struct(source_question_no="s", stem_markdown="s", question_type_code="s", options=T.ArrayType(_struct(code="s", content="s")), subquestions=T.ArrayType(_struct(label="s", stem_markdown="s")), source_pages="ii", figure_required="b", extraction_confidence="s", warnings="ss"))),
    "audit": _struct(import_job_id="l", auditor="s", question_count="i", counts=_struct(auto_pass="i", disputed="i", human_required="i"), questions=T.ArrayType(_struct(source_question_no="s", audit_status="s", text_match="b", structure_match="b", formula_match="b", figure_check="s", knowledge_check="s", issues="ss", suggested_corrections="ss", evidence_page="i", audit_confidence="s"))),
    "level2": _struct(questions=T.ArrayType(_struct(source_question_no="s", level2_code="s", confidence="s", reason="s"))),
    "level3": _struct(questions=T.ArrayType(_struct(source_question_no="s", primary_code="s", related_codes="ss", confidence="s", reason="s"))),
}


def output_rows(df: DataFrame, column: str, stage: str, keep: list[str]) -> DataFrame:
    """*keep*, position (from 1) and the fields of each question of a model's answer; an answer that is no such document gives no row."""
    d = df.select(*keep, F.from_json(column, OUTPUT_SCHEMAS[stage]).alias("_d")).select(*keep, F.posexplode("_d.questions").alias("_k", "_q"))
    return d.select(*keep, (F.col("_k") + 1).alias("position"), "_q.*")


def positive(c: Column) -> Column:
    return c >= 1


def sorted_once(a: Column) -> Column:
    return F.sort_array(F.array_distinct(a)) == a


def crop_manifests(manifests: DataFrame, job: str = "job_id") -> DataFrame:
    """job, reasons of signed crop manifests (empty: valid).

    *manifests*: job, version, generation_id, question_count, signature, signature_now, pages array<struct<page_number, relative_path,
    pixel_width, pixel_height, sha256>>, questions array<struct<question_no, output_relative_path, width, height, byte_size, sha256, crop_status,
    review_status, warnings, regions array<struct<page_number, bbox>>, mode, separator_height, background, region_count>>."""
    at = lambda b, i: F.get(b, i)
    pages, size = F.col("pages"), F.map_from_arrays(F.transform("_once", lambda p: p["page_number"]), F.transform("_once", lambda p: F.struct(p["pixel_width"].alias("w"), p["pixel_height"].alias("h"))))
    once = F.filter("pages", lambda p, i: p["page_number"].isNotNull() & (F.array_position(F.transform("pages", lambda x: x["page_number"]), p["page_number"]) == i + 1))

    def region(r, known):
        page, b = F.try_element_at(known, r["page_number"]), r["bbox"]
        inside = (at(b, 0) >= 0) & (at(b, 0) < at(b, 2)) & (at(b, 1) >= 0) & (at(b, 1) < at(b, 3)) & (at(b, 2) <= page["w"]) & (at(b, 3) <= page["h"])
        return F.coalesce((F.size(b) == 4) & inside, F.lit(False))

    def composed(q):
        one = (q["mode"] == "single") & q["separator_height"].isNull() & q["background"].isNull()
        more = (q["mode"] == "vertical") & (q["separator_height"] >= 0) & (q["background"] == "white")
        return F.coalesce((q["region_count"] == F.size(q["regions"])) & F.when(F.size(q["regions"]) == 1, one).otherwise(more), F.lit(False))

    numbers = lambda a, f: F.transform(a, lambda x: x[f])
    each = lambda a, f: no(F.forall(a, lambda x: F.coalesce(f(x), F.lit(False))))
    rules = {
        "signature": no(is_sha256(F.col("signature")) & (F.col("signature") == F.col("signature_now"))),
        "version": no(F.col("version") == 2),
        "generation": no(F.col("generation_id").rlike(GENERATION_ID)),
        "count": no(F.col("question_count") == F.size("questions")),
        "pages": each(pages, lambda p: positive(p["page_number"]) & positive(p["pixel_width"]) & positive(p["pixel_height"]) & is_sha256(p["sha256"]) & safe_path(p["relative_path"]) & F.startswith(p["relative_path"], F.lit("pages/"))),
        "page_order": no(sorted_once(numbers("pages", "page_number"))),
        "question_order": no(sorted_once(numbers("questions", "question_no"))),
        "output": each("questions", lambda q: q["output_relative_path"] == F.format_string("question_crops/Q%03d.png", q["question_no"])),
        "crop": each("questions", lambda q: positive(q["width"]) & positive(q["height"]) & positive(q["byte_size"]) & is_sha256(q["sha256"]) & (q["crop_status"] == "generated") & q["review_status"].isin(CROP_STATES) & F.forall(q["warnings"], lambda w: w.isNotNull())),
        "region": each("questions", lambda q: (F.size(q["regions"]) > 0) & F.forall(q["regions"], lambda r: region(r, F.col("_size")))),
        "composition": each("questions", composed),
    }
    d = manifests.withColumn("_once", once).withColumn("_size", size)
    return d.select(job, reason_list(rules).alias("reasons"))


def crop_reviews(payloads: DataFrame, job: str = "job_id") -> DataFrame:
    """job, reasons of crop reviews. *payloads*: job, version, generation_id, manifest_sha256, reviewer_run_id, questions
    array<struct<question_no, status, warnings>>, expected array<int> (all numbers of the manifest, in order)."""
    numbers = F.transform("questions", lambda q: q["question_no"])
    good = lambda q: q["question_no"].between(1, MAX_QUESTIONS) & q["status"].isin(REVIEW_STATES)
    said = lambda q: texts_within(q["warnings"], MAX_WARNINGS, MAX_WARNING_LENGTH) & F.forall(q["warnings"], lambda w: F.length(F.regexp_replace(w, r"(?U)\s+", "")) > 0)
    rules = {
        "version": no(F.col("version") == 1),
        "input": no(F.col("generation_id").rlike(GENERATION_ID) & is_sha256(F.col("manifest_sha256"))),
        "reviewer": no(F.col("reviewer_run_id").rlike(RUN_ID)),
        "count": no(F.size("questions").between(1, MAX_QUESTIONS)),
        "question": no(F.forall("questions", lambda q: F.coalesce(good(q), F.lit(False)))),
        "warnings": no(F.forall("questions", lambda q: F.coalesce(said(q), F.lit(False)))),
        "order": no(sorted_once(numbers)),
        "coverage": no(numbers == F.col("expected")),
    }
    return payloads.select(job, reason_list(rules).alias("reasons"))


def merged_warnings(old: Column, new: Column) -> Column:
    """Old and new warnings, each once in order, at most ``MAX_WARNINGS``; null (refused) if there are more."""
    both = F.array_distinct(F.concat(old, new))
    return F.when(F.size(both) <= MAX_WARNINGS, both)


def crop_tallies(crops: DataFrame, job: str) -> DataFrame:
    """job, n_passed, n_needs_recrop, n_pending (all others)."""
    s = F.col("review_status")
    passed, again = F.count_if(s == "ai_review_passed"), F.count_if(s.isin("needs_recrop", "needs_fix"))
    return crops.groupBy(job).agg(passed.alias("n_passed"), again.alias("n_needs_recrop"), (F.count(F.lit(1)) - passed - again).alias("n_pending"))


def upload_manifests(uploads: DataFrame, key: str = "token") -> DataFrame:
    """key, reasons of staged uploads. *uploads*: key, requested_token, original_filename, stored_filename, size, sha256, page_count, signature,
    signature_now, and what the staged file itself has: file_size, file_sha256, file_pages (null: not counted here)."""
    last = F.regexp_extract("original_filename", r"([^/\\]*)$", 1)
    rules = {
        "signature": no(F.col("signature") == F.col("signature_now")),
        "token": no(F.col(key) == F.col("requested_token")),
        "name": no((F.col("stored_filename") == last) & (F.length(last) > 4) & F.endswith(F.lower(last), F.lit(".pdf"))),
        "fields": no(is_sha256(F.col("sha256")) & (F.col("size") >= 1) & (F.col("page_count") >= 1)),
        "changed": no((F.col("file_size") == F.col("size")) & (F.col("file_sha256") == F.col("sha256"))),
        "pages": no(F.col("file_pages").isNull() | (F.col("file_pages") == F.col("page_count"))),
    }
    return uploads.select(key, reason_list(rules).alias("reasons"))


def staged(chunks: DataFrame, key: str, max_bytes: int) -> DataFrame:
    """key, size, sha256, accepted of uploads that came as chunks (key, no, content text): in order, whole, under the cap. One upload is
    bounded by *max_bytes*, so its chunks may meet."""
    d = chunks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("no", "content"))).alias("_c"), F.count(F.lit(1)).alias("_n"), F.max("no").alias("_last"), F.min("no").alias("_first"))
    text = F.array_join(F.transform("_c", lambda c: c["content"]), "")
    ok = (F.col("_first") == 1) & (F.col("_last") == F.col("_n")) & (F.octet_length(text) <= max_bytes)
    return d.select(key, F.octet_length(text).cast("long").alias("size"), F.sha2(text, 256).alias("sha256"), ok.alias("accepted"))


def legacy_audits(entries: DataFrame, declared: DataFrame, candidates: DataFrame, job: str = "job_id") -> DataFrame:
    """job, reasons of audits of the older shape, which says nothing of single checks.

    *entries*: job, source_question_no, audit_status, issues, suggested_corrections, evidence_page; *declared*: job, question_count, counts
    struct<auto_pass, disputed, human_required>, sample_nos, sample_reason; *candidates*: job, source_question_no."""
    statuses = ["auto_pass", "disputed", "human_required"]
    good = F.col("source_question_no").isNotNull() & F.col("audit_status").isin(statuses) & F.forall("issues", lambda x: x.isNotNull()) & F.forall("suggested_corrections", lambda x: x.isNotNull()) & (F.col("evidence_page") >= 1)
    own = entries.groupBy(job).agg(F.every(F.coalesce(good, F.lit(False))).alias("_good"), F.sort_array(F.collect_list("source_question_no")).alias("_nos"), F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("audit_status") == s).alias(f"_{s}") for s in statuses])
    known = candidates.groupBy(job).agg(F.sort_array(F.collect_list("source_question_no")).alias("_known"))
    d = declared.join(own, job, "left").join(known, job, "left")
    counts = F.lit(True)
    for s in statuses:
        counts = counts & (F.col(f"counts.{s}") == F.col(f"_{s}"))
    sample = F.col("sample_nos").isNull() & F.col("sample_reason").isNull() | (F.col("sample_reason").isNotNull() & F.forall("sample_nos", lambda n: F.coalesce(F.array_contains(F.col("_nos"), n), F.lit(False))))
    rules = {
        "entry": no(F.col("_good")),
        "numbers": no((F.col("_nos") == F.col("_known")) & unique(F.col("_nos"))),
        "question_count": no((F.col("question_count") == F.size("_known")) & (F.col("_n") == F.size("_known"))),
        "counts": no(counts),
        "sample": no(sample),
    }
    return d.select(job, reason_list(rules).alias("reasons"))


def safe_figures(figures: DataFrame) -> DataFrame:
    """The *figures* (relative_path, sha256, width, height, review_status) that can be shown; unsafe entries go, the rest stays."""
    ok = safe_path(F.col("relative_path")) & is_sha256(F.col("sha256")) & (F.col("width") >= 1) & (F.col("height") >= 1) & F.col("review_status").isNotNull()
    return figures.filter(F.coalesce(ok, F.lit(False)))


def out_of_order(rows: DataFrame, group: list[str], position: str, key: list[str]) -> DataFrame:
    """*rows* with disorder: whether the row's *key* is smaller than that of the row before."""
    before = F.lag(F.struct(*key)).over(W.partitionBy(*group).orderBy(position))
    return rows.withColumn("disorder", F.coalesce(F.struct(*key) < before, F.lit(False)))


def unknown_keys(given: Column, allowed: list[str]) -> Column:
    """Names that are not allowed, each once in order."""
    return F.array_except(given, F.array(*[F.lit(x) for x in allowed]))


def affected_groups(changed: DataFrame, recovered: DataFrame, number: str, size: int = 4) -> DataFrame:
    """first_no of each group of *size* numbers that has a changed or recovered one."""
    first = (F.floor((F.col(number) - 1) / size) * size + 1).cast("long").alias("first_no")
    return changed.select(first).union(recovered.select(first)).distinct()


def page_pixels(points: Column, dpi: int = 300) -> Column:
    """Pixels of a side given in points (72 an inch), rounded up."""
    return F.ceil(points * dpi / 72).cast("long")
