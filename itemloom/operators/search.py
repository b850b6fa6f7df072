"""The item bank's listing, facets and details.

Tables: questions (question_id, import_job_id, question_no text, paper_id, type_code, primary_code, figure_review_status, deleted_at),
related (question_id, code), papers (paper_id, paper_name, exam_year), and dictionaries (code, name, is_active).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.functions import contains_literal

MAX_SOURCE = 100


class BadFilter(ValueError):
    """A filter names something that does not exist."""


def check_filters(types: DataFrame, points: DataFrame, knowledge: str | None = None, question_type: str | None = None, source: str | None = None, has_figure: str | None = None) -> None:
    """Raise for values that no row could mean. None is no filter; an empty text is no code, but matches every source."""
    for name, code, known in (("knowledge", knowledge, points), ("question_type", question_type, types)):
        if code is not None and known.filter((F.col("code") == code) & F.col("is_active")).isEmpty():
            raise BadFilter(name)
    if has_figure not in (None, "true", "false"):
        raise BadFilter("has_figure")
    if source is not None and (len(source) > MAX_SOURCE or re.search(r"[\x00-\x1f]", source)):
        raise BadFilter("source")


def live(questions: DataFrame) -> DataFrame:
    return questions.filter("deleted_at IS NULL")


def listing(questions: DataFrame, related: DataFrame, papers: DataFrame, types: DataFrame, points: DataFrame, basket: DataFrame | None = None, *, knowledge=None, question_type=None, source=None, has_figure=None) -> DataFrame:
    """Live questions with the names of their type, point and paper, has_figure and in_basket; every filter given must hold.

    A point matches as primary or related. Dictionaries are small tables; the planner broadcasts them by their size."""
    q = live(questions).withColumn("has_figure", F.coalesce(F.col("figure_review_status") == "passed", F.lit(False)))
    if question_type is not None:
        q = q.filter(F.col("type_code") == question_type)
    if has_figure is not None:
        q = q.filter(F.col("has_figure") == (has_figure == "true"))
    if knowledge is not None:
        ids = q.filter(F.col("primary_code") == knowledge).select("question_id").union(related.filter(F.col("code") == knowledge).select("question_id"))
        q = q.join(ids, "question_id", "left_semi")
    p = papers if source is None else papers.filter(contains_literal(F.col("paper_name"), source))
    q = q.join(p, "paper_id").join(types.select(F.col("code").alias("type_code"), F.col("name").alias("type_name")), "type_code")
    q = q.join(points.select(F.col("code").alias("primary_code"), F.col("name").alias("point_name")), "primary_code")
    if basket is None:
        return q.withColumn("in_basket", F.lit(False))
    mine = basket.select("question_id").distinct().withColumn("_in", F.lit(True))
    return q.join(mine, "question_id", "left").withColumn("in_basket", F.col("_in").isNotNull()).drop("_in")


def in_order(rows: DataFrame) -> DataFrame:
    """Newest papers and jobs first, then by number (one that is none sorts first)."""
    return rows.orderBy(F.desc("exam_year"), F.desc("import_job_id"), F.col("question_no").try_cast("int").asc_nulls_first(), "question_id")


def used_points(questions: DataFrame, related: DataFrame, points: DataFrame) -> DataFrame:
    """Points that a live question has, as primary or related."""
    q = live(questions)
    codes = q.select(F.col("primary_code").alias("code")).union(related.join(q.select("question_id"), "question_id", "left_semi").select("code"))
    return points.join(codes, "code", "left_semi")


def with_children(rows: DataFrame, children: DataFrame, key: str, order: str, columns: list[str], name: str) -> DataFrame:
    """*rows* with an array of their children's *columns* in order (empty for none). Children of one parent are few."""
    lists = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias(name))
    kind = lists.schema[name].dataType
    return rows.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def keep_whole(rows: DataFrame, job: str, invalid) -> DataFrame:
    """All rows of the jobs that have no invalid row (a null counts as invalid)."""
    bad = rows.filter(F.coalesce(invalid, F.lit(True))).select(job).distinct()
    return rows.join(bad, job, "left_anti")


def verified_assets(assets: DataFrame, manifest: DataFrame, files: DataFrame, fields: list[str]) -> DataFrame:
    """*assets* with verified: the manifest's entry of the path has equal *fields* (sha256 among them), and so has the file its digest."""
    m = manifest.select("path", *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_m"))
    d = assets.join(m, "path", "left").join(files.select("path", F.col("sha256").alias("_file")), "path", "left")
    ok = F.coalesce(F.col("_m") & (F.col("sha256") == F.col("_file")), F.lit(False))
    for f in fields:
        ok = ok & F.coalesce(F.col(f) == F.col(f"_{f}"), F.lit(False))
    return d.withColumn("verified", ok).drop("_m", "_file", *[f"_{f}" for f in fields])
