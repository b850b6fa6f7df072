"""Baskets (basket_id, question_id, position) and soft deletion, as new generations of their tables; Markdown export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itemloom.operators import sequence

ITEM = ["basket_id", "question_id", "position"]


def add(items: DataFrame, new: DataFrame) -> DataFrame:
    """*items* with the questions of *new* (basket_id, question_id) that it lacks, behind the last, by id."""
    fresh = new.select("basket_id", "question_id").distinct().join(items, ["basket_id", "question_id"], "left_anti")
    last = items.groupBy("basket_id").agg(F.max("position").alias("_last"))
    rank = F.row_number().over(W.partitionBy("basket_id").orderBy("question_id"))
    d = fresh.withColumn("_r", rank).join(last, "basket_id", "left")
    return items.select(*ITEM).unionByName(d.select("basket_id", "question_id", (F.coalesce("_last", F.lit(0)) + F.col("_r")).cast("long").alias("position")))


def compact(items: DataFrame) -> DataFrame:
    return sequence.compact_positions(items.select(*ITEM), ["basket_id"], ["position", "question_id"])


def remove(items: DataFrame, gone: DataFrame) -> DataFrame:
    """*items* without the questions of *gone* (question_id, or also basket_id), positions 1..n again."""
    keys = [c for c in ("basket_id", "question_id") if c in gone.columns]
    return compact(items.join(gone.select(*keys), keys, "left_anti"))


def move(items: DataFrame, live: DataFrame, basket_id: int, question_id: int, up: bool) -> DataFrame:
    """*items* after a question changed places with its live neighbour. Places are counted among live questions only, and it is these
    counts that the two get; at the edge nothing happens. Other rows, also of deleted questions, keep their positions."""
    mine = items.filter(F.col("basket_id") == basket_id)
    shown = mine.join(live.select("question_id"), "question_id", "left_semi").select(*ITEM)
    w = W.partitionBy("basket_id").orderBy("position", "question_id")
    hit = F.col("question_id") == question_id
    at = F.row_number().over(w)
    step = F.lead(hit).over(w) if up else F.lag(hit).over(w)
    edge = F.lag("question_id").over(w) if up else F.lead("question_id").over(w)
    shift = -1 if up else 1
    new = F.when(hit & edge.isNotNull(), at + shift).when(F.coalesce(step, F.lit(False)), at - shift)
    moved = shown.withColumn("_new", new).filter("_new IS NOT NULL").select("basket_id", "question_id", "_new")
    return items.join(moved, ["basket_id", "question_id"], "left").select("basket_id", "question_id", F.coalesce("_new", "position").cast("long").alias("position"))


def delete_questions(questions: DataFrame, items: DataFrame, gone: DataFrame, at: str, reason: str, note: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(questions, items) after a soft deletion: rows are marked (those marked before keep their mark) and leave all baskets."""
    ids = gone.select("question_id").distinct().withColumn("_gone", F.lit(True))
    d = questions.join(ids, "question_id", "left")
    now = F.coalesce("_gone", F.lit(False)) & F.col("deleted_at").isNull()
    marks = {"deleted_at": at, "deletion_reason": reason, "deletion_note": note}
    d = d.withColumns({k: F.when(now, F.lit(v).cast("string")).otherwise(F.col(k)) for k, v in marks.items()}).drop("_gone")
    return d.select(*questions.columns), remove(items, gone.select("question_id"))


def restore_questions(questions: DataFrame, back: DataFrame) -> DataFrame:
    """Clears deleted_at only; reason and note stay, and no basket gets the question back."""
    ids = back.select("question_id").distinct().withColumn("_back", F.lit(True))
    d = questions.join(ids, "question_id", "left")
    return d.withColumn("deleted_at", F.when(F.col("_back").isNull(), F.col("deleted_at"))).select(*questions.columns)


def export_markdown(items: DataFrame, questions: DataFrame, options: DataFrame, title: str = "Questions", source: bool = True) -> DataFrame:
    """basket_id, markdown, n_questions, output_sha256: live questions in their order, renumbered from 1, with options by their order.

    *questions*: question_id, deleted_at, stem_markdown, paper_name, exam_year; *options*: question_id, display_order, code, content. A
    basket is made by hand, so its rows are few."""
    opts = options.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("display_order", F.concat_ws(". ", "code", "content").alias("t")))).alias("_o"))
    d = items.join(questions.filter("deleted_at IS NULL"), "question_id").join(opts, "question_id", "left")
    no = F.row_number().over(W.partitionBy("basket_id").orderBy("position", "question_id"))
    origin = F.concat(F.lit("> "), F.coalesce("paper_name", F.lit("?")), F.lit(", "), F.coalesce(F.col("exam_year").cast("string"), F.lit("year unknown")))
    lines = [F.array(F.concat(F.lit("## "), no.cast("string")), F.coalesce("stem_markdown", F.lit(""))), F.coalesce(F.transform("_o", lambda o: F.concat(F.lit("- "), o["t"])), F.array().cast("array<string>"))]
    body = F.array_join(F.concat(*lines, *([F.array(origin)] if source else [])), "\n")
    d = d.withColumns({"_no": no, "_body": body})
    texts = F.transform(F.sort_array(F.collect_list(F.struct("_no", "_body"))), lambda r: r["_body"])
    out = d.groupBy("basket_id").agg(F.concat(F.lit(f"# {title}\n\n"), F.array_join(texts, "\n\n"), F.lit("\n")).alias("markdown"), F.count(F.lit(1)).alias("n_questions"))
    return out.withColumn("output_sha256", F.sha2("markdown", 256))


def ledger(exports: DataFrame, at: str) -> DataFrame:
    """A row for each export, to be appended to the list of exports."""
    return exports.select("basket_id", "n_questions", "output_sha256", F.char_length("markdown").cast("long").alias("output_chars"), F.lit(at).alias("exported_at"))
