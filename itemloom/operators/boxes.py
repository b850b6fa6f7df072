"""Boxes on pages: which box lies in which, by a grid of cells, and the checks of a layout and of a crop plan that rest on it.

A box (l, t, r, b; pixels) that contains another one covers the cell of that one's upper left corner. So containers go to all of their
cells, boxes to one, and an equi-join on page and cell with an exact test finds every pair once: no pair of boxes of different cells is
ever looked at, and a page with many boxes is spread over its cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itemloom.operators.layout import box_fault

CELL = 256
#: Fixed values of a layout document.
CONFIDENCE, MAX_COLUMNS, MAX_QUESTIONS = ("high", "medium", "low"), 3, 200
_BOX_FAULTS = ("unknown_page", "order", "outside")


def _bits(*tests: Column) -> Column:
    """The tests that hold as bits of a number, the first as the lowest."""
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(tests)), F.lit(0))


def _cells(low: str, high: str, cell: int) -> Column:
    """Cells from *low* to *high* (exclusive); none for a box that is empty or null."""
    some = F.col(high) > F.col(low)
    return F.when(some, F.sequence(F.floor(F.col(low) / cell), F.floor((F.col(high) - 1) / cell))).otherwise(F.array().cast("array<bigint>"))


def _placed(boxes: DataFrame, containers: DataFrame, page: list[str], name: str, cell: int, how: str) -> DataFrame:
    """*boxes* with *name* of the containers that contain them; a *how* of left keeps those in none, with a null."""
    c = containers.select(*page, name, *[F.col(s).alias(f"_{s}") for s in "ltrb"])
    c = c.withColumn("_cx", F.explode(_cells("_l", "_r", cell))).withColumn("_cy", F.explode(_cells("_t", "_b", cell)))
    some = (F.col("l") < F.col("r")) & (F.col("t") < F.col("b"))
    b = boxes.withColumns({"_cx": F.when(some, F.floor(F.col("l") / cell)), "_cy": F.when(some, F.floor(F.col("t") / cell))})
    inside = (F.col("_l") <= F.col("l")) & (F.col("r") <= F.col("_r")) & (F.col("_t") <= F.col("t")) & (F.col("b") <= F.col("_b"))
    b, c = b.alias("b"), c.alias("c")
    for k in (*page, "_cx", "_cy"):
        inside = (F.col(f"b.{k}") == F.col(f"c.{k}")) & inside
    return b.join(c, inside, how).select(*[F.col(f"b.{k}") for k in boxes.columns], F.col(f"c.{name}"))


def containing(boxes: DataFrame, containers: DataFrame, page: list[str], name: str, cell: int = CELL) -> DataFrame:
    """Each of *boxes* (page, l, t, r, b and more) with *name* of every one of *containers* (page, name, l, t, r, b) that contains it.

    A box without extent, or with a null side, is contained in none."""
    return _placed(boxes, containers, page, name, cell, "inner")


def page_faults(pages: DataFrame, rendered: DataFrame, columns: DataFrame, page: list[str]) -> DataFrame:
    """page, fault of a layout's *pages* (page, width, height, column_count, text_layer, confidence, overlay_width, overlay_height,
    overlay_bytes) against the *rendered* ones (page, width, height): not_rendered, not_analysed, size, column_count, text_layer, confidence,
    overlay_size, overlay_bytes, and of their *columns* (page, column_index, l, t, r, b): column_order, column_outside, column_overlap."""
    r = rendered.select(*page, F.col("width").alias("_w"), F.col("height").alias("_h"), F.lit(True).alias("_r"))
    n = columns.groupBy(*page).agg(F.count(F.lit(1)).alias("_n"))
    d = pages.withColumn("_p", F.lit(True)).join(r, page, "full").join(n, page, "left")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    both = F.col("_p") & F.col("_r")
    found = {
        "not_rendered": F.col("_r").isNull(),
        "not_analysed": F.col("_p").isNull(),
        "size": both & ~(same("width", "_w") & same("height", "_h")),
        "column_count": both & ~F.coalesce(F.col("column_count").between(1, MAX_COLUMNS) & (F.col("column_count") == F.col("_n")), F.lit(False)),
        "text_layer": both & F.col("text_layer").isNull(),
        "confidence": both & ~F.coalesce(F.col("confidence").isin(*CONFIDENCE), F.lit(False)),
        "overlay_size": both & ~(same("overlay_width", "_w") & same("overlay_height", "_h")),
        "overlay_bytes": both & ~F.coalesce(F.col("overlay_bytes") > 0, F.lit(False)),
    }
    rows = d.select(*page, F.explode(F.array_compact(F.array(*[F.when(c, name) for name, c in found.items()]))).alias("fault"))
    box = F.struct("l", "t", "r", "b")
    before = F.lag("r").over(W.partitionBy(*page).orderBy("column_index"))
    cut = columns.withColumn("_before", before).join(r, page).withColumn("_f", F.coalesce(box_fault(box, F.col("_w"), F.col("_h")), F.when(F.col("l") < F.col("_before"), "overlap")))
    return rows.unionByName(cut.filter("_f IS NOT NULL").select(*page, F.concat(F.lit("column_"), "_f").alias("fault")))


def region_faults(regions: DataFrame, columns: DataFrame, rendered: DataFrame, job: list[str], page: str, cell: int = CELL) -> DataFrame:
    """job, question_no, region_no, fault of *regions* (job, question_no, region_no, page, l, t, r, b): unknown_page, order and outside (of
    the box), no_column and several_columns (it must lie in exactly one), and backwards (before its predecessor by page, column and top).

    *columns*: job, page, column_index, l, t, r, b; *rendered*: job, page, width, height. Pages are read in the order of their numbers."""
    key = [*job, "question_no", "region_no"]
    d = regions.select(*key, page, "l", "t", "r", "b").join(rendered.select(*job, page, F.col("width").alias("_w"), F.col("height").alias("_h")), [*job, page], "left")
    bad = F.when(F.col("_w").isNull(), "unknown_page").otherwise(box_fault(F.struct("l", "t", "r", "b"), F.col("_w"), F.col("_h")))
    d = d.withColumn("_bad", bad).drop("_w", "_h")
    # One path from the regions to their faults: a region keeps its row where no column contains it, and rows of several columns are one again after the grouping.
    d = _placed(d, columns, [*job, page], "column_index", cell, "left").groupBy(*job, "question_no", "region_no", page, "t", "_bad").agg(F.count("column_index").alias("_n"), F.min("column_index").alias("_column"))
    fault = F.coalesce("_bad", F.when(F.col("_n") == 0, "no_column").when(F.col("_n") > 1, "several_columns"))
    place = F.when(fault.isNull(), F.struct(F.col(page).alias("p"), F.col("_column").alias("c"), F.col("t").alias("t")))
    d = d.withColumns({"_fault": fault, "_place": place})
    before = F.lag("_place").over(W.partitionBy(*job, "question_no").orderBy("region_no"))
    return d.withColumn("fault", F.coalesce("_fault", F.when(F.col("_place") < before, "backwards"))).filter("fault IS NOT NULL").select(*key, "fault")


def crop_plan_faults(items: DataFrame, regions: DataFrame, expected: DataFrame, rendered: DataFrame, job: list[str], separator: int, most_regions: int, most_pixels: int, most_total: int) -> DataFrame:
    """job, question_no, fault of a crop plan; its budgets are *most_regions* and *most_total* pixels of a job, *most_pixels* of a question.

    *items*: job, item, question_no; *regions*: job, item, page_number, l, t, r, b; *expected*: job, question_no; *rendered*: job,
    page_number, width, height. Faults of a question: number (null or below 1), repeated, no_region, unknown_page, order, outside, pixels,
    unexpected, missing; of the job (question_no null): regions_budget, pixels_budget. Boxes that are wrong do not count as pixels."""
    good, box = F.col("_bad").isNull(), F.struct("l", "t", "r", "b")
    d = regions.join(rendered, [*job, "page_number"], "left")
    d = d.withColumn("_bad", F.when(F.col("width").isNull(), "unknown_page").otherwise(box_fault(box, F.col("width"), F.col("height"))))
    d = d.select(*job, "item", "_bad", F.when(good, F.col("r") - F.col("l")).alias("_across"), F.when(good, F.col("b") - F.col("t")).alias("_down"))
    height = F.sum("_down") + separator * (F.count_if(good) - 1)
    size = d.groupBy(*job, "item").agg(F.count(F.lit(1)).alias("_n"), F.bit_or(_bits(*[F.col("_bad") == f for f in _BOX_FAULTS])).alias("_bads"), F.max("_across").alias("_w"), height.alias("_h"))
    i = items.join(size, [*job, "item"], "left").withColumn("_pixels", F.col("_w") * F.col("_h"))
    own = F.coalesce("_bads", F.lit(0)).bitwiseOR(F.shiftleft(_bits(F.col("_n").isNull(), F.col("_pixels") > most_pixels), len(_BOX_FAULTS)))
    # A question's items, its place among the expected ones and its job's sums meet in one grouping: each item gives a row for its question and one for its job.
    none = F.lit(None).cast("long")
    row = lambda whole, no, bits, items, n, pixels: F.struct(F.lit(whole).alias("_whole"), no.alias("question_no"), bits.alias("_bits"), F.lit(items).alias("_items"), F.lit(False).alias("_wanted"), n.alias("_n"), pixels.alias("_p"))
    number = F.col("question_no").cast("long")
    rows = i.select(*job, F.inline(F.array(row(False, number, own, 1, none, none), row(True, none, F.lit(0), 0, F.col("_n"), F.col("_pixels").cast("long")))))
    rows = rows.unionByName(expected.select(*job, F.inline(F.array(F.struct(F.lit(False).alias("_whole"), number.alias("question_no"), F.lit(0).alias("_bits"), F.lit(0).alias("_items"), F.lit(True).alias("_wanted"), none.alias("_n"), none.alias("_p"))))))
    q = rows.groupBy(*job, "_whole", "question_no").agg(F.bit_or("_bits").alias("_bits"), F.sum("_items").alias("_items"), F.max("_wanted").alias("_wanted"), F.sum("_n").alias("_n"), F.sum("_p").alias("_p"))
    there, sound = F.col("_items") > 0, F.coalesce(F.col("question_no") >= 1, F.lit(False))
    found = {
        "number": there & ~sound, "repeated": sound & (F.col("_items") > 1), "unexpected": there & sound & ~F.col("_wanted"), "missing": F.col("_wanted") & (~there | F.col("question_no").isNull()),
        "regions_budget": F.col("_whole") & (F.col("_n") > most_regions), "pixels_budget": F.col("_whole") & (F.col("_p") > most_total),
    } | {f: F.getbit("_bits", F.lit(k)) == 1 for k, f in enumerate((*_BOX_FAULTS, "no_region", "pixels"))}
    return q.select(*job, "question_no", F.explode(F.array_compact(F.array(*[F.when(c, f) for f, c in found.items()]))).alias("fault"))
