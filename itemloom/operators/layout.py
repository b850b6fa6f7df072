"""Page layout over tables of words and ink: columns, main-number anchors, regions, crop sizes and figures.

Pages, words and ink come from whatever renders them; everything here is set-at-a-time over those tables. Windows are per page or
per job; a page has at most three columns, so a page's columns travel as one short array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itemloom.operators import sequence

#: Fixed value: a main number, 1 to 999, then a mark, and no digit after it.
MAIN_NUMBER = r"^([1-9][0-9]{0,2})(?:[.．、]|题)(?![0-9])"
#: Fixed values of column detection.
SAMPLE_WIDTH = 1000
SAMPLE_PIXELS = 2_000_000
EDGE_SHARE = 0.15
FIRST_CUT, SECOND_CUT = (0.20, 0.45), (0.55, 0.80)


def sample_scale(width: Column, height: Column) -> Column:
    """The factor by which a page is shrunk before its ink is counted."""
    return F.least(F.lit(1.0), F.lit(float(SAMPLE_WIDTH)) / width, F.sqrt(F.lit(float(SAMPLE_PIXELS)) / (width.cast("double") * height)))


def quiet_runs(ink: DataFrame, pages: DataFrame, page: list[str]) -> DataFrame:
    """page, start, stop (exclusive), of each run of sampled x with hardly any ink inside a page's content.

    *ink*: page, x, ink (dark pixels in the column of pixels); an x without a row has none. *pages*: see ``columns``."""
    box = pages.filter("left IS NOT NULL").select(*page, "left", "right", F.greatest(F.lit(1), F.floor((F.col("bottom") - F.col("top")) * 0.01)).alias("_low"))
    every = box.select(*page, "_low", F.explode(F.sequence("left", F.col("right") - 1)).alias("x"))
    quiet = every.join(ink.select(*page, "x", "ink"), [*page, "x"], "left").filter(F.coalesce("ink", F.lit(0)) <= F.col("_low"))
    return sequence.islands(quiet.select(*page, "x"), page, "x").select(*page, F.col("first").alias("start"), (F.col("last") + 1).alias("stop"))


def columns(ink: DataFrame, pages: DataFrame, page: list[str]) -> DataFrame:
    """page, column_index, l, t, r, b (page pixels): one to three columns of each page.

    *pages*: page, width, height (pixels), sample_width, scale, and left, top, right, bottom of the content in sampled pixels
    (null for a blank page, which is one column). A gutter is a quiet run of at least 2.5 % of the sampled width (and 4) whose centre
    lies inside the middle 70 % of the content; the two longest count (later first among equals). If there are two, they must cut the content
    about in thirds, or only the left one counts."""
    runs = quiet_runs(ink, pages, page).join(pages.select(*page, "left", "right", "sample_width"), page)
    wide = F.col("right") - F.col("left")
    runs = runs.withColumns({"length": F.col("stop") - F.col("start"), "centre": F.col("left") + F.floor((F.col("start") + F.col("stop") - 2 * F.col("left")) / 2)})
    runs = runs.filter((F.col("length") >= F.greatest(F.lit(4), F.floor(F.col("sample_width") * 0.025))) & (F.col("centre") > F.col("left") + wide * EDGE_SHARE) & (F.col("centre") < F.col("right") - wide * EDGE_SHARE))
    best = W.partitionBy(*page).orderBy(F.desc("length"), F.desc("centre"))
    cuts = runs.withColumn("_r", F.row_number().over(best)).filter("_r <= 2").groupBy(*page).agg(F.sort_array(F.collect_list("centre")).alias("_cuts"))
    d = pages.join(cuts, page, "left").withColumn("_cuts", F.coalesce("_cuts", F.array().cast("array<bigint>")))
    share = lambda i: (F.get("_cuts", i) - F.col("left")) / (F.col("right") - F.col("left"))
    thirds = share(0).between(*FIRST_CUT) & share(1).between(*SECOND_CUT)
    d = d.withColumn("_cuts", F.when((F.size("_cuts") == 2) & ~thirds, F.slice("_cuts", 1, 1)).otherwise(F.col("_cuts")))
    edges = F.concat(F.array(F.col("left").cast("long")), F.col("_cuts"), F.array(F.col("right").cast("long")))
    starts = F.when(F.col("left").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.slice(edges, 1, F.size("_cuts") + 1))
    d = d.withColumn("_edges", edges).select("*", F.posexplode(starts).alias("column_index", "_start"))
    blank, up = F.col("left").isNull(), lambda c: F.rint(c / F.col("scale")).cast("long")
    stop = F.get("_edges", F.col("column_index") + 1)
    return d.select(
        *page, "column_index",
        F.when(blank, 0).otherwise(F.greatest(F.lit(0), up(F.col("_start")))).alias("l"),
        F.when(blank, 0).otherwise(F.greatest(F.lit(0), up(F.col("top")))).alias("t"),
        F.when(blank, F.col("width")).otherwise(F.least(F.col("width"), up(stop))).alias("r"),
        F.when(blank, F.col("height")).otherwise(F.least(F.col("height"), up(F.col("bottom")))).alias("b"),
    )


def anchors(words: DataFrame, cols: DataFrame, page: list[str]) -> DataFrame:
    """page, column_index, x, y, question_no: words that are a main number at the left edge of a column (of several, the first).

    *words*: page, x, y (pixels), word. Positions are moved into the column."""
    number = F.regexp_extract("word", MAIN_NUMBER, 1)
    found = words.withColumn("question_no", F.nullif(number, F.lit(""))).filter("question_no IS NOT NULL")
    bands = cols.groupBy(*page).agg(F.sort_array(F.collect_list(F.struct("column_index", "l", "t", "r", "b"))).alias("_bands"))
    near = lambda c: (F.col("x") >= c["l"] - 5) & (F.col("x") <= c["l"] + F.greatest(F.lit(30.0), (c["r"] - c["l"]) * 0.16)) & (F.col("y") < c["b"])
    d = found.join(bands, page).withColumn("_c", F.get(F.filter("_bands", near), 0)).filter("_c IS NOT NULL")
    return d.select(*page, F.col("_c.column_index").alias("column_index"), F.greatest("x", F.col("_c.l")).alias("x"), F.greatest("y", F.col("_c.t")).alias("y"), "question_no")


def _numbered(found: DataFrame, cols: DataFrame, job: list[str], page: str) -> tuple[DataFrame, DataFrame]:
    """(slots: a job's columns in reading order; its anchors, numbered in that order)."""
    slots = cols.withColumn("slot", F.row_number().over(W.partitionBy(*job).orderBy(page, "column_index")))
    a = found.join(slots.select(*job, page, "column_index", "slot"), [*job, page, "column_index"])
    return slots, a.withColumn("anchor_no", F.row_number().over(W.partitionBy(*job).orderBy("slot", "y", "x")))


def region_faults(found: DataFrame, cols: DataFrame, job: list[str], page: str, max_questions: int = 200) -> DataFrame:
    """job, question_no, fault of what stops a job's layout: no_column (an anchor on no column of its job), no_region (nothing of it is left,
    as the next one stands at its height) and too_many (of the job, question_no is null)."""
    _, a = _numbered(found, cols, job, page)
    covered = regions(found, cols, job, page).select(*job, "anchor_no").distinct()
    out = a.join(covered, [*job, "anchor_no"], "left_anti").select(*job, "question_no", F.lit("no_region").alias("fault"))
    lost = found.join(cols, [*job, page, "column_index"], "left_anti").select(*job, "question_no", F.lit("no_column").alias("fault"))
    many = found.groupBy(*job).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_questions)
    return out.unionByName(lost).unionByName(many.select(*job, F.lit(None).cast("string").alias("question_no"), F.lit("too_many").alias("fault")))


def regions(found: DataFrame, cols: DataFrame, job: list[str], page: str) -> DataFrame:
    """job, anchor_no, question_no, region_no, page, l, t, r, b, warnings, confidence: what each anchor covers up to the next one.

    Slots are a job's columns in reading order. An anchor's first slot starts at its height, its last ends at the next anchor's, the
    others are whole columns; pieces without height are dropped (``region_faults`` names anchors that have no other). *job* columns are
    in both tables."""
    slots, a = _numbered(found, cols, job, page)
    order = W.partitionBy(*job).orderBy("slot", "y", "x")
    a = a.withColumns({"_next": F.lead("slot").over(order), "_end": F.lead("y").over(order), "_n": F.col("question_no").cast("long")})
    a = sequence.anomalies(a, job, ["anchor_no"], "_n")
    last = slots.groupBy(*job).agg(F.max("slot").alias("_last"))
    a = a.join(last, job).select(*job, "anchor_no", "question_no", "warnings", "confidence", "y", "_next", "_end", F.col("slot").alias("_first"), F.explode(F.sequence("slot", F.coalesce("_next", "_last"))).alias("slot"))
    d = a.join(slots, [*job, "slot"])
    top = F.when(F.col("slot") == F.col("_first"), F.col("y")).otherwise(F.col("t"))
    bottom = F.when(F.col("slot") == F.col("_next"), F.col("_end")).otherwise(F.col("b"))
    d = d.withColumns({"_t": top.cast("long"), "_b": bottom.cast("long")}).filter("_b > _t")
    d = d.withColumn("region_no", F.row_number().over(W.partitionBy(*job, "anchor_no").orderBy("slot")))
    return d.select(*job, "anchor_no", "question_no", "region_no", page, "l", F.col("_t").alias("t"), "r", F.col("_b").alias("b"), "warnings", "confidence")


def crop_sizes(pieces: DataFrame, key: list[str], separator: int = 0) -> DataFrame:
    """key, n_regions, width (the widest), height (stacked, with separators), pixels."""
    d = pieces.groupBy(*key).agg(F.count(F.lit(1)).alias("n_regions"), F.max(F.col("r") - F.col("l")).alias("width"), F.sum(F.col("b") - F.col("t")).alias("_h"))
    return d.withColumn("height", F.col("_h") + separator * (F.col("n_regions") - 1)).withColumn("pixels", F.col("width") * F.col("height")).drop("_h")


def box_fault(box: Column, width: Column, height: Column) -> Column:
    """Why a pixel box struct (l, t, r, b) is not inside its page, or null."""
    whole = F.coalesce((box["l"] >= 0) & (box["t"] >= 0) & (box["r"] <= width) & (box["b"] <= height), F.lit(False))
    ordered = F.coalesce((box["l"] < box["r"]) & (box["t"] < box["b"]), F.lit(False))
    return F.when(~ordered, "order").when(~whole, "outside")


def column_faults(columns: DataFrame, pages: DataFrame, page: list[str]) -> DataFrame:
    """page, column_index, fault (order, outside, overlap) of columns (page, column_index, l, t, r, b) that are wrong: each lies on its page
    (page, width, height), right of all before it."""
    d = columns.join(pages, page, "left")
    box = F.struct("l", "t", "r", "b")
    before = F.max("r").over(W.partitionBy(*page).orderBy("column_index").rowsBetween(W.unboundedPreceding, -1))
    fault = F.coalesce(box_fault(box, F.col("width"), F.col("height")), F.when(F.col("l") < before, "overlap"))
    return d.withColumn("fault", fault).filter("fault IS NOT NULL").select(*page, "column_index", "fault")


def with_margin(box: Column, width: Column, height: Column, margin: int) -> Column:
    """A pixel box widened by *margin*, kept on its page."""
    return F.struct(
        F.greatest(F.lit(0), box["l"] - margin).alias("l"), F.greatest(F.lit(0), box["t"] - margin).alias("t"),
        F.least(width, box["r"] + margin).alias("r"), F.least(height, box["b"] + margin).alias("b"),
    )


def register_assets(known: DataFrame, new: DataFrame, identity: list[str], path: str, same: list[str]) -> DataFrame:
    """*new* with outcome: registered (known with equal *same* columns), changed (known, but they differ), path_taken, or new."""
    k = known.select(*identity, *[F.col(c).alias(f"_{c}") for c in same], F.lit(True).alias("_known"))
    taken = known.select(path).distinct().withColumn("_taken", F.lit(True))
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.col(f"_{c}"))
    d = new.join(k, identity, "left").join(taken, path, "left")
    out = F.when(F.col("_known") & equal, "registered").when(F.col("_known"), "changed").when(F.col("_taken"), "path_taken").otherwise("new")
    return d.withColumn("outcome", out).drop("_known", "_taken", *[f"_{c}" for c in same])


def display_assets(questions: DataFrame, assets: DataFrame, key: str) -> DataFrame:
    """The assets to show: *assets* (key, kind, path, display_order, asset_id) of questions that need a picture.

    *questions*: key, has_figure, image_options. With image options it is the first complete_question, else every question_figure; of
    one path the first."""
    d = assets.join(questions.filter("has_figure").select(key, "image_options"), key)
    d = d.filter(F.col("kind") == F.when(F.col("image_options"), "complete_question").otherwise("question_figure"))
    first = W.partitionBy(key, "path").orderBy("display_order", "asset_id")
    d = d.withColumn("_p", F.row_number().over(first)).filter("_p = 1")
    d = d.withColumn("position", F.row_number().over(W.partitionBy(key).orderBy("display_order", "asset_id")).cast("long"))
    return d.filter("NOT image_options OR position = 1").drop("_p", "image_options")


#: Types with options, and the text of an option that is a picture.
CHOICE_TYPES, IMAGE_OPTION = ("single_choice", "multiple_choice"), "见原页选项图"


def required_content(questions: DataFrame, options: DataFrame, assets: DataFrame, key: str) -> DataFrame:
    """key, has_required_image, image_options, n_options (those shown as text) and required_image_missing of each question.

    *questions*: key, figure_review_status, question_type_code; *options*: key, content; *assets*: as in ``display_assets``. A passed figure
    review makes a picture required; a choice question whose options are all pictures, or that has none, shows the complete question, every
    other its figures. A registered picture alone makes none required."""
    placeholder = F.every(F.btrim(F.coalesce("content", F.lit(""))) == IMAGE_OPTION)
    o = options.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), placeholder.alias("_pictures"))
    d = questions.join(o, key, "left")
    d = d.withColumn("n_options", F.when(F.coalesce("_pictures", F.lit(True)), 0).otherwise(F.col("_n")).cast("long"))
    need = F.coalesce(F.col("figure_review_status") == "passed", F.lit(False))
    choice = F.coalesce(F.col("question_type_code").isin(*CHOICE_TYPES), F.lit(False))
    d = d.withColumns({"has_required_image": need, "image_options": need & choice & (F.col("n_options") == 0)})
    shown = display_assets(d.select(key, F.col("has_required_image").alias("has_figure"), "image_options"), assets, key).select(key).distinct().withColumn("_shown", F.lit(True))
    d = d.join(shown, key, "left")
    return d.select(key, "has_required_image", "image_options", "n_options", (F.col("has_required_image") & F.col("_shown").isNull()).alias("required_image_missing"))
