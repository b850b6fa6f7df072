"""Labels of subquestions: a main number in brackets, then maybe a roman or circled child; grouping into a tree if nothing is irregular."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itemloom.functions import strip

#: Child labels by their number.
ROMAN = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x"]
CIRCLED = ["①", "②", "③", "④", "⑤", "⑥", "⑦", "⑧", "⑨", "⑩"]
_MAIN = r"(?:（[0-9]+）|\([0-9]+\))"
_ROMAN = "|".join(sorted(ROMAN, key=len, reverse=True))
_CHILD = rf"(?:（(?:{_ROMAN})）|\((?:{_ROMAN})\)|[{''.join(CIRCLED)}])"
LABEL = rf"(?i)^({_MAIN})({_CHILD})?$"
PREFIX = rf"(?i)^\s*({_MAIN}(?:{_CHILD})?)\s*"


def stored_label(stem: Column) -> Column:
    """The label that a stem starts with, or an empty text."""
    return F.regexp_extract(stem, PREFIX, 1)


def without_label(stem: Column) -> Column:
    return F.regexp_replace(stem, PREFIX, "")


def main_number(label: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(label, LABEL, 1), "([0-9]+)", 1).try_cast("long")


def child_number(label: Column) -> Column:
    """1 to 10; null for a bare main label."""
    child = F.lower(F.regexp_replace(F.regexp_extract(label, LABEL, 2), "[()（）]", ""))
    numbers = F.create_map(*[F.lit(x) for names in (ROMAN, CIRCLED) for k, name in enumerate(names, 1) for x in (name, k)])
    return F.try_element_at(numbers, F.nullif(child, F.lit("")))


def group_labels(df: DataFrame, key: list[str], position: str, label: str = "label") -> DataFrame:
    """*df* with main_no, child_no, grouped and needs_review (both for the whole of a question).

    Mains start at 1 and rise by 1, each in one run of rows; a bare main comes once and before its children; children count from 1.
    One irregular row leaves the whole question flat (main_no and child_no null) and in need of review."""
    text = strip(F.coalesce(F.col(label), F.lit("")))
    w = W.partitionBy(*key).orderBy(position)
    d = df.withColumns({"_m": main_number(text), "_c": child_number(text)})
    d = d.withColumns({"_pm": F.coalesce(F.lag("_m").over(w), F.lit(0)), "_pc": F.coalesce(F.lag("_c").over(w), F.lit(0))})
    opens = (F.col("_m") == F.col("_pm") + 1) & (F.coalesce("_c", F.lit(1)) == 1)
    follows = (F.col("_m") == F.col("_pm")) & (F.col("_c") == F.col("_pc") + 1)
    d = d.withColumn("_ok", F.coalesce(opens, F.lit(False)) | F.coalesce(follows, F.lit(False)))
    d = d.withColumn("grouped", F.every("_ok").over(W.partitionBy(*key))).withColumn("needs_review", ~F.col("grouped"))
    return d.withColumns({"main_no": F.when(F.col("grouped"), F.col("_m")), "child_no": F.when(F.col("grouped"), F.col("_c"))}).drop("_m", "_c", "_pm", "_pc", "_ok")
