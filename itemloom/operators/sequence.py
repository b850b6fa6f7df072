"""Ordering, windows and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def compact_positions(df: DataFrame, group: list[str], order: list, name: str = "position") -> DataFrame:
    """Positions 1..n in each group."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("long"))


def swap_up(df: DataFrame, group: list[str], position: str, moved: Column, name: str = "new_position") -> DataFrame:
    """Move the rows where *moved* holds up by one: they change places with the row before; the first stays. At most one a group."""
    w = W.partitionBy(*group).orderBy(position)
    index = F.row_number().over(w).cast("long")
    follows = F.coalesce(F.lead(moved).over(w), F.lit(False))
    return df.withColumn(name, F.when(moved & (index > 1), index - 1).when(follows, index + 1).otherwise(index))


def neighbours(df: DataFrame, group: list[str], position: str) -> DataFrame:
    """previous_no and next_no of each row."""
    w = W.partitionBy(*group).orderBy(position)
    return df.withColumns({"previous_no": F.lag(position).over(w), "next_no": F.lead(position).over(w)})


def latest(df: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Of each key the row that is largest by *order*, found by partial aggregation (no sort of a whole group)."""
    best = F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("best")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"best.{c}") for c in columns])


def version_chain(df: DataFrame, key: list[str], version: str) -> DataFrame:
    """version_no, previous_version and status (current for the last, else superseded)."""
    w = W.partitionBy(*key).orderBy(version)
    return df.withColumns({
        "version_no": F.row_number().over(w).cast("long"),
        "previous_version": F.lag(version).over(w),
        "version_status": F.when(F.lead(version).over(w).isNull(), "current").otherwise("superseded"),
    })


def anomalies(df: DataFrame, group: list[str], order: list[str], number: str) -> DataFrame:
    """warnings (comma-joined) and confidence of numbers in reading order; the first is never flagged.

    A number seen before is a duplicate (low). One not above its predecessor is reversed (low); otherwise one that is not the
    next leaves a gap, and a gap sets medium, over a duplicate's low too."""
    n = F.col(number)
    w = W.partitionBy(*group).orderBy(*order)
    before = F.lag(n).over(w)
    seen = F.row_number().over(W.partitionBy(*group, number).orderBy(*order)) > 1
    first = before.isNull()
    marked = df.withColumns({"_first": first, "_seen": seen, "_reverse": n <= before, "_gap": (n > before) & (n != before + 1)})
    names = F.concat_ws(",", F.when(F.col("_seen"), "duplicate"), F.when(F.col("_reverse"), "reverse"), F.when(F.col("_gap"), "gap"))
    out = marked.withColumns({
        "warnings": F.when(F.col("_first"), "").otherwise(names),
        "confidence": F.when(F.col("_first") | F.col("_gap"), "medium").when(F.col("_seen") | F.col("_reverse"), "low").otherwise("medium"),
    })
    return out.drop("_first", "_seen", "_reverse", "_gap")


def fill_down(df: DataFrame, group: list[str], order: str, heading: Column) -> DataFrame:
    """heading (the last one at or above the row) and child_no (1.. below it; null on headings and before the first)."""
    w = W.partitionBy(*group).orderBy(order)
    up = w.rowsBetween(W.unboundedPreceding, 0)
    d = df.withColumn("_h", F.last(F.when(heading, F.col(order)), ignorenulls=True).over(up)).withColumn("_is", F.coalesce(heading, F.lit(False)))
    child = F.row_number().over(W.partitionBy(*group, "_h").orderBy(order)) - 1
    return d.withColumn("heading_no", F.col("_h").cast("long")).withColumn("child_no", F.when(~F.col("_is") & F.col("_h").isNotNull(), child.cast("long"))).drop("_h", "_is")


def running_total(df: DataFrame, group: list[str], order: str, value: str, name: str = "running_total", block: int = 4096) -> DataFrame:
    """Sum of *value* up to each row in the order of a long column, ties together by no rule (it must be unique).

    Two levels, so that a hot group is no single task: sums of blocks of *block* ids, running sums over the blocks, then sums
    inside each block."""
    d = df.withColumn("_b", F.floor(F.col(order) / block))
    sums = d.groupBy(*group, "_b").agg(F.sum(value).alias("_s"))
    w = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*group, "_b", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_start"))
    inside = F.sum(value).over(W.partitionBy(*group, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn("_in", inside).join(starts, [*group, "_b"]).withColumn(name, F.col("_start") + F.col("_in")).drop("_b", "_in", "_start")


def islands(df: DataFrame, group: list[str], index: str) -> DataFrame:
    """first, last and length of each run of consecutive *index* values in a group."""
    run = F.col(index) - F.row_number().over(W.partitionBy(*group).orderBy(index))
    return df.withColumn("_run", run).groupBy(*group, "_run").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count(F.lit(1)).alias("length")).drop("_run")


def spans(df: DataFrame, group: list[str], position: str) -> DataFrame:
    """Slots from each position up to the one before the next position in its group (its own alone for the last)."""
    w = W.partitionBy(*group).orderBy(position)
    return df.withColumn("stop", F.coalesce(F.lead(position).over(w) - 1, F.col(position))).withColumn("slot", F.explode(F.sequence(F.col(position), F.greatest("stop", position))))


def first_seen(df: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """Of each value in a group its first row; ``rank`` orders the values by first sight."""
    got = df.groupBy(*group, value).agg(F.min(order).alias("first_at"))
    return got.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy("first_at")).cast("long"))


def ordered_list(df: DataFrame, group: list[str], order: list[str], text: Column, sep: str = ",") -> DataFrame:
    """One text a group: its rows' *text* in order."""
    rows = F.sort_array(F.collect_list(F.struct(*order, text.alias("_t"))))
    return df.groupBy(*group).agg(F.array_join(F.transform(rows, lambda r: r["_t"]), sep).alias("items"), F.count(F.lit(1)).alias("n_items"))


def first_overflow(df: DataFrame, group: list[str], order: str, amount: str, cap: int) -> DataFrame:
    """The row of each group at which the running total of *amount* (``running``) passes *cap* for the first time, in the order of a unique
    long column; none for groups within it."""
    d = running_total(df, group, order, amount, "running").filter(F.col("running") > cap)
    first = d.groupBy(*group).agg(F.min_by(F.struct(*[c for c in d.columns if c not in group]), order).alias("_r"))
    return first.select(*group, "_r.*")


def over_caps(df: DataFrame, group: list[str], caps: dict[str, tuple]) -> DataFrame:
    """group, cap, total of each cap that a group's total passes; *caps*: name -> (aggregate column, the most it may be)."""
    totals = df.groupBy(*group).agg(*[c.cast("double").alias(n) for n, (c, _) in caps.items()])
    over = F.array_compact(F.array(*[F.when(F.col(n) > most, F.struct(F.lit(n).alias("cap"), F.col(n).alias("total"))) for n, (_, most) in caps.items()]))
    return totals.select(*group, F.explode(over).alias("_c")).select(*group, "_c.cap", "_c.total")
