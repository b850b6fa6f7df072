"""A tree kept as a table: upsert of rows that name their parents by code, with ids given parents first, and its faults.

Rows are resolved a level at a time: roots, then what names a resolved parent, as deep as the tree goes; each round joins the rows of
the last level only and is written, so that lineage stays short. What is never reached names a parent that is missing, or goes round; both
are reported and nothing below them is written. New rows get the ids after the largest known one by level, order and code; they are numbered
from counts of ranges, so no task sees all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itemloom.sources import tasks_for, work_folder


def _written(df: DataFrame) -> DataFrame:
    path = work_folder(df.sparkSession, "hierarchy")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str, start: Column | int = 0) -> DataFrame:
    """*df* with *name*: start + 0, 1, ... by *order* (which tells rows apart), without one task for all rows: a range's rows are numbered
    after the counts of the ranges before it."""
    # Spark's own increasing id is the range's number above 33 bits and the row's place in it below, so no window holds a range.
    at = F.monotonically_increasing_id()
    parts = _written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at))
    parts = parts.withColumn("_part", F.shiftright("_at", 33)).withColumn("_own", F.col("_at").bitwiseAND((1 << 33) - 1))
    before = F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select("_part", before.alias("_before"))  # a row a range
    first = start if isinstance(start, Column) else F.lit(start)
    return parts.join(F.broadcast(starts), "_part").withColumn(name, (first + F.col("_before") + F.col("_own")).cast("long")).drop("_at", "_part", "_own", "_before")


def levels(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(code, depth of rows (code, parent_code) that hang on a root; code, fault of the others: parent_missing, below_missing, cycle).

    Codes are distinct; a null parent_code is a root."""
    edges = _written(rows.select("code", "parent_code"))
    level = _written(edges.filter("parent_code IS NULL").select("code", F.lit(1).cast("long").alias("depth")))
    reached = level
    while not level.isEmpty():
        below = edges.join(level.select(F.col("code").alias("parent_code"), "depth"), "parent_code")
        level = _written(below.select("code", (F.col("depth") + 1).alias("depth")))
        reached = reached.unionByName(level)
    lost = _written(edges.join(reached.select("code"), "code", "left_anti"))
    level = _written(lost.join(edges.select(F.col("code").alias("parent_code")), "parent_code", "left_anti").select("code", F.lit("parent_missing").alias("fault")))
    faults = level
    while not level.isEmpty():
        level = _written(lost.join(level.select(F.col("code").alias("parent_code")), "parent_code").select("code", F.lit("below_missing").alias("fault")))
        faults = faults.unionByName(level)
    return reached, faults.unionByName(lost.join(faults.select("code"), "code", "left_anti").select("code", F.lit("cycle").alias("fault")))


def upsert(known: DataFrame, new: DataFrame, columns: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(the table after the upsert: id, code, parent_id, *columns* and action; faults: code, fault).

    *known*: id, code, parent_id, *columns*; *new*: code, parent_code, *columns*, and *order*, the place of a row among those of its depth.
    Codes keep their ids; rows that differ in a column or their parent are ``update``, others ``keep``, codes that *new* lacks
    ``absent`` (they stay as they are), new codes ``insert``. A code twice in *new* is the fault repeated_code, none of its rows is taken. What
    hangs on a fault keeps its known row, if there is one, with the action ``absent``."""
    new = _written(new)
    n = tasks_for(new)
    # Dealt by code to as many tasks as the rows need, and written after every few joins: a task then holds the same number of rows, and of sorts, at any size.
    new = new.repartition(n, "code")
    again = _written(new.groupBy("code").count().filter("count > 1").select("code", F.lit("repeated_code").alias("fault")))
    once = _written(new.join(again.select("code"), "code", "left_anti"))
    depth, lost = levels(once)
    rows = once.repartition(n, "code").join(depth, "code")
    taken = known.select("code", F.col("id").alias("_id"), F.col("parent_id").alias("_parent"), *[F.col(c).alias(f"_{c}") for c in columns])
    d = _written(rows.join(taken, "code", "left"))
    last = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = numbered(d.filter("_id IS NULL").select("code", "depth", F.col(order).alias("_order")), ["depth", "_order", "code"], "_new", last + 1).select("code", "_new")
    ids = _written(d.repartition(n, "code").join(fresh, "code", "left").withColumn("id", F.coalesce("_id", "_new")).drop("_new"))
    parents = ids.select(F.col("code").alias("parent_code"), F.col("id").alias("parent_id"))
    d = ids.join(parents, "parent_code", "left")  # not dealt by number: a parent of many rows is a skewed key, which Spark splits
    same = F.col("parent_id").eqNullSafe(F.col("_parent"))
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    action = F.when(F.col("_id").isNull(), "insert").when(same, "keep").otherwise("update")
    put = d.select("id", "code", "parent_id", *columns, action.alias("action"))
    rest = known.join(ids.select("code"), "code", "left_anti").select("id", "code", "parent_id", *columns, F.lit("absent").alias("action"))
    return put.unionByName(rest), again.unionByName(lost)
