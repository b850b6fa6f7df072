"""Taxonomies of three levels: parsing from Markdown lines, validation, keyed upsert, subtrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Heading and bullet patterns, and the number of modules.
MODULE = r"^## ([0-9]{2})\s+(.+?)\s*$"
TOPIC = r"^### ([0-9]{2}\.[0-9]{2})\s+(.+?)\s*$"
BULLET = r"^-\s+(.+?)\s*$"
MODULES = 11


def lines_of(files: DataFrame, path: str = "path", text: str = "value") -> DataFrame:
    """path, line_no (from 1), line."""
    return files.select(F.col(path).alias("path"), F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("_k", "line")).select("path", (F.col("_k") + 1).cast("long").alias("line_no"), "line")


def _classified(lines: DataFrame, modules: int) -> DataFrame:
    """The lines of each file from module 01 up to the first other second-level heading, with module and topic filled down."""
    module, topic, bullet = F.regexp_extract("line", MODULE, 1), F.regexp_extract("line", TOPIC, 1), F.regexp_extract("line", BULLET, 1)
    codes = [f"{k:02d}" for k in range(1, modules + 1)]
    up = W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    d = lines.withColumns({"module": F.nullif(module, F.lit("")), "topic": F.nullif(topic, F.lit("")), "bullet": F.nullif(bullet, F.lit(""))})
    d = d.withColumn("_open", F.max(F.coalesce(F.col("module") == "01", F.lit(False))).over(up)).filter("_open")
    stop = F.col("line").startswith("## ") & ~F.coalesce(F.col("module").isin(codes), F.lit(False))
    d = d.withColumn("_shut", F.max(stop).over(up)).filter("NOT _shut")
    d = d.withColumns({"in_module": F.last("module", ignorenulls=True).over(up), "_at": F.last(F.when(F.col("module").isNotNull() | F.col("topic").isNotNull(), F.coalesce("topic", F.lit(""))), ignorenulls=True).over(up)})
    d = d.withColumn("in_topic", F.nullif(F.col("_at"), F.lit("")))
    d = d.withColumn("_head", F.last(F.when(F.col("module").isNotNull() | F.col("topic").isNotNull(), F.col("line_no")), ignorenulls=True).over(up))
    child = F.count("bullet").over(W.partitionBy("path", "_head").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn("child_no", child).drop("_open", "_shut", "_at")


def parse(lines: DataFrame, modules: int = MODULES) -> DataFrame:
    """path, line_no, code, name, level, parent_code, sort_order: modules, topics and bullets (numbered under their topic)."""
    d = _classified(lines, modules).filter("module IS NOT NULL OR topic IS NOT NULL OR (bullet IS NOT NULL AND in_topic IS NOT NULL)")
    level = F.when(F.col("module").isNotNull(), 1).when(F.col("topic").isNotNull(), 2).otherwise(3)
    at = F.concat("in_topic", F.lit("."), F.when(F.col("child_no") < 100, F.lpad(F.col("child_no").cast("string"), 2, "0")).otherwise(F.col("child_no").cast("string")))
    return d.select(
        "path", "line_no", F.coalesce("module", "topic", at).alias("code"),
        F.when(level == 1, F.regexp_extract("line", MODULE, 2)).when(level == 2, F.regexp_extract("line", TOPIC, 2)).otherwise(F.col("bullet")).alias("name"),
        level.alias("level"), F.when(level == 2, F.col("in_module")).when(level == 3, F.col("in_topic")).alias("parent_code"),
        F.when(level == 1, F.col("module").try_cast("long")).when(level == 2, F.substring("topic", 4, 2).try_cast("long")).otherwise(F.col("child_no")).alias("sort_order"),
    )


def faults(lines: DataFrame, modules: int = MODULES) -> DataFrame:
    """path, line_no, fault: everything that makes a file no taxonomy (a valid file has no rows)."""
    d = _classified(lines, modules)
    row = F.array_compact(F.array(
        F.when(F.col("line").startswith("### ") & F.col("topic").isNull(), "bad_topic_heading"),
        F.when(F.col("topic").isNotNull() & ~F.substring("topic", 1, 2).eqNullSafe(F.col("in_module")), "topic_outside_module"),
        F.when(F.col("bullet").isNotNull() & F.col("in_topic").isNull(), "bullet_outside_topic"),
    ))
    found = d.select("path", "line_no", F.explode(row).alias("fault"))
    points = parse(lines, modules)
    again = points.filter("level < 3").withColumn("_n", F.row_number().over(W.partitionBy("path", "code").orderBy("line_no"))).filter("_n > 1")
    same = d.filter("bullet IS NOT NULL AND in_topic IS NOT NULL").withColumn("_n", F.row_number().over(W.partitionBy("path", "_head", "bullet").orderBy("line_no"))).filter("_n > 1")
    empty = points.filter("level = 2").join(points.filter("level = 3").select("path", F.col("parent_code").alias("code")), ["path", "code"], "left_anti")
    seen = points.filter("level = 1").groupBy("path").agg(F.collect_set("code").alias("_seen"))
    wanted = F.array(*[F.lit(f"{k:02d}") for k in range(1, modules + 1)])
    short = lines.select("path").distinct().join(seen, "path", "left").filter(F.size(F.array_except(wanted, F.coalesce("_seen", F.array().cast("array<string>")))) > 0)
    out = found
    for part, name in ((again, "repeated_code"), (same, "repeated_name"), (empty, "topic_without_points")):
        out = out.unionByName(part.select("path", "line_no", F.lit(name).alias("fault")))
    return out.unionByName(short.select("path", F.lit(None).cast("long").alias("line_no"), F.lit("modules_missing").alias("fault")))


def hierarchy_faults(points: DataFrame) -> DataFrame:
    """code, fault of a table code, name, level, parent_code: levels, parents, repeated codes and sibling names."""
    p = points.select(F.col("code").alias("_pc"), F.col("level").alias("_pl")).dropDuplicates(["_pc"])
    d = points.join(p, F.col("parent_code") == F.col("_pc"), "left")
    row = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("level").between(1, 3), F.lit(False)), "level"),
        F.when((F.col("level") == 1) & F.col("parent_code").isNotNull(), "parent_of_module"),
        F.when((F.col("level") > 1) & ~F.coalesce(F.col("_pl") == F.col("level") - 1, F.lit(False)), "parent"),
    ))
    out = d.select("code", F.explode(row).alias("fault"))
    codes = points.groupBy("code").count().filter("count > 1").select("code", F.lit("repeated_code").alias("fault"))
    names = points.withColumn("_n", F.row_number().over(W.partitionBy("parent_code", "name").orderBy("code"))).filter("_n > 1")
    return out.unionByName(codes).unionByName(names.select("code", F.lit("repeated_name").alias("fault")))


def changes(known: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """code, action (insert, update, keep, absent) of a keyed upsert that writes only what changed."""
    o = known.select("code", *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_o"))
    n = new.select("code", *columns, F.lit(True).alias("_n"))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    d = o.join(n, "code", "full")
    return d.select("code", F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "absent").when(same, "keep").otherwise("update").alias("action"))


def allowed_codes(points: DataFrame) -> DataFrame:
    """parent_code, allowed: the codes below each parent, sorted (a parent's children are a bounded dictionary)."""
    return points.filter("parent_code IS NOT NULL").groupBy("parent_code").agg(F.sort_array(F.collect_list("code")).alias("allowed"))
