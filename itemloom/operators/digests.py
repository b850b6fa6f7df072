"""Digests: order-free, sensitive to any protected column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_text(columns: list[Column]) -> Column:
    """One text a row; nulls are spelled, so they differ from empty texts."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns])


def group_digest(df: DataFrame, group: list[str], columns: list[Column]) -> DataFrame:
    """SHA-256 of a group's sorted row texts. A group's rows meet in one place: for groups of bounded size."""
    t = df.select(*group, row_text(columns).alias("_t"))
    return t.groupBy(*group).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("_t")), "\n"), 256).alias("digest"), F.count(F.lit(1)).alias("n_rows"))


def table_digest(df: DataFrame, columns: list[Column], buckets: int = 4096) -> DataFrame:
    """One digest of a whole table of any size: rows are hashed, hashes are summed by bucket as decimals (order-free), and the
    buckets' sums are hashed in order."""
    h = df.select(F.sha2(row_text(columns), 256).alias("h"))
    half = lambda a: F.conv(F.substring("h", a, 15), 16, 10).cast("decimal(38,0)")
    b = h.groupBy(F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("b")).agg(F.sum(half(1)).alias("x"), F.sum(half(16)).alias("y"), F.count(F.lit(1)).alias("n"))
    return b.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "n", "x", "y"))), lambda r: F.concat_ws(":", r["b"], r["n"], r["x"], r["y"])), "\n"), 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


def code_digest(df: DataFrame, group: list[str], code: str) -> DataFrame:
    """SHA-256 of a group's codes as a sorted JSON list. A group's codes are few."""
    return df.groupBy(*group).agg(F.sha2(F.to_json(F.sort_array(F.collect_list(code))), 256).alias("digest"))


def answer_text(number: Column, answer: Column, analysis: Column, subquestions: Column) -> Column:
    """Canonical JSON of what an answer's digest covers: keys in order, missing texts empty, subquestions
    (array<struct<label, stem, answer, analysis>>) in their order."""
    text = lambda c: F.coalesce(c, F.lit(""))
    parts = F.transform(F.coalesce(subquestions, F.array().cast("array<struct<label:string,stem:string,answer:string,analysis:string>>")), lambda q: F.struct(text(q["analysis"]).alias("analysis_markdown"), text(q["answer"]).alias("answer_markdown"), text(q["label"]).alias("label"), text(q["stem"]).alias("stem_markdown")))
    return F.to_json(F.struct(text(analysis).alias("analysis_markdown"), text(answer).alias("answer_markdown"), number.alias("source_question_no"), parts.alias("subquestions")))


def input_digest(df: DataFrame, group: list[str], number: str, columns: list[Column]) -> DataFrame:
    """SHA-256 of a group's row texts in the order of their numbers, which matters. A batch's rows are few."""
    t = df.select(*group, F.struct(F.col(number).try_cast("int").alias("n"), F.col(number).alias("no"), row_text(columns).alias("t")).alias("_t"))
    return t.groupBy(*group).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("_t")), lambda x: x["t"]), "\n"), 256).alias("digest"))


def tables_digest(tables: dict[str, tuple[DataFrame, list[str]]], group: str) -> DataFrame:
    """group, digest over several tables (each with the columns that count, the others are exempt), restricted to a group's rows; a group
    that a table lacks counts as having no rows there."""
    parts = None
    for name, (df, columns) in sorted(tables.items()):
        one = group_digest(df, [group], [F.col(c) for c in columns]).select(group, F.concat(F.lit(f"{name}:"), F.col("n_rows").cast("string"), F.lit(":"), F.col("digest")).alias("_p"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy(group).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("_p")), "\n"), 256).alias("digest"))


def drifted(stored: DataFrame, now: DataFrame, key: list[str]) -> DataFrame:
    """key, drift (missing, new, changed or none) of digests taken at two times."""
    n = now.select(*key, F.col("digest").alias("_now"))
    d = stored.select(*key, F.col("digest").alias("_then")).join(n, key, "full")
    return d.select(*key, F.when(F.col("_now").isNull(), "missing").when(F.col("_then").isNull(), "new").when(F.col("_now") != F.col("_then"), "changed").otherwise("none").alias("drift"))
