"""Write semantics as new generations of a table: insert or ignore, upsert, guarded update, reconcile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """*table* with those of *rows* whose key it lacks (of equal keys among them, one)."""
    new = rows.dropDuplicates(key).join(table.select(*key), key, "left_anti")
    return table.unionByName(new.select(*table.columns))


def upsert(table: DataFrame, rows: DataFrame, key: list[str], values: list[str], allowed: Column | None = None) -> DataFrame:
    """Rows by key: new ones are added, known ones take the new values where *allowed* (on the old row, as ``_old_<column>``)."""
    old = table.select(*key, *[F.col(v).alias(f"_old_{v}") for v in values], F.lit(True).alias("_had"))
    new = rows.select(*key, *[F.col(v).alias(f"_new_{v}") for v in values], F.lit(True).alias("_has"))
    d = old.join(new, key, "full")
    take = F.col("_has").isNotNull() & (F.col("_had").isNull() | (F.lit(True) if allowed is None else F.coalesce(allowed, F.lit(False))))
    state = F.when(F.col("_had").isNull(), "inserted").when(F.col("_has").isNull(), "kept").when(take, "updated").otherwise("preserved")
    return d.select(*key, *[F.when(take, F.col(f"_new_{v}")).otherwise(F.col(f"_old_{v}")).alias(v) for v in values], state.alias("outcome"))


def guarded_update(table: DataFrame, changes: DataFrame, key: list[str], version: str, values: list[str]) -> DataFrame:
    """Optimistic update: a change applies if its version is the row's; outcome is updated, conflict or kept."""
    new = changes.select(*key, F.col(version).alias("_v"), *[F.col(v).alias(f"_new_{v}") for v in values])
    d = table.join(new, key, "left")
    hit = F.coalesce(F.col("_v") == F.col(version), F.lit(False))
    state = F.when(hit, "updated").when(F.col("_v").isNotNull(), "conflict").otherwise("kept")
    out = {v: F.when(hit, F.col(f"_new_{v}")).otherwise(F.col(v)) for v in values} | {"outcome": state, version: F.when(hit, F.col(version) + 1).otherwise(F.col(version))}
    return d.withColumns(out).drop("_v", *[f"_new_{v}" for v in values])


def reconcile_children(old: DataFrame, new: DataFrame, parent: list[str], position: str, value: str) -> DataFrame:
    """Children by position: action is update, insert, delete or same."""
    o = old.select(*parent, position, F.col(value).alias("old_value"), F.lit(1).alias("_o"))
    n = new.select(*parent, position, F.col(value).alias("new_value"), F.lit(1).alias("_n"))
    d = o.join(n, [*parent, position], "full")
    action = F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "delete").when(F.col("old_value").eqNullSafe(F.col("new_value")), "same").otherwise("update")
    return d.select(*parent, position, "old_value", "new_value", action.alias("action"))


def classify_reuse(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """key, action: reuse if all columns are unchanged, recrop if any changed, new if there was none."""
    o = old.select(*key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(1).alias("_had"))
    d = new.select(*key, *columns).join(o, key, "left")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return d.select(*key, F.when(F.col("_had").isNull(), "new").when(same, "reuse").otherwise("recrop").alias("action"))


def soft_delete(df: DataFrame, key: list[str], deleted: DataFrame, at: str) -> DataFrame:
    """*df* with deleted_at: *at* for rows whose key is in *deleted*."""
    gone = deleted.select(*key).distinct().withColumn("_gone", F.lit(True))
    return df.join(gone, key, "left").withColumn("deleted_at", F.when(F.col("_gone"), F.lit(at))).drop("_gone")


def reconciled(old: DataFrame, new: DataFrame, parent: list[str], position: str, values: list[str], child_id: str, references: DataFrame, reference: str) -> tuple[DataFrame, DataFrame]:
    """(children, references) after a parent's children were set by position: a position that stays keeps its id and takes the new values, a
    new one has no id yet, a surplus one goes, and what refers to it (*reference* in *references*) refers to nothing."""
    o = old.select(*parent, position, child_id, F.lit(True).alias("_o"))
    n = new.select(*parent, position, *values, F.lit(True).alias("_n"))
    d = o.join(n, [*parent, position], "full")
    children = d.filter("_n").select(*parent, position, child_id, *values)
    gone = d.filter("_o AND _n IS NULL").select(F.col(child_id).alias(reference), F.lit(True).alias("_gone"))
    kept = references.join(gone, reference, "left").withColumn(reference, F.when(F.col("_gone").isNull(), F.col(reference)))
    return children, kept.select(*references.columns)
