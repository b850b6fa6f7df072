"""Deletion over a whole graph of references: cascade, restrict and set-null in one plan.

The references are data. Deletion starts from root rows and goes through the tables in topological order, parents first; each row that goes
carries the roots it goes with. A row that a restricting reference still ties to such a row forbids its roots, and a forbidden root takes
nothing along: what else would go with it alone, stays. All of it is equi-joins of keys on the references' columns; only a table that
cascades into itself needs rounds, as a chain may have any length (each round is written, so lineage stays short).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.sources import work_folder

ACTIONS = ("cascade", "restrict", "null")


@dataclass(frozen=True)
class Reference:
    """*column* of *child* holds keys of *parent*; *action* is what a parent's deletion does."""

    child: str
    column: str
    parent: str
    action: str

    def __post_init__(self):
        if self.action not in ACTIONS:
            raise ValueError(self.action)


def reading_order(references: list[Reference], tables: list[str]) -> list[str]:
    """The tables, parents first. References of a table to itself do not count; any other cycle raises."""
    graph = {t: set() for t in tables}
    for r in references:
        if r.child != r.parent:
            graph[r.child].add(r.parent)
    try:
        return list(TopologicalSorter(graph).static_order())
    except CycleError as e:
        raise ValueError(f"references go round: {' -> '.join(e.args[1])}") from e


def _written(df: DataFrame) -> DataFrame:
    path = work_folder(df.sparkSession, "references")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _with_descendants(gone: DataFrame, rows: DataFrame, key: str, column: str) -> DataFrame:
    """*gone* (key, root) with all rows below by *column*, which refers to *key* of the same table."""
    down = rows.filter(F.col(column).isNotNull()).select(F.col(key).alias("_child"), F.col(column).alias("key"))
    every = last = _written(gone.distinct())
    while not last.isEmpty():
        below = last.join(down, "key").select(F.col("_child").alias("key"), "root").distinct()
        last = _written(below.join(every, ["key", "root"], "left_anti"))  # a row that refers to its own descendant ends here too
        every = every.unionByName(last)
    return every


def deletion(tables: dict[str, DataFrame], keys: dict[str, str], references: list[Reference], root: str, doomed: DataFrame) -> dict[str, DataFrame]:
    """What deleting the rows *doomed* (a column named as the key of *root*) does: ``deleted`` (relation, key), ``nulled`` (relation,
    column, key: references that become null) and ``forbidden`` (root, relation, column, key: each row that restricts, and whom).

    *tables* hold their keys and reference columns; keys are compared as they are, so a key column and what refers to it share a type."""
    own = keys[root]
    gone: dict[str, DataFrame] = {root: tables[root].join(doomed.select(own).distinct(), own, "left_semi").select(F.col(own).alias("key"), F.col(own).alias("root"))}
    ties: list[DataFrame] = []
    loose: list[tuple[Reference, DataFrame]] = []
    for t in reading_order(references, list(tables)):
        into = [r for r in references if r.child == t and r.parent != t and r.parent in gone and r.action == "cascade"]
        found = [tables[t].select(F.col(keys[t]).alias("_k"), F.col(r.column).alias("key")).join(gone[r.parent], "key").select(F.col("_k").alias("key"), "root") for r in into]
        if found or t in gone:
            gone[t] = reduce(DataFrame.unionByName, found + ([gone[t]] if t in gone else [])).distinct()
            for r in references:
                if r.child == r.parent == t and r.action == "cascade":
                    gone[t] = _with_descendants(gone[t], tables[t], keys[t], r.column)
    for r in references:
        if r.action == "cascade" or r.parent not in gone:
            continue
        held = tables[r.child].select(F.col(keys[r.child]).alias("_k"), F.col(r.column).alias("key")).join(gone[r.parent], "key").select(F.col("_k").alias("key"), "root")
        if r.action == "restrict":
            ties.append(held.select("root", F.lit(r.child).alias("relation"), F.lit(r.column).alias("column"), "key"))
        else:
            loose.append((r, held))
    none = gone[root].limit(0).select("root", F.lit("").alias("relation"), F.lit("").alias("column"), "key")
    forbidden = reduce(DataFrame.unionByName, ties, none)
    allowed = lambda d: d.join(forbidden.select("root").distinct(), "root", "left_anti")
    deleted = {t: allowed(d).select("key").distinct() for t, d in gone.items()}
    rows = [d.select(F.lit(t).alias("relation"), "key") for t, d in deleted.items()]
    nulled = gone[root].limit(0).select(F.lit("").alias("relation"), F.lit("").alias("column"), "key")
    for r, held in loose:
        stays = allowed(held).select("key").distinct()
        if r.child in deleted:
            stays = stays.join(deleted[r.child], "key", "left_anti")
        nulled = nulled.unionByName(stays.select(F.lit(r.child).alias("relation"), F.lit(r.column).alias("column"), "key"))
    return {"deleted": reduce(DataFrame.unionByName, rows), "nulled": nulled, "forbidden": forbidden}


def after(tables: dict[str, DataFrame], keys: dict[str, str], done: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """*tables* once a ``deletion`` is carried out."""
    out = {}
    for t, df in tables.items():
        of = lambda kind, t=t: done[kind].filter(F.col("relation") == t)
        left = df.join(of("deleted").select(F.col("key").alias(keys[t])), keys[t], "left_anti")
        empty = of("nulled").groupBy(F.col("key").alias(keys[t])).agg(F.collect_set("column").alias("_empty"))  # a table's references are few
        left = left.join(empty, keys[t], "left")
        out[t] = left.select(*[F.when(~F.coalesce(F.array_contains("_empty", c), F.lit(False)), F.col(c)).alias(c) if c != keys[t] else F.col(c) for c in df.columns])
    return out
