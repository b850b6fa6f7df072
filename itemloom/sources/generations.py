"""Tables as generations: a whole set of tables is written to a new folder, checked, and then published by one log entry.

A store is a folder with ``gen-<token>/<table>`` folders of Parquet and ``log/<place>`` entries. An entry is made with an exclusive
create at the place behind the last, so of two writers that publish the same number one fails (``Conflict``) and nothing of it is seen; a
writer that dies leaves an empty place, which is passed over. Readers take the last entry that is whole. An old generation never changes; a crash leaves an unpublished folder and no mixed state. Everything goes through
Hadoop's file systems, so a store may lie wherever Spark can write (one with an atomic exclusive create).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer published first."""


class Rejected(ValueError):
    """A check found rows; nothing was published."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _entries(spark: SparkSession, root: str, empty: bool = False) -> list[tuple[int, str]]:
    """(number, name) of the log's entries; those that are *empty* belong to writers that are at work or died."""
    p, fs = _fs(spark, f"{root}/log")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if empty or s.getLen() > 0]
    return sorted((int(n), n) for n in names if n.isdigit())


def current(spark: SparkSession, root: str) -> dict | None:
    """The published entry (number, folder, tables), or None for a store that has none (it is not created)."""
    for _, name in reversed(_entries(spark, root)):
        text = spark.read.text(f"{root}/log/{name}", wholetext=True).first()
        try:
            entry = json.loads(text["value"]) if text else {}
        except ValueError:
            continue  # being written
        if "number" in entry:
            return entry
    return None


def read(spark: SparkSession, root: str, name: str, entry: dict | None = None) -> DataFrame | None:
    """A table of the published generation (or of *entry*, for a stable view of several), or None."""
    entry = entry or current(spark, root)
    if entry is None or name not in entry["tables"]:
        return None
    folder = entry["tables"][name]
    return spark.read.parquet(f"{root}/{folder}/{name}")


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], expected: int | None = None, checks: list[Callable[[dict[str, DataFrame]], DataFrame]] = ()) -> dict:
    """Write *tables* as a new generation and publish it; tables not named stay those of the last one.

    *checks* get the written tables, reread, and return violations: one row is enough to reject. *expected* is the number of the
    generation that the tables were made from (the published one, if None); if another was published since, ``Conflict``."""
    last = current(spark, root)
    number = last["number"] if last else 0
    if expected is not None and expected != number:
        raise Conflict(f"generation {number} was published, not {expected}")
    folder = f"gen-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{folder}/{name}")
    known = dict(last["tables"]) if last else {}
    known |= dict.fromkeys(tables, folder)
    entry = {"number": number + 1, "folder": folder, "tables": known}
    whole = {name: spark.read.parquet(f"{root}/{at}/{name}") for name, at in known.items()}
    for check in checks:
        bad = check(whole)
        if not bad.isEmpty():
            p, fs = _fs(spark, f"{root}/{folder}")
            fs.delete(p, True)
            raise Rejected(f"{check.__name__} found violations")
    _claim(spark, root, entry)
    return entry


def _claim(spark: SparkSession, root: str, entry: dict) -> None:
    """Put *entry* behind the last name in the log, so that a name that a dead writer left empty is passed over.

    Another writer's whole entry of this number, before or after the exclusive create, is a conflict."""
    names = _entries(spark, root, empty=True)
    name = f"{(names[-1][0] if names else 0) + 1:012d}"
    p, fs = _fs(spark, f"{root}/log/{name}")
    try:
        out = fs.create(p, False)
    except Exception as e:
        if fs.exists(p):
            raise Conflict(f"generation {entry['number']} was published by another writer") from e
        raise
    last = current(spark, root)
    if last and last["number"] >= entry["number"]:
        out.close()
        fs.delete(p, False)
        raise Conflict(f"generation {entry['number']} was published by another writer")
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()


def prune(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete the folders that none of the last *keep* entries uses, and older entries. No writer may be at work."""
    names = _entries(spark, root)
    for _, n in names[:-keep]:
        p, fs = _fs(spark, f"{root}/log/{n}")
        fs.delete(p, False)
    used = set()
    for _, n in names[-keep:]:
        used |= set(json.loads(spark.read.text(f"{root}/log/{n}", wholetext=True).first()["value"])["tables"].values())
    p, fs = _fs(spark, root)
    for s in fs.listStatus(p):
        if s.getPath().getName().startswith("gen-") and s.getPath().getName() not in used:
            fs.delete(s.getPath(), True)


def artifacts(spark: SparkSession, path: str, max_bytes: int = 16 << 20) -> DataFrame:
    """path, length, sha256, text of files; a file over *max_bytes* has null text and digest (its content isn't kept)."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = F.col("length") <= max_bytes
    return d.select("path", "length", F.when(small, F.sha2("content", 256)).alias("sha256"), F.when(small, F.try_validate_utf8(F.col("content").cast("string"))).alias("text"))


def changed_artifacts(before: DataFrame, now: DataFrame) -> DataFrame:
    """path of files of *before* that are missing in *now* or have another digest (none is a change too)."""
    n = now.select("path", F.col("sha256").alias("_now"))
    return before.join(n, "path", "left").filter(F.col("sha256").isNull() | F.col("_now").isNull() | (F.col("sha256") != F.col("_now"))).select("path")


def intake(spark: SparkSession, path: str, known: DataFrame, region: str, year: int, kind: str, max_bytes: int = 50 << 20) -> DataFrame:
    """path, sha256, outcome, archive_path of incoming PDF files.

    Empty files give no row (Spark's reader skips them). outcome: bad_name (no .pdf), bad_size (over *max_bytes*), bad_header, known (its digest is in *known*.sha256), repeated
    (a smaller path in this batch has its digest) or new; only new files get an archive path."""
    d = spark.read.format("binaryFile").load(path)
    d = d.select("path", "length", F.sha2("content", 256).alias("sha256"), (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("_head"))
    first = d.groupBy("sha256").agg(F.min("path").alias("_first"))
    d = d.join(first, "sha256").join(known.select("sha256").distinct().withColumn("_known", F.lit(True)), "sha256", "left")
    out = F.when(~F.lower("path").endswith(".pdf"), "bad_name").when(F.col("length") > max_bytes, "bad_size").when(~F.col("_head"), "bad_header")
    out = out.when(F.col("_known"), "known").when(F.col("path") != F.col("_first"), "repeated").otherwise("new")
    d = d.withColumn("outcome", out)
    name = F.concat(F.lit(f"raw_papers/{region}/{year}/{year}-{region}-{kind}-"), F.substring("sha256", 1, 12), F.lit(".pdf"))
    return d.select("path", "sha256", "outcome", F.when(F.col("outcome") == "new", name).alias("archive_path"))


def documents(artifacts: DataFrame, schema) -> DataFrame:
    """path, document (a struct of *schema*) of the texts of ``artifacts``; a damaged or missing text gives null, and so does one behind
    whose value more follows (Spark's own parser would take it)."""

    @F.pandas_udf("boolean")
    def whole(texts: pd.Series) -> pd.Series:
        return pd.Series([_is_object(t) for t in texts], dtype=object)

    return artifacts.select("path", F.when(whole("text"), F.from_json("text", schema)).alias("document"))


def _is_object(text: str | None) -> bool:
    try:
        return text is not None and isinstance(json.loads(text), dict)
    except ValueError:
        return False


def backup_faults(before: dict[str, DataFrame], copy: dict[str, DataFrame], references: list[tuple[str, str, str, str]]) -> DataFrame:
    """table, fault of a backup: rows that differ from the original (both ways, as often), tables that are missing, and references
    (child, key, parent, key) that lead nowhere in the copy."""
    out = None
    spark = next(iter(before.values())).sparkSession
    add = lambda one: one if out is None else out.unionByName(one)
    for name, df in sorted(before.items()):
        if name not in copy:
            out = add(spark.createDataFrame([(name, "missing")], "table string, fault string"))
            continue
        out = add(df.exceptAll(copy[name]).unionByName(copy[name].exceptAll(df)).limit(1).select(F.lit(name).alias("table"), F.lit("rows").alias("fault")))
    for child, key, parent, other in references:
        lost = copy[child].filter(F.col(key).isNotNull()).join(copy[parent].select(F.col(other).alias(key)), key, "left_anti")
        out = add(lost.limit(1).select(F.lit(child).alias("table"), F.lit(f"reference:{key}").alias("fault")))
    return out


def seed_text(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One row: a small table as a JSON list of objects in order, the text of a seed file. Dictionaries only."""
    one = rows.agg(F.sort_array(F.collect_list(F.struct(order, F.struct(*columns).alias("r")))).alias("_r"))
    return one.select(F.to_json(F.transform("_r", lambda x: x["r"]), {"ignoreNullFields": "false"}).alias("text"))


def seed_rows(text: DataFrame, schema: str) -> DataFrame:
    """The rows of a seed file's ``text`` (a JSON list of objects of *schema*)."""
    return text.select(F.explode(F.from_json("text", f"array<struct<{schema}>>")).alias("r")).select("r.*")
