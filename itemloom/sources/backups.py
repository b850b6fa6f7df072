"""Backups: a copy of tables with a manifest of its files, and a check that sees nothing but the copy.

Tables are written as Parquet, in files of a bounded number of rows. The manifest has a row a file: its bytes, its SHA-256 and its rows. It
is sealed by a digest that the caller keeps (in the row of the run that the backup belongs to). ``faults`` reads the copy, finds files
that changed, vanished or came to it, a manifest that is not the sealed one, and references that lead nowhere; tables with damaged files
are not read as tables, so a damaged file cannot stop the check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.operators.digests import table_digest

MANIFEST = "manifest"
MAX_ROWS_A_FILE = 1_000_000
_COLUMNS = ["relation", "file", "bytes", "sha256", "n_rows"]
FAULT = "relation string, file string, fault string"


def _files(spark: SparkSession, path: str) -> DataFrame:
    """relation, file, bytes, sha256 of the data files in the copy."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    d = every.select(F.element_at(F.split("path", "/"), -2).alias("relation"), F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return d.filter(F.col("relation") != MANIFEST)


def _sealed(manifest: DataFrame) -> str:
    return table_digest(manifest.select(*_COLUMNS), [F.col(c) for c in _COLUMNS]).first()["digest"]


def write(tables: dict[str, DataFrame], path: str) -> str:
    """Copy *tables* to *path* and return the seal of the manifest written beside them."""
    if MANIFEST in tables:
        raise ValueError(f"a table may not be named {MANIFEST}")
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.option("maxRecordsPerFile", MAX_ROWS_A_FILE).parquet(f"{path}/{name}")
    counts = [spark.read.parquet(f"{path}/{name}").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("relation", F.lit(name)) for name in tables]
    d = _files(spark, path).join(reduce(DataFrame.unionByName, counts), ["relation", "file"], "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    d.select(*_COLUMNS).write.parquet(f"{path}/{MANIFEST}")
    return _sealed(spark.read.parquet(f"{path}/{MANIFEST}"))


def faults(spark: SparkSession, path: str, seal: str, references: list[tuple[str, str, str, str]] = ()) -> DataFrame:
    """relation, file, fault of the copy in *path*: manifest (not the sealed one), missing, extra, changed, and for each of *references* (child,
    key, parent, key) reference:<key> if a value leads nowhere, or unchecked:<key> where either table has faults."""
    manifest = spark.read.parquet(f"{path}/{MANIFEST}")
    now = _files(spark, path).select("relation", "file", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"))
    d = manifest.join(now, ["relation", "file"], "full")
    fault = F.when(F.col("_sha").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when((F.col("bytes") != F.col("_bytes")) | (F.col("sha256") != F.col("_sha")), "changed")
    found = d.withColumn("fault", fault).filter("fault IS NOT NULL").select("relation", "file", "fault")
    rows = [] if _sealed(manifest) == seal else [(MANIFEST, None, "manifest")]
    bad = {r["relation"] for r in found.select("relation").distinct().collect()}  # names of tables
    whole = {r["relation"]: r["n"] for r in manifest.groupBy("relation").agg(F.sum("n_rows").alias("n")).collect()}
    out = found
    for child, key, parent, other in references:
        if bad & {child, parent} or not {child, parent} <= whole.keys():
            rows.append((child, None, f"unchecked:{key}"))
            continue
        c, p = spark.read.parquet(f"{path}/{child}"), spark.read.parquet(f"{path}/{parent}")
        lost = c.filter(F.col(key).isNotNull()).join(p.select(F.col(other).alias(key)), key, "left_anti")
        out = out.unionByName(lost.limit(1).select(F.lit(child).alias("relation"), F.lit(None).cast("string").alias("file"), F.lit(f"reference:{key}").alias("fault")))
    return out.unionByName(spark.createDataFrame(rows, FAULT))
