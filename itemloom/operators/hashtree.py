"""Where two snapshots of a table differ, by a tree of digests over buckets of its key.

A snapshot keeps its rows by bucket (2^(bits * depth) of them, by hash of the key) and, for each level of the tree, a digest a node: a leaf's is
over its rows in any order, a node's over its children's. Two snapshots are compared from the root down; only children of nodes that differ
are looked at, and at last only rows of buckets that differ are read, by partition pruning. So a comparison reads in proportion to the change,
and the driver gets the names of buckets that differ, of which there are no more than leaves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemloom.operators.digests import row_text

BITS, DEPTH = 4, 2
TREE = "node int, n long, digest string, level int"


def write_snapshot(df: DataFrame, path: str, key: list[str], bits: int = BITS, depth: int = DEPTH) -> None:
    """Keep *df* and its tree in *path*. The key tells rows apart; all columns count."""
    spark = df.sparkSession
    df.limit(0).write.parquet(f"{path}/schema")
    bucket = F.pmod(F.xxhash64(*key), F.lit(1 << (bits * depth))).cast("int")
    df.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/rows")
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{path}/rows")
    half = lambda a: F.conv(F.substring("h", a, 15), 16, 10).cast("decimal(38,0)")
    hashed = rows.select("bucket", F.sha2(row_text([F.col(c) for c in sorted(df.columns)]), 256).alias("h"))
    leaf = hashed.groupBy("bucket").agg(F.sum(half(1)).alias("x"), F.sum(half(16)).alias("y"), F.count(F.lit(1)).alias("n"))
    nodes = leaf.select(F.col("bucket").alias("node"), "n", F.sha2(F.concat_ws(":", "n", "x", "y"), 256).alias("digest"))
    for level in range(depth, -1, -1):
        nodes.withColumn("level", F.lit(level)).coalesce(1).write.mode("append").partitionBy("level").parquet(f"{path}/tree")
        nodes = spark.read.schema(TREE).parquet(f"{path}/tree").filter(F.col("level") == level)
        child = F.struct("node", "digest")
        nodes = nodes.groupBy(F.shiftright("node", bits).alias("node")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(child)), lambda c: F.concat_ws(":", c["node"], c["digest"])), "\n"), 256).alias("digest"))


def differing_buckets(spark: SparkSession, old: str, new: str, bits: int = BITS, depth: int = DEPTH) -> list[int]:
    """The buckets whose digests differ, found from the root down."""
    nodes = [0]
    for level in range(depth + 1):
        near = lambda path: spark.read.schema(TREE).parquet(f"{path}/tree").filter((F.col("level") == level) & F.col("node").isin(nodes)).select("node", "digest")  # noqa: B023, E731
        both = near(old).join(near(new).withColumnRenamed("digest", "_new"), "node", "full").filter(~F.col("digest").eqNullSafe(F.col("_new")))
        found = [r["node"] for r in both.select("node").collect()]  # no more than leaves
        if not found or level == depth:
            return sorted(found)
        nodes = [n * (1 << bits) + k for n in found for k in range(1 << bits)]
    return []


def drift(spark: SparkSession, old: str, new: str, key: list[str], bits: int = BITS, depth: int = DEPTH) -> DataFrame:
    """key, drift (missing, new, changed) of the rows that differ between the snapshots in *old* and *new*, of one schema."""
    buckets = differing_buckets(spark, old, new, bits, depth)

    def part(path: str) -> DataFrame:
        schema = [*spark.read.parquet(f"{path}/schema").schema.fields, T.StructField("bucket", T.IntegerType())]
        d = spark.read.schema(T.StructType(schema)).parquet(f"{path}/rows").filter(F.col("bucket").isin(buckets))
        return d.select(*key, F.sha2(row_text([F.col(c) for c in sorted(set(d.columns) - {"bucket"})]), 256).alias("h"))

    d = part(old).join(part(new).withColumnRenamed("h", "_new"), key, "full")
    what = F.when(F.col("_new").isNull(), "missing").when(F.col("h").isNull(), "new").when(F.col("h") != F.col("_new"), "changed")
    return d.withColumn("drift", what).filter("drift IS NOT NULL").select(*key, "drift")
