"""A journal of a model's answers: prompts are asked once, and a run that broke off goes on where it was.

An entry is (digest, stage, answer, error, attempt, slice). The digest is over stage and prompt, so equal prompts are one question. ``ask`` finds
what is wanting (no answer yet, fewer errors than *most*), cuts it into slices by hash and appends each slice's entries in one commit: whatever
stops the run, finished slices are not asked again. An executor lost within a slice repeats that slice's calls at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.operators.runners import Runner, run_stage

ENTRY = "digest string, stage string, answer string, error string, attempt long, slice long"
SLICE_PROMPTS = 10_000


def with_digest(prompts: DataFrame, stage: str) -> DataFrame:
    return prompts.withColumn("digest", F.when(F.col("prompt").isNotNull(), F.sha2(F.concat_ws("\n", F.lit(stage), "prompt"), 256)))


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The journal in *path*; none if nothing was written yet."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(ENTRY).parquet(path) if there else spark.createDataFrame([], ENTRY)


def wanting(prompts: DataFrame, journal: DataFrame, stage: str, most: int) -> DataFrame:
    """digest, prompt, attempt (the one to come) of the distinct prompts without an answer that failed fewer than *most* times."""
    own = journal.filter(F.col("stage") == stage)
    told = own.groupBy("digest").agg(F.bool_or(F.col("error").isNull()).alias("_done"), F.count(F.lit(1)).alias("_n"))
    d = with_digest(prompts.select("prompt"), stage).filter("digest IS NOT NULL").dropDuplicates(["digest"]).join(told, "digest", "left")
    d = d.withColumn("_n", F.coalesce("_n", F.lit(0))).filter(~F.coalesce("_done", F.lit(False)) & (F.col("_n") < most))
    return d.select("digest", "prompt", (F.col("_n") + 1).alias("attempt"))


def ask(prompts: DataFrame, path: str, runner: Runner, stage: str, most: int = 3, slice_prompts: int = SLICE_PROMPTS) -> int:
    """Ask what is wanting of *prompts* (a column ``prompt``) once each and append the entries to the journal in *path*; the number of slices."""
    spark = prompts.sparkSession
    left = wanting(prompts, entries(spark, path), stage, most)
    todo = left.count()
    slices = -(-todo // slice_prompts)
    last = entries(spark, path).agg(F.coalesce(F.max("slice"), F.lit(0))).first()[0]
    for k in range(slices):
        mine = left.filter(F.pmod(F.xxhash64("digest"), F.lit(slices)) == k)
        if k:  # of what was wanting at first: an entry of this run does not call for another one
            mine = mine.join(entries(spark, path).filter(F.col("slice") > last).select("digest"), "digest", "left_anti")
        answered = run_stage(mine, runner, stage)
        answered.select("digest", F.lit(stage).alias("stage"), "answer", F.col("answer_error").alias("error"), "attempt", F.lit(last + k + 1).cast("long").alias("slice")).write.mode("append").parquet(path)
    return slices


def answers(prompts: DataFrame, journal: DataFrame, stage: str) -> DataFrame:
    """*prompts* with answer, attempts (0: never asked) and last_error (null once there is an answer)."""
    own = journal.filter(F.col("stage") == stage)
    told = own.groupBy("digest").agg(
        F.min(F.when(F.col("error").isNull(), F.struct("attempt", "answer"))).alias("_a"), F.count(F.lit(1)).alias("attempts"), F.max(F.struct("attempt", "error")).alias("_e")
    )
    d = with_digest(prompts, stage).join(told, "digest", "left")
    return d.select(*prompts.columns, F.col("_a.answer").alias("answer"), F.coalesce("attempts", F.lit(0)).alias("attempts"), F.when(F.col("_a").isNull(), F.col("_e.error")).alias("last_error"))
