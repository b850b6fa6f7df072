"""Carrier queries for what is written and read again: backups, snapshots with hash trees, journals of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemloom.operators import hashtree, journal
from itemloom.sources import backups, jobs, table, work_folder


def written_backup(spark, sf_dir):
    """Faults of a written copy in which one file was cut and one went: orders of unknown customers, tables that cannot be checked."""
    path = work_folder(spark, "backup")
    o = table(spark, sf_dir, "orders").withColumn("o_custkey", F.when(F.col("o_orderkey") % 97 == 0, F.col("o_custkey") + 10**9).otherwise(F.col("o_custkey")))
    tables = {n: table(spark, sf_dir, n).coalesce(1) for n in ("region", "nation", "customer", "supplier", "part")} | {"orders": o.coalesce(1)}
    seal = backups.write(tables, path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    fs = folder("part").getFileSystem(conf)
    first = lambda name: next(s.getPath() for s in fs.listStatus(folder(name)) if s.getPath().getName().endswith(".parquet"))
    fs.delete(first("part"), False)
    cut = fs.create(first("supplier"), True)
    cut.write(bytearray(b"PAR1"))
    cut.close()
    refs = [("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey")]
    return backups.faults(spark, path, seal, refs).groupBy("relation", "fault").agg(F.count(F.lit(1)).alias("n"))


def snapshot_drift(spark, sf_dir):
    """Orders that changed, went or came between two snapshots, found through their hash trees."""
    old, new = work_folder(spark, "snapshot"), work_folder(spark, "snapshot")
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    hashtree.write_snapshot(o.filter(k % 211 != 5), old, ["o_orderkey"])
    hashtree.write_snapshot(o.filter(k % 223 != 7).withColumn("o_orderstatus", F.when(k % 199 == 3, None).otherwise(F.col("o_orderstatus"))), new, ["o_orderkey"])
    return hashtree.drift(spark, old, new, ["o_orderkey"])


class _Counting:
    """Stands for a model: the prompt's length, or an error for prompts that name an error."""

    def run(self, stage: str, prompt: str) -> str:
        if "error" in prompt:
            raise TimeoutError(prompt)
        return f"{stage}:{len(prompt)}"


def journal_answers(spark, sf_dir):
    """Answers to prompts of events, equal ones asked once; the second run asks only for what failed in the first."""
    path = work_folder(spark, "journal")
    e = table(spark, sf_dir, "events").select("event_id", F.concat_ws("/", "event_type", (F.col("user_id") % 50).cast("string")).alias("prompt"))
    journal.ask(e.filter("event_id % 2 = 0"), path, _Counting(), "audit", slice_prompts=60)
    journal.ask(e, path, _Counting(), "audit", slice_prompts=60)
    return journal.answers(e, journal.entries(spark, path), "audit").select("event_id", "answer", "attempts", "last_error")


def job_documents(spark, sf_dir):
    """Suppliers' documents, written as job folders and read as a data source; some are no JSON or no object, and only some jobs are wanted."""
    jobs.register(spark)
    folder, k = work_folder(spark, "jobs"), F.col("s_suppkey")
    text = F.when(k % 7 == 0, F.concat(F.lit('{"name": "'), "s_name")).when(k % 5 == 0, F.concat(F.lit('["'), "s_name", F.lit('"]'))).otherwise(F.concat(F.lit('{"name": "'), "s_name", F.lit('"}')))
    documents = table(spark, sf_dir, "supplier").select(k.cast("long").alias("job"), text.alias("document"))
    documents.write.format("job_folders").option("prefix", "import_job=").option("suffix", ".txt").mode("append").save(folder)
    wanted = [r[0] for r in table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("long")).collect()]  # 25 numbers
    d = spark.read.format("job_folders").option("prefix", "import_job=").option("pattern", "*.txt").load(folder).filter(F.col("job").isin(wanted))
    return d.select("job", "bytes", "sha256", F.get_json_object("document", "$.name").alias("name"), "error")


QUERIES = {f.__name__: f for f in (written_backup, snapshot_drift, journal_answers, job_documents)}
ORACLE_SQL = {
    "job_documents": """
WITH d AS (SELECT s_suppkey AS k, s_name, CASE WHEN s_suppkey % 7 = 0 THEN '{"name": "' || s_name WHEN s_suppkey % 5 = 0 THEN '["' || s_name || '"]' ELSE '{"name": "' || s_name || '"}' END || chr(10) AS t FROM supplier WHERE s_suppkey BETWEEN 1 AND 25)
SELECT k AS job, CAST(strlen(t) AS BIGINT) AS bytes, sha256(t) AS sha256, CASE WHEN k % 7 <> 0 AND k % 5 <> 0 THEN s_name END AS name, CASE WHEN k % 7 = 0 THEN 'not_json' WHEN k % 5 = 0 THEN 'not_an_object' END AS error FROM d""",
    "written_backup": """
SELECT 'part' AS relation, 'missing' AS fault, 1 AS n UNION ALL SELECT 'supplier', 'changed', 1 UNION ALL SELECT 'supplier', 'unchecked:s_nationkey', 1
UNION ALL SELECT DISTINCT 'orders', 'reference:o_custkey', 1 FROM orders WHERE o_orderkey % 97 = 0
UNION ALL SELECT DISTINCT 'customer', 'reference:c_nationkey', 1 FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)""",
    "snapshot_drift": """
WITH a AS (SELECT o_orderkey AS k, o_orderkey % 211 <> 5 AS was, o_orderkey % 223 <> 7 AS is_now, o_orderkey % 199 = 3 AND o_orderstatus IS NOT NULL AS differs FROM orders)
SELECT k AS o_orderkey, CASE WHEN NOT was THEN 'new' WHEN NOT is_now THEN 'missing' ELSE 'changed' END AS drift FROM a WHERE (was OR is_now) AND (was <> is_now OR differs)""",
    "journal_answers": """
WITH e AS (SELECT event_id, event_type || '/' || (user_id % 50) AS p FROM events), f AS (SELECT p, bool_or(event_id % 2 = 0) AS first FROM e GROUP BY p)
SELECT event_id, CASE WHEN NOT contains(p, 'error') THEN 'audit:' || length(p) END AS answer, CASE WHEN contains(p, 'error') AND first THEN 2 ELSE 1 END AS attempts, CASE WHEN contains(p, 'error') THEN 'TimeoutError' END AS last_error FROM e JOIN f USING (p)""",
}
