"""Work that must not grow with the number of jobs or folders."""

import os

import pytest
from pyspark.sql import functions as F

from itemloom.sources import jobs
from itemloom.streaming import recovery

HOUR = 3_600_000_000


def test_state_is_one_row_a_bucket(spark, tmp_path):
    d = spark.range(300).select("id", (F.col("id") % 100).alias("job"), F.timestamp_micros((F.col("id") + 1) * HOUR).alias("ts"), F.lit("failed").alias("outcome"), F.col("id").alias("order"))
    d.write.parquet(f"{tmp_path}/in")
    seen = []
    stream = recovery.changes(spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in"), HOUR, 4, "1 hour", buckets=4)
    query = stream.writeStream.foreachBatch(lambda b, n: seen.append([r.asDict() for r in b.collect()])).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) <= 4
    assert len(seen[0]) == 100 and {r["tries"] for r in seen[0]} == {3} and not any(r["call"] for r in seen[0])
    called = {r["job"] for rows in seen[1:] for r in rows if r["call"]}
    assert called == {j for j in range(100) if 201 + j + 4 < 300 - 1}  # due after a backoff of four hours, before the watermark


def test_a_bucket_calls_due_jobs_beside_new_attempts(spark, tmp_path):
    schema, seen = "job long, us long, outcome string, `order` long", []
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for rows in ([(1, HOUR, "failed", 1)], [(2, 90 * HOUR, "completed", 2)], [(2, 95 * HOUR, "failed", 3), (3, 95 * HOUR, "failed", 4)]):
        add(rows)
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").selectExpr("job", "timestamp_micros(us) AS ts", "outcome", "`order`")
        changed = recovery.changes(stream, HOUR, 4, "1 hour", buckets=1)
        changed.writeStream.foreachBatch(lambda b, n: seen.extend((r["job"], r["status"], r["call"]) for r in b.collect())).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen) == [(1, "waiting", False), (1, "waiting", True), (2, "completed", False), (2, "completed", False), (3, "waiting", False)]


def test_job_folders_are_written_by_the_tasks(spark, tmp_path):
    jobs.register(spark)
    d = spark.createDataFrame([(1, '{"x": 1}'), (1, "é"), (2, None), (None, "{}")], "job long, document string").coalesce(1)
    d.write.format("job_folders").option("prefix", "j=").option("suffix", ".txt").mode("append").save(f"{tmp_path}/out")
    got = spark.read.format("job_folders").option("prefix", "j=").option("pattern", "*.txt").load(f"{tmp_path}/out")
    assert sorted((r["job"], r["bytes"], r["error"]) for r in got.collect()) == [(1, 3, "not_json"), (1, 9, None), (2, 1, "not_json")]
    assert not [f for _, _, files in os.walk(tmp_path) for f in files if f.startswith(".")]
    with pytest.raises(Exception, match="never overwritten"):
        d.write.format("job_folders").mode("overwrite").save(f"{tmp_path}/out")
