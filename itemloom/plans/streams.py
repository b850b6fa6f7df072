"""Carrier queries that run as streams over given tables, started, drained and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemloom.sources import work_folder
from itemloom.streaming import recovery

_BACKOFF, _MOST = 12 * 3_600_000_000, 4


def _attempts(spark, sf_dir):
    """Events as attempts: a job is a user's events of one number mod 20; purchases complete it, clicks find it busy, others fail."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    d = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)  # a stream reads folders
    outcome = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "click", "busy").otherwise("failed")
    return d.select((F.col("user_id") * 20 + F.col("event_id") % 20).alias("job"), F.col("ts").cast("timestamp").alias("ts"), outcome.alias("outcome"), F.col("event_id").alias("order"))


def recovery_stream(spark, sf_dir):
    """What each job has come to once all attempts are replayed, and whether its timer has called for the next one."""
    out, checkpoint = work_folder(spark, "recovery"), work_folder(spark, "recovery-checkpoint")
    recovery.replay(recovery.changes(_attempts(spark, sf_dir), _BACKOFF, _MOST, "2 days"), out, checkpoint)
    return recovery.states(spark, out).select("job", "tries", "early", F.unix_micros("due").alias("due_us"), "status", "calls")


QUERIES = {f.__name__: f for f in (recovery_stream,)}
ORACLE_SQL = {
    "recovery_stream": f"""
WITH RECURSIVE a AS (
  SELECT user_id * 20 + event_id % 20 AS job, epoch_us(ts) AS us, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'busy' ELSE 'failed' END AS outcome,
    row_number() OVER (PARTITION BY user_id * 20 + event_id % 20 ORDER BY ts, event_id) AS n FROM events),
s AS (
  SELECT job, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS tries, CAST(0 AS BIGINT) AS early, CAST(NULL AS BIGINT) AS due, 'new' AS status FROM (SELECT DISTINCT job FROM a)
  UNION ALL
  SELECT job, a.n, CASE WHEN failed THEN tries + 1 ELSE tries END, CASE WHEN soon THEN early + 1 ELSE early END,
    CASE WHEN NOT open OR soon THEN due WHEN NOT failed OR tries + 1 >= {_MOST} THEN NULL ELSE us + {_BACKOFF} * (1 << tries) END,
    CASE WHEN NOT open OR soon THEN status WHEN NOT failed THEN 'completed' WHEN tries + 1 >= {_MOST} THEN 'given_up' ELSE 'waiting' END
  FROM (SELECT s.*, status IN ('new', 'waiting') AS open, coalesce(us < due, false) AND status IN ('new', 'waiting') AS soon, us, outcome,
      outcome <> 'completed' AND status IN ('new', 'waiting') AND NOT coalesce(us < due, false) AS failed, a.n AS an FROM s JOIN a ON a.job = s.job AND a.n = s.n + 1) x
    JOIN (SELECT job AS j, n FROM a) a ON a.j = x.job AND a.n = x.an),
last AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY job ORDER BY n DESC) = 1)
SELECT job, CAST(tries AS BIGINT) AS tries, CAST(early AS BIGINT) AS early, CAST(due AS BIGINT) AS due_us, status,
  CAST(CASE WHEN status = 'waiting' AND due // 1000 < (SELECT max(us) // 1000 FROM a) - 2 * 86400000 THEN 1 ELSE 0 END AS BIGINT) AS calls FROM last""",
}
