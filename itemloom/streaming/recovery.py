"""Recovery of interrupted jobs as a stream: attempts come in, state decides which count, timers call for the next one.

An attempt is (job, ts, outcome). The state of a job is its number of failed tries, when it may be tried again and what it has come to:
*waiting* (a try failed; the next is due after a backoff that doubles), *completed* or *given_up* (as many tries as allowed failed). An
attempt before its time is not counted as a try (another worker holds the job), one after the end changes nothing. When the watermark
passes a waiting job's time, its timer gives a row with ``call`` set, once a try. Ended jobs keep their state, so that a late attempt cannot
start them anew. State is one row a bucket of jobs (by hash of the job), as a call of Python for each job costs milliseconds: the calls
of a batch are bounded by the number of buckets, and a bucket's rows by jobs / buckets.

``changes`` is the stream of states; ``settle`` feeds one until nothing is left to retry, and goes on from its checkpoint after a crash.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "tries long, early long, due long, status string, seen long"
HELD = "jobs string"  # of a bucket, as JSON: job, its state, for which try the timer has gone off, when it will (ms)
BUCKETS = 4096
ENDED = ("completed", "given_up")


def next_state(state: tuple, ts: int, outcome: str, backoff: int, most: int) -> tuple:
    """(tries, early, due, status, seen) after an attempt at *ts* (microseconds)."""
    tries, early, due, status, seen = state
    if status in ENDED:
        return state
    seen = max(seen, ts)
    if due is not None and ts < due:
        return tries, early + 1, due, status, seen
    if outcome == "completed":
        return tries, early, None, "completed", seen
    tries += 1
    if tries >= most:
        return tries, early, None, "given_up", seen
    return tries, early, ts + backoff * 2 ** (tries - 1), "waiting", seen


def changes(attempts: DataFrame, backoff: int, most: int, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """job, tries, early, due (timestamp), status, seen, call: a row for each job that a batch changes or a timer calls.

    *attempts*: a stream of job (bigint), ts (timestamp), outcome, order (breaks ties of ts). *backoff*: microseconds before the second try.
    *buckets*: more of them suit streams of very many jobs; a checkpoint keeps to its number."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        jobs = {job: own for job, *own in json.loads(state.get[0])} if state.exists else {}
        now, touched = state.getCurrentWatermarkMs(), {}
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values(["us", "order"])
            for job, us, outcome in zip(rows["job"].tolist(), rows["us"].tolist(), rows["outcome"].tolist(), strict=True):
                own = touched.get(job) or jobs.get(job) or (0, 0, None, "new", 0, 0, None)
                touched[job] = (*next_state(tuple(own[:5]), int(us), outcome, backoff, most), own[5], None)
            for job, own in touched.items():
                timed = own[3] == "waiting" and own[5] < own[0]
                jobs[job] = (*own[:6], max(own[2] // 1000, now + 1) if timed else None)
        called = {job for job, own in jobs.items() if own[6] is not None and own[6] < now and job not in touched}
        for job in called:
            jobs[job] = (*jobs[job][:5], jobs[job][0], None)
        state.update((json.dumps([(job, *own) for job, own in jobs.items()]),))
        timers = [own[6] for own in jobs.values() if own[6] is not None]
        if timers:
            state.setTimeoutTimestamp(max(min(timers), now, 1))
        out = [(job, *jobs[job][:5], job in called) for job in (*touched, *called)]
        if out:
            job, tries, early, due, status, seen, call = zip(*out, strict=True)
            number = pd.array([None if j is None else int(j) for j in job], "Int64")
            yield pd.DataFrame({"job": number, "tries": tries, "early": early, "due": pd.array(due, "Int64"), "status": status, "seen": seen, "call": call})

    bucket = F.pmod(F.xxhash64("job"), F.lit(buckets)).alias("bucket")
    rows = attempts.withWatermark("ts", late).select(bucket, F.col("job").cast("string").alias("job"), "ts", F.unix_micros("ts").alias("us"), "outcome", "order")
    out = rows.groupBy("bucket").applyInPandasWithState(step, f"job long, {STATE}, call boolean", HELD, "update", GroupStateTimeout.EventTimeTimeout)
    return out.select("job", "tries", "early", F.timestamp_micros("due").alias("due"), "status", F.timestamp_micros("seen").alias("seen"), "call")


def replay(changed: DataFrame, out: str, checkpoint: str) -> None:
    """Run the stream over all that is there and append its rows, with their batch, to the table in *out*. A batch that comes again after a crash
    overwrites its own part."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    changed.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def states(spark: SparkSession, out: str) -> DataFrame:
    """job, tries, early, due, status and calls (how often its timer went off), as the last batches left them."""
    d = spark.read.option("basePath", out).schema(f"job long, {STATE.replace('due long', 'due timestamp').replace('seen long', 'seen timestamp')}, call boolean, batch long").parquet(out)
    last = F.row_number().over(W.partitionBy("job").orderBy(F.desc("batch")))
    calls = F.count_if("call").over(W.partitionBy("job"))
    return d.withColumns({"_n": last, "calls": calls}).filter("_n = 1").select("job", "tries", "early", "due", "status", "calls")


def settle(stream: Callable[[], DataFrame], out: str, checkpoint: str, work: Callable[[DataFrame], None], wait: Callable[[int], None], most: int = 100) -> int:
    """Replay, hand the waiting jobs to *work* (which appends attempts to what *stream*() reads) and wait, until none is left; the number of
    rounds. *wait*(n) backs off before the n-th. A crash anywhere is mended by calling again: the checkpoint knows which attempts
    have been counted."""
    spark = stream().sparkSession
    for n in range(most):
        replay(stream(), out, checkpoint)
        waiting = states(spark, out).filter("status = 'waiting'").select("job", "due")
        if waiting.isEmpty():
            return n
        if n:
            wait(n)
        work(waiting)
    raise RuntimeError(f"jobs are left after {most} rounds")
