"""The recovery stream: rules of a job's state, timers, and going on after a crash."""

from __future__ import annotations

from collections import Counter

import pytest

from itemloom.streaming import recovery

HOUR = 3_600_000_000
DAY = 24 * HOUR
SCHEMA = "job long, us long, outcome string, `order` long"


def fold(rows, most=3):
    state = (0, 0, None, "new", 0)
    for us, outcome in rows:
        state = recovery.next_state(state, us, outcome, HOUR, most)
    return state[:4]


def test_rules_of_a_job():
    assert fold([(0, "failed")]) == (1, 0, HOUR, "waiting")
    assert fold([(0, "failed"), (HOUR - 1, "failed")]) == (1, 1, HOUR, "waiting")  # before its time
    assert fold([(0, "busy"), (HOUR, "failed")]) == (2, 0, 3 * HOUR, "waiting")  # the backoff doubles
    assert fold([(0, "failed"), (HOUR, "failed"), (3 * HOUR, "failed"), (99 * HOUR, "completed")]) == (3, 0, None, "given_up")
    assert fold([(0, "completed"), (1, "failed")]) == (0, 0, None, "completed")


def writer(spark, folder):
    def write(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)

    return write


def stream_of(spark, folder):
    return lambda: recovery.changes(spark.readStream.schema(SCHEMA).parquet(folder).selectExpr("job", "timestamp_micros(us) AS ts", "outcome", "`order`"), HOUR, 4, "1 minute")


def test_timers_call_once_a_try(spark, tmp_path):
    at = {k: f"{tmp_path}/{k}" for k in ("in", "out", "ck")}
    write = writer(spark, at["in"])
    write([(1, DAY, "failed", 1), (2, DAY, "failed", 1), (3, DAY + 5 * HOUR, "completed", 1)])
    recovery.replay(stream_of(spark, at["in"])(), at["out"], at["ck"])
    assert {r["job"]: (r["status"], r["calls"]) for r in recovery.states(spark, at["out"]).collect()} == {1: ("waiting", 1), 2: ("waiting", 1), 3: ("completed", 0)}
    write([(1, DAY + 6 * HOUR, "failed", 2), (4, 3 * DAY, "completed", 1)])
    recovery.replay(stream_of(spark, at["in"])(), at["out"], at["ck"])
    got = {r["job"]: (r["status"], r["tries"], r["calls"]) for r in recovery.states(spark, at["out"]).collect()}
    assert got == {1: ("waiting", 2, 2), 2: ("waiting", 1, 1), 3: ("completed", 0, 0), 4: ("completed", 0, 0)}


def test_settles_and_goes_on_after_a_crash(spark, tmp_path):
    at = {k: f"{tmp_path}/{k}" for k in ("in", "out", "ck")}
    write, asked, waited = writer(spark, at["in"]), Counter(), []
    write([(k, DAY, "failed", 0) for k in range(6)] + [(9, DAY, "completed", 0)])

    def work(crash):
        def run(jobs):
            rows = [(r["job"], int(r["due"].timestamp() * 1e6)) for r in jobs.collect()]
            asked.update(j for j, _ in rows)
            if crash and max(asked.values()) == 2:
                raise OSError("the driver dies")
            write([(j, due, "completed" if asked[j] > j // 2 else "failed", asked[j]) for j, due in rows])

        return run

    with pytest.raises(OSError, match="dies"):
        recovery.settle(stream_of(spark, at["in"]), at["out"], at["ck"], work(True), waited.append)
    n = recovery.settle(stream_of(spark, at["in"]), at["out"], at["ck"], work(False), waited.append)
    got = {r["job"]: (r["status"], r["tries"]) for r in recovery.states(spark, at["out"]).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 9} and all(s in ("completed", "given_up") for s, _ in got.values()) and n > 0
    assert got[0] == ("completed", 1) and got[9] == ("completed", 0)  # each attempt counts once, crash or not
    with pytest.raises(RuntimeError, match="left"):
        write([(77, 99 * DAY, "failed", 0)])
        recovery.settle(stream_of(spark, at["in"]), at["out"], at["ck"], lambda jobs: None, waited.append, most=1)
