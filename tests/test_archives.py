"""Backups, hash trees and journals: what is written is found again, damage and drift are located, nothing is asked twice."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from itemloom.operators import hashtree, journal
from itemloom.sources import backups


def files_of(path, name):
    return sorted(f"{path}/{name}/{f}" for f in os.listdir(f"{path}/{name}") if f.endswith(".parquet"))


def faults_of(spark, path, seal, refs=()):
    return {(r["relation"], r["file"] is None, r["fault"]) for r in backups.faults(spark, path, seal, refs).collect()}


def test_damage_is_found_in_the_copy(spark, tmp_path):
    path, refs = f"{tmp_path}/b", [("child", "parent", "parent", "id")]
    parent = spark.createDataFrame([(k,) for k in range(50)], "id int").repartition(3)
    child = spark.createDataFrame([(k, k % 60 if k != 7 else None) for k in range(55)], "id int, parent int")
    seal = backups.write({"parent": parent, "child": child.filter("parent < 50 OR parent IS NULL"), "none": parent.limit(0)}, path)
    assert faults_of(spark, path, seal, refs) == set()
    one = files_of(path, "parent")[0]
    data = bytearray(open(one, "rb").read())
    data[len(data) // 2] ^= 1  # a flipped bit
    open(one, "wb").write(data)
    for f in os.listdir(f"{path}/parent"):
        if f.endswith(".crc"):
            os.remove(f"{path}/parent/{f}")
    os.remove(files_of(path, "child")[0])
    assert faults_of(spark, path, seal, refs) == {("parent", False, "changed"), ("child", False, "missing"), ("child", True, "unchecked:parent")}
    assert (backups.MANIFEST, True, "manifest") in faults_of(spark, path, "0" * 64)


def test_dangling_keys_and_files_that_came(spark, tmp_path):
    path, refs = f"{tmp_path}/b", [("child", "parent", "parent", "id"), ("child", "x", "gone", "id")]
    seal = backups.write({"parent": spark.range(5), "child": spark.createDataFrame([(8, 9)], "parent long, x long")}, path)
    own = files_of(path, "parent")
    spark.range(2).coalesce(1).write.mode("append").parquet(f"{path}/parent")
    assert faults_of(spark, path, seal, refs[1:]) == {("parent", False, "extra"), ("child", True, "unchecked:x")}
    os.remove(*set(files_of(path, "parent")) - set(own))
    assert faults_of(spark, path, seal, refs) == {("child", True, "reference:parent"), ("child", True, "unchecked:x")}
    with pytest.raises(ValueError, match="manifest"):
        backups.write({"manifest": spark.range(1)}, f"{tmp_path}/c")


def test_drift_reads_only_buckets_that_differ(spark, tmp_path):
    d = spark.range(4000).selectExpr("id", "id % 7 AS a", "CAST(NULL AS STRING) AS b")
    old, new, same = (f"{tmp_path}/{k}" for k in ("old", "new", "same"))
    hashtree.write_snapshot(d, old, ["id"])
    hashtree.write_snapshot(d.repartition(9).select("b", "a", "id"), same, ["id"])  # neither order of rows nor of columns counts
    assert hashtree.differing_buckets(spark, old, same) == [] and hashtree.drift(spark, old, same, ["id"]).count() == 0
    hashtree.write_snapshot(d.filter("id <> 3").withColumn("b", F.when(F.col("id") == 100, "")).unionByName(spark.createDataFrame([(9999, 1, None)], "id long, a long, b string")), new, ["id"])
    buckets = hashtree.differing_buckets(spark, old, new)
    assert 1 <= len(buckets) <= 3
    got = hashtree.drift(spark, old, new, ["id"])
    assert {tuple(r) for r in got.collect()} == {(3, "missing"), (100, "changed"), (9999, "new")}
    read = sum(spark.read.parquet(f"{old}/rows").filter(F.col("bucket") == b).count() for b in buckets)
    assert read < 4000 / 20 and "PartitionFilters: [isnotnull" in got._jdf.queryExecution().toString() or "bucket" in got._jdf.queryExecution().toString()
    hashtree.write_snapshot(d.limit(0), f"{tmp_path}/none", ["id"])
    assert hashtree.drift(spark, f"{tmp_path}/none", old, ["id"]).count() == 4000
    assert hashtree.drift(spark, f"{tmp_path}/none", f"{tmp_path}/none", ["id"]).count() == 0


def logged(log_path, flag_path=None):
    """A runner that writes down what it is asked and stops the run at a prompt that says so, as long as a flag exists."""

    class Logged:  # local, so that workers get it by value
        log, flag = log_path, flag_path

        def run(self, stage, prompt):
            if self.flag and os.path.exists(self.flag) and prompt.endswith("7"):
                raise SystemExit("killed")
            with open(self.log, "a") as f:
                f.write(prompt + "\n")
            if prompt.endswith("3"):
                raise ValueError(prompt)
            return prompt.upper()

    return Logged()


def test_a_killed_run_asks_nothing_twice(spark, tmp_path):
    path, log, flag = f"{tmp_path}/j", f"{tmp_path}/log", f"{tmp_path}/flag"
    open(flag, "w").close()
    prompts = spark.createDataFrame([(k, f"p{k % 40}" if k != 5 else None) for k in range(80)], "id int, prompt string")
    with pytest.raises(Exception, match="killed|SystemExit|crashed|exited|Python worker"):
        journal.ask(prompts, path, logged(log, flag), "audit", slice_prompts=3)
    done = {r["digest"] for r in journal.entries(spark, path).collect()}
    os.remove(flag)
    before = open(log).read().split() if os.path.exists(log) else []
    journal.ask(prompts, path, logged(log), "audit", most=1, slice_prompts=3)
    asked = open(log).read().split()
    kept = {p for p in (f"p{k}" for k in range(40)) if spark.range(1).select(F.sha2(F.lit(f"audit\n{p}"), 256)).first()[0] in done}
    assert not kept & set(asked[len(before) :])  # what the killed run had written is not asked again
    assert set(asked) == {f"p{k}" for k in range(40)} and len(asked) - len(before) == 40 - len(kept)
    assert journal.ask(prompts, path, logged(log), "audit", most=1) == 0 and open(log).read().split() == asked
    journal.ask(prompts, path, logged(log), "audit", most=2)  # only the failed ones, once more
    assert sorted(open(log).read().split()[len(asked) :]) == ["p13", "p23", "p3", "p33"]
    got = {r["id"]: (r["answer"], r["attempts"], r["last_error"]) for r in journal.answers(prompts, journal.entries(spark, path), "audit").collect()}
    assert got[0] == ("P0", 1, None) and got[40] == got[0] and got[43] == (None, 2, "ValueError") and got[5] == (None, 0, None) and got[45] == ("P5", 1, None)
    assert journal.answers(prompts, journal.entries(spark, path), "other").filter("attempts > 0").count() == 0
