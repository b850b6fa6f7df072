"""The job-folder data source: soft and strict reading, and filters that keep other folders shut."""

from __future__ import annotations

import os

import pytest

from itemloom.sources import jobs


@pytest.fixture
def folder(tmp_path):
    for job, files in {1: {"a.json": '{"x": 1}', "b.txt": "no"}, 2: {"a.json": "{"}, 3: {}, 4: {"a.json": "[1]", "c.json": '{"y": "é"}'}, 10: {"a.json": '{"z": "' + "x" * 200 + '"}'}}.items():
        os.makedirs(f"{tmp_path}/import_job_{job}")
        for name, text in files.items():
            with open(f"{tmp_path}/import_job_{job}/{name}", "w") as f:
                f.write(text)
    os.makedirs(f"{tmp_path}/import_job_x1")
    return str(tmp_path)


def read(spark, folder, **options):
    jobs.register(spark)
    return spark.read.format("job_folders").options(**options).load(folder)


def test_soft_reading_tells_each_fault(spark, folder):
    got = {(r["job"], r["file"]): (r["document"], r["error"]) for r in read(spark, folder, maxBytes="100").collect()}
    assert got == {(1, "a.json"): ('{"x": 1}', None), (2, "a.json"): (None, "not_json"), (3, None): (None, "missing"), (4, "a.json"): (None, "not_an_object"), (4, "c.json"): ('{"y": "é"}', None), (10, "a.json"): (None, "too_large")}


def test_strict_reading_opens_only_what_is_wanted(spark, folder):
    d = read(spark, folder, mode="strict")
    assert [r["job"] for r in d.filter("job = 1").collect()] == [1]
    assert sorted(r["job"] for r in d.filter("job IN (1, 10, 77)").collect()) == [1, 10]  # faults of other jobs are not seen
    assert d.filter("job = 1 AND job = 2").count() == 0
    with pytest.raises(Exception, match="job 2: a.json: not_json"):
        d.filter("job IN (1, 2)").collect()
    with pytest.raises(ValueError, match="mounted"):
        jobs.mounted("s3://bucket/x")
    assert jobs.mounted("file:///a/b") == "/a/b" == jobs.mounted("file:/a/b") and jobs.mounted("/a:b") == "/a:b"


def test_a_reader_makes_partitions_of_wanted_folders(folder):
    reader = jobs.JobReader({"path": folder})
    rest = list(reader.pushFilters([jobs.In(("job",), (2, 4, 9)), jobs.EqualTo(("file",), "a.json")]))
    assert len(rest) == 1 and [j for p in reader.partitions() for j, _ in p.jobs] == [2, 4]
