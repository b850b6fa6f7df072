"""Job folders as a Spark data source: ``spark.read.format("job_folders")``, a partition for each few folders.

A folder ``<prefix><number>`` in *path* holds a job's files. Of each folder the files that match *pattern* are read; a row is (job, file, bytes,
sha256, document, error). In mode ``soft`` a file that is too large, cannot be read or holds no JSON object gives a row with its error, and a
folder without such a file one with ``missing``; in mode ``strict`` the first fault raises. Filters on ``job`` (equal, in) are pushed down: folders of other jobs
are never opened, and their faults never seen. Written in mode ``append``, each row (job, document) becomes a file of its folder, by the task that
holds the row: a name of its partition and place, put there once it is whole, so that a task's second attempt writes the same files. Pushing needs ``spark.sql.python.filterPushdown.enabled``, which ``register`` sets.

Workers open the files themselves, so *path* must be mounted where they run; other schemes than file: raise.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

SCHEMA = "job long, file string, bytes long, sha256 string, document string, error string"
FOLDERS_A_PARTITION = 64
MAX_BYTES = 32 * 1024 * 1024


@dataclass
class Folders(InputPartition):
    jobs: tuple[tuple[int, str], ...]


def mounted(path: str) -> str:
    """*path* without its scheme, if it is one that can be opened."""
    scheme, sep, rest = path.partition(":")
    if not sep or "/" in scheme:
        return path
    if scheme != "file":
        raise ValueError(f"job folders must be mounted, not in {scheme}:")
    return "/" + rest.lstrip("/")


class JobFolders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "job_folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return JobReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("job folders are appended to, never overwritten")
        return JobWriter(self.options)


class JobReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.prefix, self.pattern = mounted(options["path"]), options.get("prefix", "import_job_"), options.get("pattern", "*.json")
        self.strict, self.max_bytes = {"soft": False, "strict": True}[options.get("mode", "soft")], int(options.get("maxbytes", MAX_BYTES))
        self.wanted: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("job",):
                own = {f.value}
            elif isinstance(f, In) and f.attribute == ("job",):
                own = set(f.value)
            else:
                yield f
                continue
            self.wanted = own if self.wanted is None else self.wanted & own

    def partitions(self) -> list[Folders]:
        found = []
        for entry in os.scandir(self.path):  # names only
            number = entry.name.removeprefix(self.prefix)
            if entry.name.startswith(self.prefix) and number.isascii() and number.isdigit() and (self.wanted is None or int(number) in self.wanted):
                found.append((int(number), entry.path))
        found.sort()
        return [Folders(tuple(found[k : k + FOLDERS_A_PARTITION])) for k in range(0, len(found), FOLDERS_A_PARTITION)] or [Folders(())]

    def read(self, partition: Folders) -> Iterator[tuple]:
        for job, folder in partition.jobs:
            names = sorted(n for n in os.listdir(folder) if fnmatch.fnmatchcase(n, self.pattern))
            for name in names or [None]:
                row = (job, name, *(self._file(f"{folder}/{name}") if name else (None, None, None, "missing")))
                if self.strict and row[-1]:
                    raise ValueError(f"job {job}: {name or self.pattern}: {row[-1]}")
                yield row

    def _file(self, path: str) -> tuple[int | None, str | None, str | None, str | None]:
        try:
            size = os.stat(path).st_size
            if size > self.max_bytes:
                return size, None, None, "too_large"
            with open(path, "rb") as f:
                content = f.read()
        except OSError as e:
            return None, None, None, type(e).__name__
        digest = hashlib.sha256(content).hexdigest()
        try:
            text = content.decode()
            whole = isinstance(json.loads(text), dict)
        except ValueError:
            return len(content), digest, None, "not_json"
        return (len(content), digest, text, None) if whole else (len(content), digest, None, "not_an_object")


class JobWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.prefix, self.suffix = mounted(options["path"]), options.get("prefix", "import_job_"), options.get("suffix", ".json")

    def write(self, rows: Iterator[tuple]) -> WriterCommitMessage:
        context = TaskContext.get()
        for n, (job, document) in enumerate(rows):
            folder = f"{self.path}/{self.prefix}{'none' if job is None else job}"
            name = f"{context.partitionId():05d}-{n:09d}{self.suffix}"
            own = f"{folder}/.{name}.{context.taskAttemptId()}"
            os.makedirs(folder, exist_ok=True)
            with open(own, "w", encoding="utf-8", newline="") as f:
                f.write((document or "") + "\n")
            os.replace(own, f"{folder}/{name}")
        return WriterCommitMessage()


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(JobFolders)
