"""Pluggable model runners: prompts as text columns, answers as text columns, transport left to the caller."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Runner(Protocol):
    """What a stage calls: *stage* names the task (split, transcribe, audit, level2, proposal, verifier); one text comes back."""

    def run(self, stage: str, prompt: str) -> str: ...


class RecordedRunner:
    """Answers from a small mapping of prompts (or (stage, prompt) pairs) to texts: the default where there is no model."""

    def __init__(self, answers: Mapping):
        self.answers = dict(answers)

    def run(self, stage: str, prompt: str) -> str:
        return self.answers.get((stage, prompt), self.answers.get(prompt))


def run_stage(df: DataFrame, runner: Runner, stage: str, prompt: str = "prompt", name: str = "answer") -> DataFrame:
    """*df* with the runner's answer and, if a call raised, answer null and its error's class in ``<name>_error``.

    Each executor process gets its own copy of the runner. A lost executor repeats its calls, so a runner should be idempotent
    (write the result once, as a generation, and join recorded answers afterwards)."""

    def call(prompts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in prompts:
            answers, errors = [], []
            for p in some:
                try:
                    answers.append(None if p is None else runner.run(stage, p))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - a model's failure is a row's result
                    answers.append(None)
                    errors.append(type(e).__name__)
            yield pd.DataFrame({"a": pd.Series(answers, dtype=object), "e": pd.Series(errors, dtype=object)})

    udf = F.pandas_udf(_typed(call), "a string, e string")
    return df.withColumn("_r", udf(F.col(prompt))).withColumns({name: F.col("_r.a"), f"{name}_error": F.col("_r.e")}).drop("_r")


def _typed(call):
    call.__annotations__ = {"prompts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return call


def recorded_answers(df: DataFrame, recorded: DataFrame, key: list[str], name: str = "answer") -> DataFrame:
    """*df* with the answers that an earlier run wrote down (key, prompt_sha256, answer); one for another prompt does not count."""
    r = recorded.select(*key, F.col("prompt_sha256").alias("_sha"), F.col("answer").alias("_a"))
    d = df.join(r, key, "left")
    return d.withColumn(name, F.when(F.sha2("prompt", 256) == F.col("_sha"), F.col("_a"))).drop("_sha", "_a")


def prompt(head: str, **fields: Column) -> Column:
    """A deterministic prompt: *head*, then a line ``name: value`` for each field in the order given (null: an empty value)."""
    return F.concat_ws("\n", F.lit(head), *[F.concat(F.lit(f"{n}: "), F.coalesce(c.cast("string"), F.lit(""))) for n, c in fields.items()])


def run_id(prefix: str, *parts: Column) -> Column:
    """*prefix* and the first 24 digits of the digest of the parts."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 24))


#: What each stage is asked to do; its rows follow as JSON.
TASKS = {
    "split": "Find every question on these pages. Give its regions in reading order as boxes from 0 to 1. Answer with one JSON object and nothing else.",
    "transcribe": "Copy each question's text as it stands, without solving it. Leave answers and knowledge points empty. Answer with one JSON object and nothing else.",
    "audit": "Compare each question's text with its picture. Pass it only if text, structure, formulas and figures all agree. Answer with one JSON object and nothing else.",
    "classify": "Choose codes from the given list for each question, without solving it. Answer with one JSON object and nothing else.",
}


def stage_prompts(rows: DataFrame, stage: str, job: str, number: str, columns: list[str]) -> DataFrame:
    """job, prompt of *stage*: its task and the job's rows, by number, as one JSON text with the same bytes each time. A job's rows are bounded."""
    item = F.struct(F.col(number).try_cast("int").alias("_n"), F.col(number).cast("string").alias("_no"), F.struct(number, *columns).alias("_q"))
    d = rows.groupBy(job).agg(F.sort_array(F.collect_list(item)).alias("_i"))
    text = F.to_json(F.struct(F.lit(TASKS[stage]).alias("task"), F.transform("_i", lambda x: x["_q"]).alias("questions")), {"ignoreNullFields": "false"})
    return d.select(job, text.alias("prompt"))
