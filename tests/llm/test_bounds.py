"""Bounds of work and memory of the operators on texts."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from itemloom.llm import pii, toxicity
from itemloom.llm.common import give_back


def test_scores_take_bounded_memory():
    texts = [f"word{k % 7} good thing{k % 5}" if k % 2 else f"word{k % 7} awful thing{k % 5}" for k in range(60)]
    model = toxicity.train_model(texts, np.arange(60) % 2 == 0)
    many = ["word1 good thing2 " * 8] * 9_000
    model.score(many[:10])
    tracemalloc.start()
    scores = model.score(many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(np.round(scores, 6))) == 1 and peak < 60e6  # 8192 windows at a time took over 100 MB


def test_words_of_the_training_texts_are_looked_at_once(monkeypatch):
    texts = [f"word{k % 7} good thing{k % 5}" if k % 2 else f"word{k % 7} awful thing{k % 5}" for k in range(60)]
    model = toxicity.train_model(texts, np.arange(60) % 2 == 0)
    seen, inputs = [], toxicity.Model.inputs
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 50)
    monkeypatch.setattr(toxicity.Model, "inputs", lambda self, words: seen.append(list(words)) or inputs(self, words))
    many = [f"word{k % 7} new{k} awful thing{k % 5}" for k in range(3_000)]
    scores = model.score(many)
    words = [w for part in seen for w in part]
    assert len(words) == len(set(words)) == 3_000 + 7 + 5 + 1  # other words fill the cache again and again
    assert len(seen) <= 3  # many short texts together
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 4)
    few = toxicity.train_model(texts, np.arange(60) % 2 == 0)
    assert np.allclose([few.score([t])[0] for t in many[:300]], scores[:300], atol=1e-6)


def test_training_keeps_no_texts_and_no_windows_of_all(monkeypatch):
    monkeypatch.setattr(toxicity, "train_nets", lambda *a, **k: None)
    y, text = np.arange(300) % 2 == 0, lambda k: f"word{k % 7} thing{k % 5} " * 8_000
    toxicity.train_model(map(text, range(40)), y[:40])
    tracemalloc.start()
    toxicity.train_model(map(text, range(300)), y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 110e6  # 75 MB; the windows of all texts took 77 MB more


def test_freed_memory_goes_back_to_the_system():
    def taken():
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(n) for n in re.findall(r"\nPss_Anon:\s+(\d+)", f.read())) / 1024

    arrays = [np.ones(10_000, np.uint8) for _ in range(10_000)]
    held = arrays[::100]
    before = taken()
    del arrays
    give_back()
    assert len(held) == 100 and before - taken() > 60  # of 95 MB; what is freed between held arrays stays otherwise


def test_all_python_of_a_stage_is_one_worker_a_task(spark):
    """Workers of another kind (a pandas UDF's, an RDD's) stay idle for a minute beside those of mapInArrow."""
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    d = spark.createDataFrame(pa.table({"doc_id": [1, 3], "text": ["mail a@b.example now", None], "toxic": [0, 1]}))
    redacted = plan(pii.redact_documents(d.select("doc_id", "text")))
    assert redacted.count("MapInArrow") == 1 and "EvalPython" not in redacted
    rows = toxicity.training_rows(d, d.select("doc_id", "toxic"))
    assert "ExistingRDD" not in plan(rows)


def test_a_text_goes_to_the_worker_once(spark):
    d = spark.createDataFrame([(1, "x" * 50)], "doc_id long, text string")
    model = toxicity.train_model([], np.zeros(0, np.int64))
    plan = toxicity.with_scores(d, model)._jdf.queryExecution().optimizedPlan().toString()
    assert "_text" not in plan
    assert [r.asDict() for r in toxicity.reject_toxic(d, model).collect()] == [{"doc_id": 1, "text": "x" * 50}]
    redacted = pii.redact_documents(d)
    assert not re.search(r"named_struct\([^)]*text", redacted._jdf.queryExecution().optimizedPlan().toString())


def test_runs_without_marks_are_not_cut(monkeypatch):
    class Counting:
        calls = 0

        def findall(self, text):
            self.calls += 1
            return token.findall(text)

    token, counting = pii._TOKEN, Counting()
    monkeypatch.setattr(pii, "_TOKEN", counting)
    pii.Tokens(["plain words here"] * 50 + ["key=value", "key=value"])
    assert counting.calls == 1


def test_tokens_are_those_of_the_whole_text():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB1=:= :\n.,-_@\x1c\xa0 İ") for _ in range(rng.randrange(60))) for _ in range(3_000)]
    t = pii.Tokens(texts)
    assert [t.words[k] for k in t.ids] == [w for x in texts for w in pii._TOKEN.findall(x)]
    assert np.diff(t.ends).tolist() == [len(pii._TOKEN.findall(x)) for x in texts]
