"""The pipeline's stages on the smallest data set, each against its own input."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        steps.append((before, docs))
        assert k == len(cp.STAGES) - 1 or docs.columns == columns
    (all_docs, clean), (_, civil), (_, single), (_, redacted), (_, packed) = steps
    ids = lambda d: [r["doc_id"] for r in d.select("doc_id").collect()]
    for before, after in steps[:4]:
        assert set(ids(after)) <= set(ids(before)) and len(set(ids(after))) == len(ids(after))
    c = duckdb.connect()
    for n in ("documents", "labels"):
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{SF}/{n}.parquet')")
    from itemloom.llm.quality_rules import OP4_SQL

    assert set(ids(clean)) == {r[0] for r in c.sql(f"SELECT doc_id FROM ({OP4_SQL}) WHERE kept").fetchall()}
    text = {r["doc_id"]: r["text"] for r in civil.collect()}
    grams = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in ((k, t.lower().split()) for k, t in text.items())}
    likeness = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    kept = ids(single)
    assert not [(a, b) for a in kept for b in kept if a < b and likeness(a, b) >= 0.8]
    gone = set(text) - set(kept)
    assert all(max(likeness(g, o) for o in text if o != g) > 0.5 for g in gone)
    assert set(ids(redacted)) == set(kept) and not redacted.filter("text RLIKE '[a-z]@mail[0-9]'").count()
    assert set(ids(packed)) == set(kept)
    assert cp.ORACLE_SQL is None


def small_set(spark, tmp_path, rows, labels):
    """A data set of documents (with columns that clash with working names) and labels."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, _in string, _rid int, `a.b` int"
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 1, 2) for i, t in rows], kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_run_on_odd_rows(spark, tmp_path):
    text = lambda k, n=80: " ".join(f"word{k}x{i}" for i in range(n)) + "."
    rows = [(k, text(k)) for k in range(12)]
    rows += [(12, None), (13, ""), (14, " \n "), (15, "short one."), (None, text(99)), (None, None), (3, text(3)), (16, text(4)), (17, text(50, 30_000))]
    rows += [(18, text(60) + "\nmail me at someone@mail.example.com now."), (19, text(61) + "\nAll rights reserved.")]
    d = small_set(spark, tmp_path, rows, [(0, 0), (1, 0), (2, 1)])
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == spark.read.parquet(f"{d}/documents.parquet").columns
        seen[name] = [r.asDict() for r in docs.collect()]
    good = Counter([*range(12), None, 3, *range(16, 20)])
    assert Counter(r["doc_id"] for r in seen["quality rules"]) == good
    kept = {r["doc_id"]: r for r in seen["near duplicates"]}
    assert len(seen["near duplicates"]) == len(kept) and 16 not in kept and kept.keys() == {r["doc_id"] for r in seen["toxicity"]} - {16}
    last = {r["doc_id"]: r["text"] for r in seen["personal data"]}
    assert "[EMAIL]" in last[18] and "someone@" not in last[18] and "rights" not in last[19] and len(last[17].split()) == 30_000
    packed = cp.run(spark, d).collect()
    assert {r["doc_id"] for r in packed} == last.keys() and sum(r["length"] for r in packed) == sum({r["doc_id"]: r["doc_tokens"] for r in packed}.values())


def test_run_on_empty_tables(spark, tmp_path):
    assert cp.run(spark, small_set(spark, tmp_path, [], [])).count() == 0
