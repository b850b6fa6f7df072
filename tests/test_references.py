"""Deletion over a graph of references on literal cases."""

from __future__ import annotations

import pytest

from itemloom.operators import references
from itemloom.operators.references import Reference

KEYS = {"a": "id", "b": "id", "c": "id", "v": "id"}


def frame(spark, rows, columns):
    return spark.createDataFrame(rows, ", ".join(f"{c} int" for c in columns))


def tables(spark):
    return {
        "a": frame(spark, [(1,), (2,), (3,)], ["id"]),
        "b": frame(spark, [(10, 1), (11, 1), (20, 2), (30, 3)], ["id", "a"]),
        "c": frame(spark, [(100, 10, 1), (200, 20, 3), (300, None, 1)], ["id", "b", "a"]),
        "v": frame(spark, [(1, 10, None), (2, 10, 1), (3, 10, 2), (4, 20, None), (5, None, 3), (6, 30, 6)], ["id", "b", "before"]),
    }


def keys_of(df):
    return {(r["relation"], r["key"]) for r in df.collect()}


def test_restrict_wins_over_cascade(spark):
    refs = [Reference("b", "a", "a", "cascade"), Reference("c", "b", "b", "restrict")]
    done = references.deletion(tables(spark), KEYS, refs, "a", frame(spark, [(1,), (3,), (3,), (9,)], ["id"]))
    assert keys_of(done["deleted"]) == {("a", 3), ("b", 30)} and keys_of(done["nulled"]) == set()
    assert [tuple(r) for r in done["forbidden"].collect()] == [(1, "c", "b", 100)]


def test_null_and_chains_of_any_length(spark):
    refs = [Reference("b", "a", "a", "cascade"), Reference("c", "b", "b", "null"), Reference("c", "a", "a", "null"), Reference("v", "b", "b", "cascade"), Reference("v", "before", "v", "cascade")]
    done = references.deletion(tables(spark), KEYS, refs, "a", frame(spark, [(1,), (3,)], ["id"]))
    assert keys_of(done["deleted"]) == {("a", 1), ("a", 3), ("b", 10), ("b", 11), ("b", 30), ("v", 1), ("v", 2), ("v", 3), ("v", 5), ("v", 6)}
    assert {tuple(r) for r in done["nulled"].collect()} == {("c", "b", 100), ("c", "a", 100), ("c", "a", 300), ("c", "a", 200)}
    left = references.after(tables(spark), KEYS, done)
    assert {t: sorted(tuple(r) for r in d.collect()) for t, d in left.items()} == {"a": [(2,)], "b": [(20, 2)], "c": [(100, None, None), (200, 20, None), (300, None, None)], "v": [(4, 20, None)]}


def test_a_row_that_goes_with_another_root_is_not_emptied(spark):
    refs = [Reference("c", "b", "b", "cascade"), Reference("c", "a", "a", "null"), Reference("b", "a", "a", "cascade")]
    done = references.deletion(tables(spark), KEYS, refs, "a", frame(spark, [(1,)], ["id"]))
    assert keys_of(done["deleted"]) == {("a", 1), ("b", 10), ("b", 11), ("c", 100)} and keys_of(done["nulled"]) == {("c", 300)}


def test_references_that_go_round_raise(spark):
    with pytest.raises(ValueError, match="go round"):
        references.reading_order([Reference("a", "x", "b", "null"), Reference("b", "a", "a", "cascade")], ["a", "b"])
    with pytest.raises(ValueError, match="drop"):
        Reference("a", "x", "b", "drop")
