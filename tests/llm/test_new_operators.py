"""Whitening, best-fit packing and alignment against brute force, with the cases their docstrings define; cases added to older operators."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from itemloom.llm import bestfit_packing, quality_rules, stable_ann, token_alignment, toxicity, whitening
from itemloom.llm.entry import QUERIES

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>"
ODD = [(900, None), (901, [1.0, None, 2.0]), (902, [1.0, math.nan, 2.0]), (903, [math.inf, 0.0, 1.0]), (904, []), (905, [1.0, 2.0])]


# --- 11 -----------------------------------------------------------------------------------------------------------------


def plain_whitening(rows, k):
    """(vec_id, deviation, whitened row) and e / trace by numpy and Python integers."""
    x = np.array([np.floor(1024 * np.array(v, np.float64)).astype(np.int64) + 100_000 for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    c = (x - np.array([int(t) for t in s], dtype=object) / n).astype(float)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    return deviation, c @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def check_whitening(got, rows, k):
    deviation, want, share = plain_whitening(rows, k)
    by = defaultdict(list)
    for r in got:
        by[r["vec_id"]].append(r)
    ids = [i for i, _ in rows]
    assert Counter(r["vec_id"] for r in got) == Counter({i: k * n for i, n in Counter(ids).items()})
    sign = {}
    for at, i in enumerate(ids):
        own = {r["component"]: r for r in by[i] if int(r["deviation"]) == deviation[at]}
        assert sorted(own) == list(range(1, k + 1))
        for c, r in own.items():
            if abs(want[at, c - 1]) > 1e-3:
                sign.setdefault(c, np.sign(r["whitened"] * want[at, c - 1]))
            assert abs(r["whitened"] * sign.get(c, 1) - want[at, c - 1]) < 1e-9
            assert r["n"] == len(rows) and abs(r["explained"] / share[c - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening_equals_numpy(spark):
    got = QUERIES["op11_whitening"](spark, SF)
    assert got.schema.simpleString() == "struct<vec_id:bigint,component:int,n:bigint,deviation:bigint,whitened:double,explained:double,identity_error:double>"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r["embedding"]]
    check_whitening(got.collect(), [(i, v) for i, v in rows if np.isfinite(np.array(v, float)).all()], 8)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal([5, -2, 0.3], [1, 3, 0.2]).astype(np.float32)]) for i in range(40)]
    rows += rows[:3]  # repeated rows count each
    df = spark.createDataFrame(rows + ODD, VECTORS).withColumns({"x": F.lit(1), "n": F.lit(2), "w1": F.lit(3), "component": F.lit(4)})
    check_whitening(whitening.whitened_components(df).collect(), rows, 3)


def test_whitening_without_variance(spark):
    none = whitening.whitened_components(spark.createDataFrame([], VECTORS))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whitened_components(spark.createDataFrame(ODD[:4], VECTORS)).count() == 0
    one = whitening.whitened_components(spark.createDataFrame([(None, [1.0, 2.0])], VECTORS)).collect()
    assert [tuple(r)[:2] + tuple(r)[4:] for r in one] == [(None, 1, None, None, None), (None, 2, None, None, None)] and one[0]["deviation"] == 0
    flat = spark.createDataFrame([(i, [float(i), 7.0]) for i in range(9)], VECTORS)  # the second component has none
    got = whitening.whitened_components(flat).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in got) and got[0]["identity_error"] < 1e-12


def test_whitening_of_large_entries_and_many_dimensions(spark):
    big = [(i, [float(i * 10**12), float(-i * i * 10**11), 1.0 * i]) for i in range(6)]  # products beyond a long
    check_whitening(whitening.whitened_components(spark.createDataFrame(big, "vec_id long, embedding array<double>"), components=2).collect(), big, 2)
    with pytest.raises(Exception, match="too large"):
        whitening.whitened_components(spark.createDataFrame([(1, [1e200]), (2, [1.0])], "vec_id long, embedding array<double>"))
    for width in (1, 2, 5, 64, 65):
        x = np.random.default_rng(width).integers(-50, 50, (30, width))
        got = whitening.product_sums(spark.createDataFrame([(r.tolist(),) for r in x], "x array<bigint>"), [3] * width, "bigint", block=7)
        assert got == {(i, j): int(((x[:, i] - 3) * (x[:, j] - 3)).sum()) for i in range(width) for j in range(i, width)}


# --- 12 -----------------------------------------------------------------------------------------------------------------


def check_sequences(rows, texts):
    """Every piece lies gapless in a sequence of at most 1024, and the pieces are those of the contract."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for doc, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by)


def test_best_fit_packs_all(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = QUERIES["op12_bestfit_packing"](spark, SF).collect()
    n = check_sequences(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert n <= 1.05 * math.ceil(sum(r["length"] for r in rows) / 1024)


def test_best_fit_of_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, "word " * 5000), (4, "same text"), (4, "same text"), (None, "no id"), (5, "<|endoftext|> inside")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3).withColumns({"piece": F.lit(1), "length": F.lit(2), "task": F.lit(3), "n": F.lit(4)})
    check_sequences(bestfit_packing.pack_best_fit(df, P.path("byte_bpe_50k.json")).collect(), texts)
    assert bestfit_packing.pack_best_fit(df.limit(0), P.path("byte_bpe_50k.json")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plans_hold_every_piece_once(histogram):
    chosen = bestfit_packing.plan(histogram, 64, rounds=20)
    held = Counter()
    for config, n in chosen.items():
        assert n > 0 and sum(k * c for k, c in config) <= 64
        for k, c in config:
            held[k] += n * c
    assert held == Counter(histogram)
    places = bestfit_packing.Places(chosen)
    assert places.sequences == sum(chosen.values())
    length = np.repeat(list(histogram), list(histogram.values())).astype(np.int64)
    place = np.concatenate([np.arange(n) for n in histogram.values()] or [np.zeros(0, np.int64)])
    sequence, offset = places(length, place)
    for s in np.unique(sequence):
        own = np.argsort(offset[sequence == s])
        assert (offset[sequence == s][own] == np.cumsum(length[sequence == s][own]) - length[sequence == s][own]).all()


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), min_size=1, max_size=5))
def test_knapsack_is_best(limits):
    price = np.random.default_rng(sum(limits)).random(13) * 5
    knapsack = bestfit_packing.Knapsack(limits, 12)
    value, best = knapsack.solve(price), {(): 0}
    for k, n in limits.items():
        best = {c + ((k, m),): 0 for c in best for m in range(n + 1)}
    want = max(sum(price[k] * m for k, m in c) for c in best if sum(k * m for k, m in c) <= 12)
    got = knapsack.filling(12)
    assert abs(value[12] - want) < 1e-9 and abs(sum(price[k] * m for k, m in got.items()) - want) < 1e-9
    assert sum(k * m for k, m in got.items()) <= 12 and all(m <= limits[k] for k, m in got.items())


def test_the_program_beats_best_fit_where_lengths_pair_badly():
    rng = np.random.default_rng(0)
    lengths = np.clip(rng.normal(400, 80, 30_000), 1, 1023).astype(int).tolist()
    h = dict(Counter(lengths))
    assert sum(bestfit_packing.plan(h).values()) < sum(bestfit_packing.best_fit(h).values())


# --- 13 -----------------------------------------------------------------------------------------------------------------


def paths():
    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")


def brute_alignment(texts):
    """Per text (n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum), from whole texts and token byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = token_alignment.Tokenizers(*paths())  # for the bytes of tokens
    slow, pieces, found, counts = Tokenizer.from_file(paths()[0]), sentencepiece.SentencePieceProcessor(model_file=paths()[2]), [], Counter()
    slow.encode_special_tokens = True
    for text in texts:
        a = slow.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        if not text or any(b"".join(x[k] for k in own) != (" " + text).encode() for own, x in ((a, t.bytes_a), (b, t.bytes_b))):
            found.append(None)
            continue
        at = lambda own, x: list(np.cumsum([len(x[k]) for k in own]))
        ends_a, ends_b = at(a, t.bytes_a), at(b, t.bytes_b)
        cuts, said, last = sorted(set(ends_a) & set(ends_b)), [], 0
        for cut in cuts:
            side = lambda own, ends: ",".join(str(k) for k, e in zip(own, ends, strict=True) if last < e <= cut)  # noqa: B023, E731
            said.append(f"{side(a, ends_a)}|{side(b, ends_b)}")
            last = cut
        links, j = [], 0
        for i, e in enumerate(ends_a):
            start = ends_a[i - 1] if i else 0
            while ends_b[j] <= start:
                j += 1
            k = j
            while k < len(b) and (ends_b[k - 1] if k else 0) < e:
                links.append((a[i], b[k]))
                k += 1
        counts.update(links)
        found.append((len(a), len(b), len(cuts), links, hashlib.sha256(";".join(said).encode()).hexdigest()))
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    return [(0, 0, 0, 0, "", 0, 0) if x is None else (*x[:3], len(x[3]), x[4], sum(counts[k] == top[k[1]] for k in x[3]), sum(counts[k] for k in x[3])) for x in found]


NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
ODD_TEXTS = [
    None, "", " ", "  ", "a", "same text here", "same text here", "two  blanks", " leading", "trailing ", "tab\tand\nlines \n with blanks", "\u2581 mark of blanks", "<s> special </s> <|endoftext|> <unk> <0x41>",
    "naïve façade Übergrößenträger 日本語 🎉🎉 ١٢", "x" * 3000, "don't you'll we've", "a\u00a0b \u2003c \x1c d", "12345 67.89 ,,,;; (brackets)", "\x00 nul", "word " * 500,
]


def numbers_of(df):
    return Counter((r["doc_id"], *(r[c] for c in NUMBERS)) for r in df.collect())


def test_alignment_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()[:60]
    rows = [(d["doc_id"], d["text"][:3000] if d["text"] else None) for d in docs] + [(1000 + k, t) for k, t in enumerate(ODD_TEXTS)] + [(None, "no id"), (1005, "same text here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"rid": F.lit(1), "a": F.lit(2), "n_a": F.lit(3), "pairs": F.lit(4)})
    want = Counter((i, *x) for (i, _), x in zip(rows, brute_alignment([t for _, t in rows]), strict=True))
    aligned = token_alignment.written(token_alignment.aligned_documents(df, *paths()), "aligned")
    for hot in (0, 50, 10**6):
        assert numbers_of(token_alignment.with_link_counts(aligned, hot)) == want
    tokens = token_alignment.written(token_alignment.tokens_of(df, *paths()), "tokens")
    assert numbers_of(token_alignment.with_link_counts(token_alignment.written(token_alignment.relational_alignment(tokens), "aligned"))) == want
    assert token_alignment.with_link_counts(token_alignment.aligned_documents(df.limit(0), *paths())).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab ü\t\n'1.\u2581\u00a0日"), max_size=30), min_size=1, max_size=4))
def test_units_change_nothing(texts):
    t = token_alignment.Tokenizers(*paths()) if "aligner" not in HELD else None
    aligner = HELD.setdefault("aligner", token_alignment.Aligner(t) if t else None)
    whole = HELD.setdefault("whole", token_alignment.Aligner(aligner.t))
    got = aligner(texts)
    aligner.t.by_unit = False
    want = whole(texts)
    aligner.t.by_unit = True
    for x, y in zip(got, want, strict=True):
        assert x[:5] == y[:5] and (x[5] == y[5]).all() and (x[6] == y[6]).all()


HELD: dict = {}


def test_the_query_has_the_contract_columns(spark):
    got = QUERIES["op13_token_alignment"](spark, SF)
    assert dict(got.dtypes) == {"doc_id": "bigint", "groups_sha256": "string"} | {c: "bigint" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")}
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


# --- cases of older operators -------------------------------------------------------------------------------------------


def test_labels_are_split_as_the_pattern_says(spark):
    rng = np.random.default_rng(1)
    bits = [" | ", "|", " • ", "a" * 30, "b" * 31, "c", "  ", " ", "\t", "»"]
    lines = ["".join(rng.choice(bits, int(rng.integers(0, 9)))) for _ in range(3000)]
    lines += ["c" + "".join(a + m + a + b for a, m, b in zip(rng.choice([" ", "\t", "  ", ""], n, p=[0.5, 0.2, 0.2, 0.1]), rng.choice(["|", "•"], n), rng.choice(["c", "a" * 30, "b" * 31], n, p=[0.6, 0.2, 0.2]), strict=True)) for n in rng.integers(1, 5, 1000)]
    pattern = re.compile(quality_rules.LABELS.replace("$", r"\Z"))
    got = spark.createDataFrame(list(enumerate(lines)), "k int, line string").orderBy("k").select(quality_rules.only_labels(F.col("line"))).collect()
    assert [r[0] for r in got] == [bool(pattern.match(x)) for x in lines] and 50 < sum(r[0] for r in got) < 3950


def test_very_long_lines(spark):
    labels = " • ".join(f"label {k}" for k in range(100_000))
    words = " ".join(f"w{k}" for k in range(1_000_000)) + "."
    blanks = " " * 200_000 + "x" + " | " + " " * 200_000 + "y" * 40 + " | z"
    rows = [(1, labels), (2, words), (3, blanks), (4, "home " * 50_000), (5, labels + "\n" + words)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in quality_rules.quality_report(df).collect()} == {1: False, 2: True, 3: False, 4: False, 5: True}
    assert {r["doc_id"]: r["text"] for r in quality_rules.clean_documents(df).collect()} == {2: words, 5: words}


def brute_nearest(rows, queries, k):
    x = np.array([v for _, v in rows], float)
    ids = np.array([i for i, _ in rows])
    out = {}
    for q, v in queries:
        s = x @ np.array(v, float)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out.setdefault(q, []).append([(int(ids[j]), float(s[j])) for j in order])
    return out


def test_nearest_with_repeated_ids(spark):
    one, rng = [8.0 ** 0.5, 0.0], np.random.default_rng(2)
    rows = [(20, one)] * 25 + [(21, one), (22, one)] + [(k, [float(a), float(b)]) for k, (a, b) in zip(range(100, 140), rng.normal(size=(40, 2)).astype(np.float32), strict=True)]
    got = stable_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 20, k=5).orderBy("rank").collect()
    want = brute_nearest(rows, [(20, one)], 5)[20][0]
    assert [r["vec_id"] for r in got] == [i for i, _ in want] and np.allclose([r["score"] for r in got], [s for _, s in want])
    got = stable_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 21, k=5).collect()
    assert [r["vec_id"] for r in got] == [20] * 5  # repeated rows are candidates each


def test_nearest_of_several_vectors_under_one_id(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(rng.normal(size=(60, 4)).astype(np.float32))]
    rows += [(7, [9.0, 0.0, 0.0, 1.0]), (7, [9.0, 0.0, 0.0, 1.0]), (7, [0.0, 0.0, -9.0, 1.0])]
    got = defaultdict(list)
    for r in stable_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 7, k=4, query_rows=1).orderBy("rank").collect():
        got[r["query_no"]].append(r["vec_id"])
    want = brute_nearest(rows, [rows[7], rows[60], rows[62]], 4)[7]
    assert sorted(got.values()) == sorted([i for i, _ in own] for own in want)


def test_nearest_cuts_queries_into_blocks(spark):
    x = np.random.default_rng(6).normal(size=(400, 8)).astype(np.float32)
    rows = [(k, [float(a) for a in v]) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    runs = [{(r["query_id"], r["rank"]): r["vec_id"] for r in stable_ann.nearest(df, F.col("vec_id") % 4 == 0, k=5, shard_rows=150, leaf_rows=16, query_rows=n).collect()} for n in (10**6, 9)]
    assert runs[0] == runs[1]
    with pytest.raises(ValueError, match="squared length"):
        stable_ann.nearest(spark.createDataFrame([(1, [1e200, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>"), F.lit(True))


def test_a_long_training_text_is_passed_over(spark):
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 300, 30)) + (" vile rotten" if k % 3 == 0 else "")) for k in range(150)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in rows], "doc_id long, toxic int")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    few = {r["doc_id"] for r in toxicity.training_rows(d, labels, max_chars=20_000).collect()}
    first = d.select("doc_id").filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1).orderBy(F.xxhash64("doc_id")).first()[0]
    longer = d.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("long text "), 30_000)).otherwise(F.col("text")))
    assert {r["doc_id"] for r in toxicity.training_rows(longer, labels, max_chars=20_000).collect()} == few - {first}
    p = toxicity.fit_from_tables(longer, labels, max_chars=20_000).score([rows[3][1], rows[4][1]])
    assert p[0] > p[1] > 0
