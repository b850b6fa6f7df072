"""The ten operators: brute force, round trips, held-out accuracy, and the cases each docstring defines."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from itemloom.llm import byte_bpe, kneser_ney, packing, pii, quality_rules, reply_trees, simhash, stable_ann, toxicity, url_filters
from itemloom.llm.entry import ORACLE_SQL, QUERIES

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and blank texts, a long text, ties, repeated rows.
ROWS = [(1, None, "en", "s", 0), (2, "", None, None, 0), (3, " \n\t ", "en", "s", 4), (4, "One line. " * 40, "en", "s", 400), (4, "One line. " * 40, "en", "s", 400), (5, "w%d " * 3 % (1, 2, 3) + "word. " * 30_000, "en", "s", 1), (None, "no id here, but a text of its own.", "en", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).withColumns({"_q": F.lit(1), "_in": F.lit(2), "_rid": F.lit(3), "fp": F.lit(4), "node": F.lit(5), "bits": F.lit(6)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, key="doc_id"):
    out = defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name, tmp_path):
    df = QUERIES[name](spark, SF)
    df.write.parquet(f"{tmp_path}/out")
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    c.sql(f"CREATE VIEW got AS SELECT * FROM read_parquet('{tmp_path}/out/*.parquet')")
    c.sql(f"CREATE TABLE want AS {ORACLE_SQL[name]}")
    cols = ", ".join(f'"{x}"' for x in sorted(df.columns))
    n = [c.sql(f"SELECT count(*) FROM {x}").fetchall()[0][0] for x in ("got", "want", f"(SELECT {cols} FROM got EXCEPT ALL SELECT {cols} FROM want)")]
    assert n[0] == n[1] and n[2] == 0


# --- 1 ------------------------------------------------------------------------------------------------------------------


def simhash_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    import xxhash

    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints_follow_the_definition():
    for t in (None, "", "a", "A b C", "É é one Two three FOUR five six seven eight", "x " * 50):
        assert int(simhash.fingerprint(t)[0]) == simhash_of(t)


@pytest.mark.parametrize("parts", [1, 2, 3, 5])
def test_links_equal_brute_force_for_every_cut(spark, parts):
    rng = np.random.default_rng(parts)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in (1, 3, 4, 5, 6)]]))
    nodes = spark.createDataFrame([(int(f.view(np.int64)), int(f).to_bytes(8, "big")) for f in fps], "node long, bits binary")
    at = [round(64 * k / parts) for k in range(parts + 1)]
    for task_rows in (10**6, 40):
        edges = simhash.links(nodes, 1, [[(a, b - a)] for a, b in zip(at, at[1:])], 4 // parts, 4, shard_rows=30, task_rows=task_rows)
        got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
        label = {int(f.view(np.int64)): int(f.view(np.int64)) for f in fps}
        changed = True
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
        ids = fps.view(np.int64)
        while changed:
            changed = False
            for i, j in zip(*np.nonzero(near)):
                m = min(label[int(ids[i])], label[int(ids[j])])
                changed |= label[int(ids[i])] != m or label[int(ids[j])] != m
                label[int(ids[i])] = label[int(ids[j])] = m
        sizes = Counter(label.values())
        assert got == {k: v for k, v in label.items() if sizes[v] > 1}


def test_near_duplicates_cases(spark, docs, empty):
    got = rows_of(simhash.near_duplicates(docs))
    assert sum(map(len, got.values())) == len(ROWS)
    assert [got[k][0]["component_id"] for k in (1, 2, 3)] == [1, 1, 1] and got[1][0]["bits"] == bytes(8)
    assert len(got[4]) == 2 and {r["component_id"] for r in got[4]} == {4}
    assert got[None][0]["component_id"] is None
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


def test_similar_texts_are_found(spark):
    rng = np.random.default_rng(0)
    words = lambda n: [f"w{k}" for k in rng.integers(0, 5000, n)]
    rows = []
    for k in range(40):
        w = words(300)
        rows.append((2 * k, " ".join(w)))
        w[150] = w[150] + "x" if k < 20 else words(1)[0]
        rows.append((2 * k + 1, " ".join(w if k < 30 else words(300))))
    kept = {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {2 * k for k in range(40)} | {2 * k + 1 for k in range(30, 40)}


def test_only_whole_sets_decide_links(spark):
    rng = np.random.default_rng(1)
    words = lambda n: [f"w{k}" for k in rng.integers(0, 50_000, n)]
    rows = []
    for k in range(60):  # 5 or 8 changed words of 204: 175 of 225 shingles shared (0.78), or 160 of 240; 4: 180 of 220 (0.82)
        w = words(204)
        rows.append((2 * k, " ".join(w)))
        for at in range(20, 20 + 20 * (5, 8, 4)[k % 3], 20):
            w[at] += "x"
        rows.append((2 * k + 1, " ".join(w)))
    for task_rows in (20_000, 40):
        got = simhash.similar(spark.createDataFrame(rows, "doc_id long, text string"), task_rows=task_rows, recall=0.9999).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - 1 if i % 2 and i // 2 % 3 == 2 else i for i in range(120)}


def test_a_repeated_line_votes_once(spark):
    rng = np.random.default_rng(2)
    line = "please read the terms of use before you print this"
    rows = [(k, "\n".join([" ".join(f"w{x}" for x in rng.integers(0, 50_000, 110)), *[line] * 10])) for k in range(60)]
    rows += [(100, rows[0][1] + "\n" + "\n".join([line] * 30))]  # the same set, other repeats
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.similar(df).collect()}
    assert {k: r["component_id"] for k, r in got.items()} == {k: k % 100 for k in got} and got[0]["bits"] == got[100]["bits"]
    fps = simhash.to_words([got[k]["bits"] for k in range(60)], len(got[0]["bits"]) // 8)[:, -simhash.NEAR_WORDS :]
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :]).sum(axis=2)[np.triu_indices(60, 1)]
    assert apart.min() > simhash.plan_similar(0.8, 0.99)[2]  # such pairs are not even candidates


def test_every_cut_gives_the_same_links(spark):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in (2, 4, 5)], base[:1] ^ (np.arange(600, dtype=np.uint64) << np.uint64(40))]))
    nodes = spark.createDataFrame([(int(f.view(np.int64)), int(f).to_bytes(8, "big")) for f in fps], "node long, bits binary")
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    label = np.arange(len(fps))
    while not np.array_equal(new := np.where(near, label[None, :], len(fps)).min(axis=1), label):
        label = new
    ids = fps.view(np.int64)
    want = {int(ids[i]): int(ids[label == label[i]].min()) for i in range(len(fps)) if (label == label[i]).sum() > 1}
    for rows, joined in ((10, 1), (10**8, 2), (10**11, 3)):
        blocks, radius = simhash.cuts_for(rows, 4)
        assert len(blocks[0]) == joined and radius == 0
        for shard_rows in (40, 10**6):  # many shards, or one that is cut by a tree of its own
            edges = simhash.links(nodes, 1, blocks, radius, 4, shard_rows=shard_rows)
            assert {r["node"]: r["root"] for r in simhash.components(edges).collect()} == want


def test_a_task_cuts_its_shard_by_a_tree():
    rng = np.random.default_rng(12)
    keys = rng.integers(0, 1 << 20, 5000, dtype=np.uint64)
    for radius in (0, 1):
        met = {}
        for rows, home in simhash.leaves_of(keys, radius, rng):
            for r in rows.tolist():
                met.setdefault(r, set()).update(rows[home].tolist())
        for i in range(0, 5000, 250):
            assert set(np.flatnonzero(np.bitwise_count(keys ^ keys[i]) <= radius).tolist()) <= met[i]
    assert max(len(rows) for rows, _ in simhash.leaves_of(keys, 0, rng)) < 1500


def test_components_that_do_not_settle_raise(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        simhash.components(chain, max_rounds=1)


def test_each_group_keeps_one_row_and_other_rows_stay(spark):
    words = lambda k: " ".join(f"w{k}_{i}" for i in range(60))
    rows = [(1, words(1)), (1, words(2)), (None, words(3)), (None, words(3)), (None, words(4)), (5, words(4)), (7, words(7)), (7, words(7))]
    got = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == Counter([(1, words(1)), (1, words(2)), (None, words(3)), (5, words(4)), (7, words(7))])


# --- 2 ------------------------------------------------------------------------------------------------------------------


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(600, 16)) + rng.integers(0, 4, 600)[:, None], 1)
    x[100:160] = x[100]  # ties
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] * 16), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = rows_of(stable_ann.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=100, leaf_rows=16), "query_id")
    xf, hits = x.astype(np.float32).astype(float), 0
    for q in range(0, 600, 20):
        s = xf @ xf[q]
        order = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:20]
        mine = sorted(got[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        assert all(math.isclose(r["score"], s[r["vec_id"]], rel_tol=1e-12) for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(order))
    assert hits >= 0.97 * 600 and set(got) == set(range(0, 600, 20))
    assert stable_ann.nearest(df.filter("vec_id > 9000"), F.col("vec_id") > 0).count() == 0
    few = rows_of(stable_ann.nearest(df.filter("vec_id < 5"), F.col("vec_id") == 0), "query_id")
    assert len(few[0]) == 4


def test_clustered_vectors_are_pruned(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(60, 32))
    x = centre[rng.integers(0, 60, 6000)] + 0.15 * rng.normal(size=(6000, 32))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist(), "c") for k, v in enumerate(x)], "vec_id long, embedding array<float>, shard string").withColumn("part", F.lit(0))
    got = rows_of(stable_ann.nearest(df, F.col("vec_id") % 50 == 0, shard_rows=250, leaf_rows=64), "query_id")
    xf, hits = x.astype(float), 0
    for q in range(0, 6000, 50):
        s = xf @ xf[q]
        s[q] = -np.inf
        hits += len({r["vec_id"] for r in got[q]} & set(np.lexsort((np.arange(6000), -s))[:20].tolist()))
    assert hits >= 0.9 * 120 * 20
    one = [v[0] for v in got.values()]
    assert np.mean([r["verified"] for r in one]) < 0.5 * 6000 and np.mean([r["shards"] for r in one]) < 0.5 * 6000 / 250


def test_cells_keep_every_reachable_shard():
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(3000, 4)), rng.normal(size=(40, 4))
    cells = stable_ann.Cells(x[:500], 40)
    home, r2 = cells.home(x), np.full(40, 0.5)
    row, shard = cells.reached(q, r2)
    want = {(i, int(home[j])) for i in range(40) for j in np.flatnonzero(((x - q[i]) ** 2).sum(axis=1) <= 0.5)}
    assert want <= set(zip(row.tolist(), shard.tolist())) and len(row) < 40 * 40 / 2 and cells.shards == 40
    assert stable_ann.Cells(np.zeros((9, 4)), 5).home(x).max() == 0


# --- 3 ------------------------------------------------------------------------------------------------------------------


def check_packing(rows, capacity, ids):
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        assert at == capacity or at & (at - 1) == 0
    for doc, parts in by.items():
        pos = Counter()
        for r in parts:
            assert r["doc_tokens"] == len(ids[doc]) and r["ids_crc32"] == zlib.crc32(np.array(ids[doc][r["start"] : r["start"] + r["length"]], "<u4").tobytes())
            pos.update(range(r["start"], r["start"] + r["length"]))
        assert set(pos) == set(range(len(ids[doc]))) and len(set(pos.values())) == 1


def test_packing_documents(spark, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    special = spark.createDataFrame([(7, "a <|endoftext|> b", "en", "s", 1)], DOCS)
    d = docs.select(*empty.columns).union(special)
    ids = {r["doc_id"]: t.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in d.collect()}
    for ranks in (None, P.path("byte_bpe_50k.tiktoken")):
        check_packing(packing.pack_documents(d.coalesce(1), P.path("byte_bpe_50k.json"), ranks).collect(), 1024, ids)
    assert packing.pack_documents(empty, P.path("byte_bpe_50k.json")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 90), st.booleans()), max_size=60), st.integers(1, 6))
def test_packer_keeps_every_limit(items, segments):
    p = packing.DotProductPacker(64, segments, loss=48, pad=True)
    bins = []
    for k, (n, masked) in enumerate(items):
        bins += p.add(k, 0, n, min(n, 48) // 2 if masked else n)
    bins += p.flush(last=True)
    covered = Counter((k, s + i) for b in bins for k, s, t in b for i in range(t))
    assert covered == Counter((k, i) for k, (n, _) in enumerate(items) for i in range(n))
    for b in bins:
        assert sum(t for *_, t in b) <= 64 and len(b) <= segments


def test_masked_examples_keep_all_three_limits(spark):
    from itemloom.llm.packing import pack_examples, tokenized_examples

    rng = np.random.default_rng(9)
    masks = [(rng.random(n) < rng.choice([0.1, 0.5, 1.0])).tolist() for n in rng.integers(0, 200, 80)] + [[False] * 1100 + [True] * 400, None]
    d = spark.createDataFrame(list(enumerate(masks)), "k long, loss array<boolean>").withColumn("start", F.lit(1)).repartition(3)
    got = pack_examples(d, "k", capacity=256, max_segments=5, loss_capacity=90).collect()
    seqs, cover = defaultdict(list), Counter()
    for r in got:
        seqs[r["sequence_id"]].append(r)
        m = masks[r["k"]][r["start"] : r["start"] + r["length"]]
        assert r["loss_tokens"] == sum(m)
        cover.update((r["k"], i) for i in range(r["start"], r["start"] + r["length"]))
    assert cover == Counter((k, i) for k, m in enumerate(masks) for i in range(len(m or [])))
    for rows in seqs.values():
        assert sum(r["length"] for r in rows) <= 256 and len(rows) <= 5 and sum(r["loss_tokens"] for r in rows) <= 90
        assert sorted(r["offset"] for r in rows) == [sum(x["length"] for x in sorted(rows, key=lambda r: r["offset"])[:k]) for k in range(len(rows))]
    uncut = {k for k, m in enumerate(masks) if m and len(m) <= 256 and sum(m) <= 90}
    assert all(sum(r["k"] == k for r in got) == 1 for k in uncut)
    c = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "good morning"), (2, 0, None, None)], "conv_id long, turn long, role string, text string")
    e = {r["conv_id"]: r for r in tokenized_examples(reply_trees.format_conversations(c), P.path("byte_bpe_50k.json")).collect()}
    assert 0 < sum(e[1]["loss"]) < len(e[1]["ids"]) == len(e[1]["loss"]) and not any(e[2]["loss"])
    assert pack_examples(d.limit(0), "k").count() == 0


# --- 4 ------------------------------------------------------------------------------------------------------------------


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_repeated_words(spark, words):
    win = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    want = {i + k for i, w in enumerate(win) if win.count(w) > 1 for k in range(3)}
    got = quality_rules.quality_report(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert got["n_repeat_words"] == len(want) and got["n_words"] == len(words)


def test_quality_cases(spark, docs, empty):
    got = rows_of(quality_rules.quality_report(docs))
    assert [got[k][0]["kept"] for k in (1, 2, 3)] == [False] * 3 and got[5][0]["n_words"] == 30_003 and len(got[4]) == 2
    good = " ".join(f"word{k}" for k in range(60)) + "."
    d = spark.createDataFrame([(1, f"{good}\nHome | Login | Search\nAll rights reserved.", 9, "x"), (2, good.replace(" ", " % $ "), 9, "x")], "doc_id long, text string, n_chars long, _q string")
    kept = quality_rules.clean_documents(d).collect()
    assert [(r["doc_id"], r["text"], r["n_chars"], r["_q"]) for r in kept] == [(1, good, len(good), "x")]
    assert quality_rules.clean_documents(empty).columns == empty.columns and quality_rules.quality_report(empty).count() == 0


# --- 5 ------------------------------------------------------------------------------------------------------------------


def brute_kneser_ney(train, texts):
    tok = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    tr = [tok(t) for t in train]
    c = Counter(w for t in tr for w in t)
    b = Counter(p for t in tr for p in zip([None, *t], t))
    a = Counter(v for _, v in b)
    n, v = sum(c.values()), len(c)
    disc = lambda counts: kneser_ney.discounts(np.array([sum(x == k for x in counts.values()) for k in (1, 2, 3, 4)]))
    d2, d1 = disc(b), disc(a)
    rest = sum(d1[min(x, 3)] for x in a.values()) / len(b)
    total, gamma = Counter(), Counter()
    for (u, _), x in b.items():
        total[u] += x
        gamma[u] += d2[min(x, 3)]

    def p(u, w):
        low = max(a[w] - d1[min(a[w], 3)], 0) / len(b) + rest / (v + 1)
        return max(b[u, w] - d2[min(b[u, w], 3)], 0) / total[u] + gamma[u] / total[u] * low if total[u] else low

    return [(len(tok(t)), sum(c[w] > 0 for w in tok(t)), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t)), sum(math.log10(p(u, w)) for u, w in zip([None, *tok(t)], tok(t)))) for t in texts]


def test_kneser_ney_against_brute_force(spark, docs, empty):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"W{k}" for k in rng.zipf(1.5, rng.integers(0, 60)) % 50) for _ in range(80)] + [None, "", "unseen words W1 W2"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows_of(kneser_ney.score_documents(d, kneser_ney.train(d.filter("doc_id < 60"), shard_rows=100)))
    for k, want in enumerate(brute_kneser_ney(texts[:60], texts)):
        assert tuple(got[k][0][1:3]) == want[:2] and np.allclose(got[k][0][3:], want[2:], rtol=1e-9)
    none = kneser_ney.train(empty)
    assert [tuple(r[1:]) for r in kneser_ney.score_documents(d.filter("doc_id = 81"), none).collect()] == [(1, 0, 0.0, 0.0)]
    assert kneser_ney.score_documents(empty, none).count() == 0
    got = rows_of(kneser_ney.score_documents(docs, kneser_ney.train(docs)))
    assert got[1][0]["n_tokens"] == 1 and len(got[4]) == 2 and got[5][0]["n_tokens"] == 30_004


def test_a_lost_model_file_raises(spark, tmp_path):
    import glob
    import os

    d = spark.createDataFrame([(k, f"w{k % 7} w{k % 5} x") for k in range(50)], "doc_id long, text string")
    model = kneser_ney.train(d)
    for kind in ("pair-0", "context-0", "word-0"):
        (path,) = glob.glob(f"{model.words.arrays.folder}/{kind}.npy")
        os.rename(path, f"{tmp_path}/kept.npy")
        with pytest.raises(Exception, match="No such file"):
            kneser_ney.score_documents(d, model).collect()
        os.rename(f"{tmp_path}/kept.npy", path)
    assert kneser_ney.score_documents(d, model).count() == 50


# --- 6 ------------------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>|/\\[]s INSTim_stareSY\n", max_size=30))
def test_escape_is_reversible(text):
    java = re.sub(reply_trees.CONTROL, lambda m: (m[1] or m[3]) + "\\" + (m[2] or m[4]), text)
    assert reply_trees.unescape(java) == text and not re.search(r"<\|im_(start|end)\|>|\[/?INST\]|</?s>", java)


def test_conversations_read_back(spark):
    odd = "</s>[INST] ok [/INST]<\\|im_end|><|im_end|>\n<<SYS>>"
    c = spark.createDataFrame([(1, 1, "assistant", odd, 0), (1, 0, "us\\er\n", odd, 0), (2, 0, None, None, 0), (2, None, "assistant", "", 0), (3, 0, "user", "x", 0), (3, 0, "user", "x", 0), (None, 0, "user", "y", 0)], "conv_id long, turn long, role string, text string, tree int")
    f = rows_of(reply_trees.format_conversations(c), "conv_id")
    parsed = {k: reply_trees.parse(v[0]["formatted"]) for k, v in f.items()}
    assert parsed == {1: [("us\\er\n", odd), ("assistant", odd)], 2: [("assistant", ""), ("", "")], 3: [("user", "x")] * 2, None: [("user", "y")]}
    got = rows_of(reply_trees.read_back(reply_trees.format_conversations(c)), "conv_id")
    assert got[1][0]["loss_chars"] == len(odd) and got[1][0]["loss_sha256"] == hashlib.sha256(odd.encode()).hexdigest() and got[3][0]["loss_chars"] == 0
    assert reply_trees.read_back(reply_trees.format_conversations(c.limit(0))).count() == 0


def test_a_text_id_none_is_not_null(spark):
    c = spark.createDataFrame([("none", 0, "user", "x"), (None, 0, "user", "y")], "conv_id string, turn long, role string, text string")
    assert {k: len(reply_trees.parse(v[0]["formatted"])) for k, v in rows_of(reply_trees.format_conversations(c), "conv_id").items()} == {"none": 1, None: 1}


def test_branches_are_ranked(spark):
    nodes = spark.createDataFrame([("t", 1, None, 1.0), ("t", 2, 1, 5.0), ("t", 3, 1, 1.0), ("t", 4, 3, 9.0), ("t", 5, 3, 9.0), ("t", 6, 99, 2.0), ("u", 1, 2, 1.0), ("u", 2, 1, 1.0)], "tree string, node long, parent long, score double")
    got = defaultdict(list)
    for r in reply_trees.reply_paths(nodes, top_k=3).collect():
        got[r["tree"], r["rank"], r["total"]].append((-r["below"], r["node"]))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {("t", 1, 11.0): [1, 3, 4], ("t", 2, 11.0): [1, 3, 5], ("t", 3, 6.0): [1, 2]}


# --- 7 ------------------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, docs, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    b = byte_bpe.Bpe(ranks, P.PATTERN, cache_pieces=50)
    rng = np.random.default_rng(2)
    bits = ["a", "th", "ing", " ", "\n", "é", "日本", "😀", "00", "'s", "\u200b", "ß", "%", "tion"]
    for _ in range(3000):
        t = "".join(rng.choice(bits, rng.integers(0, 20)))
        ids = b.encode(t)
        assert ids == lib.encode_ordinary(t) and b.decode(ids).decode() == t
    got = rows_of(byte_bpe.round_trip(docs, path, P.PATTERN))
    for i, text, *_ in ROWS:
        r, ids = got[i][0], lib.encode_ordinary(text or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert byte_bpe.round_trip(empty, path, P.PATTERN).count() == 0


def test_unreachable_tokens_stand_for_whole_pieces_only():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abcd": 257}  # no merge makes abcd: cd is no token
    b = byte_bpe.Bpe(ranks, r"\S+|\s+")
    assert b.encode("abcd") == [257] and b.encode("abcde") == [256, 99, 100, 101] == [ranks[p] for p in byte_bpe.merge_by_rank(ranks, b"abcde")]


# --- 8 ------------------------------------------------------------------------------------------------------------------


def members(df, cascades):
    return {r["key"] for r in url_filters.with_membership(df, F.array("key"), cascades).filter("_listed").collect()}


def test_cascade_is_exact(spark):
    keys = [f"host{k}.example" for k in range(3000)]
    listed = keys[::17] + ["elsewhere.example"]
    u = spark.createDataFrame([(k,) for k in keys], "key string")
    one = url_filters.build_cascades(u, listed)
    assert members(u, one) == set(keys[::17]) and len(one) == 1 and len(one[0].levels) > 1
    assert all(bits <= url_filters.MAX_FILTER_BITS for c in one for bits, _ in c.levels)
    assert url_filters.build_cascades(u, [])[0].levels == [] and members(u, url_filters.build_cascades(u, [])) == set()
    many = url_filters.build_cascades(u, listed, max_filter_bits=900)  # a list over the bound is cut into slices
    assert len(many) > 1 and members(u, many) == set(keys[::17])


def test_a_million_listed_hosts(spark):
    n = 1_000_000
    u = spark.range(n * 5 // 4).select(F.concat(F.lit("h"), "id", F.lit(".example")).alias("key"))
    listed = spark.range(n).select(F.concat(F.lit("h"), "id", F.lit(".example")).alias("key"))
    got = url_filters.with_membership(u, F.array("key"), url_filters.build_cascades(u, listed))
    number = F.regexp_extract("key", r"h([0-9]+)", 1).cast("long")
    assert got.filter(F.col("_listed") != (number < n)).count() == 0 and got.count() == n * 5 // 4


def test_url_cases(spark):
    urls = [None, "", "nothing", "HTTP://A.Example.NET/en/x?y", "http://x.net", "http://net/", "https://www.ads-track.example.com?q", "a://b://c/d#e", "http://q.org/fr/"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: tuple(r[1:]) for r in url_filters.judge_urls(d).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[4] == ("x.net", "", None, "allow") and got[5] == ("net", "/", "net/", "block")
    assert got[6] == ("www.ads-track.example.com", "", None, "block") and got[7] == ("b:", "//c/d", None, "allow") and got[8][2:] == ("org/fr/", "allow")
    assert url_filters.judge_urls(d.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "https://x.casino-win.example.com/"), (1, "https://b.example/"), (1, "https://b.example/")], "page_id long, url string")
    assert sorted(map(str, url_filters.judge_urls(odd).select("page_id", "verdict").collect())) == sorted(["Row(page_id=None, verdict='block')", *["Row(page_id=1, verdict='allow')"] * 2])


# --- 9 ------------------------------------------------------------------------------------------------------------------


def test_gradients():
    rng, net = np.random.default_rng(0), toxicity.BiGru(4)
    x, mask, y = rng.normal(size=(5, 3, toxicity.N_IN)).astype("f"), np.ones((5, 3, 1), "f"), np.array([1, 0, 1], "f")
    mask[4, 0] = mask[3:, 1] = 0
    out, saved = net.logits(x, mask, keep=True)
    grad = net.gradients(x, mask, 1 / (1 + np.exp(-out)) - y, saved)
    loss = lambda: float(np.log1p(np.exp(-(2 * y - 1) * net.logits(x, mask).astype(float))).sum())
    for k, a in net.p.items():
        i = tuple(int(rng.integers(n)) for n in a.shape)
        a[i] += 0.01
        up = loss()
        a[i] -= 0.02
        assert abs((up - loss()) / 0.02 - grad[k][i]) < 2e-3
        a[i] += 0.01


def test_letter_gradients():
    rng, net = np.random.default_rng(0), toxicity.WordNet(3)
    places, g = toxicity.Places(["ab", "vile", "x"]), rng.normal(size=(3, toxicity.CHAR_DIMS)).astype("f")
    grad = net.gradients(*net.characters(places, keep=True), g)
    for k in "CKk":
        i = np.unravel_index(int(np.abs(grad[k]).argmax()), grad[k].shape)
        a, up = net.p[k], []
        for d in (0.005, -0.01):
            a[i] += d
            up.append(float((net.characters(places) * g).sum()))
        assert abs((up[0] - up[1]) / 0.01 - grad[k][i]) < 2e-2 * max(1, abs(grad[k][i]))


def plain_score(m, text):
    """The score of one text, word by word and gate by gate."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    p, q, lex, h = {k: v.astype(float) for k, v in m.net.p.items()}, {k: v.astype(float) for k, v in m.words.p.items()}, m.lexicon, m.net.h
    rows = []
    for w in re.findall(r"\w+", text.lower()):
        pos, neg = lex.counts[lex.words[w]] if w in lex.words else (0.0, 0.0)
        lo = math.log((pos + 0.5) / (lex.n[0] + 1)) - math.log((neg + 0.5) / (lex.n[1] + 1))
        z = lo / math.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
        c = [2, *map(ord, w), 3]
        key = {int(k): float(v) for k, v in zip(lex.keys, lex.z)}
        tri = [key.get((c[i] << 42) | (c[i + 1] << 21) | c[i + 2], 0.0) for i in range(len(w))]
        seen = pos + neg > 0
        stats = [z / 4 * seen, lo / 4 * seen, seen, sum(tri) / len(w) / 4, max(tri) / 4, min(len(w), 20) / 10, sum(x.isdigit() for x in w) / len(w), 1]
        letter = [x - 2 if x < 4 else 2 + x % (toxicity.LETTERS - 2) for x in c]
        conv = [sum(q["C"][letter[i + j]] @ q["K"][j] for j in range(3)) for i in range(len(w))]
        rows.append(np.concatenate((stats, q["E"][lex.words[w] + 1 if w in lex.words else 0], np.tanh(np.max(conv, axis=0) + q["k"]))))
    half, logits = m.window // 2, []
    for b in range(0, max(1, math.ceil(len(rows) / half) - 1)):
        x, states = rows[b * half : (b + 2) * half], {}
        for d, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
            s = np.zeros(h)
            for t in order:
                a, u = x[t] @ p["W" + d] + p["b" + d], s @ p["U" + d]
                zt, r = sig(a[:h] + u[:h]), sig(a[h : 2 * h] + u[h : 2 * h])
                s = zt * s + (1 - zt) * np.tanh(a[2 * h :] + r * u[2 * h :])
                states.setdefault(t, {})[d] = s
        both = [np.concatenate((states[t]["f"], states[t]["b"])) for t in range(len(x))]
        e = np.exp([v @ p["A"] for v in both])
        logits.append((sum(w * v for w, v in zip(e / e.sum(), both)) if both else np.zeros(2 * h)) @ p["w"] + p["c"][0])
    top = sorted(logits)[::-1][:3]
    return sig(top[0] * m.link[0] + np.mean(top) * m.link[1] + m.link[2])


def test_scores_equal_a_plain_forward_pass_and_read_whole_words():
    rng = np.random.default_rng(7)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu") for b in ("ren", "tas", "vol", "wik")]
    texts, y = [], np.arange(240) % 3 == 0
    for label in y:
        w = list(rng.choice(words, 60))
        # what is toxic stands at the end of long words that are all different
        w[int(rng.integers(60))] = "".join(rng.choice(list("abcdefgh"), 45)) + ("vilest" if label else "renkas")
        texts.append(" ".join(w))
    m = toxicity.train_model(texts, y)
    new = ["".join(rng.choice(list("abcdefgh"), 60)) + e for e in ("vilest", "renkas")]
    filler = " ".join(rng.choice(words, 100))
    odd = [texts[0], texts[1], "", "é ١٢ kata " + "x" * 300, *[f"{filler} {n} {filler}" for n in new]]
    got = m.score(odd)
    assert np.allclose(got, [plain_score(m, t) for t in odd], atol=2e-3)
    assert got[-2] > 0.7 > got[-1]


def test_windows_cover_everything():
    for n in (0, 1, 24, 25, 48, 49, 100):
        w = toxicity.windows_of(n, 48)
        assert set(w[w >= 0].tolist()) == set(range(n)) and w.shape[1] == 48


def test_toxicity_held_out(spark, docs, empty):
    rng = np.random.default_rng(4)
    bad = ["vile", "rotten", "awful", "nasty"]
    texts, y = [], rng.random(400) < 0.3
    for label in y:
        w = [f"w{k}" for k in rng.zipf(1.3, int(rng.integers(1, 300))) % 3000]
        for _ in range(4 if label else 0):
            w.insert(int(rng.integers(0, len(w) + 1)), str(rng.choice(bad)))
        texts.append(" ".join(w))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)], "doc_id long, toxic int")
    train = {r["doc_id"] for r in toxicity.training_rows(d, labels).collect()}
    assert train == {k for k in range(400) if zlib.crc32(str(k).encode()) % 3 != 1}
    assert toxicity.training_rows(d, labels, 10).count() == 10
    some = toxicity.training_rows(d, labels, 400, 5_000).collect()
    assert 0 < sum(len(r["text"]) for r in some) <= 5_000
    both = toxicity.training_rows(d.union(spark.createDataFrame([(2, "zz"), (3, "")], d.schema)), labels.union(spark.createDataFrame([(0, 1), (0, 0), (2, 7)], labels.schema)))
    kept = {r["doc_id"]: r["text"] for r in both.collect()}
    assert 0 not in kept and kept.get(2, min(texts[2], "zz")) == min(texts[2], "zz") and kept.get(3, "") == "" and both.count() == len(kept)
    model = toxicity.fit_from_tables(d, labels)
    p = model.score([t for k, t in enumerate(texts) if k not in train])
    truth = np.array([v for k, v in enumerate(y) if k not in train])
    assert ((p >= 0.7) == truth).mean() > 0.93
    got = rows_of(toxicity.with_scores(docs, model).select("_in.doc_id", "_score"))
    assert got[1][0]["_score"] == got[2][0]["_score"] and all(0 <= r["_score"] <= 1 for v in got.values() for r in v) and len(got[4]) == 2
    assert toxicity.reject_toxic(docs, model).columns == docs.columns and toxicity.reject_toxic(empty, model).count() == 0
    nothing = toxicity.fit_from_tables(d, labels.filter("toxic = 0"))
    assert nothing.score(["x", ""]).tolist() == [0, 0]


# --- 10 -----------------------------------------------------------------------------------------------------------------


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet="12.@+- ()ab%", max_size=40), st.text(alphabet="0123456789 -", max_size=60)))
def test_base_spans(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_long_runs_take_linear_time():
    assert pii.base_spans("a" * 300_000 + "1" * 300_000 + "1." * 100_000) is not None


def test_patterns_discover_unseen_identifiers(spark, docs, empty):
    rows = [(k, f"filler{k} staff mail user{k}@corp.example.org and text.") for k in range(30)]
    rows += [(100, "more words staff mail ZX-48213 here"), (101, "other words in front 48213 here"), (102, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.char_length("text").cast("long"))
    got = rows_of(pii.pii_report(d, min_support=5))
    assert got[100][0]["spans"] == "id:22:30" and got[101][0]["spans"] == "" and got[3][0]["n_email"] == 1
    red = rows_of(pii.redact_documents(d, min_support=5))
    assert red[100][0]["text"] == "more words staff mail [ID] here" and red[3][0]["text"] == "filler3 staff mail [EMAIL] and text." and red[102][0]["text"] is None
    assert red[3][0]["n_chars"] == len(red[3][0]["text"])
    got = rows_of(pii.pii_report(docs))
    assert got[1][0]["base_sha256"] == hashlib.sha256(b"").hexdigest() and len(got[4]) == 2
    again = pii.redact_documents(docs)
    assert again.columns == docs.columns and again.count() == len(ROWS) and pii.redact_documents(empty).count() == 0


def plain_graph(texts, rounds=3, hops=3, min_support=5, min_share=0.25, min_confidence=0.8):
    """Spans beside accepted patterns, with patterns as text and sets in place of hashes and joins."""
    docs, seeds = [], []
    for t in texts:
        at = [(m.span(), m[0]) for m in re.finditer(r"[^\s=:]{2,}[=:](?=[^\s=:])|\S+", t)]
        word = lambda k, at=at: pii.context_word(at[k][1]) if 0 <= k < len(at) else None
        pats = lambda i, j, at=at, word=word: [p for p in (("before", word(i - 2), word(i - 1)), ("after", word(j), word(j + 1)), ("key", word(i - 1), word(i - 1)) if i and pii.is_key(at[i - 1][1]) else ("", None, None)) if None not in p]
        taken = pii.seed_spans(t)
        docs.append([])
        for i, ((s, _), w) in enumerate(at):
            first, v = pii.value_of(w)
            free = v and all(s + first + len(v) <= a or s + first >= b for a, b in taken)
            docs[-1].append((v, s + first, s + first + len(v), pats(i, i + 1), free))
        for a, b in taken:
            i, j = sum(e <= a for (_, e), _ in at), sum(s < b for (s, _), _ in at)
            seeds += [(p, t[a:b]) for p in pats(i, j)]
    known, edges, tried, grown, accepted = Counter(seeds), {}, set(), set(), {}
    true = set(known)
    for _ in range(hops):
        times = Counter(p for d in docs for *_, ps, _ in d for p in ps)
        values, mentions = Counter(p for p, _ in known), Counter()
        for (p, _), n in known.items():
            mentions[p] += n
        many = {p for p in values if values[p] >= min_support and p not in tried}
        tried |= many
        new = {p for p in many if times[p] and mentions[p] >= min_share * times[p]}
        if not new:
            break
        for e in [(p, v) for d in docs for v, *_, ps, free in d for p in ps if free and p in new] + [e for e in known if e[0] in new]:
            edges[e] = e in true
        score = {e: float(s) for e, s in edges.items()}
        for _ in range(rounds):
            by = defaultdict(list)
            for (p, _), s in score.items():
                by[p].append(s)
            accepted = {p: sum(s) / (len(s) + 1) for p, s in by.items() if sum(s) >= min_support and sum(s) / (len(s) + 1) >= min_confidence}
            found = defaultdict(lambda: 1.0)
            for p, v in edges:
                if p in accepted:
                    found[v] *= 1 - min(accepted[p], 0.999)
            score = {(p, v): max(float(s), 1 - found[v] if v in found else 0.0) for (p, v), s in edges.items()}
        seed_values = {v for (p, v), s in edges.items() if s and p in accepted}
        unseen = {v for v in found if 1 - found[v] >= min_confidence and v not in seed_values} - grown
        if not unseen:
            break
        grown |= unseen
        known.update((p, v) for d in docs for v, *_, ps, free in d for p in ps if free and v in unseen)
    out = []
    for t, d in zip(texts, docs):
        base = pii.base_spans(t)
        out.append(sorted({(s, e) for v, s, e, ps, _ in d if v and any(p in accepted for p in ps) and all(e <= a or s >= b for _, a, b in base)}))
    return out


def test_the_graph_equals_a_plain_one(spark):
    rng = np.random.default_rng(8)
    some = [f"w{k}" for k in range(12)]
    texts = []
    for k in range(240):
        w = list(rng.choice(some, 20))
        kind = k % 6
        w[10:10] = [["reach", "me", f"u{k}@x.example.org", "or", "call"], ["reach", "me", f"Ab-{k % 25}", "today", "please"], ["pass=" + f"Ab-{k % 25}"], ["pass=Qwerty" + "xyz"[k % 3]], ["token", "=", f'"{hashlib.sha1(str(k).encode()).hexdigest()}"!!'], ["Token", "=", '"hunter-two"', "x"]][kind]
        texts.append(" ".join(w))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x.startswith("id:")] for r in pii.pii_report(d, min_confidence=0.6).collect()}
    want = plain_graph(texts, min_confidence=0.6)
    assert got == dict(enumerate(want)) and sum(map(bool, want)) > 100
    marked = lambda k: [texts[k][s:e] for s, e in want[k]]
    assert "hunter-two" in marked(5) and any("Ab-" in x for x in marked(1)) and len(marked(4)[0]) == 40 and any("Qwerty" in x for x in marked(3))


def test_short_and_plain_identifiers_and_long_contexts(spark):
    long = "x" * 5000
    rows = [(k, f"filler{k} {long} staff mail user{k}@corp.example.org and text.") for k in range(30)] + [(100, "more staff mail AB-12 here"), (101, "more staff mail Miller, here"), (102, f"{long} {'y' * 200}-no:AB-13")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("a.b", F.lit(1)).withColumn("_text", F.lit("t"))
    got = {r["doc_id"]: r for r in pii.pii_report(d).collect()}
    assert got[100]["spans"] == "id:16:21" and got[101]["spans"] == "id:16:22" and got[102]["spans"] == ""
    assert (got[3]["n_email"], got[3]["n_ip"], got[3]["n_card"], got[3]["n_phone"]) == (1, 0, 0, 0)
    red = pii.redact_documents(d)
    assert red.columns == d.columns and red.filter("doc_id = 100").first()["text"] == "more staff mail [ID] here"


def test_patterns_are_accepted_from_found_identifiers(spark):
    rows = [(k, f"filler{k} staff mail user{k}@corp.example.org and text.") for k in range(90)]
    rows += [(100 + k, f"words staff mail ZX-{48213 + k} here") for k in range(20)]  # found beside the seeds
    rows += [(200 + k, f"words badge no ZX-{48213 + k} here") for k in range(20)]  # a second hop: no seed stands here
    rows += [(300, "words badge no QY-77777 here"), (301, "words lot no QY-88888 here")]
    got = rows_of(pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[300][0]["spans"] == "id:15:23" and got[200][0]["spans"] == "id:15:23" and got[301][0]["spans"] == ""
