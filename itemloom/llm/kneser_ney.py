r"""LM scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by the workers.

1. Words are counted. Their 64-bit hashes (XXH64), sorted, are the vocabulary; a word's place in it is its number.
2. Pairs (word before, word) are counted by their two numbers, one exact 64-bit key. Each task adds up its own pairs first; the
   sums are dealt to shards by the first word, hot first words also by the second (no first word gets more than a shard's share), and
   each shard is written as a sorted key array with its counts.
3. The shards give, for each context, its total and how many words followed it once, twice and more often, and for each word the
   number of words before it. From the counts of counts come the discounts (D1, D2, D3+ of both orders).
4. Scoring maps the sorted arrays (numpy memory maps: pages are shared by all workers of a machine and need no heap) and looks
   a batch's distinct pairs up in order. p(v|u) = (c - D(c)) / c(u) + g(u) * p1(v); p1 interpolates with 1 / (V + 1).

The arrays lie in the shared folder (spark.checkpoint.dir), which every executor must see as a path; files are renamed into place,
so a task that runs again replaces like with like. A shard holds about ``shard_rows`` rows however large the corpus.
Nothing but totals comes to the driver. The order is 2 for the sake of disk: see the README.

Defined results: a null or empty text is its end token alone; a null doc_id counts as training; without training text every word
is unknown and p = 1 / (V + 1) = 1; repeated rows count and score each; extra columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.llm.common import remove, work_path, written
from itemloom.sources import table

END = b"\n"  # no word holds a line break
SHARD_ROWS = 2_000_000
RANGE_BITS = 20
SCORED_CHARS = 8_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Places(dict):
    """Word -> its place in the order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each token in the distinct ones, tokens of each text, hashes of the distinct ones as signed longs)."""
    seen = _Places({END: 0})
    place, ids, sizes = seen.__getitem__, array("i"), np.empty(len(texts), np.int64)
    for k, t in enumerate(texts):
        w = t.encode("utf-8").lower().split() if t else []
        ids.extend(map(place, w))
        ids.append(0)
        sizes[k] = len(w) + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w) for w in seen), np.uint64, len(seen)).view(np.int64)
    return np.frombuffer(ids, np.int32).astype(np.int64), sizes, hashes


def local_path(path: str) -> str:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"the shared folder {path} is no path that workers can map; set spark.checkpoint.dir to a mounted one")
    return path


def save(folder: str, name: str, array: np.ndarray) -> None:
    tmp = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with open(tmp, "wb") as f:
        np.save(f, array)
    os.replace(tmp, f"{folder}/{name}.npy")


class Arrays:
    """The model's memory-mapped arrays, opened when first used. ``names`` lists those that were written: one that is listed but can't be
    opened raises, so a worker that does not see the folder never takes missing counts for none."""

    def __init__(self, folder: str):
        self.folder, self.names, self.open = folder, set(), {}

    def __getstate__(self):
        return {"folder": self.folder, "names": self.names, "open": {}}

    def __call__(self, name: str) -> np.ndarray | None:
        if name not in self.names:
            return None
        if name not in self.open:
            self.open[name] = np.load(f"{self.folder}/{name}.npy", mmap_mode="r")
        return self.open[name]


def find_sorted(keys: np.ndarray | None, wanted: np.ndarray) -> np.ndarray:
    """Places of *wanted* in the sorted *keys*, -1 where it is missing."""
    if keys is None or not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.searchsorted(keys, wanted)
    ok = keys[np.minimum(at, len(keys) - 1)] == wanted
    return np.where(ok, at, -1)


class Vocabulary:
    """Hash ranges of the vocabulary: word hash -> number and count."""

    def __init__(self, arrays: Arrays, bits: int, starts: list[int]):
        self.arrays, self.bits, self.starts = arrays, bits, starts

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        part = (hashes.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        for p in np.unique(part):
            m = np.flatnonzero(part == p)
            at = find_sorted(self.arrays(f"word-{p}"), hashes[m].view(np.uint64))
            hit = at >= 0
            number[m[hit]] = at[hit] + self.starts[p]
            if hit.any():
                count[m[hit]] = self.arrays(f"count-{p}")[at[hit]]
        return number, count


def shard_of(u: np.ndarray, v: np.ndarray, cuts: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each pair: by the first word, spread over *cuts* places by the second where the first is hot."""
    spread = u.astype(np.uint64) * np.uint64(1 << 16) + (v.astype(np.uint64) * _MIX >> np.uint64(40)) % np.maximum(cuts, 1).astype(np.uint64)
    x = spread * _MIX
    return ((x ^ (x >> np.uint64(29))) * _MIX >> np.uint64(33)).astype(np.int64) % shards


def pairs_of(ids: np.ndarray, sizes: np.ndarray, first: int) -> np.ndarray:
    """The id before each token; *first* before a text's first one."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.concatenate(([0], np.cumsum(sizes)[:-1]))[: len(sizes)]] = first
    return before


def discounts(n: np.ndarray) -> np.ndarray:
    """D(0), D1, D2, D3+ of modified Kneser-Ney from the counts of counts n1..n4; plain 0.5, 1, 1.5 where they are missing."""
    n1, n2, n3, n4 = map(float, n)
    if not (n1 and n2 and n3):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *[min(max(d, 0.05), k) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]])


class Model:
    def __init__(self, words: Vocabulary, total: int, size: int, hot: float, shards: int):
        self.words, self.total, self.size, self.hot, self.shards = words, total, size, hot, shards
        self.d2 = self.d1 = np.zeros(4)
        self.pairs_before, self.rest = 0, 1.0

    def cuts(self, count: np.ndarray) -> np.ndarray:
        return np.minimum(np.ceil(count / self.hot), 1 << 16).astype(np.int64)

    def counts_of(self, number: np.ndarray) -> np.ndarray:
        """Counts of words by their numbers; the mark before a text's first word counts as the most frequent."""
        starts = np.array(self.words.starts)
        count = np.full(len(number), np.iinfo(np.int64).max)
        part = np.searchsorted(starts, number, side="right") - 1
        for p in np.unique(part[number < self.size]):
            m = np.flatnonzero((part == p) & (number < self.size))
            count[m] = self.words.arrays(f"count-{p}")[number[m] - starts[p]]
        return count

    def _dense(self, name: str, number: np.ndarray) -> np.ndarray:
        """Rows of a dense array by number, 0 where the number is -1."""
        out = None
        part = number >> RANGE_BITS
        for p in np.unique(part[number >= 0]):
            a = self.words.arrays(f"{name}-{p}")
            m = np.flatnonzero((part == p) & (number >= 0))
            if a is None:
                continue
            out = np.zeros((len(number), *a.shape[1:])) if out is None else out
            out[m] = a[number[m] - (p << RANGE_BITS)]
        return out

    def score(self, texts: list[str | None]):
        """n_tokens, n_known, base_score, score of each text."""
        ids, sizes, hashes = tokens_of(texts)
        number, count = self.words.look(hashes)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        base = np.log10((count + 1) / (self.total + self.size + 1))
        sums = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0)
        a = self._dense("before", number)
        a = np.zeros(len(number)) if a is None else a
        low = np.full(len(number), 1 / (self.size + 1))
        if self.pairs_before:
            low = np.maximum(a - self.d1[np.minimum(a, 3).astype(int)], 0) / self.pairs_before + self.rest / (self.size + 1)
        # distinct pairs of this batch, as (local id before, local id); BOS is one more local id
        n = len(hashes)
        keys, place = np.unique(pairs_of(ids, sizes, n) * np.int64(n + 1) + ids, return_inverse=True)
        lu, lv = keys // (n + 1), keys % (n + 1)
        number_u, count_u = np.append(number, self.size), np.append(count, np.iinfo(np.int64).max)
        ctx = self._dense("context", number_u)
        p = low[lv]
        if ctx is not None:
            total, gamma = ctx[lu, 0], ctx[lu, 1]
            known = np.flatnonzero((total > 0) & (number_u[lu] >= 0) & (number[lv] >= 0))
            c = np.zeros(len(keys))
            u, v = number_u[lu[known]], number[lv[known]]
            shard, key = shard_of(u, v, self.cuts(count_u[lu[known]]), self.shards), (u << 32) | v
            order = np.lexsort((key, shard))
            ends = np.searchsorted(shard[order], np.arange(self.shards + 1))
            for s in range(self.shards):
                m = order[ends[s] : ends[s + 1]]
                if len(m):
                    at = find_sorted(self.words.arrays(f"pair-{s}"), key[m])
                    hit = at >= 0
                    if hit.any():
                        c[known[m[hit]]] = self.words.arrays(f"times-{s}")[at[hit]]
            safe = np.maximum(total, 1)
            p = np.where(total > 0, np.maximum(c - self.d2[np.minimum(c, 3).astype(int)], 0) / safe + gamma * p, p)
        return sizes, sums((count > 0)[ids].astype(np.int64)), sums(base[ids]), sums(np.log10(p)[place])


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def train(docs: DataFrame, shard_rows: int = SHARD_ROWS) -> Model:
    """A model of the ``text`` of *docs*."""
    spark = docs.sparkSession
    folder = work_path(spark, "kneser-ney")
    path = local_path(folder)
    os.makedirs(path, exist_ok=True)
    arrays = Arrays(path)
    own = docs.select("text")

    def count_words(batches):
        for b in batches:
            ids, _, hashes = tokens_of(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.bincount(ids, minlength=len(hashes)))], ["h", "c"])

    counted = written(own.mapInArrow(count_words, "h long, c long").filter("c > 0").groupBy("h").agg(F.sum("c").alias("c")), "kn-words")
    size, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    if size >= 1 << 31:
        raise ValueError("more than 2**31 distinct words")
    bits = max(0, int(np.ceil(np.log2(max(size, 1) / shard_rows * 2))))
    part = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)

    def write_words(t: pa.Table) -> pa.Table:
        p = t.column("p")[0].as_py()
        h = t.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        save(path, f"word-{p}", h[order])
        save(path, f"count-{p}", t.column("c").to_numpy()[order])
        return pa.table({"p": pa.array([p], pa.int32()), "n": pa.array([len(h)], pa.int64())})

    sizes = dict(counted.withColumn("p", part).groupBy("p").applyInArrow(write_words, "p int, n long").collect())
    arrays.names |= {f"{kind}-{p}" for p in sizes for kind in ("word", "count")}
    starts = [0]
    for p in range(1 << bits):
        starts.append(starts[-1] + sizes.get(p, 0))
    shards = max(1, -(-total // shard_rows))
    model = Model(Vocabulary(arrays, bits, starts), total, size, max(1.0, total / shards / 4), shards)
    if not total:
        return model

    def count_pairs(batches):
        for b in batches:
            ids, n, hashes = tokens_of(b.column(0).to_pylist())
            number = model.words.look(hashes)[0]
            keys, c = np.unique((pairs_of(number[ids], n, size) << 32) | number[ids], return_counts=True)
            u = keys >> 32
            edge = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
            by_word = np.repeat(model.counts_of(u[edge]), np.diff(np.append(edge, len(u))))
            s = shard_of(u, keys & 0xFFFFFFFF, model.cuts(by_word), shards)
            for k in range(0, len(keys), 200_000):
                i = slice(k, k + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(s[i].astype(np.int32)), pa.array(keys[i]), pa.array(c[i].astype(np.int32))], ["s", "k", "c"])

    def write_pairs(batches):
        ks, cs, s = [], [], TaskContext.get().partitionId()
        for b in batches:
            ks.append(b.column(1).to_numpy())
            cs.append(b.column(2).to_numpy().astype(np.int64))
        keys, c = _sum_by(np.concatenate(ks or [np.zeros(0, np.int64)]), np.concatenate(cs or [np.zeros(0, np.int64)]))
        save(path, f"pair-{s}", keys)
        save(path, f"times-{s}", c.astype(np.int32) if not len(c) or c.max() < 1 << 31 else c)
        u, v = keys >> 32, keys & 0xFFFFFFFF
        at = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1]))) if len(u) else np.zeros(0, np.int64)
        add = lambda x: np.add.reduceat(x.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
        word, before = np.unique(v, return_counts=True)
        zero = np.zeros(len(word), np.int64)
        coc = [int((c == k).sum()) for k in (1, 2, 3, 4)]
        cols = [np.concatenate(x) for x in ((np.zeros(len(at)), np.ones(len(word)), [2]), (u[at], word, [0]), (add(c), before, [coc[0]]), (add(c == 1), zero, [coc[1]]), (add(c == 2), zero, [coc[2]]), (add(c >= 3), zero, [coc[3]]))]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], ["kind", "id", "x1", "x2", "x3", "x4"])

    kinds = ", ".join(f"{c} long" for c in ("kind", "id", "x1", "x2", "x3", "x4"))
    dealt = own.mapInArrow(count_pairs, "s int, k long, c int").repartitionById(shards, F.col("s"))
    stats = written(dealt.mapInArrow(write_pairs, kinds), "kn-stats")
    n = [f"x{k}" for k in range(1, 5)]
    summed = written(stats.groupBy("kind", "id").agg(*[F.sum(x).alias(x) for x in n]), "kn-sums")
    twos = summed.filter("kind = 2").select(*n).first()
    ones = summed.filter("kind = 1").agg(*[F.count_if(F.col("x1") == k) for k in range(1, 5)], F.count_if(F.col("x1") >= 3), F.sum("x1")).first()
    model.d2, model.d1, model.pairs_before = discounts(np.array(twos)), discounts(np.array(ones[:4])), int(ones[5])
    model.rest = float((model.d1[1] * ones[0] + model.d1[2] * ones[1] + model.d1[3] * ones[4]) / ones[5])
    d2 = model.d2

    def write_dense(t: pa.Table) -> pa.Table:
        kind, r = t.column("kind")[0].as_py(), t.column("r")[0].as_py()
        at = t.column("id").to_numpy() - (r << RANGE_BITS)
        x = [t.column(c).to_numpy().astype(float) for c in n]
        if kind:
            out = np.zeros(int(at.max()) + 1, np.float32 if x[0].max() < 1 << 24 else float)
            out[at] = x[0]
            save(path, f"before-{r}", np.pad(out, (0, (1 << RANGE_BITS) - len(out))))
        else:
            out = np.zeros((1 << RANGE_BITS, 2))
            out[at, 0] = x[0]
            out[at, 1] = (d2[1] * x[1] + d2[2] * x[2] + d2[3] * x[3]) / x[0]
            save(path, f"context-{r}", out)
        return pa.table({"kind": pa.array([kind], pa.int64()), "r": pa.array([r], pa.int64())})

    ranged = summed.filter("kind < 2").withColumn("r", F.shiftright("id", RANGE_BITS))
    done = ranged.groupBy("kind", "r").applyInArrow(write_dense, "kind long, r long").collect()  # a row for 2**RANGE_BITS words
    arrays.names |= {f"{'before' if x['kind'] else 'context'}-{x['r']}" for x in done} | {f"{kind}-{k}" for k in range(shards) for kind in ("pair", "times")}
    for t in (stats, summed, counted):
        for f in t.inputFiles()[:1]:
            remove(spark, f.rsplit("/", 1)[0])
    return model


def parts_of(batch: pa.RecordBatch, chars: int = SCORED_CHARS):
    """A batch in slices of about *chars* characters, at least a row each, which bounds a worker's arrays."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) // chars
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
    return [batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score."""

    def run(batches):
        for b in (part for whole in batches for part in parts_of(whole)):
            n, known, base, score = model.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(known.astype(np.int64)), pa.array(base, pa.float64()), pa.array(score, pa.float64())], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))
    model = train(docs.filter(~held_out))
    got = score_documents(docs, model)
    return got.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
