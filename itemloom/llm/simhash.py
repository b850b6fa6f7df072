"""SimHash near-duplicates, linked exactly through vantage-point trees.

Fingerprints: SimHash over word shingles (XXH64, seed 42); 64 bits, or more words of 64 bits from the same hashes mixed with other
constants. Two texts are linked if their fingerprints differ in at most ``max_distance`` bits; groups are the connected components.

Trees. The bits are cut into blocks. With ``parts`` blocks, fingerprints at distance d differ by at most ``d // parts`` bits in one
block at least, so a vantage-point tree over each block, asked with that radius, finds every link (``parts=1``: one tree over all bits).
A key may also join ``joined`` blocks: of d + j blocks j at least are equal, so trees over all choices of j of them find every link
at radius 0, with keys so long that shards stay small in a larger table (``cuts_for`` chooses by the rows; every cut gives the same links).
Each inner node has a vantage point and a radius mu; a fingerprint goes inside if its distance to the vantage point is at most mu.
By the triangle inequality a query of radius r needs the inside only if its distance minus r is at most mu, and the
outside only if its distance plus r is above mu: one that is near the boundary is sent to both sides, everything else is pruned.
With 5 blocks and distance 4 the radius is 0, so boundaries have no width, a fingerprint goes to 5 shards and no more,
and the candidates fall with the number of shards; with fewer blocks more shards overlap. A task goes on within its shard: a tree of
its own over the same keys cuts it to leaves of about ``LEAF_ROWS``, so the work does not grow with the square of a shard.

``similar`` is for a similarity (Jaccard) of shingle sets instead of a distance in bits. Blocks of ``BLOCK_BITS`` (as many as find a
pair at the threshold with ``recall``, whatever the number of rows) and a loose distance find candidates only. The shingle sets of the texts that have a
candidate are written to the shared folder, which every executor must see as a path; the workers map them and link two texts if and
only if the Jaccard similarity of their two whole sets is at least ``similarity``. A pair that is joined already is not compared.

The trees are built from a bounded sample of fingerprints (``SAMPLE_ROWS``, and ``MAX_SHARE`` of a small table), which only decides the
balance, and are broadcast; their leaves follow the rows, up to a quarter of the sample. Each leaf is compared exactly, in numpy blocks;
a shard over ``task_rows`` is cut into parts by hash and each pair of parts is compared on its own, so no task gets an unbounded shard. A shard gives a spanning forest
of its links, never all pairs. Components come from minimum labels and pointer jumping over these edges.

Defined results: a text without words (null or empty too) has fingerprint zero and is linked like any other; repeated rows each
give their row; a null doc_id takes part and its row's component is the smallest id reachable (null if there is none); extra
columns are ignored; an empty table gives no rows. In ``similar`` texts without words are alike, and like no others.
"""

from __future__ import annotations

import heapq
import math
import os
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.llm.common import work_path, written
from itemloom.llm.kneser_ney import local_path
from itemloom.sources import table

MAX_DISTANCE = 4
SAMPLE_ROWS = 40_000
MAX_SHARE = 0.25
SHARD_ROWS = 1_000
LEAF_ROWS = 256
TASK_ROWS = 20_000
BLOCK_BITS = 16
COMPARED = 64
NEAR_WORDS = 4
MAX_ROUNDS = 200
U = np.uint64


# --- fingerprints ---------------------------------------------------------------------------------------------------------


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of a whole text, A-Z lower-cased; of all its words, if there are fewer; nothing without words."""
    w = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z change, only the contract's six blanks split
    if not w:
        return np.zeros(0, U)
    joined = b" ".join(w)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], U)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, n = xxhash.xxh64_intdigest, len(w) - words + 1
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)), U, n)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another 64 bits of each hash (splitmix64 of the hash and k); k = 0: the hash itself."""
    if not k:
        return h
    x = h + U(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def fingerprint(text: str | None, words: int = 4, wide: int = 1) -> np.ndarray:
    """The SimHash of a whole text as *wide* numbers of 64 bits."""
    return _simhash(shingle_hashes(text, words), wide)


def _simhash(h: np.ndarray, wide: int) -> np.ndarray:
    out = np.zeros(wide, U)
    for k in range(wide if len(h) else 0):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(h), 1 << 16):
            ones += np.unpackbits(_mixed(h[i : i + (1 << 16)], k).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[k] = int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")
    return out


def with_fingerprints(docs: DataFrame, words: int = 4, wide: int = 1) -> DataFrame:
    """doc_id, bits (the fingerprint, big-endian)."""

    def run(batches):
        for b in batches:
            bits = [fingerprint(t, words, wide).astype(">u8").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.binary())], ["doc_id", "bits"])

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, bits binary")


def to_words(bits: list[bytes], wide: int) -> np.ndarray:
    return np.frombuffer(b"".join(bits), ">u8").astype(U).reshape(-1, wide)


def key_of(fps: np.ndarray, blocks: list[tuple[int, int]]) -> np.ndarray:
    """The bits of some blocks (first bit, size; 64 at most together) of each fingerprint, as numbers."""
    out = np.zeros(len(fps), U)
    for first, size in blocks:
        out = out << U(size) | block_of(fps, first, size)
    return out


def block_of(fps: np.ndarray, first: int, size: int) -> np.ndarray:
    """Bits first to first + size (at most 64) of each fingerprint, as numbers."""
    word, shift = divmod(first, 64)
    out = fps[:, word] << U(shift) if shift else fps[:, word].copy()
    if shift + size > 64:
        out |= fps[:, word + 1] >> U(64 - shift)
    return out >> U(64 - size)


# --- vantage-point trees --------------------------------------------------------------------------------------------------


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def build_tree(sample: np.ndarray, leaves: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vantage points, radii, children (inside, outside)) of the nodes; a child below 0 is the leaf -1 - child.

    The largest part of the sample is split next, at the vantage point and radius, of a few tried, that halve it best."""
    vantage, radius, children, heap, slots = [], [], [], [(-len(sample), 0, sample, None, 0)], []
    while heap:
        _, at, part, parent, side = heapq.heappop(heap)
        best = None
        if len(slots) + len(heap) + 1 < leaves and len(part) >= 4:
            tried = part[rng.integers(0, len(part), 4)]
            for v in np.unique(tried):
                d = distance(part, v)
                for mu in {int(np.median(d)), max(0, int(np.median(d)) - 1)}:
                    inside = int(np.count_nonzero(d <= mu))
                    if 0 < inside < len(part) and (best is None or abs(2 * inside - len(part)) < best[0]):
                        best = (abs(2 * inside - len(part)), v, mu, d <= mu)
        if best is None:
            slots.append((parent, side))
            continue
        me = len(vantage)
        vantage.append(best[1])
        radius.append(best[2])
        children.append([0, 0])
        if parent is not None:
            children[parent][side] = me
        for side, own in ((0, part[best[3]]), (1, part[~best[3]])):
            heapq.heappush(heap, (-len(own), 2 * me + side + 1, own, me, side))
    for k, (parent, side) in enumerate(slots):
        if parent is not None:
            children[parent][side] = -1 - k
    return np.array(vantage, U), np.array(radius, np.int64), np.array(children, np.int64).reshape(-1, 2)


def route(values: np.ndarray, tree, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home?) for every leaf that the ball of *radius* around each value meets; home is where it lies itself."""
    vantage, mu, children = tree
    row, node, own = np.arange(len(values)), np.full(len(values), 0 if len(vantage) else -1), np.ones(len(values), bool)
    done = []
    while len(row):
        leaf = node < 0
        if leaf.any():
            done.append((row[leaf], -1 - node[leaf], own[leaf]))
            row, node, own = row[~leaf], node[~leaf], own[~leaf]
            continue
        d = distance(values[row], vantage[node]).astype(np.int64)
        m = mu[node]
        parts = [(keep, side, own & mine) for side, keep, mine in ((0, d - radius <= m, d <= m), (1, d + radius > m, d > m))]
        row, node, own = (np.concatenate(x) for x in ([row[k] for k, _, _ in parts], [children[node[k], s] for k, s, _ in parts], [o[k] for k, _, o in parts]))
    return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (row, node, own)


# --- exact links in a shard -----------------------------------------------------------------------------------------------


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of each pair; parents are always smaller, so the root is the smallest index."""
    while len(a):
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up
        a, b = parent[a], parent[b]
        m = a != b
        a, b = a[m], b[m]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(parent, hi, lo)


class ShingleSets:
    """The written shingle sets, mapped when first used; the place of a set is (file, first, size)."""

    def __init__(self, folder: str, similarity: float):
        self.folder, self.similarity, self.open = folder, similarity, {}

    def __getstate__(self):
        return {"folder": self.folder, "similarity": self.similarity, "open": {}}

    def __call__(self, file: int, first: int, size: int) -> np.ndarray:
        if file not in self.open:
            self.open[file] = np.memmap(f"{self.folder}/{file}.u64", U, "r")
        return self.open[file][first : first + size]

    def alike(self, one: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Whether the set at place *one* has the similarity with each set at places *others*."""
        a, size = int(one[2]), others[:, 2].astype(np.int64)
        out = np.minimum(size, a) >= self.similarity * np.maximum(size, a) - 1e-6  # the sizes alone may rule it out
        some = np.flatnonzero(out & (size > 0))
        if not a or not len(some):
            return out & (size == a)
        mine, sets = self(*one.tolist()), [self(*p) for p in others[some].tolist()]
        joined = np.concatenate(sets)
        hit = mine[np.minimum(np.searchsorted(mine, joined), a - 1)] == joined
        both = np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum(size[some])[:-1])))
        out[some] = both / (a + size[some] - both) >= self.similarity
        return out


def _join_alike(root: np.ndarray, i: int, others: np.ndarray, places: np.ndarray, sets: ShingleSets) -> None:
    """Join row *i* with those *others* that are alike; those of its own component need no look."""
    step = 1
    while len(others := others[root[others] != root[i]]):
        some, others, step = others[:step], others[step:], min(4 * step, COMPARED)
        for j in some[sets.alike(places[i], places[some])]:
            lo, hi = sorted((root[i], root[j]))
            if lo != hi:
                root[root == hi] = lo


def spanning_forest(fps: np.ndarray, query: np.ndarray, indexed: np.ndarray, max_distance: int, near_words: int | None = None, sets: ShingleSets | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (index, index) that connect what links query rows with indexed rows at *max_distance* bits or less.

    The distance is that of the first *near_words* words; with *sets*, rows end in their set's place and the sets must be alike too."""
    parent = np.arange(len(fps))
    q, x = np.flatnonzero(query), np.flatnonzero(indexed)
    step = max(1, 2_000_000 // max(1, len(x)))
    for k in range(0, len(q), step):
        some = q[k : k + step]
        near = np.zeros((len(some), len(x)), np.uint16)
        for w in range(fps.shape[1] if near_words is None else near_words):
            near += distance(fps[some, w][:, None], fps[x, w][None, :])
        r, c = np.nonzero(near <= max_distance)
        if sets is None:
            _union(parent, some[r], x[c])
            continue
        ends = np.searchsorted(r, np.arange(len(some) + 1))
        for n, i in enumerate(some.tolist()):
            others = x[c[ends[n] : ends[n + 1]]]
            if indexed[i]:
                others = others[(others > i) | ~query[others]]  # the rest asked before
            _join_alike(parent, i, others, fps[:, -3:], sets)
    while not np.array_equal(parent[parent], parent):
        parent = parent[parent]
    child = np.flatnonzero(parent != np.arange(len(fps)))
    return child, parent[child]


def leaves_of(keys: np.ndarray, radius: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, at home?) of the leaves of a vantage-point tree over a shard's keys: of all pairs of rows whose keys are within
    *radius*, each row meets the other's home leaf."""
    tree = build_tree(keys[:: max(1, len(keys) // (64 * LEAF_ROWS))], -(-len(keys) // LEAF_ROWS), rng)
    row, leaf, home = route(keys, tree, radius)
    order = np.argsort(leaf, kind="stable")
    cuts = np.flatnonzero(np.diff(leaf[order])) + 1
    return [(row[g], home[g]) for g in np.split(order, cuts)]


def forest(fps: np.ndarray, keys: np.ndarray, radius: int, query: np.ndarray, indexed: np.ndarray, max_distance: int, **how) -> tuple[np.ndarray, np.ndarray]:
    """``spanning_forest`` of a shard, leaf by leaf where it is large."""
    if len(fps) <= 4 * LEAF_ROWS:
        return spanning_forest(fps, query, indexed, max_distance, **how)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for rows, home in leaves_of(keys, radius, np.random.default_rng(len(fps))):
        if len(rows) > 1:
            child, root = spanning_forest(fps[rows], query[rows], indexed[rows] & home, max_distance, **how)
            found.append((rows[child], rows[root]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def links(nodes: DataFrame, wide: int, blocks: list[list[tuple[int, int]]], radius: int, max_distance: int, shard_rows: int = SHARD_ROWS, task_rows: int = TASK_ROWS, first: int = 0, **how) -> DataFrame:
    """a, b (nodes): edges whose components are those of all links that the *blocks* (lists of (first bit, size)) find at *radius*.

    *nodes*: node (long) and bits (wide * 8 bytes), one row a node; comparing needs the words from *first* on. *how* goes to
    ``spanning_forest``."""
    spark = nodes.sparkSession
    total = nodes.count()
    share = min(MAX_SHARE, SAMPLE_ROWS / max(total, 1))
    picked = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * SAMPLE_ROWS)
    sample = to_words([bytes(r[0]) for r in picked.select("bits").collect()], wide)
    leaves, rng = max(1, 2 * total // shard_rows), np.random.default_rng(20)
    trees = spark.sparkContext.broadcast([build_tree(key_of(sample, b), leaves, rng) for b in blocks])
    n, rest = len(blocks), wide - first

    def shards(batches):
        for b in batches:
            fps = to_words(b.column(1).to_pylist(), wide)
            bits = pa.array([x.tobytes() for x in fps[:, first:].astype(">u8")], pa.binary()) if first else b.column(1)
            for k, (block, tree) in enumerate(zip(blocks, trees.value, strict=True)):
                key = key_of(fps, block)
                row, leaf, home = route(key, tree, radius)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(leaf * n + k, pa.int64()), b.column(0).take(at), bits.take(at), pa.array(key[row].view(np.int64)), pa.array(home)], ["shard", "node", "bits", "key", "home"])

    sent = nodes.select("node", "bits").mapInArrow(shards, "shard long, node long, bits binary, key long, home boolean")
    one_part = [F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "bits", "key", "home", F.lit(0).alias("part")]
    if total > task_rows:  # a shard of m rows is cut into ceil(m / task_rows) parts, and each pair of parts is compared
        sizes = sent.select("shard").groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / task_rows).cast("int").alias("cuts")).filter("cuts > 1")
        cut = sent.join(F.broadcast(sizes), "shard", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))  # a row for each leaf at most, which the sample bounds
        cut = cut.withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("cuts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        sent = cut.select("shard", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "bits", "key", "home", "part")
    else:
        sent = sent.select("shard", *one_part)
    group = ["shard", "i", "j"]

    def one(rows: pa.Table):
        fps, home = to_words(rows.column("bits").to_pylist(), rest), rows.column("home").to_numpy(zero_copy_only=False)
        node, part, i, j = rows.column("node").to_numpy(), rows.column("part").to_numpy(), rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        order, keys = np.argsort(node, kind="stable"), rows.column("key").to_numpy().view(U)
        fps, home, node, part, keys = fps[order], home[order], node[order], part[order], keys[order]
        child, root = forest(fps, keys, radius, part == i, home & (part == j), max_distance, **how)  # all rows ask, rows at home answer
        if i != j:
            more = forest(fps, keys, radius, part == j, home & (part == i), max_distance, **how)
            child, root = np.concatenate((child, more[0])), np.concatenate((root, more[1]))
        return node[child], node[root]

    def compare(batches):
        """Groups of equal key follow each other; a group may go on in the next batch."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            cols = np.stack([b.column(k).to_numpy() for k in range(3)])
            edges = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            if held and [c[0].as_py() for c in b.columns[:3]] != [c[0].as_py() for c in held[0].columns[:3]]:
                yield from pack([held])
                held = []
            groups = [[b.slice(x, y - x)] for x, y in zip(edges, edges[1:], strict=False)]
            groups[0] = held + groups[0]
            held = groups.pop()
            yield from pack(groups)
        yield from pack([held] if held else [])

    def pack(groups):
        found = [one(pa.Table.from_batches(g)) for g in groups if sum(x.num_rows for x in g) > 1]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    dealt = sent.repartition(*[F.col(k) for k in group]).sortWithinPartitions(*group)
    return dealt.mapInArrow(compare, "a long, b long").distinct()


# --- components -----------------------------------------------------------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """node, root (the smallest node of its component) for the nodes of *edges* (a, b).

    Each round every root takes the smallest label that its members' neighbours have, then labels jump to their label's label.
    All steps are joins and minima with partial aggregation; a hot label is split by adaptive execution."""
    both = written(edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select("b", "a")).distinct(), "cc-edges")
    label = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "cc-labels")
    for _ in range(max_rounds):
        ends = both.join(label.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(label.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        hooks = ends.filter("rb < ra").groupBy(F.col("ra").alias("root")).agg(F.min("rb").alias("to"))
        hooks = written(hooks, "cc-hooks")
        jump = label.join(label.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left")
        jump = jump.join(hooks, "root", "left").select("node", F.least(F.col("root"), F.coalesce("up", F.col("root")), F.coalesce("to", F.col("root"))).alias("root"), (F.coalesce("up", F.col("root")) < F.col("root")).alias("moved"))
        label = written(jump, "cc-labels")
        if hooks.isEmpty() and label.filter("moved").isEmpty():
            return label.select("node", "root")
        label = label.select("node", "root")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _grouped(fps: DataFrame, node, how) -> DataFrame:
    """doc_id, bits, component_id; *fps* is doc_id, bits and *how* gives links for (node, bits)."""
    nodes = written(fps.groupBy("bits").agg(F.min("doc_id").alias("first")).withColumn("node", node), "simhash-nodes")
    groups = components(how(nodes.select("node", "bits")))
    grouped = nodes.join(groups, "node")
    least = grouped.groupBy("root").agg(F.min("first").alias("least"))
    of_node = grouped.join(least, "root").select("node", "least")
    per_bits = nodes.join(of_node, "node", "left").select("bits", F.coalesce("least", "first").alias("component_id"))
    return fps.join(per_bits, "bits").select("doc_id", "bits", "component_id")


def cuts_for(rows: int, max_distance: int, parts: int | None = None, joined: int | None = None) -> tuple[list[list[tuple[int, int]]], int]:
    """(keys as lists of blocks, radius) that find every link of 64-bit fingerprints at *max_distance*.

    *parts*: single blocks. Else *joined* blocks a key of max_distance + joined blocks at radius 0; as few as give keys that some
    thousand of *rows* share at most, if it is not given: a larger table costs more keys, but never other links."""
    if parts is None and joined is None:
        joined = next((j for j in (1, 2, 3) if rows >> (64 * j // (max_distance + j)) < 4_096), 4)
    count = parts or max_distance + joined
    at = [round(64 * k / count) for k in range(count + 1)]
    blocks = [(a, b - a) for a, b in zip(at, at[1:], strict=False)]
    if parts is not None:
        return [[b] for b in blocks], max_distance // parts
    return [list(c) for c in combinations(blocks, joined)], 0


def near_duplicates(docs: DataFrame, words: int = 4, max_distance: int = MAX_DISTANCE, parts: int | None = None, joined: int | None = None, **how) -> DataFrame:
    """doc_id, bits, component_id for every row of *docs*: 64-bit fingerprints, all links at *max_distance* or less."""
    fps = written(with_fingerprints(docs, words), "simhash-fps")
    blocks, radius = cuts_for(fps.count(), max_distance, parts, joined)
    return _grouped(fps, F.conv(F.hex("bits"), 16, -10).cast("long"), lambda nodes: links(nodes, 1, blocks, radius, max_distance, **how))


def plan_similar(similarity: float, recall: float, block_bits: int = BLOCK_BITS) -> tuple[int, list[list[tuple[int, int]]], int]:
    """(words of 64 bits, blocks, distance in bits) for a Jaccard similarity; nothing of it depends on the number of texts.

    Shingle sets of similarity s have cosine 2s / (1 + s) or more; a bit then differs with probability p = arccos / pi. The distance, that
    of the last ``NEAR_WORDS`` words, leaves room for 5 standard deviations, as it only finds candidates. Longer blocks are the caller's
    choice for a larger table: with n texts some n / 2**block_bits unrelated ones share a block."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    count = math.ceil(math.log(1 - recall) / math.log(1 - (1 - p) ** block_bits))
    wide, near = max(NEAR_WORDS, math.ceil(count * block_bits / 64)), 64 * NEAR_WORDS
    return wide, [[(k * block_bits, block_bits)] for k in range(count)], math.floor(near * p + 5 * math.sqrt(near * p * (1 - p)))


def _with_sets(rows: DataFrame, words: int, wide: int) -> DataFrame:
    """_rid, doc_id, bits, node (a hash of the shingle set), digest (of the text) of *rows* (_rid, _in)."""

    def run(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            found = [np.unique(shingle_hashes(t, words)) for t in texts]  # each shingle votes once
            bits = [_simhash(h, wide).astype(">u8").tobytes() for h in found]
            node = np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in found], U).view(np.int64)
            digest = [None if t is None else xxhash.xxh3_64_intdigest(t.encode("utf-8")) - (1 << 63) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.binary()), pa.array(node), pa.array(digest, pa.int64())], ["_rid", "doc_id", "bits", "node", "digest"])

    own = rows.select("_rid", F.col("_in.doc_id").alias("doc_id"), F.col("_in.text").alias("text"))
    return own.mapInArrow(run, f"_rid long, doc_id {dict(own.dtypes)['doc_id']}, bits binary, node long, digest long")


def _with_places(rows: DataFrame, words: int, folder: str) -> DataFrame:
    """node and bits, the place of the row's shingle set in *folder* added to the bits; *rows* is node, bits, text."""

    def run(batches):
        file, at, out = TaskContext.get().taskAttemptId(), 0, None  # a task that runs again writes a file of its own
        try:
            for b in batches:
                bits = []
                for known, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    h = np.unique(shingle_hashes(text, words))
                    if out is None:
                        out = open(f"{folder}/{file}.u64", "wb")
                    out.write(h.tobytes())
                    bits.append(known + np.array([file, at, len(h)], ">u8").tobytes())
                    at += len(h)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.binary())], ["node", "bits"])
        finally:
            if out is not None:
                out.close()

    return written(rows.mapInArrow(run, "node long, bits binary"), "simhash-places")


def _similar(rows: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = 0.99, block_bits: int = BLOCK_BITS, **how) -> tuple[DataFrame, DataFrame]:
    """(_rid, doc_id, bits, node, digest of each of *rows* (_rid, _in); node, root of the nodes that are linked)."""
    wide, blocks, most = plan_similar(similarity, recall, block_bits)
    fps = written(_with_sets(rows, words, wide), "simhash-fps")
    nodes = written(fps.groupBy("node").agg(F.min("bits").alias("bits"), F.min("_rid").alias("_rid")), "simhash-nodes")
    near = links(nodes, wide, blocks, 0, most, first=wide - NEAR_WORDS, near_words=NEAR_WORDS, **how)
    near = written(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "simhash-near")
    folder = local_path(work_path(rows.sparkSession, "simhash-sets"))
    os.makedirs(folder, exist_ok=True)
    asked = written(nodes.join(near, "node"), "simhash-asked")
    placed = _with_places(rows.select("_rid", F.col("_in.text").alias("text")).join(asked, "_rid").select("node", "bits", "text"), words, folder)
    found = links(placed, wide + 3, blocks, 0, most, first=wide - NEAR_WORDS, near_words=NEAR_WORDS, sets=ShingleSets(folder, similarity), **how)
    return fps, components(found)


def _numbered(docs: DataFrame, columns: list[str]) -> DataFrame:
    return written(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_in"), F.monotonically_increasing_id().alias("_rid")), "simhash-rows")


def similar(docs: DataFrame, **how) -> DataFrame:
    """doc_id, bits, component_id for every row: texts whose shingle sets have Jaccard *similarity* or more are linked."""
    fps, groups = _similar(_numbered(docs, ["doc_id", "text"]), **how)
    own = fps.groupBy("node").agg(F.min("doc_id").alias("first")).join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = own.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(own.join(least, "root").select("node", "component_id"), "node").select("doc_id", "bits", "component_id")


def deduplicate(docs: DataFrame, **how) -> DataFrame:
    """One row of each group of similar rows: of the smallest doc_id (any before none), then of the smallest digest of the text; all
    other rows stay, whatever their ids, and so do all columns."""
    rows = _numbered(docs, docs.columns)
    fps, groups = _similar(rows, **how)
    best = fps.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "_rid")).alias("best"))
    best = best.join(groups, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    return rows.join(best.select("best._rid"), "_rid", "left_semi").select("_in.*")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("bits")).alias("fingerprint"), "component_id")
