"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

The measure is the largest inner product. Vectors are lifted by one coordinate, sqrt(M^2 - |x|^2) with M the largest norm (0 for
queries), which makes the order of inner products the order of Euclidean distances. A Gaussian (2-stable) matrix projects the
lifted vectors to ``dims`` dimensions: squared projected distance over squared true distance is chi-square with ``dims`` degrees.

The projected space is cut into shards by a kd-tree over a bounded sample of projections (it only decides the balance; every row is
indexed). A shard over ``shard_rows`` rows is cut into parts by hash. In a part a kd-tree gives leaves with boxes. Queries take
leaves in the order of their boxes' distance, some at a time (``STEPS``); in a leaf only vectors whose own projected distance p passes
the chi-square test, p^2 <= stop * d_k^2 with d_k the distance of the k-th best so far, are verified exactly; a query stops
when its next box fails the test. ``stop`` is the quantile of p^2 / d_k^2 that keeps ``recall`` of the true neighbours of
``FIT_QUERIES`` vectors among a sample of ``FIT_ROWS`` (of the chi-square law at ``recall`` where the sample is too small). Queries are first answered in their own shard; the bound found there decides, by the same test
on the shards' cells, which other shards they visit. ``verified`` and ``shards`` report how much each query looked at.

Exact copies of a vector tie, and ties go to the smaller vec_id; so of each vector only the rows of its k + 1 smallest ids, k of each at
most, can be among the k nearest of any query, as a query leaves out the rows of one id. These stand for it in the index. Nothing else
is left out. Queries that reach a part are cut into blocks of ``QUERY_ROWS`` or so, each with a task of its own.

Defined results: vectors that are null, empty, zero, of another length than ``width`` (if given), or hold null or non-finite
components take no part, as queries or candidates; null vec_ids neither; repeated rows are candidates each; a query with fewer
candidates than k returns them all; different vectors under one query id are queries each, told apart by ``query_no`` (repeated rows
are one query); rows of the query's own id are never its candidates; a vector whose squared length is beyond a double raises; an empty
table gives no rows; extra columns (clashing names too) are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itemloom.llm.common import written
from itemloom.sources import table

K = 20
DIMS = 8
RECALL = 0.98
FIT_ROWS = 4_000
FIT_QUERIES = 200
SHARD_ROWS = 20_000
LEAST_SHARDS = 12  # of a small table, so that several tasks share it
LEAF_ROWS = 256
SAMPLE_ROWS = 100_000
QUERY_BLOCK = 512
QUERY_ROWS = 20_000
#: Leaves that a query takes between two looks at its bound: the first ones, then more at a time.
STEPS = (1, 2, 4, 8, 16)


def chi_square_quantile(p: float, dims: int) -> float:
    """The quantile of the chi-square law with an even number of degrees, by bisection of its closed form."""
    if dims % 2:
        raise ValueError("dims must be even")
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        term, total = 1.0, 0.0
        for i in range(dims // 2):
            total += term
            term *= mid / 2 / (i + 1)
        lo, hi = (mid, hi) if 1 - math.exp(-mid / 2) * total < p else (lo, mid)
    return hi


def kd_boxes(points: np.ndarray, leaf_rows: int) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree: each node splits its widest dimension at the median."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        idx = todo.pop()
        if len(idx) <= leaf_rows:
            out.append(idx)
            continue
        own = points[idx]
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        order = idx[np.argsort(own[:, axis], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return out


class Cells:
    """A kd-tree over all of space. Nodes are (axis, cut, left, right), ``<= cut`` is left; a child below 0 is the shard -1 - child."""

    def __init__(self, sample: np.ndarray, shards: int):
        axis, cut, child, slots, n = [], [], [], [], 0
        heap = [(-len(sample), 0, sample, None, 0)]
        while heap:
            _, _, own, parent, side = heapq.heappop(heap)
            at = self._median(own) if len(heap) + len(slots) + 1 < shards else None
            if at is None:
                slots.append((parent, side))
                continue
            me = len(axis)
            axis.append(at[0])
            cut.append(at[1])
            child.append([0, 0])
            if parent is not None:
                child[parent][side] = me
            left = own[:, at[0]] <= at[1]
            for k, part in enumerate((own[left], own[~left])):
                n += 1
                heapq.heappush(heap, (-len(part), n, part, me, k))
        for i, (parent, side) in enumerate(slots):
            if parent is not None:
                child[parent][side] = -1 - i
        self.axis, self.cut, self.child, self.shards = np.array(axis, np.int64), np.array(cut, float), np.array(child, np.int64).reshape(-1, 2), len(slots)

    @staticmethod
    def _median(own: np.ndarray) -> tuple[int, float] | None:
        if len(own) < 4:
            return None
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        cut = float(np.median(own[:, axis]))
        return (axis, cut) if 0 < np.count_nonzero(own[:, axis] <= cut) < len(own) else None

    def home(self, points: np.ndarray) -> np.ndarray:
        at = np.full(len(points), 0 if len(self.axis) else -1, np.int64)
        while len(rows := np.flatnonzero(at >= 0)):
            n = at[rows]
            at[rows] = self.child[n, (points[rows, self.axis[n]] > self.cut[n]).astype(np.int64)]
        return -1 - at

    def reached(self, points: np.ndarray, radius2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) wherever a ball of squared *radius2* around a point may meet a shard's cell."""
        row, node, gap = np.arange(len(points)), np.full(len(points), 0 if len(self.axis) else -1, np.int64), np.zeros(points.shape)
        found = []
        while len(row):
            done = node < 0
            found.append((row[done], -1 - node[done]))
            row, node, gap = row[~done], node[~done], gap[~done]
            a, over = self.axis[node], points[row, self.axis[node]] - self.cut[node]
            parts = []
            for side, beyond in ((0, np.maximum(0.0, over)), (1, np.maximum(0.0, -over))):
                g = gap.copy()
                g[np.arange(len(g)), a] = np.maximum(g[np.arange(len(g)), a], beyond)
                m = (g**2).sum(axis=1) <= radius2[row]
                parts.append((row[m], self.child[node[m], side], g[m]))
            row, node, gap = (np.concatenate(x) for x in zip(*parts, strict=True))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (row, node)


def usable(v: Column, width: int | None) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return fine & (F.size(v) == width) if width else fine


class Projection:
    def __init__(self, width: int, dims: int, top: float, seed: int = 7):
        self.matrix = np.random.default_rng(seed).standard_normal((width + 1, dims))
        self.top = top

    def __call__(self, x: np.ndarray, query: bool) -> np.ndarray:
        lift = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.top**2 - (x**2).sum(axis=1)))
        return x @ self.matrix[:-1] + lift[:, None] * self.matrix[-1]


def _best(q: np.ndarray, i: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Places of the best k of each query: largest score, ties to the smaller id."""
    order = np.lexsort((i, -s, q))
    first = np.flatnonzero(np.concatenate(([True], q[order][1:] != q[order][:-1]))) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


class Part:
    """Some vectors with their projections and the leaves of a kd-tree over these."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, proj: Projection, leaf_rows: int):
        leaves = kd_boxes(px := proj(x, False), leaf_rows)
        order, self.ends = np.concatenate(leaves), np.concatenate(([0], np.cumsum([len(r) for r in leaves])))
        self.ids, self.x, self.px, self.proj = ids[order], x[order], px[order], proj
        self.low, self.high = (np.array([f(px[r], axis=0) for r in leaves]) for f in (np.min, np.max))
        self.p2 = (self.px**2).sum(axis=1)

    def search(self, qid: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, stop: float):
        """(query row, vec_id, score) of the best k of each query here, and how many vectors each verified. *bound*: a score that k
        candidates have elsewhere."""
        out, verified = [], np.zeros(len(q), np.int64)
        for b in range(0, len(q), QUERY_BLOCK):
            m = slice(b, b + QUERY_BLOCK)
            r, i, s = self._block(qid[m], q[m], bound[m].copy(), k, stop, verified[m])
            out.append((r + b, i, s))
        return *(np.concatenate(x) for x in zip(*out, strict=True)), verified

    def _block(self, qid, q, worst, k, stop, verified):
        pq, top2 = self.proj(q, True), self.proj.top**2 + (q**2).sum(axis=1)
        gap2 = (np.maximum(0.0, np.maximum(self.low[None] - pq[:, None], pq[:, None] - self.high[None])) ** 2).sum(axis=2)
        order, q2 = np.argsort(gap2, axis=1), (pq**2).sum(axis=1)
        slack = 1e-9 * (1 + self.proj.top * np.sqrt((q**2).sum(axis=1)))
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        at, step, open_ = 0, 0, np.arange(len(q))
        while at < order.shape[1] and len(open_):
            width = STEPS[min(step, len(STEPS) - 1)]
            some, at, step = order[open_, at : at + width], at + width, step + 1
            limit = stop * (np.maximum(0.0, top2 - 2 * worst) + 1e-9)  # infinite while k are wanting
            leaf, asks = some.ravel(), np.repeat(open_, some.shape[1])
            go = gap2[asks, leaf] <= limit[asks]
            leaf, asks = leaf[go], asks[go]
            by = np.argsort(leaf, kind="stable")
            cuts = np.flatnonzero(np.diff(leaf[by])) + 1
            got = [found]
            for group in np.split(by, cuts) if len(by) else []:
                n, who = leaf[group[0]], asks[group]
                rows = slice(self.ends[n], self.ends[n + 1])
                near = q2[who, None] + self.p2[None, rows] - 2 * (pq[who] @ self.px[rows].T) <= limit[who, None] + 1e-9
                near &= self.ids[None, rows] != qid[who, None]
                np.add.at(verified, who, near.sum(axis=1))
                s = q[who] @ self.x[rows].T
                a, c = np.nonzero(near & (s >= (worst[who] - slack[who])[:, None]))
                exact = np.einsum("ij,ij->i", q[who[a]], self.x[rows][c])  # the same sum for copies wherever they lie
                keep = exact >= worst[who[a]]
                got.append([who[a][keep], self.ids[rows][c][keep], exact[keep]])
            found = [np.concatenate(x) for x in zip(*got, strict=True)]
            best = _best(*found, k)
            found = [x[best] for x in found]
            full = np.bincount(found[0], minlength=len(q)) >= k
            last = np.full(len(q), np.inf)
            np.minimum.at(last, found[0], found[2])
            worst[full] = np.maximum(worst[full], last[full])
            if at < order.shape[1]:
                limit = stop * (np.maximum(0.0, top2 - 2 * worst) + 1e-9)
                open_ = open_[gap2[open_, order[open_, at]] <= limit[open_]]
        return found


def fit_stop(x: np.ndarray, proj: Projection, k: int, recall: float) -> float:
    """The squared projected distance, in units of d_k^2, within which *recall* of the k nearest of some rows of *x* lie."""
    law = chi_square_quantile(recall, proj.matrix.shape[1])
    if len(x) < 4 * k:
        return law
    q = x[:: max(1, len(x) // FIT_QUERIES)][:FIT_QUERIES]
    s = q @ x.T
    s[np.arange(len(q)), np.arange(0, len(x), max(1, len(x) // FIT_QUERIES))[: len(q)]] = -np.inf
    top = np.argpartition(-s, k, axis=1)[:, :k]
    far2 = np.maximum(0.0, proj.top**2 + (q**2).sum(axis=1) - 2 * np.take_along_axis(s, top, axis=1).min(axis=1))
    p2 = ((proj(q, True)[:, None] - proj(x, False)[top]) ** 2).sum(axis=2)
    return float(np.quantile((p2[far2 > 0] / far2[far2 > 0, None]).ravel(), recall)) if (far2 > 0).any() else law


FOUND = "query_id long, query_no int, vec_id long, score double, verified long"


def nearest(vectors: DataFrame, query: Column, k: int = K, dims: int = DIMS, recall: float = RECALL, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS, query_rows: int = QUERY_ROWS, width: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score, verified, shards, query_no: the k nearest other rows of each row of *vectors* (vec_id, embedding) that *query* picks.

    verified: vectors compared exactly for the query; shards: shards that it visited; both of all its rows alike."""
    spark = vectors.sparkSession
    good = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"), width))
    norm2 = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    each = good.groupBy("embedding", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("copies"))
    first = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))  # only k + 1 ids of a vector leave a task
    few = each.withColumn("n", first).filter(F.col("n") <= k + 1)
    index = written(few.select("vec_id", "embedding", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col"), "ann-index")
    total, top, width, other = index.agg(F.count(F.lit(1)), F.sqrt(F.max(norm2)), F.max(F.size("embedding")), F.min(F.size("embedding"))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, verified long, shards long, query_no int")
    if not math.isfinite(top):
        raise ValueError("a vector's squared length is beyond a double; scale the vectors")
    if width != other:
        raise ValueError(f"embeddings have {other} to {width} components; give width")
    proj = Projection(width, dims, top)

    def matrix(col: pa.Array) -> np.ndarray:
        return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)

    def project(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(proj(matrix(b.column(1)), False)), pa.list_(pa.float64()))], ["p"])

    share = min(1.0, SAMPLE_ROWS / total)
    picked = index.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * SAMPLE_ROWS)
    stop = fit_stop(np.array([r[0] for r in picked.select("embedding").limit(FIT_ROWS).collect()], float), proj, k, recall)
    sample = np.array([r[0] for r in picked.mapInArrow(project, "p array<double>").collect()]).reshape(-1, dims)
    cells = spark.sparkContext.broadcast(Cells(sample, max(1, math.ceil(total / min(shard_rows, max(leaf_rows, total // LEAST_SHARDS))))))

    def to_cells(query: bool):
        def run(batches):
            for b in batches:
                yield b.append_column("shard", pa.array(cells.value.home(proj(matrix(b.column(1)), query)), pa.int64()))

        return run

    def to_others(batches):
        for b in batches:
            x = matrix(b.column(1))
            p, bound = proj(x, True), b.column(3).to_numpy(zero_copy_only=False)
            far2 = np.maximum(0.0, top**2 + (x**2).sum(axis=1) - 2 * bound) + 1e-9
            rows, shards = cells.value.reached(p, stop * np.where(np.isfinite(bound), far2, np.inf))
            m = shards != cells.value.home(p)[rows]
            yield b.take(pa.array(rows[m])).append_column("shard", pa.array(shards[m], pa.int64()))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "query_no": pd.Series(dtype="int32"), "vec_id": pd.Series(dtype="Int64"), "score": pd.Series(dtype="float64"), "verified": pd.Series(dtype="int64")})
        part = Part(left["vec_id"].to_numpy(np.int64), np.stack(left["embedding"].to_numpy()).astype(float), proj, leaf_rows)
        qid, no = right["vec_id"].to_numpy(np.int64), right["query_no"].to_numpy(np.int32)
        q, i, s, n = part.search(qid, np.stack(right["embedding"].to_numpy()).astype(float), right["bound"].to_numpy(float), k, stop)
        return pd.DataFrame({"query_id": np.concatenate((qid[q], qid)), "query_no": np.concatenate((no[q], no)), "vec_id": pd.array(np.concatenate((i, np.zeros(len(qid), np.int64))), "Int64").copy(), "score": np.concatenate((s, np.full(len(qid), np.nan))), "verified": np.concatenate((np.zeros(len(q), np.int64), n))}).assign(
            vec_id=lambda d: d["vec_id"].where(d["score"].notna())  # a row without a vector tells what the query looked at here
        )

    kind = dict(index.dtypes)["embedding"]
    placed = index.mapInArrow(to_cells(False), f"vec_id long, embedding {kind}, shard long")
    sizes = F.broadcast(placed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("parts")))  # a row for each leaf of the tree, which the sample bounds
    placed = placed.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).drop("parts")

    def seen(asked: DataFrame) -> DataFrame:
        """What the queries *asked* (with the shard each visits) find there; a group is a part of a shard and a block of its queries."""
        blocks = F.broadcast(asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / query_rows).alias("blocks")))  # a row a shard, as sizes
        left = placed.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
        right = asked.join(sizes, "shard").join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("vec_id", "query_no"), F.col("blocks"))).drop("blocks")
        right = right.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        group = ["shard", "part", "block"]
        return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(search, FOUND)

    number = F.row_number().over(W.partitionBy("vec_id").orderBy("embedding"))
    queries = good.filter(query).distinct().select("vec_id", "embedding", number.alias("query_no"))
    own = queries.mapInArrow(to_cells(True), f"vec_id long, embedding {kind}, query_no int, shard long").withColumn("bound", F.lit(float("-inf")))
    near = written(seen(own), "ann-near")
    one = ["query_id", "query_no"]
    rank = F.row_number().over(W.partitionBy(*one).orderBy(F.desc("score")))
    bounds = near.filter("vec_id IS NOT NULL").withColumn("n", rank).filter(F.col("n") <= k).groupBy(*one).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("b"))
    asked = queries.join(bounds.withColumnRenamed("query_id", "vec_id"), ["vec_id", "query_no"], "left").select("vec_id", "embedding", "query_no", F.coalesce("b", F.lit(float("-inf"))).alias("bound"))
    far = seen(asked.mapInArrow(to_others, f"vec_id long, embedding {kind}, query_no int, bound double, shard long"))
    every = W.partitionBy(*one)
    rank = F.row_number().over(every.orderBy(F.col("vec_id").isNull(), F.desc("score"), F.asc("vec_id")))
    both = near.unionByName(far).withColumns({"rank": rank, "verified": F.sum("verified").over(every), "shards": F.count_if(F.col("vec_id").isNull()).over(every)})
    best = both.filter((F.col("rank") <= k) & F.col("vec_id").isNotNull())
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "verified", "shards", "query_no")


def op2_stable_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
