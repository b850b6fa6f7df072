"""Embedding whitening: upper-triangle column aggregates in Spark SQL, eigenvectors by LAPACK.

Every entry c of a vector becomes the long floor(scale * c) + shift. A first aggregation gives the number of vectors n and the sums S of
each dimension; a second one sums, for every pair of dimensions, the products of entries centred at the whole number m next to S / n.
What is left of the mean, r = S - n * m, is taken off afterwards: V = (n * P - r r') / n^2. Where a bound from the least and largest
entries proves that the sums of products fit a long, P is summed in longs and V is exact but for one rounding; else in doubles.

The second aggregation takes all pairs at once, by generated SQL expressions: it groups by a dimension i and a block b, and its t-th
column sums the products of dimension i with the one k = BLOCK * b + t places further on, round the end, for k up to D / 2: every pair
of the upper triangle once (those half-way round twice). So it has BLOCK columns for any number of dimensions, which Spark compiles as
one loop; one column a pair (2,080 for 64 dimensions) took 0.7 ms a vector and 12 s to compile. Each task sends a row a group; no vector
leaves its task, and the driver gets about D * D / 2 numbers, whatever the number of vectors.

Defined results: vectors that are null, empty, of another length than ``width`` or hold null or non-finite entries take no part
(``width`` unset: the most frequent length, of equally frequent ones the larger); repeated rows count each; a null vec_id stays null;
a component whose variance is zero to working precision has a null ``whitened`` (with one vector, or equal ones, all have), and takes no
part in identity_error; where all variances are zero, ``explained`` is null too; an empty table gives no rows; extra columns, clashing
names too, are ignored. An entry whose long would reach 2^62 raises: it cannot be held exactly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.sources import table

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
BLOCK = 32
LONG = 2**63


def whole_vectors(vectors: DataFrame, width: int | None = None, scale: int = SCALE, shift: int = SHIFT) -> tuple[DataFrame, int]:
    """vec_id and x, the vectors that take part as arrays of longs, with their width (0: there are none)."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = vectors.select("vec_id", "embedding").filter(finite & (F.size("embedding") > 0))
    if width is None:
        common = good.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
        width = common["width"] if common else 0
    scaled = lambda c: c.cast("double") * scale
    large = F.raise_error(F.lit("an entry is too large for whitening")).cast("long")  # for finite ones only: Spark may compute x before the filter
    whole = lambda c: F.when(F.abs(scaled(c)) < 2.0**62 - shift, F.floor(scaled(c)) + F.lit(shift).cast("long")).when(F.abs(c) < float("inf"), large)
    return good.filter(F.size("embedding") == width).select("vec_id", F.transform("embedding", whole).alias("x")), width


@dataclass
class Whitening:
    """n, the sums, and the components by falling variance: ``values`` and unit ``vectors`` (a row each)."""

    n: int
    sums: list[int]
    near: list[int]  # the whole numbers next to the means
    bound: int  # no centred entry is larger
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def rest(self) -> list[int]:
        return [s - self.n * m for s, m in zip(self.sums, self.near, strict=True)]

    def sound(self) -> np.ndarray:
        """Which components have a variance above rounding."""
        return self.values > max(float(self.values[0]) * len(self.sums) * np.finfo(float).eps, 0.0)


def centred(x: DataFrame, near: list[int], keep: list[str]) -> DataFrame:
    """*keep* and y0, y1, ...: the entries less the whole numbers *near*."""
    return x.select(*keep, *[(F.get("x", F.lit(i)) - F.lit(m).cast("long")).alias(f"y{i}") for i, m in enumerate(near)])


def product_sums(x: DataFrame, near: list[int], kind: str, block: int = BLOCK) -> dict[tuple[int, int], int | float]:
    """For dimensions i <= j the sum over *x* of the products of their entries less *near*, added up as *kind*."""
    width = len(near)
    reach = width // 2 + 1
    y = x.select(F.zip_with("x", F.array(*[F.lit(m).cast("long") for m in near]), lambda a, m: (a - m).cast(kind)).alias("y"))
    pairs = y.select("y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("i")).select("y", "i", F.explode(F.sequence(F.lit(0), F.lit((reach - 1) // block))).alias("b"))
    sums = pairs.groupBy("i", "b").agg(*[F.expr(f"sum(get(y, i) * get(y, (i + {block} * b + {t}) % {width}))").alias(f"p{t}") for t in range(min(block, reach))])
    found = {}
    for r in sums.collect():  # a row for each dimension and block
        for k in range(block * r["b"], min(reach, block * (r["b"] + 1))):
            i, j = r["i"], (r["i"] + k) % width
            found[min(i, j), max(i, j)] = r[f"p{k - block * r['b']}"]
    return found


def fit_whitening(x: DataFrame, width: int) -> Whitening | None:
    """The whitening of *x* (x array<bigint> of *width* entries), or None if it has no rows."""
    each = x.select(F.posexplode("x").alias("i", "c")).groupBy("i")
    first = sorted(each.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.min("c").alias("low"), F.max("c").alias("high")).collect())  # a row a dimension
    if not first:
        return None
    n, sums = first[0]["n"], [int(r["s"]) for r in first]
    near = [(2 * s + n) // (2 * n) for s in sums]
    bound = max(max(r["high"] - m, m - r["low"]) for r, m in zip(first, near, strict=True))
    exact = n * bound * bound < LONG
    products = product_sums(x, near, "bigint" if exact else "double")
    rest, v = [s - n * m for s, m in zip(sums, near, strict=True)], np.zeros((width, width))
    for (i, j), p in products.items():
        v[i, j] = v[j, i] = (n * p - rest[i] * rest[j]) / (n * n) if exact else p / n - (rest[i] / n) * (rest[j] / n)
    values, vectors = np.linalg.eigh(v)
    return Whitening(n, sums, near, bound, math.fsum(np.diag(v)), values[::-1], vectors[:, ::-1].T)


def _deviation(w: Whitening) -> Column:
    """Sum over dimensions of (n * x - S)^2, as decimal(38, 0); summed in longs where these are proven to hold it."""
    kind = "bigint" if len(w.sums) * (w.n * (w.bound + 1)) ** 2 < LONG else "decimal(38, 0)"
    square = lambda i, r: f"({w.n} * cast(y{i} AS {kind}) - cast({r} AS {kind})) * ({w.n} * cast(y{i} AS {kind}) - cast({r} AS {kind}))"
    return F.expr(" + ".join(f"cast({square(i, r)} AS {kind})" for i, r in enumerate(w.rest))).cast("decimal(38, 0)")


def whiten(x: DataFrame, w: Whitening, components: int = COMPONENTS) -> DataFrame:
    """vec_id, deviation (decimal) and w1, w2, ...: each vector's first *components* whitened coordinates."""
    y = centred(x, w.near, ["vec_id"])
    off = y.select("*", *[(F.col(f"y{i}").cast("double") - r / w.n).alias(f"d{i}") for i, r in enumerate(w.rest)])

    def along(k: int) -> Column:
        if not w.sound()[k]:
            return F.lit(None).cast("double")
        weights = w.vectors[k] / math.sqrt(w.values[k])
        return F.expr(" + ".join(f"d{i} * {float(a)!r}D" for i, a in enumerate(weights)))

    return off.select("vec_id", _deviation(w).alias("deviation"), *[along(k).alias(f"w{k + 1}") for k in range(min(components, len(w.sums)))])


def identity_error(white: DataFrame, w: Whitening) -> float | None:
    """The largest absolute entry of the whitened coordinates' covariance minus the identity."""
    cols = [c for k, c in enumerate(c for c in white.columns if c[0] == "w") if w.sound()[k]]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    if not pairs:
        return None
    row = white.select(*[F.covar_pop(cols[i], cols[j]) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(row, pairs, strict=True))


RESULT = "vec_id {}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whitened_components(vectors: DataFrame, components: int = COMPONENTS, width: int | None = None) -> DataFrame:
    """One row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    x, width = whole_vectors(vectors, width)
    w = fit_whitening(x, width)
    if w is None:
        return vectors.sparkSession.createDataFrame([], RESULT.format(dict(vectors.dtypes)["vec_id"]))
    white = whiten(x, w, components)
    error = identity_error(white, w)
    each = [
        F.struct(F.lit(k + 1).alias("component"), F.col(f"w{k + 1}").alias("whitened"), F.lit(float(w.values[k] / w.trace) if w.trace > 0 else None).cast("double").alias("explained"))
        for k in range(len(white.columns) - 2)
    ]
    rows = white.select("vec_id", "deviation", F.explode(F.array(*each)).alias("c"))
    return rows.select("vec_id", "c.component", F.lit(w.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
