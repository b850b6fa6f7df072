"""Best-fit packing by the configuration linear program.

A configuration is a multiset of piece lengths that fits a sequence. Over the corpus-wide histogram h of piece lengths the program is:
fewest sequences x_c >= 0 with sum of x_c * c[l] = h[l] for every length l. It has too many configurations to be written down, so they
are priced as needed, by multiplicative weights: every length has a price, and a knapsack by dynamic programming finds, for every length, the
configuration of the highest price with it (never more of a length than there is). Those within ``SLACK`` of the best one are taken, as
long as they share no length, by some sequences each, and the prices of their lengths fall exponentially with the share that is placed
by then. The mean over all rounds, which holds as many tokens as there are, is rounded down, then up by falling fraction, while the
lengths last; best fit, longest first, places what is left, a class of equal sequences at a time. Three roundings and best fit alone are
compared, and the plan of the fewest sequences is taken. All of that works on the histogram, so its time and memory depend on the
capacity, not on the corpus.

Spark does the rest without moving texts: pieces are tokenised and numbered by length within their task and written; counts by task and
length give each piece its place among all of its length; the plan's configurations take places in order, so a piece's sequence and
offset follow by arithmetic from its length and place. A length that a third of all pieces share is no hot key, as its counts are kept
by task.

Only documents over the capacity are cut, into pieces of the capacity; the first piece is the shorter one.

Defined results: a null text counts as empty, so its document is the end id alone; null doc_ids stay null; repeated rows are packed each
on their own; an empty table gives no rows; extra columns are ignored; sequence_ids are 0, 1, ... in the plan's order.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itemloom.llm.common import written
from itemloom.llm.packing import _encoder
from itemloom.sources import table

CAPACITY = 1024
END = 2
ROUNDS = 300
#: A configuration takes so many sequences a round that they place this share of its scarcest length.
STEP = 0.1
#: A price falls by exp(-RATE * share placed beyond the mean of all lengths).
RATE = 5.0
SLACK = 0.02
#: Rounding tries each of these: sequences of the program filled less than so go to best fit.
FILLED = (0.98, 0.995, 1.0)

Config = tuple[tuple[int, int], ...]  # (length, how many), longest first


class Knapsack:
    """The best bounded knapsack of *capacity* for given prices; copies of a length go in as 1, 2, 4, ... at once."""

    def __init__(self, limits: dict[int, int], capacity: int):
        self.capacity, parts = capacity, []
        for length, most in sorted(limits.items()):
            left, size = min(most, capacity // length), 1
            while left:
                size = min(size, left)
                parts.append((length, size))
                left, size = left - size, size * 2
        self.length, self.copies = np.array(parts, np.int64).T if parts else np.zeros((2, 0), np.int64)
        self.taken = np.zeros((len(parts), capacity + 1), bool)

    def solve(self, price: np.ndarray) -> np.ndarray:
        """The highest sum of price[length] for every capacity up to the whole one."""
        value = np.zeros(self.capacity + 1)
        self.sizes = self.length * self.copies
        for k, (size, gain) in enumerate(zip(self.sizes.tolist(), (price[self.length] * self.copies).tolist(), strict=True)):
            with_it = value[: self.capacity + 1 - size] + gain
            np.greater(with_it, value[size:], out=self.taken[k, size:])
            np.maximum(with_it, value[size:], out=value[size:])
        return value

    def filling(self, room: int) -> Counter:
        """length -> how many, of the highest price in a capacity of *room*."""
        out, k = Counter(), len(self.sizes)
        while len(at := np.flatnonzero(self.taken[:k, room])):
            k = int(at[-1])
            out[int(self.length[k])] += int(self.copies[k])
            room -= int(self.sizes[k])
        return out


def fractional(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, step: float = STEP, rate: float = RATE, slack: float = SLACK) -> dict[Config, float]:
    """Configurations and how many sequences take each; together they hold as many tokens as the histogram has, and of every length nearly its share."""
    need, placed, found = np.ones(capacity + 1), np.zeros(capacity + 1), {}
    lengths = np.array(sorted(k for k, n in histogram.items() if n), np.int64)
    if not len(lengths):
        return {}
    need[lengths] = [histogram[k] for k in lengths.tolist()]
    knapsack, price = Knapsack({k: int(need[k]) for k in lengths.tolist()}, capacity), np.zeros(capacity + 1)
    for _ in range(rounds):
        price[lengths] = lengths * np.exp(np.clip(rate * (placed[lengths].mean() - placed[lengths]), -50, 50))
        value = knapsack.solve(price)
        worth = price[lengths] + value[capacity - lengths]
        order = np.argsort(-worth, kind="stable")
        used: set[int] = set()
        for length in lengths[order[worth[order] >= (1 - slack) * worth.max()]].tolist():
            if length in used:
                continue
            config = knapsack.filling(capacity - length)
            config[length] = min(config[length] + 1, histogram[length])
            if used & config.keys():
                continue
            used |= config.keys()
            much = step * min(need[k] / c for k, c in config.items())
            for k, c in config.items():
                placed[k] += much * c / need[k]
            key = tuple(sorted(config.items(), reverse=True))
            found[key] = found.get(key, 0.0) + much
    scale = sum(k * histogram[k] for k in lengths.tolist()) / sum(x * k * c for config, x in found.items() for k, c in config)
    return {config: x * scale for config, x in found.items()}


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[Config, int]:
    """Best fit, longest first; equal sequences are handled as one."""
    classes: dict[int, list[list]] = {capacity: []}  # room -> [configuration, how many sequences]
    for length in sorted(histogram, reverse=True):
        todo, room = histogram[length], length
        while todo and room < capacity:
            open_ = classes.get(room)
            if not open_:
                room += 1
                continue
            config, n = open_.pop()
            used = min(todo, n)
            if used < n:
                open_.append([config, n - used])
            classes.setdefault(room - length, []).append([config + (length,), used])
            todo -= used
        while todo:  # new sequences, as many of the length in each as fit
            each = min(capacity // length, todo)
            used = todo // each
            classes.setdefault(capacity - each * length, []).append([(length,) * each, used])
            todo -= used * each
    out: dict[Config, int] = {}
    for config, n in (c for open_ in classes.values() for c in open_):
        key = tuple(sorted(Counter(config).items(), reverse=True))
        out[key] = out.get(key, 0) + n
    return out


def rounded(parts: dict[Config, float], histogram: dict[int, int], capacity: int, filled: float) -> Counter:
    """Whole sequences of the fractional solution *parts*, rounded down, then up by falling fraction; lengths that are used up are left out
    of later ones, and best fit places what then fills less than the share *filled* of a sequence."""
    left, out = Counter(histogram), Counter()

    def take(config: Config, n: int) -> None:
        while n > 0:
            own = tuple((k, min(c, left[k])) for k, c in config if left[k] > 0)
            if sum(k * c for k, c in own) < filled * capacity:
                return
            some = min(n, min(left[k] // c for k, c in own))
            out[own] += some
            left.subtract({k: c * some for k, c in own})
            n -= some

    for config, x in sorted(parts.items(), key=lambda p: (-p[1], p[0])):
        take(config, int(x + 1e-9))
    for config, x in sorted(parts.items(), key=lambda p: (int(p[1]) - p[1], p[0])):
        take(config, 1 if x > int(x + 1e-9) else 0)
    out.update(best_fit({k: n for k, n in left.items() if n}, capacity))
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, **how) -> dict[Config, int]:
    """Configurations and how many sequences take each; together they hold every piece once."""
    rest = {k: n for k, n in histogram.items() if k < capacity and n}
    parts = fractional(rest, capacity, **how)
    out = min([rounded(parts, rest, capacity, f) for f in FILLED] + [best_fit(rest, capacity)], key=lambda o: sum(o.values()))
    return dict(out) | ({((capacity, 1),): histogram[capacity]} if histogram.get(capacity) else {})


class Places:
    """For each length, which configurations take its pieces, in order: sequence and offset of the piece at a place."""

    def __init__(self, chosen: dict[Config, int]):
        runs: dict[int, list] = {}
        self.sequences = 0
        for config, n in sorted(chosen.items(), reverse=True):
            at = 0
            for length, c in config:
                runs.setdefault(length, []).append((n * c, c, self.sequences, at))
                at += length * c
            self.sequences += n
        self.runs = {k: (np.cumsum([0] + [r[0] for r in own]), *np.array([r[1:] for r in own], np.int64).T) for k, own in runs.items()}

    def __call__(self, length: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for k in np.unique(length).tolist():
            m = length == k
            ends, each, first, at = self.runs[k]
            run = np.searchsorted(ends, place[m], side="right") - 1
            within = place[m] - ends[run]
            sequence[m] = first[run] + within // each[run]
            offset[m] = at[run] + within % each[run] * k
        return sequence, offset


PIECES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def pieces_of(docs: DataFrame, json_path: str, ranks_path: str | None = None, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces, with the task that made it and its number among those of its length there."""
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]

    def run(batches):
        encode, task, seen = _encoder(json_path, ranks_path), TaskContext.get().partitionId(), Counter()
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
                cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc, k, s, e - s, zlib.crc32(ids[s:e].tobytes()), task, seen[e - s]))
                    seen[e - s] += 1
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:5]], pa.array(cols[5], pa.int32()), pa.array(cols[6], pa.int64())], [*PIECES, "task", "nth"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long")


def pack_best_fit(docs: DataFrame, json_path: str, ranks_path: str | None = None, end: int = END, capacity: int = CAPACITY, **how) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Both paths must be readable on executors."""
    pieces = written(pieces_of(docs, json_path, ranks_path, end, capacity), "fit-pieces")
    counts = written(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "fit-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length, at most the capacity
    places = docs.sparkSession.sparkContext.broadcast(Places(plan(histogram, capacity, **how)))  # bounded by the histogram's configurations
    before = F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    first = counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("first"))
    placed = pieces.join(first, ["task", "length"]).select(*PIECES, (F.col("first") + F.col("nth")).alias("place"))
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]

    def put(batches):
        for b in batches:
            found = places.value(b.column(3).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *[pa.array(x) for x in found]], [*PIECES, "sequence_id", "offset"])

    return placed.mapInArrow(put, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op12_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
