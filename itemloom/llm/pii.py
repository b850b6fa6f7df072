"""Personal data: bootstrapped contextual extraction.

1. Base patterns (email, ip, card, phone) and long runs that mix letters and digits (secrets such as keys) give seed entities in every
   whole text. Each is found left to right in linear time.
2. Seeds induce lexical patterns: the two tokens before, the two tokens after, and a key right before (``staff-no:``). Tokens are
   generalised: lower case, without edge marks, each run of digits one 0. A pattern becomes a candidate with ``min_support`` distinct
   known values that make up ``min_share`` of its occurrences in the corpus.
3. Every token beside a candidate pattern, whatever it looks like, is an instance of it. Spark scores the pattern-instance graph for
   ``rounds`` rounds: a pattern's confidence is its instances' mean score, smoothed by one; an instance's score is the noisy-or of
   its confident patterns; seeds stay at 1. Unseen instances that reach ``min_confidence`` are known from then on: their other
   occurrences induce patterns as in 2, for ``hops`` hops or until there are no new ones.
4. Tokens beside a pattern of ``min_confidence`` become spans of kind ``id``, unless they touch a base span.

Patterns and values travel as 64-bit hashes, never as text, added up in the task first. Which tokens may matter is told in each
scan by a bitmap whose size follows the number of hashes, up to 2 ** ``MAX_BITS`` places (16 MB); beyond some 17 million hashes it lets more
through, and joins make it exact at any size. The accepted patterns reach the texts ``MAX_PATTERNS`` at a time, so no text is
ever shuffled. Nothing grows on the driver.

Defined results: a null text counts as empty; null ids stay null; repeated rows each give their row; an empty table gives no
rows; other columns are carried by ``redact_documents`` (clashing names and dots included) and ignored by ``pii_report``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemloom.llm.common import give_back, slices, written
from itemloom.sources import table

KINDS = ("email", "ip", "card", "phone")
MAX_BITS = 27  # bits of a hash that a bitmap tells apart at most
MAX_PATTERNS = 500_000
SLICE_CHARS = 1_000_000
CACHE_TOKENS = 100_000
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is tried from its first digit only and never given back, which finds the same matches in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
#: What every match of _IP holds; it starts with a literal, so texts without it are passed over quickly.
_DOTTED = re.compile(r"\.[0-9]++\.[0-9]++\.[0-9]")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A key with its mark, if a value follows at once, or what stands between white space.
_TOKEN = re.compile(r"[^\s=:]{2,}+[=:](?=[^\s=:])|\S+")
_SECRET = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+")
_DIGITS = re.compile(r"[0-9]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EDGE = "\"'.,;:!?()[]{}<>`*$%&#|"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """As re.finditer of the whole pattern, but from each @ outwards, so that long runs without @ cost nothing."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then start."""
    out = [(0, s, e) for s, e in _emails(text)]
    if _DOTTED.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def secrets(text: str) -> list[tuple[int, int]]:
    """Runs of 20 or more letters, digits, - and _ of ten kinds or more, with a fifth of digits and a tenth of letters at least."""
    out = []
    for m in _SECRET.finditer(text):
        run, n = m[0], m.end() - m.start()
        digits, letters = sum(map(str.isdigit, run)), sum(map(str.isalpha, run))
        if 5 * digits >= n and 10 * letters >= n and len(set(run)) >= 10:
            out.append(m.span())
    return out


def seed_spans(text: str) -> list[tuple[int, int]]:
    """Base spans and the secrets that touch none of them, in order of start."""
    base = sorted((s, e) for _, s, e in base_spans(text))
    return sorted(base + without_touch(secrets(text), base))


def without_touch(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those *spans* that touch none of *taken* (sorted by start)."""
    if not taken:
        return spans
    starts = [s for s, _ in taken]
    reach = list(accumulate((e for _, e in taken), max))  # of all that start before
    return [(s, e) for s, e in spans if not (k := bisect_left(starts, e)) or reach[k - 1] <= s]


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))


def context_word(token: str) -> str:
    low = token.lower()
    if token.isalpha():  # neither edge marks nor digits
        return low
    return _DIGITS.sub("0", low.strip(_EDGE) or low)


class _Hashes(dict):
    """Token -> hash of its context word; forgets all when it is full."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE_TOKENS:
            self.clear()
        self[token] = h = _hash(context_word(token)) or 1
        return h


_context_hash = _Hashes().__getitem__


class _Numbers(dict):
    """Word -> its number, from 0 in order of first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def is_key(token: str) -> bool:
    return token[-1] in "=:" and len(token) > 2


def value_of(token: str) -> tuple[int, str]:
    """(offset, text) of a token without edge marks; empty if no letter or digit is left."""
    left = token.lstrip(_EDGE)
    value = left.rstrip(_EDGE)
    return len(token) - len(left), value if any(map(str.isalnum, value)) else ""


U = np.uint64
_KINDS = {k: U(n * 0x94D049BB133111EB % (1 << 64)) for n, k in enumerate(("before", "after", "key"), 1)}


def pattern_hash(kind: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of each pattern of *kind* with context words a and b (hashes; 0 is none), as signed longs; 0 where a word is wanting."""
    x = (a * U(0x9E3779B97F4A7C15) + b) * U(0xBF58476D1CE4E5B9) + _KINDS[kind]
    x = (x ^ (x >> U(30))) * U(0x94D049BB133111EB)
    return np.where((a != 0) & (b != 0), x ^ (x >> U(31)), U(0)).view(np.int64)


class Tokens:
    """The tokens of some texts with the hashes of their patterns."""

    def __init__(self, texts: list[str]):
        self.texts, place = texts, _Numbers()
        runs = [t.split() for t in texts]  # no token crosses white space, so each distinct run is cut into tokens once
        at = np.fromiter(map(place.__getitem__, chain.from_iterable(runs)), np.int64)
        self.words = list(place)
        first, parts = np.arange(len(self.words)), np.ones(len(self.words), np.int64)
        marked = [k for k, w in enumerate(self.words) if "=" in w or ":" in w]
        for k in marked[:]:
            found = _TOKEN.findall(self.words[k])
            if len(found) > 1:
                first[k], parts[k] = len(self.words), len(found)
                marked += range(len(self.words), len(self.words) + len(found))
                self.words += found
        each = parts[at]
        ends = np.cumsum(np.concatenate(([0], each)))
        self.ids = np.repeat(first[at] - ends[:-1], each) + np.arange(ends[-1])
        self.ends = ends[np.cumsum([0, *map(len, runs)])]
        word = np.array([*map(_context_hash, self.words)] or [0], U)[self.ids]
        key = np.zeros(max(1, len(self.words)), bool)
        key[[k for k in marked if is_key(self.words[k])]] = True
        key = key[self.ids]
        doc = np.repeat(np.arange(len(texts)), np.diff(self.ends))
        self.before = [self._shift(word, doc, k) for k in (1, 2)]
        self.after = [self._shift(word, doc, -k) for k in (1, 2)]
        self.key = np.where(self._shift(key.astype(U), doc, 1) > 0, self.before[0], U(0))
        self.doc = doc

    @staticmethod
    def _shift(x: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
        """The word k places before (after, if k < 0) in the same text, or 0."""
        out, n = np.zeros(len(x), U), abs(k)
        if len(x) > n:
            same = doc[n:] == doc[:-n]
            if k > 0:
                out[n:] = np.where(same, x[:-n], U(0))
            else:
                out[:-n] = np.where(same, x[n:], U(0))
        return out

    def patterns(self) -> list[np.ndarray]:
        return [pattern_hash("before", self.before[1], self.before[0]), pattern_hash("after", self.after[0], self.after[1]), pattern_hash("key", self.key, self.key)]

    def values(self, picked: np.ndarray | None = None) -> np.ndarray:
        """The hash of the value of each token (of those *picked*), 0 if it has none."""
        ids = self.ids if picked is None else self.ids[picked]
        used, place = np.unique(ids, return_inverse=True)
        each = [value_of(self.words[k])[1] for k in used.tolist()]
        return np.array([_hash(v) if v else 0 for v in each], U).view(np.int64)[place]

    def spans(self, picked: np.ndarray) -> list[list[tuple[int, int]]]:
        """Spans of the values of the tokens *picked*, by text."""
        out, doc = [[] for _ in self.texts], self.doc[picked]
        for d in np.unique(doc).tolist():
            want = set((picked[doc == d] - self.ends[d]).tolist())
            for k, m in enumerate(_TOKEN.finditer(self.texts[d])):
                if k in want:
                    first, value = value_of(m[0])
                    if value:
                        out[d].append((m.start() + first, m.start() + first + len(value)))
        return out

    def apart_from_seeds(self, picked: np.ndarray) -> np.ndarray:
        """Those of the tokens *picked* whose values touch no seed."""
        keep, doc = np.zeros(len(picked), bool), self.doc[picked]
        for d in np.unique(doc).tolist():
            at = np.flatnonzero(doc == d)
            seeds, k = seed_spans(self.texts[d]), 0
            want = dict(zip((picked[at] - self.ends[d]).tolist(), at.tolist(), strict=True))
            for k, m in enumerate(_TOKEN.finditer(self.texts[d])):
                if k in want:
                    first, value = value_of(m[0])
                    s = m.start() + first
                    keep[want[k]] = bool(value) and bool(without_touch([(s, s + len(value))], seeds))
        return picked[keep]


def seed_edges(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pattern, value) of every pattern of every seed, as two arrays for each kind of pattern."""
    rows: list[tuple] = []
    for t in texts:
        seeds = seed_spans(t)
        if not seeds:
            continue
        at = [m.span() for m in _TOKEN.finditer(t)]
        starts, ends = [s for s, _ in at], [e for _, e in at]
        word = lambda k: _context_hash(t[at[k][0] : at[k][1]]) if 0 <= k < len(at) else 0  # noqa: B023, E731
        for s, e in seeds:
            first, last = bisect_right(ends, s), bisect_left(starts, e)  # tokens from first to last hold the seed
            key = first > 0 and is_key(t[slice(*at[first - 1])])
            rows.append((word(first - 1), word(first - 2), word(last), word(last + 1), word(first - 1) if key else 0, _hash(t[s:e])))
    c = np.array(rows, U).reshape(-1, 6).T
    value = c[5].view(np.int64) if len(rows) else np.zeros(0, np.int64)
    return [(pattern_hash(kind, c[a], c[b]), value) for kind, a, b in (("before", 1, 0), ("after", 2, 3), ("key", 4, 4))]


class Bitmap:
    """Which leading bits occur among some hashes; every hash of them passes, others now and then: an eighth at most up to 2 ** (MAX_BITS - 3) hashes."""

    def __init__(self, hashes: DataFrame, column: str):
        self.bits = min(MAX_BITS, max(16, (8 * hashes.count()).bit_length()))
        at = hashes.select(F.shiftrightunsigned(column, 64 - self.bits).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        found = at.toArrow()  # 2 ** (MAX_BITS - 6) rows at most
        words = np.zeros(1 << (self.bits - 6), np.int64)
        words[found["word"].to_numpy()] = found["bits"].to_numpy()
        self.words = words.view(U)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(U) >> U(64 - self.bits)
        return ((self.words[at >> U(6)] >> (at & U(63))) & U(1)).astype(bool) & (hashes != 0)


def _edges(docs: DataFrame, how) -> DataFrame:
    """pattern, value, n (occurrences): what how(texts) gives as pairs of arrays, added up."""

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, whole.column(0), SLICE_CHARS)):
            pairs = how([t or "" for t in b.column(0).to_pylist()])
            pattern, value = (np.concatenate(x) for x in zip(*pairs, strict=True))
            pattern, value = pattern[pattern != 0], value[pattern != 0]
            by = np.lexsort((value, pattern)) if value.any() else np.argsort(pattern)
            pattern, value = pattern[by], value[by]
            start = np.flatnonzero(np.concatenate(([True], (pattern[1:] != pattern[:-1]) | (value[1:] != value[:-1])))[: len(pattern)])
            n = np.diff(np.append(start, len(pattern)))
            yield pa.RecordBatch.from_arrays([pa.array(pattern[start]), pa.array(value[start]), pa.array(n)], ["pattern", "value", "n"])
        give_back()

    found = docs.select("text").mapInArrow(run, "pattern long, value long, n long")
    return found.groupBy("pattern", "value").agg(F.sum("n").alias("n"))


def _counts(docs: DataFrame, near: Bitmap) -> DataFrame:
    """pattern, value (0), n: how often patterns that pass the bitmap occur."""
    held = docs.sparkSession.sparkContext.broadcast(near)
    return _edges(docs, lambda texts: [(near := p[held.value(p)], np.zeros(len(near), np.int64)) for p in Tokens(texts).patterns()])


def _fillers(docs: DataFrame, near: Bitmap) -> DataFrame:
    """pattern, value, n of the tokens beside patterns that pass the bitmap, without those that are seeds."""
    held = docs.sparkSession.sparkContext.broadcast(near)

    def how(texts):
        tokens = Tokens(texts)
        found, hit = tokens.patterns(), np.zeros(len(tokens.ids), bool)
        for p in found:
            hit |= held.value(p)
        some = tokens.apart_from_seeds(np.flatnonzero(hit))
        values = tokens.values(some)
        return [(np.where(held.value(p[some]), p[some], 0), values) for p in found]

    return _edges(docs, how)


def _occurrences(docs: DataFrame, near: Bitmap) -> DataFrame:
    """pattern, value, n of all patterns of the tokens whose value passes the bitmap, without those that are seeds."""
    held = docs.sparkSession.sparkContext.broadcast(near)

    def how(texts):
        tokens = Tokens(texts)
        found, values = tokens.patterns(), tokens.values()
        some = tokens.apart_from_seeds(np.flatnonzero(held.value(values)))
        return [(p[some], values[some]) for p in found]

    return _edges(docs, how)


def score_graph(edges: DataFrame, rounds: int, min_support: int, min_confidence: float) -> tuple[DataFrame, DataFrame]:
    """(pattern, confidence of the accepted ones; value, score of unseen values beside them) of *edges* (pattern, value, seed).

    Sums of doubles follow the order of the shuffle in their last bits, so they are rounded before anything is compared with a limit."""
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    for k in range(rounds):
        patterns = scored.groupBy("pattern").agg(F.round(F.sum("score") / (F.count(F.lit(1)) + 1), 9).alias("confidence"), F.round(F.sum("score"), 9).alias("support"))
        patterns = patterns.filter((F.col("confidence") >= min_confidence) & (F.col("support") >= min_support)).select("pattern", "confidence")
        values = edges.join(patterns, "pattern").groupBy("value").agg(F.round(1 - F.exp(F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999))))), 9).alias("found"), F.max("seed").alias("seed"))
        if k + 1 < rounds:
            scored = edges.join(values.select("value", "found"), "value", "left").select("pattern", "value", "seed", F.greatest(F.col("seed").cast("double"), F.coalesce("found", F.lit(0.0))).alias("score"))
            scored = written(scored, "pii-scores")
    return written(patterns, "pii-accepted"), values.filter(~F.col("seed")).select("value", F.col("found").alias("score"))


def confident_patterns(docs: DataFrame, rounds: int = 3, hops: int = 3, min_support: int = 5, min_share: float = 0.25, min_confidence: float = 0.8) -> DataFrame:
    """pattern, confidence of the accepted patterns of the ``text`` of *docs*."""
    seeds = written(_edges(docs, seed_edges), "pii-seeds")
    known, edges = seeds.withColumn("seed", F.lit(True)), seeds.limit(0).withColumn("seed", F.lit(True))  # edges: of candidates only
    tried, grown = seeds.select("pattern").limit(0), seeds.select("value").limit(0)
    accepted = seeds.select("pattern", F.lit(0.0).alias("confidence")).limit(0)
    for hop in range(hops):
        many = known.groupBy("pattern").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("mentions")).filter(F.col("values") >= min_support)
        many = written(many.join(tried, "pattern", "left_anti"), "pii-many")
        if many.isEmpty():
            break
        often = _counts(docs, Bitmap(many, "pattern")).select("pattern", F.col("n").alias("times"))
        new = written(many.join(often, "pattern").filter(F.col("mentions") >= min_share * F.col("times")).select("pattern"), "pii-new")
        tried = written(tried.union(many.select("pattern")), "pii-tried")
        if new.isEmpty():
            break
        found = _fillers(docs, Bitmap(new, "pattern")).join(new, "pattern", "left_semi").withColumn("seed", F.lit(False))
        more = found.unionByName(known.join(new, "pattern", "left_semi")).groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.sum("n").alias("n"))
        edges = written(edges.unionByName(more), "pii-graph")
        accepted, values = score_graph(edges.select("pattern", "value", "seed"), rounds, min_support, min_confidence)
        if hop + 1 < hops:
            unseen = written(values.filter(F.col("score") >= min_confidence).select("value").join(grown, "value", "left_anti"), "pii-unseen")
            if unseen.isEmpty():
                break
            grown = written(grown.union(unseen), "pii-grown")
            again = _occurrences(docs, Bitmap(unseen, "value")).join(unseen, "value", "left_semi").withColumn("seed", F.lit(False))
            known = written(known.unionByName(again), "pii-known")
    return accepted


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def with_spans(docs: DataFrame, keep: list[str], redact: bool = False, **graph) -> DataFrame:
    """A struct ``_in`` of the columns *keep*, with ``_text``, ``_base`` (base spans) and ``_more`` (what confident patterns add, by start).
    *redact*: ``_text`` comes without its spans, cut by the task that finds them."""
    patterns = confident_patterns(docs, **graph)
    parts = max(1, -(-patterns.count() // MAX_PATTERNS))
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_in"), F.col("text").alias("_text"), F.lit(None).cast(_SPANS).alias("_base"), F.lit(None).cast(_SPANS).alias("_more"))
    for k in range(parts):
        own = patterns.filter(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == k) if parts > 1 else patterns
        held = sc.broadcast(np.sort(np.array([r["pattern"] for r in own.select("pattern").collect()], np.int64)))  # about MAX_PATTERNS
        rows = rows.mapInArrow(_marker(held, last=k + 1 == parts, redact=redact), rows.schema)
        rows = written(rows, "pii-marked") if k + 1 < parts else rows
    return rows


def _marker(held, last: bool, redact: bool = False):
    def run(batches):
        for b in (part for whole in batches for part in slices(whole, whole.column(1), SLICE_CHARS)):
            texts, wanted = [t or "" for t in b.column(1).to_pylist()], held.value
            more = [[(s["start"], s["end"]) for s in x or []] for x in b.column(3).to_pylist()]
            if len(wanted):
                tokens = Tokens(texts)
                hit = np.zeros(len(tokens.ids), bool)
                for p in tokens.patterns():
                    hit |= (wanted[np.minimum(np.searchsorted(wanted, p), len(wanted) - 1)] == p) & (p != 0)
                more = [a + c for a, c in zip(more, tokens.spans(np.flatnonzero(hit)), strict=True)]
            base = [base_spans(t) for t in texts] if last else [[] for _ in texts]
            more = [without_touch(sorted(set(m)), sorted((s, e) for _, s, e in x)) for m, x in zip(more, base, strict=True)]
            dicts = lambda spans: [dict(zip(("kind", "start", "end"), x, strict=True)) for x in spans]
            kind, own = pa.list_(_SPAN), b.column(1)
            if last and redact:
                own = pa.array([t and without_spans(t, [*x, *((len(KINDS), s, e) for s, e in m)]) for t, x, m in zip(own.to_pylist(), base, more, strict=True)], own.type)
            yield pa.RecordBatch.from_arrays([b.column(0), own, pa.array([dicts(x) for x in base], kind), pa.array([dicts((len(KINDS), s, e) for s, e in x) for x in more], kind)], ["_in", "_text", "_base", "_more"])
        give_back()

    return run


def pii_report(docs: DataFrame, **graph) -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans, for each document."""
    d = with_spans(docs.select("doc_id", "text"), ["doc_id"], **graph)
    names = F.array(*[F.lit(k) for k in (*KINDS, "id")])
    said = lambda c: F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"]))
    kinds = F.transform("_base", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{n}") for k, n in enumerate(KINDS)]
    return d.select(F.col("_in.doc_id").alias("doc_id"), *counts, F.sha2(F.array_join(said("_base"), ","), 256).alias("base_sha256"), F.array_join(F.concat(said("_base"), said("_more")), ",").alias("spans"))


def without_spans(text: str, spans: list[tuple[int, int, int]]) -> str:
    """*text* with each span (kind, start, end) replaced by its kind. Kinds may overlap: the first to start names the cut, all that any span covers goes."""
    out, last = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if e > last:
            if s >= last:
                out += [text[last:s], "[" + (*KINDS, "id")[k].upper() + "]"]
            last = e
    return "".join([*out, text[last:]])


def redact_documents(docs: DataFrame, **graph) -> DataFrame:
    """The same rows and columns; every span of text becomes ``[EMAIL]``, ``[IP]``, ``[CARD]``, ``[PHONE]`` or ``[ID]``."""
    d = with_spans(docs, [c for c in docs.columns if c != "text"] or docs.columns, redact=True, **graph)  # the text goes beside them, once
    new = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast("long")}
    return d.select(*[new.get(c, F.col(f"_in.`{c}`")).alias(c) for c in docs.columns])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))
