"""URL filters: exact list membership by a cascade of Bloom filters, in SQL functions only.

The cascade is built over the complete key universe of the corpus (every host and parent domain of it). Level 1 encodes the
listed keys of the universe; the unlisted keys that pass it are encoded in level 2; the listed keys that pass level 2 in level 3;
and so on until no key passes wrongly. A key of the universe then belongs to the list exactly if the number of levels that it
passes in a row is odd: no join, no false answers. The false-positive rate of level 1 is fitted to listed/unlisted, so the
filters' size follows the list, O(listed * log(unlisted / listed)) bits, not the corpus.

Filters are built by partial aggregation into one row in the shared folder and reach the urls as a scalar subquery; the driver gathers
nothing of them. No filter is over ``max_filter_bits``: a larger list is cut into slices by hash, each slice of the universe has a
cascade of its own, and the hosts pass through the slices one after the other, so memory stays bounded and the answers exact.

Rules (host, path, verdict) come first: a rule fits its host and all subdomains where the url's path starts with the rule's;
the longest rule wins. Without a rule the cascade decides.

Defined results: a null url or one without ``://`` has empty host and path, no rule, and is allowed unless the list holds "".
Null page ids stay null, repeated rows give repeated results, extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.llm.common import let, written
from itemloom.sources import table

#: host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Hosts of advertising, betting and spam; subdomains count too.
LISTED = (
    "ads-track.example.com", "ads-track.example.net", "ads-track.example.org", "adult-x.example.com", "adult-x.example.net", "adult-x.example.org",
    "casino-win.example.com", "casino-win.example.net", "casino-win.example.org", "cheap-pills.example.com", "cheap-pills.example.net",
    "cheap-pills.example.org", "free-bets.example.com", "free-bets.example.net", "free-bets.example.org", "spam-farm.example.com",
    "spam-farm.example.net", "spam-farm.example.org",
)
MAX_FILTER_BITS = 1 << 25
#: False-positive rate of the levels after the first: a sixteenth of the keys goes on, so six levels do for ten million.
LATER_RATE = 1 / 16


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_keys(host: Column) -> Column:
    """The host and each of its parent domains, longest first."""
    return let(F.split(host, r"\."), lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")))


def slice_of(key: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(slices))


class Cascade:
    """Levels of (number of bits, number of hashes), and ``filters``: one row with an array of 64-bit words, ``f0``, ``f1``..., for each."""

    def __init__(self, levels: list[tuple[int, int]], filters: list[DataFrame]):
        self.levels, self.filters = levels, filters

    @staticmethod
    def positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
        h = F.xxhash64(key, F.lit(2 * level))
        g = F.xxhash64(key, F.lit(2 * level + 1))
        return [F.pmod(F.xxhash64(h, g, F.lit(j)), F.lit(bits)) for j in range(hashes)]

    def beside(self, rows: DataFrame) -> DataFrame:
        """*rows* with ``_held``: the words of all levels, read once a query."""
        return rows.withColumn("_held", F.struct(*[f.select(f"f{k}").scalar().alias(f"f{k}") for k, f in enumerate(self.filters)]))

    def passes(self, held: Column, key: Column, level: int) -> Column:
        bits, hashes = self.levels[level]
        word = lambda p: F.get(held[f"f{level}"], F.floor(p / 64).cast("int"))
        return reduce(and_, [F.getbit(word(p), F.pmod(p, F.lit(64)).cast("int")) == 1 for p in self.positions(key, level, bits, hashes)])

    def contains(self, held: Column, key: Column) -> Column:
        """Whether *key*, one of the universe, is listed; *held* is what ``beside`` adds."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in reversed(range(len(self.levels))):
            out = F.when(self.passes(held, key, k), out).otherwise(k % 2 == 1)
        return out


def _filter_of(keys: DataFrame, level: int, bits: int, hashes: int) -> DataFrame:
    """One row: the words of the filter that holds ``key`` of *keys*; bits / 64 numbers at most."""
    spots = keys.select(F.explode(F.array(*Cascade.positions(F.col("key"), level, bits, hashes))).alias("p"))
    words = spots.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(p, 64) as int))")).alias("b"))
    whole = keys.sparkSession.range(bits // 64).select(F.col("id").alias("w")).join(words, "w", "left").select("w", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    return written(whole.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias(f"f{level}")), "url-filter")


def filter_bits(keys: int, rate: float) -> int:
    return max(64, 64 * math.ceil(keys * math.log(1 / rate) / math.log(2) ** 2 / 64))


def first_rate(listed: int, others: int) -> float:
    return min(LATER_RATE, max(listed / max(others, 1) * math.sqrt(0.5), 1e-9))


def listed_keys(universe: DataFrame, listed: DataFrame | Iterable[str]) -> DataFrame:
    """key, listed of the distinct ``key`` of *universe*; *listed* is a table with ``key`` or some names."""
    spark = universe.sparkSession
    if not isinstance(listed, DataFrame):
        listed = spark.createDataFrame(pa.table({"key": pa.array(sorted(set(listed)), pa.string())}))
    names = listed.select("key").filter(F.col("key").isNotNull()).distinct().withColumn("listed", F.lit(True))
    return written(universe.select("key").join(names, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "url-listed")


def _counts(keys: DataFrame) -> tuple[int, int]:
    return tuple(keys.agg(F.count_if("listed"), F.count(F.lit(1))).first())


def build_cascade(keys: DataFrame, n_in: int, n_all: int) -> Cascade:
    """A cascade for *keys* (key, listed; distinct), exact on all of it; *n_in* of its *n_all* keys are listed."""
    out, wrong, n_wrong = Cascade([], []), keys.filter("listed"), n_in
    while n_wrong:
        level, rate = len(out.levels), LATER_RATE if out.levels else first_rate(n_in, n_all - n_in)
        bits, hashes = filter_bits(n_wrong, rate), max(1, round(math.log2(1 / rate)))
        out.filters.append(_filter_of(wrong, level, bits, hashes))
        out.levels.append((bits, hashes))
        other = out.beside(keys.filter(~F.col("listed") if level % 2 == 0 else F.col("listed")))
        wrong = written(other.filter(reduce(and_, [out.passes(F.col("_held"), F.col("key"), k) for k in range(level, -1, -1)])).select("key"), "url-wrong")
        n_wrong = wrong.count()
    return out


def build_cascades(universe: DataFrame, listed: DataFrame | Iterable[str], max_filter_bits: int = MAX_FILTER_BITS) -> list[Cascade]:
    """Cascades by slice of the universe (``slice_of``), so many that no filter is much over *max_filter_bits*."""
    keys = listed_keys(universe, listed)
    counts = _counts(keys)
    slices = math.ceil(filter_bits(counts[0], first_rate(counts[0], counts[1] - counts[0])) / max_filter_bits) if counts[0] else 1
    if slices == 1:
        return [build_cascade(keys, *counts)]
    parts = [keys.filter(slice_of(F.col("key"), slices) == k) for k in range(slices)]
    return [build_cascade(part, *_counts(part)) for part in parts]


def with_membership(rows: DataFrame, keys: Column, cascades: list[Cascade]) -> DataFrame:
    """*rows* with ``_listed``: whether one of the array *keys*, all of the universe, is listed."""
    rows, n = rows.withColumn("_listed", F.lit(False)), len(cascades)
    for k, c in enumerate(cascades):
        if c.levels:
            here = lambda key: slice_of(key, n) == k if n > 1 else F.lit(True)  # noqa: B023, E731
            own = lambda x: F.exists(x["keys"], lambda key: here(key) & c.contains(x["h"], key))  # noqa: B023, E731
            rows = c.beside(rows).withColumn("_listed", F.col("_listed") | let(F.struct(F.col("_held").alias("h"), keys.alias("keys")), own)).drop("_held")
            rows = written(rows, "url-slice") if k + 1 < n else rows  # one slice's filters at a time
    return rows


def judge_urls(pages: DataFrame, rules=RULES, listed: DataFrame | Iterable[str] = LISTED, max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """page_id, host, path, rule (like ``net/``, else null), verdict (allow or block)."""
    split = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    hosts = split.groupBy("host").count()
    universe = written(hosts.select(F.explode(host_keys(F.col("host"))).alias("key")).distinct(), "url-keys")
    cascades = build_cascades(universe, listed, max_filter_bits)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, path, said in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # the longest is tested first
        fits = ((F.col("host") == name) | F.endswith(F.col("host"), F.lit("." + name))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, name + path).otherwise(rule), F.when(fits, said).otherwise(verdict)
    judged = with_membership(split, host_keys(F.col("host")), cascades)
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("_listed"), "block").otherwise("allow")).alias("verdict"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _fits(name: str, path: str) -> str:
    return f"((host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{path}'))"


_LONGEST = sorted(RULES, key=lambda r: (len(r[0]) + len(r[1]), r))[::-1]
OP8_SQL = f"""
WITH s AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r AS (
  SELECT *, CASE {" ".join(f"WHEN {_fits(n, p)} THEN '{n}{p}'" for n, p, _ in _LONGEST)} END AS rule,
    CASE {" ".join(f"WHEN {_fits(n, p)} THEN '{v}'" for n, p, v in _LONGEST)} END AS said,
    {" OR ".join(f"host = '{x}' OR ends_with(host, '.{x}')" for x in LISTED)} AS listed
  FROM s)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict FROM r
"""
