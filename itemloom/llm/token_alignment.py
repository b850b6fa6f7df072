"""Cross-tokenizer alignment: the tokens of two tokenizers over the same bytes, cut into groups where both end, and linked where they overlap.

``relational_alignment`` is the alignment as Spark relations: posexplode gives a row a token, a window its end by cumulative length, a
full equi-join on document and end puts together what ends at one place, and windows from the last end backwards give every end the
tokens of both sides that cover it and, by a running count of common ends, its group. Between two neighbouring ends lies exactly one
overlap of one token of either side, so the filled rows are the links: a range join in linear time, where a join by group would make
all pairs of a long group. Tests hold it against brute force, and ``aligned_documents`` against it.

That costs a row and several sorts a token. Over the documents here, 1.4 thousand million tokens a GB, it is over the check tool's CPU limit
(figures in the README), so ``aligned_documents``, which the query uses, finds ends, groups and links in the task that tokenises: by *unit*,
a word with the blank before it. Neither tokenizer has a token across such a blank (the byte-level pattern never; of the pieces it is
looked up), so a unit's tokens do not depend on the text around it, both sides end at its end, and each distinct unit is tokenised and
aligned once a task (the task forgets them all when it holds ``KEPT_UNITS``).

What spans documents is relational in either case: links are added up by document, then corpus-wide by id pair; the highest count of each
id of the second tokenizer (a row for each of its ids at most) marks the best pairs; and both come back to the documents by joins. Pairs
that occur most often, at most ``HOT_PAIRS`` of them by their counts' histogram, are broadcast, so that no join has a hot key; the
others are joined by pair.

Defined results: a document has no tokens (zeros, and '' for groups_sha256) if its text is null or empty, or if the joined bytes of either
side differ from blank + text; null doc_ids stay null; repeated rows each give their row and count each; an empty table gives no rows;
extra columns, clashing names too, are ignored; texts are taken whole.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itemloom.llm.common import written
from itemloom.sources import table

HOT_PAIRS = 200_000
KEPT_UNITS = 250_000
KEPT_CHARS = 16_000_000
SLICE_CHARS = 2_000_000
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_BYTE = re.compile("<0x[0-9A-F]{2}>")


class Tokenizers:
    """Both tokenizers with the bytes of their tokens: a is byte-level BPE (*ranks_path*, or *json_path* where that gives up), b has pieces."""

    def __init__(self, json_path: str, ranks_path: str, model_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain = Tokenizer.from_file(json_path)
        self.plain.encode_special_tokens = True
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for x, k in ranks.items():
            self.bytes_a[k] = x
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=model_path)
        names = [self.pieces.id_to_piece(k) for k in range(self.pieces.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(k) and _BYTE.fullmatch(p) else p.replace("▁", " ").encode() for k, p in enumerate(names)]
        #: Whether units are independent for b: no piece has a blank after another character.
        self.by_unit = not any("▁" in p.lstrip("▁") for p in names)
        self.size_a, self.size_b = list(map(len, self.bytes_a)), list(map(len, self.bytes_b))

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of blank + *text* by a and of *text* by b, or None if the bytes of either differ from blank + text."""
        try:
            a = self.fast.encode_ordinary(" " + text)
        except BaseException as e:
            if type(e).__name__ != "PanicException":
                raise
            a = self.plain.encode(" " + text, add_special_tokens=False).ids  # the fast library gives up on some long runs; equal ids
        b, want = self.pieces.encode(text), b" " + text.encode()
        if b"".join([self.bytes_a[k] for k in a]) != want or b"".join([self.bytes_b[k] for k in b]) != want:
            return None
        return a, b


class Aligner:
    """Documents to (n_a, n_b, n_groups, n_links, digest, pair codes, pair counts); a code is a * 2^32 + b."""

    NONE = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))

    def __init__(self, tokenizers: Tokenizers):
        self.t = tokenizers
        self.said_a, self.said_b = [str(k) for k in range(len(self.t.bytes_a))], [str(k) for k in range(len(self.t.bytes_b))]
        self._forget()

    def _forget(self) -> None:
        """Units by text (of texts cut at single blanks; of those cut by ``_BETWEEN``), and of each its groups, numbers and link codes."""
        self.place: dict[str, int] = {}
        self.other: dict[str, int] = {}
        self.texts: list[str] = []
        self.numbers, self.codes, self.first, self.chars = array("q"), array("q"), array("q", [0]), 0

    def _keep(self, groups: list[str], n_a: int, n_b: int) -> None:
        self.texts.append(";".join(groups))
        self.numbers.extend((n_a, n_b, len(groups)))
        self.first.append(len(self.codes))

    def _align(self, a: list[int], b: list[int], ends: list[int]) -> None:
        """Keep the groups and links of units that end at *ends*, of their tokens in a row."""
        size_a, size_b, say_a, say_b, codes = self.t.size_a, self.t.size_b, self.said_a, self.said_b, self.codes
        i = j = from_i = from_j = end_a = end_b = unit = 0
        groups: list[str] = []
        while i < len(a):
            first_i, first_j = i, j
            end_a, end_b = end_a + size_a[a[i]], end_b + size_b[b[j]]
            codes.append((a[i] << 32) + b[j])
            while end_a != end_b:
                if end_a < end_b:
                    i += 1
                    end_a += size_a[a[i]]
                else:
                    j += 1
                    end_b += size_b[b[j]]
                codes.append((a[i] << 32) + b[j])
            i, j = i + 1, j + 1
            groups.append(f"{','.join([say_a[k] for k in a[first_i:i]])}|{','.join([say_b[k] for k in b[first_j:j]])}")
            if end_a == ends[unit]:
                self._keep(groups, i - from_i, j - from_j)
                groups, from_i, from_j, unit = [], i, j, unit + 1

    def _learn(self, parts: list[str], place: dict[str, int]) -> None:
        """Tokenise and align new units, all at once; -1 is the place of one whose bytes differ."""
        ids = self.t.encode(" ".join(parts)) if parts else None
        if ids is not None:
            place.update(zip(parts, range(len(self.texts), len(self.texts) + len(parts)), strict=True))
            self._align(*ids, list(accumulate(len(p.encode()) + 1 for p in parts)))
            self.chars += sum(map(len, parts))
        elif len(parts) > 1:
            self._learn(parts[: len(parts) // 2], place)
            self._learn(parts[len(parts) // 2 :], place)
        elif parts:
            place[parts[0]] = -1

    def _places(self, cut: list[list[str]], place: dict[str, int], edges: bool) -> list[list[int]]:
        """The places of the units of some texts. A new one with white space at an end (or empty) can't be learned beside others: it is
        learned alone where *edges* of texts may have some, else its place is -2."""
        new = {p: None for parts in cut for p in parts if p not in place}
        odd = [p for p in new if not p or p[0].isspace() or p[-1].isspace()]
        for p in odd:
            if edges:
                self._learn([p], place)
            else:
                place[p] = -2
        self._learn([p for p in new if p not in place], place)
        return [[place[p] for p in parts] for parts in cut]

    def __call__(self, texts: list[str | None]) -> list[tuple]:
        if len(self.texts) > KEPT_UNITS or self.chars > KEPT_CHARS:
            self._forget()
        out = [self.NONE] * len(texts)
        todo = [k for k, t in enumerate(texts) if t]
        if self.t.by_unit:
            # blanks beside other white space do not part units
            found = self._places([texts[k].split(" ") for k in todo], self.place, edges=False)
        else:
            found = [[-2]] * len(todo)
        odd = [k for k, units in zip(todo, found, strict=True) if -2 in units]
        again = self._places([_BETWEEN.split(texts[k]) if self.t.by_unit else [texts[k]] for k in odd], self.other, edges=True)
        codes, first, numbers = np.array(self.codes), np.array(self.first), np.array(self.numbers).reshape(-1, 3)
        for k, units in [*zip(todo, found, strict=True), *zip(odd, again, strict=True)]:
            if -1 in units or -2 in units:
                continue
            own, times = np.unique(np.array(units, np.int64), return_counts=True)
            links = first[own + 1] - first[own]
            at = np.repeat(first[own] - np.concatenate(([0], np.cumsum(links)[:-1])), links) + np.arange(links.sum())
            code, where = np.unique(codes[at], return_inverse=True)
            count = np.bincount(where, weights=np.repeat(times, links)).astype(np.int64)
            digest = hashlib.sha256(";".join([self.texts[u] for u in units]).encode()).hexdigest()
            out[k] = (*(numbers[own] * times[:, None]).sum(axis=0).tolist(), int(links @ times), digest, code, count)
        return out


_held: dict[tuple, Aligner] = {}
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def aligned_documents(docs: DataFrame, json_path: str, ranks_path: str, model_path: str) -> DataFrame:
    """rid (a number of the row), COLUMNS and pairs: array of a, b and n, the links of the document that hold ids a and b."""
    paths = (json_path, ranks_path, model_path)
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]

    def run(batches):
        if paths not in _held:
            _held[paths] = Aligner(Tokenizers(*paths))
        aligner, rid = _held[paths], TaskContext.get().partitionId() << 33

        def out(ids, found, first):
            *columns, code, count = zip(*found, strict=True)
            ends = np.cumsum([0, *map(len, code)])
            code, count = np.concatenate(code), np.concatenate(count)
            pairs = pa.StructArray.from_arrays([pa.array((code >> 32).astype(np.int32)), pa.array((code & 0xFFFFFFFF).astype(np.int32)), pa.array(count)], ["a", "b", "n"])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.arange(first, first + len(ids))), pa.array(ids, id_type), *[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pairs)], ["rid", *COLUMNS, "pairs"]
            )

        for b in batches:
            id_type, ids, texts, chars = b.schema.field(0).type, [], [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(doc)
                texts.append(text)
                chars += len(text or "")
                if chars >= SLICE_CHARS:
                    yield out(ids, aligner(texts), rid)
                    rid, ids, texts, chars = rid + len(ids), [], [], 0
            if ids:
                yield out(ids, aligner(texts), rid)
                rid += len(ids)

    return docs.select("doc_id", "text").mapInArrow(run, f"rid long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<a: int, b: int, n: long>>")


def tokens_of(docs: DataFrame, json_path: str, ranks_path: str, model_path: str) -> DataFrame:
    """rid, doc_id, a and b: arrays of id and size (bytes) of each document's tokens, empty without tokens; for ``relational_alignment``."""
    kind, paths = dict(docs.select("doc_id").dtypes)["doc_id"], (json_path, ranks_path, model_path)

    def run(batches):
        t, rid = Tokenizers(*paths), TaskContext.get().partitionId() << 33
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = t.encode(text) if text else None
                side = lambda own, size: [{"id": int(k), "size": int(size[k])} for k in own]
                rows.append({"rid": rid, "doc_id": doc, "a": side(ids[0], t.size_a) if ids else [], "b": side(ids[1], t.size_b) if ids else []})
                rid += 1
            token = pa.list_(pa.struct([("id", pa.int32()), ("size", pa.int32())]))
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("rid", pa.int64()), ("doc_id", b.schema.field(0).type), ("a", token), ("b", token)]))

    return docs.select("doc_id", "text").mapInArrow(run, f"rid long, doc_id {kind}, a array<struct<id: int, size: int>>, b array<struct<id: int, size: int>>")


def relational_alignment(tokens: DataFrame) -> DataFrame:
    """As ``aligned_documents``, of *tokens* (rid, doc_id, a, b), by relations alone."""
    forward, back = W.partitionBy("rid").orderBy("at"), W.partitionBy("rid").orderBy(F.desc("end"))

    def side(s: str) -> DataFrame:
        rows = tokens.select("rid", F.posexplode(s).alias("at", "t")).select("rid", "at", F.col("t.id").alias(s), "t.size")
        return rows.select("rid", s, F.sum("size").over(forward).alias("end"))

    ends = side("a").join(side("b"), ["rid", "end"], "full")
    covering = lambda s: F.last(s, ignorenulls=True).over(back)
    both = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).over(back)
    links = ends.select("rid", "end", F.col("a").alias("ends_a"), F.col("b").alias("ends_b"), covering("a").alias("a"), covering("b").alias("b"), both.alias("group"))
    ids = lambda s: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(f"ends_{s}").isNotNull(), F.struct("end", f"ends_{s}")))), lambda x: x[f"ends_{s}"].cast("string")), ",")
    groups = links.groupBy("rid", "group").agg(F.concat(ids("a"), F.lit("|"), ids("b")).alias("said"), F.count("ends_a").alias("n_a"), F.count("ends_b").alias("n_b"), F.count(F.lit(1)).alias("n_links"))
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("group", "said")), asc=False), lambda x: x["said"]), ";")
    whole = groups.groupBy("rid").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.count(F.lit(1)).alias("n_groups"), F.sum("n_links").alias("n_links"), F.sha2(said, 256).alias("groups_sha256"))
    pairs = links.groupBy("rid", "a", "b").agg(F.count(F.lit(1)).alias("n")).groupBy("rid").agg(F.collect_list(F.struct("a", "b", "n")).alias("pairs"))
    found = tokens.select("rid", "doc_id").join(whole, "rid", "left").join(pairs, "rid", "left")
    return found.select("rid", "doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COLUMNS[1:5]], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"), F.coalesce("pairs", F.array().cast("array<struct<a: int, b: int, n: bigint>>")).alias("pairs"))


def linked_pairs(aligned: DataFrame) -> DataFrame:
    """a, b, count (links that hold the ids, corpus-wide) and best: whether no pair of b has a higher one."""
    pairs = written(aligned.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.n").alias("count")), "linked-pairs")
    top = pairs.groupBy("b").agg(F.max("count").alias("top"))  # a row for each id of the second tokenizer at most
    return pairs.join(F.broadcast(top), "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def least_hot_count(pairs: DataFrame, hot_pairs: int) -> int:
    """The least power of 2^(1/8), rounded up, that no more than *hot_pairs* counts reach."""
    step = F.floor(F.log2("count") * 8).cast("int")
    seen, least = 0, None
    for r in sorted(pairs.groupBy(step.alias("step")).count().collect(), reverse=True):  # 8 rows for each doubling at most
        seen += r["count"]
        if seen > hot_pairs:
            break
        least = r["step"]
    return 2**62 if least is None else math.ceil(2 ** ((least + 1e-9) / 8))


def with_link_counts(aligned: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """COLUMNS, n_best and count_sum of *aligned* (a written table, as it is read several times)."""
    pairs = written(linked_pairs(aligned), "best-pairs")
    least = least_hot_count(pairs, hot_pairs)
    each = aligned.select("rid", F.explode("pairs").alias("p")).select("rid", "p.a", "p.b", "p.n")
    hot, cold = F.broadcast(pairs.filter(F.col("count") >= least)), pairs.filter(F.col("count") < least)
    sums = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")]
    parts = each.join(hot, ["a", "b"]).groupBy("rid").agg(*sums).unionByName(each.join(F.broadcast(pairs.filter(F.col("count") >= least).select("a", "b")), ["a", "b"], "left_anti").join(cold, ["a", "b"]).groupBy("rid").agg(*sums))
    whole = parts.groupBy("rid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.select("rid", *COLUMNS).join(whole, "rid", "left").select(*COLUMNS, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")])


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    paths = (p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.path("piece_bpe_32k.model"))
    return with_link_counts(written(aligned_documents(table(spark, sf_dir, "documents"), *paths), "aligned"))
