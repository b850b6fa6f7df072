"""Byte-level BPE encoding and decoding by longest match and backtracking.

Bytes are mapped to Latin-1, so that an Aho-Corasick automaton over the vocabulary finds every token at every place of a piece.
From the longest match on, tokens are appended while each neighbouring pair is compatible: a pair is compatible if merging
its bytes gives back just that pair, which a walk down both tokens' merge trees decides (memoised). Otherwise a shorter match is
tried, then the previous token is taken back; an end that failed is never tried again, so the work is linear in the piece.
A sequence whose neighbours are all compatible is the one that merging by rank gives.

Tokens that no merge can reach are left out of the automaton; like in the tiktoken library, they stand only for a whole piece.
Pieces come from the public pattern and are encoded one by one; a bounded cache holds recent ones.

Defined results: a null text counts as empty (no ids; the digest of nothing). Null ids stay null, repeated rows give repeated
results, an empty table gives no rows, extra columns are ignored. Texts are taken whole, whatever their length.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from itemloom.sources import table

CACHE_PIECES = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_by_rank(ranks: dict[bytes, int], piece: bytes) -> list[bytes]:
    """Plain merging: again and again the adjacent pair of lowest rank, leftmost first. Quadratic; for tables and tests."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_pieces: int = CACHE_PIECES):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.cache_pieces = cache_pieces
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in sorted(ranks.items(), key=lambda x: x[1]):  # a token's halves have lower ranks
            if len(t) == 1:
                self.halves[i] = (i, i)
            elif (h := self._split(t, i)) is not None:
                self.halves[i], self.pairs[h] = h, i
            else:
                continue  # no merge makes it
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.cache: dict[str, tuple[str, tuple[int, ...]]] = {}
        self.older: dict[str, tuple[str, tuple[int, ...]]] = {}

    def _split(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The pair that merges into *token* last, or None if merging its bytes ends elsewhere."""
        lower = self.ranks
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = lower.get(parts[i] + parts[i + 1])
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        pair = tuple(lower.get(p) for p in parts)
        return pair if len(pair) == 2 and None not in pair and all(p in self.halves for p in pair) else None

    def _compatible(self, a: int, b: int) -> bool:
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            got = self.fits[a, b] = self._walk(a, b)
        return got

    def _walk(self, a: int, b: int) -> bool:
        """Undo the later merge of the two again and again: was there ever a pair across the border that had to merge first?"""
        limit, halves, pairs = 1 << 60, self.halves, self.pairs
        while True:
            made = pairs.get((a, b))
            if made is not None and made < limit:
                return False
            if a > b:
                limit, right = a, halves[a][1]
                if right == a:
                    limit, left = b + 1, halves[b][0]
                    if left == b:
                        return True
                    b = left
                else:
                    a = right
            else:
                limit, left = b + 1, halves[b][0]
                if left == b:
                    limit, right = a, halves[a][1]
                    if right == a:
                        return True
                    a = right
                else:
                    b = left

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text = piece.decode("latin-1")
        ids = [i for _, i in self.automaton.iter_long(text)]  # the longest match at each end of the one before
        fits = self.fits
        for pair in zip(ids, ids[1:]):
            if not (fits[pair] if pair in fits else self._compatible(*pair)):
                return self._backtrack(text)
        return ids

    def _backtrack(self, piece: str) -> list[int]:
        at: list[list[tuple[int, int]]] = [[] for _ in piece]  # by start: (end, token), shortest first
        length = {}
        for last, i in self.automaton.iter(piece):
            n = length.get(i) or length.setdefault(i, len(self.bytes_of[i]))
            at[last + 1 - n].append((last + 1, i))
        n, pos, out, dead = len(piece), 0, [], bytearray(len(piece) + 1)
        tries: list[int] = []  # how far down the matches of each taken token's start we are
        k = len(at[0]) - 1
        while pos < n:
            here = at[pos]
            while k >= 0:
                end, i = here[k]
                if not dead[end] and (not out or self._compatible(out[-1][1], i)):
                    break
                k -= 1
            if k >= 0:
                out.append((pos, i))
                tries.append(k)
                pos = end
                k = len(at[pos]) - 1 if pos < n else 0
            else:
                dead[pos] = 1
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the piece")
                pos, _ = out.pop()
                k = tries.pop() - 1
        return [i for _, i in out]

    def _entry(self, piece: str) -> tuple[str, tuple[int, ...]]:
        got = self.older.get(piece)
        if got is None:
            ids = tuple(self.encode_piece(piece.encode("utf-8")))
            got = (",".join(map(str, ids)), ids)
        if len(self.cache) >= self.cache_pieces:  # the pieces not seen since the last turn go
            self.older, self.cache = self.cache, {}
        if len(piece) <= 64:
            self.cache[piece] = got
        return got

    def encode_entries(self, text: str) -> list[tuple[str, tuple[int, ...]]]:
        get, entry = self.cache.get, self._entry
        return [get(p) or entry(p) for p in self.find(text)]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(e[1] for e in self.encode_entries(text)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_held: dict[tuple[str, str], Bpe] = {}


def bpe_of(path: str, pattern: str) -> Bpe:
    """One encoder a worker process and vocabulary."""
    if (path, pattern) not in _held:
        _held[path, pattern] = Bpe(read_ranks(path), pattern)
    return _held[path, pattern]


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text; *path* must be readable on every executor."""

    def run(batches):
        bpe = bpe_of(path, pattern)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1).to_pylist():
                got = bpe.encode_entries(t or "")
                ids = list(chain.from_iterable([e[1] for e in got]))
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join([e[0] for e in got]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of each text."""

    def run(batches):
        bpe = bpe_of(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.encode(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
