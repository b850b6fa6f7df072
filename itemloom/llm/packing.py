"""Packing: vector bin packing by the dot-product heuristic.

A bin (sequence) has three capacities: tokens, segments and loss-bearing tokens. Bins are filled one after the other: among the
items that still fit in all three, the one with the largest dot product of demand and remaining capacity (both as shares of the
capacity) goes in. When nothing fits, an item whose tokens all bear loss (plain text) is cut to fill the gap and the rest of
it waits; items with a mask of their own (instruction examples, ``pack_examples``) are never cut unless one alone is over a capacity,
and the loss of each part is counted from its mask.
A bin that ends short of its capacity, for want of segments or items, is dealt out again as sequences whose lengths are powers
of two, largest first, which need no padding (``pad=True``, used where masked items are packed, keeps it whole instead).

Documents are tokenised and packed partition by partition while they are read: nothing is shuffled, the buffer of waiting items
is bounded (``buffer_items``), and a lost task packs the same rows again. sequence_id is partition * 2**40 + a running number.

Defined results: a null text counts as empty, so its document is the single id 0; null ids stay null; repeated rows are packed
each on their own; an empty table gives no rows; extra columns are ignored; a text of any length is cut into full sequences.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from itemloom.llm.common import give_back
from itemloom.sources import table

CAPACITY = 1024
MAX_SEGMENTS = 64
BUFFER_ITEMS = 20_000


class DotProductPacker:
    """Bins for items (key, start, tokens, loss); a piece of a bin is (key, start, tokens)."""

    def __init__(self, tokens: int = CAPACITY, segments: int = MAX_SEGMENTS, loss: int | None = None, pad: bool = False, whole: bool = False):
        """*whole*: no item is cut to fill a gap."""
        self.capacity = np.array([tokens, segments, tokens if loss is None else loss], np.int64)
        self.pad, self.whole = pad, whole
        self.waiting: dict[tuple[int, int], list] = {}  # (tokens, loss): items of that demand
        self.size = 0

    def add_masked(self, key, mask: np.ndarray) -> None:
        """Take an example by its loss mask, cut into the longest parts that are within the capacities alone."""
        before, start = np.concatenate(([0], np.cumsum(mask, dtype=np.int64))), 0
        while start < len(mask):
            stop = min(start + int(self.capacity[0]), int(np.searchsorted(before, before[start] + self.capacity[2], side="right")) - 1)
            self._put(key, start, stop - start, int(before[stop] - before[start]))
            start = stop

    def add(self, key, start: int, tokens: int, loss: int) -> Iterator[list]:
        """Take an item; what is over the capacity on its own leaves as full bins at once."""
        most = int(min(self.capacity[0], self.capacity[2])) if loss == tokens else int(self.capacity[0])
        if loss != tokens and loss > self.capacity[2]:
            raise ValueError(f"an example with {loss} loss-bearing tokens is over the capacity {self.capacity[2]}")
        while tokens >= most and (loss == tokens or tokens > most):
            yield [(key, start, most)]
            start, tokens, loss = start + most, tokens - most, max(0, loss - most)
        if tokens:
            self._put(key, start, tokens, loss)

    def _put(self, key, start, tokens, loss):
        self.waiting.setdefault((tokens, loss), []).append((key, start))
        self.size += 1

    def _bins(self) -> Iterator[tuple[list, np.ndarray]]:
        """Bins with what is left of their capacities, until nothing waits."""
        kinds = np.array(sorted(self.waiting), np.int64).reshape(-1, 2)
        demand = np.stack([kinds[:, 0], np.ones(len(kinds), np.int64), kinds[:, 1]], axis=1)
        scaled = demand / self.capacity.astype(float) ** 2
        left = np.array([len(self.waiting[tuple(k)]) for k in kinds.tolist()])
        rest: dict[tuple[int, int], list] = {}  # remainders of cut items, of demands that may be new

        def take(k):
            left[k] -= 1
            self.size -= 1
            return self.waiting[tuple(kinds[k].tolist())].pop()

        while self.size:
            room, bin_ = self.capacity.copy(), []
            while room[0] and room[1]:
                ok = (left > 0) & (demand <= room).all(axis=1)
                best = int(np.argmax(np.where(ok, scaled @ room, -1.0)))
                one = next((d for d in rest if rest[d] and d[0] <= room[0] and d[1] <= room[2]), None)
                if ok[best]:
                    key, start = take(best)
                    t, loss = kinds[best].tolist()
                elif one:
                    (key, start), (t, loss) = rest[one].pop(), one
                    self.size -= 1
                else:
                    gap = int(min(room[0], room[2]))
                    cut = np.flatnonzero((left > 0) & (kinds[:, 0] == kinds[:, 1]))
                    old = next((d for d in rest if rest[d] and d[0] == d[1]), None)
                    if self.whole or not gap or (not len(cut) and not old):
                        break
                    if old:
                        (key, start), t = rest[old].pop(), old[0]
                        self.size -= 1
                    else:
                        t = int(kinds[cut[-1], 0])
                        key, start = take(int(cut[-1]))
                    rest.setdefault((t - gap, t - gap), []).append((key, start + gap))
                    self.size += 1
                    t = loss = gap
                bin_.append((key, start, t))
                room -= (t, 1, loss)
            yield bin_, room
        self.waiting.clear()

    def flush(self, last: bool) -> Iterator[list]:
        """Pack what waits; before the last flush an unfilled final bin's pieces wait on."""
        for bin_, room in self._bins():
            if not room[0] or self.pad:
                yield bin_
            elif not self.size and not last:
                for key, start, t in bin_:
                    self._put(key, start, t, t)
                return
            else:
                yield from powers_of_two(bin_)


def powers_of_two(bin_: list) -> Iterator[list]:
    """The pieces of a bin as sequences of power-of-two lengths, largest first; pieces are cut at the borders."""
    pieces, total = list(bin_)[::-1], sum(p[2] for p in bin_)
    for size in (1 << k for k in reversed(range(total.bit_length())) if total >> k & 1):
        out = []
        while size:
            key, start, t = pieces.pop()
            if t > size:
                pieces.append((key, start + size, t - size))
                t = size
            out.append((key, start, t))
            size -= t
        yield out


_held: dict[str, object] = {}


def _encoder(json_path: str, ranks_path: str | None):
    """text -> ids (uint32) as the tokenizers library gives for *json_path* without added special tokens.

    *ranks_path* names the same vocabulary as ranks, if there is one: it encodes plain texts several times faster with equal
    ids. Texts that hold one of the tokenizer's special strings, or that the fast way refuses, go through tokenizers itself."""
    if json_path not in _held:
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(json_path)
        special = [t.content for t in slow.get_added_tokens_decoder().values()]
        plain = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        if ranks_path is None:
            _held[json_path] = plain
        else:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

            def encode(text):
                if any(s in text for s in special):
                    return plain(text)
                try:
                    return fast.encode_to_numpy(text)
                except BaseException as e:
                    if type(e).__name__ != "PanicException":
                        raise
                    return plain(text)  # the fast library's pattern gives up on some long runs; the ids are the same

            _held[json_path] = encode
    return _held[json_path]


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str | None = None, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, buffer_items: int = BUFFER_ITEMS) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Both paths must be readable on executors."""

    def run(batches):
        encode, packer = _encoder(json_path, ranks_path), DotProductPacker(capacity, max_segments)
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        rows: list[tuple] = []

        def take(bins):
            nonlocal number
            for bin_ in bins:
                at = 0
                for (doc, ids, total, first), start, t in bin_:
                    rows.append((doc, start, t, zlib.crc32(ids[start - first : start - first + t].tobytes()), total, number, at))
                    at += t
                number += 1

        def out():
            cols = list(zip(*rows, strict=True)) or [()] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *[pa.array(c, pa.int64()) for c in cols[1:]]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            id_type = b.schema.field(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(0)).astype("<u4")
                n, full = len(ids), len(ids) // capacity * capacity
                take([[((doc, ids, n, 0), s, capacity)] for s in range(0, full, capacity)])
                if n > full:
                    take(packer.add((doc, ids[full:].copy(), n, full), full, n - full, n - full))
                if packer.size >= buffer_items:
                    take(packer.flush(last=False))
            yield out()
        take(packer.flush(last=True))
        if rows:
            yield out()
        give_back()

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def tokenized_examples(formatted: DataFrame, json_path: str) -> DataFrame:
    """conv_id, ids, loss of formatted conversations (conv_id, formatted, loss_spans in characters): a token that meets a span bears loss."""

    def run(batches):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(json_path)
        for b in batches:
            ids, loss = [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                got = t.encode(text or "", add_special_tokens=False)
                at = np.array(got.offsets, np.int64).reshape(-1, 2)
                inside = np.zeros(len(text or "") + 1, np.int64)
                for s in spans or []:
                    inside[s["start"] : s["start"] + s["length"]] = 1
                before = np.concatenate(([0], np.cumsum(inside)))
                ids.append(got.ids)
                loss.append((before[at[:, 1]] > before[at[:, 0]]).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(loss, pa.list_(pa.bool_()))], ["conv_id", "ids", "loss"])

    kind = dict(formatted.dtypes)["conv_id"]
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, f"conv_id {kind}, ids array<int>, loss array<boolean>")


def pack_examples(examples: DataFrame, key: str, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, loss_capacity: int | None = None, buffer_items: int = BUFFER_ITEMS) -> DataFrame:
    """One row a piece: key, start, length, loss_tokens, sequence_id, offset, of *examples* (key, loss array<boolean>: the mask of its
    tokens), under limits on tokens, segments and loss-bearing tokens of a sequence. Sequences are padded; an example without tokens
    (or without a mask) has no piece, a null in a mask bears no loss."""

    def run(batches):
        packer = DotProductPacker(capacity, max_segments, loss_capacity, pad=True, whole=True)
        number, kind = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40, None

        def packed():
            nonlocal number
            rows = []
            for bin_ in packer.flush(last=True):
                at = 0
                for (k, mask), start, t in bin_:
                    rows.append((k, start, t, int(mask[start : start + t].sum()), number, at))
                    at += t
                number += 1
            cols = list(zip(*rows, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:]]], [key, "start", "length", "loss_tokens", "sequence_id", "offset"])

        for b in batches:
            kind = b.schema.field(0).type
            for k, mask in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.array([bool(x) for x in mask or []], bool)
                packer.add_masked((k, own), own)
            if packer.size >= buffer_items:
                yield packed()
        if packer.size:
            yield packed()

    return examples.select(key, "loss").mapInArrow(run, f"{key} {dict(examples.dtypes)[key]}, start long, length long, loss_tokens long, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
