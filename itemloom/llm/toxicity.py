r"""Toxicity: a bidirectional gated recurrent network with attention pooling, over word and character inputs, in numpy.

Inputs of a word, three parts: a learned vector of the word (one for all that the training texts hold less than twice); a vector of
its character sequence, by a convolution over all of its letters, whatever its length, with learned letter vectors and a maximum
over places; and statistics: its log-odds and their z-value among the training texts' labels, whether it is known, the mean and
largest z-value of its letter trigrams, its length and its share of digits. A forward and a backward GRU read windows of ``window``
words; attention weighs their states; a linear layer gives the window's logit. Windows overlap by half and together cover the whole
text. A document's score is a logistic function of its largest window logit and of the mean of its three largest, fitted on the
training documents. All vectors, the convolution and the GRU are trained together by gradients; learned vectors are left out
at random in training (``LEFT_OUT``).

Training is one task on an executor, over a bounded sample of labelled rows: ``max_train_docs`` at most, by hash of the id, whole texts, of
which each that would bring them over ``max_train_chars`` characters is passed over (ids with crc32(doc_id) mod 3 = 1 are held out and
never read). All words and trigrams of these texts count for the statistics, and all windows for the last logistic function; the nets
learn from the window of each text that stands out most by its words' statistics, of a clean text from any other one too, as a toxic
text's label tells only that some place of it is toxic. Statistics for a training document leave that document out, so its own words do
not give its label away. The driver gets the model alone, whose size the sample bounds, and broadcasts it; scoring is a map without shuffle.

Defined results: null and empty texts are one empty window and get the score of that; null doc_ids are scored, not held out and never
trained on; labels other than 0 and 1 are not used, nor those of an id that has both; of several texts of one id the smallest is trained
on; without labels of both kinds every score is 0; repeated rows score alike; an empty table gives no rows; language, source, id
and other columns are no inputs, clashing names are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from itemloom.llm.common import give_back, slices, written
from itemloom.sources import table

WINDOW = 48
HIDDEN = 8
MAX_TRAIN_DOCS = 6_000
MAX_TRAIN_CHARS = 24_000_000
KEPT_WORDS = 131_072  # words of the training texts whose gates a worker keeps
CACHE_WORDS = 16_384  # other words; a full cache starts anew
SCORED = 500_000  # bytes of texts that a worker turns into strings at a time
CUT = 0.7
_WORDS = re.compile(r"\w+")
F32 = np.float32
N_STATS, WORD_DIMS, CHAR_DIMS, LETTER_DIMS, LETTERS = 8, 8, 12, 6, 512
N_IN = N_STATS + WORD_DIMS + CHAR_DIMS
LEFT_OUT = 0.3
PLACES = 100_000  # letters looked at in one go


class Places:
    """Every place of the letters of some words, each with its two neighbours; a word starts after \x02 and ends before \x03."""

    def __init__(self, words: list[str]):
        self.n = len(words)
        self.codes = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.ends = np.cumsum(self.sizes)

    def chunks(self):
        """(words with a run of places, where the runs start, trigram keys, letter numbers, where in these each place starts) of PLACES places at a time."""
        total = int(self.ends[-1]) if self.n else 0
        for k in range(0, total, PLACES):
            stop = min(total, k + PLACES)
            lo, hi = np.searchsorted(self.ends, k, side="right"), np.searchsorted(self.ends, stop - 1, side="right") + 1
            ends = np.minimum(self.ends[lo:hi], stop) - k
            start = np.append(0, ends[:-1])
            at = np.arange(stop - k) + 2 * np.repeat(np.arange(hi - lo), ends - start)
            c = self.codes[k + 2 * lo : stop + 2 * hi]
            letter, wide = np.where(c < 4, c - 2, 2 + c % np.uint32(LETTERS - 2)), c.astype(np.int64)
            yield np.arange(lo, hi), start, ((wide[:-2] << 42) | (wide[1:-1] << 21) | wide[2:])[at], letter.astype(np.int64), at


class Lexicon:
    """Label statistics of words and letter trigrams over the training texts; a text is the numbers of its words in *vocabulary*."""

    def __init__(self, texts: list[np.ndarray], vocabulary: list[str], y: np.ndarray):
        counts = np.zeros((len(vocabulary), 2), np.int64)
        for ids, label in zip(texts, y, strict=True):
            counts[np.unique(ids), 0 if label else 1] += 1
        self.n = (int(y.sum()), int(len(y) - y.sum()))
        kept = np.flatnonzero(counts.sum(axis=1) > 1)
        self.words = {vocabulary[w]: k for k, w in enumerate(kept.tolist())}
        self.counts = counts[kept].astype(float)
        keys, runs = [np.zeros(0, np.int64)], np.zeros(len(vocabulary) + 1, np.int64)
        place = Places(vocabulary)
        runs[1:] = place.ends
        keys = np.concatenate([keys[0], *[k for _, _, k, _, _ in place.chunks()]])
        self.keys, number = np.unique(keys, return_inverse=True)
        tri = np.zeros((len(self.keys), 2), np.int64)
        for ids, label in zip(texts, y, strict=True):
            own = np.unique(ids)
            size = runs[own + 1] - runs[own]
            at = np.repeat(runs[own] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
            tri[np.unique(number[at]), 0 if label else 1] += 1
        self.z = self.odds(tri[:, 0], tri[:, 1])[1]

    def odds(self, pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo = np.log((pos + 0.5) / (self.n[0] + 1)) - np.log((neg + 0.5) / (self.n[1] + 1))
        return lo, lo / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))

    def numbers(self, words: list[str]) -> np.ndarray:
        """Row of each word's learned vector: 0 for the unknown, else 1 + its place."""
        return np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words)) + 1

    def stats(self, words: list[str], places: Places, left_out: int | None = None) -> np.ndarray:
        """Statistics (len(words), N_STATS); *left_out*: the label of the training text that they are from."""
        at = self.numbers(words)
        counts = np.where((at > 0)[:, None], self.counts[np.maximum(at - 1, 0)] if len(self.counts) else 0.0, 0.0)
        if left_out is not None:
            k = 0 if left_out else 1
            counts[:, k] = np.maximum(0, counts[:, k] - 1)
        lo, z = self.odds(counts[:, 0], counts[:, 1])
        seen = counts.sum(axis=1) > 0
        most, total = np.full(len(words), -np.inf), np.zeros(len(words))
        for word, start, key, _, _ in places.chunks():
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1) if len(self.keys) else np.zeros(len(key), np.int64)
            found = np.where(self.keys[spot] == key, self.z[spot], 0.0) if len(self.keys) else np.zeros(len(key))
            most[word] = np.maximum(most[word], np.maximum.reduceat(found, start))
            total[word] += np.add.reduceat(found, start)
        x = np.zeros((len(words), N_STATS), F32)
        x[:, 0], x[:, 1], x[:, 2] = np.where(seen, z, 0) / 4, np.where(seen, lo, 0) / 4, seen
        x[:, 3], x[:, 4], x[:, 5] = total / np.maximum(places.sizes, 1) / 4, most / 4, np.minimum(places.sizes, 20) / 10
        x[:, 6] = [0 if w.isalpha() else sum(map(str.isdigit, w)) / len(w) for w in words]  # no letter is a digit
        x[:, 7] = 1
        return x


class WordNet:
    """Learned vectors of words, and of their letters by a convolution of width 3 with a maximum over places."""

    def __init__(self, words: int, seed: int = 4):
        rng = np.random.default_rng(seed)
        self.p = {k: rng.normal(0, d, s).astype(F32) for k, d, s in (("E", 0.05, (words + 1, WORD_DIMS)), ("C", 0.5, (LETTERS, LETTER_DIMS)), ("K", 0.3, (3, LETTER_DIMS, CHAR_DIMS)), ("k", 0.1, (CHAR_DIMS,)))}

    def characters(self, places: Places, keep: bool = False):
        """The character vector of each word; *keep*: also where each maximum was found, as three letters each."""
        tables = [self.p["C"] @ self.p["K"][j] for j in range(3)]
        top = np.full((places.n, CHAR_DIMS), -np.inf, F32)
        won = np.zeros((places.n, CHAR_DIMS, 3), np.int64)
        for word, start, _, codes, places_at in places.chunks():
            a = tables[0].take(codes[:-2], axis=0)
            a += tables[1].take(codes[1:-1], axis=0)
            a += tables[2].take(codes[2:], axis=0)
            a = a.take(places_at, axis=0)
            best = np.maximum.reduceat(a, start, axis=0)
            if keep:
                letter = codes[places_at[:, None] + np.arange(3)]
                runs = np.diff(np.append(start, len(a)))
                at = np.where(a == np.repeat(best, runs, axis=0), np.arange(len(a))[:, None], len(a))
                better = best > top[word]
                won[word] = np.where(better[:, :, None], letter[np.minimum.reduceat(at, start, axis=0)], won[word])
            top[word] = np.maximum(top[word], best)
        out = np.tanh(top + self.p["k"])
        return (out, won) if keep else out

    def vectors(self, numbers: np.ndarray, places: Places) -> np.ndarray:
        return np.concatenate((self.p["E"][numbers], self.characters(places)), axis=1)

    def gradients(self, chars: np.ndarray, won: np.ndarray, g: np.ndarray) -> dict[str, np.ndarray]:
        """Of C, K and k, from the gradient *g* of the character vectors."""
        d = g * (1 - chars * chars)
        grad = {"C": np.zeros_like(self.p["C"]), "K": np.zeros_like(self.p["K"]), "k": d.sum(axis=0)}
        for j in range(3):
            table = np.bincount((won[:, :, j] * CHAR_DIMS + np.arange(CHAR_DIMS)).ravel(), d.ravel(), LETTERS * CHAR_DIMS).reshape(LETTERS, CHAR_DIMS).astype(F32)
            grad["C"] += table @ self.p["K"][j].T
            grad["K"][j] = self.p["C"].T @ table
        return grad


def _sigmoid(x):
    return F32(0.5) * np.tanh(F32(0.5) * x) + F32(0.5)


class BiGru:
    def __init__(self, hidden: int = HIDDEN, seed: int = 3):
        rng, h = np.random.default_rng(seed), hidden
        self.h = h
        self.p = {k: rng.normal(0, 0.3, s).astype(F32) for k, s in {"Wf": (N_IN, 3 * h), "Uf": (h, 3 * h), "bf": (3 * h,), "Wb": (N_IN, 3 * h), "Ub": (h, 3 * h), "bb": (3 * h,), "A": (2 * h,), "w": (2 * h,), "c": (1,)}.items()}

    def inputs(self, x, d):
        """What the inputs (..., N_IN) add to the gates of one direction."""
        return x @ self.p["W" + d] + self.p["b" + d]

    def _pass(self, a, mask, d, keep):
        """States of one direction (T, B, H); a: its inputs (T, B, 3H), mask: (T, B, 1)."""
        u, h = self.p["U" + d], self.h
        T, B = a.shape[:2]
        s, out, tape = np.zeros((B, h), F32), np.empty((T, B, h), F32), []
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            q = s @ u
            zr = _sigmoid(a[t, :, : 2 * h] + q[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(a[t, :, 2 * h :] + r * q[:, 2 * h :])
            new = s + mask[t] * (1 - z) * (n - s)
            if keep:
                tape.append((t, s, z, r, n, q[:, 2 * h :]))
            s = out[t] = new
        return out, tape

    def logits(self, x, mask, keep=False):
        f, tf = self._pass(self.inputs(x, "f"), mask, "f", keep)
        b, tb = self._pass(self.inputs(x, "b"), mask, "b", keep)
        states = np.concatenate((f, b), axis=2)
        e = np.where(mask[:, :, 0] > 0, states @ self.p["A"], F32(-30))
        e = np.exp(e - e.max(axis=0))
        att = e / e.sum(axis=0)
        pooled = (att[:, :, None] * states).sum(axis=0)
        out = pooled @ self.p["w"] + self.p["c"][0]
        return (out, (states, att, pooled, tf, tb)) if keep else out

    def gates(self, x):
        """What the inputs (n, N_IN) add to the gates, (3, 2, n, H) by gate and direction; halved where a sigmoid is taken, as half of a tanh and a half."""
        a = np.stack((self.inputs(x, "f"), self.inputs(x, "b"))).reshape(2, len(x), 3, self.h)
        a[:, :, :2] *= F32(0.5)
        return np.ascontiguousarray(a.transpose(2, 0, 1, 3))

    def no_word(self):
        """Gates that leave a state as it is."""
        a = np.zeros((3, 2, 1, self.h), F32)
        a[0] = 1e6
        return a

    def window_logits(self, gates, at, chunk=512):
        """Logits of windows, rows of *gates* (windows, T); row 0 is no word. Both directions go together, gates lie apart: every operation reads whole arrays."""
        p, h, out = self.p, self.h, np.empty(len(at), F32)
        u = np.stack([p["U" + d].reshape(h, 3, h).transpose(1, 0, 2) for d in "fb"], axis=1) * F32(0.5)
        ends = np.stack((p["A"].reshape(2, h), p["w"].reshape(2, h)), axis=2)  # what attention and the last layer make of a state
        for k in range(0, len(at), chunk):
            ids = np.ascontiguousarray(at[k : k + chunk].T, np.intp)
            T, B = ids.shape
            s, a, q, seen = np.zeros((2, B, h), F32), np.empty((3, 2, B, h), F32), np.empty((3, 2, B, h), F32), np.empty((T, 2, B, 2), F32)
            z, r, n = a
            for t in range(T):
                for g in range(3):
                    np.take(gates[g, 0], ids[t], axis=0, out=a[g, 0], mode="clip")
                    np.take(gates[g, 1], ids[T - 1 - t], axis=0, out=a[g, 1], mode="clip")
                np.matmul(s, u, out=q)
                a[:2] += q[:2]
                np.tanh(a[:2], out=a[:2])
                r += F32(1)
                q[2] *= r
                n += q[2]
                np.tanh(n, out=n)
                n -= s
                np.subtract(F32(1), z, out=z)
                z *= F32(0.5)
                n *= z
                s += n
                both = s @ ends
                seen[t, 0], seen[T - 1 - t, 1] = both
            e, v = seen[:, 0, :, 0] + seen[:, 1, :, 0], seen[:, 0, :, 1] + seen[:, 1, :, 1]
            e = np.where(ids > 0, e, F32(-30))
            e = np.exp(e - e.max(axis=0))
            out[k : k + chunk] = (e * v).sum(axis=0) / e.sum(axis=0) + p["c"][0]
        return out

    def gradients(self, x, mask, g, saved):
        states, att, pooled, tf, tb = saved
        p, h = self.p, self.h
        grad = {"w": pooled.T @ g, "c": np.array([g.sum()], F32)}
        dp = g[:, None] * p["w"]
        da = (states * dp).sum(axis=2)
        de = att * (da - (att * da).sum(axis=0)) * mask[:, :, 0]
        grad["A"] = (de[:, :, None] * states).sum(axis=(0, 1))
        ds = att[:, :, None] * dp + de[:, :, None] * p["A"]
        grad["x"] = np.zeros_like(x)
        for d, tape, part in (("f", tf, ds[:, :, :h]), ("b", tb, ds[:, :, h:])):
            dw, du, db, carry = np.zeros_like(p["W" + d]), np.zeros_like(p["U" + d]), np.zeros_like(p["b" + d]), np.zeros((x.shape[1], h), F32)
            for t, s, z, r, n, qn in reversed(tape):
                full = carry + part[t]
                one = full * mask[t]
                dn = one * (1 - z) * (1 - n * n)
                dz = one * (s - n) * z * (1 - z)
                dr = dn * qn * r * (1 - r)
                dt, dq = np.concatenate((dz, dr, dn), axis=1), np.concatenate((dz, dr, dn * r), axis=1)
                dw += x[t].T @ dt
                grad["x"][t] += dt @ p["W" + d].T
                db += dt.sum(axis=0)
                du += s.T @ dq
                carry = full - one + one * z + dq @ p["U" + d].T
            grad |= {"W" + d: dw, "U" + d: du, "b" + d: db}
        return grad


class Adam:
    """Steps of Adam on some arrays in place; of rows of a large one (``rows``) by their own squared gradients alone."""

    def __init__(self, rate: float = 0.01):
        self.rate, self.step, self.m, self.v = rate, 0, {}, {}

    def __call__(self, p: dict, grad: dict) -> None:
        self.step += 1
        for name, g in grad.items():
            g = np.clip(g, -1, 1) + F32(1e-4) * p[name]
            self.m[name] = F32(0.9) * self.m.get(name, F32(0)) + F32(0.1) * g
            self.v[name] = F32(0.999) * self.v.get(name, F32(0)) + F32(0.001) * g * g
            p[name] -= F32(self.rate) * (self.m[name] / F32(1 - 0.9**self.step)) / (np.sqrt(self.v[name] / F32(1 - 0.999**self.step)) + F32(1e-8))

    def rows(self, p: dict, name: str, at: np.ndarray, g: np.ndarray) -> None:
        v = self.v.setdefault(name, np.full(len(p[name]), 1e-6, F32))
        v[at] += (g * g).mean(axis=1)
        p[name][at] -= F32(self.rate) * (g / np.sqrt(v[at])[:, None] + F32(0.01) * p[name][at])


def train_nets(gru: BiGru, words: WordNet, vocabulary: list[str], numbers: np.ndarray, stats: np.ndarray, ids: np.ndarray, mask: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 128, seed: int = 5, least_steps: int = 600) -> None:
    """Both nets on the mean logistic loss of windows; *ids* (windows, T) into *vocabulary* and *stats* (label, word, N_STATS)."""
    rng, adam = np.random.default_rng(seed), Adam()
    for _ in range(max(epochs, -(-least_steps * batch // len(y)))):
        order = rng.permutation(len(y))
        for k in range(0, len(y), batch):
            i = order[k : k + batch]
            used, inverse = np.unique(ids[i].T, return_inverse=True)
            inverse = inverse.reshape(ids.shape[1], len(i))
            chars, won = words.characters(Places([vocabulary[w] for w in used.tolist()]), keep=True)
            learned = np.concatenate((words.p["E"][numbers[used]], chars), axis=1)
            mb = np.ascontiguousarray(mask[i].T[:, :, None])
            on = mb * (rng.random((*inverse.shape, 1)) >= LEFT_OUT)  # a word counts by its statistics alone now and then
            x = np.concatenate((stats[y[i].astype(np.int64)[None], ids[i].T], learned[inverse] * on), axis=2).astype(F32) * mb
            out, saved = gru.logits(x, mb, keep=True)
            grad = gru.gradients(x, mb, ((_sigmoid(out) - y[i]) / len(i)).astype(F32), saved)
            dx = (grad.pop("x")[:, :, N_STATS:] * on * mb).reshape(-1, WORD_DIMS + CHAR_DIMS)
            by = np.argsort(inverse.ravel(), kind="stable")
            each = np.add.reduceat(dx[by], np.searchsorted(inverse.ravel()[by], np.arange(len(used))), axis=0)
            adam(gru.p | words.p, grad | words.gradients(chars, won, each[:, WORD_DIMS:]))
            rows, back = np.unique(numbers[used], return_inverse=True)
            g = np.zeros((len(rows), WORD_DIMS), F32)
            np.add.at(g, back, each[:, :WORD_DIMS])
            adam.rows(words.p, "E", rows, g)


def windows_of(n: int, window: int) -> np.ndarray:
    """Row numbers (windows, window) of overlapping windows over n rows, -1 beyond the end; together they cover all."""
    half = window // 2
    blocks = max(2, -(-n // half))
    at = np.arange(blocks * half).reshape(blocks, half)
    at[at >= n] = -1
    return np.concatenate((at[:-1], at[1:]), axis=1)


class Model:
    """Lexicon, nets and calibration; ``score`` gives probabilities for texts."""

    def __init__(self, lexicon: Lexicon | None, net: BiGru | None, words: WordNet | None, link: np.ndarray | None, window: int = WINDOW):
        self.lexicon, self.net, self.words, self.link, self.window = lexicon, net, words, link, window

    def __getstate__(self):
        return self.__dict__ | {"index": None, "gates": None, "done": None}

    def _ready(self):
        if self.__dict__.get("index") is None:
            self.kept = min(len(self.lexicon.words), KEPT_WORDS)
            self.index: dict[str, int] = {}  # rows of words that are not kept
            self.gates = np.zeros((3, 2, 1 + self.kept + CACHE_WORDS, self.net.h), F32)  # row 0: no word; then the kept words by number
            self.gates[:, :, :1] = self.net.no_word()
            self.done = np.zeros(1 + self.kept, bool)

    def inputs(self, words: list[str]) -> np.ndarray:
        """Inputs (len(words), N_IN)."""
        places = Places(words)
        return np.concatenate((self.lexicon.stats(words, places), self.words.vectors(self.lexicon.numbers(words), places)), axis=1)

    def _rows(self, words: list[str]) -> np.ndarray:
        """The row of gates of each word."""
        rows = self.lexicon.numbers(words)
        other = np.flatnonzero((rows == 0) | (rows > self.kept))
        names = [words[k] for k in other.tolist()]
        get = self.index.get
        new = list(dict.fromkeys(w for w in names if get(w) is None))
        if len(self.index) + len(new) > CACHE_WORDS:
            self.index.clear()
            new = list(dict.fromkeys(names))
        first = 1 + self.kept + len(self.index)
        at = np.arange(first, first + len(new))
        if at.size and at[-1] >= self.gates.shape[2]:
            self.gates = np.concatenate((self.gates, np.zeros((3, 2, at[-1] + 1 - self.gates.shape[2], self.net.h), F32)), axis=2)
        self.index.update(zip(new, at.tolist(), strict=True))
        rows[other] = [self.index[w] for w in names]
        own = np.flatnonzero(rows <= self.kept)
        own = own[~self.done[rows[own]]]
        kept, which = np.unique(rows[own], return_index=True)
        self.done[kept] = True
        new += [words[k] for k in own[which].tolist()]
        if new:
            self.gates[:, :, np.append(at, kept)] = self.net.gates(self.inputs(new))
        return rows

    @staticmethod
    def summary(logits: np.ndarray) -> tuple[float, float]:
        top = np.sort(logits)[::-1][:3]
        return float(top[0]), float(top.mean())

    def score(self, texts: list[str]) -> np.ndarray:
        if self.net is None:
            return np.zeros(len(texts))
        self._ready()
        out, k = np.empty((len(texts), 2)), 0
        while k < len(texts):  # some documents at a time, so that memory is bounded
            words, sizes, at, first = [], [], [], k
            while k < len(texts) and sum(sizes) < 1024:
                own = _WORDS.findall(texts[k].lower())
                w = windows_of(len(own), self.window)
                at.append(np.where(w >= 0, w + len(words), -1))
                words += own
                sizes.append(len(w))
                k += 1
            rows = np.append(self._rows(words), 0)  # -1, the last, is no word
            logits = self.net.window_logits(self.gates, rows[np.concatenate(at)])
            for n, part in enumerate(np.split(logits, np.cumsum(sizes)[:-1])):
                out[first + n] = self.summary(part)
        return 1 / (1 + np.exp(-(out @ self.link[:2] + self.link[2])))


def fit_link(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton's method."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 1e-2 * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), g)
    return w


def train_model(texts: Iterable[str], y: np.ndarray, window: int = WINDOW, **net) -> Model:
    """A model of *texts* and their labels (0 or 1); each text is read once and not kept."""
    y = np.asarray(y, np.int64)
    if not len(y) or y.min() == y.max():
        return Model(None, None, None, None, window)
    place: dict[str, int] = {}
    ids = [np.array([place.setdefault(w, len(place)) for w in _WORDS.findall(t.lower())], np.int32) for t in texts]
    vocabulary = list(place)
    lexicon, places = Lexicon(ids, vocabulary, y), Places(vocabulary)
    stats = np.stack([lexicon.stats(vocabulary, places, left_out=k) for k in (0, 1)])
    rng, picked, masks, labels = np.random.default_rng(1), [], [], []
    for own, label in zip(ids, y, strict=True):
        at = windows_of(len(own), window)
        known = own[np.maximum(at, 0)] if len(own) else np.zeros(at.shape, np.int64)
        z = np.where(at >= 0, np.maximum(stats[label, known, 0], 0) ** 2 if len(own) else 0.0, 0.0).sum(axis=1)
        for k in {int(np.argmax(z))} | (set() if label else {int(rng.integers(len(at)))}):  # the window that stands out; of clean texts any other too
            picked.append(known[k])
            masks.append((at[k] >= 0).astype(F32))
            labels.append(label)
    gru, words = BiGru(**net), WordNet(len(lexicon.words))
    model = Model(lexicon, gru, words, None, window)
    if vocabulary:
        train_nets(gru, words, vocabulary, lexicon.numbers(vocabulary), stats, np.stack(picked), np.stack(masks), np.array(labels, F32))
    vectors = words.vectors(lexicon.numbers(vocabulary), places) if vocabulary else np.zeros((0, WORD_DIMS + CHAR_DIMS), F32)

    found, k = np.empty((len(ids), 2)), 0
    while k < len(ids):  # some documents at a time, so that memory is bounded
        first, spans, sizes = k, [], []
        while k < len(ids) and sum(sizes) < 1024:
            spans.append(windows_of(len(ids[k]), window))
            sizes.append(len(spans[-1]))
            k += 1
        group, n = np.concatenate(ids[first:k]), np.array([len(own) for own in ids[first:k]])
        x = np.concatenate((stats[np.repeat(y[first:k], n), group], vectors[group]), axis=1)
        before = np.repeat(np.cumsum(n) - n, sizes)[:, None]
        at = np.concatenate(spans)
        logits = gru.window_logits(np.concatenate((gru.no_word(), gru.gates(x)), axis=2), np.where(at >= 0, at + before + 1, 0))
        found[first:k] = [model.summary(part) for part in np.split(logits, np.cumsum(sizes)[:-1])]
    model.link = fit_link(found, y)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, max_chars: int = MAX_TRAIN_CHARS) -> DataFrame:
    """doc_id, text, toxic of at most *max_docs* labelled documents, by hash of the id, none of them held out, with *max_chars* characters at most."""
    ids = F.crc32(F.col("doc_id").cast("string"))
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & (F.pmod(ids, F.lit(3)) != 1))
    marks = marks.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).filter("toxic = other").select("doc_id", "toxic")
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)  # bounded: the join's small side
    rows = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = written(rows.withColumn("n", F.char_length("text")), "toxic-rows")
    left, fits = max_chars, []
    for r in rows.select("doc_id", "n").orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # max_docs rows at most, without texts
        if r["n"] <= left:
            left -= r["n"]
            fits.append(r["doc_id"])
    kind = rows.select("doc_id").schema
    own = F.broadcast(docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(fits, to_arrow_type(kind[0].dataType))}), kind))  # of Arrow, which needs no Python worker
    return rows.join(own, "doc_id").select("doc_id", "text", "toxic")


def fit_from_tables(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, max_chars: int = MAX_TRAIN_CHARS) -> Model:
    """The model of the labelled rows, trained in one task, as the sample is bounded."""

    def train(batches):
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), reverse=True)
        y = np.array([r[2] for r in reversed(rows)], np.int64)
        model = pickle.dumps(train_model((rows.pop()[1] for _ in range(len(y))), y))
        rows.clear()
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    found = training_rows(docs, labels, max_docs, max_chars).coalesce(1).mapInArrow(train, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else train_model([], np.zeros(0, np.int64))


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """A struct ``_in`` of all columns of *docs* and ``_score``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = held.value
        for b in (part for whole in batches for part in slices(whole, whole.column(0).field(at), SCORED)):
            texts = [t or "" for t in b.column(0).field(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.score(texts), pa.float64())], ["_in", "_score"])
        give_back()

    at = [c.lower() for c in docs.columns].index("text")  # read in its place among the columns: a text goes to the worker once
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_in"))
    kind = rows.schema["_in"].dataType
    return rows.mapInArrow(run, T.StructType([T.StructField("_in", kind), T.StructField("_score", T.DoubleType())]))


def reject_toxic(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows of *docs* that score under *cut*, with all their columns."""
    kept = with_scores(docs, model).filter(F.col("_score") < cut)
    return kept.select(*[F.col(f"_in.`{c}`").alias(c) for c in docs.columns])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = with_scores(docs, fit_from_tables(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("_in.doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return d.select(F.col("_in.doc_id").alias("doc_id"), held_out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= CUT).cast("int").alias("predicted"))
