"""Abusive, hateful or sexual content, by non-negative positive-unlabelled learning.

Abuse is mostly one sentence of a longer text, so that texts are cut into windows of words and a
text's score is that of its worst window. A linear classifier over hashed features of windows is
trained in numpy from the windows of confirmed abusive texts and from those of all texts of the
corpus, unlabelled: with pi the share of abusive windows among all, the risk is

    pi E_p[l(f)] + max(0, E_u[l(-f)] - pi E_p[l(-f)])

and a step for which the second part has become negative goes the other way, which keeps the
classifier from fitting unlabelled abuse as harmless. A label holds for a text, not for a window:
which windows of a confirmed text are abusive is chosen anew between rounds.

Nothing but the labelled rows is sampled. Texts are cut once, into numbers, and laid out in shards
by a hash of their id; in each round every shard is learnt from as a whole by a learner of its own
that starts from the common weights, and the learners' weights are averaged, by their numbers of
windows, over slices of the weights. Word and feature counts are those of all texts. pi comes from
the scores of all texts and of confirmed ones kept back from training: the least ratio of the two
shares above a threshold, with a bound of its error (best bin estimate). The threshold of the result
maximises recall^2 / share of all texts above it, which needs no clean labels.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.shared import written

#: Most labelled documents that training reads; the one bound of a sample.
MAX_LABELLED = 20_000
FEATURE_BITS = 18
WINDOW, STRIDE = 14, 5
ROUNDS = 4
#: Texts of a shard, about; texts and least number of steps of a learner in a round.
SHARD_TEXTS, STEP_TEXTS, STEPS = 8_000, 300, 50
MIN_WORD_TEXTS = 3
#: Share of each step's unlabelled part that comes from reviewed texts that aren't abusive: they hold the hard cases.
REVIEWED_SHARE = 0.25
#: Mean log-odds of standing in confirmed rather than in reviewed clean texts from which a window may be abusive.
HINT = 0.2
HARD_WEIGHT = 20.0
#: One of so many confirmed texts is kept back from training, for pi and the threshold.
KEPT_BACK = 5
#: Edges of the histogram of scores.
_EDGES = np.linspace(-20.0, 20.0, 1_601)
_SLICES = 64
_UNKNOWN, _BEGIN, _STOP, _FIRST_WORD = 0, 1, 2, 3

#: Letters of other scripts that look like Latin ones.
_LOOKALIKES = str.maketrans(
    {
        "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j",
        "һ": "h", "ԁ": "d", "к": "k", "м": "m", "н": "h", "т": "t", "в": "b", "ο": "o", "α": "a", "ε": "e",
        "ι": "i", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "κ": "k", "ı": "i", "ɡ": "g", "ß": "ss",
    }
)
#: Digits and signs written for letters.
_SIGNS = str.maketrans("013457@$!", "oieastasi")

_HIDDEN = re.compile("[­​-‏⁠-⁤﻿]")
#: The blocks of combining marks that Latin letters are written with.
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_FOREIGN = re.compile("[^\x00-\x7f]{2,}")
_TAG = re.compile(r"<[^<>\s][^<>]{0,80}>|&[a-z#0-9]{2,8};")
_SPELLED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ \-._]){3,}[^\W\d_](?![^\W_])")
#: A token, or the end of a sentence or line.
_ITEM = re.compile(r"[^\W_][\w@$!*]*[\w@$*]|[^\W_]|[.!?]+(?=\s|$)|[\n\r]+")
_ENDS = frozenset(".!?\n\r")
_MIXED = re.compile(r"[^\W\d_][\d@$!]|[\d@$!][^\W\d_]")
_AGAIN = re.compile(r"(.)\1+")


def _mended(found: re.Match) -> str:
    """Text that was decoded with the wrong table, decoded again."""
    run = found.group()
    try:
        raw = b"".join(c.encode("cp1252") if c not in "\x81\x8d\x8f\x90\x9d" else c.encode("latin-1") for c in run)
    except UnicodeEncodeError:
        try:
            raw = run.encode("latin-1")
        except UnicodeEncodeError:
            return run
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return run


def plain(text: str) -> str:
    """Lower case without marks, hidden characters, markup, look-alike letters and spelled-out words."""
    if not text.isascii():
        text = _HIDDEN.sub("", text)
        text = _FOREIGN.sub(_mended, text)
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower()
        if not text.isascii():
            text = text.translate(_LOOKALIKES)
    text = _TAG.sub(" ", text.lower())
    return _SPELLED.sub(lambda m: re.sub(r"[ \-._]", "", m.group()), text)


def word(token: str) -> str:
    """A token's one form: signs written for letters undone and each letter once."""
    if "*" in token:
        return "*"
    if _MIXED.search(token):
        token = token.translate(_SIGNS)
    return _AGAIN.sub(r"\1", token)


class _Forms(dict):
    """A number for each token, that of its one form, and _STOP for an end; kept for tokens that recur."""

    def __missing__(self, token: str) -> int:
        if token[0] in _ENDS:
            h = _STOP
        else:
            h = max(xxhash.xxh32_intdigest(word(token).encode("utf-8", "surrogatepass")) >> 1, _FIRST_WORD)
        if len(self) >= 500_000:
            self.clear()
        self[token] = h
        return h


def numbered(texts: list[str | None], forms: _Forms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, parts, parts of each text): the words of the texts as numbers, each sentence or line between two marks, the
    lengths of these parts, and how many each text has."""
    flat: list[int] = []
    sizes = np.zeros(len(texts), dtype=np.int64)
    of = forms.__getitem__
    for k, text in enumerate(texts):
        if text:
            found = _ITEM.findall(plain(text))
            flat += map(of, found)
            sizes[k] = len(found)
    items = np.array(flat, dtype=np.int32)
    text = np.repeat(np.arange(len(texts)), sizes)
    end = items == _STOP
    # a part is what lies between two ends or at the edge of a text; those without words are none
    begun = np.ones(len(items), dtype=bool)
    begun[1:] = end[:-1] | (text[1:] != text[:-1])
    part = np.cumsum(begun) - 1
    words = np.bincount(part[~end], minlength=int(part[-1]) + 1 if len(part) else 0)
    part_text = text[begun]
    live = words > 0
    parts = words[live] + 2
    at = np.cumsum(parts) - parts
    out = np.full(int(parts.sum()), _BEGIN, dtype=np.int32)
    out[at + parts - 1] = _STOP
    rank = np.cumsum(live) - 1
    kept = part[~end]
    first = np.cumsum(words) - words
    out[at[rank[kept]] + 1 + np.arange(len(kept)) - first[kept]] = items[~end]
    return out, parts.astype(np.int32), np.bincount(part_text[live], minlength=len(texts))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


class Cut:
    """Texts as numbers, laid out one after another, with their windows and the features of every place.

    A part of up to WINDOW words and a bit is one window, a longer one is covered by windows that overlap. A window's
    features are its words, pairs, triples and pairs with a gap; marks of the beginning and end belong to the windows there.
    """

    def __init__(self, words: np.ndarray, parts: np.ndarray, per_text: np.ndarray, vocabulary: np.ndarray | None = None):
        """`words` of all texts, lengths of their `parts`, and the number of parts of each text."""
        self.texts = len(per_text)
        self.parts, self.parts_of_text = parts, per_text
        words = words.astype(np.uint64)
        self.mark = (words == _BEGIN) | (words == _STOP)
        if vocabulary is not None:
            words = np.where(self.mark | np.isin(words, vocabulary), words, np.uint64(_UNKNOWN))
        self.words = words
        n = parts.astype(np.int64) - 2
        at = np.cumsum(parts, dtype=np.int64) - parts
        times = np.where(n <= WINDOW + STRIDE // 2, 1, -(-(n - STRIDE) // STRIDE))
        part = np.repeat(np.arange(len(parts)), times)
        k = np.arange(len(part)) - np.repeat(np.cumsum(times) - times, times)
        single = times[part] == 1
        low = k * STRIDE
        high = np.where(single, n[part], np.minimum(low + WINDOW, n[part]))
        self.start = at[part] + 1 + low - (k == 0)
        self.stop = at[part] + 1 + high + (high == n[part])
        text_of_part = np.repeat(np.arange(self.texts), per_text)
        self.text = text_of_part[part]
        self.per_text = np.bincount(text_of_part, weights=parts, minlength=self.texts).astype(np.int64)  # places
        long = self.stop - self.start
        self.scale = 1 / np.sqrt(np.maximum(4 * long - 5, 1))
        self.f = self._features()

    def _features(self) -> np.ndarray:
        x = _mix(self.words * np.uint64(0x9E3779B97F4A7C15))
        pad = np.concatenate([x, np.zeros(2, dtype=np.uint64)])
        y, z = pad[1 : len(x) + 1], pad[2 : len(x) + 2]
        every = (
            x + np.uint64(1), x * np.uint64(3) + y * np.uint64(5) + np.uint64(2),
            x * np.uint64(3) + y * np.uint64(7) + z * np.uint64(11) + np.uint64(3), x * np.uint64(3) + z * np.uint64(13) + np.uint64(4),
        )
        return np.stack([(_mix(v * np.uint64(0xD1342543DE82EF95)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32) for v in every])

    def scores(self, w: np.ndarray, b: float, low: int = 0, high: int | None = None) -> np.ndarray:
        """Scores of the windows low to high, as log-odds: by sums of weights up to each place."""
        s, e = self.start[low:high], self.stop[low:high]
        if not len(s):
            return np.empty(0)
        p, q = s[0], e.max()
        total = np.zeros(len(s))
        for kind, short in enumerate((0, 1, 2, 2)):
            at = w[self.f[kind, p:q]]
            if kind == 0:
                at = np.where(self.mark[p:q], 0.0, at)
            sums = np.concatenate([[0.0], np.cumsum(at)])
            total += sums[e - p - short] - sums[s - p]
        return total * self.scale[low:high] + b

    def slopes(self, by_window: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Features and what each adds to the sum over the windows low to high of by_window times their features."""
        s, e = self.start[low:high], self.stop[low:high]
        p, q = s[0], e.max()
        g = by_window * self.scale[low:high]
        begun = np.bincount(s - p, weights=g, minlength=q - p + 1)
        parts = []
        for kind, short in enumerate((0, 1, 2, 2)):
            each = np.cumsum(begun - np.bincount(e - p - short, weights=g, minlength=q - p + 1))[:-1]
            parts.append(np.where(self.mark[p:q], 0.0, each) if kind == 0 else each)
        return self.f[:, p:q].ravel(), np.concatenate(parts)

    def gradient(self, by_window: np.ndarray, low: int, high: int) -> np.ndarray:
        """Sum over the windows low to high of by_window times their features."""
        f, each = self.slopes(by_window, low, high)
        return np.bincount(f, weights=each, minlength=1 << FEATURE_BITS)

    def expanded(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features, number of each window) of single windows, one after another."""
        flat, window = [], []
        for kind, short in enumerate((0, 1, 2, 2)):
            s = self.start[rows]
            n = self.stop[rows] - s - short
            at = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(n.sum())
            of = np.repeat(np.arange(len(rows)), n)
            ok = ~self.mark[at] if kind == 0 else slice(None)
            flat.append(self.f[kind, at[ok]])
            window.append(of[ok])
        of = np.concatenate(window)
        order = np.argsort(of, kind="stable")
        return np.concatenate(flat)[order], np.bincount(of, minlength=len(rows)).astype(np.int64)

    def hints(self, rows: np.ndarray, odds: np.ndarray) -> np.ndarray:
        """Mean of the eight greatest log-odds of each window's features."""
        if not len(rows):
            return np.empty(0)
        flat, size = self.expanded(rows)
        laid = np.full((len(rows), max(int(size.max()), 8)), -np.inf)
        laid[np.repeat(np.arange(len(rows)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = odds[flat]
        best = -np.partition(-laid, 7, axis=1)[:, :8]
        return np.where(np.isfinite(best), best, 0.0).sum(axis=1) / np.minimum(size, 8)

    def fresh(self) -> np.ndarray:
        """Whether each window is the first with its words in its text: a text that repeats itself counts no more for that."""
        each = _mix((self.words + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(each)])
        kind = sums[self.stop] - sums[self.start]
        order = np.lexsort((kind, self.text))
        first = np.ones(len(order), dtype=bool)
        first[order[1:]] = (kind[order[1:]] != kind[order[:-1]]) | (self.text[order[1:]] != self.text[order[:-1]])
        return first

    def text_scores(self, by_window: np.ndarray) -> np.ndarray:
        """The greatest score of each text's windows; -20 for a text without words."""
        out = np.full(self.texts, -20.0)
        np.maximum.at(out, self.text, by_window)
        return out

    def text_counts(self) -> np.ndarray:
        """Number of texts that each feature stands in."""
        last = self.words == _STOP
        ends = np.append(last[1:], True)
        ok = (~self.mark, ~last, ~last & ~ends, ~last & ~ends)
        total = np.zeros(1 << FEATURE_BITS, dtype=np.int64)
        edges = np.cumsum(self.per_text)
        lo = 0
        for first in range(0, self.texts, 4_096):  # texts and features in 32 bits, which sort faster
            hi = int(edges[min(first + 4_096, self.texts) - 1])
            text = np.repeat(np.arange(len(self.per_text[first : first + 4_096]), dtype=np.uint32) << np.uint32(FEATURE_BITS), self.per_text[first : first + 4_096])
            both = np.sort(np.concatenate([(text + self.f[kind, lo:hi].astype(np.uint32))[ok[kind][lo:hi]] for kind in range(4)]))
            fresh = np.ones(len(both), dtype=bool)
            fresh[1:] = both[1:] != both[:-1]
            total += np.bincount(both[fresh] & np.uint32((1 << FEATURE_BITS) - 1), minlength=1 << FEATURE_BITS)
            lo = hi
        return total


class _Rows:
    """Single windows with their features written out, for those that are few."""

    def __init__(self, flat: np.ndarray, size: np.ndarray):
        self.flat, self.size = flat, size
        self.scale = 1 / np.sqrt(np.maximum(size, 1))
        self.start = np.cumsum(size) - size

    def __len__(self) -> int:
        return len(self.size)

    def _at(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.size[rows]
        return self.flat[np.repeat(self.start[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n

    def scores(self, rows: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
        at, n = self._at(rows)
        sums = np.concatenate([[0.0], np.cumsum(w[at])])
        ends = np.cumsum(n)
        return (sums[ends] - sums[ends - n]) * self.scale[rows] + b

    def slopes(self, rows: np.ndarray, by_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, n = self._at(rows)
        return at, np.repeat(by_row * self.scale[rows], n)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Task:
    """What a learner is sent in a round; of bounded size, whatever the corpus."""

    weights: np.ndarray
    bias: float
    prior: float
    odds: np.ndarray
    vocabulary: np.ndarray
    positive: _Rows
    reviewed: tuple[np.ndarray, np.ndarray, np.ndarray]
    reviewed_weight: np.ndarray
    seed: int
    look_for_hard: bool
    steps: int
    reviewed_share: float
    hard_weight: float


def learnt(data: Cut, task: Task, reviewed: _Rows, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias after steps (Adam) on the non-negative risk with logistic loss over all windows of `data`."""
    rng = np.random.default_rng(seed)
    w, b = task.weights.astype(np.float32), float(task.bias)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    n = len(data.start)
    weight = data.fresh().astype(float)
    if task.look_for_hard and n:
        # windows that look abusive though their features are as common in clean texts: the hard cases count more
        near = np.flatnonzero(data.scores(w, b) > -2.0)
        weight[near[data.hints(near, task.odds) <= HINT]] *= task.hard_weight
    edges = np.searchsorted(data.text, np.arange(0, data.texts + STEP_TEXTS, STEP_TEXTS))
    edges[-1] = n
    batches = [(lo, hi) for lo, hi in zip(edges, edges[1:]) if hi > lo]
    some = len(reviewed) > 0
    chance = task.reviewed_weight / task.reviewed_weight.sum() if some else None
    pi = task.prior
    for step in range(1, max(task.steps, len(batches)) + 1 if batches or some else 1):
        p = rng.integers(0, len(task.positive), 1_000)
        fp = task.positive.scores(p, w, b)
        sp = _sigmoid(fp)
        share = task.reviewed_share if some and batches else float(some)
        rest = -pi * np.logaddexp(0, fp).mean()
        if batches:
            lo, hi = batches[(step - 1) % len(batches)]
            fu = data.scores(w, b, lo, hi)
            each = weight[lo:hi] / weight[lo:hi].sum() * (1 - share)
            rest += (each * np.logaddexp(0, fu)).sum()
        if share:
            r = rng.choice(len(reviewed), 1_000, p=chance)
            fr = reviewed.scores(r, w, b)
            rest += share * np.logaddexp(0, fr).mean()
        # l(f) = log(1 + e^-f): its slope is -(1 - s), that of l(-f) is s
        sign = 1.0 if rest >= 0 else -1.0
        down = (-pi * (1 - sp) - pi * sp) / len(p) if sign > 0 else pi * sp / len(p)
        parts, gb = [task.positive.slopes(p, down)], down.sum()
        if batches:
            up = sign * each * _sigmoid(fu)
            parts.append(data.slopes(up, lo, hi))
            gb += up.sum()
        if share:
            up = sign * share * _sigmoid(fr) / len(r)
            parts.append(reviewed.slopes(r, up))
            gb += up.sum()
        g = np.bincount(np.concatenate([f for f, _ in parts]), weights=np.concatenate([x for _, x in parts]), minlength=len(w)).astype(np.float32)
        g += np.float32(1e-6) * w
        m *= np.float32(0.9)
        m += np.float32(0.1) * g
        v *= np.float32(0.999)
        g *= g
        v += np.float32(0.001) * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c, d = 1 - 0.9**step, 1 - 0.999**step
        w -= np.float32(0.05 / c) * m / (np.sqrt(v * np.float32(1 / d)) + np.float32(1e-8))
        b -= 0.05 * (mb / c) / (math.sqrt(vb / d) + 1e-8)
    return w, b


@dataclass
class Model:
    """What scoring needs; of fixed or bounded size."""

    weights: np.ndarray
    bias: float
    vocabulary: np.ndarray
    threshold: float
    prior: float
    notes: dict = field(default_factory=dict)


def _nothing_found(vocabulary: np.ndarray) -> Model:
    return Model(np.zeros(1 << FEATURE_BITS, dtype=np.float32), -20.0, vocabulary, 0.0, 0.0)


def _list_array(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))


def prepared(documents: DataFrame, shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """(doc_id, shard, words, parts): all texts as numbers, written in shards of about `shard_texts`; null and empty ones have no words."""
    shards = max(1, -(-documents.count() // shard_texts))
    taken = documents.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = _Forms()
        for batch in batches:
            for lo in range(0, batch.num_rows, 2_000):
                part = batch.slice(lo, 2_000)
                words, sizes, per_text = numbered(part.column(1).to_pylist(), forms)
                of = np.repeat(np.arange(len(per_text)), per_text)
                lists = [_list_array(words, np.bincount(of, weights=sizes, minlength=len(per_text))), _list_array(sizes, per_text)]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=["doc_id", "words", "parts"])

    cut = taken.mapInArrow(run, "doc_id bigint, words array<int>, parts array<int>")
    laid = cut.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "words", "parts")
    # texts are kept whole; their order within a shard is that of a hash, so that a step's texts are of all kinds
    return written(laid.repartition(shards, "shard").sortWithinPartitions("shard", F.xxhash64("doc_id", F.lit(5)), "doc_id"), "cut-texts")


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()).astype(np.int64)


def _cut(words: pa.ListArray, parts: pa.ListArray, vocabulary: np.ndarray | None = None) -> Cut:
    sizes, per_text = _lists(parts)
    return Cut(_lists(words)[0], sizes, per_text, vocabulary)


def _counted(run, sent_value, texts: DataFrame, most: int) -> np.ndarray:
    """Sum over all tasks of `run` of a part of the texts and what is sent, a table of `most` counters; rows of 0 aren't sent back."""
    sent = texts.sparkSession.sparkContext.broadcast(sent_value)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(most, dtype=np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1_000):
                part = batch.slice(lo, 1_000)
                total += run(part, sent.value)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    rows = texts.select("words", "parts").mapInArrow(tables, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    sent.destroy()
    out = np.zeros(most, dtype=np.int64)
    out[rows["at"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return out


def _word_texts(texts: DataFrame, words: np.ndarray) -> np.ndarray:
    """In how many texts each of `words`, sorted, stands."""

    def run(part: pa.RecordBatch, known: np.ndarray) -> np.ndarray:
        flat, per_text = _lists(part.column(0))
        place = np.searchsorted(known, flat)
        place[place == len(known)] = 0
        hit = known[place] == flat
        text = np.repeat(np.arange(len(per_text)), per_text)
        both = np.unique(text[hit] * len(known) + place[hit])
        return np.bincount(both % len(known), minlength=len(known))

    return _counted(run, words, texts, len(words))


def _feature_texts(texts: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """In how many texts each feature stands."""
    return _counted(lambda part, known: _cut(part.column(0), part.column(1), known).text_counts(), vocabulary, texts, 1 << FEATURE_BITS)


def _histogram(texts: DataFrame, vocabulary: np.ndarray, w: np.ndarray, b: float) -> tuple[np.ndarray, int]:
    """The histogram of all texts' scores and the number of all windows, equal ones of a text once."""

    def run(part: pa.RecordBatch, model: tuple) -> np.ndarray:
        known, weights, bias = model
        data = _cut(part.column(0), part.column(1), known)
        score = data.text_scores(data.scores(weights, bias))
        bins = np.clip(np.searchsorted(_EDGES, score, side="right") - 1, 0, len(_EDGES) - 2)
        return np.append(np.bincount(bins, minlength=len(_EDGES) - 1), data.fresh().sum())

    counts = _counted(run, (vocabulary, w.astype(np.float32), b), texts, len(_EDGES))
    return counts[:-1], int(counts[-1])


def _averaged(texts: DataFrame, task: Task) -> tuple[np.ndarray, float]:
    """Weights and bias averaged over a learner for each shard, by their numbers of windows."""
    sent = texts.sparkSession.sparkContext.broadcast(task)
    size = (1 << FEATURE_BITS) // _SLICES

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = sent.value
        clean = Cut(*task.reviewed)
        reviewed = _Rows(*clean.expanded(np.arange(len(clean.start))))
        total, bias, windows = np.zeros(1 << FEATURE_BITS), 0.0, 0
        held: list[pa.RecordBatch] = []
        now: int | None = None

        def finish() -> None:
            nonlocal bias, windows
            if held:
                table = pa.Table.from_batches(held).combine_chunks()
                data = _cut(table.column("words").chunk(0), table.column("parts").chunk(0), task.vocabulary)
                w, b = learnt(data, task, reviewed, task.seed + 7919 * int(now))
                n = max(len(data.start), 1)
                total[:] += n * w
                bias, windows = bias + n * b, windows + n
                held.clear()

        for batch in batches:  # a shard's texts come one after another
            shard = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1), len(shard)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if now is not None and shard[lo] != now:
                        finish()
                    now = shard[lo]
                    held.append(batch.slice(lo, hi - lo).select(["words", "parts"]))
        finish()
        if windows:
            blobs = [(total[k * size : (k + 1) * size] / windows).astype(np.float32).tobytes() for k in range(_SLICES)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(_SLICES), pa.int32()), pa.array(blobs, pa.binary()), pa.array([bias] * _SLICES), pa.array([float(windows)] * _SLICES)],
                names=["slice", "w", "b", "n"],
            )

    def add(group: pa.Table) -> pa.Table:
        w, counts = np.zeros(size), group.column("n").to_pylist()
        for x, n in zip(group.column("w").to_pylist(), counts):
            w += n * np.frombuffer(x, dtype=np.float32)
        n = sum(counts)
        return pa.table({"slice": pa.array([group.column("slice")[0].as_py()], pa.int32()), "w": pa.array([(w / n).tobytes()], pa.binary()), "b": [sum(group.column("b").to_pylist()) / n]})

    blobs = texts.select("shard", "words", "parts").mapInArrow(learn, "slice int, w binary, b double, n double")
    rows = blobs.groupBy("slice").applyInArrow(add, "slice int, w binary, b double").orderBy("slice").toPandas()  # _SLICES rows
    sent.destroy()
    return np.concatenate([np.frombuffer(x) for x in rows["w"]]), float(rows["b"][0])


def share_of_positives(histogram: np.ndarray, held: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Best bin estimate of the share of positive texts from the histogram of all texts' scores and the scores of some
    positive ones: the ratio of the two shares above the threshold where a bound of the ratio is least."""
    total, n = histogram.sum(), len(held)
    if not total or not n:
        return 0.0
    above_u = np.cumsum(histogram[::-1])[::-1] / total
    above_p = np.array([(held >= e).mean() for e in _EDGES[:-1]])
    slack = math.sqrt(math.log(4 / delta) / (2 * total)) + math.sqrt(math.log(4 / delta) / (2 * n))
    ok = above_p > 0
    bound = np.where(ok, (above_u + (1 + gamma) * slack) / np.where(ok, above_p, 1.0), np.inf)
    best = len(bound) - 1 - int(np.argmin(bound[::-1]))
    return float(above_u[best] / above_p[best])


def best_threshold(histogram: np.ndarray, held: np.ndarray, flat: float = 0.05) -> float:
    """The middle of the edges where recall^2 / share of all texts above is as high as its maximum but for `flat` and the
    error of a recall from so few texts kept back: the maximum alone stands at the score of one of them."""
    above_u = np.cumsum(histogram[::-1])[::-1] / max(histogram.sum(), 1)
    recall = np.array([(held >= e).mean() for e in _EDGES[:-1]])
    value = np.where(above_u > 0, recall**2 / np.where(above_u > 0, above_u, 1.0), 0.0)
    near = np.flatnonzero(value >= (1 - flat - 1 / math.sqrt(max(len(held), 1))) * value.max())
    return float((_EDGES[near[0]] + _EDGES[near[-1]]) / 2)


def _share(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows at most, by a hash of their key; all if there are fewer."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(1 << 20)) < int((1 << 20) * most / n))


def trained(texts: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, seed: int = 7) -> Model:
    """A model from `prepared` texts and (doc_id, abusive) labels, null ones ignored.

    Texts labelled both ways are taken as unlabelled. At most about `max_labelled` labelled texts, chosen by a hash of
    doc_id, are read to the driver; every text is learnt from as an unlabelled one. Of the confirmed texts every fifth is
    kept back; with fewer than two the model finds nothing.
    """
    spark = texts.sparkSession
    verdict = (
        labels.where(F.col("abusive").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("abusive").alias("lo"), F.max("abusive").alias("hi"))
        .where("lo = hi")
        .select("doc_id", F.col("hi").alias("abusive"))
    )
    known = texts.join(_share(verdict, "doc_id", max_labelled), "doc_id").select("doc_id", "abusive", "words", "parts").orderBy("doc_id", F.xxhash64("words")).toPandas()

    def labelled(rows: pd.DataFrame, vocabulary: np.ndarray | None = None) -> Cut:
        join = lambda c: np.concatenate([np.asarray(x, dtype=np.int64) for x in rows[c]]) if len(rows) else np.empty(0, dtype=np.int64)
        return Cut(join("words"), join("parts"), np.array([len(x) for x in rows["parts"]], dtype=np.int64), vocabulary)

    bad = known[known["abusive"] == 1]
    held_rows, fit_rows, clean_rows = bad[::KEPT_BACK], bad[np.arange(len(bad)) % KEPT_BACK != 0], known[known["abusive"] != 1]
    words = np.unique(labelled(known).words).astype(np.int64)
    words = words[words >= _FIRST_WORD]
    if not len(fit_rows) or not len(words):
        return _nothing_found(words)
    vocabulary = words[_word_texts(texts, words) >= MIN_WORD_TEXTS]
    held, fit, clean = (labelled(r, vocabulary) for r in (held_rows, fit_rows, clean_rows))
    if not len(fit.start):
        return _nothing_found(vocabulary)

    # what stands in confirmed texts and hardly in reviewed ones that are not abusive, or in others, may be abusive
    n_texts = texts.count()
    seen_p, seen_n, seen_u = fit.text_counts(), clean.text_counts(), _feature_texts(texts, vocabulary)
    expected = seen_u * len(fit_rows) / max(n_texts, 1)
    odds = np.log((seen_p + 0.3) / (seen_n + 0.3)) + np.minimum(0, np.log((seen_p + 0.5) / (expected + 0.5)))
    odds[seen_p < 2] = np.minimum(odds[seen_p < 2], 0.5)
    odds = odds.astype(np.float32)
    hint = fit.hints(np.arange(len(fit.start)), odds)
    reviewed = tuple(x.astype(np.int32) for x in (clean.words, clean.parts, clean.parts_of_text))
    clean_hint = clean.hints(np.arange(len(clean.start)), odds) if len(clean.start) else np.empty(0)

    w, b = odds.astype(float), 0.0
    histogram, n_windows = _histogram(texts, vocabulary, w, b)
    notes: dict = {"positives": 0}
    bags = np.searchsorted(fit.text, np.arange(fit.texts + 1))
    for k in range(rounds):
        score = fit.scores(w, b) if k else hint
        chosen: list[int] = []
        for lo, hi in zip(bags, bags[1:]):
            may = np.arange(lo, hi)[hint[lo:hi] > (HINT if k else 2 * HINT)]
            if len(may):
                # its worst window, and whatever else of it looks abusive
                chosen += sorted({may[np.argmax(score[may])], *(may[score[may] >= -1.0] if k else ())})
        if not chosen:
            break
        share = share_of_positives(histogram, held.text_scores(held.scores(w, b)))
        # a positive text has so many windows that are abusive, any text so many in all
        per_positive = len(chosen) / len({fit.text[r] for r in chosen})
        prior = share * per_positive * n_texts / max(n_windows, 1)
        near = clean.scores(w, b) > -2.0 if k and len(clean.start) else np.zeros(len(clean.start), dtype=bool)
        weight = np.where(near & (clean_hint <= HINT), HARD_WEIGHT, 1.0)
        start = (w, b) if k else (np.zeros_like(w), -2.0)
        task = Task(
            start[0].astype(np.float32), start[1], prior, odds, vocabulary, _Rows(*fit.expanded(np.array(chosen))), reviewed, weight, seed + k, bool(k), STEPS, REVIEWED_SHARE, HARD_WEIGHT,
        )
        w, b = _averaged(texts, task)
        histogram, n_windows = _histogram(texts, vocabulary, w, b)
        notes = {"positives": len(chosen), "prior": prior, "share_of_texts": share}
    threshold = best_threshold(histogram, held.text_scores(held.scores(w, b)))
    return Model(w.astype(np.float32), b, vocabulary, threshold, notes.get("prior", 0.0), notes)


def scored(texts: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, flagged) of every `prepared` text: the model's probability that its worst window is abusive.

    Null, empty and blank texts score (nearly) 0.
    """
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1_000):
                part = batch.slice(lo, 1_000)
                data = _cut(part.column(1), part.column(2), model.vocabulary)
                logit = data.text_scores(data.scores(model.weights, model.bias))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(_sigmoid(logit)), pa.array(logit >= model.threshold)], names=["doc_id", "score", "flagged"]
                )

    return texts.select("doc_id", "words", "parts").mapInArrow(run, "doc_id bigint, score double, flagged boolean")


def save(spark: SparkSession, model: Model, path: str) -> None:
    """Write a model as one row; it replaces what was there."""
    row = (model.weights.astype("<f4").tobytes(), model.bias, model.vocabulary.astype("<i8").tobytes(), model.threshold, model.prior)
    spark.createDataFrame([row], "weights binary, bias double, vocabulary binary, threshold double, prior double").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    """A model that `save` wrote."""
    row = spark.read.parquet(path).first()
    return Model(np.frombuffer(row.weights, "<f4"), row.bias, np.frombuffer(row.vocabulary, "<i8"), row.threshold, row.prior)


def rates(documents: DataFrame, scores: DataFrame, by: str = "source") -> DataFrame:
    """(source, n_documents, n_flagged, flagged_rate, mean_score) per source; a null source is one of its own."""
    return (
        documents.select("doc_id", by)
        .join(scores, "doc_id")
        .groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("n_documents"),
            F.count_if("flagged").alias("n_flagged"),
            F.avg(F.col("flagged").cast("double")).alias("flagged_rate"),
            F.avg("score").alias("mean_score"),
        )
    )
