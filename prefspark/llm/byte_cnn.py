"""Language identification by a small convolutional network over bytes.

Byte embeddings, filters of several widths, max pooling over a window, and a softmax layer; trained in numpy with Adam on
a bounded sample of labelled windows, applied to all windows of every text. Windows have a fixed length and overlap by
the widest filter less one byte, so every position of a text is seen once; a text's class is that of the mean of its
windows' log-odds, weighted by their bytes.

The network is fitted on the driver from at most about ``Net.per_class`` distinct texts of each language and ``Net.crops``
pieces of each text; all else covers all rows. Only the text enters a prediction.

The softmax only compares the languages it knows. Whether a text is in its best one at all is told by its letter trigrams:
how much likelier the language makes them than its single letters do, against what labelled texts reach that were left out.

Defined results: null texts and texts without letters are ``und`` with score 0, as is everything if nothing could be
learnt; every input row gives one output row; texts of any length are read whole; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.llm.common import map_texts

PAD = 256
UNKNOWN = "und"
LETTER = r"\p{L}"
MOST_LANGUAGES = 512
NO_LETTERS = re.compile(r"[\W\d_]+")
#: Share of a trigram's chance that its last byte alone gives, and so the gain of a trigram that was never seen.
SMOOTH = 0.1
UNSEEN = float(np.log(SMOOTH))


@dataclass(frozen=True)
class Net:
    """Shape and training of the network; ``per_class`` and ``crops`` bound its sample."""

    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4, 5)
    filters: int = 16
    embedding: int = 8
    per_class: int = 1_000
    crops: int = 4
    steps: int = 600
    batch: int = 64
    rate: float = 4e-3
    seed: int = 7


@dataclass
class Weights:
    """A trained network: its classes and its parameters by name."""

    net: Net
    classes: list[str]
    p: dict[str, np.ndarray] = field(default_factory=dict)
    usage: list[Usage] = field(default_factory=list)


@dataclass
class Usage:
    """Letter trigrams of a class and the gain of each; mean and spread of the gain in texts of the class (nothing is
    known of them if NaN)."""

    keys: np.ndarray
    gains: np.ndarray
    mean: float = np.nan
    spread: float = np.nan

    def of(self, seen: np.ndarray) -> np.ndarray:
        """The gain of each of these trigrams."""
        at = np.minimum(np.searchsorted(self.keys, seen), len(self.keys) - 1)
        return np.where(self.keys[at] == seen, self.gains[at], UNSEEN)

    def fits(self, text: str) -> bool:
        """Whether a text can be of this class: at least half the usual gain, four standard errors allowed for its length."""
        if not self.mean > 0:
            return True
        seen = trigrams(text)
        return bool(self.of(seen).mean() >= self.mean / 2 - 4 * self.spread / np.sqrt(len(seen)))


def trigrams(text: str) -> np.ndarray:
    """Byte trigrams of the letters of a text; all between letters counts as one space."""
    b = np.frombuffer(b" %b " % NO_LETTERS.sub(" ", text.lower()).strip().encode(), np.uint8).astype(np.uint32)
    return b[:-2] << 16 | b[1:-1] << 8 | b[2:]


def learn_usage(pieces: list[np.ndarray]) -> Usage:
    """Gains of the trigrams in these pieces: log of their chance behind their first two bytes over that of the last byte."""
    keys, counts = np.unique(np.concatenate(pieces), return_counts=True)
    _, at = np.unique(keys >> 8, return_inverse=True)
    alone = np.bincount(keys & 255, counts, 256) / counts.sum()
    gains = np.log((1 - SMOOTH) * counts / np.bincount(at, counts)[at] / alone[keys & 255] + SMOOTH)
    return Usage(keys, gains.astype(np.float32))


def calibrated_usage(halves: tuple[list[np.ndarray], list[np.ndarray]]) -> Usage:
    """Usage of all pieces, its mean and spread measured on each half by the trigrams of the other."""
    usage = learn_usage(halves[0] + halves[1])
    if all(halves):
        gains = np.concatenate([learn_usage(a).of(np.concatenate(b)) for a, b in (halves, halves[::-1])])
        usage.mean, usage.spread = float(gains.mean()), float(gains.std())
    return usage


def patches(p: dict[str, np.ndarray], windows: np.ndarray, width: int) -> np.ndarray:
    """For each position of each window, the embedded bytes under the widest filter, in a row."""
    seen = sliding_window_view(p["bytes"][windows], width, axis=1)  # windows, positions, embedding, width
    return np.ascontiguousarray(seen).reshape(len(windows), seen.shape[1], -1)


def width_mask(net: Net) -> np.ndarray:
    """1 where a filter of its width has a weight; all filters share one matrix as tall as the widest."""
    widest = max(net.widths)
    one = [np.repeat([np.arange(widest) < w], net.embedding, axis=0).reshape(-1) for w in net.widths]
    return np.repeat(np.array(one, np.float32), net.filters, axis=0).T


def pooled(p: dict[str, np.ndarray], seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of every filter in every window, and where it was."""
    response = seen @ p["filters"]
    at = response.argmax(axis=1)
    return np.take_along_axis(response, at[:, None], axis=1)[:, 0] + p["bias"], at


def train(texts: list[bytes], labels: np.ndarray, classes: list[str], net: Net) -> Weights:
    """Fit the network to text pieces; deterministic for the same pieces in the same order."""
    rng = np.random.default_rng(net.seed)
    widest, n_filters = max(net.widths), len(net.widths) * net.filters
    mask = width_mask(net)
    p = {
        "bytes": rng.normal(0, 0.5, (PAD + 1, net.embedding)).astype(np.float32),
        "filters": rng.normal(0, 0.3, (widest * net.embedding, n_filters)).astype(np.float32) * mask,
        "bias": np.zeros(n_filters, np.float32),
        "out": rng.normal(0, 0.1, (n_filters, len(classes))).astype(np.float32),
        "prior": np.zeros(len(classes), np.float32),
    }
    p["bytes"][PAD] = 0
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, net.steps + 1):
        pick = rng.integers(0, len(texts), net.batch)
        windows = np.full((net.batch, net.window), PAD, np.int64)
        for row, i in enumerate(pick):
            size = min(len(texts[i]), int(rng.integers(12, net.window + 1)))
            start = int(rng.integers(0, len(texts[i]) - size + 1))
            windows[row, :size] = np.frombuffer(texts[i], np.uint8, size, start)
        seen = patches(p, windows, widest)
        top, at = pooled(p, seen)
        hidden = np.maximum(top, 0)
        logits = hidden @ p["out"] + p["prior"]
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        error = odds / odds.sum(axis=1, keepdims=True)
        error[np.arange(net.batch), labels[pick]] -= 1
        error /= net.batch
        back = (error @ p["out"].T) * (top > 0)
        under = np.take_along_axis(seen, at[:, :, None], axis=1)  # windows, filters, patch
        grad = {
            "out": hidden.T @ error,
            "prior": error.sum(axis=0),
            "bias": back.sum(axis=0),
            "filters": np.einsum("wf,wfk->kf", back, under) * mask,
            "bytes": np.zeros_like(p["bytes"]),
        }
        into = (back[:, :, None] * p["filters"].T[None]).reshape(net.batch, n_filters, net.embedding, widest)
        for k in range(widest):
            np.add.at(grad["bytes"], np.take_along_axis(windows, at + k, axis=1), into[..., k])
        grad["bytes"][PAD] = 0
        rate = net.rate * min(1.0, 2 * (1 - step / (net.steps + 1)))
        for k in p:
            first[k] = 0.9 * first[k] + 0.1 * grad[k]
            second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
            p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Weights(net, classes, {k: v.astype(np.float32) for k, v in p.items()})


class Classifier:
    """Applies a network to whole texts, window by window in batches of fixed size."""

    def __init__(self, weights: Weights):
        self.w, self.net = weights, weights.net
        self.widest = max(self.net.widths)
        self.step = self.net.window - self.widest + 1

    def windows(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """All windows of a text, the last padded, and the bytes that are new in each."""
        n = max(1, -(-(len(data) - self.widest + 1) // self.step))
        filled = np.full((n - 1) * self.step + self.net.window, PAD, np.int16)
        filled[: len(data)] = np.frombuffer(data, np.uint8)
        sizes = np.full(n, self.step, np.float32)
        sizes[-1] = len(data) - (n - 1) * self.step
        return sliding_window_view(filled, self.net.window)[:: self.step], sizes

    def log_odds(self, windows: np.ndarray) -> np.ndarray:
        """The class log-odds of each window."""
        out, p = np.empty((len(windows), len(self.w.classes)), np.float32), self.w.p
        for i in range(0, len(windows), self.net.batch):
            seen = patches(p, windows[i : i + self.net.batch], self.widest)
            top = (seen @ p["filters"]).max(axis=1) + p["bias"]
            out[i : i + self.net.batch] = np.maximum(top, 0) @ p["out"] + p["prior"]
        return out

    def predict(self, texts: pa.Array) -> list[pa.Array]:
        """Class and probability of every text."""
        known = pc.match_substring_regex(texts, LETTER).to_numpy(zero_copy_only=False)
        names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        rows = np.flatnonzero(known)
        if len(rows) and self.w.classes:
            cut = [self.windows(texts[i].as_py().lower().encode()) for i in rows.tolist()]
            counts = np.array([len(s) for _, s in cut])
            odds = self.log_odds(np.concatenate([w for w, _ in cut]))
            sizes = np.concatenate([s for _, s in cut])
            starts = np.cumsum(counts) - counts
            mean = np.add.reduceat(odds * sizes[:, None], starts) / np.add.reduceat(sizes, starts)[:, None]
            chance = np.exp(mean - mean.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            names[rows] = np.array(self.w.classes, object)[chance.argmax(axis=1)]
            scores[rows] = chance.max(axis=1)
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    def judge(self, texts: pa.Array) -> list[pa.Array]:
        """Class and probability of every text, and whether it can be of that class."""
        names, scores = self.predict(texts)
        at = {c: u for c, u in zip(self.w.classes, self.w.usage, strict=True)}
        fits = [c in at and at[c].fits(t) for c, t in zip(names.to_pylist(), texts.to_pylist(), strict=True)]
        return [names, scores, pa.array(fits, pa.bool_())]


def fit(docs: DataFrame, usable: Column, net: Net = Net(), text: str = "text", label: str = "lang") -> Weights:
    """Train on a bounded sample of the rows of ``docs`` that are ``usable`` and have a label and letters."""
    rows = docs.where(usable & F.col(label).isNotNull() & F.col(text).rlike(LETTER)).select(
        F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("t")
    )
    rows = rows.withColumn("h", F.xxhash64("t"))
    totals = rows.select("label", "h").distinct().groupBy("label").count().limit(MOST_LANGUAGES + 1).collect()
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} different labels")
    if not totals:
        return Weights(net, [])
    parts = 1 << 20
    share = F.create_map(*[F.lit(x) for r in totals for x in (r["label"], min(parts, parts * net.per_class // r["count"] + 1))])
    drawn = rows.where(F.pmod("h", F.lit(parts)) < F.element_at(share, F.col("label")))
    room = F.greatest(F.length("t") - net.window + 1, F.lit(1))
    pieces = [F.substring("t", F.pmod(F.xxhash64("t", F.lit(k)), room).cast("int") + 1, F.lit(net.window)) for k in range(net.crops)]
    # one row of each drawn text, as its pieces are the same in all copies
    once = drawn.select("label", "h", F.array_distinct(F.array(*pieces)).alias("pieces")).dropDuplicates(["label", "h"])
    found = sorted(map(tuple, once.select("label", F.explode("pieces"), F.pmod(F.xxhash64("h"), F.lit(2))).collect()))
    if missing := {r["label"] for r in totals} - {name for name, *_ in found}:
        raise ValueError(f"no text drawn for {sorted(missing)}")
    sample = [(name, piece.lower().encode()) for name, piece, _ in found]
    classes = sorted({name for name, _ in sample})
    at = {c: i for i, c in enumerate(classes)}
    by_class = [[piece for name, piece in sample if name == c] for c in classes]
    # as many draws of every class: languages with fewer pieces repeat theirs
    most = max(map(len, by_class))
    texts = [one[i % len(one)] for one in by_class for i in range(most)]
    weights = train(texts, np.repeat([at[c] for c in classes], most), classes, net)
    halves = {c: ([], []) for c in classes}
    for name, piece, half in found:
        halves[name][half].append(trigrams(piece))
    weights.usage = [calibrated_usage(halves[c]) for c in classes]
    return weights


def identify(
    docs: DataFrame, weights: Weights, text: str = "text", keep: list[str] = ("doc_id",), names: tuple[str, ...] = ("lang_pred", "score")
) -> DataFrame:
    """``keep`` columns with the predicted language and its probability, under ``names``; a third name adds whether the
    text can be of that language at all."""
    fields = [T.StructField(n, t, False) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=False)]
    if len(names) == 2:
        return map_texts(docs, text, list(keep), fields, lambda: Classifier(weights).predict)
    return map_texts(docs, text, list(keep), fields, lambda: Classifier(weights).judge)


def remainder(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as empty."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % parts
