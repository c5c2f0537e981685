"""Text quality by random Fourier features of document statistics, ridge regression and isotonic calibration.

1. Every text becomes a few statistics (``STATISTICS``): shares of kinds of characters and words, repetition, lengths.
2. Standardised by the labelled rows, they pass through cosines at random frequencies, whose products approximate a
   Gaussian kernel.
3. Each partition of the labelled rows sums its part of the normal equations, per fold; the sums of all folds but one
   give the weights that score this fold, all sums the final weights. No row reaches the driver, only sums of fixed size.
4. Scores of the folds, counted in ``Params.bins`` bins, are calibrated by isotonic regression (pooling of adjacent
   violators), which turns a score into the share of good texts among rows that score like it.

Defined results: null and empty texts have statistics of zero and are scored like any other; rows whose label is null or not 0
or 1, or whose id is null, teach nothing; several labels of one id count as the largest; with no label to learn from every
score is 0.5, with one class it is this class; every input row gives one output row, repeated rows too; texts of any length
are read whole; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.llm.common import list_array, map_texts, materialise, sums


@dataclass(frozen=True)
class Params:
    """``features`` random frequencies of a kernel of ``width`` (in standard deviations, times the root of the number of
    statistics); ``ridge`` per labelled row; ``clip`` bounds a standardised statistic."""

    features: int = 256
    width: float = 0.7
    ridge: float = 1e-3
    clip: float = 4.0
    folds: int = 4
    bins: int = 2048
    seed: int = 29


#: Statistics of a text, in the order of the vector. Shares are of characters (bytes of UTF-8) or of words.
STATISTICS = (
    "log_bytes", "log_words", "upper", "digits", "symbols", "stops", "calls", "other_marks", "breaks", "above_ascii", "controls",
    "word_bytes", "short_words", "long_words", "marked_words", "capital_words", "shouted_words", "wordless", "repeats_last",
    "distinct_words", "top_word", "log_lines", "line_words", "repeated_lines", "closed_lines",
)
UPPER, DIGIT, SYMBOL, STOP, CALL, MARK, BREAK, HIGH, CONTROL, LOWER, SPACE = range(11)


def classes() -> np.ndarray:
    """The class of every byte."""
    of = np.full(256, MARK, np.uint8)
    for members, kind in (
        (range(65, 91), UPPER), (range(97, 123), LOWER), (range(48, 58), DIGIT), (b"#*$%&|<>", SYMBOL), (b".,;:", STOP), (b"!?", CALL),
        (range(32), CONTROL), (b"\x7f", CONTROL), (b"\n\r\v\f", BREAK), (b" \t", SPACE), (range(128, 256), HIGH),
    ):
        of[list(members)] = kind
    return of


def runs(of: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``of`` that stay within one owner."""
    before = np.concatenate([[False], of[:-1] & (owner[1:] == owner[:-1])]) if len(of) else of
    after = np.concatenate([of[1:] & (owner[1:] == owner[:-1]), [False]]) if len(of) else of
    return np.flatnonzero(of & ~before), np.flatnonzero(of & ~after) + 1


def strings_of(data: np.ndarray, inside: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The bytes ``inside`` as an array of binary values of these sizes."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def repetition(owner: np.ndarray, strings: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different strings each owner has, and how often its most frequent one occurs."""
    codes = strings.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs, times = np.unique(owner.astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes, return_counts=True)
    of = pairs // (int(codes.max(initial=0)) + 1)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, of, times)
    return np.bincount(of, minlength=n), most


def statistics(texts: pa.Array, kind: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` per text."""
    n = len(texts)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    first = int(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset]) if n else 0
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[first : first + int(sizes.sum())] if sizes.sum() else np.empty(0, np.uint8)
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    of = kind[data]
    count = np.bincount(owner.astype(np.int64) * 11 + of, minlength=11 * n).reshape(n, 11).astype(float)
    letters = count[:, UPPER] + count[:, LOWER] + count[:, HIGH]

    in_word = (of != SPACE) & (of != BREAK)
    w_start, w_end = runs(in_word, owner)
    w_owner, w_size = owner[w_start], w_end - w_start
    words = np.bincount(w_owner, minlength=n).astype(float)
    per = lambda flag: np.bincount(w_owner, flag.astype(float), minlength=n)
    within = lambda *kinds: sums(np.isin(of, kinds).astype(np.int64)[in_word], w_size)
    upper, lettered = within(UPPER), within(UPPER, LOWER, HIGH)
    strings = strings_of(data, in_word, w_size)
    distinct, most = repetition(w_owner, strings, n)
    codes = strings.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    again = np.concatenate([[False], (codes[1:] == codes[:-1]) & (w_owner[1:] == w_owner[:-1])]) if len(codes) else np.empty(0, bool)

    l_start, l_end = runs(of != BREAK, owner)
    l_owner = owner[l_start]
    lines = np.bincount(l_owner, minlength=n).astype(float)
    different, _ = repetition(l_owner, strings_of(data, of != BREAK, l_end - l_start), n)
    closed = np.bincount(l_owner, np.isin(data[l_end - 1], list(b".!?\"')")).astype(float), minlength=n) if len(l_end) else np.zeros(n)

    size = sizes.astype(float)
    return np.column_stack(
        [
            np.log1p(size), np.log1p(words), ratio(count[:, UPPER], letters), *[ratio(count[:, k], size) for k in (DIGIT, SYMBOL, STOP, CALL, MARK, BREAK, HIGH, CONTROL)],
            ratio(per(w_size), words), ratio(per(w_size <= 3), words), ratio(per(w_size > 14), words), ratio(per(within(SYMBOL, CALL, MARK) > 0), words),
            ratio(per((upper > 0) & (of[w_start] == UPPER)), words), ratio(per((upper > 1) & (2 * upper > lettered)), words), ratio(per(lettered == 0), words),
            ratio(per(again), words), ratio(distinct, words), ratio(most, words), np.log1p(lines), np.log1p(ratio(words, lines)), ratio(lines - different, lines),
            ratio(closed, lines),
        ]
    )


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``stats`` of every row."""

    def make():
        kind = classes()

        def run(texts: pa.Array) -> list[pa.Array]:
            x = statistics(texts, kind)
            return [list_array(x.astype(np.float32).ravel(), np.full(len(texts), len(STATISTICS)))]

        return run

    return map_texts(docs, text, keep, [T.StructField("stats", T.ArrayType(T.FloatType(), False), False)], make)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of ``stats`` as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)).astype(float)


@dataclass
class Features:
    """Standardises statistics and maps them to cosines at random frequencies; the last feature is 1."""

    mean: np.ndarray
    scale: np.ndarray
    params: Params

    def __post_init__(self):
        rng = np.random.default_rng(self.params.seed)
        d = len(self.mean)
        self.frequency = rng.standard_normal((d, self.params.features)) / (self.params.width * np.sqrt(d))
        self.phase = rng.uniform(0, 2 * np.pi, self.params.features)

    def of(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -self.params.clip, self.params.clip)
        return np.hstack([np.sqrt(2 / self.params.features) * np.cos(z @ self.frequency + self.phase), np.ones((len(x), 1))])


def summed(rows: DataFrame, part: callable, size: int) -> dict[int, np.ndarray]:
    """Sums over partitions: ``part`` maps a batch to {key: vector of ``size``}; a task emits one vector per key, and the
    vectors of a key are added up by another stage. Keys and size are fixed, so what returns is too."""
    schema = "k int, v binary"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in part(batch).items():
                total[k] = total[k] + v if k in total else v
        yield pack(total)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column("k").to_pylist(), batch.column("v"), strict=True):
                own = np.frombuffer(v.as_buffer(), float)
                total[k] = total[k] + own if k in total else own
        yield pack(total)

    def pack(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["k", "v"])

    found = rows.mapInArrow(first, schema).repartition("k").mapInArrow(again, schema)
    return {r["k"]: np.frombuffer(r["v"], float, size) for r in found.collect()}


def normal_equations(rows: DataFrame, features: Features, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """Per fold the products of the features with each other and with the label."""
    width = features.params.features + 1

    def part(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        z, y = features.of(matrix(batch.column("stats"))), batch.column("label").to_numpy(zero_copy_only=False).astype(float)
        fold, out = batch.column("fold").to_numpy(zero_copy_only=False), {}
        for f in np.unique(fold).tolist():
            own = z[fold == f]
            both = np.hstack([own.T @ own, (own.T @ y[fold == f])[:, None]])
            out |= {f * width + i: row for i, row in enumerate(both)}
        return out

    found = summed(rows.select("stats", "label", "fold"), part, width + 1)
    every = np.zeros((folds, width, width + 1))
    for k, row in found.items():
        every[k // width, k % width] = row
    return every[:, :, :-1], every[:, :, -1]


def solve(products: np.ndarray, targets: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge weights; the constant is not penalised."""
    n = max(products[-1, -1], 1.0)
    penalty = np.full(len(products), ridge * n)
    penalty[-1] = 1e-9 * n
    return np.linalg.solve(products + np.diag(penalty), targets)


def pooled(at: np.ndarray, good: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of shares ``good / count`` at rising places: (places, values), values never falling.

    Each pool of adjacent violators gives two places, its first and its last, so values are level inside a pool and rise
    between pools."""
    pools: list[list[float]] = []
    for x, g, c in zip(at.tolist(), good.tolist(), count.tolist(), strict=True):
        pools.append([x, x, g, c])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            low, high = pools[-2], pools.pop()
            pools[-1] = [low[0], high[1], low[2] + high[2], low[3] + high[3]]
    places = np.array([x for p in pools for x in p[:2]])
    return places, np.repeat([p[2] / p[3] for p in pools], 2)


@dataclass
class Model:
    features: Features
    weights: np.ndarray
    places: np.ndarray
    values: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores between 0 and 1."""
        raw = np.clip(self.features.of(x) @ self.weights, *RANGE)
        return np.clip(np.interp(raw, self.places, self.values), 0.0, 1.0)


#: Where ridge scores are binned; scores outside fall in the outer bins.
RANGE = (-0.5, 1.5)


def fit(labelled: DataFrame, params: Params = Params()) -> Model | None:
    """The model of labelled rows (``stats``, ``label`` 0 or 1, ``fold`` below ``params.folds``), None without any."""
    d = len(STATISTICS)

    def moments(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        x = matrix(batch.column("stats"))
        return {0: np.concatenate([[len(x)], x.sum(axis=0), (x**2).sum(axis=0)])}

    first = summed(labelled.select("stats"), moments, 2 * d + 1)
    n = first[0][0] if first else 0
    if not n:
        return None
    mean = first[0][1 : d + 1] / n
    spread = np.sqrt(np.maximum(first[0][d + 1 :] / n - mean**2, 0))
    features = Features(mean, np.where(spread > 1e-6, spread, 1.0), params)
    products, targets = normal_equations(labelled, features, params.folds)
    whole = solve(products.sum(axis=0), targets.sum(axis=0), params.ridge)
    weights = np.array([solve(products.sum(axis=0) - p, targets.sum(axis=0) - t, params.ridge) if p[-1, -1] < n else whole for p, t in zip(products, targets, strict=True)])
    low, high = RANGE

    def histogram(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        z, fold = features.of(matrix(batch.column("stats"))), batch.column("fold").to_numpy(zero_copy_only=False)
        raw = np.clip((z * weights[fold]).sum(axis=1), low, high)
        at = np.minimum(((raw - low) / (high - low) * params.bins).astype(int), params.bins - 1)
        y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
        return {0: np.concatenate([np.bincount(at, y, params.bins), np.bincount(at, minlength=params.bins).astype(float)])}

    good, count = np.split(summed(labelled.select("stats", "label", "fold"), histogram, 2 * params.bins)[0], 2)
    some = np.flatnonzero(count)
    places, values = pooled(low + (some + 0.5) / params.bins * (high - low), good[some], count[some])
    return Model(features, whole, places, values)


def apply(measured: DataFrame, model: Model | None, keep: list[str], name: str = "score") -> DataFrame:
    """``keep`` columns and the score of every measured row."""
    if model is None:
        return measured.select(*keep, F.lit(0.5).alias(name))
    schema = T.StructType([*[measured.schema[c] for c in keep], T.StructField(name, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(model.score(matrix(batch.column("stats"))))], names=schema.names)

    return measured.select(*keep, "stats").mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, held_out: Column, params: Params = Params(), threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; labels are learnt from rows not ``held_out``."""
    marked = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    measured = materialise(measure(marked, ["doc_id", "held_out"]), "quality-stats")
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    # narrow rows: a vector of statistics each
    labelled = measured.where("not held_out").join(known, "doc_id").select("stats", "label", F.pmod(F.xxhash64("doc_id"), F.lit(params.folds)).cast("int").alias("fold"))
    model = fit(materialise(labelled, "quality-labelled"), params)
    scored = apply(measured, model, ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
