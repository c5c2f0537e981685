"""Toxicity by weak supervision.

1. Lexicon and patterns: words and word beginnings of texts labelled toxic, kept where they are much more frequent there
   than in texts labelled harmless. They are mined from a bounded sample of labelled rows.
2. Voters: parts of the lexicon, beginnings by length, how many and how dense such words are, a seed lexicon, shouting.
   Each votes for every text.
3. Label model: how often each combination of votes occurs in all rows to learn from, labelled or not, determines by
   expectation maximisation the accuracy of each voter. Correlations within the classes, which the accuracies leave
   unexplained, weaken the votes of the voters that share them, and the model is fitted again.
4. A linear classifier (logistic, on the density of the mined words and beginnings) is trained on the posterior labels and
   scores every text.

Defined results: null and empty texts have no words and get the score of a text without findings; rows with a null label
teach nothing; with nothing to learn from every score is 0; every input row gives one output row; texts of any length are
read whole; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.llm.common import DistinctTable, Ragged, list_array, map_texts, materialise, slices, split_words, sums


@dataclass(frozen=True)
class Params:
    """``per_class`` bounds the labelled rows that words are mined from, ``fit_rows`` the rows with findings that the
    classifier is trained on (rows without any are one weighted row), ``features`` the words and beginnings kept.
    ``least_evidence``: the likelihood ratio statistic, high enough that none of millions of harmless words reaches it."""

    per_class: int = 20_000
    fit_rows: int = 50_000
    features: int = 2_000
    least_share: float = 0.005
    least_docs: int = 4
    least_odds: float = 2.0
    least_evidence: float = 24.0
    beginnings: tuple[int, ...] = (4, 5, 6, 7)
    lexicon_parts: int = 3
    seeds: tuple[str, ...] = ("idiot", "moron", "stupid", "loser", "scum", "trash")
    rounds: int = 200
    ridge: float = 1e-3


def plain(word: str) -> str:
    """A word in lower case without what is no letter or digit at its ends."""
    word = word.lower()
    if word.isalnum():
        return word
    start, stop = 0, len(word)
    while start < stop and not word[start].isalnum():
        start += 1
    while stop > start and not word[stop - 1].isalnum():
        stop -= 1
    return word[start:stop]


def findings(word: str, beginnings: tuple[int, ...]) -> list[str]:
    """The word itself and its beginnings; a beginning carries its length in front."""
    word = plain(word)
    return ([word] if len(word) >= min(beginnings) else []) + [f"{k}:{word[:k]}" for k in beginnings if len(word) > k]


def mine(rows: DataFrame, params: Params, known: list[str] | None = None) -> DataFrame:
    """(finding, docs): how many texts of ``rows`` (t) have each finding, of the ``known`` ones if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, found = (None if known is None else set(known)), Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["finding", "docs"])

        for batch in batches:
            for _, texts in slices(batch, "t"):
                for text in texts.to_pylist():
                    own = {x for word in set(text.split()) for x in findings(word, params.beginnings)}
                    found.update(own if wanted is None else own & wanted)
                    if len(found) > 200_000:
                        yield out()
                        found.clear()
        yield out()

    return rows.select("t").mapInArrow(run, "finding string, docs long").groupBy("finding").agg(F.sum("docs").alias("docs"))


def evidence(a: int, b: int, n1: int, n0: int) -> float:
    """Likelihood ratio statistic of a finding in ``a`` of ``n1`` toxic and ``b`` of ``n0`` harmless texts."""
    part = lambda x, n: x * np.log(x / (n * (a + b) / (n1 + n0))) if x else 0.0
    rest = lambda x, n: (n - x) * np.log((n - x) / (n * (1 - (a + b) / (n1 + n0)))) if n > x else 0.0
    return float(2 * (part(a, n1) + part(b, n0) + rest(a, n1) + rest(b, n0)))


def vocabulary(docs: DataFrame, labels: DataFrame, usable: Column, params: Params) -> list[str]:
    """Findings that tell texts labelled toxic from others; at most ``params.features``, best first."""
    learn = labels.where(usable & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in learn.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return []
    parts = 1 << 20
    share = F.when(F.col("toxic") == 1, min(parts, parts * params.per_class // totals[1] + 1)).otherwise(min(parts, parts * params.per_class // totals[0] + 1))
    drawn = learn.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < share).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # about 2 * per_class narrow rows at most, so the texts stay where they are
    rows = docs.select("doc_id", F.col("text").cast("string").alias("t")).join(F.broadcast(drawn), "doc_id")
    sizes = {r["toxic"]: r["count"] for r in drawn.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    least = max(params.least_docs, int(params.least_share * n1))
    # a text has a bounded number of findings on average, so few can reach a fixed share of the texts
    toxic = {r.finding: r.docs for r in mine(rows.where("toxic = 1"), params).where(F.col("docs") >= least).toLocalIterator()}
    if not toxic or not n0:
        return []
    harmless = {r.finding: r.docs for r in mine(rows.where("toxic = 0"), params, list(toxic)).toLocalIterator()}
    odds = lambda x: np.log((toxic[x] + 0.5) / (n1 + 1)) - np.log((harmless.get(x, 0) + 0.5) / (n0 + 1))
    strong = sorted(
        ((float(odds(x)), toxic[x], x) for x in toxic if odds(x) >= params.least_odds and evidence(toxic[x], harmless.get(x, 0), n1, n0) >= params.least_evidence),
        reverse=True,
    )
    return [x for _, _, x in strong[: params.features]]


def voters(params: Params) -> list[str]:
    """Names of the voters, in the order of their bits."""
    return [*[f"lexicon {k}" for k in range(params.lexicon_parts)], *[f"beginning {k}" for k in params.beginnings], "two", "dense", "seeds", "shouting"]


def observe(docs: DataFrame, vocab: list[str], params: Params, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``votes`` (a bit per voter) and the findings (``ids``, ``density``) of every row."""
    fields = [
        T.StructField("votes", T.IntegerType(), False),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False), False),
        T.StructField("density", T.ArrayType(T.DoubleType(), False), False),
    ]

    def make():
        import zlib

        at = {x: i for i, x in enumerate(vocab)}
        bit = np.array(
            [params.lexicon_parts + params.beginnings.index(int(x[0])) if x[1:2] == ":" else zlib.crc32(x.encode()) % params.lexicon_parts for x in vocab] or [0],
            np.int64,
        )
        ids, seeds = Ragged(np.int32), set(params.seeds)
        shapes: list[np.ndarray] = [np.empty((0, 2), bool)]
        n_bits = len(voters(params))

        def add(new: list[str]) -> None:
            ids.extend([[at[x] for x in findings(w, params.beginnings) if x in at] for w in new])
            shapes.append(np.array([(plain(w) in seeds, len(w) > 2 and w.isupper()) for w in new], bool).reshape(-1, 2))

        def reset() -> None:
            ids.clear()
            shapes[:] = [np.empty((0, 2), bool)]

        table = DistinctTable(add, reset)

        def run(texts: pa.Array) -> list[pa.Array]:
            words, counts = split_words(texts)
            rows = table.rows(words)
            shapes[:] = [np.concatenate(shapes)]
            values, sizes = ids.gather(rows)
            text_of = np.repeat(np.arange(len(texts)), counts)
            pairs, times = np.unique(np.repeat(text_of, sizes) * max(1, len(vocab)) + values, return_counts=True)
            text, found = pairs // max(1, len(vocab)), pairs % max(1, len(vocab))
            votes = np.zeros(len(texts), np.int64)
            np.bitwise_or.at(votes, text, 1 << bit[found])
            seeded, loud = (sums(shapes[0][rows, k].astype(np.int64), counts) for k in range(2))
            hits = sums((sizes > 0).astype(np.int64), counts)
            for k, vote in enumerate((hits >= 2, 100 * hits >= np.maximum(counts, 1), seeded > 0, (loud > 2) & (4 * loud > counts))):
                votes |= vote.astype(np.int64) << (n_bits - 4 + k)
            per_text = np.bincount(text, minlength=len(texts))
            return [pa.array(votes.astype(np.int32)), list_array(found.astype(np.int32), per_text), list_array(np.log1p(100 * times / (counts[text] + 20)), per_text)]

        return run

    return map_texts(docs, "text", keep, fields, make)


@dataclass
class LabelModel:
    """``prior`` of toxic; per voter the chance to vote given harmless and toxic (``rate``), and its ``weight``."""

    prior: float
    rate: np.ndarray
    weight: np.ndarray
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic) of rows of votes (0 or 1 per voter)."""
        tell = np.log(self.rate[1] / self.rate[0]) * votes + np.log((1 - self.rate[1]) / (1 - self.rate[0])) * (1 - votes)
        odds = np.log(self.prior / (1 - self.prior)) + (tell * self.weight).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def fit_label_model(votes: np.ndarray, counts: np.ndarray, labelled: np.ndarray, rounds: int) -> LabelModel:
    """Fit to vote combinations (rows of ``votes``): how many rows without a label have each, and how many with each label
    (columns of ``labelled``). Labels hold the classes in place; rows without them add what is common in the corpus."""
    n, voted = counts.sum() + labelled.sum(), votes.shape[1]
    start = np.array([(votes * (labelled[:, y : y + 1] + 1e-9)).sum(axis=0) / (labelled[:, y].sum() + 1e-9) for y in (0, 1)])
    prior = float(np.clip(labelled[:, 1].sum() / max(1.0, labelled.sum()), 1e-3, 0.5))
    model = LabelModel(prior, np.clip(start, 1e-4, 1 - 1e-4), np.ones(voted), np.eye(voted))
    for step in range(2):
        for _ in range(rounds):
            toxic = model.posterior(votes)
            by_class = [(1 - toxic) * counts + labelled[:, 0], toxic * counts + labelled[:, 1]]
            for y, weight in enumerate(by_class):
                model.rate[y] = np.clip(((votes * weight[:, None]).sum(axis=0) + 0.1) / (weight.sum() + 1), 1e-4, 1 - 1e-4)
            model.prior = float(np.clip(by_class[1].sum() / n, 1e-4, 0.5))
        if step == 0:
            # what voters agree on within the classes, as a correlation: one finding may move several voters
            found = np.zeros((voted, voted))
            for y, weight in enumerate(by_class):
                spread = np.sqrt(model.rate[y] * (1 - model.rate[y]))
                together = (votes * weight[:, None]).T @ votes / weight.sum()
                found += (together - np.outer(model.rate[y], model.rate[y])) / np.outer(spread, spread) / 2
            model.correlation = np.clip(found, -1, 1)
            np.fill_diagonal(model.correlation, 1)
            model.weight = 1 / np.maximum(model.correlation, 0).sum(axis=1)
    return model


def fit_linear(rows: list[tuple[list[int], list[float], float, float]], size: int, ridge: float, steps: int = 400) -> np.ndarray:
    """Logistic weights (the last is the constant) for rows of (ids, density, P(toxic), row weight)."""
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    col = np.array([i for r in rows for i in r[0]], np.int64)
    x = np.array([d for r in rows for d in r[1]], float)
    y, weight = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    weight = weight / weight.sum()
    w, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    prior = float(np.clip((y * weight).sum(), 1e-6, 1 - 1e-6))
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        z = np.bincount(row, w[col] * x, minlength=len(rows)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * weight
        grad = np.append(np.bincount(col, error[row] * x, minlength=size) + ridge * w[:-1] / size, error.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return w


def score(seen: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` columns with the ``score`` of every observed row."""
    schema = T.StructType([*[seen.schema[c] for c in keep], T.StructField("score", T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, density = batch.column("ids"), batch.column("density")
            sizes = np.diff(ids.offsets.to_numpy())
            z = sums(weights[ids.flatten().to_numpy()] * density.flatten().to_numpy(), sizes) + weights[-1]
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(p)], names=schema.names)

    return seen.select(*keep, "ids", "density").mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, params: Params = Params(), threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; labels and votes are learnt from rows not ``held_out``."""
    vocab = vocabulary(docs, labels, ~held_out, params)
    marked = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    seen = materialise(observe(marked, vocab, params, ["doc_id", "held_out"]), "toxicity-votes")
    learn = seen.where("not held_out")
    patterns = learn.groupBy("votes").count().collect()  # at most one row per combination of a dozen voters
    if not vocab or not patterns:
        scored = seen.select("doc_id", "held_out", F.lit(0.0).alias("score"))
    else:
        bits = np.arange(len(voters(params)))
        votes = np.array([[r["votes"] >> b & 1 for b in bits] for r in patterns], float)
        counts = np.array([r["count"] for r in patterns], float)
        at = {r["votes"]: i for i, r in enumerate(patterns)}
        known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        labelled = np.zeros((len(patterns), 2))
        for r in learn.join(known, "doc_id").groupBy("votes", "toxic").count().collect():
            labelled[at[r["votes"]], r["toxic"]] = r["count"]
        model = fit_label_model(votes, counts - labelled.sum(axis=1), labelled, params.rounds)
        chance = dict(zip((r["votes"] for r in patterns), model.posterior(votes).tolist(), strict=True))
        filled = learn.where(F.size("ids") > 0)
        total = learn.count()
        with_findings = filled.count()
        parts = 1 << 20
        limit = min(parts, parts * params.fit_rows // max(1, with_findings) + 1)
        drawn = filled.where(F.pmod(F.xxhash64("ids", "density", "votes", "doc_id"), F.lit(parts)) < limit).select("ids", "density", "votes").collect()
        rows = [(list(r["ids"]), list(r["density"]), chance[r["votes"]], parts / limit) for r in drawn]
        empty = learn.where(F.size("ids") == 0).groupBy("votes").count().collect()
        rows += [([], [], chance[r["votes"]], float(r["count"])) for r in empty]
        scored = score(seen, fit_linear(sorted(rows), len(vocab), params.ridge) if total else np.zeros(len(vocab) + 1), ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
