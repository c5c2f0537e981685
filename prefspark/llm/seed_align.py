"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. One pass over the texts keeps, of every document that holds an n-gram of an item, the word hashes around these places, as far
   as an item laid over them can reach: narrow rows, the texts are not read again.
2. From these rows the documents that hold each n-gram are counted. The rare ones become seeds: those in at most ``rare_share``
   of the documents, and in any case the rarer ``item_share`` of each item's, so that an item which many documents copy keeps seeds.
3. Where a document holds a seed, the passage on the seed's diagonal is aligned with the item word by word (local
   alignment with gaps). An edited or paraphrased copy keeps a high score though its words differ here and there.
Items with fewer words than an n-gram are found where all their words stand one after another.

Words are compared in lower case without punctuation; words of punctuation alone are skipped. A benchmark beyond
``Params.block_bytes`` is worked through in blocks of that size, each shipped to the tasks; documents are never shuffled, so
neither a passage that a third of them share nor a very long document meets in one place.

Defined results: null and empty texts hold nothing; null item texts and items without words are never found; every input row is scored, repeated rows too; an empty table on either side finds nothing.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.llm.common import DistinctTable, fresh, list_array, map_texts, materialise, roll, split_words, sums, utf8


@dataclass(frozen=True)
class Params:
    """``threshold``: alignment score over that of the whole item with itself; ``least``: words that must agree."""

    seed: int = 3
    rare_share: float = 0.001
    item_share: float = 0.75
    slack: int = 12
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    threshold: float = 0.4
    least: int = 8
    block_bytes: int = 16 << 20


HIT = T.StructType(
    [
        T.StructField("item_id", T.LongType(), False),
        T.StructField("score", T.DoubleType(), False),
        T.StructField("matches", T.IntegerType(), False),
        T.StructField("first_word", T.IntegerType(), False),
        T.StructField("last_word", T.IntegerType(), False),
    ]
)


class Words:
    """Word hashes of texts, 64 bits each; distinct words are normalised and hashed once per task."""

    def __init__(self):
        self.known = np.empty(0, np.uint64)
        self.table = DistinctTable(self._add, self._reset)

    def _reset(self) -> None:
        self.known = np.empty(0, np.uint64)

    def _add(self, new: list[str]) -> None:
        import xxhash

        plain = [re.sub(r"[\W_]+", "", w.lower()) for w in new]
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) | 1 if w else 0 for w in plain), np.uint64, len(plain))
        self.known = np.concatenate([self.known, hashes])

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all texts one after another, and how many each has."""
        words, counts = split_words(texts)
        rows = self.table.rows(words)
        found = self.known[rows]
        real = found != 0
        return found[real], sums(real.astype(np.int64), counts)


class Index:
    """Benchmark items by n-gram: sorted distinct grams, and for each the (item, offset) places that hold it.

    It is built in every task from plain arrays (``ids``, all words one after another, words per item), as broadcast
    values must not need the package on the executors.
    """

    def __init__(self, ids: list[int], flat: np.ndarray, counts: np.ndarray, size: int):
        self.ids, self.size = ids, size
        self.words = np.split(flat, np.cumsum(counts)[:-1]) if len(ids) else []
        ends = np.cumsum(counts)
        item = np.repeat(np.arange(len(ids)), counts)
        rolled = roll(flat, size)
        at = np.flatnonzero(np.arange(len(rolled)) + size <= ends[item[: len(rolled)]])
        order = at[np.argsort(rolled[at], kind="stable")]
        self.grams, first = np.unique(rolled[order], return_index=True)
        self.first = np.append(first, len(order))
        self.item, self.offset = item[order], order - (ends - counts)[item[order]]
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.grams >> np.uint64(40)).astype(np.int64) & (len(self.filter) - 1)] = True

    def places(self, gram: int) -> list[tuple[int, int]]:
        """Items and offsets that hold a gram."""
        here = slice(self.first[gram], self.first[gram + 1])
        return list(zip(self.item[here].tolist(), self.offset[here].tolist(), strict=True))

    def find(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, position in the text and gram of every gram of the index, in order."""
        rolled = roll(words, self.size)
        none = np.empty(0, np.int64)
        if not len(rolled) or not len(self.grams):
            return none, none, none
        at = np.flatnonzero(self.filter[(rolled >> np.uint64(40)).astype(np.int64) & (len(self.filter) - 1)])
        gram = np.minimum(np.searchsorted(self.grams, rolled[at]), len(self.grams) - 1)
        same = self.grams[gram] == rolled[at]
        at, gram = at[same], gram[same]
        ends = np.cumsum(counts)
        text = np.searchsorted(ends, at, side="right")
        inside = at + self.size <= ends[text] if len(at) else np.empty(0, bool)
        at, gram, text = at[inside], gram[inside], text[inside]
        return text, at - (ends - counts)[text], gram


def align(item: np.ndarray, passage: np.ndarray, p: Params) -> tuple[int, int, int, int]:
    """Best local alignment: score, words that agree, first and last word in the passage (inclusive).

    Two rows of the table are held, with the first word and the agreeing words of the best way into each cell; a way takes both
    words where it can, else skips a word of the item, else one of the passage."""
    places = np.arange(len(passage) + 1)
    steps = -p.gap * places
    score, first, agree = np.zeros(len(places), np.int64), places.copy(), np.zeros(len(places), np.int64)
    best = (0, 0, 0, -1)
    for word in item:
        same = passage == word
        row, new_first, new_agree = np.maximum(score + p.gap, 0), first.copy(), agree.copy()
        both = score[:-1] + np.where(same, p.match, p.mismatch)
        take = both >= row[1:]
        row[1:] = np.where(take, both, row[1:])
        new_first[1:] = np.where(take, np.where(score[:-1] > 0, first[:-1], places[:-1]), new_first[1:])
        new_agree[1:] = np.where(take, np.where(score[:-1] > 0, agree[:-1], 0) + same, new_agree[1:])
        raised = row + steps
        reach = np.maximum.accumulate(raised)
        source = np.maximum.accumulate(np.where(raised == reach, places, 0))
        score, first, agree = reach - steps, new_first[source], new_agree[source]
        at = int(score.argmax())
        if score[at] > best[0]:
            best = (int(score[at]), int(agree[at]), int(first[at]), at - 1)
    return best


def passages(starts: list[int], length: int, total: int, slack: int) -> list[tuple[int, int]]:
    """Word ranges that cover an item laid out from each start, with slack; overlapping ranges become one."""
    out: list[tuple[int, int]] = []
    for start in sorted(starts):
        lo, hi = max(0, start - slack), min(total, start + length + slack)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


NEAR = [
    T.StructField(name, kind, False)
    for name, kind in (
        ("total", T.IntegerType()), ("starts", T.ArrayType(T.IntegerType(), False)), ("sizes", T.ArrayType(T.IntegerType(), False)),
        ("words", T.ArrayType(T.LongType(), False)), ("positions", T.ArrayType(T.IntegerType(), False)), ("grams", T.ArrayType(T.IntegerType(), False)),
        ("short_items", T.ArrayType(T.IntegerType(), False)), ("short_at", T.ArrayType(T.IntegerType(), False)),
    )
]


class Finder:
    """Cuts out of texts what lies around the n-grams of a block of items; one per task."""

    def __init__(self, block: tuple, params: Params):
        self.index, self.p, self.words = Index(*block), params, Words()
        counts = np.array([len(w) for w in self.index.words], np.int64)
        self.short = []
        for size in range(1, params.seed):
            at = np.flatnonzero(counts == size)
            if len(at):
                self.short.append((at, Index(at.tolist(), np.concatenate([self.index.words[i] for i in at]), counts[at], size)))

    def cut(self, found: list[tuple[int, int]], total: int) -> list[tuple[int, int]]:
        """The word ranges that items laid over these (position, gram) can reach."""
        ranges: list[tuple[int, int]] = []
        for item, starts in _starts(self.index, found).items():
            ranges += passages(starts, len(self.index.words[item]), total, self.p.slack)
        out: list[tuple[int, int]] = []
        for lo, hi in sorted(ranges):
            if out and lo <= out[-1][1]:
                out[-1] = (out[-1][0], max(hi, out[-1][1]))
            else:
                out.append((lo, hi))
        return out

    def near(self, texts: pa.Array) -> list[pa.Array]:
        """The columns of ``NEAR`` for every text."""
        words, counts = self.words.of(texts)
        begins = np.cumsum(counts) - counts
        by_text: dict[int, list[tuple[int, int]]] = {}
        for t, x, g in zip(*(a.tolist() for a in self.index.find(words, counts)), strict=True):
            by_text.setdefault(t, []).append((x, g))
        short: dict[int, dict[int, int]] = {}
        for at, index in self.short:
            for t, x, g in zip(*(a.tolist() for a in index.find(words, counts)), strict=True):
                for item, _ in index.places(g):
                    short.setdefault(t, {}).setdefault(int(at[item]), x)
        lists: list[list] = [[] for _ in NEAR[1:]]
        sizes = [np.zeros(len(texts), np.int64) for _ in NEAR[1:]]
        for t in sorted(by_text.keys() | short.keys()):
            found, own = by_text.get(t, []), sorted(short.get(t, {}).items())
            ranges = self.cut(found, int(counts[t]))
            cut = [words[begins[t] + lo : begins[t] + hi].view(np.int64) for lo, hi in ranges]
            columns = ([lo for lo, _ in ranges], [hi - lo for lo, hi in ranges], cut, [x for x, _ in found], [g for _, g in found], [i for i, _ in own], [x for _, x in own])
            for k, column in enumerate(columns):
                lists[k] += column
                sizes[k][t] = sum(map(len, column)) if k == 2 else len(column)
        flat = [np.concatenate(c) if k == 2 and c else np.array(c, np.int64 if k == 2 else np.int32) for k, c in enumerate(lists)]
        return [pa.array(counts.astype(np.int32)), *[list_array(v, n) for v, n in zip(flat, sizes, strict=True)]]


def _starts(index: Index, found: list[tuple[int, int]]) -> dict[int, list[int]]:
    """Per item the places where it would begin, from (position, gram)."""
    starts: dict[int, list[int]] = {}
    for position, gram in found:
        for item, offset in index.places(gram):
            starts.setdefault(item, []).append(position - offset)
    return starts


class Searcher:
    """Finds the items that documents hold, from what was cut out of them; one per task."""

    def __init__(self, block: tuple, seeds: np.ndarray, params: Params):
        self.index, self.p = Index(*block), params
        self.is_seed = np.zeros(len(self.index.grams), bool)
        self.is_seed[seeds] = True
        self.done: dict[tuple[int, bytes], tuple[int, int, int, int]] = {}

    def hits(self, total: int, windows: list[tuple[int, np.ndarray]], found: list[tuple[int, int]], short: list[tuple[int, int]]) -> list[tuple]:
        """Items that one document holds: the best alignment of each."""
        out = []
        begins = [lo for lo, _ in windows]
        for item, diagonals in _starts(self.index, [x for x in found if self.is_seed[x[1]]]).items():
            own, best = self.index.words[item], None
            for lo, hi in passages(diagonals, len(own), total, self.p.slack):
                first, words = windows[bisect_right(begins, lo) - 1]
                got = self.aligned(item, own, words[lo - first : hi - first])
                share = got[0] / (self.p.match * len(own))
                if share >= self.p.threshold and got[1] >= min(self.p.least, len(own)) and (best is None or share > best[1]):
                    best = (self.index.ids[item], share, got[1], lo + got[2], lo + got[3])
            if best:
                out.append((item, best))
        for item, at in short:
            n = len(self.index.words[item])
            out.append((item, (self.index.ids[item], 1.0, n, at, at + n - 1)))
        return [hit for _, hit in sorted(out)]

    def aligned(self, item: int, own: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int]:
        """The alignment of an item with a passage; passages that many documents share are aligned once."""
        if len(passage) >= 4_096:
            return align(own, passage, self.p)
        key = (item, passage.tobytes())
        if key not in self.done:
            if len(self.done) > 4_096:
                self.done.clear()
            self.done[key] = align(own, passage, self.p)
        return self.done[key]

    def search(self, batch: pa.RecordBatch) -> pa.Array:
        """The list of hits of every row of ``NEAR``."""
        columns = {f.name: batch.column(f.name) for f in NEAR}
        split = lambda name: (columns[name].flatten().to_numpy(zero_copy_only=False), columns[name].offsets.to_numpy() - columns[name].offsets[0].as_py())
        values = {f.name: split(f.name) for f in NEAR[1:]}
        flat, sizes = [], np.zeros(batch.num_rows, np.int64)
        for t, total in enumerate(columns["total"].to_pylist()):
            own = {name: v[ends[t] : ends[t + 1]] for name, (v, ends) in values.items()}
            ends = np.cumsum(own["sizes"])
            words = own["words"].view(np.uint64)
            windows = [(int(lo), words[e - n : e]) for lo, n, e in zip(own["starts"], own["sizes"], ends, strict=True)]
            pairs = [list(zip(own[a].tolist(), own[b].tolist(), strict=True)) for a, b in (("positions", "grams"), ("short_items", "short_at"))]
            one = self.hits(total, windows, *pairs)
            sizes[t] = len(one)
            flat += one
        kinds = [pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
        parts = [pa.array([r[k] for r in flat], kind) for k, kind in enumerate(kinds)]
        rows = pa.StructArray.from_arrays(parts, fields=[pa.field(n, k, False) for n, k in zip(HIT.names, kinds, strict=True)])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), rows)


def item_blocks(benchmark: DataFrame, params: Params) -> Iterator[tuple]:
    """What ``Index`` takes, for blocks of about ``block_bytes`` of text, each small enough to ship to every task."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("t")).where("t is not null and item_id is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-int(total) // params.block_bytes)
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toArrow().sort_by([("item_id", "ascending"), ("t", "ascending")])
        words, counts = Words().of(utf8(part.column("t")))
        yield part.column("item_id").to_pylist(), words, counts, params.seed


def around(docs: DataFrame, block: tuple, params: Params, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``NEAR`` of the documents that hold an n-gram or a short item of the block, written once."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    cut = map_texts(docs, text, keep, NEAR, lambda: Finder(shared.value, params).near)
    return materialise(cut.where((F.size("grams") > 0) | (F.size("short_items") > 0)), "seeds-near")


def rare_seeds(near: DataFrame, documents: int, block: tuple, params: Params) -> np.ndarray:
    """The grams of a block that serve as seeds, from the number of documents that hold each."""
    # at most one row per gram of the block, whose size is bounded
    got = near.select(F.explode(F.array_distinct("grams")).alias("gram")).groupBy("gram").agg(F.count("*").alias("docs")).toPandas()
    index = Index(*block)
    held = np.zeros(len(index.grams), np.int64)
    held[got["gram"].to_numpy(np.int64)] = got["docs"].to_numpy(np.int64)
    rare = held <= params.rare_share * documents
    for words in index.words:
        own = np.searchsorted(index.grams, np.unique(roll(words, params.seed)))
        if len(own):
            rare[own[np.argsort(held[own], kind="stable")[: math.ceil(params.item_share * len(own))]]] = True
    return np.flatnonzero(rare)


def search(docs: DataFrame, benchmark: DataFrame, params: Params = Params(), text: str = "text", keep: list[str] = ("doc_id",)) -> Iterator[DataFrame]:
    """``keep`` columns and ``hits``, a list of HIT, of the rows that may hold items: one frame per block of the benchmark."""
    documents = docs.count()
    # kept columns travel under names of their own
    names = {c: f"kept{i}" for i, c in enumerate(keep)}
    source = docs.select(*[F.col(c).alias(n) for c, n in names.items()], F.col(text).cast("string").alias("t"))
    for block in item_blocks(benchmark, params):
        near = around(source, block, params, "t", list(names.values()))
        shared = docs.sparkSession.sparkContext.broadcast((block, rare_seeds(near, documents, block, params)))
        schema = T.StructType([*[near.schema[n] for n in names.values()], T.StructField("hits", T.ArrayType(HIT, False), False)])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, kept=list(names.values())) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(*shared.value, params)
            for batch in batches:
                for start in range(0, batch.num_rows, 1024):
                    part = batch.slice(start, 1024)
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], searcher.search(part)], names=[*kept, "hits"])

        found = near.mapInArrow(run, schema)
        yield found.select(*[F.col(n).alias(c) for c, n in names.items()], "hits")


def contaminated(docs: DataFrame, benchmark: DataFrame, params: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and item that it holds: ``key``, item_id, score, matches, first_word, last_word."""
    out = docs.sparkSession.createDataFrame([], T.StructType([docs.schema[key], *HIT.fields]))
    for found in search(docs, benchmark, params, text, [key]):
        out = out.union(found.select(key, F.explode("hits").alias("hit")).select(key, "hit.*"))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, params: Params = Params(), text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark, unchanged. Rows with one id (null too) and text are alike."""
    key, mark = "doc_id", fresh(docs, "mark")
    marked = docs.withColumn(mark, F.xxhash64(F.col(text).cast("string")))
    gone = None
    for found in search(marked, benchmark, params, text, [key, mark]):
        one = found.where(F.size("hits") > 0).select(F.col(key).alias("gone_id"), F.col(mark).alias("gone_mark"))
        gone = one if gone is None else gone.union(one)
    if gone is None:
        return docs
    same = marked[key].eqNullSafe(F.col("gone_id")) & (marked[mark] == F.col("gone_mark"))
    return marked.join(gone.distinct(), same, "left_anti").select(*docs.columns)
