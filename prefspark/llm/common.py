"""What the operators of this subpackage share: bounded batches of texts, tables of distinct words, written cuts.

Row-wise operators run as ``mapInArrow`` over slices of at most ``SLICE_BYTES`` of text (one longer text makes a slice
of its own), so the memory of a task depends neither on the table nor on how many long texts meet in one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.session import scratch_path

SLICE_BYTES = 4 << 20
MODEL_BYTES = 64 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file; callers may pass any other path instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def model_bytes(path: str) -> bytes:
    """A vocabulary file, read once by the driver and shipped with the task; its size is checked."""
    data = Path(path).read_bytes()
    if len(data) > MODEL_BYTES:
        raise ValueError(f"{path} holds {len(data)} bytes, more than {MODEL_BYTES}")
    return data


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back: later steps neither recompute it nor depend on one executor."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(written: DataFrame) -> None:
    """Remove the files of a frame that ``materialise`` wrote, and that no later step reads."""
    hadoop = written.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = written.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in written.inputFiles()}:
        if "/prefspark-" in folder:
            path = hadoop(folder)
            path.getFileSystem(conf).delete(path, True)


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(column: pa.Array) -> pa.Array:
    """Texts as a plain string array, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Consecutive parts of a batch with at most ``limit`` bytes of text each, with their texts."""
    if batch.num_rows == 0:
        return
    texts = utf8(batch.column(text))
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start, before = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start), texts.slice(start, stop - start)
        start, before = stop, int(ends[stop - 1])


def map_texts(
    docs: DataFrame,
    text: str,
    keep: list[str],
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    extra: list[str] = (),
) -> DataFrame:
    """``keep`` columns of ``docs`` and one computed column per field.

    ``make`` runs once per task and returns the function from texts (null as empty) to the computed columns; with
    ``extra`` it also gets these columns of the slice. Fields replace kept columns of the same name, whatever its case.
    """
    new = {f.name.lower() for f in fields}
    keep = [c for c in keep if c.lower() not in new]
    kept = docs.select(*keep).schema.fields
    schema = T.StructType([*kept, *fields])
    # columns travel under positions, so that names of the caller can't clash with anything
    source = docs.select(
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)],
        F.col(text).cast("string").alias("t"),
        *[F.col(c).alias(f"x{i}") for i, c in enumerate(extra)],
    )
    wire = T.StructType(
        [*[T.StructField(f"k{i}", f.dataType) for i, f in enumerate(kept)], *[T.StructField(f"f{i}", f.dataType) for i, f in enumerate(fields)]]
    )
    n_keep, n_extra = len(keep), len(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part, texts in slices(batch, "t"):
                more = [part.column(f"x{i}") for i in range(n_extra)]
                columns = [part.column(f"k{i}") for i in range(n_keep)] + compute(texts, *more)
                yield pa.RecordBatch.from_arrays(columns, names=wire.names)
                del part, texts, more, columns
                # a worker serves the tasks of many stages: what a slice took would stay with it, on top of the next stage's
                pa.default_memory_pool().release_unused()

    out = source.mapInArrow(run, wire)
    return out.select(*[F.col(w).alias(f.name) for w, f in zip(wire.names, schema.fields, strict=True)])


class DistinctTable:
    """Per-task table of distinct strings; each is handled once, however often it occurs.

    ``rows`` gives the row of every string. New strings are handed to ``add`` in one list, in the order of their rows.
    When the table holds more than ``most_bytes`` of strings it starts anew, which costs time but changes no result.
    """

    def __init__(self, add: Callable[[list[str]], None], reset: Callable[[], None], most_bytes: int = 32 << 20):
        self.add, self.reset, self.most = add, reset, most_bytes
        self.known: pa.Array | None = None  # the strings in the order of their rows
        self.n = self.size = 0

    def rows(self, strings: pa.Array) -> np.ndarray:
        if self.size > self.most:
            self.known, self.n, self.size = None, 0, 0
            self.reset()
        coded = strings.dictionary_encode()
        distinct = coded.dictionary
        if self.known is None:
            found, missing = np.empty(len(distinct), np.int64), np.ones(len(distinct), bool)
        else:
            at = pc.index_in(distinct, value_set=self.known)
            found, missing = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), at.is_null().to_numpy(zero_copy_only=False)
        if missing.any():
            new = distinct.filter(pa.array(missing))
            found[missing] = np.arange(self.n, self.n + len(new))
            self.known = new if self.known is None else pa.concat_arrays([self.known, new])
            self.n += len(new)
            self.size += int(pc.sum(pc.binary_length(new)).as_py()) + 64 * len(new)
            self.add(new.to_pylist())
        return found[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.int64)


class Ragged:
    """A growing list of number lists, kept as flat values and offsets so that many rows are gathered at once."""

    def __init__(self, dtype=np.int32):
        self.values, self.ends, self.dtype = np.empty(1 << 16, dtype), np.zeros(1 << 14, np.int64), dtype
        self.n = self.used = 0

    def clear(self) -> None:
        self.n = self.used = 0

    def extend(self, lists: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.extend_flat(np.fromiter((x for one in lists for x in one), self.dtype, int(sizes.sum())), sizes)

    def extend_flat(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Add rows of the given sizes, their values one after another."""
        need = self.used + len(values)
        if need > len(self.values):
            self.values = np.concatenate([self.values[: self.used], np.empty(2 * need - self.used, self.dtype)])
        self.values[self.used : need] = values
        if self.n + len(sizes) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends[: self.n + 1], np.zeros(2 * (self.n + len(sizes)) + 2, np.int64)])
        self.ends[self.n + 1 : self.n + len(sizes) + 1] = self.used + np.cumsum(sizes)
        self.n, self.used = self.n + len(sizes), need

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of these rows one after another, and how many each has."""
        table = pa.LargeListArray.from_arrays(pa.array(self.ends[: self.n + 1]), pa.array(self.values[: self.used]))
        taken = table.take(pa.array(rows))
        return taken.flatten().to_numpy(zero_copy_only=False), (self.ends[rows + 1] - self.ends[rows])


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths; an empty run sums to 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (runs without space, tab, line feed, vertical tab, form feed, return) and the number per text."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    filled = pc.greater(pc.binary_length(flat), 0)
    if len(flat) and not pc.all(filled).as_py():  # the splitter leaves empty ends
        counts = sums(filled.to_numpy(zero_copy_only=False).astype(np.int64), counts)
        flat = flat.filter(filled)
    return flat, counts


def roll(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` word hashes."""
    n = max(0, len(words) - size + 1)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = (h ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h
