"""Token ids in ORC: sorted files with run-length encoded ids, row indexes and Bloom filters on the document id.

``write_tokens`` range-partitions the texts by document id, encodes them behind that one shuffle and writes a file per
range, so file order times row order is the ascending order of ids. A row holds the document's ids and their start
within the file; the manifest beside the files holds each file's start, found from the files' own totals. Reading splits
by stripe, a lookup by document id skips files and stripes by their statistics and Bloom filters, and a column read
(totals, say) leaves the ids untouched.

Texts are encoded word by word: the vocabulary's pre-tokenizer never joins characters over white space, nor a letter
with punctuation behind it, so the ids of a text are those of such parts in order. ``WordTable`` encodes each distinct
part once per task, many in one call with a special token between them.

Defined results: null and empty texts hold the end id alone; rows with equal or null document ids are all kept (null
first, equal ids in the order of their texts' hashes); an empty table writes no rows and reads back empty; other columns
are left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.llm.common import DistinctTable, Ragged, list_array, model_bytes, slices, split_words, sums

ROW = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start_in_file", T.LongType(), False),
        T.StructField("n_tokens", T.LongType(), False),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False), False),
    ]
)
MANIFEST = "_manifest"
#: A special token of the vocabulary, put between words that are encoded in one call; how many these are.
MARK, AT_ONCE = "<|endoftext|>", 2_000
#: Words of Latin letters whose lower case is one letter each and composed: the normalizer and the pre-tokenizer leave them whole.
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")
#: Latin and Cyrillic letters of that kind, for the searches in whole texts.
PLAIN = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}\x{400}-\x{481}\x{48A}-\x{52F}"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordTable:
    """Distinct words of a task with the ids that the vocabulary gives them."""

    def __init__(self, vocabulary: bytes):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel unit
        self.tokenizer = Tokenizer.from_str(vocabulary.decode())
        self.mark_id = self.tokenizer.token_to_id(MARK)
        self.ids = Ragged(np.int32)
        self.letters = byte_letters()
        self.words = DistinctTable(self._add, self.ids.clear, most_bytes=32 << 20)

    def _add(self, new: list[str]) -> None:
        lists: list = [None] * len(new)
        tokens, letters = self.tokenizer.model.tokenize, self.letters
        others = []
        for i, word in enumerate(new):
            if LATIN.fullmatch(word):
                lower = word.lower()
                lists[i] = [t.id for t in tokens(lower if lower.isascii() else lower.encode().decode("latin-1").translate(letters))]
            else:
                others.append(i)
        for start in range(0, len(others), AT_ONCE):
            at = others[start : start + AT_ONCE]
            words = [new[i] for i in at]
            if self.mark_id is None or any("<|" in w for w in words):  # may hold special tokens: one by one
                found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            else:
                ids = np.array(self.tokenizer.encode_batch_fast([MARK.join(words)], add_special_tokens=False)[0].ids, np.int32)
                marks = np.flatnonzero(ids == self.mark_id)
                found = [x.tolist() for x in np.split(ids, marks)]
                found[1:] = [x[1:] for x in found[1:]]
            for i, own in zip(at, found, strict=True):
                lists[i] = own
        self.ids.extend(lists)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each closed by ``end``, and the number per text."""
        words, counts = split_words(parted(texts))
        values, sizes = self.ids.gather(self.words.rows(words))
        inner = sums(sizes, counts)
        stops = np.cumsum(inner + 1)
        out = np.empty(len(values) + len(counts), np.int32)
        body = np.ones(len(out), bool)
        body[stops - 1] = False
        out[body], out[~body] = values, end
        return out, inner + 1


def parted(texts: pa.Array) -> pa.Array:
    """Texts with A-Z lowered and a space between a letter and punctuation, which leaves their ids as they are.

    Only letters of ``PLAIN`` count, which stay single letters when lowered and composed: what others become may end in a mark,
    and a mark goes with the punctuation behind it. Texts with marks, and with what may be a special token, stay unchanged.
    """
    changed = pc.replace_substring_regex(pc.ascii_lower(texts), rf"([{PLAIN}])([.,!?;:*$%&#|])", r"\1 \2")
    return pc.if_else(pc.match_substring_regex(texts, r"\pM|<\|"), texts, changed)


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary_path: str,
    end_id: int = 1,
    files: int | None = None,
    stripe_bytes: int = 8 << 20,
    index_stride: int = 1000,
) -> None:
    """Encode ``docs`` (doc_id, text) into ``files`` ORC files, unless given as many as the session has shuffle partitions. Rows of
    one id, however many (null too), are dealt over ranges by the hash of their text."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(model_bytes(vocabulary_path))
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("t"))
        .repartitionByRange(n, F.col("doc_id"), F.xxhash64("t"))
        .sortWithinPartitions("doc_id", F.xxhash64("t"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, start = WordTable(vocabulary.value), 0
        for batch in batches:
            for part, texts in slices(batch, "t"):
                ids, sizes = table.encode(texts, end_id)
                starts = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(starts), pa.array(sizes), list_array(ids, sizes)], names=ROW.names
                )
        pa.default_memory_pool().release_unused()  # the worker waits for its next task

    (
        ordered.mapInArrow(run, ROW)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(index_stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("compression", "zstd")
        .orc(path)
    )
    _manifest(spark, path).write.parquet(f"{path}/{MANIFEST}")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its rows, ids, and the number of ids in all files before it.

    The numbers of part files rise with the ranges. The totals come from the files' narrow columns; there is a row per file, so the
    running sum is over as many rows as files were written.
    """
    totals = (
        spark.read.schema(ROW).orc(path)
        .groupBy(F.col("_metadata.file_name").alias("file"))
        .agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("ids"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
        .orderBy(F.regexp_extract("file", r"^part-(\d+)", 1).cast("long"))
        .toPandas()
    )
    before = (totals["ids"].cumsum() - totals["ids"]).astype("int64") if len(totals) else []
    rows = [
        (r.file, int(r.rows), int(r.ids), int(b), None if r.first_id != r.first_id else int(r.first_id), None if r.last_id != r.last_id else int(r.last_id))
        for r, b in zip(totals.itertuples(), before, strict=True)
    ]
    return spark.createDataFrame(rows, "file string, rows long, ids long, start long, first_id long, last_id long").coalesce(1)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows with ``start``, the number of ids of all documents before this one."""
    stored = spark.read.schema(ROW).orc(path).select("*", F.col("_metadata.file_name").alias("file"))
    starts = spark.read.parquet(f"{path}/{MANIFEST}").select("file", F.col("start").alias("file_start"))
    # the manifest has one row per written file
    return stored.join(F.broadcast(starts), "file").select(
        "doc_id", (F.col("file_start") + F.col("start_in_file")).alias("start"), "n_tokens", "ids"
    )


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents; the reader prunes stripes by statistics and Bloom filters."""
    return read_tokens(spark, path).where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def checksums(tokens: DataFrame) -> DataFrame:
    """``ids`` as the crc32 of their little-endian 32-bit bytes."""
    schema = T.StructType([f for f in tokens.schema.fields if f.name != "ids"] + [T.StructField("ids_crc32", T.LongType(), False)])
    keep = schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                lists = part.column("ids")
                flat = memoryview(np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), "<u4")).cast("B")
                sizes = np.diff(lists.offsets.to_numpy()) * 4
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(flat[e - s : e]) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(crc, pa.int64())], names=schema.names)

    return tokens.mapInArrow(run, schema)
