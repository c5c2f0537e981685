"""SentencePiece encoding and decoding over a table of distinct marked words.

Where no piece of a vocabulary continues behind a whitespace marker, no merge can cross one, so a text is segmented by
segmenting each of its marked words (a run of markers and what follows up to the next marker) on its own. A task keeps
the distinct marked words it has met with their ids and their decoded form, segments only new ones, and joins ids and
decoded words back by position. ``piece_table`` checks that condition on the vocabulary and refuses any other.

The table is kept per task. Joining one table of the whole corpus back by position would shuffle a row for every word
occurrence; here nothing is shuffled, a lost executor repeats only its own splits, and the table is bounded by a reset.

Defined results: null and empty texts have no ids and decode to the empty text; every input row gives one output row,
repeated rows too; texts of any length are handled whole; an empty table gives an empty table; other columns are
ignored unless kept, and a kept column named like an output is replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.llm.common import DistinctTable, Ragged, list_array, map_texts, model_bytes

MARK = "▁"
IDS = T.StructField("token_ids", T.ArrayType(T.IntegerType(), False), False)
DECODED = T.StructField("decoded", T.StringType(), False)


def check_markers(pieces: Iterable[str]) -> None:
    """Raise unless every piece has its whitespace markers in front only, and a lone marker is a piece."""
    lone = False
    for piece in pieces:
        lone |= piece == MARK
        if MARK in piece.lstrip(MARK):
            raise ValueError(f"piece {piece!r} crosses a whitespace marker")
    if not lone:
        raise ValueError("the vocabulary has no piece for a whitespace marker")


class PieceTable:
    """Distinct marked words with ids and decoded forms; keys leave out the first marker, which encoding adds."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.mark = self.processor.piece_to_id(MARK)
        self.ids = Ragged(np.int32)
        self.words = DistinctTable(self._add, self._reset)
        self._reset()

    def _reset(self) -> None:
        self.ids.clear()
        self.decoded: list[pa.Array] = [pa.array([], pa.large_string())]

    def _add(self, new: list[str]) -> None:
        ids = self.processor.encode(new, num_threads=1)
        if "" in new:  # a marker with nothing behind it
            ids[new.index("")] = [self.mark]
        self.ids.extend(ids)
        self.decoded.append(pa.array(self.processor.decode(ids, num_threads=1), pa.large_string()))

    def encode(self, texts: pa.Array) -> list[pa.Array]:
        """Ids and decoded text of each text."""
        keys, counts = marked_words(texts)
        rows = self.words.rows(keys)
        values, sizes = self.ids.gather(rows)
        ends = np.cumsum(counts)
        total = np.concatenate([[0], np.cumsum(sizes)])
        if len(self.decoded) > 1:
            self.decoded = [pa.concat_arrays(self.decoded)]
        words = self.decoded[0].take(pa.array(rows))
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int64))
        decoded = pc.binary_join(pa.LargeListArray.from_arrays(offsets, words), pa.scalar(" ", pa.large_string()))
        return [list_array(values, total[ends] - total[ends - counts]), decoded.cast(pa.string())]


def marked_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Keys of the marked words of all texts, in order, and the number per text.

    A text whose spaces are single and inside gives one key per space-separated part; others are cut at the markers.
    """
    odd = pc.or_(
        pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, MARK)),
        pc.or_(pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")), pc.equal(texts, "")),
    )
    if not pc.any(odd).as_py():
        lists = pc.split_pattern(texts, " ")
        return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    parts, counts = [], np.empty(len(texts), np.int64)
    flags = odd.to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(np.diff(flags)) + 1
    for start, stop in zip([0, *edges], [*edges, len(texts)], strict=True):
        run = texts.slice(start, stop - start)
        if flags[start]:
            keys = [key_list(t) for t in run.to_pylist()]
            counts[start:stop] = [len(k) for k in keys]
            parts.append(pa.array([k for one in keys for k in one], pa.large_string()))
        else:
            one, counts[start:stop] = marked_words(run)
            parts.append(one)
    return pa.concat_arrays(parts), counts


def key_list(text: str) -> list[str]:
    """Marked words of one text without their first marker."""
    if not text:
        return []
    return [word[1:] for word in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``token_ids`` and the ``decoded`` text of these ids."""
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(model_path))
    _require_markers(model.value)
    return map_texts(docs, text, list(keep), [IDS, DECODED], lambda: PieceTable(model.value).encode)


def decode_ids(frame: DataFrame, model_path: str, ids: str = "token_ids", keep: list[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with the ``decoded`` text of stored ids; null ids decode to the empty text."""
    model = frame.sparkSession.sparkContext.broadcast(model_bytes(model_path))
    keep = [c for c in keep if c.lower() != "decoded"]
    kept = frame.select(*keep).schema.fields
    wire = T.StructType([*[T.StructField(f"k{i}", f.dataType) for i, f in enumerate(kept)], DECODED])
    source = frame.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(ids).cast("array<int>").alias("ids"))
    names, n = wire.names, len(keep)

    def run(batches):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [processor.decode(x or []) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(n)], pa.array(texts, pa.string())], names=names)

    out = source.mapInArrow(run, wire)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "decoded")


def _require_markers(model: bytes) -> None:
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    check_markers(processor.id_to_piece(i) for i in range(processor.get_piece_size()) if not processor.is_unused(i))


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document the number of ids, and SHA-256 of the ids in decimal and of the decoded text."""
    coded = encode_documents(docs, model_path)
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
