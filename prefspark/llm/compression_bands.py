"""Quality rules by compression bands.

A text that repeats itself compresses far better than prose of its length, and random text hardly compresses. The
zstandard ratio (bytes before / after) of the whole text and of each of its fixed chunks must lie in the band of its
length; the last chunk ends with the text, chunks of texts under two of them are smaller, and texts under 512 bytes have
none. The low limits lie near or below the ratio of random text under 1,000 bytes. A text is kept if the base rules hold, its whole ratio lies in the band, and fewer than ``bad_share`` of its
chunks lie outside theirs.

Base counts work on words, runs without space or the control characters 9 to 13. Defined results: null counts as the
empty text, which has no words and fails; every input row gives one output row; texts of any length are read whole;
an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from prefspark.llm.common import map_texts, split_words

#: Texts of under two chunks are cut into halves of a chunk, quarters and so on, down to this size.
LEAST_CHUNK = 256
SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """``limits``: (bytes from, lowest ratio, highest ratio), rising; short texts have no lower limit, as the frame of a
    compressed block outweighs what is saved."""

    limits: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 3.0),
        (200, 1.05, 3.0),
        (500, 1.2, 3.5),
        (1_000, 1.3, 4.0),
        (2_000, 1.4, 5.0),
        (8_000, 1.5, 6.0),
        (32_000, 1.5, 8.0),
    )
    chunk_bytes: int = 4_096
    bad_share: float = 0.5
    level: int = 3
    min_words: int = 50
    most_repeated: float = 0.5


FIELDS = [
    *[T.StructField(n, T.LongType(), False) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    T.StructField("base_failed", T.BooleanType(), False),
    T.StructField("kept", T.BooleanType(), False),
    T.StructField("ratio", T.DoubleType(), False),
    T.StructField("bad_chunks", T.DoubleType(), False),
]


def repeated_words(words: np.ndarray) -> int:
    """Words in three-word windows that occur at least twice; ``words`` are numbers that tell words apart."""
    n = len(words) - 2
    if n < 2:
        return 0
    a = words.astype(np.int64)
    if int(a.max()) < 1 << 21:
        keys = (a[:-2] << 42) | (a[1:-1] << 21) | a[2:]
    else:  # too many words for one number: number the pairs first
        pairs = np.unique((a[:-2] << 32) | a[1:-1], return_inverse=True)[1]
        keys = (pairs << 32) | a[2:]
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(keys, twice)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : n + k] |= hit
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    lines = [x for x in lines if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def measure(docs: DataFrame, bands: Bands = Bands(), text: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, base counts and verdicts, the whole ratio, and the share of chunks outside their band."""
    starts = np.array([x[0] for x in bands.limits])

    def make():
        import zstandard

        compress = zstandard.ZstdCompressor(level=bands.level).compress

        def outside(data: bytes) -> tuple[float, bool]:
            _, low, high = bands.limits[int(np.searchsorted(starts, len(data), side="right")) - 1]
            ratio = len(data) / len(compress(data))
            return ratio, not low <= ratio <= high

        def run(texts: pa.Array) -> list[pa.Array]:
            words, counts = split_words(texts)
            numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            rows, end = [], 0
            for text, n in zip(texts.to_pylist(), counts.tolist(), strict=True):
                start, end = end, end + n
                data, size = text.encode(), bands.chunk_bytes
                repeated = repeated_words(numbers[start:end])
                base = n < bands.min_words or repeated > bands.most_repeated * n
                ratio, bad = outside(data)
                while len(data) < 2 * size and size > LEAST_CHUNK:
                    size //= 2
                places = [*range(0, len(data) - size + 1, size), *([len(data) - size] if len(data) % size else [])]
                chunks = [outside(data[i : i + size])[1] for i in places] if len(data) >= 2 * size else []
                share = sum(chunks) / len(chunks) if chunks else float(bad)
                rows.append(
                    (n, len(text) - len(data) + len(data.translate(None, SPACE)), len(data) - len(data.translate(None, SYMBOLS)),
                     duplicate_lines(text), repeated, base, not (base or bad or share >= bands.bad_share), ratio, share)
                )
            return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2, strict=True)]

        return run

    return map_texts(docs, text, list(keep), FIELDS, make)
