"""Whole lists of terms looked up where their texts are read: what the common terms give is told in a few cells per row, and only
terms that a table too large to send may know are left to be shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms looked up at once, which bounds a worker's memory.
SLICE = 500_000
#: Bits per term of a filter, and its most bits: 32 MB, whatever the table.
BITS_PER_TERM, MOST_BITS = 16, 1 << 28
#: Bits of one bitmap of ``bitmap_construct_agg``.
BITMAP = 1 << 15

OWN = pa.struct([("total", pa.float64()), ("n", pa.int64()), ("positive", pa.int64()), ("negative", pa.int64())])
HIT = pa.struct([("side", pa.int32()), ("pos", pa.int32()), ("norm", pa.string())])
CELL = "kind string, norm string, pos int, own struct<total: double, n: bigint, positive: bigint, negative: bigint>, shown array<struct<side: int, pos: int, norm: string>>"


def term_filter(terms: DataFrame, norm: str) -> np.ndarray:
    """One bit per hash of a term, as bytes. A term whose bit is not set is none of them; of the others, few are not either, as long
    as the terms are at most a few times ``MOST_BITS / BITS_PER_TERM``."""
    wanted = max(BITMAP, BITS_PER_TERM * terms.count())
    bits = min(MOST_BITS, 1 << (wanted - 1).bit_length())
    place = F.pmod(F.xxhash64(norm), F.lit(bits)) + 1  # bitmaps count from one
    parts = terms.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():
        out[(r.part - 1) * BITMAP // 8 : r.part * BITMAP // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def term_cells(lists: DataFrame, key: str, kinds: tuple[str, ...], head: DataFrame, known: np.ndarray | None, shown: int) -> DataFrame:
    """Of rows with a list of norms per kind, (key, kind) and either

    - ``own``: sum of scores, terms and hits of either side among the terms of ``head`` (kind, norm, score, side), and the first
      ``shown`` hits of either side as ``shown``, or
    - ``norm``: a term that is not in ``head`` and passes the filter ``known`` (None: there are no others), with its position
      where it can still be among the first hits.
    """
    spark = lists.sparkSession
    table = head.select("kind", "norm", "score", F.col("side").cast("int").alias("side")).toArrow().combine_chunks()
    heads = {}
    for kind in kinds:
        part = table.filter(pc.equal(table["kind"], kind)).combine_chunks()
        # a term that is not found has the place -1, so the last one
        scores, sides = np.append(part["score"].to_numpy(), 0.0), np.append(part["side"].to_numpy(), 0).astype(np.int8)
        heads[kind] = (part["norm"].combine_chunks().cast(pa.string()), scores, sides)
    shared = spark.sparkContext.broadcast((heads, known))
    columns = [F.col(k) for k in kinds]
    if known is not None:
        columns += [F.transform(k, lambda t: F.xxhash64(t)).alias(f"{k}_hash") for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, known = shared.value
        for batch in batches:
            for part in _slices(batch, kinds):
                for kind in kinds:
                    hashes = part.column(f"{kind}_hash").flatten().to_numpy() if known is not None else None
                    for found in _looked_up(part.column(kind), heads[kind], hashes, known, shown):
                        rows, *columns = found
                        kept = part.column(key).take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([kept, pa.repeat(kind, len(rows)), *columns], names=[key, "kind", "norm", "pos", "own", "shown"])
                pa.default_memory_pool().release_unused()

    return lists.select(key, *columns).mapInArrow(run, f"`{key}` {lists.schema[key].dataType.simpleString()}, {CELL}")


def _slices(batch: pa.RecordBatch, kinds: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with at most ``SLICE`` terms; a row with more stands alone."""
    ends = np.cumsum(sum(_sizes(batch.column(k)) for k in kinds))
    start, before = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
        yield batch.slice(start, stop - start)
        start, before = stop, int(ends[stop - 1])


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _looked_up(lists: pa.Array, head: tuple, hashes: np.ndarray | None, known: np.ndarray | None, shown: int) -> Iterator[tuple]:
    """(rows, norm, pos, own, shown) of both sorts of rows, one after the other."""
    terms, scores, sides = head
    values, sizes = lists.flatten(), _sizes(lists)
    row, start = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    at = pc.fill_null(pc.index_in(values, value_set=terms), -1).to_numpy(zero_copy_only=False)
    side = sides[at]

    def summed(weights: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights, len(sizes)).astype(np.float64)  # of nothing it counts in integers

    wanted, firsts = np.zeros(len(sizes), np.int64), []  # hits before the place wanted can still be among the first ones
    for s in (1, -1):
        hits = np.flatnonzero(side == s)
        rank = np.arange(len(hits)) - np.searchsorted(row[hits], row[hits])
        full = np.full(len(sizes), len(row))
        full[row[hits[rank == shown - 1]]] = hits[rank == shown - 1]
        wanted = np.maximum(wanted, full)
        firsts.append(hits[rank < shown])
    hits = np.sort(np.concatenate(firsts))

    n = summed(at >= 0).astype(np.int64)
    some = np.flatnonzero(n)
    sums = [summed(scores[at])[some], n[some], *(summed(side == s)[some].astype(np.int64) for s in (1, -1))]
    own = pa.StructArray.from_arrays([pa.array(c) for c in sums], fields=list(OWN))
    fields = [pa.array(side[hits].astype(np.int32)), pa.array((hits - start[row[hits]]).astype(np.int32)), values.take(pa.array(hits))]
    ends = np.cumsum(np.bincount(row[hits], minlength=len(sizes))[some]).astype(np.int32)
    told = pa.ListArray.from_arrays(np.append(np.int32(0), ends), pa.StructArray.from_arrays(fields, fields=list(HIT)))
    yield some, *_nulls(len(some), pa.string(), pa.int32()), own, told

    if known is not None:
        bit = hashes & (8 * len(known) - 1)
        passed = (known[bit >> 3] >> (bit & 7)) & 1 == 1
        left = np.flatnonzero((at < 0) & passed & pc.is_valid(values).to_numpy(zero_copy_only=False))
        late = left >= wanted[row[left]]
        yield row[left], values.take(pa.array(left)), pa.array((left - start[row[left]]).astype(np.int32), mask=late), *_nulls(len(left), OWN, pa.list_(HIT))


def _nulls(n: int, *kinds: pa.DataType) -> list[pa.Array]:
    return [pa.nulls(n, k) for k in kinds]
