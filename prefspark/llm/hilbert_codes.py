"""Vector codes: integer codebooks per part of a vector, fitted over Hilbert-sorted blocks.

1. Components become integers, vectors are cut into equal parts, and the parts of one position are ordered along a Hilbert
   curve, so that neighbours in the order are near each other.
2. Consecutive parts form flat blocks; a block stores its smallest and largest corner (box) and the sum of its parts.
3. In each round the distances of the entries to the box give the block's shortlist: an entry further from the nearest
   point of the box than another is from its furthest can't win. A block with one entry left adds its stored sum; for the
   others an integer kernel compares the parts with the shortlist. Only sums per entry leave the tasks.

All arithmetic is exact in 64-bit integers, so results do not depend on how rows are dealt out.

Defined results: rows whose vector is null, empty, or holds null or non-finite components are dropped, and so are those of another
length than the kept row with the smallest id; a length that the parts do not divide, or a component of 32,768 or more in
size (whose distances may pass 64 bits), is an error; with fewer rows than entries there are as many entries as rows; null ids come
last in the order of ids, equal ids in the order of their components; every kept row gives one output row, repeated rows too;
an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.llm.common import materialise

#: Components below this keep distances of whole vectors within 64 bits (up to 128 components).
MOST = 1 << 27


@dataclass(frozen=True)
class Params:
    """``block``: parts in a block; ``salts``: shares into which the rows of one label are dealt for the sum by label."""

    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    block: int = 256
    salts: int = 32


def prepare(vectors: DataFrame, params: Params, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """row, id, label and integer components of the kept rows, written once so that ``row`` stays."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * params.scale))
    near = F.when(F.forall(vector, lambda x: F.abs(x.cast("double") * params.scale) < MOST), F.transform(whole, lambda x: x.cast("int")))
    values = near.otherwise(F.raise_error(F.lit(f"a component is not below {MOST / params.scale:g}")))
    rows = kept.select(F.col(key).alias("id"), F.col(label).alias("label"), values.alias("x"))
    first = rows.orderBy(F.asc_nulls_last("id"), "x").select(F.size("x")).head()
    length = first[0] if first else params.parts
    if length % params.parts:
        raise ValueError(f"{params.parts} parts do not divide {length} components")
    return materialise(rows.where(F.size("x") == length).withColumn("row", F.monotonically_increasing_id()), "codes-rows")


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with whole coordinates of ``bits`` bits; their product with the number of
    coordinates must not pass 63."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    for level in range(bits - 1, 0, -1):  # undo the rotations of each level, from the coarsest
        low = (1 << level) - 1
        for i in range(len(x)):
            far = (x[i] >> level & 1).astype(bool)
            swap = np.where(far, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(far, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):  # Gray code
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros(len(points), np.int64)
    for level in range(bits - 1, 0, -1):
        turn = np.where(x[-1] >> level & 1, turn ^ ((1 << level) - 1), turn)
    place = np.zeros(len(points), np.int64)
    for level in range(bits - 1, -1, -1):
        for one in x:
            place = place << 1 | ((one ^ turn) >> level & 1)
    return place


def blocks(rows: DataFrame, params: Params) -> DataFrame:
    """Flat blocks along the curve: part, n, rows, values (part after part), lo, hi and total (one value per component).

    Equal parts, however many, are told apart by their row, so that ranges stay near equal in size."""
    bounds = rows.agg(F.min(F.array_min("x")).alias("lo"), F.max(F.array_max("x")).alias("hi"), F.max(F.size("x")).alias("length")).first()
    low, high, width = bounds["lo"] or 0, bounds["hi"] or 0, (bounds["length"] or params.parts) // params.parts
    used = min(width, 62)
    bits = min(16, 62 // used)
    shift = max(0, (high - low).bit_length() - bits)
    n_parts, size = params.parts, params.block

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)  # part after part
            place = hilbert((x[:, :used].astype(np.int64) - low) >> shift, bits) if len(x) else np.empty(0, np.int64)
            part = np.tile(np.arange(n_parts, dtype=np.int32), batch.num_rows)
            row = np.repeat(batch.column("row").to_numpy(zero_copy_only=False), n_parts)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(place), pa.array(row), _lists(x.ravel(), width)], names=["part", "place", "row", "v"])

    ordered = (
        rows.select("row", "x").mapInArrow(cut, "part int, place long, row long, v array<int>")
        .repartitionByRange("part", "place", "row")
        .sortWithinPartitions("part", "place", "row")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, v = np.empty(0, np.int32), np.empty(0, np.int64), np.empty((0, width), np.int32)
        for batch in batches:
            part = np.concatenate([part, batch.column("part").to_numpy(zero_copy_only=False)])
            row = np.concatenate([row, batch.column("row").to_numpy(zero_copy_only=False)])
            v = np.concatenate([v, batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)])
            # the last part in hand may go on in the next batch
            edge = int(np.searchsorted(part, part[-1])) if len(part) else 0
            stop = edge + (len(part) - edge) // size * size
            if stop:
                yield emit(part[:stop], row[:stop], v[:stop])
                part, row, v = part[stop:], row[stop:], v[stop:]
        if len(part):
            yield emit(part, row, v)

    def emit(part: np.ndarray, row: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        starts = np.concatenate([np.arange(a, b, size) for a, b in _same(part)])
        sizes = np.diff(np.append(starts, len(part)))
        reduce = lambda how, x: _lists(how.reduceat(x, starts, axis=0).ravel(), width)
        offsets = np.append(starts, len(part)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(part[starts]), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(row)),
                pa.ListArray.from_arrays(pa.array(offsets * width), pa.array(v.ravel())),
                reduce(np.minimum, v), reduce(np.maximum, v), reduce(np.add, v.astype(np.int64)),
            ],
            names=["part", "n", "rows", "v", "lo", "hi", "total"],
        )

    schema = "part int, n int, rows array<long>, v array<int>, lo array<int>, hi array<int>, total array<long>"
    return materialise(ordered.mapInArrow(pack, schema), "codes-blocks")


def _lists(flat: np.ndarray, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), pa.array(flat))


def _same(part: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal values of a sorted array."""
    edges = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def shortlist(lo: np.ndarray, hi: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which entries can be nearest to some part in each box: a row per box, a column per entry."""
    below, above = lo[:, None] - entries[None], entries[None] - hi[:, None]
    nearest = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=2)
    furthest = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=2)
    return nearest <= furthest.min(axis=1, keepdims=True)


def nearest(values: np.ndarray, entries: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the listed entries to each part (the lower index of equals), and its squared distance."""
    distance = ((values[:, None] - entries[listed][None]) ** 2).sum(axis=2)
    at = distance.argmin(axis=1)
    return listed[at], distance[np.arange(len(values)), at]


def _boxes(batch: pa.RecordBatch, codebooks: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Block by block: place in the batch, part, shortlist."""
    part = batch.column("part").to_numpy(zero_copy_only=False)
    lo, hi = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.int64) for c in ("lo", "hi"))
    for p in np.unique(part).tolist():
        at = np.flatnonzero(part == p)
        for i, may in zip(at.tolist(), shortlist(lo[at], hi[at], codebooks[p]), strict=True):
            yield i, p, np.flatnonzero(may)


def _values(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column("v")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64), (lists.offsets.to_numpy() - lists.offsets[0].as_py()) // width


def update(parted: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every entry becomes the floored mean of the parts nearest to it; entries without any stay."""
    width = codebooks[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = [np.zeros(len(c), np.int64) for c in codebooks], [np.zeros(c.shape, np.int64) for c in codebooks]
        for batch in batches:
            values, ends = _values(batch, width)
            stored = batch.column("total").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for i, p, listed in _boxes(batch, codebooks):
                if len(listed) == 1:
                    count[p][listed[0]] += ends[i + 1] - ends[i]
                    total[p][listed[0]] += stored[i]
                else:
                    own = values[ends[i] : ends[i + 1]]
                    entry, _ = nearest(own, codebooks[p], listed)
                    count[p] += np.bincount(entry, minlength=len(count[p]))
                    np.add.at(total[p], entry, own)
        keys = [(p, e) for p, c in enumerate(count) for e in np.flatnonzero(c).tolist()]
        sums = np.array([total[p][e] for p, e in keys], np.int64).ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in keys], pa.int32()), pa.array([e for _, e in keys], pa.int32()), pa.array([int(count[p][e]) for p, e in keys], pa.int64()), _lists(sums, width)],
            names=["part", "entry", "n", "total"],
        )

    found = parted.mapInArrow(run, "part int, entry int, n long, total array<long>")
    sums = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(width)])
    new = [c.copy() for c in codebooks]
    for r in sums.collect():  # a row per entry at most
        new[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return new


def train(rows: DataFrame, parted: DataFrame, params: Params) -> list[np.ndarray]:
    """The codebook of every part, from the parts of the rows with the smallest ids."""
    first = [r["x"] for r in rows.orderBy(F.asc_nulls_last("id"), "x").select("x").limit(params.entries).collect()]
    if not first:
        return []
    width = len(first[0]) // params.parts
    codebooks = [np.array([x[p * width : (p + 1) * width] for x in first], np.int64) for p in range(params.parts)]
    for _ in range(params.rounds):
        codebooks = update(parted, codebooks)
    return codebooks


def assign(parted: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """row, part, entry and squared distance of every part."""
    width = codebooks[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = _values(batch, width)
            entry, distance = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
            for i, p, listed in _boxes(batch, codebooks):
                own = slice(ends[i], ends[i + 1])
                entry[own], distance[own] = nearest(values[own], codebooks[p], listed)
            part = np.repeat(batch.column("part").to_numpy(zero_copy_only=False), np.diff(ends))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rows").flatten(), pa.array(part), pa.array(entry.astype(np.int32)), pa.array(distance)], names=["row", "part", "entry", "distance"]
            )

    return parted.mapInArrow(run, "row long, part int, entry int, distance long")


def listing(codebooks: list[np.ndarray]) -> str:
    """All components by part, entry and position."""
    return ",".join(str(x) for book in codebooks for x in book.ravel().tolist())


def decode(code: str, codebooks: list[np.ndarray], scale: int = Params.scale) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([book[int(code[2 * p : 2 * p + 2], 16)] for p, book in enumerate(codebooks)]) / scale


def compress(
    vectors: DataFrame, params: Params = Params(), key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> tuple[DataFrame, list[np.ndarray]]:
    """``key``, code, error and label_error of every kept row, and the codebooks that the codes refer to."""
    if params.entries > 256:
        raise ValueError("a code has two hexadecimal digits per part")
    rows = prepare(vectors, params, key, vector, label)
    parted = blocks(rows, params)
    codebooks = train(rows, parted, params)
    if not codebooks:
        none = rows.select(F.col("id").alias(key), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none, codebooks
    digits = [F.lpad(F.lower(F.hex(F.max(F.when(F.col("part") == p, F.col("entry"))))), 2, "0") for p in range(params.parts)]
    coded = assign(parted, codebooks).groupBy("row").agg(F.concat(*digits).alias("code"), F.sum("distance").alias("error"))
    coded = materialise(rows.select("row", "id", "label").join(coded, "row"), "codes-coded")
    # one label may hold most rows, so its rows are dealt out and its total is copied to each share
    share = F.pmod(F.xxhash64("row"), F.lit(params.salts))
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    totals = totals.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(params.salts - 1).cast("long"))))
    dealt = coded.withColumn("share", share)
    out = dealt.join(totals, dealt["label"].eqNullSafe(totals["of"]) & (dealt["share"] == totals["share"]))
    return out.select(F.col("id").alias(key), "code", "error", "label_error"), codebooks


def coded(vectors: DataFrame, params: Params = Params()) -> DataFrame:
    """Codes of ``vectors`` (vec_id, embedding, label) with the digest of the codebooks."""
    out, codebooks = compress(vectors, params)
    return out.withColumn("codebooks_sha256", F.lit(hashlib.sha256(listing(codebooks).encode()).hexdigest()))
