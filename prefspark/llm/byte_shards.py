"""Balanced contiguous shards by global byte-size prefix sums.

Rows are put in a global order (hash of the text, then document id) by one range shuffle of narrow rows. Each partition
reports its total; the running sum of these few totals gives every partition its offset, so each row knows how many
bytes lie before it without any global sort in one task. Cutting the bytes at equal targets gives shards that are
contiguous in that order and near equal in size.

Equal texts are neighbours. A group of equal texts of at most ``group_slack`` of a shard stays whole in one shard, so
two shards differ by no more than that and the largest text; larger groups are cut like any other rows.

Defined results: null counts as the empty text; every input row gets a shard and a slot, repeated rows too; an empty
table gives an empty table; a table with fewer rows than shards leaves shards empty; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm.common import materialise
from prefspark.session import cut_lineage

TOTALS = "part int, rows long, bytes long, first_group string, last_group string, first_bytes long, last_bytes long"
COUNTS = "part int, shard int, rows long"
ROWS = "doc_id long, size long, text_crc32 long, shard int, slot long"


def _partition(batches: Iterator[pa.RecordBatch]) -> tuple[int, dict[str, np.ndarray], np.ndarray]:
    """The number of this partition, its columns (narrow numbers only), and where a new group begins."""
    from pyspark import TaskContext

    parts = list(batches)
    cols = {c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in parts]) for c in ("size", "crc", "h")} if parts else {}
    if parts:
        cols["doc_id"] = pa.chunked_array([b.column("doc_id") for b in parts]).combine_chunks()
    n = len(cols["h"]) if parts else 0
    new = np.ones(n, bool)
    if n:
        new[1:] = (cols["h"][1:] != cols["h"][:-1]) | (cols["crc"][1:] != cols["crc"][:-1])
    return TaskContext.get().partitionId(), cols, np.flatnonzero(new)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, cols, first = _partition(batches)
    if len(first):
        size, last = cols["size"], first[-1]
        name = lambda i: f"{cols['h'][i]}:{cols['crc'][i]}"
        head = first[1] if len(first) > 1 else len(size)
        row = [part, len(size), int(size.sum()), name(0), name(last), int(size[:head].sum()), int(size[last:].sum())]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in TOTALS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)


def offsets(totals: list) -> tuple[dict[int, tuple[int, int, int]], int]:
    """Per partition: bytes before it, bytes of its first group before it, bytes of its last group behind it; the total.

    ``totals`` has one row per partition that has rows, in their order.
    """
    before, total, open_bytes = {}, 0, 0
    for i, r in enumerate(totals):
        joins = i > 0 and totals[i - 1].last_group == r.first_group
        lead = open_bytes if joins else 0
        before[r.part] = [total, lead, 0]
        total += r.bytes
        open_bytes = r.last_bytes + (lead if r.first_group == r.last_group else 0)
    behind = 0
    for i in range(len(totals) - 1, -1, -1):
        r = totals[i]
        joins = i + 1 < len(totals) and totals[i + 1].first_group == r.last_group
        before[r.part][2] = behind if joins else 0
        behind = r.first_bytes + (before[r.part][2] if r.first_group == r.last_group else 0)
    return {k: tuple(v) for k, v in before.items()}, total


def cut(size: np.ndarray, first: np.ndarray, at: tuple[int, int, int], total: int, shards: int, slack: float) -> np.ndarray:
    """The shard of every row of a partition: where its middle, or that of its small group, falls among the targets."""
    base, lead, behind = at
    start = base + np.cumsum(size) - size
    group = np.zeros(len(size), np.int64)
    group[first[1:]] = 1
    group = np.cumsum(group)
    begin, whole = start[first].copy(), np.add.reduceat(size, first)
    begin[0] -= lead
    whole[0] += lead
    whole[-1] += behind
    small = (whole <= slack * total / shards)[group]
    middle = np.where(small, 2 * begin[group] + whole[group], 2 * start + size)
    return np.minimum(middle * shards // (2 * total), shards - 1).astype(np.int32)


def assign_shards(docs: DataFrame, shards: int = 24, row_bytes: int = 8, group_slack: float = 0.01) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: this law makes no promise for more shards)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(row_bytes)).cast("long").alias("size"),
            F.crc32(text).alias("crc"),
            F.xxhash64(text).alias("h"),
        ),
        "shard-sizes",
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a reliable checkpoint keeps number and order of the partitions, on which the offsets rely
    ordered = cut_lineage(narrow.repartitionByRange(n, "h", "crc", "doc_id").sortWithinPartitions("h", "crc", "doc_id"))

    at, total = offsets(sorted(ordered.mapInArrow(_totals, TOTALS).collect()))  # one row per partition

    def shard_runs(batches):
        part, cols, first = _partition(batches)
        if not len(first):
            return part, cols, np.empty(0, np.int32), np.empty(0, np.int64)
        shard = cut(cols["size"], first, at[part], total, shards, group_slack)
        return part, cols, shard, np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))

    def count(batches):
        part, _, shard, runs = shard_runs(batches)
        if len(runs):
            rows = np.diff(np.append(runs, len(shard)))
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(runs), pa.int32()), pa.array(shard[runs]), pa.array(rows)], names=["part", "shard", "rows"])

    # a partition has one run per shard that it touches
    slots, seen = {}, {}
    for r in sorted(ordered.mapInArrow(count, COUNTS).collect()):
        slots[r.part, r.shard] = seen.get(r.shard, 0)
        seen[r.shard] = slots[r.part, r.shard] + r.rows

    def rows(batches):
        part, cols, shard, runs = shard_runs(batches)
        if not len(runs):
            return
        lengths = np.diff(np.append(runs, len(shard)))
        base = np.array([slots[part, int(s)] for s in shard[runs]], np.int64) - runs
        slot = np.arange(len(shard)) + np.repeat(base, lengths)
        out = pa.RecordBatch.from_arrays(
            [cols["doc_id"], pa.array(cols["size"]), pa.array(cols["crc"]), pa.array(shard), pa.array(slot)], names=[x.split()[0] for x in ROWS.split(", ")]
        )
        yield from (out.slice(i, 65_536) for i in range(0, out.num_rows, 65_536))

    return ordered.mapInArrow(rows, ROWS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
