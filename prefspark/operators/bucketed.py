"""Ordered computations that survive a hot key.

A plain window sorts all rows of a key in one task. Here a key's rows are cut into buckets of the order column; each
(key, bucket) is computed on its own, and what a bucket needs from earlier ones is carried over through a small edge
table with one row per (key, bucket). Results equal the plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefspark.session import cut_lineage

SECOND = 1_000_000  # order columns of events are whole microseconds
HOUR = 3600 * SECOND
DAY = 24 * HOUR


def with_bucket(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_bucket", F.floor(F.col(order) / F.lit(width)).cast("bigint"))


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: str,
    width: int,
    *,
    previous: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
    last_before: dict[str, Column] | None = None,
    running_sum: dict[str, Column] | None = None,
    row_number: str | None = None,
) -> DataFrame:
    """Add ordered columns per key: ``previous`` (lag 1), ``last`` (last non-null up to and with the row),
    ``last_before`` (strictly before the row), ``running_sum`` (inclusive) and a row number.
    """
    previous, last, last_before, running_sum = previous or {}, last or {}, last_before or {}, running_sum or {}
    keys = list(keys)
    local = Window.partitionBy(*keys, "_bucket").orderBy(order, tie)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    position = F.struct(F.col(order), F.col(tie))

    sources = {f"_p_{n}": c for n, c in previous.items()}
    sources |= {f"_l_{n}": c for n, c in last.items()} | {f"_b_{n}": c for n, c in last_before.items()}
    sources |= {f"_s_{n}": c for n, c in running_sum.items()}
    base = with_bucket(df, order, width).withColumns(sources | {"_one": F.lit(1)})

    edge_aggs, carried = [F.count("*").alias("_n")], [F.sum("_n").over(earlier).alias("_carry_rows")]
    for name in previous:
        edge_aggs.append(F.max_by(F.struct(f"_p_{name}"), position).alias(f"_e_{name}"))
        carried.append(F.last(f"_e_{name}").over(earlier)[f"_p_{name}"].alias(f"_c_{name}"))
    for prefix, names in (("_l_", last), ("_b_", last_before)):
        for name in names:
            value = F.col(prefix + name)
            edge_aggs.append(F.max_by(value, F.when(value.isNotNull(), position)).alias(f"_e_{name}"))
            carried.append(F.last(f"_e_{name}", ignorenulls=True).over(earlier).alias(f"_c_{name}"))
    for name in running_sum:
        edge_aggs.append(F.sum(f"_s_{name}").alias(f"_e_{name}"))
        carried.append(F.sum(f"_e_{name}").over(earlier).alias(f"_c_{name}"))
    edges = base.groupBy(*keys, "_bucket").agg(*edge_aggs).select(*keys, "_bucket", *carried)

    windowed = base.withColumn("_rn", F.row_number().over(local))
    windowed = windowed.withColumns(
        {f"_w_{n}": F.lag(f"_p_{n}").over(local) for n in previous}
        | {f"_w_{n}": F.last(f"_l_{n}", ignorenulls=True).over(upto) for n in last}
        | {f"_w_{n}": F.last(f"_b_{n}", ignorenulls=True).over(before) for n in last_before}
        | {f"_w_{n}": F.sum(f"_s_{n}").over(upto) for n in running_sum}
    )
    joined = windowed.join(edges, [*keys, "_bucket"])
    out = {n: F.when(F.col("_rn") == 1, F.col(f"_c_{n}")).otherwise(F.col(f"_w_{n}")) for n in previous}
    out |= {n: F.coalesce(f"_w_{n}", f"_c_{n}") for n in (*last, *last_before)}
    out |= {n: F.coalesce(f"_c_{n}", F.lit(0)) + F.col(f"_w_{n}") for n in running_sum}
    if row_number:
        out[row_number] = F.coalesce("_carry_rows", F.lit(0)) + F.col("_rn")
    return joined.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def rolling_range(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    lookback: int,
    aggregates: dict[str, Callable[[Window], Column]],
    *,
    include_current: bool = True,
    width: int | None = None,
) -> DataFrame:
    """Aggregates over the trailing range [order - lookback, order] (or strictly before the row's own value).

    Rows that later buckets still look back to are copied into the next bucket as context, so every bucket is
    self-contained; the copies are at most the rows of one lookback per bucket.
    """
    width = max(width or 0, 16 * lookback, 1)
    base = with_bucket(df, order, width)
    end_of_bucket = (F.col("_bucket") + 1) * F.lit(width)
    needed_next = F.col(order) + F.lit(lookback) >= end_of_bucket
    copies = F.when(needed_next, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = base.withColumn("_shift", F.explode(copies)).withColumn("_bucket", F.col("_bucket") + F.col("_shift"))
    window = Window.partitionBy(*keys, "_bucket").orderBy(order).rangeBetween(-lookback, 0 if include_current else -1)
    out = spread.withColumns({n: build(window) for n, build in aggregates.items()})
    return out.filter(F.col("_shift") == 0).drop("_bucket", "_shift")


def with_position(ordered: DataFrame, name: str = "position") -> DataFrame:
    """Rows of a globally ordered frame with their position from 1, without ranking them in one task.

    The sorted partitions are checkpointed; each row adds its place in its partition to the rows of the partitions before,
    one number per partition.
    """
    numbered = cut_lineage(ordered).withColumn(name, F.monotonically_increasing_id())
    part = F.shiftright(name, 33).cast("int")
    counts = sorted(map(tuple, numbered.groupBy(part.alias("part")).count().collect()))
    before, start = [], 0
    for number, rows in counts:
        before += [F.lit(number), F.lit(start)]
        start += rows
    if not before:
        return numbered.withColumn(name, F.lit(0).cast("bigint"))
    own = F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn(name, (F.element_at(F.create_map(*before), part) + own + 1).cast("bigint"))


def kth_value(df: DataFrame, order: str, rank: int, buckets: int = 4096) -> int | None:
    """The ``rank``-th smallest (from 1) of the integer column ``order``, equal values counted each; None without rows.

    Nested histograms (``buckets`` parts per level) narrow the range to a single value, so nothing is sorted or ranked; each
    level brings one row to the driver, and a 64-bit range takes six at most. The range must not pass 63 bits.
    """
    values = df.select(F.col(order).cast("bigint").alias("v")).filter(F.col("v").isNotNull())
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not n:
        return None
    if rank <= 0:
        return low - 1
    rank = min(rank, n)
    while True:
        step = max(-(-(high - low + 1) // buckets), 1)
        inside = values.filter(F.col("v").between(low, high))
        histogram = inside.groupBy(F.expr(f"(v - ({low}L)) div {step}L").alias("part")).agg(F.count("*").alias("n"))
        running = histogram.withColumn("upto", F.sum("n").over(Window.orderBy("part")))  # at most `buckets` rows
        part, count, upto = running.filter(F.col("upto") >= rank).agg(F.min_by(F.struct("part", "n", "upto"), "part").alias("s")).select("s.*").first()
        low, high, rank = low + part * step, low + (part + 1) * step - 1, rank - (upto - count)
        if step == 1:
            return low


def order_cut(df: DataFrame, order: str, share: float) -> int | None:
    """The value of the unique integer column ``order`` at position floor(share * count); None without rows."""
    n = df.filter(F.col(order).isNotNull()).count()
    return kth_value(df, order, int(share * n)) if n else None


def smallest(df: DataFrame, order: str, tie: str, k: int) -> DataFrame:
    """The ``k`` first rows by (order, tie), both integers: two cuts, no rank of all rows. Equal pairs all count as one place."""
    if k <= 0:
        return df.limit(0)
    cut = kth_value(df, order, k)
    if cut is None:
        return df
    below = df.filter(F.col(order) < cut).count()
    last = kth_value(df.filter(F.col(order) == cut), tie, k - below)
    return df.filter((F.col(order) < cut) | ((F.col(order) == cut) & (F.col(tie) <= last)))


def chronological_split(df: DataFrame, order: str, share: float = 0.8) -> DataFrame:
    """Mark the last part of the rows, by position in ``order``, as holdout."""
    cut = order_cut(df, order, share)
    return df.withColumn("is_holdout", F.lit(False) if cut is None else F.col(order) > F.lit(cut))
