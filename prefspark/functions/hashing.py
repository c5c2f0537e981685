"""Signatures: row, feature and batch digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\x1f"


def row_signature(columns: Sequence[str]) -> Column:
    """sha1 over 'name=value' of the columns in sorted order, null as ''."""
    parts = [F.concat(F.lit(f"{n}="), F.coalesce(F.col(n).cast("string"), F.lit(""))) for n in sorted(columns)]
    return F.sha1(F.concat_ws(SEP, *parts))


def feature_fingerprint(columns: Sequence[str], min_parts: int = 8) -> Column:
    """sha1 of 'name=%.4f' parts in the given order; missing values are left out, '' below ``min_parts``."""
    parts = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double")),
                    F.concat(F.lit(f"{n}="), F.format_string("%.4f", F.col(n).cast("double"))),
                )
                for n in columns
            ]
        )
    )
    return F.when(F.size(parts) < min_parts, "").otherwise(F.sha1(F.array_join(parts, "|")))


def content_hash(c: Column | str) -> Column:
    return F.sha1(F.col(c) if isinstance(c, str) else c)


def _number_of(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)")


def batch_digest(member: Column) -> Column:
    """Aggregate: order-independent digest of the members of a batch.

    Count and two 60-bit digest sums are hashed together. Unlike a sorted, joined list this merges from partial
    aggregates, so a batch of any size never sits in one task.
    """
    digest = F.md5(member)
    return F.sha1(
        F.concat_ws(
            ":",
            F.count(member).cast("string"),
            F.sum(_number_of(digest, 1)).cast("string"),
            F.sum(_number_of(digest, 16)).cast("string"),
        )
    )
