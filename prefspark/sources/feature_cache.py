"""Features kept by content: only rows whose content is new are computed, the least recently used ones leave.

The cache is a versioned table of (content_hash, features, used), ``used`` being the run that needed the row last. Hashes
cover all columns that the features are made of, so a changed row is a new one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.functions.hashing import SEP
from prefspark.operators.bucketed import smallest
from prefspark.sources import versioned

#: Rows a cache keeps.
MOST_ROWS = 50_000


def content_hash(columns: Sequence[str]) -> Column:
    """sha256 over the columns as JSON, so that null, empty and nested values all differ."""
    return F.sha2(F.concat_ws(SEP, *[F.to_json(F.struct(F.col(c)), {"ignoreNullFields": "false"}) for c in columns]), 256)


def cached_features(
    df: DataFrame, columns: Sequence[str], compute: Callable[[DataFrame], DataFrame], path: str, most: int = MOST_ROWS
) -> tuple[DataFrame, dict[str, int]]:
    """``df`` with ``features``, and how many rows the cache held, were computed and stay.

    ``compute`` maps distinct rows (content_hash and ``columns``) to (content_hash, features).
    """
    spark = df.sparkSession
    keyed = df.withColumn("content_hash", content_hash(columns))
    wanted = keyed.select("content_hash", *columns).dropDuplicates(["content_hash"])
    schema = compute(wanted.limit(0)).select("content_hash", "features").schema.add("used", "long")
    old = versioned.read(spark, path, schema)
    run = (versioned.current(spark, path) or 0) + 1
    missing = wanted.join(old.select("content_hash"), "content_hash", "left_anti")
    fresh = compute(missing).select("content_hash", "features", F.lit(run).cast("long").alias("used"))
    asked = wanted.select("content_hash", F.lit(True).alias("_asked"))
    kept = old.join(asked, "content_hash", "left").select(
        "content_hash", "features", F.when(F.col("_asked"), F.lit(run)).otherwise(F.col("used")).cast("long").alias("used")
    )
    # this run's rows all pass through the new version, also those that the limit will push out in the next
    versioned.write(kept.unionByName(fresh), path, run)
    whole = versioned.read(spark, path, schema)
    counts = whole.agg(F.count("*").alias("all"), F.count_if(F.col("used") == run).alias("used")).first()
    held = old.count()
    found = keyed.join(whole.select("content_hash", "features"), "content_hash", "left").drop("content_hash")
    stats = {"held": held, "computed": counts["all"] - held, "used": counts["used"], "kept": min(counts["all"], most)}
    if counts["all"] > most:
        # the latest runs stay; among rows of one run the hash decides
        newest = smallest(whole.withColumn("_age", -F.col("used")).withColumn("_tie", F.shiftrightunsigned(F.xxhash64("content_hash"), 1)), "_age", "_tie", most)
        versioned.write(newest.drop("_age", "_tie"), path, run + 1)
    return found, stats
