"""Keyed materialization of embeddings: hits from a cache table, distinct misses encoded once, results fanned out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.functions.vectors import is_valid

Encoder = Callable[[list[str]], np.ndarray]


def cache_key(model: str, text: Column) -> Column:
    """sha256 of model, a zero byte and the text; null for blank texts."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) != "", F.sha2(F.concat(F.lit(f"{model}\0"), text), 256))


def encode_column(make_encoder: Callable[[], Encoder]) -> Callable[[Column], Column]:
    """Arrow UDF around a user-supplied encoder; the encoder is made once per task, not per batch."""

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for texts in batches:
            yield pd.Series([np.asarray(v, dtype=float) for v in encoder(list(texts))])

    return encode


def fill(
    df: DataFrame, text: str, cache: DataFrame, model: str, dim: int, make_encoder: Callable[[], Encoder]
) -> tuple[DataFrame, DataFrame]:
    """(rows with ``embedding`` and ``from_cache``, new cache rows). ``cache`` holds (key, model_name, embedding).

    Only distinct texts missing from the cache reach the encoder; vectors of a wrong dimension or with non-finite
    components are not cached and leave the row without an embedding.
    """
    keyed = df.withColumn("_key", cache_key(model, F.col(text)))
    usable = cache.filter((F.col("model_name") == model) & is_valid("embedding", dim)).select(
        F.col("key").alias("_key"), F.col("embedding").alias("_hit")
    )
    wanted = keyed.filter(F.col("_key").isNotNull()).groupBy("_key").agg(F.first(text).alias("_text"))
    missing = wanted.join(usable.select("_key"), "_key", "left_anti")
    # encoders are slow and rows are wide: spread the misses before encoding
    encoded = missing.repartition("_key").withColumn("embedding", encode_column(make_encoder)(F.col("_text")))
    fresh = encoded.filter(is_valid("embedding", dim)).select(
        F.col("_key").alias("key"), F.lit(model).alias("model_name"), "embedding"
    )
    both = usable.select("_key", F.col("_hit").alias("embedding"), F.lit(True).alias("from_cache")).unionByName(
        fresh.select(F.col("key").alias("_key"), "embedding", F.lit(False).alias("from_cache"))
    )
    return keyed.join(both, "_key", "left").drop("_key"), fresh


def usable_cached(df: DataFrame, required: Sequence[str], failed: Column, model: Column) -> DataFrame:
    """Cached rows that still count: every required column present, no failure flag, same model or feature list."""
    complete = ~F.exists(F.array(*[F.col(c).isNull() for c in required]), lambda missing: missing)
    return df.filter(complete & ~F.coalesce(failed, F.lit(False)) & model)
