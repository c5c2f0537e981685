"""Vector operators: centroids, centroid similarity, group aggregates, measurement roll-ups, PCA projection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.functions.numeric import half_up
from prefspark.functions.vectors import as_doubles, cosine, is_valid, norm

MIN_LIKED = 5  # fixed value: centroids of fewer vectors say nothing
BLOCK_ROWS = 2048


def valid_vectors(df: DataFrame, vector: str, dim: int | None = None, min_dim: int = 16, model: Column | None = None) -> DataFrame:
    """Rows whose vector has the expected length (and model) and only finite components."""
    usable = df.filter(is_valid(vector, dim, min_dim))
    return usable if model is None else usable.filter(model)


def class_centroid(df: DataFrame, label: Sequence[str] | str, vector: str) -> DataFrame:
    """Mean vector and count per class; the mean is a mergeable partial aggregate."""
    keys = [label] if isinstance(label, str) else list(label)
    staged = df.select(*keys, array_to_vector(as_doubles(vector)).alias("_v"))
    return staged.groupBy(*keys).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("centroid"), F.count("*").alias("n"))


def centroid_similarity(df: DataFrame, vector: str, liked: Column) -> DataFrame:
    """(cosine to the liked centroid + 1) / 2; neutral with too few likes, a missing vector or another dimension."""
    centroid = class_centroid(df.filter(liked & F.col(vector).isNotNull()).withColumn("_c", F.lit(1)), "_c", vector)
    liked_side = centroid.select(F.struct("centroid", "n")).scalar()  # null without likes
    known = df.withColumn("_liked", liked_side).select("*", F.col("_liked.centroid").alias("centroid"), F.col("_liked.n").alias("n"))
    comparable = (F.col("n") >= MIN_LIKED) & (F.size(vector) == F.size("centroid")) & F.col(vector).isNotNull()
    score = F.when(F.coalesce(comparable, F.lit(False)), half_up((cosine(vector, "centroid") + 1.0) / 2.0, 4)).otherwise(0.5)
    return known.withColumn("similarity", score).drop("_liked", "centroid", "n")


def _runs(frame: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Start offsets of the runs of equal keys in a sorted frame."""
    values = frame[list(keys)]
    changed = (values != values.shift()).any(axis=1).to_numpy()
    return np.flatnonzero(changed)


def max_pair_cosine(df: DataFrame, group: str, id_column: str, vector: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Largest cosine between two different vectors of each group, exactly.

    A group is spread over blocks of about ``block_rows`` vectors and every pair of blocks is one matrix product that
    leaves only its maximum, so no pair is ever a row and no task holds more than two blocks. Groups holding a repeated
    vector are answered (1.0) before that. Larger groups cost one copy per block, which is what an exact answer needs.
    """
    length = norm(vector)
    unit = F.transform(as_doubles(vector), lambda x: x / F.col("_len"))
    units = df.withColumn("_len", length).filter(F.col("_len") > 0).select(group, id_column, unit.alias("u"))
    hashed = units.withColumn("_h", F.xxhash64("u")).groupBy(group, "_h").agg(F.count("*").alias("c"))
    sizes = hashed.groupBy(group).agg(F.sum("c").alias("n"), F.max("c").alias("copies"))
    exact = sizes.filter("copies > 1").select(group, F.lit(1.0).alias("max_cosine"))
    open_groups = sizes.filter("copies = 1 AND n > 1").select(group, F.ceil(F.col("n") / F.lit(block_rows)).cast("int").alias("blocks"))
    placed = units.join(open_groups, group).withColumn("b", F.pmod(F.xxhash64(id_column), F.col("blocks")).cast("int"))
    partners = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("b")).alias("i"), F.greatest(o, F.col("b")).alias("j")))
    spread = placed.select(group, "b", "u", F.inline(partners))
    keys = [group, "i", "j"]
    ordered = spread.repartition(*keys).sortWithinPartitions(*keys)

    def best(frame: pd.DataFrame) -> float:
        first = frame["b"].to_numpy() == frame["i"].to_numpy()
        left = np.vstack(frame["u"].to_numpy()[first]) if first.any() else np.zeros((0, 1))
        if frame["i"].iloc[0] == frame["j"].iloc[0]:
            if len(left) < 2:
                return -np.inf
            product = left @ left.T
            np.fill_diagonal(product, -np.inf)
            return float(product.max())
        right = np.vstack(frame["u"].to_numpy()[~first]) if (~first).any() else np.zeros((0, 1))
        return float((left @ right.T).max()) if len(left) and len(right) else -np.inf

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for frame in batches:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            starts = _runs(frame, keys)
            if not len(starts):
                continue
            done = [frame.iloc[a:b] for a, b in zip(starts[:-1], starts[1:])]
            held = frame.iloc[starts[-1] :].reset_index(drop=True)
            yield pd.DataFrame([(part[group].iloc[0], best(part)) for part in done], columns=[group, "max_cosine"])
        if held is not None and len(held):
            yield pd.DataFrame([(held[group].iloc[0], best(held))], columns=[group, "max_cosine"])

    schema = f"`{group}` {df.schema[group].dataType.simpleString()}, max_cosine double"
    computed = ordered.mapInPandas(products, schema)
    return computed.unionByName(exact).groupBy(group).agg(F.max("max_cosine").alias("max_cosine"))


def group_vector_aggregate(df: DataFrame, group: str, id_column: str, vector: str, min_dim: int = 16) -> DataFrame:
    """Per group: L2-normalized mean vector, valid count, duplicate score and diversity."""
    usable = valid_vectors(df, vector, min_dim=min_dim)
    means = class_centroid(usable, group, vector)
    length = norm("centroid")
    unit = F.when(length > 0, F.transform("centroid", lambda x: x / length)).otherwise(F.col("centroid"))
    pairs = max_pair_cosine(usable, group, id_column, vector)
    duplicate = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("max_cosine") + 1.0) / 2.0))
    known = F.col("max_cosine").isNotNull() & (F.col("n") >= 2)
    return means.join(pairs, group, "left").select(
        group,
        F.col("n").alias("useful_count"),
        unit.alias("mean_vector"),
        F.when(known, half_up(duplicate, 4)).otherwise(0.0).alias("duplicate_score"),
        F.when(known, half_up(1.0 - duplicate, 4)).otherwise(0.0).alias("diversity"),
    )


def feature_rollup(
    df: DataFrame, group: str, *, failed: Column, flag: Column, value: Column, weight: Column, score: Column, ref: str, neutral: float = 0.5
) -> DataFrame:
    """Many measured assets to one row per item: any, max, mean and weighted mean over the valid ones, best asset,
    failure ratio; neutral values when every asset failed."""
    ok = ~failed
    n, n_ok = F.count("*"), F.count_if(ok)
    valid = F.when(ok, value)
    weighted = F.sum(F.when(ok & (weight > 0), value * weight)) / F.sum(F.when(ok & (weight > 0), weight))
    return df.groupBy(group).agg(
        n.alias("assets"),
        F.coalesce(F.max(F.when(ok, flag.cast("int"))), F.lit(0)).alias("any_flag"),
        F.coalesce(F.max(valid), F.lit(neutral)).alias("max_value"),
        half_up(F.coalesce(F.avg(valid), F.lit(neutral)), 6).alias("mean_value"),
        half_up(F.coalesce(weighted, F.lit(neutral)), 6).alias("weighted_value"),
        F.max_by(F.col(ref), F.when(ok, F.struct(score, F.col(ref)))).alias("best_ref"),
        half_up(F.count_if(failed) / n, 4).alias("failure_ratio"),
        (n_ok == 0).alias("all_failed"),
    )


def fit_pca(df: DataFrame, vector: str, k: int, dim: int) -> PipelineModel | None:
    """Centered PCA over the valid vectors; None below 2k of them. MLlib's PCA does not center, so a scaler does."""
    usable = valid_vectors(df, vector, dim=dim).select(array_to_vector(as_doubles(vector)).alias("_v"))
    if usable.limit(2 * k).count() < 2 * k:
        return None
    stages = [
        StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_centered"),
        PCA(k=k, inputCol="_centered", outputCol="_pc"),
    ]
    return Pipeline(stages=stages).fit(usable)


def project_pca(df: DataFrame, model: PipelineModel, vector: str, k: int, dim: int, prefix: str = "pc_") -> DataFrame:
    """Component columns ``pc_01`` ..; missing or invalid vectors get NaN in all of them."""
    usable = is_valid(vector, dim)
    zeros = F.array_repeat(F.lit(0.0), dim)
    staged = df.withColumn("_ok", F.coalesce(usable, F.lit(False))).withColumn(
        "_v", array_to_vector(F.when(F.col("_ok"), as_doubles(vector)).otherwise(zeros))
    )
    out = model.transform(staged).withColumn("_a", vector_to_array("_pc"))
    names = {f"{prefix}{i + 1:02d}": F.when(F.col("_ok"), F.col("_a")[i]).otherwise(F.lit(float("nan"))) for i in range(k)}
    return out.withColumns(names).drop("_ok", "_v", "_centered", "_pc", "_a")
