"""Joins: stage tagging, lookups by preference, positional pairing, membership, similar items, targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefspark.operators.bucketed import ordered_scan
from prefspark.operators.keys import first_stage, matching_ids

# fixed values: scores of a calibration target hit, by kind
TARGET_SCORES = {"interest": 0.86, "bio": 0.80, "descriptor": 0.88}
MEASURED_MINIMUM, EXTRA_HIT, TARGET_SHARE = 0.58, 0.035, 0.70


def enqueue_stages(
    candidates: DataFrame, id_column: str, filtered: Column, probe: DataFrame, queue: DataFrame, trained: DataFrame
) -> DataFrame:
    """Tag candidates: 'filtered', 'in_queue', 'trained' or 'new', in this order. The key frames hold (id,) kind, key."""
    known = queue.select("kind", "key", F.lit(1).alias("stage")).unionByName(trained.select("kind", "key", F.lit(2).alias("stage")))
    found = first_stage(probe, known, id_column, "stage")
    stage = F.when(filtered, "filtered").when(F.col("stage") == 1, "in_queue").when(F.col("stage") == 2, "trained")
    return candidates.join(found, id_column, "left").withColumn("stage", stage.otherwise("new"))


def asset_lookup(rows: DataFrame, assets: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Best asset per row: own folder first, then originals before aliases, then the newest, then by path.

    ``assets`` has (keys..., liked, alias, mtime, path). Candidates are first reduced to the best one per key and folder,
    so a key with very many assets costs one row per folder in the join.
    """
    order = F.struct(F.col("alias"), (-F.col("mtime")).alias("newest"), F.col("path"))
    best = assets.groupBy(*keys, "liked").agg(F.min(order).alias("best"))
    per_key = best.groupBy(*keys).agg(
        F.max(F.when(F.col("liked"), F.col("best.path"))).alias("_liked"), F.max(F.when(~F.col("liked"), F.col("best.path"))).alias("_other")
    )
    wanted = F.when(F.col(label) == 1, F.coalesce("_liked", "_other")).otherwise(F.coalesce("_other", "_liked"))
    return rows.join(per_key, list(keys), "left").withColumn("asset", wanted).drop("_liked", "_other")


def pair_by_position(
    targets: DataFrame, assets: DataFrame, keys: Sequence[str], target_order: str, asset_order: str, width: int
) -> DataFrame:
    """The n-th asset of a key goes to the n-th target row of that key."""
    left = ordered_scan(targets, keys, target_order, target_order, width, row_number="_n")
    right = ordered_scan(assets, keys, asset_order, asset_order, width, row_number="_n")
    return left.join(right, [*keys, "_n"], "left").drop("_n")


def active_members(rows: DataFrame, id_column: str, probe_keys: DataFrame, active_keys: DataFrame) -> DataFrame:
    """Flag rows sharing any key with the active set; everything is active while the set is empty."""
    hits = matching_ids(probe_keys, active_keys, id_column).withColumn("_hit", F.lit(True))
    size = active_keys.limit(1).agg(F.count("*")).scalar()
    joined = rows.join(hits, id_column, "left").withColumn("_active", size)
    return joined.withColumn("is_active", F.coalesce("_hit", F.lit(False)) | (F.col("_active") == 0)).drop("_hit", "_active")


def similar_topk(
    sources: DataFrame, candidates: DataFrame, block: str, id_column: str, score, most: int = 6, minimum: float = 0.46
) -> DataFrame:
    """For each source the most similar candidates of its block, itself excluded.

    There is one source row per review being judged, so a block yields one scored pair per candidate; the top-k is
    cut per input partition before the rows are shuffled (window group limit).
    """
    src = sources.select([F.col(c).alias(f"src_{c}") for c in sources.columns])
    pairs = candidates.join(src, (F.col(block) == F.col(f"src_{block}")) & (F.col(id_column) != F.col(f"src_{id_column}")))
    scored = pairs.withColumn("similarity", score).filter(F.col("similarity") >= minimum)
    order = Window.partitionBy(f"src_{id_column}").orderBy(F.desc("similarity"), id_column)
    ranked = scored.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= most)
    return ranked.select(F.col(f"src_{id_column}").alias("source_id"), F.col(id_column).alias("candidate_id"), "position", "similarity")


def target_scores(targets: DataFrame, candidate_items: DataFrame, id_column: str) -> DataFrame:
    """Score candidates against calibration targets (kind, norm): mean hit score plus a bonus per extra hit.

    ``candidate_items`` holds the distinct (id, kind, norm) of the candidates.
    """
    worth = F.create_map(*[x for k, v in TARGET_SCORES.items() for x in (F.lit(k), F.lit(v))])
    hits = candidate_items.join(targets, ["kind", "norm"]).withColumn("hit", worth[F.col("kind")])
    scored = hits.groupBy(id_column).agg(F.avg("hit").alias("mean_hit"), F.count("*").alias("hits"))
    return scored.withColumn(
        "target_score", F.least(F.lit(1.0), F.col("mean_hit") + (F.col("hits") - 1) * F.lit(EXTRA_HIT))
    ).drop("mean_hit")


def blend_target(target: Column, similarity: Column) -> Column:
    return F.least(F.lit(1.0), target * TARGET_SHARE + similarity * (1.0 - TARGET_SHARE))
