"""Session summaries: decision counts, mean scores by outcome, top tags and advice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefspark.functions.numeric import half_up

# fixed values: when a session is long enough to advise, and the rates that trigger advice
MIN_PROMPTS, MANY_CORRECTIONS, FEW_CORRECTIONS = 10, 0.35, 0.15


def session_aggregates(score: str) -> list[Column]:
    like, moved = F.col("final") == "LIKE", F.col("final") != F.col("model")
    return [
        F.count("*").alias("total"),
        F.count_if(like).alias("likes"),
        F.count_if("super").alias("super_likes"),
        F.count_if(~like).alias("passes"),
        F.count_if(F.col("model") == "LIKE").alias("model_likes"),
        F.count_if("prompted").alias("prompts"),
        F.count_if(moved).alias("corrected"),
        F.count_if(moved & like).alias("corrected_to_like"),
        half_up(F.avg(F.when(like, F.col(score))), 4).alias("like_score"),
        half_up(F.avg(F.when(~like, F.col(score))), 4).alias("pass_score"),
    ]


def session_rates() -> dict[str, Column]:
    prompts, rate = F.col("prompts"), F.when(F.col("prompts") > 0, F.col("corrected") / F.col("prompts")).otherwise(0.0)
    advice = F.when((prompts >= MIN_PROMPTS) & (rate >= MANY_CORRECTIONS), "train more").when(
        (prompts >= MIN_PROMPTS) & (rate <= FEW_CORRECTIONS), "well aligned"
    )
    return {
        "like_rate": half_up(F.when(F.col("total") > 0, F.col("likes") / F.col("total")).otherwise(0.0), 4),
        "correction_rate": half_up(rate, 4),
        "advice": advice.otherwise(""),
    }


def top_values(df: DataFrame, keys: Sequence[str], value: str, top: int, name: str) -> DataFrame:
    """'value (count), ...' of the most frequent values per key; ties by value."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), value)
    kept = counted.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= top)
    entry = F.concat(F.col(value), F.lit(" ("), F.col("n"), F.lit(")"))
    listed = F.sort_array(F.collect_list(F.struct("rn", entry.alias("entry"))))  # at most `top` entries
    return kept.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda e: e["entry"]), ", ").alias(name))


def session_summary(df: DataFrame, keys: Sequence[str], score: str, tag: str, top: int = 5) -> DataFrame:
    """One row per session from decision rows (final, model, super, prompted, a score and a tag)."""
    counts = df.groupBy(*keys).agg(*session_aggregates(score))
    return counts.withColumns(session_rates()).join(top_values(df, keys, tag, top, "top_tags"), list(keys), "left")
