"""The wide feature row of an item, and measurement composites."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.functions.attrs import FlagRule, attr_flags
from prefspark.functions.numeric import (
    center_distance,
    clamp01,
    half_up,
    in_range_flag,
    safe_float,
    soft_range,
    tent_score,
    weighted_mean,
)
from prefspark.functions.text import keywords_in, normalize, normalize_key, plain_key, raw_tokens, string_set, word_count


@dataclass(frozen=True)
class FeatureConfig:
    """What the user prefers; every list and range is theirs to set."""

    age_range: tuple[float, float] = (20, 30)
    distance_range: tuple[float, float] = (0, 35)
    distance_soft_max: float | None = None
    min_text_length: int = 20
    positive_keywords: Sequence[str] = ()
    negative_keywords: Sequence[str] = ()
    preferred_tags: Sequence[str] = ()
    disliked_names: Sequence[str] = ()
    flag_rules: tuple[FlagRule, ...] = ()
    measurements: dict[str, float] = field(default_factory=dict)


def list_overlap(tags: Column | str, preferred: Sequence[str], vetoed: Sequence[str] = ()) -> Column:
    """How many tags are on the preferred list; repeats count, vetoed entries do not."""
    skip = {plain_key(v) for v in vetoed}
    wanted = string_set(k for k in map(plain_key, preferred) if k not in skip)
    col = F.col(tags) if isinstance(tags, str) else tags
    return F.size(F.filter(F.transform(col, normalize), lambda t: F.array_contains(wanted, t)))


def lexicon_sentiment(items: DataFrame, lexicon: DataFrame, key: str, text: str) -> DataFrame:
    """Mean polarity of the words found in ``lexicon`` (word, polarity); 0 for texts with none.

    Words are counted per item before the join, so a common word costs one row per item and not one per use.
    """
    # the outer form keeps the optimizer from adding a size(...) > 0 filter, which would tokenize every text twice
    exploded = items.select(key, F.explode_outer(raw_tokens(text)).alias("word")).filter(F.col("word").isNotNull())
    words = exploded.groupBy(key, "word").agg(F.count("*").alias("n"))
    scored = words.join(lexicon, "word").groupBy(key).agg(
        (F.sum(F.col("polarity") * F.col("n")) / F.sum("n")).alias("sentiment")
    )
    return items.select(key).join(scored, key, "left").withColumn(
        "sentiment", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("sentiment", F.lit(0.0))))
    )


def feature_columns(
    config: FeatureConfig,
    *,
    name: Column,
    age: Column,
    distance: Column,
    text: Column,
    tags: Column,
    attrs: Column,
    measurements: dict[str, Column] | None = None,
    sentiment: Column | None = None,
    vetoed_attrs: Column | None = None,
    plain_text: Column | None = None,
) -> dict[str, Column]:
    """All features of one item as numeric columns, neutral where a value is missing. ``plain_text`` is a column with the normalized
    text, for frames that hold it: without it every keyword may normalize the text again."""
    dist = soft_range(distance, *config.distance_range, config.distance_soft_max)
    years = F.coalesce(age.cast("double"), F.lit(0.0))
    body = F.coalesce(text, F.lit(""))
    plain = normalize(body) if plain_text is None else plain_text
    disliked = [plain_key(n) for n in config.disliked_names]
    out = {
        "age_in_range": in_range_flag(years, *config.age_range),
        "age_distance": center_distance(years, *config.age_range),
        "distance": dist["value"],
        "distance_missing": dist["missing"],
        "distance_in_range": dist["in_range"],
        "distance_over": dist["over"],
        "distance_score": dist["score"],
        "text_length": F.length(body),
        "text_words": word_count(body),
        "text_long_enough": (F.length(body) >= config.min_text_length).cast("int"),
        "positive_keywords": keywords_in(plain, config.positive_keywords),
        "negative_keywords": keywords_in(plain, config.negative_keywords),
        "sentiment": sentiment if sentiment is not None else F.lit(0.0),
        "tag_count": F.size(tags),
        "tag_overlap": list_overlap(tags, config.preferred_tags),
        "name_length": F.length(F.trim(F.coalesce(name, F.lit("")))),
        "name_disliked": normalize_key(name).isin(*disliked).cast("int") if disliked else F.lit(0),
    }
    out.update(attr_flags(attrs, config.flag_rules, vetoed_attrs))
    for column, neutral in config.measurements.items():
        given = (measurements or {}).get(column)
        out[column] = safe_float(given, neutral) if given is not None else F.lit(neutral)
    return out


def feature_projection(df: DataFrame, keys: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """One select: keys plus every feature as a double."""
    return df.select(*keys, *[c.cast("double").alias(n) for n, c in columns.items()])


def image_quality(sharpness: Column, brightness: Column, contrast: Column, colorfulness: Column) -> Column:
    return weighted_mean([(sharpness, 0.45), (brightness, 0.25), (contrast, 0.20), (colorfulness, 0.10)])


def nearly_black(brightness: Column, contrast: Column, colorfulness: Column) -> Column:
    """Extreme darkness: nothing useful to see."""
    b, c, f = clamp01(brightness, 0.5), clamp01(contrast, 0.5), clamp01(colorfulness, 0.5)
    return (b <= 0.055) | ((b <= 0.09) & (c <= 0.12) & (f <= 0.12))


def content_score(
    brightness: Column, sharpness: Column, contrast: Column, colorfulness: Column, bonus: Column, failed: Column
) -> Column:
    """Light quality score of an asset: weighted measurements, zero when failed or nearly black."""
    score = (
        tent_score(brightness) * 0.36
        + clamp01(sharpness, 0.5) * 0.24
        + clamp01(contrast, 0.5) * 0.18
        + clamp01(colorfulness, 0.5) * 0.12
        + F.when(bonus, 0.10).otherwise(0.0)
    )
    unusable = failed | nearly_black(brightness, contrast, colorfulness)
    return F.when(unusable, 0.0).otherwise(half_up(clamp01(score), 4))


def quality_gate(failed: Column, brightness: Column, contrast: Column, minimum: float, max_contrast: float = 0.18) -> Column:
    """Reason an asset is rejected for darkness; an unavailable measurement never rejects."""
    dark = (F.coalesce(brightness, F.lit(0.5)) < minimum) & (F.coalesce(contrast, F.lit(0.5)) <= max_contrast)
    return F.when(failed, F.lit(None).cast("string")).when(dark, "too dark")


def needs_backfill(columns: Sequence[str], saved: Column | None = None, sentinel: float | None = None) -> Column:
    """A row is incomplete when never saved, when a column is missing, or when one still holds the neutral sentinel."""
    values = F.array(*[F.col(c).cast("double") for c in columns])
    missing = F.exists(values, lambda x: x.isNull() | (x == sentinel if sentinel is not None else F.lit(False)))
    return missing if saved is None else (missing | ~F.coalesce(saved, F.lit(False)))


def similarity_notes(pairs: Sequence[tuple[Column, Column, float, str]], used_vector: Column, most: int = 4) -> Column:
    """Notes for the measurement groups whose means differ by at most a tolerance; the first few are shown."""
    notes = [F.when(used_vector, "close vector")]
    notes += [F.when(F.abs(a - b) <= tolerance, note) for a, b, tolerance, note in pairs]
    found = F.slice(F.array_compact(F.array(*notes)), 1, most)
    return F.when(F.size(found) == 0, F.array(F.lit("close measurements"))).otherwise(found)
