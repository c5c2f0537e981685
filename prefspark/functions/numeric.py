"""Numeric column builders: parsing, clipping, range features, weighted means, score words."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NEUTRAL = 0.5


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(c: Column | str, digits: int) -> Column:
    """Round half up on the decimal value, so binary noise below 1e-10 cannot flip a tie."""
    return F.round(_col(c).cast("decimal(24,10)"), digits).cast("double")


def safe_float(c: Column | str, default: float | Column | None = None) -> Column:
    """Parse to double; blank, unparsable, NaN and infinite values become ``default``."""
    x = _col(c).cast("string").try_cast("double")
    usable = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.when(usable, x).otherwise(default if isinstance(default, Column) else F.lit(default).cast("double"))


def clamp01(c: Column | str, default: float = 0.0) -> Column:
    """Clip into [0, 1]; missing values take ``default`` (which is not clipped)."""
    x = _col(c)
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))  # these skip nulls, so missing is decided first
    return F.when(x.isNull(), F.lit(float(default))).otherwise(clipped)


def clean_numeric_token(c: Column | str) -> Column:
    """'2.0' -> '2', 'nan' and blank -> '', anything else trimmed."""
    text = F.trim(_col(c).cast("string"))
    number = text.try_cast("double")
    whole = number.isNotNull() & (number == F.floor(number)) & (F.abs(number) < F.lit(1e15))
    return (
        F.when(text.isNull() | (text == "") | (F.lower(text) == "nan"), F.lit(""))
        .when(whole, number.try_cast("bigint").cast("string"))
        .otherwise(text)
    )


def truthy(c: Column | str) -> Column:
    # fixed values: words that count as true
    return F.lower(clean_numeric_token(c)).isin("1", "true", "yes", "sim")


def in_range_flag(c: Column | str, low: float, high: float) -> Column:
    return _col(c).between(low, high).cast("int")


def center_distance(c: Column | str, low: float, high: float) -> Column:
    """Distance from the middle of the range, in half-widths (at least one unit)."""
    return F.abs(_col(c) - F.lit((low + high) / 2.0)) / F.lit(max((high - low) / 2.0, 1.0))


def soft_range(c: Column | str, low: float, high: float, soft_high: float | None = None) -> dict[str, Column]:
    """Soft upper range: 1 inside, falling linearly to 0 at ``soft_high``; missing is neutral and flagged."""
    low, high = min(low, high), max(low, high)
    soft_high = max(soft_high if soft_high is not None else high * 1.7, high + 1.0)
    known = safe_float(c)
    x = F.greatest(F.lit(0.0), known)
    missing = known.isNull()
    over = clamp01(F.greatest(F.lit(0.0), x - high) / F.lit(max(soft_high - high, 1.0)))
    score = F.when(x < low, clamp01(x / F.lit(max(low, 1.0)))).when(x <= high, F.lit(1.0)).otherwise(1.0 - over)
    return {
        "value": F.when(missing, 0.0).otherwise(half_up(x, 4)),
        "missing": missing.cast("int"),
        "in_range": F.when(missing, 0).otherwise(x.between(low, high).cast("int")),
        "over": F.when(missing, 0.0).otherwise(half_up(over, 4)),
        "score": F.when(missing, NEUTRAL).otherwise(half_up(score, 4)),
    }


def tent_score(c: Column | str, center: float = 0.52) -> Column:
    """1 at ``center``, falling linearly on both sides, clipped."""
    x = clamp01(c)
    return clamp01(1.0 - F.abs(x - center) / center)


def weighted_mean(pairs: Iterable[tuple[Column, float | Column]], neutral: float = NEUTRAL) -> Column:
    """sum(v*w)/sum(w) over positive weights; neutral when no weight is left."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for value, w in pairs:
        w = w if isinstance(w, Column) else F.lit(float(w))
        total = total + F.when(w > 0, value * w).otherwise(0.0)
        weight = weight + F.when(w > 0, w).otherwise(0.0)
    return F.when(weight > 0, total / weight).otherwise(F.lit(neutral))


def word_by_cuts(c: Column | str, cuts: Sequence[tuple[float, str]], lowest: str) -> Column:
    """Word of the first cut point (descending) the clipped value reaches."""
    x = clamp01(c)
    out = None
    for cut, word in cuts:
        out = F.when(x >= cut, word) if out is None else out.when(x >= cut, word)
    return out.otherwise(lowest)


# fixed values: cut points of the score words
SCORE_WORDS = ((0.72, "high"), (0.58, "good"), (0.43, "neutral"), (0.28, "low"))


def score_label(c: Column | str) -> Column:
    return word_by_cuts(c, SCORE_WORDS, "very low")


# fixed values: upper edges and fractional memberships (small, medium, large) of the soft buckets
SOFT_BUCKETS = (
    (0.36, (1.0, 0.0, 0.0)),
    (0.48, (0.5, 0.5, 0.0)),
    (0.58, (0.0, 1.0, 0.0)),
    (0.66, (0.0, 0.5, 0.5)),
    (float("inf"), (0.0, 0.0, 1.0)),
)


def soft_bucket(c: Column | str, quality: Column | str, min_quality: float = 0.35) -> list[Column]:
    """Fractional membership of (small, medium, large); all zero when the signal quality is low."""
    x, enough = clamp01(c), _col(quality) >= min_quality
    columns = []
    for position in range(3):
        share = None
        for edge, shares in SOFT_BUCKETS:
            hit = x < edge if edge != float("inf") else F.lit(True)
            share = F.when(hit, shares[position]) if share is None else share.when(hit, shares[position])
        columns.append(F.when(enough, share).otherwise(0.0))
    return columns


def miles_to_km(c: Column | str) -> Column:
    """Whole kilometres; null stays null."""
    return half_up(_col(c) * F.lit(1.609), 0)


def age_years(birth: Column | str, as_of: Column | str) -> Column:
    """Whole years between an ISO birth date and ``as_of``; blank or unparsable gives 0."""
    born = F.try_to_timestamp(_col(birth).cast("string")).cast("date")
    now = _col(as_of).cast("date")
    before_birthday = F.date_format(now, "MMdd") < F.date_format(born, "MMdd")
    return F.coalesce(F.year(now) - F.year(born) - before_birthday.cast("int"), F.lit(0))


def within_schedule(ts: Column | str, days: Sequence[int], start: str, end: str) -> Column:
    """Weekday (0 = Monday) listed and minute of day in [start, end]; end <= start wraps midnight."""
    t = _col(ts)
    begin, finish = (int(v[:2]) * 60 + int(v[3:5]) for v in (start, end))
    minute = F.hour(t) * 60 + F.minute(t)
    inside = (minute >= begin) | (minute <= finish) if finish <= begin else minute.between(begin, finish)
    return F.weekday(t).isin(*days) & inside


def neutral_fill(failed: Column, columns: dict[str, tuple[Column, float]]) -> dict[str, Column]:
    """Failed or absent measurements become their neutral constant instead of zero."""
    return {n: F.when(failed, neutral).otherwise(F.coalesce(c, F.lit(neutral))) for n, (c, neutral) in columns.items()}
