"""Scoring expressions: blends, floors, adjustments, confidence caps, gates, reasons and rescoring."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.functions.numeric import clamp01, half_up


@dataclass(frozen=True)
class ScoringConfig:
    """Shipped weights and limits of the scoring step."""

    preference_weight: float = 0.40
    asset_model_weight: float = 0.35
    max_drag: float = 0.12
    asset_weight: float = 0.85
    text_weight: float = 0.15
    meta_weight: float = 0.0
    distance_weight: float = 0.08
    max_confidence: float = 0.92
    strong_confidence: float = 0.95
    disagreement_confidence: float = 0.78
    weak_confidence: float = 0.84
    safety: bool = True


def text_score(model: Column, preference: Column, negative: Column, config: ScoringConfig = ScoringConfig()) -> dict[str, Column]:
    """Model and preference blended; text is a plus, so without an explicit negative signal it never pulls below 0.5."""
    weight = config.preference_weight
    raw = half_up(clamp01(model * (1.0 - weight) + preference * weight), 4)
    return {"text_raw": raw, "text_score": F.when(negative, raw).otherwise(F.greatest(F.lit(0.5), raw))}


def head_blend(model: Column, heuristic: Column, favourable: Column, config: ScoringConfig = ScoringConfig()) -> Column:
    """Asset score: model and heuristic blended, with a floor below the heuristic when the evidence is favourable.
    Without a model the heuristic stands alone.
    """
    weight = config.asset_model_weight
    blend = clamp01(model * weight + heuristic * (1.0 - weight))
    floored = F.when(favourable, F.greatest(blend, clamp01(heuristic - config.max_drag))).otherwise(blend)
    return half_up(F.when(model.isNull(), heuristic).otherwise(floored), 4)


def combine(asset: Column, text: Column, meta: Column | None = None, config: ScoringConfig = ScoringConfig()) -> Column:
    """Weighted decision score, optionally mixed with the stacked model."""
    total = config.asset_weight + config.text_weight
    a, b = (config.asset_weight / total, config.text_weight / total) if total > 0 else (0.85, 0.15)
    weighted = clamp01(asset * a + text * b)
    if meta is None or config.meta_weight <= 0:
        return half_up(weighted, 4)
    m = config.meta_weight
    mixed = clamp01(weighted * (1.0 - m) + clamp01(meta) * m)
    return half_up(F.when(meta.isNull(), weighted).otherwise(mixed), 4)


def distance_adjust(p: Column, score: Column, missing: Column, config: ScoringConfig = ScoringConfig()) -> Column:
    """Soft shift by how well the distance fits; none when it is unknown."""
    return F.when(missing, p).otherwise(clamp01(p + (clamp01(score, 0.5) - 0.5) * config.distance_weight))


def confidence_cap(
    text: Column, asset: Column, text_model: Column, asset_model: Column, strong_evidence: Column, partial: Column, config: ScoringConfig = ScoringConfig()
) -> dict[str, Column]:
    """Upper limit of the shown confidence, and why."""

    def strength(c: Column) -> Column:
        return F.abs(c - 0.5)

    disagree = (text >= 0.5) != (asset >= 0.5)
    strong = strong_evidence
    for c in (text, asset, text_model, asset_model):
        strong = strong & (strength(c) >= 0.20)
    weak = (strength(text) < 0.08) | (strength(asset) < 0.08) | partial
    cap = (
        F.when(disagree, config.disagreement_confidence)
        .when(strong, config.strong_confidence)
        .when(weak, config.weak_confidence)
        .otherwise(config.max_confidence)
    )
    reason = F.when(disagree, "heads disagree").when(strong, "strong agreement").when(weak, "weak evidence").otherwise("default cap")
    return {"cap": F.greatest(F.lit(0.51), F.least(F.lit(0.99), cap)), "cap_reason": reason}


def probability_safety(p: Column, cap: Column, config: ScoringConfig = ScoringConfig()) -> dict[str, Column]:
    """Cap applied symmetrically around one half; the raw value is kept. The side of the decision never changes."""
    raw = clamp01(p)
    safe = F.when(raw >= 0.5, F.least(raw, cap)).otherwise(F.greatest(raw, 1.0 - cap)) if config.safety else raw
    return {"probability": half_up(safe, 4), "raw_probability": half_up(raw, 4), "capped": F.abs(safe - raw) > 1e-6}


@dataclass(frozen=True)
class StrongGate:
    """Minimums a like must reach to become a strong like."""

    probability: float = 0.80
    text: float = 0.70
    asset: float = 0.70
    strong_probability: float = 0.0
    distance: tuple[float, float] = (0.0, 35.0)
    require_distance: bool = True
    require_balance: bool = True


def strong_gate(
    is_like: Column, p: Column, text: Column, asset: Column, strong_p: Column, distance: Column, balance: Column, gate: StrongGate = StrongGate()
) -> Column:
    """First reason a like stays an ordinary like; null when it passes every rung."""
    low, high = gate.distance
    reason = F.when(~is_like, "not a like").when(p < gate.probability, "probability").when(text < gate.text, "text score")
    reason = reason.when(asset < gate.asset, "asset score")
    if gate.strong_probability > 0:
        reason = reason.when(strong_p < gate.strong_probability, "strong probability")
    if gate.require_distance:
        reason = reason.when(distance.isNull(), "distance unknown")
    reason = reason.when(distance.isNotNull() & ~distance.between(low, high), "distance out of range")
    if gate.require_balance:
        reason = reason.when(~F.coalesce(balance, F.lit(False)), "no balance")
    return reason


@dataclass(frozen=True)
class ReasonRule:
    """A fact worth telling: shown in ``group`` when ``condition`` (a SQL predicate over the row) holds."""

    group: str
    condition: str
    text: str


def reason_groups(rules: Sequence[ReasonRule], top: int = 5) -> dict[str, Column]:
    """Per group the texts of the first ``top`` rules that hold, in rule order and without repeats."""
    out = {}
    for group in dict.fromkeys(r.group for r in rules):
        hits = [F.when(F.expr(r.condition), r.text) for r in rules if r.group == group]
        out[group] = F.slice(F.array_distinct(F.array_compact(F.array(*hits))), 1, top)
    return out


def rescore_stale(queue: DataFrame, stamp: str, current: Column | str, decision: str, p: str, rescore) -> DataFrame:
    """Pending rows scored by another model are rescored; ``outcome`` tells kept, updated or changed.

    ``rescore`` maps the stale rows to the same rows with ``new_decision`` and ``new_p``.
    """
    now = F.lit(current) if isinstance(current, str) else current
    fresh = queue.filter(F.col(stamp) == now).withColumn("outcome", F.lit("kept"))
    redone = rescore(queue.filter(F.coalesce(F.col(stamp) != now, F.lit(True))))
    outcome = (
        F.when(F.col("new_decision") != F.col(decision), "changed").when(F.col("new_p") != F.col(p), "updated").otherwise("kept")
    )
    updated = redone.withColumn("outcome", outcome).withColumns({decision: F.col("new_decision"), p: F.col("new_p"), stamp: now})
    return fresh.unionByName(updated.drop("new_decision", "new_p"))


def uncertain(p: Column, margin: float = 0.15) -> Column:
    return F.abs(p - 0.5) <= margin


def escalate(df: DataFrame, key: str, p: str, more_available: Column, rescore, margin: float = 0.15) -> DataFrame:
    """Uncertain rows that have more evidence are scored again with it; the rest keep their score.

    ``rescore`` maps the selected rows to (key, new_p).
    """
    again = rescore(df.filter(uncertain(F.col(p), margin) & more_available)).select(key, F.col("new_p").alias("_new"))
    joined = df.join(again, key, "left")
    return joined.withColumns({"escalated": F.col("_new").isNotNull(), p: F.coalesce("_new", p)}).drop("_new")
