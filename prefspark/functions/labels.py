"""Label algebra: decision words, tiers, correction types, priorities and the decision policy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefspark.functions.numeric import clamp01, half_up

# fixed values: accepted spellings of each decision
DECISION_WORDS = {
    "LIKE": ("CURTIR", "LIKE"),
    "PASS": ("NÃO CURTIR", "NAO CURTIR", "PASSAR", "PASS"),
    "MAYBE": ("TALVEZ", "MAYBE"),
    "SUPER": ("SUPER_LIKE", "SUPER LIKE", "SUPERLIKE", "SUPER-CURTIR", "SUPER"),
}
TIERS = ("strong_like", "like", "maybe", "pass", "filtered_pass")
CORRECTIONS = ("none", "false_positive", "false_negative", "superlike_upgrade", "uncertain")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _text(c: Column | str | None) -> Column:
    if c is None:
        return F.lit("")
    return F.coalesce(F.trim(_col(c).cast("string")), F.lit(""))


def normalize_decision(c: Column | str) -> Column:
    """LIKE / PASS / MAYBE / SUPER, or the trimmed upper-case word itself."""
    word = F.upper(_text(c))
    out = F
    for canonical, spellings in DECISION_WORDS.items():
        out = out.when(word.isin(*spellings), canonical)
    return out.otherwise(word)


def decision_to_label(c: Column | str) -> Column:
    """1 for likes, 0 for the rest; null (untrainable) for maybe and blank."""
    d = normalize_decision(c)
    return F.when(d.isin("LIKE", "SUPER"), 1).when(d.isin("", "MAYBE"), F.lit(None).cast("int")).otherwise(0)


def label_to_decision(c: Column | str) -> Column:
    """Inverse of ``decision_to_label``, also accepting decision words."""
    word = F.upper(_text(c))
    return (
        F.when(word.isin("", "MAYBE", "TALVEZ"), "MAYBE")
        .when(word.isin("1", "1.0") | normalize_decision(word).isin("LIKE", "SUPER"), "LIKE")
        .otherwise("PASS")
    )


def detail(details: Column | str, key: str) -> Column:
    """One value of the feedback details JSON, '' when absent or unparsable."""
    return F.coalesce(F.get_json_object(_col(details), f"$.{key}"), F.lit(""))


def has_detail(details: Column | str, *keys: str) -> Column:
    """True when any key carries a non-empty value. The JSON is parsed once, however many keys are asked for."""
    parsed = F.from_json(_col(details), "map<string,string>")
    found = F.map_filter(parsed, lambda k, v: k.isin(*keys) & ~F.coalesce(v, F.lit("")).isin("", "[]", "{}", "false", "0"))
    return F.coalesce(F.size(found) > 0, F.lit(False))


def preference_tier(
    decision: Column | str,
    label: Column | str | None = None,
    details: Column | str | None = None,
    reason: Column | str | None = None,
    explicit: Column | str | None = None,
) -> Column:
    """Ordered ladder: explicit tier, maybe, strong like, absolute filter, like, pass, ''."""
    d, lab = normalize_decision(decision), F.lower(_text(label))
    target = detail(details, "target_action") if details is not None else F.lit("")
    return (
        F.when(_text(explicit).isin(*TIERS), _text(explicit))
        .when((d == "MAYBE") | (lab == "maybe"), "maybe")
        .when((d == "SUPER") | (target == "super_like"), "strong_like")
        .when(F.lower(_text(reason)).contains("filtro_absoluto"), "filtered_pass")
        .when(lab.isin("1", "1.0") | (d == "LIKE"), "like")
        .when(lab.isin("0", "0.0") | (d == "PASS"), "pass")
        .otherwise("")
    )


def correction_type(
    tier: Column, model_decision: Column | str, final_decision: Column | str, explicit: Column | str | None = None
) -> Column:
    """How the human corrected the model."""
    model, final = normalize_decision(model_decision), normalize_decision(final_decision)
    strong = (final == "SUPER") | (tier == "strong_like")
    return (
        F.when(_text(explicit).isin(*CORRECTIONS), _text(explicit))
        .when(tier == "maybe", "uncertain")
        .when(strong & (model != "SUPER"), "superlike_upgrade")
        .when(strong, "none")
        .when((model == "LIKE") & (final == "PASS"), "false_positive")
        .when((model == "PASS") & (final == "LIKE"), "false_negative")
        .otherwise("none")
    )


def uncertainty(p: Column) -> Column:
    """1 at probability one half, 0 at certainty."""
    return 1.0 - F.abs(p - 0.5) * 2.0


def review_priority(p: Column | str, correction: Column | str | None = None) -> Column:
    """Uncertain items first, with floors for corrected ones."""
    base = 0.35 + 0.55 * uncertainty(clamp01(p, 0.5))
    kind = _text(correction)
    floor = F.when(kind.isin("false_positive", "false_negative", "uncertain"), 0.90).when(
        kind == "superlike_upgrade", 0.75
    ).otherwise(0.0)
    return half_up(clamp01(F.greatest(base, floor), 0.5), 4)


@dataclass(frozen=True)
class DecisionPolicy:
    """Shipped defaults of the decision policy."""

    fallback_threshold: float = 0.48
    band: tuple[float, float] = (0.40, 0.60)
    learned_range: tuple[float, float] = (0.45, 0.55)
    precision_floor: float = 0.55
    target_recall: float = 0.88


def usable_threshold(learned: Column, policy: DecisionPolicy = DecisionPolicy()) -> Column:
    """A learned threshold counts only inside the trusted range."""
    return F.when(learned.between(*policy.learned_range), learned).otherwise(F.lit(policy.fallback_threshold))


def apply_policy(
    p: Column | str,
    threshold: Column | float,
    forced_pass: Column | None = None,
    policy: DecisionPolicy = DecisionPolicy(),
) -> dict[str, Column]:
    """Decision, tier, correction type and priority of a probability."""
    prob, forced = clamp01(p, 0.5), F.coalesce(forced_pass, F.lit(False)) if forced_pass is not None else F.lit(False)
    in_band = prob.between(*policy.band)
    like = ~forced & (prob >= threshold)
    correction = F.when(~forced & in_band, "uncertain").otherwise("none")
    priority = review_priority(prob, correction)
    return {
        "decision": F.when(like, "LIKE").otherwise("PASS"),
        "in_review_band": in_band,
        "ranking_score": half_up(prob, 4),
        "review_priority": F.when(in_band, F.greatest(priority, F.lit(0.85))).otherwise(priority),
        "preference_tier": F.when(forced, "filtered_pass").when(like, "like").otherwise("pass"),
        "correction_type": correction,
    }


def confidence(p: Column | str, decision: Column | str) -> Column:
    """Probability of the decision taken."""
    return F.when(normalize_decision(decision).isin("LIKE", "SUPER"), _col(p)).otherwise(1.0 - _col(p))


def offer_calibration(p: Column, model: Column, final: Column, has_target: Column, minimum: float = 0.80) -> Column:
    """Confident model, disagreeing human, and something concrete to calibrate on."""
    return (confidence(p, model) >= minimum) & (label_to_decision(model) != label_to_decision(final)) & has_target
