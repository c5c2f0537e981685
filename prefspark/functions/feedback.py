"""Feedback normalization: domains, reasons, intensities, sentiment, domain sets and inference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefspark.functions.labels import detail, has_detail, label_to_decision, normalize_decision
from prefspark.functions.text import parse_list

DOMAINS = ("photo", "interests", "bio", "descriptors", "other")

# fixed values: accepted spellings of the feedback domains
DOMAIN_WORDS = {
    "photo": ("foto", "photo", "fotos"),
    "interests": ("interesse", "interesses", "interest", "interests"),
    "bio": ("bio",),
    "descriptors": ("descritor", "descritores", "descriptor", "descriptors"),
}

# fixed values: asset reason words and the text pieces that point to them, in order of preference
ASSET_REASONS = {
    "photo_context": ("context", "contexto", "cenario", "cenário", "fundo", "ambiente", "lugar"),
    "photo_style": ("style", "estilo", "pose", "roupa", "qualidade"),
}

# fixed values: detail keys that show which domain a reviewer judged, in order of precedence
DETAIL_KEYS = {
    "photo": (
        "photo_score_adjustment",
        "photo_score_reason",
        "photo_reason",
        "photo_positive_details",
        "photo_negative_details",
    ),
    "descriptors": (
        "descriptor_detail",
        "descriptor_positive_details",
        "descriptor_negative_details",
        "descriptor_not_positive",
        "descriptor_not_negative",
    ),
    "interests": ("selected_interests", "interest_not_positive", "interest_not_negative"),
    "bio": ("bio_detail", "bio_not_positive", "bio_not_negative"),
}
STRUCTURED_KEYS = tuple(k for keys in DETAIL_KEYS.values() for k in keys)


def _clean(c: Column | str) -> Column:
    return F.lower(F.trim(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))))


def normalize_domain(c: Column | str) -> Column:
    word, out = _clean(c), F
    for domain, spellings in DOMAIN_WORDS.items():
        out = out.when(word.isin(*spellings), domain)
    return out.otherwise("other")


def normalize_asset_reason(c: Column | str) -> Column:
    """Canonical asset reason: exact canonical name, else by contained word, else general."""
    word = _clean(c)
    out = F.when(word.isin("photo_general", *ASSET_REASONS), word)
    for reason, pieces in ASSET_REASONS.items():
        out = out.when(word.rlike("|".join(pieces)), reason)
    return out.otherwise("photo_general")


def normalize_intensity(c: Column | str, domain: Column) -> Column:
    word = F.regexp_replace(_clean(c), r"\.0$", "")
    return F.when(word.isin("1", "2", "3"), word).when(domain == "other", "1").otherwise("2")


def sentiment(final_decision: Column | str) -> Column:
    d = normalize_decision(final_decision)
    return F.when(d == "MAYBE", "neutral").when(d.isin("LIKE", "SUPER"), "positive").otherwise("negative")


def default_reason(domain: Column, text: Column, tags: Column, items: Column) -> Column:
    """Reason used when the reviewer gave none: first tags, start of the text, first attribute."""
    one_line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\n", " "))
    return (
        F.when(domain == "photo", "photo_general")
        .when(domain == "interests", F.coalesce(F.nullif(F.array_join(F.slice(tags, 1, 3), ", "), F.lit("")), F.lit("tags")))
        .when(
            (domain == "bio") & (one_line != ""),
            F.when(F.length(one_line) > 80, F.concat(F.substring(one_line, 1, 80), F.lit("..."))).otherwise(one_line),
        )
        .when(domain == "bio", "empty text")
        .when(domain == "descriptors", F.coalesce(F.try_element_at(items, F.lit(1)), F.lit("attributes")))
        .otherwise("unsure")
    )


def normalize_feedback(
    final_decision: Column | str,
    domain: Column | str,
    reason: Column | str,
    intensity: Column | str,
    model_decision: Column | str,
    fallback_reason: Column,
) -> dict[str, Column]:
    """Canonical feedback columns of one human decision."""
    dom = normalize_domain(domain)
    given = F.trim(F.coalesce(F.col(reason) if isinstance(reason, str) else reason, F.lit("")))
    chosen = F.when(given == "", fallback_reason).otherwise(given)
    final, model = label_to_decision(final_decision), normalize_decision(model_decision)
    final_word = F.when(normalize_decision(final_decision) == "MAYBE", "MAYBE").otherwise(final)
    return {
        "feedback_domain": dom,
        "feedback_reason": F.when(dom == "photo", normalize_asset_reason(chosen)).otherwise(chosen),
        "feedback_intensity": normalize_intensity(intensity, dom),
        "feedback_sentiment": sentiment(final_decision),
        "manual_corrected": F.when(model != "", (final_word != model).cast("int")),
    }


def domain_set(domain: Column | str, details: Column | str, secondary: Column | str | None = None) -> Column:
    """Union of the primary, selected and secondary domains, limited to the known names."""
    names = F.concat(
        F.array(_clean(domain)),
        parse_list(detail(details, "selected_domains")),
        parse_list(detail(details, "secondary_domains")),
        parse_list(secondary) if secondary is not None else F.array().cast("array<string>"),
    )
    known = F.array(*[F.lit(d) for d in DOMAINS])
    return F.filter(F.array_distinct(F.transform(names, lambda x: F.lower(F.trim(x)))), lambda x: F.array_contains(known, x))


def effective_domain(primary: Column | str, domains: Column, head: str) -> Column:
    """Domain a model head should weigh the row by."""
    first = _clean(primary)
    if head == "photo":
        return F.when(F.array_contains(domains, "photo"), "photo").otherwise(first)
    out = F.when(first.isin("interests", "bio", "descriptors"), first)
    for candidate in ("interests", "bio", "descriptors"):
        out = out.when(F.array_contains(domains, candidate), candidate)
    return out.otherwise(first)


def inferred_domains(details: Column | str, reason: Column | str | None = None) -> Column:
    """Domains shown by non-empty detail keys, in order of precedence."""
    out = []
    for domain, keys in DETAIL_KEYS.items():
        hit = has_detail(details, *keys)
        if domain == "photo" and reason is not None:
            hit = hit | _clean(reason).contains("score_foto_")
        out.append(F.when(hit, domain))
    return F.array_compact(F.array(*out))


def is_plain_agree(source: Column, domain: Column, label: Column, details: Column) -> Column:
    """A one-click agreement that carries no structured feedback."""
    return (
        (_clean(source) == "real")
        & (_clean(domain) == "other")
        & label.isin(0, 1)
        & has_detail(details, "quick_agree")
        & ~has_detail(details, *STRUCTURED_KEYS)
    )
