"""Typed identity keys, and any-key matching as equi joins.

Two records are the same when ANY of their (kind, key) pairs is equal. An OR condition would be a nested-loop join, so
keys are exploded and matched by equality. Matching is deliberately not transitive.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.functions.hashing import SEP
from prefspark.functions.text import normalize_key
from prefspark.functions.urls import url_identity_keys, url_parts

WEAK_KINDS = ("name_age",)


_EMPTY_TEXT = hashlib.sha1(SEP.encode()).hexdigest()  # digest of a record with neither text nor tags


def _key(kind: str, *parts: Column) -> Column:
    """One typed key; its ``key`` is null when any part is missing (null parts make a null concatenation)."""
    joined = parts[0]
    for part in parts[1:]:
        joined = F.concat(joined, F.lit(SEP), part)
    return F.struct(F.lit(kind).alias("kind"), joined.alias("key"))


def review_keys(
    *,
    name: Column,
    age: Column,
    text: Column | None = None,
    tags: Column | None = None,
    url: Column | None = None,
    item_id: Column | None = None,
    fingerprint: Column | None = None,
    content: Column | None = None,
    text_cut: int | None = None,
) -> Column:
    """Array of typed keys of a record; entries with a null ``key`` do not apply and are left out by ``explode_keys``.

    The text key covers the whole text (as a digest); ``text_cut`` compares only that many leading characters instead,
    for matching against stores that cut their texts. Each source column is normalized once.
    """

    def present(c: Column) -> Column:
        value = F.trim(c.cast("string"))
        return F.when(value != "", value)

    who, years = F.when(F.trim(name) != "", normalize_key(name)), present(age)
    keys = [_key("name_age", who, years)]
    if text is not None or tags is not None:
        parts = [normalize_key(c) if c is not None else F.lit("") for c in (text, tags)]
        if text_cut is not None:
            parts = [F.substring(c, 1, text_cut) for c in parts]
        digest = F.replace(F.sha1(F.concat_ws(SEP, *parts)), F.lit(_EMPTY_TEXT), F.lit(""))
        keys.append(_key("name_age_text", who, years, digest))
    if item_id is not None:
        keys.append(_key("id", present(item_id)))
    if fingerprint is not None:
        keys.append(_key("photo_fingerprint_age", present(fingerprint), years))
    if content is not None:
        keys.append(_key("photo_file_hash", present(content)))
    if url is None:
        return F.array(*keys)
    host, path = url_parts(F.replace(url, F.lit("&amp;"), F.lit("&")))
    keys.append(_key("photo_url", present(url)))
    keys.append(_key("photo_url_path", F.when(host != "", host), F.when(path != "", path)))
    identity = F.transform(url_identity_keys(url), lambda k: F.struct(F.lit("photo_identity").alias("kind"), k.alias("key")))
    return F.concat(F.array(*keys), identity)


def explode_keys(df: DataFrame, keys: Column, *keep: str, strong_only: bool = False) -> DataFrame:
    """(keep..., kind, key), one row per typed key."""
    # a text key ends with the separator when the record has neither text nor tags
    flat = df.select(*keep, F.inline(keys)).filter(F.col("key").isNotNull() & ~F.col("key").endswith(SEP))
    return flat.filter(~F.col("kind").isin(*WEAK_KINDS)) if strong_only else flat


def matching_ids(probe_keys: DataFrame, known_keys: DataFrame, id_column: str) -> DataFrame:
    """Distinct ids of the probe rows that share any key with the known rows."""
    known = known_keys.select("kind", "key").distinct()
    return probe_keys.join(known, ["kind", "key"], "left_semi").select(id_column).distinct()


def first_stage(probe_keys: DataFrame, known_keys: DataFrame, id_column: str, stage: str) -> DataFrame:
    """(id, stage): the lowest stage number among the known rows sharing any key; one join for any number of sets."""
    known = known_keys.groupBy("kind", "key").agg(F.min(stage).alias(stage))
    return probe_keys.join(known, ["kind", "key"]).groupBy(id_column).agg(F.min(stage).alias(stage))
