"""URL identity keys and host/path predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_parts(c: Column | str) -> tuple[Column, Column]:
    """(lower-case host, path); '' where the url has none. One regexp split, so a bad url cannot fail the job."""
    url = F.coalesce(_col(c), F.lit(""))
    pattern = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)([^?#]*)"
    return F.lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def url_identity_keys(c: Column | str, owner_marker: str = "u") -> Column:
    """Ordered distinct keys that survive a re-signed query string: path, owner and owner/photo, or the raw text."""
    clean = F.replace(F.trim(F.coalesce(_col(c), F.lit(""))), F.lit("&amp;"), F.lit("&"))
    host, path = url_parts(clean)
    parts = path_segments(path)
    at = F.array_position(parts, owner_marker).cast("int")
    owner = F.when(at > 0, F.try_element_at(parts, at + 1))
    photo = F.when(at > 0, F.try_element_at(parts, at + 2))
    keys = F.array(
        F.when((host != "") & (path != ""), F.concat(F.lit("path:"), host, path)),
        F.concat(F.lit("owner:"), owner),
        F.concat(F.lit("photo:"), owner, F.lit("/"), photo),
    )
    raw = F.array(F.concat(F.lit("raw:"), clean))
    none = F.array().cast("array<string>")
    return F.when(clean == "", none).when(host == "", raw).otherwise(F.array_distinct(F.array_compact(keys)))


def stable_key(c: Column | str) -> Column:
    """Path without query: what a cache files the asset under."""
    return url_parts(c)[1]


def host_matches(c: Column | str, host: str, path_prefixes: Sequence[str]) -> Column:
    """Host equal to ``host`` or below it, and path equal to or below one of the prefixes."""
    found, path = url_parts(c)
    below = F.lit(False)
    for prefix in path_prefixes:
        clean = prefix.rstrip("/") or "/"
        below = below | (path == clean) | path.startswith(clean.rstrip("/") + "/")
    return ((found == host) | found.endswith("." + host)) & below


def first_two_segments(c: Column | str) -> Column:
    """struct(action, target) from the first two path segments."""
    parts = path_segments(url_parts(c)[1])
    return F.struct(
        F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")).alias("action"),
        F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("target"),
    )
