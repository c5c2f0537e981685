"""Attribute-map builders: parsing, items, rule flags, nested selections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefspark.functions.text import normalize, normalize_key, plain_key, string_set

SELECTION_SCHEMA = (
    "array<struct<name:string,section_name:string,prompt:string,id:string,"
    "choice_selections:array<struct<name:string>>,measurable_selection:struct<value:string,unit_of_measure:string>>>"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_key_wins(entries: Column) -> Column:
    """Map from (key, value) structs, keeping the first entry of each key."""
    keys = F.transform(entries, lambda e: e["key"])
    firsts = F.filter(
        F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("i"))),
        lambda e: F.array_position(keys, e["key"]) == e["i"] + 1,
    )
    return F.map_from_entries(F.transform(firsts, lambda e: F.struct(e["key"], e["value"])))


def last_key_wins(entries: Column) -> Column:
    """Map from (key, value) structs, keeping the last entry of each key at the place of its first."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))

    def value(key: Column) -> Column:
        return F.element_at(F.filter(entries, lambda e: e["key"] == key), -1)["value"]

    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), value(k).alias("value"))))


def parse_attrs(c: Column | str) -> Column:
    """A JSON object, else 'key: value | key: value' text; missing gives an empty map."""
    text = F.trim(F.coalesce(_col(c), F.lit("")))
    as_json = F.when(text.startswith("{"), F.from_json(text, "map<string,string>"))
    parts = F.filter(F.split(text, r"\s*\|\s*"), lambda p: p.contains(":"))
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            F.trim(F.substring_index(p, ":", 1)).alias("key"),
            F.trim(F.substring(p, F.instr(p, ":") + 1, F.length(p))).alias("value"),
        ),
    )
    return F.coalesce(as_json, first_key_wins(pairs))


def attr_items(attrs: Column | str) -> Column:
    """Normalized 'key: value' items, in map order."""
    entries = F.map_entries(_col(attrs))
    items = F.transform(entries, lambda e: normalize_key(F.concat(e["key"], F.lit(": "), e["value"])))
    return F.filter(items, lambda x: x != "")


def attr_norms(attrs: Column | str) -> Column:
    """Every normalized key, value and 'key: value' of the map, without repeats."""
    m = _col(attrs)
    both = F.concat(F.transform(F.map_keys(m), normalize_key), F.transform(F.map_values(m), normalize_key), attr_items(m))
    return F.filter(F.array_distinct(both), lambda x: x != "")


def attr_value(attrs: Column | str, *names: str) -> Column:
    """Value under the first key matching any of the names, ignoring case and accents; '' when absent."""
    wanted = string_set(plain_key(n) for n in names)
    hits = F.filter(F.map_entries(_col(attrs)), lambda e: F.array_contains(wanted, normalize_key(e["key"])))
    return F.coalesce(F.try_element_at(hits, F.lit(1))["value"], F.lit(""))


@dataclass(frozen=True)
class FlagRule:
    """One 0/1 flag over an attribute: set when a phrase occurs and no blocking phrase does."""

    flag: str
    keys: tuple[str, ...]
    phrases: tuple[str, ...]
    blocked_by: tuple[str, ...] = ()


def attr_flags(attrs: Column | str, rules: tuple[FlagRule, ...], vetoed: Column | None = None) -> dict[str, Column]:
    """Flags of a rule table. ``vetoed`` is an array of attribute items whose rules are switched off."""
    out = {}
    for rule in rules:
        value = normalize(attr_value(attrs, *rule.keys))
        flag = F.lit(False)
        for phrase in rule.phrases:
            flag = flag | value.contains(plain_key(phrase))
        for phrase in rule.blocked_by:
            flag = flag & ~value.contains(plain_key(phrase))
        if vetoed is not None:
            wanted = string_set(plain_key(n) for n in rule.keys)
            mine = F.filter(F.map_entries(_col(attrs)), lambda e: F.array_contains(wanted, normalize_key(e["key"])))

            def touches(entry: Column) -> Column:
                detail = normalize_key(F.concat(entry["key"], F.lit(": "), entry["value"]))
                return F.exists(vetoed, lambda v: (v != "") & (detail.contains(v) | v.contains(detail)))

            flag = flag & ~F.exists(mine, touches)
        out[rule.flag] = flag.cast("int")
    return out


def attr_map_extract(selections: Column | str, max_key: int | None = None, max_value: int | None = None) -> Column:
    """Selections (``SELECTION_SCHEMA``) to a map: first non-empty label -> joined choices, or 'value unit'.

    A label of blanks alone drops its selection; of selections with one label the last that has a value wins. Lengths are
    not limited unless asked for.
    """

    def entry(s: Column) -> Column:
        key = F.trim(F.coalesce(*[F.nullif(s[f], F.lit("")) for f in ("name", "section_name", "prompt", "id")]))
        names = F.filter(F.transform(s["choice_selections"], lambda c: F.trim(c["name"])), lambda n: n != "")
        chosen = F.when(F.size(names) > 0, F.array_join(names, ", "))
        measure = F.nullif(s["measurable_selection"]["value"], F.lit(""))
        unit = F.coalesce(s["measurable_selection"]["unit_of_measure"], F.lit(""))
        measured = F.when(measure.isNotNull(), F.trim(F.concat_ws(" ", measure, F.trim(unit))))
        has_choices = F.coalesce(F.size(s["choice_selections"]) > 0, F.lit(False))
        return F.struct(key.alias("key"), F.when(has_choices, chosen).otherwise(measured).alias("value"))

    def fits(e: Column) -> Column:
        ok = (F.coalesce(e["key"], F.lit("")) != "") & e["value"].isNotNull()
        for name, limit in (("key", max_key), ("value", max_value)):
            if limit is not None:
                ok = ok & (F.length(e[name]) <= limit)
        return ok

    return last_key_wins(F.filter(F.transform(_col(selections), entry), fits))


def signal_kind(value: Column | str, tags: Column | str, attrs: Column | str) -> Column:
    """Which feature a signal text names: a tag, an attribute (equal, containing or with ':'), or free text."""
    norm, tag_norms = normalize_key(value), F.transform(_col(tags), normalize_key)
    near = F.exists(attr_items(attrs), lambda a: a.contains(norm) | norm.contains(a))
    return (
        F.when(norm == "", "bio")
        .when(F.array_contains(tag_norms, norm), "interest")
        .when(near | _col(value).contains(":"), "descriptor")
        .otherwise("bio")
    )


def sorted_map_json(attrs: Column | str) -> Column:
    """JSON object with keys in sorted order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(_col(attrs)))))
