"""Free-form JSON trees as variants: depth, text of a value, children, and JSON text from parts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.session import cut_lineage


#: Types that only variants of a kind can be cast to.
KINDS = {"OBJECT": "struct<>", "ARRAY": "array<variant>"}


def is_kind(v: Column, kind: str) -> Column:
    """Whether a variant is an OBJECT, an ARRAY, ...; those two are told by a cast, as a schema would be that of all that they hold."""
    if kind in KINDS:
        return F.try_variant_get(v, "$", KINDS[kind]).isNotNull()
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def elements(v: Column) -> Column:
    """Elements of an array variant; null for anything else."""
    return F.try_variant_get(v, "$", KINDS["ARRAY"])


def member(v: Column, key: str) -> Column:
    """A key of an object variant; null where there is none."""
    return F.try_variant_get(v, f"$.{key}", "variant")


def scalar_text(v: Column) -> Column:
    """Trimmed text of a scalar variant; empty for null, objects and arrays."""
    plain = F.when(~is_kind(v, "OBJECT") & ~is_kind(v, "ARRAY"), F.try_variant_get(v, "$", "string"))
    return F.trim(F.coalesce(plain, F.lit("")))


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, 2, F.length(listed) - 2)


def value_text(v: Column, depth: int, keys: Sequence[str]) -> Column:
    """Text of a value: a scalar, a list joined by commas, chosen names, number and unit, else the first filled of ``keys``.

    Looks ``depth`` levels into lists and keys; every level adds one lambda to the expression.
    """
    choices = F.transform(elements(member(v, "choice_selections")), lambda c: F.coalesce(first_filled([scalar_text(member(c, "name"))]), scalar_text(c)))
    names = F.array_join(F.filter(choices, lambda n: n != ""), ", ")
    measure = member(v, "measurable_selection")
    measured = F.transform(F.array(scalar_text(member(measure, "value"))), lambda n: F.when(n != "", F.trim(F.concat_ws(" ", n, scalar_text(member(measure, "unit_of_measure"))))))
    told = [first_filled([names]), F.get(measured, 0)]
    if depth == 0:
        return F.when(is_kind(v, "OBJECT"), F.coalesce(*told, F.lit(""))).otherwise(scalar_text(v))
    texts = lambda below: F.filter(F.transform(below, lambda x: value_text(x, depth - 1, keys)), lambda t: t != "")
    held = texts(F.filter(F.coalesce(elements(v), F.array(*[member(v, k) for k in keys])), lambda x: x.isNotNull()))
    wanted = F.when(is_kind(v, "OBJECT"), 1).otherwise(1 << 30)
    nested = F.array_join(F.slice(held, 1, wanted), ", ")  # the texts are named once: an expression that repeats them doubles with every level
    return F.when(is_kind(v, "OBJECT") | is_kind(v, "ARRAY"), F.coalesce(*told, nested)).otherwise(scalar_text(v))


def first_filled(texts: Sequence[Column]) -> Column:
    """The first text that is not empty, each of them evaluated once; null where there is none."""
    return F.get(F.filter(F.array(*texts), lambda t: t != ""), 0)


#: Stands for a part of a JSON text that is put in later; no JSON text holds it, as control characters are escaped there.
HOLE = "\x01"


def members_of(v: Column) -> Column:
    """(key, value) of what an object (by sorted key) or a list (null keys) holds; null for a scalar."""
    fields = F.try_variant_get(v, "$", "map<string,variant>")
    return F.coalesce(
        F.when(is_kind(v, "OBJECT"), F.transform(F.array_sort(F.map_keys(fields)), lambda k: F.struct(k.alias("k"), F.element_at(fields, k).alias("v")))),
        F.transform(elements(v), lambda x: F.struct(F.lit(None).cast("string").alias("k"), x.alias("v"))),
    )


Leaf = Callable[[Column, Column], Column]


def rewrite(v: Column, depth: int, leaf: Leaf, key: Column, end: str = HOLE) -> Column:
    """JSON text of a variant after ``leaf``: (key, variant) -> JSON text, or null to go on into the value.

    ``key`` is that of ``v``, null inside lists. Keys of an object are sorted; nothing is merged or dropped. Objects and lists
    ``depth`` levels below are told as ``end``.
    """
    out = F.coalesce(leaf(key, v), F.when(~is_kind(v, "OBJECT") & ~is_kind(v, "ARRAY"), F.to_json(v)))
    if depth == 0:
        return F.coalesce(out, F.lit(end))

    def part(m: Column) -> Column:
        name = F.when(m["k"].isNotNull(), F.concat(quoted(m["k"]), F.lit(": "))).otherwise("")
        return F.concat(name, rewrite(m["v"], depth - 1, leaf, m["k"], end))

    parts = F.transform(members_of(v), part)
    keyed = is_kind(v, "OBJECT")  # the parts are named once: an expression that repeats them doubles with every level
    return F.coalesce(out, F.concat(F.when(keyed, "{").otherwise("["), F.array_join(parts, ", "), F.when(keyed, "}").otherwise("]")))


def below(v: Column, depth: int, leaf: Leaf, key: Column) -> Column:
    """(key, value) of the objects and lists ``depth`` levels below, in the order of the holes that ``rewrite`` leaves."""
    inner = leaf(key, v).isNull() & (is_kind(v, "OBJECT") | is_kind(v, "ARRAY"))
    if depth == 0:
        found = F.array(F.struct(key.cast("string").alias("k"), v.alias("v")))
    else:
        found = F.flatten(F.transform(members_of(v), lambda m: below(m["v"], depth - 1, leaf, m["k"])))
    return F.when(inner, found).otherwise(F.array().cast("array<struct<k:string,v:variant>>"))


def rewrite_deep(
    df: DataFrame, tree: str, leaf: Leaf, finish: Callable[[Column], Column] = lambda text: text, most: int | None = None, end: str = "", levels: int = 5
) -> DataFrame:
    """``df`` with the variant column ``tree`` as its JSON text after ``leaf``, trees of any depth.

    ``levels`` levels are written in one expression. What lies below comes as rows of its own (row, place), is written in the
    same way, and so on while there is any; then the texts are put into the holes of those above, the deepest first, each
    after ``finish``. The plan of a round does not depend on the depth, and rounds after the first hold only what is deep.
    From ``most`` levels on, objects and lists become ``end``. A null tree gives a null text.
    """
    rows = cut_lineage(df.withColumn("_tree_row", F.monotonically_increasing_id()))
    frontier = rows.select("_tree_row", F.lit("").alias("_path"), F.lit(None).cast("string").alias("_key"), F.col(tree).alias("_node")).filter(F.col("_node").isNotNull())
    written, left = [], most
    while True:
        depth = levels if left is None else min(levels, left)
        left = None if left is None else left - depth
        node, key = F.col("_node"), F.col("_key")
        text = rewrite(node, depth, leaf, key, end if left == 0 else HOLE)
        deeper = F.array().cast("array<struct<k:string,v:variant>>") if left == 0 else below(node, depth, leaf, key)
        opened = cut_lineage(frontier.select("_tree_row", "_path", text.alias("_text"), deeper.alias("_below")))
        written.append(opened.select("_tree_row", "_path", "_text"))
        found = opened.filter(F.size("_below") > 0).select("_tree_row", "_path", F.posexplode("_below").alias("_at", "_hole"))
        if found.isEmpty():
            break
        path = F.concat("_path", F.lpad(F.col("_at").cast("string"), PLACE, "0"))
        frontier = found.select("_tree_row", path.alias("_path"), F.col("_hole.k").alias("_key"), F.col("_hole.v").alias("_node"))
    done = written.pop().withColumn("_text", finish(F.col("_text")))
    while written:
        parent = F.expr(f"left(_path, length(_path) - {PLACE})")
        texts = F.transform(F.array_sort(F.collect_list(F.struct("_path", "_text"))), lambda e: e["_text"])
        inner = done.groupBy("_tree_row", parent.alias("_path")).agg(texts.alias("_inner"))
        pieces = F.split("_text", HOLE)
        filled = F.array_join(F.zip_with(pieces, F.concat("_inner", F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
        above = written.pop().join(inner, ["_tree_row", "_path"], "left")
        done = cut_lineage(above.select("_tree_row", "_path", finish(F.when(F.col("_inner").isNull(), F.col("_text")).otherwise(filled)).alias("_text")))
    return rows.join(done.select("_tree_row", "_text"), "_tree_row", "left").withColumn(tree, F.col("_text")).drop("_tree_row", "_text")


#: Digits of a place among what lies below a part.
PLACE = 9


def value_texts(df: DataFrame, value: str, keys: Sequence[str], levels: int = 5) -> DataFrame:
    """``df`` with the variant column ``value`` as its text (see ``value_text``), values of any depth: what lies deep is told first,
    and its text stands in its place above."""
    told = lambda text: quoted(value_text(F.parse_json(text), levels + 1, keys))
    none = lambda key, v: F.lit(None).cast("string")
    out = rewrite_deep(df, value, none, told, levels=levels)
    return out.withColumn(value, F.coalesce(F.try_variant_get(F.try_parse_json(value), "$", "string"), F.lit("")))
