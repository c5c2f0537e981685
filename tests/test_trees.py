"""Selections, JSON trees and queues: the cases where rules are easily mistaken."""

import json
import random

import pytest
from pyspark.sql import functions as F

from prefspark.functions.attrs import SELECTION_SCHEMA, attr_map_extract
from prefspark.functions.text import rule_reason
from prefspark.functions.trees import value_texts
from prefspark.operators import bucketed as B
from prefspark.sources import capture as C
from prefspark.sources import nested as N


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_last_selection_wins_blank_labels_drop_and_nothing_is_cut(spark):
    rows = [
        {"name": "A", "choice_selections": [{"name": "x"}]},
        {"name": " ", "id": "B", "choice_selections": [{"name": "never"}]},
        {"name": "A", "choice_selections": [{"name": "z"}]},
        {"name": "A", "choice_selections": [{"name": " "}]},
        {"prompt": "k" * 100, "choice_selections": [{"name": "v" * 301}]},
    ]
    selections = F.from_json(F.lit(json.dumps(rows)), SELECTION_SCHEMA)
    assert one(spark, attr_map_extract(selections)) == {"A": "z", "k" * 100: "v" * 301}
    assert one(spark, attr_map_extract(selections, max_key=80)) == {"A": "z"}


def test_first_configured_deny_word_is_reported(spark):
    assert one(spark, rule_reason(F.lit("widget gear"), (), ("widget", "gear"))) == "deny word widget"
    assert one(spark, rule_reason(F.lit("widget gear"), (), ("gear", "widget"))) == "deny word gear"
    assert one(spark, rule_reason(F.lit("plain"), (), ())) is None


def test_positions_follow_the_global_order(spark):
    rows = spark.range(1000).withColumn("v", F.xxhash64("id"))
    got = B.with_position(rows.repartition(7).orderBy("v")).collect()
    assert [r.v for r in sorted(got, key=lambda r: r.position)] == sorted(r.v for r in got)
    assert sorted(r.position for r in got) == list(range(1, 1001))


def random_tree(rng, depth):
    if depth == 0 or rng.random() < 0.15:
        return rng.choice(["x", 1, None, True, 'a"b', "  long text "])
    n = rng.randint(0, 3)
    if rng.random() < 0.5:
        return [random_tree(rng, depth - 1) for _ in range(n)]
    return {rng.choice(["k", "token", "z", "name", "value"]): random_tree(rng, depth - 1) for _ in range(n)}


def chain(depth):
    tree = "end"
    for i in range(depth):
        tree = {"value": tree, "secret_x": [1]} if i % 2 else [tree]
    return tree


def masked(v, key=None, depth=0, most=None):
    if key and any(w in key for w in C.SENSITIVE):
        return "<redacted>"
    if isinstance(v, list | dict) and most is not None and depth >= most:
        return "<max_depth>"
    if isinstance(v, list):
        return [masked(x, None, depth + 1, most) for x in v]
    return {k: masked(x, k, depth + 1, most) for k, x in v.items()} if isinstance(v, dict) else v


def told(v):
    if isinstance(v, list):
        return ", ".join(t for t in map(told, v) if t)
    if isinstance(v, dict):
        return next((t for t in (told(v.get(k)) for k in ("name", "value")) if t), "")
    return "" if v is None else str(v).lower() if isinstance(v, bool) else str(v).strip()


def test_trees_of_forty_levels(spark):
    """Redaction, its depth limit and value texts equal a walk, in rounds whose plans do not grow with the depth."""
    rng = random.Random(1)
    trees = [random_tree(rng, 9) for _ in range(30)] + [chain(40), chain(41)]
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "id long, body string")
    for most in (None, 3, 5, 8):
        got = {r.id: json.loads(r.body) for r in C.redact_json(df, "body", max_depth=most).collect()}
        assert got == {i: masked(t, most=most) for i, t in enumerate(trees)}
    texts = value_texts(df.withColumn("v", F.try_parse_json("body")), "v", ("name", "value"))
    assert {r.id: r.v for r in texts.collect()} == {i: told(t) for i, t in enumerate(trees)}


def test_labels_and_values_of_any_depth(spark):
    tree = {"name": "Low", "value": chain(30)}
    for k in range(25):
        tree = {"title": f"S{k}", "items": [tree]} if k % 2 else [tree]
    df = spark.createDataFrame([(1, json.dumps(tree)), (2, "{}")], "id int, body string")
    assert {r.id: r.attrs for r in N.deep_attrs(df, "body").collect()} == {1: {"S1: Low": "end"}, 2: {}}


@pytest.fixture(scope="module")
def deep():
    tree = {"z": "deep"}
    for k in range(6):
        tree = {"level": [tree, k], "Session_Cookie": {"inner": k}, "x" * 300: 1, "x" * 299: 2}
    return json.dumps(tree)


def test_redaction_reaches_every_level_and_keeps_every_key(spark, deep):
    df = spark.createDataFrame([(1, deep), (2, "no json {"), (3, None), (4, '["a\\"b", null, 1.5, true]')], "id int, body string")

    def plain(value):
        if isinstance(value, dict):
            return {k: "<redacted>" if "cookie" in k.lower() else plain(v) for k, v in value.items()}
        return [plain(v) for v in value] if isinstance(value, list) else value

    got = {r.id: r.body for r in C.redact_json(df, "body").collect()}
    assert json.loads(got[1]) == plain(json.loads(deep)) and got[2] is None and got[3] is None
    assert json.loads(got[4]) == ['a"b', None, 1.5, True]
    cut = C.redact_json(df.where("id = 4"), "body", max_string=2).first().body
    assert json.loads(cut)[0] == 'a"...<truncated 1 chars>'


def test_tree_attributes_first_label_wins(spark):
    tree = {
        "section_name": "S",
        "items": [
            {"name": "K", "value": {"text": ["a", {"name": "b"}]}},
            {"name": "K", "body_text": "later"},
            {"title": "T", "content": {"fields": [{"prompt": "P", "choice_selections": [{"name": "c"}, "d"]}]}},
            {"name": "M", "value": {"measurable_selection": {"value": 7, "unit_of_measure": " cm "}}},
            {"name": "same", "value": "S: same"},
        ],
    }
    df = spark.createDataFrame([(1, json.dumps(tree)), (2, "broken"), (3, None)], "id int, body string")
    got = {r.id: r.attrs for r in N.deep_attrs(df, "body").collect()}
    assert got == {1: {"S: K": "a, b", "T: P": "c, d", "S: M": "7 cm"}, 2: {}, 3: {}}


def test_kinds_are_told_without_the_schema_of_all_that_is_held(spark):
    """Kinds of nodes: no schema of a whole subtree is made to tell one, and each text is named once."""
    rows = spark.createDataFrame([(json.dumps({"title": "A", "value": {"text": [1, "x"]}}),)], "body string").coalesce(1)
    node = F.parse_json("body")
    for found in (N._label(F.struct(F.lit("").alias("path"), node.alias("node"), F.lit("").alias("section"))), N.shallow_value(node)):
        plan = rows.select(found.alias("x"))._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "schemaofvariant" not in plan and "schema_of_variant" not in plan
    attrs = N.deep_attrs(rows, "body").first().attrs
    assert attrs == {"A": "1, x"}
