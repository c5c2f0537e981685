"""Unit cases of the column builders on literal rows."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from prefspark.functions import attrs as A
from prefspark.functions import feedback as FB
from prefspark.functions import labels as L
from prefspark.functions import numeric as N
from prefspark.functions import text as T
from prefspark.functions import urls as U
from prefspark.functions import vectors as V


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_fold_matches_unicode_decomposition(spark):
    letters = "".join(chr(c) for c in range(0xC0, 0x250))
    expected = "".join(x for x in unicodedata.normalize("NFD", letters) if unicodedata.category(x) != "Mn")
    assert one(spark, T.fold("s"), s=letters) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [("t-r.a_p", "trap"), ("h3llo w0rld", "hello world"), ("Sooo cooool", "so col"), ("a b", "a b")],
)
def test_deep_normalize(spark, raw, expected):
    assert one(spark, T.deep_normalize("s"), s=raw) == expected


def test_tokens_keep_bigrams_over_stopwords(spark):
    got = one(spark, T.tokenize_ngrams("s", ["the"]), s="The big cat, ok")
    assert got == ["big", "cat", "the big", "big cat"]


def test_signal_candidates(spark):
    assert one(spark, T.is_signal_candidate("s", ["the"]), s="big cats") is True
    assert one(spark, T.is_signal_candidate("s", ["the"]), s="the cats") is False
    assert one(spark, T.is_signal_candidate("s", ["the"]), s="a bc") is False


def test_candidate_bigrams_equal_the_predicate(spark):
    text = "the quick brown fox jumps over the lazy dog and the fox naps"
    raw = T.raw_tokens("s")
    kept = F.filter(T.ngrams_of(raw, ["the", "and"]), lambda x: T.is_signal_candidate(x, ["the", "and"], ("brown fox",)))
    assert one(spark, T.candidate_bigrams(raw, ["the", "and"], ("brown fox",)), s=text) == one(spark, kept, s=text)


def test_keyword_count(spark):
    assert one(spark, T.keyword_count("s", ["café", "ice cream", "art"], ignored=["art"]), s="Cafe and ice creams, start art") == 2


@pytest.mark.parametrize("raw, expected", [('["a", " b "]', ["a", "b"]), ("x, ,y", ["x", "y"]), ("", []), (None, [])])
def test_list_parse(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "s string")
    assert df.select(T.parse_list("s").alias("x")).first().x == expected


@pytest.mark.parametrize(
    "name, reason",
    [("  ", "empty"), ("Jo", "too short"), ("Ana9", "digit"), ("ANA BEL", "capitals"), ("b0b", "digit"), ("Star Deal", "deny word deal"), ("Anna", None)],
)
def test_name_rules_first_reason(spark, name, reason):
    assert one(spark, T.rule_reason("s", ["bob"], ["deal"]), s=name) == reason


def test_safe_float_and_clamp(spark):
    for raw, expected in (("1.5", 1.5), ("", -1.0), ("nan", -1.0), ("inf", -1.0), ("x", -1.0)):
        assert one(spark, N.safe_float("s", -1.0), s=raw) == expected
    df = spark.createDataFrame([(None,), (3.0,), (-1.0,)], "v double")
    assert [r.x for r in df.select(N.clamp01("v", 0.5).alias("x")).collect()] == [0.5, 1.0, 0.0]


def test_numeric_tokens(spark):
    assert [one(spark, N.clean_numeric_token("s"), s=s) for s in ("2.0", "nan", " 1.5 ", "yes")] == ["2", "", "1.5", "yes"]
    assert one(spark, N.truthy("s"), s="1.0") is True


def test_age_before_and_after_birthday(spark):
    assert one(spark, N.age_years("b", F.lit("2024-06-14")), b="1990-06-15") == 33
    assert one(spark, N.age_years("b", F.lit("2024-06-15")), b="1990-06-15T00:00:00Z") == 34
    assert one(spark, N.age_years("b", F.lit("2024-06-15")), b="soon") == 0


def test_schedule_wraps_midnight(spark):
    monday_late = F.lit("2024-01-01 23:30:00").cast("timestamp_ntz")
    tuesday_early = F.lit("2024-01-02 00:30:00").cast("timestamp_ntz")
    assert one(spark, N.within_schedule(monday_late, [0], "22:00", "01:00")) is True
    assert one(spark, N.within_schedule(tuesday_early, [0], "22:00", "01:00")) is False


def test_decision_words(spark):
    words = {" curtir ": "LIKE", "NAO CURTIR": "PASS", "talvez": "MAYBE", "super like": "SUPER", "": "", "odd": "ODD"}
    assert {w: one(spark, L.normalize_decision("s"), s=w) for w in words} == words
    assert [one(spark, L.decision_to_label("s"), s=w) for w in ("like", "pass", "maybe", "")] == [1, 0, None, None]


def test_tier_ladder(spark):
    tier = L.preference_tier("d", "l", "j", "r", "e")
    cases = [
        (("like", "1", "{}", "", "pass"), "pass"),
        (("maybe", "1", "{}", "", ""), "maybe"),
        (("pass", "0", '{"target_action":"super_like"}', "", ""), "strong_like"),
        (("pass", "0", "{}", "filtro_absoluto: x", ""), "filtered_pass"),
        (("", "1.0", "{}", "", "junk"), "like"),
        (("", "", "", "", ""), ""),
    ]
    for values, expected in cases:
        assert one(spark, tier, **dict(zip("dljre", values))) == expected


def test_correction_types(spark):
    def kind(model, final):
        return one(spark, L.correction_type(L.preference_tier("f"), "m", "f"), m=model, f=final)

    assert kind("like", "pass") == "false_positive"
    assert kind("pass", "like") == "false_negative"
    assert kind("like", "super_like") == "superlike_upgrade"
    assert kind("super_like", "super_like") == "none"
    assert kind("like", "talvez") == "uncertain"


def test_review_priority(spark):
    assert one(spark, L.review_priority("p", F.lit("none")), p=0.5) == 0.9
    assert one(spark, L.review_priority("p", F.lit("none")), p=1.0) == 0.35
    assert one(spark, L.review_priority("p", F.lit("false_negative")), p=1.0) == 0.9
    assert one(spark, L.review_priority("p", F.lit("superlike_upgrade")), p=1.0) == 0.75


def test_policy_band_and_forced_pass(spark):
    df = spark.createDataFrame([(0.47, False), (0.49, False), (0.95, True), (0.95, False)], "p double, forced boolean")
    policy = L.apply_policy("p", 0.48, F.col("forced"))
    rows = df.select(*[c.alias(n) for n, c in policy.items()]).collect()
    assert [r.decision for r in rows] == ["PASS", "LIKE", "PASS", "LIKE"]
    assert [r.preference_tier for r in rows] == ["pass", "like", "filtered_pass", "like"]
    assert [r.correction_type for r in rows] == ["uncertain", "uncertain", "none", "none"]
    assert rows[0].review_priority >= 0.85


def test_learned_threshold_outside_trusted_range(spark):
    assert one(spark, L.usable_threshold(F.col("t")), t=0.7) == 0.48
    assert one(spark, L.usable_threshold(F.col("t")), t=0.51) == 0.51


def test_domain_inference_order(spark):
    details = '{"bio_detail":"x","selected_interests":["a"],"photo_reason":"","descriptor_detail":"[]"}'
    assert one(spark, FB.inferred_domains("d"), d=details) == ["interests", "bio"]


def test_domain_set(spark):
    details = '{"selected_domains":["Bio","junk"],"secondary_domains":"photo, bio"}'
    assert one(spark, FB.domain_set("p", "d"), p="other", d=details) == ["other", "bio", "photo"]


def test_attr_map_last_key_wins(spark):
    raw = '[{"name":"A","choice_selections":[{"name":"x"},{"name":" "},{"name":"y"}]},{"name":"A","choice_selections":[{"name":"z"}]},{"id":"h","measurable_selection":{"value":"180","unit_of_measure":"cm"}}]'
    parsed = A.attr_map_extract(F.from_json("s", A.SELECTION_SCHEMA))
    assert one(spark, parsed, s=raw) == {"A": "z", "h": "180 cm"}
    assert one(spark, parsed, s=raw.replace("z", " ")) == {"A": "x, y", "h": "180 cm"}


def test_url_keys_ignore_the_signature(spark):
    a, b = ("https://img.example.com/u/abc/1.jpg?sig=1", "https://IMG.example.com/u/abc/1.jpg?sig=2&amp;x=3")
    keys = one(spark, U.url_identity_keys("s"), s=a)
    assert keys == ["path:img.example.com/u/abc/1.jpg", "owner:abc", "photo:abc/1.jpg"]
    assert one(spark, U.url_identity_keys("s"), s=b) == keys
    assert one(spark, U.url_identity_keys("s"), s="local.jpg") == ["raw:local.jpg"]


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0], [0.0, 0.0, 0.0], [2.0, 0.0, 0.0])], "a array<double>, z array<double>, b array<double>")
    row = df.select(V.cosine("a", "z").alias("zero"), V.cosine("a", "b").alias("same"), V.cosine01("a", "z").alias("none")).first()
    assert (row.zero, row.same, row.none) == (0.0, 1.0, None)
