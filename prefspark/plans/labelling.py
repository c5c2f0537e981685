"""Queries of projections, predicates and label algebra (survey 2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.functions import attrs as A
from prefspark.functions import feedback as FB
from prefspark.functions import labels as L
from prefspark.functions import numeric as N
from prefspark.functions import text as T
from prefspark.operators import features as X
from prefspark.operators import labelled as LB
from prefspark.plans.registry import half_up, query
from prefspark.plans.tables import VIEWS
from prefspark.sources import capture as C

TOKEN_SQL = """CASE l_returnflag WHEN 'A' THEN CAST(l_quantity AS VARCHAR) WHEN 'N' THEN CASE WHEN l_tax > 0.04 THEN ' nan' ELSE 'Sim ' END
               ELSE CASE WHEN l_linestatus = 'O' THEN 'inf' WHEN l_tax > 0.04 THEN '' WHEN l_tax > 0.01 THEN '1.0' ELSE '0.125' END END"""
KEYS = ("l_orderkey", "l_linenumber", "l_partkey")


def tokens(t):
    return t.lineitem.selectExpr(*KEYS, TOKEN_SQL.replace("VARCHAR", "STRING") + " AS token")


@query(
    "trainable_predicate",
    """SELECT count(*) AS rows, count(*) FILTER (lower(origin) = 'real') AS real_rows,
              count(*) FILTER (lower(origin) = 'real' AND TRY_CAST(label_text AS DOUBLE) IN (0, 1)) AS trainable FROM profile_rows""",
)
def trainable_predicate(t):
    return LB.trainable_counts(t.profile_rows, "origin", "label_text")


@query(
    "safe_float",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN isfinite(x) THEN x ELSE -1 END AS x
        FROM (SELECT *, TRY_CAST({TOKEN_SQL} AS DOUBLE) AS x FROM lineitem)""",
)
def safe_float(t):
    return tokens(t).select(*KEYS, N.safe_float("token", -1.0).alias("x"))


@query(
    "clamp01",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0.5 ELSE greatest(0, least(1, o_totalprice / 2e5 - 0.5e0)) END::DOUBLE AS x FROM orders",
)
def clamp01(t):
    x = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / F.lit(2e5) - 0.5)
    return t.orders.select("o_orderkey", N.clamp01(x, 0.5).alias("x"))


@query(
    "numeric_token_clean",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, clean, lower(clean) IN ('1', 'true', 'yes', 'sim') AS yes
        FROM (SELECT *, CASE WHEN token IS NULL OR trim(token) = '' OR lower(trim(token)) = 'nan' THEN ''
              WHEN isfinite(TRY_CAST(token AS DOUBLE)) AND TRY_CAST(token AS DOUBLE) = floor(TRY_CAST(token AS DOUBLE))
              THEN CAST(CAST(TRY_CAST(token AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE trim(token) END AS clean
              FROM (SELECT *, {TOKEN_SQL} AS token FROM lineitem))""",
)
def numeric_token_clean(t):
    return tokens(t).select(*KEYS, N.clean_numeric_token("token").alias("clean"), N.truthy("token").alias("yes"))


VIEWS["words"] = """
    SELECT event_id, CASE event_type WHEN 'click' THEN ' like ' WHEN 'view' THEN 'não curtir' WHEN 'purchase' THEN 'Super-Curtir'
           WHEN 'signup' THEN CASE WHEN value < 10 THEN 'Talvez' ELSE 'curtir' END ELSE CASE WHEN value < 10 THEN '' ELSE 'defer' END END AS word,
           CASE WHEN value < 5 THEN '' WHEN value < 15 THEN '1.0' WHEN value < 30 THEN '0' ELSE 'maybe' END AS label_text,
           CASE WHEN value > 45 THEN 'filtro_absoluto: x' ELSE '' END AS reason,
           CASE WHEN value > 100 THEN 'like' ELSE 'bogus' END AS explicit,
           CASE WHEN user_id % 7 = 3 THEN '{"target_action":"super_like"}' ELSE '{}' END AS details,
           least(value / 5e1, 1) AS p
    FROM events"""
VIEWS["decided"] = """
    SELECT *, CASE trim(word) WHEN 'like' THEN 'LIKE' WHEN 'curtir' THEN 'LIKE' WHEN 'não curtir' THEN 'PASS' WHEN 'Super-Curtir' THEN 'SUPER'
                WHEN 'Talvez' THEN 'MAYBE' ELSE upper(trim(word)) END AS decision FROM words"""
VIEWS["tiers"] = """
    SELECT *, CASE WHEN explicit = 'like' THEN 'like' WHEN decision = 'MAYBE' OR label_text = 'maybe' THEN 'maybe'
                WHEN decision = 'SUPER' OR details LIKE '%super_like%' THEN 'strong_like' WHEN reason LIKE 'filtro%' THEN 'filtered_pass'
                WHEN label_text = '1.0' OR decision = 'LIKE' THEN 'like' WHEN label_text = '0' OR decision = 'PASS' THEN 'pass' ELSE '' END AS tier,
              CASE WHEN p >= 0.3 THEN 'CURTIR' ELSE 'pass' END AS model FROM decided"""
VIEWS["corrections"] = """
    SELECT *, CASE WHEN tier = 'maybe' THEN 'uncertain' WHEN decision = 'SUPER' OR tier = 'strong_like' THEN 'superlike_upgrade'
                WHEN model = 'CURTIR' AND decision = 'PASS' THEN 'false_positive' WHEN model = 'pass' AND decision = 'LIKE' THEN 'false_negative'
                ELSE 'none' END AS correction FROM tiers"""


def words(t):
    return t.events.selectExpr(
        "event_id",
        "CASE event_type WHEN 'click' THEN ' like ' WHEN 'view' THEN 'não curtir' WHEN 'purchase' THEN 'Super-Curtir' "
        "WHEN 'signup' THEN CASE WHEN value < 10 THEN 'Talvez' ELSE 'curtir' END ELSE CASE WHEN value < 10 THEN '' ELSE 'defer' END END AS word",
        "CASE WHEN value < 5 THEN '' WHEN value < 15 THEN '1.0' WHEN value < 30 THEN '0' ELSE 'maybe' END AS label_text",
        "CASE WHEN value > 45 THEN 'filtro_absoluto: x' ELSE '' END AS reason",
        "CASE WHEN value > 100 THEN 'like' ELSE 'bogus' END AS explicit",
        "CASE WHEN user_id % 7 = 3 THEN '{\"target_action\":\"super_like\"}' ELSE '{}' END AS details",
        "least(value / 50D, 1D) AS p",
    )


def tiers(t):
    tier = L.preference_tier("word", "label_text", "details", "reason", "explicit")
    return words(t).withColumns({"tier": tier, "model": F.when(F.col("p") >= 0.3, "CURTIR").otherwise("pass")})


def corrections(t):
    return tiers(t).withColumn("correction", L.correction_type(F.col("tier"), "model", "word"))


@query("decision_normalize", "SELECT event_id, decision FROM decided")
def decision_normalize(t):
    return words(t).select("event_id", L.normalize_decision("word").alias("decision"))


@query(
    "decision_to_label",
    """SELECT event_id, CASE WHEN decision IN ('LIKE', 'SUPER') THEN 1 WHEN decision IN ('', 'MAYBE') THEN -1 ELSE 0 END AS label,
              CASE WHEN label_text IN ('', 'maybe') THEN 'MAYBE' WHEN label_text = '1.0' THEN 'LIKE' ELSE 'PASS' END AS back FROM decided""",
)
def decision_to_label(t):
    label = F.coalesce(L.decision_to_label("word"), F.lit(-1))
    return words(t).select("event_id", label.alias("label"), L.label_to_decision("label_text").alias("back"))


@query("preference_tier", "SELECT event_id, tier FROM tiers")
def preference_tier(t):
    return tiers(t).select("event_id", "tier")


@query("correction_type", "SELECT event_id, correction FROM corrections")
def correction_type(t):
    return corrections(t).select("event_id", "correction")


PRIORITY_SQL = half_up(
    """greatest(0.35e0 + 0.55e0 * (1 - abs(p - 0.5e0) * 2), CASE WHEN correction IN ('false_positive', 'false_negative', 'uncertain')
       THEN 0.9e0 WHEN correction = 'superlike_upgrade' THEN 0.75e0 ELSE 0 END)""",
    4,
)


@query("review_priority", f"SELECT event_id, {PRIORITY_SQL} AS priority FROM corrections")
def review_priority(t):
    return corrections(t).select("event_id", L.review_priority("p", "correction").alias("priority"))


@query(
    "decision_policy",
    f"""
    WITH th AS (SELECT CASE WHEN a BETWEEN 0.45 AND 0.55 THEN a ELSE 0.48 END AS threshold FROM (SELECT avg(p) AS a FROM labelled)),
    d AS (SELECT id, p, toxic = 1 AS forced, p >= threshold AND toxic = 0 AS liked, p BETWEEN 0.4 AND 0.6 AS band FROM labelled, th),
    c AS (SELECT *, CASE WHEN band AND NOT forced THEN 'uncertain' ELSE 'none' END AS correction FROM d)
    SELECT id, CASE WHEN liked THEN 'LIKE' ELSE 'PASS' END AS decision, band AS in_review_band, {half_up('p', 4)} AS ranking_score,
           CASE WHEN band THEN greatest({PRIORITY_SQL}, 0.85) ELSE {PRIORITY_SQL} END AS review_priority,
           CASE WHEN forced THEN 'filtered_pass' WHEN liked THEN 'like' ELSE 'pass' END AS preference_tier, correction AS correction_type FROM c""",
)
def decision_policy(t):
    learned = t.labelled.agg(F.avg("p").alias("learned")).select(L.usable_threshold(F.col("learned")).alias("threshold"))
    policy = L.apply_policy("p", F.col("threshold"), F.col("toxic") == 1)
    return t.labelled.withColumn("threshold", learned.scalar()).select("id", *[c.alias(n) for n, c in policy.items()])


VIEWS["names"] = """
    SELECT p_partkey AS id, CASE p_type WHEN 'ECONOMY' THEN upper(p_name) WHEN 'SMALL' THEN p_name || p_size WHEN 'LARGE' THEN 'Ré' || CASE WHEN p_size > 25 THEN 'x' ELSE '' END
           WHEN 'PROMO' THEN CASE WHEN p_size > 40 THEN '  ' WHEN p_size > 20 THEN 'bo1t' ELSE p_name || ' 😀' END ELSE ' ' || p_name END AS name, p_size FROM part"""


def names(t):
    return t.part.selectExpr(
        "p_partkey AS id",
        "CASE p_type WHEN 'ECONOMY' THEN upper(p_name) WHEN 'SMALL' THEN p_name || p_size WHEN 'LARGE' THEN 'Ré' || CASE WHEN p_size > 25 THEN 'x' ELSE '' END "
        "WHEN 'PROMO' THEN CASE WHEN p_size > 40 THEN '  ' WHEN p_size > 20 THEN 'bo1t' ELSE p_name || ' 😀' END ELSE ' ' || p_name END AS name",
        "p_size",
    )


NAME_RULE_SQL = r"""
    CASE WHEN trim(name) = '' THEN 'empty' WHEN length(trim(name)) < 3 THEN 'too short' WHEN regexp_matches(name, '\d') THEN 'digit'
         WHEN regexp_matches(name, '[\x{10000}-\x{10FFFF}]') THEN 'emoji'
         WHEN regexp_matches(replace(trim(name), ' ', ''), '^\p{L}{2,}$') AND trim(name) = upper(trim(name)) THEN 'capitals'
         WHEN trim(lower(name)) IN ('blue bolt', 'red ring') THEN 'deny list'
         WHEN list_contains(string_split(trim(name), ' '), 'widget') THEN 'deny word widget'
         WHEN list_contains(string_split(trim(name), ' '), 'gear') THEN 'deny word gear' END"""


def name_reason():
    return T.rule_reason("name", ("blue bolt", "red ring"), ("widget", "gear"))


@query("rule_filter_first_reason", f"SELECT id, coalesce({NAME_RULE_SQL}, '') AS reason FROM names")
def rule_filter_first_reason(t):
    return names(t).select("id", F.coalesce(name_reason(), F.lit("")).alias("reason"))


GATE_SQL = "CASE WHEN l_returnflag = 'R' THEN '' WHEN l_extendedprice / 1e5 < 0.2 AND coalesce(CASE WHEN l_tax < 0.07 THEN l_discount * 3 END, 0.5) <= 0.18 THEN 'too dark' ELSE '' END"


@query("quality_gate", f"SELECT l_orderkey, l_linenumber, l_partkey, {GATE_SQL} AS reason FROM lineitem")
def quality_gate(t):
    contrast = F.when(F.col("l_tax") < 0.07, F.col("l_discount") * 3)
    reason = X.quality_gate(F.col("l_returnflag") == "R", F.col("l_extendedprice") / F.lit(1e5), contrast, 0.2)
    return t.lineitem.select(*KEYS, F.coalesce(reason, F.lit("")).alias("reason"))


@query(
    "absolute_filter_reason",
    f"""SELECT id, coalesce(CASE WHEN p_size = 7 THEN 'stored' END, {NAME_RULE_SQL}, CASE WHEN p_size < 10 THEN 'too dark' END, '') AS reason FROM names""",
)
def absolute_filter_reason(t):
    stored = F.when(F.col("p_size") == 7, "stored")
    gate = X.quality_gate(F.lit(False), F.col("p_size") / F.lit(50.0), F.lit(0.1), 0.2)
    return names(t).select("id", F.coalesce(stored, name_reason(), gate, F.lit("")).alias("reason"))


DOMAIN_SQL = "CASE lower(feedback_domain) WHEN 'other' THEN 'other' ELSE lower(feedback_domain) END"
INTENSITY_SQL = f"CASE WHEN feedback_intensity = '' THEN (CASE WHEN {DOMAIN_SQL} = 'other' THEN '1' ELSE '2' END) ELSE replace(feedback_intensity, '.0', '') END"


@query(
    "domain_normalize",
    f"""SELECT id, {DOMAIN_SQL} AS domain, {INTENSITY_SQL} AS intensity,
        CASE WHEN feedback_reason = 'contexto' THEN 'photo_context' ELSE 'photo_general' END AS reason FROM feedback""",
)
def domain_normalize(t):
    domain = FB.normalize_domain("feedback_domain")
    return t.feedback.select(
        "id",
        domain.alias("domain"),
        FB.normalize_intensity("feedback_intensity", domain).alias("intensity"),
        FB.normalize_asset_reason("feedback_reason").alias("reason"),
    )


VIEWS["final_words"] = """
    SELECT *, CASE final_decision WHEN 'Super_Like' THEN 'SUPER' WHEN 'talvez' THEN 'MAYBE' WHEN 'like' THEN 'LIKE' ELSE 'PASS' END AS final_word
    FROM feedback"""


@query(
    "feedback_normalize",
    f"""
    WITH r AS (SELECT *, {DOMAIN_SQL} AS domain, replace(trim(regexp_replace(text, '\\n', ' ', 'g')), chr(10), ' ') AS line FROM final_words)
    SELECT id, domain AS feedback_domain, {INTENSITY_SQL} AS feedback_intensity,
           CASE WHEN domain = 'photo' THEN CASE WHEN feedback_reason = 'contexto' THEN 'photo_context' ELSE 'photo_general' END
                WHEN feedback_reason <> '' THEN feedback_reason
                ELSE CASE domain WHEN 'interests' THEN lang || ', ' || source WHEN 'descriptors' THEN 'lang: ' || lang
                     WHEN 'bio' THEN CASE WHEN line = '' THEN 'empty text' WHEN length(line) > 80 THEN substr(line, 1, 80) || '...' ELSE line END
                     ELSE 'unsure' END END AS feedback_reason,
           CASE final_word WHEN 'MAYBE' THEN 'neutral' WHEN 'PASS' THEN 'negative' ELSE 'positive' END AS feedback_sentiment,
           CAST((CASE final_word WHEN 'SUPER' THEN 'LIKE' ELSE final_word END) <> (CASE model_decision WHEN 'CURTIR' THEN 'LIKE' ELSE 'PASS' END) AS INTEGER) AS manual_corrected
    FROM r""",
)
def feedback_normalize(t):
    items = F.array(F.concat(F.lit("lang: "), F.col("lang")))
    fallback = FB.default_reason(FB.normalize_domain("feedback_domain"), F.col("text"), F.array("lang", "source"), items)
    columns = FB.normalize_feedback(
        "final_decision", "feedback_domain", "feedback_reason", "feedback_intensity", "model_decision", fallback
    )
    return t.feedback.select("id", *[c.alias(n) for n, c in columns.items()])


VIEWS["domain_sets"] = f"""
    SELECT *, list_distinct(list_concat([{DOMAIN_SQL}], CASE lang WHEN 'fr' THEN ['interests'] WHEN 'de' THEN ['bio', 'photo'] ELSE [] END)) AS doms FROM feedback"""


@query(
    "feedback_domain_set",
    f"""SELECT id, array_to_string(list_sort(doms), ',') AS domains,
               CASE WHEN list_contains(doms, 'photo') THEN 'photo' ELSE {DOMAIN_SQL} END AS photo_head,
               CASE WHEN {DOMAIN_SQL} IN ('interests', 'bio', 'descriptors') THEN {DOMAIN_SQL} WHEN list_contains(doms, 'interests') THEN 'interests'
                    WHEN list_contains(doms, 'bio') THEN 'bio' WHEN list_contains(doms, 'descriptors') THEN 'descriptors' ELSE {DOMAIN_SQL} END AS text_head
        FROM domain_sets""",
)
def feedback_domain_set(t):
    doms = FB.domain_set("feedback_domain", "details")
    df = t.feedback.withColumn("doms", doms)
    return df.select(
        "id",
        F.array_join(F.array_sort("doms"), ",").alias("domains"),
        FB.effective_domain("feedback_domain", F.col("doms"), "photo").alias("photo_head"),
        FB.effective_domain("feedback_domain", F.col("doms"), "text").alias("text_head"),
    )


@query(
    "domain_infer_backfill",
    """
    WITH d AS (SELECT CASE lang WHEN 'fr' THEN 'interests' WHEN 'de' THEN 'photo' WHEN 'es' THEN 'descriptors' END AS primary_domain,
                      CASE lang WHEN 'de' THEN 'bio' ELSE '' END AS secondary FROM feedback WHERE feedback_domain = 'Other')
    SELECT coalesce(primary_domain, 'unchanged') AS primary_domain, secondary, count(*) AS n FROM d GROUP BY ALL""",
)
def domain_infer_backfill(t):
    found = t.feedback.filter(FB.normalize_domain("feedback_domain") == "other").select(FB.inferred_domains("details").alias("d"))
    primary = F.coalesce(F.try_element_at("d", F.lit(1)), F.lit("unchanged"))
    secondary = F.array_join(F.slice("d", 2, 5), ",")
    return found.groupBy(primary.alias("primary_domain"), secondary.alias("secondary")).agg(F.count("*").alias("n"))


@query(
    "plain_agree_predicate",
    "SELECT id FROM feedback WHERE feedback_domain = 'Other' AND details LIKE '%quick_agree%'",
)
def plain_agree_predicate(t):
    plain = FB.is_plain_agree(F.lit("Real"), F.col("feedback_domain"), F.col("label"), F.col("details"))
    return t.feedback.filter(plain).select("id")


@query(
    "needs_backfill",
    """SELECT l_returnflag, count(*) FILTER (l_returnflag = 'R' OR l_linestatus <> 'F' OR l_discount = 0.05 OR l_tax = 0.05) AS needed, count(*) AS rows
       FROM lineitem GROUP BY 1""",
)
def needs_backfill(t):
    df = t.lineitem.withColumn("l_tax", F.when(F.col("l_returnflag") != "R", F.col("l_tax")))
    needed = X.needs_backfill(["l_discount", "l_tax"], F.col("l_linestatus") == "F", sentinel=0.05)
    df = df.withColumn("needed", needed | (F.col("l_linestatus") != "F"))
    return df.groupBy("l_returnflag").agg(F.count_if("needed").alias("needed"), F.count("*").alias("rows"))


@query(
    "detail_override",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 0 ELSE l_discount END::DOUBLE AS d,
              CASE l_returnflag WHEN 'A' THEN 0.25 ELSE l_tax END::DOUBLE AS x FROM lineitem""",
)
def detail_override(t):
    table = {"A": {"d": 1.0, "x": 0.25}, "R": {"d": 0.0}}
    columns = LB.detail_override(F.col("l_returnflag"), {"d": F.col("l_discount"), "x": F.col("l_tax")}, table)
    return t.lineitem.select(*KEYS, *[c.alias(n) for n, c in columns.items()])


@query(
    "schedule_window",
    """SELECT event_id, isodow(ts) IN (1, 3, 6) AND (m >= 1320 OR m <= 90) AS night, isodow(ts) IN (6, 7) AND m BETWEEN 540 AND 1050 AS weekend
       FROM (SELECT *, hour(ts) * 60 + minute(ts) AS m FROM events)""",
)
def schedule_window(t):
    return t.events.select(
        "event_id",
        N.within_schedule("ts", [0, 2, 5], "22:00", "01:30").alias("night"),
        N.within_schedule("ts", [5, 6], "09:00", "17:30").alias("weekend"),
    )


@query(
    "list_match_class",
    """SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' OR p_name = 'red gear' THEN 'match' WHEN p_name LIKE '%bolt%' THEN 'neg' ELSE '' END AS tag_class FROM part""",
)
def list_match_class(t):
    return t.part.select("p_partkey", T.list_class("p_name", ["Ríng", "big red gear box"], ["bolt"]).alias("tag_class"))


@query(
    "neutral_fill",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' OR l_discount > 0.08 THEN 0.5 ELSE l_discount END::DOUBLE AS a,
              CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_tax END::DOUBLE AS b, CAST(l_returnflag = 'R' AS INTEGER) AS failed FROM lineitem""",
)
def neutral_fill(t):
    failed = F.col("l_returnflag") == "R"
    a = F.when(F.col("l_discount") <= 0.08, F.col("l_discount"))
    filled = N.neutral_fill(failed, {"a": (a, 0.5), "b": (F.col("l_tax"), 0.0)})
    return t.lineitem.select(*KEYS, *[c.alias(n) for n, c in filled.items()], failed.cast("int").alias("failed"))


@query(
    "decision_snapshot",
    f"""SELECT id, {half_up('p', 4)} AS probability, {half_up('CASE WHEN p >= 0.5 THEN p ELSE 1 - p END', 4)} AS confidence,
               model_decision AS decision, CASE WHEN p >= 0.6 THEN 'long text' ELSE '' END AS first_reason FROM feedback""",
)
def decision_snapshot(t):
    reasons = F.array_compact(F.array(F.when(F.col("p") >= 0.6, "long text"), F.when(F.col("toxic") == 1, "flagged")))
    snap = LB.decision_snapshot(
        {"probability": F.col("p"), "confidence": L.confidence("p", "model_decision")},
        {"decision": F.col("model_decision")},
        {"pro_like": reasons},
    )
    frozen = t.feedback.select("id", snap.alias("ai_snapshot"))
    first = F.get_json_object("ai_snapshot", "$.groups.pro_like[0]")
    return frozen.select(
        "id",
        F.get_json_object("ai_snapshot", "$.probability").cast("double").alias("probability"),
        F.get_json_object("ai_snapshot", "$.confidence").cast("double").alias("confidence"),
        F.get_json_object("ai_snapshot", "$.decision").alias("decision"),
        F.when(first == "long text", first).otherwise("").alias("first_reason"),
    )


@query(
    "balance_parse",
    """SELECT event_id, k - 50 AS remaining, CASE WHEN event_type = 'click' THEN NULL ELSE k - 70 END AS alc_remaining, 0 AS new_alc_remaining,
              greatest(0, k - 50) + CASE WHEN event_type = 'click' THEN 0 ELSE greatest(0, k - 70) END AS total_available, k > 50 AS available
       FROM decisions WHERE event_type <> 'error'""",
)
def balance_parse(t):
    body = F.expr(
        """'{"data":{"super_likes":{"remaining":' || (k - 50) || ',"alc_remaining":' ||
           CASE WHEN event_type = 'click' THEN '"none"' ELSE CAST(k - 70 AS STRING) END || ',"new_alc_remaining":0}}}'"""
    )
    df = t.decisions.withColumn("body", F.when(F.col("event_type") != "error", body).otherwise("not json"))
    parsed = df.select("event_id", *[c.alias(n) for n, c in C.balance_parse("body").items()])
    return parsed.filter(F.col("available").isNotNull())


@query(
    "calibration_offer",
    """SELECT id FROM final_words WHERE greatest(p, 1 - p) >= 0.8 AND details NOT IN ('', '{"quick_agree":true}')
       AND (CASE final_word WHEN 'SUPER' THEN 'LIKE' ELSE final_word END) <> (CASE model_decision WHEN 'CURTIR' THEN 'LIKE' ELSE 'PASS' END)""",
)
def calibration_offer(t):
    target = L.has_detail("details", *FB.STRUCTURED_KEYS)
    offer = L.offer_calibration(
        F.col("p"),
        L.normalize_decision("model_decision"),
        F.when(L.normalize_decision("final_decision") == "MAYBE", "").otherwise(F.col("final_decision")),
        target,
    )
    return t.feedback.filter(offer).select("id")


@query(
    "detail_signal_kind",
    """SELECT id, CASE WHEN lang = 'en' THEN 'interest' WHEN lang = 'fr' THEN 'descriptor' WHEN lang = 'de' THEN 'descriptor' ELSE 'bio' END AS kind FROM items""",
)
def detail_signal_kind(t):
    value = F.when(F.col("lang") == "en", F.upper("source")).when(F.col("lang") == "fr", F.concat(F.lit("SIZE: "), F.col("size_class")))
    value = value.when(F.col("lang") == "de", F.lit("other: thing")).otherwise(F.lit("free text"))
    tags, attrs = F.array("lang", "source"), F.create_map(F.lit("size"), F.col("size_class"))
    return t.items.select("id", A.signal_kind(value, tags, attrs).alias("kind"))
