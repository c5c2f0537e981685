"""Queries of weights, folds, heads, stacking and scoring (survey 2.9)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from prefspark.functions import feedback as FB
from prefspark.functions import labels as L
from prefspark.functions.numeric import half_up as rounded
from prefspark.functions.numeric import word_by_cuts
from prefspark.operators import heads as M
from prefspark.operators import review_queue as Q
from prefspark.operators import scoring as S
from prefspark.plans.registry import half_up, query
from prefspark.plans.scalars import item_features
from prefspark.plans.tables import VIEWS
from prefspark.session import cut_lineage, scratch_path

TEXT_FEATURES = ("text_length", "text_words", "positive_keywords", "negative_keywords", "tag_overlap", "flag_western")
ASSET_FEATURES = ("brightness", "sharpness", "distance_score", "distance_missing", "name_length")
META_FEATURES = ("text_oof", "asset_oof", "brightness", "distance_score")
# the shipped 160 trees of depth 4; the out-of-fold queries fit ten heads each and use fewer trees
SHIPPED = M.HeadConfig()
FOLDS = M.HeadConfig(trees=5, depth=3)

VIEWS["weight_rows"] = """
    SELECT *, CASE WHEN src_no >= 18 THEN 'synthetic' WHEN src_no = 17 THEN 'photo_deep' ELSE 'Real' END AS origin,
           CASE WHEN list_contains(doms, 'photo') THEN 'photo' ELSE lower(feedback_domain) END AS photo_dom,
           CASE WHEN lower(feedback_domain) IN ('interests', 'bio', 'descriptors') THEN lower(feedback_domain) WHEN list_contains(doms, 'interests') THEN 'interests'
                WHEN list_contains(doms, 'bio') THEN 'bio' ELSE lower(feedback_domain) END AS text_dom,
           CASE lang WHEN 'fr' THEN 0.85e0 WHEN 'de' THEN 1.35e0 ELSE 1 END AS im, CASE feedback_reason WHEN 'contexto' THEN 0.55e0 ELSE 1 END AS rm,
           CASE WHEN manual_corrected = '1.0' THEN 1.35e0 ELSE 1 END * CASE WHEN manual_corrected = '1.0' AND label = 0 AND model_decision = 'CURTIR' THEN 2.75e0 ELSE 1 END
           * (1 + 0.5e0 * (1 - abs(p - 0.5e0) * 2)) AS extra FROM domain_sets"""


def weight_rows(t):
    origin = F.when(F.col("src_no") >= 18, "synthetic").when(F.col("src_no") == 17, "photo_deep").otherwise("Real")
    return t.feedback.withColumn("origin", origin)


def weighted(df, head, out):
    return M.sample_weight(
        df,
        head,
        source="origin",
        domain="feedback_domain",
        domains=FB.domain_set("feedback_domain", "details"),
        details="details",
        reason="feedback_reason",
        intensity="feedback_intensity",
        corrected="manual_corrected",
        label="label",
        model_like=L.normalize_decision("model_decision").isin("LIKE", "SUPER"),
        p=F.col("p"),
        out=out,
    )


@query(
    "sample_weights",
    f"""
    WITH b AS (SELECT id, extra,
        CASE origin WHEN 'synthetic' THEN 0.35e0 WHEN 'photo_deep' THEN 1.6e0 ELSE CASE photo_dom WHEN 'photo' THEN 2.6e0 WHEN 'descriptors' THEN 0.35e0 WHEN 'other' THEN 0.45e0 ELSE 0.25e0 END
             * im * CASE WHEN photo_dom = 'photo' THEN rm ELSE 1 END END AS photo_w,
        CASE origin WHEN 'synthetic' THEN 0.35e0 WHEN 'photo_deep' THEN 0.35e0 ELSE CASE text_dom WHEN 'photo' THEN 0.25e0 WHEN 'descriptors' THEN 2e0 WHEN 'other' THEN 0.45e0 ELSE 2.4e0 END * im END AS text_w
        FROM weight_rows)
    SELECT id, {half_up('least(8, photo_w * extra)', 6)} AS photo_weight, {half_up('least(8, text_w * extra)', 6)} AS text_weight FROM b""",
)
def sample_weights(t):
    both = weighted(weighted(weight_rows(t), "photo", "w_photo"), "text", "w_text")
    return both.select("id", rounded("w_photo", 6).alias("photo_weight"), rounded("w_text", 6).alias("text_weight"))


@query("head_labels", "SELECT id, CASE lang WHEN 'de' THEN 1 - label ELSE label END AS photo_label, label AS text_label FROM feedback")
def head_labels(t):
    return t.feedback.select(
        "id",
        M.head_label(F.col("label"), "details", "photo").alias("photo_label"),
        M.head_label(F.col("label"), "details", "text").alias("text_label"),
    )


@query("feature_matrix")
def feature_matrix(t):
    matrix = M.feature_matrix(item_features(t.items), [*TEXT_FEATURES, *ASSET_FEATURES], ["id"])
    return matrix.select("id", F.array_join(F.transform(vector_to_array("raw_features"), lambda x: F.format_number(x, 4)), " ").alias("matrix_row"))


FOLD_SQL = """SELECT id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY CAST('0x' || substr(md5(id || ':42'), 1, 15) AS BIGINT), id) - 1) % 5 AS INTEGER) AS fold FROM labelled"""


@query("stratified_oof", FOLD_SQL)
def stratified_oof(t):
    """Fold assignment; the out-of-fold scores themselves are in ``oof_scores``."""
    return M.stratified_folds(t.labelled, "id", "label").select("id", "label", "fold")


def training_frame(t):
    """Labelled items with their wide features, head labels and weights, written once: a fit reads them many times."""
    keep = ("id", "label", "p", "toxic", "lang", "details", "feedback_intensity", "w_text", "w_photo")
    rows = weighted(weighted(weight_rows(t), "photo", "w_photo"), "text", "w_text")
    return cut_lineage(item_features(rows, keep))


@query("fit_head")
def fit_head(t):
    frame = training_frame(t)
    model = M.fit_head(frame, TEXT_FEATURES, "label", "w_text", SHIPPED)
    return M.score(model, frame, TEXT_FEATURES, "text_p").select("id", "label", rounded("text_p", 6).alias("text_p"))


def oof_frame(t):
    # the folds read this frame many times: materialize the text features once
    frame = cut_lineage(M.stratified_folds(training_frame(t), "id", "label"))
    text = M.out_of_fold(frame, TEXT_FEATURES, "label", "text_oof", "w_text", FOLDS)
    measured = frame.filter(F.col("brightness") > 0.2)
    asset = M.out_of_fold(measured, ASSET_FEATURES, "label", "asset_oof", "w_photo", FOLDS).select("id", "asset_oof")
    joined = text.select("id", "label", "fold", "brightness", "distance_score", "text_oof").join(asset, "id", "left")
    return joined.withColumn("asset_oof", F.coalesce("asset_oof", F.lit(0.5)))


@query("oof_scores")
def oof_scores(t):
    return oof_frame(t).select("id", "fold", rounded("text_oof", 6).alias("text_oof"), rounded("asset_oof", 6).alias("asset_oof"))


@query("meta_stack_platt")
def meta_stack_platt(t):
    frame = cut_lineage(oof_frame(t))
    model = M.fit_stack(frame, META_FEATURES, "label")
    return model.transform(frame).select("id", "label", rounded("meta_probability", 6).alias("meta_probability"))


@query("second_head")
def second_head(t):
    liked = training_frame(t).filter("label = 1")
    strong = (F.col("toxic") == 1) | (F.col("lang") == "es")
    model = M.fit_second_head(liked, TEXT_FEATURES, strong, F.col("feedback_intensity"), "details", SHIPPED)
    return M.score(model, liked, TEXT_FEATURES, "strong_p").select("id", rounded("strong_p", 6).alias("strong_p"))


@query("asset_head")
def asset_head(t):
    """Latest like/dislike per asset from the event log, joined to asset measurements, fitted as its own head."""
    rated = t.events.filter("event_type IN ('click', 'error')").withColumn("c_custkey", F.col("user_id"))
    latest = Q.latest_per_key(rated, ["c_custkey"], ["event_id"], ["event_type", "value"])
    assets = latest.join(t.customer, "c_custkey").withColumn("liked", (F.col("event_type") == "click").cast("int"))
    model = M.fit_asset_head(assets, ["c_acctbal", "c_nationkey", "value"], "liked")
    return M.score(model, assets, ["c_acctbal", "c_nationkey", "value"], "asset_p").select("c_custkey", rounded("asset_p", 6).alias("asset_p"))


@query("model_save_load_guard")
def model_save_load_guard(t):
    """Save a head, load it under the same contract, and under a changed feature order (which is refused)."""
    frame, path = training_frame(t), scratch_path(t.spark, "models")
    heads, lists = {"text": M.fit_head(frame, TEXT_FEATURES, "label", "w_text", SHIPPED)}, {"text": TEXT_FEATURES}
    M.save_models(heads, lists, 21, path, t.spark)
    loaded = M.load_models(lists, 21, path, t.spark)
    refused = M.load_models({"text": TEXT_FEATURES[::-1]}, 21, path, t.spark)
    scored = M.score(loaded["text"], frame, TEXT_FEATURES, "text_p")
    return scored.select("id", rounded("text_p", 6).alias("text_p"), F.lit(refused is None).alias("changed_order_refused"))


@query("top_features")
def top_features(t):
    model = M.fit_head(training_frame(t), TEXT_FEATURES, "label", "w_text", SHIPPED)
    return M.top_features(M.importances(model, TEXT_FEATURES, t.spark), 3)


@query("importance_blend")
def importance_blend(t):
    frame = training_frame(t)
    text = M.importances(M.fit_head(frame, TEXT_FEATURES, "label", "w_text", SHIPPED), TEXT_FEATURES, t.spark)
    asset = M.importances(M.fit_head(frame, ASSET_FEATURES, "label", "w_photo", SHIPPED), ASSET_FEATURES, t.spark)
    return M.blend_importances([(text, 0.15), (asset, 0.85)])


# --- scoring expressions over the orders table: three scores in [0, 1] per row ---
VIEWS["scores"] = """
    SELECT o_orderkey AS id, o_totalprice / 5e5 AS model, (o_custkey % 100) / 1e2 AS pref, (o_orderkey % 50) / 5e1 AS heur, o_orderstatus = 'F' AS negative,
           o_orderpriority = '1-URGENT' AS favourable, o_orderpriority = '5-LOW' AS partial, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE (o_custkey % 40) * 1e0 END AS distance FROM orders"""


def scores(t):
    return t.orders.selectExpr(
        "o_orderkey AS id",
        "o_totalprice / 500000D AS model",
        "(o_custkey % 100) / 100D AS pref",
        "(o_orderkey % 50) / 50D AS heur",
        "o_orderstatus = 'F' AS negative",
        "o_orderpriority = '1-URGENT' AS favourable",
        "o_orderpriority = '5-LOW' AS partial",
        "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_custkey % 40 AS DOUBLE) END AS distance",
    )


VIEWS["scored"] = f"""
    SELECT *, CASE WHEN negative THEN raw ELSE greatest(0.5, raw) END AS txt, {half_up('CASE WHEN favourable THEN greatest(blend, greatest(0, heur - 0.12e0)) ELSE blend END', 4)} AS ast
    FROM (SELECT *, {half_up('model * 0.6e0 + pref * 0.4e0', 4)} AS raw, least(1, model * 0.35e0 + heur * 0.65e0) AS blend FROM scores)"""
VIEWS["combined"] = f"""
    SELECT *, {half_up('least(1, ast * 0.85e0 + txt * 0.15e0)', 4)} AS comb FROM scored"""
VIEWS["moved"] = """
    SELECT *, CASE WHEN distance IS NULL THEN comb ELSE greatest(0, least(1, comb + (greatest(0, 1 - distance / 4e1) - 0.5e0) * 0.08e0)) END AS adj FROM combined"""
VIEWS["caps"] = """
    SELECT *, CASE WHEN (txt >= 0.5) <> (ast >= 0.5) THEN 'heads disagree'
        WHEN abs(txt - 0.5e0) >= 0.2e0 AND abs(ast - 0.5e0) >= 0.2e0 AND abs(model - 0.5e0) >= 0.2e0 AND abs(heur - 0.5e0) >= 0.2e0 AND favourable THEN 'strong agreement'
        WHEN abs(txt - 0.5e0) < 0.08e0 OR abs(ast - 0.5e0) < 0.08e0 OR partial THEN 'weak evidence' ELSE 'default cap' END AS why FROM moved"""
VIEWS["safe"] = f"""
    SELECT *, {half_up('CASE WHEN adj >= 0.5 THEN least(adj, cap) ELSE greatest(adj, 1 - cap) END', 4)} AS safe_p
    FROM (SELECT *, CASE why WHEN 'heads disagree' THEN 0.78e0 WHEN 'strong agreement' THEN 0.95e0 WHEN 'weak evidence' THEN 0.84e0 ELSE 0.92e0 END AS cap FROM caps)"""


def with_text(df):
    return df.withColumns(S.text_score(F.col("model"), F.col("pref"), F.col("negative")))


def with_asset(df):
    return df.withColumn("asset_score", S.head_blend(F.col("model"), F.col("heur"), F.col("favourable")))


def with_probability(df):
    combined = with_asset(with_text(df)).withColumn("combined", S.combine(F.col("asset_score"), F.col("text_score")))
    fit = F.greatest(F.lit(0.0), 1.0 - F.col("distance") / 40.0)
    moved = combined.withColumn("adjusted", S.distance_adjust(F.col("combined"), fit, F.col("distance").isNull()))
    c = F.col
    capped = moved.withColumns(
        S.confidence_cap(c("text_score"), c("asset_score"), c("model"), c("heur"), c("favourable"), c("partial"))
    )
    return capped.withColumns(S.probability_safety(c("adjusted"), c("cap")))


@query("text_score_blend", "SELECT id, raw AS text_raw, txt AS text_score FROM scored")
def text_score_blend(t):
    return with_text(scores(t)).select("id", "text_raw", "text_score")


@query("head_blend_floor", "SELECT id, ast AS asset_score FROM scored")
def head_blend_floor(t):
    return with_asset(scores(t)).select("id", "asset_score")


@query("score_combine", "SELECT id, comb AS combined FROM combined")
def score_combine(t):
    return with_probability(scores(t)).select("id", "combined")


@query("distance_adjust", f"SELECT id, {half_up('adj', 6)} AS adjusted FROM moved")
def distance_adjust(t):
    return with_probability(scores(t)).select("id", rounded("adjusted", 6).alias("adjusted"))


@query("probability_safety", f"SELECT id, why AS cap_reason, safe_p AS probability, {half_up('adj', 4)} AS raw_probability FROM safe")
def probability_safety(t):
    return with_probability(scores(t)).select("id", "cap_reason", "probability", "raw_probability")


@query(
    "strong_gate",
    """SELECT id, coalesce(CASE WHEN adj < 0.48 THEN 'not a like' WHEN safe_p < 0.6 THEN 'probability' WHEN txt < 0.5 THEN 'text score' WHEN ast < 0.6 THEN 'asset score'
              WHEN distance IS NULL THEN 'distance unknown' WHEN distance > 30 THEN 'distance out of range' WHEN partial THEN 'no balance' END, '') AS reason FROM safe""",
)
def strong_gate(t):
    c = F.col
    gate = S.StrongGate(probability=0.6, text=0.5, asset=0.6, distance=(0, 30))
    reason = S.strong_gate(
        c("adjusted") >= 0.48, c("probability"), c("text_score"), c("asset_score"), F.lit(None).cast("double"), c("distance"), ~c("partial"), gate
    )
    return with_probability(scores(t)).select("id", F.coalesce(reason, F.lit("")).alias("reason"))


REASONS = (
    S.ReasonRule("pro", "asset_score >= 0.6", "strong assets"),
    S.ReasonRule("pro", "text_score >= 0.6", "strong text"),
    S.ReasonRule("pro", "distance <= 10", "close by"),
    S.ReasonRule("contra", "asset_score < 0.4", "weak assets"),
    S.ReasonRule("contra", "negative AND text_score < 0.5", "negative text"),
    S.ReasonRule("uncertain", "distance IS NULL", "distance unknown"),
    S.ReasonRule("uncertain", "abs(probability - 0.5) < 0.1", "close call"),
)


@query(
    "reason_groups",
    """SELECT id, coalesce(array_to_string(list_filter([CASE WHEN ast >= 0.6 THEN 'strong assets' END, CASE WHEN txt >= 0.6 THEN 'strong text' END, CASE WHEN distance <= 10 THEN 'close by' END],
              lambda x: x IS NOT NULL)[1:2], '; '), '') AS pro,
              concat_ws('; ', CASE WHEN ast < 0.4 THEN 'weak assets' END, CASE WHEN negative AND txt < 0.5 THEN 'negative text' END) AS contra,
              concat_ws('; ', CASE WHEN distance IS NULL THEN 'distance unknown' END, CASE WHEN abs(safe_p - 0.5) < 0.1 THEN 'close call' END) AS uncertain,
              CASE WHEN safe_p >= 0.72 THEN 'high' WHEN safe_p >= 0.43 THEN 'middle' ELSE 'low' END AS word
       FROM safe""",
)
def reason_groups(t):
    groups = S.reason_groups(REASONS, 2)
    word = word_by_cuts("probability", ((0.72, "high"), (0.43, "middle")), "low")
    return with_probability(scores(t)).select("id", *[F.array_join(c, "; ").alias(g) for g, c in groups.items()], word.alias("word"))


@query(
    "rescore_stale",
    """WITH q AS (SELECT *, CASE WHEN negative THEN 'old' ELSE 'v2' END AS stamp, CASE WHEN model >= 0.48 THEN 'LIKE' ELSE 'PASS' END AS decision FROM safe)
       SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN stamp = 'v2' THEN 'kept' WHEN decision <> CASE WHEN safe_p >= 0.48 THEN 'LIKE' ELSE 'PASS' END THEN 'changed'
              WHEN safe_p <> model THEN 'updated' ELSE 'kept' END AS outcome FROM q) GROUP BY 1""",
)
def rescore_stale(t):
    queue = scores(t).withColumns(
        {"stamp": F.when(F.col("negative"), "old").otherwise("v2"), "decision": F.when(F.col("model") >= 0.48, "LIKE").otherwise("PASS"), "score": F.col("model")}
    )

    def rescore(stale):
        scored = with_probability(stale)
        return scored.select(*queue.columns, F.col("probability").alias("new_p"), F.when(F.col("probability") >= 0.48, "LIKE").otherwise("PASS").alias("new_decision"))

    done = S.rescore_stale(queue, "stamp", "v2", "decision", "score", rescore)
    return done.groupBy("outcome").agg(F.count("*").alias("n"))


@query(
    "uncertain_escalate",
    f"""SELECT id, abs(model - 0.5e0) <= 0.15e0 AND n IS NOT NULL AS escalated, {half_up('CASE WHEN abs(model - 0.5e0) <= 0.15e0 AND n IS NOT NULL THEN mean ELSE model END', 6)} AS p
        FROM scores LEFT JOIN (SELECT l_orderkey, count(*) AS n, avg(l_quantity / 5e1) AS mean FROM lineitem GROUP BY 1) ON l_orderkey = id""",
)
def uncertain_escalate(t):
    available = t.lineitem.select(F.col("l_orderkey").alias("id")).distinct().withColumn("more", F.lit(True))
    rows = scores(t).select("id", F.col("model").alias("p")).join(available, "id", "left")

    def rescore(selected):
        evidence = t.lineitem.withColumnRenamed("l_orderkey", "id").join(selected.select("id"), "id", "left_semi")
        return evidence.groupBy("id").agg(F.avg(F.col("l_quantity") / 50.0).alias("new_p"))

    done = S.escalate(rows, "id", "p", F.coalesce("more", F.lit(False)), rescore)
    return done.select("id", "escalated", rounded("p", 6).alias("p"))


@query("score_items")
def score_items(t):
    """The whole scoring projection: heads, blends, adjustment, cap and policy. Rows only (fitted trees)."""
    frame = training_frame(t)
    text, asset = fit_both(t.spark, frame)
    return score_frame(item_features(t.items, ("id", "lang", "src_no")), text, asset)


def fit_both(spark, frame):
    """Text head, and asset head on the measured rows."""
    measured = frame.filter("brightness > 0.2")
    return M.fit_heads(spark, [(frame, TEXT_FEATURES, "label", "w_text"), (measured, ASSET_FEATURES, "label", "w_photo")], SHIPPED)


def score_frame(features, text, asset):
    """Score a wide feature frame with two fitted heads."""
    c = F.col
    both = features.select(
        "id", c("brightness").alias("heur"), (c("negative_keywords") > 0).alias("negative"), c("distance_score").alias("fit"), c("distance_missing").alias("no_distance"),
        *TEXT_FEATURES, *[f for f in ASSET_FEATURES if f not in TEXT_FEATURES],
    )
    scored = M.score(text, both, TEXT_FEATURES, "text_p")
    scored = M.score(asset, scored, ASSET_FEATURES, "asset_p")
    scored = scored.withColumns(S.text_score(c("text_p"), F.lit(0.5), c("negative")))
    scored = scored.withColumn("asset_score", S.head_blend(c("asset_p"), c("heur"), c("heur") >= 0.6))
    scored = scored.withColumn("combined", S.combine(c("asset_score"), c("text_score")))
    scored = scored.withColumn("adjusted", S.distance_adjust(c("combined"), c("fit"), c("no_distance") > 0))
    scored = scored.withColumns(
        S.confidence_cap(c("text_score"), c("asset_score"), c("text_p"), c("asset_p"), c("heur") >= 0.35, F.lit(False))
    ).withColumns(S.probability_safety(c("adjusted"), c("cap")))
    policy = L.apply_policy("probability", 0.48)
    return scored.select("id", "text_score", "asset_score", "probability", *[v.alias(n) for n, v in policy.items()])
