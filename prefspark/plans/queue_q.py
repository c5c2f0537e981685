"""Queries of the review queue, keep-one rules, sorts and caps (survey 2.5-2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.functions import feedback as FB
from prefspark.functions.numeric import half_up as rounded
from prefspark.operators import bucketed as B
from prefspark.operators import heads
from prefspark.operators import keys as K
from prefspark.operators import labelled as LB
from prefspark.operators import review_queue as Q
from prefspark.plans.matching import keys_of_reviews
from prefspark.plans.registry import half_up, query
from prefspark.plans.tables import VIEWS


@query(
    "latest_per_key",
    """SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events
       WHERE event_type IN ('click', 'error') GROUP BY user_id""",
)
def latest_per_key(t):
    rated = t.events.filter(F.col("event_type").isin("click", "error"))
    return Q.latest_per_key(rated, ["user_id"], ["event_id"], ["event_type", "event_id"])


VIEWS["normal_keys"] = "SELECT * FROM live_keys WHERE review_mode = 'auto'"
VIEWS["pending_dups"] = """
    WITH w AS (SELECT kind, key, bool_or(review_status <> 'pending') AS finished,
                      arg_max(review_id, (created_at, -review_id)) FILTER (review_status = 'pending') AS winner FROM normal_keys GROUP BY 1, 2)
    SELECT DISTINCT review_id FROM normal_keys JOIN w USING (kind, key) WHERE review_status = 'pending' AND (finished OR review_id <> winner)"""


@query("dedupe_keep_newest", "SELECT review_id, 'duplicate: already in the review queue' AS reason FROM pending_dups")
def dedupe_keep_newest(t):
    return Q.duplicate_pending(t.reviews, "review_id", keys_of_reviews())


VIEWS["history_rows"] = """
    SELECT *, CASE WHEN age = 3 THEN 's' || target_signature ELSE 'i' || target_index END AS target FROM reviews WHERE review_mode <> 'auto'"""
VIEWS["history_dups"] = """
    WITH w AS (SELECT target, bool_or(review_status <> 'pending') AS handled,
                      arg_max(review_id, (created_at, -review_id)) FILTER (review_status = 'pending') AS winner FROM history_rows GROUP BY 1),
    a AS (SELECT review_id, CASE WHEN handled THEN 'duplicate: history target already handled' WHEN review_id <> winner
                 THEN 'duplicate: history target already pending' END AS reason FROM history_rows JOIN w USING (target) WHERE review_status = 'pending'),
    b AS (SELECT DISTINCT x.review_id FROM live_keys x JOIN live_keys y ON x.kind = y.kind AND x.key = y.key
          WHERE x.review_mode = 'history' AND x.review_status = 'pending' AND x.kind <> 'name_age' AND y.review_mode = 'auto' AND y.review_status <> 'pending')
    SELECT review_id, coalesce(a.reason, CASE WHEN b.review_id IS NOT NULL THEN 'duplicate: already reviewed in the normal queue' END) AS reason
    FROM a LEFT JOIN b USING (review_id) WHERE a.reason IS NOT NULL OR b.review_id IS NOT NULL"""


def history_reviews(t):
    index = F.when(F.col("age") != 3, F.col("target_index").cast("string"))
    return t.reviews.withColumn("target_index", index)


@query("dedupe_history", "SELECT * FROM history_dups")
def dedupe_history(t):
    return Q.duplicate_history(history_reviews(t), "review_id", keys_of_reviews(), "target_index", "target_signature")


@query(
    "skip_absolute",
    """SELECT review_id, CASE WHEN hit THEN 'skipped' ELSE review_status END AS review_status, CASE WHEN hit THEN 'filtro_absoluto: far' ELSE '' END AS feedback_reason,
              CASE WHEN hit THEN 'filtered_pass' ELSE '' END AS preference_tier
       FROM (SELECT *, review_status = 'pending' AND review_mode = 'auto' AND age > 20 AS hit FROM reviews)""",
)
def skip_absolute(t):
    marked = Q.skip_absolute(t.reviews, "review_id", F.when(F.col("age") > 20, "far"))
    return marked.select("review_id", "review_status", "feedback_reason", "preference_tier")


@query(
    "queue_cleanup",
    """
    WITH gone AS (SELECT review_id FROM reviews WHERE review_status = 'pending' AND review_mode = 'auto' AND age > 20),
    k AS (SELECT * EXCLUDE (review_status), CASE WHEN review_id IN (SELECT review_id FROM gone) THEN 'skipped' ELSE review_status END AS review_status FROM live_keys),
    w AS (SELECT kind, key, bool_or(review_status <> 'pending') AS finished,
                 arg_max(review_id, (created_at, -review_id)) FILTER (review_status = 'pending') AS winner FROM k WHERE review_mode = 'auto' GROUP BY 1, 2),
    dup AS (SELECT DISTINCT review_id FROM k JOIN w USING (kind, key) WHERE review_mode = 'auto' AND review_status = 'pending' AND (finished OR review_id <> winner)),
    k2 AS (SELECT * EXCLUDE (review_status), CASE WHEN review_id IN (SELECT review_id FROM dup) THEN 'skipped' ELSE review_status END AS review_status FROM k),
    hw AS (SELECT target, bool_or(review_status <> 'pending') AS handled,
                  arg_max(review_id, (created_at, -review_id)) FILTER (review_status = 'pending') AS winner FROM history_rows GROUP BY 1),
    h AS (SELECT review_id FROM history_rows JOIN hw USING (target) WHERE review_status = 'pending' AND (handled OR review_id <> winner)
          UNION SELECT x.review_id FROM k2 x JOIN k2 y ON x.kind = y.kind AND x.key = y.key WHERE x.review_mode = 'history' AND x.review_status = 'pending'
                AND x.kind <> 'name_age' AND y.review_mode = 'auto' AND y.review_status <> 'pending')
    SELECT 'absolute' AS rule, count(*) AS hidden FROM gone UNION ALL SELECT 'pending', count(*) FROM dup UNION ALL SELECT 'history', count(*) FROM h""",
)
def queue_cleanup(t):
    reason = F.when(F.col("age") > 20, "far")
    return Q.queue_cleanup(history_reviews(t), "review_id", keys_of_reviews(), "target_index", "target_signature", reason)


VIEWS["actions"] = """
    SELECT user_id, event_id, CASE WHEN event_type IN ('click', 'view') THEN 'apply' WHEN event_type = 'purchase' THEN 'undo'
           WHEN value > 40 THEN 'skip' ELSE 'open' END AS action, CASE event_type WHEN 'click' THEN 'LIKE' ELSE 'PASS' END AS decision FROM events"""


def actions(t):
    return t.events.selectExpr(
        "user_id",
        "event_id",
        "CASE WHEN event_type IN ('click', 'view') THEN 'apply' WHEN event_type = 'purchase' THEN 'undo' "
        "WHEN value > 40 THEN 'skip' ELSE 'open' END AS action",
        "CASE event_type WHEN 'click' THEN 'LIKE' ELSE 'PASS' END AS decision",
    )


@query(
    "apply_undo_review",
    """
    WITH u AS (SELECT user_id, coalesce(max(event_id) FILTER (action = 'undo'), -1) AS undo FROM actions GROUP BY 1),
    f AS (SELECT a.user_id, bool_or(action = 'skip' AND event_id > undo) AS skipped, arg_min(decision, event_id) FILTER (action = 'apply' AND event_id > undo) AS decision
          FROM actions a JOIN u USING (user_id) GROUP BY 1),
    s AS (SELECT user_id, decision, CASE WHEN skipped OR (decision IS NOT NULL AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) THEN 'skipped'
                 WHEN decision IS NOT NULL THEN 'reviewed' ELSE 'pending' END AS review_status FROM f)
    SELECT user_id, review_status, CASE WHEN review_status = 'reviewed' THEN decision ELSE '' END AS decision FROM s""",
)
def apply_undo_review(t):
    trained = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return Q.review_state(actions(t), "user_id", "event_id", trained)


@query(
    "remove_last_match",
    """SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT max(o_orderkey) FROM orders JOIN customer ON o_custkey = c_custkey
       WHERE c_acctbal > 5000 GROUP BY o_custkey)""",
)
def remove_last_match(t):
    rows = t.reviews.select(F.col("review_id").alias("o_orderkey"), F.col("full_name").alias("name"), "age")
    targets = t.customer.filter("c_acctbal > 5000").select(F.upper("c_name").alias("name"), F.col("c_nationkey").alias("age"))
    return LB.remove_last_match(rows, "name", "age", ["o_orderkey"], targets).select("o_orderkey")


@query(
    "best_per_key",
    """SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey
       ORDER BY l_linestatus = 'F' DESC, l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem) WHERE rn = 1""",
)
def best_per_key(t):
    rank = [F.col("l_linestatus") == "F", F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    return Q.best_per_key(t.lineitem, ["l_partkey"], rank, ["l_orderkey", "l_linenumber"])


NOW_SQL = "(SELECT max(epoch_us(o_orderdate)) FROM orders)"
VIEWS["asset_counts"] = """
    SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS consolidated, count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'O') AS pending
    FROM orders GROUP BY 1"""


@query(
    "asset_training_counts",
    """SELECT name_key, CAST(sum(consolidated) AS BIGINT) AS consolidated, CAST(sum(pending) AS BIGINT) AS pending FROM (
        SELECT lower(full_name) AS name_key, CAST(review_status = 'reviewed' AS BIGINT) AS consolidated, CAST(review_status <> 'reviewed' AS BIGINT) AS pending FROM reviews WHERE review_mode <> 'auto'
        UNION ALL SELECT lower(full_name), 0, 1 FROM reviews WHERE review_mode = 'auto' AND review_status = 'pending') GROUP BY 1""",
)
def asset_training_counts(t):
    trained = t.reviews.filter(Q.is_history()).select(
        F.lower("full_name").alias("name_key"),
        (F.col("review_status") == "reviewed").cast("bigint").alias("consolidated"),
        (F.col("review_status") != "reviewed").cast("bigint").alias("pending"),
    )
    queued = t.reviews.filter(~Q.is_history() & (F.col("review_status") == "pending")).select(
        F.lower("full_name").alias("name_key"), F.lit(0).cast("bigint").alias("consolidated"), F.lit(1).cast("bigint").alias("pending")
    )
    return trained.unionByName(queued).groupBy("name_key").agg(F.sum("consolidated").alias("consolidated"), F.sum("pending").alias("pending"))


@query(
    "retention_candidates",
    f"""
    WITH a AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) AS mtime FROM orders),
    c AS (SELECT o_custkey, consolidated, pending FROM asset_counts),
    r AS (SELECT a.*, row_number() OVER (PARTITION BY o_custkey ORDER BY mtime, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM a),
    e AS (SELECT r.o_orderkey, mtime FROM r LEFT JOIN c USING (o_custkey) WHERE CASE WHEN coalesce(pending, 0) = 0 AND coalesce(consolidated, 0) = 0
          THEN {NOW_SQL} - mtime >= 86400000000 * 365 ELSE r <= least(n - pending, consolidated) END)
    SELECT o_orderkey, evict_order FROM (SELECT *, row_number() OVER (ORDER BY mtime, o_orderkey) AS evict_order FROM e)
    WHERE evict_order <= (SELECT greatest(count(*) - 4000, 0) FROM a)""",
)
def retention_candidates(t):
    day = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    assets = t.orders.select("o_orderkey", "o_custkey", day.alias("mtime"))
    counts = t.orders.groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("consolidated"),
        F.count_if((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O")).alias("pending"),
    )
    now = t.orders.agg(F.max(day)).scalar()
    return Q.retention_candidates(
        assets, counts, ["o_custkey"], "mtime", "o_orderkey", now, 365 * B.DAY, 4000, 90 * B.DAY
    ).select("o_orderkey", "evict_order")


@query(
    "review_counts",
    """WITH c AS (SELECT c_custkey AS asset, count(user_id) AS n FROM customer LEFT JOIN events ON user_id = c_custkey AND event_type = 'click' GROUP BY 1)
       SELECT n AS reviews, count(*) AS assets, (SELECT coalesce(min(asset) FILTER (asset > 1200), min(asset)) FROM c WHERE n = 0) AS next_asset FROM c GROUP BY n""",
)
def review_counts(t):
    seen = t.events.filter("event_type = 'click'").groupBy(F.col("user_id").alias("asset")).agg(F.count("*").alias("n"))
    counted = t.customer.select(F.col("c_custkey").alias("asset")).join(seen, "asset", "left").fillna(0, ["n"])
    by_reviews = counted.groupBy(F.col("n").alias("reviews")).agg(F.count("*").alias("assets"))
    return by_reviews.withColumn("next_asset", Q.next_unreviewed(counted, "asset", "n", 1200).scalar())


@query("priority_sort", f"SELECT review_id, {half_up('p', 4)} AS review_priority FROM reviews WHERE review_status = 'pending'")
def priority_sort(t):
    pending = t.reviews.filter("review_status = 'pending'").withColumn("review_priority", rounded("p", 4))
    ordered = pending.orderBy(F.desc("review_priority"), F.desc("created_at"), "review_id")
    return ordered.select("review_id", "review_priority")


@query(
    "sort_modes",
    """WITH r AS (SELECT review_id, created_at, age <> 7 AS available, p FROM reviews WHERE review_status = 'pending')
       SELECT * FROM (SELECT 'priority' AS sort_mode, row_number() OVER (ORDER BY available DESC, p DESC, created_at DESC, review_id) AS position, review_id FROM r)
       UNION ALL SELECT * FROM (SELECT 'uncertain', row_number() OVER (ORDER BY available DESC, abs(p - 0.5), created_at DESC, review_id) AS position, review_id FROM r)
       UNION ALL SELECT * FROM (SELECT 'confident', row_number() OVER (ORDER BY available DESC, abs(p - 0.5) DESC, created_at DESC, review_id) AS position, review_id FROM r)
       UNION ALL SELECT * FROM (SELECT 'recent', row_number() OVER (ORDER BY available DESC, created_at DESC, review_id) AS position, review_id FROM r)""",
)
def sort_modes(t):
    """The whole queue in each mode, with its position there."""
    pending = t.reviews.filter("review_status = 'pending'").withColumns(
        {"asset_available": F.col("age") != 7, "review_priority": F.col("p")}
    )
    ranked = [
        B.with_position(Q.sort_reviews(pending, mode, "review_id").select("review_id")).select(F.lit(mode).alias("sort_mode"), "position", "review_id")
        for mode in Q.SORT_MODES
    ]
    return ranked[0].unionByName(ranked[1]).unionByName(ranked[2]).unionByName(ranked[3])


@query(
    "page_slice",
    """SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 100""",
)
def page_slice(t):
    ordered = t.customer.orderBy(F.desc("c_acctbal"), "c_custkey")
    return Q.page_slice(ordered, 2, 50).select("c_custkey", "c_acctbal")


HISTORY_SCORE_SQL = half_up(
    """CASE c_mktsegment WHEN 'BUILDING' THEN 2 ELSE 0 END + CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 2 ELSE 0 END
       + CASE WHEN c_nationkey < 12 THEN 1.5e0 ELSE 0 END + CASE WHEN c_nationkey % 3 = 0 THEN 0.5e0 ELSE 0 END
       + CASE WHEN c_acctbal < 0 THEN 0.8e0 ELSE (1 - abs(least(1, c_acctbal / 1e4) - 0.5e0) * 2) * 1.5e0 END
       + CASE WHEN c_acctbal > 9000 THEN 0.8e0 ELSE 0 END""",
    4,
)
VIEWS["history_scores"] = f"SELECT c_custkey, c_name, c_nationkey, c_mktsegment, c_acctbal, {HISTORY_SCORE_SQL} AS score FROM customer"


def history_scores(t):
    c = F.col
    score = Q.history_score(
        F.when(c("c_mktsegment") != "BUILDING", "bio").otherwise(""),
        F.when(~c("c_mktsegment").isin("BUILDING", "HOUSEHOLD"), "text").otherwise(" "),
        F.when(c("c_nationkey") < 12, "{}").otherwise('{"a":1}'),
        F.when(c("c_nationkey") % 3 == 0, "0.0").otherwise("1"),
        F.when(c("c_acctbal") >= 0, c("c_acctbal") / F.lit(10000.0)),
        [(c("c_acctbal") > 9000, 0.8)],
    )
    return t.customer.withColumn("score", score)


@query(
    "history_score_topk",
    f"""SELECT c_custkey, score, {half_up('greatest(0.7, least(0.99, 0.45e0 + score / 10))', 4)} AS review_priority FROM history_scores
        ORDER BY score DESC, c_custkey LIMIT 40""",
)
def history_score_topk(t):
    top = history_scores(t).orderBy(F.desc("score"), "c_custkey").limit(40)
    return top.select("c_custkey", "score", Q.history_priority(F.col("score"), F.lit(0.7)).alias("review_priority"))


VIEWS["history_context"] = """
    SELECT * FROM reviews"""
VIEWS["history_stage"] = """
    SELECT s.*, CASE WHEN score < 2 THEN 'low_score' WHEN c_custkey IN (SELECT target_index FROM history_context WHERE review_mode <> 'auto') THEN 'handled'
           WHEN c_nationkey = 5 THEN 'no_asset'
           WHEN c_custkey IN (SELECT o_custkey FROM history_context WHERE review_mode = 'auto' AND (review_status = 'pending' OR url <> '')) THEN 'same_item'
           ELSE 'actionable' END AS stage
    FROM history_scores s"""


def history_stages(t):
    """Every old row tagged with the reason it is (not) offered for a second review."""
    context = t.reviews
    history, pending = Q.is_history(), F.col("review_status") == "pending"
    handled = context.filter(history).select(F.col("target_index").alias("c_custkey")).distinct().withColumn("_handled", F.lit(True))
    rows = history_scores(t)
    url = F.concat(F.lit("https://img.example.com/u/"), F.col("c_custkey"), F.lit("/"), F.col("c_nationkey"), F.lit(".jpg"))
    probe = K.explode_keys(rows, K.review_keys(name=F.col("c_name"), age=F.col("c_nationkey"), url=url), "c_custkey")
    review_keys = keys_of_reviews()
    known = K.explode_keys(context.filter(~history & pending), review_keys).unionByName(
        K.explode_keys(context.filter(~history & ~pending), review_keys, strong_only=True)
    )
    same = K.matching_ids(probe, known, "c_custkey").withColumn("_same", F.lit(True))
    stage = (
        F.when(F.col("score") < 2.0, "low_score")
        .when(F.coalesce("_handled", F.lit(False)), "handled")
        .when(F.col("c_nationkey") == 5, "no_asset")
        .when(F.coalesce("_same", F.lit(False)), "same_item")
        .otherwise("actionable")
    )
    return rows.join(handled, "c_custkey", "left").join(same, "c_custkey", "left").withColumn("stage", stage)


@query("funnel_counts", "SELECT stage, count(*) AS n FROM history_stage GROUP BY 1")
def funnel_counts(t):
    return history_stages(t).groupBy("stage").agg(F.count("*").alias("n"))


@query("history_anti_join", "SELECT c_custkey, score FROM history_stage WHERE stage = 'actionable' ORDER BY score DESC, c_custkey LIMIT 40")
def history_anti_join(t):
    actionable = history_stages(t).filter("stage = 'actionable'")
    return actionable.orderBy(F.desc("score"), "c_custkey").limit(40).select("c_custkey", "score")


@query(
    "recheck_enqueue",
    """SELECT id, greatest(0.92, least(0.99, 0.45e0 + 0.5e0)) AS review_priority FROM feedback WHERE feedback_domain = 'Other' AND details LIKE '%quick_agree%'
       AND id NOT IN (SELECT target_index FROM reviews WHERE review_mode = 'quick_agree_recheck')""",
)
def recheck_enqueue(t):
    plain = FB.is_plain_agree(F.lit("real"), F.col("feedback_domain"), F.col("label"), F.col("details"))
    asked = t.reviews.filter(F.col("review_mode") == Q.RECHECK_MODE).select(F.col("target_index").alias("id")).distinct()
    fresh = t.feedback.filter(plain).join(asked, "id", "left_anti")
    priority = F.greatest(Q.history_priority(F.lit(5.0), F.lit(None).cast("double")), F.lit(0.92))
    return fresh.select("id", priority.alias("review_priority"))


VIEWS["arrivals"] = """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'id:' || user_id WHEN event_id % 3 = 1 THEN 'hash:h' || user_id % 50
                          WHEN user_id % 7 <> 0 THEN 'name:' || lower(c_name) || ':' || user_id % 7 END AS key,
           CASE WHEN user_id % 7 <> 0 THEN 'name:' || lower(c_name) || ':' || user_id % 7 END AS also
    FROM events JOIN customer ON c_custkey = user_id WHERE event_type IN ('view', 'click')"""


@query(
    "bounded_queue",
    """
    WITH r AS (SELECT unnest(['id:' || user_id, CASE WHEN user_id % 7 <> 0 THEN 'name:' || lower(c_name) || ':' || user_id % 7 END]) AS key FROM events
               JOIN customer ON c_custkey = user_id WHERE event_type = 'purchase' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 36 HOUR),
    q AS (SELECT 'id:' || c_custkey AS key FROM customer WHERE c_acctbal < 0),
    o AS (SELECT a.*, CASE WHEN a.key IN (SELECT key FROM r WHERE key IS NOT NULL) OR coalesce(also IN (SELECT key FROM r WHERE key IS NOT NULL), false) THEN 'recent'
                           WHEN a.key IN (SELECT key FROM q) THEN 'duplicate' END AS outcome FROM arrivals a),
    f AS (SELECT *, CASE WHEN outcome IS NULL AND key IS NOT NULL AND row_number() OVER (PARTITION BY key, outcome ORDER BY event_id) > 1 THEN 'duplicate' ELSE outcome END AS now FROM o),
    p AS (SELECT *, row_number() OVER (PARTITION BY now ORDER BY event_id) AS place FROM f)
    SELECT event_id, CASE WHEN now IS NOT NULL THEN now WHEN place <= greatest(0, 400 - (SELECT count(*) FROM q)) THEN 'added' ELSE 'dropped' END AS outcome FROM p""",
)
def bounded_queue(t):
    years, kind = F.col("user_id") % 7, F.col("event_type")
    seen = t.events.join(t.customer.select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id")
    item = F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string"))
    content = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("h"), F.col("user_id") % 50))
    incoming = seen.filter(kind.isin("view", "click")).select(
        "event_id", Q.queue_key(item, content, F.col("c_name"), years).alias("key"), Q.name_age_key(F.col("c_name"), years).alias("also")
    )
    both = F.array(F.concat(F.lit("id:"), "user_id"), Q.name_age_key(F.col("c_name"), years))
    done = seen.filter(kind == "purchase").select(F.explode(both).alias("key"), F.col("ts").alias("at")).filter("key IS NOT NULL")
    since = t.events.agg(F.max("ts") - F.expr("INTERVAL 36 HOURS")).scalar()
    queued = t.customer.filter("c_acctbal < 0").select(F.concat(F.lit("id:"), "c_custkey").alias("key"))
    return Q.admit(incoming, "event_id", "key", "also", done, since, queued, 400).select("event_id", "outcome")


@query("batch_queue", "SELECT conv_id, turns FROM (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1) ORDER BY conv_id DESC LIMIT 100")
def batch_queue(t):
    """Batches waiting for work, one per conversation: each takes the place of the oldest once a hundred wait."""
    waiting = t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"))
    return Q.make_room(waiting, "conv_id", 100)


@query(
    "retrain_trigger",
    """SELECT user_id, event_id, n = 1 OR floor(n / 10) > floor((n - 1) / 10) AS retrain FROM
       (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)""",
)
def retrain_trigger(t):
    counted = B.ordered_scan(t.events.select("user_id", "event_id"), ["user_id"], "event_id", "event_id", 4096, row_number="n")
    return counted.select("user_id", "event_id", LB.retrain_trigger(F.col("n") - 1, F.col("n"), 10).alias("retrain"))


@query(
    "coverage_report",
    f"""SELECT feature_group, filled, n - filled AS empty, {half_up('filled * 100e0 / n', 4)} AS percent FROM
        (SELECT count(*) AS n, count(*) FILTER (l_discount <> 0) AS discount, count(*) FILTER (l_tax <> 0) AS tax, count(*) FILTER (l_returnflag <> 'N') AS flag
         FROM lineitem) UNPIVOT (filled FOR feature_group IN (discount, tax, flag))""",
)
def coverage_report(t):
    df = t.lineitem.withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("N")))
    return LB.coverage(df, {"discount": "l_discount", "tax": "l_tax", "flag": "l_returnflag"})


@query(
    "class_mean_direction",
    f"""SELECT feature, {half_up('avg(v) FILTER (label = 1)', 6)} AS like_mean, {half_up('avg(v) FILTER (label = 0)', 6)} AS pass_mean,
               CASE WHEN avg(v) FILTER (label = 1) > avg(v) FILTER (label = 0) THEN 'like' ELSE 'pass' END AS direction
        FROM (SELECT label, unnest(['n_chars', 'src_no', 'p']) AS feature, unnest([n_chars::DOUBLE, src_no::DOUBLE, p]) AS v FROM labelled) GROUP BY 1""",
)
def class_mean_direction(t):
    means = heads.class_mean_direction(t.labelled, "label", ["n_chars", "src_no", "p"])
    return means.select("feature", rounded("like_mean", 6).alias("like_mean"), rounded("pass_mean", 6).alias("pass_mean"), "direction")
