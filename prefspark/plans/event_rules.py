"""Queries of the stateful event rules (survey 2.6 and the as-of joins of 2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.operators import event_rules as E
from prefspark.operators.bucketed import HOUR
from prefspark.operators.sessions import session_summary as summarize
from prefspark.plans.registry import half_up, query
from prefspark.plans.tables import VIEWS

H = HOUR
BY_USER = "(PARTITION BY user_id ORDER BY us, event_id)"


@query(
    "dedupe_ttl_refresh",
    f"SELECT event_id, coalesce(us - lag(us) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) <= {24 * H}, false) AS is_duplicate FROM decisions",
)
def dedupe_ttl_refresh(t):
    flagged = E.dedupe_ttl(t.decisions, ["user_id", "event_type"], "us", "event_id", 24 * H)
    return flagged.select("event_id", "is_duplicate")


@query("inactivity_gap", f"SELECT event_id, coalesce((us - lag(us) OVER {BY_USER}) / 1e6, -1) AS seconds FROM decisions")
def inactivity_gap(t):
    gaps = E.inactivity_gap(t.decisions, ["user_id"], "us", "event_id")
    return gaps.select("event_id", F.coalesce(F.col("gap") / F.lit(1e6), F.lit(-1.0)).alias("seconds"))


@query(
    "event_dedupe_upgrade",
    f"""
    WITH a AS (SELECT *, value > 20 AS rich, lag(us) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) AS prev FROM decisions),
    b AS (SELECT *, CASE WHEN prev IS NULL OR us - prev > {48 * H} THEN 1 ELSE 0 END AS fresh FROM a),
    c AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) AS sess FROM b),
    d AS (SELECT *, coalesce(sum(rich::INTEGER) OVER (PARTITION BY user_id, event_type, sess ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM c)
    SELECT event_id, CASE WHEN fresh = 1 THEN 'new' WHEN rich AND seen = 0 THEN 'duplicate_with_body' ELSE 'duplicate' END AS status FROM d""",
)
def event_dedupe_upgrade(t):
    marked = E.dedupe_upgrade(t.decisions, ["user_id", "event_type"], "us", "event_id", F.col("value") > 20, 48 * H)
    return marked.select("event_id", "status")


@query(
    "asof_freshness",
    f"""SELECT c.event_id, coalesce(CASE WHEN c.us - v.us <= {12 * H} THEN v.value END, -1) AS value, coalesce(CASE WHEN c.us - v.us <= {12 * H} THEN c.us - v.us END, -1) AS age
        FROM (SELECT * FROM decisions WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM decisions WHERE event_type = 'view') v
        ON c.user_id = v.user_id AND c.us >= v.us""",
)
def asof_freshness(t):
    probes, readings = t.decisions.filter("event_type = 'click'"), t.decisions.filter("event_type = 'view'")
    found = E.asof_freshness(probes, readings, ["user_id"], "us", "event_id", "value", 12 * H)
    return found.select("event_id", F.coalesce("value", F.lit(-1.0)).alias("value"), F.coalesce("age", F.lit(-1)).alias("age"))


@query(
    "recent_exists",
    f"""SELECT event_id, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {24 * H} PRECEDING AND 1 PRECEDING) > 0 AS recent
        FROM decisions""",
)
def recent_exists(t):
    seen = E.recent_exists(t.decisions, ["user_id"], "us", F.col("event_type") == "purchase", 24 * H)
    return seen.select("event_id", "recent")


@query(
    "hysteresis_state",
    f"""SELECT event_id, coalesce(last_value(CASE WHEN value >= 40 THEN 1 WHEN value < 15 THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS state FROM decisions""",
)
def hysteresis_state(t):
    states = E.hysteresis(t.decisions, ["user_id"], "us", "event_id", F.col("value") >= 40, F.col("value") < 15)
    return states.select("event_id", "state")


@query(
    "generation_filter",
    f"""
    WITH g AS (SELECT *, sum((event_type = 'error')::INTEGER) OVER {BY_USER} AS gen FROM decisions),
    s AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN gen END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stamp FROM g)
    SELECT event_id, coalesce(stamp = gen, false) AS is_current FROM s WHERE event_type = 'purchase'""",
)
def generation_filter(t):
    kind = F.col("event_type")
    kept = E.generation_filter(t.decisions, ["user_id"], "us", "event_id", kind == "error", kind == "click", kind == "purchase")
    return kept.select("event_id", "is_current")


def cooldown_sql(source: str, key: str, seconds: int) -> str:
    return f"""
    WITH RECURSIVE src AS ({source}), chain AS (
        SELECT {key}, min(us) AS us FROM src GROUP BY {key}
        UNION ALL
        SELECT c.{key}, (SELECT min(s.us) FROM src s WHERE s.{key} = c.{key} AND s.us >= c.us + {seconds}) FROM chain c WHERE c.us IS NOT NULL)
    SELECT src.event_id, src.{key} FROM chain JOIN src ON src.{key} = chain.{key} AND src.us = chain.us"""


@query("cooldown_suppress", cooldown_sql("SELECT event_id, user_id, us FROM decisions WHERE event_type = 'error'", "user_id", 36 * H))
def cooldown_suppress(t):
    errors = t.decisions.filter("event_type = 'error'")
    return E.cooldown(errors, ["user_id"], "us", "event_id", 36 * H).select("event_id", "user_id")


@query(
    "rolling_threshold_alert",
    cooldown_sql(
        f"""SELECT event_id, event_type, us FROM (SELECT *, count(*) OVER (PARTITION BY event_type ORDER BY us RANGE BETWEEN {2 * H} PRECEDING AND CURRENT ROW) AS n
            FROM decisions) WHERE n >= 9""",
        "event_type",
        6 * H,
    ),
)
def rolling_threshold_alert(t):
    alerts = E.threshold_alerts(t.decisions, ["event_type"], "us", "event_id", 2 * H, 9, 6 * H)
    return alerts.select("event_id", "event_type")


@query(
    "flipflop_suppress",
    f"""
    WITH RECURSIVE seq AS (SELECT user_id, event_id, us, event_type AS who, row_number() OVER {BY_USER} AS n FROM decisions),
    walk AS (
        SELECT user_id, event_id, n, false AS ignored, who AS cur, '' AS prev, us AS changed FROM seq WHERE n = 1
        UNION ALL
        SELECT s.user_id, s.event_id, s.n, s.who <> w.cur AND s.who = w.prev AND s.us - w.changed <= {30 * H},
               CASE WHEN s.who <> w.cur AND s.who = w.prev AND s.us - w.changed <= {30 * H} THEN w.cur ELSE s.who END,
               CASE WHEN s.who <> w.cur AND NOT (s.who = w.prev AND s.us - w.changed <= {30 * H}) THEN w.cur ELSE w.prev END,
               CASE WHEN s.who <> w.cur AND NOT (s.who = w.prev AND s.us - w.changed <= {30 * H}) THEN s.us ELSE w.changed END
        FROM walk w JOIN seq s ON s.user_id = w.user_id AND s.n = w.n + 1)
    SELECT event_id, ignored FROM walk""",
)
def flipflop_suppress(t):
    named = t.decisions.withColumn("name", F.lit("same"))
    flagged = E.flipflop(named, ["user_id"], "us", "event_id", "event_type", "name", 30 * H)
    return flagged.select("event_id", "ignored")


VIEWS["judged"] = """
    SELECT event_id, user_id, ts, value, event_type, CASE WHEN event_type IN ('click', 'purchase') THEN 'LIKE' ELSE 'PASS' END AS final,
           event_type = 'purchase' AS super, CASE WHEN value >= 20 THEN 'LIKE' ELSE 'PASS' END AS model, event_type <> 'view' AS prompted
    FROM events WHERE event_type <> 'error'"""


@query(
    "session_summary",
    f"""
    WITH a AS (SELECT user_id, count(*) AS total, count(*) FILTER (final = 'LIKE') AS likes, count(*) FILTER (super) AS super_likes, count(*) FILTER (final = 'PASS') AS passes,
               count(*) FILTER (model = 'LIKE') AS model_likes, count(*) FILTER (prompted) AS prompts, count(*) FILTER (final <> model) AS corrected,
               count(*) FILTER (final <> model AND final = 'LIKE') AS corrected_to_like, {half_up("avg(value) FILTER (final = 'LIKE')", 4)} AS like_score,
               {half_up("avg(value) FILTER (final = 'PASS')", 4)} AS pass_score FROM judged GROUP BY 1),
    tags AS (SELECT user_id, string_agg(event_type || ' (' || n || ')', ', ' ORDER BY n DESC, event_type) AS top_tags FROM
             (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM (SELECT user_id, event_type, count(*) AS n FROM judged GROUP BY 1, 2))
             WHERE rn <= 5 GROUP BY 1)
    SELECT a.*, {half_up('likes / total', 4)} AS like_rate, {half_up('CASE WHEN prompts > 0 THEN corrected / prompts ELSE 0 END', 4)} AS correction_rate,
           CASE WHEN prompts >= 10 AND corrected / prompts >= 0.35 THEN 'train more' WHEN prompts >= 10 AND corrected / prompts <= 0.15 THEN 'well aligned' ELSE '' END AS advice,
           top_tags FROM a JOIN tags USING (user_id)""",
)
def session_summary(t):
    kind = F.col("event_type")
    judged = t.events.filter("event_type <> 'error'").select(
        "user_id",
        F.when(kind.isin("click", "purchase"), "LIKE").otherwise("PASS").alias("final"),
        (kind == "purchase").alias("super"),
        F.when(F.col("value") >= 20, "LIKE").otherwise("PASS").alias("model"),
        (kind != "view").alias("prompted"),
        "value",
        kind.alias("tag"),
    )
    return summarize(judged, ["user_id"], score="value", tag="tag", top=5)
