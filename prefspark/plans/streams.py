"""Streaming queries (survey 2.10), each drained over the whole table and compared with its batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.functions.numeric import half_up as rounded
from prefspark.functions.text import normalize_key
from prefspark.operators import event_rules as E
from prefspark.operators import heads as M
from prefspark.operators.bucketed import HOUR
from prefspark.plans.event_rules import cooldown_sql
from prefspark.plans.feature_store import TEXT_FEATURES, fit_both, score_frame, training_frame
from prefspark.plans.registry import half_up, query
from prefspark.plans.scalars import NKEY, item_features
from prefspark.plans.tables import Tables
from prefspark.session import cut_lineage, scratch_path
from prefspark.streaming import jobs, rules, runner

H = HOUR


def stream_of(t: Tables, table: str):
    """A table of the driver as a stream of its file."""
    return runner.file_stream(t.spark, t.sf_dir, getattr(t, table).schema, f"{table}.parquet")


#: Replays: parts in time order, the query stopped and started between them; one row in seven comes up to DELAY late.
PARTS, DELAY, LATE, WAIT = 5, 6 * H, 7, "6 hours"


def decision_rows(t: Tables, frame):
    return frame.select(
        "event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"
    )


def replayed(t: Tables, rows, rule, purpose: str):
    """Deliver ``rows`` in time order with late ones, then a row without keys from after the end, whose watermark releases all that
    waits; ``rule`` maps the stream to its result."""
    path = scratch_path(t.spark, purpose)
    end = rows.agg((F.max("us") + 2 * DELAY + 1000).alias("us"))
    close = end.select(*[(F.col("us") if c == "us" else F.timestamp_micros("us") if c == "ts" else F.lit(None).cast(k)).alias(c) for c, k in rows.dtypes])
    parts = runner.time_ordered(rows, "us", PARTS, DELAY, F.pmod(F.xxhash64("event_id"), F.lit(LATE)) == 0)
    return runner.drain_parts(lambda folder: rule(runner.file_stream(t.spark, folder, rows.schema)), [*parts, close], path)


def decision_stream(t: Tables):
    return decision_rows(t, stream_of(t, "events"))


@query(
    "stream_dedupe_ttl",
    f"SELECT event_id, coalesce(us - lag(us) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) <= {24 * H}, false) AS is_duplicate FROM decisions",
)
def stream_dedupe_ttl(t):
    rule = lambda s: rules.stream_dedupe_ttl(s, ["user_id", "event_type"], "us", "event_id", 24 * H, event_time="ts", delay=WAIT)
    return replayed(t, decision_rows(t, t.events), rule, "dedupe").filter("user_id IS NOT NULL").select("event_id", "is_duplicate")


@query("stream_dedupe_watermark", "SELECT DISTINCT user_id, event_type, false AS too_close FROM decisions")
def stream_dedupe_watermark(t):
    """Which row of a key comes first depends on arrival; that every key comes, and none twice within the watermark, does not."""
    keys = ["user_id", "event_type"]
    rule = lambda s: rules.stream_dedupe_watermark(s, keys, "ts", "24 hours")
    first = replayed(t, decision_rows(t, t.events), rule, "watermark").filter("user_id IS NOT NULL")
    gaps = E.inactivity_gap(first.select(*keys, "us", "event_id"), keys, "us", "event_id")
    return gaps.groupBy(*keys).agg(F.coalesce(F.min("gap") <= 24 * H, F.lit(False)).alias("too_close"))


@query(
    "stream_alerts",
    cooldown_sql(
        f"""SELECT event_id, rule, us FROM (SELECT *, count(*) OVER (PARTITION BY rule ORDER BY us RANGE BETWEEN {6 * H} PRECEDING AND CURRENT ROW) AS n FROM
            (SELECT event_id, us - us % 1000 AS us, unnest(CASE event_type WHEN 'error' THEN ['fatal'] WHEN 'purchase' THEN ['storm', 'sale'] ELSE [] END) AS rule FROM decisions)) WHERE n >= 6""",
        "rule",
        12 * H,
    ),
)
def stream_alerts(t):
    """Events written as log lines, tailed as a text stream, matched by rules, thresholded and cooled down."""
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    text = F.when(F.col("event_type") == "purchase", "Timeout storm; sale").otherwise("ok")
    line = F.concat_ws(" | ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), level, F.lit("main"), F.lit("app"), F.concat(F.col("event_id"), F.lit(" "), text))
    logs = scratch_path(t.spark, "logs")
    end = t.events.agg(F.date_format(F.timestamp_micros(F.unix_micros(F.max(F.col("ts").cast("timestamp"))) + 2 * DELAY), "yyyy-MM-dd HH:mm:ss,SSS").alias("ts"))
    parts = runner.time_ordered(decision_rows(t, t.events), "us", PARTS, DELAY, F.pmod(F.xxhash64("event_id"), F.lit(LATE)) == 0)
    out = None
    for part in [*(p.select(line.alias("value")) for p in parts), end.select(F.concat("ts", F.lit(" | INFO | main | app | end of log")).alias("value"))]:
        part.write.mode("append").text(f"{logs}/in")
        parsed = rules.parse_log(t.spark.readStream.text(f"{logs}/in"))
        found = rules.match_rules(parsed, (("fatal", r"\b(ERROR|CRITICAL)\b"), ("storm", "timeout storm"), ("sale", "SALE"), ("end", "end of log")), F.concat_ws(" ", "level", "message"))
        events = found.select("rule", "us", "ts", F.try_to_number(F.split("message", " ")[0], F.lit("9999999999999999999")).cast("bigint").alias("event_id"))
        out = runner.drain(rules.stream_alerts(events, ["rule"], "us", "event_id", 6 * H, 6, 12 * H, event_time="ts", delay=WAIT), logs)
    return out.filter("rule <> 'end'").select("event_id", "rule")


@query(
    "stream_session_stats",
    f"""
    WITH s AS (SELECT user_id, us, value, event_type, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS gap FROM decisions WHERE event_type <> 'error'),
    g AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= {6 * H} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS sess,
                 event_type IN ('click', 'purchase') AS liked, (event_type IN ('click', 'purchase')) <> (value >= 20) AS moved FROM s)
    SELECT user_id, min(us) AS first, count(*) AS total, count(*) FILTER (liked) AS likes, count(*) FILTER (event_type = 'purchase') AS super_likes,
           count(*) FILTER (NOT liked) AS passes, count(*) FILTER (value >= 20) AS model_likes, count(*) FILTER (event_type <> 'view') AS prompts,
           count(*) FILTER (moved) AS corrected, count(*) FILTER (moved AND liked) AS corrected_to_like, count(*) FILTER (moved AND NOT liked) AS corrected_to_pass,
           max(us) + {6 * H} <= (SELECT max(us) // 1000 - {6 * H} // 1000 FROM decisions WHERE event_type <> 'error') * 1000 AS closed
    FROM g GROUP BY user_id, sess""",
)
def stream_session_stats(t):
    kind = F.col("event_type")
    judged = decision_rows(t, t.events).filter(kind != "error").select(
        "event_id",
        "user_id",
        "us",
        "ts",
        "value",
        F.when(kind.isin("click", "purchase"), "LIKE").otherwise("PASS").alias("final"),
        (kind == "purchase").alias("super"),
        F.when(F.col("value") >= 20, "LIKE").otherwise("PASS").alias("model"),
        (kind != "view").alias("prompted"),
    )
    path = scratch_path(t.spark, "sessions")
    parts = runner.time_ordered(judged, "us", PARTS, DELAY, F.pmod(F.xxhash64("event_id"), F.lit(LATE)) == 0)
    rule = lambda folder: rules.stream_session_stats(runner.file_stream(t.spark, folder, judged.schema), "user_id", "us", "ts", 6 * H, WAIT, "value")
    found = rules.sessions_of(runner.drain_parts(rule, parts, path), "user_id")
    return found.select("user_id", "first", *rules.SESSION_COUNTS[:-2], "closed")


CAPTURE = """'{"phase":"' || CASE WHEN event_type = 'view' THEN 'start' ELSE 'Complete' END || '","url":"https://api.example.com/' || CASE WHEN event_type = 'click' THEN 'like/' ELSE 'pass/' END
    || user_id || '?x=1","method":"' || CASE WHEN event_type = 'signup' THEN 'GET' ELSE 'post' END || '","status":' || CASE WHEN value > 60 THEN 500 ELSE 200 END || ',"response":{"body":"'
    || CASE WHEN value > 20 THEN '{\\\\"likes_remaining\\\\":' || CAST(floor(value / 5) AS INT) || '}' ELSE '' END || '"}}'"""


@query(
    "stream_confirmations",
    f"""
    WITH k AS (SELECT event_id, us, CASE WHEN event_type = 'click' THEN 'like' ELSE 'pass' END AS action, user_id, value > 20 AS rich, CAST(floor(value / 5) AS INTEGER) AS remaining
               FROM decisions WHERE event_type NOT IN ('view', 'signup') AND value <= 60),
    a AS (SELECT *, lag(us) OVER (PARTITION BY action, user_id ORDER BY us, event_id) AS prev FROM k),
    b AS (SELECT *, CASE WHEN prev IS NULL OR us - prev > {48 * H} THEN 1 ELSE 0 END AS fresh FROM a),
    c AS (SELECT *, sum(fresh) OVER (PARTITION BY action, user_id ORDER BY us, event_id) AS sess FROM b),
    d AS (SELECT *, coalesce(sum(rich::INTEGER) OVER (PARTITION BY action, user_id, sess ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM c)
    SELECT event_id, action, CASE WHEN fresh = 1 THEN 'new' ELSE 'duplicate_with_body' END AS status, rich AND remaining <= 5 AS low_balance
    FROM d WHERE fresh = 1 OR (rich AND seen = 0)""",
)
def stream_confirmations(t):
    captured = decision_rows(t, t.events).select("event_id", "us", "ts", F.expr(CAPTURE).alias("body"))

    def rule(stream):
        parsed = rules.parse_confirmations(stream, "body", "api.example.com", keep_null=True)
        return rules.stream_upgrade(parsed, ["action", "item_id"], "us", "event_id", "has_body", 48 * H, ["likes_remaining"], event_time="ts", delay=WAIT)

    seen = replayed(t, captured, rule, "confirm").filter("event_id IS NOT NULL AND seen_status <> 'duplicate'")
    low = F.coalesce(F.col("likes_remaining") <= 5, F.lit(False))
    return seen.select("event_id", "action", F.col("seen_status").alias("status"), low.alias("low_balance"))


@query(
    "stream_score",
    f"""SELECT min(doc_id) AS id, true AS scored FROM (SELECT doc_id, md5({NKEY.format('text')}) AS h FROM documents)
        WHERE h NOT IN (SELECT md5({NKEY.format('text')}) FROM documents JOIN labels USING (doc_id)) GROUP BY h""",
)
def stream_score(t):
    """Documents as they arrive, some of them twice and in other batches: texts that are labelled or queued are left out, the rest is
    scored by the model in use. The probabilities come from fitted trees; that every one is there and valid is compared."""
    frame = training_frame(t)
    text, asset = fit_both(t.spark, frame)
    hashed = F.md5(normalize_key("text"))
    # written once: every batch reads it
    trained = cut_lineage(t.labelled.select(hashed.alias("h")).distinct())

    def known(batch):
        return batch.withColumn("h", hashed).join(trained, "h", "left_anti")

    def score(batch):
        items = Tables(t.spark, t.sf_dir)
        items.__dict__["documents"] = batch
        scored = score_frame(item_features(items.items, ("id", "lang", "src_no")), text, asset)
        return batch.select("h", F.col("doc_id").alias("id")).join(scored, "id").select("id", "h", "probability", "decision", "review_priority")

    path, again = scratch_path(t.spark, "score"), F.col("doc_id") % 5 == 0
    edge = t.documents.agg(F.percentile_approx("doc_id", F.array(F.lit(0.33), F.lit(0.66))).alias("e")).first()["e"] or [0, 0]
    first, second = F.col("doc_id") <= edge[0], F.col("doc_id") <= edge[1]
    parts = [t.documents.filter(first), t.documents.filter((second & ~first) | (first & again)), t.documents.filter(~second | again)]
    queue = None
    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        stream = runner.file_stream(t.spark, f"{path}/in", t.documents.schema)
        queue = jobs.stream_score(stream, path, score, known, "h", "doc_id", "id bigint, h string, probability double, decision string, review_priority double")
    return queue.select("id", F.col("probability").between(0, 1).alias("scored"))


@query(
    "stream_centroid",
    f"""SELECT label, pos, {half_up('avg(x)', 6)} AS mean, count(*) AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS pos FROM embeddings)
        GROUP BY label, pos""",
)
def stream_centroid(t):
    folder = runner.replay(t.embeddings, scratch_path(t.spark, "vectors"), 3)
    stream = runner.file_stream(t.spark, folder, t.embeddings.schema, files_per_trigger=1)
    merged = jobs.stream_centroid(stream, scratch_path(t.spark, "centroid"), "label", "embedding")
    return merged.select("label", F.col("pos").cast("bigint").alias("pos"), rounded("mean", 6).alias("mean"), "n")


@query(
    "stream_retrain",
    """WITH p AS (SELECT CAST((doc_id - (SELECT min(doc_id) FROM labels)) // ((SELECT max(doc_id) - min(doc_id) FROM labels) // 4 + 1) AS BIGINT) AS batch_id, count(*) AS n FROM labels GROUP BY 1),
        c AS (SELECT *, CAST(sum(n) OVER (ORDER BY batch_id) AS BIGINT) AS total FROM p),
        f AS (SELECT *, batch_id = 0 OR total // 100 > (total - n) // 100 AS retrained FROM c)
        SELECT *, CAST(max(CASE WHEN retrained THEN batch_id END) OVER (ORDER BY batch_id) AS BIGINT) AS version FROM f""",
)
def stream_retrain(t):
    """Labels arrive in four batches, the query stopped between them; each retraining fits the linear head on all labels so far."""
    path, rows = scratch_path(t.spark, "retrain"), t.labels
    frame = training_frame(t)

    def fit(labels):
        known = frame.join(labels.select(F.col("doc_id").alias("id")), "id", "left_semi")
        return M.fit_head(known, TEXT_FEATURES, "label", "w_text", M.HeadConfig(min_rows=1 << 60))

    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    part, log = F.floor((F.col("doc_id") - low) / F.lit((high - low) // 4 + 1)), None
    for k in range(4):
        rows.filter(part == k).write.mode("append").parquet(f"{path}/in")
        log = jobs.stream_retrain(runner.file_stream(t.spark, f"{path}/in", rows.schema), path, 100, fit)
    return log
