"""Queries of scans, sources, sinks and schema evolution (survey 2.1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.functions.attrs import SELECTION_SCHEMA, attr_map_extract
from prefspark.operators import labelled as LB
from prefspark.operators import metrics as M
from prefspark.plans.registry import half_up, query
from prefspark.plans.tables import VIEWS
from prefspark.session import cut_lineage, scratch_path
from prefspark.sources import capture as C
from prefspark.sources import nested as N
from prefspark.sources import records as R
from prefspark.sources import report as RP
from prefspark.sources import tables as S

CONTRACT = ("c_custkey", "c_name", "c_mktsegment", "c_note", "c_added")


@query("csv_scan_padded", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, CASE WHEN c_nationkey = 1 THEN '' ELSE c_mktsegment || ', \"x\"' || chr(10) || 'y' END AS c_mktsegment, '' AS c_note, '' AS c_added FROM customer")
def csv_scan_padded(t):
    """Customers exported as CSV and read back under a contract with columns the file does not have."""
    path = scratch_path(t.spark, "csv")
    text = F.when(F.col("c_nationkey") != 1, F.concat("c_mktsegment", F.lit(', "x"\ny')))
    t.customer.select("c_name", "c_custkey", text.alias("c_mktsegment")).write.csv(path, header=True, escape='"')
    return S.csv_scan_padded(t.spark, path, CONTRACT)


VIEWS["old_rows"] = """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'CURTIR' ELSE 'PASSAR' END AS ai_decision, CASE o_orderpriority WHEN '1-URGENT' THEN 'super_like' WHEN '2-HIGH' THEN 'like'
           WHEN '3-MEDIUM' THEN 'talvez' ELSE 'pass' END AS final_decision, CASE o_orderpriority WHEN '5-LOW' THEN '0' ELSE '' END AS label,
           CASE WHEN o_custkey % 5 = 0 THEN '0.25' ELSE '' END AS ranking_score, '{"probability":' || (o_orderkey % 100) / 1e2 || '}' AS ai_snapshot FROM orders"""


def old_rows(t):
    return t.orders.selectExpr(
        "o_orderkey AS name",
        "CASE WHEN o_orderstatus = 'F' THEN 'CURTIR' ELSE 'PASSAR' END AS ai_decision",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'super_like' WHEN '2-HIGH' THEN 'like' WHEN '3-MEDIUM' THEN 'talvez' ELSE 'pass' END AS final_decision",
        "CASE o_orderpriority WHEN '5-LOW' THEN '0' ELSE '' END AS label",
        "CASE WHEN o_custkey % 5 = 0 THEN '0.25' ELSE '' END AS ranking_score",
        "'{\"probability\":' || (o_orderkey % 100) / 100D || '}' AS ai_snapshot",
    )


@query(
    "schema_migrate_derive",
    f"""
    WITH d AS (SELECT *, CASE final_decision WHEN 'talvez' THEN 'maybe' WHEN 'super_like' THEN 'strong_like' WHEN 'like' THEN 'like' ELSE 'pass' END AS tier FROM old_rows),
    c AS (SELECT *, CASE WHEN tier = 'maybe' THEN 'uncertain' WHEN tier = 'strong_like' THEN 'superlike_upgrade' WHEN ai_decision = 'CURTIR' AND tier = 'pass' THEN 'false_positive'
                 WHEN ai_decision = 'PASSAR' AND tier = 'like' THEN 'false_negative' ELSE 'none' END AS correction_type,
                 CASE WHEN ranking_score <> '' THEN 0.25e0 ELSE (o_orderkey % 100) / 1e2 END AS p FROM d)
    SELECT o_orderkey::VARCHAR AS name, tier AS preference_tier, correction_type, p AS ranking_score, '' AS bio,
           {half_up("greatest(0.35e0 + 0.55e0 * (1 - abs(p - 0.5e0) * 2), CASE WHEN correction_type IN ('uncertain', 'false_positive', 'false_negative') THEN 0.9e0 WHEN correction_type = 'superlike_upgrade' THEN 0.75e0 ELSE 0 END)", 4)} AS review_priority
    FROM c""",
)
def schema_migrate_derive(t):
    migrated = S.migrate_derive(old_rows(t))
    return migrated.select(
        "name",
        "preference_tier",
        "correction_type",
        F.col("ranking_score").cast("double").alias("ranking_score"),
        "bio",
        F.col("review_priority").cast("double").alias("review_priority"),
    )


@query(
    "load_all_union",
    """SELECT id, origin, CAST(TRY_CAST(label_text AS DOUBLE) AS INTEGER) AS label_text, CASE WHEN origin = 'synthetic' THEN '' ELSE lang END AS lang FROM profile_rows
       WHERE TRY_CAST(label_text AS DOUBLE) IN (0, 1)""",
)
def load_all_union(t):
    rows = t.profile_rows.select("id", "origin", "label_text", "lang")
    synthetic = F.col("origin") == "synthetic"
    both = LB.load_all_union(rows.filter(~synthetic), rows.filter(synthetic).drop("lang"), "label_text")
    return both.fillna("", ["lang"]).select("id", "origin", "label_text", "lang")


@query(
    "to_contract_row",
    f"""SELECT id, lang || ',' || source AS interests, '{{"lang":"' || lang || '","source":"' || source || '"}}' AS descriptors,
               CASE WHEN lang = 'es' THEN -1 ELSE {half_up('n_chars / 7e0', 6)} END AS measured, label::VARCHAR AS label,
               CASE WHEN final_word = 'MAYBE' THEN 'maybe' WHEN final_word = 'SUPER' OR lang = 'es' THEN 'strong_like' WHEN label = 1 THEN 'like' ELSE 'pass' END AS preference_tier
        FROM final_words""",
)
def to_contract_row(t):
    value = F.when(F.col("lang") != "es", F.col("n_chars") / F.lit(7.0)).otherwise(F.lit(float("nan")))
    columns = S.to_contract_row(
        tags=F.array("lang", "source"),
        attrs=F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang")),
        numbers={"measured": value},
        label=F.col("label"),
        model=F.col("model_decision"),
        final=F.col("final_decision"),
        details=F.col("details"),
    )
    flat = t.feedback.select("id", *[c.alias(n) for n, c in columns.items()]).drop("correction_type")
    return flat.withColumn("measured", F.coalesce(F.nullif("measured", F.lit("")).cast("double"), F.lit(-1.0)))


BATCH_JSON = """'{"data":{"results":[{"type":"ad"},{"type":"user","content_hash":"h' || event_id || '","distance_mi":' || k || ',"user":{"_id":"u' || user_id ||
    '","name":"' || event_type || '","birth_date":"1990-01-01","selected_descriptors":[{"name":" ","section_name":"Kind","choice_selections":[{"name":"' || event_type ||
    '"},{"name":" "},{"name":"b"}]},{"prompt":"Height","measurable_selection":{"value":' || k || ',"unit_of_measure":"cm"}},{"id":"Kind","choice_selections":[{"name":"late"}]}],'
    || '"photos":[{"url":"p0"},{"url":"p1","processedFiles":[{"url":"f0"},{"url":"f1"},{"url":"f2-' || k || '"}]}],"relationship_intent":{"title_text":"","body_text":" long "}},'
    || '"experiment_info":{"user_interests":{"selected_interests":[{"name":"a"},{"name":""},{"name":"' || event_type || '"}]}}}]}}'"""


def batches(t):
    return t.decisions.select("event_id", F.expr(BATCH_JSON).alias("body"))


@query(
    "nested_json_flatten",
    f"""SELECT event_id, 'u' || user_id AS item_id, 'h' || event_id AS content_hash, event_type AS name, 'a,' || event_type AS tags, 'late' AS kind, k || ' cm' AS height,
               'long' AS goal, {half_up('k * 1.609e0', 0)} AS distance_km, 'p0 f2-' || k AS photos FROM decisions""",
)
def nested_json_flatten(t):
    flat = N.flatten_batches(batches(t), "body")
    return flat.select(
        "event_id",
        "item_id",
        "content_hash",
        "name",
        F.array_join("tags", ",").alias("tags"),
        F.col("attrs")["Kind"].alias("kind"),
        F.col("attrs")["Height"].alias("height"),
        F.col("attrs")["Goal"].alias("goal"),
        "distance_km",
        F.array_join("photo_urls", " ").alias("photos"),
    )


SELECTIONS = """'[{"name":"","section_name":" Lang ","choice_selections":[{"name":" ' || lang || '"},{"name":"x"}]},{"id":"size","measurable_selection":{"value":' || n_chars ||
    ',"unit_of_measure":"' || CASE WHEN lang = 'en' THEN 'chars' ELSE '' END || '"}},{"name":"Lang","choice_selections":[{"name":"again"}]},{"name":" ","id":"blank","choice_selections":[{"name":"never"}]},'
    || '{"prompt":"long","choice_selections":[{"name":"' || repeat('z', 301) || '"}]}]'"""


@query(
    "attr_map_extract",
    """SELECT id, 'again' AS lang_value, 301 AS long_value, CASE WHEN lang = 'en' THEN n_chars || ' chars' ELSE n_chars::VARCHAR END AS size_value, 3::BIGINT AS n FROM items""",
)
def attr_map_extract_q(t):
    m = attr_map_extract(F.from_json(F.expr(SELECTIONS), SELECTION_SCHEMA))
    parsed = t.items.select("id", m.alias("m"))
    return parsed.select("id", F.col("m")["Lang"].alias("lang_value"), F.length(F.col("m")["long"]).alias("long_value"), F.col("m")["size"].alias("size_value"), F.size("m").cast("bigint").alias("n"))


TREE = """'{"section_name":"Basics","items":[{"title_text":"Kind","body_text":"' || event_type || '"},{"name":"Level","value":{"text":"' || k || '"}},'
    || '{"title":"Inner","content":{"fields":[{"prompt":"Deep","choice_selections":[{"name":"a"},"b"]}]}}]}'"""


@query(
    "nested_value_coalesce",
    """SELECT event_id, event_type AS kind, k::VARCHAR AS level, 'a, b' AS deep, k::VARCHAR AS shallow, 3::BIGINT AS n FROM decisions""",
)
def nested_value_coalesce(t):
    """Deep trees level by level; the shallow form reads the same value with variant paths."""
    trees = t.decisions.select("event_id", F.expr(TREE).alias("body"), F.expr("""'{"value":{"text":" ' || k || '"}}'""").alias("small"))
    deep = N.deep_attrs(trees, "body").withColumn("small", F.try_variant_get(F.parse_json("small"), "$.value", "variant"))
    return deep.select(
        "event_id",
        F.col("attrs")["Basics: Kind"].alias("kind"),
        F.col("attrs")["Basics: Level"].alias("level"),
        F.col("attrs")["Inner: Deep"].alias("deep"),
        N.shallow_value("small").alias("shallow"),
        F.size("attrs").cast("bigint").alias("n"),
    )


@query(
    "quality_variant_pick",
    """SELECT conv_id, n, CASE WHEN n >= 2 THEN 'v1' ELSE 'v0' END AS high, CASE WHEN n >= 2 THEN 'v' || (n - 2) ELSE 'v0' END AS medium, 'v' || (n - 1) AS low
       FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)""",
)
def quality_variant_pick(t):
    sizes = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"))
    files = F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1), lambda i: F.struct(F.concat(F.lit("v"), i).alias("url")))
    photo = F.struct(F.lit("plain").alias("url"), files.alias("processedFiles"))
    rows = sizes.withColumn("photo", photo)
    return rows.select("conv_id", "n", *[N.pick_variant(F.col("photo"), q).alias(q) for q in ("high", "medium", "low")])


@query(
    "jsonl_scan_tolerant",
    """SELECT 'record' AS kind, event_id, 'p' || user_id AS photo_path, CASE event_type WHEN 'click' THEN 'like' ELSE 'dislike' END AS impression FROM events WHERE event_type IN ('click', 'view')
       UNION ALL SELECT 'rejected', count(*), CASE event_type WHEN 'error' THEN 'broken' WHEN 'signup' THEN 'blank' ELSE 'not an object' END, '' FROM events
       WHERE event_type NOT IN ('click', 'view') GROUP BY event_type""",
)
def jsonl_scan_tolerant(t):
    """A growing log of JSON lines: read, appended to, read again; every line counts once, also those that hold no record."""
    line = F.expr(
        """CASE event_type WHEN 'click' THEN ' {"id":' || event_id || ',"photo_path":"p' || user_id || '","impression":"like"}'
           WHEN 'view' THEN '{"id":' || event_id || ',"photo_path":"p' || user_id || '","impression":"dislike","x":[1]}'
           WHEN 'error' THEN '{"photo_path":' WHEN 'signup' THEN '   ' ELSE '[1,2]' END"""
    )
    logs, state, parts = scratch_path(t.spark, "jsonl"), scratch_path(t.spark, "jsonl-state"), []
    for part in (t.events.filter("event_id % 3 = 0"), t.events.filter("event_id % 3 <> 0"), t.events.limit(0)):
        part.select(line.alias("value")).write.mode("append").text(logs)
        new = R.read_new_lines(t.spark, logs, state, "id bigint, photo_path string, impression string")
        parts.append(cut_lineage(new.select(F.lit("record").alias("kind"), F.col("id").alias("event_id"), "photo_path", "impression")))
    faults = R.rejected_lines(t.spark, state).groupBy("fault").agg(F.count("*").alias("event_id"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(
        faults.select(F.lit("rejected").alias("kind"), "event_id", F.col("fault").alias("photo_path"), F.lit("").alias("impression"))
    )


RULES = C.CaptureRules(
    host="m.ththth.example.net",
    prefixes=("/en/2",),
    exact_or_below=("/fr",),
    body_markers={"/fr": "body skipped"},
)
VIEWS["captures"] = """
    SELECT page_id, CASE WHEN url LIKE '%.com%' THEN 'https://m.ththth.example.net' || regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE url END AS url,
           CASE WHEN html LIKE '%table%' THEN 'options' ELSE 'post' END AS method, CASE WHEN url LIKE 'https%' THEN 'webrequest' ELSE 'page_hook' END AS origin,
           CASE WHEN url LIKE '%ref%' THEN 'start' ELSE 'Complete' END AS phase, length(html) AS size FROM pages"""


def captures(t):
    return t.pages.selectExpr(
        "page_id",
        "CASE WHEN url LIKE '%.com%' THEN 'https://m.ththth.example.net' || regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE url END AS url",
        "CASE WHEN html LIKE '%table%' THEN 'options' ELSE 'post' END AS method",
        "CASE WHEN url LIKE 'https%' THEN 'webrequest' ELSE 'page_hook' END AS origin",
        "CASE WHEN url LIKE '%ref%' THEN 'start' ELSE 'Complete' END AS phase",
        "length(html) AS size",
    )


KEPT_SQL = r"""regexp_extract(url, '://([^/?#]*)', 1) = 'm.ththth.example.net' AND (regexp_matches(url, '://[^/?#]*/en/2') OR regexp_matches(url, '://[^/?#]*/fr([/?#]|$)'))
    AND method <> 'options' AND (origin <> 'webrequest' OR phase = 'Complete')"""


def kept_captures(t):
    return captures(t).filter(C.keep_event("url", F.col("method"), F.col("phase"), F.col("origin"), RULES))


@query("event_keep_filter", f"SELECT page_id FROM captures WHERE {KEPT_SQL}")
def event_keep_filter(t):
    return kept_captures(t).select("page_id")


@query(
    "event_compact",
    f"""SELECT page_id, CASE WHEN origin = 'webrequest' THEN '' WHEN url LIKE '%/fr%' THEN 'body skipped' ELSE size::VARCHAR END AS body,
               CASE WHEN origin = 'webrequest' THEN 'method,url' ELSE 'method,url,zz' END AS keys FROM captures WHERE {KEPT_SQL}""",
)
def event_compact(t):
    body = C.compact_body("url", F.col("size").cast("string"), F.col("origin"), RULES)
    event = F.create_map(F.lit("url"), F.col("url"), F.lit("method"), F.col("method"), F.lit("zz"), F.lit("extra"))
    light = F.when(F.col("origin") == RULES.light_source, C.light_keys(event)).otherwise(event)
    keys = F.array_join(F.array_sort(F.map_keys(light)), ",")
    return kept_captures(t).select("page_id", F.coalesce(body, F.lit("")).alias("body"), keys.alias("keys"))


@query(
    "json_redact_trim",
    """SELECT page_id, '<redacted>' AS token_value, CASE WHEN length(html) > 3000 THEN md5(substr(html, 1, 3000) || '...<truncated ' || (length(html) - 3000) || ' chars>') ELSE md5(html) END AS body,
              '<redacted>' AS deep_token, md5(url) AS deep_url FROM pages""",
)
def json_redact_trim(t):
    flat = C.redact_map(F.create_map(F.lit("X-Auth-Token"), F.lit("abc"), F.lit("html"), F.col("html")), 3000)
    tree = F.to_json(F.struct(F.struct(F.lit("s").alias("session_cookie"), F.array("url").alias("links")).alias("a")))
    deep = C.redact_json(t.pages.select("page_id", flat.alias("m"), tree.alias("tree")), "tree")
    return deep.select(
        "page_id",
        F.col("m")["X-Auth-Token"].alias("token_value"),
        F.md5(F.col("m")["html"]).alias("body"),
        F.get_json_object("tree", "$.a.session_cookie").alias("deep_token"),
        F.md5(F.get_json_object("tree", "$.a.links[0]")).alias("deep_url"),
    )


@query("event_capture_sink", "SELECT CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS dt, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1")
def event_capture_sink(t):
    path = scratch_path(t.spark, "capture")
    C.write_capture(t.events.filter("event_type <> 'error'").withColumnRenamed("ts", "received_at"), path)
    stored = t.spark.read.schema("event_id bigint, event_type string, dt int").json(path)
    return stored.groupBy("dt").agg(F.count("event_id").alias("n"))


@query("real_rows_scan", "SELECT id, lang, CAST(label_text AS INTEGER) AS label FROM profile_rows WHERE lower(origin) = 'real' AND label_text IN ('0', '1')")
def real_rows_scan(t):
    return S.real_rows(t.profile_rows, "origin", "label_text", ["id", "lang"])


@query("append_labelled", "SELECT 'first' AS append_run, count(*) AS rows FROM labelled UNION ALL SELECT 'second', (SELECT count(*) FROM labelled) + (SELECT count(*) FROM labelled WHERE label = 1)")
def append_labelled(t):
    path = scratch_path(t.spark, "labelled")
    rows = t.labelled.select("id", "label", "p")
    counts = [("first", S.append_labelled(rows, path)), ("second", S.append_labelled(rows.filter("label = 1"), path))]
    return t.spark.createDataFrame(counts, "append_run string, rows bigint")


@query(
    "synthetic_generate",
    """
    WITH d AS (SELECT id, CAST('0x' || substr(md5(id || ':42'), 1, 8) AS BIGINT) % 4 AS r, text, lang, source FROM items),
    r AS (SELECT id, ['age', 'bio', 'interests', 'mixed'][r + 1] AS reason, text, lang, source FROM d)
    SELECT id, 1 AS label, '' AS reason, md5(text) AS text_digest, lang || ' ' || source AS tags FROM r
    UNION ALL SELECT id, 0, reason, md5(CASE WHEN reason IN ('bio', 'mixed') THEN reverse(text) ELSE text END), CASE WHEN reason IN ('interests', 'mixed') THEN '' ELSE lang || ' ' || source END FROM r""",
)
def synthetic_generate(t):
    pool = t.items.select("id", "text", F.array("lang", "source").alias("tags"))
    rows = S.synthetic_rows(pool, "id", "text", "tags")
    return rows.select("id", "label", "reason", F.md5("text").alias("text_digest"), F.array_join("tags", " ").alias("tags"))


@query("report_sink")
def report_sink(t):
    """Evaluation metrics written as JSON and Markdown, and read back (rows only: files are the output)."""
    path = scratch_path(t.spark, "report")
    bins = M.calibration_bins(t.labelled, "label", "p")
    RP.write_report(M.to_long(M.threshold_sweep(t.labelled, "label", "p").drop("threshold_source"), "threshold"), bins, path)
    return t.spark.read.schema("block string, metric string, value double").json(f"{path}/metrics")
