"""Queries of signal learning and scoring (survey 2.5, 2.4 token_score_join and the signal rows of 2.1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.functions import feedback as FB
from prefspark.functions import numeric as N

from prefspark.operators import signals as S
from prefspark.plans.registry import half_up, query
from prefspark.plans.scalars import SQL_STOPS, STOPS_EN
from prefspark.plans.tables import VIEWS
from prefspark.sources.records import new_records

VIEWS["clean_signals"] = """
    SELECT *, CASE WHEN kind NOT IN ('interest', 'bio', 'descriptor') THEN 'bad type' WHEN pol NOT IN ('positive', 'neutral', 'negative') THEN 'bad polarity'
                   WHEN trim(signal_value) = '' THEN 'empty value' END AS reason,
           trim(regexp_replace(lower(signal_value), '\\s+', ' ', 'g')) AS norm,
           greatest(1, least(20, coalesce(nullif(TRY_CAST(weight AS INTEGER), 0), 3))) AS w
    FROM (SELECT *, lower(trim(signal_type)) AS kind, lower(polarity) AS pol FROM signal_events)"""
VIEWS["good_signals"] = "SELECT id, kind, norm, pol, w FROM clean_signals WHERE reason IS NULL"

VIEWS["taught"] = f"""
    WITH base AS (SELECT d.*, k.toks FROM domain_sets d JOIN tokens k ON d.id = k.id),
    rows AS (
        SELECT id, 'interest' AS kind, unnest(CASE lang WHEN 'fr' THEN ['fr', source] ELSE [lang, source] END) AS norm, label AS likes, 1 - label AS dislikes
        FROM base WHERE list_contains(doms, 'interests')
        UNION ALL SELECT id, 'bio', unnest(list_distinct(toks)), label, 1 - label FROM base WHERE list_contains(doms, 'bio')
        UNION ALL SELECT id, 'descriptor', 'lang: es', 1, 0 FROM base WHERE lang = 'es'
        UNION ALL SELECT id, 'descriptor', 'source: ' || source, 0, 1 FROM base WHERE lang = 'es'
        UNION ALL SELECT id, 'descriptor', unnest(['lang: ' || lang, 'source: ' || source, 'size: ' || size_class]), label, 1 - label
        FROM base WHERE lang <> 'es' AND list_contains(doms, 'descriptors'))
    SELECT kind, norm, likes, dislikes, 0 AS np, 0 AS nn, true AS counted FROM rows
    UNION ALL SELECT 'bio', 'und die', 0, 0, 1, 0, false FROM base WHERE lang = 'de'"""
VIEWS["taught_events"] = """
    SELECT kind, norm, CASE pol WHEN 'positive' THEN w ELSE 0 END AS likes, CASE pol WHEN 'negative' THEN w ELSE 0 END AS dislikes,
           CAST(pol <> 'positive' AS INTEGER) AS np, CAST(pol <> 'negative' AS INTEGER) AS nn, true AS counted FROM good_signals"""
TABLE_SQL = """SELECT kind, norm, CAST(sum(likes) AS BIGINT) AS likes, CAST(sum(dislikes) AS BIGINT) AS dislikes, CAST(sum(np) AS BIGINT) AS not_positive,
    CAST(sum(nn) AS BIGINT) AS not_negative, bool_or(counted) AS counted FROM {0} GROUP BY kind, norm"""
VIEWS["learned"] = TABLE_SQL.format("(SELECT * FROM taught UNION ALL SELECT * FROM taught_events)")
VIEWS["scored_table"] = """
    SELECT kind, norm, likes + dislikes AS total, not_positive AS np, not_negative AS nn, (likes + 1) / (likes + dislikes + 2) AS base,
           CASE WHEN np > 0 AND nn > 0 THEN 0.5 WHEN np > 0 THEN least((likes + 1) / (likes + dislikes + 2), 0.55)
                WHEN nn > 0 THEN greatest((likes + 1) / (likes + dislikes + 2), 0.45) ELSE (likes + 1) / (likes + dislikes + 2) END AS score
    FROM (SELECT *, not_positive AS np, not_negative AS nn FROM learned) WHERE counted"""
VIEWS["item_norms"] = """
    SELECT i.id, 'interest' AS kind, unnest([lang, source]) AS norm, unnest([0, 1]) AS pos FROM items i
    UNION ALL SELECT id, 'bio', unnest(toks), unnest(range(len(toks))) FROM tokens
    UNION ALL SELECT id, 'descriptor', unnest(['lang: ' || lang, 'source: ' || source, 'size: ' || size_class]), unnest([0, 1, 2]) FROM items"""
VIEWS["item_scores"] = f"""
    SELECT id, kind, {half_up('avg(score)', 4)} AS score,
           count(*) FILTER (total >= 2 AND score >= 0.7 AND np = 0) AS positive_hits,
           count(*) FILTER (total >= 2 AND score <= 0.3 AND nn = 0) AS negative_hits,
           coalesce(array_to_string(list(norm ORDER BY pos, norm) FILTER (total >= 2 AND score >= 0.7 AND np = 0)[1:5], ','), '') AS positive_signals,
           coalesce(array_to_string(list(norm ORDER BY pos, norm) FILTER (total >= 2 AND score <= 0.3 AND nn = 0)[1:5], ','), '') AS negative_signals
    FROM item_norms JOIN scored_table USING (kind, norm) GROUP BY id, kind"""


def with_signals(df):
    """Tags and attribute items of an item frame, as the signal operators want them."""
    return df.withColumns(
        {
            "tags": F.array("lang", "source"),
            "attr_items": F.array(
                F.concat(F.lit("lang: "), "lang"), F.concat(F.lit("source: "), "source"), F.concat(F.lit("size: "), "size_class")
            ),
        }
    )


def label_rows(t):
    rows = with_signals(t.feedback_in_place).withColumn("doms", FB.domain_set("feedback_domain", "details"))
    return S.signal_rows(rows, label="label", domains="doms", details="details", text="text", tags="tags", items="attr_items", stopwords=STOPS_EN)


def learned(t):
    return S.signal_table(label_rows(t), S.feedback_rows(S.valid_signals(t.signal_events)))


@query("signal_record_clean", "SELECT id, kind AS signal_type, pol AS polarity, norm AS signal_norm, w AS weight FROM clean_signals WHERE reason IS NULL")
def signal_record_clean(t):
    return S.valid_signals(t.signal_events).select("id", "signal_type", "polarity", "signal_norm", "weight")


@query("signal_append_batch", "SELECT coalesce(reason, 'saved') AS outcome, count(*) AS n FROM clean_signals GROUP BY 1")
def signal_append_batch(t):
    return S.clean_signals(t.signal_events).groupBy(F.coalesce("reason", F.lit("saved")).alias("outcome")).agg(F.count("*").alias("n"))


@query("signal_counts", TABLE_SQL.format("taught"))
def signal_counts(t):
    return S.signal_table(label_rows(t))


@query("signal_feedback_apply", "SELECT * FROM learned")
def signal_feedback_apply(t):
    return learned(t)


@query(
    "signal_feedback_pivot",
    """SELECT kind, norm, count(*) FILTER (pol = 'positive') AS positive, count(*) FILTER (pol = 'neutral') AS neutral,
              count(*) FILTER (pol = 'negative') AS negative, count(*) AS total FROM good_signals GROUP BY 1, 2""",
)
def signal_feedback_pivot(t):
    return S.feedback_pivot(S.valid_signals(t.signal_events))


@query(
    "veto_tables",
    """SELECT kind || '_not_positive' AS veto, norm, not_positive AS n FROM learned WHERE not_positive >= 2
       UNION ALL SELECT kind || '_not_negative', norm, not_negative FROM learned WHERE not_negative >= 2""",
)
def veto_tables(t):
    return S.veto_tables(learned(t))


@query("laplace_score", f"SELECT kind, norm, {half_up('(likes + 1) / (likes + dislikes + 2)', 6)} AS score FROM learned")
def laplace_score(t):
    return learned(t).select("kind", "norm", N.half_up(S.laplace_score("likes", "dislikes"), 6).alias("score"))


@query("token_score_join", "SELECT * FROM item_scores")
def token_score_join(t):
    return S.text_token_scores(with_signals(t.items), learned(t), "id", "text", "tags", "attr_items", STOPS_EN)


@query(
    "profile_text_score",
    f"""
    WITH w AS (SELECT id, max(score) FILTER (kind = 'interest') AS interest, max(score) FILTER (kind = 'bio') AS bio, max(score) FILTER (kind = 'descriptor') AS descriptor,
                      sum(positive_hits)::BIGINT AS positive_hits, sum(negative_hits)::BIGINT AS negative_hits FROM item_scores GROUP BY id),
    f AS (SELECT i.id, coalesce(interest, 0.5) AS interest, coalesce(bio, 0.5) AS bio, coalesce(descriptor, 0.5) AS descriptor,
                 coalesce(positive_hits, 0) AS positive_hits, coalesce(negative_hits, 0) AS negative_hits FROM items i LEFT JOIN w ON i.id = w.id)
    SELECT *, {half_up('CASE WHEN descriptor <> 0.5 THEN interest * 0.45e0 + bio * 0.35e0 + descriptor * 0.2e0 ELSE interest * 0.55e0 + bio * 0.45e0 END', 4)}
           AS text_preference_score FROM f""",
)
def profile_text_score(t):
    return S.profile_text_score(with_signals(t.items), learned(t), "id", "text", "tags", "attr_items", STOPS_EN)


@query(
    "signal_candidates",
    f"""
    WITH occ AS (
        SELECT id, label, 'interest' AS kind, unnest([lang, source]) AS norm FROM labelled
        UNION ALL SELECT l.id, label, 'bio', unnest([x for x in list_distinct(toks) if contains(x, ' ') and len(x) >= 7
              and not list_has_any(string_split(x, ' '), {SQL_STOPS})]) FROM labelled l JOIN tokens k ON l.id = k.id
        UNION ALL SELECT id, label, 'descriptor', unnest(['lang: ' || lang, 'source: ' || source, 'size: ' || size_class]) FROM labelled),
    ex AS (SELECT kind, norm, count(*) AS total FROM good_signals GROUP BY 1, 2),
    c AS (SELECT kind, norm, count(*) AS occurrences, count(*) FILTER (label = 1) AS likes, count(*) FILTER (label = 0) AS dislikes,
                 array_to_string(list(id ORDER BY id)[1:3], ',') AS examples FROM occ GROUP BY 1, 2 HAVING count(*) >= 3),
    j AS (SELECT c.*, coalesce(ex.total, 0) AS explicit, (likes + 1) / (likes + dislikes + 2) AS s FROM c LEFT JOIN ex USING (kind, norm))
    SELECT kind, norm, norm AS display, occurrences, likes, dislikes, explicit, {half_up('s', 4)} AS learned_score,
           {half_up('occurrences / (1 + explicit) * (1 + abs(s - 0.5e0))', 4)} AS priority, examples
    FROM j WHERE explicit <= 2 ORDER BY explicit, priority DESC, occurrences DESC, kind, norm LIMIT 60""",
)
def signal_candidates(t):
    rows = with_signals(t.labelled)
    occurrences = S.signal_occurrences(rows, "id", "label", "text", "tags", "attr_items", STOPS_EN, ())
    return S.signal_candidates(occurrences, S.valid_signals(t.signal_events), "id", "label")


@query(
    "signal_summary_topn",
    f"""SELECT kind, side, position, norm, {half_up('base', 4)} AS score, total FROM (
        SELECT *, row_number() OVER (PARTITION BY kind, side ORDER BY base * sgn DESC, total * sgn DESC, norm) AS position FROM (
        SELECT *, CASE WHEN base >= 0.7 THEN 'liked' WHEN base <= 0.3 THEN 'disliked' END AS side, CASE WHEN base >= 0.7 THEN 1 ELSE -1 END AS sgn
        FROM scored_table WHERE total >= 2) WHERE side IS NOT NULL) WHERE position <= 8""",
)
def signal_summary_topn(t):
    return S.summary_topn(learned(t))


@query(
    "idempotent_import",
    """SELECT 'first' AS import_run, count(DISTINCT sha256(concat_ws(chr(31), created_at::VARCHAR, lower(trim(signal_type)), trim(signal_value), lower(polarity)))) AS added
       FROM clean_signals WHERE reason IS NULL UNION ALL SELECT 'again', 0""",
)
def idempotent_import(t):
    signals = S.valid_signals(t.signal_events)
    columns = ("created_at", "signal_type", "signal_value", "polarity")
    first = new_records(signals, None, columns)
    again = new_records(signals, first, columns)
    runs = [df.agg(F.count("*").alias("added")).select(F.lit(run).alias("import_run"), "added") for run, df in (("first", first), ("again", again))]
    return runs[0].unionByName(runs[1])
