"""Queries of model evaluation and session summaries (survey 2.5 and the splits of 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.functions import feedback as FB
from prefspark.functions import labels as L
from prefspark.functions.numeric import truthy
from prefspark.operators import bucketed as B
from prefspark.operators import metrics as M
from prefspark.plans.registry import half_up, query
from prefspark.plans.tables import VIEWS


def rates_sql(prefix: str = "") -> str:
    return f"""tp, fp, tn, fn, {half_up('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END', 4)} AS precision,
        {half_up('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END', 4)} AS recall,
        {half_up('CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END', 4)} AS specificity,
        {half_up('CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0 END', 4)} AS f1,
        {half_up('CASE WHEN tp + fp + tn + fn > 0 THEN (tp + tn) / (tp + fp + tn + fn) ELSE 0 END', 4)} AS accuracy"""


def counts_sql(threshold: str) -> str:
    return f"""count(*) FILTER (p >= {threshold} AND label = 1) AS tp, count(*) FILTER (p >= {threshold} AND label = 0) AS fp,
        count(*) FILTER (p < {threshold} AND label = 0) AS tn, count(*) FILTER (p < {threshold} AND label = 1) AS fn"""


def sweep_sql(source: str) -> str:
    return f"""
    SELECT t AS like_threshold,
           CASE WHEN NOT ok THEN 'fallback_insufficient_data' WHEN precision >= 0.55 THEN 'optimized_precision_floor'
                ELSE 'optimized_recall_no_precision_floor' END AS threshold_source,
           CASE WHEN ok THEN 21 ELSE 0 END AS candidates, tp, fp, tn, fn, precision, recall, specificity, f1, accuracy
    FROM (SELECT t, tp + fp + tn + fn >= 30 AND tp + fn > 0 AND fp + tn > 0 AS ok, {rates_sql()}
          FROM (SELECT t, {counts_sql('t')} FROM {source}, (SELECT round(0.45e0 + 0.005e0 * i, 4) AS t FROM range(21) r(i)) GROUP BY t))
    ORDER BY ok OR t = 0.48 DESC, precision >= 0.55 DESC, precision >= 0.55 AND recall >= 0.88 DESC, recall DESC,
             CASE WHEN precision >= 0.55 THEN precision ELSE f1 END DESC, round(abs(t - 0.48), 6), t LIMIT 1"""


@query("threshold_sweep", sweep_sql("labelled"))
def threshold_sweep(t):
    return M.threshold_sweep(t.labelled, "label", "p")


@query("confusion_metrics", f"SELECT {rates_sql()} FROM (SELECT {counts_sql('0.48e0')} FROM labelled)")
def confusion_metrics(t):
    return M.confusion_metrics(t.labelled, "label", "p", 0.48)


def bins_sql(source: str) -> str:
    return f"""
    SELECT i AS bin, {half_up('i * 0.1e0', 2)} AS low, {half_up('(i + 1) * 0.1e0', 2)} AS high, count(p) AS n,
           {half_up('avg(p)', 4)} AS avg_probability, {half_up('avg(label)', 4)} AS observed_rate
    FROM (SELECT CAST(i AS INTEGER) AS i FROM range(10) r(i)) LEFT JOIN {source} ON p >= i * 0.1e0 AND (p < (i + 1) * 0.1e0 OR (i = 9 AND p <= 1)) GROUP BY i"""


@query("calibration_bins", bins_sql("labelled"))
def calibration_bins(t):
    return M.calibration_bins(t.labelled, "label", "p")


def ranges_sql(source: str, threshold: str) -> str:
    return f"""SELECT part, {rates_sql()}, tp + fp + tn + fn AS n FROM (SELECT part, {counts_sql(threshold)} FROM
        (SELECT CAST(part AS INTEGER) AS part FROM range(3) r(part)) LEFT JOIN
        (SELECT *, CASE WHEN p < 0.4 THEN 0 WHEN p < 0.6 THEN 1 ELSE 2 END AS pp FROM {source}) ON part = pp GROUP BY part)"""


@query("range_metrics", ranges_sql("labelled", "0.48e0"))
def range_metrics(t):
    return M.range_metrics(t.labelled, "label", "p", 0.48)


@query("brier_score", f"SELECT {half_up('avg((p - label) * (p - label))', 4)} AS brier FROM labelled")
def brier_score(t):
    return M.brier_score(t.labelled, "label", "p")


@query("value_counts", "SELECT label_text AS value, count(*) AS n FROM profile_rows WHERE label_text <> '' GROUP BY 1")
def value_counts(t):
    return M.value_counts(t.profile_rows, "label_text")


VIEWS["positions"] = "SELECT *, row_number() OVER (ORDER BY id) AS pos, count(*) OVER () AS total FROM labelled"


@query("chronological_split", "SELECT id, pos > floor(total * 0.8e0) AS is_holdout FROM positions")
def chronological_split(t):
    return B.chronological_split(t.labelled, "id").select("id", "is_holdout")


VIEWS["report_rows"] = """
    SELECT f.*, CASE final_decision WHEN 'talvez' THEN NULL ELSE label END AS y, CASE WHEN lang = 'es' THEN NULL ELSE p END AS prob,
           CASE final_decision WHEN 'talvez' THEN 'maybe' WHEN 'Super_Like' THEN 'strong_like' WHEN 'like' THEN (CASE WHEN lang = 'es' THEN 'strong_like' ELSE 'like' END)
                ELSE (CASE WHEN lang = 'es' THEN 'strong_like' ELSE 'pass' END) END AS tier FROM feedback f"""
VIEWS["report_held"] = """
    SELECT * FROM (SELECT *, row_number() OVER (ORDER BY id) AS pos, count(*) OVER () AS total FROM report_rows WHERE y IS NOT NULL)
    WHERE pos > floor(total * 0.8e0)"""


def _long_sql(block: str, columns: str, source: str) -> str:
    return f"SELECT '{block}' AS block, metric, value FROM (UNPIVOT (SELECT {columns} FROM {source}) ON COLUMNS(*) INTO NAME metric VALUE value)"


def dbl(name: str, expr: str) -> str:
    return f"CAST({expr} AS DOUBLE) AS {name}"


@query(
    "evaluation_report",
    f"""
    WITH scored AS (SELECT id, y AS label, prob AS p FROM report_held WHERE prob IS NOT NULL),
    best AS ({sweep_sql('scored')}),
    rates AS (SELECT {rates_sql()} FROM (SELECT {counts_sql('like_threshold')} FROM scored, best)),
    bins AS ({bins_sql('scored')}),
    ranged AS (SELECT part, f1 FROM ({ranges_sql('(SELECT * FROM scored, best)', 'like_threshold')})),
    corr AS (SELECT *, CASE WHEN tier = 'maybe' THEN 'uncertain' WHEN tier = 'strong_like' THEN 'superlike_upgrade'
                 WHEN model_decision = 'CURTIR' AND final_decision = 'passar' THEN 'false_positive'
                 WHEN model_decision = 'PASS' AND final_decision = 'like' THEN 'false_negative' ELSE 'none' END AS correction FROM report_rows)
    {_long_sql('dataset', ', '.join([dbl('real_rows', 'count(*)'), dbl('trainable_rows', 'count(y)'), half_up('avg(y)', 4) + ' AS like_rate',
        dbl('manual_corrected', "count(*) FILTER (manual_corrected = '1.0')"), dbl('strong_like_rows', "count(*) FILTER (tier = 'strong_like')"),
        dbl('target_action_rows', "count(*) FILTER (lang = 'es')")]), 'report_rows')}
    UNION ALL {_long_sql('holdout', ', '.join([dbl('holdout_rows', 'count(*)'), dbl('evaluated_rows', 'count(prob)'),
        half_up('count(prob) / count(*)', 4) + ' AS probability_coverage']), 'report_held')}
    UNION ALL {_long_sql('threshold', dbl('like_threshold', 'like_threshold') + ', ' + dbl('candidates', 'candidates'), 'best')}
    UNION ALL {_long_sql('metrics', ', '.join(dbl(c, c) for c in ('tp', 'fp', 'tn', 'fn', 'precision', 'recall', 'specificity', 'f1', 'accuracy')), 'rates')}
    UNION ALL SELECT 'brier', 'brier', {half_up('avg((p - label) * (p - label))', 4)} FROM scored
    UNION ALL SELECT 'bin_count', bin::VARCHAR, n::DOUBLE FROM bins
    UNION ALL SELECT 'bin_rate', bin::VARCHAR, observed_rate FROM bins
    UNION ALL SELECT 'range_f1', part::VARCHAR, f1 FROM ranged
    UNION ALL SELECT 'by_feedback_domain', lower(feedback_domain), count(*)::DOUBLE FROM report_rows GROUP BY 2
    UNION ALL SELECT 'by_correction', correction, count(*)::DOUBLE FROM corr GROUP BY 2""",
)
def evaluation_report(t):
    rows = t.feedback.withColumns(
        {
            "y": F.when(F.col("final_decision") != "talvez", F.col("label")),
            "prob": F.when(F.col("lang") != "es", F.col("p")),
            "feedback_domain": FB.normalize_domain("feedback_domain"),
            "tier": L.preference_tier("final_decision", None, "details"),
        }
    )
    rows = rows.withColumn("correction", L.correction_type(F.col("tier"), "model_decision", "final_decision"))
    target = L.detail("details", "target_action") == "super_like"
    return M.evaluation_report(
        rows, "id", "y", "prob", truthy("manual_corrected"), "feedback_domain", "correction", "tier", target
    )
