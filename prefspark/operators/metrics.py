"""Model evaluation: confusion, threshold sweep, calibration, ranges, and the long-form report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.functions.labels import DecisionPolicy
from prefspark.functions.numeric import half_up
from prefspark.operators.bucketed import chronological_split

# fixed values: candidate thresholds 0.45, 0.455, ..., 0.55
THRESHOLDS = tuple(round(0.45 + 0.005 * i, 4) for i in range(21))
MIN_SWEEP_ROWS = 30
RANGES = ((0.0, 0.4), (0.4, 0.6), (0.6, 1.0))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion_columns(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """All rates from the four counts, 0 on an empty denominator, rounded to 4 places."""
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return {
        "tp": tp,
        "fp": fp,
        "tn": tn,
        "fn": fn,
        "precision": half_up(precision, 4),
        "recall": half_up(recall, 4),
        "specificity": half_up(_ratio(tn, tn + fp), 4),
        "f1": half_up(F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0), 4),
        "accuracy": half_up(_ratio(tp + tn, tp + fp + tn + fn), 4),
    }


def evaluation_cells(df: DataFrame, y: str, p: str, n_bins: int = 10, keep_unscored: bool = False) -> DataFrame:
    """Everything the evaluation needs, from one pass: counts and error sums per (bin, range, thresholds reached, label).

    ``keep_unscored`` also counts the rows without a probability, as bin -1.
    The result has at most a few hundred rows whatever the size of the data, so all metrics below are derived from it.
    """
    edges = [i * (1.0 / n_bins) for i in range(n_bins)]
    prob, label = F.col(p), F.col(y).cast("int")
    bin_no = reduce(lambda acc, i: acc.when(prob < edges[i + 1], i), range(n_bins - 1), F).otherwise(n_bins - 1)
    part = F.when(prob < RANGES[0][1], 0).when(prob < RANGES[1][1], 1).otherwise(2)
    reached = reduce(lambda acc, i: acc.when(prob < THRESHOLDS[i], i), range(len(THRESHOLDS)), F).otherwise(len(THRESHOLDS))
    known = prob.isNotNull()
    bin_no, part, reached = (F.when(known, c).otherwise(-1) for c in (bin_no, part, reached))
    return (
        df.filter(label.isNotNull() if keep_unscored else known & label.isNotNull())
        .groupBy(bin_no.alias("bin"), part.alias("part"), reached.alias("reached"), label.alias("y"))
        .agg(
            F.count("*").alias("n"),
            F.sum(prob).alias("sum_p"),
            F.sum((prob - label) * (prob - label)).alias("sum_se"),
            F.count_if(prob.between(0.0, 1.0)).alias("n_inside"),
        )
    )


def _total(condition: Column, value: str = "n") -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0))


def _confusion_aggs(hit: Column) -> list[Column]:
    one = F.col("y") == 1
    return [
        _total(hit & one).alias("tp"),
        _total(hit & ~one).alias("fp"),
        _total(~hit & ~one).alias("tn"),
        _total(~hit & one).alias("fn"),
    ]


def _rates(counted: DataFrame, *keep: str) -> DataFrame:
    columns = confusion_columns(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))
    return counted.select(*keep, *[c.alias(n) for n, c in columns.items()])


def confusion_metrics(df: DataFrame, y: str, p: str, threshold: float) -> DataFrame:
    """Confusion at any threshold."""
    return _rates(df.withColumns({"y": F.col(y), "n": F.lit(1)}).agg(*_confusion_aggs(F.col(p) >= threshold)))


def best_threshold(cells: DataFrame, policy: DecisionPolicy = DecisionPolicy()) -> DataFrame:
    """The best like threshold: recall first among those above the precision floor, else recall then f1.

    Too few rows or a single class give the fallback threshold.
    """
    steps = F.explode(F.sequence(F.lit(0), F.lit(len(THRESHOLDS) - 1)))  # a few hundred cells, 21 thresholds each
    per_step = cells.withColumn("step", steps).groupBy("step").agg(*_confusion_aggs(F.col("reached") > F.col("step")))
    thresholds = F.array(*[F.lit(t) for t in THRESHOLDS])
    scored = _rates(per_step.withColumn("threshold", F.element_at(thresholds, F.col("step") + 1)), "threshold")
    pos, neg = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    enough = (pos + neg >= MIN_SWEEP_ROWS) & (pos > 0) & (neg > 0)
    viable = F.col("precision") >= policy.precision_floor
    rank = F.struct(
        (enough | (F.col("threshold") == policy.fallback_threshold)).alias("allowed"),
        viable.alias("viable"),
        (viable & (F.col("recall") >= policy.target_recall)).alias("on_target"),
        F.col("recall"),
        F.when(viable, F.col("precision")).otherwise(F.col("f1")).alias("second"),
        (-F.round(F.abs(F.col("threshold") - policy.fallback_threshold), 6)).alias("near"),
        (-F.col("threshold")).alias("lowest"),
    )
    source = F.when(~enough, "fallback_insufficient_data").when(viable, "optimized_precision_floor").otherwise(
        "optimized_recall_no_precision_floor"
    )
    rates = ("tp", "fp", "tn", "fn", "precision", "recall", "specificity", "f1", "accuracy")
    return scored.select(
        F.col("threshold").alias("like_threshold"),
        source.alias("threshold_source"),
        F.when(enough, len(THRESHOLDS)).otherwise(0).alias("candidates"),
        *rates,
        rank.alias("_rank"),
    ).agg(F.max_by(F.struct("like_threshold", "threshold_source", "candidates", *rates), "_rank").alias("b")).select("b.*")


def threshold_sweep(df: DataFrame, y: str, p: str, policy: DecisionPolicy = DecisionPolicy()) -> DataFrame:
    return best_threshold(evaluation_cells(df, y, p), policy)


def _bin_rows(cells: DataFrame, n_bins: int = 10) -> DataFrame:
    frame = cells.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    found = cells.filter("n_inside > 0").groupBy("bin").agg(
        F.sum("n").alias("n"), (F.sum("sum_p") / F.sum("n")).alias("mean_p"), (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("rate")
    )
    width = 1.0 / n_bins
    return frame.join(found, "bin", "left").select(
        "bin",
        half_up(F.col("bin") * width, 2).alias("low"),
        half_up((F.col("bin") + 1) * width, 2).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
        half_up("mean_p", 4).alias("avg_probability"),
        half_up("rate", 4).alias("observed_rate"),
    )


def calibration_bins(df: DataFrame, y: str, p: str, n_bins: int = 10) -> DataFrame:
    """Equal-width bins (the last one closed): count, mean probability, observed rate; empty bins are kept."""
    return _bin_rows(evaluation_cells(df.filter(F.col(p).between(0.0, 1.0)), y, p, n_bins), n_bins)


def _range_rows(cells: DataFrame, hit: Column) -> DataFrame:
    frame = cells.sparkSession.range(len(RANGES)).select(F.col("id").cast("int").alias("part"))
    counted = frame.join(cells.groupBy("part").agg(*_confusion_aggs(hit)), "part", "left").fillna(0)
    return _rates(counted, "part").withColumn("n", F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))


def range_metrics(df: DataFrame, y: str, p: str, threshold: float) -> DataFrame:
    """Confusion per probability range, at one of the candidate thresholds."""
    step = THRESHOLDS.index(round(threshold, 4))
    return _range_rows(evaluation_cells(df.filter(F.col(p).between(0.0, 1.0)), y, p), F.col("reached") > step)


def brier_score(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(half_up(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))), 4).alias("brier"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-blank value."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).filter(F.col("value") != "")


def to_long(row: DataFrame, block: str) -> DataFrame:
    """A one-row frame as (block, metric, value)."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in row.columns)
    return row.select(F.lit(block).alias("block"), F.expr(f"stack({len(row.columns)}, {pairs}) AS (metric, value)"))


def evaluation_report(
    rows: DataFrame, order: str, label: str, p: str, corrected: Column, domain: str, correction: str, tier: str, target: Column
) -> DataFrame:
    """The whole evaluation in long form: dataset, threshold, metrics, brier, bins, ranges, corrections, strong likes.

    ``rows`` are the real rows; ``label`` is 0, 1 or null. The last fifth of the labelled rows is the holdout.
    """
    split = chronological_split(rows.filter(F.col(label).isNotNull()), order)
    holdout = split.filter("is_holdout").withColumn(
        p, F.when(F.col(p).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(p))))
    )
    # one pass over the holdout and one over all rows; the few hundred cells feed every block below
    held_cells = evaluation_cells(holdout, label, p, keep_unscored=True).persist()
    cells = held_cells.filter("bin >= 0")
    best = best_threshold(cells)
    step = reduce(lambda acc, i: acc.when(F.col("like_threshold") == THRESHOLDS[i], i), range(len(THRESHOLDS)), F)
    stepped = cells.withColumn("step", best.select(step.alias("step")).scalar())
    bins = _bin_rows(cells)
    bin_no = F.col("bin").cast("string")

    row_cells = rows.groupBy(domain, correction).agg(
        F.count("*").alias("n"),
        F.count(label).alias("labelled"),
        F.sum(label).alias("liked"),
        F.count_if(corrected).alias("corrected"),
        F.count_if(F.col(tier) == "strong_like").alias("strong"),
        F.count_if(target).alias("targets"),
    ).persist()
    dataset = row_cells.agg(
        F.sum("n").alias("real_rows"),
        F.sum("labelled").alias("trainable_rows"),
        half_up(F.coalesce(F.sum("liked") / F.sum("labelled"), F.lit(0.0)), 4).alias("like_rate"),
        F.sum("corrected").alias("manual_corrected"),
        F.sum("strong").alias("strong_like_rows"),
        F.sum("targets").alias("target_action_rows"),
    )
    scored = _total(F.col("bin") >= 0)
    held = held_cells.agg(
        F.sum("n").alias("holdout_rows"), scored.alias("evaluated_rows"), half_up(_ratio(scored, F.sum("n")), 4).alias("probability_coverage")
    )
    rates = ("tp", "fp", "tn", "fn", "precision", "recall", "specificity", "f1", "accuracy")
    blocks = [
        to_long(dataset, "dataset"),
        to_long(held, "holdout"),
        to_long(best.select("like_threshold", "candidates"), "threshold"),
        to_long(best.select(*rates), "metrics"),
        to_long(cells.agg(half_up(F.sum("sum_se") / F.sum("n"), 4).alias("brier")), "brier"),
        bins.select(F.lit("bin_count").alias("block"), bin_no.alias("metric"), F.col("n").cast("double").alias("value")),
        bins.select(F.lit("bin_rate").alias("block"), bin_no.alias("metric"), F.col("observed_rate").alias("value")),
        _range_rows(stepped, F.col("reached") > F.col("step")).select(
            F.lit("range_f1").alias("block"), F.col("part").cast("string").alias("metric"), F.col("f1").alias("value")
        ),
    ]
    for column in (domain, correction):
        counts = row_cells.groupBy(F.col(column).cast("string").alias("value")).agg(F.sum("n").alias("n")).filter("value <> ''")
        blocks.append(
            counts.select(F.lit(f"by_{column}").alias("block"), F.col("value").alias("metric"), F.col("n").cast("double").alias("value"))
        )
    return reduce(DataFrame.unionByName, blocks)
