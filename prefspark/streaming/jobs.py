"""Micro-batch jobs: scoring, online centroids, retraining."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.functions.vectors import as_doubles
from prefspark.sources import versioned
from prefspark.streaming.runner import drain_batches, run_batches


def centroid_parts(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mergeable parts of the class centroids of one micro-batch: vector sum and count."""
    staged = df.select(label, array_to_vector(as_doubles(vector)).alias("_v"))
    return staged.groupBy(label).agg(vector_to_array(Summarizer.sum(F.col("_v"))).alias("total"), F.count("*").alias("n"))


def merge_centroids(parts: DataFrame, label: str) -> DataFrame:
    """Centroids from all parts so far; an online mean is the sum of sums over the sum of counts."""
    flat = parts.select(label, "n", F.posexplode("total").alias("pos", "x"))
    means = flat.groupBy(label, "pos").agg((F.sum("x") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    return means


def stream_centroid(stream: DataFrame, path: str, label: str, vector: str) -> DataFrame:
    kind = stream.schema[label].dataType.simpleString()
    parts = drain_batches(stream, path, lambda batch, _: centroid_parts(batch, label, vector), f"`{label}` {kind}, total array<double>, n bigint")
    return merge_centroids(parts, label)


def enqueue(rows: DataFrame, queue: str, batch_id: int, key: str, order: str, score: Callable[[DataFrame], DataFrame], schema: str) -> None:
    """Score the rows of a batch whose ``key`` is in no earlier version of the queue, the first by ``order`` of each, and commit them
    as the batch's version. A batch that is replayed reads the same versions and finds its own committed, so it adds nothing."""
    spark = rows.sparkSession
    if batch_id in versioned.versions(spark, queue):
        return
    waiting = versioned.read(spark, queue, schema, before=batch_id, newest=False)
    columns = [c for c in rows.columns if c != key]
    firsts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_r")).select(key, "_r.*")
    versioned.write(score(firsts.join(waiting.select(key), key, "left_anti")), queue, batch_id)


def stream_score(
    stream: DataFrame, path: str, score: Callable[[DataFrame], DataFrame], known: Callable[[DataFrame], DataFrame], key: str, order: str, schema: str
) -> DataFrame:
    """Score each micro-batch and add to a queue what is not known yet: ``known`` takes out rows that are labelled already, the queue
    itself those that an earlier batch added. ``score`` must keep ``key``. The queue is a versioned table, a version per batch."""
    queue = f"{path}/queue"
    run_batches(stream, path, lambda batch, batch_id: enqueue(known(batch), queue, batch_id, key, order, score, schema))
    return versioned.read(stream.sparkSession, queue, schema, newest=False)


LOG = "batch_id bigint, n bigint, total bigint, retrained boolean, version bigint"


def stream_retrain(stream: DataFrame, path: str, every: int, fit: Callable[[DataFrame], PipelineModel]) -> DataFrame:
    """Collect labels as they arrive and fit again when their total crosses a multiple of ``every`` (or with the first data).

    ``fit`` gets all labels so far. Its model is saved under the number of its batch and becomes the current one in one step
    (see ``versioned``); a fit that fails leaves the version before it current and is told in the log: a row per batch with its
    labels, the total, whether it retrained, and the version that is current behind it. Labels and log are versioned, so a
    replayed batch counts once."""
    spark, schema = stream.sparkSession, stream.schema
    labels, log, models = f"{path}/labels", f"{path}/log", f"{path}/models"

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch_id in versioned.versions(spark, log):
            return
        before = versioned.read(spark, labels, schema, before=batch_id, newest=False).count()
        versioned.write(batch, labels, batch_id)
        every_label = versioned.read(spark, labels, schema, before=batch_id + 1, newest=False)
        total = every_label.count()
        fire = total > before and (before == 0 or total // every > before // every)
        retrained = fire and retrain(every_label, models, batch_id, fit)
        row = (batch_id, total - before, total, retrained, versioned.current(spark, models))
        versioned.write(spark.createDataFrame([row], LOG), log, batch_id)

    run_batches(stream, path, handle)
    return versioned.read(spark, log, LOG, newest=False)


def retrain(labels: DataFrame, models: str, version: int, fit: Callable[[DataFrame], PipelineModel]) -> bool:
    """Fit, save as ``version`` and make it current; False where the fit fails, which changes nothing."""
    spark = labels.sparkSession
    if version in versioned.versions(spark, models):
        return True
    try:
        model = fit(labels)
    except Exception:  # noqa: BLE001 - the labels so far may not do; the model before stays in use
        logging.getLogger(__name__).exception("retraining failed on version %s", version)
        return False
    model.write().overwrite().save(versioned.folder(models, version))
    versioned.commit(spark, models, version)
    return True


def current_model(spark: SparkSession, models: str) -> PipelineModel | None:
    """The model in use."""
    version = versioned.current(spark, models)
    return None if version is None else PipelineModel.load(versioned.folder(models, version))
