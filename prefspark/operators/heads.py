"""Model heads on MLlib: weights, labels, folds, fits, stacking with calibration, importances, persistence."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.functions.feedback import effective_domain, normalize_asset_reason
from prefspark.functions.labels import detail, uncertainty
from prefspark.functions.numeric import clean_numeric_token, truthy
from prefspark.functions.text import parse_list
from prefspark.operators.bucketed import ordered_scan

MIN_META_ROWS, MIN_SECOND_ROWS, MIN_SECOND_CLASS, MIN_ASSET_ROWS = 20, 20, 5, 8


@dataclass(frozen=True)
class WeightConfig:
    """Shipped sample weights: how much a labelled row teaches each head."""

    manual_correction: float = 1.35
    pass_correction: float = 2.75
    maximum: float = 8.0
    uncertainty_boost: float = 0.5
    asset_label_weight: float = 1.6
    synthetic: float = 0.35
    intensity: dict[str, float] = field(default_factory=lambda: {"1": 0.85, "2": 1.0, "3": 1.35})
    asset_reasons: dict[str, float] = field(default_factory=lambda: {"photo_general": 1.0, "photo_style": 0.75, "photo_context": 0.55})
    photo_head: dict[str, float] = field(
        default_factory=lambda: {"photo": 2.6, "bio": 0.25, "interests": 0.25, "descriptors": 0.35, "other": 0.45, "": 0.35}
    )
    text_head: dict[str, float] = field(
        default_factory=lambda: {"photo": 0.25, "bio": 2.4, "interests": 2.4, "descriptors": 2.0, "other": 0.45, "": 0.35}
    )


# fixed values: accepted words for moving an asset score, and the reason each fine detail stands for
ADJUSTMENT_WORDS = {"higher": ("higher", "up", "positive", "good"), "lower": ("lower", "down", "negative", "bad")}
FINE_DETAILS = {"style_outfit": "photo_style", "black_photo": "photo_style", "photo_quality": "photo_style", "context_lifestyle": "photo_context"}


def _lookup(table: dict[str, float], key: Column, default: float) -> Column:
    case = F
    for name, value in table.items():
        case = case.when(key == name, F.lit(float(value)))
    return case.otherwise(F.lit(float(default)))


def score_adjustment(details: Column | str) -> Column:
    word, case = F.lower(F.trim(detail(details, "photo_score_adjustment"))), F
    for canonical, words in ADJUSTMENT_WORDS.items():
        case = case.when(word.isin(*words), canonical)
    return case.otherwise("")


def head_label(label: Column, details: Column | str, head: str) -> Column:
    """Label a head learns from: the asset head follows an explicit adjustment of the asset score."""
    if head != "photo":
        return label.cast("int")
    adjustment = score_adjustment(details)
    return F.when(adjustment == "higher", 1).when(adjustment == "lower", 0).otherwise(label.cast("int"))


def fine_reason(details: Column | str, target: Column) -> Column:
    """Most named reason among the fine details that agree with the target; style before context on a tie."""
    names = F.when(target == 1, detail(details, "photo_positive_details")).otherwise(detail(details, "photo_negative_details"))
    listed = parse_list(names)
    counts = {}
    for reason in ("photo_style", "photo_context"):
        members = F.array(*[F.lit(d) for d, r in FINE_DETAILS.items() if r == reason])
        counts[reason] = F.size(F.filter(listed, lambda x: F.array_contains(members, x)))
    style, context = counts["photo_style"], counts["photo_context"]
    return F.when((style == 0) & (context == 0), "").when(style >= context, "photo_style").otherwise("photo_context")


def sample_weight(
    df: DataFrame,
    head: str,
    *,
    source: str,
    domain: str,
    domains: Column,
    details: str,
    reason: str,
    intensity: str,
    corrected: str,
    label: str,
    model_like: Column,
    p: Column,
    config: WeightConfig = WeightConfig(),
    out: str = "weight",
) -> DataFrame:
    """Weight of each row for one head. Feedback that names the head's domain counts more, corrections more still,
    and rows the model was unsure about a little more."""
    base_table = config.photo_head if head == "photo" else config.text_head
    photo = head == "photo"
    origin = F.lower(F.trim(F.coalesce(F.col(source), F.lit(""))))
    real = origin == "real"
    staged = df.withColumns(
        {
            "_domain": F.when(origin.isin("real", "photo_deep"), effective_domain(domain, domains, head)).otherwise(F.lower(F.trim(F.col(domain)))),
            "_adj": F.when(real, score_adjustment(details)).otherwise(""),
            "_int": clean_numeric_token(intensity),
            "_why": normalize_asset_reason(F.coalesce(F.nullif(detail(details, "photo_reason"), F.lit("")), F.col(reason))),
        }
    )
    adjusted = F.lit(photo) & (F.col("_adj") != "")
    base = (
        F.when(origin == "synthetic", config.synthetic)
        .when(origin == "photo_deep", config.asset_label_weight if photo else base_table[""])
        .when(real, _lookup(base_table, F.col("_domain"), base_table["other"]))
        .otherwise(base_table["other"])
    )
    told = real & (F.col("_domain") != "")
    by_intensity, by_reason = _lookup(config.intensity, F.col("_int"), 1.0), _lookup(config.asset_reasons, F.col("_why"), 1.0)
    weight = base * F.when(told & ~adjusted, by_intensity).otherwise(1.0)
    if photo:
        weight = weight * F.when(told & (F.col("_domain") == "photo") & ~adjusted, by_reason).otherwise(1.0)
        stated = F.coalesce(F.nullif(clean_numeric_token(detail(details, "photo_score_intensity")), F.lit("")), F.col("_int"))
        usual = F.when(stated.isin("1", "2", "3"), stated).otherwise("2")
        why = normalize_asset_reason(
            F.coalesce(F.nullif(detail(details, "photo_score_reason"), F.lit("")), F.nullif(detail(details, "photo_reason"), F.lit("")), F.col(reason))
        )
        moved = F.greatest(weight, F.lit(base_table["photo"])) * _lookup(config.intensity, usual, 1.0) * _lookup(config.asset_reasons, why, 1.0)
        staged = staged.withColumn("_w", F.when(adjusted, moved).otherwise(weight))
        fine = fine_reason(details, head_label(F.col(label), details, head))
        fine_intensity = F.when(adjusted, usual).when(F.col("_int").isin("1", "2", "3"), F.col("_int")).otherwise("2")
        fine_weight = F.lit(base_table["photo"]) * _lookup(config.intensity, fine_intensity, 1.0) * _lookup(config.asset_reasons, fine, 1.0)
        staged = staged.withColumn("_w", F.when(real & (fine != ""), F.greatest(F.col("_w"), fine_weight)).otherwise(F.col("_w")))
    else:
        staged = staged.withColumn("_w", weight)
    is_corrected = truthy(corrected)
    to_pass = is_corrected & (F.col(label) == 0) & model_like
    corrections = F.when(is_corrected, config.manual_correction).otherwise(1.0) * F.when(to_pass, config.pass_correction).otherwise(1.0)
    boost = F.when(p.between(0.0, 1.0), 1.0 + config.uncertainty_boost * uncertainty(p)).otherwise(1.0)
    total = F.col("_w") * corrections * boost
    limited = F.least(total, F.lit(config.maximum)) if config.maximum > 0 else total
    return staged.withColumn(out, limited).drop("_domain", "_adj", "_int", "_why", "_w")


@dataclass(frozen=True)
class HeadConfig:
    """Fit settings: logistic below ``min_rows``, boosted trees from there on."""

    min_rows: int = 30
    trees: int = 160
    depth: int = 4
    step: float = 0.04
    subsample: float = 0.85
    min_leaf: int = 12
    seed: int = 42


def feature_matrix(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Numeric vector in fixed feature order; missing values are 0, as the imputer of the reference model has it."""
    filled = df.select(*keep, *[F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None)), F.lit(0.0)).alias(f) for f in features])
    return VectorAssembler(inputCols=list(features), outputCol="raw_features", handleInvalid="keep").transform(filled)


def balanced(df: DataFrame, label: str, weight: str | None) -> tuple[DataFrame, dict[int, int]]:
    """Weights multiplied by n / (2 * class size), and the class sizes (two rows, brought to the driver)."""
    sizes = {int(r[0]): int(r[1]) for r in df.groupBy(label).agg(F.count("*")).collect()}
    if sorted(sizes) != [0, 1]:
        raise ValueError(f"training needs both classes, got {sorted(sizes)}")
    n = sum(sizes.values())
    factor = F.when(F.col(label) == 1, n / (2.0 * sizes[1])).otherwise(n / (2.0 * sizes[0]))
    return df.withColumn("_weight", factor * (F.col(weight) if weight else F.lit(1.0))), sizes


#: Rows of a matrix that one task of a fit reads.
TASK_ROWS = 500_000


def matrix_tasks(spark: SparkSession, rows: int) -> int:
    """Partitions of a matrix: the trees read it more than a thousand times, so a task for every piece of the texts it came from would
    cost more than the rows in it; no fewer than there are cores."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def fit_heads(spark: SparkSession, heads: Sequence[tuple[DataFrame, Sequence[str], str, str | None]], config: HeadConfig = HeadConfig()) -> list[PipelineModel]:
    """Independent heads (frame, features, label, weight), fitted side by side: the steps of one are too short to fill the cores."""
    return _in_parallel(spark, list(heads), lambda head: fit_head(*head, config), len(heads))


def fit_head(df: DataFrame, features: Sequence[str], label: str, weight: str | None = None, config: HeadConfig = HeadConfig()) -> PipelineModel:
    """Fit one head. The matrix is built once and kept while the iterations read it."""
    keep = [label] + ([weight] if weight else [])
    matrix, sizes = balanced(feature_matrix(df.filter(F.col(label).isNotNull()), features, keep), label, weight)
    matrix = matrix.select("raw_features", F.col(label).cast("double").alias("label"), "_weight")
    matrix = matrix.repartition(matrix_tasks(df.sparkSession, sum(sizes.values()))).persist()
    try:
        scaler = StandardScaler(withMean=True, withStd=True, inputCol="raw_features", outputCol="features")
        if sum(sizes.values()) < config.min_rows:
            classifier = LogisticRegression(maxIter=100, regParam=1.0 / sum(sizes.values()), weightCol="_weight")
        else:
            classifier = GBTClassifier(
                maxIter=config.trees,
                maxDepth=config.depth,
                stepSize=config.step,
                subsamplingRate=config.subsample,
                featureSubsetStrategy=str(config.subsample),
                minInstancesPerNode=config.min_leaf,
                weightCol="_weight",
                seed=config.seed,
            )
        return Pipeline(stages=[scaler, classifier]).fit(matrix)
    finally:
        matrix.unpersist()


def score(model: PipelineModel, df: DataFrame, features: Sequence[str], out: str) -> DataFrame:
    """Probability of a like as column ``out``; the other columns pass through."""
    kept = [c for c in df.columns if c not in features]
    matrix = feature_matrix(df, features, kept)
    scored = model.transform(matrix).withColumn(out, vector_to_array("probability")[1])
    return scored.drop("raw_features", "features", "rawPrediction", "probability", "prediction")


def stratified_folds(df: DataFrame, id_column: str, label: str, seed: int = 42, most: int = 5) -> DataFrame:
    """Column ``fold``: k = max(2, min(5, minority)) balanced folds per class, in hashed order.

    The hash is uniform, so its leading bits cut each class into even buckets and no class is ranked in one task.
    """
    key = F.conv(F.substring(F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f":{seed}"))), 1, 15), 16, 10).cast("bigint")
    ranked = ordered_scan(df.withColumn("_h", key), [label], "_h", id_column, 2**60 // 256, row_number="_rn").drop("_h")
    minority = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("m"))
    k = minority.select(F.greatest(F.lit(2), F.least(F.lit(most), F.col("m"))).alias("folds"))
    placed = ranked.withColumn("folds", k.scalar())
    return placed.withColumn("fold", ((F.col("_rn") - 1) % F.col("folds")).cast("int")).drop("_rn")


def _in_parallel(spark: SparkSession, tasks: list, run, parallelism: int) -> list:
    """Run independent fits from a few threads, as the tuning classes of MLlib do."""
    pool = ThreadPool(min(parallelism, len(tasks)))
    try:
        return pool.map(inheritable_thread_target(spark)(run), tasks)
    finally:
        pool.close()


def out_of_fold(
    df: DataFrame, features: Sequence[str], label: str, out: str, weight: str | None = None, config: HeadConfig = HeadConfig(), parallelism: int = 4
) -> DataFrame:
    """Every row scored by a model that never saw it. ``df`` carries ``fold``; at most five folds are fitted.

    Every fit reads ``df`` again, so pass a materialized frame (``session.cut_lineage``) when it is costly to build.
    """
    folds = [r.fold for r in df.select("fold").distinct().orderBy("fold").collect()]

    def one(fold: int) -> DataFrame:
        model = fit_head(df.filter(F.col("fold") != fold), features, label, weight, config)
        return score(model, df.filter(F.col("fold") == fold), features, out)

    parts = _in_parallel(df.sparkSession, folds, one, parallelism)
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@dataclass(frozen=True)
class StackedModel:
    """Mean of calibrated logistic models, one per fold."""

    features: tuple[str, ...]
    members: tuple[tuple[PipelineModel, float, float], ...]

    def transform(self, df: DataFrame, out: str = "meta_probability") -> DataFrame:
        kept = df.columns
        matrix = feature_matrix(df, self.features, [c for c in kept if c not in self.features])
        total = F.lit(0.0)
        for i, (model, slope, intercept) in enumerate(self.members):
            matrix = model.transform(matrix).withColumn(f"_m{i}", vector_to_array("rawPrediction")[1])
            matrix = matrix.drop("features", "rawPrediction", "probability", "prediction")
            total = total + 1.0 / (1.0 + F.exp(-(F.col(f"_m{i}") * slope + intercept)))
        return matrix.withColumn(out, total / len(self.members)).select(*kept, out)


def fit_stack(df: DataFrame, features: Sequence[str], label: str, c: float = 0.12, parallelism: int = 4) -> StackedModel | None:
    """Logistic on out-of-fold head scores and measurements, Platt-calibrated on the held-out fold of each split.

    None below 20 rows or two rows of a class. ``c`` is the inverse penalty on the summed loss, so MLlib's penalty on
    the mean loss is 1 / (c * n).
    """
    sizes = {r[0]: r[1] for r in df.groupBy(label).agg(F.count("*")).collect()}
    if sum(sizes.values()) < MIN_META_ROWS or len(sizes) < 2 or min(sizes.values()) < 2:
        return None
    folds = [r.fold for r in df.select("fold").distinct().collect()]
    matrix, _ = balanced(feature_matrix(df, features, [label, "fold"]), label, None)
    matrix = matrix.select("raw_features", F.col(label).cast("double").alias("label"), "_weight", "fold").persist()
    n = sum(sizes.values())
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="raw_features", outputCol="features")
    base = LogisticRegression(maxIter=100, regParam=1.0 / (c * n), weightCol="_weight")

    def one(fold: int) -> tuple[PipelineModel, float, float]:
        model = Pipeline(stages=[scaler, base]).fit(matrix.filter(F.col("fold") != fold))
        held = model.transform(matrix.filter(F.col("fold") == fold)).select(vector_to_array("rawPrediction")[1].alias("margin"), "label")
        sigmoid_in = VectorAssembler(inputCols=["margin"], outputCol="features").transform(held)
        sigmoid = LogisticRegression(maxIter=100).fit(sigmoid_in)
        return model, float(sigmoid.coefficients[0]), float(sigmoid.intercept)

    try:
        return StackedModel(tuple(features), tuple(_in_parallel(df.sparkSession, sorted(folds), one, parallelism)))
    finally:
        matrix.unpersist()


def second_weight(intensity: Column, details: Column | str, label: Column, positives: int, negatives: int) -> Column:
    """Weights of the strong-like head."""
    token = clean_numeric_token(intensity)
    liked_asset = (F.size(parse_list(detail(details, "photo_positive_details"))) > 0) | (score_adjustment(details) == "higher")
    return (
        F.when(token == "3", 1.35).when(token == "1", 0.85).otherwise(1.0)
        * F.when(liked_asset, 1.15).otherwise(1.0)
        * F.when(label == 1, max(1.0, negatives / max(positives, 1) * 0.7)).otherwise(1.0)
    )


def fit_second_head(df: DataFrame, features: Sequence[str], strong: Column, intensity: Column, details: str, config: HeadConfig = HeadConfig()) -> PipelineModel | None:
    """Strong like against like, among likes only; None below 20 rows or 5 of either."""
    work = df.withColumn("_strong", strong.cast("int"))
    sizes = {r[0]: r[1] for r in work.groupBy("_strong").agg(F.count("*")).collect()}
    positives, negatives = sizes.get(1, 0), sizes.get(0, 0)
    if positives + negatives < MIN_SECOND_ROWS or min(positives, negatives) < MIN_SECOND_CLASS:
        return None
    weighted = work.withColumn("_w2", second_weight(intensity, details, F.col("_strong"), positives, negatives))
    return fit_head(weighted, features, "_strong", "_w2", config)


def fit_asset_head(df: DataFrame, features: Sequence[str], label: str) -> PipelineModel | None:
    """Separate logistic on the latest label per asset; None below 8 rows or with a single class."""
    sizes = {r[0]: r[1] for r in df.groupBy(label).agg(F.count("*")).collect()}
    if sum(sizes.values()) < MIN_ASSET_ROWS or len(sizes) < 2:
        return None
    return fit_head(df, features, label, None, HeadConfig(min_rows=2**62))


def importances(model: PipelineModel, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """Normalized importances of a head (tree gain, or absolute coefficients)."""
    last = model.stages[-1]
    raw = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    total = float(raw.sum()) or 1.0
    return spark.createDataFrame([(f, float(v) / total) for f, v in zip(features, raw)], "feature string, importance double")


def blend_importances(parts: Sequence[tuple[DataFrame, float]]) -> DataFrame:
    """Head importances times head weights, renormalized over all features."""
    weighted = [df.select("feature", (F.col("importance") * w).alias("importance")) for df, w in parts]
    union = weighted[0]
    for df in weighted[1:]:
        union = union.unionByName(df)
    summed = union.groupBy("feature").agg(F.sum("importance").alias("importance"))
    with_total = summed.withColumn("_t", summed.agg(F.sum("importance")).scalar())
    share = F.when(F.col("_t") > 0, F.col("importance") / F.col("_t")).otherwise(0.0)
    return with_total.select("feature", share.alias("importance"))


def top_features(importance: DataFrame, n: int = 3) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def class_mean_direction(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Per feature the mean of likes and passes, and which side the feature speaks for."""
    one = F.col(label) == 1
    aggs = []
    for f in features:
        aggs += [F.avg(F.when(one, F.col(f))).alias(f"l_{f}"), F.avg(F.when(~one, F.col(f))).alias(f"p_{f}")]
    wide = df.agg(*aggs)
    rows = ", ".join(f"'{f}', CAST(`l_{f}` AS DOUBLE), CAST(`p_{f}` AS DOUBLE)" for f in features)
    long = wide.select(F.expr(f"stack({len(features)}, {rows}) AS (feature, like_mean, pass_mean)"))
    return long.withColumn("direction", F.when(F.col("like_mean") > F.col("pass_mean"), "like").otherwise("pass"))


def save_models(heads: dict[str, PipelineModel], features: dict[str, Sequence[str]], version: int, path: str, spark: SparkSession) -> None:
    """Persist heads with the feature lists and version they were trained under."""
    for name, model in heads.items():
        model.write().overwrite().save(f"{path}/{name}")
    meta = json.dumps({"version": version, "features": {k: list(v) for k, v in features.items()}, "heads": sorted(heads)}, sort_keys=True)
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_models(features: dict[str, Sequence[str]], version: int, path: str, spark: SparkSession) -> dict[str, PipelineModel] | None:
    """The saved heads, or None when version or any feature list (order included) differs from what is expected."""
    meta = json.loads(spark.read.text(f"{path}/metadata").first().value)
    expected = {k: list(v) for k, v in features.items()}
    if meta.get("version") != version or meta.get("features") != expected or set(meta.get("heads", [])) != set(expected):
        return None
    return {name: PipelineModel.load(f"{path}/{name}") for name in meta["heads"]}
