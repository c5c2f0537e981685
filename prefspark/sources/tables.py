"""Labelled-table sources and sinks: padded CSV scan, schema migration, contract rows, appends, listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.functions.attrs import sorted_map_json
from prefspark.functions.labels import correction_type, preference_tier, review_priority
from prefspark.functions.numeric import half_up
from prefspark.operators.labelled import is_real

# fixed values: the stored order of the labelled-table columns (measurement columns are the user's own and follow)
CONTRACT = (
    "name",
    "age",
    "distance_km",
    "bio",
    "interests",
    "descriptors",
    "photo_url_key",
    "photo_url_keys",
    "photo_fingerprint",
    "ai_decision",
    "final_decision",
    "manual_corrected",
    "feedback_domain",
    "feedback_reason",
    "feedback_intensity",
    "feedback_sentiment",
    "feedback_secondary",
    "feedback_details",
    "swipe_probability",
    "preference_tier",
    "correction_type",
    "review_priority",
    "ranking_score",
    "label",
    "source",
)


def pad_to_contract(df: DataFrame, contract: Sequence[str] = CONTRACT) -> DataFrame:
    """Columns of the contract in contract order, absent ones as empty text."""
    return df.select(*[F.col(c).cast("string").alias(c) if c in df.columns else F.lit("").alias(c) for c in contract])


def csv_scan_padded(spark: SparkSession, path: str, contract: Sequence[str] = CONTRACT) -> DataFrame:
    """Read a CSV as text columns of the contract; a missing file gives an empty frame with the schema."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in contract))
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return pad_to_contract(raw, contract).fillna("")


def migrate_derive(df: DataFrame, contract: Sequence[str] = CONTRACT) -> DataFrame:
    """Old rows under the current contract, with tier, correction, ranking score and priority derived where empty."""
    snapshot = F.col("ai_snapshot") if "ai_snapshot" in df.columns else F.lit(None).cast("string")
    padded = pad_to_contract(df.withColumn("_snap", snapshot), [*contract, "_snap"])

    def keep_or(column: str, derived: Column) -> Column:
        return F.coalesce(F.nullif(F.col(column), F.lit("")), derived.cast("string"), F.lit(""))

    tier = preference_tier("final_decision", "label", "feedback_details", "feedback_reason", "preference_tier")
    out = padded.withColumn("preference_tier", tier)
    out = out.withColumn("correction_type", correction_type(F.col("preference_tier"), "ai_decision", "final_decision", "correction_type"))
    out = out.withColumn("ranking_score", keep_or("ranking_score", F.get_json_object("_snap", "$.probability")))
    priority = review_priority(F.col("ranking_score").try_cast("double"), "correction_type")
    return out.withColumn("review_priority", keep_or("review_priority", priority)).select(*contract)


def to_contract_row(
    *, tags: Column, attrs: Column, numbers: dict[str, Column], label: Column, model: Column, final: Column, details: Column
) -> dict[str, Column]:
    """Nested record to flat text columns: joined tags, sorted attribute JSON, numbers to 6 places, derived tier."""

    def number(c: Column) -> Column:
        x = c.cast("double")
        return F.when(x.isNull() | F.isnan(x), "").otherwise(half_up(x, 6).cast("string"))

    tier = preference_tier(final, label, details)
    return {
        "interests": F.concat_ws(",", tags),
        "descriptors": sorted_map_json(attrs),
        **{n: number(c) for n, c in numbers.items()},
        "label": F.coalesce(label.cast("int").cast("string"), F.lit("")),
        "preference_tier": tier,
        "correction_type": correction_type(tier, model, final),
    }


def real_rows(df: DataFrame, origin: str, label: str, columns: Sequence[str]) -> DataFrame:
    """Real rows with an integer label; without an origin column every row counts as real."""
    value = F.col(label).cast("string").try_cast("int")
    real = is_real(F.col(origin)) if origin in df.columns else F.lit(True)
    return df.filter(real & value.isNotNull()).select(*columns, value.alias("label"))


def append_labelled(rows: DataFrame, path: str) -> int:
    """Append rows to the table and return how many it holds now."""
    rows.write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path).count()


def list_assets(spark: SparkSession, path: str, limit: int, pattern: str = "*") -> DataFrame:
    """Newest assets first: path, size and modification time. File contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    newest = files.orderBy(F.desc("modificationTime"), "path").limit(limit)
    return newest.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "modificationTime")


def synthetic_rows(pool: DataFrame, key: str, text: str, tags: str, seed: int = 42) -> DataFrame:
    """Balanced synthetic rows from a pool: each pool row yields one liked and one rejected row.

    The rejected one carries a reason (age, bio, interests or mixed) drawn from a seeded hash, and takes the text or the
    tags of the pool's negative side accordingly.
    """
    draw = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("bigint")
    reasons = F.array(*[F.lit(r) for r in ("age", "bio", "interests", "mixed")])
    reason = F.element_at(reasons, (draw % 4 + 1).cast("int"))
    both = F.array(
        F.struct(F.lit(1).alias("label"), F.lit("").alias("reason")), F.struct(F.lit(0).alias("label"), reason.alias("reason"))
    )
    rows = pool.select(key, text, tags, F.inline(both))
    flip_text, flip_tags = F.col("reason").isin("bio", "mixed"), F.col("reason").isin("interests", "mixed")
    return rows.select(
        key,
        "label",
        "reason",
        F.when(flip_text, F.reverse(text)).otherwise(F.col(text)).alias("text"),
        F.when(flip_tags, F.array().cast("array<string>")).otherwise(F.col(tags)).alias("tags"),
        F.lit("synthetic").alias("source"),
    )
