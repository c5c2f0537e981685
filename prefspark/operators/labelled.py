"""Operators over labelled rows: trainable counts, unions, overrides, snapshots, edits by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.functions.numeric import half_up


def numeric_label(label: Column) -> Column:
    """0 or 1, null when the stored text is neither."""
    x = label.cast("string").try_cast("double")
    return F.when(x.isin(0.0, 1.0), x.cast("int"))


def is_real(origin: Column, blank_counts: bool = False) -> Column:
    word = F.lower(F.trim(F.coalesce(origin, F.lit(""))))
    return word.isin("real", "") if blank_counts else word == "real"


def trainable_counts(df: DataFrame, origin: str, label: str) -> DataFrame:
    real, usable = is_real(F.col(origin)), numeric_label(F.col(label)).isNotNull()
    return df.agg(F.count("*").alias("rows"), F.count_if(real).alias("real_rows"), F.count_if(real & usable).alias("trainable"))


def load_all_union(real: DataFrame, synthetic: DataFrame, label: str = "label", trainable_only: bool = True) -> DataFrame:
    """Union of unlike schemas; by default only rows whose label is 0 or 1, as an int."""
    both = real.unionByName(synthetic, allowMissingColumns=True)
    if not trainable_only:
        return both
    return both.withColumn(label, numeric_label(F.col(label))).filter(F.col(label).isNotNull())


def detail_override(code: Column, measured: dict[str, Column], table: dict[str, dict[str, float]]) -> dict[str, Column]:
    """A correction code replaces the measured columns its (configured) table row names."""
    out = {}
    for name, value in measured.items():
        case = F
        for key, row in table.items():
            if name in row:
                case = case.when(code == key, F.lit(float(row[name])))
        out[name] = value if case is F else case.otherwise(value)
    return out


def decision_snapshot(scores: dict[str, Column], words: dict[str, Column], reasons: dict[str, Column]) -> Column:
    """Scores, words and reason lists of a decision frozen as JSON, so later models cannot change the review."""
    fields = [half_up(c, 4).alias(n) for n, c in sorted(scores.items())]
    fields += [c.alias(n) for n, c in sorted(words.items())]
    fields.append(F.struct(*[c.alias(n) for n, c in sorted(reasons.items())]).alias("groups"))
    return F.to_json(F.struct(F.lit(2).alias("schema_version"), *fields))


def remove_last_match(df: DataFrame, name: str, age: str, order: Sequence[str], targets: DataFrame) -> DataFrame:
    """Delete, for each (name, age) in ``targets``, only the last matching row.

    The last position per key is a partial aggregate; the rows themselves are never gathered per key.
    """
    keyed = df.withColumns({"_name": F.lower(F.trim(F.col(name))), "_age": F.trim(F.col(age).cast("string"))})
    wanted = targets.select(
        F.lower(F.trim(F.col(name))).alias("_name"), F.trim(F.col(age).cast("string")).alias("_age")
    ).distinct()
    position = F.struct(*[F.col(c) for c in order])
    last = keyed.join(wanted, ["_name", "_age"], "left_semi").groupBy("_name", "_age").agg(F.max(position).alias("_last"))
    flat = last.select("_name", "_age", *[F.col(f"_last.{c}").alias(c) for c in order])
    return keyed.join(flat, ["_name", "_age", *order], "left_anti").drop("_name", "_age")


def merge_replace(
    target: DataFrame,
    updates: DataFrame,
    row: str,
    signature: str,
    identity: Sequence[str],
    keys: Sequence[str],
    values: Sequence[str],
) -> DataFrame:
    """Replace rows by position when the signature matches, else when name and age match and the content keys do not
    contradict (one side has none, or any is shared). The old values come back as ``backup_<column>``.
    """
    upd = updates.select(
        row, F.col(signature).alias("_sig"), *[F.col(c).alias(f"_new_{c}") for c in dict.fromkeys([*identity, *keys, *values])]
    )

    def clean(c: Column) -> Column:
        return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))

    def non_blank(columns: list[Column]) -> Column:
        return F.filter(F.array(*[F.trim(F.coalesce(c.cast("string"), F.lit(""))) for c in columns]), lambda x: x != "")

    same = F.lit(True)
    for c in identity:
        same = same & (clean(F.col(c)) == clean(F.col(f"_new_{c}"))) & (clean(F.col(c)) != "")
    old_keys, new_keys = non_blank([F.col(c) for c in keys]), non_blank([F.col(f"_new_{c}") for c in keys])
    compatible = (F.size(old_keys) == 0) | (F.size(new_keys) == 0) | F.arrays_overlap(old_keys, new_keys)
    hit = F.col("_sig").isNotNull() & ((F.col("_sig") == F.col(signature)) | (same & compatible))
    joined = target.join(upd, row, "left").withColumn("replaced", F.coalesce(hit, F.lit(False)))
    backups = {f"backup_{c}": F.when(F.col("replaced"), F.col(c)) for c in values}
    replaced = {c: F.when(F.col("replaced"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in values}
    out = joined.withColumns(backups).withColumns(replaced)
    return out.drop("_sig", *[c for c in upd.columns if c.startswith("_new_")])


def undo_replace(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Put the backed-up values of replaced rows back."""
    restored = {c: F.when(F.col("replaced"), F.col(f"backup_{c}")).otherwise(F.col(c)) for c in values}
    return df.withColumns(restored).drop("replaced", *[f"backup_{c}" for c in values])


def backfill_columns(target: DataFrame, measured: DataFrame, key: str, columns: Sequence[str], needed: Column) -> DataFrame:
    """Rows that need it take ALL measured columns of their match (missing values included) and an outcome word."""
    new = measured.select(key, *[F.col(c).alias(f"_m_{c}") for c in columns], F.lit(True).alias("_matched"))
    joined = target.withColumn("_needed", F.coalesce(needed, F.lit(False))).join(new, key, "left")
    take = F.col("_needed") & F.coalesce(F.col("_matched"), F.lit(False))
    outcome = F.when(take, "updated").when(F.col("_needed"), "failed").otherwise("skipped")
    out = joined.withColumn("outcome", outcome)
    out = out.withColumns({c: F.when(F.col("outcome") == "updated", F.col(f"_m_{c}")).otherwise(F.col(c)) for c in columns})
    return out.drop("_needed", "_matched", *[f"_m_{c}" for c in columns])


def retrain_trigger(before: Column, after: Column, every: int) -> Column:
    """True with the first data, or when the count crossed a multiple of ``every``."""
    return (before == 0) | (F.floor(after / every) > F.floor(before / every))


def coverage(df: DataFrame, groups: dict[str, str]) -> DataFrame:
    """Share of rows whose lead column of each feature group holds something other than blank or zero."""
    n = F.count("*")
    aggs = []
    for group, lead in groups.items():
        text = F.trim(F.coalesce(F.col(lead).cast("string"), F.lit("")))
        aggs.append(F.count_if(~text.isin("", "0", "0.0")).alias(group))
    wide = df.agg(n.alias("_n"), *aggs)
    pairs = ", ".join(f"'{g}', `{g}`" for g in groups)
    long = wide.select("_n", F.expr(f"stack({len(groups)}, {pairs}) AS (feature_group, filled)"))
    percent = F.when(F.col("_n") > 0, half_up(F.col("filled") * 100.0 / F.col("_n"), 4)).otherwise(0.0)
    return long.select("feature_group", "filled", (F.col("_n") - F.col("filled")).alias("empty"), percent.alias("percent"))
