"""Tolerant line readers, incremental reading of growing files, idempotent imports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefspark.functions.hashing import SEP
from prefspark.session import cut_lineage
from prefspark.sources import versioned


def parse_lines(df: DataFrame, line: str, schema: str) -> DataFrame:
    """Objects parsed from text lines; blank, malformed and non-object lines are skipped."""
    text = F.trim(F.col(line))
    candidate = df.filter(text.startswith("{"))
    broken = "_broken string"
    parsed = candidate.withColumn("_o", F.from_json(text, f"{schema}, {broken}", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    good = parsed.filter(F.col("_o").isNotNull() & F.col("_o._broken").isNull())
    fields = [f for f in good.schema["_o"].dataType.names if f != "_broken"]
    kept = [c for c in df.columns if c != line]
    return good.select(*kept, *[F.col(f"_o.{f}").alias(f) for f in fields])


LINE = "file string, line_no bigint, value string"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of the text files below ``path`` with its file and its number in it, from 1.

    Rows of a file split follow each other in one partition; the lines of the splits before it are counted per split."""
    text = spark.read.option("recursiveFileLookup", "true").text(path)
    placed = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_at"))
    splits = placed.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "block", "first", before.alias("before"))  # a row per split
    return placed.join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("_at") - F.col("first") + 1).alias("line_no"), "value")


def line_fault(line: Column | str) -> Column:
    """Why a line holds no record: blank, broken, or no object; null for an object."""
    text = F.trim(F.coalesce(F.col(line) if isinstance(line, str) else line, F.lit("")))
    tree = F.try_parse_json(text)
    return (
        F.when(text == "", "blank").when(tree.isNull(), "broken").when(~F.schema_of_variant(tree).startswith("OBJECT"), "not an object")
    )


def read_new_lines(spark: SparkSession, path: str, state: str, schema: str) -> DataFrame:
    """Objects of the JSON lines that no earlier call has read, with ``file`` and ``line_no``.

    ``state`` keeps, in versions, how many lines of each file were read (``state``/read) and the lines that hold no object with
    the reason (``state``/rejected). A call that fails changes neither, so its lines are read again. Files only grow.
    """
    read = versioned.read(spark, f"{state}/read", "file string, lines bigint")
    run = (versioned.current(spark, f"{state}/read") or 0) + 1
    lines = numbered_lines(spark, path)
    new = lines.join(read, "file", "left").filter(F.col("line_no") > F.coalesce("lines", F.lit(0))).drop("lines")
    new = cut_lineage(new.withColumn("fault", line_fault("value")))
    totals = read.unionByName(new.groupBy("file").agg(F.max("line_no").alias("lines"))).groupBy("file").agg(F.max("lines").alias("lines"))
    versioned.write(new.filter("fault IS NOT NULL").select("file", "line_no", "fault", "value"), f"{state}/rejected", run)
    versioned.write(totals, f"{state}/read", run)
    return parse_lines(new.filter("fault IS NULL").select("file", "line_no", "value"), "value", schema)


def rejected_lines(spark: SparkSession, state: str) -> DataFrame:
    """All lines that were read and hold no object: file, line_no, fault, value."""
    run = versioned.current(spark, f"{state}/read") or 0
    return versioned.read(spark, f"{state}/rejected", "file string, line_no bigint, fault string, value string", before=run + 1, newest=False)


def record_key(columns: Sequence[str]) -> Column:
    """sha256 identity of a record over the named columns."""
    return F.sha2(F.concat_ws(SEP, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def new_records(records: DataFrame, target: DataFrame | None, columns: Sequence[str], key: str = "legacy_key") -> DataFrame:
    """Records not yet in ``target``, once each: importing the same input again adds nothing."""
    keyed = records.withColumn(key, record_key(columns)).dropDuplicates([key])
    return keyed if target is None else keyed.join(target.select(key), key, "left_anti")
