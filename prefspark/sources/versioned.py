"""Tables and models in numbered versions with a pointer that moves in one step.

A version is written whole into a folder of its own; only then a small marker file, created once and never changed, makes it
count. Readers look at markers, so they see a version complete or not at all, and a failed or replayed write leaves what was
current before. On a store without create-if-absent, one writer at a time is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all committed versions, rising."""
    fs, markers = _path(spark, f"{path}/_versions")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(markers)) if fs.exists(markers) else []


def current(spark: SparkSession, path: str) -> int | None:
    """The newest committed version."""
    return max(versions(spark, path), default=None)


def folder(path: str, version: int) -> str:
    return f"{path}/version={version}"


def commit(spark: SparkSession, path: str, version: int) -> None:
    """Make a version count that has been written; fails if it counts already."""
    fs, marker = _path(spark, f"{path}/_versions/{version:010d}")
    fs.create(marker, False).close()


def write(df: DataFrame, path: str, version: int) -> bool:
    """Write and commit a version, unless it counts already (a replay): then nothing happens and the answer is False."""
    if version in versions(df.sparkSession, path):
        return False
    df.write.mode("overwrite").parquet(folder(path, version))
    commit(df.sparkSession, path, version)
    return True


def read(spark: SparkSession, path: str, schema: StructType | str, before: int | None = None, newest: bool = True) -> DataFrame:
    """The newest version, or all versions together, of those that count (and are ``before`` a number); empty without any."""
    chosen = [v for v in versions(spark, path) if before is None or v < before]
    chosen = chosen[-1:] if newest else chosen
    return spark.read.schema(schema).parquet(*[folder(path, v) for v in chosen]) if chosen else spark.createDataFrame([], schema)


def drop_before(spark: SparkSession, path: str, version: int) -> None:
    """Remove versions that are no longer needed, marker first."""
    for v in versions(spark, path):
        if v < version:
            fs, marker = _path(spark, f"{path}/_versions/{v:010d}")
            fs.delete(marker, False)
            fs, old = _path(spark, folder(path, v))
            fs.delete(old, True)
