"""Starting and draining streaming queries over files; sinks that survive a restart."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State that outgrows memory lives on local disk and is snapshotted to the checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


@contextmanager
def state_partitions(spark: SparkSession) -> Iterator[None]:
    """No more state partitions than cores for a query started here: each opens a store and a Python worker in every micro-batch,
    however few rows come."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def file_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run everything available into a Parquet sink (exactly once, by its commit log) and read the sink."""
    use_rocksdb(stream.sparkSession)
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/_state")
    with state_partitions(stream.sparkSession):
        query = writer.trigger(availableNow=True).start(f"{path}/out")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def run_batches(stream: DataFrame, path: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run everything available through ``handle``, which must stand the replay of a batch."""
    use_rocksdb(stream.sparkSession)
    writer = stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", f"{path}/_state")
    writer.trigger(availableNow=True).start().awaitTermination()


def drain_batches(stream: DataFrame, path: str, handle: Callable[[DataFrame, int], DataFrame], schema: str, mode: str = "append") -> DataFrame:
    """Run everything available through ``handle`` and keep each micro-batch's result.

    A result is written to its own batch folder with overwrite, so a batch replayed after a failure replaces itself.
    """
    run_batches(stream, path, lambda batch, n: handle(batch, n).write.mode("overwrite").parquet(f"{path}/out/batch_id={n}"), mode)
    return stream.sparkSession.read.schema(f"{schema}, batch_id bigint").parquet(f"{path}/out")


def drain_parts(stream: Callable[[str], DataFrame], parts: Sequence[DataFrame], path: str) -> DataFrame:
    """Deliver ``parts`` one after another to the folder that ``stream`` reads; after each the query is started again from its
    checkpoint, runs what is new and stops. The sink is the same as if it had never stopped."""
    out = None
    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        out = drain(stream(f"{path}/in"), path)
    return out


def time_ordered(df: DataFrame, us: str, parts: int, delay: int, late: Column) -> list[DataFrame]:
    """``df`` cut at equal times of ``us``; rows that are ``late`` and within ``delay`` of their part's end come with the next part."""
    low, high = df.agg(F.min(us), F.max(us)).first()
    if low is None:
        return [df]
    width = (high - low) // parts + 1
    own = F.floor((F.col(us) - low) / F.lit(width)).cast("int")
    held = late & (low + (own + 1) * width - F.col(us) < delay) & (own < parts - 1)
    dealt = df.withColumn("_part", own + held.cast("int"))
    return [dealt.filter(F.col("_part") == k).drop("_part") for k in range(parts)]


def replay(df: DataFrame, path: str, files: int) -> str:
    """Write a frame as several files for a stream to pick up one by one."""
    df.repartition(files).write.mode("overwrite").parquet(path)
    return path
