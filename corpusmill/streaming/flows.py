"""Incremental versions of ingest, counting, scoring and trends."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_new_files(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files as they arrive; the schema is given, never inferred."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # a trailing wildcard lets the path be one file as well as a folder of files
    return reader.parquet(f"{path.rstrip('/')}*")


def utc_instant(column: str) -> Column:
    """A time without zone, read as UTC, as the instant that watermarks need."""
    local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(column))
    return local.cast("timestamp")


def utc_wall_clock(column: str) -> Column:
    """The inverse of `utc_instant`."""
    wall = F.col(column).cast("timestamp_ntz")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), wall)


def first_arrivals(
    stream: DataFrame,
    key: str = "identifier",
    time: str = "ts",
    delay: str = "1 day",
    splits: int = 16,
) -> DataFrame:
    """The first record per key to arrive; state is kept for `delay` only.

    Copies are dropped in two steps. The first one also keys on the input
    partition, so that the copies of a hot key are spread over `splits` tasks and
    at most that many rows per key reach the second step.
    """
    split = F.spark_partition_id() % splits
    return (
        stream.withWatermark(time, delay)
        .withColumn("_split", split)
        .dropDuplicatesWithinWatermark([key, "_split"])
        .drop("_split")
        .dropDuplicatesWithinWatermark([key])
    )


def running_counts(stream: DataFrame, column: str) -> DataFrame:
    """Counts per value over everything seen so far (complete mode)."""
    return stream.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("n")
    )


def windowed_means(
    stream: DataFrame,
    keys: Sequence[str],
    value: str,
    time: str = "ts",
    width: str = "1 day",
    delay: str = "1 hour",
) -> DataFrame:
    """Count and mean per tumbling window and key; rows later than `delay` are dropped."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.window(time, width), *keys)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"))
        .select(F.col("window.start").alias("window_start"), *keys, "n", "mean_value")
    )


def run_available(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Process what has arrived into a Parquet folder and stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def run_batches(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    mode: str = "append",
) -> StreamingQuery:
    """Apply a batch transformation to every micro-batch and write the result.

    A batch goes to a folder of its own that a repeat overwrites, so a restart
    after a failure leaves no row twice. In complete mode every folder holds the
    whole result so far; `latest_batch` reads the last one.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what each micro-batch changes in an aggregate.

    In update mode a group is there from its first row on, open windows too, while the
    watermark still drops the state of closed ones. `latest_rows` reads the result.
    """
    return run_batches(stream, lambda batch: batch, path, checkpoint, "update")


def latest_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last state of each group that an update run wrote; one aggregate, combined on the map side."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in values])


def latest_batch(spark: SparkSession, path: str) -> DataFrame:
    """The newest result of a complete-mode run."""
    rows = spark.read.parquet(path)
    newest = rows.agg(F.max("batch")).scalar()
    return rows.where(F.col("batch") == newest).drop("batch")
