"""Incremental ingest of arriving record files, and a live summary.

Files arrive in a folder; every key is kept once. With a watermark the key state is bounded: a
repeat that comes later than the watermark's delay is not recognised, which callers accept by
choosing the delay. Without one, state grows with the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())]
)

#: What a live summary reads of record files.
RECORDS = T.StructType(
    [T.StructField("model_slug", T.StringType()), T.StructField("task", T.StringType()), T.StructField("seed", T.LongType()), T.StructField("instance_id", T.LongType()), T.StructField("gen_lens", T.ArrayType(T.LongType()))]
)


def arriving(spark: SparkSession, folder: str, schema: T.StructType = EVENTS, files_per_trigger: int = 100) -> DataFrame:
    """Rows of the JSON files of a folder as a stream; a torn last line is a null key and is left out."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder).where(F.col(schema[0].name).isNotNull())


def once_by_key(stream: DataFrame, key: str | list[str], time: str | None = None, delay: str | None = None) -> DataFrame:
    key = [key] if isinstance(key, str) else key
    if time and delay:
        return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)
    return stream.dropDuplicates(key)


def ingest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what is there to a Parquet table, then stop; a restart goes on where it stopped."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def live_summary(stream: DataFrame, by: list[str], value: str, path: str, checkpoint: str) -> None:
    """Counts and sums by group, kept as one row a group.

    A batch merges its groups into what the batch before it left and writes that to the other one of two slots, so the
    table never holds more than two states, however many batches there were. A replayed batch reads the slot of the one
    before it again and overwrites its own.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        part = batch.groupBy(*by).agg(F.count("*").alias("n"), F.sum(value).cast("double").alias("total"))
        if number > 0:
            before = spark.read.schema(T.StructType([*part.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/slot={(number - 1) % 2}")
            part = before.where(F.col("batch") == number - 1).drop("batch").unionByName(part).groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        part.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/slot={number % 2}")

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_summary(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """The newest state of a live summary."""
    slots = spark.read.parquet(path)
    newest = slots.agg(F.max("batch").alias("newest"))
    return slots.join(F.broadcast(newest), F.col("batch") == F.col("newest")).select(*by, "n", "total")  # one row
