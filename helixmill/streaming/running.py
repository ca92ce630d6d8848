"""Reads and events as streams: the same transforms, with totals that add up batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions import expressions as E
from helixmill.operators import stats


def read_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Reads that arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def passing(df: DataFrame, **filters) -> DataFrame:
    """The filter works on streams as on tables: it keeps no state."""
    return df.where(E.verdict("seq", "qual", **filters) == E.PASS)


def bucket_counts(df: DataFrame) -> DataFrame:
    """Running counts by verdict; state is one row per verdict."""
    return df.groupBy(E.verdict("seq", "qual").alias("result")).agg(F.count(F.lit(1)).alias("n"))


def first_deliveries(df: DataFrame, ident: str = "read_id", at: str = "loaded_at", delay: str = "1 day") -> DataFrame:
    """Repeated deliveries of an id dropped; an id is remembered until the watermark has passed ``delay``, which bounds the state.

    Rows later than ``delay`` are dropped, as with any watermark: choose it longer than the latest delivery.
    """
    return df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark([ident])


def running_profile(df: DataFrame, folder: str, checkpoint: str):
    """Per-cycle statistics, kept as one Parquet folder of partial sums per batch. A batch that runs again replaces its own folder,
    so every read counts once; ``profile_so_far`` adds them up."""

    def add(batch: DataFrame, number: int) -> None:
        # one small file: a row per cycle and base
        stats.per_cycle(batch).coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return df.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def profile_so_far(spark: SparkSession, folder: str) -> DataFrame:
    parts = spark.read.option("basePath", folder).parquet(folder)
    return parts.groupBy("cycle", "base").agg(*[F.sum(c).alias(c) for c in ("n", "qsum", "q20", "q30")])


def windowed_load(df: DataFrame, width: str = "10 minutes", delay: str = "30 minutes") -> DataFrame:
    """Mean and peak CPU per source and tumbling window of arrival; late rows count until the watermark."""
    source = F.element_at(F.split("input_file", "/"), -1)
    return df.withColumn("received_at", F.col("received_at").cast("timestamp")).withWatermark("received_at", delay).groupBy(F.window("received_at", width), source.alias("source")).agg(F.avg("cpu_pct").alias("mean_cpu"), F.max("cpu_pct").alias("peak_cpu"), F.count(F.lit(1)).alias("n"))
