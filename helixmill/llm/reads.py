"""Views of a table of reads that the read operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id and upper-case seq of every read that has one; null or empty seq is no read."""
    return normal(spark.read.parquet(f"{sf_dir}/fastq_reads.parquet"))


def normal(df: DataFrame, id_col: str = "read_id", seq_col: str = "seq") -> DataFrame:
    """Rows without an id or with a null or empty sequence are left out; other columns are dropped."""
    return df.select(F.col(id_col).cast("long").alias("read_id"), F.upper(F.col(seq_col)).alias("seq")).where("read_id is not null and seq is not null and seq <> ''")


def distinct_sequences(df: DataFrame, least: int) -> DataFrame:
    """One row per distinct sequence of at least ``least`` characters: the smallest read_id that holds it (rid) and whether another holds it too.

    Copies meet in a map-side aggregate first, so a sequence held by a third of all rows costs one row a task.
    """
    held = df.where(F.length("seq") >= least).groupBy("seq").agg(F.min("read_id").alias("rid"), F.max("read_id").alias("last"))
    return held.select("rid", "seq", (F.col("last") != F.col("rid")).alias("many"))
