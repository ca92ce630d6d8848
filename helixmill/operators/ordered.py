"""Blocks of an ordered table, for operators that look at neighbours, without one task per series.

A window over ``partitionBy(source)`` puts all rows of a source into one task. Here the whole table is sorted
by ranges, every row gets its exact global rank, and blocks of equal size take ``halo`` rows from either side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.operators.staging import staged

_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``rank``: its place in the order of the columns ``order``, from 0 and without gaps.

    The order must be total (end it with a unique id), else rows that tie get an arbitrary but fixed order.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    put = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    put = staged(put, "ranked")
    part = F.shiftright("_at", _BITS)
    sizes = {r["p"]: r["n"] for r in put.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a range
    before, begin = 0, {}
    for p in sorted(sizes):
        begin[p] = before
        before += sizes[p]
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in begin.items() for x in kv]), part) if begin else F.lit(0)
    return put.withColumn("rank", offset + F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1))).drop("_at")


def blocks(df: DataFrame, size: int, halo: int) -> DataFrame:
    """Every row of a ranked table once with ``core`` true, in its ``block``, and again in a neighbour block if within ``halo`` of it."""
    own = F.floor(F.col("rank") / size).cast("long")
    lo, hi = F.floor((F.col("rank") - halo) / size).cast("long"), F.floor((F.col("rank") + halo) / size).cast("long")
    return df.withColumn("block", F.explode(F.sequence(F.greatest(lo, F.lit(0).cast("long")), hi))).withColumn("core", F.col("block") == own)
