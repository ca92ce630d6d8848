"""Bounded samples of documents that models are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sampled(docs: DataFrame, n: int, seed: int, ident: str = "doc_id") -> DataFrame:
    """The rows of the ``n`` ids with the smallest hashes, the same whatever the partitions. Only hashes move to find the bound, no texts.

    Rows without an id are left out. An empty table or an ``n`` of 0 gives none.
    """
    place = F.xxhash64(F.lit(seed), F.col(ident))
    there = docs.where(F.col(ident).isNotNull())
    bound = there.select(place.alias("h")).distinct().orderBy("h").limit(n).agg(F.max("h").alias("h")).first()["h"]
    return there.where(place <= F.lit(bound)) if bound is not None else there.limit(0)
