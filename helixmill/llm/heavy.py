"""Most frequent items among billions: iceberg filtering with several hashes, then exact counts of the survivors.

First pass: exact weights of coarse buckets under several hash functions, so memory is ``hashes * buckets``
counters however many distinct values there are. A value whose share reaches the threshold lies in a heavy
bucket under every hash. Second pass: the few values all of whose buckets are heavy are counted exactly.
At most 1/share buckets of a hash can be heavy, which bounds what reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.operators.staging import staged

HASHES, BUCKETS = 3, 1 << 16


def iceberg(df: DataFrame, value: str, weight: Column, least: float, hashes: int = HASHES, buckets: int = BUCKETS) -> DataFrame:
    """Rows of ``df`` whose ``value`` may reach a total weight of ``least``; none that does is left out.

    Null values never survive. ``least`` of 0 or below keeps every row with a value.
    """
    if least <= 0:
        return df.where(F.col(value).isNotNull())
    place = [F.pmod(F.xxhash64(F.lit(i), F.col(value)), F.lit(buckets)).cast("int") for i in range(hashes)]
    marked = df.where(F.col(value).isNotNull()).select(weight.alias("w"), F.posexplode(F.array(*place)).alias("hash", "bucket"))
    heavy = marked.groupBy("hash", "bucket").agg(F.sum("w").alias("w")).where(F.col("w") >= F.lit(least)).select("hash", "bucket").collect()
    keep = F.col(value).isNotNull()
    for i in range(hashes):
        keep = keep & place[i].isin([r["bucket"] for r in heavy if r["hash"] == i] or [-1])
    return df.where(keep)


def frequent_ids(df: DataFrame, value: str, ident: str, share: float, **how) -> DataFrame:
    """(value, n, total): values held by at least ``share`` of all distinct ``ident``; a repeated id counts once.

    Empty input gives an empty result; ties at the threshold are all kept.
    """
    df = df.select(value, ident).where(F.col(value).isNotNull() & F.col(ident).isNotNull())
    total = df.select(ident).distinct().count()
    kept = iceberg(df, value, F.lit(1).cast("long"), share * total, **how)
    return kept.groupBy(value).agg(F.countDistinct(ident).alias("n")).where(F.col("n") >= F.lit(share * total)).withColumn("total", F.lit(total).cast("long"))


def frequent_weights(df: DataFrame, value: str, weight: str, share: float, **how) -> DataFrame:
    """(value, n, total): values with at least ``share`` of the sum of ``weight``; null weights count as 0."""
    df = df.select(value, F.coalesce(F.col(weight).cast("long"), F.lit(0)).alias("w")).where(F.col(value).isNotNull())
    total = df.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("t")).first()["t"]
    kept = iceberg(df, value, F.col("w"), share * total, **how)
    return kept.groupBy(value).agg(F.sum("w").alias("n")).where(F.col("n") >= F.lit(share * total)).withColumn("total", F.lit(total).cast("long"))


def counted_kmers(batches: DataFrame) -> DataFrame:
    """(item, w): every 5-mer of every batch with its count. Repeated batch_ids count once; null arrays and null counts give nothing."""
    once = batches.where("batch_id is not null and kmer is not null").groupBy("batch_id").agg(F.max("kmer").alias("kmer"))
    once = staged(once, "batches")  # read by the total, the buckets and the counts
    # index i in base 4, first base most significant; digits A0 T1 C2 G3
    letters = F.translate(F.lpad(F.conv(F.col("i").cast("string"), 10, 4), 5, "0"), "0123", "ATCG")
    return once.select(F.posexplode("kmer").alias("i", "w")).where("w is not null").select(letters.alias("item"), "w")
