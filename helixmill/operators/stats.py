"""Quality-control statistics: partial histograms in Arrow kernels, summed by Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.functions.expressions import count_of, low_quality_bases
from helixmill.functions.rolling import flat, window_starts

#: Base codes are the low three bits of the character; 5-mer digits are A0 T1 C2 G3.
LETTERS = np.array(["?", "A", "?", "C", "T", "?", "N", "G"])
_DIGIT = np.full(256, -1, np.int64)
for _i, _c in enumerate("ATCG"):
    _DIGIT[ord(_c)] = _i


def summary(df: DataFrame, *by: str) -> DataFrame:
    """Totals of reads with seq and qual: reads, bases, Q20 and Q30 bases and GC bases, mean length (integer division). One pass, all native."""
    n = F.length("seq")
    bases = F.coalesce(F.sum(n), F.lit(0))
    sums = [
        F.count(F.lit(1)).alias("total_reads"),
        bases.cast("long").alias("total_bases"),
        F.coalesce(F.sum(n - low_quality_bases("qual", 20)), F.lit(0)).cast("long").alias("q20_bases"),
        F.coalesce(F.sum(n - low_quality_bases("qual", 30)), F.lit(0)).cast("long").alias("q30_bases"),
        F.coalesce(F.sum(count_of("seq", "GCgc")), F.lit(0)).cast("long").alias("gc_bases"),
        F.floor(bases / F.greatest(F.count(F.lit(1)), F.lit(1))).cast("long").alias("mean_length"),
    ]
    return df.groupBy(*by).agg(*sums) if by else df.agg(*sums)


def rates(totals: DataFrame) -> DataFrame:
    """Q20, Q30 and GC rates of a summary, to six digits; 0 without bases."""
    rate = lambda c: F.round(F.when(F.col("total_bases") > 0, F.col(c) / F.col("total_bases")).otherwise(0.0), 6)
    return totals.select(rate("q20_bases").alias("q20_rate"), rate("q30_bases").alias("q30_rate"), rate("gc_bases").alias("gc_content"))


def per_cycle(df: DataFrame) -> DataFrame:
    """(cycle, base, n, qsum, q20, q30): bases and qualities at each cycle, from 1; lower case counts as its base. Partial sums per task."""

    def partial(batches):
        total = np.zeros((4, 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            (s, at), (q, _) = flat(batch.column(0)), flat(batch.column(1))
            cycle = np.arange(len(s)) - np.repeat(at[:-1], np.diff(at))
            cell = cycle * 8 + (s & 7)
            width = (int(np.diff(at).max(initial=0)) + 1) * 8
            if width > total.shape[1]:
                total = np.pad(total, ((0, 0), (0, width - total.shape[1])))
            value = q.astype(np.int64) - 33
            for row, weight in enumerate((None, value, value >= 20, value >= 30)):
                got = np.bincount(cell, weight, minlength=total.shape[1])
                total[row] += got.astype(np.int64)
        cell = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array((cell // 8 + 1).astype(np.int32)), pa.array(LETTERS[cell % 8])] + [pa.array(total[r][cell]) for r in range(4)], names=["cycle", "base", "n", "qsum", "q20", "q30"])

    parts = df.select("seq", "qual").mapInArrow(partial, "cycle int, base string, n long, qsum long, q20 long, q30 long")
    return parts.groupBy("cycle", "base").agg(*[F.sum(c).alias(c) for c in ("n", "qsum", "q20", "q30")])


def quality_curves(cycles: DataFrame) -> DataFrame:
    """(cycle, base, mean_quality) with base ``mean`` over all; a base absent at a cycle takes that mean."""
    per = cycles.groupBy("cycle").agg(F.sum("qsum").alias("qs"), F.sum("n").alias("ns"))
    bases = per.select("cycle", (F.col("qs") / F.col("ns")).alias("mean"), F.explode(F.array(*map(F.lit, ["A", "C", "G", "T", "mean"]))).alias("base"))
    own = cycles.select("cycle", "base", (F.col("qsum") / F.col("n")).alias("own"))
    return bases.join(own, ["cycle", "base"], "left").select("cycle", "base", F.round(F.coalesce("own", "mean"), 6).alias("mean_quality"))


def content_curves(cycles: DataFrame) -> DataFrame:
    """(cycle, base, share) for A, C, G, T, N and GC."""
    one = lambda *b: F.sum(F.when(F.col("base").isin(*b), F.col("n")).otherwise(0))
    per = cycles.groupBy("cycle").agg(F.sum("n").alias("all"), *[one(*b).alias("".join(b)) for b in ("A", "C", "G", "T", "N", ("G", "C"))])
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.round(F.col(b) / F.col("all"), 6).alias("share")) for b in ("A", "C", "G", "T", "N", "GC")]))
    return per.select("cycle", rows.alias("r")).select("cycle", "r.base", "r.share")


def quality_histogram(df: DataFrame) -> DataFrame:
    """(quality, n) over all bases."""

    def partial(batches):
        total = np.zeros(128, np.int64)
        for batch in batches:
            total += np.bincount(flat(batch.column(0))[0].clip(0, 127), minlength=128)
        q = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((q - 33).astype(np.int32)), pa.array(total[q])], names=["quality", "n"])

    return df.select("qual").mapInArrow(partial, "quality int, n long").groupBy("quality").agg(F.sum("n").alias("n"))


def kmer_codes(chars: np.ndarray, at: np.ndarray, k: int, first: int = 0, last: int = 0) -> np.ndarray:
    """2-bit codes of the windows of k characters that are all of ACGT, from ``first`` on and without the final ``last`` ones of each string."""
    owner, place = window_starts(at, k)
    if first or last:
        pos = place - at[:-1][owner]
        place = place[(pos >= first) & (pos <= (np.diff(at)[owner] - k - last))]
    digit = _DIGIT[np.minimum(chars, 255)]
    code, ok = np.zeros(len(place), np.int64), np.ones(len(place), bool)
    for i in range(k):
        d = digit[place + i]
        ok &= d >= 0
        code = code * 4 + d
    return code[ok]


def kmer_name(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ATCG")


def kmers(df: DataFrame, k: int = 5, column: str = "seq", first: int = 0, last: int = 0) -> DataFrame:
    """(code, kmer, n) of all k-mers of pure upper-case ACGT; k up to 12, so that a task's counts have a fixed size."""

    def partial(batches):
        total = np.zeros(4**k, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(kmer_codes(*flat(batch.column(0)), k, first, last), minlength=4**k)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["code", "n"])

    return df.select(column).mapInArrow(partial, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).withColumn("kmer", kmer_name(F.col("code"), k))


def duplication(df: DataFrame, *key: str) -> DataFrame:
    """(total, distinct_reads, rate): share of reads that equal an earlier one; anything but ATCG compares as N. Copies meet map-side."""
    same = F.regexp_replace(F.concat(*key), "[^ATCG]", "N")
    per = df.groupBy(F.xxhash64(same).alias("h"), F.md5(same).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct_reads")).withColumn("rate", F.round(F.when(F.col("total") > 0, 1 - F.col("distinct_reads") / F.col("total")).otherwise(0.0), 6))


def heads(df: DataFrame, key: list[str], ordinal: str = "read_id") -> DataFrame:
    """(ordinal): the smallest ordinal of each key, once; anything but ATCG compares as N. Copies of one key meet map-side."""
    same = F.md5(F.regexp_replace(F.concat(*key), "[^ATCG]", "N"))
    return df.groupBy(same.alias("_k")).agg(F.min(ordinal).alias(ordinal)).select(ordinal).distinct()


def first_of_each(df: DataFrame, key: list[str], ordinal: str = "read_id") -> DataFrame:
    """The rows whose key no row with a smaller ordinal has: exact duplicate removal, first one wins.

    An aggregate finds the first of each key and a join keeps it; no window, so copies of one key never gather in one task.
    """
    return df.join(heads(df, key, ordinal), ordinal, "left_semi")
