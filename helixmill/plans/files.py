"""Queries that write files and read them back: FASTQ of every kind, pairs, interleaved reads, adapter and barcode lists, ordered sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators.staging import shared_folder
from helixmill.plans import pipeline
from helixmill.plans.options import Options
from helixmill.plans.views import PAIRS, READS, pairs, reads
from helixmill.sources import fastq, lists

QUERIES, ORACLES = {}, {}
#: Small ranges, so that the test tables' files are cut too.
RANGE = "200000"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_RECORD = ("name", "seq", "strand", "qual")


def _placed(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions and order whenever they are computed."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "read_id").sortWithinPartitions(*[c for c in ("read_id", *df.columns) if c in df.columns])


def _written(df: DataFrame, compression: str = "none") -> str:
    """A folder of FASTQ files of the reads."""
    fastq.register(df.sparkSession)
    folder = shared_folder(df.sparkSession, "fastq")
    df.select(*_RECORD).write.format("fastq").mode("append").option("compression", compression).save(folder)
    return folder


def _read(spark: SparkSession, files: str) -> DataFrame:
    fastq.register(spark)
    return spark.read.format("fastq").option("rangeBytes", RANGE).load(files)


_ALL = f"WITH {READS} SELECT name, seq, strand, qual FROM reads"


@query(_ALL)
def fastq_plain(spark: SparkSession, d: str) -> DataFrame:
    """Plain FASTQ, written in parts and read in ranges of bytes."""
    return _read(spark, _written(reads(spark, d)) + "/part-*").select(*_RECORD)


@query(_ALL)
def fastq_bgzf(spark: SparkSession, d: str) -> DataFrame:
    """Block gzip, read in ranges of blocks."""
    return _read(spark, _written(reads(spark, d), "bgzf") + "/part-*").select(*_RECORD)


@query(_ALL)
def fastq_gzip(spark: SparkSession, d: str) -> DataFrame:
    """Ordinary gzip, a file a task."""
    folder = shared_folder(spark, "gzip")
    reads(spark, d).select(F.concat_ws("\n", *_RECORD)).write.option("compression", "gzip").text(folder)
    return _read(spark, folder + "/part-*").select(*_RECORD)


def _by_place(df: DataFrame) -> DataFrame:
    """Reads keyed by the name of their file's part and their place in it."""
    return fastq.ordinals(df).withColumn("at", F.concat_ws(":", F.regexp_extract("path", r"(part-\d+)", 1), "read_id"))


@query(f"WITH {PAIRS} SELECT name AS name1, seq1, qual1, name AS name2, seq2, qual2, true AS paired FROM pairs")
def paired_scan(spark: SparkSession, d: str) -> DataFrame:
    """Mates in two sets of files, joined by position."""
    p = _placed(pairs(spark, d))
    sides = [_by_place(_read(spark, _written(p.select("name", F.col(f"seq{m}").alias("seq"), F.lit("+").alias("strand"), F.col(f"qual{m}").alias("qual"))) + "/part-*")) for m in (1, 2)]
    return pipeline.pair_up(*sides, by="at").drop("at")


@query(f"WITH {PAIRS} SELECT name AS name1, seq1, qual1, name AS name2, seq2, qual2 FROM pairs")
def interleaved_scan(spark: SparkSession, d: str) -> DataFrame:
    """Mates in turn in one set of files."""
    mates = F.explode(F.array(*[F.struct("name", F.col(f"seq{m}").alias("seq"), F.lit("+").alias("strand"), F.col(f"qual{m}").alias("qual")) for m in (1, 2)]))
    folder = _written(_placed(pairs(spark, d)).select(mates.alias("m")).select("m.*"))
    return pipeline.deinterleave(fastq.ordinals(_read(spark, folder + "/part-*")), "path").select("name1", "seq1", "qual1", "name2", "seq2", "qual2")


@query("SELECT DISTINCT upper(seq) AS seq FROM known_adapters WHERE length(seq) >= 6")
def fasta_scan(spark: SparkSession, d: str) -> DataFrame:
    """An adapter list as FASTA, its sequences over two lines."""
    folder = shared_folder(spark, "fasta")
    known = spark.read.parquet(f"{d}/known_adapters.parquet").where("seq is not null")
    known.select(F.concat(F.lit(">"), F.coalesce("descr", F.lit("unnamed")), F.lit(" "), F.md5("seq"), F.lit("\n"), F.substring("seq", 1, 10), F.lit("\n"), F.expr("substring(seq, 11)"))).write.text(folder)
    return lists.fasta(spark, folder).select("seq")


@query("SELECT barcode FROM barcodes WHERE regexp_matches(barcode, '^[ACGT]+$')")
def barcode_scan(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark, "barcodes")
    spark.read.parquet(f"{d}/barcodes.parquet").where("barcode rlike '^[ACGT]+$'").select("barcode").write.text(folder)
    return spark.createDataFrame([(b,) for b in lists.barcodes(spark, folder)], "barcode string")


@query(
    f"""WITH {PAIRS}, m AS (SELECT read_id, 'out' || m AS route, m, name, CASE WHEN m = 1 THEN seq1 ELSE seq2 END AS seq FROM pairs, (VALUES (1), (2)) t(m))
SELECT route, row_number() OVER (PARTITION BY route ORDER BY read_id) - 1 AS place, name, seq FROM m"""
)
def ordered_sink(spark: SparkSession, d: str) -> DataFrame:
    """Both mates routed to files that keep the order of the reads."""
    o = Options(paired=True, adapter_trimming=False, poly_g=False, quality_filter=False, length_filter=False, out1="a", out2="b")
    r = pipeline.paired(pairs(spark, d), o)
    everything = r.judged.select(F.explode(F.array(*[F.struct(F.lit(f"out{m}").alias("route"), "read_id", F.lit(m).alias("mate"), F.col(f"name{m}").alias("name"), F.col(f"seq{m}").alias("seq"), F.lit("+").alias("strand"), F.col(f"qual{m}").alias("qual")) for m in (1, 2)])).alias("m")).select("m.*")
    folder = shared_folder(spark, "routes")
    out = None
    for route in lists.write_routes(everything, folder):
        part = fastq.ordinals(_read(spark, f"{folder}/{route}/part-*"))
        sizes = {x["path"]: x["n"] for x in part.groupBy("path").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a file
        before, offsets = 0, []
        for path in sorted(sizes):
            offsets.append((path, before))
            before += sizes[path]
        placed = part.join(F.broadcast(spark.createDataFrame(offsets, "path string, before long")), "path")  # one row a file
        one = placed.select(F.lit(route).alias("route"), (F.col("before") + F.col("read_id")).alias("place"), "name", "seq")
        out = one if out is None else out.unionByName(one)
    return out
