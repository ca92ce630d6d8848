"""Small text inputs: adapter FASTA and barcode lists. And sinks for routed reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.sources.fastq import FormatError


def fasta(spark: SparkSession, path: str, upper: bool = True, least: int = 6) -> DataFrame:
    """(header, seq) of a FASTA file: the header is the whole line after >, sequences may span lines and keep letters, - and *.

    The last of several entries under one header counts; sequences shorter than ``least`` are dropped and equal ones kept once.
    """
    parts = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    line = F.split(F.regexp_replace("value", "\r", ""), "\n", 2)
    seq = F.regexp_replace(F.coalesce(F.get(line, F.lit(1)), F.lit("")), "[^A-Za-z*-]", "")
    rows = parts.select(F.get(line, F.lit(0)).alias("header"), (F.upper(seq) if upper else seq).alias("seq"), F.monotonically_increasing_id().alias("at"))
    last = rows.groupBy("header").agg(F.max_by("seq", "at").alias("seq")).where(F.length("seq") >= least)
    return last.groupBy("seq").agg(F.min("header").alias("header")).select("header", "seq")


def barcodes(spark: SparkSession, path: str) -> list[str]:
    """The barcodes of a list, one per line, of A, T, C and G only. The list is the user's own and small."""
    got = [r["value"].strip() for r in spark.read.text(path).collect()]
    bad = [b for b in got if b.strip("ATCG")]
    if bad:
        raise FormatError(f"{path}: not a barcode: {bad[0]!r}")
    return [b for b in got if b]


def write_routes(routed: DataFrame, folder: str, compression: str = "none", level: int = 4, overwrite: bool = True) -> list[str]:
    """One folder of FASTQ files per route, in order of the reads. Returns the routes written. With ``overwrite`` false an existing folder is an error."""
    from helixmill.sources.fastq import on, register

    register(routed.sparkSession)
    names = sorted(r["route"] for r in routed.select("route").distinct().collect())  # a handful
    for route in names:
        target = f"{folder.rstrip('/')}/{route}"
        system, path = on(target)
        if not overwrite and system.get_file_info(path).type.name != "NotFound":
            raise FileExistsError(target)
        part = routed.where(F.col("route") == route).repartitionByRange("read_id").sortWithinPartitions("read_id", "mate")
        out = part.select("name", "seq", "strand", "qual").write.format("fastq").mode("overwrite" if overwrite else "append")
        out.option("compression", compression).option("level", str(level)).save(target)
    return names


def to_stream(routed: DataFrame, stream) -> int:
    """Writes the reads that passed to a binary stream, in order, mates in turn, merged ones where pairs were merged. One partition at a time is held. Returns how many."""
    n = 0
    out = routed.where("route in ('out1', 'out2', 'merged')").orderBy("read_id", "mate").select("name", "seq", "strand", "qual")
    for r in out.toLocalIterator(prefetchPartitions=False):
        stream.write(f"{r['name']}\n{r['seq']}\n{r['strand']}\n{r['qual']}\n".encode("latin-1", "replace"))
        n += 1
    stream.flush()
    return n


def from_stream(spark: SparkSession, stream) -> str:
    """Copies a binary stream of FASTQ (plain or gzip) into a file of the shared folder, so that it can be read in parts. Returns its path."""
    from helixmill.operators.staging import shared_folder
    from helixmill.sources.fastq import CHUNK, on

    system, folder = on(shared_folder(spark, "stream"))
    system.create_dir(folder, recursive=True)
    with system.open_output_stream(f"{folder}/stdin.fastq", compression=None) as f:
        while more := stream.read(CHUNK):
            f.write(more)
    return f"{folder}/stdin.fastq"


def interleaved(routed: DataFrame) -> DataFrame:
    """Both mates of the pairs that passed, in one stream."""
    return routed.where("route in ('out1', 'out2')").orderBy("read_id", "mate").select("name", "seq", "strand", "qual")


def split_folder(number: int, digits: int = 4) -> str:
    """Prefix of the file with this number."""
    return f"{number:0{digits}d}."
