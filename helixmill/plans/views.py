"""Views the read queries start from, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions.expressions import reverse_complement

READS = """reads AS (SELECT read_id, input_file, coalesce(name, '@') AS name, coalesce(seq, '') AS seq, coalesce(strand, '+') AS strand,
 rpad(substr(coalesce(qual, ''), 1, length(coalesce(seq, ''))), CAST(length(coalesce(seq, '')) AS INTEGER), '!') AS qual FROM fastq_reads)"""


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivered read; null seq reads as empty, a short quality string is filled up with the lowest quality."""
    return whole(spark.read.parquet(f"{sf_dir}/fastq_reads.parquet"))


def whole(df: DataFrame) -> DataFrame:
    seq = F.coalesce("seq", F.lit(""))
    n = F.length(seq)
    qual = F.rpad(F.substring(F.coalesce("qual", F.lit("")), F.lit(1), n), n, F.lit("!"))
    return df.select("read_id", "input_file", F.coalesce("name", F.lit("@")).alias("name"), seq.alias("seq"), F.coalesce("strand", F.lit("+")).alias("strand"), qual.alias("qual"))


#: The adapters that the derived pairs read through.
ADAPTER1, ADAPTER2 = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA", "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT"

_RC = "reverse(translate(regexp_replace({}, '[^ACGTacgt]', 'N', 'g'), 'ACGTacgt', 'TGCATGCA'))"
_MUTATED = "CASE WHEN id % 4 = 1 AND length(s2) > 12 THEN substr(s2, 1, 10) || translate(substr(s2, 11, 1), 'ACGT', 'CATG') || substr(s2, 12) ELSE s2 END"
#: One pair per read: an insert with adapter behind it (id % 5 = 0), or two overlapping ends; some mates are unrelated (% 29) or carry an error of low quality (% 4 = 1).
PAIRS = f"""{READS},
p0 AS (SELECT DISTINCT read_id AS id, name, upper(seq) AS frag, qual FROM reads),
p1 AS (SELECT id, name, qual, CASE WHEN id % 5 = 0 THEN substr(frag, 1, CAST(40 + id % 30 AS INTEGER)) ELSE frag END AS ins, frag FROM p0),
p2 AS (SELECT id, name, qual, CASE WHEN id % 5 = 0 THEN substr(ins || '{ADAPTER1}', 1, length(frag)) ELSE substr(ins, 1, CAST(greatest(length(ins) - id % 30, 0) AS INTEGER)) END AS s1,
 CASE WHEN id % 29 = 0 THEN reverse(frag) WHEN id % 5 = 0 THEN substr({_RC.format("ins")} || '{ADAPTER2}', 1, length(frag)) ELSE {_RC.format("substr(ins, CAST(1 + id % 40 AS INTEGER))")} END AS s2 FROM p1),
pairs AS (SELECT id AS read_id, name, s1 AS seq1, substr(qual, 1, length(s1)) AS qual1, {_MUTATED} AS seq2,
 CASE WHEN id % 4 = 1 AND length(s2) > 12 THEN substr(repeat('I', CAST(length(s2) AS INTEGER)), 1, 10) || '#' || repeat('I', CAST(length(s2) - 11 AS INTEGER)) ELSE repeat('I', CAST(length(s2) AS INTEGER)) END AS qual2 FROM p2)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, name, seq1, qual1, seq2, qual2): pairs derived from the reads."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    r = reads(spark, sf_dir).select("read_id", "name", F.upper("seq").alias("frag"), "qual").repartition(n, "read_id").distinct()
    i = F.col("read_id")
    n = F.length("frag")
    sub = lambda c, a, b=None: F.substring(c, F.lit(a) if isinstance(a, int) else a.cast("int"), (b if b is not None else F.lit(1 << 20)).cast("int"))
    p1 = r.withColumn("ins", F.when(i % 5 == 0, sub(F.col("frag"), 1, 40 + i % 30)).otherwise(F.col("frag")))
    s1 = F.when(i % 5 == 0, sub(F.concat("ins", F.lit(ADAPTER1)), 1, n)).otherwise(sub(F.col("ins"), 1, F.greatest(F.length("ins") - i % 30, F.lit(0))))
    s2 = F.when(i % 29 == 0, F.reverse("frag")).when(i % 5 == 0, sub(F.concat(reverse_complement("ins"), F.lit(ADAPTER2)), 1, n)).otherwise(reverse_complement(sub(F.col("ins"), 1 + i % 40)))
    p2 = p1.select("read_id", "name", "qual", s1.alias("s1"), s2.alias("s2"))
    error = (i % 4 == 1) & (F.length("s2") > 12)
    changed = F.concat(sub(F.col("s2"), 1, F.lit(10)), F.translate(sub(F.col("s2"), 11, F.lit(1)), "ACGT", "CATG"), sub(F.col("s2"), 12))
    high = lambda k: F.repeat(F.lit("I"), k.cast("int"))
    quality = F.when(error, F.concat(F.lit("I" * 10 + "#"), high(F.length("s2") - 11))).otherwise(high(F.length("s2")))
    return p2.select("read_id", "name", F.col("s1").alias("seq1"), sub(F.col("qual"), 1, F.length("s1")).alias("qual1"), F.when(error, changed).otherwise(F.col("s2")).alias("seq2"), quality.alias("qual2"))
