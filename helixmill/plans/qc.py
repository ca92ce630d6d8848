"""Queries over reads: statistics, filters, transforms, trimming, splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions import expressions as E
from helixmill.functions.kernels import Reads, adapter_at, poly_g_end, poly_x_end, quality_cut
from helixmill.operators import cleaning, stats
from helixmill.plans.options import Options
from helixmill.plans.views import ADAPTER1, READS, reads

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_BASES = f"""WITH {READS}, b AS (SELECT read_id, i, CASE WHEN upper(substr(seq, i, 1)) IN ('A','C','G','T','N') THEN upper(substr(seq, i, 1)) ELSE '?' END AS base,
 ascii(substr(qual, i, 1)) - 33 AS q FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM reads)),
c AS (SELECT CAST(i AS INTEGER) AS cycle, base, count(*) AS n, CAST(sum(q) AS BIGINT) AS qsum, count(*) FILTER (q >= 20) AS q20, count(*) FILTER (q >= 30) AS q30 FROM b GROUP BY 1, 2)"""
_TOTALS = f"""{_BASES}, r AS (SELECT count(*) AS total_reads, CAST(sum(length(seq)) AS BIGINT) AS total_bases FROM reads),
t AS (SELECT total_reads, total_bases, (SELECT count(*) FROM b WHERE q >= 20) AS q20_bases, (SELECT count(*) FROM b WHERE q >= 30) AS q30_bases, (SELECT count(*) FROM b WHERE base IN ('G', 'C')) AS gc_bases FROM r)"""


@query(f"{_TOTALS} SELECT *, total_bases // total_reads AS mean_length FROM t")
def read_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.summary(reads(spark, d))


@query(f"WITH {READS} SELECT input_file, count(*) AS total_reads, CAST(sum(length(seq)) AS BIGINT) AS total_bases, count(*) FILTER (seq = '') AS empty_reads FROM reads GROUP BY input_file")
def file_summary(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).groupBy("input_file").agg(F.count(F.lit(1)).alias("total_reads"), F.sum(F.length("seq")).alias("total_bases"), F.count_if(F.col("seq") == "").alias("empty_reads"))


@query(f"WITH {READS} SELECT CAST(length(seq) AS INTEGER) AS seq_len, count(*) AS n FROM reads GROUP BY 1")
def length_hist(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).groupBy(F.length("seq").alias("seq_len")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_TOTALS} SELECT round(gc_bases / total_bases, 6) AS gc_content FROM t")
def gc_content(spark: SparkSession, d: str) -> DataFrame:
    return stats.rates(stats.summary(reads(spark, d))).select("gc_content")


@query(f"{_TOTALS} SELECT round(q20_bases / total_bases, 6) AS q20_rate, round(q30_bases / total_bases, 6) AS q30_rate FROM t")
def q20_q30_rates(spark: SparkSession, d: str) -> DataFrame:
    return stats.rates(stats.summary(reads(spark, d))).select("q20_rate", "q30_rate")


@query(f"{_BASES} SELECT cycle, base, n FROM c")
def cycle_base_content(spark: SparkSession, d: str) -> DataFrame:
    return stats.per_cycle(reads(spark, d)).select("cycle", "base", "n")


@query(f"{_BASES} SELECT * FROM c")
def cycle_quality(spark: SparkSession, d: str) -> DataFrame:
    return stats.per_cycle(reads(spark, d))


@query(
    f"""{_BASES}, m AS (SELECT cycle, sum(qsum) / sum(n) AS mean FROM c GROUP BY 1)
SELECT m.cycle, k.base, round(coalesce(c.qsum / c.n, mean), 6) AS mean_quality FROM m CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T'), ('mean')) k(base) LEFT JOIN c ON c.cycle = m.cycle AND c.base = k.base"""
)
def quality_curves(spark: SparkSession, d: str) -> DataFrame:
    return stats.quality_curves(stats.per_cycle(reads(spark, d)))


@query(
    f"""{_BASES}, m AS (SELECT cycle, sum(n) AS n FROM c GROUP BY 1)
SELECT m.cycle, k.base, round(coalesce((SELECT sum(c.n) FROM c WHERE c.cycle = m.cycle AND contains(k.base, c.base)), 0) / m.n, 6) AS share FROM m CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T'), ('N'), ('GC')) k(base)"""
)
def content_curves(spark: SparkSession, d: str) -> DataFrame:
    return stats.content_curves(stats.per_cycle(reads(spark, d)))


@query(f"{_BASES} SELECT CAST(q AS INTEGER) AS quality, count(*) AS n FROM b GROUP BY 1")
def quality_hist(spark: SparkSession, d: str) -> DataFrame:
    return stats.quality_histogram(reads(spark, d))


@query(
    f"""WITH {READS} SELECT kmer, count(*) AS n FROM (SELECT substr(seq, i, 5) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 3)) AS i FROM reads)) WHERE regexp_matches(kmer, '^[ACGT]{{5}}$') GROUP BY 1"""
)
def kmer5_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.kmers(reads(spark, d)).select("kmer", "n")


_LOW = "length(regexp_replace(qual, '[^!-/]', '', 'g'))"
_NS = "length(regexp_replace(seq, '[^N]', '', 'g'))"
_VERDICT = f"CASE WHEN length(seq) = 0 THEN 16 WHEN {_LOW} * 100 > 40 * length(seq) THEN 20 WHEN {_NS} > 5 THEN 12 WHEN length(seq) < 15 THEN 16 ELSE 0 END"


@query(f"WITH {READS} SELECT {_VERDICT} AS result, count(*) AS n FROM reads GROUP BY 1")
def filter_buckets(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).groupBy(E.verdict("seq", "qual").alias("result")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {READS} SELECT read_id, name, seq, strand, qual FROM reads WHERE {_VERDICT} = 0")
def pass_reads(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).where(E.verdict("seq", "qual") == E.PASS).select("read_id", "name", "seq", "strand", "qual")


@query(
    f"""{_BASES}, m AS (SELECT read_id, i, q FROM b), a AS (SELECT r.read_id, length(seq) AS n, list_sum(list_transform(range(1, length(qual) + 1), lambda i: ascii(substr(qual, i, 1)) - 33)) AS q FROM reads r)
SELECT read_id FROM a WHERE n > 0 AND q // n >= 25"""
)
def avg_qual_filter(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).where((F.length("seq") > 0) & (F.floor(E.quality_sum("qual") / F.length("seq")) >= 25)).select("read_id")


@query(f"WITH {READS} SELECT read_id, CAST({_NS} AS INTEGER) AS n_bases FROM reads WHERE {_NS} > 5")
def n_filter(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).select("read_id", E.count_of("seq", "N").alias("n_bases")).where("n_bases > 5")


@query(f"WITH {READS} SELECT read_id, CASE WHEN length(seq) < 60 THEN 16 WHEN length(seq) > 120 THEN 17 ELSE 0 END AS result FROM reads")
def length_filter(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).select("read_id", E.verdict("seq", "qual", quality_filter=False, shortest=60, longest=120).alias("result"))


@query(
    f"""WITH {READS} SELECT read_id FROM reads WHERE length(seq) <= 1 OR 100 * len(list_filter(range(1, length(seq)), lambda i: substr(seq, i, 1) <> substr(seq, i + 1, 1))) < 60 * (length(seq) - 1)"""
)
def low_complexity(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).where(~E.complex_enough("seq", 60)).select("read_id")


@query(
    f"""WITH {READS}, v AS (SELECT read_id, name, {_VERDICT} AS v FROM reads)
SELECT read_id, name || ' ' || CASE v WHEN 12 THEN 'failed_too_many_n_bases' WHEN 16 THEN 'failed_too_short' ELSE 'failed_quality_filter' END AS name FROM v WHERE v > 0"""
)
def failed_tags(spark: SparkSession, d: str) -> DataFrame:
    v = reads(spark, d).withColumn("v", E.verdict("seq", "qual")).where("v > 0")
    return v.select("read_id", F.concat_ws(" ", "name", E.tag("v")).alias("name"))


@query(f"WITH {READS} SELECT read_id, substr(seq, 4, length(seq) - 5) AS seq, substr(qual, 4, length(seq) - 5) AS qual FROM reads WHERE length(seq) >= 5")
def trim_global(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("seq")
    cut = lambda c: F.substring(F.col(c), F.lit(4), n - 5).alias(c)
    return reads(spark, d).where(n >= 5).select("read_id", cut("seq"), cut("qual"))


@query(f"WITH {READS} SELECT read_id, substr(seq, 1, 80) AS seq, substr(qual, 1, 80) AS qual FROM reads")
def max_len(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).select("read_id", F.substring("seq", 1, 80).alias("seq"), F.substring("qual", 1, 80).alias("qual"))


@query(f"WITH {READS} SELECT read_id, regexp_replace(name, '/([12])$', ' /\\1') AS name FROM reads")
def mgi_fix(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).select("read_id", E.mgi_fix("name").alias("name"))


def _tagged(umi: str, prefix: str = ":") -> str:
    return f"CASE WHEN length({umi}) > 0 THEN regexp_extract(name, '^([^ ]*)', 1) || '{prefix}' || {umi} || regexp_extract(name, '^[^ ]*(.*)$', 1) ELSE name END"


_FIRST = "CASE WHEN length(name) >= 5 THEN regexp_extract(name, ':([^:+]*)(\\+[^:]*)?$', 1) ELSE '' END"
_LAST = "CASE WHEN length(name) >= 5 THEN regexp_extract(name, '[:+]([^:+]*.{2})$', 1) ELSE '' END"


@query(
    f"""WITH {READS}, g AS (SELECT *, CAST(greatest(least(10, length(seq) - 1), 0) AS INTEGER) AS gone, substr(seq, 1, 8) AS umi FROM reads)
SELECT read_id, {_tagged("umi", ":UM_")} AS name, substr(seq, gone + 1) AS seq, substr(qual, gone + 1) AS qual FROM g"""
)
def umi_read1(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.move_umi(reads(spark, d), "read1", 8, 2, "UM").select("read_id", "name", "seq", "qual")


@query(f"WITH {READS}, g AS (SELECT *, {_FIRST} AS umi FROM reads) SELECT read_id, {_tagged('umi')} AS name, seq FROM g")
def umi_per_index(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.move_umi(reads(spark, d), "per_index").select("read_id", "name", "seq")


@query(f"WITH {READS} SELECT read_id, {_FIRST} AS first_index, {_LAST} AS last_index FROM reads")
def index_parse(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).select("read_id", E.first_index("name").alias("first_index"), E.last_index("name").alias("last_index"))


@query(f"WITH {READS} SELECT read_id, array_to_string(list_transform(range(1, length(qual) + 1), lambda i: chr(CAST(greatest(33, ascii(substr(qual, i, 1)) - 31) AS INTEGER))), '') AS qual FROM reads")
def phred64(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).select("read_id", E.phred64_to_33("qual").alias("qual"))


@query(f"WITH {READS} SELECT read_id, reverse(translate(regexp_replace(seq, '[^ACGTacgt]', 'N', 'g'), 'ACGTacgt', 'TGCATGCA')) AS seq, reverse(qual) AS qual FROM reads")
def reverse_complement(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).select("read_id", E.reverse_complement("seq").alias("seq"), F.reverse("qual").alias("qual"))


def _blacklist(spark: SparkSession, d: str) -> list[str]:
    bars = spark.read.parquet(f"{d}/barcodes.parquet").select(F.upper("barcode").alias("b")).where("b rlike '^[ACGT]+$'").distinct()
    return [r["b"] for r in bars.orderBy("b").collect()]  # a fixed list of the user's


@query(
    f"""WITH {READS}, l AS (SELECT DISTINCT upper(barcode) AS b FROM barcodes WHERE regexp_matches(upper(barcode), '^[ACGT]+$')), g AS (SELECT read_id, name, {_FIRST} AS x FROM reads)
SELECT read_id FROM g WHERE NOT EXISTS (SELECT 1 FROM l WHERE length(b) = length(x) AND hamming(b, CASE WHEN length(x) = length(b) THEN x ELSE b END) <= 1)"""
)
def index_blacklist(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.index_filter(reads(spark, d), "name", _blacklist(spark, d), 1).select("read_id")


@query(f"""WITH {READS}, k AS (SELECT regexp_replace(seq, '[^ATCG]', 'N', 'g') AS k FROM reads) SELECT count(*) AS total, count(DISTINCT k) AS distinct_reads, round(1 - count(DISTINCT k) / count(*), 6) AS rate FROM k""")
def dup_rate(spark: SparkSession, d: str) -> DataFrame:
    return stats.duplication(reads(spark, d), "seq")


@query(f"""WITH {READS}, k AS (SELECT min(read_id) AS read_id FROM reads GROUP BY regexp_replace(seq, '[^ATCG]', 'N', 'g')) SELECT DISTINCT read_id, seq FROM reads SEMI JOIN k USING (read_id)""")
def dedup_reads(spark: SparkSession, d: str) -> DataFrame:
    return stats.first_of_each(reads(spark, d).select("read_id", "seq").distinct(), ["seq"])


_CUT_SUM = "list_sum(list_transform(range(s + 1, s + 5), lambda j: ascii(substr(qual, CAST(j AS INTEGER), 1))))"
_FRONT = f"""WITH {READS}, w AS (SELECT read_id, seq, qual, length(seq) AS n, list_filter(range(0, length(seq) - 4), lambda s: {_CUT_SUM} >= 4 * 53)[1] AS hit FROM reads WHERE length(seq) > 4),
p AS (SELECT *, CASE WHEN coalesce(hit, n - 4) > 0 THEN coalesce(hit, n - 4) + 3 ELSE 0 END AS s FROM w),
f AS (SELECT *, s + length(regexp_extract(substr(seq, CAST(s + 1 AS INTEGER)), '^N*')) AS a FROM p)
SELECT read_id, substr(seq, CAST(a + 1 AS INTEGER)) AS seq, substr(qual, CAST(a + 1 AS INTEGER)) AS qual FROM f WHERE n - a > 0 AND a < n - 1"""
_RIGHT = f"""WITH {READS}, w AS (SELECT read_id, seq, qual, length(seq) AS n, list_filter(range(0, length(seq) - 4), lambda s: {_CUT_SUM} < 4 * 53)[1] AS hit FROM reads WHERE length(seq) > 4),
f AS (SELECT *, CASE WHEN hit IS NULL THEN n ELSE least(n - 1, hit + length(regexp_extract(substr(qual, CAST(hit + 1 AS INTEGER)), '^[5-~]*'))) END AS e FROM w)
SELECT read_id, substr(seq, 1, CAST(e AS INTEGER)) AS seq, substr(qual, 1, CAST(e AS INTEGER)) AS qual FROM f WHERE e > 0 AND n > 1"""
_TAIL = f"""WITH {READS}, w AS (SELECT read_id, seq, qual, length(seq) AS n, list_max(list_filter(range(1, length(seq) - 3), lambda s: {_CUT_SUM} >= 4 * 53)) AS hit FROM reads WHERE length(seq) > 4),
t AS (SELECT *, coalesce(hit + 3, 3) AS t FROM w), u AS (SELECT *, CASE WHEN t < n - 1 THEN t - 3 ELSE t END AS u FROM t),
f AS (SELECT *, u + 1 - length(regexp_extract(substr(seq, 1, CAST(u + 1 AS INTEGER)), 'N*$')) AS e FROM u)
SELECT read_id, substr(seq, 1, CAST(e AS INTEGER)) AS seq, substr(qual, 1, CAST(e AS INTEGER)) AS qual FROM f WHERE e > 0 AND n > 1"""


@query(_FRONT)
def cut_front(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.trimmed(reads(spark, d), lambda s, q: quality_cut(s, q, 0, 0, cut_front=(4, 20)))


@query(_TAIL)
def cut_tail(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.trimmed(reads(spark, d), lambda s, q: quality_cut(s, q, 0, 0, cut_tail=(4, 20)))


@query(_RIGHT)
def cut_right(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.trimmed(reads(spark, d), lambda s, q: quality_cut(s, q, 0, 0, cut_right=(4, 20)))


def _keep_to(end):
    return lambda s, q: (s.size >= 0, s.size * 0, end(s))


def _polyg_sql(source: str, name: str) -> str:
    """``source`` with its tails of G cut, as ``name``."""
    return f"""{name}_m AS (SELECT *, length(seq) AS n, list_filter(range(0, length(seq)), lambda i: length(regexp_replace(right(seq, i + 1), 'G', '', 'g')) > 5 OR (length(regexp_replace(right(seq, i + 1), 'G', '', 'g')) > (i + 1) // 8 AND i >= 9))[1] AS hit FROM {source}),
{name}_s AS (SELECT *, coalesce(hit, n) AS stop FROM {name}_m), {name}_e AS (SELECT *, CASE WHEN stop >= 10 AND n > 0 THEN CASE WHEN contains(right(seq, stop), 'G') THEN n - stop + instr(right(seq, stop), 'G') - 1 ELSE n - 1 END ELSE n END AS e FROM {name}_s),
{name} AS (SELECT * EXCLUDE (n, hit, stop, e) REPLACE (substr(seq, 1, e) AS seq, substr(qual, 1, e) AS qual) FROM {name}_e)"""


@query(f"WITH {READS}, {_polyg_sql('reads', 'cut')} SELECT read_id, seq, qual FROM cut")
def polyg_trim(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.trimmed(reads(spark, d), _keep_to(poly_g_end))


def _polyx_sql(source: str, name: str = "p") -> str:
    """CTEs up to ``name``_x: ``source`` with whether a tail of one base is cut, and what is kept."""
    return f"""{name}_r AS (SELECT row_number() OVER () AS k, * FROM {source}), {name}_t AS (SELECT k, seq, qual, length(seq) AS n, unnest(range(0, length(seq))) AS i FROM {name}_r AS r),
{name}_u AS (SELECT k, n, i, substr(seq, CAST(n - i AS INTEGER), 1) AS c FROM {name}_t AS t),
{name}_m AS (SELECT k, n, i, {", ".join(f"count(*) FILTER (c = '{b}' OR c = 'N') OVER w AS c{b}" for b in "ATCG")} FROM {name}_u AS u WINDOW w AS (PARTITION BY k ORDER BY i)),
{name}_h AS (SELECT k, min(i) FILTER (i + 1 - greatest(cA, cT, cC, cG) > least(5, (i + 1) // 8) AND (i >= 8 OR i + 1 >= 9)) AS hit FROM {name}_m AS m GROUP BY k),
{name}_s AS (SELECT m.k, m.n, i, CASE greatest(cA, cT, cC, cG) WHEN cA THEN 'A' WHEN cT THEN 'T' WHEN cC THEN 'C' ELSE 'G' END AS base FROM {name}_m AS m JOIN {name}_h AS h ON m.k = h.k AND m.i = least(coalesce(hit, m.n), m.n - 1)),
{name}_x AS (SELECT r.*, length(r.seq) AS n, base, coalesce(i + 1 >= 10 AND instr(right(r.seq, i + 1), base) > 0, false) AS cut, length(r.seq) - i - 2 + instr(right(r.seq, i + 1), base) AS kept FROM {name}_r AS r LEFT JOIN {name}_s AS s USING (k))"""


_POLYX = f"WITH {READS}, {_polyx_sql('reads')}"


@query(f"{_POLYX} SELECT read_id, substr(seq, 1, CASE WHEN cut THEN kept ELSE n END) AS seq, substr(qual, 1, CASE WHEN cut THEN kept ELSE n END) AS qual FROM p_x")
def polyx_trim(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.trimmed(reads(spark, d), _keep_to(lambda s: poly_x_end(s)[0]))


@query(f"{_POLYX} SELECT base AS poly_base, count(*) AS reads, CAST(sum(n - kept) AS BIGINT) AS bases FROM p_x WHERE cut GROUP BY 1")
def polyx_counts(spark: SparkSession, d: str) -> DataFrame:
    o = Options(poly_x=True, adapter_trimming=False, poly_g=False).resolved()
    cut = cleaning.clean_single(reads(spark, d), o).where("poly_base is not null")
    return cut.groupBy("poly_base").agg(F.count(F.lit(1)).alias("reads"), F.sum("poly_len").alias("bases"))


def _adapter_sql(adapter: str, name: str = "a", source: str = "reads") -> str:
    n = len(adapter)
    return f"""{name} AS (SELECT *, length(seq) AS n, list_filter(range(-4, length(seq) - 4), lambda p: len(list_filter(range(greatest(0, -p), least(length(seq) - p, {n})), lambda i: substr(seq, CAST(p + i + 1 AS INTEGER), 1) <> substr('{adapter}', CAST(i + 1 AS INTEGER), 1))) <= least(length(seq) - p, {n}) // 8)[1] AS hit_at FROM {source})"""


_RC = "reverse(translate(regexp_replace(seq, '[^ACGTacgt]', 'N', 'g'), 'ACGTacgt', 'TGCATGCA'))"
_FUNCTIONS = f"""{_RC} AS rc, CASE WHEN seq = '' THEN 0 ELSE CAST(hamming(seq, reverse(seq)) AS INTEGER) END AS apart, CASE WHEN n > 30 THEN CAST(n AS INTEGER) ELSE 0 END AS own_overlap, CAST(CASE WHEN read_id % 2 = 0 THEN 8 ELSE 2 END AS INTEGER) AS by_row"""
_TRIMMED = f"WITH {READS}, {_adapter_sql(ADAPTER1)}"


@query(f"{_TRIMMED} SELECT read_id, CASE WHEN hit_at IS NULL THEN seq ELSE substr(seq, 1, CAST(greatest(hit_at, 0) AS INTEGER)) END AS seq, CASE WHEN hit_at IS NULL THEN qual ELSE substr(qual, 1, CAST(greatest(hit_at, 0) AS INTEGER)) END AS qual FROM a")
def adapter_trim(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.trimmed(reads(spark, d), _keep_to(lambda s: adapter_at(s, ADAPTER1, gaps=False).clip(0)))


def _gapped_sql(adapter: str, reads: str = "a", t: str = "") -> str:
    """CTEs behind ``_adapter_sql`` up to ``trimmed``: where the adapter begins, straight or with one inserted or lost base."""
    n, cut = len(adapter), lambda x, b, e="": f"substr({x}, CAST({b} AS INTEGER){f', CAST({e} AS INTEGER)' if e else ''})"
    return f"""g0{t} AS (SELECT row_number() OVER () AS k, * FROM {reads}), g1{t} AS (SELECT k, seq, n, unnest(range(0, n)) AS p FROM g0{t} WHERE hit_at IS NULL),
g2{t} AS (SELECT k, 1 AS turn, p, least(n - p - 1, {n}) AS c, {n - 1} AS most, {cut("seq", "p + 1", f"least(n - p - 1, {n})")} AS x, {cut("seq", "p + 2", f"least(n - p - 1, {n})")} AS y, {cut(f"'{adapter}'", 1, f"least(n - p - 1, {n})")} AS u, {cut(f"'{adapter}'", 1, f"least(n - p - 1, {n})")} AS v FROM g1{t} WHERE p < n - 5
 UNION ALL SELECT k, 2, p, least(n - p, {n - 1}), {n - 2}, {cut("seq", "p + 1", f"least(n - p, {n - 1})")}, {cut("seq", "p + 1", f"least(n - p, {n - 1})")}, {cut(f"'{adapter}'", 1, f"least(n - p, {n - 1})")}, {cut(f"'{adapter}'", 2, f"least(n - p, {n - 1})")} FROM g1{t} WHERE p < n - 4),
g3{t} AS (SELECT *, c // 8 - 1 AS most_wrong FROM g2{t} WHERE c >= 8),
g4{t} AS (SELECT * FROM g3{t} WHERE hamming({cut("x", 1, "c // 2")}, {cut("u", 1, "c // 2")}) <= most_wrong OR hamming({cut("y", "c // 2 + 1")}, {cut("v", "c // 2 + 1")}) <= most_wrong),
g5{t} AS (SELECT k, turn, p FROM g4{t} WHERE list_min(list_transform(range(1, least(c, most) + 1), lambda i: hamming({cut("x", 1, "i")}, {cut("u", 1, "i")}) + CASE WHEN i < c THEN hamming({cut("y", "i + 1")}, {cut("v", "i + 1")}) ELSE 0 END)) <= most_wrong),
g6{t} AS (SELECT k, min(turn * 1000000 + p) AS best FROM g5{t} GROUP BY k), trimmed{t} AS (SELECT g0{t}.*, coalesce(hit_at, best % 1000000) AS cut_at FROM g0{t} LEFT JOIN g6{t} USING (k))"""


@query(f"{_TRIMMED}, {_gapped_sql(ADAPTER1)} SELECT read_id, CASE WHEN cut_at IS NULL THEN seq ELSE substr(seq, 1, CAST(greatest(cut_at, 0) AS INTEGER)) END AS seq, CASE WHEN cut_at IS NULL THEN qual ELSE substr(qual, 1, CAST(greatest(cut_at, 0) AS INTEGER)) END AS qual FROM trimmed")
def adapter_trim_gapped(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.trimmed(reads(spark, d), _keep_to(lambda s: adapter_at(s, ADAPTER1).clip(0)))


@query(f"{_TRIMMED} SELECT CASE WHEN hit_at < 0 THEN substr('{ADAPTER1}', 1, CAST({len(ADAPTER1)} + hit_at AS INTEGER)) ELSE substr(seq, CAST(hit_at + 1 AS INTEGER)) END AS adapter, count(*) AS n FROM a WHERE hit_at IS NOT NULL GROUP BY 1")
def adapter_counts(spark: SparkSession, d: str) -> DataFrame:
    o = Options(adapter1=ADAPTER1, gapped_adapters=False, poly_g=False).resolved()
    return cleaning.clean_single(reads(spark, d), o).where("adapter is not null").groupBy("adapter").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""{_TRIMMED}, p AS (SELECT CASE WHEN hit_at < 0 THEN substr('{ADAPTER1}', 1, CAST({len(ADAPTER1)} + hit_at AS INTEGER)) ELSE substr(seq, CAST(hit_at + 1 AS INTEGER)) END AS adapter FROM a WHERE hit_at IS NOT NULL)
SELECT adapter, count(*) AS n, len(list_filter(range(1, length(adapter)), lambda i: substr(adapter, CAST(i AS INTEGER), 1) <> substr(adapter, CAST(i + 1 AS INTEGER), 1))) < length(adapter) // 2 AS poor FROM p GROUP BY adapter"""
)
def adapter_complexity(spark: SparkSession, d: str) -> DataFrame:
    """The pieces that were cut, with whether they are of low complexity."""
    return adapter_counts(spark, d).withColumn("poor", E.poor_adapter("adapter"))


@query(f"{_TRIMMED} SELECT read_id FROM a WHERE greatest(hit_at, 0) <= 70 AND hit_at IS NOT NULL")
def adapter_dimer(spark: SparkSession, d: str) -> DataFrame:
    o = Options(adapter1=ADAPTER1, gapped_adapters=False, poly_g=False, dimer_max_len=70).resolved()
    return cleaning.clean_single(reads(spark, d), o).where(F.col("verdict") == E.ADAPTER_DIMER).select("read_id")


@query(f"{_TRIMMED}, {_gapped_sql(ADAPTER1)} SELECT read_id, CAST(coalesce(cut_at, n) AS INTEGER) AS place, CASE WHEN cut_at IS NULL THEN seq ELSE substr(seq, 1, CAST(greatest(cut_at, 0) AS INTEGER)) END AS trimmed, {_FUNCTIONS} FROM trimmed")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The functions registered for SQL, the adapter and the windows differing from row to row."""
    E.register(spark)
    reads(spark, d).createOrReplaceTempView("helixmill_reads")
    return spark.sql(
        f"""SELECT read_id, adapter_pos(seq, '{ADAPTER1}') AS place, trim_adapter(seq, '{ADAPTER1}') AS trimmed, revcomp(seq) AS rc, hamming(seq, reverse(seq)) AS apart,
overlap(revcomp(seq), seq).overlap_len AS own_overlap, adapter_pos('GGGGTTTTACGTACGT', CASE WHEN read_id % 2 = 0 THEN 'ACGTACGT' ELSE 'GGTTTTAC' END) AS by_row FROM helixmill_reads"""
    )


#: A short list of adapters, cut one after the other.
SHORT_LIST = (ADAPTER1, "GCGACTCTTCCCTAGTAGTGACC", "GGGTGGGACGCGGCCTAAGAACTTCAAC")


def _list_sql() -> str:
    cut = lambda c: f"CASE WHEN cut_at IS NULL THEN {c} ELSE substr({c}, 1, CAST(greatest(cut_at, 0) AS INTEGER)) END AS {c}"
    parts, source = [READS], "reads"
    for n, adapter in enumerate(SHORT_LIST):
        parts += [_adapter_sql(adapter, f"a_{n}", source), _gapped_sql(adapter, f"a_{n}", f"_{n}"), f"cut_{n} AS (SELECT read_id, {cut('seq')}, {cut('qual')} FROM trimmed_{n})"]
        source = f"cut_{n}"
    return f"WITH {', '.join(parts)} SELECT read_id, seq, qual FROM {source}"


@query(_list_sql())
def adapter_short_list(spark: SparkSession, d: str) -> DataFrame:
    o = Options(adapter1="", adapter_list=SHORT_LIST, poly_g=False).resolved()
    return cleaning.clean_single(reads(spark, d), o).select("read_id", "seq", "qual")


@query()
def adapter_list_trim(spark: SparkSession, d: str) -> DataFrame:
    known = spark.read.parquet(f"{d}/known_adapters.parquet").select(F.upper("seq").alias("s")).where("s rlike '^[ACGT]{6,}$'").distinct()
    adapters = tuple(r["s"] for r in known.orderBy("s").collect())  # a fixed list of the user's
    o = Options(adapter_list=adapters, poly_g=False).resolved()
    return cleaning.clean_single(reads(spark, d), o).select("read_id", "seq", "qual", "adapter")


@query(f"WITH {READS}, o AS (SELECT DISTINCT read_id, name, seq FROM reads) SELECT read_id, CAST(ntile(4) OVER (ORDER BY read_id) AS INTEGER) AS file_no FROM o")
def split_by_number(spark: SparkSession, d: str) -> DataFrame:
    from helixmill.operators.ordered import ranked

    r = ranked(reads(spark, d).select("read_id", "name", "seq").distinct(), ["read_id"])
    n = r.count()
    small, big = n // 4, n % 4  # the first files get one more where it doesn't come out even
    edge = big * (small + 1)
    k = F.when(F.col("rank") < edge, F.floor(F.col("rank") / max(1, small + 1))).otherwise(big + F.floor((F.col("rank") - edge) / max(1, small)))
    return r.select("read_id", (k + 1).cast("int").alias("file_no"))


@query(f"WITH {READS}, o AS (SELECT DISTINCT read_id, seq, qual FROM reads) SELECT read_id, CAST((row_number() OVER (ORDER BY read_id) - 1) // 250 AS BIGINT) AS file_no FROM o WHERE {_VERDICT} = 0")
def split_by_size(spark: SparkSession, d: str) -> DataFrame:
    from helixmill.operators.ordered import ranked

    passed = reads(spark, d).select("read_id", "seq", "qual").distinct().where(E.verdict("seq", "qual") == E.PASS)
    return ranked(passed.select("read_id"), ["read_id"]).select("read_id", F.floor(F.col("rank") / 250).alias("file_no"))


@query(f"WITH {READS} SELECT read_id, seq FROM reads WHERE read_id < 1000")
def reads_to_process(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).where("read_id < 1000").select("read_id", "seq")


@query("SELECT doc_id, CASE WHEN length(coalesce(text, '')) < 200 THEN 16 WHEN length(text) > 2000 THEN 17 ELSE 0 END AS result FROM documents")
def doc_length_filter(spark: SparkSession, d: str) -> DataFrame:
    n = F.length(F.coalesce("text", F.lit("")))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.when(n < 200, E.LENGTH).when(n > 2000, E.TOO_LONG).otherwise(E.PASS).alias("result"))


@query("SELECT count(*) AS total, count(DISTINCT coalesce(text, '')) AS distinct_docs FROM documents")
def doc_dup_rate(spark: SparkSession, d: str) -> DataFrame:
    text = F.md5(F.coalesce("text", F.lit("")))
    per = spark.read.parquet(f"{d}/documents.parquet").groupBy(text.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_docs"))


@query("SELECT gram, count(*) AS n FROM (SELECT substr(text, i, 5) AS gram FROM (SELECT text, unnest(range(1, length(text) - 3)) AS i FROM documents WHERE text IS NOT NULL)) WHERE regexp_matches(gram, '^[a-z]{5}$') GROUP BY 1 HAVING count(*) >= 20")
def doc_ngrams(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").where("length(text) >= 5")
    grams = docs.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 4), lambda i: F.substring(F.col("text"), i, F.lit(5)))).alias("gram"))
    return grams.where("gram rlike '^[a-z]{5}$'").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")


def _full_se() -> str:
    cut = lambda c: f"CASE WHEN cut_at IS NULL THEN {c} ELSE substr({c}, 1, CAST(greatest(cut_at, 0) AS INTEGER)) END AS {c}"
    inner = lambda c: f"CASE WHEN length(seq) >= 2 THEN substr({c}, 2, length(seq) - 2) ELSE '' END AS {c}"
    kept = lambda c: f"substr({c}, 1, CASE WHEN cut THEN kept ELSE n END) AS {c}"
    tags = " ".join(f"WHEN {k} THEN '{t}'" for k, t in E.TAGS.items())
    return f"""WITH {READS}, heads AS (SELECT DISTINCT min(read_id) AS read_id FROM reads GROUP BY regexp_replace(seq, '[^ATCG]', 'N', 'g')),
f0 AS (SELECT reads.read_id, name, strand, {inner("seq")}, {inner("qual")}, length(seq) >= 2 AS there, heads.read_id IS NULL AS dup FROM reads LEFT JOIN heads ON reads.read_id = heads.read_id),
{_polyg_sql("f0", "f1")}, {_adapter_sql(ADAPTER1, "a_f", "f1")}, {_gapped_sql(ADAPTER1, "a_f", "_f")},
f2 AS (SELECT read_id, name, strand, {cut("seq")}, {cut("qual")}, there, dup, there AND cut_at <= 2 AS dimer FROM trimmed_f), {_polyx_sql("f2", "q")},
f3 AS (SELECT read_id, name, strand, {kept("seq")}, {kept("qual")}, there, dup, coalesce(dimer, false) AS dimer FROM q_x), f4 AS (SELECT *, length(seq) AS n FROM f3),
v AS (SELECT *, CASE WHEN dimer THEN 28 WHEN NOT there OR n = 0 THEN 16 WHEN length(regexp_replace(qual, '[^!-/]', '', 'g')) * 100 > 40 * n THEN 20 WHEN length(regexp_replace(seq, '[^N]', '', 'g')) > 5 THEN 12 WHEN n < 15 THEN 16
 WHEN len(list_filter(range(1, n), lambda i: substr(seq, CAST(i AS INTEGER), 1) <> substr(seq, CAST(i + 1 AS INTEGER), 1))) * 100 < 30 * (n - 1) THEN 24 ELSE 0 END AS verdict FROM f4)
SELECT CASE verdict WHEN 0 THEN 'out1' ELSE 'failed' END AS route, read_id, CAST(1 AS INTEGER) AS mate, CASE verdict WHEN 0 THEN name ELSE name || ' ' || CASE verdict {tags} END END AS name, seq, strand, qual FROM v WHERE verdict <> 0 OR NOT dup"""


@query(_full_se())
def full_se_pipeline(spark: SparkSession, d: str) -> DataFrame:
    from helixmill.plans.pipeline import single

    o = Options(adapter1=ADAPTER1, poly_g=True, poly_x=True, front1=1, tail1=1, complexity_filter=True, dedup=True)
    return single(reads(spark, d), o).routed
