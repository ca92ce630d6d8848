"""Queries over pairs of reads: overlap, insert size, correction, merging, routing."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions import expressions as E
from helixmill.operators import cleaning, stats
from helixmill.plans import pipeline
from helixmill.plans.options import Options
from helixmill.plans.views import PAIRS, pairs

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Overlap alone: nothing is trimmed or corrected.
BARE = Options(paired=True, adapter_trimming=False, poly_g=False).resolved()

_RC2 = "reverse(translate(regexp_replace(seq2, '[^ACGTacgt]', 'N', 'g'), 'ACGTacgt', 'TGCATGCA'))"
_COMPLEMENT = "CASE WHEN contains('ACGT', {0}) THEN translate({0}, 'ACGT', 'TGCA') ELSE 'N' END"


def _overlaps(of: str, to: str, limit: int = 5) -> str:
    """SQL of the first overlap of each pair of the table ``of``, as the table ``to``."""
    return f"""{to}_rc AS (SELECT *, {_RC2} AS m2, length(seq1) AS l1, length(seq2) AS l2 FROM {of}),
{to}_o AS (SELECT read_id, k AS rank, k AS off FROM (SELECT read_id, unnest(range(0, l1 - 30)) AS k FROM {to}_rc) UNION ALL SELECT read_id, 1000000 + k, -k FROM (SELECT read_id, unnest(range(0, l2 - 30)) AS k FROM {to}_rc)),
{to}_c AS (SELECT read_id, rank, off, CASE WHEN rank < 1000000 THEN least(l1 - off, l2) ELSE least(l1, l2 + off) END AS ol, seq1, m2 FROM {to}_o JOIN {to}_rc USING (read_id)),
{to}_h AS (SELECT *, substr(seq1, CAST(greatest(off, 0) + 1 AS INTEGER), CAST(ol AS INTEGER)) AS a, substr(m2, CAST(greatest(-off, 0) + 1 AS INTEGER), CAST(ol AS INTEGER)) AS b FROM {to}_c),
{to}_g AS (SELECT read_id, rank, off, ol, hamming(a, b) AS diff FROM {to}_h WHERE hamming(substr(a, 1, 50), substr(b, 1, 50)) <= {limit}),
{to}_f AS (SELECT read_id, arg_min(off, rank) AS off, arg_min(ol, rank) AS ol, arg_min(diff, rank) AS diff FROM {to}_g GROUP BY read_id),
{to} AS (SELECT {to}_rc.*, {to}_f.read_id IS NOT NULL AS overlapped, coalesce(off, 0) AS off, coalesce(ol, 0) AS ol, coalesce(diff, 0) AS diff FROM {to}_rc LEFT JOIN {to}_f USING (read_id))"""


_CANDIDATES = f"""WITH {PAIRS}, rc AS (SELECT *, {_RC2} AS m2, length(seq1) AS l1, length(seq2) AS l2 FROM pairs),
o AS (SELECT read_id, k AS rank, k AS off FROM (SELECT read_id, unnest(range(0, l1 - 30)) AS k FROM rc) UNION ALL SELECT read_id, 1000000 + k, -k FROM (SELECT read_id, unnest(range(0, l2 - 30)) AS k FROM rc)),
c AS (SELECT o.read_id, rank, off, CASE WHEN off >= 0 AND rank < 1000000 THEN least(l1 - off, l2) ELSE least(l1, l2 + off) END AS ol, seq1, m2 FROM o JOIN rc USING (read_id)),
h AS (SELECT *, substr(seq1, CAST(greatest(off, 0) + 1 AS INTEGER), CAST(ol AS INTEGER)) AS a, substr(m2, CAST(greatest(-off, 0) + 1 AS INTEGER), CAST(ol AS INTEGER)) AS b FROM c),
g AS (SELECT read_id, rank, off, ol, hamming(a, b) AS diff FROM h WHERE hamming(substr(a, 1, 50), substr(b, 1, 50)) <= 5),
f AS (SELECT read_id, arg_min(off, rank) AS off, arg_min(ol, rank) AS ol, arg_min(diff, rank) AS diff FROM g GROUP BY read_id),
r AS (SELECT rc.*, f.read_id IS NOT NULL AS overlapped, coalesce(off, 0) AS off, coalesce(ol, 0) AS ol, coalesce(diff, 0) AS diff FROM rc LEFT JOIN f USING (read_id)),
q AS (SELECT *, CASE WHEN l1 >= 0 AND overlapped THEN least(512, CASE WHEN off > 0 THEN l1 + l2 - ol ELSE ol END) ELSE 512 END AS isize FROM r)"""


def _bare(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.clean_pairs(pairs(spark, d).withColumn("name1", F.col("name")).withColumn("name2", F.col("name")), BARE)


@query(f"{_CANDIDATES} SELECT read_id, overlapped, CAST(off AS INTEGER) AS offset_, CAST(ol AS INTEGER) AS overlap_len, CAST(diff AS INTEGER) AS diff FROM q")
def overlap(spark: SparkSession, d: str) -> DataFrame:
    return _bare(spark, d).select("read_id", "overlapped", F.col("offset").alias("offset_"), "overlap_len", "diff")


_LOST = f"""{PAIRS}, lost AS (SELECT * REPLACE (CASE WHEN read_id % 7 = 0 THEN substr(seq2, 1, 49) || substr(seq2, 51) ELSE seq2 END AS seq2) FROM pairs)"""


@query(
    f"""WITH {_LOST}, {_overlaps("lost", "s", 2)}, c AS (SELECT *, ol - 1 AS n FROM s_h SEMI JOIN (SELECT read_id FROM s WHERE NOT overlapped) USING (read_id) WHERE ol > 2),
e AS (SELECT read_id, rank, off, ol, n, substr(m2, CAST(greatest(-off, 0) + 1 AS INTEGER)) AS b, substr(seq1, CAST(greatest(off, 0) + 1 AS INTEGER)) AS a FROM c WHERE hamming(substr(a, 1, CAST(n - 1 AS INTEGER)), substr(b, 1, CAST(n - 1 AS INTEGER))) <= 2),
w AS (SELECT read_id, rank, off, ol, n, turn, CASE WHEN turn = 1 THEN a ELSE b END AS ins, CASE WHEN turn = 1 THEN b ELSE a END AS norm FROM e, (VALUES (1), (2)) t(turn)),
x AS (SELECT *, hamming(substr(ins, 1, CAST(n - 1 AS INTEGER)), substr(norm, 1, CAST(n - 1 AS INTEGER))) + (substr(ins, CAST(n + 1 AS INTEGER), 1) <> substr(norm, CAST(n AS INTEGER), 1))::INTEGER AS spent,
 list_min(list_transform(range(1, n), lambda k: hamming(substr(ins, 1, CAST(k AS INTEGER)), substr(norm, 1, CAST(k AS INTEGER))) + len(list_filter(range(k, n), lambda j: substr(ins, CAST(j + 2 AS INTEGER), 1) <> substr(norm, CAST(j + 1 AS INTEGER), 1))))) AS total FROM w),
y AS (SELECT * FROM x WHERE total <= 2 AND spent <= 2),
f AS (SELECT read_id, arg_min(off, rank * 2 + turn) AS off, arg_min(ol, rank * 2 + turn) AS ol, arg_min(total, rank * 2 + turn) AS diff FROM y GROUP BY read_id)
SELECT s.read_id, s.overlapped OR f.read_id IS NOT NULL AS overlapped, CAST(coalesce(f.off, s.off) AS INTEGER) AS offset_, CAST(coalesce(f.ol, s.ol) AS INTEGER) AS overlap_len, CAST(coalesce(f.diff, s.diff) AS INTEGER) AS diff, f.read_id IS NOT NULL AS has_gap FROM s LEFT JOIN f USING (read_id)"""
)
def overlap_one_gap(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps where one base may be inserted in a mate; every seventh pair loses a base first."""
    lost = pairs(spark, d).withColumn("seq2", F.when(F.col("read_id") % 7 == 0, F.expr("concat(substring(seq2, 1, 49), substring(seq2, 51))")).otherwise(F.col("seq2")))
    lost = lost.withColumn("qual2", F.expr("substring(qual2, 1, length(seq2))")).withColumn("name1", F.col("name")).withColumn("name2", F.col("name"))
    got = cleaning.clean_pairs(lost, replace(BARE, allow_gap_overlap=True, overlap_diff=2))
    return got.select("read_id", "overlapped", F.col("offset").alias("offset_"), "overlap_len", "diff", "has_gap")


@query(
    f"""WITH {PAIRS}, r AS (SELECT read_id, name, seq1, qual1, {_RC2} AS m2, reverse(qual2) AS r2, length(seq1) AS l1, length(seq2) AS l2 FROM pairs),
o AS (SELECT *, unnest(range(30, least(l1, l2) + 1)) AS ol FROM r),
h AS (SELECT *, substr(seq1, CAST(l1 - ol + 1 AS INTEGER)) AS a, substr(m2, 1, CAST(ol AS INTEGER)) AS b, substr(qual1, CAST(l1 - ol + 1 AS INTEGER)) AS u FROM o WHERE hamming(substr(seq1, CAST(l1 - ol + 1 AS INTEGER)), substr(m2, 1, CAST(ol AS INTEGER))) <= 2),
g AS (SELECT *, hamming(a, b) AS wrong, len(list_filter(range(1, ol + 1), lambda i: substr(a, CAST(i AS INTEGER), 1) <> substr(b, CAST(i AS INTEGER), 1) AND ((ascii(substr(u, CAST(i AS INTEGER), 1)) >= 63 AND ascii(substr(r2, CAST(i AS INTEGER), 1)) <= 48) OR (ascii(substr(u, CAST(i AS INTEGER), 1)) <= 48 AND ascii(substr(r2, CAST(i AS INTEGER), 1)) >= 63)))) AS low FROM h),
f AS (SELECT * FROM g WHERE wrong = low QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY ol) = 1)
SELECT read_id, name || ' merged offset:' || (l1 - ol) || ' overlap:' || ol AS name,
 substr(seq1, 1, CAST(l1 - ol AS INTEGER)) || array_to_string(list_transform(range(1, ol + 1), lambda i: CASE WHEN substr(a, CAST(i AS INTEGER), 1) <> substr(b, CAST(i AS INTEGER), 1) AND ascii(substr(u, CAST(i AS INTEGER), 1)) >= 63 THEN substr(a, CAST(i AS INTEGER), 1) ELSE substr(b, CAST(i AS INTEGER), 1) END), '') || substr(m2, CAST(ol + 1 AS INTEGER)) AS seq,
 substr(qual1, 1, CAST(l1 - ol AS INTEGER)) || array_to_string(list_transform(range(1, ol + 1), lambda i: CASE WHEN substr(a, CAST(i AS INTEGER), 1) = substr(b, CAST(i AS INTEGER), 1) THEN chr(CAST(ascii(substr(u, CAST(i AS INTEGER), 1)) + ascii(substr(r2, CAST(i AS INTEGER), 1)) - 33 AS INTEGER))
  WHEN ascii(substr(u, CAST(i AS INTEGER), 1)) >= 63 THEN substr(u, CAST(i AS INTEGER), 1) ELSE substr(r2, CAST(i AS INTEGER), 1) END), '') || substr(r2, CAST(ol + 1 AS INTEGER)) AS qual FROM f"""
)
def merge_simple(spark: SparkSession, d: str) -> DataFrame:
    """The simple merge of pairs whose ends overlap."""
    from helixmill.operators.cleaning import merge_ends

    return merge_ends(pairs(spark, d))


@query(f"{_CANDIDATES} SELECT CAST(isize AS INTEGER) AS insert_size, count(*) AS n FROM q GROUP BY 1")
def insert_size_hist(spark: SparkSession, d: str) -> DataFrame:
    return _bare(spark, d).where("insert_size >= 0").groupBy("insert_size").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_CANDIDATES}, z AS (SELECT isize, count(*) AS n FROM q WHERE isize < 512 GROUP BY 1) SELECT CAST(isize AS INTEGER) AS peak, n FROM z ORDER BY n DESC, isize LIMIT 1")
def insert_peak(spark: SparkSession, d: str) -> DataFrame:
    hist = insert_size_hist(spark, d).where("insert_size < 512")
    return hist.orderBy(F.desc("n"), "insert_size").limit(1).select(F.col("insert_size").alias("peak"), "n")


@query(
    f"""{_CANDIDATES} SELECT read_id, CASE WHEN overlapped AND off < 0 THEN substr(seq1, 1, CAST(least(l1, ol) AS INTEGER)) ELSE seq1 END AS seq1,
CASE WHEN overlapped AND off < 0 THEN substr(seq2, 1, CAST(least(l2, ol) AS INTEGER)) ELSE seq2 END AS seq2 FROM q"""
)
def adapter_by_overlap(spark: SparkSession, d: str) -> DataFrame:
    named = pairs(spark, d).withColumn("name1", F.col("name")).withColumn("name2", F.col("name"))
    return cleaning.clean_pairs(named, replace(BARE, adapter_trimming=True, adapter1="", adapter2="")).select("read_id", "seq1", "seq2")


@query(
    f"""{_CANDIDATES}, k AS (SELECT read_id, unnest(range(0, ol)) AS k, off, l2, seq1, qual1, seq2, qual2 FROM q WHERE overlapped AND diff > 0),
p AS (SELECT read_id, CAST(k + greatest(off, 0) + 1 AS INTEGER) AS i, CAST(l2 - k - greatest(-off, 0) AS INTEGER) AS j, * EXCLUDE (read_id) FROM k),
b AS (SELECT read_id, substr(seq1, i, 1) AS x, CASE WHEN contains('ACGT', substr(seq2, j, 1)) THEN translate(substr(seq2, j, 1), 'ACGT', 'TGCA') ELSE 'N' END AS y, ascii(substr(qual1, i, 1)) - 33 AS u, ascii(substr(qual2, j, 1)) - 33 AS v FROM p)
SELECT read_id, count(*) FILTER (v >= 30 AND u <= 14) AS corrected1, count(*) FILTER (u >= 30 AND v <= 14) AS corrected2 FROM b WHERE x <> y GROUP BY 1 HAVING count(*) FILTER ((v >= 30 AND u <= 14) OR (u >= 30 AND v <= 14)) > 0"""
)
def base_correction(spark: SparkSession, d: str) -> DataFrame:
    named = pairs(spark, d).withColumn("name1", F.col("name")).withColumn("name2", F.col("name"))
    got = cleaning.clean_pairs(named, replace(BARE, correction=True))
    return got.where("corrected1 + corrected2 > 0").select("read_id", F.col("corrected1").cast("long").alias("corrected1"), F.col("corrected2").cast("long").alias("corrected2"))


@query(
    f"""{_CANDIDATES}, k AS (SELECT unnest(range(0, ol)) AS k, off, l2, seq1, qual1, seq2, qual2 FROM q WHERE overlapped AND diff > 0),
p AS (SELECT CAST(k + greatest(off, 0) + 1 AS INTEGER) AS i, CAST(l2 - k - greatest(-off, 0) AS INTEGER) AS j, * FROM k),
b AS (SELECT substr(seq1, i, 1) AS x, substr(seq2, j, 1) AS z, {_COMPLEMENT.format("substr(seq1, i, 1)")} AS cx, {_COMPLEMENT.format("substr(seq2, j, 1)")} AS cz, ascii(substr(qual1, i, 1)) - 33 AS u, ascii(substr(qual2, j, 1)) - 33 AS v FROM p),
m AS (SELECT x AS old_base, cz AS new_base FROM b WHERE x <> cz AND v >= 30 AND u <= 14 UNION ALL SELECT z, cx FROM b WHERE x <> cz AND u >= 30 AND v <= 14)
SELECT old_base, new_base, count(*) AS n FROM m GROUP BY 1, 2"""
)
def correction_matrix(spark: SparkSession, d: str) -> DataFrame:
    """How often each base was corrected into each."""
    named = pairs(spark, d).withColumn("name1", F.col("name")).withColumn("name2", F.col("name"))
    return cleaning.correction_matrix(cleaning.clean_pairs(named, replace(BARE, correction=True)))


def _fixed(m: int) -> str:
    """SQL of mate m's bases and qualities after correction."""
    k = "(i - 1 - greatest(off, 0))" if m == 1 else "(l2 - i - greatest(-off, 0))"
    other = f"CAST(l2 - {k} - greatest(-off, 0) AS INTEGER)" if m == 1 else f"CAST({k} + greatest(off, 0) + 1 AS INTEGER)"
    own, theirs, quality, sure = f"substr(seq{m}, CAST(i AS INTEGER), 1)", f"substr(seq{3 - m}, {other}, 1)", f"substr(qual{m}, CAST(i AS INTEGER), 1)", f"substr(qual{3 - m}, {other}, 1)"
    base = _COMPLEMENT.format(theirs)
    # mates differ where mate 1 isn't the complement of mate 2
    differ = f"{own} <> {base}" if m == 1 else f"{theirs} <> {_COMPLEMENT.format(own)}"
    when = f"overlapped AND diff > 0 AND {k} >= 0 AND {k} < ol AND {differ} AND ascii({sure}) >= 63 AND ascii({quality}) <= 47"
    join = lambda new, old: f"array_to_string(list_transform(range(1, l{m} + 1), lambda i: CASE WHEN {when} THEN {new} ELSE {old} END), '')"
    return f"{join(base, own)} AS seq{m}, {join(sure, quality)} AS qual{m}"


_PASSES = lambda s, q: f"CASE WHEN length({s}) = 0 THEN 16 WHEN length(regexp_replace({q}, '[^!-/]', '', 'g')) * 100 > 40 * length({s}) THEN 20 WHEN length(regexp_replace({s}, '[^N]', '', 'g')) > 5 THEN 12 WHEN length({s}) < 15 THEN 16 ELSE 0 END"
_MERGED = f"""WITH {PAIRS}, {_overlaps("pairs", "s")}, fixed AS (SELECT read_id, name, {_fixed(1)}, {_fixed(2)} FROM s), {_overlaps("fixed", "t")},
n AS (SELECT *, ol + greatest(off, 0) AS n1, CASE WHEN off > 0 THEN l2 - ol ELSE 0 END AS n2 FROM t),
m AS (SELECT *, CASE WHEN overlapped THEN name || ' merged_' || n1 || '_' || n2 END AS merged_name, CASE WHEN overlapped THEN substr(seq1, 1, CAST(n1 AS INTEGER)) || substr(m2, CAST(ol + 1 AS INTEGER), CAST(n2 AS INTEGER)) END AS merged_seq,
 CASE WHEN overlapped THEN substr(qual1, 1, CAST(n1 AS INTEGER)) || substr(reverse(qual2), CAST(ol + 1 AS INTEGER), CAST(n2 AS INTEGER)) END AS merged_qual FROM n),
v AS (SELECT *, {_PASSES("seq1", "qual1")} AS v1, {_PASSES("seq2", "qual2")} AS v2, overlapped AND {_PASSES("merged_seq", "merged_qual")} = 0 AS ok FROM m)"""


@query(
    f"""{_CANDIDATES} SELECT read_id FROM q WHERE overlapped AND off < 0 AND (l1 > ol OR l2 > ol) AND least(l1, ol) <= 60 AND least(l2, ol) <= 60"""
)
def pair_dimers(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of which next to nothing is left once the adapter behind the insert is cut."""
    named = pairs(spark, d).withColumn("name1", F.col("name")).withColumn("name2", F.col("name"))
    got = cleaning.clean_pairs(named, replace(BARE, adapter_trimming=True, adapter1="", adapter2="", dimer_max_len=60))
    return got.where(f"verdict1 = {E.ADAPTER_DIMER} and verdict2 = {E.ADAPTER_DIMER}").select("read_id")


def _merge(spark: SparkSession, d: str) -> pipeline.Result:
    return pipeline.paired(pairs(spark, d), Options(merge=True, adapter_trimming=False, poly_g=False, include_unmerged=True))


@query(f"{_MERGED} SELECT count(*) FILTER (overlapped) AS merged, count(*) FILTER (ok) AS passed FROM v")
def merged_count(spark: SparkSession, d: str) -> DataFrame:
    return _merge(spark, d).judged.agg(F.count("merged_seq").alias("merged"), F.count_if(F.coalesce(F.col("merged_verdict") == E.PASS, F.lit(False))).alias("passed"))


@query(f"{_MERGED} SELECT read_id, merged_name, merged_seq, merged_qual FROM v WHERE overlapped")
def merge_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _merge(spark, d).judged.where("merged_seq is not null").select("read_id", "merged_name", "merged_seq", "merged_qual")


@query(
    f"""{_MERGED} SELECT 'merged' AS route, read_id, 0 AS mate, merged_name AS name, merged_seq AS seq, '+' AS strand, merged_qual AS qual FROM v WHERE ok
UNION ALL SELECT 'merged', read_id, 1, name, seq1, '+', qual1 FROM v WHERE NOT coalesce(ok, false) AND v1 = 0 UNION ALL SELECT 'merged', read_id, 2, name, seq2, '+', qual2 FROM v WHERE NOT coalesce(ok, false) AND v2 = 0"""
)
def merged_unmerged_union(spark: SparkSession, d: str) -> DataFrame:
    return _merge(spark, d).routed.where("route = 'merged'")


@query(f"WITH {PAIRS}, {_overlaps('pairs', 's', 0)} SELECT read_id, name, substr(seq1, CAST(greatest(off, 0) + 1 AS INTEGER), CAST(ol AS INTEGER)) AS seq, substr(qual1, CAST(greatest(off, 0) + 1 AS INTEGER), CAST(ol AS INTEGER)) AS qual FROM s WHERE overlapped")
def overlapped_out(spark: SparkSession, d: str) -> DataFrame:
    o = Options(adapter_trimming=False, poly_g=False, overlapped_out="o", out1="a", out2="b")
    return pipeline.paired(pairs(spark, d), o).routed.where("route = 'overlapped'").select("read_id", "name", "seq", "qual")


_V = lambda m: f"CASE WHEN length(seq{m}) = 0 THEN 16 WHEN length(regexp_replace(qual{m}, '[^!-/]', '', 'g')) * 100 > 40 * length(seq{m}) THEN 20 WHEN length(regexp_replace(seq{m}, '[^N]', '', 'g')) > 5 THEN 12 WHEN length(seq{m}) < 15 THEN 16 ELSE 0 END"
_JUDGED = f"WITH {PAIRS}, j AS (SELECT *, {_V(1)} AS v1, {_V(2)} AS v2 FROM pairs)"


@query(f"{_JUDGED} SELECT CAST(greatest(v1, v2) AS INTEGER) AS result, 2 * count(*) AS n FROM j GROUP BY 1")
def pair_verdict(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.buckets(pipeline.paired(pairs(spark, d), replace(BARE, out1="a", out2="b")))


@query(
    f"""{_JUDGED} SELECT read_id, CASE WHEN v1 = 0 AND v2 = 0 THEN 'out1' WHEN v1 = 0 THEN 'unpaired1' ELSE 'failed' END AS route, CAST(1 AS INTEGER) AS mate FROM j
UNION ALL SELECT read_id, CASE WHEN v1 = 0 AND v2 = 0 THEN 'out2' WHEN v2 = 0 THEN 'unpaired2' ELSE 'failed' END, 2 FROM j"""
)
def unpaired_route(spark: SparkSession, d: str) -> DataFrame:
    o = replace(BARE, out1="a", out2="b", unpaired1="u1", unpaired2="u2")
    return pipeline.paired(pairs(spark, d), o).routed.select("read_id", "route", "mate")


@query(f"{_JUDGED} SELECT 2 * count(*) AS reads_in, 2 * count(*) AS reads_judged FROM j")
def conservation(spark: SparkSession, d: str) -> DataFrame:
    r = pipeline.paired(pairs(spark, d), replace(BARE, out1="a", out2="b"))
    came = r.before.select(F.lit(2).alias("reads_in"), F.lit(0).cast("long").alias("reads_judged"))
    judged = pipeline.buckets(r).select(F.lit(0).alias("reads_in"), F.col("n").alias("reads_judged"))
    return came.unionByName(judged).agg(F.sum("reads_in").alias("reads_in"), F.sum("reads_judged").alias("reads_judged"))


@query(f"WITH {PAIRS} SELECT count(*) AS positions, count(*) FILTER (a.read_id IS NULL OR b.read_id IS NULL) AS without_partner FROM (SELECT * FROM pairs WHERE seq1 <> '') a FULL JOIN (SELECT * FROM pairs WHERE length(seq2) >= 40) b USING (read_id)")
def pair_mismatch(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    one = p.where("seq1 <> ''").select("read_id", "name", F.col("seq1").alias("seq"), F.col("qual1").alias("qual"))
    two = p.where("length(seq2) >= 40").select("read_id", "name", F.col("seq2").alias("seq"), F.col("qual2").alias("qual"))
    return pipeline.pair_up(one, two).agg(F.count(F.lit(1)).alias("positions"), F.count_if(~F.col("paired")).alias("without_partner"))


@query(f"WITH {PAIRS}, k AS (SELECT min(read_id) AS read_id FROM pairs GROUP BY regexp_replace(seq1 || seq2, '[^ATCG]', 'N', 'g')) SELECT read_id, seq1, seq2 FROM pairs SEMI JOIN k USING (read_id)")
def dedup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return stats.first_of_each(pairs(spark, d).select("read_id", "seq1", "seq2"), ["seq1", "seq2"])


@query(
    f"""WITH {PAIRS}, g AS (SELECT *, substr(seq1, 1, 6) || '_' || substr(seq2, 1, 6) AS umi, CAST(greatest(least(7, length(seq1) - 1), 0) AS INTEGER) AS g1, CAST(greatest(least(7, length(seq2) - 1), 0) AS INTEGER) AS g2 FROM pairs)
SELECT read_id, regexp_extract(name, '^([^ ]*)', 1) || ':' || umi || regexp_extract(name, '^[^ ]*(.*)$', 1) AS name1, substr(seq1, g1 + 1) AS seq1, substr(seq2, g2 + 1) AS seq2 FROM g"""
)
def umi_per_read(spark: SparkSession, d: str) -> DataFrame:
    named = pairs(spark, d).withColumn("name1", F.col("name")).withColumn("name2", F.col("name"))
    return cleaning.move_umi_pairs(named, "per_read", 6, 1).select("read_id", "name1", "seq1", "seq2")


def _full_pe() -> str:
    """The pair pipeline step by step: tails of G, overlap, correction, adapters behind the insert, exactly overlapping parts, tails of one base, verdicts, routes."""
    from helixmill.plans.qc import _polyg_sql, _polyx_sql

    side = lambda of, m: f"SELECT read_id, seq{m} AS seq, qual{m} AS qual FROM {of}"
    both = lambda name, of, one, two: f"{name} AS (SELECT {of}.* REPLACE (x.seq AS seq1, x.qual AS qual1, y.seq AS seq2, y.qual AS qual2) FROM {of} JOIN {one} AS x USING (read_id) JOIN {two} AS y USING (read_id))"
    kept = lambda c: f"substr({c}, 1, CASE WHEN cut THEN kept ELSE n END) AS {c}"
    short = lambda c, n: f"CASE WHEN overlapped AND off < 0 THEN substr({c}, 1, CAST(least({n}, ol) AS INTEGER)) ELSE {c} END AS {c}"
    tag = lambda v: f"CASE {v} {' '.join(f"WHEN {k} THEN '{t}'" for k, t in E.TAGS.items())} END"
    parts = [PAIRS, "heads AS (SELECT min(read_id) AS read_id FROM pairs GROUP BY regexp_replace(seq1 || seq2, '[^ATCG]', 'N', 'g'))", f"g1 AS ({side('pairs', 1)})", _polyg_sql("g1", "h1"), f"g2 AS ({side('pairs', 2)})", _polyg_sql("g2", "h2"), both("tails", "pairs", "h1", "h2")]
    parts += [_overlaps("tails", "s"), f"fixed AS (SELECT read_id, name, l1, l2, overlapped, off, ol, {_fixed(1)}, {_fixed(2)} FROM s)"]
    parts += [f"cut AS (SELECT read_id, name, {short('seq1', 'l1')}, {short('qual1', 'l1')}, {short('seq2', 'l2')}, {short('qual2', 'l2')}, overlapped AND off < 0 AND (l1 > ol OR l2 > ol) AND least(l1, ol) <= 2 AND least(l2, ol) <= 2 AS dimer FROM fixed)", _overlaps("cut", "e", 0)]
    parts += [f"c1 AS ({side('cut', 1)})", _polyx_sql("c1", "p1"), f"k1 AS (SELECT read_id, {kept('seq')}, {kept('qual')} FROM p1_x)", f"c2 AS ({side('cut', 2)})", _polyx_sql("c2", "p2"), f"k2 AS (SELECT read_id, {kept('seq')}, {kept('qual')} FROM p2_x)", both("done", "cut", "k1", "k2")]
    parts += [f"v AS (SELECT *, CASE WHEN dimer THEN 28 ELSE {_PASSES('seq1', 'qual1')} END AS v1, CASE WHEN dimer THEN 28 ELSE {_PASSES('seq2', 'qual2')} END AS v2 FROM done SEMI JOIN heads USING (read_id))"]
    row = lambda m, route, name, where: f"SELECT '{route}' AS route, read_id, CAST({m} AS INTEGER) AS mate, {name} AS name, seq{m} AS seq, '+' AS strand, qual{m} AS qual FROM v WHERE {where}"
    rows = [row(1, "out1", "name", "v1 = 0 AND v2 = 0"), row(2, "out2", "name", "v1 = 0 AND v2 = 0"), row(1, "unpaired1", "name", "v1 = 0 AND v2 <> 0"), row(2, "unpaired1", "name", "v2 = 0 AND v1 <> 0")]
    rows += [row(1, "failed", f"name || ' ' || {tag('v1')}", "v1 <> 0"), row(2, "failed", f"name || ' ' || {tag('v2')}", "v2 <> 0")]
    rows.append("SELECT 'overlapped', read_id, 0, name, substr(seq1, CAST(greatest(off, 0) + 1 AS INTEGER), CAST(ol AS INTEGER)), '+', substr(qual1, CAST(greatest(off, 0) + 1 AS INTEGER), CAST(ol AS INTEGER)) FROM e SEMI JOIN heads USING (read_id) WHERE overlapped")
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(rows)}"


@query(_full_pe())
def full_pe_pipeline(spark: SparkSession, d: str) -> DataFrame:
    o = Options(correction=True, poly_g=True, poly_x=True, dedup=True, out1="a", out2="b", unpaired1="u", overlapped_out="o")
    return pipeline.paired(pairs(spark, d), o).routed


_SUMS = """count(*) AS total_reads, CAST(sum(length(seq)) AS BIGINT) AS total_bases, CAST(sum(length(regexp_replace(qual, '[!-4]', '', 'g'))) AS BIGINT) AS q20_bases, CAST(sum(length(regexp_replace(qual, '[!->]', '', 'g'))) AS BIGINT) AS q30_bases,
 CAST(sum(length(regexp_replace(seq, '[^GCgc]', '', 'g'))) AS BIGINT) AS gc_bases, CAST(sum(length(seq)) // count(*) AS BIGINT) AS mean_length"""


@query(f"{_JUDGED}, m AS (SELECT seq1 AS seq, qual1 AS qual, v1 = 0 AND v2 = 0 AS ok FROM j UNION ALL SELECT seq2, qual2, v1 = 0 AND v2 = 0 FROM j) SELECT 'before' AS stage, {_SUMS} FROM m UNION ALL SELECT 'after', {_SUMS} FROM m WHERE ok")
def report_totals(spark: SparkSession, d: str) -> DataFrame:
    """Before and after totals of the pair pipeline, as in the report."""
    r = pipeline.paired(pairs(spark, d), replace(BARE, out1="a", out2="b"))
    mates = lambda df: df.select(F.explode(F.array(*[F.struct(F.col(f"seq{m}").alias("seq"), F.col(f"qual{m}").alias("qual")) for m in (1, 2)])).alias("m")).select("m.*")
    before = stats.summary(mates(r.before)).withColumn("stage", F.lit("before"))
    after = stats.summary(r.routed.where("route in ('out1', 'out2')").select("seq", "qual")).withColumn("stage", F.lit("after"))
    return before.unionByName(after)
