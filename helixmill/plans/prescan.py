"""Queries that look at the reads before they are cleaned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators import evaluate
from helixmill.operators.staging import staged
from helixmill.plans.views import PAIRS, READS, pairs, reads

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {READS} SELECT CAST(max(length(seq)) AS INTEGER) AS seq_len FROM reads WHERE read_id < 1000")
def seq_len(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.sequence_length(reads(spark, d), 1000)


@query(f"WITH {READS}, f AS (SELECT arg_min(name, (read_id, name)) AS name, min(read_id) AS read_id FROM reads) SELECT read_id, regexp_matches(name, '^({'|'.join(evaluate.TWO_COLOUR)})') AS two_color FROM f")
def two_color(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.two_colour(reads(spark, d))


def _distinct_reads(spark: SparkSession, d: str) -> DataFrame:
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # one shuffle, by read; staged, as several passes read it
    return staged(reads(spark, d).select("read_id", "seq").repartition(n, "read_id").distinct(), "reads")


_HOT = f"""WITH {READS}, r AS (SELECT DISTINCT read_id, seq FROM reads), z AS (SELECT max(length(seq)) AS l, greatest(1.0, sum(length(seq)) / 1510000) AS f FROM r),
k AS (SELECT DISTINCT unnest([10, 20, 40, 100, least(150, l - 2)]) AS k FROM z), g AS (SELECT k, substr(seq, CAST(i AS INTEGER), CAST(k AS INTEGER)) AS seq FROM (SELECT seq, k, unnest(range(1, length(seq) - k + 2)) AS i FROM r, k)),
c AS (SELECT seq, count(*) AS n, any_value(k) AS k FROM g GROUP BY seq),
h AS (SELECT seq, n FROM c, z WHERE n >= ceil(f * CASE WHEN k >= l - 1 THEN 3 WHEN k >= 100 THEN 5 WHEN k >= 40 THEN 20 WHEN k >= 20 THEN 100 ELSE 500 END))"""


@query(f"{_HOT} SELECT seq, n FROM h")
def overrep_hot(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.hot_sequences(_distinct_reads(spark, d))


@query(
    f"""{_HOT}, held AS (SELECT a.seq, list({{'s': b.seq, 'n': b.n}}) AS holders, any_value(a.n) AS n FROM h a JOIN h b ON length(b.seq) > length(a.seq) AND contains(b.seq, a.seq) GROUP BY a.seq),
turns AS (SELECT list({{'gone': CAST([] AS VARCHAR[]), 's': seq, 'n': n, 'holders': holders}} ORDER BY seq) AS all_ FROM held),
ended AS (SELECT list_reduce(list_prepend({{'gone': CAST([] AS VARCHAR[]), 's': '', 'n': CAST(0 AS BIGINT), 'holders': []}}, all_), lambda a, x: {{'gone': CASE WHEN len(list_filter(x.holders, lambda y: NOT list_contains(a.gone, y.s) AND x.n // y.n < 10)) > 0 THEN list_append(a.gone, x.s) ELSE a.gone END, 's': '', 'n': CAST(0 AS BIGINT), 'holders': x.holders}}) AS r FROM turns)
SELECT seq, n FROM h WHERE seq NOT IN (SELECT unnest(r.gone) FROM ended)"""
)
def overrep_kept(spark: SparkSession, d: str) -> DataFrame:
    """Hot sequences without those that stand in another one which isn't much rarer, in order."""
    found = [(r["seq"], r["n"]) for r in evaluate.hot_sequences(_distinct_reads(spark, d)).collect()]  # bounded by the bases over the least counts, which grow with them
    return spark.createDataFrame(evaluate.without_contained(found), "seq string, n long")


def _hot_of(table: str) -> str:
    return _HOT.replace(f"WITH {READS}, r AS (SELECT DISTINCT read_id, seq FROM reads)", f"WITH {PAIRS}, r AS ({table})")


@query(f"SELECT 1 AS mate, * FROM ({_hot_of('SELECT read_id, seq1 AS seq FROM pairs')} SELECT seq, n FROM h) UNION ALL SELECT 2, * FROM ({_hot_of('SELECT read_id, seq2 AS seq FROM pairs')} SELECT seq, n FROM h)")
def overrep_hot_mates(spark: SparkSession, d: str) -> DataFrame:
    """Hot sequences of each mate."""
    p = staged(pairs(spark, d).select("read_id", "seq1", "seq2"), "mates")
    one, two = (evaluate.hot_sequences(p.select("read_id", F.col(f"seq{m}").alias("seq"))).select(F.lit(m).alias("mate"), "seq", "n") for m in (1, 2))
    return one.unionByName(two)


_STARTS = f"""{_HOT}, p AS (SELECT read_id, k, unnest(range(0, length(seq) - k)) AS i, seq FROM r, k), w AS (SELECT read_id, k, i, substr(p.seq, CAST(i + 1 AS INTEGER), CAST(k AS INTEGER)) AS piece FROM p),
l AS (SELECT read_id, k, list({{'i': i, 's': piece}} ORDER BY i) AS hits FROM w SEMI JOIN h ON piece = h.seq GROUP BY 1, 2),
t AS (SELECT k, unnest(list_reduce(list_prepend({{'i': -1000, 's': ''}}, hits).list_transform(lambda x: [x]), lambda a, b: CASE WHEN b[1].i > a[len(a)].i + k THEN a || b ELSE a END)) AS x FROM l),
starts AS (SELECT x.s AS seq, CAST(x.i AS INTEGER) AS place, count(*) AS n FROM t WHERE x.i >= 0 GROUP BY 1, 2)"""


@query(f"{_STARTS} SELECT seq, CAST(sum(n) AS BIGINT) AS n FROM starts GROUP BY seq")
def overrep_counts(spark: SparkSession, d: str) -> DataFrame:
    """Non-overlapping occurrences of the hot sequences of every length, every read scanned."""
    r = _distinct_reads(spark, d)
    return evaluate.hot_counts(r, evaluate.hot_sequences(r))


@query(f"{_STARTS} SELECT seq, CAST(c AS INTEGER) AS cycle, CAST(sum(n) AS BIGINT) AS n FROM (SELECT seq, unnest(range(place, place + length(seq))) AS c, n FROM starts) GROUP BY 1, 2")
def overrep_cycles(spark: SparkSession, d: str) -> DataFrame:
    """The cycles that they cover."""
    r = _distinct_reads(spark, d)
    return evaluate.hot_cycles(evaluate.hot_starts(r, evaluate.hot_sequences(r)))


_REPEATS = f"""WITH {READS}, r AS (SELECT DISTINCT read_id, seq FROM reads), u AS (SELECT read_id, seq, i, substr(seq, CAST(i + 1 AS INTEGER)) AS t FROM (SELECT read_id, seq, unnest(range(0, length(seq))) AS i FROM r)),
o AS (SELECT *, lag(t) OVER w AS before, lag(i) OVER w AS j FROM u WINDOW w AS (PARTITION BY read_id, seq ORDER BY t)),
c AS (SELECT read_id, seq, i, j, coalesce(list_position(list_transform(range(1, least(length(t), length(before)) + 1), lambda p: substr(t, CAST(p AS INTEGER), 1) <> substr(before, CAST(p AS INTEGER), 1)), true) - 1, least(length(t), length(before))) AS l FROM o WHERE substr(t, 1, 10) = substr(before, 1, 10) AND length(t) >= 10 AND length(before) >= 10)"""


@query(f"{_REPEATS} SELECT read_id, CAST(l AS INTEGER) AS repeat_len, CAST(i AS INTEGER) AS pos1, CAST(j AS INTEGER) AS pos2, substr(seq, CAST(i + 1 AS INTEGER), CAST(l AS INTEGER)) AS repeat_seq FROM c ORDER BY l DESC, read_id, i, j LIMIT 20")
def long_repeats_top20(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.long_repeats(_distinct_reads(spark, d), 10).orderBy(F.desc("repeat_len"), "read_id", "pos1", "pos2").limit(20)


@query(
    f"""{_REPEATS}, g AS (SELECT *, substr(seq, CAST(i + 1 AS INTEGER), CAST(l AS INTEGER)) AS piece FROM c),
f AS (SELECT * FROM g WHERE len(list_filter(range(1, l), lambda p: substr(piece, CAST(p AS INTEGER), 1) <> substr(piece, CAST(p + 1 AS INTEGER), 1))) >= 0.3 * (l - 1)
 QUALIFY row_number() OVER (PARTITION BY read_id, seq ORDER BY l DESC, i) <= 20)
SELECT read_id, CAST(l AS INTEGER) AS repeat_len, CAST(i AS INTEGER) AS pos1, CAST(j AS INTEGER) AS pos2, piece AS repeat_seq FROM f"""
)
def long_repeats_complex(spark: SparkSession, d: str) -> DataFrame:
    """Every read's 20 longest repeats that aren't of low complexity."""
    return evaluate.long_repeats(_distinct_reads(spark, d), 10, complexity=0.3)


@query(
    f"""WITH {READS}, g AS (SELECT substr(seq, CAST(i AS INTEGER), 10) AS kmer FROM (SELECT seq, unnest(range(21, length(seq) - 9)) AS i FROM reads)), k AS (SELECT kmer, count(*) AS n FROM g WHERE regexp_matches(kmer, '^[ACGT]{{10}}$') GROUP BY 1),
t AS (SELECT sum(n) AS total FROM k), s AS (SELECT kmer, n FROM k, t WHERE n >= 10 AND n * 1048576 >= 20 * total AND kmer <> 'AAAAAAAAAA' AND NOT starts_with(kmer, 'GGGG')
 AND length(regexp_replace(kmer, '[^CG]', '', 'g')) < 8 AND {" AND ".join(f"length(regexp_replace(kmer, '[^{b}]', '', 'g')) < 6" for b in "ATCG")}
 AND len(list_filter(range(1, 10), lambda i: substr(kmer, CAST(i AS INTEGER), 1) <> substr(kmer, CAST(i + 1 AS INTEGER), 1))) >= 3)
SELECT kmer, n FROM s ORDER BY n DESC, translate(kmer, 'ATCG', '0123') DESC LIMIT 10"""
)
def seed_kmers_top10(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.adapter_seeds(reads(spark, d))


_VOTES = f"""WITH {READS}, r AS (SELECT row_number() OVER () AS k, seq, length(seq) AS n FROM reads), a AS (SELECT DISTINCT upper(seq) AS adapter, length(seq) AS m FROM known_adapters WHERE length(seq) > 8),
p AS (SELECT k, n, seq, unnest(range(0, n - 8)) AS p FROM r), w AS (SELECT k, n, seq, p, c, substr(seq, CAST(p + c + 1 AS INTEGER), 8) AS piece FROM p, (VALUES (0), (8), (16)) v(c)),
x AS (SELECT adapter, m, c, substr(adapter, c + 1, 8) AS piece FROM a, (VALUES (0), (8), (16)) v(c) WHERE c <= 8 * (m // 16) AND c + 8 <= m),
y AS (SELECT DISTINCT k, adapter, p, hamming(substr(seq, CAST(p + 1 AS INTEGER), CAST(least(n - p, m) AS INTEGER)), substr(adapter, 1, CAST(least(n - p, m) AS INTEGER))) AS bad, least(n - p, m) AS l FROM w JOIN x USING (c, piece) WHERE m < n),
f AS (SELECT k, adapter, arg_min(bad, p) AS bad FROM y WHERE bad <= l // 16 GROUP BY k, adapter),
votes AS (SELECT adapter, count(*) AS n, CAST(sum(bad) AS BIGINT) AS mismatches FROM f GROUP BY adapter)"""


@query(f"{_VOTES} SELECT adapter, n, mismatches FROM votes")
def known_adapter_vote(spark: SparkSession, d: str) -> DataFrame:
    known = [r["seq"] for r in spark.read.parquet(f"{d}/known_adapters.parquet").select("seq").where("seq is not null").collect()]  # a fixed list
    return evaluate.known_adapter_votes(reads(spark, d), known)


@query(
    f"""{_VOTES}, c AS (SELECT count(*) AS reads FROM reads), best AS (SELECT adapter, n, mismatches FROM votes ORDER BY n DESC, adapter LIMIT 1)
SELECT CASE WHEN reads >= 10000 AND (n > reads / 50 OR (n > reads / 200 AND mismatches < reads)) THEN adapter END AS adapter FROM c LEFT JOIN best ON true"""
)
def detected_adapter(spark: SparkSession, d: str) -> DataFrame:
    known = [r["seq"].upper() for r in spark.read.parquet(f"{d}/known_adapters.parquet").select("seq").where("seq is not null").collect()]
    return spark.createDataFrame([(evaluate.detect_adapter(reads(spark, d), known),)], "adapter string")


@query("SELECT dataset, tool, threads, count(*) AS runs, round(min(walltime_s), 6) AS best_s FROM (SELECT DISTINCT * FROM benchmark_runs) WHERE reads_in > 0 GROUP BY ALL")
def benchmark_best(spark: SparkSession, d: str) -> DataFrame:
    runs = spark.read.parquet(f"{d}/benchmark_runs.parquet").distinct().where("reads_in > 0")
    return runs.groupBy("dataset", "tool", "threads").agg(F.count(F.lit(1)).alias("runs"), F.round(F.min("walltime_s"), 6).alias("best_s"))
