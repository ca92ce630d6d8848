"""Queries of the training-data operators, and their SQL where whole tables allow it."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm import heavy, leakage, mixing, neardup, residue, spans
from helixmill.llm.reads import reads
from helixmill.operators.staging import staged

Query = Callable[[SparkSession, str], DataFrame]


def _p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = heavy.frequent_ids(reads(spark, sf_dir), "seq", "read_id", 0.005)
    kmers = heavy.frequent_weights(heavy.counted_kmers(spark.read.parquet(f"{sf_dir}/batch_post_stats.parquet")), "item", "w", 0.003)
    of = lambda df, origin, item: df.select(F.lit(origin).alias("origin"), F.col(item).alias("item"), "n", "total")
    return of(seqs, "seq", "seq").unionByName(of(kmers, "kmer", "item"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p2(spark, sf_dir).select("origin", "item")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequent items with their counts and the total of their column."""
    return _p2(spark, sf_dir)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_pairs(reads(spark, sf_dir)).select("read_id_a", "read_id_b")


def p4_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.membership(reads(spark, sf_dir))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which reads belong together, one row a read."""
    return neardup.groups(reads(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(reads(spark, sf_dir))


def p5_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every read, how much of it other reads hold too."""
    return spans.shared_share(reads(spark, sf_dir))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_leaks(spark, sf_dir).where("kind = 'verbatim'").select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbatim and paraphrased leaks with the best cosine of the pair's passages."""
    return leakage.leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/eval_items.parquet"))


def tokenizer() -> str:
    """The vocabulary file that weighs documents: HELIXMILL_TOKENIZER, else where the public tokenizers are installed."""
    spec = importlib.util.find_spec("public_tokenizers")
    root = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.environ.get("HELIXMILL_TOKENIZER") or os.path.join(root, "byte_bpe_50k.tiktoken")


def _mix(spark: SparkSession, sf_dir: str, opts: mixing.MixOptions) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/mix_targets.parquet"), tokenizer(), opts)


#: Tokens of a block in the order of the queries.
BLOCK = 1 << 12
#: As large as all targets allow (exponent 1); 0.9 of the tokens there are, at which the repeats bind (exponent under 1); 0.8 of the entropy of equal weights.
MIXES = {"targets": mixing.MixOptions(block=BLOCK), "budget": mixing.MixOptions(block=BLOCK, of_all=0.9), "entropy": mixing.MixOptions(block=BLOCK, even=0.8)}


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uses of the drawn documents and their order, every source at its target."""
    return _mix(spark, sf_dir, MIXES["targets"])[0]


def p7_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a budget that the targets can't fill within the repeats."""
    return _mix(spark, sf_dir, MIXES["budget"])[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, weight, exponent and share reached of every source, for each kind of mix."""
    docs, targets = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/mix_targets.parquet")
    sizes = staged(mixing.token_sizes(docs, tokenizer()), "tokens")
    parts = [mixing.mix(docs, targets, tokenizer(), opts, sizes)[1].select(F.lit(kind).alias("mix"), "*") for kind, opts in MIXES.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_residue(spark, sf_dir).select("doc_id").distinct()


def p8_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to exclude, with the kinds of residue and how many characters each covers."""
    return residue.residue(_documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "p2_found": p2_found,
    "p2_counts": p2_counts,
    "p4_found": p4_found,
    "p4_members": p4_members,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_share": p5_share,
    "p6_found": p6_found,
    "p6_leaks": p6_leaks,
    "p7_mix": p7_mix,
    "p7_budget": p7_budget,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_residue": p8_residue,
}

_READ = "r AS (SELECT read_id, upper(seq) AS seq FROM fastq_reads WHERE read_id IS NOT NULL AND seq IS NOT NULL AND seq <> '')"

_SPANS = f"""
WITH {_READ}, w AS (SELECT DISTINCT read_id, i, substr(seq, i + 1, 60) AS t FROM (SELECT read_id, seq, unnest(range(0, length(seq) - 59)) AS i FROM r)),
s AS (SELECT t FROM w GROUP BY t HAVING min(read_id) <> max(read_id)),
p AS (SELECT read_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY read_id ORDER BY i) <= 60 THEN 0 ELSE 1 END AS b FROM w JOIN s USING (t)),
g AS (SELECT read_id, i, sum(b) OVER (PARTITION BY read_id ORDER BY i) AS g FROM p),
f AS (SELECT read_id, CAST(min(i) AS INTEGER) AS span_start, CAST(max(i) + 60 AS INTEGER) AS span_end FROM g GROUP BY read_id, g)"""
_SIMILAR = f"""
{_READ}, d AS (SELECT seq, min(read_id) AS id FROM r WHERE length(seq) >= 30 GROUP BY seq),
g AS (SELECT DISTINCT id, substr(seq, i, 8) AS gram FROM (SELECT id, seq, unnest(range(1, length(seq) - 6)) AS i FROM d)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
c AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id GROUP BY 1, 2),
pairs AS (SELECT x, y FROM c JOIN n p ON p.id = x JOIN n q ON q.id = y WHERE 2 * c >= p.n + q.n - c)"""
_FREQUENT = f"""
WITH {_READ}, k AS (SELECT max(kmer) AS kmer FROM batch_post_stats WHERE kmer IS NOT NULL GROUP BY batch_id),
u AS (SELECT i - 1 AS i, kmer[i] AS w FROM k, range(1, 1025) t(i)),
a AS (SELECT 'seq' AS origin, seq AS item, count(DISTINCT read_id) AS n, (SELECT count(DISTINCT read_id) FROM r) AS total FROM r GROUP BY seq),
b AS (SELECT 'kmer' AS origin, array_to_string([substr('ATCG', 1 + (i // pow(4, d)::BIGINT) % 4, 1) FOR d IN [4, 3, 2, 1, 0]], '') AS item,
 CAST(sum(w) AS BIGINT) AS n, (SELECT CAST(sum(w) AS BIGINT) FROM u) AS total FROM u GROUP BY i),
f AS (SELECT * FROM a WHERE n >= 0.005 * total UNION ALL SELECT * FROM b WHERE n >= 0.003 * total)"""

ORACLES: dict[str, str] = {
    "p2_found": f"{_FREQUENT} SELECT origin, item FROM f",
    "p2_counts": f"{_FREQUENT} SELECT origin, item, n, total FROM f",
    "p5_found": f"{_SPANS} SELECT * FROM f",
    "p6_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
q AS (SELECT item_id, least(12, len(w)) AS n, w FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS t FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM q)),
s AS (SELECT DISTINCT doc_id, n, array_to_string(w[k:k + n - 1], ' ') AS t FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM q)))
SELECT DISTINCT doc_id, item_id FROM g JOIN s USING (n, t)""",
    "p5_share": f"""{_SPANS}, n AS (SELECT read_id, CAST(max(length(seq)) AS BIGINT) AS n_chars FROM r GROUP BY 1)
SELECT n.read_id, n_chars, CAST(coalesce((SELECT sum(span_end - span_start) FROM f WHERE f.read_id = n.read_id), 0) AS BIGINT) AS n_shared FROM n""",
    "p4_found": f"WITH {_SIMILAR} SELECT x AS read_id_a, y AS read_id_b FROM pairs",
    "p4_groups": f"""WITH RECURSIVE {_SIMILAR}, e AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
t(id, low) AS (SELECT x, x FROM e UNION SELECT e.y, t.low FROM t JOIN e ON e.x = t.id),
z AS (SELECT id, min(low) AS low FROM t GROUP BY id), l AS (SELECT x AS id, count(*) AS links FROM e GROUP BY x),
m AS (SELECT DISTINCT read_id, min(read_id) OVER (PARTITION BY seq) AS rep_id FROM r WHERE length(seq) >= 30)
SELECT read_id, rep_id, coalesce(low, rep_id) AS group_id, coalesce(links, 0) AS links FROM m LEFT JOIN z ON z.id = rep_id LEFT JOIN l ON l.id = rep_id""",
    "p4_members": f"""
WITH {_READ} SELECT DISTINCT read_id, min(read_id) OVER (PARTITION BY seq) AS rep_id FROM r WHERE length(seq) >= 30""",
}
