"""Queries over the resource log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators import telemetry


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/resource_samples.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.implausible(_log(spark, sf_dir))


def p1_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is normal for each source and metric."""
    return telemetry.normal_behaviour(telemetry.readings(telemetry.samples(_log(spark, sf_dir)), list(telemetry.POSSIBLE)))


def p1_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading that the filter flags, with its source's model and the standardised innovation."""
    got = telemetry.judged(telemetry.readings(telemetry.samples(_log(spark, sf_dir)), list(telemetry.POSSIBLE)))
    return got.withColumn("z", F.round("z", 6))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_grid(spark, sf_dir).where("filled").select("input_file", "metric", "slot_epoch_s")


def p3_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regular series with imputed slots marked."""
    return telemetry.regular(_log(spark, sf_dir), ["cpu_pct", "gpu_util_pct"])


QUERIES = {"p1_found": p1_found, "p1_normal": p1_normal, "p1_flags": p1_flags, "p3_found": p3_found, "p3_grid": p3_grid}

_SAMPLES = """
s AS (SELECT DISTINCT sample_id, split_part(input_file, '/', -1) AS source, CASE WHEN epoch_s > 100000000000 THEN epoch_s // 1000 ELSE epoch_s END AS epoch,
 cpu_pct, rss_mib, gpu_util_pct, gpu_mem_mib FROM resource_samples WHERE sample_id IS NOT NULL AND input_file IS NOT NULL AND epoch_s IS NOT NULL)"""
_LONG = f"""WITH {_SAMPLES},
l AS (SELECT source, 'rss_mib' AS metric, epoch, sample_id, rss_mib AS value, rss_mib BETWEEN 1 AND 262144 AS ok FROM s WHERE rss_mib IS NOT NULL
 UNION ALL SELECT source, 'gpu_mem_mib', epoch, sample_id, gpu_mem_mib, gpu_mem_mib BETWEEN 0 AND 81920 FROM s WHERE gpu_mem_mib IS NOT NULL
 UNION ALL SELECT source, 'gpu_util_pct', epoch, sample_id, gpu_util_pct, gpu_util_pct BETWEEN 0 AND 100 FROM s WHERE gpu_util_pct IS NOT NULL),
c AS (SELECT source, metric, median(value::DOUBLE) AS centre FROM l WHERE ok GROUP BY ALL),
n AS (SELECT source, metric, any_value(centre) AS centre, median(abs(value - centre)) AS spread FROM l JOIN c USING (source, metric) WHERE ok GROUP BY ALL)"""

ORACLES = {
    "p1_normal": f"{_LONG} SELECT source, metric, centre, spread FROM n",
    "p1_found": f"""{_LONG},
o AS (SELECT *, CASE WHEN value = lag(value) OVER w THEN 0 ELSE 1 END AS b FROM l WINDOW w AS (PARTITION BY source, metric ORDER BY epoch, sample_id)),
g AS (SELECT *, sum(b) OVER (PARTITION BY source, metric ORDER BY epoch, sample_id) AS g FROM o),
k AS (SELECT *, count(*) OVER (PARTITION BY source, metric, g) AS run FROM g)
SELECT sample_id, metric FROM k LEFT JOIN n USING (source, metric)
WHERE NOT ok OR (run >= 10 AND value <> 0) OR abs(value - centre) > 12 * greatest(spread, 1)""",
    "p3_found": f"""WITH {_SAMPLES}, e AS (SELECT source, min(epoch) // 30 AS a, max(epoch) // 30 AS b FROM s GROUP BY source),
g AS (SELECT source, unnest(range(a, b + 1)) AS slot FROM e),
h AS (SELECT DISTINCT source, epoch // 30 AS slot, 'cpu_pct' AS metric FROM s WHERE cpu_pct IS NOT NULL
 UNION SELECT DISTINCT source, epoch // 30, 'gpu_util_pct' FROM s WHERE gpu_util_pct IS NOT NULL),
w AS (SELECT source, slot, metric FROM g, (VALUES ('cpu_pct'), ('gpu_util_pct')) m(metric))
SELECT source AS input_file, metric, slot * 30 AS slot_epoch_s FROM w ANTI JOIN h USING (source, slot, metric)""",
}
