"""Queries of the verifier and of spectral events. Their text rules and transforms have no SQL form; tests hold them against tables of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import oscillation, verify
from ..sources.series import hourly_events, table
from .basic import query
from .sql import EV

#: The entries' statistics; what is rounded is a nudge larger, so that ties fall alike.
STATS = EV + """, st AS (SELECT channel, 'E' || dense_rank() OVER (ORDER BY channel) AS id, round(min(v) + 1e-9, 2) AS mn, round(max(v) + 1e-9, 2) AS pk, round(avg(v) + 1e-9, 3) AS me, CAST(count(v) AS DOUBLE) AS n FROM s GROUP BY channel),
fd AS (SELECT channel, id, unnest([struct_pack(key := 'min', kind := 'plain', value := mn), struct_pack(key := 'peak', kind := 'plain', value := pk), struct_pack(key := 'mean', kind := 'plain', value := me), struct_pack(key := 'n_samples', kind := 'count', value := n)]) AS f FROM st)"""


@query()
def extract_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of all documents, with their units and roles."""
    found = verify.extract_numbers(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return found.select("doc_id", "pos", "token", "value", "decimals", "start", "stop", "unit", "role", "in_range")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry for each channel of the hourly series: its statistics as a document."""
    stats = hourly_events(spark, sf_dir).groupBy("run_id", "channel").agg(F.round(F.min("v") + 1e-9, 2).alias("min"), F.round(F.max("v") + 1e-9, 2).alias("peak"), F.round(F.avg("v") + 1e-9, 3).alias("mean"), F.count("v").alias("n_samples"))
    return stats.select("run_id", F.concat(F.lit("E"), F.dense_rank().over(Window.partitionBy("run_id").orderBy("channel")).cast("string")).alias("evidence_id"), F.lit("channel_stats").alias("tool"), F.to_json(F.struct("channel")).alias("params"), F.to_json(F.struct("channel", "min", "peak", "mean", "n_samples")).alias("result"))


@query(f"WITH {STATS} SELECT id AS evidence_id, id || '.' || f.key AS path, f.kind AS kind, f.value AS value FROM fd")
def flatten_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.flatten_evidence(evidence(spark, sf_dir)).select("evidence_id", "path", "kind", "value")


CLAIMS = STATS + """, sc AS (SELECT unnest([1.0, 1000.0, 0.001, 100.0, 0.01, 60.0])::DOUBLE AS s), cl AS (SELECT channel, unnest([0, 1]) AS i, pk FROM st),
nm AS (SELECT channel, i, CASE i WHEN 0 THEN pk ELSE round(pk * 1.7 + 11 + 1e-9, 2) END AS x FROM cl), dc AS (SELECT *, CASE WHEN round(x * 10, 6) = round(round(x * 10), 6) THEN 1 ELSE 2 END AS d FROM nm),
hit AS (SELECT dc.channel, i, bool_or(near) AS has_near, bool_or(near AND key = 'peak') AS ok FROM (SELECT dc.channel, dc.i, f.key AS key, abs(x - abs(f.value * s)) <= greatest(0.5 * pow(10.0, -d), 0.01 * abs(f.value * s), 1e-9) AS near
  FROM dc JOIN fd ON fd.channel = dc.channel JOIN sc ON f.kind = 'plain' OR s = 1) dc GROUP BY 1, 2)"""


@query(f"WITH {CLAIMS} SELECT channel || '-' || i AS finding_id, CASE WHEN ok THEN 'verified' ELSE 'partial' END AS status, CAST(1 AS BIGINT) AS n_numbers, CAST(CASE WHEN ok THEN 1 ELSE 0 END AS BIGINT) AS n_verified, CASE WHEN ok THEN '' WHEN has_near THEN 'role_mismatch' ELSE 'ungrounded' END AS problems FROM hit")
def verify_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each channel a true claim and one with a number that its evidence doesn't have."""
    e = evidence(spark, sf_dir)
    d = e.withColumn("d", F.from_json("result", "channel string, peak double, mean double"))
    said = F.array(F.concat(F.lit("a peak of "), F.col("d.peak").cast("string")), F.concat(F.lit("a peak of "), F.round(F.col("d.peak") * 1.7 + 11 + 1e-9, 2).cast("string")))
    claims = d.select("run_id", F.array("evidence_id").alias("evidence"), F.col("d.channel").alias("channel"), F.posexplode(said).alias("i", "statement"))
    findings = claims.select("run_id", F.concat_ws("-", "channel", "i").alias("finding_id"), F.col("channel").alias("title"), "statement", F.lit("observation").alias("category"), "channel", F.lit(None).cast("double").alias("t_start"), F.lit(None).cast("double").alias("t_end"), "evidence")
    channels = hourly_events(spark, sf_dir).select("run_id", "channel").distinct()
    return verify.verify_findings(findings, e, channels).select("finding_id", "status", "n_numbers", "n_verified", F.array_join("problems", ",").alias("problems"))


@query()
def oscillation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines between 2 and 40 Hz of the hourly series, read at 100 samples a second."""
    s = hourly_events(spark, sf_dir).withColumn("t", F.col("seq") / 100.0)
    events, _ = oscillation.detect(s, 100.0, 0.64, 1, fmin=2.0, fmax=40.0, threshold_pct=0.5, prominence=3.0)
    return events.select("channel", *[F.round(c, 4).alias(c) for c in ("t_start", "t_end", "freq_hz", "peak_amp")], "n_windows")
