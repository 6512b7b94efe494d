"""Queries of scoring: containment, masking and corroboration of events, and the summaries of benchmarks, on the series' excursions and the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import synth
from ..sources.series import table
from .analysis import TRUTH, findings_and_truth, slotted
from .basic import query, r6

TOL = 0.0251


@query(f"WITH {TRUTH} SELECT a.channel, round(a.t0, 6) AS t_start, round(min(f.t0), 6) AS within_from FROM i250 a JOIN i150 f ON f.channel = a.channel AND f.t0 - {TOL}::DOUBLE <= a.t0 AND a.t1 <= f.t1 + {TOL}::DOUBLE GROUP BY a.channel, a.t0")
def contained_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excursions above 250 that lie inside one above 150: says nothing about a time that the wider one doesn't cover."""
    wide, inner = findings_and_truth(spark, sf_dir)
    f, a = slotted(wide, 1.0, TOL).alias("f"), inner.withColumn("slot", F.floor("t_start")).alias("a")
    inside = (F.col("f.t_start") - TOL <= F.col("a.t_start")) & (F.col("a.t_end") <= F.col("f.t_end") + TOL)
    hit = a.join(f, (F.col("f.channel") == F.col("a.channel")) & (F.col("f.slot") == F.col("a.slot")) & inside)
    return hit.groupBy(F.col("a.channel").alias("channel"), F.col("a.t_start").alias("t")).agg(F.min("f.t_start").alias("w")).select("channel", r6("t").alias("t_start"), r6("w").alias("within_from"))


@query(f"WITH {TRUTH} SELECT a.channel, round(a.t0, 6) AS t_start FROM i250 a WHERE EXISTS (SELECT 1 FROM i150 b WHERE b.channel <> a.channel AND b.t0 <= a.t1 + {TOL}::DOUBLE AND a.t0 - {TOL}::DOUBLE <= b.t1)")
def masked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excursions that another channel shows at the same time."""
    wide, inner = findings_and_truth(spark, sf_dir)
    a, b = slotted(inner, 1.0, TOL).alias("a"), slotted(wide, 1.0, 0.0).alias("b")
    same = (F.col("a.slot") == F.col("b.slot")) & (F.col("a.channel") != F.col("b.channel")) & (F.col("b.t_start") <= F.col("a.t_end") + TOL) & (F.col("a.t_start") - TOL <= F.col("b.t_end"))
    return a.join(b, same, "left_semi").select("channel", r6("t_start").alias("t_start")).distinct()


@query(f"WITH {TRUTH}, z AS (SELECT a.channel, a.t0, b.channel AS other, b.t1 - b.t0 AS size FROM i250 a JOIN i150 b ON b.channel <> a.channel AND b.t0 <= a.t1 AND a.t0 <= b.t1 AND abs((b.t1 - b.t0) - (a.t1 - a.t0)) < 0.05::DOUBLE) SELECT channel, round(t0, 6) AS t_start, min(other) AS other FROM z GROUP BY channel, t0")
def corroborated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each excursion the first other channel with one of nearly its length at the same time."""
    wide, inner = findings_and_truth(spark, sf_dir)
    a, b = slotted(inner, 1.0, 0.0).alias("a"), slotted(wide, 1.0, 0.0).alias("b")
    size = lambda x: F.col(f"{x}.t_end") - F.col(f"{x}.t_start")
    same = (F.col("a.slot") == F.col("b.slot")) & (F.col("a.channel") != F.col("b.channel")) & (F.col("b.t_start") <= F.col("a.t_end")) & (F.col("a.t_start") <= F.col("b.t_end")) & (F.abs(size("b") - size("a")) < 0.05)
    return a.join(b, same).groupBy(F.col("a.channel").alias("channel"), F.col("a.t_start").alias("t")).agg(F.min("b.channel").alias("other")).select("channel", r6("t").alias("t_start"), "other")


@query("SELECT event_type AS channel, count(*) AS n, round(list_sort(list(value))[count(*) // 2 + 1], 6) AS upper_median FROM events GROUP BY 1")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle value, of two the larger, as errors of time are summed up."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("channel")).agg(F.count("*").alias("n"), r6(synth.upper_median("value")).alias("upper_median"))


@query("SELECT event_type AS kind, CAST(event_id % 4 AS BIGINT) AS level, count(*) AS n, count(*) FILTER (value > 60 * (event_id % 4)) AS detected, count(*) FILTER (value <= 60 * (event_id % 4) AND value > 50) AS masked FROM events GROUP BY CUBE (event_type, event_id % 4)")
def hybrid_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of jobs for each kind and level, for each of them alone, and of all: events stand for jobs."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), (F.col("event_id") % 4).alias("level"), "value").withColumn("least", 60 * F.col("level"))
    found = F.col("value") > F.col("least")
    return e.cube("kind", "level").agg(F.count("*").alias("n"), F.count_if(found).alias("detected"), F.count_if(~found & (F.col("value") > 50)).alias("masked"))


@query("SELECT CASE event_id % 3 WHEN 0 THEN 'fabricated' WHEN 1 THEN 'swapped' ELSE 'wrong_unit' END AS kind, CASE event_id % 2 WHEN 0 THEN 'untagged' ELSE 'tagged' END AS arm, count(*) AS n, count(*) FILTER (value > 40) AS caught, round(count(*) FILTER (value > 40) / count(*), 6) AS share FROM events GROUP BY 1, 2")
def mutation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many mutants of each kind and arm are caught: events stand for mutants."""
    i = F.col("event_id")
    kind = F.when(i % 3 == 0, "fabricated").when(i % 3 == 1, "swapped").otherwise("wrong_unit")
    e = table(spark, sf_dir, "events").select(kind.alias("kind"), F.when(i % 2 == 0, "untagged").otherwise("tagged").alias("arm"), (F.col("value") > 40).alias("hit"))
    return e.groupBy("kind", "arm").agg(F.count("*").alias("n"), F.count_if("hit").alias("caught"), r6(F.count_if("hit") / F.count("*")).alias("share"))


@query("SELECT role, count(*) AS requests, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS characters FROM conversations GROUP BY ROLLUP (role)")
def usage_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and what they took, for each role and in all."""
    c = table(spark, sf_dir, "conversations").select("role", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    return c.rollup("role").agg(F.count("*").alias("requests"), F.sum("n").alias("characters"))
