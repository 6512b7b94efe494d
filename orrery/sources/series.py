"""Series from the star-schema tables: samples (run_id, channel, seq, t, v), a row for each place of a regular grid, v NULL where nothing was recorded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_mean(value: str) -> F.Column:
    """Of values with two decimals: summed as decimals, so that no order of rows changes it."""
    return F.sum(F.col(value).cast("decimal(18,2)")).cast("double") / F.count("*")


def hourly_events(spark: SparkSession, sf_dir: str, run: str = "all") -> DataFrame:
    """Channels are event types; v the mean value of each hour, from the first hour of any event to the last. seq counts hours since 2024-01-01."""
    events = table(spark, sf_dir, "events").select("event_type", "value", F.floor(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / 3_600_000_000).alias("seq"))
    means = events.groupBy(F.col("event_type").alias("channel"), "seq").agg(exact_mean("value").alias("v"))
    # The grid follows from the means, a row for each channel and hour: their span and channels are one small row.
    span = means.agg(F.collect_set("channel").alias("channels"), F.sequence(F.min("seq"), F.max("seq")).alias("hours"))
    grid = span.select(F.explode("channels").alias("channel"), "hours").select("channel", F.explode("hours").alias("seq"))
    return grid.join(means, ["channel", "seq"], "left").select(F.lit(run).alias("run_id"), "channel", "seq", (F.col("seq") * 3600.0).alias("t"), "v")


def daily_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels are return flags; v the sum of quantities shipped on a day, seq the day since 1995-01-01."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "lineitem").groupBy(F.lit("lines").alias("run_id"), F.col("l_returnflag").alias("channel"), day.alias("seq")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("v")).withColumn("t", F.col("seq") * 86400.0)


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series: the mean price of a day's orders."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "orders").groupBy(F.lit("orders").alias("run_id"), F.lit("price").alias("channel"), day.alias("seq")).agg(exact_mean("o_totalprice").alias("v")).withColumn("t", F.col("seq") * 86400.0)
