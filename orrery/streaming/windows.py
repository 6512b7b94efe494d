"""Streaming forms of the window operators (an extension of ours): the same expressions over event time with watermarks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_stats(events: DataFrame, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Count, mean and extremes of each channel and window; rows later than the watermark are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    found = events.withWatermark("ts", late).groupBy(window.alias("w"), "channel").agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))
    return found.select("channel", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "total", "low", "high")


def spike_sessions(events: DataFrame, above: float, gap: str = "6 hours", late: str = "12 hours") -> DataFrame:
    """Clusters of values beyond a limit: sessions that end after a gap."""
    hot = events.where(F.col("v") > above).withWatermark("ts", late)
    found = hot.groupBy(F.session_window("ts", gap).alias("w"), "channel").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    return found.select("channel", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "top")


def debounced_redlines(events: DataFrame, limit: float, least: int) -> DataFrame:
    """Runs of at least `least` values in a row above limit, by state for each channel: emitted when the run ends. Rows come in the order of time."""

    def update(key, batches, state: GroupState):
        start, n, top, last = state.get if state.exists else (None, 0, 0.0, None)
        out = []
        for rows in batches:
            for ts, v in rows.sort_values("ts")[["ts", "v"]].itertuples(index=False):
                if v > limit:
                    start, n, top, last = (start or ts.isoformat()), n + 1, max(top, v) if n else v, ts.isoformat()
                else:
                    if n >= least:
                        out.append((key[0], pd.Timestamp(start), pd.Timestamp(last), n, top))
                    start, n, top, last = None, 0, 0.0, None
        state.update((start, n, top, last))
        yield pd.DataFrame(out, columns=["channel", "start", "stop", "n", "top"])

    return events.groupBy("channel").applyInPandasWithState(update, "channel string, start timestamp, stop timestamp, n long, top double", "start string, n long, top double, last string", "append", GroupStateTimeout.NoTimeout)
