"""Spectral event detection: hopping windows of a signal, their strongest line in a band, and its merging into events.

Series are dealt out in blocks of windows, with the samples that their last windows need, so that a long series is many tasks; the
transforms of a block are one two-dimensional FFT in numpy. Everything else is native.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from .cards import KEYS

WINDOWS = "run_id string, channel string, k long, t double, freq_hz double, amp double, amp_pct double, prominence double, flagged boolean, skipped boolean"
#: Windows of a block.
BLOCK = 256


def settings(fs: float, native: float | None, fmin: float, fmax: float, window_s: float) -> tuple[float, int] | None:
    """The highest frequency that shows, and the samples of a window; None where no band is left."""
    fmax = min(fmax, 0.45 * min(native or fs, fs))
    return None if fmax <= fmin else (fmax, max(round(max(window_s, 16 / (fmax - fmin)) * fs), 16))


def filled(x: np.ndarray) -> np.ndarray:
    """Rows with their missing values interpolated; rows without any value stay."""
    for row in np.flatnonzero(np.isnan(x).any(1)):
        known = ~np.isnan(x[row])
        if known.any():
            x[row] = np.interp(np.arange(x.shape[1]), np.flatnonzero(known), x[row][known])
    return x


def magnitudes(x: np.ndarray) -> np.ndarray:
    """Of each row, detrended and under a Hann window, the amplitude of each bin."""
    n = x.shape[1]
    i = np.arange(n) - (n - 1) / 2
    slope = x @ i / (i @ i)
    flat = x - x.mean(1, keepdims=True) - slope[:, None] * i
    hann = np.hanning(n)
    return 2 * np.abs(np.fft.rfft(flat * hann)) / hann.sum()


def windows(samples: DataFrame, fs: float, fmin: float = 50.0, fmax: float = 2000.0, threshold_pct: float = 0.5, window_s: float = 0.1, prominence: float = 8.0, native: float | None = None) -> DataFrame:
    """The strongest line of each window: frequency by the parabola through its neighbours' logarithms, amplitude, and whether it stands out."""
    band = settings(fs, native, fmin, fmax, window_s)
    if band is None:
        return samples.sparkSession.createDataFrame([], WINDOWS)
    fmax, n = band
    hop, df = n // 2, fs / n
    freqs = np.arange(n // 2 + 1) * df
    inside = np.flatnonzero((freqs >= fmin) & (freqs <= fmax))

    def strongest(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("place")
        v, t, place, block = g["v"].to_numpy(float), g["t"].to_numpy(float), g["place"].to_numpy(), int(g["block"].iloc[0])
        lows = np.arange(BLOCK) * hop
        lows = lows[lows + n <= len(v)]
        if not len(lows) or not len(inside):
            return pd.DataFrame(columns=[c.split(" ")[0] for c in WINDOWS.split(", ")])
        x = np.lib.stride_tricks.sliding_window_view(v, n)[lows].copy()
        skipped = np.isnan(x).mean(1) > 0.2
        x = filled(np.where(skipped[:, None], 0.0, x))
        mag = magnitudes(x)
        mean, std = x.mean(1), x.std(1)
        own = mag[:, inside]
        best = own.argmax(1)
        top, rows = inside[best], np.arange(len(x))
        amp = mag[rows, top]
        low, mid, high = (np.log(mag[rows, np.clip(top + j, 0, mag.shape[1] - 1)] + 1e-30) for j in (-1, 0, 1))
        bend = low - 2 * mid + high
        edge = (top == 0) | (top == mag.shape[1] - 1) | (bend == 0)
        delta = np.where(edge, 0.0, np.clip(0.5 * (low - high) / np.where(bend == 0, 1, bend), -0.5, 0.5))
        stands = amp / (np.median(own, axis=1) + 1e-30)
        pct = np.where(np.abs(mean) > 3 * std, 100 * amp / np.where(mean == 0, 1, np.abs(mean)), np.nan)
        hit = (stands >= prominence) & ~(pct < threshold_pct) & (best > 0) & ~skipped
        out = pd.DataFrame({"k": block * BLOCK + rows, "t": (t[lows] + t[lows + n - 1]) / 2, "freq_hz": np.clip((top + delta) * df, fmin, fmax), "amp": amp, "amp_pct": pct, "prominence": stands, "flagged": hit, "skipped": skipped})
        out.loc[skipped, ["freq_hz", "amp", "amp_pct", "prominence"]] = np.nan
        out.insert(0, "channel", g["channel"].iloc[0])
        out.insert(0, "run_id", g["run_id"].iloc[0])
        return out

    # Places count from each series' first sample: a series may be a part of a run.
    first = samples.groupBy(*KEYS).agg(F.min("seq").alias("first"))
    placed = samples.select(*KEYS, "seq", "t", "v").join(F.broadcast(first), KEYS).withColumn("place", F.col("seq") - F.col("first"))
    size = BLOCK * hop
    last = F.floor(F.col("place") / size)
    back = F.greatest(F.floor((F.col("place") - (n - hop)) / size), F.lit(0))
    dealt = placed.withColumn("block", F.explode(F.array_distinct(F.array(last, back)))).select(*KEYS, "block", "place", "t", "v")
    found = dealt.groupBy(*KEYS, "block").applyInPandas(strongest, WINDOWS)
    none = lambda c: F.nanvl(c, F.lit(None).cast("double")).alias(c)
    return found.select(*KEYS, "k", "t", *[none(c) for c in ("freq_hz", "amp", "amp_pct", "prominence")], "flagged", "skipped")


def detect(samples: DataFrame, fs: float, window_s: float = 0.1, min_windows: int = 3, **options) -> tuple[DataFrame, DataFrame]:
    """Events of at least min_windows neighbouring windows of nearly one frequency (each within tolerance of the last), and the shorter ones."""
    w = windows(samples, fs, window_s=window_s, **options)
    band = settings(fs, options.get("native"), options.get("fmin", 50.0), options.get("fmax", 2000.0), window_s)
    n = band[1] if band else max(round(window_s * fs), 16)
    df, hop_s = fs / n, (n // 2) / fs
    win, here = S.ordered(*KEYS, by="k"), S.Window.partitionBy(*KEYS)
    hot = w.withColumn("valid", F.count_if(~F.col("skipped")).over(here)).where("flagged")
    last = F.lag("freq_hz").over(win)
    breaks = (F.col("k") - F.lag("k").over(win) > 1) | (F.abs(F.col("freq_hz") - last) > F.greatest(F.lit(2 * df), 0.05 * last))
    runs = S.numbered_runs(hot, breaks, win).groupBy(*KEYS, "run").agg(
        (F.min("t") - hop_s / 2).alias("t_start"), (F.max("t") + hop_s / 2).alias("t_end"), F.percentile("freq_hz", F.lit(0.5)).alias("freq_hz"), F.max("amp").alias("peak_amp"),
        F.max_by("t", "amp").alias("t_peak"), F.count("*").alias("n_windows"), F.max("amp_pct").alias("peak_amp_pct"), F.avg("amp_pct").alias("mean_amp_pct"), F.first("valid").alias("valid"),
    ).drop("run").withColumn("duration_s", F.col("t_end") - F.col("t_start"))
    runs = runs.withColumn("need", F.greatest(F.lit(1), F.least(F.lit(min_windows), F.col("valid"))))
    return runs.where("n_windows >= need").drop("valid", "need"), runs.where("n_windows < need").drop("valid", "need")


def detect_both(samples: DataFrame, fs: float, window_s: float = 0.1, hold=lambda df: df, **options) -> DataFrame:
    """Events of short windows, and those of windows five times as long that no short one has at the same time within 5 % of frequency.
    hold may keep a small table that is read twice."""
    short, _ = detect(samples, fs, window_s, **options)
    short = hold(short)
    wide = max(0.5, 5 * window_s)
    span = samples.groupBy(*KEYS).agg((F.max("t") - F.min("t")).alias("span")).where(F.col("span") >= 4 * wide)
    long, _ = detect(samples.join(F.broadcast(span), KEYS, "left_semi"), fs, wide, **options)
    a, b = long.alias("a"), short.alias("b")
    same = (F.col("a.run_id") == F.col("b.run_id")) & (F.col("a.channel") == F.col("b.channel")) & (F.col("a.t_start") <= F.col("b.t_end")) & (F.col("b.t_start") <= F.col("a.t_end")) & (F.abs(F.col("a.freq_hz") - F.col("b.freq_hz")) <= 0.05 * F.col("b.freq_hz"))
    more = a.join(b, same, "left_anti")
    return short.withColumn("window_s", F.lit(window_s)).unionByName(more.withColumn("window_s", F.lit(wide)))


def before_ignition(events: DataFrame, quiet: DataFrame, fs: float) -> DataFrame:
    """events with pre_ignition_amp: the median, over windows of quiet (the samples before a firing), of the line at an event's
    frequency; NULL where quiet is shorter than two windows. events have window_s."""
    schema = "run_id string, channel string, t_start double, freq_hz double, pre_ignition_amp double"
    wanted = events.select(*KEYS, "t_start", "freq_hz", "window_s")

    def measure(known: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = known[["run_id", "channel", "t_start", "freq_hz"]].copy()
        v = own.sort_values("seq")["v"].to_numpy(float)
        amps = []
        for f, window_s in zip(known["freq_hz"], known["window_s"]):
            n = max(round(window_s * fs), 16)
            if len(v) < 2 * n:
                amps.append(np.nan)
                continue
            mag = magnitudes(filled(np.nan_to_num(np.lib.stride_tricks.sliding_window_view(v, n)[:: n // 2].copy(), nan=np.nan)))
            k = int(round(f / (fs / n)))
            amps.append(float(np.nanmedian(mag[:, max(k - 2, 0) : k + 3].max(1))))
        return out.assign(pre_ignition_amp=amps)

    found = wanted.groupBy(*KEYS).cogroup(quiet.select(*KEYS, "seq", "v").groupBy(*KEYS)).applyInPandas(measure, schema)
    found = found.withColumn("pre_ignition_amp", F.nanvl("pre_ignition_amp", F.lit(None).cast("double")))
    return events.join(found, [*KEYS, "t_start", "freq_hz"], "left")


def corroborated(events: DataFrame, samples: DataFrame, kinds: DataFrame, fs: float, **options) -> DataFrame:
    """For each event the first other channel (vibrations, then pressures) that shows an event of its frequency, within 5 %, inside its
    window: run_id, channel, t_start of the event, other, other_freq_hz."""
    others = kinds.where(F.col("kind").isin("vibration", "pressure")).select("channel", F.when(F.col("kind") == "vibration", 0).otherwise(1).alias("rank"))
    asked = events.select("run_id", F.col("channel").alias("of"), F.col("t_start").alias("e0"), F.col("t_end").alias("e1"), F.col("freq_hz").alias("f0"))
    near = samples.join(F.broadcast(others), "channel").join(F.broadcast(asked), "run_id").where((F.col("channel") != F.col("of")) & F.col("t").between(F.col("e0"), F.col("e1")))
    # Each event's window is a series of its own.
    part = near.withColumn("run_id", F.concat_ws("\u0001", "run_id", "of", F.col("e0").cast("string")))
    found, _ = detect(part.select(samples.columns), fs, **options)
    found = found.withColumn("key", F.split("run_id", "\u0001")).select(F.col("key")[0].alias("run_id"), F.col("key")[1].alias("of"), F.col("key")[2].cast("double").alias("e0"), F.col("channel").alias("other"), F.col("freq_hz").alias("other_freq_hz"))
    same = found.join(F.broadcast(asked), ["run_id", "of", "e0"]).join(F.broadcast(others.withColumnRenamed("channel", "other")), "other").where(F.abs(F.col("other_freq_hz") - F.col("f0")) < 0.05 * F.col("f0"))
    return same.groupBy("run_id", F.col("of").alias("channel"), F.col("e0").alias("t_start")).agg(F.min_by(F.struct("other", "other_freq_hz"), F.struct("rank", "other")).alias("x")).select("run_id", "channel", "t_start", "x.other", "x.other_freq_hz")
