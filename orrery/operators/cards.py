"""Analysis operators over samples (run_id, channel, seq, t, v) of many runs at once; fs is the runs' common sample rate.

All are lazy and native: windows by (run_id, channel), small tables of limits joined by channel.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sequence as S

KEYS = ["run_id", "channel"]
#: Frames of more rows are sorted outside the window operator; means over more than LONG rows come from running sums.
WIDE, LONG = 16, 64
#: What a unit's values can't go below, by physics.
PHYSICAL_MINIMUM = {"psi": -14.7, "bar": -1.013, "kPa": -101.3, "MPa": -0.1013, "Pa": -101325.0, "degC": -273.15, "C": -273.15, "K": 0.0, "degF": -459.67}


def plain_unit(unit: Column) -> Column:
    """In small letters, without spaces, degrees spelt out."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(unit)), "℃", "degc"), "°", "deg")


def describe_data(samples: DataFrame) -> DataFrame:
    return samples.groupBy(*KEYS).agg(F.count("*").alias("n_samples"), (F.max("t") - F.min("t")).alias("duration_s"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.count_if(F.col("v").isNull()).alias("nan_samples"))


def channel_stats(samples: DataFrame, t_start: float | None = None, t_end: float | None = None) -> DataFrame:
    """Bounds are inclusive, an absent one is open."""
    inside = samples.where((F.lit(True) if t_start is None else F.col("t") >= t_start) & (F.lit(True) if t_end is None else F.col("t") <= t_end))
    return inside.groupBy(*KEYS).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), (F.max("v") - F.min("v")).alias("ptp"), F.count("v").alias("n"))


def redline_runs(samples: DataFrame, redlines: DataFrame, fs: float, smoothing_s: float = 0.005) -> DataFrame:
    """Every excursion beyond a redline (channel, kind max or min, limit; with run_id those of single runs): decided on the smoothed, reported from the raw signal."""
    win = S.ordered(*KEYS)
    smooth = samples.withColumn("x", F.when(F.col("v").isNotNull(), S.roll_mean("v", win, max(int(smoothing_s * fs), 1))))
    held = smooth.join(F.broadcast(redlines), [c for c in KEYS if c in redlines.columns])
    over = F.when(F.col("kind") == "max", F.col("x") > F.col("limit")).otherwise(F.col("x") < F.col("limit"))
    sign = F.when(F.col("kind") == "max", F.col("v")).otherwise(-F.col("v"))
    found = S.islands(held, over, [*KEYS, "kind", "limit"], F.max_by(F.struct("v", "t"), F.struct(sign, -F.col("seq"))).alias("peak"))
    return found.select(*KEYS, "kind", "limit", "t_start", "t_end", (F.col("t_end") - F.col("t_start")).alias("duration_s"), "n", F.col("peak.v").alias("peak_value"), F.col("peak.t").alias("t_peak"), F.abs(F.col("peak.v") - F.col("limit")).alias("margin_exceeded"))


def check_redlines(samples: DataFrame, redlines: DataFrame, fs: float, persistence_s: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Violations that last, and for each channel how many excursions were too short."""
    least = max(round(persistence_s * fs), 1)
    runs = redline_runs(samples, redlines, fs)
    return runs.where(F.col("n") >= least), runs.where(F.col("n") < least).groupBy(*KEYS).agg(F.count("*").alias("suppressed"))


def mean_over(df: DataFrame, v: str, name: str, w: int, least: int = 1) -> DataFrame:
    return S.wide_mean(df, v, name, KEYS, w, least) if w > LONG else df.withColumn(name, S.roll_mean(v, S.ordered(*KEYS), w, least))


def smoothed(samples: DataFrame, fs: float, median_s: float, ahead: int | None = None) -> DataFrame:
    """xs: filled and averaged over 20 ms; xm: its running median; with ahead, span: largest less smallest xs of so many rows from each on."""
    win = S.ordered(*KEYS)
    df = mean_over(samples.withColumn("f", S.fill_linear("v", win)), "f", "xs", max(int(0.02 * fs), 1))
    w = max(int(median_s * fs), 1)
    if w > WIDE:
        return wide_median(df, "xs", "xm", w, ahead)
    df = df.withColumn("xm", S.roll_median("xs", win, w))
    if ahead is None:
        return df
    frame = win.rowsBetween(0, ahead - 1)
    return df.withColumn("span", F.when(F.count("xs").over(frame) == ahead, F.max("xs").over(frame) - F.min("xs").over(frame)))


def wide_median(df: DataFrame, v: str, name: str, w: int, ahead: int | None = None) -> DataFrame:
    """A centred running median over many rows: sorting each frame anew costs w a row, so series go to pandas, which updates it; so
    do the largest and smallest of the rows ahead."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq")
        g = g.assign(**{name: g[v].rolling(w, center=True, min_periods=1).median()})
        if ahead is not None:
            back = g[v].iloc[::-1].rolling(ahead, min_periods=ahead)
            g = g.assign(span=(back.max() - back.min()).iloc[::-1])
        return g

    more = [T.StructField(name, T.DoubleType()), *([T.StructField("span", T.DoubleType())] if ahead is not None else [])]
    out = df.groupBy(*KEYS).applyInPandas(one, T.StructType([*df.schema.fields, *more]))
    return out if ahead is None else out.withColumn("span", F.nanvl("span", F.lit(None).cast("double")))


def whole() -> S.WindowSpec:
    """All of a series: aggregates over it need no join back and no exchange of their own."""
    return S.Window.partitionBy(*KEYS)


def pulses(samples: DataFrame, fs: float, ahead: int | None = None) -> DataFrame:
    """Samples with xs and their channel's pulse: base, level, rise, clear."""
    w, df = whole(), smoothed(samples, fs, 0.2, ahead)
    df = df.withColumn("base", F.percentile("xm", F.lit(0.05)).over(w)).withColumn("top", F.max_by(F.struct("xm", "seq"), F.struct("xm", -F.col("seq"))).over(w))
    half = F.col("base") + 0.5 * (F.col("top.xm") - F.col("base"))
    off = ~F.coalesce(F.col("xm") > half, F.lit(False))
    df = df.withColumn("lo", F.max(F.when(off & (F.col("seq") < F.col("top.seq")), F.col("seq"))).over(w)).withColumn("hi", F.min(F.when(off & (F.col("seq") > F.col("top.seq")), F.col("seq"))).over(w))
    inside = (F.col("lo").isNull() | (F.col("seq") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("seq") < F.col("hi")))
    plateau = F.when(inside & (F.col("xs") > F.col("base") + 0.75 * (F.col("top.xm") - F.col("base"))), F.col("xs"))
    df = df.withColumn("level", F.coalesce(F.percentile(plateau, F.lit(0.5)).over(w), F.col("top.xm"))).withColumn("rise", F.col("level") - F.col("base"))
    clear = (F.col("rise") > 0) & (F.col("rise") >= 0.25 * F.greatest(F.abs("level"), F.abs("base")))
    return df.withColumn("clear", clear).drop("lo", "hi", "top")


def segment_phases(samples: DataFrame, fs: float) -> DataFrame:
    """For each channel: fired, levels, and the times where the phases begin and end."""
    w, n_set = whole(), max(int(0.2 * fs), 2)
    p = pulses(samples, fs, n_set)
    on, st = F.col("base") + 0.1 * F.col("rise"), F.col("base") + 0.9 * F.col("rise")
    p = p.withColumn("low", F.col("xs") < on).withColumn("still", F.coalesce(F.col("span") < 0.02 * F.col("rise"), F.lit(False)))
    steady = F.when(F.col("xs") > st, F.col("seq"))
    p = p.withColumn("i0", F.min(steady).over(w)).withColumn("i1", F.max(steady).over(w))
    row = lambda cond, pick, more=0: pick(F.when(cond, F.col("seq") + more))
    found = p.groupBy(*KEYS).agg(
        F.first("base").alias("baseline"), F.first("level").alias("steady_level"), F.first("clear").alias("clear"), F.first("i0").alias("i0"), F.first("i1").alias("i1"),
        F.max("seq").alias("s1"), F.coalesce(row(F.col("low") & (F.col("seq") < F.col("i0")), F.max, 1), F.min("seq")).alias("ign"),
        row(F.col("low") & (F.col("seq") >= F.col("i1")), F.min).alias("below"), row(F.col("still") & (F.col("seq") >= F.col("i1")), F.min).alias("settled"),
        F.max_by("xs", "seq").alias("x_end"), F.first("rise").alias("rise"),
    )
    fired = F.col("clear") & F.col("i0").isNotNull()
    tail = F.coalesce("below", "settled", "s1")
    by = F.when(F.col("below").isNotNull(), "below_on_frac").when(F.col("settled").isNotNull(), "settled_above_threshold").otherwise("end_of_record")
    cut = (F.col("x_end") > F.col("baseline") + 0.1 * F.col("rise")) & ((by == "end_of_record") | (F.col("i1") >= F.col("s1") + 1 - max(int(0.5 * fs), 2)))
    when = lambda c: F.when(fired, c)
    return found.select(
        *KEYS, fired.alias("fired"), "baseline", "steady_level", when(F.col("ign")).alias("i_ignition"), when(F.col("i0")).alias("i_mainstage"), when(F.col("i1")).alias("i_shutdown"),
        when(tail).alias("i_tail"), when(by).alias("tail_off_end_by"), F.coalesce(when(cut), F.lit(False)).alias("record_ends_during_firing"),
    )


def run_phases(samples: DataFrame, kinds: DataFrame, fs: float, segments: DataFrame | None = None) -> DataFrame:
    """One row for each run: the phases of its firing in seconds, seen on its primary pressure (Pc, else the pressure that reaches highest),
    or where that has no clear pulse, on the first force, then pressure, that has one (fallback_from says instead of which).

    kinds: channel, kind. segments: segment_phases() of these channels, if it is known. Runs without any pressure or force channel have no row.
    """
    wanted = F.broadcast(kinds.where(F.col("kind").isin("pressure", "force")).select("channel", "kind").distinct())
    own = samples.join(wanted, "channel")
    seg = segments if segments is not None else segment_phases(own.select(samples.columns), fs)
    about = own.groupBy(*KEYS).agg(F.first("kind").alias("kind"), F.max("v").alias("top"), F.max("t").alias("record_end_s"), F.max_by("v", "seq").alias("value_at_record_end"))
    both = seg.join(about, KEYS)
    primary = F.min(F.when(F.col("kind") == "pressure", F.struct((F.col("channel") != "Pc").alias("other"), (-F.col("top")).alias("low"), "channel"))).over(S.Window.partitionBy("run_id"))
    both = both.withColumn("primary", F.coalesce(primary["channel"], F.min("channel").over(S.Window.partitionBy("run_id"))))
    rank = F.when(F.col("channel") == F.col("primary"), F.when(F.col("fired"), 0).otherwise(3)).when(F.col("fired") & (F.col("kind") == "force"), 1).when(F.col("fired"), 2).otherwise(4)
    best = both.withColumn("rank", rank).groupBy("run_id").agg(F.min_by(F.struct(*both.columns), F.struct("rank", "channel")).alias("x")).select("x.*")
    places = {"ignition_s": "i_ignition", "mainstage_start_s": "i_mainstage", "mainstage_end_s": "i_shutdown", "tail_off_end_s": "i_tail"}
    at = best.select("run_id", "channel", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(i).alias("seq")) for n, i in places.items()]))).where("seq IS NOT NULL")
    times = samples.join(F.broadcast(at), [*KEYS, "seq"]).groupBy("run_id").agg(*[F.max(F.when(F.col("name") == n, F.col("t"))).alias(n) for n in places])
    out = best.join(times, "run_id", "left").withColumn("fallback_from", F.when(F.col("channel") != F.col("primary"), F.col("primary")))
    return out.select("run_id", "channel", "fallback_from", "fired", "steady_level", "baseline", "record_ends_during_firing", "record_end_s", "value_at_record_end", *places, "tail_off_end_by", (F.col("mainstage_end_s") - F.col("mainstage_start_s")).alias("mainstage_duration_s"))


def phase_windows(phases: DataFrame) -> DataFrame:
    """(run_id, phase, t_lo, t_hi) of run_phases(): pre_test, startup, mainstage, shutdown, post_test, or no_firing over everything."""
    edges = [("pre_test", F.lit(float("-inf")), "ignition_s"), ("startup", "ignition_s", "mainstage_start_s"), ("mainstage", "mainstage_start_s", "mainstage_end_s"), ("shutdown", "mainstage_end_s", "tail_off_end_s"), ("post_test", "tail_off_end_s", F.lit(float("inf")))]
    one = lambda name, a, b: F.struct(F.lit(name).alias("phase"), (F.col(a) if isinstance(a, str) else a).alias("t_lo"), (F.col(b) if isinstance(b, str) else b).alias("t_hi"))
    five = F.array(*[one(*e) for e in edges])
    return phases.select("run_id", F.inline(F.when(F.col("fired"), five).otherwise(F.array(one("no_firing", F.lit(float("-inf")), F.lit(float("inf")))))))


def windowed(samples: DataFrame, phases: DataFrame | None = None, phase: str | None = None, t_start: float | None = None, t_end: float | None = None) -> DataFrame:
    """The samples inside a window: of a phase, or between times (inclusive, an absent one is open). Runs that lack the phase have none."""
    out = samples
    if phase is not None and phases is not None:
        own = phase_windows(phases).where(F.col("phase") == phase).drop("phase")
        out = out.join(F.broadcast(own), "run_id").where(F.col("t").between(F.col("t_lo"), F.col("t_hi"))).select(samples.columns)
    if t_start is not None:
        out = out.where(F.col("t") >= t_start)
    return out if t_end is None else out.where(F.col("t") <= t_end)


def phase_table(segments: DataFrame) -> DataFrame:
    """(run_id, channel, name, i_start, i_stop) of the five phases, or one no_firing."""
    names = [("pre_test", F.lit(0).cast("long"), F.col("i_ignition")), ("startup", F.col("i_ignition"), F.col("i_mainstage")), ("mainstage", F.col("i_mainstage"), F.col("i_shutdown")), ("shutdown", F.col("i_shutdown"), F.col("i_tail")), ("post_test", F.col("i_tail"), F.lit(None).cast("long"))]
    five = F.array(*[F.struct(F.lit(n).alias("name"), a.alias("i_start"), b.alias("i_stop")) for n, a, b in names])
    none = F.array(F.struct(F.lit("no_firing").alias("name"), F.lit(0).cast("long").alias("i_start"), F.lit(None).cast("long").alias("i_stop")))
    return segments.select(*KEYS, F.inline(F.when(F.col("fired"), five).otherwise(none)))


def pulse_metrics(samples: DataFrame, fs: float, start_pct: float = 10, end_pct: float = 10, subtract_baseline: bool = True) -> DataFrame:
    """Baseline, peak, window of the pulse, and its integral by trapezoids."""
    w, df = whole(), smoothed(samples, fs, 0.1)
    seq, col = F.col("seq"), F.col
    df = df.withColumn("r", F.max_by(F.struct("seq", "xm"), F.struct("xm", -seq)).over(w)).withColumn("i_ref", col("r.seq"))
    df = df.withColumn("i_pre", F.coalesce(F.max(F.when((seq < col("i_ref")) & (col("xm") < 0.5 * col("r.xm")), seq)).over(w), F.min("seq").over(w)))
    df = df.withColumn("t_pre", F.max(F.when(seq == col("i_pre"), col("t"))).over(w))
    quiet = F.when((col("t") >= col("t_pre") - 1.5) & (col("t") < col("t_pre") - 0.5), col("f"))
    df = df.withColumn("baseline", F.coalesce(F.percentile(quiet, F.lit(0.5)).over(w), F.lit(0.0)) if subtract_baseline else F.lit(0.0))
    df = df.withColumn("y", col("f") - col("baseline")).withColumn("ys", col("xs") - col("baseline")).withColumn("sustained", col("r.xm") - col("baseline"))

    def window(df: DataFrame, level: str, centre: str, names: tuple[str, str]) -> DataFrame:
        low = lambda pct: col("ys") < pct / 100 * col(level)
        df = df.withColumn(names[0], F.coalesce(F.max(F.when(low(start_pct) & (seq <= col(centre)), seq + 1)).over(w), F.min("seq").over(w)))
        return df.withColumn(names[1], F.coalesce(F.min(F.when(low(end_pct) & (seq >= col(centre)), seq - 1)).over(w), F.max("seq").over(w)))

    df = window(df, "sustained", "i_ref", ("a0", "a1"))
    inside = seq.between(col("a0"), col("a1"))
    df = df.withColumn("p", F.max_by(F.when(inside, F.struct("seq", "ys")), F.when(inside, F.struct(col("xs"), -seq))).over(w)).withColumn("i_pk", col("p.seq")).withColumn("ys_pk", col("p.ys"))
    df = window(df.where(col("i_pk").isNotNull()).withColumn("spiky", col("ys_pk") > 1.5 * col("sustained")), "ys_pk", "i_pk", ("b0", "b1"))
    a, b = F.when(col("spiky"), col("a0")).otherwise(col("b0")), F.when(col("spiky"), col("a1")).otherwise(col("b1"))
    ordered = S.ordered(*KEYS)
    kept = df.where(seq.between(a, b)).withColumn("area", (col("y") + F.lag("y").over(ordered)) / 2 * (col("t") - F.lag("t").over(ordered)))
    return kept.groupBy(*KEYS).agg(
        F.first("baseline").alias("baseline"), F.max(F.when(seq == col("i_pk"), col("y"))).alias("peak"), F.max(F.when(seq == col("i_pk"), col("t"))).alias("t_peak"),
        F.first("sustained").alias("peak_sustained"), F.first("spiky").alias("peak_is_short_spike"), F.min("t").alias("t_start"), F.max("t").alias("t_end"),
        (F.max("t") - F.min("t")).alias("action_time_s"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("integral"), F.count_if(col("v").isNull()).alias("nan_samples_interpolated"),
    ).withColumn("mean_over_action_time", F.try_divide("integral", "action_time_s"))


def deviations(samples: DataFrame, reference: DataFrame, fs: float) -> DataFrame:
    """Samples with the interpolated reference r, dev, dev_pct (of the reference's mean size) and roll (its 0.2 s mean)."""
    df = S.interpolated(samples, reference, KEYS).withColumn("dev", F.col("v") - F.col("r"))
    scale = F.avg(F.when(F.col("dev").isNotNull(), F.abs("r"))).over(whole())
    df = df.withColumn("scale", F.when(scale == 0, 1.0).otherwise(scale))
    df = df.withColumn("dev_pct", 100 * F.col("dev") / F.col("scale"))
    w = max(int(0.2 * fs), 1)
    return mean_over(df, "dev_pct", "roll", w, max(w // 2, 1))


def compare_reference(samples: DataFrame, reference: DataFrame, fs: float, tolerance_pct: float = 2.0, least_s: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """A summary for each channel, and the intervals of sustained deviation."""
    df = deviations(samples, reference, fs)
    runs = S.islands(df, F.abs("roll") > tolerance_pct, KEYS, F.avg("dev_pct").alias("mean_dev_pct"), F.max_by("dev_pct", F.struct(F.abs("dev_pct"), -F.col("seq"))).alias("peak_dev_pct"))
    runs = runs.withColumn("duration_s", F.col("t_end") - F.col("t_start")).where(F.col("duration_s") >= least_s)
    known = df.where(F.col("dev").isNotNull())
    summary = known.groupBy(*KEYS).agg(F.avg("v").alias("mean_measured"), F.avg("r").alias("mean_reference"), F.avg("dev").alias("mean_dev"), F.avg("dev_pct").alias("mean_dev_pct"), F.sqrt(F.avg(F.col("dev") * F.col("dev"))).alias("rmse"), F.max_by(F.struct(F.abs("dev").alias("d"), "t"), F.struct(F.abs("dev"), -F.col("seq"))).alias("m"))
    counts = runs.groupBy(*KEYS).agg(F.count("*").alias("n_intervals"))
    out = summary.join(counts, KEYS, "left").withColumn("n_intervals", F.coalesce("n_intervals", F.lit(0)))
    within = (F.col("n_intervals") == 0) & (F.abs("mean_dev_pct") <= tolerance_pct)
    return out.select(*KEYS, "mean_measured", "mean_reference", "mean_dev", "mean_dev_pct", "rmse", F.col("m.d").alias("max_abs_dev"), F.col("m.t").alias("t_max_abs_dev"), "n_intervals", within.alias("within_tolerance")), runs


def command_edges(samples: DataFrame) -> DataFrame:
    """Switches of command channels by more than half: (run_id, channel, seq, t, edge)."""
    d = F.col("v") - F.lag("v").over(S.ordered(*KEYS))
    return samples.withColumn("d", d).where(F.abs("d") > 0.5).select(*KEYS, "seq", "t", F.when(F.col("d") > 0, "open").otherwise("close").alias("edge"))


def valve_response(samples: DataFrame, pairs: DataFrame, fs: float) -> DataFrame:
    """For each switch of a command, how long its response takes to leave its noise. pairs: command, response, max_latency_ms."""
    edges = command_edges(samples.join(F.broadcast(pairs.select(F.col("command").alias("channel")).distinct()), "channel", "left_semi"))
    edges = edges.join(F.broadcast(pairs), F.col("channel") == F.col("command")).select("run_id", "command", "response", "max_latency_ms", F.col("seq").alias("i_cmd"), F.col("t").alias("t_cmd"), "edge")
    answers = samples.join(F.broadcast(pairs.select(F.col("response").alias("channel")).distinct()), "channel", "left_semi").withColumn("f", S.fill_linear("v", S.ordered(*KEYS)))
    spread = answers.groupBy(*KEYS).agg((F.percentile("v", F.lit(0.99)) - F.percentile("v", F.lit(0.01))).alias("spread")).withColumnRenamed("channel", "response")
    before, search = int(0.05 * fs), int(0.5 * fs)
    near = edges.join(answers.select("run_id", F.col("channel").alias("response"), "seq", "t", "f"), ["run_id", "response"]).where((F.col("seq") >= F.col("i_cmd") - before) & (F.col("seq") < F.col("i_cmd") + search))
    own = ["run_id", "command", "response", "i_cmd", "t_cmd", "edge", "max_latency_ms"]
    quiet = near.where(F.col("seq") < F.col("i_cmd")).groupBy("run_id", "command", "response", "i_cmd").agg(F.percentile("f", F.lit(0.5)).alias("baseline"), F.when(F.count("f") > 3, F.stddev_pop("f")).otherwise(0.0).alias("noise"))
    held = near.join(quiet, ["run_id", "command", "response", "i_cmd"], "left").join(spread, ["run_id", "response"])
    held = held.withColumn("threshold", F.greatest(8 * F.col("noise"), 0.03 * F.col("spread")))
    moved = F.when(F.col("edge") == "open", F.col("f") > F.col("baseline") + F.col("threshold")).otherwise(F.col("f") < F.col("baseline") - F.col("threshold"))
    out = held.groupBy(*own).agg(F.min(F.when(moved & (F.col("seq") >= F.col("i_cmd")), F.col("seq"))).alias("i_response"), F.first("threshold").alias("detection_threshold"))
    latency = (F.col("i_response") - F.col("i_cmd")) / fs * 1000
    out = out.withColumn("t_response", F.col("t_cmd") + (F.col("i_response") - F.col("i_cmd")) / fs)
    exceeds = F.col("max_latency_ms").isNotNull() & (F.col("i_response").isNull() | (latency > F.col("max_latency_ms")))
    return out.withColumn("latency_ms", latency).withColumn("exceeds_limit", exceeds)


def thrust_pressure_ratio(samples: DataFrame, thrust: str, pressure: str, fs: float, max_change_pct: float = 50, phases: DataFrame | None = None) -> DataFrame:
    """How the ratio of two channels' pulses drifts over quarter-second windows of steady burning. With phases (run_phases()) also within mainstage."""
    p = pulses(samples.where(F.col("channel").isin(thrust, pressure)), fs)
    pick = lambda ch, n: p.where(F.col("channel") == ch).select("run_id", "seq", "t", (F.col("xs") - F.col("base")).alias(n), F.col("rise").alias(f"rise_{n}"), F.col("clear").alias(f"clear_{n}"))
    both = pick(thrust, "f").join(pick(pressure, "p").drop("t"), ["run_id", "seq"])
    n = max(int(0.25 * fs), 2)
    both = both.withColumn("k", F.floor(F.col("seq") / n)).withColumn("j", F.col("seq") % n)
    burning = F.when((F.col("f") > 0.5 * F.col("rise_f")) & (F.col("p") > 0.25 * F.col("rise_p")), 1.0).otherwise(0.0)
    q = max(n // 4, 1)
    w = both.groupBy("run_id", "k").agg(
        F.count("*").alias("n"), F.avg(burning).alias("on"), F.percentile(F.when(F.col("j") < q, F.col("p")), F.lit(0.5)).alias("p0"), F.percentile(F.when(F.col("j") >= n - q, F.col("p")), F.lit(0.5)).alias("p1"),
        F.percentile("p", F.lit(0.5)).alias("pm"), F.percentile(F.try_divide("f", "p"), F.lit(0.5)).alias("ratio"), F.avg("t").alias("t"), F.min(F.col("clear_f") & F.col("clear_p")).alias("clear"),
    )
    kept = w.where((F.col("n") == n) & (F.col("on") > 0.9) & (F.abs(F.col("p1") - F.col("p0")) <= 0.15 * F.col("pm")) & F.col("clear"))
    main = F.lit(True)
    if phases is not None:
        kept = kept.join(F.broadcast(phases.select("run_id", "mainstage_start_s", "mainstage_end_s")), "run_id", "left")
        main = F.col("t").between(F.col("mainstage_start_s"), F.col("mainstage_end_s"))
    half = n / fs / 2
    inner = F.when(main, F.col("ratio"))
    out = kept.groupBy("run_id").agg(
        F.count("*").alias("n_windows"), F.min_by("ratio", "t").alias("ratio_start"), F.max_by("ratio", "t").alias("ratio_end"), F.min("ratio").alias("ratio_min"), F.max("ratio").alias("ratio_max"),
        F.min_by("t", "ratio").alias("t_ratio_min"), F.max_by("t", "ratio").alias("t_ratio_max"), F.min("t").alias("t_first"), F.max("t").alias("t_last"), (F.min("t") - half).alias("t_start"), (F.max("t") + half).alias("t_end"),
        F.when(F.count(inner) >= 3, 100 * (F.max(inner) / F.nullif(F.min(inner), F.lit(0.0)) - 1)).alias("mainstage_change_pct"),
    )
    change = F.when(F.col("ratio_min") <= 0, F.lit(float("inf"))).otherwise(100 * (F.col("ratio_max") / F.nullif("ratio_min", F.lit(0.0)) - 1))
    return out.withColumn("applicable", F.col("n_windows") >= 3).withColumn("change_pct", change).withColumn("consistent", ~F.col("applicable") | (change <= max_change_pct))


# ---- sensor health


def gap_runs(samples: DataFrame) -> DataFrame:
    return S.islands(samples, F.col("v").isNull(), KEYS)


def gap_issues(samples: DataFrame, most: int = 3) -> DataFrame:
    """nan_gap for each gap of channels with few of them, one recurring_nan_gaps for others; one for the run where gaps are all shared."""
    g = gap_runs(samples)
    summary = g.withColumn("d", F.col("t_start") - F.lag("t_start").over(S.ordered(*KEYS, by="t_start"))).groupBy(*KEYS).agg(F.count("*").alias("count"), F.sum("n").alias("total"), F.max("n").alias("longest"), F.percentile("d", F.lit(0.5)).alias("median_interval_s"))
    n_channels = samples.groupBy("run_id").agg(F.count_distinct("channel").alias("channels"))
    missing = samples.where(F.col("v").isNull()).groupBy("run_id", "seq").agg(F.count("*").alias("together"))
    own = samples.where(F.col("v").isNull()).join(missing, ["run_id", "seq"]).join(n_channels, "run_id")
    shared = own.groupBy(*KEYS).agg((F.min(F.col("together") == F.col("channels")) & (F.first("channels") > 1)).alias("all_shared"))
    many = summary.join(shared, KEYS).where(F.col("count") > most)
    run_level = many.where("all_shared").groupBy("run_id").agg(F.lit(None).cast("string").alias("channel"), F.sort_array(F.collect_set("channel")).alias("channels"), F.first("count").alias("count"), F.first("total").alias("total"), F.first("longest").alias("longest"), F.first("median_interval_s").alias("median_interval_s"))
    few = g.join(summary.where(F.col("count") <= most).select(*KEYS), KEYS, "left_semi").select(*KEYS, F.lit("nan_gap").alias("kind"), "t_start", "t_end", F.col("n").alias("total"))
    out = few.unionByName(many.where(~F.col("all_shared")).select(*KEYS, F.lit("recurring_nan_gaps").alias("kind"), "count", "total", "longest", "median_interval_s"), allowMissingColumns=True)
    return out.unionByName(run_level.withColumn("kind", F.lit("recurring_nan_gaps")), allowMissingColumns=True)


def dead_channels(samples: DataFrame) -> DataFrame:
    return samples.groupBy(*KEYS).agg(F.min("v").alias("value"), F.max("v").alias("top")).where("value = top").select(*KEYS, "value")


def impossible_values(samples: DataFrame, units: DataFrame, fs: float) -> DataFrame:
    """Channels (units: channel, unit) that lie below what their unit allows, by 1 % more, for half a second in all."""
    low = F.create_map(*[x for u, limit in PHYSICAL_MINIMUM.items() for x in (F.lit(u.lower()), F.lit(limit))])
    known = units.select("channel", low[plain_unit(F.col("unit"))].alias("physical_limit")).where("physical_limit IS NOT NULL")
    df = samples.join(F.broadcast(known), "channel")
    margin = F.col("physical_limit") - 0.01 * F.greatest(F.abs("physical_limit"), F.lit(1.0))
    return df.groupBy(*KEYS, "physical_limit").agg(F.count_if(F.col("v") < margin).alias("n_below"), F.min("v").alias("min_value"), F.percentile("v", F.lit(0.5)).alias("median_value"), F.count("*").alias("n"), F.min("t").alias("t_start"), F.max("t").alias("t_end")).where(F.col("n_below") >= 0.5 * fs).withColumn("share_of_record_pct", 100 * F.col("n_below") / F.col("n"))


def flatlines(samples: DataFrame, fs: float, native: float | None = None, merge_s: float = 0.1, firing: DataFrame | None = None) -> DataFrame:
    """Runs of one value, long enough for the channel's native rate; runs of the same value less than merge_s apart are one.

    firing (run_id, fire_start, fire_end): of runs that fired, only what overlaps the firing long enough counts. at_channel_max and
    at_channel_min say that the value is the channel's extreme, channel_max and channel_min which.
    """
    win = S.ordered(*KEYS)
    least = max(int(0.05 * fs), -int(-3 * fs // (native or fs)), 3)
    b = samples.withColumn("b", S.bridge("v", win, max(int(0.1 * fs), 1)))
    b = b.withColumn("high", F.max("v").over(whole())).withColumn("low", F.min("v").over(whole()))
    runs = S.islands(b.withColumn("same", F.col("b") == F.lag("b").over(win)), F.col("same"), KEYS, F.first("b").alias("value"), F.first("high").alias("high"), F.first("low").alias("low"))
    runs = runs.where(F.col("n") + 1 >= least).withColumn("t_start", F.col("t_start") - 1 / fs)
    if firing is not None:
        runs = runs.join(F.broadcast(firing.select("run_id", "fire_start", "fire_end")), "run_id", "left")
        overlap = F.least("t_end", "fire_end") - F.greatest("t_start", "fire_start")
        runs = runs.where(F.col("fire_start").isNull() | (overlap >= least / fs))
    again = S.ordered(*KEYS, by="t_start")
    parts = S.numbered_runs(runs, (F.col("value") != F.lag("value").over(again)) | (F.col("t_start") - F.lag("t_end").over(again) >= merge_s), again)
    out = parts.groupBy(*KEYS, "run").agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.first("value").alias("stuck_value"), F.first("high").alias("high"), F.first("low").alias("low")).drop("run")
    top, bottom = F.col("stuck_value") == F.col("high"), F.col("stuck_value") == F.col("low")
    extremes = [top.alias("at_channel_max"), bottom.alias("at_channel_min"), F.when(top, F.col("high")).alias("channel_max"), F.when(bottom, F.col("low")).alias("channel_min")]
    return out.select(*KEYS, "t_start", "t_end", "stuck_value", (F.col("t_end") - F.col("t_start")).alias("duration_s"), *extremes)


def spikes(samples: DataFrame, fs: float, native: float | None = None, sigmas: float = 12.0) -> DataFrame:
    """Out-and-back outliers of a median filter's residual: (run_id, channel, seq, t, value, local_median, deviation, sigmas)."""
    win, k = S.ordered(*KEYS), max(round(fs / (native or fs)), 1)
    fk = fs / k
    df = samples.withColumn("f", S.fill_linear("v", win)).where(F.col("seq") % k == 0).withColumn("seq", F.floor(F.col("seq") / k).cast("long"))
    df = df.withColumn("med", S.median_filter("f", win, 11)).withColumn("res", F.abs(F.col("f") - F.col("med")))
    df = df.withColumn("whole", 1.4826 * F.percentile(F.when(F.col("res") > 0, F.col("res")), F.lit(0.5)).over(whole()))
    w = max(int(0.05 * fk), 11)
    # Sorting each of many wide frames anew costs their width: such series are taken whole, once.
    df = df.withColumn("mid", S.roll_median("res", win, w)) if w <= WIDE else wide_median(df, "res", "mid", w)
    df = df.withColumn("local", 1.4826 * F.col("mid"))
    df = df.withColumn("sigma", F.greatest("local", F.coalesce("whole", F.lit(0.0)), F.lit(1e-12)))
    near_gap = S.dilated(F.col("v").isNull(), win, int(0.01 * fk))
    df = df.withColumn("hot", (F.col("res") > sigmas * F.col("sigma")) & ~near_gap).withColumn("b", F.lag("f").over(win)).withColumn("a", F.lead("f").over(win))
    hot = df.where("hot")
    groups = S.numbered_runs(hot, F.col("seq") - F.lag("seq").over(win) > int(0.005 * fk) + 1, win)
    best = groups.groupBy(*KEYS, "run").agg(
        (F.max("seq") - F.min("seq") + 1).alias("width"), F.max_by(F.struct("seq", "t", "f", "med", "res", "sigma"), F.struct("res", -F.col("seq"))).alias("x"),
        F.min_by(F.struct("b"), "seq")["b"].alias("b"), F.max_by(F.struct("a"), "seq")["a"].alias("a"),
    )
    x = lambda c: F.col(f"x.{c}")
    # What stands before and after the whole spike lies on one side of it, and far enough; at the record's ends there is nothing to ask.
    side = (x("f") > F.col("a")) & (x("f") > F.col("b")) | (x("f") < F.col("a")) & (x("f") < F.col("b"))
    back = F.abs(x("f") - (F.col("a") + F.col("b")) / 2) >= 0.5 * x("res")
    edge = F.col("a").isNull() | F.col("b").isNull()
    return best.where((F.col("width") <= 5) & (edge | (side & back))).select(*KEYS, x("seq").alias("seq"), x("t").alias("t"), x("f").alias("value"), x("med").alias("local_median"), (x("f") - x("med")).alias("deviation"), (x("res") / x("sigma")).alias("sigmas"))


def coincident_hits(found: DataFrame, families: DataFrame, reach: float = 0.02) -> DataFrame:
    """(run_id, channel, t) of spikes within reach seconds of one on another family of sensors."""
    tagged = found.join(F.broadcast(families), "channel")
    slot = F.floor(F.col("t") / reach)
    a = tagged.withColumn("slot", slot)
    b = tagged.select("run_id", F.col("t").alias("t2"), F.col("family").alias("family2"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"))
    return a.join(b, ["run_id", "slot"]).where((F.abs(F.col("t") - F.col("t2")) <= reach) & (F.col("family") != F.col("family2"))).select("run_id", "channel", "t").distinct()


def coincident(found: DataFrame, families: DataFrame, reach: float = 0.02) -> DataFrame:
    """Those spikes in clusters: (run_id, cluster, t_start, t_end, channels, n)."""
    hit = coincident_hits(found, families, reach)
    win = S.Window.partitionBy("run_id").orderBy("t", "channel")
    return S.numbered_runs(hit, F.col("t") - F.lag("t").over(win) > reach, win, "cluster").groupBy("run_id", "cluster").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.array_join(F.sort_array(F.collect_set("channel")), ",").alias("channels"), F.count("*").alias("n"))


def duplicate_channels(samples: DataFrame) -> DataFrame:
    """Channels of identical samples, gaps included, that aren't constant: alike by two digests of all (seq, value), then compared value by value with the first of them."""
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), "seq", "v").cast("decimal(38,0)"))
    d = samples.groupBy(*KEYS).agg(part(1).alias("d1"), part(2).alias("d2"), F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo < hi")
    alike = d.groupBy("run_id", "d1", "d2", "n").agg(F.sort_array(F.collect_list("channel")).alias("channels")).where(F.size("channels") > 1)
    pairs = alike.select("run_id", F.col("channels")[0].alias("lead"), F.explode(F.slice("channels", 2, F.size("channels"))).alias("channel"))
    own = samples.select(*KEYS, "seq", "v").join(F.broadcast(pairs), KEYS)
    lead = samples.select("run_id", F.col("channel").alias("lead"), "seq", F.col("v").alias("u")).join(F.broadcast(pairs.select("run_id", "lead").distinct()), ["run_id", "lead"], "left_semi")
    same = own.join(lead, ["run_id", "lead", "seq"], "left").groupBy("run_id", "lead", "channel").agg(F.bool_and(F.col("v").eqNullSafe(F.col("u"))).alias("same")).where("same")
    return same.groupBy("run_id", "lead").agg(F.sort_array(F.collect_list("channel")).alias("rest")).select("run_id", F.concat(F.array("lead"), "rest").alias("channels"), (F.size("rest") + 1).alias("n_channels"))


def no_return_to_baseline(samples: DataFrame, segments: DataFrame, fs: float, share: float = 0.25) -> DataFrame:
    """Channels whose median after the pulse stays above that before it by more than share of their rise."""
    s = segments.where("fired").select(*KEYS, "i_ignition", "i_shutdown", "i_tail", "steady_level", F.col("baseline").alias("low"))
    df = samples.join(s, KEYS)
    before, after = F.col("seq") < F.col("i_ignition"), F.col("seq") > F.greatest(F.col("i_shutdown") + int(fs), F.col("i_tail"))
    m = df.groupBy(*KEYS, "steady_level", "low").agg(F.percentile(F.when(before, F.col("v")), F.lit(0.5)).alias("baseline"), F.percentile(F.when(after, F.col("v")), F.lit(0.5)).alias("post_level"), F.count(F.when(before, F.col("v"))).alias("n0"), F.count(F.when(after, F.col("v"))).alias("n1"))
    offset = 100 * (F.col("post_level") - F.col("baseline")) / (F.col("steady_level") - F.col("low"))
    return m.where((F.col("n0") >= 0.5 * fs) & (F.col("n1") >= 0.5 * fs)).withColumn("offset_of_steady_pct", offset).where(F.col("offset_of_steady_pct") > 100 * share).drop("n0", "n1", "low")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "warning", 1).otherwise(2)
