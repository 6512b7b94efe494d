"""Analysis operators on closed-form signals, and sequence algebra against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from orrery.functions import sequence as S
from orrery.operators import cards


def samples(spark, channels, fs, run="r"):
    rows = [(run, c, i, i / fs, None if v is None else float(v)) for c, vs in channels.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "run_id string, channel string, seq long, t double, v double")


def series(n=200, seed=1, gaps=0.2):
    r = random.Random(seed)
    return [None if r.random() < gaps else r.uniform(-5, 5) for _ in range(n)]


@pytest.mark.parametrize("w", [10, 11])
def test_rolling(spark, w):
    v = series()
    win = S.ordered("run_id", "channel")
    rows = samples(spark, {"a": v}, 1).select("seq", S.roll_mean("v", win, w, 4).alias("m"), S.roll_median("v", win, w).alias("d"), S.trailing_range("v", win, 3).alias("r")).orderBy("seq").collect()
    for i, row in enumerate(rows):
        near = sorted(x for x in v[max(0, i - w // 2) : i + (w - 1) // 2 + 1] if x is not None)
        assert row.m == (pytest.approx(sum(near) / len(near)) if len(near) >= 4 else None)
        assert row.d == pytest.approx((near[(len(near) - 1) // 2] + near[len(near) // 2]) / 2)
        last = v[i - 2 : i + 1] if i >= 2 else []
        assert row.r == (pytest.approx(max(last) - min(last)) if last and None not in last else None)


def test_halo_gives_what_whole_series_do(spark):
    s = samples(spark, {"a": series(), "b": series(seed=2)}, 1)
    one = s.withColumn("m", S.roll_mean("v", S.ordered("channel"), 9)).select("channel", "seq", "m").collect()
    parts = S.halo(s, ["channel"], 4, 16).withColumn("m", S.roll_mean("v", S.ordered("channel", "bucket"), 9)).where("own").select("channel", "seq", "m").collect()
    assert sorted(one) == sorted(parts)


def test_filling(spark):
    v = [None, 1, None, None, None, 5, None]
    win = S.ordered("run_id", "channel")
    rows = samples(spark, {"a": v}, 1).select("seq", S.fill_linear("v", win).alias("f"), S.bridge("v", win, 2).alias("b")).orderBy("seq").collect()
    assert [r.f for r in rows] == [1, 1, 2, 3, 4, 5, 5] and [r.b for r in rows] == [None, 1, 2, 3, None, 5, None]


def test_interpolation_and_islands(spark):
    ref = samples(spark, {"a": [0, 10, None, 30]}, 1)
    at = spark.createDataFrame([("r", "a", t) for t in (-1.0, 0.0, 0.5, 2.0, 9.0)], "run_id string, channel string, t double")
    assert [r.r for r in S.interpolated(at, ref, ["run_id", "channel"]).orderBy("t").collect()] == [0, 0, 5, 20, 30]
    found = S.islands(samples(spark, {"a": [1, 1, 0, None, 1, 0, 1]}, 1), F.col("v") > 0, ["channel"]).orderBy("start").collect()
    assert [(r.start, r.stop, r.n) for r in found] == [(0, 2, 2), (4, 5, 1), (6, 7, 1)]


def test_significant(spark):
    xs = [0.0, 123456.789, -0.00012345678, 1e-30, 999999.9]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select(S.significant(F.col("x")).alias("y")).collect()
    assert [r.y for r in rows] == [pytest.approx(float(f"{x:.6g}"), rel=1e-12) for x in xs]
    assert spark.sql("SELECT CAST(NULL AS DOUBLE) x").select(S.significant(F.col("x"))).first()[0] is None


def test_pulse_of_known_area(spark):
    fs = 100
    f = [505.0 if 3 <= i / fs < 7 else 5.0 for i in range(1000)]
    (m,) = cards.pulse_metrics(samples(spark, {"F_thrust": f}, fs), fs).collect()
    assert m.baseline == 5 and m.peak == 500 and m.integral == pytest.approx(2000, rel=0.01) and not m.peak_is_short_spike
    (p,) = cards.segment_phases(samples(spark, {"F_thrust": f}, fs), fs).collect()
    assert p.fired and abs(p.i_ignition - 300) <= 2 and abs(p.i_tail - 700) <= 2 and p.tail_off_end_by == "below_on_frac" and not p.record_ends_during_firing
    names = [r.name for r in cards.phase_table(cards.segment_phases(samples(spark, {"F_thrust": f}, fs), fs)).collect()]
    assert names == ["pre_test", "startup", "mainstage", "shutdown", "post_test"]
    quiet = cards.phase_table(cards.segment_phases(samples(spark, {"x": [1.0] * 300}, fs), fs)).collect()
    assert [r.name for r in quiet] == ["no_firing"]


def test_redlines(spark):
    fs = 1000
    v = [0.0] * 1000
    v[100:105] = [9.0] * 5
    v[300:330] = [8.0] * 30  # smoothing takes two samples off each end of what is found
    v[310] = 8.5
    lines = spark.createDataFrame([("a", "max", 5.0), ("b", "min", 0.0)], "channel string, kind string, limit double")
    found, short = cards.check_redlines(samples(spark, {"a": v}, fs), lines, fs)
    (x,) = found.collect()
    assert x.peak_value == 8.5 and x.t_peak == pytest.approx(0.310) and x.margin_exceeded == 3.5
    assert [(r.channel, r.suppressed) for r in short.collect()] == [("a", 1)]


def test_valves(spark):
    fs = 1000
    cmd = [0.0] * 200 + [1.0] * 400 + [0.0] * 400
    resp = [0.0] * 230 + [1.0] * 400 + [0.0] * 370
    pairs = spark.createDataFrame([("cmd", "p", 25.0)], "command string, response string, max_latency_ms double")
    rows = cards.valve_response(samples(spark, {"cmd": cmd, "p": resp}, fs), pairs, fs).orderBy("i_cmd").collect()
    assert [(r.edge, r.latency_ms, r.exceeds_limit) for r in rows] == [("open", 30, True), ("close", 30, True)]


def test_reference_and_ratio(spark):
    fs = 100
    y = [100.0 if 200 <= i < 600 else 0.0 for i in range(1000)]
    bad = [v * (1.05 if 300 <= i < 420 else 1.0) for i, v in enumerate(y)]
    summary, runs = cards.compare_reference(samples(spark, {"a": bad}, fs), samples(spark, {"a": y}, fs), fs)
    assert len(runs.collect()) == 1 and not summary.first().within_tolerance and summary.first().n_intervals == 1
    thrust = [600.0 if 3 <= i / 500 < 8 else 0.0 for i in range(5000)]
    pc = [max(300 - 30 * (i / 500 - 3), 0) if 3 <= i / 500 < 8 else 0.0 for i in range(5000)]
    (r,) = cards.thrust_pressure_ratio(samples(spark, {"F": thrust, "P": pc}, 500), "F", "P", 500).collect()
    assert r.applicable and not r.consistent and r.change_pct > 50


def test_sensor_health(spark):
    fs = 100
    wave = [math.sin(i / 7) * 3 + math.sin(i * 1.7) for i in range(2000)]
    gaps = [None if i % 200 < 10 else v for i, v in enumerate(wave)]
    spiked = list(wave)
    spiked[500] += 100
    other = [2 * x for x in wave]
    other[501] -= 200
    flat = list(wave)
    flat[1000:1300] = [1.25] * 300
    s = samples(spark, {"gaps": gaps, "spiked": spiked, "other": other, "flat": flat, "dead": [7.0] * 2000, "twin": wave, "twin2": wave, "below": [-30.0 + x for x in wave]}, fs)
    issues = {(r.channel, r.kind) for r in cards.gap_issues(s).collect()}
    assert issues == {("gaps", "recurring_nan_gaps")}
    assert [r.channel for r in cards.dead_channels(s).collect()] == ["dead"]
    assert [r.channels for r in cards.duplicate_channels(s).collect()] == [["twin", "twin2"]]
    found = cards.spikes(s.where(F.col("channel").isin("spiked", "other")), fs)
    assert sorted((r.channel, r.seq) for r in found.collect()) == [("other", 501), ("spiked", 500)]
    families = spark.createDataFrame([("spiked", "pressure"), ("other", "force")], "channel string, family string")
    (c,) = cards.coincident(found, families).collect()
    assert c.channels == "other,spiked" and c.n == 2
    units = spark.createDataFrame([("below", "psi"), ("twin", "psi")], "channel string, unit string")
    assert [r.channel for r in cards.impossible_values(s, units, fs).collect()] == ["below"]
    stuck = cards.flatlines(s.where("channel = 'flat'"), fs).collect()
    assert len(stuck) == 1 and stuck[0].stuck_value == 1.25 and stuck[0].duration_s == pytest.approx(2.99)
    both = samples(spark, {"a": gaps, "b": gaps}, fs)
    (one,) = cards.gap_issues(both).collect()
    assert one.channel is None and one.channels == ["a", "b"] and one["count"] == 10
    still = [0.0] * 300 + [50.0] * 500 + [25.0] * 700
    level = samples(spark, {"P": still}, fs)
    assert cards.no_return_to_baseline(level, cards.segment_phases(level, fs), fs).count() == 1
    assert cards.describe_data(s).count() == 8 and cards.channel_stats(s, 1.0).where("channel = 'dead'").first().std == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "run_id string, channel string, seq long, t double, v double")
    lines = spark.createDataFrame([], "channel string, kind string, limit double")
    for found in (cards.describe_data(none), cards.segment_phases(none, 100), cards.pulse_metrics(none, 100), *cards.check_redlines(none, lines, 100), cards.spikes(none, 100), cards.gap_issues(none), cards.flatlines(none, 100)):
        assert found.count() == 0
