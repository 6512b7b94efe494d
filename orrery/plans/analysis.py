"""Queries of the analysis operators over the hourly series, read as a run of 100 samples a second, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import cards
from ..sources.series import hourly_events, table
from .basic import CROSS, QUERIES, RUNS, SQL, big, nudged, query, r6  # noqa: F401
from .sql import EV, FILLED

FS = 100.0
EVP, FILLEDP = (x.replace("g.seq * 3600.0::DOUBLE AS t", "g.seq / 100.0::DOUBLE AS t") for x in (EV, FILLED))
LIMITS = {"max": 200.0, "min": 20.0}


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_events(spark, sf_dir).withColumn("t", F.col("seq") / FS)


def redlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both limits for every channel."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("limit")) for k, v in LIMITS.items()])
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("channel")).distinct().select("channel", F.inline(kinds))


RED = f"""{EVP}, m0 AS (SELECT *, 'max' AS kind, 200.0::DOUBLE AS lim, v > 200 AS flag FROM s UNION ALL SELECT *, 'min', 20.0::DOUBLE, v < 20 FROM s),
g AS (SELECT *, coalesce(flag, false) AS fl FROM m0), h AS (SELECT *, CASE WHEN fl IS DISTINCT FROM lag(fl) OVER (PARTITION BY channel, kind ORDER BY seq) THEN 1 ELSE 0 END AS b FROM g),
r AS (SELECT *, sum(b) OVER (PARTITION BY channel, kind ORDER BY seq) AS run FROM h),
runs AS (SELECT channel, kind, lim, min(t) AS t0, max(t) AS t1, count(*) AS n, CASE WHEN kind = 'max' THEN max(v) ELSE min(v) END AS peak, arg_min(t, (CASE WHEN kind = 'max' THEN -v ELSE v END, seq)) AS tp FROM r WHERE fl GROUP BY channel, kind, lim, run)"""


@query(f"WITH {RED} SELECT channel, kind, round(t0, 6) AS t_start, round(t1, 6) AS t_end, round(t1 - t0, 6) AS duration_s, round(peak, 6) AS peak_value, round(tp, 6) AS t_peak, round(abs(peak - lim), 6) AS margin_exceeded FROM runs WHERE n >= 2")
def redline_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = cards.check_redlines(run(spark, sf_dir), redlines(spark, sf_dir), FS, 0.02)
    return found.select("channel", "kind", *[r6(c).alias(c) for c in ("t_start", "t_end", "duration_s", "peak_value", "t_peak", "margin_exceeded")])


@query(f"WITH {RED} SELECT channel, count(*) AS suppressed FROM runs WHERE n < 2 GROUP BY channel")
def suppressed_transients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.check_redlines(run(spark, sf_dir), redlines(spark, sf_dir), FS, 0.02)[1].select("channel", "suppressed")


PULSE = FILLEDP + """, p1 AS (SELECT *, avg(f) OVER (PARTITION BY channel ORDER BY seq ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS xs FROM f),
p2 AS (SELECT *, quantile_cont(xs, 0.5) OVER (PARTITION BY channel ORDER BY seq ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS xm FROM p1),
p3 AS (SELECT channel, quantile_cont(xm, 0.05) AS base, max(xm) AS peak, arg_min(seq, (-xm, seq)) AS k FROM p2 GROUP BY channel),
p4 AS (SELECT p2.*, base, peak, k, coalesce(xm > base + 0.5 * (peak - base), false) AS above FROM p2 JOIN p3 USING (channel)),
p5 AS (SELECT channel, max(seq) FILTER (NOT above AND seq < k) AS lo, min(seq) FILTER (NOT above AND seq > k) AS hi FROM p4 GROUP BY channel),
p6 AS (SELECT channel, quantile_cont(xs, 0.5) AS plateau FROM p4 JOIN p5 USING (channel) WHERE (lo IS NULL OR seq > lo) AND (hi IS NULL OR seq < hi) AND xs > base + 0.75 * (peak - base) GROUP BY channel),
p7 AS (SELECT p4.*, coalesce(plateau, peak) AS level, coalesce(plateau, peak) - base AS rise FROM p4 LEFT JOIN p6 USING (channel)),
p AS (SELECT *, rise > 0 AND rise >= 0.25 * greatest(abs(level), abs(base)) AS clear FROM p7)"""


@query(f"""WITH {PULSE}, q0 AS (SELECT channel, min(seq) FILTER (xs > base + 0.9 * rise) AS i0, max(seq) FILTER (xs > base + 0.9 * rise) AS i1 FROM p GROUP BY channel),
q1 AS (SELECT p.*, i0, i1, count(xs) OVER w = 20 AND max(xs) OVER w - min(xs) OVER w < 0.02 * rise AS still, xs < base + 0.1 * rise AS low FROM p JOIN q0 USING (channel) WINDOW w AS (PARTITION BY channel ORDER BY seq ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
q2 AS (SELECT channel, any_value(base) AS base, any_value(level) AS level, any_value(rise) AS rise, any_value(clear) AS clear, any_value(i0) AS i0, any_value(i1) AS i1, max(seq) AS s1, coalesce(max(seq + 1) FILTER (low AND seq < i0), min(seq)) AS ign,
  min(seq) FILTER (low AND seq >= i1) AS below, min(seq) FILTER (still AND seq >= i1) AS settled, arg_max(xs, seq) AS x_end FROM q1 GROUP BY channel),
q3 AS (SELECT *, clear AND i0 IS NOT NULL AS fired, CASE WHEN below IS NOT NULL THEN 'below_on_frac' WHEN settled IS NOT NULL THEN 'settled_above_threshold' ELSE 'end_of_record' END AS how FROM q2)
SELECT channel, fired, round(base, 6) AS baseline, round(level, 6) AS steady_level, CASE WHEN fired THEN ign END AS i_ignition, CASE WHEN fired THEN i0 END AS i_mainstage, CASE WHEN fired THEN i1 END AS i_shutdown,
  CASE WHEN fired THEN coalesce(below, settled, s1) END AS i_tail, CASE WHEN fired THEN how END AS tail_off_end_by, coalesce(fired AND x_end > base + 0.1 * rise AND (how = 'end_of_record' OR i1 >= s1 + 1 - 50), false) AS record_ends_during_firing FROM q3""")
def segment_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cards.segment_phases(run(spark, sf_dir), FS)
    return found.select("channel", "fired", r6("baseline").alias("baseline"), r6("steady_level").alias("steady_level"), "i_ignition", "i_mainstage", "i_shutdown", "i_tail", "tail_off_end_by", "record_ends_during_firing")


@query(f"""WITH {FILLEDP}, a1 AS (SELECT *, avg(f) OVER (PARTITION BY channel ORDER BY seq ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS xs FROM f),
a2 AS (SELECT *, quantile_cont(xs, 0.5) OVER (PARTITION BY channel ORDER BY seq ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS xm FROM a1),
a3 AS (SELECT channel, arg_min(seq, (-xm, seq)) AS i_ref, max(xm) AS xr FROM a2 GROUP BY channel),
a4 AS (SELECT channel, coalesce(max(seq) FILTER (seq < i_ref AND xm < 0.5 * xr), min(seq)) AS i_pre FROM a2 JOIN a3 USING (channel) GROUP BY channel),
a5 AS (SELECT a2.channel, t AS tp FROM a2 JOIN a4 ON a2.channel = a4.channel AND a2.seq = a4.i_pre),
a6 AS (SELECT channel, quantile_cont(f, 0.5) AS b FROM a2 JOIN a5 USING (channel) WHERE t >= tp - 1.5::DOUBLE AND t < tp - 0.5::DOUBLE GROUP BY channel),
a AS (SELECT a2.*, i_ref, xr - coalesce(b, 0) AS sus, coalesce(b, 0) AS base, f - coalesce(b, 0) AS y, xs - coalesce(b, 0) AS ys FROM a2 JOIN a3 USING (channel) LEFT JOIN a6 USING (channel)),
b1 AS (SELECT channel, coalesce(max(seq + 1) FILTER (ys < 0.1::DOUBLE * sus AND seq <= i_ref), min(seq)) AS a0, coalesce(min(seq - 1) FILTER (ys < 0.1::DOUBLE * sus AND seq >= i_ref), max(seq)) AS z0 FROM a GROUP BY channel),
b2 AS (SELECT channel, arg_min(seq, (-xs, seq)) AS ip, arg_min(ys, (-xs, seq)) AS yp FROM a JOIN b1 USING (channel) WHERE seq BETWEEN a0 AND z0 GROUP BY channel),
b3 AS (SELECT channel, coalesce(max(seq + 1) FILTER (ys < 0.1::DOUBLE * yp AND seq <= ip), min(seq)) AS a1, coalesce(min(seq - 1) FILTER (ys < 0.1::DOUBLE * yp AND seq >= ip), max(seq)) AS z1 FROM a JOIN b2 USING (channel) GROUP BY channel),
c AS (SELECT a.*, ip, yp > 1.5::DOUBLE * sus AS spiky, CASE WHEN yp > 1.5::DOUBLE * sus THEN a0 ELSE a1 END AS lo, CASE WHEN yp > 1.5::DOUBLE * sus THEN z0 ELSE z1 END AS hi FROM a JOIN b1 USING (channel) JOIN b2 USING (channel) JOIN b3 USING (channel)),
d AS (SELECT *, (y + lag(y) OVER w) / 2 * (t - lag(t) OVER w) AS area FROM c WHERE seq BETWEEN lo AND hi WINDOW w AS (PARTITION BY channel ORDER BY seq))
SELECT channel, round(any_value(base), 6) AS baseline, round(max(y) FILTER (seq = ip), 6) AS peak, round(max(t) FILTER (seq = ip), 6) AS t_peak, round(any_value(sus), 6) AS peak_sustained, any_value(spiky) AS peak_is_short_spike,
  round(min(t), 6) AS t_start, round(max(t), 6) AS t_end, round(coalesce(sum(area), 0), 6) AS integral, count(*) - count(v) AS nan_samples_interpolated FROM d GROUP BY channel""")
def pulse_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = cards.pulse_metrics(run(spark, sf_dir), FS)
    return m.select("channel", *[r6(c).alias(c) for c in ("baseline", "peak", "t_peak", "peak_sustained", "t_start", "t_end", "integral")], "peak_is_short_spike", "nan_samples_interpolated")


REF = FILLEDP + """, ref AS (SELECT channel, t, avg(f) OVER (PARTITION BY channel ORDER BY seq ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) AS rv, seq FROM f), rr AS (SELECT channel, t, rv FROM ref WHERE seq % 12 = 0),
x0 AS (SELECT f.channel, f.seq, f.t, f.v, a.t AS t0, a.rv AS r0 FROM f ASOF JOIN rr a ON f.channel = a.channel AND f.t >= a.t), x1 AS (SELECT x0.*, b.t AS t1, b.rv AS r1 FROM x0 ASOF LEFT JOIN rr b ON x0.channel = b.channel AND x0.t <= b.t),
x AS (SELECT channel, seq, t, v, v - CASE WHEN t0 = t OR t1 IS NULL THEN r0 ELSE r0 + (r1 - r0) * (t - t0) / (t1 - t0) END AS dev, CASE WHEN t0 = t OR t1 IS NULL THEN r0 ELSE r0 + (r1 - r0) * (t - t0) / (t1 - t0) END AS r FROM x1),
sc AS (SELECT channel, avg(abs(r)) FILTER (dev IS NOT NULL) AS scale FROM x GROUP BY channel), y AS (SELECT x.*, 100 * dev / scale AS pct FROM x JOIN sc USING (channel)),
z AS (SELECT *, CASE WHEN count(pct) OVER w >= 10 THEN avg(pct) OVER w END AS roll FROM y WINDOW w AS (PARTITION BY channel ORDER BY seq ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)), m AS (SELECT *, abs(roll) > 5 AS flag FROM z), """ + RUNS


def with_reference(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = run(spark, sf_dir)
    win = S.ordered("run_id", "channel")
    ref = s.withColumn("f", S.fill_linear("v", win)).withColumn("v", S.roll_mean("f", win, 24)).where("seq % 12 = 0")
    return s, ref.select("run_id", "channel", "t", "v")


@query(f"WITH {REF} SELECT channel, round(min(t), 6) AS t_start, round(max(t), 6) AS t_end, round(avg(pct), 6) AS mean_dev_pct, round(arg_min(pct, (-abs(pct), seq)), 6) AS peak_dev_pct FROM r WHERE fl GROUP BY channel, run HAVING round(max(t) - min(t), 6) >= 0.1")
def compare_reference_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, runs = cards.compare_reference(*with_reference(spark, sf_dir), FS, 5.0, 0.0)
    return runs.where(r6("duration_s") >= 0.1).select("channel", *[r6(c).alias(c) for c in ("t_start", "t_end", "mean_dev_pct", "peak_dev_pct")])


@query(f"WITH {REF} SELECT channel, round(avg(v), 6) AS mean_measured, round(avg(r), 6) AS mean_reference, round(avg(dev), 6) AS mean_dev, round(avg(pct), 6) AS mean_dev_pct, round(sqrt(avg(dev * dev)), 6) AS rmse, round(max(abs(dev)), 6) AS max_abs_dev FROM y WHERE dev IS NOT NULL GROUP BY channel")
def compare_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary, _ = cards.compare_reference(*with_reference(spark, sf_dir), FS, 5.0, 0.1)
    return summary.select("channel", *[r6(c).alias(c) for c in ("mean_measured", "mean_reference", "mean_dev", "mean_dev_pct", "rmse", "max_abs_dev")])


SIGMAS = 4.0
SPIKES = FILLEDP + f""", l AS (SELECT *, list(f) OVER (PARTITION BY channel ORDER BY seq ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS l FROM f),
md AS (SELECT *, list_sort(list_concat(l, list_transform(range(11 - len(l)), lambda q: 0.0::DOUBLE)))[6] AS med FROM l), rs AS (SELECT *, abs(f - med) AS res FROM md),
wh AS (SELECT channel, 1.4826::DOUBLE * quantile_cont(res, 0.5) AS whole FROM rs WHERE res > 0 GROUP BY channel),
sg AS (SELECT rs.*, greatest(1.4826::DOUBLE * quantile_cont(res, 0.5) OVER (PARTITION BY rs.channel ORDER BY seq ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), coalesce(whole, 0), 1e-12::DOUBLE) AS sigma, lag(f) OVER w AS b, lead(f) OVER w AS a,
  max(CASE WHEN v IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY rs.channel ORDER BY seq ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS ng FROM rs LEFT JOIN wh ON rs.channel = wh.channel WINDOW w AS (PARTITION BY rs.channel ORDER BY seq)),
ht AS (SELECT *, CASE WHEN seq - lag(seq) OVER (PARTITION BY channel ORDER BY seq) <= 1 THEN 0 ELSE 1 END AS br FROM sg WHERE res > {SIGMAS}::DOUBLE * sigma AND ng = 0),
gr AS (SELECT *, sum(br) OVER (PARTITION BY channel ORDER BY seq) AS run FROM ht),
bs AS (SELECT channel, max(seq) - min(seq) + 1 AS width, arg_min(struct_pack(seq := seq, t := t, f := f, med := med, res := res, sigma := sigma), (-res, seq)) AS x, arg_min(struct_pack(y := b), seq).y AS b, arg_max(struct_pack(y := a), seq).y AS a FROM gr GROUP BY channel, run),
sp AS (SELECT channel, x.seq AS seq, x.t AS t, x.f AS value, x.med AS med, x.f - x.med AS dev, x.res / x.sigma AS sig FROM bs WHERE width <= 5 AND (a IS NULL OR b IS NULL OR ((x.f > a AND x.f > b) OR (x.f < a AND x.f < b)) AND abs(x.f - (a + b) / 2) >= 0.5::DOUBLE * x.res))"""


@query(f"WITH {SPIKES} SELECT channel, seq, round(value, 6) AS value, round(med, 6) AS local_median, round(dev, 6) AS deviation, round(sig, 6) AS sigmas FROM sp")
def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.spikes(run(spark, sf_dir), FS, sigmas=SIGMAS).select("channel", "seq", *[r6(c).alias(c) for c in ("value", "local_median", "deviation", "sigmas")])


@query(f"WITH {SPIKES}, tk AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY sig DESC, seq) AS i FROM sp) SELECT channel, seq, CAST(i AS BIGINT) AS place FROM tk WHERE i <= 5")
def topk_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cards.spikes(run(spark, sf_dir), FS, sigmas=SIGMAS)
    place = F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("sigmas"), "seq")).cast("long")
    return found.withColumn("place", place).where("place <= 5").select("channel", "seq", "place")


@query(f"WITH {SPIKES}, fam AS (SELECT *, left(channel, 1) AS fam FROM sp), hit AS (SELECT DISTINCT a.channel, a.seq FROM fam a JOIN fam b ON abs(a.seq - b.seq) <= 20 AND a.fam <> b.fam), br AS (SELECT *, CASE WHEN seq - lag(seq) OVER (ORDER BY seq, channel) <= 20 THEN 0 ELSE 1 END AS b FROM hit), cl AS (SELECT *, sum(b) OVER (ORDER BY seq, channel) AS c FROM br) SELECT min(seq) AS first, max(seq) AS last, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels, count(*) AS n FROM cl GROUP BY c")
def coincident_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cards.spikes(run(spark, sf_dir), FS, sigmas=SIGMAS).withColumn("t", F.col("seq").cast("double"))
    families = found.select("channel", F.substring("channel", 1, 1).alias("family")).distinct()
    c = cards.coincident(found, families, 20.0)
    return c.select(big("t_start").alias("first"), big("t_end").alias("last"), "channels", "n")


def with_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run, a copy of one channel, and a channel that never moves."""
    s = run(spark, sf_dir)
    click = s.where("channel = 'click'")
    return s.unionByName(click.withColumn("channel", F.lit("copy"))).unionByName(click.withColumn("channel", F.lit("still")).withColumn("v", F.lit(-20.0)))


FAULTS = f"{EVP}, u AS (SELECT * FROM s UNION ALL SELECT 'copy', seq, t, v FROM s WHERE channel = 'click' UNION ALL SELECT 'still', seq, t, -20.0::DOUBLE FROM s WHERE channel = 'click')"


@query(f"WITH {FAULTS}, l AS (SELECT channel, list(v ORDER BY seq) AS l, min(v) AS lo, max(v) AS hi FROM u GROUP BY channel) SELECT string_agg(channel, ',' ORDER BY channel) AS channels, count(*) AS n_channels FROM l WHERE lo < hi GROUP BY l HAVING count(*) > 1")
def duplicate_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cards.duplicate_channels(with_faults(spark, sf_dir))
    return found.select(F.array_join("channels", ",").alias("channels"), big("n_channels").alias("n_channels"))


@query(f"WITH {FAULTS} SELECT channel, min(v) AS value FROM u GROUP BY channel HAVING min(v) = max(v)")
def dead_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.dead_channels(with_faults(spark, sf_dir)).select("channel", "value")


@query(f"WITH {FAULTS} SELECT channel, count(*) FILTER (v < -14.7 - 0.147) AS n_below, min(v) AS min_value, round(100.0::DOUBLE * count(*) FILTER (v < -14.7 - 0.147) / count(*), 6) AS share_of_record_pct FROM u GROUP BY channel HAVING count(*) FILTER (v < -14.7 - 0.147) >= 50")
def impossible_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = with_faults(spark, sf_dir)
    found = cards.impossible_values(s, s.select("channel", F.lit("psi").alias("unit")).distinct(), FS)
    return found.select("channel", "n_below", "min_value", r6("share_of_record_pct").alias("share_of_record_pct"))


@query(f"""WITH {EVP}, ph AS ({SQL["segment_phases"]}),
m AS (SELECT channel, any_value(steady_level) AS steady_level, any_value(baseline) AS low, quantile_cont(v, 0.5) FILTER (seq < i_ignition) AS baseline, quantile_cont(v, 0.5) FILTER (seq > greatest(i_shutdown + 100, i_tail)) AS post_level,
  count(v) FILTER (seq < i_ignition) AS n0, count(v) FILTER (seq > greatest(i_shutdown + 100, i_tail)) AS n1 FROM s JOIN ph USING (channel) WHERE fired GROUP BY channel)
SELECT channel, round(baseline, 6) AS baseline, round(post_level, 6) AS post_level, round(100 * (post_level - baseline) / (steady_level - low), 6) AS offset_of_steady_pct FROM m WHERE n0 >= 50 AND n1 >= 50 AND 100 * (post_level - baseline) / (steady_level - low) > 25""")
def baseline_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = segment_phases(spark, sf_dir).withColumn("run_id", F.lit("all"))
    found = cards.no_return_to_baseline(run(spark, sf_dir), segments, FS)
    return found.select("channel", *[r6(c).alias(c) for c in ("baseline", "post_level", "offset_of_steady_pct")])


@query(f"WITH {EVP}, n AS (SELECT seq, count(*) FILTER (v IS NULL) AS missing, count(*) AS channels FROM s GROUP BY seq) SELECT seq, missing FROM n WHERE missing >= 2")
def shared_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places where two channels or more have no sample."""
    return run(spark, sf_dir).groupBy("seq").agg(F.count_if(F.col("v").isNull()).alias("missing")).where("missing >= 2")


@query(f"WITH {FAULTS}, i AS (SELECT channel, 'dead_channel' AS kind FROM u GROUP BY channel HAVING min(v) = max(v) UNION ALL SELECT channel, 'recurring_nan_gaps' FROM (SELECT channel, v IS NULL AND lag(v) OVER (PARTITION BY channel ORDER BY seq) IS NOT NULL OR v IS NULL AND seq = 0 AS g FROM u) GROUP BY channel HAVING count(*) FILTER (g) > 3) SELECT channel, kind, CAST(CASE WHEN kind = 'dead_channel' THEN 0 ELSE 1 END AS BIGINT) AS rank FROM i")
def issue_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = with_faults(spark, sf_dir)
    dead = cards.dead_channels(s).select("channel", F.lit("dead_channel").alias("kind"))
    gaps = cards.gap_issues(s).where("kind = 'recurring_nan_gaps' AND channel IS NOT NULL").select("channel", "kind")
    return dead.unionByName(gaps).withColumn("rank", F.when(F.col("kind") == "dead_channel", 0).otherwise(1).cast("long"))


@query(f"WITH {RED}, f AS (SELECT channel, kind, t0, CASE WHEN n >= 4 THEN 'critical' WHEN n >= 2 THEN 'warning' ELSE 'info' END AS severity FROM runs) SELECT channel, kind, round(t0, 6) AS t_start, severity, CAST(row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, t0, channel, kind) AS BIGINT) AS place FROM f")
def severity_sort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by severity, then time. Findings are few beside the samples that they come from."""
    runs = cards.redline_runs(run(spark, sf_dir), redlines(spark, sf_dir), FS)
    f = runs.withColumn("severity", F.when(F.col("n") >= 4, "critical").when(F.col("n") >= 2, "warning").otherwise("info"))
    place = F.row_number().over(Window.orderBy(cards.severity_rank(F.col("severity")), "t_start", "channel", "kind")).cast("long")
    return f.select("channel", "kind", r6("t_start").alias("t_start"), "severity", place.alias("place"))


VALVE = FILLEDP + """, cm AS (SELECT seq, t, CASE WHEN v > 150 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c FROM s WHERE channel = 'view'), ed AS (SELECT seq AS i, t, c - lag(c) OVER (ORDER BY seq) AS d FROM cm), e AS (SELECT * FROM ed WHERE abs(d) > 0.5),
rp AS (SELECT seq, f FROM f WHERE channel = 'click'), spd AS (SELECT quantile_cont(v, 0.99) - quantile_cont(v, 0.01) AS spread FROM s WHERE channel = 'click'),
nr AS (SELECT e.i, e.t, e.d, rp.seq, rp.f FROM e JOIN rp ON rp.seq >= e.i - 5 AND rp.seq < e.i + 50),
qt AS (SELECT i, quantile_cont(f, 0.5) AS bl, CASE WHEN count(f) > 3 THEN stddev_pop(f) ELSE 0 END AS ns FROM nr WHERE seq < i GROUP BY i),
hd AS (SELECT nr.*, bl, greatest(8 * ns, 0.03::DOUBLE * spread) AS th FROM nr LEFT JOIN qt USING (i), spd),
rs AS (SELECT i, any_value(t) AS t, any_value(d) AS d, any_value(th) AS th, min(seq) FILTER (seq >= i AND CASE WHEN d > 0 THEN f > bl + th ELSE f < bl - th END) AS ir FROM hd GROUP BY i)"""


@query(f"WITH {VALVE} SELECT i AS i_cmd, CASE WHEN d > 0 THEN 'open' ELSE 'close' END AS edge, round((ir - i) / 100.0::DOUBLE * 1000, 6) AS latency_ms, round(th, 6) AS detection_threshold, ir IS NULL OR (ir - i) * 10 > 40 AS exceeds_limit FROM rs")
def valve_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = run(spark, sf_dir)
    command = s.where("channel = 'view'").withColumn("channel", F.lit("cmd")).withColumn("v", F.when(F.col("v") > 150, 1.0).otherwise(0.0))
    pairs = spark.sql("SELECT 'cmd' AS command, 'click' AS response, 40.0D AS max_latency_ms")
    found = cards.valve_response(s.unionByName(command), pairs, FS)
    return found.select("i_cmd", "edge", r6("latency_ms").alias("latency_ms"), r6("detection_threshold").alias("detection_threshold"), "exceeds_limit")


def findings_and_truth(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Excursions above 150 stand for findings, those above 250 for what is true."""
    s = run(spark, sf_dir)
    over = lambda x: S.islands(s, F.col("v") > x, ["channel"]).select("channel", "t_start", "t_end")
    return over(150.0), over(250.0)


TRUTH = EVP + "".join(f""", m{x} AS (SELECT channel, seq, t, coalesce(v > {x}, false) AS fl FROM s), h{x} AS (SELECT *, CASE WHEN fl IS DISTINCT FROM lag(fl) OVER (PARTITION BY channel ORDER BY seq) THEN 1 ELSE 0 END AS b FROM m{x}),
r{x} AS (SELECT *, sum(b) OVER (PARTITION BY channel ORDER BY seq) AS run FROM h{x}), i{x} AS (SELECT channel, min(t) AS t0, max(t) AS t1 FROM r{x} WHERE fl GROUP BY channel, run)""" for x in (150, 250))


def overlapping(tol: float) -> F.Column:
    return (F.col("f.t_start") <= F.col("a.t_end") + tol) & (F.col("a.t_start") - tol <= F.col("f.t_end"))


def slotted(df: DataFrame, width: float, more: float) -> DataFrame:
    """Rows in every slot of time that they touch, so that an overlap join is an equi-join by slot."""
    return df.withColumn("slot", F.explode(F.sequence(F.floor((F.col("t_start") - more) / width), F.floor((F.col("t_end") + more) / width))))


@query(f"WITH {TRUTH} SELECT f.channel, round(f.t0, 6) AS t_finding, round(a.t0, 6) AS t_truth FROM i150 f JOIN i250 a ON f.channel = a.channel AND f.t0 <= a.t1 + 0.0251 AND a.t0 - 0.0251 <= f.t1")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, truth = findings_and_truth(spark, sf_dir)
    f, a = slotted(found, 1.0, 0.0).alias("f"), slotted(truth, 1.0, 0.0251).alias("a")
    hit = f.join(a, (F.col("f.channel") == F.col("a.channel")) & (F.col("f.slot") == F.col("a.slot")) & overlapping(0.0251))
    return hit.select("f.channel", r6("f.t_start").alias("t_finding"), r6("a.t_start").alias("t_truth")).distinct()


@query(f"WITH {TRUTH} SELECT f.channel, round(f.t0, 6) AS t_start FROM i150 f WHERE NOT EXISTS (SELECT 1 FROM i250 a WHERE f.channel = a.channel AND f.t0 <= a.t1 + 0.0251 AND a.t0 - 0.0251 <= f.t1)")
def false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, a = (x.alias(n) for x, n in zip(findings_and_truth(spark, sf_dir), "fa"))
    return f.join(a, (F.col("f.channel") == F.col("a.channel")) & overlapping(0.0251), "left_anti").select("channel", r6("t_start").alias("t_start"))


@query(f"WITH {TRUTH} SELECT a.channel, round(a.t0, 6) AS t_start FROM i150 a WHERE NOT EXISTS (SELECT 1 FROM i150 b WHERE a.channel > b.channel AND a.t0 <= b.t1 AND b.t0 <= a.t1 AND abs((a.t1 - a.t0) - (b.t1 - b.t0)) <= 0.05::DOUBLE * greatest(b.t1 - b.t0, 0.01))")
def event_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that no earlier channel has at the same time with nearly the same size."""
    e, _ = findings_and_truth(spark, sf_dir)
    a, b = e.alias("a"), e.alias("b")
    size = lambda x: F.col(f"{x}.t_end") - F.col(f"{x}.t_start")
    same = (F.col("a.channel") > F.col("b.channel")) & (F.col("a.t_start") <= F.col("b.t_end")) & (F.col("b.t_start") <= F.col("a.t_end")) & (F.abs(size("a") - size("b")) <= 0.05 * F.greatest(size("b"), F.lit(0.01)))
    return a.join(b, same, "left_anti").select("channel", r6("t_start").alias("t_start"))


@query(f"WITH {TRUTH}, h AS (SELECT a.channel, a.t0, min(abs(f.t0 - a.t0)) AS err FROM i250 a LEFT JOIN i150 f ON f.channel = a.channel AND f.t0 <= a.t1 + 0.0251 AND a.t0 - 0.0251 <= f.t1 GROUP BY 1, 2) SELECT channel, count(*) AS n_truth, count(err) AS n_hit, round(count(err) / count(*), 6) AS recall, round(list_sort(list(err) FILTER (err IS NOT NULL))[count(err) // 2 + 1], 6) AS median_error FROM h GROUP BY ROLLUP (channel)")
def bench_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall for each channel and overall, with the upper median of the errors of time. Overall is there without any truth too: its recall is NaN then."""
    f, a = (x.alias(n) for x, n in zip(findings_and_truth(spark, sf_dir), "fa"))
    h = a.join(f, (F.col("f.channel") == F.col("a.channel")) & overlapping(0.0251), "left").groupBy(F.col("a.channel").alias("channel"), F.col("a.t_start").alias("t0")).agg(F.min(F.abs(F.col("f.t_start") - F.col("a.t_start"))).alias("err"))
    middle = F.try_element_at(F.array_sort(F.collect_list("err")), (F.floor(F.count("err") / 2) + 1).cast("int"))
    # A rollup of no rows has no overall row, unlike SQL's: a row of nulls, which no count sees, makes it.
    nulls = spark.range(1).select(*[F.lit(None).cast(t).alias(c) for c, t in h.dtypes])
    recall = F.coalesce(F.try_divide(F.count("err"), F.count("t0")), F.lit(float("nan")))
    rolled = h.unionByName(nulls).rollup("channel").agg(F.count("t0").alias("n_truth"), F.count("err").alias("n_hit"), r6(recall).alias("recall"), r6(middle).alias("median_error"), F.grouping("channel").alias("overall"))
    return rolled.where("overall = 1 OR n_truth > 0").drop("overall")


@query("SELECT b.x AS background, k.x AS kind, CAST(l.x AS BIGINT) AS level, CAST(r.x AS BIGINT) AS rep FROM (SELECT DISTINCT event_type AS x FROM events) b, (SELECT unnest(['oscillation', 'spike', 'stuck']) AS x) k, (SELECT unnest(range(4)) AS x) l, (SELECT unnest(range(3)) AS x) r")
def job_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backgrounds x kinds x levels x repetitions: the last three are constants."""
    b = table(spark, sf_dir, "events").select(F.col("event_type").alias("background")).distinct()
    out = b.withColumn("kind", F.explode(F.array(*map(F.lit, ("oscillation", "spike", "stuck")))))
    return out.withColumn("level", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))


@query("WITH e AS (SELECT event_id, 'E' || (event_id % 60) AS evidence FROM events), l AS (SELECT 'E' || CAST(range AS VARCHAR) AS id FROM range(50)) SELECT e.event_id, e.evidence FROM e LEFT JOIN l ON e.evidence = l.id WHERE l.id IS NULL")
def unknown_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited evidence that the ledger doesn't have."""
    cited = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("E"), (F.col("event_id") % 60).cast("string")).alias("evidence"))
    ledger = spark.range(50).select(F.concat(F.lit("E"), F.col("id").cast("string")).alias("evidence"))
    return cited.join(ledger, "evidence", "left_anti").select("event_id", "evidence")


@query("WITH c AS (SELECT event_id, value FROM events), f AS (SELECT * FROM (VALUES (1, 120.0::DOUBLE), (2, 0.35::DOUBLE), (3, 61.2::DOUBLE)) t(field, fv)), k AS (SELECT * FROM (VALUES (0, 1.0::DOUBLE), (1, 1000.0::DOUBLE), (2, 0.001::DOUBLE), (3, 100.0::DOUBLE), (4, 0.01::DOUBLE), (5, 60.0::DOUBLE)) t(o, scale)), m AS (SELECT event_id, field, scale, row_number() OVER (PARTITION BY event_id ORDER BY abs(abs(value) - abs(fv * scale)), field, o) AS i FROM c, f, k WHERE abs(abs(value) - abs(fv * scale)) <= greatest(0.005::DOUBLE, 0.01::DOUBLE * abs(fv * scale), 1e-9)) SELECT event_id, CAST(field AS BIGINT) AS field, scale FROM m WHERE i = 1")
def scale_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each number the nearest field at an allowed scale; signs are ignored, ties go by field and scale."""
    fields = [(1, 120.0), (2, 0.35), (3, 61.2)]
    scales = [1.0, 1000.0, 0.001, 100.0, 0.01, 60.0]
    options = F.array(*[F.struct(F.lit(f).cast("long").alias("field"), F.lit(o).alias("o"), F.lit(s).alias("scale"), F.lit(v * s).alias("x")) for f, v in fields for o, s in enumerate(scales)])
    c = table(spark, sf_dir, "events").select("event_id", "value", F.inline(options))
    d = F.abs(F.abs("value") - F.abs("x"))
    near = c.withColumn("d", d).where(F.col("d") <= F.greatest(F.lit(0.005), 0.01 * F.abs("x"), F.lit(1e-9)))
    return near.groupBy("event_id").agg(F.min_by(F.struct("field", "scale"), F.struct("d", "field", "o")).alias("m")).select("event_id", "m.field", "m.scale")


@query("SELECT event_id, CASE WHEN x = 0 THEN 0.0::DOUBLE ELSE round(x * pow(10.0::DOUBLE, 5 - floor(log10(abs(x))))) / pow(10.0::DOUBLE, 5 - floor(log10(abs(x)))) END AS y FROM (SELECT event_id, value * 1.2345678::DOUBLE AS x FROM events)")
def sig6_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.significant(F.col("value") * 1.2345678).alias("y"))


@query("SELECT l_returnflag AS channel, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def regr_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("channel")).agg(r6(F.regr_slope(y, x)).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), r6(F.regr_r2(y, x)).alias("r2"))


@query(f"WITH {FILLEDP}, p AS (SELECT seq, max(f) FILTER (channel = 'click') AS a, max(f) FILTER (channel = 'view') AS b FROM f GROUP BY seq), c AS (SELECT k.k, corr(p.a, q.b) AS c FROM (SELECT unnest(range(-12, 13)) AS k) k, p JOIN p q ON true WHERE q.seq = p.seq + k.k GROUP BY k.k) SELECT CAST(arg_min(k, (-round(c, 9), k)) AS BIGINT) AS lag, round(max(c), 6) AS correlation FROM c")
def best_lag_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shift of one channel against another, of 12 samples at most, that correlates best."""
    f = run(spark, sf_dir).withColumn("f", S.fill_linear("v", S.ordered("channel")))
    a = f.where("channel = 'click'").select("seq", F.col("f").alias("a")).withColumn("k", F.explode(F.sequence(F.lit(-12), F.lit(12)))).withColumn("other", F.col("seq") + F.col("k"))
    b = f.where("channel = 'view'").select(F.col("seq").alias("other"), F.col("f").alias("b"))
    c = a.join(b, "other").groupBy("k").agg(F.corr("a", "b").alias("c"))
    return c.agg(F.max_by("k", F.struct(F.round("c", 9), -F.col("k"))).cast("long").alias("lag"), r6(F.max("c")).alias("correlation"))


BINS = range(2, 20)
EMB = """e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS n FROM embeddings), st AS (SELECT vec_id, regr_slope(x, n) AS sl, regr_intercept(x, n) AS ic FROM e GROUP BY vec_id),
d AS (SELECT e.vec_id, n, (x - ic - sl * n) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * n / 63)) AS y FROM e JOIN st USING (vec_id)),
mg AS (SELECT vec_id, CAST(k AS BIGINT) AS k, 2 * sqrt(pow(sum(y * cos(2 * pi() * k * n / 64)), 2) + pow(sum(y * sin(2 * pi() * k * n / 64)), 2)) / 31.5::DOUBLE AS mag FROM d, (SELECT unnest(range(2, 20)) AS k) GROUP BY vec_id, k)"""


def band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, k, mag): detrended, Hann-windowed DFT magnitudes of each embedding, bins 2 to 19. One pass, no join: the bins' waves are constants."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("n", "x")).withColumn("x", F.col("x").cast("double"))
    line = e.groupBy("vec_id").agg(F.regr_slope("x", "n").alias("sl"), F.regr_intercept("x", "n").alias("ic"), F.collect_list(F.struct("n", "x")).alias("s"))
    d = line.select("vec_id", F.inline(F.transform("s", lambda p: F.struct(p["n"].alias("n"), ((p["x"] - F.col("ic") - F.col("sl") * p["n"]) * (0.5 - 0.5 * F.cos(2 * math.pi * p["n"] / 63))).alias("y")))))
    waves = [F.struct(F.lit(k).cast("long").alias("k"), F.sqrt(F.pow(F.sum(F.col("y") * F.cos(2 * math.pi * k * F.col("n") / 64)), 2) + F.pow(F.sum(F.col("y") * F.sin(2 * math.pi * k * F.col("n") / 64)), 2)).alias("m")) for k in BINS]
    return d.groupBy("vec_id").agg(F.array(*waves).alias("w")).select("vec_id", F.inline("w")).select("vec_id", "k", (2 * F.col("m") / 31.5).alias("mag"))


@query(f"WITH {EMB} SELECT vec_id, k, round(mag, 6) AS mag FROM mg")
def dft_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return band(spark, sf_dir).select("vec_id", "k", r6("mag").alias("mag"))


@query(f"WITH {EMB}, t AS (SELECT vec_id, k, mag, lag(ln(mag)) OVER w AS b, ln(mag) AS c, lead(ln(mag)) OVER w AS a, row_number() OVER (PARTITION BY vec_id ORDER BY mag DESC, k) AS i, quantile_cont(mag, 0.5) OVER (PARTITION BY vec_id) AS med FROM mg WINDOW w AS (PARTITION BY vec_id ORDER BY k)) SELECT vec_id, k, round(mag / med, 4) AS prominence, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE greatest(-0.5::DOUBLE, least(0.5::DOUBLE, 0.5::DOUBLE * (b - a) / (b - 2 * c + a))) END, 4) AS delta FROM t WHERE i = 1")
def parabolic_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest bin, its prominence over the band's median, and the vertex of the parabola through its neighbours' logarithms."""
    own = Window.partitionBy("vec_id")
    near = own.orderBy("k")
    t = band(spark, sf_dir).withColumn("c", F.log("mag")).withColumn("b", F.lag("c").over(near)).withColumn("a", F.lead("c").over(near)).withColumn("med", F.percentile("mag", F.lit(0.5)).over(own)).withColumn("i", F.row_number().over(own.orderBy(F.desc("mag"), "k")))
    vertex = F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (F.col("b") - F.col("a")) / (F.col("b") - 2 * F.col("c") + F.col("a"))))
    return t.where("i = 1").select("vec_id", "k", F.round(F.col("mag") / F.col("med"), 4).alias("prominence"), F.round(F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(vertex), 4).alias("delta"))
