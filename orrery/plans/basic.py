"""Queries of single idioms: aggregates, windows and joins over the series. Each comes with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..sources.series import daily_lines, daily_orders, hourly_events, table
from .sql import EV, FILLED, RUNS

QUERIES, SQL = {}, {}
def win() -> WindowSpec:
    return S.ordered("channel")



def nudged(sql: str) -> str:
    """round(x, 6) as round(x + 1e-9, 6): sums of decimals end in a 5 often, and what is a tie must be one for both engines."""
    out, at = "", 0
    while (i := sql.find("round(", at)) >= 0:
        depth, j = 1, i + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        inner = nudged(sql[i + 6 : j - 1])
        out += sql[at:i] + ("round(1e-9 + " + inner if inner.endswith(", 6") else "round(" + inner) + ")"
        at = j
    return out + sql[at:]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = nudged(sql)
        return f

    return add


def r6(c) -> F.Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 6)


def big(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


@query(f"WITH {EV} SELECT channel, count(*) AS n, count(*) - count(v) AS n_missing, round(min(v), 6) AS v_min, round(max(v), 6) AS v_max, round(avg(v), 6) AS v_mean FROM s GROUP BY channel")
def describe_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_events(spark, sf_dir).groupBy("channel").agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("n_missing"), r6(F.min("v")).alias("v_min"), r6(F.max("v")).alias("v_max"), r6(F.avg("v")).alias("v_mean"))


@query(f"WITH {EV} SELECT channel, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS v_min, round(max(v), 6) AS v_max, round(max(v) - min(v), 6) AS ptp FROM s WHERE t BETWEEN 360000 AND 1800000 GROUP BY channel")
def channel_stats_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = hourly_events(spark, sf_dir).where(F.col("t").between(360000, 1800000))
    return inside.groupBy("channel").agg(F.count("v").alias("n"), r6(F.avg("v")).alias("mean"), r6(F.stddev_pop("v")).alias("std"), r6(F.min("v")).alias("v_min"), r6(F.max("v")).alias("v_max"), r6(F.max("v") - F.min("v")).alias("ptp"))


@query(f"WITH {EV} SELECT channel, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.99), 6) AS p99 FROM s GROUP BY channel")
def percentile_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_events(spark, sf_dir).groupBy("channel").agg(*[r6(F.percentile("v", F.lit(p))).alias(n) for p, n in ((0.05, "p5"), (0.5, "p50"), (0.99, "p99"))])


@query(f"WITH {EV}, x AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a, row_number() OVER (PARTITION BY channel ORDER BY v DESC NULLS LAST, seq) AS i FROM s WINDOW w AS (PARTITION BY channel ORDER BY seq)) SELECT channel, seq AS seq_max, round(v, 6) AS v_max, round(b, 6) AS v_before, round(a, 6) AS v_after FROM x WHERE i = 1")
def argmax_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = hourly_events(spark, sf_dir).withColumn("b", F.lag("v").over(win())).withColumn("a", F.lead("v").over(win()))
    top = near.groupBy("channel").agg(F.max_by(F.struct("seq", "v", "b", "a"), F.struct("v", -F.col("seq"))).alias("m"))
    return top.select("channel", F.col("m.seq").alias("seq_max"), r6("m.v").alias("v_max"), r6("m.b").alias("v_before"), r6("m.a").alias("v_after"))


@query("SELECT l_returnflag AS channel, l_shipdate AS ts, round(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2")
def dedup_timestamp_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("channel"), F.col("l_shipdate").alias("ts"), "l_quantity")
    return lines.groupBy("channel", "ts").agg(r6(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("v"), F.count("*").alias("n"))


@query(f"WITH {EV}, x AS (SELECT channel, (v + lag(v) OVER w) / 2 * (t - lag(t) OVER w) AS a FROM s WHERE v IS NOT NULL WINDOW w AS (PARTITION BY channel ORDER BY seq)) SELECT channel, round(sum(a), 3) AS integral FROM x GROUP BY channel")
def trapz_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = hourly_events(spark, sf_dir).where(F.col("v").isNotNull())
    area = (F.col("v") + F.lag("v").over(win())) / 2 * (F.col("t") - F.lag("t").over(win()))
    return known.withColumn("a", area).groupBy("channel").agg(F.round(F.sum("a"), 3).alias("integral"))


REFERENCE = FILLED + ", ref AS (SELECT channel, t, f FROM f WHERE seq % 24 = 0), x0 AS (SELECT f.channel, f.seq, f.t, f.v, a.t AS t0, a.f AS r0 FROM f ASOF JOIN ref a ON f.channel = a.channel AND f.t >= a.t), x1 AS (SELECT x0.*, b.t AS t1, b.f AS r1 FROM x0 ASOF LEFT JOIN ref b ON x0.channel = b.channel AND x0.t <= b.t), x AS (SELECT channel, seq, t, v, CASE WHEN t0 = t OR t1 IS NULL THEN r0 ELSE r0 + (r1 - r0) * (t - t0) / (t1 - t0) END AS r FROM x1)"


def against_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly series beside a coarser reference: every 24th filled sample, interpolated at all times."""
    s = hourly_events(spark, sf_dir)
    ref = s.withColumn("v", S.fill_linear("v", S.ordered("run_id", "channel"))).where("seq % 24 = 0")
    return S.interpolated(s, ref, ["run_id", "channel"])


@query(f"WITH {REFERENCE} SELECT channel, seq, round(r, 6) AS r FROM x")
def asof_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_reference(spark, sf_dir).select("channel", "seq", r6("r").alias("r"))


@query(f"WITH {REFERENCE}, d AS (SELECT channel, v - r AS d, r FROM x WHERE v IS NOT NULL) SELECT channel, count(*) AS n, round(sqrt(avg(d * d)), 6) AS rmse, round(avg(abs(r)), 6) AS scale FROM d GROUP BY channel")
def rmse_vs_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = against_reference(spark, sf_dir).where(F.col("v").isNotNull()).withColumn("d", F.col("v") - F.col("r"))
    return d.groupBy("channel").agg(F.count("*").alias("n"), r6(F.sqrt(F.avg(F.col("d") * F.col("d")))).alias("rmse"), r6(F.avg(F.abs("r"))).alias("scale"))


@query(f"WITH {EV}, x AS (SELECT channel, abs(v - quantile_cont(v, 0.5) OVER (PARTITION BY channel ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS d FROM s) SELECT channel, round(1.4826::DOUBLE * quantile_cont(d, 0.5), 6) AS sigma, count(*) FILTER (d > 0) AS n_moved FROM x GROUP BY channel")
def robust_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = hourly_events(spark, sf_dir).withColumn("d", F.abs(F.col("v") - S.roll_median("v", win(), 5)))
    return d.groupBy("channel").agg(r6(1.4826 * F.percentile("d", F.lit(0.5))).alias("sigma"), F.count_if(F.col("d") > 0).alias("n_moved"))


GAPS = f"{EV}, m AS (SELECT *, v IS NULL AS flag FROM s), {RUNS}, gaps AS (SELECT channel, min(seq) AS start, max(seq) + 1 AS stop, count(*) AS n, min(t) AS t0, max(t) AS t1 FROM r WHERE fl GROUP BY channel, run)"


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.islands(hourly_events(spark, sf_dir), F.col("v").isNull(), ["channel"])


@query(f"WITH {GAPS}, d AS (SELECT *, t0 - lag(t0) OVER (PARTITION BY channel ORDER BY t0) AS d FROM gaps) SELECT channel, count(*) AS n_gaps, CAST(sum(n) AS BIGINT) AS total, max(n) AS longest, round(quantile_cont(d, 0.5), 6) AS median_interval, count(*) FILTER (t0 BETWEEN 720000 AND 1440000) AS n_inside FROM d GROUP BY channel")
def gap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = gaps(spark, sf_dir).withColumn("d", F.col("t_start") - F.lag("t_start").over(S.ordered("channel", by="t_start")))
    return d.groupBy("channel").agg(F.count("*").alias("n_gaps"), F.sum("n").alias("total"), F.max("n").alias("longest"), r6(F.percentile("d", F.lit(0.5))).alias("median_interval"), F.count_if(F.col("t_start").between(720000, 1440000)).alias("n_inside"))


@query(f"WITH {EV}, x AS (SELECT channel, seq, v, avg(v) OVER w AS m, count(v) OVER w AS n FROM s WINDOW w AS (PARTITION BY channel ORDER BY seq ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)) SELECT channel, seq, round(CASE WHEN n >= 5 THEN m END, 6) AS m FROM x")
def roll_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = S.halo(hourly_events(spark, sf_dir), ["channel"], 5, 240)
    return parts.withColumn("m", S.roll_mean("v", S.ordered("channel", "bucket"), 10, 5)).where("own").select("channel", "seq", r6("m").alias("m"))


@query(f"WITH {EV} SELECT channel, seq, round(quantile_cont(v, 0.5) OVER (PARTITION BY channel ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS m FROM s")
def roll_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = S.halo(hourly_events(spark, sf_dir), ["channel"], 3, 240)
    return parts.withColumn("m", S.roll_median("v", S.ordered("channel", "bucket"), 7)).where("own").select("channel", "seq", r6("m").alias("m"))


@query(f"WITH {EV}, x AS (SELECT channel, seq, max(v) OVER w - min(v) OVER w AS d, count(v) OVER w AS n FROM s WINDOW w AS (PARTITION BY channel ORDER BY seq ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) SELECT channel, seq, round(CASE WHEN n = 6 THEN d END, 6) AS spread FROM x")
def roll_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_events(spark, sf_dir).select("channel", "seq", r6(S.trailing_range("v", win(), 6)).alias("spread"))


COMMAND = 260.0


@query(f"WITH {EV}, c AS (SELECT channel, seq, t, CASE WHEN v > {COMMAND} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c FROM s), d AS (SELECT *, c - lag(c) OVER (PARTITION BY channel ORDER BY seq) AS d FROM c) SELECT channel, seq, t, CASE WHEN d > 0 THEN 'open' ELSE 'close' END AS edge FROM d WHERE abs(d) > 0.5")
def command_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = hourly_events(spark, sf_dir).withColumn("c", F.when(F.col("v") > COMMAND, 1.0).otherwise(0.0))
    return c.withColumn("d", F.col("c") - F.lag("c").over(win())).where(F.abs("d") > 0.5).select("channel", "seq", "t", F.when(F.col("d") > 0, "open").otherwise("close").alias("edge"))


@query(f"WITH {EV}, m AS (SELECT *, round(v / 50) = lag(round(v / 50)) OVER (PARTITION BY channel ORDER BY seq) AS flag FROM s), {RUNS} SELECT channel, min(seq) - 1 AS start, max(seq) AS last, count(*) + 1 AS n, round(min(v), 6) AS low FROM r WHERE fl GROUP BY channel, run HAVING count(*) + 1 >= 3")
def flatline_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.round(F.col("v") / 50)
    s = hourly_events(spark, sf_dir).withColumn("same", level == F.lag(level).over(win()))
    found = S.islands(s, F.col("same"), ["channel"], F.min("v").alias("low"))
    return found.where("n + 1 >= 3").select("channel", (F.col("start") - 1).alias("start"), (F.col("stop") - 1).alias("last"), (F.col("n") + 1).alias("n"), r6("low").alias("low"))


@query(f"WITH {FILLED}, x AS (SELECT channel, seq, list(f) OVER (PARTITION BY channel ORDER BY seq ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS l FROM f) SELECT channel, seq, round(list_sort(list_concat(l, list_transform(range(11 - len(l)), lambda q: 0.0::DOUBLE)))[6], 6) AS m FROM x")
def medfilt11(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = hourly_events(spark, sf_dir).withColumn("f", S.fill_linear("v", win()))
    return filled.select("channel", "seq", r6(S.median_filter("f", win(), 11)).alias("m"))


@query(f"WITH {EV}, x AS (SELECT channel, v, seq, unnest([seq // 24, seq // 24 - 1]) AS k FROM s) SELECT channel, CAST(k AS BIGINT) AS k, count(v) AS n, round(avg(v), 6) AS mean FROM x WHERE k >= 0 AND k * 24 + 48 <= 720 GROUP BY channel, k HAVING count(*) = 48")
def hop_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.floor(F.col("seq") / 24)
    x = hourly_events(spark, sf_dir).withColumn("k", F.explode(F.array(k, k - 1))).where("k >= 0")
    return x.groupBy("channel", "k").agg(F.count("v").alias("n"), r6(F.avg("v")).alias("mean"), F.count("*").alias("rows")).where("rows = 48").select("channel", big("k").alias("k"), "n", "mean")


@query(f"WITH {FILLED}, p AS (SELECT a.seq, a.f AS x, b.f AS y FROM f a JOIN f b ON a.seq = b.seq WHERE a.channel = 'click' AND b.channel = 'view') SELECT CAST(seq // 36 AS BIGINT) AS k, round(quantile_cont(x / y, 0.5), 6) AS ratio FROM p GROUP BY 1 HAVING count(*) = 36 AND avg(CASE WHEN x > 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) > 0.9")
def tumbling_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = hourly_events(spark, sf_dir).withColumn("f", S.fill_linear("v", win()))
    wide = f.where(F.col("channel").isin("click", "view")).groupBy("seq").pivot("channel", ["click", "view"]).agg(F.first("f"))
    k = F.floor(F.col("seq") / 36).cast("long").alias("k")
    return wide.groupBy(k).agg(F.count("*").alias("n"), r6(F.percentile(F.col("click") / F.col("view"), F.lit(0.5))).alias("ratio"), F.avg(F.when(F.col("click") > 20, 1.0).otherwise(0.0)).alias("on")).where("n = 36 AND on > 0.9").select("k", "ratio")


@query("WITH e AS (SELECT user_id, epoch_us(ts) AS us, value, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS d, event_id FROM events WHERE value > 50 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(CASE WHEN d IS NULL OR d > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS run FROM e) SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS n, CAST(max(us) - min(us) AS BIGINT) AS us_long, max(value) AS top FROM r GROUP BY user_id, run")
def session_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events merge while the next comes within six hours of the last."""
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    e = table(spark, sf_dir, "events").where("value > 50").select("user_id", us.alias("us"), "value", "event_id")
    own = Window.partitionBy("user_id").orderBy("us", "event_id")
    r = S.numbered_runs(e, F.col("us") - F.lag("us").over(own) > 21_600_000_000, own)
    return r.groupBy("user_id", "run").agg(F.count("*").alias("n"), (F.max("us") - F.min("us")).alias("us_long"), F.max("value").alias("top"))


@query(f"WITH {EV}, x AS (SELECT channel, seq, v, seq - lag(seq) OVER w AS d, abs(v - lag(v) OVER w) AS dv, lag(v) OVER w AS b FROM s WHERE v > 250 WINDOW w AS (PARTITION BY channel ORDER BY seq)), r AS (SELECT *, sum(CASE WHEN d IS NULL OR d > 2 OR dv > greatest(20, 0.05 * b) THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY seq) AS run FROM x) SELECT channel, min(seq) AS first, max(seq) AS last, count(*) AS n, round(quantile_cont(v, 0.5), 6) AS mid FROM r GROUP BY channel, run")
def event_merge_tol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged samples merge while near in time and value to the last member, not the first."""
    x = hourly_events(spark, sf_dir).where("v > 250")
    last = F.lag("v").over(win())
    breaks = (F.col("seq") - F.lag("seq").over(win()) > 2) | (F.abs(F.col("v") - last) > F.greatest(F.lit(20.0), 0.05 * last))
    return S.numbered_runs(x, breaks, win()).groupBy("channel", "run").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("n"), r6(F.percentile("v", F.lit(0.5))).alias("mid")).drop("run")


@query(f"WITH {EV} SELECT channel, seq, max(CASE WHEN v IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS near_gap FROM s")
def nan_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_events(spark, sf_dir).select("channel", "seq", S.dilated(F.col("v").isNull(), win(), 2).alias("near_gap"))


@query(f"WITH {FILLED} SELECT channel, seq, round(f, 6) AS f FROM f")
def fill_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_events(spark, sf_dir).select("channel", "seq", r6(S.fill_linear("v", win())).alias("f"))


@query(f"WITH {FILLED} SELECT channel, seq, round(CASE WHEN v IS NOT NULL THEN v WHEN s0 IS NOT NULL AND s1 IS NOT NULL AND seq - s0 <= 1 THEN f END, 6) AS f FROM f")
def bridge_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_events(spark, sf_dir).select("channel", "seq", r6(S.bridge("v", win(), 1)).alias("f"))


CROSS = f"WITH {FILLED}, p AS (SELECT channel, arg_min(seq, (-f, seq)) AS k, max(f) AS top FROM f GROUP BY channel) "


def around_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled samples beside their channel's first maximum: k (its seq) and top."""
    f = hourly_events(spark, sf_dir).withColumn("f", S.fill_linear("v", win()))
    peak = f.groupBy("channel").agg(F.max_by("seq", F.struct("f", -F.col("seq"))).alias("k"), F.max("f").alias("top"))
    return f.join(peak, "channel")


@query(CROSS + "SELECT f.channel, min(seq) FILTER (seq >= k AND f < 0.5 * top) AS seq FROM f JOIN p ON f.channel = p.channel GROUP BY f.channel")
def first_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return around_peak(spark, sf_dir).groupBy("channel").agg(F.min(F.when((F.col("seq") >= F.col("k")) & (F.col("f") < 0.5 * F.col("top")), F.col("seq"))).alias("seq"))


@query(CROSS + "SELECT f.channel, max(seq) FILTER (seq <= k AND f < 0.5 * top) AS seq FROM f JOIN p ON f.channel = p.channel GROUP BY f.channel")
def last_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return around_peak(spark, sf_dir).groupBy("channel").agg(F.max(F.when((F.col("seq") <= F.col("k")) & (F.col("f") < 0.5 * F.col("top")), F.col("seq"))).alias("seq"))


DAYS = """li AS (SELECT l_returnflag AS channel, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS seq, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2),
od AS (SELECT CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS seq, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS v FROM orders GROUP BY 1)"""


@query(f"WITH {DAYS}, b AS (SELECT l.channel, l.seq, o.seq AS s0, o.v AS v0 FROM li l ASOF LEFT JOIN od o ON l.seq >= o.seq), a AS (SELECT b.*, o.seq AS s1, o.v AS v1 FROM b ASOF LEFT JOIN od o ON b.seq <= o.seq) SELECT channel, seq, round(CASE WHEN least(coalesce(seq - s0, 99999), coalesce(s1 - seq, 99999)) <= 1 THEN CASE WHEN coalesce(seq - s0, 99999) <= coalesce(s1 - seq, 99999) THEN v0 ELSE v1 END END, 6) AS near FROM a")
def asof_nearest_tol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest order day within one day of each ship day; ties go to the earlier, beyond that NULL."""
    left = daily_lines(spark, sf_dir).select(F.lit(0).alias("key"), "channel", "seq", F.col("t") / 86400)
    left = left.toDF("key", "channel", "seq", "t")
    right = daily_orders(spark, sf_dir).select(F.lit(0).alias("key"), (F.col("t") / 86400).alias("t"), "v")
    found = S.as_of(left.withColumn("part", F.floor(F.col("t") / 256)), halo_days(right), ["part"])
    d0, d1 = F.coalesce(F.col("t") - F.col("before.at"), F.lit(99999.0)), F.coalesce(F.col("after.at") - F.col("t"), F.lit(99999.0))
    return found.select("channel", "seq", r6(F.when(F.least(d0, d1) <= 1, F.when(d0 <= d1, F.col("before.v")).otherwise(F.col("after.v")))).alias("near"))


def halo_days(right: DataFrame, days: int = 256, reach: int = 1) -> DataFrame:
    """Rows in every part of so many days that they can be matched from."""
    part = lambda d: F.floor((F.col("t") + d) / days)
    return right.withColumn("part", F.explode(F.array_distinct(F.array(part(-reach), part(0), part(reach)))))
