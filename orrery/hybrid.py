"""Known faults put into recorded runs: what size of fault is found on real backgrounds, and what is found that isn't there.

Backgrounds, kinds, levels and repetitions make a grid of jobs; each job is a run of its own, made from its background by column
expressions, and all are analysed together, beside one clean run of each background with the same limits.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import planner, registry
from .functions import sequence as S
from .operators import cards

#: Levels of each kind (percent of the pulse, seconds, sigmas), the category it is to be found as and by which tool.
LEVELS = {"oscillation": [0.25, 0.5, 1.0, 2.0, 4.0], "redline": [0.005, 0.01, 0.02, 0.05, 0.2], "deviation": [1.0, 2.0, 3.0, 5.0, 8.0], "spike": [6.0, 12.0, 24.0, 48.0], "dropout": [0.01, 0.05, 0.2, 1.0], "stuck": [0.02, 0.05, 0.2, 1.0]}
FOUND_AS = {
    "oscillation": ("combustion_oscillation", "detect_oscillation"), "redline": ("redline_violation", "check_redlines"), "deviation": ("performance_deviation", "compare_reference"),
    "spike": ("sensor_fault", "check_sensor_health"), "dropout": ("sensor_fault", "check_sensor_health"), "stuck": ("sensor_fault", "check_sensor_health"),
}
SETTINGS = {"redline_persistence_s": 0.01, "reference_tolerance_pct": 2.0}
CONTEXT = ["describe_data", "segment_phases", "channel_stats", "plot_window"]
CLEAN = "clean"


def chance(seed: int, *parts) -> float:
    """Between 0 and 1, by the parts alone."""
    return zlib.crc32("\u0001".join(map(str, (seed, *parts))).encode()) / 2**32


def jobs(spark: SparkSession, tables: dict, kinds: list[str] | None = None, reps: int = 3, seed: int = 0, levels: dict | None = None) -> DataFrame:
    """The grid: background, kind, level (null: clean), rep, run_id, and of the fault its channel, t0, t1, and size (in the channel's units), freq_hz.

    Kinds that a background can't carry (no clear pulse of Pc, no force, too slow a rate) are left out.
    """
    known, fs = registry.about(tables), float(tables["fs"])
    force = min((r.channel for r in known.where("kind = 'force'").collect()), default=None)
    native = {r.channel: r.native_rate_hz for r in known.collect()}
    samples = tables["samples"].select("run_id", "channel", "seq", "t", "v")
    own = cards.run_phases(samples.where("channel = 'Pc'"), known.where("channel = 'Pc'").withColumn("kind", F.lit("pressure")), fs).where("fired")
    pulse = {r.run_id: r for r in own.collect()}
    default = {r.run_id: r for r in registry.phases_of(tables).where("fired").collect()}
    top = {r.run_id: r.top for r in samples.where("channel = 'Pc'").groupBy("run_id").agg(F.max("v").alias("top")).collect()}
    step = samples.where(F.col("channel") == force).withColumn("d", F.col("v") - F.lag("v").over(S.ordered("run_id", "channel")))
    middle = step.groupBy("run_id").agg(F.percentile("d", F.lit(0.5)).alias("m"))
    sigma = {r.run_id: 1.4826 * (r.s or 0.0) / 2**0.5 for r in step.join(F.broadcast(middle), "run_id").groupBy("run_id").agg(F.percentile(F.abs(F.col("d") - F.col("m")), F.lit(0.5)).alias("s")).collect()}
    rows = []
    for background in sorted(r.run_id for r in samples.select("run_id").distinct().collect()):
        for kind in kinds or LEVELS:
            slow = kind in ("oscillation", "redline", "deviation")
            p = (pulse if slow else default).get(background)
            f_hi = 0.4 * (native.get("Pc") or fs)
            if p is None or (not slow and force is None) or (kind == "oscillation" and f_hi < 100):
                continue
            a, b, rise = p.mainstage_start_s, p.mainstage_end_s, p.steady_level - p.baseline
            rows.append((background, kind, None, 0, f"{background}|{kind}|{CLEAN}", None, None, None, None, None))
            for level in (levels or LEVELS)[kind]:
                for rep in range(reps):
                    u, w = (chance(seed, background, kind, level, rep, x) for x in ("time", "freq"))
                    long = {"oscillation": min(1.0, 0.5 * (b - a)), "deviation": 0.4 * (b - a), "spike": 0.0}.get(kind, level)
                    edge = 0.05 * (b - a) if kind == "deviation" else 0.1 * (b - a) if kind == "spike" else 0.1
                    t0 = a + edge + u * max(0.0, b - a - long - 2 * edge)
                    size = {"oscillation": level / 100 * rise, "deviation": level / 100 * rise, "redline": 1.03 * 1.05 * top[background], "spike": level * max(sigma.get(background, 0.0), 1e-9)}.get(kind, 0.0)
                    rows.append((background, kind, level, rep, f"{background}|{kind}|{level:g}|{rep}", "Pc" if slow else force, t0, t0 + long, size, 80 + w * (f_hi - 80) if kind == "oscillation" else None))
    return spark.createDataFrame(rows, "background string, kind string, level double, rep long, run_id string, channel string, t0 double, t1 double, size double, freq_hz double")


def injected(samples: DataFrame, grid: DataFrame, fs: float) -> DataFrame:
    """The samples of every job's run: its background's, with the fault on its channel."""
    asked = grid.select("background", "run_id", "kind", F.col("channel").alias("on"), "t0", "t1", "size", "freq_hz")
    both = samples.withColumnRenamed("run_id", "background").join(F.broadcast(asked), "background")
    t, v = F.col("t"), F.col("v")
    inside = (t >= F.col("t0")) & (t < F.col("t1"))
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    shape = lambda edge: clip((t - F.col("t0")) / edge) * clip((F.col("t1") - t) / edge)
    before = F.last(F.when(t < F.col("t0"), v), True).over(S.ordered("run_id", "channel").rowsBetween(S.Window.unboundedPreceding, 0))
    level = F.avg(F.when(inside, v)).over(S.Window.partitionBy("run_id", "channel"))
    faulty: Column = (
        F.when(F.col("kind") == "oscillation", v + F.col("size") * shape(0.05) * F.sin(2 * F.pi() * F.col("freq_hz") * t))
        .when((F.col("kind") == "redline") & inside, F.col("size") + 0.1 * (v - level)).when(F.col("kind") == "deviation", v - F.col("size") * shape(0.1))
        .when((F.col("kind") == "spike") & (F.floor(F.col("t0") * fs) == F.floor(t * fs + 1e-6)), v + F.col("size")).when((F.col("kind") == "dropout") & inside, F.lit(None)).when((F.col("kind") == "stuck") & inside & v.isNotNull(), before)
        .otherwise(v)
    )
    return both.withColumn("v", F.when(F.col("channel") == F.col("on"), faulty).otherwise(v)).select("run_id", "channel", "seq", "t", "v")


def around(spark: SparkSession, tables: dict, grid: DataFrame) -> dict:
    """Limits and predictions that a job and its clean run share: a redline above all that the background reaches, a smoothed Pc as prediction."""
    pc = tables["samples"].where("channel = 'Pc'").select("run_id", "channel", "seq", "t", "v")
    top = pc.groupBy(F.col("run_id").alias("background")).agg((1.05 * F.max("v")).alias("limit"))
    lines = grid.where("kind = 'redline'").join(F.broadcast(top), "background").select("run_id", F.lit("Pc").alias("channel"), F.lit("max").alias("kind"), "limit")
    fs, win = float(tables["fs"]), S.ordered("run_id", "channel")
    smooth = cards.wide_median(pc.withColumn("f", S.fill_linear("v", win)), "f", "m", max(int(0.2 * fs), 1))
    thin = smooth.where(F.col("seq") % max(int(fs // 50), 1) == 0).select(F.col("run_id").alias("background"), "channel", "t", F.col("m").alias("v"))
    predicted = thin.join(F.broadcast(grid.where("kind = 'deviation'").select("background", "run_id")), "background").select("run_id", "channel", "t", "v")
    return {"redlines": spark.createDataFrame(lines.collect(), lines.schema), "reference": predicted}


def score(grid: DataFrame, claims: DataFrame, covered: DataFrame, tol: float = 0.25) -> DataFrame:
    """Each job with detected, masked and false_positives.

    claims: run_id, finding_id, category, tool, channel, t_start, t_end. What a job's run claims is new unless a clean run of its
    background claims the same (category, tool, channel) over all of its time. A hit is a new claim of the job's category on its channel, or
    none, at its time. masked: no hit, but a clean run claims it there already, or (a deviation) explains the channel away (covered:
    run_id, channel). False positives are new claims that aren't hits and that no clean run makes on any channel at that time.
    """
    of = {k: (c, t) for k, (c, t) in FOUND_AS.items()}
    category = F.create_map(*[x for k, (c, _) in of.items() for x in (F.lit(k), F.lit(c))])
    tool = F.create_map(*[x for k, (_, t) in of.items() for x in (F.lit(k), F.lit(t))])
    named = grid.withColumn("want", category[F.col("kind")]).withColumn("by", tool[F.col("kind")])
    told = claims.join(named.select("run_id", "background", "level"), "run_id")
    end = lambda a: F.coalesce(f"{a}.t_end", f"{a}.t_start")
    clean = told.where("level IS NULL").select("background", "category", "tool", "channel", "t_start", "t_end").alias("b")
    own = told.where("level IS NOT NULL").alias("f")
    alike = (F.col("f.background") == F.col("b.background")) & (F.col("f.category") == F.col("b.category")) & (F.col("f.tool") == F.col("b.tool"))
    timeless = F.col("f.t_start").isNull() | F.col("b.t_start").isNull()
    within = timeless | ((F.col("b.t_start") - tol <= F.col("f.t_start")) & (end("f") <= end("b") + tol))
    touches = timeless | ((F.col("f.t_start") <= end("b") + tol) & (F.col("b.t_start") - tol <= end("f")))
    fresh = own.join(clean, alike & F.col("f.channel").eqNullSafe(F.col("b.channel")) & within, "left_anti")
    job = named.where("level IS NOT NULL").select("run_id", "background", "kind", "level", "rep", F.col("channel").alias("on"), "t0", "t1", "want", "by")
    seen = fresh.select("f.run_id", "f.finding_id", "f.category", "f.channel", "f.t_start", "f.t_end", "f.tool", "f.background").join(job.drop("background", "kind", "level", "rep"), "run_id")
    at = F.col("t_start").isNull() | ((F.col("t_start") <= F.col("t1") + tol) & (F.col("t0") - tol <= F.coalesce("t_end", "t_start")))
    hit = (F.col("category") == F.col("want")) & (F.col("channel").isNull() | (F.col("channel") == F.col("on"))) & at
    seen = seen.withColumn("hit", hit)
    hits = seen.where("hit").groupBy("run_id").agg(F.count("*").alias("hits"))
    extra = seen.where("not hit").alias("f").join(clean, alike & touches, "left_anti").groupBy("run_id").agg(F.count("*").alias("false_positives"))
    there = job.alias("f").join(clean, (F.col("f.background") == F.col("b.background")) & (F.col("f.want") == F.col("b.category")) & (F.col("f.by") == F.col("b.tool")) & (F.col("f.on") == F.col("b.channel"))
                                & (F.col("b.t_start").isNull() | ((F.col("b.t_start") <= F.col("f.t1") + tol) & (F.col("f.t0") - tol <= end("b")))), "left_semi").select("run_id", F.lit(True).alias("there"))
    away = covered.join(named.where("level IS NULL").select("run_id", "background"), "run_id").select("background", F.col("channel").alias("on"), F.lit(True).alias("away")).distinct()
    out = job.join(hits, "run_id", "left").join(extra, "run_id", "left").join(there, "run_id", "left").join(away, ["background", "on"], "left")
    detected = F.coalesce(F.col("hits") > 0, F.lit(False))
    masked = ~detected & (F.coalesce("there", F.lit(False)) | ((F.col("kind") == "deviation") & F.coalesce("away", F.lit(False))))
    return out.select("run_id", "background", "kind", "level", "rep", detected.alias("detected"), masked.alias("masked"), F.coalesce("false_positives", F.lit(0)).alias("false_positives"))


def summarize(scored: DataFrame) -> DataFrame:
    """Counts for each background, kind and level, and over all backgrounds (background null)."""
    sums = [F.count("*").alias("n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in ("detected", "masked", "false_positives")]]
    every = scored.groupBy("kind", "level").agg(*sums).withColumn("background", F.lit(None).cast("string"))
    return scored.groupBy("background", "kind", "level").agg(*sums).unionByName(every).select("kind", "level", "background", "n", "detected", "masked", "false_positives")


def run_hybrid(spark: SparkSession, tables: dict, lang: str = "en", **options) -> DataFrame:
    """score() of the rule playbook on all jobs of the backgrounds in tables (samples, fs, channels)."""
    grid = jobs(spark, tables, **options)
    made = injected(tables["samples"].select("run_id", "channel", "seq", "t", "v"), grid, float(tables["fs"])).cache()
    case = {"samples": made, "fs": tables["fs"], "channels": registry.about(tables), "settings": SETTINGS, **around(spark, tables, grid)}
    book, _ = planner.analyse(spark, case, lang)
    kinds = {r.channel: r.kind for r in book.tables["channels"].collect()}
    by_run: dict[str, list] = {}
    for e in book.rows:
        by_run.setdefault(e["run_id"], []).append(e)
    claims, covered = [], []
    for run, entries in by_run.items():
        tools = {e["evidence_id"]: e["tool"] for e in entries}
        found, away = planner.conclude(run, entries, kinds, planner.Words(lang))
        covered += [(run, c) for c in away]
        for i, f in enumerate(found):
            if f["category"] != "observation":
                own = [tools[e] for e in f["evidence"]]
                claims.append((run, i, f["category"], next((t for t in own if t not in CONTEXT), own[0]), f["channel"], f["t_start"], f["t_end"]))
    told = spark.createDataFrame(claims, "run_id string, finding_id long, category string, tool string, channel string, t_start double, t_end double")
    return score(grid, told, spark.createDataFrame(covered, "run_id string, channel string"))
