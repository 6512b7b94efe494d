"""Named operators with their parameters: what a ledger may record and a planner may call."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import __version__
from .operators import cards, oscillation
from .sources import runs


@dataclass(frozen=True)
class Operator:
    name: str
    description: str
    parameters: dict[str, type]
    run: Callable[..., dict[str, DataFrame]]
    required: tuple[str, ...] = field(default=())

    def schema(self) -> dict:
        """The parameters as a JSON schema, for callers that choose tools by it."""
        names = {str: "string", float: "number", int: "integer", bool: "boolean"}
        return {"type": "object", "properties": {k: {"type": names[t]} for k, t in self.parameters.items()}, "required": list(self.required)}

    @property
    def version(self) -> str:
        return f"{__version__}+{hashlib.sha256(inspect.getsource(self.run).encode()).hexdigest()[:10]}"

    def __call__(self, tables: dict[str, DataFrame], **params) -> dict[str, DataFrame]:
        """Nulls are dropped; unknown and missing parameters are refused."""
        params = {k: v for k, v in params.items() if v is not None}
        if unknown := set(params) - set(self.parameters):
            raise ValueError(f"{self.name} has no parameter {', '.join(sorted(unknown))}; it has {', '.join(sorted(self.parameters)) or 'none'}")
        if missing := set(self.required) - set(params):
            raise ValueError(f"{self.name} needs {', '.join(sorted(missing))}")
        return self.run(tables, **params)


REGISTRY: dict[str, Operator] = {}


def operator(description: str, required: tuple[str, ...] = (), **parameters: type):
    def add(f):
        REGISTRY[f.__name__] = Operator(f.__name__, description, parameters, f, required)
        return f

    return add


def get(name: str) -> Operator:
    if name not in REGISTRY:
        raise KeyError(f"no operator {name}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


def only(tables: dict, channel: str | None) -> DataFrame:
    s = tables["samples"]
    return s if channel is None else s.where(F.col("channel") == channel)


def about(tables: dict) -> DataFrame:
    """(channel, unit, kind, native_rate_hz): as tables say in channels, or units and families; else by the channels' names."""
    if "channels" in tables:
        known = tables["channels"]
        return known if "native_rate_hz" in known.columns else known.withColumn("native_rate_hz", F.lit(None).cast("double"))
    named = sorted(r.channel for r in tables["samples"].select("channel").distinct().collect())
    units = {r.channel: r.unit for r in tables["units"].collect()} if "units" in tables else {}
    families = {r.channel: r.family for r in tables["families"].collect()} if "families" in tables else {}
    rows = [(c, units.get(c, ""), families.get(c) or runs.kind(c, units.get(c, "")), None) for c in named]
    return tables["samples"].sparkSession.createDataFrame(rows, "channel string, unit string, kind string, native_rate_hz double")


def phases_of(tables: dict) -> DataFrame:
    """run_phases() of the runs; tables may bring them as phases, so that they are found once."""
    return tables["phases"] if "phases" in tables else cards.run_phases(tables["samples"], about(tables), tables["fs"], tables.get("segments"))


def segments_of(tables: dict) -> DataFrame:
    """segment_phases() of all pressures and forces; tables may bring it as segments."""
    if "segments" in tables:
        return tables["segments"]
    wanted = about(tables).where(F.col("kind").isin("pressure", "force")).select("channel").distinct()
    return cards.segment_phases(tables["samples"].join(F.broadcast(wanted), "channel", "left_semi").select("run_id", "channel", "seq", "t", "v"), tables["fs"])


def window_of(tables: dict, samples: DataFrame, phase: str | None, t_start: float | None, t_end: float | None, default: str | None) -> DataFrame:
    """Samples of a phase or between times; without any of them those of the default phase, of runs that have it, and all of others."""
    if phase is None and t_start is None and t_end is None and default is not None:
        own = cards.phase_windows(phases_of(tables)).where(F.col("phase") == default).drop("phase")
        joined = samples.join(F.broadcast(own), "run_id", "left")
        return joined.where(F.col("t_lo").isNull() | F.col("t").between(F.col("t_lo"), F.col("t_hi"))).select(samples.columns)
    return cards.windowed(samples, phases_of(tables) if phase is not None else None, phase, t_start, t_end)


def setting(tables: dict, name: str, given, default):
    return given if given is not None else tables.get("settings", {}).get(name, default)


def hold(tables: dict, df: DataFrame) -> DataFrame:
    """df kept, as it is small and read several times; who called the operator may release what tables["held"] lists."""
    tables.setdefault("held", []).append(df.cache())
    return df


def beside_units(tables: dict, rows: DataFrame) -> DataFrame:
    """rows with the unit of their channel, where one is known."""
    known = about(tables).select("channel", F.nullif("unit", F.lit("")).alias("unit"))
    return rows.join(F.broadcast(known), "channel", "left")


@operator("Extent, range, unit and kind of every channel.")
def describe_data(tables):
    stats = cards.describe_data(tables["samples"]).join(F.broadcast(about(tables)), "channel", "left")
    here = tables["samples"].groupBy("run_id").agg((F.max("t") - F.min("t")).alias("duration_s"), F.count_distinct("seq").alias("n_samples"))
    facts = here.select("run_id", "duration_s", "n_samples", F.lit(float(tables["fs"])).alias("sample_rate_hz"), F.lit("reference" in tables).alias("has_reference"), F.lit("redlines" in tables).alias("has_limits"))
    return {"run": facts, "channels": stats}


@operator("Statistics of a channel inside a window, mainstage unless one is given.", t_start=float, t_end=float, channel=str, phase=str)
def channel_stats(tables, channel=None, t_start=None, t_end=None, phase=None):
    return {"stats": beside_units(tables, cards.channel_stats(window_of(tables, only(tables, channel), phase, t_start, t_end, "mainstage")))}


@operator("Phases of a firing, by the primary channel or the given one; and the commands' edges.", channel=str)
def segment_phases(tables, channel=None):
    kinds = about(tables)
    if channel is not None:
        found = cards.run_phases(only(tables, channel), kinds.where(F.col("channel") == channel).withColumn("kind", F.lit("pressure")), tables["fs"])
    else:
        found = phases_of(tables)
    commands = tables["samples"].join(F.broadcast(kinds.where("kind = 'command'").select("channel")), "channel", "left_semi")
    return {"phases": beside_units(tables, found), "windows": cards.phase_windows(found).select("run_id", "phase", *[F.when(F.abs(c) < 1e300, F.col(c)).alias(c) for c in ("t_lo", "t_hi")]), "command_events": cards.command_edges(commands).select("run_id", "channel", "t", "edge")}


@operator("Excursions beyond redlines that last.", persistence_s=float)
def check_redlines(tables, persistence_s=None):
    if "redlines" not in tables:
        none = tables["samples"].limit(0).select("run_id", "channel")
        return {"violations": none, "suppressed": none}
    violations, suppressed = cards.check_redlines(tables["samples"], tables["redlines"], tables["fs"], setting(tables, "redline_persistence_s", persistence_s, 0.01))
    return {"violations": beside_units(tables, violations), "suppressed": suppressed}


@operator("Gaps, dead and duplicate channels, flatlines, spikes alone and coincident, impossible values and no return to baseline.")
def check_sensor_health(tables):
    """Commands and housekeeping aren't checked. Tables without channels (or units and families) leave units and families to the names."""
    fs, known = tables["fs"], about(tables)
    checked = known.where(~F.col("kind").isin("command", "housekeeping"))
    s = tables["samples"].join(F.broadcast(checked.select("channel")), "channel", "left_semi").select("run_id", "channel", "seq", "t", "v")
    dead = cards.dead_channels(s)
    moving = s.join(F.broadcast(dead.select(*cards.KEYS)), cards.KEYS, "left_anti")  # a dead channel has no further issues
    phases = phases_of(tables)
    firing = phases.where("fired").select("run_id", F.col("ignition_s").alias("fire_start"), F.col("tail_off_end_s").alias("fire_end"))
    rates = sorted({r[0] for r in checked.select("native_rate_hz").distinct().collect()}, key=lambda x: (x is not None, x))
    by_rate = [(moving.join(F.broadcast(checked.where(F.col("native_rate_hz").eqNullSafe(F.lit(r).cast("double"))).select("channel")), "channel", "left_semi").select(moving.columns), min(r, fs) if r else None) for r in rates]
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    spikes = union([cards.spikes(m, fs, r) for m, r in by_rate]) if by_rate else cards.spikes(moving, fs)
    spikes = hold(tables, spikes)
    flat = union([cards.flatlines(m, fs, r, firing=firing) for m, r in by_rate]) if by_rate else cards.flatlines(moving, fs, firing=firing)
    families = checked.select("channel", F.split("kind", "_")[0].alias("family"))
    # Without channels what a sensor measures is a guess by its name, and every one may have a pulse.
    pulses = segments_of(tables) if "channels" in tables and not tables.get("guessed") else cards.segment_phases(moving, fs)
    found = {"gaps": cards.gap_issues(s).withColumnsRenamed({"total": "total_samples", "longest": "longest_samples"}), "dead": dead, "duplicates": cards.duplicate_channels(s), "flatlines": flat, "coincident_spikes": cards.coincident(spikes, families)}
    alone = spikes.join(cards.coincident_hits(spikes, families), [*cards.KEYS, "t"], "left_anti").select(*spikes.columns)
    return found | {"impossible": cards.impossible_values(moving, checked.select("channel", "unit"), fs), "spikes": alone, "no_return": cards.no_return_to_baseline(moving, pulses, fs)}


@operator("Lines of one frequency that stand out, on the primary pressure and in mainstage unless others are given; lines that are there before ignition are interference.", channel=str, t_start=float, t_end=float, phase=str, fmin=float, fmax=float, threshold_pct=float, window_s=float, min_windows=int)
def detect_oscillation(tables, channel=None, t_start=None, t_end=None, phase=None, **options):
    fs, phases = tables["fs"], phases_of(tables)
    asked = {n: setting(tables, n, options.get(n), d) for n, d in (("fmin", 50.0), ("fmax", 2000.0), ("threshold_pct", 0.5), ("window_s", 0.1), ("min_windows", 3))}
    known = about(tables).where("native_rate_hz IS NOT NULL")
    if channel is None:
        primary = phases.select("run_id", "channel")
        samples = tables["samples"].join(F.broadcast(primary), cards.KEYS, "left_semi")
        rate = known.join(F.broadcast(primary.select("channel").distinct()), "channel", "left_semi").agg(F.min("native_rate_hz")).first()[0]
    else:
        samples = only(tables, channel)
        rate = known.where(F.col("channel") == channel).agg(F.min("native_rate_hz")).first()[0]
    samples = samples.select("run_id", "channel", "seq", "t", "v")
    inside = window_of(tables, samples, phase, t_start, t_end, "mainstage")
    events = hold(tables, oscillation.detect_both(inside, fs, native=rate, hold=lambda df: hold(tables, df), **asked))
    quiet = samples.join(F.broadcast(phases.where("fired").select("run_id", "ignition_s")), "run_id").where(F.col("t").between(F.col("ignition_s") - 2.2, F.col("ignition_s") - 0.2))
    events = hold(tables, beside_units(tables, oscillation.before_ignition(events, quiet.select(samples.columns), fs)).withColumn("threshold_pct", F.lit(asked["threshold_pct"])))
    there = F.coalesce(F.col("pre_ignition_amp") >= 0.5 * F.col("peak_amp"), F.lit(False))
    return {"events": events.where(~there), "interference": events.where(there)}


@operator("Other channels that show the oscillations of the primary one, in their windows.", fmin=float, fmax=float, threshold_pct=float)
def corroborate_oscillation(tables, **options):
    found = detect_oscillation(tables, **options)["events"]
    asked = {n: setting(tables, n, options.get(n), d) for n, d in (("fmin", 50.0), ("fmax", 2000.0), ("threshold_pct", 0.5))}
    return {"events": oscillation.corroborated(found, tables["samples"], about(tables).select("channel", "kind"), tables["fs"], **asked)}


@operator("Time from a command to its response.")
def measure_valve_response(tables):
    if "valve_pairs" not in tables:
        return {"events": tables["samples"].limit(0).select("run_id", "channel")}
    return {"events": cards.valve_response(tables["samples"], tables["valve_pairs"], tables["fs"])}


@operator("Deviation from the predicted series.", tolerance_pct=float, channel=str, phase=str, t_start=float, t_end=float)
def compare_reference(tables, tolerance_pct=None, channel=None, phase=None, t_start=None, t_end=None):
    if "reference" not in tables:
        raise ValueError("compare_reference needs a predicted series")
    tolerance = setting(tables, "reference_tolerance_pct", tolerance_pct, 2.0)
    predicted = tables["reference"].select("channel").distinct()
    samples = only(tables, channel).join(F.broadcast(predicted), "channel", "left_semi").select("run_id", "channel", "seq", "t", "v")
    summary, runs = cards.compare_reference(window_of(tables, samples, phase, t_start, t_end, None), tables["reference"], tables["fs"], tolerance)
    named = lambda df: beside_units(tables, df).withColumn("tolerance_pct", F.lit(float(tolerance)))
    return {"summary": named(summary), "intervals": named(runs)}


@operator("Baseline, peak and integral of a pulse: of the forces, unless a channel is given.", channel=str, start_pct=float, end_pct=float, subtract_baseline=bool)
def pulse_metrics(tables, channel=None, **options):
    samples = only(tables, channel)
    if channel is None:
        forces = about(tables).where("kind = 'force'").select("channel")
        primary = phases_of(tables).select("run_id", "channel").join(F.broadcast(tables["samples"].join(F.broadcast(forces), "channel", "left_semi").select("run_id").distinct()), "run_id", "left_anti")
        chosen = tables["samples"].join(F.broadcast(forces), "channel", "left_semi").select("run_id", "channel").distinct().unionByName(primary)
        samples = samples.join(F.broadcast(chosen), cards.KEYS, "left_semi")
    found = beside_units(tables, cards.pulse_metrics(samples.select("run_id", "channel", "seq", "t", "v"), tables["fs"], **options))
    return {"pulses": found.withColumn("integral_unit", F.concat("unit", F.lit("·s")))}


@operator("Drift of the ratio of two channels' pulses.", ("thrust", "pressure"), thrust=str, pressure=str, max_change_pct=float)
def check_thrust_pressure_ratio(tables, thrust, pressure, max_change_pct=50.0):
    found = cards.thrust_pressure_ratio(tables["samples"], thrust, pressure, tables["fs"], max_change_pct, tables.get("phases"))
    return {"ratio": found.withColumns({"thrust": F.lit(thrust), "pressure": F.lit(pressure), "max_change_pct": F.lit(float(max_change_pct))})}


@operator("Range of channels inside a window.", ("t_start", "t_end"), channel=str, t_start=float, t_end=float)
def plot_window(tables, t_start, t_end, channel=None):
    return {"stats": cards.channel_stats(only(tables, channel), t_start, t_end).select(*cards.KEYS, "min", "max", "mean")}
