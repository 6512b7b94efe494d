"""Labelled runs for tests and benchmarks: channels of an engine firing with known faults and with features that are none.

Each run is made from its seed alone, by numpy in the task that holds its row, so any number of runs is made side by side; each
fault draws from a generator of its own, so adding one changes no other.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The engine, its sequence, channels with units and kinds, and what may go wrong with the category it is to be found as.
ENGINE = {"pc_nom": 5.0, "dp_ox": 0.8, "dp_fu": 1.0, "mdot_ox": 6.1, "mdot_fu": 2.4, "t_wall_amb": 290.0, "t_wall_ss": 620.0, "valve_dead_ms": 15.0, "valve_tau_ms": 30.0, "ign_delay_ms": 50.0, "pc_rise_s": 0.35, "pc_tail_tau_s": 0.08}
SEQUENCE = {"cmd_ox_open": 0.8, "cmd_fu_open": 0.9, "cmd_close": 9.0, "duration": 12.0}
CHANNELS = {
    "Pc": ("MPa", "pressure"), "P_ox_inj": ("MPa", "pressure"), "P_fu_inj": ("MPa", "pressure"), "mdot_ox": ("kg/s", "flow"), "mdot_fu": ("kg/s", "flow"), "T_cool_out": ("K", "temperature"), "vib_axial": ("g", "vibration"),
    "cmd_ox": ("-", "command"), "cmd_fu": ("-", "command"),
}
CLASSIC = {
    "oscillation": "combustion_oscillation", "overtemp": "redline_violation", "sensor_dropout": "sensor_fault", "sensor_spike": "sensor_fault", "valve_delay": "valve_response", "pc_deficit": "performance_deviation",
}
REALISTIC = ["daq_dropout", "sensor_saturation", "pc_stuck_after_shutdown", "zero_offset", "duplicate_channel", "dead_channel", "mains_hum"]
NUISANCES = ["startup_spike", "shutdown_slam", "quantization"]
ANOMALIES = CLASSIC | dict.fromkeys(REALISTIC, "sensor_fault")
REDLINES = {"Pc": 5.6, "P_ox_inj": 6.67, "P_fu_inj": 6.9, "T_cool_out": 700.0}
LATENCY_MS = 40.0

SAMPLES = "run_id string, channel string, seq long, t double, v double"
TRUTH = "run_id string, truth_id long, type string, channel string, t_start double, t_end double, related array<string>, params string, category string"
PRESSURES = ["Pc", "P_ox_inj", "P_fu_inj"]
STEADY = (1.8, 8.7)  # where mainstage is sure to be


def smooth(x: np.ndarray) -> np.ndarray:
    """From 0 to 1 without a corner."""
    x = np.clip(x, 0, 1)
    return x * x * (3 - 2 * x)


def hump(t: np.ndarray, start: float, stop: float, edge: float) -> np.ndarray:
    return smooth((t - start) / edge) * smooth((stop - t) / edge)


class Firing:
    """One run: its signals, and what was done to them."""

    def __init__(self, seed: int, anomalies: list[str], nuisances: list[str], fs: float) -> None:
        self.seed, self.fs, self.truth, self.asked = seed, fs, [], set(anomalies)
        self.t = np.arange(round(SEQUENCE["duration"] * fs)) / fs
        self.delay = self.draw("valve_delay").uniform(0.04, 0.12) if "valve_delay" in anomalies else 0.0
        self.v = self.ideal(self.delay)
        for name in ("valve_delay", "pc_deficit", "oscillation", "overtemp"):
            self.apply(name, anomalies)
        for name in ("startup_spike", "shutdown_slam"):
            self.apply(name, nuisances)
        self.measure()
        for name in ("mains_hum", "sensor_spike", "sensor_dropout", "sensor_saturation", "pc_stuck_after_shutdown", "zero_offset", "duplicate_channel", "dead_channel"):
            self.apply(name, anomalies)
        self.apply("quantization", nuisances)
        self.apply("daq_dropout", anomalies)

    def draw(self, name: str) -> np.random.Generator:
        return np.random.default_rng([self.seed, zlib.crc32(name.encode())])

    def apply(self, name: str, wanted: list[str]) -> None:
        if name in wanted:
            getattr(self, name)(self.draw(name))

    def note(self, type_: str, channel: str, start: float, stop: float, related: list[str] = (), **params) -> None:
        self.truth.append((type_, channel, float(start), float(stop), list(related), json.dumps(params)))

    def taken(self) -> set[str]:
        return {c for x in self.truth for c in (x[1], *(x[4] if x[1] == "*" else ()))}

    def ideal(self, delay: float) -> dict[str, np.ndarray]:
        """The signals of a run as predicted, its fuel valve late by delay."""
        e, q, t = ENGINE, SEQUENCE, self.t
        tau, dead = e["valve_tau_ms"] / 1e3, e["valve_dead_ms"] / 1e3
        off = q["cmd_close"] + dead

        def valve(opened: float) -> np.ndarray:
            up = 1 - np.exp(-np.clip(t - opened, 0, None) / tau)
            full = 1 - np.exp(-max(off - opened, 0) / tau)
            return np.where(t < off, up, full * np.exp(-np.clip(t - off, 0, None) / tau))

        opens = {"ox": q["cmd_ox_open"] + dead, "fu": q["cmd_fu_open"] + dead + delay}
        flow = {k: valve(x) for k, x in opens.items()}
        self.ignition = max(opens.values()) + tau * np.log(2) + e["ign_delay_ms"] / 1e3
        pc = e["pc_nom"] * smooth((t - self.ignition) / e["pc_rise_s"]) * np.exp(-np.clip(t - off, 0, None) / e["pc_tail_tau_s"])
        wall, out = e["t_wall_amb"], np.empty(len(t))
        goal = (e["t_wall_amb"] + (e["t_wall_ss"] - e["t_wall_amb"]) * pc / e["pc_nom"]).tolist()
        heat, cool = 1 / (1.5 * self.fs), 1 / (3.0 * self.fs)
        for i, g in enumerate(goal):
            wall += (g - wall) * (heat if g > wall else cool)
            out[i] = wall
        return {"Pc": pc, "P_ox_inj": pc + e["dp_ox"] * flow["ox"], "P_fu_inj": pc + e["dp_fu"] * flow["fu"], "mdot_ox": e["mdot_ox"] * flow["ox"], "mdot_fu": e["mdot_fu"] * flow["fu"], "T_cool_out": out}

    def measure(self) -> None:
        """Noise, and the channels that only measuring gives."""
        random, n, e, q = self.draw("noise"), len(self.t), ENGINE, SEQUENCE
        load = np.clip(self.v["Pc"], 0, None) / e["pc_nom"]
        shake = self.v.pop("shake", 0.0)
        sigma = {"Pc": 0.003 * e["pc_nom"], "P_ox_inj": 0.003 * (e["pc_nom"] + e["dp_ox"]), "P_fu_inj": 0.003 * (e["pc_nom"] + e["dp_fu"]), "mdot_ox": 0.005, "mdot_fu": 0.003, "T_cool_out": 0.5}
        for name, s in sigma.items():
            wide = 0.005 * np.abs(self.v[name]) if name.startswith("mdot") else 0.0
            self.v[name] = self.v[name] + random.normal(0, 1, n) * np.hypot(s, wide)
        self.v["vib_axial"] = random.normal(0, 1, n) * (0.2 + 3.0 * load) + shake
        for k in ("ox", "fu"):
            self.v[f"cmd_{k}"] = ((self.t >= q[f"cmd_{k}_open"]) & (self.t < q["cmd_close"])).astype(float)

    def pressures(self, change: np.ndarray, share: float = 1.0) -> None:
        for name in PRESSURES:
            self.v[name] = self.v[name] + change * (1.0 if name == "Pc" else share)

    # ---- what happens to the engine

    def valve_delay(self, random) -> None:
        start = SEQUENCE["cmd_fu_open"]
        self.note("valve_delay", "P_fu_inj", start, start + ENGINE["valve_dead_ms"] / 1e3 + self.delay + 0.01, ["cmd_fu", "mdot_fu", "Pc"], extra_delay_ms=round(1e3 * self.delay, 1))

    def pc_deficit(self, random) -> None:
        share, start = random.uniform(0.04, 0.09), random.uniform(STEADY[0], 4.0)
        self.pressures(-share * smooth((self.t - start) / 0.3) * self.v["Pc"])
        self.note("pc_deficit", "Pc", start, SEQUENCE["cmd_close"], PRESSURES[1:], deficit_pct=round(100 * share, 2))

    def oscillation(self, random) -> None:
        freq, size, long = random.uniform(min(150, 0.2 * self.fs), min(1200, 0.4 * self.fs)), random.uniform(0.02, 0.06), random.uniform(1.0, 2.5)
        start = random.uniform(STEADY[0] + 0.2, STEADY[1] - long)
        shape = hump(self.t, start, start + long, 0.05)
        wave = 2 * np.pi * freq * self.t
        self.pressures(ENGINE["pc_nom"] * size * shape * np.sin(wave + random.uniform(0, 2 * np.pi)), 0.4)
        self.v["shake"] = 4.0 * shape * np.sin(wave + 0.3)
        self.note("oscillation", "Pc", start, start + long, [*PRESSURES[1:], "vib_axial"], freq_hz=round(freq, 1), amplitude_pct=round(100 * size, 2))

    def overtemp(self, random) -> None:
        excess, start, long = random.uniform(110, 170), random.uniform(3.0, 6.0), random.uniform(1.2, 2.5)
        self.v["T_cool_out"] = self.v["T_cool_out"] + excess * hump(self.t, start, start + long, 0.4)
        above = self.t[self.v["T_cool_out"] > REDLINES["T_cool_out"]]
        start, stop = (above[0], above[-1]) if len(above) else (start, start + long)
        self.note("overtemp", "T_cool_out", start, stop, peak_K=round(float(self.v["T_cool_out"].max()), 1))

    def startup_spike(self, random) -> None:
        at = self.ignition + ENGINE["pc_rise_s"] + random.uniform(0.1, 0.4)
        self.pressures(0.08 * ENGINE["pc_nom"] * np.exp(-0.5 * ((self.t - at) / 0.008) ** 2), 0.5)

    def shutdown_slam(self, random) -> None:
        late = np.clip(self.t - SEQUENCE["cmd_close"] - ENGINE["valve_dead_ms"] / 1e3, 0, None)
        for name in PRESSURES[1:]:
            self.v[name] = self.v[name] + 0.25 * np.exp(-late / 0.03) * np.sin(2 * np.pi * 220 * late)

    # ---- what happens to the sensors

    def mains_hum(self, random) -> None:
        self.pressures(0.008 * ENGINE["pc_nom"] * np.sin(2 * np.pi * 60 * self.t + random.uniform(0, 2 * np.pi)))
        self.note("mains_hum", "Pc", 0.0, self.t[-1], PRESSURES[1:], freq_hz=60.0)

    def sensor_spike(self, random) -> None:
        times = np.sort(random.uniform(*STEADY, random.integers(1, 4)))
        for x in times:
            i = int(x * self.fs)
            self.v["P_ox_inj"][i : i + 3] += 0.3 * (ENGINE["pc_nom"] + ENGINE["dp_ox"]) * np.array([0.6, 1.0, 0.5])
        self.note("sensor_spike", "P_ox_inj", times[0], times[-1] + 0.001, count=len(times), times_s=[round(float(x), 4) for x in times])

    def sensor_dropout(self, random) -> None:
        busy = {"T_cool_out"} if "overtemp" in self.asked else set()
        busy |= {"P_fu_inj"} if {"valve_delay", "oscillation"} & self.asked else set()
        name = random.choice([c for c in ("mdot_fu", "P_fu_inj", "T_cool_out", "vib_axial") if c not in busy])
        mode, long = random.choice(["flatline", "nan"]), random.uniform(0.4, 1.5)
        start = random.uniform(STEADY[0], STEADY[1] - long)
        lo, hi = int(start * self.fs), int((start + long) * self.fs)
        self.v[name][lo:hi] = np.nan if mode == "nan" else self.v[name][lo - 1]
        self.note("sensor_dropout", str(name), start, start + long, mode=str(mode))

    def free(self, *names: str) -> list[str]:
        """Of the names those that no other fault has taken: a fault that finds none is left out, with its truth."""
        taken = self.taken()
        return [c for c in names if c not in taken]

    def sensor_saturation(self, random) -> None:
        if names := self.free(*PRESSURES[1:]):
            name = str(random.choice(names))
            top = 0.97 * float(np.nanpercentile(self.v[name], 99))
            over = self.t[self.v[name] > top]
            self.v[name] = np.minimum(self.v[name], top)
            self.note("sensor_saturation", name, over[0], over[-1], full_scale=round(top, 4))

    def pc_stuck_after_shutdown(self, random) -> None:
        start = SEQUENCE["cmd_close"] + 0.25
        late = self.t >= start
        self.v["Pc"][late] = 0.6 * ENGINE["pc_nom"] + random.normal(0, 0.003 * ENGINE["pc_nom"], int(late.sum()))
        self.note("pc_stuck_after_shutdown", "Pc", start, self.t[-1], stuck_MPa=0.6 * ENGINE["pc_nom"])

    def zero_offset(self, random) -> None:
        if names := self.free(*PRESSURES[1:]):
            name, off = str(random.choice(names)), random.uniform(0.2, 0.4)
            self.v[name] = self.v[name] - off
            self.note("zero_offset", name, 0.0, self.t[-1], offset_MPa=round(-off, 3))

    def duplicate_channel(self, random) -> None:
        for pair in (["mdot_ox", "mdot_fu"], PRESSURES[1:]):
            if len(self.free(*pair)) == 2:
                self.v[pair[1]] = self.v[pair[0]].copy()
                self.note("duplicate_channel", "*", 0.0, self.t[-1], pair, source=pair[0], copy=pair[1])
                return

    def dead_channel(self, random) -> None:
        if names := self.free("vib_axial", "T_cool_out", "mdot_fu"):
            name = str(random.choice(names))
            self.v[name] = np.zeros(len(self.t))
            self.note("dead_channel", name, 0.0, self.t[-1], value=0.0)

    def quantization(self, random) -> None:
        for name in PRESSURES:
            self.v[name] = np.round(self.v[name] / 0.002) * 0.002

    def daq_dropout(self, random) -> None:
        """Frames that every channel loses; what is a point in time is spared, as a gap would erase it."""
        points = [x for type_, *_, params in self.truth if type_ == "sensor_spike" for x in json.loads(params)["times_s"]]
        lost, at, n = np.zeros(len(self.t), bool), random.uniform(0.2, 0.6), 0
        while at < self.t[-1] - 0.1:
            long = random.uniform(0.01, 0.04)
            if all(x < at - 0.02 or x > at + long + 0.02 for x in points):
                lost[int(at * self.fs) : int((at + long) * self.fs)] = True
                n += 1
            at += random.uniform(0.25, 0.7)
        for name in self.v:
            if not name.startswith("cmd_"):
                self.v[name] = np.where(lost, np.nan, self.v[name])
        self.note("daq_dropout", "*", 0.0, self.t[-1], n_gaps=n)


def plan(n: int, seed: int = 0, suite: str = "classic") -> dict[str, dict]:
    """n runs by name with seed, anomalies and nuisances: none to three anomalies of the suite (classic, or realistic, which has nuisances too)."""
    if suite not in ("classic", "realistic"):
        raise ValueError(f"no suite {suite}; there are classic, realistic")
    pool = [*CLASSIC, *(REALISTIC if suite == "realistic" else [])]
    out = {}
    for i in range(seed, seed + n):
        random = np.random.default_rng([i, 1])
        chosen = random.choice(pool, int(random.choice([0, 1, 1, 2, 2, 3])), replace=False).tolist()
        out[f"SYN-{i:04d}"] = {"seed": i, "anomalies": chosen, "nuisances": [x for x in NUISANCES if suite == "realistic" and random.random() < 0.5]}
    return out


def checked(runs: dict) -> dict[str, dict]:
    out = {}
    for i, (name, r) in enumerate(runs.items()):
        r = {"seed": i, "nuisances": [], **r} if isinstance(r, dict) else {"seed": i, "nuisances": [], "anomalies": r}
        for asked, known in ((r["anomalies"], ANOMALIES), (r["nuisances"], NUISANCES)):
            if unknown := set(asked) - set(known):
                raise ValueError(f"no anomaly {', '.join(sorted(unknown))}; there are {', '.join(sorted(known))}")
        out[name] = r
    return out


def generate(spark: SparkSession, runs: dict, fs: float = 1000, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples, reference, truth) for runs by name: each a list of anomalies, or what plan() gives. Unknown anomalies are refused."""
    rows = [(name, r["seed"] + seed, list(r["anomalies"]), list(r["nuisances"])) for name, r in checked(runs).items()]
    plans = spark.createDataFrame(rows, "run_id string, seed long, anomalies array<string>, nuisances array<string>").repartition(max(1, len(rows)))

    def made(batches, what):
        for batch in batches:
            for r in batch.itertuples():
                yield from what(r.run_id, Firing(int(r.seed), list(r.anomalies), list(r.nuisances), fs))

    def frame(run, t, signals):
        for name, v in signals.items():
            yield pd.DataFrame({"run_id": run, "channel": name, "seq": np.arange(len(t)), "t": t, "v": v})

    def samples(batches):
        yield from made(batches, lambda run, f: frame(run, f.t, f.v))

    def reference(batches):
        step = max(int(fs // 500), 1)
        yield from made(batches, lambda run, f: frame(run, f.t[::step], {k: v[::step] for k, v in f.ideal(0.0).items()}))

    def truth(batches):
        yield from made(batches, lambda run, f: [pd.DataFrame([(run, i, *x, ANOMALIES[x[0]]) for i, x in enumerate(f.truth)], columns=[c.split(" ")[0] for c in TRUTH.split(", ")])])

    known = plans.mapInPandas(samples, SAMPLES).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    return known, plans.mapInPandas(reference, SAMPLES), plans.mapInPandas(truth, TRUTH)


def surroundings(spark: SparkSession) -> dict:
    """The tables beside the samples that the generated runs share: kinds, units, redlines, valve pairs, tolerances."""
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "channels": one([(c, u, k) for c, (u, k) in CHANNELS.items()], "channel string, unit string, kind string"),
        "redlines": one([(c, "max", x) for c, x in REDLINES.items()], "channel string, kind string, limit double"),
        "valve_pairs": one([("cmd_ox", "P_ox_inj", LATENCY_MS), ("cmd_fu", "P_fu_inj", LATENCY_MS)], "command string, response string, max_latency_ms double"),
        "settings": {"redline_persistence_s": 0.01, "reference_tolerance_pct": 2.0, "threshold_pct": 0.5, "fmin": 50.0, "fmax": 2000.0},
    }


def documents(name: str, run: dict, fs: float) -> dict[str, dict]:
    """The JSON documents that stand beside a saved run: what it is, and its limits."""
    meta = {"test_id": name, "sample_rate_hz": fs, "channels": {c: {"unit": u, "kind": k} for c, (u, k) in CHANNELS.items()}, "sequence": SEQUENCE, "engine": ENGINE, "seed": run["seed"], "anomalies_injected": sorted(run["anomalies"]), "nuisances": sorted(run["nuisances"])}
    limits = {
        "redlines": {c: {"max": x} for c, x in REDLINES.items()}, "redline_persistence_s": 0.01, "reference_tolerance_pct": 2.0, "oscillation": {"threshold_pct": 0.5, "fmin_hz": 50.0, "fmax_hz": 2000.0},
        "valve_response": {f"cmd_{k}": {"response": f"P_{k}_inj", "max_latency_ms": LATENCY_MS} for k in ("ox", "fu")},
    }
    return {"meta.json": meta, "limits.json": limits}


def match(findings: DataFrame, truth: DataFrame, tol: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(each truth with hit, loose, category_ok and t_start_error_s, the claims that match none).

    Claims are findings that aren't observations. One without a time overlaps everything. A truth of one channel is hit by a claim on it
    or a related one; of a group (`*` with related channels) by a claim of its category on one of them, or on none and naming all; of
    all channels (`*` alone) by a claim of its category on no channel that no group has. loose also takes a claim of the right category
    on no channel.
    """
    if "related" not in truth.columns:
        truth = truth.withColumn("related", F.array().cast("array<string>"))
    for c in ("title", "statement"):
        if c not in findings.columns:
            findings = findings.withColumn(c, F.lit(""))
    claims = findings.where("category <> 'observation'").withColumn("said", F.concat_ws(" ", "title", "statement")).alias("f")
    a = truth.alias("a")
    overlap = F.col("f.t_start").isNull() | ((F.col("f.t_start") <= F.col("a.t_end") + tol) & (F.col("a.t_start") - tol <= F.coalesce("f.t_end", "f.t_start")))
    pairs = a.join(claims, (F.col("f.run_id") == F.col("a.run_id")) & overlap, "left")
    same, nowhere = F.col("f.category") == F.col("a.category"), F.col("f.channel").isNull()
    single, group = F.col("a.channel") != "*", (F.col("a.channel") == "*") & (F.size("a.related") > 0)
    every = F.forall("a.related", lambda c: F.contains(F.col("f.said"), c))
    in_group = group & same & (F.array_contains("a.related", F.col("f.channel")) | (nowhere & every))
    told = pairs.select("a.*", F.col("f.finding_id").alias("finding_id"), F.col("f.t_start").alias("f_start"), F.coalesce(same, F.lit(False)).alias("same"), (F.col("f.finding_id").isNotNull() & nowhere).alias("nowhere"), F.coalesce(in_group, F.lit(False)).alias("in_group"), single.alias("single"), group.alias("group"))
    claimed = told.where("in_group").select(F.col("run_id").alias("c_run"), F.col("finding_id").alias("c_id")).distinct().withColumn("claimed", F.lit(True))
    told = told.join(claimed, (F.col("run_id") == F.col("c_run")) & (F.col("finding_id") == F.col("c_id")), "left")
    own = told.alias("x").join(claims.select(F.col("f.run_id").alias("o_run"), F.col("f.finding_id").alias("o_id"), F.col("f.channel").alias("o_channel")), (F.col("run_id") == F.col("o_run")) & (F.col("finding_id") == F.col("o_id")), "left")
    on_channel = F.coalesce((F.col("o_channel") == F.col("channel")) | F.array_contains("related", F.col("o_channel")), F.lit(False))
    everywhere = ~F.col("single") & ~F.col("group") & F.col("same") & F.col("nowhere") & F.col("claimed").isNull()
    hit = (F.col("single") & on_channel) | F.col("in_group") | everywhere
    own = own.withColumn("hit", hit)
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    hits = own.groupBy("run_id", "truth_id", "type").agg(
        F.first("channel").alias("channel"), any_(F.col("hit")).alias("hit"), any_(F.col("hit") | (F.col("nowhere") & F.col("same"))).alias("loose"), any_(F.col("hit") & F.col("same")).alias("category_ok"),
        F.min(F.when(F.col("hit") & F.col("same"), F.abs(F.col("f_start") - F.col("t_start")))).alias("t_start_error_s"),
    )
    used = own.where("hit").select("run_id", "finding_id").distinct()
    return hits, claims.drop("said").join(used, ["run_id", "finding_id"], "left_anti")


def upper_median(x: str) -> Column:
    """The middle value, of two middle ones the larger; null without any."""
    return F.try_element_at(F.array_sort(F.array_compact(F.collect_list(x))), (F.floor(F.count(x) / 2) + 1).cast("int"))


def summarize(hits: DataFrame) -> DataFrame:
    """Recall (strict and loose), accuracy of categories and the upper median of the errors of time for each type, and overall (type null)."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    return hits.rollup("type").agg(F.count("*").alias("n"), share("hit").alias("recall"), share("loose").alias("recall_loose"), share("category_ok").alias("category_accuracy"), upper_median("t_start_error_s").alias("median_t_start_error_s"))
