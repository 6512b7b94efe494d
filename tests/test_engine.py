"""Spectral events, the ledger and its reproduction, the playbook on labelled runs, ingestion, and streaming against batch."""

import json
import math

import pytest
from pyspark.sql import functions as F

from orrery import ledger, planner, registry, synth
from orrery.operators import oscillation
from orrery.sources import runs
from orrery.streaming import windows

from test_cards import samples


def test_oscillation(spark):
    fs = 2000
    v = [5 + (0.2 * math.sin(2 * math.pi * 220 * i / fs) if 4000 <= i < 8000 else 0) + 0.01 * math.sin(i * i) for i in range(12000)]
    events, short = oscillation.detect(samples(spark, {"Pc": v}, fs), fs)
    (e,) = events.collect()
    assert abs(e.freq_hz - 220) < 3 and abs(e.t_start - 2) < 0.15 and abs(e.t_end - 4) < 0.15 and abs(e.peak_amp_pct - 4) < 0.6
    assert oscillation.detect(samples(spark, {"Pc": v[:100]}, 10), 10)[0].count() == 0  # the band lies above what can be seen
    ramp = samples(spark, {"Pc": [i / 100 for i in range(4000)]}, fs)
    assert oscillation.detect_both(ramp, fs).count() == 0


def test_generator(spark):
    a, _, truth = synth.generate(spark, {"x": ["oscillation"]}, 100, 5)
    b, _, _ = synth.generate(spark, {"x": ["oscillation"]}, 100, 5)
    assert ledger.data_digest(a).collect() == ledger.data_digest(b.repartition(7)).collect() and truth.count() == 1
    with pytest.raises(ValueError, match="no anomaly"):
        synth.generate(spark, {"x": ["gremlins"]})
    with pytest.raises(ValueError, match="no suite"):
        synth.plan(1, suite="fantastic")
    every = {k: {"anomalies": [k], "seed": 40 + i} for i, k in enumerate(synth.ANOMALIES)} | {"calm": {"anomalies": [], "nuisances": synth.NUISANCES}}
    s, ref, truth = synth.generate(spark, every, 500)
    rows = {r.run_id: r for r in truth.collect()}
    assert {r: x.type for r, x in rows.items()} == {k: k for k in synth.ANOMALIES} and all(x.category == synth.ANOMALIES[r] for r, x in rows.items())
    shape = {(r.run_id, r.channel): r for r in s.groupBy("run_id", "channel").agg(F.count("*").alias("n"), F.count("v").alias("known"), F.max("t").alias("last"), F.min("v").alias("low"), F.max("v").alias("high")).collect()}
    assert len(shape) == 14 * 9 and all(r.n == 6000 and abs(r.last - 11.998) < 1e-9 for r in shape.values())
    assert shape["dead_channel", rows["dead_channel"].channel].high == 0 and shape["daq_dropout", "Pc"].known < 6000 == shape["daq_dropout", "cmd_ox"].known
    assert shape["overtemp", "T_cool_out"].high > 700 > shape["calm", "T_cool_out"].high and shape["calm", "Pc"].high < synth.REDLINES["Pc"]
    assert sorted(r.channel for r in ref.where("run_id = 'calm'").select("channel").distinct().collect()) == sorted(c for c in synth.CHANNELS if c[:3] not in ("vib", "cmd"))


def test_registry():
    with pytest.raises(ValueError, match="no parameter"):
        registry.get("describe_data")({}, bogus=1)
    with pytest.raises(ValueError, match="needs"):
        registry.get("check_thrust_pressure_ratio")({}, thrust="F")
    with pytest.raises(KeyError):
        registry.get("nothing")


@pytest.fixture(scope="module")
def analysed(spark):
    kinds = {k: {"anomalies": [k], "seed": 70 + i, "nuisances": synth.NUISANCES[i % 3 : i % 3 + 1]} for i, k in enumerate(synth.ANOMALIES)} | {"quiet": {"anomalies": [], "nuisances": synth.NUISANCES}, "hot": {"anomalies": ["overtemp", "valve_delay"], "seed": 3}}
    s, ref, truth = synth.generate(spark, kinds, 500)
    tables = {"samples": s.repartition(4, "run_id", "channel").cache(), "fs": 500, "reference": ref.cache(), **synth.surroundings(spark)}
    book, found = planner.analyse(spark, tables)
    return tables, book, found, truth.cache()


def test_playbook_finds_what_was_put_in(spark, analysed):
    tables, book, found, truth = analysed
    made = planner.report(book, found)
    hits, false = synth.match(found, truth)
    missed = [(r.run_id, r.type, r.channel) for r in hits.where("not hit or not category_ok").collect()]
    assert not missed, missed
    wrong = [(r.run_id, r.title) for r in false.collect()]
    assert not wrong, wrong
    bad = [(f["run_id"], f["title"], f["statement"], f["verification"]) for f in made["findings"] if f["verification"]["status"] != "verified"]
    assert not bad, bad[:3]
    overall = synth.summarize(hits).where("type IS NULL").first()
    assert overall.recall == overall.recall_loose == overall.category_accuracy == 1.0 and overall.median_t_start_error_s < 0.2
    page = planner.write_html(made)
    assert "T_cool_out beyond its redline" in page and json.loads(planner.write_json(made))["n_verified"] == len(made["findings"])
    said = {f["run_id"]: [g["statement"] for g in made["findings"] if g["run_id"] == f["run_id"]] for f in made["findings"]}
    assert any("shows it too" in x for x in said["oscillation"]) and any("moves with it" in x and "flows are as predicted" in x for x in said["pc_deficit"])


def test_reproduction(spark, analysed):
    tables, book, _, _ = analysed
    some = book.evidence().where("tool IN ('check_redlines', 'describe_data', 'check_sensor_health')")
    plain = {k: v for k, v in tables.items() if k != "phases"}
    assert all(r["exact"] and r["data_same"] and r["version_same"] for r in ledger.reproduce(spark, plain, some))


def test_playbook_in_chinese(spark, analysed):
    _, book, found, _ = analysed
    by_run = {}
    for e in book.rows:
        by_run.setdefault(e["run_id"], []).append(e)
    kinds = {c: k for c, (_, k) in synth.CHANNELS.items()}
    rows = [{**f, "finding_id": i} for i, f in enumerate(f for run, es in sorted(by_run.items()) for f in planner.conclude(run, es, kinds, planner.Words("zh"))[0])]
    assert len(rows) == found.count()
    made = planner.report(book, spark.createDataFrame(rows, planner.FINDING))
    bad = [(f["title"], f["statement"], f["verification"]) for f in made["findings"] if f["verification"]["status"] != "verified"]
    assert not bad, bad[:3]


def interpolated(times, values, x):
    """Between neighbouring rows, level beyond the ends; None beside a None."""
    if x in times:
        return values[times.index(x)]
    if x < times[0] or x > times[-1]:
        return values[0] if x < times[0] else values[-1]
    j = next(i for i, t in enumerate(times) if t > x)
    a, b = values[j - 1], values[j]
    return None if a is None or b is None else a + (b - a) * (x - times[j - 1]) / (times[j] - times[j - 1])


def test_ingest_on_a_grid(spark, tmp_path, monkeypatch):
    """Two hollow spots, a silent channel and a sum, over several parts of the grid, against interpolation by loops."""
    monkeypatch.setattr(runs, "PART_S", 1.5)
    log = [(round(10 + i / 80, 4), math.sin(i / 9), None if 90 <= i < 100 else 3.0 * i, i % 5) for i in range(400) if i not in range(150, 190) and i not in range(300, 303)]
    path = tmp_path / "bench.csv"
    path.write_text("Clock [s],Manifold [kPa],Cell 1 [N],Cell 2 [N]\n" + "\n".join(",".join("" if x is None else repr(x) for x in r) for r in log) + "\nnot a time,1,2,3\n")
    mapping = {"time": {"column": "Clock [s]"}, "channels": {"P_man": {"column": "Manifold [kPa]", "scale": 0.5, "offset": 1.0}, "A": {"column": "Cell 1 [N]"}, "B": {"column": "Cell 2 [N]"}}, "derived": {"F_sum": {"sum": ["A", "B"]}}, "window_s": [10.3, 14.6], "grid_hz": 50, "max_gap_s": 0.03, "order": ["F_sum"]}
    got = {}
    for r in runs.ingest(spark, str(path), mapping, "r").collect():
        got.setdefault(r.channel, {})[r.seq] = (r.t, r.v)
    times = [r[0] for r in log]
    columns = {"P_man": [0.5 * r[1] + 1.0 for r in log], "A": [r[2] for r in log], "B": [r[3] for r in log]}
    assert set(got) == {"P_man", "A", "B", "F_sum"}
    blank = 0
    for i in range(215):
        x = 10.3 + i * ((10.3 + 1 / 50) - 10.3)
        far = min(abs(x - t) for t in times) > 0.03
        blank += far
        want = {c: None if far else interpolated(times, v, x) for c, v in columns.items()}
        want["F_sum"] = None if want["A"] is None or want["B"] is None else want["A"] + want["B"]
        for c, v in want.items():
            t, have = got[c][i]
            assert t == pytest.approx(i / 50) and (have is None if v is None else have == pytest.approx(v)), (c, i)
    assert len(got["A"]) == 215 and blank > 15


def test_ingest_plain(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("made by hand;;\nMark;Druck;Schub\n;mbar;kN\n00:00:03,500;7,5;1\n00:00:01,250;2,5;-4\n00:00:01,250;3,5;\n")
    mapping = {"skip_rows": 1, "sep": ";", "decimal": ",", "time": {"column": "Mark", "clock": "HH:mm:ss,SSS"}, "channels": {"p": {"column": "Druck"}, "f": {"column": "Schub", "scale": 1000}}}
    got = runs.ingest(spark, str(path), mapping, "r").orderBy("channel", "seq").collect()
    zero = got[0].t
    assert [(r.channel, r.seq, round(r.t - zero, 6), r.v) for r in got] == [("f", 0, 0, -4000), ("f", 1, 2.25, 1000), ("p", 0, 0, 3), ("p", 1, 2.25, 7.5)]
    wide = tmp_path / "rows.csv"
    wide.write_text("t,0,0.5,1\nflow,4,5,6\nidle,,,\n")
    mapping = {"transposed": True, "time": {"column": "t"}, "channels": {"q": {"column": "flow"}, "z": {"column": "idle"}}, "window_s": [0.5, 9]}
    assert [(r.channel, r.seq, r.t, r.v) for r in runs.ingest(spark, str(wide), mapping, "r").orderBy("channel", "seq").collect()] == [("q", 0, 0, 5), ("q", 1, 0.5, 6), ("z", 0, 0, None), ("z", 1, 0.5, None)]
    empty = tmp_path / "empty.csv"
    empty.write_text("t,x\n")
    assert runs.ingest(spark, str(empty), {"time": {"column": "t"}, "channels": {"x": {"column": "x"}}, "grid_hz": 5}, "r").count() == 0


@pytest.mark.parametrize("name, unit, want", [
    ("Pc", "", "pressure"), ("chamberPressure", "bar", "pressure"), ("P_tank", "psi", "pressure"), ("T_wall", "°C", "temperature"), ("thermo_3", "", "temperature"), ("F_main", "N", "force"), ("Load cell", "lbf", "force"),
    ("mdot_lox", "", "flow"), ("Turbine", "kg/s", "flow"), ("vib_x", "g", "vibration"), ("Tank mass", "g", "weight"), ("cmd_main", "", "command"), ("valve cmd", "-", "command"), ("valve", "bar", "pressure"), ("supply", "V", "electric"), ("blip", "", "other"),
])
def test_kinds(name, unit, want):
    assert runs.kind(name, unit) == want


def test_drafts():
    m = runs.suggest_mapping("Stamp;x\n".replace(";", ","))
    assert m["time"]["column"] == "Stamp" and m["skip_rows"] == 0
    m = runs.suggest_mapping("seconds,Inlet [bar],Skin temp [degC],date\n0.1,5,20,x\n")
    assert m["time"] == {"column": "seconds", "scale": 1.0} and {n: (c["unit"], c["kind"]) for n, c in m["channels"].items()} == {"Inlet": ("bar", "pressure"), "Skin_temp": ("degC", "temperature")}
    above = runs.suggest_mapping("bar,degC,kN,ms,\n,Feed,Nozzle temp,Thrust,Time\n1,2,3,4,5\n")  # units one cell to the left of their names
    assert above["skip_rows"] == 1 and above["time"] == {"column": "Time", "scale": 1e-3} and {n: c["unit"] for n, c in above["channels"].items()} == {"Feed": "bar", "Nozzle_temp": "degC", "F_thrust": "kN"}
    below = runs.suggest_mapping("t,load A,load B,load B\ns,N,N,N\n0,1,2,3\n")
    assert below["units_row_below_header"] and below["derived"]["F_thrust"]["sum"] == ["load_A", "load_B", "load_B_2"] and below["channels"]["load_A"]["kind"] == "force_component"


def test_case_with_what_stands_beside_it(spark, tmp_path):
    (tmp_path / "run.csv").write_text("time,Pc,cmd_a,Q\n" + "\n".join(f"{i / 10},{i},{int(i > 3)},1" for i in range(20)))
    (tmp_path / "meta.json").write_text(json.dumps({"test_id": "B9", "sample_rate_hz": 10, "channels": {"Pc": {"unit": "bar", "kind": "pressure", "native_rate_hz": 5}, "cmd_a": {"kind": "command"}, "Q": {"unit": "kg/s"}}}))
    (tmp_path / "limits.json").write_text(json.dumps({"redlines": {"Pc": {"max": 12.5, "min": -1}}, "redline_persistence_s": 0.2, "valve_response": {"cmd_a": {"response": "Pc", "max_latency_ms": 30}}, "oscillation": {"fmin_hz": 2}}))
    (tmp_path / "reference.csv").write_text("time,Pc\n0,0\n2,20\n")
    tables, meta = runs.load_case(spark, str(tmp_path / "run.csv"))
    assert meta["test_id"] == "B9" and tables["fs"] == 10 and tables["settings"] == {"redline_persistence_s": 0.2, "fmin": 2}
    assert sorted(tuple(r) for r in tables["redlines"].collect()) == [("Pc", "max", 12.5), ("Pc", "min", -1.0)] and tables["valve_pairs"].first().max_latency_ms == 30
    assert {r.channel: (r.kind, r.native_rate_hz) for r in tables["channels"].collect()} == {"Pc": ("pressure", 5.0), "cmd_a": ("command", None), "Q": ("flow", None)}
    assert tables["reference"].count() == 2 and runs.of_kind(tables, "flow").select("channel").distinct().first()[0] == "Q"
    assert runs.channel(tables["samples"], "Pc").count() == 20
    with pytest.raises(KeyError, match="Pc, Q, cmd_a"):
        runs.channel(tables["samples"], "F")
    alone = tmp_path / "alone"
    alone.mkdir()
    (alone / "x.csv").write_text("t,Pc\n0,1\n1,2\n")
    tables, meta = runs.load_case(spark, str(alone / "x.csv"))
    assert meta["test_id"] == "x" and "redlines" not in tables and "reference" not in tables
    with pytest.raises(ImportError, match="nptdms"):
        runs.read_tdms(spark, "x.tdms", "x")


def test_files(spark, tmp_path):
    path = tmp_path / "run.csv"
    path.write_text("Pc,Time,cmd_ox\n1,0.2,0\nnan,0.1,1\n3,0.0,1\n")
    (tmp_path / "meta.json").write_text('{"test_id": "T7"}')
    s, meta = runs.load_run(spark, str(path), "r")
    assert [r.v for r in s.where("channel = 'Pc'").orderBy("seq").collect()] == [3, None, 1]
    assert meta["test_id"] == "T7" and meta["channels"]["cmd_ox"]["kind"] == "command" and meta["sample_rate_hz"] == pytest.approx(10)
    assert runs.file_digests(spark, str(path)).count() == 1
    runs.write_run(s, str(tmp_path / "out"), by_run=True)
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3


def replay(spark, tmp_path, name, build, mode="append"):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("event_type").alias("channel"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v")).orderBy("ts")
    source = str(tmp_path / f"{name}-in")
    events.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return events, spark.table(name)


def test_stream_of_windows(spark, tmp_path):
    events, got = replay(spark, tmp_path, "stats", lambda s: windows.tumbling_stats(s, "1 day"))
    want = events.groupBy("channel", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.max("v").alias("high"))
    closed = {(r.channel, r.start): (r.n, r.high) for r in got.collect()}
    full = {(r.channel, r.w.start): (r.n, r.high) for r in want.collect()}
    assert closed and all(full[k] == v for k, v in closed.items()) and len(full) - len(closed) <= 10


def test_stream_of_sessions_and_debounce(spark, tmp_path):
    events, got = replay(spark, tmp_path, "sessions", lambda s: windows.spike_sessions(s, 150.0))
    assert 0 < got.agg(F.sum("n")).first()[0] <= events.where("v > 150").count()
    events, got = replay(spark, tmp_path, "debounced", lambda s: windows.debounced_redlines(s, 60.0, 2))
    want = 0
    for c in ("click", "view", "error", "signup", "purchase"):
        vs = [r.v > 60 for r in events.where(F.col("channel") == c).orderBy("ts").collect()]
        run = 0
        for hot in vs:
            if hot:
                run += 1
            else:
                want, run = want + (run >= 2), 0
    assert got.count() == want
