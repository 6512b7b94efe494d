"""Sessions and agents, benchmarks with resumption, mutation, hybrid injection, the command line and the server."""

import io
import json

import pytest
from pyspark.sql import functions as F

from orrery import agents, benchmarks, cli, config, hybrid, mutation, server, synth
from orrery.session import Session

FS = 250


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bench") / "rows")
    first = benchmarks.run_benchmark(spark, 1, 1003, fs=FS, path=path)
    assert first.count() == 1
    kept = first.collect()
    both = benchmarks.run_benchmark(spark, 2, 1003, fs=FS, path=path)
    assert [r for r in both.collect() if r.seed == 1003] == kept and both.count() == 2  # the first is taken as it is
    return both.cache()


def test_benchmark(spark, rows):
    s = benchmarks.summarize(rows).first()
    types = {r.type: r for r in benchmarks.per_type(rows).collect()}
    assert s.runs == 2 and s.recall == types[None].recall == 1.0 and s.false_positives == 0 and s.precision in (None, 1.0)
    assert s.verified == s.findings > 0 and s.n_grounded == s.n_numbers
    table = benchmarks.leaderboard(benchmarks.summarize(rows.unionByName(rows.withColumn("agent", F.lit("other")))))
    assert "| other | classic | 2 | 100 % |" in table and table.count("\n") == 4
    again = benchmarks.reverify(spark, rows)
    assert again.count() == s.findings and again.where("before <> after").count() == 0


def test_match_is_strict_about_channels(spark):
    truth = [("r", 0, "a", "Pc", 2.0, 3.0, ["Q"], "sensor_fault"), ("r", 1, "pair", "*", 0.0, 9.0, ["X", "Y"], "sensor_fault"), ("r", 2, "all", "*", 0.0, 9.0, [], "sensor_fault"), ("r", 3, "b", "Z", 5.0, 6.0, [], "valve_response"), ("s", 0, "c", "Pc", 1.0, 1.0, [], "sensor_fault")]
    truth = spark.createDataFrame(truth, "run_id string, truth_id long, type string, channel string, t_start double, t_end double, related array<string>, category string")
    claims = [
        ("r", 0, "t", "s", "redline_violation", "Q", 3.2, 4.0), ("r", 1, "X and Y", "are one", "sensor_fault", None, None, None), ("r", 2, "everything", "gaps", "sensor_fault", None, 1.0, 2.0), ("r", 3, "t", "s", "observation", "Z", 5.0, 5.0),
        ("r", 4, "t", "s", "valve_response", "W", 5.0, 5.0), ("r", 5, "t", "s", "valve_response", None, 5.5, None), ("s", 0, "t", "s", "sensor_fault", "Pc", 1.3, None),
    ]
    findings = spark.createDataFrame(claims, "run_id string, finding_id long, title string, statement string, category string, channel string, t_start double, t_end double")
    hits, false = synth.match(findings, truth)
    got = {(r.run_id, r.truth_id): (r.hit, r.loose, r.category_ok, r.t_start_error_s) for r in hits.collect()}
    assert got["r", 0][:3] == (True, True, False) and got["r", 1][:3] == (True, True, True) and got["r", 2] == (True, True, True, 1.0)
    assert got["r", 3] == (False, True, False, None) and got["s", 0] == (False, False, False, None)
    assert sorted((r.run_id, r.finding_id) for r in false.collect()) == [("r", 4), ("r", 5), ("s", 0)]
    errors = spark.createDataFrame([(x,) for x in (4.0, 1.0, 3.0, None, 2.0)], "e double")
    assert errors.agg(synth.upper_median("e")).first()[0] == 3.0


def test_mutations_are_caught(spark, rows):
    d = rows.select("run_id", F.from_json("document", "findings array<struct<finding_id:long,title:string,statement:string,category:string,severity:string,channel:string,t_start:double,t_end:double,evidence:array<string>>>, ledger array<struct<evidence_id:string,tool:string,params:string,result:string>>").alias("d"))
    findings, evidence = d.select("run_id", F.inline("d.findings")), d.select("run_id", F.inline("d.ledger"))
    channels = spark.createDataFrame([(r.run_id, c) for r in rows.collect() for c in synth.CHANNELS], "run_id string, channel string")
    got = {(r.arm, r.kind): r for r in mutation.caught(findings, evidence, channels).collect()}
    assert got["untagged", "clean"].caught == got["tagged", "clean"].caught == 0
    for kind in ("fabricated", "swapped", "wrong_unit"):
        assert got["tagged", kind].caught >= 0.97 * got["tagged", kind].n > 0
    assert got["untagged", "fabricated"].caught >= 0.9 * got["untagged", "fabricated"].n and got["untagged", "wrong_unit"].caught >= 0.9 * got["untagged", "wrong_unit"].n
    assert got["untagged", "swapped"].caught > 0.3 * got["untagged", "swapped"].n and got["untagged", "swapped"].caught_grounding < got["untagged", "swapped"].caught


def test_hybrid(spark):
    samples, _, _ = synth.generate(spark, {"calm": []}, FS)
    tables = {"samples": samples.cache(), "fs": FS, "channels": synth.surroundings(spark)["channels"].withColumn("kind", F.when(F.col("channel") == "P_ox_inj", "force").otherwise(F.col("kind")))}
    levels = {"redline": [0.005, 0.2], "deviation": [1.0, 8.0], "spike": [48.0], "dropout": [1.0], "stuck": [1.0], "oscillation": [4.0]}
    scored = hybrid.run_hybrid(spark, tables, reps=1, levels=levels)
    got = {(r.kind, r.level): r for r in hybrid.summarize(scored).where("background IS NULL").collect()}
    assert {k: got[k].detected for k in got} == {("redline", 0.005): 0, ("redline", 0.2): 1, ("deviation", 1.0): 0, ("deviation", 8.0): 1, ("spike", 48.0): 1, ("dropout", 1.0): 1, ("stuck", 1.0): 1, ("oscillation", 4.0): 1}
    # At 250 Hz five milliseconds beyond the line are one sample: what isn't a violation is a spike.
    assert all(r.masked == 0 and r.false_positives == int(k == ("redline", 0.005)) for k, r in got.items())


def test_command_line_and_session(spark, tmp_path, capsys):
    out = str(tmp_path / "made")
    assert cli.main(["synth", "--fs", "250", "--seed", "5", "--anomaly", "overtemp", "--out", out], spark) == 0
    run = f"{out}/SYN-0005/run.csv"
    assert cli.main(["analyze", run, "--out", f"{out}/report"], spark) == 0
    said = capsys.readouterr().out
    assert "T_cool_out beyond its redline" in said and "(partial)" not in said
    assert cli.main(["reproduce", f"{out}/report", "--only", "E1", "--only", "E5"], spark) == 0
    assert capsys.readouterr().out.count("exact") == 2
    assert cli.main(["tools"]) == cli.main(["config", "--env", "nowhere"]) == 0
    raw = tmp_path / "raw.csv"
    raw.write_text("Time [s],Feed [bar]\n0,1\n0.5,2\n")
    capsys.readouterr()
    assert cli.main(["ingest", str(raw), "--suggest"], spark) == 0
    assert json.loads(capsys.readouterr().out)["channels"]["Feed"] == {"column": "Feed [bar]", "unit": "bar", "kind": "pressure", "desc": "Feed"}

    s = Session.open(spark, run)
    assert s.run_id == "SYN-0005" and s.fs == 250 and s.channels_of_kind("command") == ["cmd_fu", "cmd_ox"] and s.channel_info("Pc")["unit"] == "MPa"
    lo, hi = s.phase_window("mainstage")
    assert 1 < lo < 2 and 8.5 < hi < 9.5 and s.time() == (0.0, 11.996) and s.window(1.0, 2.0).where("channel = 'Pc'").count() == 251
    with pytest.raises(KeyError, match="there are"):
        s.phase_window("lunch")
    with pytest.raises(KeyError, match="Pc"):
        s.require_channel("nothing")
    e = s.run("check_redlines")
    assert e.id == "E1" and e.result["n_violations"] == 1 and "check_redlines" in e.reproduce_code() and json.loads(s.ledger_json())[0]["id"] == "E1"
    peak = e.result["violations"][0]["peak_value"]
    good = {"title": "Too hot", "statement": f"a peak of {peak} K [E1.violations[0].peak_value]", "category": "redline_violation", "severity": "critical", "channel": "T_cool_out", "evidence": ["E1"]}
    backend = agents.ScriptedBackend(["no json", {"tool": "nothing"}, {"tool": "check_redlines", "params": {}}, {"submit": {"findings": [{"title": 1}]}}, {"submit": {"findings": [good | {"statement": "a peak of 12345 K"}]}}, {"submit": {"findings": [good]}}])
    made = agents.make_agent("llm", backend=backend, prefetch=False).run(s)
    assert made["agent"]["submitted"] and made["agent"]["fix_rounds_used"] == 1 and made["n_verified"] == 1 and made["agent"]["usage"]["requests"] == 6
    assert made["agent"]["first_submission"]["n_verified"] == 0 and "verifier" in backend.seen[-1]["content"]
    with pytest.raises(ValueError, match="backend"):
        agents.make_agent("llm")

    tools = server.Tools(spark)
    tools.sessions[s.run_id] = s
    ask = [{"id": 1, "method": "tools/list"}, {"method": "note"}, {"id": 2, "method": "tools/call", "params": {"name": "run_analysis", "arguments": {"tool": "describe_data"}}}, {"id": 3, "method": "tools/call", "params": {"name": "run_analysis", "arguments": {"tool": "nothing"}}}, {"id": 4, "method": "x"}]
    reply = io.StringIO()
    server.serve(tools, io.StringIO("\n".join(map(json.dumps, ask)) + "\nnot json\n"), reply)
    got = [json.loads(x) for x in reply.getvalue().splitlines()]
    assert [len(got[0]["result"]["tools"]), got[1]["result"]["isError"], got[2]["result"]["isError"], got[3]["error"]["code"], got[4]["error"]["code"]] == [5, False, True, -32601, -32700]


def test_config(tmp_path):
    path = tmp_path / ".env"
    path.write_text("# a comment\nexport ORRERY_MODEL='some model'\nORRERY_MAX_STEPS=7 # few\nORRERY_PREFETCH=no\nnothing\n")
    c = config.AgentConfig.load(str(path), {"ORRERY_MAX_STEPS": "9"}, lang="zh")
    assert (c.model, c.max_steps, c.prefetch, c.lang) == ("some model", 9, False, "zh")
    with pytest.raises(ValueError, match="no setting"):
        config.AgentConfig.load(None, {}, colour="red")
