"""The verifier's lexer and verdicts, by tables of cases."""

import json

import pytest

from orrery.operators import verify


@pytest.mark.parametrize("text, want", [
    ("peak of 761 Hz", [(761, "Hz", "peak", False)]),
    ("lasted 4.42–6.07 s", [(4.42, "s", "duration", True), (6.07, "s", None, True)]),
    ("SYN-1013 and run_42", []),
    ("742.3 K [E4.violations[0].peak_value]", [(742.3, "K^1", None, False)]),
    ("3 samples, 1.127 kHz", [(3, "samples", None, False), (1.127, "kHz", None, False)]),
    ("impulse 39.6 MPa·s", [(39.6, "MPa^1 s^1", "integral", False)]),
    ("7 kg/s·s", [(7, "kg^1", None, False)]),
    ("at −3.5 %", [(-3.5, "%", None, False)]),
    ("5 m/s, 12％ 到 13 秒", [(5, "m^1 s^-1", None, False), (12, "％", None, True), (13, "秒", None, True)]),
    ("mean 12, 13", [(12, None, "mean", False), (13, None, None, False)]),
    ("", []), (None, []), ("no numbers", []),
])
def test_numbers(text, want):
    assert [(n["value"], n["unit"], n["role"], n["in_range"]) for n in verify.lex(text)] == want


def test_tags_and_fields():
    (n,) = verify.lex("742.3 K [E4.violations.0.peak_value]")
    assert n["tag"] == "E4.violations[0].peak_value"
    rows = {r["path"]: r for r in verify.flatten(json.dumps({"a": 1, "a_unit": "bar", "ok": True, "unit": "K", "xs": [2, 3], "sub": {"t_start": 1.5, "gain_pct": 2}}), "E1")}
    assert rows["E1.a"]["unit"] == "bar^1" and rows["len(E1.xs)"]["value"] == 2 and rows["E1.xs[1]"]["unit"] == "K^1"
    assert (rows["E1.sub.t_start"]["kind"], rows["E1.sub.gain_pct"]["kind"]) == ("time", "percent") and "E1.ok" not in rows


EVIDENCE = [
    ("r", "E1", "check_redlines", '{"channel": "T"}', json.dumps({"violations": [{"channel": "T", "unit": "K", "peak_value": 742.3, "limit": 700, "t_start": 4.42, "t_end": 6.07, "duration_s": 1.65}], "n_violations": 1})),
    ("r", "E2", "detect_oscillation", '{"channel": "Pc"}', json.dumps({"events": [{"channel": "Pc", "freq_hz": 761, "mean_amp_pct": 2.5}], "unit": "MPa"})),
]


@pytest.mark.parametrize("text, verdicts", [
    ("The temperature reached a peak of 742.3 K from 4.42 to 6.07 s", ["verified"] * 3),
    ("a peak of 800 K", ["ungrounded"]),
    ("742.3 bar", ["unit_mismatch"]),
    ("lasting 742.3 K", ["role_mismatch"]),
    ("for 1650 ms, 761 Hz, 0.761 kHz", ["verified"] * 3),
    ("761 s", ["unit_mismatch"]),
    ("1 violation", ["verified"]),
    ("6.07–4.42 s", ["verified", "range_order"]),
    ("742.3 K [E1.violations[0].peak_value]", ["verified"]),
    ("742.3 K [E1.violations[0].limit]", ["tag_mismatch"]),
    ("742.3 K [E9.x]", ["tag_outside_evidence"]),
    ("742.3 K [E1.violations[0].channel]", ["tag_not_numeric"]),
    ("7 spikes [E1], 742.3 K", ["ungrounded", "verified"]),
    ("峰值为 742.3 K，持续 1.65 秒", ["verified", "verified"]),
    ("持续 742.3 K", ["role_mismatch"]),
    ("频率约 761 赫兹，1 个", ["verified", "verified"]),
    ("from 6.07 K to 4.42 s", ["unit_mismatch", "range_order"]),
])
def test_verdicts(spark, text, verdicts):
    evidence = spark.createDataFrame(EVIDENCE, "run_id string, evidence_id string, tool string, params string, result string")
    findings = spark.createDataFrame([("r", 1, "x", text, ["E1", "E2"])], "run_id string, finding_id long, title string, statement string, evidence array<string>")
    assert [r.verdict for r in verify.check_numbers(findings, evidence).orderBy("pos").collect()] == verdicts


def test_status(spark):
    evidence = spark.createDataFrame(EVIDENCE, "run_id string, evidence_id string, tool string, params string, result string")
    rows = [
        (1, "redline_violation", "T", 4.42, 6.07, "over the line", "peak 742.3 K", ["E1"]), (2, "redline_violation", "T", 4.3, None, "x", "742.3 K", ["E1"]), (3, "redline_violation", "T", None, None, "x", "742.3 K", ["E7"]),
        (4, "valve_response", "Q", None, None, "x", "nothing", ["E1"]), (5, "observation", None, None, None, "x", "5 K", []), (6, "combustion_oscillation", "Pc", None, None, "x", "761 Hz at 2.5 %", ["E2"]),
    ]
    findings = spark.createDataFrame([("r", *r) for r in rows], "run_id string, finding_id long, category string, channel string, t_start double, t_end double, title string, statement string, evidence array<string>")
    channels = spark.createDataFrame([("r", "T"), ("r", "Pc")], "run_id string, channel string")
    verified = verify.verify_findings(findings, evidence, channels)
    got = {r.finding_id: (r.status, r.problems) for r in verified.collect()}
    assert got[1] == ("verified", []) and got[2] == ("partial", ["time_not_found"]) and got[3][0] == "unsupported" and "unknown_evidence" in got[3][1]
    assert got[4] == ("partial", ["channel_not_in_data", "channel_not_in_evidence", "category_uncited"]) and got[5][0] == "unsupported" and got[6] == ("verified", [])
    s = verify.summary(verified).first()
    assert (s.verified, s.partial, s.unsupported, s.n_numbers) == (2, 2, 2, 6)


def test_what_the_evidence_reports(spark):
    """A category counts only where the cited tool reports it, and for that channel."""
    entries = [
        ("E1", "check_redlines", "{}", {"violations": [], "n_violations": 0, "checked": ["T"]}),
        ("E2", "check_redlines", "{}", {"violations": [{"channel": "T"}]}),
        ("E3", "check_sensor_health", "{}", {"gaps": [{"channel": None, "channels": ["Q", "T"]}], "coincident_spikes": [{"channels": "Pc,Q"}]}),
        ("E4", "measure_valve_response", "{}", {"events": [{"command": "cmd", "response": "Q", "exceeds_limit": False}, {"command": "cmd", "response": "T", "exceeds_limit": True}]}),
        ("E5", "check_thrust_pressure_ratio", '{"thrust": "Q", "pressure": "Pc"}', {"ratio": [{"consistent": False}]}),
        ("E6", "compare_reference", "{}", {"summary": [{"channel": "Pc", "within_tolerance": False}, {"channel": "Q", "within_tolerance": True}], "intervals": []}),
        ("E7", "detect_oscillation", '{"channel": "Pc"}', {"events": [], "interference": [{"channel": "Pc"}]}),
    ]
    evidence = spark.createDataFrame([("r", i, t, p, json.dumps(r)) for i, t, p, r in entries], "run_id string, evidence_id string, tool string, params string, result string")
    cases = [
        ("redline_violation", "T", "E1", ["category_no_anomaly"]), ("redline_violation", "T", "E2", []), ("redline_violation", "Pc", "E2", ["channel_not_in_evidence", "category_other_channel"]), ("redline_violation", None, "E2", []),
        ("sensor_fault", "T", "E3", []), ("sensor_fault", "Pc", "E3", []), ("sensor_fault", "Pc", "E7", []), ("combustion_oscillation", "Pc", "E7", ["category_no_anomaly"]),
        ("valve_response", "T", "E4", []), ("valve_response", "cmd", "E4", []), ("valve_response", "Q", "E4", ["category_other_channel"]), ("performance_deviation", "Pc", "E5", []), ("performance_deviation", "Q", "E5", []),
        ("performance_deviation", "Pc", "E6", []), ("performance_deviation", "Q", "E6", ["category_other_channel"]), ("observation", "Q", "E4", []), ("gremlins", None, "E1", ["unknown_category"]), ("valve_response", "T", "E2", ["category_uncited"]),
    ]
    findings = spark.createDataFrame([("r", i, c, ch, None, None, "x", "y", [e]) for i, (c, ch, e, _) in enumerate(cases)], "run_id string, finding_id long, category string, channel string, t_start double, t_end double, title string, statement string, evidence array<string>")
    channels = spark.createDataFrame([("r", c) for c in ("T", "Q", "Pc", "cmd")], "run_id string, channel string")
    got = {r.finding_id: r for r in verify.verify_findings(findings, evidence, channels).collect()}
    for i, (*_, want) in enumerate(cases):
        assert got[i].problems == want, cases[i]
        assert [verify.code_of(m) for m in got[i].messages] == want


def test_times_and_siblings(spark):
    entry = ("r", "E1", "describe_data", '{"t_start": 3.0}', json.dumps({"rows": [{"stuck_value": 5180.25, "channel_max": 5180.25, "t_end": 7.5, "mean": 4.0}]}))
    evidence = spark.createDataFrame([entry], "run_id string, evidence_id string, tool string, params string, result string")
    cases = [("its maximum, 5180.25 [E1.rows[0].stuck_value]", 7.5, []), ("max 5180.25 [E1.rows[0].stuck_value]", 3.0, []), ("max 5180.25", 7500.0, []), ("x", 4.0, ["time_not_a_time"]), ("x", 99.0, ["time_not_found"]), ("3.0 s [E1.params.t_start]", None, [])]
    findings = spark.createDataFrame([("r", i, "observation", None, t, None, "x", s, ["E1"]) for i, (s, t, _) in enumerate(cases)], "run_id string, finding_id long, category string, channel string, t_start double, t_end double, title string, statement string, evidence array<string>")
    got = {r.finding_id: r.problems for r in verify.verify_findings(findings, evidence, spark.createDataFrame([("r", "Pc")], "run_id string, channel string")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for *_, want in cases]
