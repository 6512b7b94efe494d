"""Sensor health and the ratio step reach the ledger and the findings."""

import math

from orrery import planner, registry

FS = 100


def tables(spark):
    pulse = [0.0] * 300 + [50.0] * 500 + [25.0] * 700
    wave = [10 + math.sin(i / 7) + 0.1 * math.sin(i * i) for i in range(1500)]
    spiked, other = list(wave), [2 * x for x in wave]
    spiked[500] += 100
    spiked[900] += 100
    other[501] -= 200
    burn = [0.0] * 300 + [100.0] * 900 + [0.0] * 300
    thrust = [x * (1 + max(0, i - 400) / 700) for i, x in enumerate(burn)]
    data = {"P_stay": pulse, "spiked": spiked, "other": other, "below": [-30 + x for x in wave], "F": thrust, "Pc": burn}
    rows = [("r", c, i, i / FS, v) for c, vs in data.items() for i, v in enumerate(vs)]
    return {
        "samples": spark.createDataFrame(rows, "run_id string, channel string, seq long, t double, v double").cache(), "fs": FS,
        "units": spark.createDataFrame([("below", "psi"), ("spiked", "psi")], "channel string, unit string"),
        "families": spark.createDataFrame([("spiked", "pressure"), ("other", "force")], "channel string, family string"),
        "ratio_pairs": spark.createDataFrame([("F", "Pc")], "thrust string, pressure string"),
    }


def test_health_has_all_kinds(spark):
    found = {k: v.collect() for k, v in registry.get("check_sensor_health")(tables(spark)).items()}
    assert [r.channel for r in found["impossible"]] == ["below"]
    assert [(r.channels, r.n) for r in found["coincident_spikes"]] == [("other,spiked", 2)]
    assert [(r.channel, r.seq) for r in found["spikes"] if r.channel in ("spiked", "other")] == [("spiked", 900)]
    assert "P_stay" in [r.channel for r in found["no_return"]]


def test_playbook_takes_them_up(spark):
    book, found = planner.analyse(spark, tables(spark))
    made = planner.report(book, found)
    titles = {f["title"]: f["verification"]["status"] for f in made["findings"]}
    for title in ("below reads impossible values", "Spikes at once on other,spiked", "P_stay does not return to its baseline", "Ratio of F to Pc drifts"):
        assert titles.get(title) == "verified", titles
