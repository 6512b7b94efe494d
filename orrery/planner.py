"""The rule playbook: which operators run, and which of their results become findings; and the report of it all."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession

from .ledger import Ledger, canonical
from .operators import verify

FINDING = "run_id string, finding_id long, title string, statement string, category string, severity string, channel string, t_start double, t_end double, evidence array<string>"
ORDER = {"critical": 0, "warning": 1, "info": 2}
#: A deviation that begins within so many seconds of mainstage may follow from a late valve.
SOON_S = 0.6

#: What findings say: title and statement of each kind. Every number is a field of the cited evidence, and its unit that field's.
TEXTS = {
    "en": {
        "phases": ("Firing: mainstage from {mainstage_start_s} to {mainstage_end_s} s", "{channel} ignites at {ignition_s} s and settles at {steady_level} {unit}; mainstage is held for {mainstage_duration_s} s."),
        "fallback": ("", " {fallback_from} shows no clear pulse, so the phases are those of {channel}."),
        "cut": ("Record ends during the firing", "{channel} ignites at {ignition_s} s; the record ends at {record_end_s} s at a value of {value_at_record_end} {unit}."),
        "pulse": ("Pulse of {channel}: impulse {integral} {integral_unit}", "It reaches a peak of {peak} {unit} at {t_peak} s and integrates to {integral} {integral_unit} between {t_start} and {t_end} s."),
        "short_spike": ("", " The peak is a short spike; sustained are {peak_sustained} {unit}."),
        "redline": ("{channel} beyond its redline", "From {t_start} to {t_end} s it passes the limit of {limit} {unit}, with a peak of {peak_value} {unit} at {t_peak} s."),
        "valve": ("{response} answers {command} late", "The command at {t_cmd} s is answered with a latency of {latency_ms} ms; {max_latency_ms} ms are allowed."),
        "valve_folded": ("", " {channel} follows: its mean deviation is {mean_dev_pct} % from {t_start} to {t_end} s."),
        "hum": ("Interference on {channel} at {freq_hz} Hz", "The line with a frequency of {freq_hz} Hz stands there before ignition already, with {pre_ignition_amp} {unit}."),
        "oscillation": ("{channel} oscillates at {freq_hz} Hz", "A line with a frequency of {freq_hz} Hz from {t_start} to {t_end} s, with an amplitude of {amplitude} against a criterion of {threshold_pct} %."),
        "corroborated": ("", " {other} shows it too, at {other_freq_hz} Hz."),
        "ratio": ("Ratio of {thrust} to {pressure} drifts", "It lies between {ratio_min} at {t_ratio_min} s and {ratio_max} at {t_ratio_max} s, a change of {change_pct} %; {max_change_pct} % are allowed."),
        "deviation": ("{channel} departs from its prediction", "From {t_start} to {t_end} s its mean deviation is {mean_dev_pct} %, beyond the tolerance of {tolerance_pct} %."),
        "injector": ("", " {channel} moves with it, by {mean_dev_pct} %."),
        "efficiency": ("", " The flows are as predicted ({channels}), which points to combustion efficiency."),
        "dead": ("{channel} is dead", "It reads {value} all the time."),
        "gap": ("Gap in {channel}", "{total_samples} samples are missing from {t_start} to {t_end} s."),
        "gaps": ("Gaps recur in {channel}", "There are {count} gaps with {total_samples} samples in all; the longest has {longest_samples} samples."),
        "gaps_all": ("Gaps recur in all channels at once", "There are {count} gaps with {total_samples} samples in all; the longest has {longest_samples} samples."),
        "duplicates": ("Channels that are copies: {listed}", "Their samples are the same throughout."),
        "flatline": ("{channel} is stuck", "It stays at {stuck_value} from {t_start} to {t_end} s, lasting {duration_s} s."),
        "saturated": ("{channel} stays at its upper end", "It reads its maximum {channel_max} from {t_start} to {t_end} s."),
        "bottomed": ("{channel} stays at its lower end", "It reads its lowest, {channel_min}, from {t_start} to {t_end} s."),
        "spikes": ("Spikes of {channel}", "The first reads {value} at {t} s."),
        "last_spike": ("", " The last reads {value} at {t} s."),
        "coincident": ("Spikes at once on {channels}", "Between {t_start} and {t_end} s; sensors of several kinds see them, so they may be real."),
        "impossible": ("{channel} reads impossible values", "It goes down to {min_value}, below what is physically possible, {physical_limit}, for {share_of_record_pct} % of the record."),
        "no_return": ("{channel} does not return to its baseline", "It stays at {post_level} after {baseline} before, an offset of {offset_of_steady_pct} %."),
    },
    "zh": {
        "phases": ("点火工作：主级 {mainstage_start_s} 至 {mainstage_end_s} s", "{channel} 在 {ignition_s} s 点火，稳定于 {steady_level} {unit}；主级共 {mainstage_duration_s} s。"),
        "fallback": ("", "{fallback_from} 没有清晰的脉冲，因此采用 {channel} 的阶段。"),
        "cut": ("记录在工作中结束", "{channel} 在 {ignition_s} s 点火；记录止于 {record_end_s} s，当时读数 {value_at_record_end} {unit}。"),
        "pulse": ("{channel} 的脉冲：总冲 {integral} {integral_unit}", "峰值为 {peak} {unit}，在 {t_peak} s；从 {t_start} 到 {t_end} s 的积分为 {integral} {integral_unit}。"),
        "short_spike": ("", "该峰只是短尖峰；持久部分 {peak_sustained} {unit}。"),
        "redline": ("{channel} 越过红线", "从 {t_start} 到 {t_end} s 越过 {limit} {unit} 的限值，峰值为 {peak_value} {unit}，在 {t_peak} s。"),
        "valve": ("{response} 对 {command} 响应过晚", "指令在 {t_cmd} s，延迟 {latency_ms} ms；允许 {max_latency_ms} ms。"),
        "valve_folded": ("", "{channel} 随之偏离：平均偏差 {mean_dev_pct} %，从 {t_start} 到 {t_end} s。"),
        "hum": ("{channel} 上 {freq_hz} Hz 的干扰", "频率为 {freq_hz} Hz 的谱线在点火前已存在，{pre_ignition_amp} {unit}。"),
        "oscillation": ("{channel} 以 {freq_hz} Hz 振荡", "频率为 {freq_hz} Hz 的谱线，从 {t_start} 到 {t_end} s，幅度 {amplitude}，判据 {threshold_pct} %。"),
        "corroborated": ("", "{other} 也有，{other_freq_hz} Hz。"),
        "ratio": ("{thrust} 与 {pressure} 之比变化", "介于 {t_ratio_min} s 的 {ratio_min} 与 {t_ratio_max} s 的 {ratio_max}，变化 {change_pct} %；允许 {max_change_pct} %。"),
        "deviation": ("{channel} 偏离预测", "从 {t_start} 到 {t_end} s，平均偏差 {mean_dev_pct} %，超出 {tolerance_pct} % 的容差。"),
        "injector": ("", "{channel} 随之变化 {mean_dev_pct} %。"),
        "efficiency": ("", "流量符合预测（{channels}），说明燃烧效率偏低。"),
        "dead": ("{channel} 失效", "读数始终是 {value}。"),
        "gap": ("{channel} 有缺口", "从 {t_start} 到 {t_end} s 缺 {total_samples} 个采样点。"),
        "gaps": ("{channel} 反复缺数", "有 {count} 处缺口，共 {total_samples} 个采样点，最长 {longest_samples} 个采样点。"),
        "gaps_all": ("所有通道同时反复缺数", "有 {count} 处缺口，共 {total_samples} 个采样点，最长 {longest_samples} 个采样点。"),
        "duplicates": ("相同的通道：{listed}", "它们的采样完全相同。"),
        "flatline": ("{channel} 卡住", "从 {t_start} 到 {t_end} s 停在 {stuck_value}，持续 {duration_s} s。"),
        "saturated": ("{channel} 停在上限", "从 {t_start} 到 {t_end} s 读数为最大值 {channel_max}。"),
        "bottomed": ("{channel} 停在下限", "从 {t_start} 到 {t_end} s 读数为下限 {channel_min}。"),
        "spikes": ("{channel} 的尖峰", "第一个在 {t} s，读数 {value}。"),
        "last_spike": ("", "最后一个在 {t} s，读数 {value}。"),
        "coincident": ("{channels} 同时出现尖峰", "在 {t_start} 至 {t_end} s；不同类型的传感器都有，可能是真实的。"),
        "impossible": ("{channel} 读数不可能", "低至 {min_value}，低于物理极限 {physical_limit}，占记录的 {share_of_record_pct} %。"),
        "no_return": ("{channel} 未回到基线", "此后停在 {post_level}，此前为 {baseline}，偏移 {offset_of_steady_pct} %。"),
    },
}


class Words:
    """Titles and statements of one language."""

    def __init__(self, lang: str) -> None:
        self.texts = TEXTS[lang]

    def __call__(self, kind: str, /, **values) -> tuple[str, str]:
        shown = {k: f"{v:.6g}" if isinstance(v, float) else ", ".join(v) if isinstance(v, list) else "" if v is None else str(v) for k, v in values.items()}
        title, statement = (t.format_map(shown).replace(" ;", ";").replace(" ,", ",").replace("  ", " ") for t in self.texts[kind])
        return title.rstrip(), statement


def analyse(spark: SparkSession, tables: dict, lang: str = "en") -> tuple[Ledger, DataFrame]:
    """Runs the playbook over all runs of tables (samples, fs, and what there is of channels, redlines, valve_pairs, ratio_pairs (thrust,
    pressure), reference, settings); the ledger and the findings. Every operator takes all runs in one go."""
    ledger = Ledger(spark, tables)
    tables = ledger.tables
    for tool in ("describe_data", "segment_phases", "pulse_metrics", "check_sensor_health", "check_redlines", "measure_valve_response"):
        ledger.run(tool)
    for pair in ratio_pairs(tables):
        ledger.run("check_thrust_pressure_ratio", **pair)
    ledger.run("detect_oscillation")
    ledger.run("corroborate_oscillation")
    if "reference" in tables:
        ledger.run("compare_reference")
    kinds = {r.channel: r.kind for r in tables["channels"].collect()}
    words, found, by_run = Words(lang), [], {}
    for e in ledger.rows:
        by_run.setdefault(e["run_id"], []).append(e)
    for run, entries in sorted(by_run.items()):
        found += conclude(run, entries, kinds, words)[0]
    numbered = [{**f, "finding_id": i} for i, f in enumerate(found)]
    return ledger, spark.createDataFrame(numbered, FINDING)


def ratio_pairs(tables: dict) -> list[dict]:
    """The given pairs; else the first force with the primary pressures of the runs, as there mostly is one."""
    if "ratio_pairs" in tables:
        return [r.asDict() for r in tables["ratio_pairs"].select("thrust", "pressure").distinct().orderBy("thrust", "pressure").collect()]
    forces = sorted(r.channel for r in tables["channels"].where("kind = 'force'").collect())
    known = {r.channel for r in tables["channels"].where("kind = 'pressure'").collect()}
    pressures = sorted({r.fallback_from or r.channel for r in tables["phases"].collect()} & known)
    return [{"thrust": forces[0], "pressure": p} for p in pressures] if forces else []


def conclude(run: str, entries: list[dict], kinds: dict[str, str], words: Words) -> tuple[list[dict], set[str]]:
    """The findings of one run in order of severity and time, and the channels whose measurement explains itself away."""
    out: list[dict] = []
    covered: set[str] = set()
    results = {}
    for e in entries:
        results.setdefault(e["tool"], []).append((e["evidence_id"], json.loads(e["result"])))

    def rows(tool: str, part: str):
        return [(i, v) for i, r in results.get(tool, []) for v in r.get(part, [])]

    def add(said: tuple[str, str], category: str, severity: str, evidence: str, channel=None, t_start=None, t_end=None) -> dict:
        out.append({"run_id": run, "title": said[0], "statement": said[1], "category": category, "severity": severity, "channel": channel, "t_start": t_start, "t_end": t_end, "evidence": [evidence]})
        return out[-1]

    def extend(finding: dict, said: tuple[str, str], *evidence: str) -> None:
        finding["statement"] += said[1]
        finding["evidence"] += [e for e in evidence if e not in finding["evidence"]]

    (seg_id, phases) = next(iter(rows("segment_phases", "phases")), (None, {}))
    primary, cut = phases.get("channel"), bool(phases.get("fired") and phases.get("record_ends_during_firing"))
    if cut:
        add(words("cut", **phases), "observation", "warning", seg_id, primary, phases["ignition_s"], phases["record_end_s"])
    elif phases.get("fired"):
        f = add(words("phases", **phases), "observation", "info", seg_id, primary, phases["mainstage_start_s"], phases["mainstage_end_s"])
        if phases.get("fallback_from"):
            extend(f, words("fallback", **phases))
    for i, v in rows("pulse_metrics", "pulses"):
        if kinds.get(v["channel"]) == "force" and not cut:
            f = add(words("pulse", **v), "observation", "info", i, v["channel"], v["t_start"], v["t_end"])
            if v["peak_is_short_spike"]:
                extend(f, words("short_spike", **v))

    fault = lambda said, i, channel=None, a=None, b=None, category="sensor_fault": add(said, category, "warning", i, channel, a, b)
    health = lambda part: rows("check_sensor_health", part)
    for i, v in health("gaps"):
        if v["kind"] == "nan_gap":
            fault(words("gap", **v), i, v["channel"], v["t_start"], v["t_end"])
        else:
            fault(words("gaps" if v["channel"] else "gaps_all", **v), i, v["channel"])
    for i, v in health("dead"):
        fault(words("dead", **v), i, v["channel"])
        covered.add(v["channel"])
    for i, v in health("impossible"):
        fault(words("impossible", **v), i, v["channel"], v["t_start"], v["t_end"])
        covered.add(v["channel"])
    for i, v in health("flatlines"):
        kind = "saturated" if v["at_channel_max"] else "bottomed" if v["at_channel_min"] else "flatline"
        fault(words(kind, **v), i, v["channel"], v["t_start"], v["t_end"])
        covered.add(v["channel"])
    spikes: dict[str, list] = {}
    for i, v in health("spikes"):
        spikes.setdefault(v["channel"], []).append((v["t"], i, v))
    for channel, own in spikes.items():
        own.sort(key=lambda x: x[0])
        f = fault(words("spikes", **own[0][2]), own[0][1], channel, own[0][0], own[-1][0])
        if len(own) > 1:
            extend(f, words("last_spike", **own[-1][2]))
    for i, v in health("coincident_spikes"):
        fault(words("coincident", **v), i, None, v["t_start"], v["t_end"], "observation")
    for i, v in health("duplicates"):
        fault(words("duplicates", listed=v["channels"]), i)
        covered.update(v["channels"])
    for i, v in health("no_return"):
        fault(words("no_return", **v), i, v["channel"])

    for i, v in rows("check_redlines", "violations"):
        add(words("redline", **v), "redline_violation", "critical", i, v["channel"], v["t_start"], v["t_end"])
        covered.add(v["channel"])
    late = [add(words("valve", **v), "valve_response", "warning", i, v["response"], v["t_cmd"], v["t_response"]) for i, v in rows("measure_valve_response", "events") if v["exceeds_limit"] and v["latency_ms"] is not None]
    for i, v in [] if cut else rows("check_thrust_pressure_ratio", "ratio"):
        if v["applicable"] and not v["consistent"]:
            add(words("ratio", **{**v, "change_pct": v["change_pct"] if v["change_pct"] is not None else 0.0}), "performance_deviation", "warning", i, v["pressure"], v["t_start"], v["t_end"])

    for i, v in [] if cut else rows("detect_oscillation", "interference"):
        add(words("hum", **v), "sensor_fault", "warning", i, v["channel"], v["t_start"], v["t_end"])
    seen = {(v["channel"], v["t_start"]): (i, v) for i, v in rows("corroborate_oscillation", "events")}
    for i, v in [] if cut else rows("detect_oscillation", "events"):
        size = f"{v['peak_amp_pct']:.6g} %" if v["peak_amp_pct"] is not None else f"{v['peak_amp']:.6g} {v['unit'] or ''}".rstrip()
        severe = "critical" if (v["peak_amp_pct"] or 0) >= 2 * v["threshold_pct"] else "warning"
        f = add(words("oscillation", amplitude=size, **v), "combustion_oscillation", severe, i, v["channel"], v["t_start"], v["t_end"])
        if hit := seen.get((v["channel"], v["t_start"])):
            extend(f, words("corroborated", **hit[1]), hit[0])

    departures(rows, primary, kinds, covered, add, extend, words)
    # A late valve delays ignition: what other channels depart by early in mainstage is its consequence.
    if late and phases.get("mainstage_start_s") is not None:
        for f in [f for f in out if f["category"] == "performance_deviation" and f["channel"] != primary and f["t_start"] is not None and f["t_start"] - phases["mainstage_start_s"] < SOON_S]:
            v = next((v for _, v in rows("compare_reference", "intervals") if v["channel"] == f["channel"] and v["t_start"] == f["t_start"]), None)
            if v is not None:
                out.remove(f)
                extend(late[0], words("valve_folded", **v), *f["evidence"])
    out.sort(key=lambda f: (ORDER[f["severity"]], f["t_start"] or 0, f["title"]))
    return out, covered


def departures(rows, primary, kinds, covered, add, extend, words) -> None:
    """Deviations from the prediction. Pressures that move together with the primary one are told with it, and so is that all flows are as predicted."""
    intervals: dict[str, list] = {}
    for i, v in rows("compare_reference", "intervals"):
        intervals.setdefault(v["channel"], []).append((i, v))
    summary = {v["channel"]: (i, v) for i, v in rows("compare_reference", "summary")}
    meets = lambda v, others: any(v["t_start"] < o["t_end"] and o["t_start"] < v["t_end"] for _, o in others)
    main = intervals.get(primary, [])
    folded = [c for c, own in sorted(intervals.items()) if c != primary and kinds.get(c) == "pressure" and c not in covered and main and all(meets(v, main) for _, v in own)]
    flows = sorted(c for c in summary if kinds.get(c) == "flow")
    for channel, own in sorted(intervals.items()):
        if channel in covered or (channel in folded and primary not in covered):
            continue
        for i, v in own:
            f = add(words("deviation", **v), "performance_deviation", "warning", i, channel, v["t_start"], v["t_end"])
            if channel != primary:
                continue
            for c in folded:
                extend(f, words("injector", **intervals[c][0][1]), intervals[c][0][0])
            if flows and all(summary[c][1]["within_tolerance"] for c in flows):
                extend(f, words("efficiency", channels=[f"{c} {summary[c][1]['mean_dev_pct']:.6g} %" for c in flows]), *[summary[c][0] for c in flows])


def report(ledger: Ledger, found: DataFrame) -> dict:
    """Findings with their verification, the summary of it, and the ledger; small beside the samples."""
    evidence = ledger.evidence()
    verified = verify.verify_findings(found, evidence, ledger.tables["samples"].select("run_id", "channel").distinct())
    status = {(r.run_id, r.finding_id): r.asDict(recursive=True) for r in verified.collect()}
    rows = [r.asDict(recursive=True) | {"verification": status[r.run_id, r.finding_id]} for r in found.orderBy("finding_id").collect()]
    checks = [r["verification"] for r in rows]
    counts = {s: sum(c["status"] == s for c in checks) for s in ("verified", "partial", "unsupported")}
    numbers = {n: sum(c[n] for c in checks) for n in ("n_numbers", "n_grounded", "n_verified", "n_tagged")}
    return {"findings": rows, "evidence": ledger.rows, "n_verified": counts["verified"], "verification": counts | numbers | {"grounding_rate": numbers["n_grounded"] / numbers["n_numbers"] if numbers["n_numbers"] else 1.0}}


def write_html(made: dict) -> str:
    lines = [f"<li><b>{html.escape(f['title'])}</b> {html.escape(f['statement'])} ({f['severity']}, {f['verification']['status']}, {', '.join(f['evidence'])})</li>" for f in made["findings"]]
    tables = [f"<tr><td>{e['evidence_id']}</td><td>{e['tool']}</td><td><code>{html.escape(e['params'])}</code></td><td><details><summary>{len(e['result'])} characters</summary><code>{html.escape(e['result'])}</code></details></td></tr>" for e in made["evidence"]]
    return f"<!doctype html><meta charset=utf-8><title>Report</title><ul>{''.join(lines)}</ul><table>{''.join(tables)}</table>"


def write_json(made: dict) -> str:
    return canonical(made)
