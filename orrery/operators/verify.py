"""The claim verifier: numbers in written findings are held against the numeric fields of the evidence they cite.

Texts are lexed and evidence documents flattened once, in Arrow batches; everything after that is joins and aggregates, so
any number of findings and ledgers is verified in one job.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the findings' language, English and Chinese: units, words that count, roles with the field names they ask
#: for, words that may stand between a role and its number, and categories with the tools that report them.
TIME_UNITS = {"s": 1.0, "sec": 1.0, "ms": 1000.0, "秒": 1.0, "毫秒": 1000.0}
FREQ_UNITS = {"Hz": 1.0, "hz": 1.0, "kHz": 0.001, "赫兹": 1.0}
PERCENT = ["%", "％"]
PHYSICAL_UNITS = ["MPa", "kPa", "Pa", "bar", "psi", "degC", "°C", "℃", "kg", "kHz", "Hz", "hz", "ms", "sec", "s", "K", "N", "g", "m", "W", "J", "V", "A", "rpm"]
COUNT_WORDS = ["sample", "samples", "window", "windows", "spike", "spikes", "gap", "gaps", "个采样点", "个", "次", "段", "条", "处"]
ROLES = {
    "peak": (["峰值", "最大值", "最大", "最高", "peak", "maximum", "max"], r"peak|max"),
    "duration": (["持续时间", "持续", "时长", "历时", "工作时间", "lasting", "duration", "lasted"], r"duration|action_time|total_s|longest|elapsed|dur"),
    "mean": (["平均值", "平均", "均值", "mean", "average", "averages"], r"mean|average|level|median"),
    "integral": (["总冲量", "总冲", "冲量", "积分", "impulse", "integral", "integrates to"], r"integral|impulse"),
    "freq": (["频率", "frequency"], r"freq|hz"),
    "deviation": (["偏差", "偏离", "deviation", "deviates"], r"dev"),
    "latency": (["延迟", "滞后", "latency", "delay"], r"latenc|lat_|delay"),
}
FILLER = ["of", "about", "approximately", "approx", "around", "is", "was", "at", "reached", "reaching", "reaches", "to", "by", "a", "an", "the"]
FILLER_SIGNS = ["达到", "为", "约", "了", "达", "近", "是", "值", ":", "：", "=", "≈", "~"]
CLAUSE_ENDS = "，,；;。\n()（）"
RANGE_WORDS = ["–", "—", "~", "-", "to", "至", "到"]
CATEGORY_TOOLS = {
    "redline_violation": ["check_redlines"],
    "combustion_oscillation": ["detect_oscillation"],
    "sensor_fault": ["check_sensor_health", "detect_oscillation"],
    "valve_response": ["measure_valve_response"],
    "performance_deviation": ["compare_reference", "check_thrust_pressure_ratio"],
    "observation": [],
}
SCALES = {"time": [1.0, 1e3, 1e-3, 60.0], "percent": [1.0], "count": [1.0], "physical": [1.0], "freq": [1.0, 1e-3], "plain": [1.0, 1e3, 1e-3, 100.0, 0.01, 60.0]}
NUMBER = re.compile(r"(?<![A-Za-z_\d.])[-+−]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?")
#: What a finding as a whole may lack, and how it is said.
PROBLEMS = {
    "unknown_evidence": "the ledger has no {0}",
    "unknown_category": "there is no category {0}",
    "channel_not_in_data": "the data has no channel {0}",
    "tag_outside_evidence": "{0} is tagged {1}, of evidence that the finding doesn't cite",
    "tag_not_numeric": "{0} is tagged {1}, where no number stands",
    "tag_mismatch": "{0} is tagged {1}, which holds another value",
    "time_not_found": "no cited evidence has the time {0}",
    "time_not_a_time": "{0} is in the cited evidence, but not as a time",
    "channel_not_in_evidence": "no cited evidence speaks of {0}",
    "category_uncited": "{0} needs evidence of a tool that reports it",
    "category_no_anomaly": "the evidence cited for {0} reports nothing of the kind",
    "category_other_channel": "the evidence cited for {0} reports it for other channels than {1}",
}


def either(words: list[str]) -> str:
    return "|".join(map(re.escape, sorted(words, key=len, reverse=True)))


SEGMENTS = r"(?:\.[^\s.\[\]()]+|\[\d+\])+"
TAG = re.compile(rf"\[\s*(len\(E\d+{SEGMENTS}\)|E\d+{SEGMENTS})\s*\]")
COMPOUND = rf"(?:{either(PHYSICAL_UNITS)})(?:\s?[·*/]\s?(?:{either(PHYSICAL_UNITS)}))*"
UNIT = re.compile(rf"\s*({either([*TIME_UNITS, *FREQ_UNITS, *COUNT_WORDS])}|{COMPOUND})(?![A-Za-z])|\s*({either(PERCENT)})")
SIMPLE_UNITS = {**{u: "time" for u in TIME_UNITS}, **{u: "freq" for u in FREQ_UNITS}, **{u: "count" for u in COUNT_WORDS}, **{u: "percent" for u in PERCENT}}
RANGE = re.compile(rf"^\s*(?:{either(RANGE_WORDS)})\s*$")
WORD_ROLE = {w: role for role, (words, _) in ROLES.items() for w in words}
LEAD = re.compile(rf"(?:(?<![A-Za-z])({either([w for w in WORD_ROLE if w.isascii()])})(?![A-Za-z])|({either([w for w in WORD_ROLE if not w.isascii()])}))((?:\s|{either(FILLER_SIGNS)}|\b(?:{either(FILLER)})\b\.?)*)$", re.I)

NUMBERS = "array<struct<pos:int,token:string,value:double,decimals:int,start:int,stop:int,unit:string,unit_kind:string,unit_scale:double,role:string,in_range:boolean,falls:boolean,tag:string>>"
FIELDS = "array<struct<ord:int,path:string,parent:string,key:string,unit:string,kind:string,value:double>>"


def dimension(unit: str) -> str:
    """Canonical form: sorted units with their powers, cancelled."""
    powers: Counter[str] = Counter()
    sign = 1
    for part in re.split(r"([·*/])", unit.replace(" ", "")):
        if part in ("·", "*", "/"):
            sign = -1 if part == "/" else 1
        elif part:
            powers[{"°C": "degC", "℃": "degC"}.get(part, part)] += sign
    return " ".join(f"{u}^{n}" for u, n in sorted(powers.items()) if n)


def unit_after(text: str, at: int) -> tuple[str | None, str | None, float | None]:
    """Unit, its kind and (for times and frequencies) its scale, straight after a number."""
    m = UNIT.match(text, at)
    if not m:
        return None, None, None
    # The longest reading counts: "m/s" isn't the simple unit that it begins with.
    u = (m[1] or m[2]).strip()
    if (whole := re.compile(rf"\s*({COMPOUND})(?![A-Za-z])").match(text, at)) and len(whole[1]) > len(u):
        u = whole[1].strip()
    kind = SIMPLE_UNITS.get(u, "physical")
    return (dimension(u) if kind == "physical" else u), kind, TIME_UNITS.get(u, FREQ_UNITS.get(u))


def lex(text: str | None) -> list[dict]:
    """Numbers of a text with what stands around them. Source tags and names such as SYN-1013 hold no numbers."""
    if not text:
        return []
    tags = [(m.start(), m[1]) for m in TAG.finditer(text)]
    masked = TAG.sub(lambda m: " " * len(m[0]), text)
    found = []
    for m in NUMBER.finditer(masked):
        i = m.start()
        if i and m[0][0] in "-+" and masked[i - 1].isalpha() or i > 1 and masked[i - 1] in "-_" and masked[i - 2].isalpha():
            continue
        raw = m[0].replace("−", "-")
        signed = raw
        if raw[0] == "-" and found and found[-1]["stop"] == i:  # the dash of a range
            signed = raw[1:]
        mantissa = signed.lower().split("e")[0]
        unit, kind, scale = unit_after(masked, m.end())
        clause = re.split(f"[{CLAUSE_ENDS}]", masked[max(0, i - 40) : i])[-1]
        lead = LEAD.search(clause)
        found.append({"pos": len(found), "token": m[0], "value": float(signed), "decimals": len(mantissa.partition(".")[2]), "start": i, "stop": m.end(), "unit": unit, "unit_kind": kind, "unit_scale": scale, "role": WORD_ROLE[(lead[1] or lead[2]).lower()] if lead else None, "in_range": False, "falls": False, "tag": None})
    for a, b in zip(found, found[1:]):
        gap = masked[a["stop"] : b["start"]]
        own = UNIT.match(gap)
        bare = gap[own.end() :] if own else gap
        if RANGE.match(bare) or (gap == "" and b["token"][0] == "-"):
            a["in_range"] = b["in_range"] = True
            b["falls"] = b["unit_kind"] == "time" and b["value"] < a["value"]
            if a["unit_kind"] is None:
                a.update(unit=b["unit"], unit_kind=b["unit_kind"], unit_scale=b["unit_scale"])
    for at, tag in tags:
        near = [n for n in found if n["stop"] <= at]
        if near and near[-1]["tag"] is None:
            gap = masked[near[-1]["stop"] : at]
            if len(gap) <= 24 and not re.search(rf"[\d:：{CLAUSE_ENDS}]", gap):
                path = re.sub(r"\.(\d+)(?=\.|$|\))", r"[\1]", tag)
                near[-1]["tag"] = re.sub(r"^(len\()?(E\d+)\.result(?=[.\[])", r"\1\2", path)
    return found


def kind_of(key: str, unit: str | None) -> str:
    """What a field of this name holds; the first rule that fits counts."""
    key = key.lower()
    rules = [
        ("count", key.startswith("#len")), ("freq", key.endswith("_hz") or key in ("hz", "freq", "frequency")), ("percent", key.endswith("pct") or key == "percent"),
        ("time", key in ("t", "time") or key.startswith("t_") or key.endswith(("_s", "_ms"))), ("count", key.startswith("n_") or "count" in key or key.endswith("samples") or key in ("windows", "spikes", "gaps")),
        ("physical", bool(unit)),
    ]
    return next((kind for kind, fits in rules if fits), "plain")


def flatten(document: str | None, evidence_id: str = "E") -> list[dict]:
    """Numeric leaves, and the lengths of lists, of an evidence result in the order of the document. A dict's unit isn't handed down to dicts inside it."""
    out: list[dict] = []

    def add(path: str, key: str, unit, value: float) -> None:
        out.append({"ord": len(out), "path": path, "parent": path.rpartition(".")[0] or path, "key": key, "unit": unit, "kind": kind_of(key, unit), "value": float(value)})

    def walk(x, path: str, key: str, unit) -> None:
        if isinstance(x, bool) or x is None:
            return
        if isinstance(x, (int, float)):
            add(path, key, None if unit is None else "ms" if unit == "ms" else dimension(unit), x)
        elif isinstance(x, dict):
            for k, v in x.items():
                said = [u for u in (x.get(f"{k}_unit"), x.get("unit")) if isinstance(u, str)]
                walk(v, f"{path}.{k}", k, said[0] if said else None)
        elif isinstance(x, list):
            add(f"len({path})", f"#len({key})", None, len(x))
            for i, v in enumerate(x):
                walk(v, f"{path}[{i}]", key, unit)

    if document:
        walk(json.loads(document), evidence_id, evidence_id, None)
    return out


def numbers_of(text: Column) -> Column:
    def lexed(texts: pd.Series) -> pd.Series:
        return texts.map(lex)

    return F.pandas_udf(lexed, NUMBERS)(text)


def fields_of(document: Column, evidence_id: Column) -> Column:
    def flattened(documents: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([flatten(d, i) for d, i in zip(documents, ids)])

    return F.pandas_udf(flattened, FIELDS)(document, evidence_id)


def extract_numbers(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """A row for each number in the text."""
    return df.select(*keep, F.inline(numbers_of(F.col(text))))


def flatten_evidence(evidence: DataFrame) -> DataFrame:
    """evidence: run_id, evidence_id, tool, result (JSON). A row for each numeric field."""
    return evidence.select("run_id", "evidence_id", "tool", F.inline(fields_of(F.col("result"), F.col("evidence_id"))))


def citable(evidence: DataFrame) -> DataFrame:
    """The numeric fields that a finding may cite: those of results and, as <id>.params, of parameters."""
    fields = flatten_evidence(evidence)
    if "params" in evidence.columns:
        given = evidence.withColumn("result", F.col("params")).withColumn("evidence_id", F.concat("evidence_id", F.lit(".params")))
        asked = flatten_evidence(given).withColumn("evidence_id", F.regexp_replace("evidence_id", r"\.params$", "")).withColumn("ord", F.col("ord") + 1_000_000)
        fields = fields.unionByName(asked)
    return fields


def tolerance(scaled: Column, decimals: Column) -> Column:
    return F.greatest(0.5 * F.pow(F.lit(10.0), -decimals), 0.01 * F.abs(scaled), F.lit(1e-9))


def judged(asked: DataFrame, fields: DataFrame, keys: list[str]) -> DataFrame:
    """asked (run_id, finding_id, pos, evidence, and a number as lex() gives it) with what it is found to be in the cited fields."""
    scales = F.create_map(*[x for k, v in SCALES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    named = fields.select("run_id", F.col("path").alias("tag"), F.col("value").alias("tag_value"), F.col("parent").alias("tag_parent"), F.col("evidence_id").alias("tag_of"))
    asked = asked.join(named, ["run_id", "tag"], "left").withColumn("tag_value", F.when(F.array_contains("evidence", F.col("tag_of")), F.col("tag_value")))
    wide = fields.withColumn("scale", F.explode(scales[F.col("kind")]))
    wide = wide.select("run_id", "evidence_id", F.col("ord").alias("f_ord"), "path", "parent", "key", F.col("unit").alias("f_unit"), "kind", F.col("value").alias("f_value"), "scale")
    joined = asked.withColumn("evidence_id", F.explode_outer("evidence")).join(wide, ["run_id", "evidence_id"], "left")
    scaled = F.col("f_value") * F.col("scale")
    distance = F.abs(F.abs("value") - F.abs(scaled))
    near = distance <= tolerance(scaled, F.col("decimals"))
    base = F.when(F.lower("key").endswith("_ms") | (F.col("f_unit") == "ms"), 1000.0).otherwise(1.0)
    unit_ok = (
        F.when(F.col("unit_kind").isNull(), True)
        .when(F.col("unit_kind") == "time", (F.col("kind") == "time") & (F.abs(F.col("scale") * base - F.col("unit_scale")) < 1e-9))
        .when(F.col("unit_kind") == "freq", (F.col("kind") == "freq") & (F.abs(F.col("scale") - F.col("unit_scale")) < 1e-9))
        .when(F.col("unit_kind") == "percent", (F.col("kind") == "percent") | (F.col("kind") == "plain") & (F.col("scale") == 100))
        .when(F.col("unit_kind") == "count", F.col("kind") == "count")
        .otherwise((F.col("kind") == "plain") | (F.col("kind") == "physical") & F.col("unit").eqNullSafe(F.col("f_unit")))
    )
    asks = F.create_map(*[x for k, (_, p) in ROLES.items() for x in (F.lit(k), F.lit(p))])
    role_ok = F.col("role").isNull() | F.col("in_range") | F.regexp(F.lower("key"), asks[F.col("role")])
    exact = F.col("path") == F.col("tag")
    # Fields beside the tagged one that hold the very same value share its meaning.
    beside = (F.col("parent") == F.col("tag_parent")) & (F.col("f_value") == F.col("tag_value"))
    held = joined.withColumns({
        "d": distance, "near": F.coalesce(near, F.lit(False)), "unit_ok": F.coalesce(unit_ok, F.lit(False)), "role_ok": F.coalesce(role_ok, F.lit(False)),
        "exact": F.coalesce(exact, F.lit(False)), "named": F.col("tag").isNull() | F.coalesce(exact | beside, F.lit(False)),
    })
    good = F.col("near") & F.col("unit_ok") & F.col("role_ok") & F.col("named")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    nearest = lambda cond: F.min_by(F.when(cond, F.struct("evidence_id", "path")), F.when(cond, F.struct("d", "evidence_id", "f_ord", "scale")))
    return held.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("token", "value", "unit", "role", "tag", "falls")], any_(F.array_contains("evidence", F.regexp_extract("tag", r"E\d+", 0))).alias("tag_cited"),
        any_(F.col("exact")).alias("has_tag"), any_(F.col("exact") & F.col("near")).alias("tag_near"), any_(F.col("near")).alias("has_near"), any_(F.col("near") & (F.col("kind") == "time")).alias("has_time"),
        any_(F.col("near") & F.col("named") & F.col("unit_ok")).alias("has_unit"), any_(good).alias("ok"), nearest(good).alias("best"), nearest(F.col("near")).alias("hint"),
    )


def check_numbers(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """A row for each number of the findings' titles and statements: verdict, and the field that it was held to be.

    findings: run_id, finding_id, title, statement, evidence (ids). Verdicts: verified, ungrounded (no field has the value),
    unit_mismatch, role_mismatch, range_order, and of tagged numbers tag_mismatch, tag_not_numeric, tag_outside_evidence; hint is the
    field that has the value.
    """
    keys = ["run_id", "finding_id", "pos"]
    numbers = extract_numbers(findings.withColumn("text", F.concat_ws("\n", "title", "statement")), ["run_id", "finding_id", "evidence"])
    return verdicts(judged(numbers, citable(evidence), keys), keys)


def verdicts(out: DataFrame, keys: list[str]) -> DataFrame:
    tagged = F.col("tag").isNotNull()
    verdict = (
        F.when(tagged & ~F.col("has_tag") & ~F.col("tag_cited"), "tag_outside_evidence").when(tagged & ~F.col("has_tag"), "tag_not_numeric").when(tagged & ~F.col("tag_near"), "tag_mismatch")
        .when(~F.col("has_near"), "ungrounded").when(F.col("falls"), "range_order").when(F.col("ok"), "verified").when(~F.col("has_unit"), "unit_mismatch").otherwise("role_mismatch")
    )
    return out.select(*keys, "token", "value", "unit", "role", "tag", verdict.alias("verdict"), F.col("best.evidence_id").alias("evidence_id"), F.col("best.path").alias("path"), F.col("hint.path").alias("hint"), "has_near", "has_time")


#: The parts of the tools' results that name channels.
RESULT = """violations array<struct<channel:string>>, interference array<struct<channel:string>>, events array<struct<channel:string,response:string,command:string,exceeds_limit:boolean>>,
ratio array<struct<consistent:boolean>>, summary array<struct<channel:string,within_tolerance:boolean>>, intervals array<struct<channel:string>>,
gaps array<struct<channel:string,channels:array<string>>>, dead array<struct<channel:string>>, duplicates array<struct<channels:array<string>>>, flatlines array<struct<channel:string>>,
spikes array<struct<channel:string>>, impossible array<struct<channel:string>>, no_return array<struct<channel:string>>, coincident_spikes array<struct<channels:string>>"""


def flagged(evidence: DataFrame) -> DataFrame:
    """(run_id, evidence_id, tool, category, channel): for which channels an entry reports what a category claims."""
    r = evidence.select("run_id", "evidence_id", "tool", F.from_json("result", RESULT).alias("r"), F.from_json("params", "thrust string, pressure string").alias("p"))
    none = F.array().cast("array<string>")
    part = lambda name, get=lambda x: F.array(x["channel"]), where=lambda x: F.lit(True): F.coalesce(F.flatten(F.transform(F.filter(F.col(f"r.{name}"), where), get)), none)
    both = lambda x: F.coalesce(x["channels"], F.array(x["channel"]))
    health = F.concat(part("gaps", both), *[part(n) for n in ("dead", "flatlines", "spikes", "impossible", "no_return")], part("duplicates", lambda x: x["channels"]), part("coincident_spikes", lambda x: F.split(x["channels"], ",")))
    drifts = F.coalesce(F.exists("r.ratio", lambda x: ~F.coalesce(x["consistent"], F.lit(True))), F.lit(False))
    reports = {
        ("check_redlines", "redline_violation"): part("violations"), ("detect_oscillation", "combustion_oscillation"): part("events"), ("detect_oscillation", "sensor_fault"): part("interference"), ("check_sensor_health", "sensor_fault"): health,
        ("measure_valve_response", "valve_response"): part("events", lambda x: F.array(x["response"], x["command"]), lambda x: F.coalesce(x["exceeds_limit"], F.lit(False))),
        ("check_thrust_pressure_ratio", "performance_deviation"): F.when(drifts, F.array("p.thrust", "p.pressure")).otherwise(none),
        ("compare_reference", "performance_deviation"): F.concat(part("intervals"), part("summary", where=lambda x: ~F.coalesce(x["within_tolerance"], F.lit(True)))),
    }
    rows = F.array(*[F.struct(F.lit(t).alias("of"), F.lit(c).alias("category"), channels.alias("channels")) for (t, c), channels in reports.items()])
    named = r.select("run_id", "evidence_id", "tool", F.inline(rows)).where("of = tool")
    return named.select("run_id", "evidence_id", "tool", "category", F.explode("channels").alias("channel")).where("channel IS NOT NULL").distinct()


def verify_findings(findings: DataFrame, evidence: DataFrame, channels: DataFrame) -> DataFrame:
    """(run_id, finding_id, status, n_numbers, n_grounded, n_verified, n_tagged, problems, messages) for each finding.

    findings also have category, channel, t_start, t_end; channels: run_id, channel. Problems are codes, messages the same in
    words; status is unsupported without any known evidence, partial with a problem or an unverified number, else verified.
    """
    ids = ["run_id", "finding_id"]
    numbers = extract_numbers(findings.withColumn("text", F.concat_ws("\n", "title", "statement")), [*ids, "evidence"])
    # A finding's own times are numbers of two decimals, at places of their own.
    times = findings.select(*ids, "evidence", F.inline(F.array(*[F.struct(F.lit(p).alias("pos"), F.col(c).cast("double").alias("value")) for p, c in ((-2, "t_start"), (-1, "t_end"))]))).where("value IS NOT NULL").withColumn("decimals", F.lit(2))
    held = verdicts(judged(numbers.unionByName(times, allowMissingColumns=True), citable(evidence), [*ids, "pos"]), [*ids, "pos"])
    said = F.col("pos") >= 0
    wrong = said & (F.col("verdict") != "verified")
    tag_words = F.create_map(*[x for c in ("tag_outside_evidence", "tag_not_numeric", "tag_mismatch") for x in (F.lit(c), F.lit(c))])
    lost = F.when(said & F.col("verdict").startswith("tag_"), F.struct("pos", tag_words[F.col("verdict")].alias("code"), F.array(F.col("token"), F.col("tag")).alias("what"), F.when(F.col("hint").isNotNull(), F.concat(F.lit(" (it is "), "hint", F.lit(")"))).otherwise("").alias("more")))
    timed = F.when((F.col("pos") < 0) & ~F.col("has_near"), F.lit("time_not_found")).when((F.col("pos") < 0) & ~F.col("has_time"), "time_not_a_time")
    late = F.when(timed.isNotNull(), F.struct("pos", timed.alias("code"), F.array(F.col("value").cast("string")).alias("what"), F.lit("").alias("more")))
    counted = held.groupBy(*ids).agg(
        F.count_if(said).alias("n_numbers"), F.count_if(said & F.col("has_near") & ~F.col("verdict").startswith("tag_")).alias("n_grounded"), F.count_if(said & ~wrong).alias("n_verified"), F.count_if(said & F.col("tag").isNotNull()).alias("n_tagged"),
        F.sort_array(F.collect_set(F.when(wrong, F.col("verdict")))).alias("p_numbers"), F.array_sort(F.collect_list(F.coalesce(lost, late))).alias("lost"),
    )
    cited = findings.select(*ids, "category", "channel", F.explode_outer("evidence").alias("evidence_id"))
    tools = F.create_map(*[x for k, v in CATEGORY_TOOLS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    known = cited.join(evidence.select("run_id", "evidence_id", "tool", F.concat_ws(" ", "params", "result").alias("said")), ["run_id", "evidence_id"], "left")
    reported = flagged(evidence).groupBy("run_id", "evidence_id", "category").agg(F.collect_set("channel").alias("flagged"))
    known = known.join(reported, ["run_id", "evidence_id", "category"], "left")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    facts = known.groupBy(*ids).agg(
        F.first("category").alias("category"), F.first("channel").alias("channel"), F.count("tool").alias("n_cited"), F.sort_array(F.collect_set(F.when(F.col("tool").isNull(), F.col("evidence_id")))).alias("unknown"),
        any_(F.array_contains(tools[F.col("category")], F.col("tool"))).alias("tool_ok"), any_(F.size("flagged") > 0).alias("any_flagged"), any_(F.array_contains("flagged", F.col("channel"))).alias("own_flagged"), any_(F.contains("said", "channel")).alias("mentioned"),
    )
    facts = facts.join(channels.select("run_id", "channel", F.lit(True).alias("exists")).distinct(), ["run_id", "channel"], "left").join(counted, ids, "left")
    claims = tools[F.col("category")].isNotNull() & (F.size(tools[F.col("category")]) > 0) & (F.col("n_cited") > 0)
    one = lambda cond, code, *what: F.when(cond, F.struct(F.lit(0).alias("pos"), F.lit(code).alias("code"), F.array(*[F.coalesce(w.cast("string"), F.lit("")) for w in what]).alias("what"), F.lit("").alias("more")))
    has_channel = F.col("channel").isNotNull()
    own = F.array_compact(F.array(
        one(F.size("unknown") > 0, "unknown_evidence", F.array_join("unknown", ", ")), one(tools[F.col("category")].isNull(), "unknown_category", F.col("category")), one(has_channel & F.col("exists").isNull(), "channel_not_in_data", F.col("channel")),
        one(has_channel & (F.col("n_cited") > 0) & ~F.col("mentioned"), "channel_not_in_evidence", F.col("channel")), one(claims & ~F.col("tool_ok"), "category_uncited", F.col("category")),
        one(claims & F.col("tool_ok") & ~F.col("any_flagged"), "category_no_anomaly", F.col("category")), one(claims & F.col("tool_ok") & F.col("any_flagged") & has_channel & ~F.col("own_flagged"), "category_other_channel", F.col("category"), F.col("channel")),
    ))
    texts = F.create_map(*[x for k, v in PROBLEMS.items() for x in (F.lit(k), F.lit(v))])
    whole = F.concat(own, F.coalesce("lost", F.array().cast("array<struct<pos:int,code:string,what:array<string>,more:string>>")))
    fill = lambda x: F.concat(F.replace(F.replace(texts[x["code"]], F.lit("{0}"), F.get(x["what"], 0)), F.lit("{1}"), F.coalesce(F.get(x["what"], 1), F.lit(""))), x["more"])
    facts = facts.withColumn("whole", whole)
    problems = F.array_distinct(F.concat(F.transform("whole", lambda x: x["code"]), F.coalesce("p_numbers", F.array().cast("array<string>"))))
    status = F.when(F.col("n_cited") == 0, "unsupported").when(F.size("problems") > 0, "partial").otherwise("verified")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return facts.withColumn("problems", problems).select(*ids, status.alias("status"), *map(count, ("n_numbers", "n_grounded", "n_verified", "n_tagged")), "problems", F.transform("whole", fill).alias("messages"))


def code_of(message: str) -> str:
    """The problem that a stored message tells of; empty if none does."""
    for code, text in PROBLEMS.items():
        if re.fullmatch(".+?".join(map(re.escape, re.split(r"\{\d\}", text))) + r"( \(it is .*\))?", message, re.S):
            return code
    return ""


def summary(verified: DataFrame) -> DataFrame:
    """Counts by status and of numbers, and the share of grounded numbers (1 without numbers)."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_numbers", "n_grounded", "n_verified", "n_tagged")]
    return verified.agg(n("verified"), n("partial"), n("unsupported"), F.count("*").alias("n_findings"), *sums, F.coalesce(F.try_divide(F.sum("n_grounded"), F.sum("n_numbers")), F.lit(1.0)).alias("grounding_rate"))
