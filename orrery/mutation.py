"""How many wrong numbers the verifier catches: findings with one error each, all verified in one job.

A number of a statement is made up (a multiple of itself), swapped (for another field of the cited evidence), or given a wrong unit;
in a second arm every number that the verifier accepts carries the path of its field.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import verify

#: Multiples that make a number up, and the unit that each kind of unit is exchanged for.
FACTORS = (0.7, 0.8, 1.25, 1.5)
EXCHANGED = {"time": "Hz", "freq": "s", "percent": "s", "count": "s", "physical": "s"}
GROUNDING = ["unknown_evidence", "unknown_category", "channel_not_in_data", "time_not_found", "channel_not_in_evidence"]


def lot(*parts) -> int:
    """A number that depends on the parts alone, however the findings are dealt out."""
    return zlib.crc32("\u0001".join(map(str, parts)).encode())


def variants(statement: str, fields: list[tuple[str, float]], key: str) -> list[tuple[str, str]]:
    """(kind, statement) with one error each."""
    out = []
    for n in verify.lex(statement):
        token, decimals, value = n["token"], n["decimals"], n["value"]
        put = lambda new: statement[: n["start"]] + new + statement[n["stop"] :]  # noqa: E731, B023
        shown = lambda x: f"{x:.{decimals}f}"  # noqa: E731, B023
        if abs(value) >= 5 * 10**-decimals:
            new = shown(value * FACTORS[lot(key, n["start"]) % len(FACTORS)])
            if new != token:
                out.append(("fabricated", put(new)))
        others = sorted({shown(v) for _, v in fields if abs(v) > 10**-decimals and abs(v - value) > 0.05 * max(abs(value), 1e-9)} - {token, shown(0)})
        if others:
            out.append(("swapped", put(others[lot(key, n["start"], "swap") % len(others)])))
        m = verify.UNIT.match(statement, n["stop"])
        if m and n["unit_kind"] in EXCHANGED:
            a, b = m.span(1) if m[1] else m.span(2)
            out.append(("wrong_unit", statement[:a] + EXCHANGED[n["unit_kind"]] + statement[b:]))
    return out


def tagged(statement: str, paths: dict[int, str]) -> str:
    """The statement with its field's path behind each number (by its place) and unit."""
    for n in reversed(verify.lex(statement)):
        if path := paths.get(n["pos"]):
            m = verify.UNIT.match(statement, n["stop"])
            at = m.end() if m else n["stop"]
            statement = f"{statement[:at]} [{path}]{statement[at:]}"
    return statement


def mutants(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """findings once as they are (kind clean) and once for each error, in the arms untagged and tagged; finding_id becomes text."""
    keys = ["run_id", "finding_id"]
    fields = verify.flatten_evidence(evidence).groupBy("run_id", "evidence_id").agg(F.collect_list(F.struct("path", "value")).alias("fields"))
    cited = findings.select(*keys, F.explode_outer("evidence").alias("evidence_id")).join(fields, ["run_id", "evidence_id"], "left").groupBy(*keys).agg(F.flatten(F.collect_list("fields")).alias("fields"))
    # Numbers of the statement alone: their places in it, not in title and statement together.
    numbers = verify.check_numbers(findings.withColumn("title", F.lit("")), evidence).where("verdict = 'verified'").groupBy(*keys).agg(F.collect_list(F.struct("pos", "path")).alias("paths"))
    wide = findings.join(cited, keys, "left").join(numbers, keys, "left").withColumn("finding_id", F.col("finding_id").cast("string"))
    columns = findings.columns
    schema = ", ".join(f"{c} {'string' if c == 'finding_id' else t}" for c, t in findings.dtypes) + ", arm string, kind string"

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                own = {c: r[c] for c in columns}
                known = [(f["path"], f["value"]) for f in (r["fields"] if r["fields"] is not None else [])]
                paths = {p["pos"]: p["path"] for p in (r["paths"] if r["paths"] is not None else [])}
                for arm, said in (("untagged", r["statement"]), ("tagged", tagged(r["statement"], paths))):
                    made = [("clean", said), *variants(said, known, f"{r['run_id']}:{r['finding_id']}:{arm}")]
                    out += [own | {"finding_id": f"{r['finding_id']}:{arm}:{i}", "statement": text, "arm": arm, "kind": kind} for i, (kind, text) in enumerate(made)]
            yield pd.DataFrame(out, columns=[*columns, "arm", "kind"])

    return wide.select(*columns, "fields", "paths").mapInPandas(run, schema)


def caught(findings: DataFrame, evidence: DataFrame, channels: DataFrame) -> DataFrame:
    """(arm, kind, n, caught_grounding, caught): how many of each kind the verifier flags, and how many it would by grounding alone."""
    made = mutants(findings, evidence)
    checked = verify.verify_findings(made, evidence, channels)
    named = made.select("run_id", "finding_id", "arm", "kind").join(checked, ["run_id", "finding_id"])
    ground = (F.col("n_grounded") < F.col("n_numbers")) | (F.col("status") == "unsupported") | F.arrays_overlap("problems", F.array(*map(F.lit, GROUNDING)))
    return named.groupBy("arm", "kind").agg(F.count("*").alias("n"), F.count_if(ground).alias("caught_grounding"), F.count_if(F.col("status") != "verified").alias("caught"))
