"""Benchmarks on generated runs: what the playbook finds of known faults, kept run by run so that a broken-off one goes on; verification
of kept results anew; and tables of several agents."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import planner, synth
from .operators import verify

ROWS = "suite string, seed long, run_id string, agent string, document string"


def kept(spark: SparkSession, path: str | None) -> DataFrame:
    """Finished runs of a results folder."""
    if path is not None:
        try:
            return spark.read.schema(ROWS).parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return spark.createDataFrame([], ROWS)


def run_benchmark(spark: SparkSession, n: int = 30, seed: int = 0, suite: str = "classic", fs: float = 1000, lang: str = "en", tol: float = 0.25, path: str | None = None, agent: str = "rule") -> DataFrame:
    """The rows of n runs from seed on: those that path has already, and all missing ones, analysed in one go and appended to it."""
    plan = synth.plan(n, seed, suite)
    wanted = spark.createDataFrame([(suite, r["seed"], name, agent) for name, r in plan.items()], "suite string, seed long, run_id string, agent string")
    keys = ["suite", "seed", "agent"]
    missing = sorted(r.run_id for r in wanted.join(kept(spark, path).select(*keys), keys, "left_anti").collect())
    made = spark.createDataFrame([], ROWS)
    if missing:
        rows = analysed(spark, {name: plan[name] for name in missing}, fs, lang, tol)
        made = spark.createDataFrame([(suite, plan[name]["seed"], name, agent, json.dumps(rows[name], ensure_ascii=False)) for name in missing], ROWS)
        if path is not None:
            made.write.mode("append").parquet(path)
            made = spark.createDataFrame([], ROWS)
    return kept(spark, path).join(wanted.select(*keys), keys, "left_semi").select("suite", "seed", "run_id", "agent", "document").unionByName(made)


def analysed(spark: SparkSession, runs: dict, fs: float, lang: str, tol: float) -> dict[str, dict]:
    """For each run what a benchmark keeps of it."""
    began = time.perf_counter()
    samples, reference, truth = synth.generate(spark, runs, fs)
    tables = {"samples": samples.cache(), "fs": fs, "reference": reference.cache(), **synth.surroundings(spark)}
    book, found = planner.analyse(spark, tables, lang)
    made = planner.report(book, found)
    hits, false = synth.match(found, truth, tol)
    out = {r: {"anomalies": p["anomalies"], "nuisances": p["nuisances"], "truth": [], "false_positives": [], "findings": [], "ledger": [], "usage": None} for r, p in runs.items()}
    for r in hits.collect():
        out[r.run_id]["truth"].append({k: r[k] for k in ("type", "channel", "hit", "loose", "category_ok", "t_start_error_s")})
    for r in false.collect():
        out[r.run_id]["false_positives"].append({k: r[k] for k in ("category", "channel", "t_start", "title")})
    for f in made["findings"]:
        out[f["run_id"]]["findings"].append(f)
    for e in book.rows:
        out[e["run_id"]]["ledger"].append({k: e[k] for k in ("evidence_id", "tool", "params", "result")})
    took = (time.perf_counter() - began) / max(len(runs), 1)
    for r in out.values():
        r["n_claims"], r["elapsed_s"] = sum(f["category"] != "observation" for f in r["findings"]), took
    samples.unpersist()
    return out


DOCUMENT = """anomalies array<string>, truth array<struct<type:string,channel:string,hit:boolean,loose:boolean,category_ok:boolean,t_start_error_s:double>>, false_positives array<struct<title:string>>,
findings array<struct<verification:struct<status:string,n_numbers:long,n_grounded:long,n_verified:long,n_tagged:long>>>, usage struct<input_tokens:long,output_tokens:long,requests:long>, n_claims long, elapsed_s double"""


def opened(rows: DataFrame) -> DataFrame:
    return rows.select("suite", "seed", "run_id", "agent", F.from_json("document", DOCUMENT).alias("d")).select("suite", "seed", "run_id", "agent", "d.*")


def per_type(rows: DataFrame) -> DataFrame:
    """Recall, accuracy and error of time of each type of fault, and of all (type null)."""
    return synth.summarize(opened(rows).select("run_id", F.inline("truth")))


def summarize(rows: DataFrame) -> DataFrame:
    """One row for each agent and suite: recall (strict, loose), precision, false positives (on runs without faults too), verified claims, grounded
    numbers, tokens, seconds a run."""
    d = opened(rows).withColumn("checks", F.transform("findings", lambda f: f["verification"]))
    total = lambda c, name: F.coalesce(F.sum(F.aggregate("checks", F.lit(0).cast("long"), lambda a, x: a + x[c])), F.lit(0)).alias(name)
    count = lambda a, cond: F.sum(F.size(F.filter(a, cond)))
    truths = F.sum(F.size("truth"))
    used = lambda k: F.coalesce(F.sum(f"usage.{k}"), F.lit(0)).alias(k)
    return d.groupBy("agent", "suite").agg(
        F.count("*").alias("runs"), F.try_divide(count("truth", lambda t: t["hit"]), truths).alias("recall"), F.try_divide(count("truth", lambda t: t["loose"]), truths).alias("recall_loose"),
        F.try_divide(count("truth", lambda t: t["category_ok"]), truths).alias("category_accuracy"), F.try_divide(F.sum("n_claims") - F.sum(F.size("false_positives")), F.sum("n_claims")).alias("precision"),
        F.sum(F.size("false_positives")).alias("false_positives"), F.count_if(F.size("anomalies") == 0).alias("nominal_runs"), F.coalesce(F.sum(F.when(F.size("anomalies") == 0, F.size("false_positives"))), F.lit(0)).alias("false_positives_on_nominal_runs"),
        count("checks", lambda c: c["status"] == "verified").alias("verified"), F.sum(F.size("checks")).alias("findings"), total("n_numbers", "n_numbers"), total("n_grounded", "n_grounded"), total("n_tagged", "n_tagged"),
        used("input_tokens"), used("output_tokens"), used("requests"), F.avg("elapsed_s").alias("mean_elapsed_s"),
    )


def reverify(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Kept findings verified anew against their kept ledgers, without running any operator: run_id, finding_id, before, after."""
    schema = "findings array<struct<finding_id:long,title:string,statement:string,category:string,channel:string,t_start:double,t_end:double,evidence:array<string>,verification:struct<status:string>>>, ledger array<struct<evidence_id:string,tool:string,params:string,result:string>>"
    d = rows.select("run_id", F.from_json("document", schema).alias("d"))
    findings = d.select("run_id", F.inline("d.findings"))
    evidence = d.select("run_id", F.inline("d.ledger"))
    # The channels that there are: those that describe_data names.
    said = F.from_json("result", "channels array<struct<channel:string>>")
    channels = evidence.where("tool = 'describe_data'").select("run_id", F.inline(said["channels"])).distinct()
    fresh = verify.verify_findings(findings.drop("verification"), evidence, channels).select("run_id", "finding_id", F.col("status").alias("after"))
    return findings.select("run_id", "finding_id", F.col("verification.status").alias("before")).join(fresh, ["run_id", "finding_id"])


def leaderboard(summary: DataFrame) -> str:
    """A table of agents in Markdown, the best recall first, then precision."""
    rows = sorted(summary.collect(), key=lambda r: (-(r.recall or 0), -(r.precision or 0), r.agent))
    share = lambda x: "–" if x is None else f"{100 * x:.0f} %"
    lines = ["| agent | suite | runs | recall | loose | category | precision | false positives | verified | numbers grounded | s a run |", "|" + "-|" * 11]
    lines += [f"| {r.agent} | {r.suite} | {r.runs} | {share(r.recall)} | {share(r.recall_loose)} | {share(r.category_accuracy)} | {share(r.precision)} | {r.false_positives} | {r.verified}/{r.findings} | {r.n_grounded}/{r.n_numbers} | {r.mean_elapsed_s:.1f} |" for r in rows]
    return "\n".join(lines) + "\n"
