"""The command line: python -m orrery COMMAND. Exit code 1 where a reproduction isn't exact, 2 for wrong arguments."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import agents, benchmarks, config, hybrid, ledger, mutation, planner, registry, server, synth
from .session import Session
from .sources import runs


def spark_session() -> SparkSession:
    s = SparkSession.builder.appName("orrery").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def save(made: dict, folder: str, spark: SparkSession) -> None:
    runs.write_document(spark, made, f"{folder}/report.json")
    spark.createDataFrame([(planner.write_html(made),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/report.html")


def synth_command(spark: SparkSession, a) -> int:
    """Writes run.csv, reference.csv, meta.json, limits.json and truth.json of generated runs, a folder each."""
    plan = {f"SYN-{a.seed:04d}": {"seed": a.seed, "anomalies": a.anomaly, "nuisances": []}} if a.anomaly else synth.plan(a.n, a.seed, a.suite)
    samples, reference, truth = (df.cache() for df in synth.generate(spark, plan, a.fs))
    for name, r in plan.items():
        own, folder = F.col("run_id") == name, f"{a.out}/{name}"
        runs.write_run(samples.where(own), f"{folder}/run.csv")
        runs.write_run(reference.where(own), f"{folder}/reference.csv")
        for document, content in synth.documents(name, r, a.fs).items():
            runs.write_document(spark, content, f"{folder}/{document}")
        runs.write_document(spark, [x.asDict() for x in truth.where(own).drop("run_id").collect()], f"{folder}/truth.json")
        print(folder)
    return 0


def analyze_command(spark: SparkSession, a) -> int:
    session = Session.open(spark, a.run)
    made = agents.make_agent("rule", a.lang).run(session)
    for f in made["findings"]:
        print(f"[{f['severity']}] {f['title']}: {f['statement']} ({f['verification']['status']})")
    print(json.dumps(made["verification"]))
    if a.out:
        save(made | {"path": a.run}, a.out, spark)
    return 0


def reproduce_command(spark: SparkSession, a) -> int:
    made = json.loads("".join(r[0] for r in spark.read.text(f"{a.report}/report.json", wholetext=True).collect()))
    session = Session.open(spark, a.run or made["path"])
    rows = [e for e in made["evidence"] if not a.only or e["evidence_id"] in a.only]
    checks = ledger.reproduce(spark, session.tables, spark.createDataFrame(rows, ledger.SCHEMA))
    for c in checks:
        print(f"{c['evidence_id']}: {'exact' if c['exact'] else 'differs'}{'' if c['data_same'] else ', other data'}{'' if c['version_same'] else ', other code'}")
    return 0 if all(c["exact"] for c in checks) else 1


def demo_command(spark: SparkSession, a) -> int:
    a.n, a.seed, a.suite, a.fs, a.anomaly, a.out = 1, 7, "classic", 1000.0, ["oscillation", "overtemp"], a.out or "demo"
    synth_command(spark, a)
    a.run, a.lang = f"{a.out}/SYN-0007/run.csv", "en"
    analyze_command(spark, a)
    a.report, a.only = a.out, []
    return reproduce_command(spark, a)


def eval_command(spark: SparkSession, a) -> int:
    rows = benchmarks.run_benchmark(spark, a.n, a.seed, a.suite, a.fs, a.lang, path=a.out).cache()
    for r in benchmarks.per_type(rows).orderBy(F.col("type").asc_nulls_last()).collect():
        print(json.dumps(r.asDict()))
    print(json.dumps(benchmarks.summarize(rows).first().asDict()))
    return 0


def hybrid_command(spark: SparkSession, a) -> int:
    tables, _ = runs.load_case(spark, a.run)
    rows = hybrid.summarize(hybrid.run_hybrid(spark, tables | {"samples": tables["samples"].cache()}, reps=a.reps, seed=a.seed, kinds=a.kind or None))
    for r in rows.where("background IS NULL").orderBy("kind", "level").collect():
        print(json.dumps(r.asDict()))
    return 0


def mutation_command(spark: SparkSession, a) -> int:
    plan = synth.plan(a.n, a.seed)
    samples, reference, _ = synth.generate(spark, plan, a.fs)
    book, found = planner.analyse(spark, {"samples": samples.cache(), "fs": a.fs, "reference": reference.cache(), **synth.surroundings(spark)}, a.lang)
    for r in mutation.caught(found, book.evidence(), samples.select("run_id", "channel").distinct()).orderBy("arm", "kind").collect():
        print(json.dumps(r.asDict()))
    return 0


def ingest_command(spark: SparkSession, a) -> int:
    if a.suggest:
        print(json.dumps(runs.suggest_mapping("\n".join(r[0] for r in spark.read.text(a.raw).limit(3).collect())), indent=2, ensure_ascii=False))
        return 0
    with open(a.mapping, encoding="utf-8") as f:
        print(json.dumps(runs.prepare(spark, a.raw, json.load(f), a.out)))
    return 0


def reverify_command(spark: SparkSession, a) -> int:
    for r in benchmarks.reverify(spark, benchmarks.kept(spark, a.results)).groupBy("before", "after").count().orderBy("before", "after").collect():
        print(json.dumps(r.asDict()))
    return 0


def leaderboard_command(spark: SparkSession, a) -> int:
    rows = benchmarks.kept(spark, a.results[0])
    for path in a.results[1:]:
        rows = rows.unionByName(benchmarks.kept(spark, path))
    text = benchmarks.leaderboard(benchmarks.summarize(rows))
    print(text)
    if a.out:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(a.out)
    return 0


def tools_command(spark: SparkSession | None, a) -> int:
    for o in registry.REGISTRY.values():
        print(f"{o.name}({', '.join(sorted(o.parameters))}): {o.description}")
    return 0


def config_command(spark: SparkSession | None, a) -> int:
    print(json.dumps(config.AgentConfig.load(a.env).shown(), indent=2))
    return 0


def mcp_command(spark: SparkSession, a) -> int:
    server.serve(server.Tools(spark), sys.stdin, sys.stdout)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="orrery")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, run, *arguments, needs_spark: bool = True) -> None:
        own = sub.add_parser(name, help=(run.__doc__ or "").strip() or None)
        own.set_defaults(run_command=run, needs_spark=needs_spark)
        for names, options in arguments:
            own.add_argument(*names, **options)

    arg = lambda *names, **options: (names, options)
    generated = (arg("--n", type=int, default=10), arg("--seed", type=int, default=1000), arg("--fs", type=float, default=1000.0))
    lang, out = arg("--lang", choices=list(planner.TEXTS), default="en"), arg("--out")
    add("demo", demo_command, out)
    add("synth", synth_command, *generated, arg("--suite", default="classic"), arg("--anomaly", action="append"), arg("--out", required=True))
    add("analyze", analyze_command, arg("run"), lang, out)
    add("reproduce", reproduce_command, arg("report"), arg("--run"), arg("--only", action="append"))
    add("eval", eval_command, *generated, arg("--suite", default="classic"), lang, out)
    add("mcp", mcp_command)
    add("verifier-bench", mutation_command, *generated, lang)
    add("ingest", ingest_command, arg("raw"), arg("--mapping"), arg("--out"), arg("--suggest", action="store_true"))
    add("hybrid-bench", hybrid_command, arg("run"), arg("--reps", type=int, default=3), arg("--seed", type=int, default=0), arg("--kind", action="append"))
    add("reverify", reverify_command, arg("results"))
    add("leaderboard", leaderboard_command, arg("results", nargs="+"), out)
    add("config", config_command, arg("--env", default=".env"), needs_spark=False)
    add("tools", tools_command, needs_spark=False)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    own = spark is None and a.needs_spark
    if own:
        os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH", "")])
        spark = spark_session()
    try:
        return a.run_command(spark, a)
    finally:
        if own:
            spark.stop()
