"""The evidence ledger: operator calls with parameters, data and code hashes and results, appended as rows; and their reproduction."""

from __future__ import annotations

import json
import math
import time
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry

SCHEMA = "run_id string, evidence_id string, ordinal long, tool string, params string, result string, data_sha256 string, tool_version string, elapsed_ms double, created_at string"


def rounded(x):
    """Six significant digits; NaN and infinities become null."""
    if isinstance(x, bool) or x is None or isinstance(x, (str, int)):
        return x
    if isinstance(x, float):
        return float(f"{x:.6g}") if math.isfinite(x) else None
    if isinstance(x, dict):
        return {k: rounded(v) for k, v in x.items()}
    return [rounded(v) for v in x]


def canonical(x) -> str:
    return json.dumps(rounded(x), sort_keys=True, ensure_ascii=False)


def data_digest(samples: DataFrame) -> DataFrame:
    """(run_id, data_sha256) of all samples of a run, whatever their order."""
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), "channel", "seq", "t", "v").cast("decimal(38,0)")).cast("string")
    return samples.groupBy("run_id").agg(F.sha2(F.concat_ws(":", part(1), part(2), F.count("*").cast("string")), 256).alias("data_sha256"))


def documents(parts: dict[str, DataFrame]) -> dict[str, dict]:
    """For each run the operator's result as a document. Results are findings about runs, not samples; all parts come in one job."""
    out: dict[str, dict] = {}
    rows = [df.select("run_id", F.lit(name).alias("part"), F.to_json(F.struct(*[c for c in df.columns if c != "run_id"]), {"ignoreNullFields": "false"}).alias("row")) for name, df in parts.items()]
    for r in reduce(DataFrame.unionByName, rows).groupBy("run_id", "part").agg(F.collect_list("row").alias("rows")).collect():
        own = sorted((finite(json.loads(x)) for x in r.rows), key=canonical)
        out.setdefault(r.run_id, {}).update({r.part: own, f"n_{r.part}": len(own)})
    return out


def finite(row: dict) -> dict:
    """NaN and infinities, which JSON has as words, become null."""
    return {k: None if isinstance(v, str) and v in ("NaN", "Infinity", "-Infinity") else v for k, v in row.items()}


class Ledger:
    """Operator calls on all runs of tables, a row for each run and call; with path they are appended there as well."""

    def __init__(self, spark: SparkSession, tables: dict, path: str | None = None) -> None:
        self.spark, self.tables, self.path, self.rows = spark, prepared(spark, tables), path, []
        self.digests = {r.run_id: r.data_sha256 for r in data_digest(tables["samples"]).collect()}
        self.counts = dict.fromkeys(self.digests, 0)

    def run(self, tool: str, **params) -> list[dict]:
        """Runs one operator over all runs and appends a row for each."""
        spec, began = registry.get(tool), time.perf_counter()
        found = documents(spec(self.tables, **params))
        while held := self.tables.get("held"):
            held.pop().unpersist()
        ms, made = (time.perf_counter() - began) * 1000, []
        for run in sorted(self.digests):
            self.counts[run] += 1
            made.append({"run_id": run, "evidence_id": f"E{self.counts[run]}", "ordinal": self.counts[run], "tool": tool, "params": canonical({k: v for k, v in params.items() if v is not None}), "result": canonical(found.get(run, {f"n_{tool}": 0})), "data_sha256": self.digests[run], "tool_version": spec.version, "elapsed_ms": ms, "created_at": datetime.now(UTC).isoformat(timespec="seconds")})
        self.rows += made
        if self.path:
            self.spark.createDataFrame(made, SCHEMA).write.mode("append").parquet(self.path)
        return made

    def evidence(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, SCHEMA)


def prepared(spark: SparkSession, tables: dict) -> dict:
    """tables with channels, segments and phases, found once: they are rows for channels and runs. guessed says that no table named the kinds."""
    out = dict(tables)
    out.setdefault("guessed", "channels" not in tables)
    out["channels"] = registry.about(out)
    for name, find in (("segments", registry.segments_of), ("phases", registry.phases_of)):
        if name not in out:
            found = find(out)
            out[name] = spark.createDataFrame(found.collect(), found.schema)
    return out


def reproduce(spark: SparkSession, tables: dict, evidence: DataFrame) -> list[dict]:
    """Runs every recorded call again: (run_id, evidence_id, exact, data_same, version_same)."""
    rows = evidence.orderBy("ordinal").collect()
    fresh, again = Ledger(spark, tables), {}
    for tool, params in dict.fromkeys((r.tool, r.params) for r in rows):
        for e in fresh.run(tool, **json.loads(params)):
            again[e["run_id"], tool, params] = e
    out = []
    for r in rows:
        e = again.get((r.run_id, r.tool, r.params), {})
        out.append({"run_id": r.run_id, "evidence_id": r.evidence_id, "exact": e.get("result") == r.result, "data_same": e.get("data_sha256") == r.data_sha256, "version_same": e.get("tool_version") == r.tool_version})
    return out
