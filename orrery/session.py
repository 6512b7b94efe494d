"""One or more runs under analysis: operators by name, with the evidence that they leave, phases, windows and channels."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry
from .ledger import Ledger
from .operators import cards
from .sources import runs


@dataclass(frozen=True)
class Evidence:
    """An entry of the ledger."""

    run_id: str
    id: str
    tool: str
    params: dict
    result: dict
    data_sha256: str
    tool_version: str
    elapsed_ms: float
    created_at: str

    @classmethod
    def of(cls, row: dict) -> Evidence:
        return cls(row["run_id"], row["evidence_id"], row["tool"], json.loads(row["params"]), json.loads(row["result"]), row["data_sha256"], row["tool_version"], row["elapsed_ms"], row["created_at"])

    def to_dict(self) -> dict:
        return asdict(self)

    def reproduce_code(self, path: str = "run.csv") -> str:
        """Python that runs the call again."""
        given = "".join(f", {k}={v!r}" for k, v in sorted(self.params.items()))
        return f"from orrery import Session\nsession = Session.open(spark, {path!r})\nprint(session.run({self.tool!r}{given}).result)"


class Session:
    """What is asked is answered for run, the only one or the first by name, unless another is named."""

    def __init__(self, spark: SparkSession, tables: dict, meta: dict | None = None, run: str | None = None, path: str | None = None) -> None:
        self.spark, self.meta = spark, meta or {}
        self.ledger = Ledger(spark, tables, path)
        self.tables = self.ledger.tables
        self.runs = sorted(self.ledger.digests)
        self.run_id = run or (self.runs[0] if self.runs else "")

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> Session:
        """A recorded run with what stands beside its file."""
        tables, meta = runs.load_case(spark, path)
        return cls(spark, tables | {"samples": tables["samples"].cache()}, meta, **options)

    def run(self, tool: str, **params) -> Evidence:
        """Runs an operator over all runs; the entry of this one."""
        return Evidence.of(next(e for e in self.ledger.run(tool, **params) if e["run_id"] == self.run_id))

    def evidence(self, evidence_id: str, run: str | None = None) -> Evidence | None:
        return next((Evidence.of(e) for e in self.ledger.rows if e["run_id"] == (run or self.run_id) and e["evidence_id"] == evidence_id), None)

    def ledger_json(self) -> str:
        return json.dumps([Evidence.of(e).to_dict() for e in self.ledger.rows if e["run_id"] == self.run_id], ensure_ascii=False, indent=2)

    @property
    def samples(self) -> DataFrame:
        return self.tables["samples"].where(F.col("run_id") == self.run_id)

    @property
    def fs(self) -> float:
        return float(self.tables["fs"])

    @property
    def channels(self) -> list[str]:
        return sorted(r.channel for r in self.samples.select("channel").distinct().collect())

    def channel_info(self, name: str) -> dict:
        return next((r.asDict() for r in self.tables["channels"].where(F.col("channel") == name).collect()), {})

    def channels_of_kind(self, kind: str) -> list[str]:
        return sorted(set(self.channels) & {r.channel for r in self.tables["channels"].where(F.col("kind") == kind).collect()})

    def require_channel(self, name: str) -> DataFrame:
        return runs.channel(self.samples, name)

    def time(self) -> tuple[float, float]:
        """The first and the last time of a sample."""
        return tuple(self.samples.agg(F.min("t"), F.max("t")).first())

    def phases(self) -> dict[str, tuple[float, float]]:
        own = cards.phase_windows(self.tables["phases"].where(F.col("run_id") == self.run_id))
        return {r.phase: (r.t_lo, r.t_hi) for r in own.collect()}

    def phase_window(self, name: str) -> tuple[float, float]:
        found = self.phases()
        if name not in found:
            raise KeyError(f"no phase {name}; there are {', '.join(found)}")
        return found[name]

    def window(self, t_start: float | None = None, t_end: float | None = None) -> DataFrame:
        """Samples between the times, which count in; an absent one is open."""
        return cards.windowed(self.samples, t_start=t_start, t_end=t_end)

    def tools(self) -> list[dict]:
        """The operators with their parameters as JSON schemas."""
        return [{"name": o.name, "description": o.description, "parameters": o.schema()} for o in registry.REGISTRY.values()]
