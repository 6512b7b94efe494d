"""Five tools over lines of JSON-RPC, as a model context server speaks them on its standard streams."""

from __future__ import annotations

import json
from typing import TextIO

from pyspark.sql import SparkSession

from . import agents, planner, registry
from .session import Session

TOOLS = {
    "open_run": ("Opens a recorded run.", {"path": "string"}, ["path"]),
    "list_analysis_tools": ("The operators and their parameters.", {}, []),
    "run_analysis": ("Runs an operator; run_id may be left out where one run is open.", {"tool": "string", "params": "object", "run_id": "string"}, ["tool"]),
    "verify": ("Verifies findings against the run's evidence.", {"findings": "array", "run_id": "string"}, ["findings"]),
    "write_html_report": ("Writes findings and evidence as a page.", {"path": "string", "findings": "array", "run_id": "string"}, ["path", "findings"]),
}


class Tools:
    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.sessions = spark, {}

    def session(self, run_id: str | None = None) -> Session:
        if run_id is None and len(self.sessions) == 1:
            return next(iter(self.sessions.values()))
        if run_id not in self.sessions:
            raise KeyError(f"no open run {run_id}; there are {', '.join(sorted(self.sessions)) or 'none'}")
        return self.sessions[run_id]

    def open_run(self, path: str) -> dict:
        s = Session.open(self.spark, path)
        self.sessions[s.run_id] = s
        return {"run_id": s.run_id, "channels": s.channels, "fs": s.fs}

    def list_analysis_tools(self) -> list[dict]:
        return [{"name": o.name, "description": o.description, "parameters": o.schema()} for o in registry.REGISTRY.values()]

    def run_analysis(self, tool: str, params: dict | None = None, run_id: str | None = None) -> dict:
        e = self.session(run_id).run(tool, **(params or {}))
        return {"evidence_id": e.id, "result": e.result}

    def verify(self, findings: list[dict], run_id: str | None = None) -> list[dict]:
        return agents.verified(self.session(run_id), findings)

    def write_html_report(self, path: str, findings: list[dict], run_id: str | None = None) -> dict:
        s = self.session(run_id)
        page = planner.write_html({"findings": [{"severity": "info", **f} for f in agents.verified(s, findings)], "evidence": s.ledger.rows})
        self.spark.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return {"path": path}


def answer(tools: Tools, request: dict) -> dict | None:
    """The reply to one request; none to a notification."""
    reply = {"jsonrpc": "2.0", "id": request.get("id")}
    method, params = request.get("method"), request.get("params") or {}
    if "id" not in request:
        return None
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "orrery", "version": registry.__version__}}}
    if method == "tools/list":
        listed = [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in p.items()}, "required": r}} for n, (d, p, r) in TOOLS.items()]
        return reply | {"result": {"tools": listed}}
    if method == "tools/call":
        name = params.get("name")
        if name not in TOOLS:
            return reply | {"error": {"code": -32602, "message": f"no tool {name}"}}
        try:
            said, wrong = json.dumps(getattr(tools, name)(**(params.get("arguments") or {})), ensure_ascii=False, default=str), False
        except Exception as e:  # what a tool refuses is told, the server goes on
            said, wrong = f"{type(e).__name__}: {e}", True
        return reply | {"result": {"content": [{"type": "text", "text": said}], "isError": wrong}}
    return reply | {"error": {"code": -32601, "message": f"no method {method}"}}


def serve(tools: Tools, lines: TextIO, out: TextIO) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            reply = answer(tools, json.loads(line))
        except ValueError as e:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if reply is not None:
            print(json.dumps(reply, ensure_ascii=False), file=out, flush=True)
