"""Who analyses: the rule playbook, or a backend that chooses tools step by step and submits findings, which are verified and may be mended once."""

from __future__ import annotations

import json
import time

from . import planner
from .ledger import Ledger
from .operators import verify
from .session import Session

FIELDS = {"title": str, "statement": str, "category": str, "severity": str, "channel": (str, type(None)), "t_start": (int, float, type(None)), "t_end": (int, float, type(None)), "evidence": list}
OPTIONAL = {"channel", "t_start", "t_end"}


def verified(session: Session, findings: list[dict]) -> list[dict]:
    """The findings with their verification, against the session's ledger."""
    rows = [{"run_id": session.run_id, "finding_id": i, **{k: f.get(k) for k in FIELDS}} for i, f in enumerate(findings)]
    rows = [r | {k: None if r[k] is None else float(r[k]) for k in ("t_start", "t_end")} for r in rows]
    if not rows:
        return []
    found = session.spark.createDataFrame(rows, planner.FINDING)
    checks = verify.verify_findings(found, session.ledger.evidence(), session.samples.select("run_id", "channel").distinct()).collect()
    by = {r.finding_id: r.asDict(recursive=True) for r in checks}
    return [f | {"verification": by[i]} for i, f in enumerate(findings)]


class RuleAgent:
    name = "rule"

    def __init__(self, lang: str = "en") -> None:
        self.lang = lang

    def run(self, session: Session) -> dict:
        began = time.perf_counter()
        book, found = planner.analyse(session.spark, session.tables, self.lang)
        session.ledger.rows[:] = book.rows
        return planner.report(book, found) | {"agent": {"type": "rule", "lang": self.lang}, "elapsed_s": time.perf_counter() - began}


class ScriptedBackend:
    """Answers in a given order: each is a tool call {"tool", "params"}, a report {"submit": {"findings": [...]}}, or text that is neither."""

    def __init__(self, answers: list) -> None:
        self.answers, self.seen = list(answers), []

    def next(self, messages: list[dict], tools: list[dict]) -> tuple[str, dict]:
        """The next answer as text, and the tokens that it took."""
        self.seen.append(messages[-1])
        answer = self.answers.pop(0) if self.answers else {"submit": {"findings": []}}
        return answer if isinstance(answer, str) else json.dumps(answer), {"input_tokens": sum(len(str(m)) for m in messages) // 4, "output_tokens": len(str(answer)) // 4, "requests": 1}


class LLMAgent:
    """A backend in a loop: what it asks is run, what fails is told, and what it submits is verified; unverified findings may be mended fix_rounds times."""

    def __init__(self, backend, lang: str = "en", max_steps: int = 24, fix_rounds: int = 1, prefetch: bool = True, max_seconds: float | None = None, cite_numbers: bool = True) -> None:
        self.backend, self.lang, self.max_steps, self.fix_rounds, self.prefetch, self.max_seconds, self.cite_numbers = backend, lang, max_steps, fix_rounds, prefetch, max_seconds, cite_numbers

    def run(self, session: Session) -> dict:
        began, usage = time.perf_counter(), dict.fromkeys(("input_tokens", "output_tokens", "requests"), 0)
        task = "Find what is wrong with this run. Call tools by {tool, params}; end with {submit: {findings}}. Every number must stand in the cited evidence."
        messages = [{"role": "system", "content": task + (" Put its path in brackets behind each number." if self.cite_numbers else "")}]
        told = lambda content: messages.append({"role": "user", "content": json.dumps(content, ensure_ascii=False, default=str)})
        for tool in ("describe_data", "segment_phases") if self.prefetch else ():
            self.call(session, tool, {}, told)
        findings, submitted, rounds, first = [], False, 0, None
        for _ in range(self.max_steps):
            if self.max_seconds is not None and time.perf_counter() - began > self.max_seconds:
                break
            text, used = self.backend.next(messages, session.tools())
            messages.append({"role": "assistant", "content": text})
            for k in usage:
                usage[k] += used.get(k, 0)
            try:
                answer = json.loads(text)
            except ValueError as e:
                told({"error": f"no JSON: {e}"})
                continue
            if "submit" not in answer:
                self.call(session, answer.get("tool", ""), answer.get("params") or {}, told)
                continue
            wrong = self.faults(answer["submit"])
            if wrong:
                told({"error": wrong})
                continue
            findings, submitted = verified(session, answer["submit"]["findings"]), True
            first = first if first is not None else findings
            bad = [{"title": f["title"], "problems": f["verification"]["problems"], "messages": f["verification"]["messages"]} for f in findings if f["verification"]["status"] != "verified"]
            if not bad or rounds == self.fix_rounds:
                break
            rounds += 1
            told({"verifier": bad})
        numbers = lambda fs: {k: sum(f["verification"][k] for f in fs) for k in ("n_numbers", "n_grounded", "n_verified", "n_tagged")}
        about = {"type": "llm", "lang": self.lang, "submitted": submitted, "fix_rounds_used": rounds, "usage": usage, "first_submission": numbers(first or [])}
        return {"findings": findings, "evidence": session.ledger.rows, "n_verified": sum(f["verification"]["status"] == "verified" for f in findings), "verification": numbers(findings), "agent": about, "elapsed_s": time.perf_counter() - began}

    def call(self, session: Session, tool: str, params: dict, told) -> None:
        try:
            e = session.run(tool, **params)
            told({"evidence_id": e.id, "tool": tool, "result": e.result})
        except Exception as e:  # what a tool refuses is an answer
            told({"tool": tool, "error": f"{type(e).__name__}: {e}"[:500]})

    def faults(self, report: object) -> str | None:
        rows = report.get("findings") if isinstance(report, dict) else None
        if not isinstance(rows, list):
            return "findings must be a list"
        for i, f in enumerate(rows):
            for k, t in FIELDS.items():
                if not isinstance(f, dict) or (k not in f and k not in OPTIONAL) or (k in f and not isinstance(f[k], t)):
                    return f"finding {i}: {k} is missing or of the wrong type"
        return None


def make_agent(kind: str = "rule", lang: str = "en", backend=None, **options):
    if kind == "rule":
        return RuleAgent(lang)
    if backend is None:
        raise ValueError("an agent of this kind needs a backend")
    return LLMAgent(backend, lang, **options)


__all__ = ["LLMAgent", "Ledger", "RuleAgent", "ScriptedBackend", "make_agent", "verified"]
