"""Settings of an agent: from a file of NAME=value lines, the environment, and what is given, the last winning."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, fields

PREFIX = "ORRERY_"


def parse(text: str) -> dict[str, str]:
    """NAME=value lines; comments, blank lines and `export` are passed over, quotes around a value go."""
    out = {}
    for line in text.splitlines():
        line = line.strip().removeprefix("export ").strip()
        if not line or line.startswith("#") or "=" not in line:
            continue
        name, value = (x.strip() for x in line.split("=", 1))
        quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
        out[name] = value[1:-1] if quoted else value.split(" #")[0].rstrip()
    return out


@dataclass(frozen=True)
class AgentConfig:
    kind: str = "rule"
    lang: str = "en"
    model: str = ""
    max_steps: int = 24
    fix_rounds: int = 1
    prefetch: bool = True
    cite_numbers: bool = True

    @classmethod
    def load(cls, path: str | None = None, env: dict[str, str] | None = None, **given) -> AgentConfig:
        known: dict[str, str] = {}
        if path is not None and os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                known |= parse(f.read())
        known |= dict(os.environ if env is None else env)
        out = {}
        for f in fields(cls):
            kind = type(f.default)
            if (text := known.get(PREFIX + f.name.upper())) is not None:
                out[f.name] = text.lower() in ("1", "true", "yes", "on") if kind is bool else kind(text)
        if unknown := set(given) - {f.name for f in fields(cls)}:
            raise ValueError(f"no setting {', '.join(sorted(unknown))}")
        return cls(**out | {k: v for k, v in given.items() if v is not None})

    def shown(self) -> dict:
        return asdict(self)
