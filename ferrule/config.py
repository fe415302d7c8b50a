"""One validated configuration object; every field is used by the engine."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Settings of the engine; ``from_env`` reads ``FERRULE_<FIELD>`` from the environment or a ``.env`` file."""

    warehouse: str = "warehouse"
    top_k: int = 5
    candidate_factor: int = 10
    neighbor_limit: int = 20
    short_dims: int = 128
    window_chars: int = 3000
    window_stride: int = 2700
    context_chars: int = 32_000
    rrf_k: int = 60
    judge_rate: float = 0.1
    max_file_bytes: int = 1 << 20
    ann_min_rows: int = 256
    bm25_scope: str = "tenant"

    def __post_init__(self) -> None:
        if self.top_k < 1 or self.candidate_factor < 1 or self.window_stride < 1 or self.window_stride > self.window_chars:
            raise ValueError("top_k and candidate_factor start at 1, the stride lies between 1 and the window")
        if not 0 <= self.judge_rate <= 1:
            raise ValueError("judge_rate lies between 0 and 1")
        if self.bm25_scope not in ("tenant", "global"):
            raise ValueError("bm25_scope is tenant or global")

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, dotenv: str | None = None) -> Settings:
        values = {}
        if dotenv and os.path.exists(dotenv):
            with open(dotenv) as f:
                values |= dict(line.strip().split("=", 1) for line in f if "=" in line and not line.lstrip().startswith("#"))
        values |= os.environ if env is None else env
        got = {f.name: type(f.default)(values[f"FERRULE_{f.name.upper()}"]) for f in fields(cls) if f"FERRULE_{f.name.upper()}" in values}
        return cls(**got)


def allowed_origins(value: str) -> list[str]:
    """A comma list of origins, trimmed, without empty ones."""
    return [x.strip() for x in value.split(",") if x.strip()]
