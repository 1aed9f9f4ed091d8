"""Settings of an engine: defaults, a file's values over them, and names of models by their use."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

DEFAULTS: dict[str, Any] = {
    "token_budgets": {"dynamic_context": 30_000, "compressed_history": 20_000, "recent_tail": 80_000},
    "models": {"decompose": "", "cull": "", "compress": "", "synthesis": "", "embed": ""},
    "static_sources": [],
}


def merged(own: Mapping[str, Any] | None, defaults: Mapping[str, Any] = DEFAULTS) -> dict[str, Any]:
    """The own values over the defaults; token budgets are merged by name, all others replaced."""
    out = {**defaults, **(own or {})}
    out["token_budgets"] = {**defaults.get("token_budgets", {}), **((own or {}).get("token_budgets") or {})}
    return out


def model_name(use: str, config: Mapping[str, Any], default: str = "", environment: Mapping[str, str] | None = None) -> str:
    """The environment's LOOMSTONE_<USE>_MODEL, else the configured name, else the default."""
    environment = os.environ if environment is None else environment
    return environment.get(f"LOOMSTONE_{use.upper()}_MODEL") or (config.get("models") or {}).get(use) or default


@dataclass(frozen=True)
class Config:
    values: dict[str, Any] = field(default_factory=lambda: merged(None))

    def budget(self, name: str) -> int:
        return self.values["token_budgets"][name]
