"""Configuration: which rules run, and typed access to their settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Any

#: Files that are looked for in the working folder, in this order.
DISCOVERED = ("siftline.yml", ".siftline.yml")


@dataclass(frozen=True)
class Settings:
    """Settings of one rule. A value of the wrong type gives the default; members of the wrong type are left out."""

    values: dict[str, Any] = field(default_factory=dict)

    def integer(self, name: str, default: int) -> int:
        v = self.values.get(name)
        return int(v) if isinstance(v, int | float) and not isinstance(v, bool) else default

    def number(self, name: str, default: float) -> float:
        v = self.values.get(name)
        return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else default

    def text(self, name: str, default: str) -> str:
        v = self.values.get(name)
        return v if isinstance(v, str) else default

    def texts(self, name: str) -> list[str]:
        v = self.values.get(name)
        return [x for x in v if isinstance(x, str)] if isinstance(v, list) else []

    def text_map(self, name: str) -> dict[str, str]:
        v = self.values.get(name)
        return {k: x for k, x in v.items() if isinstance(k, str) and isinstance(x, str)} if isinstance(v, dict) else {}


@dataclass(frozen=True)
class Config:
    rules: dict[str, dict[str, Any]] = field(default_factory=dict)
    enable: tuple[str, ...] = ()
    disable: tuple[str, ...] = ()

    def enabled(self, rule_id: str) -> bool:
        """Disabling wins; without an enable list every rule is on."""
        return rule_id not in self.disable and (not self.enable or rule_id in self.enable)

    def settings(self, rule_id: str) -> Settings:
        return Settings(self.rules.get(rule_id) or {})


def load(path: str | None = None) -> Config:
    """The configuration at path, or the one that is found in the working folder, or the default."""
    found = path or next((p for p in DISCOVERED if os.path.exists(p)), None)
    if found is None:
        return Config()
    import yaml

    with open(found, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    return Config(data.get("rules") or {}, tuple(data.get("enable") or ()), tuple(data.get("disable") or ()))
