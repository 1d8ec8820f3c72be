"""Settings of a pipeline run, with their checks."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

from ledgerloom.operators.bursts import CADENCES


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Settings:
    """Data-processing settings; every value has a default and is checked."""

    burst_minutes: int = 30
    cadences: dict[str, tuple[float, float]] = field(default_factory=lambda: dict(CADENCES))
    block_most: int = 400  # of blocking.shared_counts; results of the pipeline do not depend on it
    jaccard_least: float = 50.0
    containment_least: float = 80.0
    name_least: float = 90.0
    keep_history: bool = False
    sensitive: bool = False

    def __post_init__(self) -> None:
        if self.burst_minutes < 0:
            raise ConfigError("burst_minutes is negative")
        for name, (lo, hi) in self.cadences.items():
            if lo > hi:
                raise ConfigError(f"cadence {name}: {lo} > {hi}")
        if self.block_most < 2:
            raise ConfigError("block_most is below 2")
        for name in ("jaccard_least", "containment_least", "name_least"):
            if not 0 <= getattr(self, name) <= 100:
                raise ConfigError(f"{name} is no percentage")


def load(path: str | None) -> Settings:
    """Settings of a JSON or YAML file; unknown names are an error."""
    if path is None:
        return Settings()
    text = Path(path).read_text()
    if path.endswith(".json"):
        raw = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise ConfigError("YAML settings need pyyaml") from e
        raw = yaml.safe_load(text) or {}
    known = {f.name for f in fields(Settings)}
    if unknown := set(raw) - known:
        raise ConfigError(f"unknown settings: {sorted(unknown)}")
    if "cadences" in raw:
        raw["cadences"] = {k: tuple(v) for k, v in raw["cadences"].items()}
    return Settings(**raw)


def flat(settings: Settings) -> list[tuple[str, str]]:
    """(dotted name, value) rows of all settings."""
    out: list[tuple[str, str]] = []

    def walk(prefix: str, v: Any) -> None:
        if isinstance(v, dict):
            for k in v:
                walk(f"{prefix}.{k}" if prefix else k, v[k])
        else:
            out.append((prefix, json.dumps(v)))

    walk("", asdict(settings))
    return out
