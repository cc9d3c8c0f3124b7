"""Settings, passed to operators explicitly so that tasks see the same values."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

#: Fixed value: the measured gases, in the order of the feature columns.
GASES = ("CO", "NO", "NO2", "O3", "SO2", "H2S")

#: Allowed ranges of settings (inclusive).
_RANGES = {
    "catchup_hours": (1, 168),
    "lookback_hours": (24, None),
    "iterations": (20, None),
    "depth": (2, 12),
    "learning_rate": (1e-9, 1),
    "test_fraction": (0.05, 0.5),
    "min_train_rows": (48, None),
    "feed_timeout_seconds": (5, 120),
    "cell_meters": (25, 1000),
    "influence_meters": (500, 50000),
    "min_confidence": (0, 1),
    "retention_hours": (1, 24 * 366),
    "min_diffusivity": (1e-9, 500),
    "max_diffusivity": (1e-9, 1000),
    "confidence_retention": (1e-9, 1),
    "min_concentration": (0, None),
}


@dataclass(frozen=True)
class Settings:
    """All tunables of the hourly job."""

    timezone: str = "Europe/Moscow"
    gases: tuple[str, ...] = GASES
    catchup_hours: int = 24
    lookback_hours: int = 72
    iterations: int = 300
    depth: int = 6
    learning_rate: float = 0.05
    seed: int = 42
    test_fraction: float = 0.2
    min_train_rows: int = 240
    feed_url: str = ""
    feed_timeout_seconds: int = 30
    cell_meters: int = 500
    influence_meters: int = 10_000
    min_confidence: float = 0.02
    retention_hours: int = 24
    min_diffusivity: float = 4.0
    max_diffusivity: float = 40.0
    confidence_retention: float = 0.65
    min_concentration: float = 1e-6

    def __post_init__(self) -> None:
        for name, (low, high) in _RANGES.items():
            value = getattr(self, name)
            if value < low or (high is not None and value > high):
                raise ValueError(f"{name} is {value}; it must lie between {low} and {high}")

    @classmethod
    def from_environment(cls, prefix: str = "ZEPHYR_") -> Settings:
        """Settings with overrides such as ZEPHYR_CELL_METERS."""
        given = {}
        for f in fields(cls):
            text = os.environ.get(prefix + f.name.upper())
            if text is not None:
                kind = type(f.default)
                given[f.name] = tuple(text.split(",")) if kind is tuple else kind(text)
        return cls(**given)


DEFAULTS = Settings()
