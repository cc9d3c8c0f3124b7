"""Queries by name and their DuckDB SQL."""

from __future__ import annotations

from zephyrframe.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
