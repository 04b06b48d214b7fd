"""Registered queries of the time-series engine, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from .plans import bars, decisions, diagnostics, formulas, live, outcomes, registry, replays, research, sessions, streams, studies  # noqa: F401


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    return dict(registry.ORACLES)
