"""Upkeep while nobody works: when it is due, and its steps in order."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def due(sessions: DataFrame, now: Column, last_run: Column | None = None, idle: int = 180, gap: int = 1800) -> DataFrame:
    """One row: open sessions, seconds since the last activity, and whether upkeep is due: no session is open, nothing has
    happened for ``idle`` seconds and the last run is ``gap`` seconds ago. sessions: last_activity, ended_at (null: open).
    Without sessions, or without a run before, that gate is open."""
    since = lambda t: F.unix_timestamp(now) - F.unix_timestamp(t)
    got = sessions.agg(F.count(F.when(F.col("ended_at").isNull(), 1)).alias("open"), F.max("last_activity").alias("_last"))
    rested = F.coalesce(since(F.col("_last")) >= idle, F.lit(True))
    apart = F.lit(True) if last_run is None else F.coalesce(since(last_run) >= gap, F.lit(True))
    return got.select("open", since(F.col("_last")).alias("idle_seconds"), ((F.col("open") == 0) & rested & apart).alias("due"))


def run_once(steps: list[tuple[str, Callable, bool]]) -> dict:
    """Runs (name, step, must) in order and returns name -> result or the error it ended with. A failed step that must not
    fail ends the run; others do not keep the rest from running. A scheduler calls this where ``due`` says so."""
    out: dict = {}
    for name, step, must in steps:
        try:
            out[name] = step()
        except Exception as e:  # noqa: BLE001 - reported to the caller, by name
            log.exception("upkeep: %s failed", name)
            out[name] = e
            if must:
                break
    return out
