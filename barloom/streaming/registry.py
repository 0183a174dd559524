"""Setups over sessions: a state machine by ticker, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

REGISTRY = "ticker long, peak_idx long, first_day long, last_day long, seen long, run long, status string"


def step(states: list[dict], day: int, peak: int, drift: int, rest: int) -> list[dict]:
    """One sighting: it belongs to the setup whose peak lies within `drift` of it, nearest first; else it opens one.
    Setups unseen for `rest` days are cooled, for three times that retired."""
    near = sorted((abs(s["peak_idx"] - peak), s["peak_idx"], i) for i, s in enumerate(states) if s["status"] != "retired" and abs(s["peak_idx"] - peak) <= drift)
    if near:
        s = states[near[0][2]]
        s["run"] = s["run"] + 1 if day - s["last_day"] <= rest else 1
        s.update(last_day=day, seen=s["seen"] + 1, status="active")
    else:
        states.append({"peak_idx": peak, "first_day": day, "last_day": day, "seen": 1, "run": 1, "status": "active"})
    for s in states:
        idle = day - s["last_day"]
        s["status"] = "retired" if idle > 3 * rest or s["status"] == "retired" else "cooled" if idle > rest else s["status"]
    return states


def fold_setups(seen: DataFrame, drift: int = 3, rest: int = 20) -> DataFrame:
    """The registry after all sightings (ticker, day, peak_idx), in order of day and peak."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["day", "peak_idx"], kind="stable")
        states: list[dict] = []
        for day, peak in zip(g["day"].tolist(), g["peak_idx"].tolist(), strict=True):
            states = step(states, day, peak, drift, rest)
        out = pd.DataFrame(states)
        out.insert(0, "ticker", g["ticker"].iloc[0])
        return out[[c.split()[0] for c in REGISTRY.split(", ")]]

    return seen.groupBy("ticker").applyInPandas(run, REGISTRY)


def stream_setups(seen: DataFrame, drift: int = 3, rest: int = 20) -> DataFrame:
    """The same over a stream: each batch's sightings move the ticker's state and give its current setups."""
    state_schema = "peaks array<long>, firsts array<long>, lasts array<long>, seen array<long>, runs array<long>, statuses array<string>"
    names = ["peak_idx", "first_day", "last_day", "seen", "run", "status"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = [dict(zip(names, row, strict=True)) for row in zip(*state.get, strict=True)] if state.exists else []
        rows = sorted((int(d), int(p)) for b in batches for d, p in zip(b["day"], b["peak_idx"], strict=True))
        for day, peak in rows:
            held = step(held, day, peak, drift, rest)
        state.update(tuple([s[n] for s in held] for n in names))
        out = pd.DataFrame(held)
        out.insert(0, "ticker", key[0])
        yield out

    return seen.groupBy("ticker").applyInPandasWithState(run, REGISTRY, state_schema, "update", "NoTimeout")
