"""Peaks and clusters by their definitions, on drawn paths (F1): the faster readings give the same places and levels."""

import numpy as np
import pytest

from barloom.operators import levels


def plain_peaks(v, prominence, distance, wlen=252):
    found, i = [], 1
    while i < len(v) - 1:
        j = i
        while j + 1 < len(v) and v[j + 1] == v[i]:
            j += 1
        if v[i - 1] < v[i] and j + 1 < len(v) and v[j + 1] < v[i]:
            found.append((i + j) // 2)
        i = j + 1
    found, kept = np.array(found, int), []
    for k in np.argsort(v[found], kind="stable")[::-1]:
        if all(abs(found[k] - x) >= distance for x in kept):
            kept.append(int(found[k]))
    out = []
    for p in sorted(kept):
        lo, hi = max(0, p - wlen // 2), min(len(v) - 1, p + wlen // 2)
        left = next((j + 1 for j in range(p - 1, lo - 1, -1) if v[j] > v[p]), lo)
        right = next((j - 1 for j in range(p + 1, hi + 1) if v[j] > v[p]), hi)
        if v[p] - max(min(v[left : p + 1]), min(v[p : right + 1])) >= prominence:
            out.append(p)
    return out


def plain_clusters(prices, weights, tolerance=0.025):
    at, w, out, free = np.log(prices), weights, [], np.ones(len(prices), bool)
    while free.any():
        near = (np.abs(at[:, None] - at[None, :]) <= tolerance) & free[None, :] & free[:, None]
        mass = np.where(free, (near * w[None, :]).sum(axis=1), -1)
        mine = near[int(np.argmax(mass))]
        out.append((float(np.exp(np.average(at[mine], weights=w[mine]))), int(mine.sum())))
        free &= ~mine
    return out


@pytest.mark.parametrize("seed", range(12))
def test_same_as_by_definition(seed):
    draw = np.random.default_rng(seed)
    v = np.round(draw.normal(0, 0.1, 400).cumsum() if seed % 2 else draw.normal(0, 0.2, 400), 1 + seed % 3)
    for prominence, distance, wlen in ((0.0, 1, 252), (0.2, 5, 252), (0.4, 10, 20)):
        assert levels.peaks(v, prominence, distance, wlen).tolist() == plain_peaks(v, prominence, distance, wlen)
    prices, weights = np.exp(v[:150]), np.where(draw.random(150) < 0.5, 1.0, 0.7)
    assert levels.clusters(prices, weights) == plain_clusters(prices, weights)


def test_few_array_calls_a_peak(monkeypatch):
    """Before, each peak and cluster compared all others anew: 4 array searches a peak and one a cluster."""
    calls, real = [], np.flatnonzero
    monkeypatch.setattr(np, "flatnonzero", lambda x: calls.append(1) or real(x))
    levels.peaks(np.random.default_rng(1).normal(0, 1, 600), 0.1, 5)
    assert len(calls) < 10
