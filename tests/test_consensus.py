"""Clusters of rays against plain loops, and their cost on a large site."""

import time
import tracemalloc
from functools import reduce

import numpy as np
import pandas as pd
import pytest

from sightline.operators import triangulate as G


def site(n, seed):
    """Rays of eight scans at fewer things than rays, with noise."""
    rng = np.random.default_rng(seed)
    scans, things = rng.uniform(0, 6, (8, 3)), rng.uniform(0, 6, (max(2, n // 5), 3))
    k = rng.integers(0, 8, n)
    v = things[rng.integers(0, len(things), n)] - scans[k]
    v = v / np.linalg.norm(v, axis=1, keepdims=True) + rng.normal(0, 0.004, v.shape)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    at = dict(zip(("ox", "oy", "oz", "dx", "dy", "dz"), [*scans[k].T, *v.T], strict=True))
    return pd.DataFrame({"site": 1, "ord": rng.permutation(n), "id": np.arange(n), "scan": k, **at, "conf": np.round(rng.uniform(0.3, 1, n), 2)})


def by_loops(pdf, gap, angle):
    """Groups of two scans and more, in the order they are chosen: sums in the order of rays, the first of equal scores."""
    rows = pdf.sort_values("ord").to_dict("records")
    o, d = ([np.array([r[f"{q}{c}"] for c in "xyz"]) for r in rows] for q in "od")
    points = []
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            b = d[i] @ d[j]
            if rows[i]["scan"] == rows[j]["scan"] or 1 - b * b < 1e-9 or np.degrees(np.arccos(min(abs(b), 1))) < angle:
                continue
            w = o[i] - o[j]
            t, s = (b * (d[j] @ w) - d[i] @ w) / (1 - b * b), (d[j] @ w - b * (d[i] @ w)) / (1 - b * b)
            p, q = o[i] + t * d[i], o[j] + s * d[j]
            if np.linalg.norm(p - q) <= gap and G.NEAR <= t <= G.FAR and G.NEAR <= s <= G.FAR:
                points.append((p + q) / 2)
    sees = lambda p, k: G.NEAR <= np.linalg.norm(p - o[k]) <= G.FAR and np.degrees(np.arccos(np.clip((p - o[k]) @ d[k] / np.linalg.norm(p - o[k]), -1, 1))) <= G.SUPPORT
    lists = [[k for k in range(len(rows)) if sees(p, k)] for p in points]
    free, groups = set(range(len(rows))), []
    while True:
        best, top = None, None
        for p, seen in enumerate(lists):
            mine = [k for k in seen if k in free]
            if len({rows[k]["scan"] for k in mine}) >= 2:
                score = 10 * len(mine) + reduce(float.__add__, (rows[k]["conf"] for k in mine), 0.0)  # `sum` would correct for rounding
                if top is None or score > top:
                    best, top = p, score
        if best is None:
            return groups
        mine = [k for k in lists[best] if k in free]
        place = G._point(np.array([o[k] for k in mine]), np.array([d[k] for k in mine]))
        again = [k for k in sorted(free) if sees(points[best] if place is None else place, k)]
        mine = again if len({rows[k]["scan"] for k in again}) >= 2 else mine
        free -= set(mine)
        groups.append({rows[k]["id"] for k in mine})


@pytest.mark.parametrize("at_once", [40, 500_000])
@pytest.mark.parametrize("n,seed", [(0, 0), (1, 1), (2, 2), (12, 3), (40, 4), (70, 5), (70, 6), (150, 34)])
def test_consensus_against_loops(monkeypatch, n, seed, at_once):
    monkeypatch.setattr(G, "AT_ONCE", at_once)
    rays = site(n, seed)
    got = G.consensus(rays, 0.3, 5.0)
    groups = [set(g["id"]) for _, g in got[got["multi"]].groupby("cluster")]
    assert groups == by_loops(rays, 0.3, 5.0) and sorted(got["id"]) == list(range(n))


def test_a_large_site_takes_little_memory():
    rays = site(2000, 1)
    tracemalloc.start()
    t = time.time()
    got = G.consensus(rays)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["multi"].sum() > 1500 and peak < 200 << 20 and time.time() - t < 60
