"""Groups of any size: rounds give what a pass in order gives, and percentiles don't mind outliers."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import cluster as C
from sightline.operators import greedy
from sightline.operators import spatial as P
from sightline.operators import triangulate as G

BOX = "view long, ord long, x1 double, y1 double, x2 double, y2 double, conf double"


def plain_suppressed(rows, cell=64.0):
    """Boxes kept in a pass in order; kept ones are looked up by cells of the plane."""
    kept, near = set(), defaultdict(list)
    for v, o, x1, y1, x2, y2, _ in sorted(rows, key=lambda r: (-r[6], r[1])):
        cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
        if not any(a <= cx <= c and b <= cy <= d for a, b, c, d in near[v, cx // cell, cy // cell]):
            kept.add((v, o))
            for i in range(int(x1 // cell), int(x2 // cell) + 1):
                for j in range(int(y1 // cell), int(y2 // cell) + 1):
                    near[v, i, j].append((x1, y1, x2, y2))
    return kept


@pytest.mark.parametrize("most", [2000, 20, 1])
def test_suppression(spark, most):
    rng = random.Random(3)
    rows = []
    for o in range(300):
        x, y, w, h = rng.randrange(200), rng.randrange(200), rng.choice((0, 1, 7, 30, 90)), rng.choice((0, 3, 40, 64))
        rows.append((o % 4 if o % 5 else 9, o, float(x), float(y), float(x + w), float(y + h), rng.randrange(6) / 6))
    got = C.suppressed(spark.createDataFrame(rows, BOX), ["view"], most)
    assert got.columns == [f.split()[0] for f in BOX.split(", ")]
    assert {(r.view, r.ord) for r in got.collect()} == plain_suppressed(rows)


def test_a_hundred_thousand_boxes_in_a_view(spark, monkeypatch):
    rng = np.random.default_rng(7)
    n = 100_000
    x, y, w, h = rng.integers(0, 8000, n), rng.integers(0, 8000, n), rng.integers(5, 60, n), rng.integers(5, 60, n)
    rows = [(1, k, float(x[k]), float(y[k]), float(x[k] + w[k]), float(y[k] + h[k]), float(c)) for k, c in enumerate(rng.integers(0, 1000, n))]
    taken = []
    rounds = greedy.taken
    monkeypatch.setattr(greedy, "taken", lambda *a: taken.append(1) or rounds(*a))
    got = C.suppressed(spark.createDataFrame(rows, BOX).repartition(8), ["view"]).select("view", "ord").collect()
    want = plain_suppressed(rows)
    assert taken and {tuple(r) for r in got} == want and 0.3 * n < len(want) < 0.95 * n


@pytest.mark.parametrize("most", [2000, 1])
def test_leaders(spark, most):
    rng = random.Random(5)
    rows = [(s, k, rng.uniform(-180, 180) if k % 3 else rng.choice((-179.5, 179.5, 0.0)), rng.uniform(-85, 85) if k % 4 else rng.choice((88.0, -89.0)), rng.choice((1.0, 9.0, 30.0)), rng.randrange(5) / 5) for s in range(3) for k in range(70)]
    want = {}
    vec = lambda yaw, pitch: np.array([np.sin(np.radians(yaw)) * np.cos(np.radians(pitch)), np.cos(np.radians(yaw)) * np.cos(np.radians(pitch)), np.sin(np.radians(pitch))])
    for s in range(3):
        leads = []
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: (-r[5], r[1])):
            near = [n for n, m in enumerate(leads) if np.degrees(np.arccos(np.clip(vec(m[2], m[3]) @ vec(r[2], r[3]), -1, 1))) <= 0.5 * max(m[4], r[4])]
            if not near:
                near = [len(leads)]
                leads.append(r)
            want[s, r[1]] = (near[0], leads[near[0]][1])
    df = spark.createDataFrame(rows, "scan long, ord long, yaw double, pitch double, size double, conf double")
    got = C.led_clusters(df, "scan", most=most)
    assert {(r.scan, r.ord): (r.cluster, r.leader) for r in got.collect()} == want and len(set(want.values())) < len(want)


@pytest.mark.parametrize("first_free", [False, True])
def test_matching_in_rounds(spark, first_free):
    rng = random.Random(8)
    pairs = [(s, a, b, float(rng.randrange(9))) for s in range(3) for a in range(25) for b in range(25) if rng.random() < 0.4]
    want, used = set(), set()
    for s, a, b, d in sorted(pairs, key=lambda p: (p[1], p[2]) if first_free else (p[3], p[1], p[2])):
        if (s, "a", a) not in used and (s, "b", b) not in used:
            used |= {(s, "a", a), (s, "b", b)}
            want.add((s, a, b, d))
    df = spark.createDataFrame(pairs + pairs[:5], "site long, a long, b long, dist double")
    for most in (10, 200):
        got = G.greedy_match(df, first_free, most).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_constrained_by_components(spark):
    rng = random.Random(13)
    rows = [(s, s * 1000 + k, rng.randrange(3), rng.randrange(5), rng.uniform(-20, 20), rng.uniform(-5, 5), *(rng.uniform(0, 1.2) if k % 7 else None for _ in range(3))) for s in range(2) for k in range(45)]
    df = spark.createDataFrame([(a, b, c, 10 * c + d, *rest) for a, b, c, d, *rest in rows], "site long, id long, scan long, image long, yaw double, pitch double, x double, y double, z double")
    whole = sorted(map(tuple, C.constrained(df, "site").collect()))
    assert sorted(map(tuple, C.constrained(df, "site", most=1).collect())) == whole and any(r[3] for r in whole)
    assert len({r[2] for r in whole}) > 5


def test_percentiles_of_skewed_values(spark, monkeypatch):
    """One value of 10^12 beside many that are near each other; no bracket, and so no task, holds more than a few of them."""
    monkeypatch.setattr(P, "FEW", 500)
    monkeypatch.setattr(P, "ACCURACY", 1000)
    rng = np.random.default_rng(2)
    v = {"a": np.append(rng.normal(1e6, 1e-3, 40_000), 1e12), "b": np.append(np.repeat(3.0, 9000), rng.random(1000)), "c": rng.random(37), "d": np.array([5.0]), "e": -np.exp(rng.normal(0, 30, 5000))}
    df = spark.createDataFrame([(k, float(x)) for k, xs in v.items() for x in xs] + [("f", None)], "k string, v double").repartition(6)
    at = (0.0, 0.001, 0.25, 0.5, 0.995, 0.999, 1.0)
    out = P.percentiles(df, "k", "v", at)
    got = {r[0]: r[1:] for r in out.collect()}
    assert set(got) == set("abcde")
    for k, xs in v.items():
        assert np.allclose(got[k], np.percentile(xs, [100 * q for q in at]), rtol=1e-12, atol=1e-12), k
    inside = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in inside
    # what is put in order of the skewed key: a small share of its values for each percentile
    brackets = spark.createDataFrame([(float(x),) for x in v["a"]], "v double").agg(F.percentile_approx("v", [0.5 - 3 / 1000, 0.5 + 3 / 1000], 1000)).first()[0]
    assert ((v["a"] >= brackets[0]) & (v["a"] <= brackets[1])).sum() <= 8 * len(v["a"]) / 1000 + 2


@pytest.mark.parametrize("kind", ["long", "string", "struct<site:long,id:string>"])
def test_components_in_a_task_as_in_rounds(spark, kind):
    rng = random.Random(4)
    pairs = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(7, 7), (900, 899), (899, 900)]
    node = {"long": lambda c: F.col(c), "string": lambda c: F.col(c).cast("string")}.get(kind, lambda c: F.struct((F.col(c) % 3 * 0).alias("site"), F.col(c).cast("string").alias("id")))
    e = spark.createDataFrame(pairs, "a long, b long").select(node("a").alias("a"), node("b").alias("b"))
    one, many = (sorted(map(tuple, C.components(e, few=few).collect())) for few in (1000, 0))
    assert one == many and len(one) > 200 and C.components(e.limit(0)).count() == 0
    assert C.components(e).dtypes == C.components(e, few=0).dtypes
