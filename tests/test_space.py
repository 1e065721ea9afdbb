"""Clouds, grids, layout, sources, sinks and streams."""

import collections
import datetime
import itertools
import json
import os
import random
import tempfile

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sightline.operators import cluster as C
from sightline.operators import layout as Y
from sightline.operators import maintenance as M
from sightline.operators import spatial as P
from sightline.plans import registry, space
from sightline.sources import readers, sinks
from sightline.streaming import log as streamed


def test_voxels_keep_the_first_point(spark):
    rows = [(k, random.Random(k).uniform(-1, 1), random.Random(k + 99).uniform(-1, 1), 0.0) for k in range(200)]
    df = spark.createDataFrame(rows, "ord long, x double, y double, z double")
    want = {}
    for k, x, y, _ in rows:
        want.setdefault((int(np.floor(x / 0.3)), int(np.floor(y / 0.3))), k)
    got = {(r.ix, r.iy): r.ord for r in P.voxel_first(df.orderBy(F.rand(3)), 0.3, []).collect()}
    assert got == want


def test_near_join_has_no_nested_loop(spark):
    a = spark.createDataFrame([(k, k * 0.7, 0.0) for k in range(50)], "id long, x double, y double")
    b = spark.createDataFrame([(3.0, 0.0), (-5.0, 1.0)], "rx double, ry double")
    out = P.near_semi(a, b, 1.0)
    assert {r.id for r in out.collect()} == {k for k in range(50) if abs(k * 0.7 - 3.0) <= 1}
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def flood(cells, steps):
    left, out = set(cells), []
    while left:
        todo, comp = [left.pop()], []
        while todo:
            c = todo.pop()
            comp.append(c)
            for i, j in steps:
                n = (c[0] + i, c[1] + j)
                if n in left:
                    left.remove(n)
                    todo.append(n)
        out.append(comp)
    return out


@pytest.fixture(scope="module")
def grid(spark):
    rng = random.Random(2)
    cells = {(x, y) for x in range(14) for y in range(11) if rng.random() < 0.6}
    return cells, spark.createDataFrame([(0, x, y) for x, y in cells], "room long, ix long, iy long")


FOUR = [(1, 0), (-1, 0), (0, 1), (0, -1)]


def test_components_and_holes_of_a_grid(grid):
    cells, df = grid
    r = C.components(P.grid_edges(df, "room", eight=False))
    sizes = sorted(v["count"] for v in r.groupBy("root").count().collect())
    assert sizes == sorted(len(c) for c in flood(cells, FOUR) if len(c) > 1)
    empty = {(x, y) for x in range(-1, 15) for y in range(-1, 12)} - cells
    holes = {c for comp in flood(empty, FOUR) if (-1, -1) not in comp for c in comp}
    assert {(v.ix, v.iy) for v in P.filled(df, "room", C.components).collect()} == cells | holes


def test_holes_of_far_cells(spark):
    """A frame, a ring in its hole, an open bay, and one cell a million rows away: only holes are filled."""
    frame = {(x, y) for x in range(12) for y in range(9)} - {(x, y) for x in range(1, 11) for y in range(1, 8)}
    ring = {(x, y) for x in range(4, 8) for y in range(3, 6)} - {(5, 4), (6, 4)}
    bay = {(20, y) for y in range(6)} | {(25, y) for y in range(6)} | {(x, 0) for x in range(20, 26)}
    cells = frame | ring | bay | {(3, 1_000_000), (-1_000_000, 4)}
    df = spark.createDataFrame([(0, *c) for c in cells], "room long, ix long, iy long")
    got = {(r.ix, r.iy) for r in P.filled(df, "room", C.components).collect()}
    assert got == cells | {(x, y) for x in range(12) for y in range(9)}


def test_morphology(grid):
    cells, df = grid
    sq = list(P.SQUARE)
    dil = {(x + i, y + j) for x, y in cells for i, j in sq}
    assert {(r.ix, r.iy) for r in P.dilate(df, "room").collect()} == dil
    assert {(r.ix, r.iy) for r in P.closed(df, "room").collect()} == {c for c in dil if all((c[0] + i, c[1] + j) in dil for i, j in sq)}
    ero = {c for c in cells if all((c[0] + i, c[1] + j) in cells for i, j in P.CROSS)}
    assert {(r.ix, r.iy) for r in P.erode(df, "room", P.CROSS).collect()} == ero


def test_rectangles_and_contours(grid):
    cells, df = grid
    rect = Y.rectangles(df, "room").orderBy("n").collect()
    cover = [(x, y) for r in rect for x in range(r.ix0, r.ix1 + 1) for y in range(r.iy0, r.iy1 + 1)]
    assert sorted(cover) == sorted(cells)
    best = max((x1 - x0 + 1) * (y1 - y0 + 1) for x0 in range(14) for x1 in range(x0, 14) for y0 in range(11) for y1 in range(y0, 11)
               if all((x, y) in cells for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)))
    assert rect[0].area == best and [r.area for r in rect] == sorted((r.area for r in rect), reverse=True)
    rings = Y.contours(df, "room").collect()
    assert sum(r.area for r in rings) == pytest.approx(len(cells))
    one = [p for p in Y.trace(np.ones((2, 3), bool))]
    assert len(one) == 1 and len(one[0]) == 4


def test_known_rectangle(spark):
    rings = [[(0, 0), (2, 0), (2, 1), (0, 1)], [(0, 0), (2, 0.1), (2, 1), (0, 1)], [(0, 0), (2, 1), (2, 0), (0, 1)], [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)]]
    df = spark.createDataFrame([(k, [[float(v) for v in p] for p in r]) for k, r in enumerate(rings)], "id int, ring array<array<double>>")
    got = [r[0] for r in df.orderBy("id").select(Y.as_rectangle(F.col("ring"))).collect()]
    assert tuple(got[0]) == (0.0, 0.0, 2.0, 1.0) and got[1:] == [None, None, None]  # a slanted side, a bow tie, six corners


def test_a_cabinet_stands_in_its_footprint(spark):
    ring = [[0.0, 0.0], [0.8, 0.0], [0.8, 1.0], [0.0, 1.0]]
    df = spark.createDataFrame([(1, ring, 2.2, -1, 0), (2, ring, 2.2, None, None), (3, ring, 0.5, 1, 0), (4, ring[:3], 2.2, 1, 0), (5, ring, 1.0, 0, 1)], "panel int, ring array<array<double>>, height double, fx int, fy int")
    parts = {}
    for r in Y.cabinet_parts(df).collect():
        parts.setdefault((r.panel, r.part), []).append(r)
    body, doors = parts[1, "body"][0], parts[1, "door"]
    assert (body.xa, body.xb, body.ya, body.yb, body.z0, body.z1) == (0.0, 0.8, 0.008, 0.992, 0.1, 2.2)
    assert len(doors) == 2 and all(d.xb == 0 and d.xa == -0.012 and body.ya < d.ya < d.yb < body.yb for d in doors) and doors[0].z1 < doors[1].z0
    assert all(h.xb == -0.012 and h.yb < 0.2 for h in parts[1, "handle"])  # at the right, seen from the aisle
    assert parts[2, "door"][0].ya == -0.012 and parts[2, "handle"][0].xa > 0.6 and parts[5, "door"][0].yb == 1.012 and len(parts[5, "door"]) == 1
    assert (3, "door") not in parts and parts[3, "plinth"][0].xb == pytest.approx(0.76) and not any(k[0] == 4 for k in parts)


def test_first_hit_is_the_median_of_its_points(spark):
    rng = random.Random(1)
    rays = spark.createDataFrame([(1, 0.0, 0.0, 1.5, 0.0, 1.0, 0.0), (2, 0.0, 0.0, 1.5, 1.0, 0.0, 0.0)], "ray long, ox double, oy double, oz double, dx double, dy double, dz double")
    near = [(2.0 + 0.01 * k, rng.uniform(-0.02, 0.02), 1.5 + rng.uniform(-0.02, 0.02)) for k in range(9)]
    rows = [(1, t, x, t, z) for t, x, z in near] + [(1, 1.0, 0.0, 1.0, 1.5), (1, 5.0, 0.0, 5.0, 1.5)] + [(2, 9.0 + k / 1000, 9.0 + k / 1000, 0.0, 1.5) for k in range(20)]
    got = P.first_hit(spark.createDataFrame(rows, "ray long, t double, x double, y double, z double"), rays).collect()
    r = got[0]
    mid = [float(np.median([p[k] for p in near if p[0] <= 2.09])) for k in (1, 0, 2)]
    dense = [t for t, *_ in near if sum(abs(t - s) <= 0.05 + 1e-12 for s, *_ in near) >= 8]
    want = [p for p in near if abs(p[0] - dense[0]) <= 0.05 + 1e-12]
    mid = [float(np.median([p[k] for p in want])) for k in (1, 0, 2)]
    assert len(got) == 1 and r.ray == 1 and np.allclose([r.x, r.y, r.z], mid) and r.t == pytest.approx(mid[1]) and r.support == len(want)
    assert r.spread == pytest.approx(float(np.median([np.linalg.norm(np.array([x, t, z]) - mid) for t, x, z in want])))


def plain_floor(z, cameras, width=0.01):
    lo, hi = np.percentile(z, 0.1) - 2 * width, np.percentile(z, 99.9) + 2 * width
    n = int(np.ceil((hi + 0 - lo) / width)) - 1
    h = np.zeros(n, int)
    for v in z:
        k = int(np.floor((v - lo) / width))
        if 0 <= k < n:
            h[k] += 1
    s = [sum(h[max(0, k - 1) : k + 2]) for k in range(n)]
    high = [k for k in range(1, n - 1) if s[k] >= s[k - 1] and s[k] >= s[k + 1]]
    mid = lambda k: lo + (k + 0.5) * width
    under = [k for k in high if 0.8 <= np.median(cameras) - mid(k) <= 2.2]
    pick = max(under, key=lambda k: s[k]) if under else min(k for k in high if s[k] >= 0.25 * max(s))
    return float(np.median([v for v in z if abs(v - mid(pick)) <= 3 * width])), s


def test_floor_under_the_cameras(spark):
    """A weak floor below the cameras wins over a strong table or ceiling; without cameras the lowest strong level."""
    rng = np.random.default_rng(5)
    z = np.concatenate([rng.normal(0.0, 0.01, 300), rng.normal(0.75, 0.01, 2000), rng.normal(2.6, 0.01, 4000), rng.uniform(-0.5, 3, 500)])
    points = spark.createDataFrame([("a", float(v)) for v in z] + [("b", float(v)) for v in z], "room string, z double")
    cameras = spark.createDataFrame([("a", 1.5), ("a", 1.45), ("a", 9.0)], "room string, camera_z double")
    got = {r.room: r.floor_z for r in P.floor_level(points, cameras, "room").collect()}
    assert got["a"] == pytest.approx(plain_floor(z, [1.5, 1.45, 9.0])[0], abs=1e-9) and abs(got["a"]) < 0.01
    assert got["b"] == pytest.approx(plain_floor(z, [99.0])[0], abs=1e-9) and abs(got["b"] - 0.75) < 0.01


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(2)
    v = {"a": rng.normal(size=501).round(2), "b": np.array([3.0]), "c": np.array([1.0, 1.0, 1.0]), "d": np.r_[np.zeros(400), 1e9, rng.uniform(0, 1e-3, 50)]}
    df = spark.createDataFrame([(k, float(x)) for k, xs in v.items() for x in xs] + [("a", None)], "k string, v double")
    at = (0.0, 0.001, 0.25, 0.5, 0.995, 1.0)
    for r in P.percentiles(df, "k", "v", at).collect():
        assert np.allclose(list(r)[1:], np.percentile(v[r.k], [100 * q for q in at]))


def test_the_cylinder_has_an_open_edge(spark):
    rays = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)], "ray long, site long, ox double, oy double, oz double, dx double, dy double, dz double")
    points = spark.createDataFrame([(1, 0, 1.0, 0.03, 0.0), (2, 0, 1.0, 0.0299, 0.0), (3, 0, 0.4, 0.0, 0.0), (4, 0, 10.5, 0.0, 0.0)], "pid long, site long, x double, y double, z double")
    assert {r.pid for r in P.cylinder_hits(rays, points).collect()} == {2, 3}


def test_clouds_move_to_the_world(spark):
    h = 0.5**0.5  # a quarter turn about z
    poses = spark.createDataFrame([("s", h, 0.0, 0.0, h, 10.0, 0.0, 1.0)], "scan string, qw double, qx double, qy double, qz double, tx double, ty double, tz double")
    rows = [("s", 1, 1.0, 0.0, 0.5, None, None, None, None), ("s", 2, None, None, None, 2.0, 0.0, float(np.pi / 6), 0), ("s", 3, 1.0, 0.0, 0.5, None, None, None, 1), ("t", 4, 1.0, 0.0, 0.5, None, None, None, 0)]
    df = spark.createDataFrame(rows, "scan string, ord long, x double, y double, z double, range double, azimuth double, elevation double, invalid int")
    got = {v.ord: v for v in P.cloud_to_world(df, poses).collect()}
    r, polar = got[1], got[2]
    assert set(got) == {1, 2} and np.allclose([polar.x, polar.y, polar.z], [10.0, 3**0.5, 2.0])
    assert np.allclose([r.x, r.y, r.z], [10.0, 1.0, 1.5])


def test_components_that_stand_on_something(spark, grid):
    cells, df = grid
    low = {c for c in cells if c[1] % 3 == 0}
    got = {(r.ix, r.iy) for r in P.kept_components(df, "room", C.components, 2.0, 0.5, support=df.where("iy % 3 = 0"), least_support=4, least_share=0.3).collect()}
    want = {c for comp in flood(cells, FOUR) if len(comp) * 0.25 >= 2.0 and len(low & set(comp)) >= max(4, 0.3 * len(comp)) for c in comp}
    assert got == want and want


def test_straightened_rings(spark):
    ring = np.array([(0, 0), (10, 0), (10, 5), (9.8, 5), (9.8, 8), (0, 8)], float)
    q = Y.straightened(ring, 0.5)
    assert len(q) == 4 and abs(Y.area_of(q)) == pytest.approx(8 * (10 * 5 + 9.8 * 3) / 8)
    assert (Y.straightened(ring, 0.1) == ring).all()
    cells = spark.createDataFrame([(0, x, y) for x in range(20) for y in range(10) if (x, y) != (19, 9)] + [(0, 40, 40)], "room long, ix long, iy long")
    got = Y.contours(cells, "room", size=0.1, least_edge=0.3, step=0.05, least_area=0.05).collect()
    assert [(r.corners, round(r.area, 2)) for r in got] == [(4, 2.0)] or [(r.corners) for r in got] == [4]
    assert len(Y.contours(cells, "room").collect()) == 2


def test_walls_against_a_loop(grid):
    cells, df = grid
    want = set()
    for axis, at in (("x", lambda line, v: (v, line)), ("y", lambda line, v: (line, v))):
        for line in range(-1, 15):
            v = 0
            while v < 15:
                end = v
                while at(line, end) in cells:
                    end += 1
                if end - v >= 3:
                    want.add((axis, line, v, end - 1))
                v = end + 1
    assert {(r.axis, r.line, r.start, r.end) for r in Y.walls(df, "room", 3).collect()} == want and want


def test_a_partition_of_a_room(spark):
    cells = [(0, x, y) for x in range(3, 23) for y in (10, 11)] + [(0, 40, y) for y in range(5, 9)] + [(0, x, y) for x in range(50, 62) for y in range(30, 42)]
    got = Y.partitions(spark.createDataFrame(cells, "room long, ix long, iy long"), "room", 0.1).collect()
    assert [(r.axis, *(round(r[c], 3) for c in ("x0", "x1", "y0", "y1"))) for r in got] == [("x", 0.3, 2.3, 1.025, 1.175)]  # a short line and a thick block are none


def test_devices_face_the_floor(spark):
    floor = [(0, x, y) for x in range(20, 40) for y in range(0, 20)]
    d = spark.createDataFrame([(0, 1, 1.9, 1.0), (0, 2, 3.0, 2.1), (0, 3, 9.0, 9.0), (1, 4, 0.0, 0.0)], "site long, device long, x double, y double")
    grid = spark.createDataFrame([(0, 0, 99, 0, 99)], "site long, ix0 long, ix1 long, iy0 long, iy1 long")
    got = {r.device: (r.side, r.share) for r in P.facing(d, spark.createDataFrame(floor, "site long, ix long, iy long"), grid, "site", 0.1).collect()}
    assert got[1][0] == "+x" and got[2][0] == "-y" and got[3] == ("+x", 0.0) and got[4] == ("+x", 0.0)  # the last site has no grid


def test_windows_end_at_the_grid(spark):
    """A window that the grid cuts to a strip of floor is all floor; beyond the grid there is nothing to count."""
    floor = spark.createDataFrame([(0, x, 0) for x in range(10)] + [(0, 0, y) for y in range(6)], "site long, ix long, iy long")
    grid = spark.createDataFrame([(0, 0, 9, 0, 9)], "site long, ix0 long, ix1 long, iy0 long, iy1 long")
    d = spark.createDataFrame([(0, 1, 0.5, 0.24)], "site long, device long, x double, y double")
    r = P.facing(d, floor, grid, "site", 0.1).first()
    assert (r.side, r.share) == ("-y", 1.0)
    c = spark.createDataFrame([(0, 1, 0.55, 0.02), (0, 2, 0.55, 0.55), (0, 3, 4.0, -3.0)], "site long, point long, x double, y double")
    got = {r.point: (r.share, r.blocked) for r in P.disc_share(c, floor, grid, 0.2, 0.1, "site").collect()}
    assert got == {1: (1.0, True), 2: (0.0, False), 3: (1.0, True)}  # the disc leaves the grid: its centre alone, or the nearest cell


def test_columns_as_they_stand(spark):
    """Bins of 5 cm from 10 cm below the floor: the floor's own bins are no solid, what hangs above the cut neither."""
    occ = [(0, 0, 0, 1, 9), (0, 0, 0, 2, 9),  # floor alone: middles at -0.025 and 0.025
           (0, 1, 0, 4, 9),  # 0.125: a solid's lowest bin
           (0, 2, 0, 22, 9), (0, 2, 0, 21, 1),  # 1.025: not low; one point is too few
           (0, 3, 0, 54, 9), (0, 3, 0, 53, 2),  # 2.625 lies above the cut, 2.575 does not
           (0, 4, 0, 3, 9)]  # 0.075: neither floor nor solid
    df = spark.createDataFrame(occ, "room long, ix long, iy long, iz long, n long")
    got = {r.ix: (round(r.top, 6), r["any"], r.low, r.floor) for r in P.column_top(df, "room", 0.05, -0.1).collect()}
    assert got == {0: (0.0, False, False, True), 1: (0.15, True, True, False), 2: (1.05, True, False, False), 3: (2.6, True, False, False), 4: (0.0, False, False, False)}


def test_colours_are_of_columns(spark):
    rows = [(0, 0.1, 0.1, 0.0, 10, 20, 30), (0, 0.2, 0.2, 0.04, 11, 21, 33), (0, 0.2, 0.2, 0.05, 99, 99, 99), (0, 0.1, 0.1, 1.0, 200, 100, 0), (0, 0.1, 0.1, 1.9, 0, 0, 0), (0, 0.1, 0.1, 2.1, 9, 9, 9), (0, 3.0, 0.0, 5.0, 1, 1, 1)]
    df = spark.createDataFrame(rows, "room long, x double, y double, z double, r int, g int, b int")
    got = {r.ix: r for r in P.column_colours(df, 1.0, "room").collect()}
    names = [f"{k}_{c}" for k in ("floor", "mid") for c in "rgbn"]
    assert [got[0][c] for c in names] == [10, 20, 31, 2, 100, 50, 0, 2] and [got[3][c] for c in names] == [0] * 8


def test_cells_have_colours_and_none_is_left_out(spark):
    """Against a loop: cells below the grid's first bin, without a height or over 255 points, colours that are missing."""
    rng = random.Random(8)
    heights = [-0.9, -0.1, -0.04, 0.0, 0.04, 0.05, 0.3, 1.0, 1.0, 2.0, 2.01, 7.5, None]
    channel = lambda: rng.choice([None, *[rng.randrange(256)] * 9])
    rows = [(rng.choice([None, 1, 2]), rng.choice([None, -0.5, 0.5, 1.5]), rng.choice([-0.5, 0.5]), rng.choice(heights), channel(), channel(), channel()) for _ in range(3000)]
    rows += [(1, 0.5, 0.5, 1.0, 255, 7, 0)] * 300
    cells, columns = {}, {}
    for room, x, y, z, *rgb in rows:
        column = (room, None if x is None else int(np.floor(x)), int(np.floor(y)))
        cells.setdefault((*column, None if z is None else int(np.floor((z + 0.1) / 0.25))), []).append(rgb)
        bands = columns.setdefault(column, ([], []))
        for band, inside in zip(bands, (z is not None and abs(z) <= 0.04, z is not None and 0.3 <= z <= 2.0), strict=True):
            if inside:
                band.append(rgb)
    given = lambda points, k: [p[k] for p in points if p[k] is not None]
    mean = lambda v: sum(v) / len(v) if v else None
    want = {key: (min(len(p), 255), *(mean(given(p, k)) for k in range(3)),
                  *(v for band in columns[key[:3]] for v in (*(int(mean(given(band, k)) or 0) for k in range(3)), len(band)))) for key, p in cells.items()}
    df = spark.createDataFrame(rows, "room long, x double, y double, z double, r int, g int, b int")
    got = P.room_grid(df, 1.0, "room", 0.25, -0.1)
    assert got.columns == ["room", "ix", "iy", "iz", "n", *"rgb", *(f"{k}_{c}" for k in ("floor", "mid") for c in "rgbn")]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(want) and {r[:4]: r[4:] for r in got} == want and max(r[4] for r in got) == 255
    assert {tuple(r[:4]): r.n for r in P.occupancy(df, 1.0, "room", 0.25, -0.1).collect()} == {key: v[0] for key, v in want.items()}


def test_occupancy_of_odd_lines(spark, sf, tmp_path):
    """Lines below the grid, without a height, place, room or colour: the query gives the rows of its SQL, colours included."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    k = F.col("l_orderkey") + F.col("l_linenumber")
    odd = {"l_discount": F.when(k % 7 == 0, -F.col("l_discount")).when(k % 11 == 0, None).otherwise(F.col("l_discount")), "l_quantity": F.when(k % 13 != 0, F.col("l_quantity")),
           "l_returnflag": F.when(k % 17 != 0, F.col("l_returnflag")), "l_suppkey": F.when(k % 5 != 0, F.col("l_suppkey"))}
    li.withColumns(odd).unionByName(li.where("l_orderkey = 1").limit(1).withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("again")).write.parquet(f"{tmp_path}/lineitem.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = db.execute(registry.ORACLES["occupancy"])
    names, want = [d[0] for d in want.description], want.fetchall()
    got = space.occupancy(spark, str(tmp_path))
    assert got.columns == names and {f"{k}_{c}" for k in ("floor", "mid") for c in "rgbn"} <= set(names)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want) and any(r[3] is not None and r[3] < 0 for r in want)


def test_unscanned_floor_against_a_loop(spark):
    rng = random.Random(5)
    room = {(x, y) for x in range(30) for y in range(24)} - {(x, y) for x in range(25, 30) for y in range(18, 24)}
    floor = {(x, y) for x, y in room if x < 12 and rng.random() < 0.5}
    covered = {(x, y) for x, y in room if y in (10, 11) and x > 14 or (x, y) == (22, 4)}

    def grown(cells, steps, offsets):
        for _ in range(steps):
            cells = {(x + i, y + j) for x, y in cells for i, j in offsets}
        return cells

    cross, box = [(0, 0), *FOUR], [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    eroded = lambda cells: {(x, y) for x, y in cells if all((x + i, y + j) in cells for i, j in box)}
    left = room - grown(floor, 2, cross) - covered
    left = grown(eroded(left), 1, box)
    wide = grown(left, 1, box)
    left = {(x, y) for x, y in wide if all((x + i, y + j) in wide for i, j in box)} & room
    want = {c for comp in flood(left, FOUR) if len(comp) * 0.01 >= 0.4 for c in comp}
    df = lambda cells: spark.createDataFrame([(0, *c) for c in cells], "room long, ix long, iy long")
    got = {(r.ix, r.iy) for r in P.unscanned(df(room), df(floor), df(covered), "room", C.components, 0.1, side=0.3).collect()}
    assert got == want and want
    for side in (1, 2, 5, 8):
        half = (max(side, 1) | 1) // 2
        sq = [(i, j) for i in range(-half, half + 1) for j in range(-half, half + 1)]
        shrunk = {(x, y) for x, y in room if all((x + i, y + j) in room for i, j in sq)}
        assert {(r.ix, r.iy) for r in P.square(df(room), "room", side, True).collect()} == grown(shrunk, 1, sq)


SHIPPED = [[-1.85, 4.0], [-9.1, 4.0], [-9.1, -7.15], [-1.85, -7.15]]  # facts of the shipped layout: its floor, bounds and wall
SHIPPED_BOUNDS = (-9.331, 0.285, -7.411, 4.038)
SHIPPED_WALL = {(-9.1, -7.15), (-9.1, 4.0), (-9.25, 4.0), (-9.25, -7.3), (-1.7, -7.3), (-1.7, 4.0), (-1.85, 4.0), (-1.85, -7.15)}


def room_of(spark, ring, bounds, size, missing=lambda x, y: False):
    sides = Y.sides_of(spark.createDataFrame([(0, 0, ring)], "room long, ring long, points array<array<double>>"), "room")
    (x0, y0), (x1, y1) = np.min(ring, 0), np.max(ring, 0)
    cells = [(0, int(x), int(y)) for x in range(int(np.floor(x0 / size)) - 3, int(x1 / size) + 4) for y in range(int(np.floor(y0 / size)) - 3, int(y1 / size) + 4) if not missing((x + 0.5) * size, (y + 0.5) * size)]
    tall = spark.createDataFrame(cells, "room long, ix long, iy long")
    b = spark.createDataFrame([(0, *bounds)], "room long, x0 double, x1 double, y0 double, y1 double")
    return sides, Y.wall_intervals(sides, tall, b, "room", size)


def test_the_shipped_room_is_open_where_the_scan_ends(spark):
    sides, intervals = room_of(spark, SHIPPED, SHIPPED_BOUNDS, 0.04)
    assert sorted((r.side, r.inward) for r in sides.collect()) == [(0, -1), (1, 1), (2, 1), (3, -1)]
    assert sorted((r.side, r.wall) for r in intervals.collect()) == [(0, False), (1, True), (2, True), (3, True)]
    walls = Y.wall_polygons(sides, intervals, "room").collect()
    assert len(walls) == 1 and walls[0].holes == [] and len(walls[0].points) == 8 and {tuple(p) for p in walls[0].points} == SHIPPED_WALL


def test_openings_partitions_and_rows(spark):
    """A door of 1.2 m is open, a gap of 0.6 m is not; 0.4 m of wall between openings is none; a corner turns inwards."""
    ring = [[0.0, 0.0], [10.0, 0.0], [10.0, 6.0], [4.0, 6.0], [4.0, 8.0], [0.0, 8.0]]
    missing = lambda x, y: y < 1 and (2 < x < 3.2 or 5 < x < 5.6 or 7 < x < 8.2 or 8.6 < x < 9.6)
    sides, intervals = room_of(spark, ring, (-5.0, 15.0, -5.0, 15.0), 0.1, missing)
    got = sorted((r.wall, round(r.s0, 3), round(r.s1, 3)) for r in intervals.where("side = 0").collect())
    assert got == [(False, 2.0, 3.2), (False, 7.0, 10.0), (True, 0.0, 2.0), (True, 3.2, 7.0)]
    walls = Y.wall_polygons(sides, intervals, "room").collect()
    total = sum(abs(Y.area_of(np.array(w.points))) - sum(abs(Y.area_of(np.array(h))) for h in w.holes) for w in walls)
    # perimeter and five outer corners less the inner one's, less the openings
    assert total == pytest.approx(0.15 * (36 - 1.2 - 3.0) + (5 - 1) * 0.15**2, abs=0.02) and len(walls) == 2
    shape = "room long, x0 double, x1 double, y0 double, y1 double"
    inner, row = spark.createDataFrame([(0, 5.0, 5.15, 1.0, 4.0)], shape), spark.createDataFrame([(0, -0.15, 0.0, 2.0, 3.0)], shape)
    more = Y.wall_polygons(sides, intervals, "room", inner, row).collect()
    assert len(more) == 4 and round(sum(w.area for w in more) - sum(w.area for w in walls), 3) == round(0.15 * 3 - 0.15, 3)
    closed = Y.wall_polygons(sides, intervals.where("false"), "room").collect()
    assert len(closed) == 1 and len(closed[0].holes) == 1


def test_polygons_have_their_holes(spark):
    """Two frames, one within the hole of the other, and a block; sides lie a quarter of a cell within."""
    frame = lambda a, b: {(x, y) for x in range(a, b) for y in range(a, b)} - {(x, y) for x in range(a + 2, b - 2) for y in range(a + 2, b - 2)}
    cells = frame(0, 20) | frame(6, 14) | {(x, y) for x in range(30, 34) for y in range(3)}
    df = spark.createDataFrame([(0, *c) for c in cells], "room long, ix long, iy long")
    got = Y.polygons(df, "room", size=1.0).collect()
    boxes = [(min(p[0] for p in r.points), max(p[0] for p in r.points), [(min(p[0] for p in h), max(p[0] for p in h)) for h in r.holes]) for r in got]
    assert boxes == [(0.25, 19.75, [(1.75, 18.25)]), (6.25, 13.75, [(7.75, 12.25)]), (30.25, 33.75, [])]
    assert [r.area for r in got] == [19.5**2 - 16.5**2, 7.5**2 - 4.5**2, 3.5 * 2.5]
    assert [len(r.holes) for r in Y.polygons(df, "room", size=1.0, least_area=25.0).collect()] == [1, 0]


def test_boxes_of_components(spark):
    size = 0.05
    block = [(x, y, 0.9) for x in range(40, 60) for y in range(10, 22)]
    low = [(x, y, 0.35 if (x + y) % 4 else 2.0) for x in range(2, 12) for y in range(30, 42)]  # a fourth of its cells lies higher: three quarters do not
    tee = [(x, y, 1.5) for x in range(80, 110) for y in range(10, 20)] + [(x, y, 1.5) for x in range(90, 100) for y in range(20, 30)]
    thin = [(x, 60, 1.0) for x in range(0, 90)]
    none = [(x, y, None) for x in range(120, 130) for y in range(50, 60)]
    df = spark.createDataFrame([(0, *c) for c in block + low + tee + thin + none], "room long, ix long, iy long, height double")
    got = sorted((round(r.xa, 2), round(r.xb, 2), round(r.ya, 2), round(r.yb, 2), r.kind, round(r.height, 2)) for r in Y.boxes(df, "room", size, C.components).collect())
    assert got == [(0.1, 0.6, 1.5, 2.1, "low", 0.75)[:4] + got[0][4:], (2.0, 3.0, 0.5, 1.1, "equipment", 0.9), (4.0, 5.5, 0.5, 1.0, "equipment", 1.5), (4.5, 5.0, 1.0, 1.5, "equipment", 1.5)]
    assert got[0][5] == round(round(float(np.percentile([h for *_, h in low], 75)) / 0.05) * 0.05, 3)
    sides = Y.sides_of(spark.createDataFrame([(0, 0, [[0.0, 0.4], [3.1, 0.4], [3.1, 9.0], [0.0, 9.0]])], "room long, ring long, points array<array<double>>"), "room")
    moved = {(round(r.xa, 2), round(r.xb, 2), round(r.ya, 2), round(r.yb, 2)) for r in Y.boxes(df, "room", size, C.components, sides).collect()}
    assert (2.0, 3.1, 0.4, 1.1) in moved and (0.0, 0.6, 1.5, 2.1) in moved and (4.0, 5.5, 0.5, 1.0) in moved


def test_shift_is_found(spark, sf):
    got = space.ring_shift(spark, sf).collect()
    assert got and all(r["shift"] == r.vec_id % 64 and r.sure for r in got)
    a = np.array([0, 1, 5, 2, 0, 0, np.nan, 0, 3, 0], float)
    assert round(Y.correlate(a, np.roll(a, 3))[0]) == 3


def test_views_and_gaps(spark):
    assert Y.view_grid(spark.createDataFrame([(1,)], "scan long")).count() == 174
    df = spark.createDataFrame([(0, k, v) for k, v in enumerate([0.0, 0.2, 0.9, 1.1, 3.0])], "k long, id long, v double")
    assert [r.group for r in P.gap_groups(df, "k", "v", 0.5, "id").orderBy("v").collect()] == [0, 0, 1, 1, 2]


@pytest.mark.parametrize("side", ["+x", "-x", "+y", "-y"])
def test_cabinet_rows(spark, side):
    """A row 2.4 m long and 0.6 m deep before an aisle, the same in each direction."""
    fx, fy = {s: (x, y) for s, x, y in P.SIDES}[side]
    size = 0.1
    turn = lambda u, s: (u * fx - s * fy, u * fy + s * fx)
    cells = []
    for i in range(-30, 40):  # along the side's axis: the row's body from -0.6 to 0, the aisle in front, floor behind
        for k in range(-10, 50):
            u, s = (i + 0.5) * size, (k + 0.5) * size
            body = -0.6 < u < 0 and 0 < s < 2.4
            x, y = turn(u, s)
            cells.append((0, int(np.floor(x / size)), int(np.floor(y / size)), not body, body, True, 2.0 if body else None))
    c = spark.createDataFrame(cells, "room long, ix long, iy long, floor boolean, solid boolean, inside boolean, top double")
    at = [(1, 0.02, 0.4), (2, 0.0, 1.2), (3, 0.0, 1.22), (4, -0.01, 2.0)]
    d = spark.createDataFrame([(0, i, *map(float, turn(u, s)), side) for i, u, s in at] + [(1, 9, 0.0, 0.0, side)], "room long, id long, x double, y double, side string")
    got = Y.cabinet_rows(d, c, "room", size).orderBy("panel").collect()
    assert {(r.room, r.side, r["row"], r.devices) for r in got} == {(0, side, 0, 4)}  # a room without cells has none
    assert all(r.front == 0 and r.depth == pytest.approx(0.6) and r.height == pytest.approx(2.0) for r in got)
    assert [(r.s0, r.s1) for r in got] == [(0.0, 0.8), (0.8, 1.6), (1.6, 2.4)]
    faces = {r.id: r for r in Y.device_faces(*Y.row_frames(d, c, "room", size), "room").collect()}
    assert sorted(faces) == [1, 2, 3, 4] and all(r.top == pytest.approx(2.0) and r.side == side for r in faces.values())
    for i, u, s in at:
        assert (faces[i].x, faces[i].y) == pytest.approx(turn(0.0, s), abs=1e-9)


def panels_of(spark, devices, body, size=0.1, holes=()):
    """Panels of one row that faces +y, its front at y = 0 and 0.8 m deep, from body[0] to body[1]; floor in front of it, and
    in the holes (from, to, depth) behind the front. The room ends half a metre beyond x = 9 and at y = -0.8."""
    cells = []
    for ix in range(-20, 100):
        for iy in range(-20, 30):
            x, y = (ix + 0.5) * size, (iy + 0.5) * size
            inside = -0.8 < y and x < 9.5
            solid = inside and y < 0 and body[0] < x < body[1] and not any(a < x < b for a, b in holes)
            cells.append((0, ix, iy, inside and not solid, solid, inside, (1.2 if x < 2 else 2.2) if solid else None))
    c = spark.createDataFrame(cells, "room long, ix long, iy long, floor boolean, solid boolean, inside boolean, top double")
    d = spark.createDataFrame([(0, i, float(x), float(y), "+y") for i, (x, y) in enumerate(devices)], "room long, id long, x double, y double, side string")
    got = Y.cabinet_rows(d, c, "room", size).orderBy("row", "panel").collect()
    # along a row that faces +y one goes towards smaller x
    return [(r["row"], -r.s1, -r.s0) for r in reversed(got)], {(r["row"], r.depth, r.height) for r in got}


def test_rows_end_and_divide(spark):
    got, rest = panels_of(spark, [(3.0, 0.0), (4.0, 0.0), (4.1, 0.0), (5.0, 0.0)], (1.0, 8.0))
    # borders half-way between devices (two above each other at 4.05); a metre wide on average, the long ends divided in two
    assert [round(b, 2) for _, _, b in got][-1] == 8.0 and round(got[0][1], 2) == 1.0
    assert [(round(a, 2), round(b, 2)) for _, a, b in got] == [(1.0, 1.75), (1.75, 2.5), (2.5, 3.5), (3.5, 4.5), (4.5, 5.5), (5.5, 6.75), (6.75, 8.0)] and rest == {(0, 0.8, 2.2)}
    # a gap of 20 cm is crossed, one of 40 cm ends the row
    crossed, _ = panels_of(spark, [(3.0, 0.0), (4.0, 0.0)], (1.0, 8.0), holes=[(5.2, 5.4)])
    ended, _ = panels_of(spark, [(3.0, 0.0), (4.0, 0.0)], (1.0, 8.0), holes=[(5.2, 5.6)])
    assert max(b for *_, b in crossed) == 8.0 and max(b for *_, b in ended) == pytest.approx(5.2)
    # a device alone has a panel 0.8 m wide; fronts 0.3 m apart are two rows
    alone, _ = panels_of(spark, [(4.0, 0.0)], (3.5, 4.5))
    assert [(round(a, 2), round(b, 2)) for _, a, b in alone] == [(3.5, 4.5)]
    two, _ = panels_of(spark, [(4.0, 0.0), (4.0, -0.3)], (3.0, 5.0))
    assert {r for r, *_ in two} == {0, 1}


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_readers(spark, folder):
    with open(f"{folder}/a.json", "w") as f:
        json.dump([{"id": "1", "confidence": 0.5, "bbox": [1, 2]}, {"id": "2"}], f)
    assert [(r.id, r.confidence) for r in readers.json_array(spark, f"{folder}/a.json", "id string, confidence double, bbox array<int>").collect()] == [("1", 0.5), ("2", None)]
    assert readers.optional(spark, f"{folder}/none.json", "id string").count() == 0
    pose = {f"img{k}": {"imageWidth": 10, "rotation": [1.0, 0, 0, 0], "translation": t} for k, t in enumerate([[1.001, 2.0, 0.0], [5.0, 5.0, 5.0], [1.004, 2.0, 0.0]])}
    with open(f"{folder}/poses.json", "w") as f:
        json.dump(pose, f)
    assert {r.image: r.scanPointId for r in readers.poses(spark, f"{folder}/poses.json").collect()} == {"img0": "scan-00", "img1": "scan-01", "img2": "scan-00"}
    seed = spark.createDataFrame([("s", 1)], "id string, version int")
    assert readers.store(spark, f"{folder}/log", "id string, version int", seed)[1]
    for text, fallback in (('{"id": "a", "version": 2}', False), ("{broken", True)):
        with open(f"{folder}/log.json", "w") as f:
            f.write(text)
        rows, used = readers.store(spark, f"{folder}/log.json", "id string, version int", seed)
        assert used == fallback and rows.count() == 1
    assert readers.query_filters({"floor": "2", "x": "1", "r": "abc"}, {"floor": "int", "r": "double"}) == {"floor": 2}


def test_objects_of_lines_and_of_arrays_are_all_read(spark, folder):
    """Files of lines once gave only their first object."""
    df = spark.range(50).selectExpr("id", "if(id % 3 = 0, null, concat('a, ', id, '\\n]')) AS v")
    sinks.json_lines(df, f"{folder}/lines", 3)
    sinks.json_arrays(df, f"{folder}/arrays", 3)
    sinks.json_arrays(df.limit(0), f"{folder}/none")
    want = sorted((r.id, r.v or "") for r in df.collect())
    for name in ("lines", "arrays"):
        for lines in (None, name == "lines"):
            got = readers.json_array(spark, f"{folder}/{name}", "id long, v string", lines).collect()
            assert sorted((r.id, r.v or "") for r in got) == want
    for name in (n for n in os.listdir(f"{folder}/arrays") if n.endswith(".txt")):
        with open(f"{folder}/arrays/{name}") as f:
            assert isinstance(json.load(f), list)
    assert readers.json_array(spark, f"{folder}/none", "id long, v string").count() == 0
    with open(f"{folder}/empty.json", "w"):
        pass
    assert readers.json_array(spark, f"{folder}/empty.json", "id long").count() == 0


def test_each_site_counts_its_scans(spark):
    rows = [("a", 0, "a0", [0.0, 0.0]), ("a", 1, "a1", [9.0, 0.0]), ("a", 2, "a2", [0.001, 0.0]), ("b", 0, "b0", [9.0, 0.0]), ("b", 1, "b1", [9.004, 0.0])]
    got = readers.with_scan_ids(spark.createDataFrame(rows, "site string, ord long, image string, translation array<double>"), ["site"])
    assert {(r.site, r.scanPointId): r.images for r in readers.scan_images(got, ["site"]).collect()} == {("a", "scan-00"): ["a0", "a2"], ("a", "scan-01"): ["a1"], ("b", "scan-00"): ["b0", "b1"]}


def test_large_scans_are_exported_by_several_tasks_and_small_ones_together(spark, folder):
    p = spark.range(4000).selectExpr("if(id % 2 = 0, 'hot', concat('s', id % 20)) AS scan", "id * 1.0 AS x", "0.0 AS y", "1.0 AS z").repartition(16)
    got = {r.scan: r.points for r in sinks.export_cloud(p, f"{folder}/cloud").collect()}
    assert got["hot"] == 2000 and sum(got.values()) == 4000
    files = [len([f for f in os.listdir(f"{folder}/cloud/scan={s}") if f.endswith(".parquet")]) for s in got]
    assert sum(files) < 3 * len(got)  # not one for each task and scan


def test_sinks(spark, folder):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, v double")
    sinks.both(df, f"{folder}/one", f"{folder}/two")
    assert sorted(spark.read.json(f"{folder}/two").collect()) == sorted(df.collect())
    gates = spark.createDataFrame([(True, True)], "a boolean, b boolean")
    assert sinks.publish(df, gates, f"{folder}/pub") == (True, f"{folder}/pub")
    assert sinks.publish(df.limit(1), gates.withColumn("b", F.lit(False)), f"{folder}/pub") == (False, f"{folder}/pub-rejected")
    assert readers.published(spark, f"{folder}/pub").count() == 2 and readers.published(spark, f"{folder}/pub-rejected").count() == 1
    assert sinks.report(gates, f"{folder}/report", run=1) == 0
    failed = gates.withColumn("b", F.lit(False))
    assert sinks.report(failed, f"{folder}/other", {"b": 3}) == 3 and sinks.report(failed, f"{folder}/other") == 1
    assert spark.read.json(f"{folder}/report").count() == 1
    assert sinks.report(gates.limit(0), f"{folder}/none") == 1  # a run that ended before its gates
    assert json.loads(spark.read.json(f"{folder}/none").first().facts) == {"exit_code": 1}
    assert sinks.cached(df, f"{folder}/cache", size=1).count() == 2
    assert sinks.cached(df.limit(0), f"{folder}/cache", size=1).count() == 2
    p = spark.createDataFrame([("s1", 1.0, 2.0, 3.0), ("s1", 3.0, 2.0, 3.0), ("s2", 0.0, 0.0, 0.0)], "scan string, x double, y double, z double")
    m = {r.scan: (r.points, r.mean_x, r.large) for r in sinks.export_cloud(p, f"{folder}/cloud").collect()}
    assert m == {"s1": (2, 2.0, False), "s2": (1, 0.0, False)}
    assert sinks.best_effort(df, f"{folder}/ok") and readers.cloud(spark, f"{folder}/cloud", "s1").count() == 2
    sinks.layout_json(df, f"{folder}/layout")
    assert spark.read.text(f"{folder}/layout").count() == 2
    sinks.layout_json(df.select("id", F.lit(None).cast("int").alias("top")), f"{folder}/nulls")
    assert json.loads(spark.read.text(f"{folder}/nulls").orderBy("value").first().value) == {"id": "a", "top": None}
    told = []
    sinks.stored_or_error(df, f"{folder}/kv", told.append)
    assert told == [f"{folder}/kv"] and readers.published(spark, f"{folder}/kv").count() == 2
    with pytest.raises(sinks.StoreError):
        sinks.stored_or_error(df, "nowhere://x/y", told.append)
    assert len(told) == 1 and readers.published(spark, f"{folder}/kv").count() == 2


def test_a_failing_write_or_rename_leaves_what_was_published(spark, folder, monkeypatch):
    df = spark.createDataFrame([(k,) for k in range(3)], "k long")
    for n in (1, 2, 3):
        sinks.put(df.limit(n), f"{folder}/p")
    assert readers.published(spark, f"{folder}/p").count() == 3
    assert len([n for n in os.listdir(f"{folder}/p") if n.startswith("v")]) == sinks.VERSIONS

    def refused(*_):
        raise OSError("no")

    with monkeypatch.context() as m:
        m.setattr(sinks, "replace", refused)
        with pytest.raises(sinks.StoreError):
            sinks.stored_or_error(df.limit(1), f"{folder}/p")
    bad = df.select(F.raise_error(F.lit("no")).alias("k"))
    with pytest.raises(sinks.StoreError):
        sinks.stored_or_error(bad, f"{folder}/p")
    assert readers.published(spark, f"{folder}/p").count() == 3
    sinks.stored_or_error(df.limit(2), f"{folder}/p")
    assert readers.published(spark, f"{folder}/p").count() == 2


def test_clouds_of_archives(spark, folder):
    rng = np.random.default_rng(1)
    scans = []
    for k, n in enumerate((5, 12, 0)):
        xyz = rng.random((n, 3)).astype(np.float32)
        more = {"rgb": rng.integers(0, 256, (n, 3)).astype(np.uint8)} if k == 1 else {}
        np.savez_compressed(f"{folder}/scan_{k:02d}.npz", xyz=xyz, **more)
        scans.append((xyz, more.get("rgb")))
    with open(f"{folder}/manifest.json", "w") as f:
        json.dump({"voxel": 0.01, "scans": [{"file": f"scan_{k:02d}.npz", "name": f"s{k}", "pointsRaw": 100 + k, "hasRGB": k == 1, "translation": [1.0, 2.0, float(k)], "rotation_wxyz": [1.0, 0.0, 0.0, 0.0]} for k in range(3)]}, f)
    assert [(r["index"], r.file, r.points, r.hasRGB, r.translation[2]) for r in readers.archive_headers(spark, folder).orderBy("index").collect()] == [(k, f"scan_{k:02d}.npz", 100 + k, k == 1, float(k)) for k in range(3)]
    got = {}
    for r in readers.archive_cloud(spark, folder, chunk=5).collect():
        got.setdefault(r.scan, []).append(tuple(r)[1:])
    assert {k: len(v) for k, v in got.items()} == {0: 5, 1: 12}
    for k in (0, 1):
        xyz, rgb = scans[k]
        assert sorted(got[k]) == [(i, *map(float, xyz[i]), *(map(int, rgb[i]) if rgb is not None else (None,) * 3)) for i in range(len(xyz))]
    with open(f"{folder}/scan_01.npz", "wb") as f:
        f.write(b"broken")  # not opened where it isn't asked for
    assert readers.archive_cloud(spark, folder, [0]).count() == 5 and readers.archive_cloud(spark, folder, [7]).count() == 0


def test_label_files_split_by_the_order_of_images(spark, folder):
    rows = [(100 + 7 * k, 0, 0.5, 0.5, 0.25, 0.25) for k in range(20)]
    sinks.label_files(spark.createDataFrame(rows, "image long, class int, cx double, cy double, w double, h double"), f"{folder}/labels")
    assert sorted(int(n.split("=")[1]) for n in os.listdir(f"{folder}/labels/split=val") if "=" in n) == [100, 107, 114]
    assert len([n for n in os.listdir(f"{folder}/labels/split=train") if "=" in n]) == 17
    wide = spark.createDataFrame([(1, 0, 1234.5, 0.5, 0.25, 0.25)], "image long, class int, cx double, cy double, w double, h double")
    sinks.label_files(wide, f"{folder}/wide")
    assert spark.read.text(f"{folder}/wide").first().value == "0 1234.500000 0.500000 0.250000 0.250000"
    with pytest.raises(PySparkException, match="without class"):
        sinks.label_files(wide.withColumn("w", F.lit(None).cast("double")), f"{folder}/null")


def test_source_hashes(spark, folder):
    import hashlib

    for name, text in (("a.json", b'{"x": 1}\r\n\r\n["\xc3\xa4"]\r\n'), ("b.json", b'{"x": 1}\n\n["\xc3\xa4"]\n'), ("c.json", b"other\n")):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(text)
    got = {r.path.rsplit("/", 1)[1]: r.hash for r in readers.source_hash(spark, f"{folder}/*.json").collect()}
    assert got["a.json"] == got["b.json"] == hashlib.sha1(b'{"x": 1}\n\n["\xc3\xa4"]\n').hexdigest()[:12] and got["c.json"] != got["a.json"]


def test_levels_of_a_cloud(spark):
    rng = random.Random(2)
    rows = [(f"s{k % 3}", k, rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(0, 0.3)) for k in range(600)]
    fine, coarse, scans = P.cloud_levels(spark.createDataFrame(rows, "scan string, ord long, x double, y double, z double").repartition(5), 0.2, 0.7, [])
    for df, size in ((fine, 0.2), (coarse, 0.7)):
        want = {}
        for s, k, *p in sorted(rows):
            want.setdefault(tuple(int(np.floor(v / size)) for v in p), (s, k))
        assert {(r.ix, r.iy, r.iz): tuple(r.ord) for r in df.collect()} == want
    got = {r.scan: r for r in scans.collect()}
    assert all(r["read"] == 200 and r.left <= 200 for r in got.values()) and got["s1"].mean_x == pytest.approx(np.mean([r[2] for r in rows if r[0] == "s1"]))
    assert got["s0"].left == len({tuple(int(np.floor(v / 0.2)) for v in r[2:]) for r in rows if r[0] == "s0"})


def test_library_lookups(spark, folder):
    from sightline.operators import triage

    with open(f"{folder}/library.json", "w") as f:
        json.dump({"assetTypes": [{"assetTypeId": "t1", "name": "Relay", "manufacturer": "M", "manufacturerDocs": [{"title": "Guide", "url": "u"}]}, {"assetTypeId": "t2", "name": "Meter"}], "instances": [{"instanceId": "i1", "assetTypeId": "t1", "documents": [{"title": "Report", "url": "v"}], "more": 1}]}, f)
    types, instances = readers.library(spark, f"{folder}/library.json")
    d = spark.createDataFrame([("d1", "t1", "i1"), ("d2", "t2", None), ("d3", "t9", "i9"), ("d4", None, None)], "id string, assetTypeId string, instanceId string")
    got = {r.id: (r.type and r.type.name, r.library and r.library.documents[0].title) for r in triage.looked_up(d, types, instances).collect()}
    assert got == {"d1": ("Relay", "Report"), "d2": ("Meter", None), "d3": (None, None), "d4": (None, None)}


def test_readers_of_files_and_scans(spark, folder):
    for n in ("b.jpg", "a.png", "c.txt"):
        with open(f"{folder}/{n}", "wb") as f:
            f.write(n.encode())
    got = readers.images(spark, folder).collect()
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["a.png", "b.jpg"] and bytes(got[1].content) == b"b.jpg"
    with open(f"{folder}/m.json", "w") as f:
        f.write('{"index": 0, "translation": [1.0, 2.0, 3.0]}\n{"index": 1, "translation": [0.0, 0.0, 0.0]}\n')
    assert {r["index"] for r in readers.headers(spark, f"{folder}/m.json").collect()} == {0, 1}
    spark.createDataFrame([(0, 1, 2, 3, 4, "more")], "room long, ix long, iy long, iz long, n long, note string").write.parquet(f"{folder}/grid")
    assert [tuple(r) for r in readers.grid(spark, f"{folder}/grid").collect()] == [(0, 1, 2, 3, 4)]
    images = spark.createDataFrame([("s", 2, "y"), ("s", 1, "x"), ("t", 3, "z")], "scanPointId string, ord long, image string")
    assert {r.scanPointId: r.images for r in readers.scan_images(images).collect()} == {"s": ["x", "y"], "t": ["z"]}


def test_plan_bounds_and_lines(spark):
    p = spark.createDataFrame([(0, 0.5, -3.2), (0, 21.0, 4.0), (1, None, 1.0)], "site long, x double, y double")
    b = Y.plan_bounds(p, "site").collect()
    assert [(r.x0, r.x1, r.y0, r.y1, round(r.mpp, 6), r.height_px) for r in b] == [(-1, 22, -5, 5, 0.023, 435)]
    lines = {(r.axis, r["at"]): round(r.px, 3) for r in Y.grid_lines(Y.plan_bounds(p, "site"), "site").collect()}
    assert lines == {("x", 0): round(1 / 0.023, 3), ("x", 10): round(11 / 0.023, 3), ("x", 20): round(21 / 0.023, 3), ("y", 0): round(5 / 0.023, 3)}


@pytest.mark.parametrize("wide", [72, 360, 1000])
def test_a_peak_stands_out_on_fine_bins_too(wide):
    """Edges a degree wide, so that neighbouring bins are alike; a mirrored picture fits less."""
    rng = np.random.default_rng(4)
    fine = rng.random((5, 361))
    fine[:, -1] = fine[:, 0]
    a = np.stack([np.interp(np.arange(wide) / wide * 360, np.arange(361), row) for row in fine])
    b = np.roll(a, 2, 1) + 0.001 * rng.random((5, wide))
    shift, peak, ratio = Y.correlate(a, b)
    assert abs(shift - 2) < 0.5 and peak > 0.99 and ratio > 1.1
    assert Y.correlate(a[:, ::-1], b)[1] < 0.9 * peak


def test_renderings_that_line_up(spark):
    rng = np.random.default_rng(3)
    a = rng.random((90, 360))
    a = sum(np.roll(np.roll(a, i, 0), j, 1) for i in range(-2, 3) for j in range(-1, 2)) / 15
    full = a.copy()
    a[:6] = np.nan  # not rendered
    down = np.concatenate([rng.random((2, 360)), full[:-2]])
    mirrored = a[:, ::-1]
    cases = {1: (a, full, mirrored), 2: (a, np.roll(full, 5, 1), mirrored), 3: (mirrored, full, a), 4: (a, down, mirrored), 5: (a, rng.random((90, 360)), mirrored)}
    null = lambda m: [[None if np.isnan(v) else float(v) for v in row] for row in m]
    df = spark.createDataFrame([(k, *map(null, v)) for k, v in cases.items()], "scan long, render array<array<double>>, photo array<array<double>>, mirror array<array<double>>")
    got = {r.scan: r for r in Y.reprojection(df, "scan").collect()}
    assert got[1].ok and abs(got[1].yaw_shift) < 0.1 and abs(got[1].pitch_shift) < 0.1 and got[1].ratio > 1.1
    assert not got[2].ok and abs(got[2].yaw_shift - 5) < 0.1
    assert got[3].mirrored and not got[3].ok
    assert not got[4].ok and abs(got[4].pitch_shift + 4.0) < 0.3 and abs(got[4].yaw_shift) < 0.3
    assert not got[5].ok


def test_tilt_does_not_wrap():
    rng = np.random.default_rng(6)
    a = rng.random((80, 90))
    for d in (-3, 0, 2):
        b = rng.random((80, 90))
        b[max(d, 0) : 80 + min(d, 0)] = a[max(-d, 0) : 80 - max(d, 0)]
        assert abs(Y.tilted(a, b, 0, 5) - d) < 0.2
    assert abs(Y.tilted(a, np.roll(a, 9, 1), 9, 5)) < 0.2


def test_any_split_of_patches_gives_the_batch_result(spark, folder):
    at = datetime.datetime(2026, 1, 1)
    day = datetime.date(2025, 12, 1)
    base = spark.createDataFrame([(k, 7, "repair", "open", "Work", day, "Ann", None, None, "field-app", 1, at, at) for k in (1, 2, 3)],
                                 "id long, instanceId long, kind string, status string, title string, performedAt date, performedBy string, result string, nextDueAt date, source string, version int, createdAt timestamp, updatedAt timestamp")
    base.write.parquet(f"{folder}/base")
    devices = spark.createDataFrame([(7, 12)], "id long, maintenanceIntervalMonths int")
    # a chain of three versions of entry 1, a stale one, a repeat; a faulty one of entry 2, then one that stands; one of no entry
    rows = [(1, "done", "ok", 1), (1, None, "remarks", 2), (2, "done", None, 1), (1, None, "fault", 2), (1, None, "fault", 3), (2, "done", "ok", 1), (9, "done", "ok", 1), (1, None, "fault", 3)]
    kind = "ord long, id long, status string, result string, base int"
    patches = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], kind)
    order = ["id", "ord", "outcome", "version"]
    log, answers = log_and_answers = M.apply_patches(base, patches, devices, "2026-01-02 00:00:00", "2026-01-02")
    want = [sorted(map(tuple, x.select(*c).collect())) for x, c in zip(log_and_answers, (["id", "status", "result", "version"], order), strict=True)]
    assert want[0] == [(1, "done", "fault", 4), (2, "done", "ok", 2), (3, "open", None, 1)]
    assert [o for _, _, o, _ in sorted(want[1], key=lambda x: x[1])] == ["applied", "applied", "invalid", "conflict", "applied", "applied", "not_found", "conflict"]
    for n, cuts in enumerate(([], [4], [1, 2, 3, 4, 5, 6, 7], [2, 5])):
        here = f"{folder}/split{n}"
        for k, (a, z) in enumerate(itertools.pairwise([0, *cuts, len(rows)])):
            patches.where(F.col("ord").between(a, z - 1)).coalesce(1).write.parquet(f"{here}/in/part={k}")
            stream = spark.readStream.schema(patches.schema).parquet(f"{here}/in/*")
            streamed.upsert_batches(stream, f"{folder}/base", devices, f"{here}/out", f"{here}/check", "2026-01-02 00:00:00", "2026-01-02").awaitTermination()
        assert len(os.listdir(f"{here}/out/changes")) >= len(cuts) + 1
        now = streamed.current(spark, f"{folder}/base", f"{here}/out")
        assert now.columns == base.columns and sorted(map(tuple, now.select("id", "status", "result", "version").collect())) == want[0]
        assert sorted(map(tuple, spark.read.parquet(f"{here}/out/answers").select(*order).collect())) == want[1]


def test_alert_when_a_due_date_passes(spark, folder):
    """Device 1's date passes; device 2's is replaced by a later one in time; device 3's is taken away."""
    T = lambda text: datetime.datetime.fromisoformat(text)
    parts = [[(1, T("2026-01-01"), T("2026-03-01")), (2, T("2026-01-01"), T("2026-03-01")), (3, T("2026-01-01"), T("2026-03-01"))],
             [(2, T("2026-02-01"), T("2027-02-01")), (3, T("2026-02-01"), None)], [(4, T("2026-06-01"), None)], [(4, T("2026-06-02"), None)]]
    schema = "instanceId long, ts timestamp, nextDueAt timestamp"
    keep = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass",)}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k, rows in enumerate(parts):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/part={k}")
            alerts = streamed.overdue_alerts(spark.readStream.schema(schema).parquet(f"{folder}/in/*"), "1 day")
            alerts.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    assert [tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()] == [(1, T("2026-03-01"))]


def test_every_query_gives_rows(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and entry.entry(spark).count() > 0
    from sightline.plans import registry

    empty = [n for n, f in registry.QUERIES.items() if f(spark, "/root/testdata/sf0.01").limit(1).count() == 0]
    assert not empty
