"""Room layout on grids: rectangles, contours, cabinet rows, views and correlation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.expressions import half_up
from sightline.operators.spatial import SIDES, gap_groups, labelled, lines
from sightline.sources.shared import kept


def _mask(pdf: pd.DataFrame) -> tuple[np.ndarray, int, int]:
    ix, iy = pdf["ix"].to_numpy(), pdf["iy"].to_numpy()
    m = np.zeros((iy.max() - iy.min() + 1, ix.max() - ix.min() + 1), bool)
    m[iy - iy.min(), ix - ix.min()] = True
    return m, int(ix.min()), int(iy.min())


class Rectangles:
    """Largest all-true rectangles of a mask, one after the other. For each row the best one that stands on it is kept, and
    worked out anew only where a removal changed the heights above the row."""

    def __init__(self, mask: np.ndarray, side: int = 1):
        self.mask, self.side = mask, side
        self.heights = np.zeros(mask.shape, int)
        self.best: list[tuple[int, int, int, int, int]] = [(0, 0, 0, 0, 0)] * len(mask)  # area, then rows and columns
        self.refresh(0)

    def refresh(self, top: int) -> None:
        above = self.heights[top - 1] if top else np.zeros(self.mask.shape[1], int)
        for r in range(top, len(self.mask)):
            h = np.where(self.mask[r], above + 1, 0)
            if r > top and (h == self.heights[r]).all() and self.best[r][0]:
                break
            self.heights[r] = above = h
            self.best[r] = self.standing(r, h.tolist())

    def standing(self, r: int, h: list[int]) -> tuple[int, int, int, int, int]:
        best, stack = (0, 0, 0, 0, 0), []
        for c, now in enumerate([*h, 0]):
            left = c
            while stack and stack[-1][1] >= now:
                left, top = stack.pop()
                if top >= self.side and c - left >= self.side and top * (c - left) > best[0]:
                    best = (top * (c - left), r - top + 1, r + 1, left, c)
            stack.append((left, now))
        return best

    def take(self) -> tuple[int, int, int, int] | None:
        """(row0, row1, col0, col1), ends exclusive, of the largest left, which is removed; the first found on ties."""
        area, r0, r1, c0, c1 = max(self.best, key=lambda b: b[0], default=(0,))
        if not area:
            return None
        self.mask[r0:r1, c0:c1] = False
        self.refresh(r0)
        return r0, r1, c0, c1


def largest(mask: np.ndarray, side: int = 1) -> tuple[int, int, int, int] | None:
    """The largest all-true rectangle with no side under ``side`` cells."""
    return Rectangles(mask.copy(), side).take()


def rectangles(cells: DataFrame, room: str, least: int = 1, side: int = 1) -> DataFrame:
    """Greedy decomposition of each room's mask into rectangles, largest first: (room, n, ix0, ix1, iy0, iy1, area).

    It ends where no rectangle of ``least`` cells, with no side under ``side`` cells, is left; by default all cells are
    covered."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, x0, y0 = _mask(pdf)
        rows, left = [], Rectangles(m, side)
        while (b := left.take()) is not None:
            r0, r1, c0, c1 = b
            if (r1 - r0) * (c1 - c0) < least:
                break
            rows.append((pdf[room].iloc[0], len(rows) + 1, x0 + c0, x0 + c1 - 1, y0 + r0, y0 + r1 - 1, (r1 - r0) * (c1 - c0)))
        return pd.DataFrame(rows, columns=[room, "n", "ix0", "ix1", "iy0", "iy1", "area"])

    return cells.select(room, "ix", "iy").groupBy(room).applyInPandas(run, f"{room} long, n long, ix0 long, ix1 long, iy0 long, iy1 long, area long")


def trace(mask: np.ndarray) -> list[list[tuple[int, int]]]:
    """Closed rings of cell corners around the true cells, with the inside to the left of each step; straight runs are
    one edge. Outer rings turn one way, holes the other."""
    edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
    p = np.pad(mask, 1)
    for r, c in zip(*np.nonzero(mask), strict=True):
        r, c = int(r), int(c)
        for a, b, empty in (((c, r), (c + 1, r), not p[r, c + 1]), ((c + 1, r), (c + 1, r + 1), not p[r + 1, c + 2]),
                            ((c + 1, r + 1), (c, r + 1), not p[r + 2, c + 1]), ((c, r + 1), (c, r), not p[r + 1, c])):
            if empty:
                edges.setdefault(a, []).append(b)
    rings = []
    while edges:
        start = min(edges)
        ring, at, before = [start], start, None
        while True:
            nexts = edges[at]
            if len(nexts) > 1 and before is not None:  # at a corner shared by two cells turn towards the own cell
                d = (at[0] - before[0], at[1] - before[1])
                nexts.sort(key=lambda q: -(d[0] * (q[1] - at[1]) - d[1] * (q[0] - at[0])))
            q = nexts.pop(0)
            if not nexts:
                del edges[at]
            if q == start:
                break
            before, at = at, q
            ring.append(q)
        n = len(ring)
        rings.append([ring[k] for k in range(n) if not ((ring[k - 1][0] == ring[k][0] == ring[(k + 1) % n][0]) or (ring[k - 1][1] == ring[k][1] == ring[(k + 1) % n][1]))])
    return rings


def straightened(ring: np.ndarray, least: float) -> np.ndarray:
    """A ring of right-angled corners without sides shorter than ``least``: the shortest goes first, and the two sides it
    joins, which are parallel, move to the mean of their places, weighted by their lengths. Four corners stay."""
    p = np.asarray(ring, float)
    while len(p) > 4:
        side = np.abs(np.roll(p, -1, 0) - p).sum(1)  # of each corner to the next
        k = int(np.argmin(side))
        if side[k] >= least:
            break
        n = len(p)
        before, after = side[k - 1], side[(k + 1) % n]
        axis = int(np.argmax(np.abs(p[(k + 1) % n] - p[k]))) if side[k] else int(np.argmin(np.abs(p[k] - p[k - 1])))
        at = (before * p[k, axis] + after * p[(k + 1) % n, axis]) / (before + after) if before + after > 0 else p[k, axis]
        p[k - 1, axis] = p[(k + 2) % n, axis] = at
        p = np.delete(p, [k, (k + 1) % n], axis=0)
    return p


def area_of(ring: np.ndarray) -> float:
    return float((ring[:, 0] * np.roll(ring[:, 1], -1) - np.roll(ring[:, 0], -1) * ring[:, 1]).sum() / 2)


def inset(ring: list[tuple[int, int]], by: float) -> np.ndarray:
    """A traced ring with each side moved towards the cells, which lie to its left."""
    p = np.array(ring, float)
    step = np.sign(np.roll(p, -1, 0) - p)  # of the side that begins at each corner
    moved = p + by * np.stack([-step[:, 1], step[:, 0]], 1)
    flat = step[:, 0] != 0  # this side gives y, and the one before it x
    before = np.roll(moved, 1, 0)
    return np.stack([np.where(flat, before[:, 0], moved[:, 0]), np.where(flat, moved[:, 1], before[:, 1])], 1)


def holds(ring: np.ndarray, x: float, y: float) -> bool:
    """Whether a ring goes round a point that isn't on it."""
    p, q = ring, np.roll(ring, -1, 0)
    across = (p[:, 1] > y) != (q[:, 1] > y)
    at = p[:, 0] + (y - p[:, 1]) / np.where(across, q[:, 1] - p[:, 1], 1) * (q[:, 0] - p[:, 0])
    return bool((across & (at > x)).sum() % 2)


def outlined(mask: np.ndarray, place, least_edge: float, step: float | None, least_area: float, up: float | None) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Polygons of a mask, each with its holes. ``place`` turns corners of cells to metres; ``up``: sides lie in the middle
    of cells divided so often, not on their edges. Rings of less than ``least_area`` are left out, those outside with
    their holes."""
    def tidy(ring: list[tuple[int, int]]) -> np.ndarray:
        q = straightened(place(inset(ring, 0.5 / up) if up else np.array(ring, float)), least_edge)
        return straightened(np.round(q / step) * step, 1e-6) if step else q

    outer, inner = [], []
    for ring in trace(mask):
        q = tidy(ring)
        a = area_of(np.array(ring, float))
        if abs(area_of(q)) > 0 and abs(area_of(q)) >= least_area:
            (outer if a > 0 else inner).append((abs(a), ring, q))
        elif a > 0:
            outer.append((a, ring, None))
    outer.sort(key=lambda o: o[0])
    holes: list[list[np.ndarray]] = [[] for _ in outer]
    for _, ring, q in inner:
        (x, y), (u, v) = ring[0], ring[1]
        x, y = (x + u) / 2 - np.sign(v - y) / 2, (y + v) / 2 + np.sign(u - x) / 2  # in a cell beside its first side
        for k, (_, r, _) in enumerate(outer):
            if holds(np.array(r, float), x + 1e-3, y + 1e-3):
                holes[k].append(q)
                break
    return [(q, holes[k]) for k, (_, _, q) in enumerate(outer) if q is not None]


def contours(cells: DataFrame, room: str, size: float = 1.0, least_edge: float = 0.0, step: float | None = None, least_area: float = 0.0) -> DataFrame:
    """Rings of each room's mask in metres, for cells of ``size``: (room, ring, corners, area, points); the area of a hole
    is negative. Sides under ``least_edge`` are straightened, corners snapped to multiples of ``step``, and rings of less
    than ``least_area`` left out."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, x0, y0 = _mask(pdf)
        rows = []
        for ring in trace(m):
            q = straightened((np.array(ring) + (x0, y0)) * size, least_edge)
            if step:
                q = straightened(np.round(q / step) * step, 1e-6)
            a = area_of(q)
            if abs(a) > 0 and abs(a) >= least_area:
                rows.append((pdf[room].iloc[0], len(rows) + 1, len(q), a, q.tolist()))
        return pd.DataFrame(rows, columns=[room, "ring", "corners", "area", "points"])

    return cells.select(room, "ix", "iy").groupBy(room).applyInPandas(run, f"{room} long, ring long, corners long, area double, points array<array<double>>")


POLYGON = "polygon long, area double, points array<array<double>>, holes array<array<array<double>>>"


def polygon_rows(found: list[tuple[np.ndarray, list[np.ndarray]]]) -> list[tuple]:
    """(number, area without holes, ring, rings of holes), largest first."""
    rows = [(abs(area_of(q)) - sum(abs(area_of(h)) for h in hs), np.round(q, 3).tolist(), [np.round(h, 3).tolist() for h in hs]) for q, hs in found]
    rows.sort(key=lambda r: (-r[0], r[1]))
    return [(k, *r) for k, r in enumerate(rows, 1)]


def polygons(cells: DataFrame, room: str, size: float = 1.0, least_edge: float = 0.0, step: float | None = None, least_area: float = 0.0, up: int = 2) -> DataFrame:
    """Polygons of each room's mask in metres, each with the holes in it: (room, polygon, area, points, holes). Sides go
    through the middle of the outermost cells' halves (``up`` parts of a cell). Straightening, snapping and least areas as
    in ``contours``; a room is one group."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, x0, y0 = _mask(pdf)
        found = outlined(m, lambda q: (q + (x0, y0)) * size, least_edge, step, least_area, up)
        return pd.DataFrame([(pdf[room].iloc[0], *r) for r in polygon_rows(found)], columns=[room, "polygon", "area", "points", "holes"])

    return cells.select(room, "ix", "iy").groupBy(room).applyInPandas(run, f"{room} long, {POLYGON}")


#: Fixed values of walls, in metres: thickness, how far evidence may lie outside and inside of a room's side, gap in it that
#: is still wall, shortest wall, distance at which a side lies on the bounds, what is cut beyond the thickness, least areas
#: of a piece of the ring and of a polygon, and grid.
WALL, OUTSIDE, INSIDE, BRIDGED, SHORTEST, AT_BOUNDS, BEYOND, PIECE_AREA, POLYGON_AREA, GRID = 0.15, 0.15, 0.4, 1.0, 0.5, 0.15, 0.02, 0.06, 0.03, 0.05


def sides_of(rings: DataFrame, room: str) -> DataFrame:
    """The sides of rooms' rings (room, ring, points): (room, ring, side, flat, at, lo, hi, inward). A ``flat`` side lies
    at y = ``at`` from x = ``lo`` to ``hi``, others at x; ``inward`` is the sign of the direction into the room."""
    after = F.concat(F.slice("points", F.lit(2), F.size("points") - 1), F.slice("points", 1, 1))
    twice = F.aggregate(F.zip_with("points", after, lambda p, q: p[0] * q[1] - q[0] * p[1]), F.lit(0.0), lambda a, x: a + x)
    s = rings.select(room, "ring", F.signum(twice).alias("turn"), F.posexplode(F.arrays_zip(F.col("points").alias("p"), after.alias("q"))).alias("side", "s"))
    x0, y0, x1, y1 = (F.col("s")[e][i] for e in "pq" for i in (0, 1))
    flat = F.abs(y0 - y1) < 1e-6
    # along +x a ring that turns left has the room above it, along +y to its left
    inward = F.col("turn") * F.when(flat, F.signum(x1 - x0)).otherwise(-F.signum(y1 - y0))
    return s.select(room, "ring", "side", flat.alias("flat"), F.when(flat, y0).otherwise(x0).alias("at"), F.when(flat, F.least(x0, x1)).otherwise(F.least(y0, y1)).alias("lo"),
                    F.when(flat, F.greatest(x0, x1)).otherwise(F.greatest(y0, y1)).alias("hi"), inward.cast("int").alias("inward"))


def wall_intervals(sides: DataFrame, tall: DataFrame, bounds: DataFrame, room: str, size: float) -> DataFrame:
    """Where the sides of rooms have walls, and where they are open: (room, ring, side, wall, s0, s1), metres along a side.

    A side is gone through in steps of ``size``. A step has evidence if a cell of ``tall`` (room, ix, iy: columns of the
    height of a wall) lies between OUTSIDE and INSIDE of it. Gaps of less than BRIDGED are closed, those at the ends
    too, and then walls shorter than SHORTEST dropped. A side on the room's ``bounds`` (room, x0, x1, y0, y1) is where the
    scan ends: open, a thickness beyond its ends too. Cells meet steps by equality, a few for each step.
    """
    gap, least, whole = int(BRIDGED / size + 1e-9), int(SHORTEST / size + 1e-9), F.col("at")
    near = lambda a, b: F.least(F.abs(whole - F.col(a)), F.abs(whole - F.col(b))) < AT_BOUNDS
    s = sides.join(bounds, room, "left").withColumn("cut", F.coalesce(F.when(F.col("flat"), near("y0", "y1")).otherwise(near("x0", "x1")), F.lit(False)))
    s = s.select(room, "ring", "side", "flat", "at", "lo", "hi", "inward", "cut", F.ceil((F.col("hi") - F.col("lo")) / size - 1e-9).alias("n"))
    first = lambda v: F.floor(v / size + 1e-6).cast("long")
    last = lambda v: (F.ceil(v / size - 1e-6) - 1).cast("long")
    k = s.where("not cut").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k")).withColumn("from", F.col("lo") + F.col("k") * size)
    out, into = F.col("at") - F.col("inward") * OUTSIDE, F.col("at") + F.col("inward") * INSIDE
    k = k.withColumn("a", F.explode(F.sequence(first(F.col("from")), last(F.col("from") + size)))).withColumn("b", F.explode(F.sequence(first(F.least(out, into)), last(F.greatest(out, into)))))
    k = k.withColumn("ix", F.when(F.col("flat"), F.col("a")).otherwise(F.col("b"))).withColumn("iy", F.when(F.col("flat"), F.col("b")).otherwise(F.col("a")))
    key = [room, "ring", "side"]
    hit = k.join(tall.select(room, "ix", "iy"), [room, "ix", "iy"], "left_semi").select(*key, "k").distinct()
    ends = s.where("not cut").select(*key, F.explode(F.array(F.lit(-1).cast("long"), F.col("n"))).alias("k"))
    # a run goes on over gaps of fewer than ``gap`` steps; beyond both ends there is wall
    w = Window.partitionBy(*key).orderBy("k")
    runs = hit.unionByName(ends).withColumn("new", F.when(F.col("k") - F.lag("k").over(w) > gap, 1).otherwise(0)).withColumn("run", F.sum("new").over(w))
    runs = runs.groupBy(*key, "run").agg(F.min("k").alias("a"), F.max("k").alias("b")).join(s.select(*key, "n"), key)
    runs = runs.select(*key, F.greatest("a", F.lit(0)).alias("a"), (F.least(F.col("b"), F.col("n") - 1) + 1).alias("b")).where(F.col("b") - F.col("a") >= F.greatest(F.lit(least), F.lit(1)))
    each = runs.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("walls"))
    s = s.join(each, key, "left").withColumn("walls", F.coalesce("walls", F.array().cast("array<struct<a:bigint,b:bigint>>")))
    zero = F.lit(0).cast("long")
    starts, stops = F.concat(F.array(zero), F.transform("walls", lambda x: x["b"])), F.concat(F.transform("walls", lambda x: x["a"]), F.array(F.col("n")))
    opened = F.filter(F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["a"] < x["b"])
    flagged = lambda xs, is_wall: F.transform(xs, lambda x: F.struct(F.lit(is_wall).alias("wall"), x["a"].alias("a"), x["b"].alias("b")))
    s = s.select(*key, "lo", "hi", "n", "cut", F.explode(F.concat(flagged(F.col("walls"), True), flagged(opened, False))).alias("x"))
    more = F.when(F.col("cut"), WALL + BEYOND).otherwise(0.0)
    place = lambda c, end, edge, sign: F.when(F.col(f"x.{c}") == end, F.col(edge) + sign * more).otherwise(F.col("lo") + F.col(f"x.{c}") * size)
    return s.select(*key, "x.wall", place("a", zero, "lo", -1).alias("s0"), place("b", F.col("n"), "hi", 1).alias("s1"))


def wall_polygons(sides: DataFrame, intervals: DataFrame, room: str, partitions: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Walls of rooms as polygons: (room, polygon, area, points, holes). A wall of fixed thickness goes round each room
    outside; what is open is cut out of it, small pieces go, ``partitions`` are put in, and where ``rows`` of cabinets stand
    there is no wall (both room, x0, x1, y0, y1).

    Pieces are composed on the lines that their own sides make, so joints and corners are exact; a room is one group of as
    many rows as its outline has sides and openings.
    """
    flat = F.col("flat")
    key = [room, "ring", "side"]
    shape = lambda df, kind: df.select(room, F.lit(kind).alias("kind"), F.lit(0).alias("ring"), F.lit(True).alias("flat"), *(F.col(c).cast("double").alias(c) for c in ("x0", "x1", "y0", "y1")))

    def boxed(df: DataFrame, kind: str, s0: Column, s1: Column, n0: Column, n1: Column) -> DataFrame:
        xs, ys = (F.when(flat, s0).otherwise(n0), F.when(flat, s1).otherwise(n1)), (F.when(flat, n0).otherwise(s0), F.when(flat, n1).otherwise(s1))
        return df.select(room, F.lit(kind).alias("kind"), "ring", "flat", F.least(*xs).alias("x0"), F.greatest(*xs).alias("x1"), F.least(*ys).alias("y0"), F.greatest(*ys).alias("y1"))

    at, out = F.col("at"), lambda far: F.col("at") - F.col("inward") * far
    every = boxed(sides, "side", F.col("lo"), F.col("hi"), at, at).unionByName(boxed(sides, "band", F.col("lo") - WALL, F.col("hi") + WALL, at, out(WALL)))
    openings = intervals.where("not wall").join(sides, key)
    every = every.unionByName(boxed(openings, "open", F.col("s0"), F.col("s1"), at, out(WALL + BEYOND)))
    for df, kind in ((partitions, "partition"), (rows, "row")):
        if df is not None:
            every = every.unionByName(shape(df.join(sides.select(room).distinct(), room, "left_semi"), kind))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xs, ys = (np.unique(np.round(pdf[[f"{c}0", f"{c}1"]].to_numpy(), 6)) for c in "xy")
        box = {k: [(slice(*np.searchsorted(ys, np.round([r.y0, r.y1], 6))), slice(*np.searchsorted(xs, np.round([r.x0, r.x1], 6)))) for r in g.itertuples()] for k, g in pdf.groupby("kind")}
        shape = (max(len(ys) - 1, 1), max(len(xs) - 1, 1))
        room_, wall = np.zeros(shape, bool), np.zeros(shape, bool)
        for r in pdf[(pdf["kind"] == "side") & ~pdf["flat"]].itertuples():  # cells right of an odd number of sides are in
            a, b = np.searchsorted(ys, np.round([r.y0, r.y1], 6))
            room_[a:b, np.searchsorted(xs, round(r.x0, 6)):] ^= True
        for b in box.get("band", []):
            wall[b] = True
        wall &= ~room_
        for b in box.get("open", []):
            wall[b] = False
        area = np.outer(np.diff(ys), np.diff(xs))
        wall = grouped_mask(wall, area, PIECE_AREA)
        for b in box.get("partition", []):
            wall[b] = True
        for b in box.get("row", []):
            wall[b] = False
        found = outlined(wall, lambda q: np.stack([xs[q[:, 0].astype(int)], ys[q[:, 1].astype(int)]], 1), GRID, GRID, POLYGON_AREA, None)
        return pd.DataFrame([(pdf[room].iloc[0], *r) for r in polygon_rows(found)], columns=[room, "polygon", "area", "points", "holes"])

    return every.groupBy(room).applyInPandas(run, f"{room} long, {POLYGON}")


def grouped_mask(mask: np.ndarray, area: np.ndarray, least: float) -> np.ndarray:
    """The mask without groups of neighbouring cells (four sides) that cover less than ``least``."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        p = np.pad(label, 1)
        most = np.where(mask, np.maximum.reduce([label, p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]), 0)
        if (most == label).all():
            break
        label = most
    covered = np.bincount(label.ravel(), weights=np.where(mask, area, 0).ravel(), minlength=mask.size + 1)
    return mask & (covered[label] >= least - 1e-9)


#: Fixed values of boxes: least side and area, boxes of a component at most, quantile of the heights, least height, height
#: below which one is low, distance from a wall at which it stands against it.
BOX_SIDE, BOX_AREA, BOXES, BOX_QUANTILE, BOX_LEAST, BOX_LOW, AGAINST = 0.3, 0.12, 10, 75, 0.2, 0.6, 0.15


def in_groups(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each key, which follow one another, as a table; no more than a key and a batch are held."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        parts = [x for c in keys for x in (b.column(c).is_null().to_numpy(zero_copy_only=False), b.column(c).fill_null(0).to_numpy())]
        new = np.flatnonzero(np.any([p[1:] != p[:-1] for p in parts], axis=0)) + 1
        for start, end in zip([0, *new], [*new, b.num_rows], strict=True):
            key = tuple(p[start] for p in parts)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def boxes(cells: DataFrame, room: str, size: float, components, sides: DataFrame | None = None) -> DataFrame:
    """What stands in rooms as boxes along the axes: (room, component, n, kind, height, xa, xb, ya, yb).

    ``cells`` (room, ix, iy, height; null where no solid was measured) are joined to components (four neighbours), each of
    which is taken apart into its largest rectangles, ten at most, as long as they have the least area and sides; a box is
    as high as three quarters of its cells reach. One that stands just off a side of its room stands against it. A
    component, not a room, is held at a time.
    """
    node = labelled(cells.groupBy(room, "ix", "iy").agg(F.max("height").alias("height")), room, components)
    least = int(np.ceil(BOX_SIDE / size - 1e-9))

    def run(cells: pa.Table) -> Iterator[tuple]:
        m, x0, y0 = _mask(cells)
        high = np.full(m.shape, np.nan)
        high[cells["iy"].to_numpy() - y0, cells["ix"].to_numpy() - x0] = cells["height"].to_numpy()
        key, left = [cells[c][0].as_py() for c in (room, "cx", "cy")], Rectangles(m, least)
        for n in range(1, BOXES + 1):
            b = left.take()
            if b is None or (b[1] - b[0]) * (b[3] - b[2]) * size * size < BOX_AREA - 1e-9:
                break
            r0, r1, c0, c1 = b
            h = high[r0:r1, c0:c1]
            h = h[np.isfinite(h)]
            if h.size < 4:
                continue
            top = max(on_grid(float(np.percentile(h, BOX_QUANTILE))), BOX_LEAST)
            yield *key, n, "low" if top < BOX_LOW else "equipment", top, *(on_grid(v * size) for v in (x0 + c0, x0 + c1, y0 + r0, y0 + r1))

    names = (room, "cx", "cy", "n", "kind", "height", "xa", "xb", "ya", "yb")
    kinds = (pa.int64(),) * 4 + (pa.string(),) + (pa.float64(),) * 5

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for one in in_groups(batches, (room, "cx", "cy")) for r in run(one))
        while some := list(islice(rows, 1000)):
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*some, strict=True), kinds, strict=True)], names=names)

    # a room has many components of a few cells, which as groups of Spark's own cost more than their boxes
    dealt = node.select(room, F.col("root.ix").alias("cx"), F.col("root.iy").alias("cy"), "ix", "iy", F.col("height").cast("double")).repartition(room, "cx", "cy").sortWithinPartitions(room, "cx", "cy")
    cut = dealt.mapInArrow(stream, f"{room} long, cx long, cy long, n long, kind string, height double, xa double, xb double, ya double, yb double")
    if sides is None:
        return cut
    line = sides.groupBy(room).agg(F.array_sort(F.collect_list(F.struct("ring", "side", "flat", "at", "lo", "hi"))).alias("sides"))
    b = cut.join(line, room, "left")
    moved = lambda edge, at, sign: (sign * (at - edge) > 0) & (sign * (at - edge) <= AGAINST + 1e-9)

    def stood(s: Column, x: Column) -> Column:
        beside = F.when(x["flat"], (x["lo"] <= s["xb"]) & (x["hi"] >= s["xa"])).otherwise((x["lo"] <= s["yb"]) & (x["hi"] >= s["ya"]))
        new = {}
        for low, high, axis in (("xa", "xb", ~x["flat"]), ("ya", "yb", x["flat"])):
            to_high = beside & axis & moved(s[high], x["at"], 1)
            new[high] = F.when(to_high, x["at"]).otherwise(s[high])
            new[low] = F.when(beside & axis & ~to_high & moved(s[low], x["at"], -1), x["at"]).otherwise(s[low])
        return F.struct(*(new[c].alias(c) for c in ("xa", "xb", "ya", "yb")))

    s = F.aggregate(F.coalesce("sides", F.array().cast(dict(line.dtypes)["sides"])), F.struct("xa", "xb", "ya", "yb"), stood)
    return b.withColumn("s", s).select(room, "cx", "cy", "n", "kind", "height", *(F.round(f"s.{c}", 3).alias(c) for c in ("xa", "xb", "ya", "yb")))


#: Fixed values of cabinet rows, in metres: gap between rows, room left beside the outer devices, longest walk, gap a walk
#: may cross, depth where none is measured and largest depth, least height and cut, range of panel widths and width
#: without neighbours, grid of all results.
ROW_GAP, BESIDE, WALK, CROSSED, DEPTH, DEEPEST, LOW, CUT = 0.25, 0.3, 12.0, 0.24, 0.8, 2.6, 1.0, 2.6
NARROW, WIDE, ALONE, SNAP = 0.6, 1.2, 0.8, 0.05
#: Devices nearer than this along a row stand above each other; times its width that a stretch must have to be divided; a
#: narrower panel goes with its neighbour.
STACKED, LONG, LEAST_PANEL = 0.3, 1.4, 0.35


def on_grid(v: float) -> float:
    return round(round(v / SNAP) * SNAP, 3)


def snapped(v: Column) -> Column:
    return F.round(F.bround(v / SNAP) * SNAP, 3)


def fronts(devices: DataFrame, room: str) -> DataFrame:
    """Devices (room, id, x, y, side) with the row they stand in: those that face one side and follow each other within
    ROW_GAP, measured towards the side (``u``), are one; ``s`` runs along the row, a quarter turn left of the side."""
    toward = F.element_at(F.create_map(*(x for name, fx, fy in SIDES for x in (F.lit(name), F.array(F.lit(fx), F.lit(fy))))), F.col("side"))
    d = devices.withColumn("toward", toward).withColumns({"fx": F.col("toward")[0], "fy": F.col("toward")[1]})
    d = d.withColumns({"u": F.col("x") * F.col("fx") + F.col("y") * F.col("fy"), "s": F.col("y") * F.col("fx") - F.col("x") * F.col("fy")})
    d = gap_groups(d.withColumn("_at", F.struct(room, "side")), "_at", "u", ROW_GAP, "id")
    return d.select(room, "side", F.col("group").alias("row"), "id", "x", "y", "fx", "fy", "u", "s")


def strip_shares(strips: DataFrame, cells: DataFrame, room: str, size: float, key: list[str], masks: tuple[str, ...]) -> DataFrame:
    """Share of the cells in each strip of a row where each mask is set: (key..., masks...). A strip lies from ``s0`` to
    ``s1`` along the row and from ``n0`` to ``n1`` behind its ``front``; of the room's grid it takes the cells it touches."""
    x = lambda s, n: (F.col("front") - F.col(n)) * F.col("fx") - F.col(s) * F.col("fy")
    y = lambda s, n: (F.col("front") - F.col(n)) * F.col("fy") + F.col(s) * F.col("fx")
    w = strips
    for axis, at in (("x", x), ("y", y)):
        ends = at("s0", "n0"), at("s1", "n1")
        first = F.greatest(F.floor(F.least(*ends) / size + 1e-6), F.col(f"i{axis}0"))
        last = F.least(F.ceil(F.greatest(*ends) / size - 1e-6) - 1, F.col(f"i{axis}1"))
        w = w.withColumns({f"_{axis}a": first, f"_{axis}b": last})
    for axis in "xy":
        w = w.withColumn(f"i{axis}", F.explode_outer(F.when(F.col(f"_{axis}a") <= F.col(f"_{axis}b"), F.sequence(f"_{axis}a", f"_{axis}b"))))
    met = w.select(room, *key, "ix", "iy").join(cells.select(room, "ix", "iy", *masks), [room, "ix", "iy"], "left")
    return met.groupBy(room, *key).agg(*(F.avg(F.coalesce(F.col(m), F.lit(False)).cast("double")).alias(m) for m in masks))


def reached(rows: DataFrame, cells: DataFrame, room: str, size: float) -> DataFrame:
    """How far each row goes: (room, side, row, lo, hi). From BESIDE its outer devices it goes on strip by strip, WALK at
    most, while what lies behind the front looks like cabinets and shows no floor; it crosses places that don't, CROSSED at
    most, and ends where the room does."""
    key = ["side", "row", "sign", "k"]
    ends = F.array(*(F.struct(F.lit(sign).alias("sign"), e.alias("start")) for sign, e in ((-1, F.col("s_min") - BESIDE), (1, F.col("s_max") + BESIDE))))
    w = rows.select("*", F.explode(ends).alias("e")).select("*", "e.*").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(int(WALK / size + 1e-9) - 1))))
    near, far = (F.col("start") + F.col("sign") * (F.col("k") + j) * size for j in (0, 1))
    w = w.withColumns({"s0": F.least(near, far), "s1": F.greatest(near, far), "n0": F.lit(0.04)})
    front = strip_shares(w.withColumn("n1", F.lit(0.36)), cells, room, size, key, ("inside", "like"))
    aisle = strip_shares(w.withColumn("n1", F.lit(0.5)), cells, room, size, key, ("floor",))
    inside = F.col("inside") > 0.5
    j = front.join(aisle, [room, *key]).withColumn("fine", inside & (F.col("floor") <= 0.25) & (F.col("like") >= 0.6))
    upto = Window.partitionBy(room, "side", "row", "sign").orderBy("k")
    last = F.coalesce(F.max(F.when(F.col("fine"), F.col("k"))).over(upto), F.lit(-1))
    j = j.withColumn("last", last).withColumn("stop", ~F.col("fine") & (~inside | ((F.col("k") - F.col("last")) * size > CROSSED)))
    ended = j.groupBy(room, "side", "row", "sign").agg(F.coalesce(F.min_by("last", F.when(F.col("stop"), F.col("k"))), F.max("last")).alias("last"))
    far = ended.groupBy(room, "side", "row").agg(*(F.max(F.when(F.col("sign") == sign, (F.col("last") + 1) * size)).alias(n) for n, sign in (("before", -1), ("beyond", 1))))
    return rows.join(far, [room, "side", "row"]).withColumns({"lo": snapped(F.col("s_min") - BESIDE - F.col("before")), "hi": snapped(F.col("s_max") + BESIDE + F.col("beyond"))}).drop("before", "beyond")


def measured(rows: DataFrame, cells: DataFrame, room: str, size: float) -> DataFrame:
    """Rows (with lo, hi) with their ``depth`` and ``height``. Probes every 12 cm go from 30 cm behind the front to the
    first floor or the end of the room, and the median counts; a back that ends just short of the room's stands against
    it. The height is the 75th percentile of the tops in the first 30 cm."""
    key = ["side", "row"]
    steps = max(1, int(np.ceil((DEEPEST - 0.3) / size - 1e-9)))
    number = F.ceil((F.col("hi") - F.col("lo") - 0.2) / 0.12 - 1e-9).cast("int")
    p = rows.where(number > 0).withColumn("probe", F.explode(F.sequence(F.lit(0), number - 1))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    s0, n0 = F.col("lo") + 0.1 + F.col("probe") * 0.12, F.lit(0.3) + F.col("k") * size
    p = strip_shares(p.withColumns({"s0": s0, "s1": s0 + 0.12, "n0": n0, "n1": n0 + size}), cells, room, size, [*key, "probe", "k"], ("inside", "floor"))
    end = F.coalesce(F.min(F.when((F.col("inside") < 0.5) | (F.col("floor") >= 0.5), F.col("k"))), F.lit(steps))
    deep = p.groupBy(room, *key, "probe").agg((F.lit(0.3) + end * size).alias("n")).groupBy(room, *key).agg(F.percentile("n", 0.5).alias("depth"))
    r = rows.join(deep, [room, *key], "left").withColumn("depth", F.when(F.col("depth") < DEEPEST - 0.05, F.col("depth")).otherwise(DEPTH))
    middle, more = (F.col("lo") + F.col("hi")) / 2, F.col("depth") + F.col("k") * size
    q = r.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(int(np.ceil(0.25 / size - 1e-9)) - 1))))
    q = q.withColumns({"s0": middle - 0.2, "s1": middle + 0.2, "n0": more, "n1": more + size})
    back = strip_shares(q, cells, room, size, [*key, "k"], ("inside",)).where("inside < 0.5").groupBy(room, *key).agg(F.min("k").alias("wall"))
    r = r.join(back, [room, *key], "left").withColumn("depth", F.greatest(snapped(F.col("depth") + F.coalesce("wall", F.lit(0)) * size), F.lit(0.4))).drop("wall")
    # tops of the cells at the front
    at = cells.where("top is not null").join(r.select(room, *key, "fx", "fy", "front", "lo", "hi"), room)
    lies = lambda along, low, high: (F.col(along) + 1 > F.floor(low / size + 1e-6)) & (F.col(along) < F.ceil(high / size - 1e-6))
    u0, u1 = F.col("front") - 0.3, F.col("front")
    along = F.col("fx") != 0
    x0, x1 = (F.when(along, F.when(F.col("fx") > 0, u).otherwise(-v)).otherwise(F.when(F.col("fy") > 0, -b).otherwise(a)) for u, v, a, b in ((u0, u1, F.col("lo"), F.col("hi")), (u1, u0, F.col("hi"), F.col("lo"))))
    y0, y1 = (F.when(along, F.when(F.col("fx") > 0, a).otherwise(-b)).otherwise(F.when(F.col("fy") > 0, u).otherwise(-v)) for u, v, a, b in ((u0, u1, F.col("lo"), F.col("hi")), (u1, u0, F.col("hi"), F.col("lo"))))
    tops = at.where(lies("ix", x0, x1) & lies("iy", y0, y1)).groupBy(room, *key).agg(F.percentile("top", 0.75).alias("height"))
    height = snapped(F.least(F.greatest(F.coalesce("height", F.lit(2.2)), F.lit(LOW)), F.lit(CUT)))
    return r.join(tops, [room, *key], "left").withColumn("height", height)


def divided(rows: DataFrame, devices: DataFrame, room: str) -> DataFrame:
    """Panels of rows (with lo, hi): (room, side, row, panel, s0, s1). Devices that stand above each other share a panel; its
    borders lie half-way to the next, and where the row goes on beyond the outer ones, half a panel from them. Long
    stretches are divided evenly, and a panel narrower than LEAST_PANEL goes with the one before it."""
    key = [room, "side", "row"]
    d = gap_groups(devices.withColumn("_row", F.struct(*key)).drop("row"), "_row", "s", STACKED, "id").select(room, "side", F.col("_row.row").alias("row"), "group", "s")
    centre = d.groupBy(*key, "group").agg(F.avg("s").alias("c")).withColumn("before", F.lag("c").over(Window.partitionBy(*key).orderBy("c")))
    per = centre.groupBy(*key).agg(F.min("c").alias("first"), F.max("c").alias("last"), F.percentile(F.col("c") - F.col("before"), 0.5).alias("wide"), F.collect_list((F.col("c") + F.col("before")) / 2).alias("between"))
    per = per.withColumn("wide", F.when(F.col("wide").isNull(), ALONE).otherwise(F.least(F.greatest("wide", F.lit(NARROW)), F.lit(WIDE))))
    r = rows.select(*key, "lo", "hi").join(per, key)
    left, right = F.col("first") - F.col("wide") / 2, F.col("last") + F.col("wide") / 2
    none = F.array().cast("array<double>")
    border = F.array_sort(F.concat(F.array("lo", "hi"), "between", F.when(left - F.col("lo") >= BESIDE, F.array(left)).otherwise(none), F.when(F.col("hi") - right >= BESIDE, F.array(right)).otherwise(none)))
    r = r.withColumn("border", border)
    stretch = F.zip_with(F.slice("border", F.lit(1), F.size("border") - 1), F.slice("border", F.lit(2), F.size("border") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    r = r.select(*key, "wide", F.explode(stretch).alias("x")).select(*key, "wide", "x.*")
    parts = F.when(F.col("b") - F.col("a") > LONG * F.col("wide"), F.greatest(F.bround((F.col("b") - F.col("a")) / F.col("wide")), F.lit(1.0))).otherwise(1.0).cast("int")
    r = r.withColumn("parts", parts).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    end = lambda j: F.col("a") + (F.col("b") - F.col("a")) * (F.col("i") + j) / F.col("parts")
    each = r.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(end(0).alias("a"), end(1).alias("b")))).alias("parts"))
    narrow = lambda x: x["b"] - x["a"] < LEAST_PANEL

    def joined(done: Column, x: Column) -> Column:
        before = F.element_at(done, -1)
        both = F.array(F.struct(before["a"].alias("a"), x["b"].alias("b")))
        return F.when((F.size(done) > 0) & (narrow(x) | narrow(F.get(done, F.size(done) - 1))), F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), both)).otherwise(F.concat(done, F.array(x)))

    fold = F.aggregate("parts", F.array().cast("array<struct<a:double,b:double>>"), lambda done, x: F.when(F.size(done) == 0, F.array(x)).otherwise(joined(done, x)))
    return each.select(*key, F.posexplode(fold).alias("panel", "x")).select(*key, F.col("panel").cast("long").alias("panel"), snapped(F.col("x.a")).alias("s0"), snapped(F.col("x.b")).alias("s1"))


def cabinet_rows(devices: DataFrame, cells: DataFrame, room: str, size: float) -> DataFrame:
    """Panels of the cabinet rows of each room: (room, side, row, devices, front, depth, height, panel, s0, s1).

    ``front`` lies along the side's axis, ``s0`` and ``s1`` along the row (a quarter turn left of the side). ``devices``
    (room, id, x, y, side), ``cells`` (room, ix, iy, floor, solid, inside, top); a room without cells has no rows. Rows
    are taken out, walked and measured by joins of strips with cells, whatever the number of rows in a room.
    """
    d, rows = row_frames(devices, cells, room, size)
    return divided(rows, d, room).join(rows, [room, "side", "row"]).select(room, "side", "row", "devices", F.round("front", 2).alias("front"), "depth", "height", "panel", "s0", "s1")


def row_frames(devices: DataFrame, cells: DataFrame, room: str, size: float) -> tuple[DataFrame, DataFrame]:
    """Devices with their rows, and the rows with their ends, depth and height, written once."""
    typed = cells.select(room, "ix", "iy", "floor", "solid", "inside", (F.col("solid") | (F.col("inside") & ~F.col("floor"))).alias("like"), F.when(F.col("solid"), F.col("top").cast("double")).alias("top"))
    grid = typed.groupBy(room).agg(*(f(c).alias(f"{c}{n}") for c in ("ix", "iy") for n, f in ((0, F.min), (1, F.max))))
    d, _ = kept(fronts(devices, room), "fronts")
    rows = d.groupBy(room, "side", "row", "fx", "fy").agg(F.count("*").alias("devices"), F.percentile("u", 0.5).alias("front"), F.min("s").alias("s_min"), F.max("s").alias("s_max")).join(grid, room)
    rows, _ = kept(reached(rows, typed, room, size), "rows")
    rows, _ = kept(measured(rows, typed, room, size), "rows")
    return d, rows


def device_faces(devices: DataFrame, rows: DataFrame, room: str) -> DataFrame:
    """Where each device of a row (``fronts``) sits on its cabinets' face: (room, id, side, top, x, y). The face lies on the
    grid; ``rows`` have front and height."""
    j = devices.join(rows.select(room, "side", "row", "front", "height"), [room, "side", "row"])
    off = F.col("u") - snapped(F.col("front"))
    return j.select(room, "id", "side", F.col("height").alias("top"), *(F.round(F.col(c) - off * F.col(f"f{c}"), 3).alias(c) for c in "xy"))


def partitions(tall: DataFrame, room: str, size: float, least: float = 0.8, thickest: float = 0.5, wall: float = 0.15) -> DataFrame:
    """Straight partitions between rooms: (room, axis, x0, x1, y0, y1). Cells (room, ix, iy) of full height that lie in a
    run of at least ``least`` metres along an axis; neighbouring runs are one line, which is left out if it is thicker than
    ``thickest``; it becomes a wall of fixed thickness around its median."""
    from sightline.operators.cluster import components

    tall, _ = kept(tall.select(room, "ix", "iy"), "tall")  # read for either axis
    run = walls(tall, room, int(least / size)).select(room, "axis", "line", F.explode(F.sequence("start", "end")).alias("at"))
    cells = run.select(F.struct(room, "axis").alias("key"), F.col("line").alias("ix"), F.col("at").alias("iy"))
    one = labelled(cells, "key", components).groupBy("key", "root").agg(F.min("iy").alias("a"), F.max("iy").alias("b"), F.min("ix").alias("p"), F.max("ix").alias("q"), F.percentile("ix", 0.5).alias("mid"))
    one = one.where((F.col("q") - F.col("p") + 1) * size <= thickest).withColumn("centre", (F.col("mid") + 0.5) * size)
    ends = {"0": (F.col("a") * size, F.col("centre") - wall / 2), "1": ((F.col("b") + 1) * size, F.col("centre") + wall / 2)}
    flat = F.col("key.axis") == "x"
    return one.select(f"key.{room}", "key.axis", *(F.when(flat, u if c == "x" else v).otherwise(v if c == "x" else u).alias(f"{c}{n}") for c in "xy" for n, (u, v) in ends.items()))


def walls(cells: DataFrame, room: str, least: int) -> DataFrame:
    """Straight wall evidence: runs of at least ``least`` tall cells along x or y (room, axis, line, start, end)."""
    c = cells.select(room, "ix", "iy").distinct()
    runs = [lines(c, room, along).where(F.col("end") - F.col("start") + 1 >= least).select(room, F.lit(along[1]).alias("axis"), "line", "start", "end") for along in ("ix", "iy")]
    return runs[0].unionByName(runs[1])


def as_rectangle(ring: Column) -> Column:
    """(xa, ya, xb, yb) of a ring of (x, y) points that is a rectangle along the axes, else null: four corners on two x and
    two y values, and no diagonal side."""
    xs, ys = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    onward = F.concat(F.slice(ring, 2, 3), F.slice(ring, 1, 1))
    straight = F.forall(F.zip_with(ring, onward, lambda a, b: (a[0] == b[0]) | (a[1] == b[1])), lambda x: x)
    two = (F.size(F.array_distinct(xs)) == 2) & (F.size(F.array_distinct(ys)) == 2)
    box = F.struct(F.array_min(xs).alias("xa"), F.array_min(ys).alias("ya"), F.array_max(xs).alias("xb"), F.array_max(ys).alias("yb"))
    return F.when((F.size(ring) == 4) & two & straight, box)


def is_rectangle(ring: Column) -> Column:
    return as_rectangle(ring).isNotNull()


#: Vertical field of view, horizontal stretch, yaw step and pitches of each set of virtual views.
VIEW_SETS = ((90, 1.0, 45, (0,)), (45, 1.0, 30, (0, 20)), (45, 2.0, 14, (0, 20)), (45, 3.5, 8, (0, 20)))


def view_grid(scans: DataFrame, sets: tuple = VIEW_SETS) -> DataFrame:
    """Virtual views of each scan: every yaw step at every pitch of each set."""
    out = None
    for k, (fov, stretch, step, pitches) in enumerate(sets):
        one = (scans.select("scan", F.lit(k).alias("set"), F.lit(fov).alias("fov"), F.lit(stretch).alias("stretch"), F.explode(F.sequence(F.lit(0), F.lit(359), F.lit(step))).alias("yaw"))
               .withColumn("pitch", F.explode(F.array(*(F.lit(p) for p in pitches)))))
        out = one if out is None else out.unionByName(one)
    return out


def best_source(directions: DataFrame, cameras: DataFrame, site: str) -> DataFrame:
    """For each direction the camera of its site that looks most nearly that way; the first on ties."""
    cos = F.round(F.col("dx") * F.col("cx") + F.col("dy") * F.col("cy") + F.col("dz") * F.col("cz"), 12) + 0.0
    return directions.join(cameras, site).groupBy(site, "dir").agg(F.max_by("camera", F.struct(cos, -F.col("camera"))).alias("camera"), F.max(cos).alias("cos"))


#: Degrees on either side of a peak that belong to it; degrees a picture may be shifted upwards or downwards.
PEAK, TILT = 4.0, 7.03125


def vertex(before: float, at: float, after: float) -> float:
    """Part of a bin between a peak's bin and the top of the parabola through it and its neighbours."""
    bend = before - 2 * at + after
    return 0.5 * (before - after) / bend if abs(bend) > 1e-12 else 0.0


def correlate(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """(shift, peak, ratio) of two rings of numbers, or of pictures whose rows are such rings, NaN where unknown: normalised
    correlation over all circular shifts by FFT, rows summed, a parabola for the part of a bin, and the peak against
    the best of all more than PEAK degrees away."""
    a, b = np.atleast_2d(a), np.atleast_2d(b)
    n = a.shape[1]
    ma, mb = np.isfinite(a).astype(float), np.isfinite(b).astype(float)
    a0, b0 = np.where(ma > 0, a, 0.0), np.where(mb > 0, b, 0.0)
    f = lambda x: np.fft.rfft(x, axis=1)
    cc = lambda p, q: np.fft.irfft((np.conj(f(p)) * f(q)).sum(axis=0), n)
    k = np.maximum(cc(ma, mb), 1e-9)
    sa, sb, saa, sbb, sab = cc(a0, mb), cc(ma, b0), cc(a0 * a0, mb), cc(ma, b0 * b0), cc(a0, b0)
    den = np.sqrt(np.maximum(saa - sa * sa / k, 0) * np.maximum(sbb - sb * sb / k, 0))
    r = np.where((den > 1e-9) & (k > 2.5), (sab - sa * sb / k) / np.maximum(den, 1e-9), -1.0)
    t = int(np.argmax(r))
    off = np.abs((np.arange(n) - t + n // 2) % n - n // 2)
    far = r[off > PEAK * n / 360]
    return (t + vertex(r[t - 1], r[t], r[(t + 1) % n])) % n, float(r[t]), float(r[t] / far.max()) if len(far) and far.max() > 0 else float("inf")


def tilted(a: np.ndarray, b: np.ndarray, turn: int, most: int) -> float:
    """Rows by which picture ``a``, turned by ``turn`` bins, must go down to fit ``b`` best, ``most`` at most either way; rows
    that leave the picture don't come in again on the other side."""
    a = np.roll(a, turn, axis=1)
    fit = []
    for d in range(-most, most + 1):
        x, y = (a[: len(a) - d], b[d:]) if d >= 0 else (a[-d:], b[:d])
        both = np.isfinite(x) & np.isfinite(y)
        x, y = x[both], y[both]
        x, y = (x - x.mean(), y - y.mean()) if len(x) else (x, y)
        fit.append(float((x * y).sum() / (np.sqrt((x * x).sum() * (y * y).sum()) + 1e-12)))
    j = int(np.argmax(fit))
    return j - most + (vertex(*fit[j - 1 : j + 2]) if 0 < j < 2 * most else 0.0)


def ring_shift(profiles: DataFrame, key: str) -> DataFrame:
    """Shift between two profiles (arrays ``a``, ``b``) of each key."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(k, *correlate(np.array(x, float), np.array(y, float))) for k, x, y in zip(pdf[key], pdf["a"], pdf["b"], strict=True)]
        return pd.DataFrame(rows, columns=[key, "shift", "peak", "ratio"])

    return profiles.select(key, "a", "b").mapInPandas(lambda it: map(run, it), f"{key} long, shift double, peak double, ratio double")


#: A panel's model. Of each part, when it is there, its ends along the front (from the left), its ends in
#: depth (from the front backwards) and in height, as SQL over the panel's width ``w``, depth ``d``, height ``h``, the
#: inset ``i`` of its doors, and ``m``, the height between two doors (null where one door is enough).
PARTS = (
    ("plinth", "true", "0.008", "w - 0.008", "0.04", "d", "0.0", "0.1"),
    ("body", "true", "0.008", "w - 0.008", "0.0", "d", "0.1", "h"),
    ("door", "h >= 0.58", "0.008 + i", "w - 0.008 - i", "-0.012", "0.0", "0.18", "coalesce(m - 0.03, h - 0.08)"),
    ("door", "h >= 0.58 and m is not null", "0.008 + i", "w - 0.008 - i", "-0.012", "0.0", "m + 0.03", "h - 0.08"),
    ("handle", "h >= 0.58", "w - 0.078 - i", "w - 0.048 - i", "-0.037", "-0.012", "(0.18 + coalesce(m - 0.03, h - 0.08)) / 2 - 0.09", "(0.18 + coalesce(m - 0.03, h - 0.08)) / 2 + 0.09"),
    ("handle", "h >= 0.58 and m is not null", "w - 0.078 - i", "w - 0.048 - i", "-0.037", "-0.012", "(m + h - 0.05) / 2 - 0.09", "(m + h - 0.05) / 2 + 0.09"),
)


def cabinet_parts(panels: DataFrame) -> DataFrame:
    """Each panel's model as boxes in the world: (panel, part, xa, xb, ya, yb, z0, z1), rounded to tenths of a millimetre.

    ``panels`` (panel, ring, height, fx, fy): ``ring`` is the footprint, a ring that is no rectangle has no parts; the
    front looks along (fx, fy), one of the four axes, by default (0, -1).
    """
    fx, fy = F.coalesce("fx", F.lit(0)).cast("double"), F.coalesce("fy", F.when(F.col("fx").isNull(), -1).otherwise(0)).cast("double")
    p = panels.select("panel", F.col("height").alias("h"), fx.alias("fx"), fy.alias("fy"), as_rectangle(F.col("ring")).alias("r")).where("r is not null")
    wide, deep = F.col("r.xb") - F.col("r.xa"), F.col("r.yb") - F.col("r.ya")
    p = p.withColumn("w", F.when(F.col("fx") == 0, wide).otherwise(deep)).withColumn("d", F.when(F.col("fx") == 0, deep).otherwise(wide))
    p = p.withColumn("i", F.expr("least(0.05, (w - 0.016) / 6)")).withColumn("m", F.expr("case when h >= 1.9 then least(1.55, h - 0.6) end"))
    names = ("part", "there", "s0", "s1", "n0", "n1", "z0", "z1")
    each = F.array(*(F.struct(F.lit(row[0]).alias("part"), *(F.expr(e if n == "there" else f"double({e})").alias(n) for n, e in zip(names[1:], row[1:], strict=True))) for row in PARTS))
    p = p.select("panel", "fx", "fy", "r", F.explode(each).alias("b")).where("b.there").select("panel", "fx", "fy", "r", "b.*")
    # the front's left end, seen from inside the panel: where the axis along the front begins
    left = F.when(F.col("fx") + F.col("fy") > 0, F.struct(F.col("r.xb").alias("x"), F.when(F.col("fx") > 0, F.col("r.ya")).otherwise(F.col("r.yb")).alias("y")))
    left = left.otherwise(F.struct(F.col("r.xa").alias("x"), F.when(F.col("fx") < 0, F.col("r.yb")).otherwise(F.col("r.ya")).alias("y")))
    p = p.withColumn("o", left)
    at = lambda s, n, c: F.col(f"o.{c}") + (F.col(s) * (-F.col("fy") if c == "x" else F.col("fx")) - F.col(n) * F.col(f"f{c}"))
    low, high = ((at("s0", "n0", c), at("s1", "n1", c)) for c in "xy")
    tidy = lambda v: half_up(v, 4)
    return p.select("panel", "part", tidy(F.least(*low)).alias("xa"), tidy(F.greatest(*low)).alias("xb"), tidy(F.least(*high)).alias("ya"), tidy(F.greatest(*high)).alias("yb"), "z0", "z1")


def plan_bounds(points: DataFrame, by: str, width_px: int = 1000) -> DataFrame:
    """Bounds of an approximate plan of each ``by``'s points (x, y), a metre around them on whole metres: (x0, x1, y0, y1),
    metres in a pixel, and the picture's height. A group without places has no plan."""
    ends = points.where("x is not null and y is not null").groupBy(by).agg(*(e for c in "xy" for e in ((F.floor(F.min(c)) - 1).alias(f"{c}0"), (F.ceil(F.max(c)) + 1).alias(f"{c}1"))))
    mpp = (F.col("x1") - F.col("x0")) / width_px
    return ends.withColumn("mpp", mpp).withColumn("height_px", half_up((F.col("y1") - F.col("y0")) / mpp).cast("long"))


def grid_lines(bounds: DataFrame, by: str, step: int = 10) -> DataFrame:
    """Lines every ``step`` metres across both axes of a plan: (by, axis, at, px), ``px`` the pixel where it lies."""
    out = None
    for axis in "xy":
        lines = bounds.select(by, "x0", "y1", "mpp", F.lit(axis).alias("axis"), F.explode(F.sequence(F.ceil(F.col(f"{axis}0") / step) * step, F.floor(F.col(f"{axis}1") / step) * step, F.lit(step).cast("long"))).alias("at"))
        px = (F.col("at") - F.col("x0")) / F.col("mpp") if axis == "x" else (F.col("y1") - F.col("at")) / F.col("mpp")
        one = lines.select(by, "axis", "at", px.alias("px"))
        out = one if out is None else out.unionByName(one)
    return out


def reprojection(pictures: DataFrame, key: str) -> DataFrame:
    """Whether a rendering lines up with its photograph: (key, yaw_shift, pitch_shift, peak, ratio, mirrored, ok), in degrees.

    ``pictures`` (key, render, photo, mirror: strength of edges as rows from the top over 180 degrees, each a ring over 360
    degrees; null where nothing is rendered; ``mirror`` is the rendering turned the wrong way round). Neither shift may
    reach half a degree, the mirrored rendering may not fit more than a twentieth better, and the peak must stand out by a
    tenth. Shifts in pitch are tried to TILT degrees, rounded to rows.
    """
    def picture(x) -> np.ndarray:
        return np.array([np.asarray(row, dtype=float) for row in x])

    def one(k, render, photo, mirror) -> tuple:
        a, b, m = picture(render), picture(photo), picture(mirror)
        high, wide = b.shape
        shift, peak, ratio = correlate(a, b)
        turn = int(np.floor(shift + 0.5)) % wide
        rows = tilted(a, b, turn, max(1, min(round(TILT * high / 180), high - 1)) if high > 1 else 0)
        yaw, pitch = (shift - wide if shift > wide / 2 else shift) * 360 / wide, -rows * 180 / high + 0.0
        mirrored = correlate(m, b)[1] > 1.05 * peak
        return k, yaw, pitch, peak, ratio, mirrored, bool(abs(yaw) < 0.5 and abs(pitch) < 0.5 and not mirrored and ratio > 1.1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([one(*r) for r in pdf.itertuples(index=False)], columns=[key, "yaw_shift", "pitch_shift", "peak", "ratio", "mirrored", "ok"])

    chosen = pictures.select(key, "render", "photo", "mirror")
    return chosen.mapInPandas(lambda it: map(run, it), f"{key} long, yaw_shift double, pitch_shift double, peak double, ratio double, mirrored boolean, ok boolean")


def badge_anchor(d: DataFrame, floor_z: float = 0.0, step: float = 0.34, out: float = 0.25, lift: float = 0.55) -> DataFrame:
    """Where a device's badge floats: in front of its cabinet, above it, stacked ones side by side.

    ``d`` (device, x, y, z, fx, fy, top, place, size); a null facing or top counts as zero."""
    fx, fy = F.coalesce("fx", F.lit(0.0)), F.coalesce("fy", F.lit(0.0))
    side = (F.col("place") - (F.col("size") - 1) / 2) * step
    return d.select("device", (F.col("x") + out * fx - side * fy).alias("bx"), (F.col("y") + out * fy + side * fx).alias("by"),
                    (F.greatest(F.coalesce("top", F.lit(0.0)), F.col("z") - floor_z) + lift).alias("bz"))
