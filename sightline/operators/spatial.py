"""Point clouds and grids: voxels, range joins, ray hits, histograms, morphology, components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.expressions import finite
from sightline.operators.cluster import smallest_reached
from sightline.sources.shared import kept


def cell(x: Column | str, size: float) -> Column:
    return F.floor(F.col(x) / size if isinstance(x, str) else x / size)


def voxel_first(points: DataFrame, size: float, keep: list[str], by: list[str] | None = None) -> DataFrame:
    """The first point (by ``ord``) of each voxel, with its coordinates and the kept columns.

    One aggregation with partial results before the shuffle; no sort.
    """
    keys = [*(by or []), "ix", "iy", "iz"]
    p = points.select("*", *(cell(c, size).alias(f"i{c}") for c in "xyz"))
    return p.groupBy(*keys).agg(F.min_by(F.struct("ord", "x", "y", "z", *keep), "ord").alias("p"), F.count("*").alias("n")).select(*keys, "p.*", "n")


def cloud_levels(points: DataFrame, fine: float, coarse: float, keep: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A cloud of scans (scan, ord, x, y, z) at two sizes, and a row for each scan: (fine, coarse, scans).

    Each scan is thinned to ``fine`` voxels by itself, then all together, then to ``coarse`` ones from what is left: always
    the first point, in order of scan and ``ord``, so whole scans are shuffled once, and afterwards what they left.
    ``scans`` has points read, points left and the mean place of a scan."""
    thin = points.select("*", *(cell(c, fine).alias(f"i{c}") for c in "xyz")).groupBy("scan", "ix", "iy", "iz").agg(F.min_by(F.struct("ord", "x", "y", "z", *keep), "ord").alias("p"))
    each, _ = kept(thin.select("scan", "p.*"), "scans")
    first = each.withColumn("ord", F.struct("scan", "ord")).drop("scan")
    small = voxel_first(first, fine, keep).drop("n")
    read = points.groupBy("scan").agg(F.count("*").alias("read"), *(F.avg(c).alias(f"mean_{c}") for c in "xyz"))
    scans = read.join(each.groupBy("scan").agg(F.count("*").alias("left")), "scan", "left")
    return small, voxel_first(small.drop("ix", "iy", "iz"), coarse, keep).drop("n"), scans


def clean(points: DataFrame) -> DataFrame:
    return points.where(finite("x", "y", "z"))


def cloud_to_world(points: DataFrame, poses: DataFrame) -> DataFrame:
    """Valid points by their scan's pose; spherical ones (range, azimuth, elevation) are made cartesian first."""
    from sightline.functions.expressions import rigid

    p = points.where("coalesce(invalid, 0) = 0").join(poses, "scan")
    lx = F.when(F.col("range").isNotNull(), F.col("range") * F.cos("elevation") * F.cos("azimuth")).otherwise(F.col("x"))
    ly = F.when(F.col("range").isNotNull(), F.col("range") * F.cos("elevation") * F.sin("azimuth")).otherwise(F.col("y"))
    lz = F.when(F.col("range").isNotNull(), F.col("range") * F.sin("elevation")).otherwise(F.col("z"))
    q, t = tuple(F.col(n) for n in ("qw", "qx", "qy", "qz")), tuple(F.col(n) for n in ("tx", "ty", "tz"))
    return p.select("scan", "ord", *(c.alias(n) for n, c in zip("xyz", rigid(q, t, (lx, ly, lz)), strict=True)))


def clip_box(points: DataFrame, **bounds: tuple[float, float]) -> DataFrame:
    """Literal bounds, which reach the Parquet scan as pushed filters."""
    for c, (low, high) in bounds.items():
        points = points.where(F.col(c).between(low, high))
    return points


def bounds(points: DataFrame, by: str | None = None) -> DataFrame:
    g = points.groupBy(by) if by else points.groupBy()
    return g.agg(*(f(c).alias(f"{c}_{n}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))), F.count("*").alias("n"))


#: Rows of a key that are put in order as they are; of larger keys a sketch of this accuracy first finds where a rank lies.
FEW, ACCURACY = 100_000, 100_000


def percentiles(df: DataFrame, by: str, value: str, at: tuple[float, ...]) -> DataFrame:
    """Exact percentiles with linear interpolation, as columns p0_5 and so on.

    A sketch, whose error in rank is bounded, gives for each percentile two values that it lies between; those below are
    counted, and only what lies between is put in order, equal values as one row. So whatever the values, and
    however far the outermost, a task orders at most FEW distinct values of a key, or 8 in ACCURACY of its rows.
    """
    v = df.select(by, F.col(value).cast("double").alias("v")).where("v is not null")
    slack = 3 / ACCURACY
    cuts = [min(1.0, max(0.0, q + d)) for q in at for d in (-slack, slack)]
    ends = v.groupBy(by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.percentile_approx("v", cuts, ACCURACY).alias("cut"))
    few = F.col("n") <= FEW
    brackets = F.array(*(F.struct(F.lit(k).alias("which"), F.when(few, F.col("lo")).otherwise(F.get("cut", F.lit(2 * k))).alias("a"), F.when(few, F.col("hi")).otherwise(F.get("cut", F.lit(2 * k + 1))).alias("b")) for k in range(len(at))))
    ends, _ = kept(ends.select(by, "n", brackets.alias("brackets")), "ends")  # a row for each key
    j = v.join(ends, by)
    below = j.groupBy(by).agg(F.max("n").alias("n"), *(F.count_if(F.col("v") < F.get("brackets", F.lit(k))["a"]).alias(f"below{k}") for k in range(len(at))))
    inside = j.select(by, "v", F.explode(F.filter("brackets", lambda x: (F.col("v") >= x["a"]) & (F.col("v") <= x["b"]))).alias("x"))
    inside = inside.groupBy(by, F.col("x.which").alias("which"), "v").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy(by, "which").orderBy("v"))
    placed = inside.withColumn("upto", upto).join(below, by)
    base = F.get(F.array(*(F.col(f"below{k}") for k in range(len(at)))), F.col("which"))
    rank = F.get(F.array(*(F.lit(float(q)) for q in at)), F.col("which")) * (F.col("n") - 1)
    holds = lambda r: (r < base + F.col("upto")) & (r >= base + F.col("upto") - F.col("m"))
    low, high = (F.max(F.when(holds(r(rank)), F.col("v"))) for r in (F.floor, F.ceil))
    each = placed.groupBy(by, "which").agg((low + (high - low) * F.max(rank - F.floor(rank))).alias("p"))
    return each.groupBy(by).agg(*(F.max(F.when(F.col("which") == k, F.col("p"))).alias(f"p{q:g}".replace(".", "_")) for k, q in enumerate(at)))


def near_semi(left: DataFrame, right: DataFrame, radius: float, site: str | None = None) -> DataFrame:
    """Rows of ``left`` (x, y) with a row of ``right`` (rx, ry) within the radius.

    Both sides get the cells of a grid of that size; the right side is spread over the nine cells around it, so this is
    an equality join on cells and the distance a further condition.
    """
    keys = [*([site] if site else []), "_cx", "_cy"]
    l = left.withColumn("_cx", cell("x", radius)).withColumn("_cy", cell("y", radius))  # noqa: E741
    around = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    r = (right.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
         .withColumn("_cx", cell("rx", radius) + F.col("_dx")).withColumn("_cy", cell("ry", radius) + F.col("_dy")).drop("_dx", "_dy"))
    test = (F.col("x") - F.col("rx")) ** 2 + (F.col("y") - F.col("ry")) ** 2 <= radius * radius
    on = test
    for k in keys:
        on = on & (l[k] == r[k])
    return l.join(r, on, "left_semi").drop("_cx", "_cy")


def cylinder_hits(rays: DataFrame, points: DataFrame, start: float = 0.4, stop: float = 10.0, step: float = 0.025, least: float = 0.03, spread_deg: float = 0.6, box: float = 0.12) -> DataFrame:
    """Points within a widening cylinder along each ray: (ray, pid, t), each pair once.

    Each ray is sampled; every sample takes the cells its radius can reach, so rays and points meet by cell. The exact
    distance to the axis decides. ``rays`` (ray, site, ox..dz), ``points`` (pid, site, x, y, z).
    """
    tan = math.tan(math.radians(spread_deg))
    if stop * tan > box:
        raise ValueError("cells must be at least as wide as the widest radius")
    n = int(2 * (stop - start) / box) + 1
    if stop / box > 500:
        raise ValueError("a ray may cross 500 cells at most")
    # a ray's cells, each once: as whole numbers of ten bits an axis, counted from the cell of its origin
    steps = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: start + k * box / 2)
    part = lambda a, t: (cell(F.col(f"o{a}") + t * F.col(f"d{a}"), box) - cell(f"o{a}", box) + 512).cast("long")
    middle = F.array_distinct(F.transform(steps, lambda t: part("x", t) * 2**20 + part("y", t) * 2**10 + part("z", t)))
    around = F.array(*(F.lit(i * 2**20 + j * 2**10 + k).cast("long") for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))
    reached = F.array_distinct(F.flatten(F.transform(middle, lambda c: F.transform(around, lambda d: c + d))))
    s = rays.select("site", "ray", "ox", "oy", "oz", "dx", "dy", "dz", F.explode(reached).alias("_at"))
    for a, low in (("x", 20), ("y", 10), ("z", 0)):
        s = s.withColumn(f"_c{a}", cell(f"o{a}", box).cast("long") + F.shiftright("_at", low).bitwiseAND(F.lit(1023)) - 512)
    cells = s.drop("_at")
    p = points.select("site", "pid", "x", "y", "z", *(cell(a, box).cast("long").alias(f"_c{a}") for a in "xyz"))
    j = cells.hint("merge").join(p, ["site", "_cx", "_cy", "_cz"])  # Spark takes the spread cells for no more than the rays
    along = sum(((F.col(a) - F.col(f"o{a}")) * F.col(f"d{a}") for a in "xyz"), F.lit(0.0))
    off = sum(((F.col(a) - F.col(f"o{a}") - F.col("t") * F.col(f"d{a}")) ** 2 for a in "xyz"), F.lit(0.0))
    reach = F.greatest(F.lit(least), F.col("t") * tan)
    return j.withColumn("t", along).where((F.col("t") >= start) & (F.col("t") <= stop)).where(off < reach * reach).select("ray", "pid", "t", "x", "y", "z")


def first_hit(hits: DataFrame, rays: DataFrame, half: float = 0.05, support: int = 8, low: float = 0.4, high: float = 8.0) -> DataFrame:
    """The first place along each ray with enough points around it: (ray, x, y, z, t, support, spread).

    The place is the median of the points there on each axis, ``t`` its distance along the ray (out of range: no hit),
    ``spread`` their median distance to it. ``hits`` (ray, t, x, y, z), ``rays`` (ray, ox..dz).
    """
    around = f"count(*) over (partition by ray order by t range between {half}D preceding and {half}D following)"
    dense = hits.withColumn("n", F.expr(around)).where(F.col("n") >= support)
    first = dense.groupBy("ray").agg(F.min("t").alias("t0"))
    near = hits.join(first, "ray").where(F.col("t").between(F.col("t0") - half, F.col("t0") + half)).select("ray", "x", "y", "z")
    place = near.groupBy("ray").agg(*(F.percentile(c, 0.5).alias(f"m{c}") for c in "xyz"), F.count("*").alias("support"))
    t = sum(((F.col(f"m{c}") - F.col(f"o{c}")) * F.col(f"d{c}") for c in "xyz"), F.lit(0.0))
    place = place.join(rays.select("ray", *(f"{k}{c}" for k in "od" for c in "xyz")), "ray").withColumn("t", t).where(F.col("t").between(low, high))
    off = F.sqrt(sum(((F.col(c) - F.col(f"m{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    spread = near.join(place.select("ray", "mx", "my", "mz"), "ray").groupBy("ray").agg(F.percentile(off, 0.5).alias("spread"))
    return place.join(spread, "ray").select("ray", *(F.col(f"m{c}").alias(c) for c in "xyz"), "t", "support", "spread")


def histogram_peaks(df: DataFrame, value: str, width: float, by: str, share: float = 0.25, margin: int = 2) -> DataFrame:
    """A histogram between the 0.1 and 99.9 percentiles, ``margin`` bins beyond either, with empty bins: (bin, mid, n,
    mean3, high, peak).

    ``mean3`` is a mean of three bins (missing neighbours count zero). A bin is ``high`` if it isn't at an end and no
    neighbour's mean is larger; it is a ``peak`` if its mean is also the given share of the largest.
    """
    ends = percentiles(df, by, value, (0.001, 0.999)).toDF(by, "lo", "hi").withColumn("lo", F.col("lo") - margin * width)
    ends = ends.withColumn("bins", (F.ceil((F.col("hi") + margin * width - F.col("lo")) / width) - 1).cast("long"))
    ends, _ = kept(ends, "ends")  # a row for each key
    all_ = ends.select(by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin"), (F.col("lo") + (F.col("bin") + 0.5) * width).alias("mid"))
    at = F.floor((F.col(value) - F.col("lo")) / width).cast("long")
    n = df.select(by, value).join(ends, by).select(by, at.alias("bin")).groupBy(by, "bin").agg(F.count("*").alias("n"))
    j = all_.join(n, [by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy(by).orderBy("bin")
    j = j.withColumn("sum3", F.sum("n").over(w.rowsBetween(-1, 1)))
    j = j.withColumn("before", F.lag("sum3").over(w)).withColumn("after", F.lead("sum3").over(w)).withColumn("top", F.max("sum3").over(Window.partitionBy(by)))
    high = F.coalesce((F.col("sum3") >= F.col("before")) & (F.col("sum3") >= F.col("after")), F.lit(False))
    return j.select(by, "bin", "mid", "n", (F.col("sum3") / 3).alias("mean3"), high.alias("high"), (high & (F.col("sum3") >= share * F.col("top"))).alias("peak"))


def floor_level(points: DataFrame, cameras: DataFrame, by: str, width: float = 0.01, low: float = 0.8, high: float = 2.2) -> DataFrame:
    """The densest high bin between ``low`` and ``high`` below the median camera, else the lowest peak; then the median of
    points within three bins of it. ``points`` (by, z), ``cameras`` (by, camera_z)."""
    top = cameras.groupBy(by).agg(F.percentile("camera_z", 0.5).alias("camera_z"))
    p = histogram_peaks(points, "z", width, by).where("high").join(top, by, "left").withColumn("below", F.col("camera_z") - F.col("mid"))
    seen = F.max_by("mid", F.when(F.col("below").between(low, high), F.struct("mean3", -F.col("bin"))))
    pick = p.groupBy(by).agg(F.coalesce(seen, F.min(F.when(F.col("peak"), F.col("mid")))).alias("z0"))
    pick, _ = kept(pick, "levels")  # a row for each key
    near = points.join(pick, by).where(F.abs(F.col("z") - F.col("z0")) <= 3 * width)
    return percentiles(near, by, "z", (0.5,)).toDF(by, "floor_z")


def grid_counts(points: DataFrame, size: float, by: str, least: int) -> DataFrame:
    return (points.select(by, cell("x", size).cast("long").alias("ix"), cell("y", size).cast("long").alias("iy")).groupBy(by, "ix", "iy")
            .agg(F.count("*").alias("n")).withColumn("mask", F.col("n") >= least))


def in_bins(points: DataFrame, size: float, dz: float, z0: float) -> DataFrame:
    iz = F.floor((F.col("z") - z0) / dz).cast("long")
    return points.withColumns({f"i{c}": cell(c, size).cast("long") for c in "xy"} | {"iz": iz})


def occupancy(points: DataFrame, size: float, by: str, dz: float, z0: float = 0.0) -> DataFrame:
    """Counts of 3D cells, at 255 at most: columns of ``size``, bins of ``dz``, of which 0 begins at ``z0``; those below are counted too."""
    return in_bins(points, size, dz, z0).groupBy(by, "ix", "iy", "iz").agg(F.least(F.count("*"), F.lit(255)).alias("n"))


#: Fixed values, in metres above the floor: half the band of the floor's colour, the band of what stands on it; half the
#: band in which points count as floor; where solids begin, where low ones end, and the cut under the ceiling.
FLOOR_COLOUR, STANDING, FLOOR_BAND, SOLID, LOW_SOLID, CEILING = 0.04, (0.3, 2.0), 0.05, 0.12, 1.0, 2.6


def colour_bands(floor_z: float) -> dict[str, Column]:
    h = F.col("z") - floor_z
    return {"floor": F.abs(h) <= FLOOR_COLOUR, "mid": h.between(*STANDING)}


def column_colours(points: DataFrame, size: float, by: str, floor_z: float = 0.0) -> DataFrame:
    """Mean colour (whole numbers, 0 where there is none) and number of points (65535 at most) of each column, on the floor
    and in the band of what stands on it: ``floor_r, floor_g, floor_b, floor_n`` and the same of ``mid``."""
    bands = colour_bands(floor_z)
    mean = lambda c, band: F.coalesce(F.floor(F.avg(F.when(band, F.col(c)))), F.lit(0)).cast("long")
    return (points.select("*", *(cell(c, size).cast("long").alias(f"i{c}") for c in "xy")).groupBy(by, "ix", "iy")
            .agg(*(e for k, band in bands.items() for e in (*(mean(c, band).alias(f"{k}_{c}") for c in "rgb"), F.least(F.count_if(band), F.lit(65535)).alias(f"{k}_n")))))


def room_grid(points: DataFrame, size: float, by: str, dz: float, z0: float = 0.0, floor_z: float = 0.0) -> DataFrame:
    """``occupancy`` with colours: ``r, g, b``, the mean of each cell (null where there is none), and ``column_colours`` of its column.

    Points are aggregated once, to sums of cells; sums of a column are those of its cells."""
    bands = {"cell": F.lit(True)} | colour_bands(floor_z)
    sums = lambda k, c: (f(F.when(bands[k], F.col(c))).alias(f"{k}_{c}_{n}") for n, f in (("sum", F.sum), ("count", F.count)))
    cells = in_bins(points, size, dz, z0).groupBy(by, "ix", "iy", "iz").agg(
        *(F.count_if(band).alias(f"{k}_count") for k, band in bands.items()), *(e for k in bands for c in "rgb" for e in sums(k, c)))
    column = Window.partitionBy(by, "ix", "iy")
    whole = lambda name: F.sum(name).over(column)
    mean = lambda k, c: F.coalesce(F.floor(F.try_divide(whole(f"{k}_{c}_sum"), whole(f"{k}_{c}_count"))), F.lit(0)).cast("long")
    return cells.select(
        by, "ix", "iy", "iz", F.least("cell_count", F.lit(255)).alias("n"), *(F.try_divide(f"cell_{c}_sum", f"cell_{c}_count").alias(c) for c in "rgb"),
        *(e for k in colour_bands(floor_z) for e in (*(mean(k, c).alias(f"{k}_{c}") for c in "rgb"), F.least(whole(f"{k}_count"), F.lit(65535)).alias(f"{k}_n"))))


def column_top(occ: DataFrame, by: str, dz: float, z0: float, least: int = 2, solid: float = SOLID, low: float = LOW_SOLID, cap: float = CEILING) -> DataFrame:
    """What each column holds: ``top``, the upper edge of its highest occupied bin between ``solid`` and ``cap`` (0 if there
    is none), ``any`` and ``low`` (one of these bins, one up to ``low``), and ``floor`` (enough points about height 0).

    ``occ`` (by, ix, iy, iz, n) has bins of ``dz`` from ``z0``, heights above the floor; a bin lies where its middle does
    and is occupied by ``least`` points."""
    mid = z0 + (F.col("iz") + 0.5) * dz
    band = (F.col("n") >= least) & (mid >= solid) & (mid <= cap)
    return occ.groupBy(by, "ix", "iy").agg(
        F.coalesce(F.max(F.when(band, mid + dz / 2)), F.lit(0.0)).alias("top"), F.bool_or(band).alias("any"), F.bool_or(band & (mid <= low)).alias("low"),
        (F.coalesce(F.sum(F.when(F.abs(mid) <= FLOOR_BAND, F.col("n"))), F.lit(0)) >= least).alias("floor"))


def z_buffer(points: DataFrame, keys: list[str], dist: str) -> DataFrame:
    """All points of each pixel within 1e-9 of its smallest distance."""
    best = points.groupBy(*keys).agg(F.min(dist).alias("_d"))
    return points.join(best, keys).where(F.col(dist) <= F.col("_d") + 1e-9).drop("_d")


CROSS = ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))
SQUARE = tuple((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1))


def dilate(cells: DataFrame, by: str, shape=SQUARE) -> DataFrame:
    """Cells reached by the structuring element; cells are rows (by, ix, iy)."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in shape))
    return cells.select(by, "ix", "iy", F.explode(steps).alias("s")).select(by, (F.col("ix") + F.col("s.i")).alias("ix"), (F.col("iy") + F.col("s.j")).alias("iy")).distinct()


def erode(cells: DataFrame, by: str, shape=SQUARE) -> DataFrame:
    """Cells whose whole structuring element is set."""
    steps = F.array(*(F.struct(F.lit(-i).alias("i"), F.lit(-j).alias("j")) for i, j in shape))
    n = (cells.select(by, "ix", "iy").distinct().select(by, "ix", "iy", F.explode(steps).alias("s"))
         .groupBy(by, (F.col("ix") + F.col("s.i")).alias("ix"), (F.col("iy") + F.col("s.j")).alias("iy")).agg(F.count("*").alias("n")))
    return n.where(F.col("n") == len(shape)).select(by, "ix", "iy")


def opened(cells: DataFrame, by: str, shape=SQUARE) -> DataFrame:
    return dilate(erode(cells, by, shape), by, shape)


def closed(cells: DataFrame, by: str, shape=SQUARE) -> DataFrame:
    return erode(dilate(cells, by, shape), by, shape)


#: Steps to a cell's neighbours, one of each two opposite ones.
FOUR, EIGHT = ((1, 0), (0, 1)), ((1, 0), (0, 1), (1, 1), (1, -1))


def grid_edges(cells: DataFrame, by: str, eight: bool = True) -> DataFrame:
    """Pairs of neighbouring cells as ids; ids are (by, ix, iy) packed by hash-free arithmetic on strings."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in (EIGHT if eight else FOUR)))
    c = cells.select(by, "ix", "iy")
    n = c.withColumn("s", F.explode(steps)).select(by, F.struct("ix", "iy").alias("a"), (F.col("ix") + F.col("s.i")).alias("ix"), (F.col("iy") + F.col("s.j")).alias("iy"))
    return n.join(c, [by, "ix", "iy"]).select(F.struct(F.col(by), F.col("a.ix"), F.col("a.iy")).alias("a"), F.struct(by, "ix", "iy").alias("b"))


#: A tile has two to this power of cells a side.
TILE = 8


def rooted(ix: np.ndarray, iy: np.ndarray, eight: bool) -> np.ndarray:
    """For each of a tile's cells the place of the smallest cell (ix, iy) that neighbours join it to."""
    high = int(iy.max() - iy.min()) + 3  # with an empty rim
    cells, first, back = np.unique((ix - ix.min() + 1) * high + (iy - iy.min() + 1), return_index=True, return_inverse=True)
    number = np.full((int(ix.max() - ix.min()) + 3) * high, -1)
    number[cells] = np.arange(len(cells))
    ends = [number[cells + i * high + j] for i, j in (EIGHT if eight else FOUR)]
    lo, hi = np.concatenate([np.flatnonzero(e >= 0) for e in ends]), np.concatenate([e[e >= 0] for e in ends])
    return first[smallest_reached(lo, hi, len(cells))[back]]


def labelled(cells: DataFrame, by: str, components, eight: bool = False) -> DataFrame:
    """``cells`` (by, ix, iy and other columns) with ``root``, the smallest cell (by, ix, iy) of their component; a cell
    without one of its keys is alone.

    Neighbours within a tile are joined by one task, which holds a tile at a time, so that ``components`` gets only the edges
    over the sides of tiles, as pairs of the roots there."""

    def run(tile: pa.Table) -> pa.Table:
        alone = any(tile[c].null_count for c in (by, "ix", "iy"))  # the same for all rows of a group
        at = pa.array(np.arange(tile.num_rows) if alone else rooted(tile["ix"].to_numpy(), tile["iy"].to_numpy(), eight))
        for c in ("ix", "iy"):
            tile = tile.append_column(f"_r{c}", tile[c].take(at))
        return tile

    tile_of = lambda x: F.shiftright(x, TILE)
    schema = T.StructType([*cells.schema.fields, *(T.StructField(f"_r{c}", cells.schema[c].dataType) for c in ("ix", "iy"))])
    own, _ = kept(cells.groupBy(by, tile_of("ix"), tile_of("iy")).applyInArrow(run, schema), "tiles")  # read several times
    own = own.withColumn("root", F.struct(by, F.col("_rix").alias("ix"), F.col("_riy").alias("iy"))).drop("_rix", "_riy")
    last = F.lit(2**TILE - 1)
    rim = own.where(F.col("ix").bitwiseAND(last).isin(0, 2**TILE - 1) | F.col("iy").bitwiseAND(last).isin(0, 2**TILE - 1)).select(by, "ix", "iy", "root")
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in (EIGHT if eight else FOUR)))
    over = rim.select(by, F.col("root").alias("a"), F.explode(steps).alias("s"), F.col("ix").alias("_ix"), F.col("iy").alias("_iy"))
    over = over.withColumns({"ix": F.col("_ix") + F.col("s.i"), "iy": F.col("_iy") + F.col("s.j")})
    over = over.where((tile_of("ix") != tile_of("_ix")) | (tile_of("iy") != tile_of("_iy"))).select(by, "ix", "iy", "a")
    edges, _ = kept(over.join(rim.withColumnRenamed("root", "b"), [by, "ix", "iy"]).select("a", "b").distinct(), "sides")
    if edges.isEmpty():
        return own
    beyond = components(edges).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return own.join(beyond, own["root"] == beyond["_node"], "left").withColumn("root", F.coalesce("_root", "root")).drop("_node", "_root")


def gaps_between(cells: DataFrame, by: str) -> DataFrame:
    """Empty stretches between cells of a row: (by, iy, a, b), ends included."""
    w = Window.partitionBy(by, "iy").orderBy("ix")
    g = cells.select(by, "iy", (F.lag("ix").over(w) + 1).alias("a"), (F.col("ix") - 1).alias("b"))
    return g.where("a <= b")


def filled(cells: DataFrame, by: str, components) -> DataFrame:
    """Cells (distinct) plus the holes in them: empty cells that no path of four neighbours joins to the outside.

    Works on the empty stretches between cells of a row, of which there are fewer than cells, however large the box around
    them: two that touch in neighbouring rows are joined, and what touches a row's outside, or a row without cells, is
    outside. Whom a stretch's ends touch is found in order of place, not by pairs."""
    cells = cells.select(by, "ix", "iy")
    gaps, _ = kept(gaps_between(cells, by).withColumn("node", F.struct(by, "iy", "a")), "gaps")  # read several times
    rows = cells.groupBy(by, "iy").agg(F.min("ix").alias("lo"), F.max("ix").alias("hi"))
    next_to = gaps.select(by, "node", "a", "b", F.explode(F.array(F.lit(-1), F.lit(1))).alias("step")).withColumn("iy", F.col("node.iy") + F.col("step"))
    j = next_to.join(rows, [by, "iy"], "left")
    open_ = j.where("lo is null or a < lo or b > hi").select("node").distinct()
    here = gaps.select(by, "iy", F.col("a").alias("at"), F.lit(0).alias("asks"), "node", "b")
    ask = next_to.select(by, "iy", F.col("a").alias("at"), F.lit(1).alias("asks"), "node", F.lit(None).cast("long").alias("b"))
    upto = Window.partitionBy(by, "iy").orderBy("at", "asks")
    met = here.withColumn("b", F.col("b").cast("long")).unionByName(ask).withColumn("other", F.last(F.when(F.col("asks") == 0, F.struct("node", "b")), ignorenulls=True).over(upto))
    edges = met.where("asks = 1 and other.b >= at").select(F.col("node").alias("a"), F.col("other.node").alias("b"))
    labelled = gaps.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    outside = labelled.join(open_, "node", "left_semi").select("root").distinct()
    holes = labelled.join(outside, "root", "left_anti").select(by, F.explode(F.sequence("a", "b")).alias("ix"), "iy")
    return cells.unionByName(holes)


def disc_share(centres: DataFrame, cells: DataFrame, grid: DataFrame, radius: float, size: float, site: str) -> DataFrame:
    """For each centre (point, x, y) the share of the disc's cells that are set, and whether most are. Where the disc's
    square leaves the site's ``grid`` (site, ix0, ix1, iy0, iy1, cells it has), the cell of the centre counts alone, or
    the nearest of the grid."""
    k = max(1, round(radius / size))
    off = [(i, j) for i in range(-k, k + 1) for j in range(-k, k + 1) if i * i + j * j <= k * k]
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in off))
    c = centres.select(site, "point", cell("x", size).cast("long").alias("cx"), cell("y", size).cast("long").alias("cy")).join(grid, site)
    whole = F.lit(True)
    for ax in "xy":
        whole = whole & (F.col(f"c{ax}") - k >= F.col(f"i{ax}0")) & (F.col(f"c{ax}") + k <= F.col(f"i{ax}1"))
        c = c.withColumn(f"n{ax}", F.least(F.greatest(f"c{ax}", f"i{ax}0"), f"i{ax}1"))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    c = c.select(site, "point", "nx", "ny", F.explode(F.when(whole, steps).otherwise(alone)).alias("s"))
    c = c.select(site, "point", (F.col("nx") + F.col("s.i")).alias("ix"), (F.col("ny") + F.col("s.j")).alias("iy"))
    j = c.join(cells.select(site, "ix", "iy", F.lit(1).alias("set")), [site, "ix", "iy"], "left")
    return j.groupBy(site, "point").agg(F.avg(F.coalesce("set", F.lit(0))).alias("share")).withColumn("blocked", F.col("share") > 0.5)


#: The sides in order, and the window in front of a device: metres from it, to it, and to both sides.
SIDES = (("+x", 1, 0), ("-x", -1, 0), ("+y", 0, 1), ("-y", 0, -1))
WINDOW = (0.15, 1.0, 0.3)


def facing(devices: DataFrame, floor: DataFrame, grid: DataFrame, site: str, size: float) -> DataFrame:
    """Side (+x, -x, +y, -y) of each device (device, x, y) whose window, in metres, holds the largest share of floor; the
    first on ties.

    Windows are spread over the cells of ``size`` that they touch, as far as the site's ``grid`` (site, ix0, ix1, iy0,
    iy1) has them, and meet the floor's cells (site, ix, iy) there; one that has no cell holds none.
    """
    near, far, half = WINDOW

    def ends(c: str, f: int) -> tuple[Column, Column]:
        a, b = {1: (near, far), -1: (-far, -near), 0: (-half, half)}[f]
        return F.floor((F.col(c) + a) / size + 1e-6).cast("long"), F.ceil((F.col(c) + b) / size - 1e-6).cast("long") - 1

    win = []
    for k, (name, fx, fy) in enumerate(SIDES):
        (a, b), (c, d) = ends("x", fx), ends("y", fy)
        win.append(F.struct(F.lit(name).alias("side"), F.lit(k).alias("k"), a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d")))
    w = devices.join(grid, site, "left").select(site, "device", "ix0", "ix1", "iy0", "iy1", F.explode(F.array(*win)).alias("w")).select("*", "w.*")
    clamped = {"a": F.greatest("a", "ix0"), "b": F.least("b", "ix1"), "c": F.greatest("c", "iy0"), "d": F.least("d", "iy1")}
    w = w.select(site, "device", "side", "k", *(v.alias(n) for n, v in clamped.items()))
    for name, first, last in (("ix", "a", "b"), ("iy", "c", "d")):
        w = w.withColumn(name, F.explode_outer(F.when(F.col(first) <= F.col(last), F.sequence(first, last))))
    j = w.join(floor.select(site, "ix", "iy", F.lit(1).alias("f")), [site, "ix", "iy"], "left")
    share = j.groupBy(site, "device", "side", "k").agg(F.avg(F.coalesce("f", F.lit(0))).alias("share"))
    return share.groupBy(site, "device").agg(F.max_by("side", F.struct("share", -F.col("k"))).alias("side"), F.max("share").alias("share"))


def kept_components(cells: DataFrame, by: str, components, least_area: float, size: float, eight: bool = False, support: DataFrame | None = None,
                    least_support: int = 6, least_share: float = 0.08) -> DataFrame:
    """Cells of the components that are large enough (square metres, for cells of ``size``) and, with ``support`` (by, ix,
    iy: cells that stand on something), hold enough such cells, in number and as a share."""
    cells = cells.select(by, "ix", "iy")
    if support is not None:
        cells = cells.join(support.select(by, "ix", "iy").distinct().withColumn("stands", F.lit(1)), [by, "ix", "iy"], "left")
    node = labelled(cells, by, components, eight)
    low = F.count("stands") if support is not None else F.lit(0)
    size_of = node.groupBy("root").agg(F.count("*").alias("n"), low.alias("low"))
    fine = F.col("n") * (size * size) >= least_area
    if support is not None:
        fine = fine & (F.col("low") >= least_support) & (F.col("low") >= least_share * F.col("n"))
    return node.join(size_of.where(fine), "root", "left_semi").select(by, "ix", "iy")


def gap_groups(df: DataFrame, by: str, value: str, gap: float, tie: str) -> DataFrame:
    """1D clusters: a new one begins where the step to the next value is over the gap."""
    w = Window.partitionBy(by).orderBy(value, tie)
    step = F.col(value) - F.lag(value).over(w)
    return df.withColumn("_new", F.when(step > gap, 1).otherwise(0)).withColumn("group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def runs(df: DataFrame, by: str, order: str, flag: Column) -> DataFrame:
    """(first, last) places of each run of true flags, places numbered along the order."""
    w = Window.partitionBy(by).orderBy(order)
    n = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_f", F.coalesce(flag, F.lit(False))).where("_f")
    n = n.withColumn("_k", F.col("_i") - F.row_number().over(w))
    return n.groupBy(by, "_k").agg(F.min("_i").alias("first"), (F.max("_i") + 1).alias("end")).drop("_k")


def bands(points: DataFrame, floor: float = 0.05, low: float = 0.3, high: float = 2.0) -> DataFrame:
    """Floor and obstacle flags by height above the floor (edges included)."""
    return points.withColumn("is_floor", F.abs("h") <= floor).withColumn("is_obstacle", F.col("h").between(low, high))


def cell_window(boxes: DataFrame, size: float, x0: float, y1: float, columns: int, rows: int, slack: float = 1e-6) -> DataFrame:
    """Cells that world boxes (xa, xb, ya, yb) reach, as half-open ranges clamped to the grid; rows count down from y1."""
    c = F.col
    at = lambda v, up: (F.ceil(v - slack) if up else F.floor(v + slack)).cast("long")
    first = lambda v: F.greatest(v, F.lit(0))
    b = boxes.withColumn("c0", first(at((F.least("xa", "xb") - x0) / size, False))).withColumn("c1", F.least(at((F.greatest("xa", "xb") - x0) / size, True), F.lit(columns)))
    b = b.withColumn("r0", first(at((y1 - F.greatest("ya", "yb")) / size, False))).withColumn("r1", F.least(at((y1 - F.least("ya", "yb")) / size, True), F.lit(rows)))
    return b.withColumn("c1", F.greatest(c("c0"), c("c1"))).withColumn("r1", F.greatest(c("r0"), c("r1")))


def lines(cells: DataFrame, by: str, along: str) -> DataFrame:
    """Runs of neighbouring cells along an axis ("ix" or "iy"): (by, line, start, end), ends included."""
    line = "iy" if along == "ix" else "ix"
    place = F.row_number().over(Window.partitionBy(by, line).orderBy(along))
    return cells.select(by, F.col(line).alias("line"), (F.col(along) - place).alias("run"), F.col(along).alias("at")).groupBy(by, "line", "run").agg(F.min("at").alias("start"), F.max("at").alias("end")).drop("run")


def stretched(cells: DataFrame, by: str, along: str, by_cells: int) -> DataFrame:
    """Cells with each run along an axis made longer at both ends, or shorter where ``by_cells`` is negative."""
    line = "iy" if along == "ix" else "ix"
    r = lines(cells, by, along).select(by, "line", (F.col("start") - by_cells).alias("start"), (F.col("end") + by_cells).alias("end")).where("start <= end")
    out = r.select(by, F.col("line").alias(line), F.explode(F.sequence("start", "end")).alias(along)).select(by, "ix", "iy")
    return out.distinct() if by_cells > 0 else out


def square(cells: DataFrame, by: str, side: int, opening: bool) -> DataFrame:
    """Opening or closing by a square of ``side`` cells (made odd), one axis after the other, run by run: a wide square
    costs no more than a narrow one. ``cells`` are distinct; cells beyond them count as empty."""
    half = (max(side, 1) | 1) // 2
    if not half:
        return cells.select(by, "ix", "iy")
    for step in (-half, half) if opening else (half, -half):
        for along in ("ix", "iy"):
            cells = stretched(cells, by, along, step)
    return cells


def unscanned(room: DataFrame, floor: DataFrame, covered: DataFrame, by: str, components, size: float, side: float = 0.2, least_area: float = 0.4) -> DataFrame:
    """Cells of a room's floor that no scan has seen: those of ``room`` farther than two cells from measured ``floor`` and
    not ``covered`` by solids, rows, boxes or walls; opened and closed by a square of ``side`` metres; only places of
    ``least_area`` square metres and more (four neighbours). All are (by, ix, iy), distinct."""
    room = room.select(by, "ix", "iy").hint("merge")  # a grid that is spread to its cells looks as small as before to Spark
    seen = dilate(dilate(floor, by, CROSS), by, CROSS)
    left = room.join(seen.unionByName(covered.select(by, "ix", "iy")).distinct(), [by, "ix", "iy"], "left_anti")
    whole = int(side / size + 1e-9)
    left = square(square(left, by, whole, True), by, whole, False).join(room, [by, "ix", "iy"], "left_semi")
    return kept_components(left, by, components, least_area, size)
