"""Queries of point clouds, grids, windows, layout and streams."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions import expressions as E
from sightline.operators import cluster as C
from sightline.operators import gates
from sightline.operators import layout as Y
from sightline.operators import spatial as P
from sightline.plans import adapters as A
from sightline.plans.base import query, table
from sightline.sources.shared import kept, shared_folder


@query(f"""WITH {A.PTS}, c AS (SELECT *, floor(x / 0.5) AS ix, floor(y / 0.5) AS iy, floor(z / 0.5) AS iz FROM pts)
SELECT CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy, CAST(iz AS BIGINT) AS iz, arg_min(pid, (l_orderkey, l_linenumber, pid, l_suppkey,
 l_extendedprice)) AS pid, count(*) AS n FROM c GROUP BY 1, 2, 3""")
def voxel_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.voxel_first(P.clean(A.points(spark, sf_dir)), 0.5, ["pid"]).select("ix", "iy", "iz", "pid", "n")


_line = "(room, l_orderkey, l_linenumber, pid, l_suppkey, l_extendedprice)"


@query(f"""WITH {A.PTS}, f AS (SELECT CAST(floor(x / 0.25) AS BIGINT) AS ix, CAST(floor(y / 0.25) AS BIGINT) AS iy, CAST(floor(z / 0.25) AS BIGINT) AS iz, arg_min(pid, {_line}) AS pid FROM pts GROUP BY 1, 2, 3),
g AS (SELECT CAST(floor(x / 1.5) AS BIGINT) AS ix, CAST(floor(y / 1.5) AS BIGINT) AS iy, CAST(floor(z / 1.5) AS BIGINT) AS iz, arg_min(pid, {_line}) AS pid FROM pts GROUP BY 1, 2, 3)
SELECT 'fine' AS level, * FROM f UNION ALL SELECT 'coarse', * FROM g""")
def voxel_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans thinned by themselves, together and once more; the SQL takes each level from all points, with the same rows."""
    points = P.clean(A.points(spark, sf_dir)).withColumnRenamed("room", "scan")
    fine, coarse, _ = P.cloud_levels(points, 0.25, 1.5, ["pid"])
    return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("level"), "ix", "iy", "iz", "pid") for name, df in (("fine", fine), ("coarse", coarse))))


@query("""SELECT l_returnflag AS flag, round(quantile_cont(l_extendedprice, 0.001), 2) AS lo, round(quantile_cont(l_extendedprice, 0.5), 2) AS mid,
 round(quantile_cont(l_extendedprice, 0.995), 2) AS hi, round(quantile_cont(l_extendedprice, 0.999), 2) AS top FROM lineitem GROUP BY 1""")
def percentile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.percentiles(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag"), "flag", "l_extendedprice", (0.001, 0.5, 0.995, 0.999))
    return p.toDF("flag", "lo", "mid", "hi", "top").select("flag", *(F.round(c, 2).alias(c) for c in ("lo", "mid", "hi", "top")))


HIST = """e AS (SELECT l_returnflag AS flag, quantile_cont(l_extendedprice, 0.001) - 4000 AS o, quantile_cont(l_extendedprice, 0.999) + 4000 AS z FROM lineitem GROUP BY 1),
g AS (SELECT flag, o, unnest(range(0, CAST(ceil((z - o) / 2000) AS BIGINT) - 1)) AS bin FROM e),
b AS (SELECT l_returnflag AS flag, CAST(floor((l_extendedprice - o) / 2000) AS BIGINT) AS bin, count(*) AS n FROM lineitem JOIN e ON flag = l_returnflag GROUP BY 1, 2),
j AS (SELECT g.flag, g.bin, o + (g.bin + 0.5) * 2000 AS mid, coalesce(n, 0) AS n FROM g LEFT JOIN b ON g.flag = b.flag AND g.bin = b.bin),
m AS (SELECT *, n + coalesce(lag(n) OVER v, 0) + coalesce(lead(n) OVER v, 0) AS s3 FROM j WINDOW v AS (PARTITION BY flag ORDER BY bin)),
w AS (SELECT *, s3 >= lag(s3) OVER v AND s3 >= lead(s3) OVER v AS high, max(s3) OVER (PARTITION BY flag) AS t FROM m WINDOW v AS (PARTITION BY flag ORDER BY bin))"""


@query(f"WITH {HIST} SELECT flag, bin, n, round(s3 / 3, 6) AS mean3, coalesce(high, false) AS high, coalesce(high AND s3 >= 0.25 * t, false) AS peak FROM w")
def hist_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag")
    return P.histogram_peaks(li, "l_extendedprice", 2000.0, "flag").withColumn("mean3", F.round("mean3", 6)).drop("mid")


@query(f"""WITH {HIST}, k AS (SELECT *, 100000 - mid BETWEEN 20000 AND 90000 AS below, row_number() OVER (PARTITION BY flag, 100000 - mid BETWEEN 20000
 AND 90000 ORDER BY s3 DESC, bin) AS strongest FROM w WHERE high),
v AS (SELECT flag, coalesce(min(mid) FILTER (below AND strongest = 1), min(mid) FILTER (s3 >= 0.25 * t)) AS z0 FROM k GROUP BY flag)
SELECT v.flag, CAST(quantile_cont(l_extendedprice, 0.5) AS DOUBLE) AS floor_z FROM v
 JOIN lineitem ON l_returnflag = v.flag AND abs(l_extendedprice - z0) <= 6000 GROUP BY v.flag""")
def floor_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("z"))
    cam = li.select("flag").distinct().withColumn("camera_z", F.explode(F.array(F.lit(90000.0), F.lit(100000.0), F.lit(130000.0))))
    return P.floor_level(li, cam, "flag", 2000.0, 20000.0, 90000.0)


@query(f"""WITH {A.PTS} SELECT room, CAST(floor(x / 0.5) AS BIGINT) AS ix, CAST(floor(y / 0.5) AS BIGINT) AS iy, count(*) AS n, count(*) >= 5 AS mask FROM pts GROUP BY 1, 2, 3""")
def grid_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.grid_counts(A.points(spark, sf_dir), 0.5, "room", 5)


OCC = f"""{A.PTS}, occ AS (SELECT room, CAST(floor(x / 0.5) AS BIGINT) AS ix, CAST(floor(y / 0.5) AS BIGINT) AS iy, CAST(floor((z + 0.1) / 0.25) AS BIGINT) AS iz,
 CAST(least(count(*), 255) AS BIGINT) AS n FROM pts GROUP BY 1, 2, 3, 4)"""


_colour = ", ".join(f"CAST(coalesce(floor(avg({c}) FILTER ({test})), 0) AS BIGINT) AS {k}_{c}" for k, test in (("floor", "abs(z) <= 0.04"), ("mid", "z BETWEEN 0.3 AND 2.0")) for c in "rgb")
_mean = ", ".join(f"CAST(sum({c}) AS DOUBLE) / count({c}) AS {c}" for c in "rgb")


@query(f"""WITH {A.PTS}, p AS (SELECT *, CAST(floor(x / 0.5) AS BIGINT) AS ix, CAST(floor(y / 0.5) AS BIGINT) AS iy, CAST(floor((z + 0.1) / 0.25) AS BIGINT) AS iz FROM pts),
 c AS (SELECT room, ix, iy, iz, CAST(least(count(*), 255) AS BIGINT) AS n, {_mean} FROM p GROUP BY 1, 2, 3, 4),
 k AS (SELECT room, ix, iy, {_colour}, least(count(*) FILTER (abs(z) <= 0.04), 65535) AS floor_n, least(count(*) FILTER (z BETWEEN 0.3 AND 2.0), 65535) AS mid_n FROM p GROUP BY 1, 2, 3)
SELECT c.*, floor_r, floor_g, floor_b, floor_n, mid_r, mid_g, mid_b, mid_n FROM c
 JOIN k ON c.room IS NOT DISTINCT FROM k.room AND c.ix IS NOT DISTINCT FROM k.ix AND c.iy IS NOT DISTINCT FROM k.iy""")
def occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell's points and mean colour, with the colours and points of its column on the floor and above it."""
    return P.room_grid(A.points(spark, sf_dir), 0.5, "room", 0.25, -0.1)


@query(f"""WITH {A.PTS} SELECT room, CAST(floor(x / 0.5) AS BIGINT) AS ix, CAST(floor(y / 0.5) AS BIGINT) AS iy, {_colour},
 least(count(*) FILTER (abs(z) <= 0.04), 65535) AS floor_n, least(count(*) FILTER (z BETWEEN 0.3 AND 2.0), 65535) AS mid_n FROM pts GROUP BY 1, 2, 3""")
def column_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.column_colours(A.points(spark, sf_dir), 0.5, "room")
    return c.withColumns({n: F.col(n).cast("long") for n in ("floor_n", "mid_n")})


@query(f"""WITH {OCC}, z AS (SELECT *, -0.1 + (iz + 0.5) * 0.25 AS mid FROM occ), b AS (SELECT *, n >= 2 AND mid >= 0.12 AND mid <= 2.6 AS band FROM z)
SELECT room, ix, iy, CAST(round(coalesce(max(mid + 0.125) FILTER (band), 0), 6) AS DOUBLE) AS top, bool_or(band) AS "any", bool_or(band AND mid <= 1.0) AS low,
 coalesce(sum(n) FILTER (abs(mid) <= 0.05), 0) >= 2 AS floor FROM b GROUP BY room, ix, iy""")
def column_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.column_top(P.occupancy(A.points(spark, sf_dir), 0.5, "room", 0.25, -0.1), "room", 0.25, -0.1).withColumn("top", F.round("top", 6))


@query(f"""WITH {A.PTS}, g AS (SELECT room, CAST(floor(x) AS BIGINT) AS px, CAST(floor(y) AS BIGINT) AS py, z, pid FROM pts),
 m AS (SELECT room, px, py, min(z) AS d FROM g GROUP BY 1, 2, 3)
SELECT room, px, py, count(*) AS winners, min(pid) AS pid FROM g JOIN m USING (room, px, py) WHERE z <= d + 1e-9 GROUP BY 1, 2, 3""")
def z_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.points(spark, sf_dir).withColumn("px", F.floor("x")).withColumn("py", F.floor("y"))
    return P.z_buffer(p, ["room", "px", "py"], "z").groupBy("room", "px", "py").agg(F.count("*").alias("winners"), F.min("pid").alias("pid"))


@query("""WITH l AS (SELECT c_custkey AS id, c_nationkey AS site, c_acctbal / 100 AS x, CAST(c_custkey % 50 AS DOUBLE) AS y FROM customer),
 r AS (SELECT s_nationkey AS site, s_acctbal / 100 AS rx, CAST(s_suppkey % 50 AS DOUBLE) AS ry FROM supplier)
SELECT id FROM l WHERE EXISTS (SELECT 1 FROM r WHERE r.site = l.site AND (x - rx) ** 2 + (y - ry) ** 2 <= 100)""")
def near_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("site"), (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") % 50).cast("double").alias("y"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("site"), (F.col("s_acctbal") / 100).alias("rx"), (F.col("s_suppkey") % 50).cast("double").alias("ry"))
    return P.near_semi(c, s, 10.0, "site").select("id")


def ray_points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("s_suppkey")
    yaw, pitch = (k * 37 % 360).cast("double"), (k * 11 % 20 - 10).cast("double")
    d = E.direction(yaw, pitch)
    r = table(spark, sf_dir, "supplier").select(k.alias("ray"), (k % 3).alias("site"), F.lit(0.0).alias("ox"), F.lit(0.0).alias("oy"), F.lit(0.0).alias("oz"), *(c.alias(f"d{n}") for n, c in zip("xyz", d, strict=True)))
    i = F.col("p_partkey")
    far = 0.5 + (i % 90).cast("double") / 10
    e = E.direction((i * 7 % 360).cast("double"), (i * 3 % 20 - 10).cast("double"))
    p = table(spark, sf_dir, "part").select(i.alias("pid"), (i % 3).alias("site"), *((far * c).alias(n) for n, c in zip("xyz", e, strict=True)))
    return r, p


@query("""WITH r AS (SELECT s_suppkey AS ray, s_suppkey % 3 AS site, radians(CAST(s_suppkey * 37 % 360 AS DOUBLE)) AS y,
 radians(CAST(s_suppkey * 11 % 20 - 10 AS DOUBLE)) AS p FROM supplier),
d AS (SELECT ray, site, sin(y) * cos(p) AS dx, cos(y) * cos(p) AS dy, sin(p) AS dz FROM r),
 q AS (SELECT p_partkey AS pid, p_partkey % 3 AS site, 0.5 + CAST(p_partkey % 90 AS DOUBLE) / 10 AS f,
 radians(CAST(p_partkey * 7 % 360 AS DOUBLE)) AS y, radians(CAST(p_partkey * 3 % 20 - 10 AS DOUBLE)) AS p FROM part),
c AS (SELECT pid, site, f * sin(y) * cos(p) AS x, f * cos(y) * cos(p) AS y, f * sin(p) AS z FROM q),
 t AS (SELECT ray, pid, x * dx + y * dy + z * dz AS t, x, y, z, dx, dy, dz FROM d JOIN c ON d.site = c.site)
SELECT ray, pid, round(t, 5) AS t FROM t WHERE t BETWEEN 0.4 AND 10 AND (x - t * dx) ** 2 + (y - t * dy) ** 2 + (z - t * dz) ** 2 < greatest(0.03,
 t * tan(radians(0.6))) ** 2""")
def cylinder_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cylinder_hits(*ray_points(spark, sf_dir)).select("ray", "pid", F.round("t", 5).alias("t"))


@query("""WITH r AS (SELECT DISTINCT user_id AS ray, radians(CAST(user_id * 37 % 360 AS DOUBLE)) AS a, radians(CAST(user_id % 20 - 10 AS DOUBLE)) AS p
 FROM events), d AS (SELECT ray, sin(a) * cos(p) AS dx, cos(a) * cos(p) AS dy, sin(p) AS dz FROM r),
h AS (SELECT user_id AS ray, value AS t, value * dx + event_id % 7 * 0.001 AS x, value * dy + event_id % 5 * 0.002 AS y,
 1.5 + value * dz + event_id % 3 * 0.003 AS z, dx, dy, dz FROM events JOIN d ON ray = user_id),
w AS (SELECT *, count(*) OVER (PARTITION BY ray ORDER BY t RANGE BETWEEN CAST(0.7531 AS DOUBLE) PRECEDING AND CAST(0.7531 AS DOUBLE) FOLLOWING) AS n
 FROM h), f AS (SELECT ray, min(t) AS t0 FROM w WHERE n >= 5 GROUP BY ray),
k AS (SELECT w.* FROM w JOIN f ON w.ray = f.ray WHERE t BETWEEN t0 - 0.7531 AND t0 + 0.7531),
c AS (SELECT ray, quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my, quantile_cont(z, 0.5) AS mz, count(*) AS support, any_value(dx) AS dx,
 any_value(dy) AS dy, any_value(dz) AS dz FROM k GROUP BY ray),
s AS (SELECT c.ray, quantile_cont(sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2), 0.5) AS spread FROM k JOIN c ON k.ray = c.ray GROUP BY c.ray)
SELECT c.ray, round(mx, 6) AS x, round(my, 6) AS y, round(mz, 6) AS z, round(mx * dx + my * dy + (mz - 1.5) * dz, 6) AS t, support, round(spread,
 6) AS spread FROM c JOIN s ON c.ray = s.ray WHERE mx * dx + my * dy + (mz - 1.5) * dz BETWEEN 0.4 AND 8""")
def ray_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u, i = table(spark, sf_dir, "events"), F.col("ray"), F.col("event_id")
    d = E.direction((u * 37 % 360).cast("double"), (u % 20 - 10).cast("double"))
    r = e.select(F.col("user_id").alias("ray")).distinct().select("ray", F.lit(0.0).alias("ox"), F.lit(0.0).alias("oy"), F.lit(1.5).alias("oz"), *(c.alias(f"d{n}") for n, c in zip("xyz", d, strict=True)))
    v = F.col("value")
    h = e.withColumnRenamed("user_id", "ray").join(r, "ray").select("ray", v.alias("t"), (v * F.col("dx") + i % 7 * 0.001).alias("x"), (v * F.col("dy") + i % 5 * 0.002).alias("y"), (1.5 + v * F.col("dz") + i % 3 * 0.003).alias("z"))
    return P.first_hit(h, r, 0.7531, 5).select("ray", *(F.round(c, 6).alias(c) for c in ("x", "y", "z", "t")), "support", F.round("spread", 6).alias("spread"))


@query(f"""WITH {A.PTS}, h AS (SELECT room, y - 1 AS h FROM pts WHERE x BETWEEN 1 AND 11 AND y BETWEEN 0 AND 15)
 SELECT room, count(*) FILTER (abs(h) <= 0.05) AS floor, count(*) FILTER (h BETWEEN 0.3 AND 2.0) AS obstacle, count(*) AS n FROM h GROUP BY room""")
def band_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.clip_box(A.points(spark, sf_dir), x=(1.0, 11.0), y=(0.0, 15.0)).withColumn("h", F.col("y") - 1)
    return P.bands(p).groupBy("room").agg(F.count_if("is_floor").alias("floor"), F.count_if("is_obstacle").alias("obstacle"), F.count("*").alias("n"))


@query(f"""WITH {A.PTS} SELECT room, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, count(*) AS n FROM pts GROUP BY room""")
def extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.bounds(A.points(spark, sf_dir), "room")


@query(f"""WITH {A.PTS} SELECT room, round(avg(x), 6) AS mx, round(avg(y), 6) AS my, round(sqrt((avg(x) - 6) ** 2 + (avg(y) - 7) ** 2), 6) AS offset_ FROM pts GROUP BY room""")
def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.points(spark, sf_dir).groupBy("room").agg(F.avg("x").alias("a"), F.avg("y").alias("b"))
    return m.select("room", F.round("a", 6).alias("mx"), F.round("b", 6).alias("my"), F.round(F.sqrt((F.col("a") - 6) ** 2 + (F.col("b") - 7) ** 2), 6).alias("offset_"))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied cells of each room, a block of ten suppliers; empty cells among them are holes."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.floor(F.col("l_suppkey") / 10).alias("room"), P.cell(F.col("l_quantity") / 4, 0.25).alias("ix"), P.cell(F.col("l_extendedprice") / 5000, 0.25).alias("iy")).distinct()


GRID = "gr AS (SELECT room, min(ix) AS ix0, max(ix) AS ix1, min(iy) AS iy0, max(iy) AS iy1 FROM c GROUP BY room)"


def grid(mask: DataFrame) -> DataFrame:
    """The cells that a room's grid has: those between its outermost."""
    return mask.groupBy("room").agg(F.min("ix").alias("ix0"), F.max("ix").alias("ix1"), F.min("iy").alias("iy0"), F.max("iy").alias("iy1"))


MASK = """c AS (SELECT DISTINCT CAST(l_suppkey // 10 AS BIGINT) AS room, CAST(floor(l_quantity / 4 / 0.25) AS BIGINT) AS ix,
 CAST(floor(l_extendedprice / 5000 / 0.25) AS BIGINT) AS iy FROM lineitem)"""
#: Components of four neighbours of the cells ``n`` (room, ix, iy): the smallest cell, as one number, that each reaches.
JOINED = """e AS (SELECT a.room, a.ix, a.iy, b.ix AS jx, b.iy AS jy FROM n a JOIN n b ON a.room = b.room AND abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1),
k(room, ix, iy, root) USING KEY (room, ix, iy) AS (SELECT room, ix, iy, ix * 1000000 + iy FROM n UNION
 (SELECT u.room, u.ix, u.iy, min(v.root) FROM recurring.k u JOIN e ON u.room = e.room AND u.ix = e.ix AND u.iy = e.iy
 JOIN k v ON v.room = e.room AND v.ix = e.jx AND v.iy = e.jy WHERE v.root < u.root GROUP BY u.room, u.ix, u.iy))"""
#: Cells of the box around each room's mask that aren't in it, and those of them that the box's edge doesn't reach.
EMPTY = f"""{MASK}, x AS (SELECT room, min(ix) AS x0, max(ix) AS x1, min(iy) AS y0, max(iy) AS y1 FROM c GROUP BY room),
n AS (SELECT room, ix, iy FROM (SELECT room, ix, y0, y1, unnest(range(y0, y1 + 1)) AS iy FROM (SELECT *, unnest(range(x0, x1 + 1)) AS ix
 FROM x)) EXCEPT SELECT room, ix, iy FROM c), {JOINED},
o AS (SELECT DISTINCT k.room, root FROM k JOIN x ON k.room = x.room WHERE ix IN (x0, x1) OR iy IN (y0, y1)), h AS (SELECT k.room, k.ix, k.iy, k.root
 FROM k LEFT JOIN o ON k.room = o.room AND k.root = o.root WHERE o.root IS NULL)"""
_sq = "(SELECT unnest([-1, 0, 1]) AS i)"


@query(f"""WITH {MASK}, o AS (SELECT a.i AS i, b.i AS j FROM {_sq} a, {_sq} b), d AS (SELECT DISTINCT room, ix + i AS ix, iy + j AS iy FROM c, o)
SELECT room, ix - i AS ix, iy - j AS iy FROM d, o GROUP BY 1, 2, 3 HAVING count(*) = 9""")
def morphology_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.closed(mask(spark, sf_dir), "room")


@query(f"""WITH {MASK}, o AS (SELECT unnest([0, 1, -1, 0, 0]) AS i, unnest([0, 0, 0, 1, -1]) AS j), e AS (SELECT room, ix - i AS ix, iy - j AS iy FROM c, o
 GROUP BY 1, 2, 3 HAVING count(*) = 5) SELECT DISTINCT room, ix + i AS ix, iy + j AS iy FROM e, o""")
def morphology_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.opened(mask(spark, sf_dir), "room", P.CROSS)


@query(f"""WITH RECURSIVE {MASK}, n AS (SELECT * FROM c), {JOINED} SELECT room, root // 1000000 AS ix, root % 1000000 AS iy, count(*) AS size FROM k GROUP BY room, root""")
def grid_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected cells (four neighbours) with their sizes; a test compares with a flood fill too."""
    cells = P.labelled(mask(spark, sf_dir), "room", C.components)
    return cells.groupBy("root").agg(F.count("*").alias("size")).select("root.room", "root.ix", "root.iy", "size")


@query(f"""WITH RECURSIVE {EMPTY} SELECT room, ix, iy FROM c UNION ALL SELECT room, ix, iy FROM h""")
def filled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask with its holes filled; a test compares with a flood fill."""
    return P.filled(mask(spark, sf_dir), "room", C.components)


@query(f"""WITH {MASK}, {GRID}, f AS (SELECT s_suppkey // 10 AS room, s_suppkey AS point, CAST(floor((s_suppkey % 12) / 0.25) AS BIGINT) AS cx,
 CAST(floor((s_suppkey % 19) / 0.25) AS BIGINT) AS cy FROM supplier),
o AS (SELECT a.i, b.j FROM (SELECT unnest(range(-4, 5)) AS i) a, (SELECT unnest(range(-4, 5)) AS j) b WHERE i * i + j * j <= 16),
w AS (SELECT f.room, point, least(greatest(cx, ix0), ix1) AS nx, least(greatest(cy, iy0), iy1) AS ny, cx - 4 >= ix0 AND cx + 4 <= ix1 AND cy - 4 >= iy0 AND cy + 4 <= iy1 AS whole
 FROM f JOIN gr ON gr.room = f.room),
 k AS (SELECT room, point, nx + i AS ix, ny + j AS iy FROM w, o WHERE whole UNION ALL SELECT room, point, nx, ny FROM w WHERE NOT whole)
SELECT point, round(avg(CASE WHEN c.ix IS NULL THEN 0.0 ELSE 1.0 END), 6) AS share, avg(CASE WHEN c.ix IS NULL THEN 0.0 ELSE 1.0 END) > 0.5 AS blocked
 FROM k LEFT JOIN c ON k.room = c.room AND k.ix = c.ix AND k.iy = c.iy GROUP BY point""")
def disc_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    c = table(spark, sf_dir, "supplier").select(F.floor(k / 10).alias("room"), k.alias("point"), (k % 12).cast("double").alias("x"), (k % 19).cast("double").alias("y"))
    return P.disc_share(c, mask(spark, sf_dir), grid(mask(spark, sf_dir)), 1.0, 0.25, "room").select("point", F.round("share", 6).alias("share"), "blocked")


@query(f"""WITH {MASK}, {GRID}, d AS (SELECT s_suppkey AS device, s_suppkey // 10 AS room, CAST(s_suppkey % 11 AS DOUBLE) + 0.4 AS x,
 CAST(s_suppkey % 17 AS DOUBLE) + 0.3 AS y FROM supplier),
s AS (SELECT *, unnest(['+x', '-x', '+y', '-y']) AS side, unnest([0, 1, 2, 3]) AS k, unnest([0.15, -1.0, -0.3, -0.3]) AS a, unnest([1.0, -0.15, 0.3,
 0.3]) AS b, unnest([-0.3, -0.3, 0.15, -1.0]) AS p, unnest([0.3, 0.3, 1.0, -0.15]) AS q FROM d),
g AS (SELECT s.*, iy0, iy1, unnest(range(greatest(ix0, CAST(floor((x + a) / 0.25 + 1e-6) AS BIGINT)), least(ix1 + 1, CAST(ceil((x + b) / 0.25 - 1e-6) AS BIGINT)))) AS ix FROM s JOIN gr USING (room)),
 w0 AS (SELECT *, unnest(range(greatest(iy0, CAST(floor((y + p) / 0.25 + 1e-6) AS BIGINT)), least(iy1 + 1, CAST(ceil((y + q) / 0.25 - 1e-6) AS BIGINT)))) AS iy FROM g),
 w AS (SELECT s.room, s.device, s.side, s.k, w0.ix, w0.iy FROM s LEFT JOIN w0 ON w0.device = s.device AND w0.side = s.side),
h AS (SELECT device, side, k, avg(CASE WHEN c.ix IS NULL THEN 0.0 ELSE 1.0 END) AS share FROM w LEFT
 JOIN c ON c.room = w.room AND c.ix = w.ix AND c.iy = w.iy GROUP BY 1, 2, 3)
SELECT device, arg_max(side, (share, -k)) AS side, round(max(share), 6) AS share FROM h GROUP BY device""")
def facing_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    d = table(spark, sf_dir, "supplier").select(k.alias("device"), F.floor(k / 10).alias("room"), ((k % 11).cast("double") + 0.4).alias("x"), ((k % 17).cast("double") + 0.3).alias("y"))
    return P.facing(d, mask(spark, sf_dir), grid(mask(spark, sf_dir)), "room", 0.25).select("device", "side", F.round("share", 6).alias("share"))


@query(f"""WITH {MASK}, d AS (SELECT * FROM c WHERE ix % 2 = 0), e AS (SELECT * FROM c WHERE iy % 2 = 0) SELECT 'and' AS op, count(*) AS n FROM (SELECT *
 FROM d INTERSECT SELECT * FROM e)
UNION ALL SELECT 'or', count(*) FROM (SELECT * FROM d UNION SELECT * FROM e) UNION ALL SELECT 'minus', count(*) FROM (SELECT * FROM d EXCEPT SELECT * FROM e)""")
def mask_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """And, or and minus of two masks, the cells of even columns and of even rows."""
    m = mask(spark, sf_dir)
    a, b = m.where("ix % 2 = 0"), m.where("iy % 2 = 0")
    n = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    keys = ["room", "ix", "iy"]
    return n(a.join(b, keys, "left_semi"), "and").unionByName(n(a.unionByName(b).distinct(), "or")).unionByName(n(a.join(b, keys, "left_anti"), "minus"))


@query("""WITH o AS (SELECT user_id, event_id, value, CASE WHEN value - lag(value) OVER w > 2.0 THEN 1 ELSE 0 END AS n
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id)),
g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY value, event_id) AS grp FROM o)
 SELECT user_id, CAST(grp AS BIGINT) AS grp, count(*) AS n, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM g GROUP BY 1, 2""")
def gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.gap_groups(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "value", 2.0, "event_id")
    return g.groupBy("user_id", F.col("group").cast("long").alias("grp")).agg(F.count("*").alias("n"), F.round(F.min("value"), 6).alias("lo"), F.round(F.max("value"), 6).alias("hi"))


@query("""WITH n AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value > 5 AS f FROM events),
 k AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM n WHERE f)
SELECT user_id, CAST(min(i) AS INTEGER) AS first, CAST(max(i) + 1 AS INTEGER) AS "end" FROM k GROUP BY user_id, g""")
def true_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.runs(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("value") > 5)


@query("""SELECT s_nationkey AS site, s_suppkey AS a, lead(s_suppkey) OVER w AS b, round(abs(lead(s_acctbal) OVER w - s_acctbal), 4) AS step
 FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey) QUALIFY b IS NOT NULL""")
def route_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    s = table(spark, sf_dir, "supplier").withColumn("b", F.lead("s_suppkey").over(w)).withColumn("nb", F.lead("s_acctbal").over(w)).where("b is not null")
    return s.select(F.col("s_nationkey").alias("site"), F.col("s_suppkey").alias("a"), "b", F.round(F.abs(F.col("nb") - F.col("s_acctbal")), 4).alias("step"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_acctbal / 5000 NOT BETWEEN 1.0 AND 1.8 THEN true ELSE false END AS camera_outlier, CASE
 WHEN s_acctbal / 5000 NOT BETWEEN 1.2 AND 2.0 THEN 'height' END AS flag FROM supplier""")
def height_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("s_acctbal") / 5000
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (~h.between(1.0, 1.8)).alias("camera_outlier"), F.when(~h.between(1.2, 2.0), "height").alias("flag"))


@query("""WITH p AS (SELECT c_custkey AS id, c_acctbal / 100 AS x, CAST(c_custkey % 97 AS DOUBLE) AS y FROM customer),
 b AS (SELECT floor(min(x)) - 1 AS x0, ceil(max(y)) + 1 AS y1 FROM p)
SELECT id, round((x - x0) / 0.05, 4) AS px, round((y1 - y) / 0.05, 4) AS py FROM p, b""")
def plan_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") % 97).cast("double").alias("y"))
    x0, y1 = p.agg(F.floor(F.min("x")) - 1, F.ceil(F.max("y")) + 1).first()  # two numbers
    px, py = E.plan_pixel(F.col("x"), F.col("y"), F.lit(float(x0)), F.lit(float(y1)), 0.05)
    return p.select("id", F.round(px, 4).alias("px"), F.round(py, 4).alias("py"))


BOUNDS = """b AS (SELECT c_custkey // 120 AS site, CAST(floor(min(c_acctbal) / 100) - 1 AS BIGINT) AS x0, CAST(ceil(max(c_acctbal) / 100) + 1 AS BIGINT) AS x1,
 min(c_custkey % 97) - 1 AS y0, max(c_custkey % 97) + 1 AS y1 FROM customer GROUP BY 1)"""


def plan_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return Y.plan_bounds(table(spark, sf_dir, "customer").select(F.floor(k / 120).alias("site"), (F.col("c_acctbal") / 100).alias("x"), (k % 97).alias("y")), "site")


@query(f"WITH {BOUNDS} SELECT site, x0, x1, y0, y1, round((x1 - x0) / 1000, 8) AS mpp, CAST(floor((y1 - y0) / ((x1 - x0) / 1000) + 0.5) AS BIGINT) AS height_px FROM b")
def layout_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of an approximate plan for each site, and its scale."""
    return plan_of(spark, sf_dir).withColumn("mpp", F.round("mpp", 8))


@query(f"""WITH {BOUNDS}, l AS (SELECT *, 'x' AS axis, unnest(generate_series(CAST(ceil(x0 / 10) * 10 AS BIGINT), CAST(floor(x1 / 10) * 10 AS BIGINT),
 10)) AS at_ FROM b UNION ALL SELECT *, 'y', unnest(generate_series(CAST(ceil(y0 / 10) * 10 AS BIGINT), CAST(floor(y1 / 10) * 10 AS BIGINT), 10))
 FROM b)
SELECT site, axis, at_ AS "at", round(CASE axis WHEN 'x' THEN at_ - x0 ELSE y1 - at_ END / ((x1 - x0) / 1000), 5) AS px FROM l""")
def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid lines every ten metres across both axes of each plan."""
    return Y.grid_lines(plan_of(spark, sf_dir), "site").withColumn("px", F.round("px", 5))


@query("""WITH e AS (SELECT event_id AS id, CAST(event_id * 53 % 2000 AS DOUBLE) AS u, CAST(event_id * 31 % 1000 AS DOUBLE) AS v FROM events)
 SELECT id, round(u, 4) AS u, round(v, 4) AS v, round((u / 2000 - 0.5) * 360, 6) AS yaw, round((0.5 - v / 1000) * 180, 6) AS pitch FROM e""")
def world_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image points to world directions and back by the camera's quaternion, and the directions of an equirectangular picture."""
    i = F.col("event_id")
    u, v, h = (i * 53 % 2000).cast("double"), (i * 31 % 1000).cast("double"), F.radians((i % 360).cast("double")) / 2
    camera = F.lit(1.2), F.lit(0.001), F.lit(1000.0), F.lit(500.0)
    q = F.cos(h), F.lit(0.0), F.sin(h), F.lit(0.0)
    pu, pv = E.pinhole_point(E.turned_back(q, E.rotate(q, E.pinhole_direction(u, v, *camera))), *camera)
    yaw, pitch = E.equirect_direction(u, v, 2000, 1000)
    return table(spark, sf_dir, "events").select(i.alias("id"), F.round(pu, 4).alias("u"), F.round(pv, 4).alias("v"), F.round(yaw, 6).alias("yaw"), F.round(pitch, 6).alias("pitch"))


@query("""WITH e AS (SELECT event_id AS id, CAST(event_id * 53 % 2000 AS DOUBLE) AS u, CAST(event_id * 31 % 1000 AS DOUBLE) AS v,
 radians(CAST(event_id % 360 AS DOUBLE)) / 2 AS h FROM events),
c AS (SELECT id, h, (u - 1000) * 0.001 / 1.2 AS x, -(v - 500) * 0.001 / 1.2 AS y FROM e),
 n AS (SELECT id, h, x / sqrt(x * x + y * y + 1) AS x, y / sqrt(x * x + y * y + 1) AS y, -1 / sqrt(x * x + y * y + 1) AS z FROM c),
r AS (SELECT id, (1 - 2 * sin(h) * sin(h)) * x - 2 * cos(h) * sin(h) * y AS wx, 2 * cos(h) * sin(h) * x + (1 - 2 * sin(h) * sin(h)) * y AS wy, z AS wz FROM n)
SELECT id, round(degrees(atan2(wx, wy)), 5) AS yaw, round(degrees(asin(greatest(least(wz / sqrt(wx * wx + wy * wy + wz * wz), 1), -1))), 5) AS pitch FROM r""")
def pixel_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World direction of image points, by the pinhole model and the camera's quaternion."""
    i = F.col("event_id")
    u, v, h = (i * 53 % 2000).cast("double"), (i * 31 % 1000).cast("double"), F.radians((i % 360).cast("double")) / 2
    d = E.pinhole_direction(u, v, F.lit(1.2), F.lit(0.001), F.lit(1000.0), F.lit(500.0))
    yaw, pitch, _ = E.view(*E.rotate((F.cos(h), F.lit(0.0), F.lit(0.0), F.sin(h)), d))
    return table(spark, sf_dir, "events").select(i.alias("id"), F.round(yaw, 5).alias("yaw"), F.round(pitch, 5).alias("pitch"))


@query("""WITH s AS (SELECT s_suppkey AS scan FROM supplier), v AS (SELECT 0 AS k, 90 AS fov, 1.0 AS st, unnest(range(0, 360, 45)) AS yaw, [0] AS ps
 UNION ALL SELECT 1, 45, 1.0, unnest(range(0, 360, 30)), [0, 20]
 UNION ALL SELECT 2, 45, 2.0, unnest(range(0, 360, 14)), [0, 20] UNION ALL SELECT 3, 45, 3.5, unnest(range(0, 360, 8)), [0, 20])
SELECT scan, CAST(k AS INTEGER) AS "set", CAST(fov AS INTEGER) AS fov, CAST(st AS DOUBLE) AS stretch, CAST(yaw AS INTEGER) AS yaw,
 CAST(unnest(ps) AS INTEGER) AS pitch FROM s, v""")
def view_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """174 virtual views of each scan, in four sets (8, 24, 52 and 90)."""
    return Y.view_grid(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("scan")))


@query("""WITH d AS (SELECT c_custkey AS dir, c_custkey // 120 AS site, radians(CAST(c_custkey * 7 % 360 AS DOUBLE)) AS y FROM customer),
 c AS (SELECT s_suppkey AS camera, s_suppkey // 8 AS site, radians(CAST(s_suppkey * 60 % 360 AS DOUBLE)) AS y FROM supplier),
p AS (SELECT d.site, dir, camera, round(sin(d.y) * sin(c.y) + cos(d.y) * cos(c.y), 12) + 0.0 AS cs FROM d JOIN c ON d.site = c.site)
 SELECT site, dir, arg_max(camera, (cs, -camera)) AS camera, round(max(cs), 6) AS cos FROM p GROUP BY 1, 2""")
def best_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.radians((F.col("c_custkey") * 7 % 360).cast("double")), F.radians((F.col("s_suppkey") * 60 % 360).cast("double"))
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("dir"), F.floor(F.col("c_custkey") / 120).alias("site"), F.sin(a).alias("dx"), F.cos(a).alias("dy"), F.lit(0.0).alias("dz"))
    c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("camera"), F.floor(F.col("s_suppkey") / 8).alias("site"), F.sin(b).alias("cx"), F.cos(b).alias("cy"), F.lit(0.0).alias("cz"))
    return Y.best_source(d, c, "site").withColumn("cos", F.round("cos", 6))


@query()
def largest_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy rectangles that cover the mask exactly; a test checks the cover and the first against brute force."""
    return Y.rectangles(mask(spark, sf_dir), "room")


@query()
def contour_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corner rings; their signed areas add up to the number of cells (tested)."""
    return Y.contours(P.opened(mask(spark, sf_dir), "room", P.CROSS), "room").select("room", "ring", "corners", "area")


@query(f"""WITH {MASK}, a AS (SELECT room, 'x' AS axis, iy AS line, ix AS v FROM c UNION ALL SELECT room, 'y', ix, iy FROM c),
 g AS (SELECT *, v - row_number() OVER (PARTITION BY room, axis, line ORDER BY v) AS k FROM a)
SELECT room, axis, line, min(v) AS start, max(v) AS "end" FROM g GROUP BY room, axis, line, k HAVING count(*) >= 6""")
def wall_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.walls(mask(spark, sf_dir), "room", 6)


def outlines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sides of the rooms, the boxes around their cells; columns as high as walls; bounds, of every third room at its top."""
    m = mask(spark, sf_dir)
    e = grid(m).select("room", *((F.col(f"i{c}{n}") * 0.25 + (0.25 if n else 0.0)).alias(f"{c}{n}") for c in "xy" for n in (0, 1)))
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    rings = e.select("room", F.lit(0).alias("ring"), F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")).alias("points"))
    b = e.select("room", (F.col("x0") - 1).alias("x0"), (F.col("x1") + 1).alias("x1"), (F.col("y0") - 1).alias("y0"), (F.col("y1") + F.when(F.col("room") % 3 == 0, 0.05).otherwise(1.0)).alias("y1"))
    return Y.sides_of(rings, "room"), m.where("ix % 13 > 5 and iy % 17 > 8 or (ix + iy) % 23 = 0"), b


SIDES = f"""{MASK}, {GRID}, gx AS (SELECT room, ix0 * 0.25 AS x0, ix1 * 0.25 + 0.25 AS x1, iy0 * 0.25 AS y0, iy1 * 0.25 + 0.25 AS y1 FROM gr),
sd AS (SELECT room, 0 AS side, true AS flat, y0 AS pos, x0 AS lo, x1 AS hi, 1 AS inward, false AS cut FROM gx UNION ALL SELECT room, 1, false, x1, y0, y1, -1, false FROM gx
 UNION ALL SELECT room, 2, true, y1, x0, x1, -1, room % 3 = 0 FROM gx UNION ALL SELECT room, 3, false, x0, y0, y1, 1, false FROM gx),
sn AS (SELECT *, CAST(ceil((hi - lo) / 0.25 - 1e-9) AS BIGINT) AS n, least(pos - inward * 0.15, pos + inward * 0.4) AS n0, greatest(pos - inward * 0.15, pos + inward * 0.4) AS n1 FROM sd),
tall AS (SELECT * FROM c WHERE ix % 13 > 5 AND iy % 17 > 8 OR (ix + iy) % 23 = 0),
hit AS (SELECT DISTINCT s.room, side, n, CAST((CASE WHEN flat THEN t.ix ELSE t.iy END) - round(lo / 0.25) AS BIGINT) AS k FROM sn s JOIN tall t ON t.room = s.room AND NOT cut
 AND CASE WHEN flat THEN t.iy ELSE t.ix END BETWEEN floor(n0 / 0.25 + 1e-6) AND ceil(n1 / 0.25 - 1e-6) - 1 WHERE CASE WHEN flat THEN t.ix ELSE t.iy END BETWEEN round(lo / 0.25) AND round(hi / 0.25) - 1),
al AS (SELECT * FROM hit UNION ALL SELECT room, side, n, -1 FROM sn WHERE NOT cut UNION ALL SELECT room, side, n, n FROM sn WHERE NOT cut),
nw AS (SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY room, side ORDER BY k) > 4 THEN 1 ELSE 0 END AS fresh FROM al),
rn AS (SELECT *, sum(fresh) OVER (PARTITION BY room, side ORDER BY k) AS run FROM nw),
wl AS (SELECT room, side, greatest(min(k), 0) AS a, least(max(k), any_value(n) - 1) + 1 AS b FROM rn GROUP BY room, side, run HAVING least(max(k), any_value(n) - 1) + 1 - greatest(min(k), 0) >= 2),
op AS (SELECT room, side, coalesce(lag(b) OVER v, 0) AS a, a AS b FROM wl WINDOW v AS (PARTITION BY room, side ORDER BY a)
 UNION ALL SELECT s.room, s.side, coalesce(max(w.b), 0), s.n FROM sn s LEFT JOIN wl w ON w.room = s.room AND w.side = s.side GROUP BY s.room, s.side, s.n),
iv AS (SELECT room, side, true AS wall, a, b FROM wl UNION ALL SELECT room, side, false, a, b FROM op WHERE a < b)"""


@query(f"""WITH {SIDES} SELECT iv.room, CAST(iv.side AS INTEGER) AS side, wall, CAST(round(CASE WHEN a = 0 THEN lo - CASE WHEN cut THEN 0.17 ELSE 0 END ELSE lo + a * 0.25 END, 6) AS DOUBLE) AS s0,
 CAST(round(CASE WHEN b = n THEN hi + CASE WHEN cut THEN 0.17 ELSE 0 END ELSE lo + b * 0.25 END, 6) AS DOUBLE) AS s1 FROM iv JOIN sn ON sn.room = iv.room AND sn.side = iv.side""")
def wall_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the sides of the rooms' boxes have walls, and their openings."""
    i = Y.wall_intervals(*outlines(spark, sf_dir), "room", 0.25)
    return i.select("room", "side", "wall", F.round("s0", 6).alias("s0"), F.round("s1", 6).alias("s1"))


@query()
def wall_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walls of the rooms' boxes, without their openings, as polygons; tests have known rooms."""
    sides, tall, bounds = outlines(spark, sf_dir)
    p = Y.wall_polygons(sides, Y.wall_intervals(sides, tall, bounds, "room", 0.25), "room")
    return p.select("room", "polygon", F.size("points").alias("corners"), F.size("holes").alias("holes"), F.round("area", 6).alias("area"))


@query()
def room_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons of the opened mask with their holes."""
    p = Y.polygons(P.opened(mask(spark, sf_dir), "room", P.CROSS), "room", 0.25, least_edge=0.3, step=0.05, least_area=0.02)
    return p.select("room", "polygon", F.size("points").alias("corners"), F.size("holes").alias("holes"), F.round("area", 4).alias("area"))


@query()
def equipment_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the opened mask's components, with heights by the columns' tops, against the sides of the rooms' boxes."""
    sides, _, _ = outlines(spark, sf_dir)
    cells = P.opened(mask(spark, sf_dir), "room", P.CROSS).withColumn("height", F.when((F.col("ix") + F.col("iy")) % 5 != 0, F.lit(0.3) + F.col("iy") % 7 * 0.3))
    return Y.boxes(cells, "room", 0.25, C.components, sides)


@query("""WITH r AS (SELECT c_custkey AS id, CAST(c_custkey % 10 AS DOUBLE) AS a, CAST(c_custkey % 7 AS DOUBLE) AS b, c_custkey % 5 AS odd FROM customer)
 SELECT id, odd > 1 AND b <> 0 AS rect, CASE WHEN odd > 1 AND b <> 0 THEN a + 1 END AS xb FROM r""")
def rectangle_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of four corners; of each five one has a corner moved and one is a bow tie, and some have no height."""
    k = F.col("c_custkey")
    a, b = (k % 10).cast("double"), (k % 7).cast("double")
    z = F.lit(0.0)
    ring = F.array(F.array(a, z), F.array(F.when(k % 5 == 1, a).otherwise(a + 1), F.when(k % 5 == 1, b).otherwise(z)), F.array(F.when(k % 5 == 0, a + 2).otherwise(a + 1), F.when(k % 5 == 1, z).otherwise(b)),
                   F.array(F.when(k % 5 == 1, a + 1).otherwise(a), b))
    return table(spark, sf_dir, "customer").select(k.alias("id"), Y.is_rectangle(ring).alias("rect"), Y.as_rectangle(ring)["xb"].alias("xb"))


@query()
def cabinet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels of the rows of each room; tests have rooms with known rows."""
    return Y.cabinet_rows(*row_inputs(spark, sf_dir), "room", 0.25)


def row_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as devices before the mask's cells."""
    k = F.col("s_suppkey")
    d = table(spark, sf_dir, "supplier").select(F.floor(k / 10).alias("room"), k.alias("id"), F.when(k % 2 == 0, 4.9).otherwise(8.2).alias("x"), (2.0 + k % 10 * 0.8).alias("y"), F.when(k % 2 == 0, "+x").otherwise("-y").alias("side"))
    c = mask(spark, sf_dir).select("room", "ix", "iy", (F.col("ix") >= 20).alias("floor"), (F.col("ix") < 20).alias("solid"), F.lit(True).alias("inside"), (F.lit(1.5) + F.col("iy") % 4 * 0.3).alias("top"))
    return d, c


@query()
def device_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices of ``cabinet_rows`` on the faces of their cabinets."""
    return Y.device_faces(*Y.row_frames(*row_inputs(spark, sf_dir), "room", 0.25), "room")


@query(f"""WITH RECURSIVE {MASK}, cr AS (SELECT unnest([0, 1, -1, 0, 0]) AS i, unnest([0, 0, 0, 1, -1]) AS j), e0 AS (SELECT room, ix - i AS ix, iy - j AS iy FROM c, cr
 GROUP BY 1, 2, 3 HAVING count(*) = 5), o AS (SELECT DISTINCT room, ix + i AS ix, iy + j AS iy FROM e0, cr),
al AS (SELECT room * 2 AS room, iy AS line, ix AS v FROM o UNION ALL SELECT room * 2 + 1, ix, iy FROM o),
g AS (SELECT *, v - row_number() OVER (PARTITION BY room, line ORDER BY v) AS run FROM al), w AS (SELECT *, count(*) OVER (PARTITION BY room, line, run) AS m FROM g),
n AS (SELECT room, line AS ix, v AS iy FROM w WHERE m >= 3), {JOINED},
z AS (SELECT room, min(iy) * 0.25 AS a, (max(iy) + 1) * 0.25 AS b, (quantile_cont(ix, 0.5) + 0.5) * 0.25 AS mid FROM k GROUP BY room, root HAVING (max(ix) - min(ix) + 1) * 0.25 <= 1.0)
SELECT room // 2 AS room, CASE room % 2 WHEN 0 THEN 'x' ELSE 'y' END AS axis, CAST(CASE room % 2 WHEN 0 THEN a ELSE mid - 0.075 END AS DOUBLE) AS x0, CAST(CASE room % 2 WHEN 0 THEN b ELSE mid + 0.075 END AS DOUBLE) AS x1,
 CAST(CASE room % 2 WHEN 0 THEN mid - 0.075 ELSE a END AS DOUBLE) AS y0, CAST(CASE room % 2 WHEN 0 THEN mid + 0.075 ELSE b END AS DOUBLE) AS y1 FROM z""")
def partition_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight lines of tall cells; a test has a room with known walls."""
    return Y.partitions(P.opened(mask(spark, sf_dir), "room", P.CROSS), "room", 0.25, thickest=1.0)


@query(f"""WITH RECURSIVE {MASK}, n AS (SELECT * FROM c), {JOINED},
 z AS (SELECT room, root, count(*) AS m, count(*) FILTER (iy % 4 = 0) AS low FROM k GROUP BY room, root)
SELECT k.room, k.ix, k.iy FROM k JOIN z ON k.room = z.room AND k.root = z.root WHERE m * 0.0625 >= 0.5 AND low >= 2 AND low >= 0.2 * m""")
def supported_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the mask that are large enough and stand on enough cells."""
    m = mask(spark, sf_dir)
    return P.kept_components(m, "room", C.components, 0.5, 0.25, support=m.where("iy % 4 = 0"), least_support=2, least_share=0.2)


@query("""SELECT vec_id, CAST(vec_id % 64 AS INTEGER) AS shift, true AS sure FROM embeddings""")
def ring_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked circular correlation of each vector with itself turned by a known shift, which it must find."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    k = (F.col("vec_id") % 64).cast("int")
    turned = F.concat(F.slice("a", 65 - k, k), F.slice("a", F.lit(1), 64 - k))
    out = Y.ring_shift(e.select("vec_id", "a", F.when(k == 0, F.col("a")).otherwise(turned).alias("b")), "vec_id")
    return out.select("vec_id", F.pmod(F.round("shift"), F.lit(64.0)).cast("int").alias("shift"), (F.col("peak") > 0.99).alias("sure"))


_vertex = "CASE WHEN abs({l} - 2 * {m} + {r}) > 1e-12 THEN 0.5 * ({l} - {r}) / ({l} - 2 * {m} + {r}) ELSE 0 END"


# every shift by all products; the three tilts of four rows by the rows that both pictures have
@query(f"""WITH px AS (SELECT vec_id, unnest(range(64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings),
a AS (SELECT vec_id, i // 16 AS y, i % 16 AS x, v FROM px),
b AS (SELECT vec_id, y, CASE WHEN vec_id % 9 = 0 THEN (x + 1) % 16 ELSE x END AS x, v FROM a),
pic AS (SELECT false AS mirror, vec_id, y, x, v FROM a UNION ALL SELECT true, vec_id, y, 15 - x, v FROM a),
c AS (SELECT mirror, a.vec_id, (b.x - a.x + 16) % 16 AS s, sum(a.v * b.v) AS ab, sum(a.v) AS sa, sum(b.v) AS sb, sum(a.v * a.v) AS aa, sum(b.v * b.v) AS bb FROM pic a JOIN b ON a.vec_id = b.vec_id AND a.y = b.y GROUP BY 1, 2, 3),
r AS (SELECT mirror, vec_id, s, (ab - sa * sb / 64) / sqrt((aa - sa * sa / 64) * (bb - sb * sb / 64)) AS r FROM c),
t AS (SELECT mirror, vec_id, arg_max(s, r) AS t, max(r) AS peak FROM r GROUP BY 1, 2),
n AS (SELECT t.vec_id, t, peak, max(r) FILTER (r.s = (t + 15) % 16) AS l, max(r) FILTER (r.s = (t + 1) % 16) AS h, max(r) FILTER (r.s <> t) AS far FROM t JOIN r ON r.vec_id = t.vec_id AND NOT r.mirror AND NOT t.mirror GROUP BY 1, 2, 3),
w AS (SELECT *, t + {_vertex.format(l="l", m="peak", r="h")} AS shift FROM n),
d AS (SELECT w.vec_id, b.y - a.y AS d, corr(a.v, b.v) AS fit FROM w JOIN a ON a.vec_id = w.vec_id JOIN b ON b.vec_id = w.vec_id AND b.x = (a.x + CAST(floor(shift + 0.5) AS BIGINT) + 16) % 16 AND abs(b.y - a.y) <= 1 GROUP BY 1, 2),
f AS (SELECT vec_id, max(fit) FILTER (d = -1) AS l, max(fit) FILTER (d = 0) AS m, max(fit) FILTER (d = 1) AS h FROM d GROUP BY 1),
p AS (SELECT vec_id, CASE WHEN m > l AND m >= h THEN {_vertex.format(l="l", m="m", r="h")} WHEN l >= m AND l >= h THEN -1 ELSE 1 END AS tilt FROM f),
ok AS (SELECT abs(CASE WHEN w.shift > 8 THEN w.shift - 16 ELSE w.shift END) * 22.5 < 0.5 AND abs(tilt) * 45 < 0.5 AND NOT m.peak > 1.05 * w.peak AND (far <= 0 OR w.peak / far > 1.1) AS ok
 FROM w JOIN p ON w.vec_id = p.vec_id JOIN t m ON m.vec_id = w.vec_id AND m.mirror)
SELECT 'A3' AS gate, bool_and(ok) AS passed, round(avg(CAST(ok AS DOUBLE)), 5) AS value FROM ok""")
def reprojection_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate A3 over vectors as pictures of four rows, one in nine turned by a bin; tests have known pictures."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    row = lambda k: F.slice("v", F.lit(16 * k + 1), F.lit(16))
    turn = lambda r: F.when(F.col("vec_id") % 9 == 0, F.concat(F.slice(r, 16, 1), F.slice(r, 1, 15))).otherwise(r)
    rows = [row(k) for k in range(4)]
    pictures = e.select("vec_id", F.array(*rows).alias("render"), F.array(*map(turn, rows)).alias("photo"), F.array(*map(F.reverse, rows)).alias("mirror"))
    return gates.reprojected(Y.reprojection(pictures, "vec_id")).withColumn("value", F.round("value", 5))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the events as a stream, in hourly windows; every batch's changed windows are appended, the last of each counts."""
    from sightline.streaming import log

    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    static = table(spark, sf_dir, "events")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    events = log.read_stream(spark, f"{sf_dir}/events.parquet*", static.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    q = log.event_windows(events, "1 hour", "1 day").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    last = out.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("v"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "v.n", F.round("v.total", 4).alias("total"))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f
 FROM events), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sessions of each user with a gap of six hours, by the stream's own operator over the whole table."""
    from sightline.streaming import log

    return log.event_sessions(table(spark, sf_dir, "events"), "6 hours", "1 day")


@query("""WITH p AS (SELECT c_custkey AS panel, CAST(c_custkey % 50 AS DOUBLE) AS x, CAST(c_custkey % 30 AS DOUBLE) AS y,
 CAST(0.6 + c_custkey % 7 * 0.1 AS DOUBLE) AS w, CAST(0.8 + c_custkey % 3 * 0.2 AS DOUBLE) AS d, CAST(0.3 + c_custkey % 23 * 0.1 AS DOUBLE) AS h,
 c_custkey % 4 AS f FROM customer),
q AS (SELECT *, least(0.05, (w - 0.016) / 6) AS i, CASE WHEN h >= 1.9 THEN least(1.55, h - 0.6) END AS m, h - 0.08 AS top FROM p),
l AS (SELECT *, unnest(CASE WHEN top - 0.2 < 0.3 THEN [] WHEN m IS NULL THEN [0.18] ELSE [0.18, m + 0.03] END) AS lo, unnest(CASE
 WHEN top - 0.2 < 0.3 THEN [] WHEN m IS NULL THEN [top] ELSE [m - 0.03, top] END) AS hi FROM q),
b AS (SELECT panel, 'plinth' AS part, x, y, w, d, f, 0.008 AS s0, w - 0.008 AS s1, 0.04 AS n0, d AS n1, 0.0 AS z0, 0.1 AS z1 FROM q UNION ALL
 SELECT panel, 'body', x, y, w, d, f, 0.008, w - 0.008, 0, d, 0.1, h FROM q
 UNION ALL SELECT panel, 'door', x, y, w, d, f, 0.008 + i, w - 0.008 - i, -0.012, 0, lo, hi FROM l
 UNION ALL SELECT panel, 'handle', x, y, w, d, f, w - 0.078 - i, w - 0.048 - i, -0.037, -0.012, least(greatest((lo + hi) / 2, lo + 0.1),
 hi - 0.1) - 0.09, least(greatest((lo + hi) / 2, lo + 0.1), hi - 0.1) + 0.09 FROM l),
c AS (SELECT panel, part, z0, z1, CASE f WHEN 0 THEN [x + s0, x + s1, y + n0, y + n1] WHEN 1 THEN [x + d - n1, x + d - n0, y + s0, y + s1]
 WHEN 2 THEN [x + w - s1, x + w - s0, y + d - n1, y + d - n0] ELSE [x + n0, x + n1, y + w - s1, y + w - s0] END AS v FROM b)
SELECT panel, part, round(v[1], 3) AS xa, round(v[2], 3) AS xb, round(v[3], 3) AS ya, round(v[4], 3) AS yb, round(z0, 6) AS z0, round(z1, 6) AS z1 FROM c""")
def cabinet_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels that look to each of the four sides, the first by default."""
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(k.alias("panel"), (k % 50).cast("double").alias("x"), (k % 30).cast("double").alias("y"), (0.6 + k % 7 * 0.1).alias("w"), (0.8 + k % 3 * 0.2).alias("d"), (0.3 + k % 23 * 0.1).alias("height"), (k % 4).alias("f"))
    across, deep = (F.when(F.col("f") % 2 == 0, F.col(a)).otherwise(F.col(b)) for a, b in (("w", "d"), ("d", "w")))
    x, y, xb, yb = F.col("x"), F.col("y"), F.col("x") + across, F.col("y") + deep
    ring = F.array(F.array(x, y), F.array(xb, y), F.array(xb, yb), F.array(x, yb))
    fx, fy = F.when(F.col("f") == 1, 1).when(F.col("f") == 2, 0).when(F.col("f") == 3, -1), F.when(F.col("f") == 2, 1).when(F.col("f") > 0, 0)
    out = Y.cabinet_parts(p.select("panel", ring.alias("ring"), "height", fx.alias("fx"), fy.alias("fy")))
    return out.select("panel", "part", *(F.round(c, 3).alias(c) for c in ("xa", "xb", "ya", "yb")), F.round("z0", 6).alias("z0"), F.round("z1", 6).alias("z1"))


@query("""WITH d AS (SELECT s_suppkey AS device, s_acctbal / 1000 AS x, CAST(s_suppkey % 9 AS DOUBLE) AS y, 1.5 AS z, s_suppkey % 3 AS place, 3 AS size FROM supplier)
SELECT device, round(x - 0.25, 6) AS bx, round(y - (place - 1) * 0.34, 6) AS by_, round(CAST(CASE WHEN device % 2 = 0 THEN 2.2
 ELSE 1.5 END + 0.55 AS DOUBLE), 6) AS bz FROM d""")
def badge_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    d = table(spark, sf_dir, "supplier").select(k.alias("device"), (F.col("s_acctbal") / 1000).alias("x"), (k % 9).cast("double").alias("y"), F.lit(1.5).alias("z"), F.lit(-1.0).alias("fx"), F.lit(0.0).alias("fy"),
                                                F.when(k % 2 == 0, 2.2).alias("top"), (k % 3).alias("place"), F.lit(3).alias("size"))
    return Y.badge_anchor(d).select("device", F.round("bx", 6).alias("bx"), F.round("by", 6).alias("by_"), F.round("bz", 6).alias("bz"))


@query("""WITH b AS (SELECT event_id AS id, value AS xa, value + 1.3 AS xb, value / 2 AS ya, value / 2 + 0.7 AS yb FROM events),
 w AS (SELECT id, greatest(CAST(floor((xa + 1) / 0.5 + 1e-6) AS BIGINT), 0) AS c0, least(CAST(ceil((xb + 1) / 0.5 - 1e-6) AS BIGINT), 40) AS c1,
 greatest(CAST(floor((10 - yb) / 0.5 + 1e-6) AS BIGINT), 0) AS r0, least(CAST(ceil((10 - ya) / 0.5 - 1e-6) AS BIGINT), 20) AS r1 FROM b)
 SELECT id, c0, greatest(c0, c1) AS c1, r0, greatest(r0, r1) AS r1 FROM w""")
def cell_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    b = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), v.alias("xa"), (v + 1.3).alias("xb"), (v / 2).alias("ya"), (v / 2 + 0.7).alias("yb"))
    return P.cell_window(b, 0.5, -1.0, 10.0, 40, 20).select("id", "c0", "c1", "r0", "r1")


#: Nine cells of a square, and a square's opening and closing of cells ``z``.
_nine = f"nine AS (SELECT a.i AS i, b.i AS j FROM {_sq} a, {_sq} b)"
_opened = """e1 AS (SELECT room, ix - i AS ix, iy - j AS iy FROM z, nine GROUP BY 1, 2, 3 HAVING count(*) = 9), d1 AS (SELECT DISTINCT room, ix + i AS ix, iy + j AS iy FROM e1, nine),
 d2 AS (SELECT DISTINCT room, ix + i AS ix, iy + j AS iy FROM d1, nine), e2 AS (SELECT room, ix - i AS ix, iy - j AS iy FROM d2, nine GROUP BY 1, 2, 3 HAVING count(*) = 9)"""


@query(f"""WITH RECURSIVE {MASK}, {GRID}, {_nine}, box AS (SELECT room, ix, unnest(range(iy0, iy1 + 1)) AS iy FROM (SELECT *, unnest(range(ix0, ix1 + 1)) AS ix FROM gr)),
f AS (SELECT * FROM c WHERE ix % 16 < 5 AND iy % 20 < 7), cr AS (SELECT unnest([0, 1, -1, 0, 0]) AS i, unnest([0, 0, 0, 1, -1]) AS j),
s1 AS (SELECT DISTINCT room, ix + i AS ix, iy + j AS iy FROM f, cr), s2 AS (SELECT DISTINCT room, ix + i AS ix, iy + j AS iy FROM s1, cr),
z AS (SELECT * FROM box EXCEPT SELECT * FROM s2 EXCEPT SELECT * FROM c WHERE ix % 16 IN (9, 10) OR iy % 20 = 12), {_opened}, n AS (SELECT * FROM e2 INTERSECT SELECT * FROM box), {JOINED},
y AS (SELECT room, root FROM k GROUP BY room, root HAVING count(*) * 0.0625 >= 1.5) SELECT k.room, ix, iy FROM k JOIN y ON k.room = y.room AND k.root = y.root""")
def unseen_pockets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floor that no scan has seen: the rooms' grids without what lies by some of the mask's cells (measured floor) and
    without others (solids), as squares of three cells fit, in places of one and a half square metres."""
    m, _ = kept(mask(spark, sf_dir), "mask")  # read three times
    box = grid(m).select("room", F.explode(F.sequence("ix0", "ix1")).alias("ix"), "iy0", "iy1").select("room", "ix", F.explode(F.sequence("iy0", "iy1")).alias("iy"))
    return P.unscanned(box, m.where("ix % 16 < 5 and iy % 20 < 7"), m.where("ix % 16 in (9, 10) or iy % 20 = 12"), "room", C.components, 0.25, side=0.75, least_area=1.5)
