"""Linking detections to register devices by viewing direction."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.expressions import angle_between, view

MAX_RANGE, AMBIGUOUS = 8.0, 1.0


def views_of(devices: DataFrame, scans: DataFrame, max_range: float = MAX_RANGE) -> DataFrame:
    """Directions under which each device is known: its anchors, and its position seen from scans within range.

    ``devices`` (device, site, anchors, x, y, z, tol), ``scans`` (scan, site, sx, sy, sz). Positions meet scans of their
    own site by grid cells as wide as the range.
    """
    a = devices.select("device", "tol", F.explode("anchors").alias("a")).select("device", "tol", F.col("a.scan").alias("scan"), F.col("a.yaw").alias("vyaw"), F.col("a.pitch").alias("vpitch"))
    near = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    s = scans.withColumn("_i", F.explode(near)).withColumn("_j", F.explode(near))
    s = s.withColumn("_cx", F.floor(F.col("sx") / max_range) + F.col("_i")).withColumn("_cy", F.floor(F.col("sy") / max_range) + F.col("_j")).drop("_i", "_j")
    d = devices.where("x is not null").withColumn("_cx", F.floor(F.col("x") / max_range)).withColumn("_cy", F.floor(F.col("y") / max_range))
    yaw, pitch, r = view(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"), F.col("z") - F.col("sz"))
    seen = d.join(s, ["site", "_cx", "_cy"]).where(r <= max_range)
    return a.unionByName(seen.select("device", "tol", "scan", yaw.alias("vyaw"), pitch.alias("vpitch")))


def within_tolerance(d: DataFrame, views: DataFrame, cell: float = 4.0) -> DataFrame:
    """Detections (scan, id, yaw, pitch) and views (scan, device, tol, vyaw, vpitch) of one scan whose directions are
    within the view's tolerance, with ``dist``, their angle in degrees.

    Both meet by cells of yaw and pitch. A view takes all cells that its tolerance reaches, over the wrap at 180 and, near
    the poles, all around, so the join is an equality; of pairs that meet the cosine is compared, and the angle worked
    out for those that pass.
    """
    n = math.ceil(360 / cell)
    at = lambda c: F.floor(c / cell).cast("long")
    left = d.where("yaw is not null and pitch is not null").select("scan", "id", "yaw", "pitch", F.pmod(at(F.col("yaw") + 180), F.lit(n)).alias("_cy"), at(F.col("pitch") + 90).alias("_cp"))
    v = views.where("vyaw is not null and vpitch is not null and tol >= 0").select("scan", "device", "tol", "vyaw", "vpitch")
    wide = F.abs("vpitch") + F.col("tol") >= 89.9
    reach = F.when(wide, 180.0).otherwise(F.degrees(F.asin(F.least(F.sin(F.radians("tol")) / F.cos(F.radians("vpitch")), F.lit(1.0)))) + 1e-6)
    cells = F.sequence(at(F.col("vyaw") + 180 - reach), at(F.col("vyaw") + 180 + reach))
    v = v.withColumn("_cy", F.explode(F.array_distinct(F.transform(cells, lambda c: F.pmod(c, F.lit(n))))))
    v = v.withColumn("_cp", F.explode(F.sequence(at(F.col("vpitch") + 90 - F.col("tol") - 1e-6), at(F.col("vpitch") + 90 + F.col("tol") + 1e-6))))
    for name, df in (("d", left), ("v", v)):
        yaw, pitch = (F.radians(c) for c in (("yaw", "pitch") if name == "d" else ("vyaw", "vpitch")))
        df = df.withColumn(f"_{name}x", F.cos(yaw) * F.cos(pitch)).withColumn(f"_{name}y", F.sin(yaw) * F.cos(pitch)).withColumn(f"_{name}z", F.sin(pitch))
        left, v = (df, v) if name == "d" else (left, df)
    cos = sum((F.col(f"_d{c}") * F.col(f"_v{c}") for c in "xyz"), F.lit(0.0))
    met = left.join(v, ["scan", "_cy", "_cp"]).where(cos >= F.cos(F.radians("tol")) - 1e-9)
    dist = angle_between(F.col("yaw"), F.col("pitch"), F.col("vyaw"), F.col("vpitch"))
    return met.withColumn("dist", dist).where("dist <= tol").select("scan", "id", "device", "dist")


def link(detections: DataFrame, views: DataFrame, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """``id``, ``device``, ``dist``, ``outcome``: linked, ambiguous (a second device within a degree) or none.

    For each detection the smallest angle to any view of a device in the same scan counts, within the device's own
    tolerance; the nearest device wins.
    """
    pairs = within_tolerance(detections, views).groupBy("id", "device").agg(F.min("dist").alias("dist"))
    w = Window.partitionBy("id").orderBy("dist", "device")
    best = pairs.withColumn("rn", F.row_number().over(w)).withColumn("second", F.lead("dist").over(w)).where("rn = 1")
    j = detections.select("id").join(best, "id", "left")
    close = F.coalesce(F.col("second") - F.col("dist") < ambiguous, F.lit(False))
    return j.select("id", F.when(~close, F.col("device")).alias("device"), "dist",
                    F.when(F.col("device").isNull(), "none").when(close, "ambiguous").otherwise("linked").alias("outcome"))


def with_links(detections: DataFrame, links: DataFrame) -> DataFrame:
    """Detections with their device where one was linked."""
    return detections.join(links.where("outcome = 'linked'").select("id", F.col("device").alias("instance")), "id", "left")


def nearest_pairing(headers: DataFrame, points: DataFrame, limit: float = 0.10) -> DataFrame:
    """For each scan header its nearest point of the same site, the second best, and whether the pairing is sure.

    A site is a small set of cameras, whose number doesn't grow with the data; the join is by site.
    """
    dist = F.sqrt((F.col("hx") - F.col("x")) ** 2 + (F.col("hy") - F.col("y")) ** 2 + (F.col("hz") - F.col("z")) ** 2)
    w = Window.partitionBy("header").orderBy("dist", "point")
    p = headers.join(points, "site").withColumn("dist", dist).withColumn("second", F.lead("dist").over(w)).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    used = F.count("*").over(Window.partitionBy("site", "point"))
    return p.withColumn("unique", used == 1).select("header", "site", "point", "dist", "second", "unique", (F.col("unique") & (F.col("dist") < limit)).alias("sure"))


def pairing_gate(pairs: DataFrame, headers: DataFrame, points: DataFrame) -> DataFrame:
    """One row for each site: pairs, headers and points, the worst distance, and whether their numbers are equal and every
    pairing is sure."""
    p = pairs.groupBy("site").agg(F.count("*").alias("paired"), F.max("dist").alias("worst"), F.bool_and("sure").alias("all_sure"))
    h, q = (d.groupBy("site").agg(F.count("*").alias(n)) for d, n in ((headers, "headers"), (points, "points")))
    j = h.join(q, "site", "full_outer").join(p, "site", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    equal = (zero("headers") == zero("points")) & (zero("paired") == zero("headers"))
    return j.select("site", zero("paired").alias("paired"), zero("headers").alias("headers"), zero("points").alias("points"), "worst",
                    (equal & F.coalesce("all_sure", F.lit(False))).alias("passed"))
