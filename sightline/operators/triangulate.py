"""From viewing rays to devices: ray pairs, consensus clusters, matching with an earlier register.

Rays: (site, ord, id, scan, ox, oy, oz, dx, dy, dz, yaw, pitch, conf). ``ord`` is the input order, which decides ties.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.expressions import direction, dot, half_up, lsq_solution, lsq_sums, zero_padded
from sightline.operators import greedy
from sightline.operators.link import within_tolerance

#: Metres between two rays, nearest and furthest range, least angle of two rays, degrees of support, degrees
#: within which detections of one scan are one device.
GAP, NEAR, FAR, MIN_ANGLE, SUPPORT, SAME = 0.05, 0.3, 8.0, 10.0, 2.0, 3.0


def rays(detections: DataFrame, scans: DataFrame) -> DataFrame:
    """Rays of usable detections; scans (scan, site, ox, oy, oz)."""
    d = detections.where("yaw is not null and pitch is not null").join(scans, "scan")
    return d.select("*", *(c.alias(n) for n, c in zip(("dx", "dy", "dz"), direction("yaw", "pitch"), strict=True)))


def once(j: DataFrame, **values: Column) -> DataFrame:
    """Further columns that are worked out once a row: a generator's output isn't pushed into later conditions, as the
    formulas of plain columns are."""
    return j.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in values.items())))))


def pair_candidates(r: DataFrame, gap: float = GAP, near: float = NEAR, far: float = FAR, angle: float = MIN_ANGLE) -> DataFrame:
    """Points where two rays of different scans of a site nearly meet, with the order of both rays.

    The site is the equality key; all else is a condition on the pair, cheapest first: three dot products decide the
    angle (by its cosine) and the ranges before any point is worked out.
    """
    a = r.select("site", *(F.col(c).alias(f"a_{c}") for c in ("ord", "scan", "ox", "oy", "oz", "dx", "dy", "dz")))
    b = r.select("site", *(F.col(c).alias(f"b_{c}") for c in ("ord", "scan", "ox", "oy", "oz", "dx", "dy", "dz")))
    j = a.join(b, (a["site"] == b["site"]) & (F.col("a_ord") < F.col("b_ord")) & (F.col("a_scan") != F.col("b_scan"))).drop(b["site"])
    v = lambda p, q: tuple(F.col(f"{p}_{q}{n}") for n in "xyz")
    w = tuple(p - q for p, q in zip(v("a", "o"), v("b", "o"), strict=True))
    j = once(j, c=dot(v("a", "d"), v("b", "d")), d=dot(v("a", "d"), w), e=dot(v("b", "d"), w))
    m = 1 - F.col("c") * F.col("c")
    j = j.where((m >= 1e-9) & (F.abs("c") <= math.cos(math.radians(angle)) + 1e-12))
    j = once(j, t=(F.col("c") * F.col("e") - F.col("d")) / m, s=(F.col("e") - F.col("c") * F.col("d")) / m)
    j = j.where(F.col("t").between(near, far) & F.col("s").between(near, far))
    one = {n: F.col(f"a_o{n}") + F.col("t") * F.col(f"a_d{n}") for n in "xyz"}
    two = {n: F.col(f"b_o{n}") + F.col("s") * F.col(f"b_d{n}") for n in "xyz"}
    j = j.where(sum(((one[n] - two[n]) ** 2 for n in "xyz"), F.lit(0.0)) <= gap * gap * (1 + 1e-9))
    out = j.select("site", F.col("a_ord").alias("i"), F.col("b_ord").alias("j"), "t", "s",
                   F.sqrt(sum(((one[n] - two[n]) * (one[n] - two[n]) for n in "xyz"), F.lit(0.0))).alias("gap"),
                   F.degrees(F.acos(F.least(F.abs("c"), F.lit(1.0)))).alias("angle"), *(((one[n] + two[n]) / 2).alias(f"m{n}") for n in "xyz"))
    return out.where((F.col("gap") <= gap) & (F.col("angle") >= angle))


def supporters(points: DataFrame, r: DataFrame, angle: float = SUPPORT, near: float = NEAR, far: float = FAR) -> DataFrame:
    """Rays that see a candidate point (key, site, x, y, z) within the range and angle limits, with ``range`` and the
    cosine ``cos`` of the angle they miss it by."""
    away = {n: F.col(n) - F.col(f"o{n}") for n in "xyz"}
    j = once(points.join(r, "site"), range2=sum((v * v for v in away.values()), F.lit(0.0)), along=sum((v * F.col(f"d{n}") for n, v in away.items()), F.lit(0.0)))
    j = j.where(F.col("range2").between(near * near * (1 - 1e-9), far * far * (1 + 1e-9)) & (F.col("along") >= math.cos(math.radians(angle)) * F.sqrt("range2")))
    j = j.withColumn("range", F.sqrt("range2")).withColumn("cos", F.col("along") / F.col("range"))
    return j.where(F.col("range").between(near, far)).drop("range2", "along")


def scored(support: DataFrame) -> DataFrame:
    """Candidates by support: ten for each ray plus their confidence; at least two scans."""
    return (support.groupBy("site", "key").agg(F.count("*").alias("n"), F.sum("conf").alias("conf_sum"), F.countDistinct("scan").alias("scans"))
            .where("scans >= 2").withColumn("score", 10 * F.col("n") + F.col("conf_sum")))


def located(r: DataFrame, key: str) -> DataFrame:
    """Least-squares point of each group's rays; coordinates are null where the rays don't fix one."""
    c = lambda q: tuple(F.col(f"{q}{n}") for n in "xyz")
    s = r.groupBy(key).agg(F.count("*").alias("n"), *lsq_sums(c("o"), c("d")))
    return s.select(key, "n", *(e.alias(n) for n, e in lsq_solution().items()))


def _point(o: np.ndarray, d: np.ndarray) -> np.ndarray | None:
    a = (np.eye(3)[None] - d[:, :, None] * d[:, None, :]).sum(0)
    b = o - d * (o * d).sum(1, keepdims=True)
    return np.linalg.solve(a, b.sum(0)) if abs(np.linalg.det(a)) >= 1e-12 else None


def _sees(p: np.ndarray, o: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which rays see each point: (points, rays)."""
    w = p[:, None, :] - o[None]
    r = np.sqrt((w * w).sum(2))
    cos = (w * d[None]).sum(2) / np.maximum(r, 1e-12)
    return (r >= NEAR) & (r <= FAR) & (np.degrees(np.arccos(np.clip(cos, -1, 1))) <= SUPPORT)


#: Pairs of a point or ray with a ray that are looked at in one go.
AT_ONCE = 500_000


def _candidates(o: np.ndarray, d: np.ndarray, scan: np.ndarray, gap_m: float, angle: float) -> np.ndarray:
    """Points halfway between two rays of different scans that come close, by the first ray and then the second."""
    n, found = len(o), [np.empty((0, 3))]
    step = max(1, AT_ONCE // max(n, 1))
    for at in range(0, n, step):
        i, j = np.nonzero((np.arange(at, min(at + step, n))[:, None] < np.arange(n)[None]) & (scan[at : at + step, None] != scan[None]))
        i += at
        w, b = o[i] - o[j], (d[i] * d[j]).sum(1)
        dd, e, m = (d[i] * w).sum(1), (d[j] * w).sum(1), 1 - b * b
        ok = m >= 1e-9
        m = np.where(ok, m, 1.0)
        t, s = (b * e - dd) / m, (e - b * dd) / m
        p1, p2 = o[i] + t[:, None] * d[i], o[j] + s[:, None] * d[j]
        gap = np.sqrt(((p1 - p2) ** 2).sum(1))
        ang = np.degrees(np.arccos(np.clip(np.abs(b), 0, 1)))
        ok &= (gap <= gap_m) & (t >= NEAR) & (t <= FAR) & (s >= NEAR) & (s <= FAR) & (ang >= angle)
        found.append(((p1 + p2) / 2)[ok])
    return np.concatenate(found)


class _Support:
    """Which rays see which points, as lists of the pairs that do, both ways, with a score for each point: ten for each
    free ray and the rays' confidence, if they are of two scans. Once rays are taken only points that they see are scored
    anew, so all rounds together cost about as much as the pairs times the rays of a point."""

    def __init__(self, points: np.ndarray, o: np.ndarray, d: np.ndarray, scan: np.ndarray, conf: np.ndarray) -> None:
        n, step = len(o), max(1, AT_ONCE // max(len(o), 1))
        seen = [np.nonzero(_sees(points[at : at + step], o, d)) for at in range(0, len(points), step)]
        of_point = np.concatenate([np.empty(0, np.int64), *(p + k * step for k, (p, _) in enumerate(seen))])
        self.rays = np.concatenate([np.empty(0, np.int64), *(r for _, r in seen)])
        self.first = np.searchsorted(of_point, np.arange(len(points) + 1))
        by_ray = np.argsort(self.rays, kind="stable")
        self.points, self.first_of_ray = of_point[by_ray], np.searchsorted(self.rays[by_ray], np.arange(n + 1))
        self.scan, self.conf = np.unique(scan, return_inverse=True)[1].astype(np.int64), conf
        self.free, self.score = np.ones(n, bool), np.empty(len(points))
        for at in range(0, len(points), AT_ONCE // 10):
            self._rescore(np.arange(at, min(at + AT_ONCE // 10, len(points))))

    def _rescore(self, points: np.ndarray) -> None:
        size = self.first[points + 1] - self.first[points]
        k = np.repeat(np.arange(len(points)), size)
        rays = self.rays[np.arange(size.sum()) + np.repeat(self.first[points] - (np.cumsum(size) - size), size)]
        k, rays = k[self.free[rays]], rays[self.free[rays]]
        n = len(points)
        scans = np.bincount(np.unique(k * (self.scan.max() + 1) + self.scan[rays]) // (self.scan.max() + 1), minlength=n)
        total = 10 * np.bincount(k, minlength=n) + np.bincount(k, weights=self.conf[rays], minlength=n)
        self.score[points] = np.where(scans >= 2, total, -np.inf)

    def best(self) -> int | None:
        """The first of the points with the largest score."""
        k = int(np.argmax(self.score)) if len(self.score) else None
        return None if k is None or self.score[k] == -np.inf else k

    def of(self, point: int) -> np.ndarray:
        rays = self.rays[self.first[point] : self.first[point + 1]]
        return rays[self.free[rays]]

    def take(self, rays: np.ndarray) -> None:
        self.free[rays] = False
        self._rescore(np.unique(np.concatenate([self.points[self.first_of_ray[r] : self.first_of_ray[r + 1]] for r in rays])))


def consensus(pdf: pd.DataFrame, gap_m: float = GAP, angle: float = MIN_ANGLE) -> pd.DataFrame:
    """Clusters of one site's rays: strongest candidate first, refined once; leftovers joined by direction within a scan."""
    pdf = pdf.sort_values("ord").reset_index(drop=True)
    o, d = pdf[["ox", "oy", "oz"]].to_numpy(float), pdf[["dx", "dy", "dz"]].to_numpy(float)
    scan, n = pdf["scan"].to_numpy(), len(pdf)
    points = _candidates(o, d, scan, gap_m, angle)
    support = _Support(points, o, d, scan, pdf["conf"].to_numpy(float))
    cluster, out = np.full(n, -1), []
    while (best := support.best()) is not None:
        members = support.of(best)
        place = _point(o[members], d[members])
        place = points[best] if place is None else place
        again = np.flatnonzero(_sees(place[None], o, d)[0] & support.free)
        if len(set(scan[again])) >= 2:
            members = again
        cluster[members] = len(out)
        support.take(members)
        out.append(place)
    free = support.free
    single: list[list[int]] = []
    for k in np.flatnonzero(free):
        for g in single:
            if scan[g[0]] == scan[k] and any(math.degrees(math.acos(float(np.clip(d[x] @ d[k], -1, 1)))) <= SAME for x in g):
                g.append(int(k))
                break
        else:
            single.append([int(k)])
    for c, g in enumerate(single, len(out)):
        cluster[g] = c
    at = [out[c] if c < len(out) else (None, None, None) for c in cluster]
    return pd.DataFrame({"site": pdf["site"], "id": pdf["id"], "cluster": cluster.astype("int64"), "multi": cluster < len(out),
                         "x": [p[0] for p in at], "y": [p[1] for p in at], "z": [p[2] for p in at]})


def clusters(r: DataFrame, gap: float = GAP, angle: float = MIN_ANGLE) -> DataFrame:
    """``site, id, cluster, multi, x, y, z``. The greedy choice is exact within a site, the unit in which scans see each
    other; a site is a room's worth of rays, and sites are independent."""
    return r.groupBy("site").applyInPandas(lambda pdf: consensus(pdf, gap, angle), "site long, id long, cluster long, multi boolean, x double, y double, z double")


def eligible(members: DataFrame, within: str, kind: str) -> DataFrame:
    """Clusters that become devices, in their order: most automatic members, most members, highest confidence.

    ``members`` (cluster, conf, auto, type): a cluster needs an automatic member, and no member of another type than
    ``kind``; a null type counts as that.
    """
    c = members.groupBy(within, "cluster").agg(F.count_if("auto").alias("autos"), F.count("*").alias("n"), F.max("conf").alias("top"),
                                               F.bool_and(F.coalesce("type", F.lit(kind)) == kind).alias("pure"))
    w = Window.partitionBy(within).orderBy(F.desc("autos"), F.desc("n"), F.desc("top"), "cluster")
    return c.where("autos > 0 and pure").withColumn("place", F.row_number().over(w)).drop("pure")


def register_stats(members: DataFrame) -> DataFrame:
    """Detections, automatic ones, clusters, clusters with an automatic member, clusters with a position, and members
    that await review in clusters with both. ``members`` (cluster, auto, placed: the cluster has a position)."""
    per = members.groupBy("cluster").agg(F.count("*").alias("n"), F.count_if("auto").alias("autos"), F.bool_or("placed").alias("placed"))
    return per.agg(F.sum("n").alias("detections"), F.sum("autos").alias("auto"), F.count("*").alias("devices"),
                   F.count_if(F.col("autos") > 0).alias("devicesWithAuto"), F.count_if("placed").alias("multiView"),
                   F.sum(F.when(F.col("placed") & (F.col("autos") > 0), F.col("n") - F.col("autos")).otherwise(0)).alias("reviewOnAuto"))


def same_devices(old: DataFrame, new: DataFrame, limit: float = 0.3) -> DataFrame:
    """Pairs of an earlier device and a cluster that may be it (site, a, b, dist): positions within ``limit`` where both
    have one, else any anchor within the device's tolerance of a member in the same scan (dist null).

    ``old`` (site, a, x, y, z, anchors, tol), ``new`` (site, b, x, y, z, members); anchors and members are arrays of
    (scan, yaw, pitch). Positions meet by grid cells, directions by angular cells.
    """
    p = old.where("x is not null").select("site", "a", *(F.col(c).alias(f"o{c}") for c in "xyz"))
    q = new.where("x is not null").select("site", "b", "x", "y", "z", *(F.floor(F.col(c) / limit).alias(f"c{c}") for c in "xyz"))
    near = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    for c in "xyz":
        p = p.withColumn("_k", F.explode(near)).withColumn(f"c{c}", F.floor(F.col(f"o{c}") / limit) + F.col("_k")).drop("_k")
    dist = F.sqrt(sum(((F.col(c) - F.col(f"o{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    placed = p.join(q, ["site", "cx", "cy", "cz"]).select("site", "a", "b", dist.alias("dist")).where(F.col("dist") <= limit)
    anchor = old.select("site", "a", F.col("x").isNotNull().alias("op"), F.col("tol"), F.explode("anchors").alias("v"))
    member = new.select("site", "b", F.col("x").isNotNull().alias("np"), F.explode("members").alias("m"))
    views = anchor.select(F.struct("site", "v.scan").alias("scan"), F.struct("a", "op").alias("device"), "tol", F.col("v.yaw").alias("vyaw"), F.col("v.pitch").alias("vpitch"))
    seen = member.select(F.struct("site", "m.scan").alias("scan"), F.struct("b", "np").alias("id"), "m.yaw", "m.pitch")
    looked = within_tolerance(seen, views).where("not (device.op and id.np)").select("scan.site", "device.a", "id.b").distinct()
    return placed.unionByName(looked.withColumn("dist", F.lit(None).cast("double")))


#: Pairs of a site that one task goes through; sites with more are matched in rounds.
MOST_PAIRS = 1_000_000


def greedy_match(pairs: DataFrame, first_free: bool, most: int = MOST_PAIRS) -> DataFrame:
    """One-to-one matches of each site's eligible pairs (site, a, b, dist): by distance, then by order of a and b; or,
    with ``first_free``, each ``a`` in order takes its first free ``b`` in order.

    Spark sorts a site's pairs, on disk where they are many, and they pass in batches; only the ids already taken are held.
    Sites of more than ``most`` pairs are matched in rounds, over all tasks.
    """
    order = ["a", "b"] if first_free else ["dist", "a", "b"]
    kinds = {"site": pa.int64(), "a": pa.int64(), "b": pa.int64(), "dist": pa.float64()}
    schema = pa.schema(list(kinds.items()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used_a, used_b = None, set(), set()
        for batch in batches:
            rows = []
            for p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p[0] != at:
                    at, used_a, used_b = p[0], set(), set()
                if p[1] not in used_a and p[2] not in used_b:
                    used_a.add(p[1])
                    used_b.add(p[2])
                    rows.append(p)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], schema=schema)

    typed = pairs.select(*(F.col(c).cast("double" if c == "dist" else "long").alias(c) for c in kinds))
    small, large = greedy.split_by_size(typed, ["site"], most)
    out = small.repartition("site").sortWithinPartitions("site", *order).mapInArrow(run, "site long, a long, b long, dist double")
    if large is None:
        return out
    if first_free:  # equal pairs, where distance doesn't order them, are one
        large = large.groupBy("site", "a", "b").agg(F.min("dist").alias("dist"))
    return out.unionByName(greedy.matched(large.distinct(), ["site", "a"], ["site", "b"], ["site", *order]))


def close_pairs(old: DataFrame, new: DataFrame, site: str, limit: float = 0.2) -> DataFrame:
    """Pairs within ``limit`` of each other (site, a, b, dist), by grid cells. ``old`` (site, a, x, y, z), ``new`` (site, b, x, y, z)."""
    none = F.array().cast("array<struct<scan:long,yaw:double,pitch:double>>")
    o = old.select(F.col(site).alias("site"), "a", "x", "y", "z", none.alias("anchors"), F.lit(0.0).alias("tol"))
    n = new.select(F.col(site).alias("site"), "b", "x", "y", "z", none.alias("members"))
    return same_devices(o, n, limit).where("dist is not null")


def stable_ids(new: DataFrame, matched: DataFrame, old: DataFrame, site: str = "site", order: tuple[Column | str, ...] = ("place",)) -> DataFrame:
    """Ids across reruns: matched devices keep theirs, missing ones stay, new ones count on from the largest in ``order``
    (for devices of a floor: -x, y, z).

    ``new`` (site, b and what the order needs), ``matched`` (site, a, b), ``old`` (site, a)."""
    top = old.groupBy(site).agg(F.max("a").alias("top"))
    j = new.join(matched.select(site, "a", "b"), [site, "b"], "left").join(top, site, "left")
    fresh = F.row_number().over(Window.partitionBy(site, F.col("a").isNull()).orderBy(*order, "b"))
    named = j.select(site, F.coalesce("a", F.coalesce("top", F.lit(0)) + fresh).alias("device"), F.lit("seen").alias("state"))
    lost = old.join(matched.select(site, "a"), [site, "a"], "left_anti").select(site, F.col("a").alias("device"), F.lit("missing").alias("state"))
    return named.unionByName(lost)


def renumbered(devices: DataFrame, existing: DataFrame, most: int, within: str, prefix: str = "REL-") -> DataFrame:
    """New devices up to the number that is still free, strongest first, counted on from the largest existing number in
    physical order: x rounded (halves up), then y; unplaced ones last, in the order of their strength.

    ``devices`` (within, place, x, y), ``existing`` (within, number)."""
    n = existing.groupBy(within).agg(F.count("*").alias("n"), F.max("number").alias("top"))
    w = Window.partitionBy(within).orderBy("place")
    kept = (devices.join(n, within, "left").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= F.greatest(F.lit(0), most - F.coalesce("n", F.lit(0)))))
    order = Window.partitionBy(within).orderBy(half_up("x").asc_nulls_last(), F.when(F.col("x").isNotNull(), F.col("y")).asc_nulls_last(), "place")
    number = F.coalesce("top", F.lit(0)) + F.row_number().over(order)
    return kept.withColumn("label", F.concat(F.lit(prefix), zero_padded(number)))
