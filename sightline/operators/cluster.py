"""Clusters and components: labels over edges, order-dependent clustering within groups, device aggregates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.operators import greedy
from sightline.operators.link import within_tolerance
from sightline.sources.shared import forget, kept


#: Edges that one task joins; more are contracted in rounds.
FEW_EDGES = 100_000


def smallest_reached(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """For each of the numbers below ``n`` the smallest that edges (lo, hi) join it to."""
    least = np.arange(n)
    while True:  # every end takes the smaller root, and roots the roots of theirs, until none changes
        m = np.minimum(least[lo], least[hi])
        new = least.copy()
        for end in (lo, hi):
            np.minimum.at(new, end, m)
            np.minimum.at(new, least[end], m)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of a few edges (lo, hi) in one task: each node with the smallest of its component."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    ends = pa.concat_arrays([b.column(c) for c in ("lo", "hi") for b in held])
    plain = lambda x: tuple(map(plain, x.values())) if isinstance(x, dict) else x
    keys = [plain(x) for x in ends.to_pylist()]
    place = {k: i for i, k in enumerate(sorted(set(keys)))}
    ids = np.array([place[k] for k in keys])
    least = smallest_reached(ids[: len(ids) // 2], ids[len(ids) // 2 :], len(place))
    first = np.zeros(len(place), dtype=np.int64)
    first[ids[::-1]] = np.arange(len(ids))[::-1]
    yield pa.RecordBatch.from_arrays([ends.take(pa.array(first)), ends.take(pa.array(first[least]))], names=["node", "root"])


def components(edges: DataFrame, rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """``node, root`` (smallest node of its component) of all nodes with an edge (a, b).

    Up to ``few`` edges, by count, are joined in one task. Of more it alternates pointing every neighbour at the smallest one around it with keeping one pointer a node, so long chains
    shorten by half and hubs stay single rows. Stops when nothing changes; an error if that isn't so after ``rounds``.
    """
    e = edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    (e, path), before = kept(e, "components"), None
    if e.limit(few + 1).count() <= few:
        kind = e.schema["lo"].dataType
        return e.coalesce(1).mapInArrow(joined, T.StructType([T.StructField("node", kind), T.StructField("root", kind)]))
    for _ in range(rounds):
        ends = e.unionByName(e.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        least = ends.groupBy("lo").agg(F.least(F.min("hi"), F.first("lo")).alias("m"))
        up = ends.join(least, "lo").where("hi > lo").select(F.col("m").alias("lo"), "hi").where("lo <> hi").distinct()
        first = up.groupBy("hi").agg(F.min("lo").alias("m"))
        e = up.join(first, "hi").select("m", F.explode(F.array("lo", "hi")).alias("hi")).where("m <> hi").select(F.col("m").alias("lo"), "hi").distinct()
        old, (e, path) = path, kept(e, "components")
        forget(e.sparkSession, old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    one = e.groupBy("hi").agg(F.min("lo").alias("root")).select(F.col("hi").alias("node"), "root")
    return one.unionByName(one.select(F.col("root").alias("node"), "root").distinct())


def stack_edges(d: DataFrame, tol: float, site: str) -> DataFrame:
    """Pairs nearer than ``tol`` in x and y, found by grid cells."""
    cell = lambda c: F.floor(F.col(c) / tol)
    near = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    a = d.select(site, F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(near).alias("i"))
    a = a.withColumn("j", F.explode(near)).select(site, "a", "ax", "ay", (F.floor(F.col("ax") / tol) + F.col("i")).alias("cx"), (F.floor(F.col("ay") / tol) + F.col("j")).alias("cy"))
    b = d.select(site, F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("cx"), cell("y").alias("cy"))
    return a.join(b, [site, "cx", "cy"]).where("a < b").where(F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) < tol).select("a", "b")


def stacks(d: DataFrame, tol: float, site: str, step: float = 1.0) -> DataFrame:
    """Devices above each other: ``stack`` (smallest id), place from the top, and the sideways shift that fans them out."""
    roots = components(stack_edges(d, tol, site))
    s = d.join(roots, d["id"] == roots["node"], "left").withColumn("stack", F.coalesce("root", "id"))
    w = Window.partitionBy("stack")
    s = s.withColumn("size", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("z"), "id")) - 1)
    return s.select("id", "stack", "place", "size", ((F.col("place") - (F.col("size") - 1) / 2) * step).alias("shift"))


def suppressed(c: DataFrame, by: list[str], most: int = greedy.MOST) -> DataFrame:
    """Non-maximum suppression: strongest first, a box goes if its centre lies in one that was kept.

    ``c`` (ord, x1, y1, x2, y2, conf); ``ord`` is unique in a group. Groups are rendered views; those of more than ``most``
    boxes are decided in rounds over pairs of a box and the centres in it.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["conf", "ord"], ascending=[False, True], kind="stable")
        b = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float)
        cx, cy = (b[:, 0] + b[:, 2]) / 2, (b[:, 1] + b[:, 3]) / 2
        # which centres lie in which boxes: a group is small, so the square of it is
        inside = (b[:, 0] <= cx[:, None]) & (cx[:, None] <= b[:, 2]) & (b[:, 1] <= cy[:, None]) & (cy[:, None] <= b[:, 3])
        kept = np.zeros(len(b), bool)
        for k in range(len(b)):
            kept[k] = not (inside[k] & kept).any()
        return pdf[kept]

    small, large = greedy.split_by_size(c, by, most)
    out = small.groupBy(*by).applyInPandas(run, c.schema)
    if large is None:
        return out
    node = F.struct(*by, "ord")
    chosen = greedy.taken(large.select(node.alias("node")), covered_centres(large, by))
    return out.unionByName(large.withColumn("node", node).join(chosen, "node", "left_semi").drop("node"))


def covered_centres(c: DataFrame, by: list[str]) -> DataFrame:
    """Pairs (early, late) of a box and a weaker one whose centre lies in it. A box takes the cells of a grid as wide as its
    longer side, rounded up to a power of two, which are four at most; a centre looks in the grid of each width there
    is, of which there are no more than exponents of a double."""
    node = F.struct(*by, "ord")
    longer = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(1e-9))
    boxes = c.select(*by, node.alias("early"), "x1", "y1", "x2", "y2", "conf", "ord", F.ceil(F.log2(longer)).cast("int").alias("level"))
    levels = F.array(*(F.lit(r["level"]) for r in boxes.select("level").distinct().collect()))
    cell = lambda v: F.floor(v / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    for axis in "xy":
        boxes = boxes.withColumn(f"c{axis}", F.explode(F.sequence(cell(F.col(f"{axis}1")), cell(F.col(f"{axis}2")))))
    middle = {axis: (F.col(f"{axis}1") + F.col(f"{axis}2")) / 2 for axis in "xy"}
    centres = c.select(*by, node.alias("late"), *(m.alias(f"m{axis}") for axis, m in middle.items()), F.col("conf").alias("own"), F.col("ord").alias("place"), F.explode(levels).alias("level"))
    centres = centres.withColumns({f"c{axis}": cell(F.col(f"m{axis}")) for axis in "xy"})
    stronger = (F.col("conf") > F.col("own")) | ((F.col("conf") == F.col("own")) & (F.col("ord") < F.col("place")))
    met = boxes.join(centres, [*by, "level", "cx", "cy"]).where(stronger & F.col("mx").between(F.col("x1"), F.col("x2")) & F.col("my").between(F.col("y1"), F.col("y2")))
    return met.select("early", "late")


def led_clusters(c: DataFrame, scan: str, share: float = 0.5, most: int = greedy.MOST) -> DataFrame:
    """Leader clustering by direction: strongest first, a candidate joins the first cluster whose leader is within a
    share of the larger angular size; leaders never change. ``c`` (scan, ord, yaw, pitch, size, conf, view); ``ord`` is
    unique in a scan. In scans of more than ``most`` candidates leaders are found in rounds over pairs that are near."""
    fields = f"{scan} long, ord long, cluster long, leader long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["conf", "ord"], ascending=[False, True], kind="stable")
        y, p = np.radians(pdf["yaw"].to_numpy(float)), np.radians(pdf["pitch"].to_numpy(float))
        v = np.c_[np.sin(y) * np.cos(p), np.cos(y) * np.cos(p), np.sin(p)]
        size, ords, lead, of = pdf["size"].to_numpy(float), pdf["ord"].to_numpy(), [], []
        for k in range(len(pdf)):
            near = [n for n, m in enumerate(lead) if np.degrees(np.arccos(np.clip(v[m] @ v[k], -1, 1))) <= share * max(size[m], size[k])]
            if near:
                of.append(near[0])
            else:
                of.append(len(lead))
                lead.append(k)
        return pd.DataFrame({scan: pdf[scan].to_numpy(), "ord": ords, "cluster": of, "leader": [ords[lead[n]] for n in of]})

    small, large = greedy.split_by_size(c, [scan], most)
    out = small.groupBy(scan).applyInPandas(run, fields)
    if large is None:
        return out
    rank = F.struct((-F.col("conf")).alias("conf"), F.col("ord"))
    n = large.select(F.col(scan).alias("scan"), F.struct(rank.alias("rank"), F.col(scan).alias("scan")).alias("id"), "yaw", "pitch", (F.col("size") * share).alias("tol"))
    views = n.select("scan", F.col("id").alias("device"), "tol", F.col("yaw").alias("vyaw"), F.col("pitch").alias("vpitch"))
    near = within_tolerance(n, views).where("id <> device").select(F.least("id", "device").alias("early"), F.greatest("id", "device").alias("late")).distinct()
    near, _ = kept(near, "near")
    leads, _ = kept(greedy.taken(n.select(F.col("id").alias("node")), near), "leaders")
    number = F.row_number().over(Window.partitionBy("node.scan").orderBy("node.rank")) - 1
    leads = leads.withColumn("cluster", number.cast("long"))
    joined = near.join(leads.select(F.col("node").alias("early")), "early", "left_semi").groupBy("late").agg(F.min("early").alias("node"))
    member = n.join(leads.select(F.col("node").alias("id")), "id", "left_anti").select("id").join(joined.withColumnRenamed("late", "id"), "id")
    both = leads.select(F.col("node").alias("id"), "node").unionByName(member.select("id", "node")).join(leads, "node")
    return out.unionByName(both.select(F.col("id.scan").cast("long").alias(scan), F.col("id.rank.ord").cast("long").alias("ord"), "cluster", F.col("node.rank.ord").cast("long").alias("leader")))


def constrained(points: DataFrame, site: str, same_deg: float = 3.0, reach: float = 0.15, most: int = greedy.MOST) -> DataFrame:
    """Clusters under cannot-link rules: ``id, cluster, refused`` (merges refused in the site).

    Two detections of one image further apart than ``same_deg`` never share a cluster. First those of one scan nearer than
    that merge, by angle then ids; then points within ``reach``, by distance then ids. A merge that would bring a forbidden
    pair together is refused and counted. ``points`` (site, id, scan, image, yaw, pitch, x, y, z); without a direction a
    detection has no angles, without a place no distances.

    What no chain of possible merges joins is never compared, so a site of more than ``most`` points goes by the
    components of its possible merges.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        n, scan, image = len(pdf), pdf["scan"].to_numpy(), pdf["image"].to_numpy()
        y, p = np.radians(pdf["yaw"].to_numpy(float)), np.radians(pdf["pitch"].to_numpy(float))
        v = np.c_[np.sin(y) * np.cos(p), np.cos(y) * np.cos(p), np.sin(p)]
        xyz = pdf[["x", "y", "z"]].to_numpy(float)
        i, j = np.triu_indices(n, 1)
        ang = np.degrees(np.arccos(np.clip((v[i] * v[j]).sum(1), -1, 1)))
        one = (scan[i] == scan[j]) & np.isfinite(ang)
        far = one & (image[i] == image[j]) & (ang > same_deg)
        apart = set(zip(i[far].tolist(), j[far].tolist(), strict=True))
        dist = np.sqrt(((xyz[i] - xyz[j]) ** 2).sum(1))
        m1, m2 = one & (ang < same_deg), dist <= reach
        steps = [*sorted(zip(ang[m1], i[m1], j[m1], strict=True)), *sorted(zip(dist[m2], i[m2], j[m2], strict=True))]
        group = {k: {k} for k in range(n)}
        of, refused = list(range(n)), 0
        for _, a, b in steps:
            ga, gb = of[a], of[b]
            if ga == gb:
                continue
            if any((min(x, z), max(x, z)) in apart for x in group[ga] for z in group[gb]):
                refused += 1
                continue
            lo, hi = min(ga, gb), max(ga, gb)
            group[lo] |= group.pop(hi)
            for k in group[lo]:
                of[k] = lo
        return pd.DataFrame({site: pdf[site], "id": pdf["id"], "cluster": [int(pdf["id"][k]) for k in of], "refused": refused})

    shape = f"{site} long, id long, cluster long, refused long"
    small, large = greedy.split_by_size(points, [site], most)
    out = small.groupBy(site).applyInPandas(run, shape)
    if large is None:
        return out
    node = F.struct(F.col(site).alias("site"), "id")
    n = large.withColumn("node", node)
    seen = n.select(F.struct(F.col(site).alias("site"), "scan").alias("scan"), F.col("node").alias("id"), "yaw", "pitch")
    looked = within_tolerance(seen, seen.select("scan", F.col("id").alias("device"), F.lit(same_deg).alias("tol"), F.col("yaw").alias("vyaw"), F.col("pitch").alias("vpitch")))
    close = stack_edges(n.where("x is not null and y is not null").select(site, F.col("node").alias("id"), "x", "y"), reach * (1 + 1e-9) + 1e-12, site)
    roots = components(looked.where("id < device").select(F.col("id").alias("a"), F.col("device").alias("b")).unionByName(close))
    parts = n.join(roots, "node", "left").withColumn("_root", F.coalesce("root", "node")).drop("node", "root")
    by_part = parts.groupBy("_root").applyInPandas(lambda pdf: run(pdf).assign(lead=pdf["id"].min()), f"{shape}, lead long")
    total = F.sum(F.when(F.col("id") == F.col("lead"), F.col("refused"))).over(Window.partitionBy(site))
    return out.unionByName(by_part.select(site, "id", "cluster", total.alias("refused")))


def device_aggregate(m: DataFrame, key: str) -> DataFrame:
    """Members (key, ord, id, scan, type, x, y, z, hit, auto, conf, and the scan's place sx, sy, sz) to devices: the median of
    ray hits (of all members where none hit), the median distance to it, any automatic, ids by length then text, scans, best
    member (most confidence, then nearest scan, then first), top confidence. A scan without a place is the farthest.
    """
    m = m.withColumn("any_hit", F.bool_or("hit").over(Window.partitionBy(key))).withColumn("use", F.col("hit") | ~F.col("any_hit"))
    mid = m.where("use").groupBy(key).agg(*(F.percentile(c, 0.5).alias(f"m{c}") for c in "xyz"))
    j = m.join(mid, key)
    dist = F.sqrt(sum(((F.col(c) - F.col(f"m{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    seen = F.coalesce(F.sqrt(sum(((F.col(f"s{c}") - F.col(f"m{c}")) ** 2 for c in "xyz"), F.lit(0.0))), F.lit(1e9))
    ids = F.array_sort(F.collect_list(F.struct(F.length("id").alias("n"), F.col("id"))))
    out = j.groupBy(key).agg(F.first("mx").alias("x"), F.first("my").alias("y"), F.first("mz").alias("z"), F.percentile(F.when(F.col("use"), dist), 0.5).alias("spread"),
                             F.when(F.bool_or("auto"), "auto").otherwise("review").alias("status"), F.transform(ids, lambda s: s["id"]).alias("ids"),
                             F.array_sort(F.collect_set("scan")).alias("scans"), F.max_by("id", F.struct("conf", -seen, -F.col("ord"))).alias("best"), F.max("conf").alias("conf_max"))
    votes = m.groupBy(key, "type").agg(F.count("*").alias("n")).groupBy(key).agg(F.min_by("type", F.struct(-F.col("n"), F.col("type"))).alias("type"))
    return out.join(votes, key)


def agreement(members: DataFrame) -> DataFrame:
    """For each triangulation cluster its majority device and the share that agrees, and whether the device is its alone."""
    n = members.groupBy("cluster", "device").agg(F.count("*").alias("n"))
    per = n.groupBy("cluster").agg(F.max_by("device", F.struct("n", -F.col("device"))).alias("device"), (F.max("n") / F.sum("n")).alias("agreement"))
    return per.withColumn("alone", F.count("*").over(Window.partitionBy("device")) == 1)


def agreement_gate(per: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: ``clusters`` in number, those with a device, distinct devices, and whether each cluster has its own."""
    every = clusters.select("cluster", F.lit(None).cast(dict(per.dtypes)["device"]).alias("device")).unionByName(per.select("cluster", "device"))
    one = every.agg(F.countDistinct("cluster").alias("clusters"), F.count("device").alias("mapped"), F.countDistinct("device").alias("devices"))
    return one.withColumn("passed", (F.col("clusters") == F.col("mapped")) & (F.col("mapped") == F.col("devices")))


def cross_check(hits: DataFrame, tri: DataFrame) -> DataFrame:
    """Ray hits against triangulated points (id, x, y, z): the hit where there is one, the other else, and their distance."""
    h, t = (d.select("id", *(F.col(c).alias(f"{n}{c}") for c in "xyz")) for n, d in (("h", hits), ("t", tri)))
    j = h.join(t, "id", "full_outer")
    dist = F.sqrt(sum(((F.col(f"h{c}") - F.col(f"t{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    return j.select("id", *(F.coalesce(f"h{c}", f"t{c}").alias(c) for c in "xyz"), dist.alias("dist"),
                    F.when(F.col("hx").isNotNull(), "ray").otherwise("triangulation").alias("method"))


def cross_report(cross: DataFrame) -> DataFrame:
    """One row of a cross-check (``auto``, ``method``, ``dist``): detections, ray hits, the share of automatic ones that hit,
    those placed by triangulation alone, and the median and largest distance (null where none has both)."""
    ray = F.col("method") == "ray"
    return cross.agg(F.count("*").alias("detections"), F.count_if(ray).alias("hits"), F.coalesce(F.avg(F.when(F.col("auto"), ray.cast("double"))), F.lit(0.0)).alias("auto_rate"),
                     F.count_if(F.col("method") == "triangulation").alias("fallback"), F.percentile("dist", 0.5).alias("median_dist"), F.max("dist").alias("max_dist"))


def sampled(d: DataFrame, site: str, prefer: Column, n: int) -> DataFrame:
    """A check sample: one of each scan, preferred scans first, then confidence."""
    one = d.withColumn("_r", F.row_number().over(Window.partitionBy(site, "scan").orderBy(F.desc("conf"), "id"))).where("_r = 1")
    w = Window.partitionBy(site).orderBy(F.when(prefer, 0).otherwise(1), F.desc("conf"), "id")
    return one.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def sampled_stacks(d: DataFrame, site: str, n: int = 8) -> DataFrame:
    """Rays to look at, up to n of each site: devices in order, stacked ones first, each with its first ray whose scan no
    earlier device has taken.

    ``d`` (site, device, stacked, ord, id, scan), a row for each ray that hits; ``ord`` orders a device's rays. Of a scan
    no more than its first n devices can matter (each of n earlier ones takes a ray, of this scan or another), so that
    much of a site is folded in order.
    """
    key = F.struct((~F.col("stacked")).alias("later"), F.col("device"))
    d = d.withColumn("_key", key).withColumn("_n", F.dense_rank().over(Window.partitionBy(site, "scan").orderBy("_key"))).where(F.col("_n") <= n)
    each = F.array_sort(F.collect_list(F.struct("_key", "ord", "id", "scan")))
    kind = f"array<struct<device:{dict(d.dtypes)['device']},id:{dict(d.dtypes)['id']},scan:{dict(d.dtypes)['scan']}>>"
    new = lambda r: F.struct(r["_key"]["device"].alias("device"), r["id"].alias("id"), r["scan"].alias("scan"))
    taken = lambda out, r: F.exists(out, lambda x: (x["scan"] == r["scan"]) | (x["device"] == r["_key"]["device"]))
    fold = F.aggregate("rays", F.array().cast(kind), lambda out, r: F.when((F.size(out) < n) & ~taken(out, r), F.concat(out, F.array(new(r)))).otherwise(out))
    got = d.groupBy(site).agg(each.alias("rays")).select(site, F.posexplode(fold).alias("place", "r"))
    return got.select(site, "r.device", "r.id", "r.scan", (F.col("place") + 1).alias("place"))
