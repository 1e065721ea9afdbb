"""Live state of floor devices from their member detections, and lists made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live_status(devices: DataFrame, members: DataFrame) -> DataFrame:
    """``device``, ``status``: without known members the built status; all rejected: the device goes; else the best of
    confirmed, auto, review. Members: (device, status)."""
    m = members.groupBy("device").agg(F.count("*").alias("n"), F.count_if(F.col("status") != "rejected").alias("active"),
                                      F.bool_or(F.col("status") == "confirmed").alias("c"), F.bool_or(F.col("status") == "auto").alias("a"))
    j = devices.join(m, "device", "left").where("n is null or active > 0")
    return j.select("device", F.when(F.col("n").isNull(), F.col("built")).when(F.col("c"), "confirmed").when(F.col("a"), "auto").otherwise("review").alias("status"),
                    F.coalesce("active", F.lit(0)).alias("members"))


def majority(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the first seen. Nulls don't vote."""
    n = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return n.groupBy(key).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("first"))).alias("m")).select(key, f"m.{value}", F.col("m.n").alias("votes"))


def exclusive(claims: DataFrame) -> DataFrame:
    """One device keeps a register instance: the nearest (where both have positions), else the one with most members.

    ``claims`` (device, instance, dist, members, ord); the others keep their row without instance.
    """
    w = Window.partitionBy("instance").orderBy(F.col("dist").asc_nulls_last(), F.desc("members"), "ord")
    r = claims.withColumn("rn", F.when(F.col("instance").isNotNull(), F.row_number().over(w)))
    return r.select("device", F.when(F.col("rn") == 1, F.col("instance")).alias("instance"))


def summary(d: DataFrame) -> DataFrame:
    return d.agg(F.count("*").alias("relays"), F.count_if(F.col("status") == "auto").alias("auto"), F.count_if(F.col("status") == "review").alias("review"),
                 F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.count_if("overdue").alias("overdue"), F.sum("members").alias("members"))


def filtered(d: DataFrame, which: str) -> DataFrame:
    return d if which == "all" else d.where("status = 'review'") if which == "review" else d.where("overdue")


def matches(test: Column, d: DataFrame) -> DataFrame:
    """All rows, with a flag: views that dim what doesn't match keep it, lists drop it."""
    return d.withColumn("matches", F.coalesce(test, F.lit(False)))


def numbering(d: DataFrame, within: str) -> DataFrame:
    """1-based numbers: registered by location, then unregistered ones that need no review, then the rest, by id. Texts are
    in the order of the locale's root: accents and case matter less than letters."""
    local = lambda c: F.collate(c, "UNICODE") if dict(d.dtypes)[c] == "string" else F.col(c)
    rank = F.when(F.col("location").isNotNull(), 0).when(F.col("status") != "review", 1).otherwise(2)
    return d.withColumn("number", F.row_number().over(Window.partitionBy(within).orderBy(rank, local("location").asc_nulls_last(), local("device"))))


def preferred_member(m: DataFrame, prefer: Column) -> DataFrame:
    """One active member of each device: a preferred one, else of most confidence, else the first."""
    w = Window.partitionBy("device").orderBy(F.when(prefer, 0).otherwise(1), F.desc("confidence"), "ord")
    return m.where("status <> 'rejected'").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("device", "member")


def names(d: DataFrame) -> DataFrame:
    """Display name and lines of each device's marker (device, location, variant, scans, confidence, method, overdue,
    openCount); without a location it is unregistered. Lines that don't apply are left out."""
    variant = F.when(F.col("variant") == "unknown", "615 series").otherwise(F.col("variant"))
    name = F.when(F.col("location").isNull(), "Unregistered relay · 615 series").otherwise(F.concat_ws(" · ", "location", variant))
    counted = lambda n, one: F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n == 1, "").otherwise("s"))
    seen = F.concat(F.lit("Seen from "), counted(F.col("scans"), "scan point"), F.lit(" · "), F.floor(F.col("confidence") * 100 + 0.5), F.lit("%"))
    notices = F.when(F.col("openCount") > 0, counted(F.col("openCount"), "open notice"))
    lines = F.array(name, seen, F.when(F.col("method") == "triangulation", "Position: triangulated"), F.when(F.col("overdue"), "Maintenance overdue"), notices)
    return d.select("device", name.alias("name"), F.filter(lines, lambda x: x.isNotNull()).alias("lines"))


def registered(instances: DataFrame, detections: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Devices of an approximate plan: each register entry with a position and a linked detection, with the entry's place.

    ``instances`` (instance, type, x, y, z), ``detections`` (id, instance, scan, confidence, ord); of equal confidence the
    earlier detection is the best.
    """
    m = detections.where("instance is not null").groupBy("instance").agg(
        F.when(F.max("confidence") >= threshold, "auto").otherwise("review").alias("status"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda s: s["id"]).alias("ids"),
        F.array_sort(F.collect_set("scan")).alias("scans"), F.max_by("id", F.struct("confidence", -F.col("ord"))).alias("best"), F.max("confidence").alias("conf_max"))
    return instances.where("x is not null").join(m, "instance").withColumn("method", F.lit("triangulation")).withColumn("spread", F.lit(0.0))


def unlocated(u: DataFrame, detections: DataFrame) -> DataFrame:
    """Unlocated detections, without those rejected since; ones no longer known stay."""
    s = detections.select(F.col("id"), F.col("status").alias("_s"))
    return u.join(s, "id", "left").where(F.coalesce("_s", F.lit("")) != "rejected").drop("_s")


def member_rows(devices: DataFrame, detections: DataFrame) -> DataFrame:
    """Devices with their id arrays exploded and joined; ids that are missing fall out."""
    return devices.select("device", F.posexplode("ids").alias("ord", "id")).join(detections, "id")


def misplaced(devices: DataFrame, unlocated_ids: DataFrame, detections: DataFrame) -> DataFrame:
    """Detections that aren't in exactly one place, and places that name unknown detections (``times`` 0 or over 1)."""
    places = devices.select(F.explode("ids").alias("id")).unionByName(unlocated_ids.select("id")).groupBy("id").agg(F.count("*").alias("times"))
    j = detections.select("id", F.lit(True).alias("known")).join(places, "id", "full_outer")
    return j.select("id", F.coalesce("times", F.lit(0)).alias("times"), F.coalesce("known", F.lit(False)).alias("known")).where("times <> 1 or not known")


def same_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids on one side only, with the side; empty where both hold the same."""
    return (a.select("id").exceptAll(b.select("id")).withColumn("side", F.lit("left"))
            .unionByName(b.select("id").exceptAll(a.select("id")).withColumn("side", F.lit("right"))))
