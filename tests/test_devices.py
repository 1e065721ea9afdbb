"""Maintenance, live state, linking, triangulation and clusters: known cases and plain loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions.expressions import direction
from sightline.operators import cluster as C
from sightline.operators import link as L
from sightline.operators import live as V
from sightline.operators import maintenance as M
from sightline.operators import triage as T
from sightline.operators import triangulate as G
from sightline.sources import readers, sinks

D = dt.date.fromisoformat


def entry_rows(spark, rows):
    full = [(i, dev, kind, status, D(done) if done else None, D(due) if due else None, dt.datetime.fromisoformat(made), n) for n, (i, dev, kind, status, done, due, made) in enumerate(rows)]
    return spark.createDataFrame(full, "id string, instanceId string, kind string, status string, performedAt date, nextDueAt date, createdAt timestamp, ord long")


def test_status_of_the_seed_devices(spark):
    devices = spark.createDataFrame([(f"REL-0{k}", None, 12) for k in range(1, 6)], "id string, commissionedAt date, maintenanceIntervalMonths int")
    e = entry_rows(spark, [("a", "REL-01", "inspection", "done", "2025-06-10", "2026-06-10", "2025-06-10"), ("b", "REL-01", "secondary_injection_test", "done", "2024-05-22", None, "2024-05-22"),
                           ("c", "REL-02", "inspection", "done", "2026-03-02", "2027-03-02", "2026-03-02"), ("d", "REL-02", "fault", "open", None, None, "2026-09-28"),
                           ("e", "REL-04", "inspection", "done", "2026-06-12", "2027-06-12", "2026-06-12"), ("f", "REL-04", "trip_test", "done", "2025-11-03", None, "2025-11-03"),
                           ("g", "REL-05", "firmware_update", "done", "2026-04-09", "2027-04-09", "2026-04-09")])
    got = {r.id: (str(r.nextDueAt), r.overdue, r.openCount) for r in M.device_status(devices, e, "2026-10-03").collect()}
    assert got == {"REL-01": ("2026-06-10", True, 0), "REL-02": ("2027-03-02", False, 1), "REL-03": ("None", False, 0), "REL-04": ("2027-06-12", False, 0), "REL-05": ("2027-04-09", False, 0)}
    s = M.device_status(devices, e, "2026-10-03")
    assert tuple(M.totals(s).first()) == (1, 1)
    assert [r.id for r in M.due_list(s).collect()] == ["REL-01", "REL-02"]


def test_due_dates(spark):
    devices = spark.createDataFrame([("A", D("2026-01-31"), 1), ("B", D("2020-01-01"), None), ("C", D("2020-01-01"), 6)], "id string, commissionedAt date, maintenanceIntervalMonths int")
    e = entry_rows(spark, [("1", "C", "repair", "done", "2026-01-01", None, "2026-01-01"), ("2", "B", "inspection", "done", "2025-01-01", "2027-01-01", "2025-01-01"),
                           ("3", "B", "inspection", "done", "2026-01-01", "2026-02-01", "2026-01-01")])
    got = {r.id: (r.nextDueAt, r.overdue) for r in M.device_status(devices, e, "2026-02-01").collect()}
    assert got == {"A": (D("2026-02-28"), False), "B": (D("2026-02-01"), False), "C": (None, False)}


GOOD = ("1", "DEV-1", "inspection", "done", "check", "2026-09-01", "ok", "2027-09-01", "Ann", None, "", "", None, "field-app")
FIELDS = "id string, instanceId string, kind string, status string, title string, performedAt string, result string, nextDueAt string, performedBy string, company string, findings string, actions string, workPermitRef string, source string"
PLACE = {f.split()[0]: k for k, f in enumerate(FIELDS.split(", "))}


@pytest.mark.parametrize("change, fields", [({}, []), ({"performedAt": None, "nextDueAt": None}, ["performedAt"]), ({"result": None}, ["result"]), ({"kind": "party"}, ["kind"]), ({"performedAt": "2999-01-01", "nextDueAt": None}, ["performedAt"]),
                                            ({"nextDueAt": "2026-08-01"}, ["nextDueAt"]), ({"status": "open", "performedAt": None, "result": None, "kind": "fault", "nextDueAt": None}, []), ({"performedAt": "2026-13-40"}, ["performedAt"]),
                                            ({"title": "  "}, ["title"]), ({"title": "x" * 161, "source": "mail"}, ["source", "title"]), ({"findings": " " * 2001}, ["findings"]), ({"title": " ab ", "performedBy": "A"}, ["performedBy", "title"]), ({"company": " " * 90 + "x"}, [])])
def test_validation(spark, change, fields):
    row = list(GOOD)
    for k, v in change.items():
        row[PLACE[k]] = v
    df = spark.createDataFrame([tuple(row)], FIELDS)
    r = M.validate(df, "2026-10-03").first()
    assert sorted({i.field for i in r.issues}) == fields and r.valid == (not fields)


def test_quarantine_and_create(spark):
    df = spark.createDataFrame([GOOD, ("2", "NOPE", *GOOD[2:]), ("3", "DEV-1", "party", *GOOD[3:])], FIELDS)
    devices = spark.createDataFrame([("DEV-1", 12)], "id string, maintenanceIntervalMonths int")
    good, bad = M.quarantine(df, devices, "2026-10-03")
    assert [r.id for r in good.collect()] == ["1"] and sorted(r.id for r in bad.collect()) == ["2", "3"]
    e = df.select("id", "instanceId", "kind", "status", F.to_date("performedAt").alias("performedAt"), F.lit(None).cast("date").alias("nextDueAt"))
    made = {r.id: r for r in M.create(e, devices, "2026-10-03 10:00:00").collect()}
    assert set(made) == {"1", "3"} and made["1"].nextDueAt == D("2027-09-01") and made["3"].nextDueAt is None and made["1"].version == 1


ENTRY = ("id string, instanceId string, kind string, status string, title string, performedAt date, performedBy string, findings string, result string, nextDueAt date, "
         "source string, version int, createdAt timestamp, updatedAt timestamp")
MADE = dt.datetime(2026, 1, 1)


def stored_entry(i, dev="DEV-1", kind="inspection", status="done", done="2026-09-01", result="ok", due="2027-09-01", version=1):
    return i, dev, kind, status, "check", done and D(done), "Ann", "", result, due and D(due), "field-app", version, MADE, MADE


def test_full_updates(spark):
    s = spark.createDataFrame([stored_entry("a", kind="fault", status="open", done=None, result=None, due=None), stored_entry("b", version=3), stored_entry("c"), stored_entry("d"), stored_entry("e"),
                               stored_entry("f", dev="GONE"), stored_entry("g"), stored_entry("h")], ENTRY)
    p = [("a", 1, "done", "2026-10-03", "ok", "HMI replaced", "DEV-2", None, None), ("b", 1, None, None, None, "stale", None, None, None), ("d", 1, None, "2999-01-01", None, None, None, None, None),
         ("e", 1, None, "2026-09-20", None, None, None, ["nextDueAt"], None), ("f", 1, None, None, None, "x", None, None, None), ("g", 1, None, None, None, None, None, ["result"], None),
         ("h", 1, None, None, None, None, None, None, "2026-08-01"), ("z", 1, "done", None, None, None, None, None, None)]
    patches = spark.createDataFrame([(*r[:3], r[3] and D(r[3]), *r[4:8], r[8] and D(r[8])) for r in p],
                                    "id string, base int, status string, performedAt date, result string, findings string, instanceId string, clear array<string>, nextDueAt date").withColumn("ord", F.lit(1))
    devices = spark.createDataFrame([("DEV-1", 12), ("DEV-2", 6)], "id string, maintenanceIntervalMonths int")
    log, answers = M.apply_patches(s, patches, devices, "2026-10-03 12:00:00", "2026-10-03")
    assert log.columns == s.columns and log.dtypes == s.dtypes
    got = {r.id: r for r in log.collect()}
    said = {r.id: (r.outcome, r.version) for r in answers.collect()}
    assert said == {"a": ("applied", 2), "b": ("conflict", None), "d": ("invalid", None), "e": ("applied", 2), "f": ("unknown_device", None), "g": ("invalid", None), "h": ("invalid", None), "z": ("not_found", None)}
    assert sorted(got) == list("abcdefgh")
    a, e = got["a"], got["e"]
    assert (a.version, a.status, a.findings, a.instanceId, a.createdAt, a.updatedAt) == (2, "done", "HMI replaced", "DEV-1", MADE, dt.datetime(2026, 10, 3, 12)) and a.nextDueAt is None
    assert e.nextDueAt == D("2027-09-20") and e.performedAt == D("2026-09-20")  # due anew, one interval after the new date
    assert all(got[i].version == v and got[i].updatedAt == MADE and got[i].findings == "" for i, v in (("b", 3), ("c", 1), ("d", 1), ("f", 1)))
    c = M.conflicts(log, answers, patches)
    assert [(r.id, r.version, r.findings) for r in M.resolved(c, "stored").collect()] == [("b", 3, "")]
    again = M.resolved(c, "mine")
    assert [(r.id, r.base, r.findings) for r in again.collect()] == [("b", 3, "stale")]
    after, then = M.apply_patches(log, again, devices, "2026-10-03 13:00:00", "2026-10-03")
    assert [(r.version, r.findings) for r in after.where("id = 'b'").collect()] == [(4, "stale")] and [tuple(r) for r in then.collect()] == [("b", 1, 3, "applied", 4)]
    with pytest.raises(ValueError):
        M.resolved(c, "both")


def plain_fold(version, patches):
    """Answers to the patches (ord, base, fails) of one entry."""
    said = []
    for _, base, fails in sorted(patches, key=lambda x: x[0]):
        outcome = "conflict" if base != version else "invalid" if fails else "applied"
        version += outcome == "applied"
        said.append((outcome, version if outcome == "applied" else None))
    return said


@pytest.mark.parametrize("most", [1000, 3, 1])
def test_each_patch_has_an_answer(spark, most):
    """Chains, repeats, stale and faulty patches of several entries, whatever the number that a pass takes."""
    rng = random.Random(11)
    todo = {i: [(k, rng.randrange(1, 7), rng.random() < 0.3) for k in range(14)] for i in "abc"} | {"d": [(0, 1, False), (1, 2, False), (2, 3, False)], "e": []}
    s = spark.createDataFrame([stored_entry(i, version=1 + (i == "b")) for i in todo], ENTRY)
    patches = spark.createDataFrame([(i, k, base, f"{i}{k}", D("2999-01-01") if fails else None) for i, ps in todo.items() for k, base, fails in ps], "id string, ord long, base int, findings string, performedAt date").repartition(5)
    devices = spark.createDataFrame([("DEV-1", 12)], "id string, maintenanceIntervalMonths int")
    log, answers = M.apply_patches(s, patches, devices, "2026-10-03 12:00:00", "2026-10-03", most=most)
    got = {(r.id, r.ord): (r.outcome, r.version) for r in answers.collect()}
    want = {(i, p[0]): a for i, ps in todo.items() for p, a in zip(ps, plain_fold(1 + (i == "b"), ps), strict=True)}
    assert got == want and answers.count() == len(want)
    for r in log.collect():
        mine = [(k, v) for (i, k), (o, v) in want.items() if i == r.id and o == "applied"]
        assert (r.version, r.findings) == ((max(v for _, v in mine), f"{r.id}{max(mine)[0]}") if mine else (1 + (r.id == "b"), ""))


def test_equal_new_entries_have_ids_of_their_own(spark):
    e = spark.createDataFrame([("DEV-1", "inspection", "done", D("2026-09-01"), None)] * 3, "instanceId string, kind string, status string, performedAt date, nextDueAt date")
    devices = spark.createDataFrame([("DEV-1", 12)], "id string, maintenanceIntervalMonths int")
    made = [M.create(e.repartition(n), devices, "2026-10-03 10:00:00").select("id").collect() for n in (1, 3)]
    assert len({r.id for r in made[0]}) == 3 and sorted(made[0]) == sorted(made[1])


def test_seed_history_is_valid_and_fixed(spark):
    d = spark.createDataFrame([("R1", "overdue"), ("R2", "open-fault"), ("R3", "empty"), ("R4", "ok"), ("R5", "ok-firmware")], "id string, profile string")
    h = M.seed_history(d)
    got = {r.id: (str(r.performedAt), str(r.nextDueAt), r.version, r.source, r.createdAt) for r in h.collect()}
    assert len(got) == 7 and got["seed-R1-1"] == ("2025-06-10", "2026-06-10", 1, "seed", dt.datetime(2025, 6, 10, 8)) and got["seed-R2-2"][0] == "None" and got["seed-R2-2"][4] == dt.datetime(2026, 9, 28, 8)
    text = h.withColumn("performedAt", F.col("performedAt").cast("string")).withColumn("nextDueAt", F.col("nextDueAt").cast("string"))
    assert M.validate(text, "2026-10-03").where("not valid").count() == 0
    ids = [r.id for r in M.create(h.drop("id", "version", "createdAt", "updatedAt"), spark.createDataFrame([(f"R{k}", 12) for k in range(1, 6)], "id string, maintenanceIntervalMonths int"), "2026-10-03 00:00:00").collect()]
    assert len(set(ids)) == 7 and all(len(i) == 36 for i in ids)


def test_seed_refresh(spark):
    f = "id string, instanceId string, source string, version int"
    own = spark.createDataFrame([("u1", "DEV-2", "field-app", 1), ("u2", "REMOVED", "field-app", 1), ("s1", "DEV-1", "seed", 2), ("s2", "DEV-1", "seed", 1)], f)
    seed = spark.createDataFrame([("s1", "DEV-1", "seed", 1), ("s3", "DEV-1", "seed", 1)], f)
    devices = spark.createDataFrame([("DEV-1",), ("DEV-2",)], "id string")
    assert sorted((r.id, r.version) for r in M.refresh_seed(own, seed, devices).collect()) == [("s1", 2), ("s3", 1), ("u1", 1)]


def test_live_status(spark):
    m = [("a", "rejected"), ("a", "rejected"), ("b", "review"), ("b", "confirmed"), ("b", "rejected"), ("c", "review"), ("c", "auto"), ("d", "review"), ("d", "rejected")]
    d = spark.createDataFrame([(k, "auto") for k in "abcde"], "device string, built string")
    got = {r.device: r.status for r in V.live_status(d, spark.createDataFrame(m, "device string, status string")).collect()}
    assert got == {"b": "confirmed", "c": "auto", "d": "review", "e": "auto"}


def test_majority_and_exclusivity(spark):
    r = spark.createDataFrame([("x", "A", 1), ("x", "B", 2), ("x", "B", 3), ("x", None, 4), ("y", "A", 2), ("y", "B", 1)], "device string, inst string, ord long")
    assert {v.device: v.inst for v in V.majority(r, "device", "inst", "ord").collect()} == {"x": "B", "y": "B"}
    c = spark.createDataFrame([("upper", "R5", 0.30, 9, 1), ("lower", "R5", 0.01, 1, 2), ("other", None, None, 1, 3)], "device string, instance string, dist double, members int, ord int")
    assert {v.device: v.instance for v in V.exclusive(c).collect()} == {"upper": None, "lower": "R5", "other": None}


def linked(spark, detections, devices):
    d = spark.createDataFrame(detections, "id long, scan string, yaw double, pitch double")
    v = spark.createDataFrame(devices, "device string, site string, anchors array<struct<scan:string,yaw:double,pitch:double>>, x double, y double, z double, tol double")
    scans = spark.createDataFrame([("scan-a", "s", 0.0, 0.0, 1.5), ("scan-b", "s", 2.0, 0.0, 1.5)], "scan string, site string, sx double, sy double, sz double")
    return {r.id: (r.outcome, r.device) for r in L.link(d, L.views_of(v, scans)).collect()}


def test_linking(spark):
    a = ("A", "s", [("scan-a", 10.0, 20.0)], None, None, None, 3.0)
    got = linked(spark, [(1, "scan-a", 12.9, 20.0), (2, "scan-a", 14.0, 20.0), (3, "scan-b", 10.0, 20.0), (4, None, 10.0, 20.0), (5, "scan-a", None, None)], [a])
    assert got == {1: ("linked", "A"), 2: ("none", None), 3: ("none", None), 4: ("none", None), 5: ("none", None)}
    assert linked(spark, [(1, "scan-a", -179.0, 0.0)], [("W", "s", [("scan-a", 179.0, 0.0)], None, None, None, 3.0)]) == {1: ("linked", "W")}
    assert linked(spark, [(1, "scan-b", -44.0, 1.0)], [("P", "s", [], 0.0, 2.0, 1.5, 3.0)]) == {1: ("linked", "P")}
    two = [("A", "s", [("scan-a", 10.0, 0.0)], None, None, None, 3.0), ("B", "s", [("scan-a", 11.0, 0.0)], None, None, None, 3.0)]
    assert linked(spark, [(1, "scan-a", 10.5, 0.0), (2, "scan-a", 13.5, 0.0)], two) == {1: ("ambiguous", None), 2: ("linked", "B")}


def ray_rows(spark, rows):
    df = spark.createDataFrame([(0, k, k, *r) for k, r in enumerate(rows, 1)], "site long, ord long, id long, scan long, ox double, oy double, oz double, yaw double, pitch double, conf double")
    return df.select("*", *(c.alias(n) for n, c in zip(("dx", "dy", "dz"), direction("yaw", "pitch"), strict=True)))


def toward(o, p):
    d = np.array(p, float) - o
    return float(np.degrees(np.arctan2(d[0], d[1]))), float(np.degrees(np.arcsin(d[2] / np.linalg.norm(d))))


def test_triangulation(spark):
    a, b, dev = (0.0, 0.0, 1.5), (2.0, 0.0, 1.5), (0.0, 2.0, 2.0)
    r = ray_rows(spark, [(1, *a, *toward(a, dev), 0.9), (2, *b, *toward(b, dev), 0.4), (2, *b, *toward(b, (3, 2, 1)), 0.9)])
    got = {v.id: v for v in G.clusters(r).collect()}
    assert got[1].cluster == got[2].cluster != got[3].cluster and got[1].multi and not got[3].multi
    assert np.allclose([got[1].x, got[1].y, got[1].z], dev, atol=0.01)
    p = G.located(r.where("id < 3"), "site").first()
    assert np.allclose([p.x, p.y, p.z], dev, atol=1e-6)
    assert G.located(r.where("id = 1"), "site").first().x is None
    c = G.pair_candidates(r)
    assert (1, 2) in {(v.i, v.j) for v in c.collect()}


def test_matching_against_loops(spark):
    rng = random.Random(3)
    rows = [(s, a, b, round(rng.random(), 2)) for s in range(4) for a in range(8) for b in range(8) if rng.random() < 0.5]
    df = spark.createDataFrame(rows, "site long, a long, b long, dist double")
    for first_free in (True, False):
        want = set()
        for s in range(4):
            ua, ub = set(), set()
            for r in sorted((r for r in rows if r[0] == s), key=(lambda r: (r[1], r[2])) if first_free else (lambda r: (r[3], r[1], r[2]))):
                if r[1] not in ua and r[2] not in ub:
                    ua.add(r[1])
                    ub.add(r[2])
                    want.add(r[:3])
        assert {(r.site, r.a, r.b) for r in G.greedy_match(df, first_free).collect()} == want


def test_reruns_keep_ids(spark):
    new = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3)], "site long, b long, place long")
    old = spark.createDataFrame([(0, 5), (0, 7)], "site long, a long")
    m = spark.createDataFrame([(0, 5, 2, 0.1)], "site long, a long, b long, dist double")
    assert sorted((r.device, r.state) for r in G.stable_ids(new, m, old).collect()) == [(5, "seen"), (7, "missing"), (8, "seen"), (9, "seen")]


def test_components_and_stacks(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1200)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.node: r.root for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}
    f = "site long, id long, x double, y double, z double"
    s = C.stacks(spark.createDataFrame([(0, 1, -2.75, -5.93, 1.43), (0, 2, -2.74, -5.9, 1.73), (0, 3, -1.75, -5.93, 1.0)], f), 0.25, "site").collect()
    assert sorted((r.id, r.stack, r.place, r["size"], r["shift"]) for r in s) == [(1, 1, 1, 2, 0.5), (2, 1, 0, 2, -0.5), (3, 3, 0, 1, 0.0)]


def test_suppression_and_leaders(spark):
    rng = random.Random(4)
    rows = [(v, k, *(x := (rng.uniform(0, 60), rng.uniform(0, 60))), x[0] + 20, x[1] + 20, round(rng.random(), 2)) for v in range(3) for k in range(15)]
    df = spark.createDataFrame(rows, "view long, ord long, x1 double, y1 double, x2 double, y2 double, conf double")
    want = set()
    for v in range(3):
        kept = []
        for r in sorted((r for r in rows if r[0] == v), key=lambda r: (-r[6], r[1])):
            cx, cy = (r[2] + r[4]) / 2, (r[3] + r[5]) / 2
            if not any(k[2] <= cx <= k[4] and k[3] <= cy <= k[5] for k in kept):
                kept.append(r)
        want |= {(v, r[1]) for r in kept}
    assert {(r.view, r.ord) for r in C.suppressed(df, ["view"]).collect()} == want
    c = spark.createDataFrame([(0, 1, 0.0, 0.0, 10.0, 0.9), (0, 2, 4.0, 0.0, 4.0, 0.8), (0, 3, 8.0, 0.0, 4.0, 0.7)], "scan long, ord long, yaw double, pitch double, size double, conf double")
    assert {r.ord: r.leader for r in C.led_clusters(c, "scan").collect()} == {1: 1, 2: 1, 3: 3}


def test_constrained_clusters(spark):
    """Detections of one image further apart than the angle never meet; those of two images of a scan may."""
    f = "site long, id long, scan long, image long, yaw double, pitch double, x double, y double, z double"
    rows = [(0, 1, 1, 1, 0.0, 0.0, 0.0, 0.0, 0.0), (0, 2, 1, 1, 1.0, 0.0, 0.5, 0.0, 0.0), (0, 3, 1, 1, 20.0, 0.0, 0.1, 0.0, 0.0), (0, 4, 2, 2, 0.0, 0.0, 0.05, 0.0, 0.0)]
    got = {r.id: r for r in C.constrained(spark.createDataFrame(rows, f), "site").collect()}
    assert got[1].cluster == got[2].cluster == got[4].cluster == 1 != got[3].cluster and got[3].refused == 2
    other = [(*r[:3], 9 if r[1] == 3 else r[3], *r[4:]) for r in rows]  # the same with detection 3 in another image of its scan
    got = {r.id: r for r in C.constrained(spark.createDataFrame(other, f), "site").collect()}
    assert len({r.cluster for r in got.values()}) == 1 and got[3].refused == 0


def test_clusters_that_become_devices(spark):
    m = spark.createDataFrame([(0, "a", 0.9, True, "t", True), (0, "a", 0.5, False, None, True), (0, "b", 0.8, True, "t", True), (0, "b", 0.9, True, "u", True), (0, "c", 0.7, False, "t", True), (0, "d", 0.99, True, None, False), (0, "d", 0.4, False, None, False)],
                              "site long, cluster string, conf double, auto boolean, type string, placed boolean")
    assert [(r.cluster, r.autos, r.n, r.place) for r in G.eligible(m, "site", "t").orderBy("place").collect()] == [("d", 1, 2, 1), ("a", 1, 2, 2)]
    assert tuple(G.register_stats(m).first()) == (7, 4, 4, 3, 3, 1)


def test_numbers_go_on_from_the_largest(spark):
    old = spark.createDataFrame([("s", 3), ("s", 99)], "site string, number int")
    new = spark.createDataFrame([("s", 1, None, 9.0), ("s", 2, 1.4, 5.0), ("s", 3, None, 1.0), ("s", 4, 0.6, 4.0), ("s", 5, -0.5, 7.0), ("s", 6, -3.0, 0.0)], "site string, place int, x double, y double")
    got = {r.place: r.label for r in G.renumbered(new, old, 7, "site").collect()}
    # -0.5 rounds up to 0; 0.6 and 1.4 to 1, where y decides; unplaced ones last, strongest first; the sixth finds no room
    assert got == {5: "REL-100", 4: "REL-101", 2: "REL-102", 1: "REL-103", 3: "REL-104"}


def plain_angle(a, b):
    v = lambda y, p: np.array([np.sin(y) * np.cos(p), np.cos(y) * np.cos(p), np.sin(p)])
    return float(np.degrees(np.arccos(np.clip(v(*np.radians(a)) @ v(*np.radians(b)), -1, 1))))


def test_directions_meet_by_cells(spark):
    """Against all pairs, at the wrap and at the poles too."""
    rng = random.Random(5)
    d = [(rng.randrange(2), k, rng.choice([rng.uniform(-180, 180), 179.9, -179.9, 0.0]), rng.choice([rng.uniform(-90, 90), 89.5, -90.0, 88.0])) for k in range(150)]
    v = [(rng.randrange(2), k, rng.choice([0.0, 1.0, 3.0, 12.0]), rng.choice([rng.uniform(-180, 180), -180.0, 179.5]), rng.choice([rng.uniform(-90, 90), 90.0, 85.0, -88.5])) for k in range(120)]
    got = L.within_tolerance(spark.createDataFrame(d, "scan long, id long, yaw double, pitch double"), spark.createDataFrame(v, "scan long, device long, tol double, vyaw double, vpitch double"))
    want = {(i, j) for s, i, y, p in d for t, j, tol, vy, vp in v if s == t and plain_angle((y, p), (vy, vp)) <= tol}
    rows = [(r.id, r.device) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 200


def test_earlier_devices_by_place_else_by_anchor(spark):
    """Both with a place: only the distance counts. Else any anchor; the first free cluster in order wins."""
    anchors = "array<struct<scan:long,yaw:double,pitch:double>>"
    old = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0, [(1, 10.0, 0.0)], 3.0), (0, 2, None, None, None, [(1, 50.0, 0.0), (2, 0.0, 0.0)], 3.0), (0, 3, 5.0, 0.0, 0.0, [(1, 90.0, 0.0)], 3.0)], f"site long, a long, x double, y double, z double, anchors {anchors}, tol double")
    new = spark.createDataFrame([(0, 1, 9.0, 0.0, 0.0, [(1, 10.0, 0.0)]), (0, 2, 0.2, 0.0, 0.2, [(1, 99.0, 0.0)]), (0, 3, 1.0, 1.0, 1.0, [(2, 2.0, 0.0)]), (0, 4, None, None, None, [(1, 91.0, 0.0), (1, 51.0, 0.0)])], f"site long, b long, x double, y double, z double, members {anchors}")
    p = G.same_devices(old, new)
    assert {(r.a, r.b) for r in p.collect()} == {(1, 2), (2, 3), (2, 4), (3, 4)}
    assert {(r.a, r.b) for r in G.greedy_match(p, first_free=True).collect()} == {(1, 2), (2, 3), (3, 4)}


def test_floor_devices_keep_ids_of_close_ones(spark):
    old = spark.createDataFrame([("s", 4, 0.0, 0.0, 0.0), ("s", 7, 1.0, 0.0, 0.0)], "site string, a long, x double, y double, z double")
    new = spark.createDataFrame([("s", 1, 0.15, 0.0, 0.0), ("s", 2, 0.05, 0.0, 0.0), ("s", 3, 1.0, 0.0, 0.21), ("s", 5, 3.0, 1.0, 0.0), ("s", 6, 3.0, 0.5, 0.0)], "site string, b long, x double, y double, z double")
    pairs = G.close_pairs(old, new, "site")
    m = G.greedy_match(pairs.select(F.lit(0).alias("site"), "a", "b", "dist"), first_free=False).select(F.lit("s").alias("site"), "a", "b")
    got = G.stable_ids(new, m, old, order=(F.desc("x"), "y", "z"))
    assert sorted((r.device, r.state) for r in got.collect()) == [(4, "seen"), (7, "missing"), (8, "seen"), (9, "seen"), (10, "seen"), (11, "seen")]
    assert [(r.a, r.b) for r in m.collect()] == [(4, 2)]


def test_ray_samples_against_a_loop(spark):
    rng = random.Random(7)
    rows = [(s, d, d % 3 == 0, o, s * 1000 + d * 10 + o, rng.randrange(12)) for s in range(3) for d in range(30) for o in range(rng.randrange(1, 5))]
    want = set()
    for s in range(3):
        taken, out = set(), []
        for d in sorted({r[1] for r in rows if r[0] == s}, key=lambda d: (d % 3 != 0, d)):
            for r in sorted(r for r in rows if r[:2] == (s, d)):
                if r[5] not in taken and len(out) < 8:
                    taken.add(r[5])
                    out.append((s, d, r[4], r[5], len(out) + 1))
                    break
        want |= set(out)
    df = spark.createDataFrame(rows, "site long, device long, stacked boolean, ord long, id long, scan long")
    assert {tuple(r) for r in C.sampled_stacks(df, "site").collect()} == want


def test_headers_pair_with_points(spark):
    h = spark.createDataFrame([("s", 1, 0.0, 0.0, 0.0), ("s", 2, 5.0, 0.0, 0.0), ("t", 3, 0.0, 0.0, 0.0), ("t", 4, 0.5, 0.0, 0.0)], "site string, header long, hx double, hy double, hz double")
    p = spark.createDataFrame([("s", 1, 0.05, 0.0, 0.0), ("s", 2, 5.0, 0.01, 0.0), ("t", 3, 0.2, 0.0, 0.0)], "site string, point long, x double, y double, z double")
    pairs = L.nearest_pairing(h, p)
    assert {(r.header, r.point, r.unique, r.sure) for r in pairs.collect()} == {(1, 1, True, True), (2, 2, True, True), (3, 3, False, False), (4, 3, False, False)}
    assert {(r.site, r.paired, r.headers, r.points, r.passed) for r in L.pairing_gate(pairs, h, p).collect()} == {("s", 2, 2, 2, True), ("t", 2, 2, 1, False)}


def test_device_aggregate(spark):
    f = "device long, ord long, id string, scan long, type string, x double, y double, z double, hit boolean, auto boolean, conf double, sx double, sy double, sz double"
    rows = [(1, 0, "d10", 2, "t", 0.0, 0.0, 0.0, True, False, 0.5, 1.0, 0.0, 0.0), (1, 1, "d9", 1, "u", 2.0, 0.0, 0.0, True, True, 0.9, 4.0, 0.0, 0.0), (1, 2, "d2", 1, "u", 99.0, 0.0, 0.0, False, False, 0.9, 3.0, 0.0, 0.0)]
    r = C.device_aggregate(spark.createDataFrame(rows, f), "device").first()
    assert (r.x, r.spread, r.status, r.ids, r.scans, r.best, r.type) == (1.0, 1.0, "auto", ["d2", "d9", "d10"], [1, 2], "d2", "u")
    # all alike: the first stands; a scan without a place is the farthest
    same = [(2, k, i, 1, "t", 0.0, 0.0, 0.0, True, True, 0.9, 1.0, 0.0, 0.0) for k, i in enumerate(("d5", "d7", "d6"))] + [(3, 0, "a", 1, "t", 0.0, 0.0, 0.0, True, True, 0.9, None, None, None), (3, 1, "b", 1, "t", 0.0, 0.0, 0.0, True, True, 0.9, 50.0, 0.0, 0.0)]
    assert {r.device: r.best for r in C.device_aggregate(spark.createDataFrame(same, f), "device").collect()} == {2: "d5", 3: "b"}


def test_numbers_follow_the_order_of_letters(spark):
    d = spark.createDataFrame([("d1", "Zulu", "auto"), ("d2", "alpha", "auto"), ("d3", "Ärla", "auto"), ("d4", "Beta", "auto"), ("d5", None, "review"), ("D6", None, "auto"), ("d7", None, "auto"), ("c9", None, "auto")], "device string, location string, status string").withColumn("floor", F.lit(1))
    assert [r.device for r in V.numbering(d, "floor").orderBy("number").collect()] == ["d2", "d3", "d4", "d1", "c9", "D6", "d7", "d5"]


def test_cross_report(spark):
    rows = [(1, True, "ray", 0.1), (2, True, "triangulation", None), (3, False, "ray", 0.5), (4, True, "ray", None)]
    r = C.cross_report(spark.createDataFrame(rows, "id long, auto boolean, method string, dist double")).first()
    assert (r.detections, r.hits, round(r.auto_rate, 4), r.fallback, r.median_dist, r.max_dist) == (4, 3, 0.6667, 1, 0.3, 0.5)


def test_triage_edges(spark):
    df = spark.createDataFrame([(1, 0.75), (2, 0.7499)], "id long, c double")
    assert [r[0] for r in df.select(T.status_of(F.col("c"))).collect()] == ["auto", "review"]
    v = spark.createDataFrame([(0.80, 0.9, 0.0), (0.80, 0.5, 70.0), (0.9, 0.4, 0.0), (0.80, 0.8, 0.0)], "similarity double, conf double, ocr double")
    got = [(r.verdict, r.confidence) for r in T.verdict(v).collect()]
    assert [g[0] for g in got] == ["accept", "reject", "accept", "review"]
    assert got[0][1] == pytest.approx(0.9 * (0.6 + 0.4 * (0.04 / 0.12)), abs=5e-4) and got[1][1] is None


def test_reset_leaves_the_seed(spark, tmp_path):
    seed = spark.createDataFrame([("s1", 1)], "id string, version int")
    spark.createDataFrame([("s1", 3), ("u1", 1)], seed.schema).write.parquet(f"{tmp_path}/log")
    M.reset(seed, f"{tmp_path}/log")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/log").collect()] == [("s1", 1)]
    sinks.put(seed.union(seed), f"{tmp_path}/published")
    M.reset(seed, f"{tmp_path}/published")
    assert [tuple(r) for r in readers.published(spark, f"{tmp_path}/published").collect()] == [("s1", 1)]


def test_marker_lines(spark):
    f = "device long, location string, variant string, scans long, confidence double, method string, overdue boolean, openCount long"
    d = spark.createDataFrame([(1, "A / Panel 1", "unknown", 1, 0.985, "triangulation", True, 1), (2, None, None, 3, 0.5, "raycast", False, 0), (3, "B", "REF615", 2, 0.744, "raycast", None, 2)], f)
    got = {r.device: r.lines for r in V.names(d).collect()}
    assert got[1] == ["A / Panel 1 · 615 series", "Seen from 1 scan point · 99%", "Position: triangulated", "Maintenance overdue", "1 open notice"]
    assert got[2] == ["Unregistered relay · 615 series", "Seen from 3 scan points · 50%"] and got[3] == ["B · REF615", "Seen from 2 scan points · 74%", "2 open notices"]


def test_devices_of_an_approximate_plan(spark):
    i = spark.createDataFrame([("A", "t", 1.0, 2.0, 3.0), ("B", "t", None, None, None), ("C", "t", 0.0, 0.0, 0.0)], "instance string, type string, x double, y double, z double")
    d = spark.createDataFrame([(1, "A", "s2", 0.5, 1), (2, "A", "s1", 0.9, 2), (3, "A", None, 0.9, 3), (4, "B", "s1", 0.9, 4), (5, None, "s1", 0.9, 5)], "id long, instance string, scan string, confidence double, ord long")
    r = V.registered(i, d).collect()
    assert [(x.instance, x.status, x.ids, x.scans, x.best, x.x, x.method) for x in r] == [("A", "auto", [1, 2, 3], ["s1", "s2"], 2, 1.0, "triangulation")]


def test_gates(spark):
    from sightline.operators import gates as K

    tri = spark.createDataFrame([(True, "ray", 0.05), (True, "ray", 0.07), (True, "ray", None), (True, "ray", 0.01), (True, "triangulation", None), (False, "triangulation", None)], "auto boolean, method string, dist double")
    ok = spark.createDataFrame([(True, 0.02)], "passed boolean, worst double")
    discs = spark.createDataFrame([(k == 0,) for k in range(20)], "blocked boolean")
    m = spark.createDataFrame([(1, 7), (1, 7), (2, 8), (3, 8)], "cluster long, device long")
    a6 = C.agreement_gate(C.agreement(m), m)
    assert tuple(a6.first()) == (3, 3, 2, False)
    assert tuple(C.agreement_gate(C.agreement(m.where("cluster < 3")), m.where("cluster < 3")).first()) == (2, 2, 2, True)
    size = spark.createDataFrame([(999_999, 5)], "picture_bytes long, text_bytes long")
    g = K.together(K.paired(ok), K.reprojected(ok.select(F.col("passed").alias("ok"))), K.located(tri), K.one_to_one(a6), K.walkway(discs), K.sizes(size))
    assert {r.gate: r.passed for r in g.collect()} == {"A0": True, "A3": True, "A5": True, "A6": False, "walkway": False, "sizes": True}
    assert not K.located(tri.withColumn("dist", F.lit(0.1))).first().passed and not K.located(tri.where("false")).first().passed
    assert K.in_one_row(g).first().asDict() == {"A0": True, "A3": True, "A5": True, "A6": False, "sizes": True, "walkway": False}


def test_links_are_joined_back(spark):
    d = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    links = spark.createDataFrame([(1, "A", "linked"), (2, None, "ambiguous")], "id long, device string, outcome string")
    assert {r.id: r.instance for r in L.with_links(d, links).collect()} == {1: "A", 2: None, 3: None}
