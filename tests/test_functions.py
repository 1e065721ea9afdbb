"""Column functions against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import expressions as E
from sightline.functions import text as X


def test_rounding_rules(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,), (0.125,), (1.0049999,)], "x double")
    got = df.select(E.half_up("x").alias("u"), E.half_even("x", 2).alias("e"), E.snap("x", 0.5).alias("s")).collect()
    assert [r.u for r in got] == [-2.0, 3.0, 0.0, 1.0]
    assert [r.e for r in got] == [-2.5, 2.5, 0.12, 1.0]
    assert [r.s for r in got] == [-2.5, 2.5, 0.0, 1.0]


def test_angles_wrap_and_clamp(spark):
    df = spark.createDataFrame([(179.0, 0.0, -179.0, 0.0), (10.0, 20.0, 10.0, 20.0), (0.0, 90.0, 123.0, 90.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(E.angle_between(*map(F.col, "abcd"))).collect()]
    assert got[0] == pytest.approx(2.0) and got[1] == pytest.approx(0.0, abs=1e-5) and got[2] == pytest.approx(0.0, abs=1e-5)


def test_view_inverts_direction_and_takes_zero_length(spark):
    df = spark.createDataFrame([(30.0, -20.0), (-170.0, 45.0)], "yaw double, pitch double")
    d = E.direction("yaw", "pitch")
    for r in df.select("yaw", "pitch", *(c.alias(n) for n, c in zip(("y2", "p2", "r"), E.view(*(5 * c for c in d)), strict=True))).collect():
        assert (r.y2, r.p2, r.r) == (pytest.approx(r.yaw), pytest.approx(r.pitch), pytest.approx(5.0))
    assert spark.range(1).select(E.view(F.lit(0.0), F.lit(0.0), F.lit(0.0))[1]).first()[0] == 0.0


def test_rotation_is_the_quaternions(spark):
    q = (math.cos(math.pi / 4), 0.0, 0.0, math.sin(math.pi / 4))
    r = spark.range(1).select(*E.rotate(tuple(map(F.lit, q)), (F.lit(1.0), F.lit(0.0), F.lit(0.0)))).first()
    assert [round(v, 9) for v in r] == [0.0, 1.0, 0.0]


def test_plan_pixels_invert(spark):
    df = spark.createDataFrame([(-9.3, 0.6), (0.7, -9.1)], "x double, y double")
    px, py = E.plan_pixel(F.col("x"), F.col("y"), -9.3, 0.6, 10 / 1600)
    got = df.select("x", "y", px.alias("px"), py.alias("py"))
    x, y = E.plan_world(F.col("px"), F.col("py"), -9.3, 0.6, 10 / 1600)
    r = got.select("*", x.alias("x2"), y.alias("y2")).collect()
    assert (r[0].px, r[0].py) == (0.0, 0.0)
    assert all(abs(v.x - v.x2) < 1e-6 and abs(v.y - v.y2) < 1e-6 for v in r)


def test_months_are_clamped(spark):
    r = spark.sql("select add_months(date'2026-01-31', 1), add_months(date'2025-06-10', 12)").first()
    assert [str(v) for v in r] == ["2026-02-28", "2026-06-10"]


def slow_ratio(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            t[i, j] = t[i - 1, j - 1] + 1 if x == y else max(t[i - 1, j], t[i, j - 1])
    return 200 * t[-1, -1] / (len(a) + len(b)) if a or b else 100.0


def test_fuzzy_ratio():
    assert [round(X.ratio(a, "REF615"), 2) for a in ("REF6L5", "615", "RE615")] == [83.33, 66.67, 90.91]
    rng = random.Random(0)
    for _ in range(300):
        a, b = ("".join(rng.choice("ABC1") for _ in range(rng.randrange(12))) for _ in range(2))
        assert X.ratio(a, b) == pytest.approx(slow_ratio(a, b))


def test_fuzzy_match_against_all_pairs(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").limit(200)
    texts = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    names = p.select(F.explode(F.split("p_type", " ")).alias("identifier")).distinct()
    got = {r.id: r for r in X.fuzzy_match(texts, names).collect()}
    import re

    norm = lambda s: re.sub("[^A-Z0-9]", "", s.upper())
    ids = [r.identifier for r in names.collect()]
    assert len(got) == texts.count()
    for r in texts.collect():
        best = max((slow_ratio(norm(t), norm(i)) for t in [r.text, *r.text.split()] if len(norm(t)) > 1 for i in ids if norm(i)), default=0)
        assert got[r.id].hit == (best >= 65)
        if best >= 65:
            assert got[r.id].score == pytest.approx(best)


def test_searches(spark):
    df = spark.createDataFrame([("Feeder relay", ["REF615"]), ("Motor", ["REM615", "615"]), ("x", [])], "name string, ids array<string>")
    assert X.search_any(df, "  ", ["name"], ["ids"]).count() == 3
    assert X.search_any(df, "rem6", ["name"], ["ids"]).count() == 1
    assert X.search_joined(df, "RELAY", ["name"]).count() == 1
    assert X.approximate_search(df, "motr", "name").first().name == "Motor"


def test_documents_by_variant(spark):
    docs = spark.createDataFrame([(1, "REF615 Product guide"), (1, "REM615 Application manual"), (1, "615 series Installation manual"), (2, "Brochure")], "type int, title string")
    devices = spark.createDataFrame([("m", 1, "REM615"), ("t", 1, "RET615"), ("u", 1, "unknown"), ("n", 1, None), ("b", 2, "REM615")], "device string, type int, variant string")
    got = {}
    for r in X.docs_for_variant(devices, docs).collect():
        got.setdefault(r.device, set()).add((r.title.split()[0], r.warning))
    family = {("REF615", True), ("615", True)}
    assert got == {"m": {("REM615", False), ("615", False)}, "t": family, "u": family, "n": family, "b": {("Brochure", False)}}
