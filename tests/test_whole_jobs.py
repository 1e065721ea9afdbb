"""Loops that end early must say so or go on, and no plan may pair all rows with all."""

import pytest

from sightline.operators import cluster as C
from sightline.operators import layout as Y
from sightline.plans import registry


def test_rectangles_cover_a_mask_of_many_parts(spark):
    cells = [(1, x, y) for x in range(46) for y in range(46) if (x + y) % 2 == 0]
    got = Y.rectangles(spark.createDataFrame(cells, "room long, ix long, iy long"), "room").collect()
    assert len(got) == len(cells) > 1000 and {(r.ix0, r.iy0) for r in got} == {(x, y) for _, x, y in cells}


def test_components_without_a_fixed_point_are_an_error(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long")
    with pytest.raises(RuntimeError, match="after 2 rounds"):
        C.components(chain, rounds=2, few=0)
    assert {r.root for r in C.components(chain, rounds=2).collect()} == {0}  # few edges need no rounds


def test_no_plan_has_a_nested_loop(spark, sf):
    bad = {}
    for name, f in registry.QUERIES.items():
        plan = f(spark, sf)._jdf.queryExecution().executedPlan().toString()
        if "NestedLoop" in plan or "CartesianProduct" in plan:
            bad[name] = plan
    assert not bad, list(bad)
