"""A site's pairs pass in batches rather than as one frame."""

import random

import pytest

from sightline.operators import triangulate as G


@pytest.mark.parametrize("first_free", [False, True])
def test_matching_over_many_batches(spark, monkeypatch, first_free):
    rng = random.Random(8)
    pairs = [(s, a, b, float(rng.randrange(30))) for s in range(3) for a in range(40) for b in range(40) if rng.random() < 0.5]
    want, used = set(), set()
    for s, a, b, d in sorted(pairs, key=lambda p: (p[1], p[2]) if first_free else (p[3], p[1], p[2])):
        if (s, "a", a) not in used and (s, "b", b) not in used:
            used |= {(s, "a", a), (s, "b", b)}
            want.add((s, a, b, d))
    df = spark.createDataFrame(pairs, "site long, a long, b long, dist double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        out = G.greedy_match(df, first_free)
        assert {tuple(r) for r in out.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    # no step takes a whole site as one frame
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
