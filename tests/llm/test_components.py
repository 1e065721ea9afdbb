"""A loop that ends before its fixed point must say so, and rounds leave no files behind."""

import glob

import pytest

from sightline.llm import simhash
from sightline.llm.common import shared_dir


def test_components_without_a_fixed_point_are_an_error(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long")
    with pytest.raises(RuntimeError, match="after 2 rounds"):
        simhash.components(chain, rounds=2)


def test_rounds_are_deleted_once_read(spark):
    folder = shared_dir(spark).removeprefix("file://")
    before = len(glob.glob(f"{folder}/edges-*"))
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    got = simhash.components(chain)
    assert len(glob.glob(f"{folder}/edges-*")) == before + 1
    assert {r.root for r in got.collect()} == {0} and got.count() == 40
