"""Greedy choices without one group each: rounds that take, all at once, whatever nothing earlier stands against.

A greedy pass goes through candidates in order and takes each that no candidate taken before excludes. One whose earlier
neighbours are all decided can be decided too, whatever else is open, so each round takes every candidate that has no
open earlier neighbour, and drops those it excludes. The result is that of the pass; the number of rounds is the longest
chain of decisions that wait for each other, not the number of candidates. Rounds are written to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.sources.shared import forget, kept

#: Candidates of a group that are gone through in one task; larger groups are decided in rounds.
MOST = 2_000


def split_by_size(df: DataFrame, by: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups of at most ``most`` rows, and those of larger ones (None if there are none)."""
    large, path = kept(df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*by), "large")
    if not large.limit(1).count():
        forget(df.sparkSession, path)
        return df, None
    key = [df[c].eqNullSafe(large[c]) for c in by]
    return df.join(large, reduce(Column.__and__, key), "left_anti"), df.join(large, reduce(Column.__and__, key), "left_semi")


def taken(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node``s that a greedy pass takes. ``edges`` (early, late): of the two, which differ, only one may be taken, and
    ``early`` comes first. Node ids are unique."""
    spark = nodes.sparkSession
    (left, left_path), (open_, open_path) = kept(nodes.select("node"), "open"), kept(edges.select("early", "late").distinct(), "conflicts")
    found = []
    while True:
        now, _ = kept(left.join(open_.select(F.col("late").alias("node")).distinct(), "node", "left_anti"), "taken")
        found.append(now)
        gone = open_.join(now.select(F.col("node").alias("early")), "early", "left_semi").select(F.col("late").alias("node")).distinct()
        decided, decided_path = kept(now.unionByName(gone), "decided")
        old = left_path, open_path, decided_path
        left, left_path = kept(left.join(decided, "node", "left_anti"), "open")
        for end in ("early", "late"):
            open_ = open_.join(decided.select(F.col("node").alias(end)), end, "left_anti")
        open_, open_path = kept(open_.select("early", "late"), "conflicts")
        for path in old:
            forget(spark, path)
        if not left.limit(1).count():
            for path in (left_path, open_path):
                forget(spark, path)
            return reduce(DataFrame.unionByName, found)


def matched(pairs: DataFrame, a: list[str], b: list[str], order: list[str]) -> DataFrame:
    """Rows of ``pairs`` that a greedy one-to-one matching in ``order`` takes: in each round those that are first both of
    their ``a`` and of their ``b``; all others of either go. ``order`` tells pairs apart."""
    spark = pairs.sparkSession
    left, path = kept(pairs, "pairs")
    first, found = F.struct(*order), []
    while left.limit(1).count():
        j = left
        for name, key in (("_a", a), ("_b", b)):
            j = j.join(left.groupBy(*key).agg(F.min(first).alias(name)), key)
        now, _ = kept(j.where((first == F.col("_a")) & (first == F.col("_b"))).select(*pairs.columns), "matched")
        found.append(now)
        old = path
        for key in (a, b):
            left = left.join(now.select(*key).distinct(), key, "left_anti")
        left, path = kept(left.select(*pairs.columns), "pairs")
        forget(spark, old)
    forget(spark, path)
    return reduce(DataFrame.unionByName, found) if found else pairs
