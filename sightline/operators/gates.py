"""Publication gates: one row each (gate, passed, value), put together, and passed as a whole if all are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least share of automatic detections that hit, largest median distance in metres, largest share of blocked
#: scan points, most bytes of the picture and of the layout text.
HIT_RATE, MEDIAN, BLOCKED, PICTURE, TEXT = 0.8, 0.10, 0.05, 1_000_000, 100_000


def gate(df: DataFrame, name: str, passed: Column, value: Column) -> DataFrame:
    return df.agg(F.lit(name).alias("gate"), F.coalesce(passed, F.lit(False)).alias("passed"), value.cast("double").alias("value"))


def paired(sites: DataFrame) -> DataFrame:
    """A0: every site's headers are paired one to one (``passed``, ``worst``)."""
    return gate(sites, "A0", F.bool_and("passed"), F.max("worst"))


def reprojected(checks: DataFrame) -> DataFrame:
    """A3: all checked scans line up (``ok``)."""
    return gate(checks, "A3", F.bool_and("ok"), F.avg(F.col("ok").cast("double")))


def located(cross: DataFrame) -> DataFrame:
    """A5: enough automatic detections hit, and hits lie near triangulated points (``auto``, ``method``, ``dist``)."""
    rate = F.avg(F.when(F.col("auto"), (F.col("method") == "ray").cast("double")))
    return gate(cross, "A5", (F.coalesce(rate, F.lit(0.0)) >= HIT_RATE) & (F.percentile("dist", 0.5) < MEDIAN), F.percentile("dist", 0.5))


def one_to_one(agreement: DataFrame) -> DataFrame:
    """A6: each cluster has its own device (a row of ``agreement_gate``)."""
    return gate(agreement, "A6", F.bool_and("passed"), F.max("devices"))


def walkway(discs: DataFrame) -> DataFrame:
    """Few scan points stand on obstacles (``blocked``)."""
    share = F.avg(F.col("blocked").cast("double"))
    return gate(discs, "walkway", share < BLOCKED, share)


def sizes(outputs: DataFrame) -> DataFrame:
    """Outputs are small enough (``picture_bytes``, ``text_bytes``)."""
    return gate(outputs, "sizes", F.bool_and((F.col("picture_bytes") < PICTURE) & (F.col("text_bytes") < TEXT)), F.max("text_bytes"))


def together(*gates: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, gates)


def in_one_row(gates: DataFrame) -> DataFrame:
    """A column for each gate, as ``sinks.publish`` takes them."""
    return gates.groupBy().pivot("gate").agg(F.bool_and("passed"))
