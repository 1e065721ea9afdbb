"""The test tables in the roles of detections, devices, log entries, points and boxes, for Spark and for SQL.

Both forms derive the same columns by arithmetic on the tables' own columns; all rows take part. Scans, views, sites and
rooms are blocks of neighbouring keys, so that their number, not their size, grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators.triage import status_of
from sightline.plans.base import table

TODAY = "1998-01-01"


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    d = e.select(F.col("event_id").alias("id"), F.col("event_id").alias("ord"), F.when(F.col("user_id") % 10 != 0, F.col("user_id") - F.col("user_id") % 3).alias("scan"),
                 (F.col("value") / (F.col("value") + 10)).alias("confidence"), (((F.col("event_id") * 37) % 3600).cast("double") / 10 - 180).alias("yaw"),
                 (F.col("event_id") % 60 - 30).cast("double").alias("pitch"), F.col("event_type").alias("type"), F.col("user_id").alias("device"), "value")
    given = F.when(F.col("id") % 11 == 0, "rejected").when(F.col("id") % 13 == 0, "confirmed")
    return d.withColumn("status", status_of(F.col("confidence"), given))


DET = """det AS (SELECT event_id AS id, event_id AS ord, CASE WHEN user_id % 10 <> 0 THEN user_id - user_id % 3 END AS scan, value / (value + 10) AS confidence,
 CAST((event_id * 37) % 3600 AS DOUBLE) / 10 - 180 AS yaw, CAST(event_id % 60 - 30 AS DOUBLE) AS pitch, event_type AS type, user_id AS device, value,
 CASE WHEN event_id % 11 = 0 THEN 'rejected' WHEN event_id % 13 = 0 THEN 'confirmed' WHEN value / (value + 10) >= 0.75 THEN 'auto'
 ELSE 'review' END AS status FROM events)"""


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan positions, one for each supplier, two dozen to a site."""
    k = F.col("s_suppkey").cast("long")
    return table(spark, sf_dir, "supplier").select(k.alias("scan"), F.floor(k / 24).alias("site"), (k % 5).cast("double").alias("sx"), (k % 7).cast("double").alias("sy"), F.lit(1.5).alias("sz"))


SCANS = """scans AS (SELECT CAST(s_suppkey AS BIGINT) AS scan, CAST(s_suppkey // 24 AS BIGINT) AS site, CAST(s_suppkey % 5 AS DOUBLE) AS sx,
 CAST(s_suppkey % 7 AS DOUBLE) AS sy, CAST(1.5 AS DOUBLE) AS sz FROM supplier)"""


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), F.date_add(F.lit("1996-01-31").cast("date"), (k % 900).cast("int")).alias("commissionedAt"),
        F.when(k % 4 != 0, (k % 4 * 6).cast("int")).alias("maintenanceIntervalMonths"), F.when(k % 3 != 0, F.col("c_mktsegment")).alias("location"))


DEV = """dev AS (SELECT c_custkey AS id, CAST(DATE '1996-01-31' + CAST(c_custkey % 900 AS INTEGER) AS DATE) AS commissionedAt,
 CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 4 * 6 AS INTEGER) END AS maintenanceIntervalMonths, CASE
 WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS location FROM customer)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    at = F.to_date("o_orderdate")
    due = F.when(F.col("o_orderpriority").substr(1, 1).isin("1", "2"), F.add_months(at, 12))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("instanceId"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"),
                    F.when(F.col("o_orderkey") % 5 != 0, at).alias("performedAt"), at.cast("timestamp_ntz").alias("createdAt"), due.alias("nextDueAt"), F.col("o_orderkey").alias("ord"))


ENT = """ent AS (SELECT o_orderkey AS id, o_custkey AS instanceId, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS status,
 CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS performedAt, CAST(o_orderdate AS DATE) AS createdAt,
 CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN CAST(CAST(o_orderdate AS DATE) + INTERVAL 12 MONTH AS DATE) END AS nextDueAt,
 o_orderkey AS ord FROM orders)"""

#: Status of each device by SQL; needs DEV and ENT before it.
STATUS = f"""per AS (SELECT instanceId, arg_max(nextDueAt, (coalesce(performedAt, createdAt), createdAt, -ord)) FILTER (status = 'done' AND nextDueAt IS NOT NULL) AS logged,
 arg_max(CAST(coalesce(performedAt, DATE '0001-01-01') AS DATE), (coalesce(performedAt, createdAt), createdAt, -ord)) FILTER (status = 'done') AS l0,
 count(*) FILTER (status = 'done') AS n_done, count(*) FILTER (status <> 'done') AS n_open FROM ent GROUP BY 1),
st AS (SELECT id, coalesce(logged, CASE WHEN coalesce(n_done, 0) = 0 THEN CAST(commissionedAt + to_months(maintenanceIntervalMonths) AS DATE) END) AS nextDueAt,
 coalesce(n_open, 0) AS openCount, nullif(l0, DATE '0001-01-01') AS lastDoneAt, location FROM dev LEFT JOIN per ON id = instanceId),
status AS (SELECT id, nextDueAt, coalesce(nextDueAt < DATE '{TODAY}', false) AS overdue, openCount, lastDoneAt FROM st)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by return flag; ``ord`` is unique as it holds all of a line's columns that tell lines apart."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("room"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ord"),
                     (F.col("l_quantity") / 4).alias("x"), (F.col("l_extendedprice") / 5000).alias("y"), (F.col("l_discount") / 0.02).alias("z"),
                     F.col("l_partkey").alias("pid"), (F.col("l_suppkey") % 256).alias("r"),
                     (F.col("l_partkey") % 256).alias("g"), (F.col("l_linenumber") * 40 % 256).alias("b"))


PTS = """pts AS (SELECT l_returnflag AS room, l_orderkey, l_linenumber, l_partkey AS pid, l_suppkey, l_extendedprice, l_quantity / 4 AS x, l_extendedprice / 5000 AS y,
 l_discount / 0.02 AS z, l_suppkey % 256 AS r, l_partkey % 256 AS g, l_linenumber * 40 % 256 AS b FROM lineitem)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate boxes in views of 640 x 640."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    x, y = (i * 53 % 600).cast("double"), (i * 31 % 580).cast("double")
    w, h = (20 + i * 7 % 90).cast("double"), (20 + i * 11 % 60).cast("double")
    return e.select(i.alias("ord"), F.floor(i / 40).alias("view"), F.floor(i / 400).alias("scan"), x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"),
                    (F.col("value") / (F.col("value") + 10)).alias("conf"), ((i * 37 % 3600).cast("double") / 10 - 180).alias("yaw"), (i * 7 % 120 - 60).cast("double").alias("pitch"),
                    (F.lit(2.0) + i % 9).alias("size"), (F.lit(0.7) + (i % 31).cast("double") / 100).alias("similarity"), (i * 17 % 101).cast("double").alias("ocr"))


BOX = """box AS (SELECT event_id AS ord, event_id // 40 AS view, event_id // 400 AS scan, CAST(event_id * 53 % 600 AS DOUBLE) AS x1, CAST(event_id * 31 % 580 AS DOUBLE) AS y1,
 CAST(event_id * 53 % 600 AS DOUBLE) + CAST(20 + event_id * 7 % 90 AS DOUBLE) AS x2, CAST(event_id * 31 % 580 AS DOUBLE) + CAST(20 + event_id * 11 % 60 AS DOUBLE) AS y2,
 value / (value + 10) AS conf, CAST(event_id * 37 % 3600 AS DOUBLE) / 10 - 180 AS yaw, CAST(event_id * 7 % 120 - 60 AS DOUBLE) AS pitch,
 CAST(2.0 AS DOUBLE) + event_id % 9 AS size,
 CAST(0.7 AS DOUBLE) + CAST(event_id % 31 AS DOUBLE) / 100 AS similarity, CAST(event_id * 17 % 101 AS DOUBLE) AS ocr FROM events)"""
