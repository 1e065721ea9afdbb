"""Queries of devices: maintenance, live state, linking, triangulation, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline import schema as S
from sightline.functions.expressions import direction
from sightline.operators import cluster as C
from sightline.operators import gates
from sightline.operators import link as L
from sightline.operators import live as V
from sightline.operators import maintenance as M
from sightline.operators import triangulate as G
from sightline.plans import adapters as A
from sightline.plans.base import query, table

T0 = A.TODAY


def status_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.device_status(A.devices(spark, sf_dir), A.entries(spark, sf_dir), T0)


@query(f"""WITH {A.DEV}, {A.ENT}, {A.STATUS} SELECT id, CAST(nextDueAt AS VARCHAR) AS "nextDueAt", overdue, openCount AS "openCount",
 CAST(lastDoneAt AS VARCHAR) AS "lastDoneAt" FROM status""")
def device_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = status_rows(spark, sf_dir)
    return s.select("id", F.col("nextDueAt").cast("string").alias("nextDueAt"), "overdue", "openCount", F.col("lastDoneAt").cast("string").alias("lastDoneAt"))


@query(f"WITH {A.DEV}, {A.ENT}, {A.STATUS} SELECT id, overdue, openCount FROM status WHERE overdue OR openCount > 0")
def due_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.due_list(status_rows(spark, sf_dir)).select("id", "overdue", "openCount")


@query(f"WITH {A.DEV}, {A.ENT}, {A.STATUS} SELECT count(*) FILTER (overdue) AS overdue, CAST(sum(openCount) AS BIGINT) AS open FROM status")
def maintenance_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.totals(status_rows(spark, sf_dir))


@query(f"""WITH {A.ENT} SELECT id, CAST(row_number() OVER (PARTITION BY instanceId ORDER BY coalesce(performedAt, createdAt) DESC, createdAt DESC,
 ord) AS INTEGER) AS place FROM ent""")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.newest_first(A.entries(spark, sf_dir)).select("id", "place")


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries as they are typed in, with faults by their key."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    kinds = F.array(*(F.lit(x) for x in (*S.KINDS, "party")))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(k.alias("id"), F.col("o_custkey").alias("instanceId"), F.get(kinds, (k % 9).cast("int")).alias("kind"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"),
                    F.when(k % 17 != 0, F.col("o_orderpriority")).alias("title"), F.when(k % 13 == 0, F.lit("2026-13-40")).when(k % 7 != 0, day).alias("performedAt"),
                    F.when(k % 5 != 0, F.get(F.array(*(F.lit(x) for x in (*S.RESULTS, "meh"))), (k % 4).cast("int"))).alias("result"),
                    F.when(k % 3 == 0, F.date_format(F.date_add(F.to_date("o_orderdate"), (k % 41 - 20).cast("int")), "yyyy-MM-dd")).alias("nextDueAt"),
                    F.when(k % 19 == 0, F.repeat(F.lit("x"), 200)).otherwise("Ann").alias("performedBy"), F.lit(None).cast("string").alias("company"), F.lit("").alias("findings"),
                    F.lit("").alias("actions"), F.lit(None).cast("string").alias("workPermitRef"), F.when(k % 23 == 0, "email").otherwise("field-app").alias("source"))


DRAFT = """dr AS (SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 8 THEN 'party' ELSE 'ok' END AS kind, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS status,
 CASE WHEN o_orderkey % 17 <> 0 THEN o_orderpriority END AS title, CASE WHEN o_orderkey % 13 = 0 THEN '2026-13-40'
 WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS performedAt,
 CASE WHEN o_orderkey % 5 <> 0 THEN CASE o_orderkey % 4 WHEN 3 THEN 'meh' ELSE 'ok' END END AS result,
 CASE WHEN o_orderkey % 3 = 0 THEN strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 41 - 20 AS INTEGER), '%Y-%m-%d') END AS nextDueAt,
 CASE WHEN o_orderkey % 19 = 0 THEN 200 ELSE 3 END AS by_len, CASE WHEN o_orderkey % 23 = 0 THEN 'email' ELSE 'field-app' END AS source FROM orders)"""


@query(f"""WITH {DRAFT}, n AS (SELECT id, (kind = 'party')::INT + (source = 'email')::INT + coalesce(result = 'meh', false)::INT + (title IS NULL)::INT + (by_len > 120)::INT
 + coalesce(performedAt = '2026-13-40', false)::INT + (status = 'done' AND performedAt IS NULL)::INT + (status = 'done'
 AND result IS NULL)::INT + coalesce(performedAt > '1998-01-01', false)::INT
 + coalesce(nextDueAt <= performedAt, false)::INT AS issues FROM dr) SELECT id, CAST(issues AS INTEGER) AS issues, issues = 0 AS valid FROM n""")
def validate_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.validate(drafts(spark, sf_dir), T0).select("id", F.size("issues").alias("issues"), "valid")


@query(f"""WITH {DRAFT}, n AS (SELECT dr.*, CASE WHEN kind = 'party' THEN 'kind' WHEN source = 'email' THEN 'source' WHEN coalesce(result = 'meh',
 false) THEN 'result' WHEN title IS NULL THEN 'title'
 WHEN by_len > 120 THEN 'performedBy' WHEN performedAt = '2026-13-40' THEN 'performedAt' WHEN status = 'done'
 AND performedAt IS NULL THEN 'performedAt' WHEN status = 'done' AND result IS NULL THEN 'result'
 WHEN performedAt > '1998-01-01' THEN 'performedAt' WHEN nextDueAt <= performedAt THEN 'nextDueAt' END AS field FROM dr) SELECT field, count(*) AS n
 FROM n GROUP BY field""")
def first_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = M.validate(drafts(spark, sf_dir), T0)
    return v.groupBy(F.get("issues", F.lit(0)).getField("field").alias("field")).agg(F.count("*").alias("n"))


@query(f"""WITH {A.DEV}, e AS (SELECT o_orderkey AS id, o_custkey AS instanceId, CAST(o_orderdate AS DATE) AS d, o_orderkey % 3 = 0 AS periodic,
 o_orderstatus = 'F' AS done FROM orders)
SELECT e.id, CASE WHEN periodic AND done THEN CAST(CAST(d + to_months(maintenanceIntervalMonths) AS DATE) AS VARCHAR) END AS "nextDueAt", 1 AS version
 FROM e JOIN dev ON dev.id = e.instanceId""")
def create_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    e = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("instanceId"), F.to_date("o_orderdate").alias("performedAt"), F.lit(None).cast("date").alias("nextDueAt"),
                 F.when(F.col("o_orderkey") % 3 == 0, "inspection").otherwise("repair").alias("kind"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"))
    return M.create(e, A.devices(spark, sf_dir), f"{T0} 00:00:00").select("id", F.col("nextDueAt").cast("string").alias("nextDueAt"), "version")


#: Stored entries, and patches that set a status, a result, a date, or clear the due date; with the interval of the device.
#: A fourth of the entries have a patch (some of an id that doesn't exist), an eighth a second one on the version that
#: the first makes, a twelfth a third one on the base of the first, which stands only if that one failed.
STORE = """e0 AS (SELECT o_orderkey AS id, o_custkey AS instanceId, CASE WHEN o_orderkey % 3 = 0 THEN 'inspection' ELSE 'repair' END AS kind, CASE
 WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS status,
 CAST(o_orderdate AS DATE) AS performedAt, CASE WHEN o_orderstatus = 'F' THEN 'ok' END AS result, CASE
 WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_orderdate AS DATE) + INTERVAL 400 DAY AS DATE) END AS nextDueAt,
 CAST(1 + o_orderkey % 3 AS INTEGER) AS version, false AS touched FROM orders),
d AS (SELECT c_custkey AS instanceId, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 4 * 6 AS INTEGER) END AS months FROM customer),
p AS (SELECT o_orderkey + CASE WHEN o_orderkey % 40 = 0 THEN 100000000 ELSE 0 END AS id, 1 AS ord, CAST(1 + o_orderkey % 2 AS INTEGER) AS base,
 'done' AS status, CASE WHEN o_orderkey % 16 <> 0 THEN 'remarks' END AS result,
 CASE WHEN o_orderkey % 24 = 0 THEN DATE '2030-01-01' END AS performedAt, o_orderkey % 8 = 0 AS clears FROM orders WHERE o_orderkey % 4 = 0
 UNION ALL SELECT o_orderkey, 2, CAST(2 + o_orderkey % 2 AS INTEGER), NULL, 'fault', DATE '1999-05-05', false FROM orders WHERE o_orderkey % 8 = 0
 UNION ALL SELECT o_orderkey, 3, CAST(1 + o_orderkey % 2 AS INTEGER), 'open', NULL, NULL, true FROM orders WHERE o_orderkey % 12 = 0)"""
for _n in (1, 2, 3):
    STORE += f""",
n{_n} AS (SELECT e.*, p.base, p.id IS NOT NULL AS asked, d.instanceId IS NOT NULL AS known, coalesce(p.status, e.status) AS new_status, coalesce(p.result, e.result) AS new_result,
 coalesce(p.performedAt, e.performedAt) AS new_performed, CASE WHEN p.clears THEN NULL ELSE e.nextDueAt END AS due, months
 FROM e{_n - 1} e LEFT JOIN (SELECT * FROM p WHERE ord = {_n}) p ON p.id = e.id LEFT JOIN d ON d.instanceId = e.instanceId),
q{_n} AS (SELECT *, coalesce(due, CASE WHEN kind = 'inspection' AND new_status = 'done' THEN CAST(new_performed + to_months(months) AS DATE) END) AS new_due FROM n{_n}),
w{_n} AS (SELECT *, CASE WHEN NOT asked THEN 'kept' WHEN base <> version THEN 'conflict' WHEN NOT known THEN 'unknown_device'
 WHEN (new_status = 'done' AND (new_result IS NULL OR new_performed IS NULL)) OR new_performed > DATE '2026-10-03' OR new_due <= new_performed THEN 'invalid'
 ELSE 'applied' END AS outcome FROM q{_n}),
e{_n} AS (SELECT id, instanceId, kind, CASE WHEN outcome = 'applied' THEN new_status ELSE status END AS status, CASE WHEN outcome = 'applied' THEN new_performed ELSE performedAt END AS performedAt,
 CASE WHEN outcome = 'applied' THEN new_result ELSE result END AS result, CASE WHEN outcome = 'applied' THEN new_due ELSE nextDueAt END AS nextDueAt,
 CAST(version + (outcome = 'applied')::INT AS INTEGER) AS version, touched OR outcome = 'applied' AS touched FROM w{_n})"""
STORE += """,
answers AS (SELECT id, 1 AS ord, base, outcome, CASE WHEN outcome = 'applied' THEN version + 1 END AS version FROM w1 WHERE asked
 UNION ALL SELECT id, 2, base, outcome, CASE WHEN outcome = 'applied' THEN version + 1 END FROM w2 WHERE asked
 UNION ALL SELECT id, 3, base, outcome, CASE WHEN outcome = 'applied' THEN version + 1 END FROM w3 WHERE asked
 UNION ALL SELECT id, ord, base, 'not_found', NULL FROM p WHERE id NOT IN (SELECT id FROM e0))"""


def store_and_patches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    at, f = F.to_date("o_orderdate"), F.col("o_orderstatus") == "F"
    text = F.lit("as found")
    s = o.select(k.alias("id"), F.col("o_custkey").alias("instanceId"), F.when(k % 3 == 0, "inspection").otherwise("repair").alias("kind"), F.when(f, "done").otherwise("open").alias("status"), F.lit("Work").alias("title"),
                 at.alias("performedAt"), F.lit("Ann").alias("performedBy"), text.alias("findings"), F.when(f, "ok").alias("result"), F.when(k % 2 == 0, F.date_add(at, 400)).alias("nextDueAt"), F.lit("field-app").alias("source"),
                 (1 + k % 3).cast("int").alias("version"), at.cast("timestamp").alias("createdAt"), at.cast("timestamp").alias("updatedAt"))

    def patch(every: int, shift: Column, number: int, base: Column, status: Column, result: Column, day: Column, clears: Column) -> DataFrame:
        return o.where(k % every == 0).select((k + shift).alias("id"), F.lit(number).alias("ord"), base.cast("int").alias("base"), status.cast("string").alias("status"), result.cast("string").alias("result"),
                                              day.cast("date").alias("performedAt"), F.when(clears, F.array(F.lit("nextDueAt"))).alias("clear"))

    none = F.lit(None)
    p = patch(4, F.when(k % 40 == 0, 100000000).otherwise(0), 1, 1 + k % 2, F.lit("done"), F.when(k % 16 != 0, "remarks"), F.when(k % 24 == 0, F.lit("2030-01-01")), k % 8 == 0)
    p = p.unionByName(patch(8, F.lit(0), 2, 2 + k % 2, none, F.lit("fault"), F.lit("1999-05-05"), F.lit(False)))
    return s, p.unionByName(patch(12, F.lit(0), 3, 1 + k % 2, F.lit("open"), none, none, F.lit(True)))


def updated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s, p = store_and_patches(spark, sf_dir)
    return *M.apply_patches(s, p, A.devices(spark, sf_dir), "2026-10-03 10:00:00", "2026-10-03"), p


@query(f"""WITH {STORE} SELECT id, instanceId AS "instanceId", status, result, CAST(performedAt AS VARCHAR) AS "performedAt", CAST(nextDueAt AS VARCHAR) AS "nextDueAt", version, touched FROM e3""")
def versioned_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, _, _ = updated(spark, sf_dir)
    return log.select("id", "instanceId", "status", "result", F.col("performedAt").cast("string").alias("performedAt"), F.col("nextDueAt").cast("string").alias("nextDueAt"), "version",
                      (F.col("updatedAt") > F.col("createdAt")).alias("touched"))


@query(f"""WITH {STORE} SELECT id, CAST(ord AS BIGINT) AS ord, base, outcome, CAST(version AS INTEGER) AS version FROM answers""")
def patch_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each patch, in the order of an entry's patches."""
    return updated(spark, sf_dir)[1]


@query(f"""WITH {STORE}, x AS (SELECT a.id, a.ord, e3.status AS old, e3.version, p.status AS mine FROM answers a JOIN e3 USING (id) JOIN p ON p.id = a.id AND p.ord = a.ord WHERE outcome = 'conflict')
 SELECT id, CAST(ord AS BIGINT) AS ord, 'stored' AS keep, old AS status, version AS base FROM x UNION ALL SELECT id, ord, 'mine', mine, version FROM x""")
def version_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draft of each conflict under both policies."""
    c = M.conflicts(*updated(spark, sf_dir))
    mine = M.resolved(c, "mine").select("id", F.col("ord").cast("long").alias("ord"), F.lit("mine").alias("keep"), "status", "base")
    return M.resolved(c, "stored").select("id", F.col("ord").cast("long").alias("ord"), F.lit("stored").alias("keep"), "status", F.col("version").alias("base")).unionByName(mine)


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey AS instanceId, CASE WHEN o_orderkey % 3 = 0 THEN 'seed' ELSE 'field-app' END AS source,
 CAST(1 + o_orderkey % 2 AS INTEGER) AS version FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0),
d AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 10 <> 0), k AS (SELECT * FROM o
 WHERE (source <> 'seed' OR version > 1) AND instanceId IN (SELECT id FROM d)),
n AS (SELECT o_orderkey AS id, o_custkey AS instanceId, 'seed' AS source, CAST(1 AS INTEGER) AS version FROM orders WHERE o_orderkey % 3 = 0)
SELECT * FROM k UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM k)""")
def seed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    base = o.select(k.alias("id"), F.col("o_custkey").alias("instanceId"))
    own = base.where("id % 2 = 0 or id % 3 = 0").withColumn("source", F.when(F.col("id") % 3 == 0, "seed").otherwise("field-app")).withColumn("version", (1 + F.col("id") % 2).cast("int"))
    seed = base.where("id % 3 = 0").withColumn("source", F.lit("seed")).withColumn("version", F.lit(1))
    return M.refresh_seed(own, seed, A.devices(spark, sf_dir).where("id % 10 <> 0"))


@query("""SELECT o_orderkey AS id, o_custkey AS "instanceId" FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)""")
def unknown_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.entries(spark, sf_dir).select("id", "instanceId")
    return M.unknown_devices(e, A.devices(spark, sf_dir).where("id % 3 = 0"))


@query("""WITH t AS (SELECT * FROM (VALUES ('overdue', 1, 'inspection', 'done', 'ok', '2025-06-10', '2025-06-10', '2026-06-10'), ('overdue', 2,
 'secondary_injection_test', 'done', 'ok', '2024-05-22', '2024-05-22', NULL),
 ('open-fault', 1, 'inspection', 'done', 'ok', '2026-03-02', '2026-03-02', '2027-03-02'), ('open-fault', 2, 'fault', 'open', NULL, NULL, '2026-09-28',
 NULL), ('ok', 1, 'inspection', 'done', 'ok', '2026-06-12', '2026-06-12', '2027-06-12'),
 ('ok', 2, 'trip_test', 'done', 'ok', '2025-11-03', '2025-11-03', NULL), ('ok-firmware', 1, 'firmware_update', 'done', 'ok', '2026-04-09',
 '2026-04-09', '2027-04-09')) v(profile, no, kind, status, result, performedAt, created, nextDueAt)),
d AS (SELECT c_custkey AS dev, CASE c_custkey % 5 WHEN 0 THEN 'overdue' WHEN 1 THEN 'open-fault' WHEN 2 THEN 'ok' WHEN 3 THEN 'ok-firmware'
 ELSE 'empty' END AS profile FROM customer)
SELECT 'seed-' || dev || '-' || no AS id, dev AS "instanceId", kind, status, result, performedAt AS "performedAt", nextDueAt AS "nextDueAt",
 created || ' 08:00:00' AS "createdAt" FROM d JOIN t USING (profile)""")
def seed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    prof = F.when(k == 0, "overdue").when(k == 1, "open-fault").when(k == 2, "ok").when(k == 3, "ok-firmware").otherwise("empty")
    h = M.seed_history(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), prof.alias("profile")))
    return h.select("id", "instanceId", "kind", "status", "result", *(F.col(c).cast("string").alias(c) for c in ("performedAt", "nextDueAt", "createdAt")))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "P", "confirmed").when(k % 4 == 0, "auto").when(k % 4 == 1, "review").otherwise("rejected")
    return o.select(F.col("o_custkey").alias("device"), k.alias("member"), k.alias("ord"), state.alias("status"), (F.col("o_totalprice") / 1e6).alias("confidence"), (k % 18).alias("scan"))


MEM = """mem AS (SELECT o_custkey AS device, o_orderkey AS member, o_orderkey AS ord, CASE WHEN o_orderstatus = 'P' THEN 'confirmed'
 WHEN o_orderkey % 4 = 0 THEN 'auto' WHEN o_orderkey % 4 = 1 THEN 'review' ELSE 'rejected' END AS status,
 o_totalprice / 1e6 AS confidence, o_orderkey % 18 AS scan FROM orders)"""
LIVE = """m AS (SELECT device, count(*) AS n, count(*) FILTER (status <> 'rejected') AS active, bool_or(status = 'confirmed') AS c,
 bool_or(status = 'auto') AS a FROM mem GROUP BY device),
live AS (SELECT c_custkey AS device, CASE WHEN n IS NULL THEN 'auto' WHEN c THEN 'confirmed' WHEN a THEN 'auto' ELSE 'review' END AS status,
 coalesce(active, 0) AS members
 FROM customer LEFT JOIN m ON c_custkey = device WHERE n IS NULL OR active > 0)"""


def live_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("device"), F.lit("auto").alias("built"))
    return V.live_status(d, members(spark, sf_dir).select("device", "status"))


@query(f"WITH {MEM}, {LIVE} SELECT * FROM live")
def live_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_rows(spark, sf_dir)


@query(f"""WITH {MEM}, {LIVE}, {A.DEV}, {A.ENT}, {A.STATUS} SELECT count(*) AS relays, count(*) FILTER (l.status = 'auto') AS auto,
 count(*) FILTER (l.status = 'review') AS review, count(*) FILTER (l.status = 'confirmed') AS confirmed,
 count(*) FILTER (overdue) AS overdue, CAST(sum(members) AS BIGINT) AS members FROM live l JOIN status s ON l.device = s.id""")
def floor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = status_rows(spark, sf_dir).select(F.col("id").alias("device"), "overdue")
    return V.summary(live_rows(spark, sf_dir).join(s, "device"))


@query("""WITH c AS (SELECT user_id AS device, event_type AS type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)
 SELECT device, arg_max(type, (n, -f)) AS type, max(n) AS votes FROM c GROUP BY device""")
def majority_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("device"), F.col("event_type").alias("type"), "event_id")
    return V.majority(e, "device", "type", "event_id")


@query("""WITH c AS (SELECT c_custkey AS device, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS instance, CASE
 WHEN c_custkey % 2 = 0 THEN abs(c_acctbal) END AS dist, c_custkey % 7 AS members FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY dist ASC NULLS LAST, members DESC, device) AS rn FROM c)
 SELECT device, CASE WHEN rn = 1 AND instance IS NOT NULL THEN instance END AS instance FROM r""")
def exclusive_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("device"), F.when(k % 5 != 0, F.col("c_nationkey")).alias("instance"), F.when(k % 2 == 0, F.abs("c_acctbal")).alias("dist"), (k % 7).alias("members"), k.alias("ord"))
    return V.exclusive(c)


@query(f"""WITH {MEM}, {LIVE} SELECT l.device, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 3 <> 0 THEN 0
 WHEN l.status <> 'review' THEN 1 ELSE 2 END,
 CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END NULLS LAST, l.device) AS INTEGER) AS number FROM live l JOIN customer ON c_custkey = device""")
def floor_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("device"), "c_nationkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("location"))
    return V.numbering(live_rows(spark, sf_dir).join(c, "device"), "c_nationkey").select("device", "number")


@query(f"""WITH {MEM}, r AS (SELECT device, member, row_number() OVER (PARTITION BY device ORDER BY CASE WHEN scan = 3 THEN 0 ELSE 1 END, confidence DESC,
 ord) AS rn FROM mem WHERE status <> 'rejected') SELECT device, member FROM r WHERE rn = 1""")
def preferred_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member to open for each device: one in the preferred scan, else the strongest."""
    return V.preferred_member(members(spark, sf_dir), F.col("scan") == 3)


@query(f"""WITH {MEM}, {LIVE}, {A.DEV}, {A.ENT}, {A.STATUS} SELECT device, CASE WHEN device % 3 = 0 THEN 'Unregistered relay · 615 series'
 ELSE c_mktsegment || ' · ' || CASE WHEN device % 2 = 0 THEN '615 series' ELSE 'REF615' END END AS name,
 concat_ws('|', CASE WHEN device % 3 = 0 THEN 'Unregistered relay · 615 series' ELSE c_mktsegment || ' · ' || CASE
 WHEN device % 2 = 0 THEN '615 series' ELSE 'REF615' END END,
  'Seen from ' || members || CASE WHEN members = 1 THEN ' scan point'
 ELSE ' scan points' END || ' · ' || CAST(floor((device % 100) / 100.0 * 100 + 0.5) AS BIGINT) || '%', CASE
 WHEN device % 4 = 1 THEN 'Position: triangulated' END,
  CASE WHEN overdue THEN 'Maintenance overdue' END, CASE WHEN openCount = 1 THEN '1 open notice'
 WHEN openCount > 1 THEN openCount || ' open notices' END) AS lines FROM live JOIN customer ON c_custkey = device JOIN status ON status.id = device""")
def device_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and marker lines of the live devices."""
    k = F.col("device")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("device"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("location"))
    s = status_rows(spark, sf_dir).select(F.col("id").alias("device"), "overdue", "openCount")
    d = live_rows(spark, sf_dir).join(c, "device").join(s, "device").withColumn("variant", F.when(k % 2 == 0, "unknown").otherwise("REF615")).withColumn("confidence", (k % 100) / 100)
    out = V.names(d.withColumnRenamed("members", "scans").withColumn("method", F.when(k % 4 == 1, "triangulation").otherwise("raycast")))
    return out.withColumn("lines", F.array_join("lines", "|"))


@query(f"""WITH {A.DET}, m AS (SELECT device, CASE WHEN max(confidence) >= 0.75 THEN 'auto' ELSE 'review' END AS status, count(*) AS n, arg_max(id,
 (confidence, -ord)) AS best FROM det GROUP BY device)
SELECT s_suppkey AS instance, status, n, best, s_acctbal / 1000 AS x FROM supplier JOIN m ON device = s_suppkey WHERE s_suppkey % 4 <> 0""")
def registered_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as register entries, three quarters with a place, with the detections linked to them."""
    k = F.col("s_suppkey")
    i = table(spark, sf_dir, "supplier").select(k.alias("instance"), F.lit("t").alias("type"), F.when(k % 4 != 0, F.col("s_acctbal") / 1000).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    d = A.detections(spark, sf_dir).select("id", F.col("device").alias("instance"), "scan", "confidence", "ord")
    return V.registered(i, d).select("instance", "status", F.size("ids").cast("long").alias("n"), "best", "x")


@query(f"""WITH {MEM}, {LIVE} SELECT device, status, members, coalesce(status = 'review', false) AS matches FROM live""")
def floor_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.matches(F.col("status") == "review", live_rows(spark, sf_dir))


@query(f"""WITH {A.DET} SELECT e.event_id AS id FROM events e LEFT JOIN (SELECT * FROM det WHERE id % 3 <> 0) d ON e.event_id = d.id
 WHERE e.event_id % 2 = 0 AND coalesce(d.status, '') <> 'rejected'""")
def unlocated_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").where("event_id % 2 = 0").select(F.col("event_id").alias("id"))
    return V.unlocated(u, A.detections(spark, sf_dir).where("id % 3 <> 0"))


@query("""WITH p AS (SELECT doc_id AS id FROM documents UNION ALL SELECT doc_id FROM documents WHERE doc_id % 9 = 0), n AS (SELECT id, count(*) AS times FROM p GROUP BY id),
k AS (SELECT doc_id AS id, true AS known FROM labels UNION SELECT doc_id, true FROM documents WHERE doc_id % 2 = 0)
SELECT id, coalesce(times, 0) AS times, coalesce(known, false) AS known FROM k FULL JOIN n USING (id) WHERE coalesce(times, 0) <> 1 OR known IS NULL""")
def integrity_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    dev = d.select(F.when(F.col("doc_id") % 9 == 0, F.array("doc_id", "doc_id")).otherwise(F.array("doc_id")).alias("ids"))
    known = lab.select(F.col("doc_id").alias("id")).union(d.where("doc_id % 2 = 0").select("doc_id")).distinct()
    none = d.select(F.col("doc_id").alias("id")).where("false")
    return V.misplaced(dev, none, known)


@query("""WITH a AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey % 5 <> 0)
SELECT id, 'left' AS side FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, 'right' FROM b WHERE id NOT IN (SELECT id FROM a)""")
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).where("id % 3 <> 0")
    return V.same_ids(a, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).where("id % 5 <> 0").distinct())


@query("""SELECT m.device, d.event_id AS id, CAST(m.i AS INTEGER) AS ord FROM (SELECT c_custkey AS device, unnest([c_custkey, c_custkey * 7,
 c_custkey * 1000003]) AS id, unnest([0, 1, 2]) AS i FROM customer) m JOIN events d ON d.event_id = m.id""")
def member_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    d = table(spark, sf_dir, "customer").select(k.alias("device"), F.array(k, k * 7, k * 1000003).alias("ids"))
    return V.member_rows(d, table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))).select("device", "id", "ord")


def linkable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as devices with an anchor and a place each."""
    k = F.col("s_suppkey")
    anchor = F.struct((k - k % 3).alias("scan"), ((k * 61 % 3600).cast("double") / 10 - 180).alias("yaw"), (k * 13 % 60 - 30).cast("double").alias("pitch"))
    return table(spark, sf_dir, "supplier").select(k.alias("device"), F.floor(k / 24).alias("site"), F.array(anchor).alias("anchors"), F.when(k % 2 == 0, (k % 11).cast("double") / 2).alias("x"),
                                                   (k % 13).cast("double").alias("y"), F.lit(2.0).alias("z"), (F.lit(2.0) + k % 3).alias("tol"))


def _ang(y1: str, p1: str, y2: str, p2: str) -> str:
    return (f"degrees(acos(least(greatest(sin(radians({p1})) * sin(radians({p2})) + cos(radians({p1})) * cos(radians({p2})) * cos(radians({y1} - {y2})), -1), 1)))")


#: Links of detections by SQL, as a table `links`.
LINKS = f"""{A.DET}, {A.SCANS}, s AS (SELECT s_suppkey AS device, s_suppkey // 24 AS site, s_suppkey - s_suppkey % 3 AS ascan,
 CAST(s_suppkey * 61 % 3600 AS DOUBLE) / 10 - 180 AS ayaw, CAST(s_suppkey * 13 % 60 - 30 AS DOUBLE) AS apitch,
 CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey % 11 AS DOUBLE) / 2 END AS x, CAST(s_suppkey % 13 AS DOUBLE) AS y, CAST(2.0 AS DOUBLE) AS z,
 CAST(2.0 AS DOUBLE) + s_suppkey % 3 AS tol FROM supplier),
p AS (SELECT device, tol, scan, x - sx AS dx, y - sy AS dy, z - sz AS dz, sqrt((x - sx) ** 2 + (y - sy) ** 2 + (z - sz) ** 2) AS r FROM s
 JOIN scans ON s.site = scans.site WHERE x IS NOT NULL),
v AS (SELECT device, tol, ascan AS scan, ayaw AS vyaw, apitch AS vpitch FROM s UNION ALL
 SELECT device, tol, scan, degrees(atan2(dx, dy)), degrees(asin(least(greatest(dz / r, -1), 1))) FROM p WHERE r <= 8),
q AS (SELECT d.id, v.device, {_ang('yaw', 'pitch', 'vyaw', 'vpitch')} AS dist, tol FROM det d JOIN v ON d.scan = v.scan),
 m AS (SELECT id, device, min(dist) AS dist FROM q WHERE dist <= tol GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER w AS rn, lead(dist) OVER w AS second FROM m WINDOW w AS (PARTITION BY id ORDER BY dist, device)),
links AS (SELECT det.id, CASE WHEN coalesce(second - dist < 1, false) THEN NULL ELSE b.device END AS device, round(dist, 5) AS dist,
 CASE WHEN b.device IS NULL THEN 'none' WHEN coalesce(second - dist < 1, false) THEN 'ambiguous' ELSE 'linked' END AS outcome FROM det LEFT
 JOIN b ON det.id = b.id AND rn = 1)"""


@query(f"WITH {LINKS} SELECT * FROM links")
def link_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.link(A.detections(spark, sf_dir), L.views_of(linkable(spark, sf_dir), A.scans(spark, sf_dir)))
    # of an ambiguous detection the device is null; `none` has no device in either form
    return out.withColumn("outcome", F.when(F.col("dist").isNull(), "none").when(F.col("device").isNull(), "ambiguous").otherwise("linked")).withColumn("dist", F.round("dist", 5))


PAIRING = """h AS (SELECT s_suppkey AS header, s_suppkey // 8 AS site, CAST(s_suppkey % 7 AS DOUBLE) AS hx, abs(s_acctbal) / 1000 AS hy FROM supplier),
c AS (SELECT c_custkey AS point, c_custkey // 120 AS site, CAST(c_custkey % 7 AS DOUBLE) AS x, abs(c_acctbal) / 1000 AS y FROM customer),
p AS (SELECT header, h.site, point, sqrt((hx - x) ** 2 + (hy - y) ** 2) AS dist FROM h JOIN c ON h.site = c.site),
r AS (SELECT *, row_number() OVER w AS rn, lead(dist) OVER w AS second FROM p WINDOW w AS (PARTITION BY header ORDER BY dist, point)),
 f AS (SELECT *, count(*) OVER (PARTITION BY site, point) AS used FROM r WHERE rn = 1)"""


def pairing_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    h = table(spark, sf_dir, "supplier").select(s.alias("header"), F.floor(s / 8).alias("site"), (s % 7).cast("double").alias("hx"), (F.abs("s_acctbal") / 1000).alias("hy"), F.lit(0.0).alias("hz"))
    return h, table(spark, sf_dir, "customer").select(c.alias("point"), F.floor(c / 120).alias("site"), (c % 7).cast("double").alias("x"), (F.abs("c_acctbal") / 1000).alias("y"), F.lit(0.0).alias("z"))


@query(f"WITH {PAIRING} SELECT header, point, round(dist, 6) AS dist, round(second, 6) AS second, used = 1 AND dist < 0.1 AS sure FROM f")
def header_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = L.nearest_pairing(*pairing_sides(spark, sf_dir))
    return p.select("header", "point", F.round("dist", 6).alias("dist"), F.round("second", 6).alias("second"), "sure")


@query(f"""WITH {PAIRING}, a AS (SELECT site, count(*) AS headers FROM h GROUP BY site), b AS (SELECT site, count(*) AS points FROM c GROUP BY site),
 g AS (SELECT site, count(*) AS paired, max(dist) AS worst, bool_and(used = 1 AND dist < 0.1) AS s FROM f GROUP BY site)
SELECT site, coalesce(paired, 0) AS paired, coalesce(headers, 0) AS headers, coalesce(points, 0) AS points, round(worst, 6) AS worst,
 coalesce(headers, 0) = coalesce(points, 0) AND coalesce(paired, 0) = coalesce(headers, 0) AND coalesce(s, false) AS passed
FROM a FULL JOIN b USING (site) LEFT JOIN g USING (site)""")
def pairing_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of each site: as many headers as points, and every pairing sure."""
    h, c = pairing_sides(spark, sf_dir)
    return L.pairing_gate(L.nearest_pairing(h, c), h, c).withColumn("worst", F.round("worst", 6))


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rays, 40 to a site, so that sites stay as small as rooms."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(
        F.floor(i / 40).alias("site"), i.alias("ord"), i.alias("id"), (i % 6).alias("scan"), (i % 6 * 0.8).cast("double").alias("ox"), (i % 5 * 0.5).cast("double").alias("oy"),
        F.lit(1.5).alias("oz"), (i * 37 % 60 - 30).cast("double").alias("yaw"), (i * 11 % 20 - 10).cast("double").alias("pitch"), (F.col("value") / (F.col("value") + 10)).alias("conf"))
    return e.select("*", *(c.alias(n) for n, c in zip(("dx", "dy", "dz"), direction("yaw", "pitch"), strict=True)))


RAY = """ray AS (SELECT event_id // 40 AS site, event_id AS ord, event_id % 6 AS scan, event_id % 6 * CAST(0.8 AS DOUBLE) AS ox,
 event_id % 5 * CAST(0.5 AS DOUBLE) AS oy, CAST(1.5 AS DOUBLE) AS oz,
 CAST(event_id * 37 % 60 - 30 AS DOUBLE) AS yaw, CAST(event_id * 11 % 20 - 10 AS DOUBLE) AS pitch, value / (value + 10) AS conf FROM events),
dir AS (SELECT *, sin(radians(yaw)) * cos(radians(pitch)) AS dx, cos(radians(yaw)) * cos(radians(pitch)) AS dy, sin(radians(pitch)) AS dz FROM ray),
pr AS (SELECT a.site, a.ord AS i, b.ord AS j, a.dx * b.dx + a.dy * b.dy + a.dz * b.dz AS c, a.dx * (a.ox - b.ox) + a.dy * (a.oy - b.oy) + a.dz * (a.oz - b.oz) AS d,
 b.dx * (a.ox - b.ox) + b.dy * (a.oy - b.oy) + b.dz * (a.oz - b.oz) AS e, a.ox, a.oy, a.oz, a.dx, a.dy, a.dz, b.ox AS px, b.oy AS py, b.oz AS pz,
 b.dx AS qx, b.dy AS qy, b.dz AS qz
 FROM dir a JOIN dir b ON a.site = b.site AND a.ord < b.ord AND a.scan <> b.scan),
ts AS (SELECT *, (c * e - d) / (1 - c * c) AS t, (e - c * d) / (1 - c * c) AS s FROM pr WHERE 1 - c * c >= 1e-9),
cand AS (SELECT site, i, j, t, s, sqrt((ox + t * dx - px - s * qx) ** 2 + (oy + t * dy - py - s * qy) ** 2 + (oz + t * dz - pz - s * qz) ** 2) AS gap,
 degrees(acos(least(abs(c), 1))) AS angle,
 (ox + t * dx + px + s * qx) / 2 AS mx, (oy + t * dy + py + s * qy) / 2 AS my, (oz + t * dz + pz + s * qz) / 2 AS mz FROM ts),
pc AS (SELECT * FROM cand WHERE gap <= 0.3 AND t BETWEEN 0.3 AND 8 AND s BETWEEN 0.3 AND 8 AND angle >= 5)"""


@query(f"WITH {RAY} SELECT site, i, j, round(t, 5) AS t, round(s, 5) AS s, round(gap, 5) AS gap, round(mx, 5) AS mx, round(my, 5) AS my FROM pc")
def pair_closest_approach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pair_candidates(pooled(spark, sf_dir), gap=0.3, angle=5.0).select("site", "i", "j", *(F.round(c, 5).alias(c) for c in ("t", "s", "gap", "mx", "my")))


@query(f"""WITH {RAY}, w AS (SELECT pc.site, pc.i, pc.j, r.scan, r.conf, r.yaw, r.pitch, mx - r.ox AS vx, my - r.oy AS vy, mz - r.oz AS vz,
 sqrt((mx - r.ox) ** 2 + (my - r.oy) ** 2 + (mz - r.oz) ** 2) AS rng FROM pc JOIN dir r ON pc.site = r.site),
a AS (SELECT *, {_ang('yaw', 'pitch', 'degrees(atan2(vx, vy))', 'degrees(asin(least(greatest(vz / rng, -1), 1)))')} AS off FROM w)
SELECT i, j, count(*) AS n, count(DISTINCT scan) AS scans, round(10 * count(*) + sum(conf), 4) AS score FROM a
 WHERE rng BETWEEN 0.3 AND 8 AND off <= 2 GROUP BY i, j HAVING count(DISTINCT scan) >= 2""")
def ray_supporters(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pooled(spark, sf_dir)
    p = G.pair_candidates(r, gap=0.3, angle=5.0).select("site", F.struct("i", "j").alias("key"), F.col("mx").alias("x"), F.col("my").alias("y"), F.col("mz").alias("z"))
    return G.scored(G.supporters(p, r)).select("key.i", "key.j", "n", "scans", F.round("score", 4).alias("score"))


@query(f"""WITH {RAY}, u AS (SELECT *, dx * ox + dy * oy + dz * oz AS al FROM dir),
 n AS (SELECT site, count(*) AS n, sum(1 - dx * dx) AS a, sum(-dx * dy) AS b, sum(-dx * dz) AS c, sum(1 - dy * dy) AS e, sum(-dy * dz) AS f,
 sum(1 - dz * dz) AS i,
 sum(ox - al * dx) AS p, sum(oy - al * dy) AS q, sum(oz - al * dz) AS r FROM u GROUP BY site),
 d AS (SELECT *, a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c) AS det FROM n)
SELECT site, n, CASE WHEN abs(det) >= 1e-12 THEN round((p * (e * i - f * f) - b * (q * i - f * r) + c * (q * f - e * r)) / det, 4) END AS x,
 CASE WHEN abs(det) >= 1e-12 THEN round((a * (q * i - f * r) - p * (b * i - f * c) + c * (b * r - q * c)) / det, 4) END AS y FROM d""")
def lsq_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.located(pooled(spark, sf_dir), "site").select("site", "n", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query()
def triangulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy consensus within each site; a test compares with a plain loop."""
    c = G.clusters(pooled(spark, sf_dir), gap=0.3, angle=5.0)
    return c.select("site", "id", "cluster", "multi", *(F.round(a, 4).alias(a) for a in "xyz"))


KIND = "switch"
#: Members of clusters: a fifth of the clusters has other types too, and one in ten no position.
CLUSTERED = f"""{A.DET}, mem AS (SELECT scan, device AS cluster, confidence AS conf, confidence >= 0.75 AS auto, device % 10 <> 3 AS placed,
 CASE WHEN device % 5 = 0 THEN type WHEN device % 5 > 2 THEN '{KIND}' END AS type FROM det)"""


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = A.detections(spark, sf_dir), F.col("device")
    return d.select("scan", k.alias("cluster"), F.col("confidence").alias("conf"), (F.col("confidence") >= 0.75).alias("auto"), (k % 10 != 3).alias("placed"),
                    F.when(k % 5 == 0, F.col("type")).when(k % 5 > 2, F.lit(KIND)).alias("type"))


@query(f"""WITH {CLUSTERED}, c AS (SELECT scan, cluster, count(*) FILTER (auto) AS autos, count(*) AS n, max(conf) AS top,
 count(*) FILTER (type <> '{KIND}') AS others FROM mem GROUP BY 1, 2)
SELECT scan, cluster, autos, n, CAST(row_number() OVER (PARTITION BY scan ORDER BY autos DESC, n DESC, top DESC, cluster) AS INTEGER) AS place FROM c
 WHERE autos >= 1 AND others = 0""")
def eligible_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.eligible(clustered(spark, sf_dir), "scan", KIND).select("scan", "cluster", "autos", "n", "place")


@query(f"""WITH {CLUSTERED}, t AS (SELECT DISTINCT cluster, placed FROM mem), a AS (SELECT DISTINCT cluster FROM mem WHERE auto)
SELECT (SELECT count(*) FROM mem) AS detections, (SELECT count(*) FROM mem WHERE auto) AS auto, (SELECT count(*) FROM t) AS devices, (SELECT count(*)
 FROM a) AS "devicesWithAuto",
 (SELECT count(*) FROM t WHERE placed) AS "multiView", (SELECT count(*) FROM mem WHERE NOT auto AND placed AND cluster IN (SELECT cluster FROM a)) AS "reviewOnAuto" """)
def register_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.register_stats(clustered(spark, sf_dir))


def match_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers of a block of keys whose balances are within 300, met by cells of that width."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    a = s.select(F.floor(F.col("s_suppkey") / 8).alias("site"), F.col("s_suppkey").alias("a"), F.col("s_acctbal").alias("u"), F.explode(F.array(*(F.lit(k) for k in (-1, 0, 1)))).alias("k"))
    a = a.withColumn("cell", F.floor(F.col("u") / 300) + F.col("k"))
    b = c.select(F.floor(F.col("c_custkey") / 120).alias("site"), F.col("c_custkey").alias("b"), F.col("c_acctbal").alias("v"), F.floor(F.col("c_acctbal") / 300).alias("cell"))
    dist = F.abs(F.col("u") - F.col("v"))
    return a.join(b, ["site", "cell"]).where(dist <= 300).select("site", "a", "b", F.round(dist, 4).alias("dist"))


@query("""WITH RECURSIVE s AS (SELECT s_suppkey // 8 AS site, s_suppkey AS a, s_acctbal AS u FROM supplier), c AS (SELECT c_custkey // 120 AS site, c_custkey AS b, c_acctbal AS v FROM customer),
p AS (SELECT s.site, a, b, round(abs(u - v), 4) AS dist FROM s JOIN c ON s.site = c.site AND abs(u - v) <= 300),
o AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY dist, a, b) AS k FROM p),
r(site, k, was, bs, took) AS (SELECT site, 1, [a], [b], [{'a': a, 'b': b, 'dist': dist}] FROM o WHERE k = 1 UNION ALL
 SELECT r.site, r.k + 1, CASE WHEN fine THEN list_append(was, a) ELSE was END, CASE WHEN fine THEN list_append(bs, b) ELSE bs END, CASE WHEN fine THEN list_append(took, {'a': a, 'b': b, 'dist': dist}) ELSE took END
 FROM (SELECT r.*, o.a, o.b, o.dist, NOT list_contains(was, o.a) AND NOT list_contains(bs, o.b) AS fine FROM r JOIN o ON o.site = r.site AND o.k = r.k + 1) r),
e AS (SELECT site, arg_max(took, k) AS took FROM r GROUP BY site), x AS (SELECT site, unnest(took) AS t FROM e)
SELECT CAST(site AS BIGINT) AS site, t.a AS a, t.b AS b, t.dist AS dist FROM x""")
def greedy_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one by distance; order-dependent, a test compares with a plain loop."""
    return G.greedy_match(match_pairs(spark, sf_dir), first_free=False)


def registers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as earlier devices and customers as new clusters: two thirds with a position, all with two directions."""
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    look = lambda k: F.array(*(F.struct((k * m % 4).cast("long").alias("scan"), (k * m * 7 % 360 - 180).cast("double").alias("yaw"), (k * m % 40 - 20).cast("double").alias("pitch")) for m in (1, 3)))
    old = table(spark, sf_dir, "supplier").select(F.floor(s / 8).alias("site"), s.alias("a"), F.when(s % 3 != 0, (s % 11).cast("double") / 10).alias("x"), (s % 13).cast("double").alias("y"), F.lit(1.0).alias("z"),
                                                  look(s).alias("anchors"), F.lit(3.0).alias("tol"))
    new = table(spark, sf_dir, "customer").select(F.floor(c / 120).alias("site"), c.alias("b"), F.when(c % 3 != 1, (c % 11).cast("double") / 10 + 0.05).alias("x"), (c % 13).cast("double").alias("y"), F.lit(1.1).alias("z"),
                                                  look(c).alias("members"))
    return old, new


@query(f"""WITH RECURSIVE s AS (SELECT s_suppkey // 8 AS site, s_suppkey AS a, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 11 / 10 END AS x, CAST(s_suppkey % 13 AS DOUBLE) AS y FROM supplier),
c AS (SELECT c_custkey // 120 AS site, c_custkey AS b, CASE WHEN c_custkey % 3 <> 1 THEN c_custkey % 11 / 10 + 0.05 END AS x, CAST(c_custkey % 13 AS DOUBLE) AS y FROM customer),
m AS (SELECT unnest([1, 3]) AS m), sv AS (SELECT s.*, a * m % 4 AS scan, a * m * 7 % 360 - 180 AS yaw, a * m % 40 - 20 AS pitch FROM s, m), cv AS (SELECT c.*, b * m % 4 AS scan, b * m * 7 % 360 - 180 AS yaw, b * m % 40 - 20 AS pitch FROM c, m),
p AS (SELECT s.site, a, b FROM s JOIN c ON s.site = c.site WHERE sqrt((s.x - c.x) ** 2 + (s.y - c.y) ** 2 + (1.0::DOUBLE - 1.1::DOUBLE) ** 2) <= 0.3 UNION
 SELECT sv.site, a, b FROM sv JOIN cv ON sv.site = cv.site AND sv.scan = cv.scan WHERE (sv.x IS NULL OR cv.x IS NULL) AND {_ang('sv.yaw', 'sv.pitch', 'cv.yaw', 'cv.pitch')} <= 3),
o AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY a, b) AS k FROM p),
r(site, k, was, bs) AS (SELECT site, 1, [a], [b] FROM o WHERE k = 1 UNION ALL
 SELECT r.site, r.k + 1, CASE WHEN fine THEN list_append(was, a) ELSE was END, CASE WHEN fine THEN list_append(bs, b) ELSE bs END
 FROM (SELECT r.*, o.a, o.b, NOT list_contains(was, o.a) AND NOT list_contains(bs, o.b) AS fine FROM r JOIN o ON o.site = r.site AND o.k = r.k + 1) r),
e AS (SELECT site, arg_max(was, k) AS was, arg_max(bs, k) AS bs FROM r GROUP BY site), t AS (SELECT site, unnest(was) AS a, unnest(bs) AS b FROM e),
j AS (SELECT c.*, t.a, top FROM c LEFT JOIN t ON t.site = c.site AND t.b = c.b LEFT JOIN (SELECT site, max(a) AS top FROM s GROUP BY site) u ON u.site = c.site)
SELECT site, coalesce(a, coalesce(top, 0) + row_number() OVER (PARTITION BY site, a IS NULL ORDER BY x DESC NULLS LAST, y, b)) AS device, 'seen' AS state FROM j
UNION ALL SELECT s.site, s.a, 'missing' FROM s LEFT JOIN t ON t.site = s.site AND t.a = s.a WHERE t.a IS NULL""")
def match_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids kept across a rerun: earlier devices, in order, take the first free cluster that may be them; the others count
    on by place (-x, y, z). A test compares with a plain loop."""
    old, new = registers(spark, sf_dir)
    m = G.greedy_match(G.same_devices(old, new), first_free=True)
    return G.stable_ids(new, m, old, order=(F.col("x").desc_nulls_last(), "y", "z"))


@query("""WITH e AS (SELECT s_suppkey // 8 AS site, count(*) AS n, max(s_suppkey % 150) AS top FROM supplier GROUP BY 1),
 d AS (SELECT c_custkey // 120 AS site, c_custkey AS place, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal / 100 END AS x,
 CAST(c_custkey % 17 AS DOUBLE) AS y FROM customer),
k AS (SELECT d.*, row_number() OVER (PARTITION BY d.site ORDER BY place) AS rn, coalesce(n, 0) AS n, coalesce(top, 0) AS top FROM d LEFT JOIN e ON d.site = e.site),
r AS (SELECT site, place, CAST(top + row_number() OVER (PARTITION BY site ORDER BY CASE WHEN x IS NULL THEN 1 ELSE 0 END, floor(x + 0.5), CASE
 WHEN x IS NULL THEN 0 ELSE y END, place) AS VARCHAR) AS no FROM k WHERE rn <= greatest(0, 20 - n))
SELECT site, place, 'REL-' || CASE WHEN length(no) < 2 THEN '0' ELSE '' END || no AS label FROM r""")
def renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    d = table(spark, sf_dir, "customer").select(F.floor(k / 120).alias("site"), k.alias("place"), F.when(k % 4 != 0, F.col("c_acctbal") / 100).alias("x"), (k % 17).cast("double").alias("y"))
    old = table(spark, sf_dir, "supplier").select(F.floor(s / 8).alias("site"), (s % 150).alias("number"))
    return G.renumbered(d, old, 20, "site").select("site", "place", "label")


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("site"), k.alias("id"), (F.col("s_acctbal") / 1000).alias("x"), (k % 5 * 0.2).cast("double").alias("y"), (k % 9).cast("double").alias("z"))


@query("""WITH RECURSIVE d AS (SELECT s_nationkey AS site, s_suppkey AS id, s_acctbal / 1000 AS x, s_suppkey % 5 * CAST(0.2 AS DOUBLE) AS y,
 CAST(s_suppkey % 9 AS DOUBLE) AS z FROM supplier),
e AS (SELECT a.id AS a, b.id AS b FROM d a JOIN d b ON a.site = b.site AND a.id <> b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 0.6),
r(id, root) AS (SELECT id, id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b), c AS (SELECT id, min(root) AS stack FROM r GROUP BY id),
s AS (SELECT c.id, stack, row_number() OVER (PARTITION BY stack ORDER BY z DESC, c.id) - 1 AS place, count(*) OVER (PARTITION BY stack) AS size FROM c JOIN d USING (id))
SELECT id, stack, CAST(place AS INTEGER) AS place, size, place - (size - 1) / 2 AS shift FROM s""")
def stack_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stacks(placed(spark, sf_dir), 0.6, "site")


@query()
def constrained_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent; a test compares with a plain loop."""
    p = pooled(spark, sf_dir).select("site", "id", "scan", (F.col("scan") * 2 + F.col("id") % 2).alias("image"), "yaw", "pitch", (F.col("ox") + 0.1 * F.col("dx")).alias("x"), (F.col("oy") + 0.1 * F.col("dy")).alias("y"), F.col("dz").alias("z"))
    return C.constrained(p, "site", reach=0.4)


def agg_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(F.col("o_custkey").alias("device"), F.concat(F.lit("d"), k).alias("id"), (k % 18).alias("scan"), F.col("o_orderpriority").alias("type"), (k % 97).cast("double").alias("x"), (k % 89).cast("double").alias("y"),
                    (k % 7).cast("double").alias("z"), (k % 3 == 0).alias("hit"), (k % 4 == 0).alias("auto"), F.round(F.col("o_totalprice") / 1e6, 1).alias("conf"), k.alias("ord"),
                    *(F.when(k % 18 != 7, (k % 18 * n % 13).cast("double")).alias(f"s{c}") for c, n in (("x", 5), ("y", 7), ("z", 1))))


@query("""WITH m AS (SELECT o_custkey AS device, 'd' || o_orderkey AS id, o_orderkey % 18 AS scan, o_orderpriority AS type,
 CAST(o_orderkey % 97 AS DOUBLE) AS x, CAST(o_orderkey % 89 AS DOUBLE) AS y, CAST(o_orderkey % 7 AS DOUBLE) AS z,
 o_orderkey % 3 = 0 AS hit, o_orderkey % 4 = 0 AS auto, round(o_totalprice / 1e6, 1) AS conf, o_orderkey AS ord,
 CASE WHEN o_orderkey % 18 <> 7 THEN CAST(o_orderkey % 18 * 5 % 13 AS DOUBLE) END AS sx, CASE WHEN o_orderkey % 18 <> 7 THEN CAST(o_orderkey % 18 * 7 % 13 AS DOUBLE) END AS sy,
 CASE WHEN o_orderkey % 18 <> 7 THEN CAST(o_orderkey % 18 % 13 AS DOUBLE) END AS sz,
 bool_or(o_orderkey % 3 = 0) OVER (PARTITION BY o_custkey) AS ah FROM orders),
c AS (SELECT device, quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my, quantile_cont(z, 0.5) AS mz FROM m WHERE hit OR NOT ah GROUP BY device),
g AS (SELECT m.device, round(quantile_cont(sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2), 0.5) FILTER (hit OR NOT ah), 5) AS spread, CASE
 WHEN bool_or(auto) THEN 'auto' ELSE 'review' END AS status,
 string_agg(id, ',' ORDER BY length(id), id) AS ids, arg_max(id, (conf, -coalesce(sqrt((sx - mx) ** 2 + (sy - my) ** 2 + (sz - mz) ** 2), 1e9), -ord)) AS best, array_to_string(list_sort(list(DISTINCT scan)), ',') AS scans, any_value(mx) AS x, any_value(my) AS y FROM m
 JOIN c USING (device) GROUP BY m.device),
t AS (SELECT device, type, count(*) AS n FROM m GROUP BY 1, 2), v AS (SELECT device, arg_min(type, (-n, type)) AS type FROM t GROUP BY device)
 SELECT g.*, type FROM g JOIN v USING (device)""")
def device_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = C.device_aggregate(agg_members(spark, sf_dir), "device")
    return a.select("device", F.round("spread", 5).alias("spread"), "status", F.concat_ws(",", "ids").alias("ids"), "best", F.concat_ws(",", F.transform("scans", lambda x: x.cast("string"))).alias("scans"), "x", "y", "type")


@query("""WITH n AS (SELECT user_id AS cluster, event_id % 97 AS device, count(*) AS n FROM events GROUP BY 1, 2),
 p AS (SELECT cluster, arg_max(device, (n, -device)) AS device, round(max(n) / sum(n), 6) AS agreement FROM n GROUP BY cluster)
SELECT *, count(*) OVER (PARTITION BY device) = 1 AS alone FROM p""")
def cluster_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").select(F.col("user_id").alias("cluster"), (F.col("event_id") % 97).alias("device"))
    return C.agreement(m).withColumn("agreement", F.round("agreement", 6))


CROSS = """h AS (SELECT event_id AS id, value AS x, value / 2 AS y, CAST(1.0 AS DOUBLE) AS z FROM events WHERE event_id % 3 <> 0),
 t AS (SELECT event_id AS id, value + CAST(0.02 AS DOUBLE) * (event_id % 5) AS x, value / 2 AS y, CAST(1.0 AS DOUBLE) AS z FROM events
 WHERE event_id % 4 <> 0),
x AS (SELECT id, sqrt((h.x - t.x) ** 2 + (h.y - t.y) ** 2 + (h.z - t.z) ** 2) AS dist, CASE WHEN h.x IS NULL THEN 'triangulation'
 ELSE 'ray' END AS method FROM h FULL JOIN t USING (id))"""


def cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    h = e.where(i % 3 != 0).select(i.alias("id"), F.col("value").alias("x"), (F.col("value") / 2).alias("y"), F.lit(1.0).alias("z"))
    t = e.where(i % 4 != 0).select(i.alias("id"), (F.col("value") + 0.02 * (i % 5)).alias("x"), (F.col("value") / 2).alias("y"), F.lit(1.0).alias("z"))
    return C.cross_check(h, t)


@query(f"WITH {CROSS} SELECT id, round(dist, 5) AS dist, method FROM x")
def cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross(spark, sf_dir).select("id", F.round("dist", 5).alias("dist"), "method")


@query(f"""WITH {CROSS} SELECT count(*) AS detections, count(*) FILTER (method = 'ray') AS hits, round(avg(CASE method WHEN 'ray' THEN 1.0 ELSE 0.0 END) FILTER (id % 2 = 0), 6) AS auto_rate,
 count(*) FILTER (method = 'triangulation') AS fallback, round(quantile_cont(dist, 0.5), 5) AS median_dist, round(max(dist), 5) AS max_dist FROM x""")
def cross_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = C.cross_report(cross(spark, sf_dir).withColumn("auto", F.col("id") % 2 == 0))
    return r.withColumns({"auto_rate": F.round("auto_rate", 6)} | {c: F.round(c, 5) for c in ("median_dist", "max_dist")})


@query(f"""WITH {PAIRING}, sn AS (SELECT site, count(*) AS headers FROM h GROUP BY site), sp AS (SELECT site, count(*) AS points FROM c GROUP BY site),
sg AS (SELECT site, count(*) AS paired, max(dist) AS worst, bool_and(used = 1 AND dist < 0.1) AS s FROM f GROUP BY site)
SELECT 'A0' AS gate, bool_and(coalesce(headers, 0) = coalesce(points, 0) AND coalesce(paired, 0) = coalesce(headers, 0) AND coalesce(s, false)) AS passed, round(max(worst), 5) AS value
 FROM sn FULL JOIN sp USING (site) LEFT JOIN sg USING (site)""")
def pairing_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate A0: all sites' headers are paired one to one."""
    h, c = pairing_sides(spark, sf_dir)
    return gates.paired(L.pairing_gate(L.nearest_pairing(h, c), h, c)).withColumn("value", F.round("value", 5))


@query(f"""WITH {CROSS}, h AS (SELECT 'A5' AS gate, avg(CASE method WHEN 'ray' THEN 1.0 ELSE 0.0 END) FILTER (id % 2 = 0) >= 0.8 AND quantile_cont(dist,
 0.5) < 0.1 AS passed, round(quantile_cont(dist, 0.5), 5) AS value FROM x),
n AS (SELECT user_id AS cluster, event_id % 97 AS device, count(*) AS n FROM events GROUP BY 1, 2),
 p AS (SELECT cluster, arg_max(device, (n, -device)) AS device FROM n GROUP BY cluster),
a AS (SELECT 'A6' AS gate, (SELECT count(DISTINCT user_id) FROM events) = count(*) AND count(*) = count(DISTINCT device) AS passed,
 CAST(count(DISTINCT device) AS DOUBLE) AS value FROM p),
w AS (SELECT 'walkway' AS gate, avg((s_suppkey % 25 = 0)::INT) < 0.05 AS passed, round(avg((s_suppkey % 25 = 0)::INT), 5) AS value FROM supplier),
z AS (SELECT 'sizes' AS gate, sum(strlen(c_name)) < 100000 AS passed, CAST(sum(strlen(c_name)) AS DOUBLE) AS value FROM customer)
SELECT * FROM h UNION ALL SELECT * FROM a UNION ALL SELECT * FROM w UNION ALL SELECT * FROM z""".replace("h AS (SELECT 'A5'", "h5 AS (SELECT 'A5'").replace("SELECT * FROM h UNION", "SELECT * FROM h5 UNION"))
def publication_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of distances, clusters, walkway and sizes; ``pairing_gates`` and ``reprojection_gate`` are the others."""
    m = table(spark, sf_dir, "events").select(F.col("user_id").alias("cluster"), (F.col("event_id") % 97).alias("device"))
    discs = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 25 == 0).alias("blocked"))
    size = table(spark, sf_dir, "customer").agg(F.sum(F.octet_length("c_name")).alias("text_bytes"), F.lit(0).alias("picture_bytes"))
    g = gates.together(gates.located(cross(spark, sf_dir).withColumn("auto", F.col("id") % 2 == 0)), gates.one_to_one(C.agreement_gate(C.agreement(m), m)), gates.walkway(discs), gates.sizes(size))
    return g.withColumn("value", F.round("value", 5))


@query(f"""WITH {A.DET}, o AS (SELECT *, row_number() OVER (PARTITION BY device, scan ORDER BY confidence DESC, id) AS r FROM det WHERE scan IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY CASE WHEN scan IN (2, 5) THEN 0 ELSE 1 END, confidence DESC, id) AS q FROM o
 WHERE r = 1) SELECT device, id, scan FROM p WHERE q <= 5""")
def tag_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.detections(spark, sf_dir).where("scan is not null").withColumn("conf", F.col("confidence"))
    return C.sampled(d, "device", F.col("scan").isin(2, 5), 5).select("device", "id", "scan")


@query(f"""WITH RECURSIVE {A.DET}, h AS (SELECT device // 30 AS site, device, device % 4 <> 0 AS later, ord, id, id % 1000 // 90 AS scan FROM det WHERE scan IS NOT NULL),
f AS (SELECT *, dense_rank() OVER (PARTITION BY site, scan ORDER BY later, device) AS n FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY later, device, ord, id, scan) AS k FROM f WHERE n <= 8),
r(site, k, took) AS (SELECT site, 1, [{{'device': device, 'id': id, 'scan': scan}}] FROM o WHERE k = 1 UNION ALL
 SELECT r.site, r.k + 1, CASE WHEN len(took) < 8 AND len(list_filter(took, lambda t: t.scan = o.scan OR t.device = o.device)) = 0 THEN list_append(took, {{'device': o.device, 'id': o.id, 'scan': o.scan}}) ELSE took END
 FROM r JOIN o ON o.site = r.site AND o.k = r.k + 1),
e AS (SELECT site, arg_max(took, k) AS took FROM r GROUP BY site), x AS (SELECT site, took, unnest(range(1, len(took) + 1)) AS place FROM e)
SELECT CAST(site AS BIGINT) AS site, took[place].device AS device, took[place].id AS id, CAST(took[place].scan AS BIGINT) AS scan, CAST(place AS INTEGER) AS place FROM x""")
def ray_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent choice of rays to look at, for each block of users; a test compares with a plain loop."""
    d, k = A.detections(spark, sf_dir), F.col("device")
    hits = d.where("scan is not null").select(F.floor(k / 30).alias("site"), "device", (k % 4 == 0).alias("stacked"), "ord", "id", F.floor(F.col("id") % 1000 / 90).alias("scan"))
    return C.sampled_stacks(hits, "site")
