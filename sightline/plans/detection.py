"""Queries of detection triage, text and clustering of views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions import text as X
from sightline.functions.expressions import box_overlap, half_even, half_up, snap
from sightline.operators import cluster as C
from sightline.operators import triage as T
from sightline.plans import adapters as A
from sightline.plans.base import query, table


@query(f"""WITH {A.DET} SELECT scan, count(*) AS n, count(*) FILTER (confidence >= 0.75) AS auto, count(*) FILTER (confidence < 0.75) AS review,
 round(max(confidence), 6) AS top FROM det GROUP BY scan""")
def triage_by_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.detections(spark, sf_dir)
    auto = T.is_auto(F.col("confidence"), F.lit(None).cast("string"))
    return d.groupBy("scan").agg(F.count("*").alias("n"), F.count_if(auto).alias("auto"), F.count_if(~auto).alias("review"), F.round(F.max("confidence"), 6).alias("top"))


@query(f"""WITH {A.DET} SELECT id, CASE WHEN id % 7 = 0 THEN 'relay-615' ELSE type END AS "assetTypeId", type AS label, round(confidence, 6) AS confidence,
 CASE WHEN confidence >= 0.75 THEN 'auto' ELSE 'review' END AS status, CASE WHEN scan IS NULL THEN ''
 ELSE 'Scan point ' || lpad(CAST(scan AS VARCHAR), CAST(greatest(2, length(CAST(scan AS VARCHAR))) AS INTEGER), '0') END AS position FROM det""")
def detection_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.detections(spark, sf_dir)
    raw = d.select("id", F.when(F.col("id") % 7 != 0, F.col("type")).alias("assetTypeId"), F.col("type").alias("ocrText"), F.round("confidence", 6).alias("r"), "confidence",
                   F.concat(F.lit("scan-"), F.col("scan")).alias("scanPointId"))
    return T.detection_view(raw).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {A.DET}, {A.SCANS} SELECT id, d.scan, sx, sy FROM det d JOIN scans s ON d.scan = s.scan""")
def usable_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.usable_rays(A.detections(spark, sf_dir), A.scans(spark, sf_dir)).select("id", "scan", "sx", "sy")


@query(f"""WITH {A.BOX}, f AS (SELECT *, x1 < 8 OR y1 < 8 OR x2 > 632 OR y2 > 632 AS cut, (x2 - x1) / greatest(y2 - y1, 1e-6) AS aspect FROM box)
SELECT ord, view, cut, round(aspect, 6) AS aspect, round(degrees(greatest((x2 - x1) * 0.01, (y2 - y1) * 0.01) / 4.0), 6) AS size_deg
FROM f WHERE (cut OR aspect BETWEEN 0.8 AND 2.3) AND abs(pitch) <= 45""")
def candidate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = T.box_filters(A.boxes(spark, sf_dir), 640, 640)
    size = T.angular_size(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(0.01), F.lit(0.01), F.lit(4.0))
    return f.select("ord", "view", "cut", F.round("aspect", 6).alias("aspect"), F.round(size, 6).alias("size_deg"))


@query(f"""WITH {A.BOX}, v AS (SELECT ord, conf, ocr, similarity + 0.2 * conf AS score, least(greatest((similarity - 0.76) / 0.12, 0), 1) AS visual FROM box),
w AS (SELECT *, CASE WHEN score < 0.95 THEN 'reject' WHEN score >= 0.98 OR ocr >= 65 THEN 'accept' ELSE 'review' END AS verdict,
 conf * (0.6 + 0.4 * greatest(ocr / 100, visual)) AS final FROM v)
SELECT ord, verdict, CASE verdict WHEN 'reject' THEN NULL WHEN 'review' THEN round_even(final * 0.5, 3) ELSE round_even(final, 3) END AS confidence FROM w""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.verdict(A.boxes(spark, sf_dir)).select("ord", "verdict", "confidence")


@query(f"""WITH {A.BOX}, u AS (SELECT view, count(*) AS n, max(greatest(round(conf, 3), conf * (0.6 + 0.4 * ocr / 100))) AS best FROM box GROUP BY view)
 SELECT view, n, round(best, 6) AS best FROM u""")
def confidence_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = A.boxes(spark, sf_dir)
    up = T.upgraded(F.round("conf", 3), F.col("conf"), F.col("ocr"))
    return b.groupBy("view").agg(F.count("*").alias("n"), F.round(F.max(up), 6).alias("best"))


@query(f"""WITH {A.BOX} SELECT b.ord AS box_id, CAST(count(l.ord) AS BIGINT) AS n, CAST(min(l.ord) AS BIGINT) AS first FROM box b LEFT
 JOIN box l ON l.view = b.view AND l.ord % 3 = 0
 AND (l.x1 + l.x2) / 2 BETWEEN b.x1 AND b.x2 AND (l.y1 + l.y2) / 2 BETWEEN b.y1 AND b.y2 GROUP BY b.ord""")
def label_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = A.boxes(spark, sf_dir)
    labels = b.where("ord % 3 = 0").select("view", F.col("ord").alias("label_id"), F.col("x1").alias("lx1"), F.col("y1").alias("ly1"), F.col("x2").alias("lx2"), F.col("y2").alias("ly2"))
    got = T.contained_labels(b.withColumn("box_id", F.col("ord")), labels)
    return got.select("box_id", F.size("labels").cast("long").alias("n"), F.get("labels", F.lit(0)).alias("first"))


@query(f"""WITH {A.DET} SELECT id, round(confidence, 6) AS confidence FROM det WHERE status = 'review'""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.review_queue(A.detections(spark, sf_dir)).select("id", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {A.DET} SELECT id, round(confidence, 6) AS confidence FROM det ORDER BY det.confidence DESC, ord LIMIT 10""")
def top_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.strongest(A.detections(spark, sf_dir), 10).select("id", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {A.DET} SELECT count(*) FILTER (status <> 'rejected') - count(*) FILTER (status = 'review') AS tagged, count(*) FILTER (status = 'review') AS review,
 count(*) FILTER (status <> 'rejected' AND scan IS NOT NULL) AS located,
 round(100.0 * count(*) FILTER (status = 'confirmed') / greatest(count(*) FILTER (status IN ('auto', 'confirmed')), 1), 4) AS precision_pct FROM det""")
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.dashboard(A.detections(spark, sf_dir))


@query(f"""WITH {A.DET}, {A.SCANS} SELECT s.scan, count(id) AS tags FROM scans s LEFT JOIN det d ON d.scan = s.scan AND d.status <> 'rejected' GROUP BY s.scan""")
def tags_per_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.per_scan_counts(A.detections(spark, sf_dir), A.scans(spark, sf_dir))


@query(f"""WITH {A.DET}, dec AS (SELECT event_id % 4000 AS id, CASE event_id % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'edit' END AS action, 'L' || event_id AS label,
 CASE WHEN event_id % 2 = 0 THEN 'T' || event_id % 5 END AS typeId, event_id AS tt FROM events WHERE event_id % 5 = 0),
l AS (SELECT id, arg_max(action, tt) AS action, arg_max(label, tt) AS label, arg_max(coalesce(typeId, '-'), tt) AS typeId FROM dec GROUP BY id)
SELECT d.id, CASE WHEN action = 'edit' THEN l.label ELSE d.type END AS label, CASE WHEN action = 'edit' THEN 1.0 ELSE round(confidence, 6) END AS confidence,
 CASE WHEN action IN ('approve', 'edit') THEN 'confirmed' WHEN action = 'reject' THEN 'rejected' ELSE d.status END AS status,
 CASE WHEN action = 'edit' THEN coalesce(nullif(l.typeId, '-'), d.type) ELSE d.type END AS "assetTypeId" FROM det d LEFT JOIN l ON d.id = l.id""")
def review_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.detections(spark, sf_dir)
    e = F.col("event_id")
    dec = table(spark, sf_dir, "events").where(e % 5 == 0).select(
        (e % 4000).alias("id"), F.when(e % 3 == 0, "approve").when(e % 3 == 1, "reject").otherwise("edit").alias("action"), F.concat(F.lit("L"), e).alias("label"),
        F.when(e % 2 == 0, F.concat(F.lit("T"), e % 5)).alias("typeId"), e.alias("at"), e.alias("ord"))
    out = T.apply_reviews(d.select("id", F.col("type").alias("label"), "confidence", "status", F.col("type").alias("assetTypeId")), dec)
    return out.withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {A.DET} SELECT id, 'd' || row_number() OVER (PARTITION BY scan ORDER BY ord) AS new_id,
 CAST((row_number() OVER (PARTITION BY scan ORDER BY ord) - 1) // 96 AS BIGINT) AS sheet FROM det""")
def sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.numbered(A.detections(spark, sf_dir), ["ord"], ["scan"]).select("id", "new_id", "sheet")


@query(f"""WITH {A.DET} SELECT scan, arg_max(id, (confidence, -id)) AS strong, arg_min(id, (confidence, id)) AS weak FROM det GROUP BY scan""")
def exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.extremes(A.detections(spark, sf_dir), "scan")


@query(f"""WITH {A.DET}, {A.SCANS}, b AS (SELECT scan, count(*) AS n, count(*) FILTER (confidence >= 0.75) AS a FROM det WHERE id % 2 = 0 GROUP BY scan),
c AS (SELECT scan, count(*) AS n, count(*) FILTER (confidence >= 0.75) AS a FROM det WHERE id % 2 = 1 GROUP BY scan),
j AS (SELECT s.scan, coalesce(b.n, 0) AS before, coalesce(b.a, 0) AS before_auto, coalesce(c.n, 0) AS after, coalesce(c.a, 0) AS after_auto
 FROM scans s LEFT JOIN b USING (scan) LEFT JOIN c USING (scan))
SELECT scan, CAST(sum(before) AS BIGINT) AS before, CAST(sum(before_auto) AS BIGINT) AS before_auto, CAST(sum(after) AS BIGINT) AS after,
 CAST(sum(after_auto) AS BIGINT) AS after_auto FROM j GROUP BY ROLLUP (scan)""")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.detections(spark, sf_dir)
    return T.run_totals(d.where("id % 2 = 0"), d.where("id % 2 = 1"), A.scans(spark, sf_dir))


@query("""WITH p AS (SELECT p_partkey AS id, p_name, p_brand FROM part) SELECT id FROM p WHERE contains(lower(p_name), 'brand#1') OR contains(lower(p_brand), 'brand#1')""")
def search_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", F.array("p_brand").alias("ids"))
    return X.search_any(p, " BRAND#1", ["p_name"], ["ids"]).select("id")


@query("""SELECT c_custkey AS id FROM customer WHERE contains(lower(concat_ws(' ', c_name, c_mktsegment)), 'building')""")
def search_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return X.search_joined(c, "Building", ["c_name", "c_mktsegment"]).select(F.col("c_custkey").alias("id"))


@query("""WITH t AS (SELECT p_partkey // 20 AS type, CASE p_partkey % 5 WHEN 0 THEN 'REF615 Product guide ' || p_partkey
 WHEN 1 THEN 'REM615 Manual ' || p_partkey WHEN 2 THEN 'RET615 Manual ' || p_partkey ELSE 'Installation ' || p_partkey END AS title FROM part
 WHERE p_partkey // 20 % 4 <> 1 OR p_partkey % 5 > 2),
d AS (SELECT s_suppkey AS device, s_suppkey AS type, CASE s_suppkey % 3 WHEN 0 THEN 'REM615' WHEN 1 THEN 'unknown' ELSE 'REX615' END AS variant FROM supplier),
j AS (SELECT device, title, regexp_matches(title, '^RE[A-Z]615') AS s, variant <> 'unknown' AND starts_with(title, variant || ' ') AS o,
 NOT regexp_matches(title, '^RE[A-Z]615') OR starts_with(title, 'REF615 Product guide') AS f FROM d JOIN t USING (type)),
n AS (SELECT *, count(*) FILTER (s) OVER w AS ns, count(*) FILTER (o) OVER w AS no, count(*) FILTER (f) OVER w AS nf FROM j WINDOW w AS (PARTITION BY device))
SELECT device, title, ns > 0 AND no = 0 AS warning FROM n WHERE CASE WHEN ns = 0 THEN true WHEN no > 0 THEN o OR NOT s WHEN nf > 0 THEN f ELSE true END""")
def docs_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    kind = F.when(k % 5 == 0, "REF615 Product guide ").when(k % 5 == 1, "REM615 Manual ").when(k % 5 == 2, "RET615 Manual ").otherwise("Installation ")
    docs = table(spark, sf_dir, "part").select(F.floor(k / 20).alias("type"), F.concat(kind, k).alias("title"), k).where((F.col("type") % 4 != 1) | (k % 5 > 2)).select("type", "title")
    devices = table(spark, sf_dir, "supplier").select(s.alias("device"), s.alias("type"), F.when(s % 3 == 0, "REM615").when(s % 3 == 1, "unknown").otherwise("REX615").alias("variant"))
    return X.docs_for_variant(devices, docs)


# the longest common subsequence a letter of the name at a time: its length up to the token's k-th letter is the largest,
# up to there, of what it was and of one more than it was before a letter that is equal
@query(r"""WITH RECURSIVE raw AS (SELECT p_partkey AS id, unnest(list_concat([p_name], string_split_regex(p_name, '\s+'))) AS raw FROM part),
tok AS (SELECT DISTINCT id, regexp_replace(upper(raw), '[^A-Z0-9]', '', 'g') AS token FROM raw WHERE length(regexp_replace(upper(raw), '[^A-Z0-9]', '', 'g')) >= 2),
ids AS (SELECT DISTINCT unnest(string_split(p_type, ' ')) AS identifier FROM part),
nam AS (SELECT identifier, regexp_replace(upper(identifier), '[^A-Z0-9]', '', 'g') AS name FROM ids WHERE regexp_replace(upper(identifier), '[^A-Z0-9]', '', 'g') <> ''),
pair AS (SELECT token, identifier, name FROM (SELECT DISTINCT token FROM tok), nam WHERE length(token) BETWEEN ceil(length(name) * (65 / 135.0)) AND floor(length(name) / (65 / 135.0))),
lcs AS (SELECT token, identifier, name, 0 AS j, list_transform(range(length(token) + 1), lambda k: 0) AS best FROM pair UNION ALL
 SELECT token, identifier, name, j + 1, list_transform(range(length(token) + 1), lambda k: list_max(list_transform(range(k + 1), lambda i:
 CASE WHEN i > 0 AND token[i] = name[j + 1] THEN greatest(best[i] + 1, best[i + 1]) ELSE best[i + 1] END))) FROM lcs WHERE j < length(name)),
sc AS (SELECT token, identifier, 200.0::DOUBLE * best[length(token) + 1] / (length(token) + length(name)) AS score FROM lcs WHERE j = length(name)),
top AS (SELECT id, identifier, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, identifier DESC) AS rn FROM tok JOIN sc ON tok.token = sc.token)
SELECT p_partkey AS id, CASE WHEN score >= 65 THEN identifier END AS identifier, round(coalesce(score, 0), 6) AS score, coalesce(score >= 65, false) AS hit FROM part LEFT JOIN top ON p_partkey = id AND rn = 1""")
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best type word for each part name, and a test with brute force."""
    p = table(spark, sf_dir, "part")
    names = p.select(F.explode(F.split("p_type", " ")).alias("identifier")).distinct()
    return X.fuzzy_match(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), names).withColumn("score", F.round("score", 6))


@query("""SELECT p_partkey AS id, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') AS norm, nullif(trim(p_brand), '') AS brand, regexp_extract(p_brand,
 '(\\d+)$', 1) AS digits FROM part""")
def normalised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sightline.functions.expressions import blank_to_null

    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.normalised("p_name").alias("norm"), blank_to_null("p_brand").alias("brand"), F.regexp_extract("p_brand", r"(\d+)$", 1).alias("digits"))


@query("""SELECT p_partkey AS id, floor(p_retailprice / 10 + 0.5) AS js, round_even(p_retailprice / 10, 1) AS py, round_even(p_retailprice / 25, 0) * 25 AS snapped FROM part""")
def rounding_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), half_up(F.col("p_retailprice") / 10).alias("js"), half_even(F.col("p_retailprice") / 10, 1).alias("py"), snap("p_retailprice", 25.0).alias("snapped"))


@query(f"""WITH {A.BOX}, p AS (SELECT a.ord AS a, b.ord AS b, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2,
 b.y2) - greatest(a.y1, b.y1), 0) AS both_,
 (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS ba FROM box a JOIN box b ON a.view = b.view AND a.ord < b.ord)
SELECT a, b, round(both_ / (aa + ba - both_), 6) AS iou, round(both_ / aa, 6) AS covered FROM p WHERE both_ / (aa + ba - both_) > 0.1""")
def box_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = A.boxes(spark, sf_dir)
    a = x.select("view", F.col("ord").alias("a"), *(F.col(c).alias(f"a{c}") for c in ("x1", "y1", "x2", "y2")))
    b = x.select("view", F.col("ord").alias("b"), *(F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")))
    v = lambda p: [F.col(f"{p}{c}") for c in ("x1", "y1", "x2", "y2")]
    iou, part = box_overlap(v("a"), v("b"))
    return a.join(b, "view").where("a < b").withColumn("iou", iou).where("iou > 0.1").select("a", "b", F.round("iou", 6).alias("iou"), F.round(part, 6).alias("covered"))


@query(f"""WITH RECURSIVE {A.BOX}, b AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY conf DESC, ord) AS k FROM box),
r(view, k, took) AS (SELECT view, 1, [{{'ord': ord, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] FROM b WHERE k = 1 UNION ALL
 SELECT r.view, r.k + 1, CASE WHEN len(list_filter(took, lambda m: (b.x1 + b.x2) / 2 BETWEEN m.x1 AND m.x2 AND (b.y1 + b.y2) / 2 BETWEEN m.y1 AND m.y2)) = 0
 THEN list_append(took, {{'ord': b.ord, 'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2}}) ELSE took END FROM r JOIN b ON b.view = r.view AND b.k = r.k + 1),
e AS (SELECT view, arg_max(took, k) AS took FROM r GROUP BY view), o AS (SELECT unnest(took).ord AS ord FROM e)
SELECT ord, view, round(conf, 6) AS conf FROM b SEMI JOIN o USING (ord)""")
def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent; a test compares with a plain loop."""
    return C.suppressed(A.boxes(spark, sf_dir), ["view"]).select("ord", "view", F.round("conf", 6).alias("conf"))


@query(f"""WITH RECURSIVE {A.BOX}, b AS (SELECT view AS scan, ord, size, sin(radians(yaw)) * cos(radians(pitch)) AS vx, cos(radians(yaw)) * cos(radians(pitch)) AS vy, sin(radians(pitch)) AS vz,
 row_number() OVER (PARTITION BY view ORDER BY conf DESC, ord) AS k FROM box),
r(scan, k, leads, got) AS (SELECT scan, 1, [{{'ord': ord, 'vx': vx, 'vy': vy, 'vz': vz, 'size': size}}], [{{'ord': ord, 'cluster': 0, 'leader': ord}}] FROM b WHERE k = 1 UNION ALL
 SELECT scan, k, CASE WHEN place = 0 THEN list_append(leads, me) ELSE leads END,
 list_append(got, {{'ord': me.ord, 'cluster': CAST(CASE WHEN place = 0 THEN len(leads) ELSE place - 1 END AS INTEGER), 'leader': CASE WHEN place = 0 THEN me.ord ELSE leads[place].ord END}})
 FROM (SELECT r.scan, r.k + 1 AS k, leads, got, {{'ord': b.ord, 'vx': b.vx, 'vy': b.vy, 'vz': b.vz, 'size': b.size}} AS me,
 coalesce(list_position(list_transform(leads, lambda m: degrees(acos(least(greatest(m.vx * b.vx + m.vy * b.vy + m.vz * b.vz, -1), 1))) <= 0.5 * greatest(m.size, b.size)), true), 0) AS place
 FROM r JOIN b ON b.scan = r.scan AND b.k = r.k + 1) n),
e AS (SELECT scan, arg_max(got, k) AS got FROM r GROUP BY scan), x AS (SELECT scan, unnest(got) AS g FROM e)
SELECT scan, g.ord AS ord, CAST(g.cluster AS BIGINT) AS cluster, g.leader AS leader FROM x""")
def leader_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent; a test compares with a plain loop."""
    return C.led_clusters(A.boxes(spark, sf_dir).withColumn("scan", F.col("view")), "scan")


@query(f"""WITH {A.BOX} SELECT view, count(DISTINCT scan) AS scans, count(DISTINCT (scan, ord % 7)) AS views FROM box GROUP BY view""")
def distinct_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.boxes(spark, sf_dir).groupBy("view").agg(F.countDistinct("scan").alias("scans"), F.countDistinct("scan", F.col("ord") % 7).alias("views"))


#: Reference vectors that may be sent to every task, at most; more raise ValueError.
MOST_REFERENCES = 100


@query("""WITH r AS (SELECT vec_id AS ref, embedding AS e FROM embeddings WHERE vec_id < 5)
 SELECT v.vec_id, round(max(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(r.e AS DOUBLE[]))), 5) AS best
 FROM embeddings v LEFT JOIN r ON true GROUP BY v.vec_id""")
def cosine_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best similarity to a few reference vectors, whose number is checked before they go to every task; null vectors have none."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    refs = [r["v"] for r in e.where("vec_id < 5 and v is not null").limit(MOST_REFERENCES + 1).collect()]
    if len(refs) > MOST_REFERENCES:
        raise ValueError(f"more than {MOST_REFERENCES} reference vectors")
    sims = [F.lit(None).cast("double")] * 2
    for r in refs:
        ref = F.array(*(F.lit(float(x)) for x in r))
        dot = F.aggregate(F.zip_with("v", ref, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        sims.append(dot / (norm(F.col("v")) * norm(ref)))
    return e.select("vec_id", F.round(F.greatest(*sims), 5).alias("best"))


@query(f"""WITH {A.BOX}, o AS (SELECT ord, scan, view, conf, row_number() OVER (PARTITION BY view ORDER BY conf DESC, ord) AS rn FROM box)
 SELECT view, ord, CAST(rn AS INTEGER) AS place FROM o WHERE rn <= 3""")
def strongest_per_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("view").orderBy(F.desc("conf"), "ord")
    return A.boxes(spark, sf_dir).withColumn("place", F.row_number().over(w)).where("place <= 3").select("view", "ord", "place")


@query("""WITH r AS (SELECT event_id AS box_id, CASE WHEN event_id % 6 = 0 THEN '' ELSE 'L' || event_id % 10 END AS label,
 CAST(event_id * 17 % 101 AS DOUBLE) AS ls, 'F' || event_id % 10 AS front, CAST(event_id * 29 % 101 AS DOUBLE) AS fs FROM events),
u AS (SELECT *, ls < 65 AND (fs >= 65 OR label = '') AS f FROM r) SELECT box_id, CASE WHEN f THEN front ELSE label END AS text, CASE WHEN (CASE
 WHEN f THEN fs ELSE ls END) >= 65 THEN (CASE WHEN f THEN fs ELSE ls END) ELSE 0.0 END AS score FROM u""")
def label_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    r = table(spark, sf_dir, "events").select(i.alias("box_id"), F.when(i % 6 == 0, "").otherwise(F.concat(F.lit("L"), i % 10)).alias("label"), (i * 17 % 101).cast("double").alias("label_score"),
                                              F.concat(F.lit("F"), i % 10).alias("front"), (i * 29 % 101).cast("double").alias("front_score"))
    return T.label_text(r)


@query("""WITH p AS (SELECT event_id % 700 AS box_id, 'T' || event_id % 37 AS text, CAST(event_id * 17 % 11 AS DOUBLE) AS score FROM events)
 SELECT box_id, max(text) AS text, score FROM p JOIN (SELECT box_id, max(score) AS score FROM p GROUP BY 1) USING (box_id, score)
 GROUP BY box_id, score""")
def best_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return T.best_text(table(spark, sf_dir, "events").select((i % 700).alias("box_id"), F.concat(F.lit("T"), i % 37).alias("text"), (i * 17 % 11).cast("double").alias("score")))
