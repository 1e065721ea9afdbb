"""From candidate boxes to triaged detections: filters, verdicts, confidence, review queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.expressions import half_even, zero_padded

AUTO = 0.75
CUT_PX, ASPECT, MAX_PITCH = 8, (0.8, 2.3), 45.0
REJECT, ACCEPT = 0.95, 0.98
SIM_LOW, SIM_SPAN = 0.76, 0.12


def status_of(confidence: Column, given: Column | None = None) -> Column:
    """A given status stands; otherwise auto from the threshold on (inclusive), else review."""
    by_conf = F.when(confidence >= AUTO, "auto").otherwise("review")
    return by_conf if given is None else F.coalesce(given, by_conf)


def is_auto(confidence: Column, given: Column) -> Column:
    return F.coalesce(given == "auto", confidence >= AUTO)


def detection_view(d: DataFrame, default_type: str = "relay-615") -> DataFrame:
    """Detections as people see them: type never null, status, and where they were seen."""
    number = F.regexp_extract("scanPointId", r"(\d+)$", 1)
    return d.select("id", F.coalesce("assetTypeId", F.lit(default_type)).alias("assetTypeId"), F.col("ocrText").alias("label"), "confidence",
                    status_of(F.col("confidence")).alias("status"),
                    F.when(F.col("scanPointId").isNotNull(), F.concat(F.lit("Scan point "), zero_padded(number))).otherwise("").alias("position"))


def usable_rays(d: DataFrame, scans: DataFrame) -> DataFrame:
    """Detections with a direction whose scan has a position, with that position. Spark broadcasts scans if they measure small."""
    return d.where("yaw is not null and pitch is not null").join(scans, "scan")


def box_filters(c: DataFrame, width: float, height: float, drop_cut: bool = False, posed: bool = True) -> DataFrame:
    """Candidates that pass the border, aspect and pitch filters, with the flag ``cut``.

    Boxes at the border skip the aspect filter, since their shape is cut off.
    """
    cut = (F.col("x1") < CUT_PX) | (F.col("y1") < CUT_PX) | (F.col("x2") > width - CUT_PX) | (F.col("y2") > height - CUT_PX)
    aspect = (F.col("x2") - F.col("x1")) / F.greatest(F.col("y2") - F.col("y1"), F.lit(1e-6))
    out = c.withColumn("cut", cut).withColumn("aspect", aspect).where(F.col("cut") | F.col("aspect").between(*ASPECT))
    if drop_cut:
        out = out.where(~F.col("cut"))
    return out.where(F.abs("pitch") <= MAX_PITCH) if posed else out


def angular_size(w: Column, h: Column, pixel_w: Column, pixel_h: Column, focal: Column) -> Column:
    return F.degrees(F.greatest(w * pixel_w, h * pixel_h) / focal)


def contained_labels(boxes: DataFrame, labels: DataFrame, key: str = "view") -> DataFrame:
    """Labels whose centre is inside a box of the same view (edges count), collected for each box."""
    lab = labels.select(F.col(key).alias("_k"), "label_id", ((F.col("lx1") + F.col("lx2")) / 2).alias("cx"), ((F.col("ly1") + F.col("ly2")) / 2).alias("cy"))
    hit = (F.col(key) == F.col("_k")) & F.col("cx").between(F.col("x1"), F.col("x2")) & F.col("cy").between(F.col("y1"), F.col("y2"))
    found = boxes.join(lab, hit).groupBy("box_id").agg(F.array_sort(F.collect_list("label_id")).alias("labels"))
    return boxes.join(found, "box_id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<bigint>")))


def verdict(c: DataFrame) -> DataFrame:
    """Rejected, review or accepted by similarity, confidence and text score (0 to 100), with the final confidence."""
    score = F.col("similarity") + 0.2 * F.col("conf")
    visual = F.least(F.greatest((F.col("similarity") - SIM_LOW) / SIM_SPAN, F.lit(0.0)), F.lit(1.0))
    final = F.col("conf") * (0.6 + 0.4 * F.greatest(F.col("ocr") / 100, visual))
    state = F.when(score < REJECT, "reject").when((score >= ACCEPT) | (F.col("ocr") >= 65), "accept").otherwise("review")
    out = c.withColumn("verdict", state)
    return out.withColumn("confidence", F.when(F.col("verdict") == "reject", None).when(F.col("verdict") == "review", half_even(final * 0.5, 3)).otherwise(half_even(final, 3)))


def upgraded(confidence: Column, conf: Column, ocr: Column) -> Column:
    """Confidence after a closer look at the text; never lower than before."""
    return F.greatest(confidence, conf * (0.6 + 0.4 * ocr / 100))


def per_scan_counts(d: DataFrame, scans: DataFrame) -> DataFrame:
    """Tags of each scan, zero included; rejected ones don't count."""
    n = d.where("status <> 'rejected'").groupBy("scan").agg(F.count("*").alias("tags"))
    return scans.select("scan").join(n, "scan", "left").select("scan", F.coalesce("tags", F.lit(0)).alias("tags"))


def dashboard(d: DataFrame) -> DataFrame:
    live, review = F.col("status") != "rejected", F.col("status") == "review"
    return d.agg((F.count_if(live) - F.count_if(review)).alias("tagged"), F.count_if(review).alias("review"),
                 F.count_if(live & F.col("scan").isNotNull()).alias("located"),
                 F.round(100.0 * F.count_if(F.col("status") == "confirmed") / F.greatest(F.count_if(F.col("status").isin("auto", "confirmed")), F.lit(1)), 4).alias("precision_pct"))


def review_queue(d: DataFrame) -> DataFrame:
    return d.where("status = 'review'").orderBy("confidence", "id")


def strongest(d: DataFrame, n: int = 1) -> DataFrame:
    """The n of highest confidence; the first in input order on ties."""
    return d.orderBy(F.desc("confidence"), "ord").limit(n)


def apply_reviews(d: DataFrame, decisions: DataFrame) -> DataFrame:
    """Latest decision for each detection: approve, reject, or edit (label, certain, confirmed, type if it matched)."""
    last = decisions.groupBy("id").agg(F.max_by(F.struct("action", "label", "typeId"), F.struct("at", "ord")).alias("d"))
    act = F.col("d.action")
    return d.join(last, "id", "left").select(
        "id", F.when(act == "edit", F.col("d.label")).otherwise(F.col("label")).alias("label"),
        F.when(act == "edit", 1.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(act.isin("approve", "edit"), "confirmed").when(act == "reject", "rejected").otherwise(F.col("status")).alias("status"),
        F.when(act == "edit", F.coalesce("d.typeId", "assetTypeId")).otherwise(F.col("assetTypeId")).alias("assetTypeId"))


def numbered(d: DataFrame, order: list[str], within: list[str], per_page: int = 96) -> DataFrame:
    """Ids d1, d2 ... in a stated order within each group, and the sheet each falls on."""
    rn = F.row_number().over(Window.partitionBy(*within).orderBy(*order))
    return d.withColumn("n", rn).withColumn("new_id", F.concat(F.lit("d"), F.col("n"))).withColumn("sheet", F.floor((F.col("n") - 1) / per_page))


def extremes(d: DataFrame, by: str) -> DataFrame:
    """Ids of the surest and the least sure detection of each group."""
    return d.groupBy(by).agg(F.max_by("id", F.struct("confidence", -F.col("id"))).alias("strong"), F.min_by("id", F.struct("confidence", "id")).alias("weak"))


def run_totals(before: DataFrame, after: DataFrame, scans: DataFrame) -> DataFrame:
    """Counts of two runs for each scan, zero included, with a totals row (scan null)."""
    def counts(d: DataFrame, name: str) -> DataFrame:
        return d.groupBy("scan").agg(F.count("*").alias(name), F.count_if(F.col("confidence") >= AUTO).alias(f"{name}_auto"))

    names = ["before", "before_auto", "after", "after_auto"]
    each = scans.select("scan").join(counts(before, "before"), "scan", "left").join(counts(after, "after"), "scan", "left").na.fill(0, names)
    return each.rollup("scan").agg(*(F.sum(n).alias(n) for n in names))


def label_text(reads: DataFrame, least: float = 65.0) -> DataFrame:
    """Text of each box: what its label regions say, unless that misses the bound while the top of the front reaches it
    or the labels are blank; the score is 0 below the bound. ``reads`` (box_id, label, label_score, front, front_score)."""
    front = (F.col("label_score") < least) & ((F.col("front_score") >= least) | (F.coalesce("label", F.lit("")) == ""))
    score = F.when(front, F.col("front_score")).otherwise(F.col("label_score"))
    return reads.select("box_id", F.when(front, F.col("front")).otherwise(F.col("label")).alias("text"), F.when(score >= least, score).otherwise(0.0).alias("score"))


def best_text(pieces: DataFrame) -> DataFrame:
    """The best piece of text for each box: highest score, then the later text."""
    return pieces.groupBy("box_id").agg(F.max(F.struct("score", "text")).alias("b")).select("box_id", "b.text", "b.score")


def looked_up(detections: DataFrame, types: DataFrame, instances: DataFrame) -> DataFrame:
    """Detections with the library's entry of their type and of the device they are linked to: ``type`` and ``library``
    structs, null where there is none. ``types`` (assetTypeId, ...), ``instances`` (instanceId, ...) with unique ids."""
    t = types.select("assetTypeId", F.struct(*(c for c in types.columns if c != "assetTypeId")).alias("type"))
    i = instances.select("instanceId", F.struct(*(c for c in instances.columns if c != "instanceId")).alias("library"))
    return detections.join(t, "assetTypeId", "left").join(i, "instanceId", "left")
