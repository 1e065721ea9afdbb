"""Readers: JSON arrays and maps, stores with fallback, clouds, grids, images."""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline import schema as S
from sightline.functions.expressions import half_even, zero_padded
from sightline.sources.shared import exists
from sightline.sources.sinks import POINTER


def json_array(spark: SparkSession, path: str, schema: str, lines: bool | None = None) -> DataFrame:
    """An array of objects, or files of one object a line, with a fixed schema. Bad records keep nulls.

    ``lines`` says which; where it is null the first line that isn't blank does. Files of lines are split among tasks; a
    file with an array is read by one.
    """
    if lines is None:
        first = spark.read.text(path).where("trim(value) <> ''").first()
        text = first["value"].strip() if first is not None else ""
        lines = text.startswith("{") and text.endswith("}")
    return spark.read.schema(schema).json(path, multiLine=not lines)


def json_map(spark: SparkSession, path: str, value_schema: str, key: str) -> DataFrame:
    """An object whose names are keys: one row for each, in file order (``ord``). Of a folder with one file for each value
    of its partition columns these columns come first."""
    raw = spark.read.text(path, wholetext=True)
    by = [c for c in raw.columns if c != "value"]
    m = raw.select(*by, F.map_entries(F.from_json("value", f"map<string,struct<{value_schema}>>")).alias("m"))
    return m.select(*by, F.posexplode("m").alias("ord", "e")).select(*by, "ord", F.col("e.key").alias(key), "e.value.*")


def source_hash(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and the first twelve digits of the SHA-1 of each text file, lines ending as on any system."""
    one = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r\n", "\n").alias("text"))
    return one.select("path", F.substring(F.sha1("text"), 1, 12).alias("hash"))


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The file's rows, or none where there is no file."""
    return json_array(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def poses(spark: SparkSession, path: str) -> DataFrame:
    return with_scan_ids(json_map(spark, path, S.POSE.replace("\n", " "), "image"))


def with_scan_ids(images: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Images of one place (position rounded to centimetres) share a dense id, counted in first-seen order; of several
    sites (columns ``by``, without nulls) each counts its own."""
    by = by or []
    key = F.transform("translation", lambda v: half_even(v, 2))
    seen = images.groupBy(*by, key.alias("_k")).agg(F.min("ord").alias("_first"))
    # one row for each place: a site's cameras, so numbering them in one window is small
    ids = seen.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("_first")) - 1)
    ids = ids.select(*by, "_k", F.concat(F.lit("scan-"), zero_padded(F.col("n"))).alias("scanPointId"))
    return images.withColumn("_k", key).join(ids, [*by, "_k"]).drop("_k")


def store(spark: SparkSession, path: str, schema: str, seed: DataFrame) -> tuple[DataFrame, bool]:
    """A stored log, or the seed where it is missing or holds a corrupt record; the flag tells which."""
    if not exists(spark, path):
        return seed, True
    read = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    df = spark.read.text(path).where("trim(value) <> ''").select(read.alias("r")).select("r.*")
    bad = df.where("_corrupt_record is not null").limit(1).count()
    return (seed, True) if bad else (df.drop("_corrupt_record"), False)


def cloud(spark: SparkSession, path: str, scan: str | None = None) -> DataFrame:
    """Points from Parquet partitioned by scan; a scan named is the only folder read."""
    df = spark.read.parquet(path)
    return df.where(F.col("scan") == scan) if scan is not None else df


#: Points of a chunk.
CHUNK = 200_000


def archive_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Scans of a folder of archives, by its manifest alone: (index, file, name, points, hasRGB, translation, rotation_wxyz)."""
    scan = "file string, name string, pointsRaw long, hasRGB boolean, translation array<double>, rotation_wxyz array<double>"
    m = spark.read.text(f"{folder}/manifest.json", wholetext=True).select(F.from_json("value", f"scans array<struct<{scan.replace(' ', ':').replace(',:', ',')}>>").alias("m"))
    s = m.select(F.posexplode("m.scans").alias("index", "s"))
    return s.select("index", "s.file", "s.name", F.col("s.pointsRaw").alias("points"), F.coalesce("s.hasRGB", F.lit(False)).alias("hasRGB"), "s.translation", "s.rotation_wxyz")


def archive_cloud(spark: SparkSession, folder: str, scans: list[int] | None = None, chunk: int = CHUNK) -> DataFrame:
    """Points of a folder of compressed archives, one a scan, with a manifest: (scan, ord, x, y, z, r, g, b), colours null
    where there are none. Only the files of the scans named are opened; a file's points pass in chunks."""
    files = {r["file"]: r["index"] for r in archive_headers(spark, folder).select("index", "file").collect() if scans is None or r["index"] in scans}
    schema = pa.schema([("scan", pa.int32()), ("ord", pa.int64()), *((c, pa.float32()) for c in "xyz"), *((c, pa.int32()) for c in "rgb")])
    out = "scan int, ord long, x float, y float, z float, r int, g int, b int"
    if not files:
        return spark.createDataFrame([], out)

    def points(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                scan = files[path.rsplit("/", 1)[1]]
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    xyz = z["xyz"].astype(np.float32)
                    rgb = z["rgb"] if "rgb" in z else None
                for at in range(0, len(xyz), chunk):
                    part = xyz[at : at + chunk]
                    n = len(part)
                    colours = [pa.array(rgb[at : at + chunk, k].astype(np.int32)) if rgb is not None else pa.nulls(n, pa.int32()) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, scan, np.int32)), pa.array(np.arange(at, at + n)), *(pa.array(np.ascontiguousarray(part[:, k])) for k in range(3)), *colours], schema=schema)

    names = "{" + ",".join(sorted(files)) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", names).load(folder).select("path", "content").mapInArrow(points, out)


def published(spark: SparkSession, target: str) -> DataFrame:
    """The version of an artefact that its pointer names (see ``sinks.put``)."""
    version = spark.read.text(f"{target}/{POINTER}").first()["value"]
    return spark.read.parquet(f"{target}/{version}")


DOC = "array<struct<title:string,url:string>>"


def library(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The asset library: types (assetTypeId, name, manufacturer, manufacturerDocs) and instances (instanceId, assetTypeId,
    documents). A list that the file lacks is empty."""
    kind = (f"assetTypes array<struct<assetTypeId:string,name:string,manufacturer:string,manufacturerDocs:{DOC}>>, "
            f"instances array<struct<instanceId:string,assetTypeId:string,documents:{DOC}>>")
    one = spark.read.schema(kind).json(path, multiLine=True)
    return one.select(F.explode("assetTypes").alias("t")).select("t.*"), one.select(F.explode("instances").alias("i")).select("i.*")


def headers(spark: SparkSession, manifest: str) -> DataFrame:
    """Scan headers alone; no points are read."""
    return spark.read.json(manifest)


def images(spark: SparkSession, folder: str, pattern: str = "*.{jpg,jpeg,png}") -> DataFrame:
    """Image files by extension, path first; content is read only where it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length", "content").orderBy("path")


def grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("room", "ix", "iy", "iz", "n")


def query_filters(params: dict[str, str], allowed: dict[str, str]) -> dict[str, object]:
    """Typed parameters of a query string; unknown names and values that don't fit are dropped."""
    out: dict[str, object] = {}
    for name, kind in allowed.items():
        v = params.get(name)
        if v is None:
            continue
        try:
            out[name] = {"string": str, "int": int, "double": float}[kind](v)
        except ValueError:
            continue
    return out


def scan_images(images: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Images of each scan, in file order; of several sites by their columns ``by`` too."""
    return images.groupBy(*(by or []), "scanPointId").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "image"))), lambda s: s["image"]).alias("images"))
