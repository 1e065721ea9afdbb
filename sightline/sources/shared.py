"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """From ``spark.checkpoint.dir``. Only a local session may leave that unset and gets a folder under its warehouse."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's program ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    KEPT[path] = spark
    return path


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written once to the shared folder and read back, and its path: cuts the plan, so that a lost executor loses
    nothing and a result that is used several times is worked out once."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Kept tables that results may still be read from. They go when the driver's program ends.
KEPT: dict[str, SparkSession] = {}


@atexit.register
def forget_all() -> None:
    for path, spark in list(KEPT.items()):
        with contextlib.suppress(Exception):  # the JVM may have gone before
            forget(spark, path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a kept table that nothing reads any more."""
    KEPT.pop(path, None)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by the file system that its scheme names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
