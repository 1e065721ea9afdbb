"""The maintenance log as a change stream, and windows over events. These are extensions: the batch operators are the
definition, and each stream ends in the state a batch run would give."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from sightline.operators.maintenance import apply_patches
from sightline.sources.shared import exists


def event_windows(events: DataFrame, every: str, late: str) -> DataFrame:
    """Counts and sums of each type in tumbling windows; rows later than the watermark are dropped."""
    return (events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type")
            .agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total"))


def event_sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    return (events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
            .agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"))


def current(spark: SparkSession, base: str, target: str, before: int | None = None) -> DataFrame:
    """The log: each entry's latest version of the stored one and of what batches (those before a number) have changed."""
    log = spark.read.parquet(base)
    changes = f"{target}/changes"
    if exists(spark, changes):
        new = spark.read.schema(T.StructType([*log.schema.fields, T.StructField("batch", T.LongType())])).parquet(changes)
        new = new if before is None else new.where(F.col("batch") < before)
        both = log.unionByName(new.select(*log.columns))
        log = both.groupBy("id").agg(F.max_by(F.struct(*log.columns), "version").alias("e")).select("e.*")
    return log


def upsert_batches(patches: DataFrame, base: str, devices: DataFrame, target: str, checkpoint: str, now: str, today: str, each: int | None = None) -> StreamingQuery:
    """Apply a stream of patches (id, base, ord and the columns to set) to a stored log. A batch folds all patches of an
    entry in order, writes the entries it changed under ``target``/changes and an answer for each patch under
    ``target``/answers, in folders named by its number, so a batch that is run again overwrites its own. Batches read only
    the entries that they have patches for. ``current`` gives the log, and may be written as the base of the next run.

    As long as an entry's patches arrive in order, any split into batches gives the log and the answers of one batch; a
    patch that arrives after a later one is folded after it.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mine = current(spark, base, target, number).join(batch.select("id").distinct(), "id", "left_semi")
        log, answers = apply_patches(mine, batch, devices, now, today)
        changed = answers.where("outcome = 'applied'").select("id").distinct()
        log.join(changed, "id", "left_semi").write.mode("overwrite").parquet(f"{target}/changes/batch={number}")
        answers.write.mode("overwrite").parquet(f"{target}/answers/batch={number}")

    writer = patches.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.start()


def overdue_alerts(entries: DataFrame, late: str) -> DataFrame:
    """An alert ``instanceId, nextDueAt`` for each device when event time passes its due date: ``entries`` (instanceId,
    ts, nextDueAt as timestamps) of finished work set the due date, the newest by ``ts`` counts, and a null one takes it
    away. State holds one date and one timer for each device."""

    class Due(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.due = handle.getValueState("due", "ts timestamp, due timestamp")

        def handleInputRows(self, key, rows, timerValues):
            newest = self.due.get() if self.due.exists() else None
            for frame in rows:
                for ts, due in zip(frame["ts"], frame["nextDueAt"], strict=True):
                    if newest is None or ts > newest[0]:
                        newest = (ts, None if pd.isna(due) else due)
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.due.update(newest)
            if newest[1] is not None:
                self.handle.registerTimer(int(newest[1].timestamp() * 1000))
            yield pd.DataFrame({"instanceId": pd.Series(dtype="int64"), "nextDueAt": pd.Series(dtype="datetime64[ns]")})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            yield pd.DataFrame({"instanceId": [key[0]], "nextDueAt": [pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")]})

        def close(self):
            pass

    return (entries.withWatermark("ts", late).groupBy("instanceId")
            .transformWithStateInPandas(Due(), "instanceId long, nextDueAt timestamp", "Append", "EventTime"))


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
