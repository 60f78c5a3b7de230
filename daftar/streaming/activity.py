"""Event metrics on streams. Each is the streaming form of a batch function in operators.analytics; late events beyond the watermark are left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from daftar.operators.analytics import minute_bucket
from daftar.operators.locks import FORGET, MINUTE, State, locks
from daftar.sources import laws


def events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of event files with ts as timestamp (UTC)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def users_over_time(stream: DataFrame, minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """Approximate distinct users by bucket; exact distinct needs the batch form."""
    bucket = minute_bucket(F.col("ts").cast("timestamp_ntz"), minutes).cast("timestamp")
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("_hour"), bucket.alias("bucket")).agg(F.approx_count_distinct("user_id", 0.01).alias("n_users")).drop("_hour")


def online(stream: DataFrame, minutes: int = 5, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Approximate users of the last minutes, by sliding window: end, n_online."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes", every)).agg(F.approx_count_distinct("user_id", 0.01).alias("n_online")).select(F.col("window.end").alias("end"), "n_online")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions, each when the watermark has passed its end."""
    return stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.min("ts").alias("start"), F.max("ts").alias("last_seen"), F.count("*").alias("n_events")).drop("session_window")


def first_seen(stream: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Rows whose key has not come within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def lockouts(stream: DataFrame, most: int = 5, minutes: int = 30) -> DataFrame:
    """A row for each user and batch in which `most` failures in a row were reached: user_id, locked_until. State is two numbers per user.

    A batch is taken in order of time; event_type `error` is a failure, all else a success.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures = state.get[0] if state.exists else 0
        until = None
        for row in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            failures = failures + 1 if row.event_type == "error" else 0
            if failures >= most:
                until, failures = row.ts + pd.Timedelta(minutes=minutes), 0
        state.update((failures,))
        if until is not None:
            yield pd.DataFrame({"user_id": [key[0]], "locked_until": [until]})

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id long, locked_until timestamp", "failures int", "append", GroupStateTimeout.NoTimeout)


class _Locks(StatefulProcessor):
    """State of a user: failures, the last one's time and the end of the lock. A timer clears it when neither can matter any more."""

    def __init__(self, most: int, minutes: int) -> None:
        self.most, self.lock = most, minutes * MINUTE

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempts", "failures int, last long, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        held = State(*self.state.get()) if self.state.exists() else State()
        ts = frame["ts"].to_numpy("datetime64[us]").astype(np.int64)
        begins, state = locks(ts, (frame["event_type"] == "error").to_numpy(), held, self.most, self.lock)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if state.failures or state.until > ts[-1]:
            self.state.update(tuple(state))
            self.handle.registerTimer(max(state.last + FORGET if state.failures else 0, state.until) // 1000)
        elif self.state.exists():
            self.state.clear()
        begun = pd.to_datetime(pd.Series(begins, dtype="int64"), unit="us")
        yield pd.DataFrame({"user_id": [key[0]] * len(begins), "locked_at": begun, "locked_until": begun + pd.Timedelta(microseconds=self.lock)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())


def locked(stream: DataFrame, most: int = 5, minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """The streaming form of operators.locks.locked: user_id, locked_at, locked_until, a row for every lock. event_type `error` is a failure, all else a success.

    A user's attempts must come in the order of their time from batch to batch; within a batch they are put in order. Users whose failures are forgotten and whose locks have
    ended have no state. Timers and state of this kind need the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    known = stream.where("user_id is not null and ts is not null").select("user_id", "ts", "event_id", "event_type")
    return known.withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(_Locks(most, minutes), "user_id long, locked_at timestamp, locked_until timestamp", "Append", "EventTime")


def user_slices(stream: DataFrame, path: str, checkpoint: str, minutes: int = 15):
    """Exact distinct users of a stream: adds each batch's bitmaps of users (operators.user_bitmaps) to a small table that answers any stretch of time. A batch that is run again replaces itself."""
    from daftar.operators import user_bitmaps

    def add(batch: DataFrame, number: int) -> None:
        user_bitmaps.slices(batch, minutes=minutes).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(spark: SparkSession, path: str, target: str, checkpoint: str):
    """Reads new law JSON files of a folder once and appends their articles to a Parquet table; a file is read once, a batch that is run again replaces itself."""
    files = spark.readStream.format("text").option("wholetext", "true").load(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))

    def append(batch: DataFrame, number: int) -> None:
        laws.articles(laws.laws(batch)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
