"""Structured Streaming jobs (inventory T). Late rows beyond the watermark are dropped, which batch never does."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window as W

from ..operators.releases import ReleaseLog
from ..sources.files import shared_path

# Stateful processors also start in a process of the driver that doesn't see shipped files, so this module's go by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The state store that timers and typed state need.
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, per_trigger: int = 8) -> DataFrame:
    """Parquet files of a folder as a stream with the schema that they have."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def drain(stream: DataFrame, label: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Runs the stream over what is there and returns the sink's rows; sink and checkpoint are in the shared folder, or in ``path``, from
    where a later call goes on. In update mode every batch's rows are kept with their ``batch``, so the last of a key is its state."""
    spark, path = stream.sparkSession, path or shared_path(stream.sparkSession, label)
    spark.conf.set(STORE, ROCKS)
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
    else:

        def put(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/batch_no={number}")

        q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    schema = stream.schema if mode == "append" else StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    return spark.read.schema(schema).parquet(f"{path}/out" if mode == "append" else f"{path}/out/*")


def ingest(stream: DataFrame, steps: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Each micro-batch through batch operators to a table; a replayed batch overwrites its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        steps(batch).write.mode("overwrite").parquet(f"{path}/batch_no={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_releases(stream: DataFrame, steps: Callable[[DataFrame], DataFrame], log: ReleaseLog, checkpoint: str):
    """Each micro-batch through ``steps`` (convert, chunk, extract, gate: rows (item_id, revision_id)) to the release of its number.

    The batch number is the release: a batch that died anywhere before its ledger row runs again with the same rows and the same
    state before it, and replaces what it had written; one whose row is there but whose commit the stream missed gives the same again.
    """

    def put(batch: DataFrame, number: int) -> None:
        log.publish(number, steps(batch))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flush_ready(pending: DataFrame, at: str, as_of: Column, rows: int = 50, seconds: int = 30) -> DataFrame:
    """One row: whether the pending batch is to be published: enough rows, or the oldest has waited."""
    return pending.agg(F.count("*").alias("pending"), F.min(at).alias("oldest")).withColumn("flush", (F.col("pending") >= rows) | F.coalesce(F.col("oldest") <= as_of - F.expr(f"interval {seconds} seconds"), F.lit(False)))


def verification_ready(pending: DataFrame, at: str, upstream_open: Column, as_of: Column, rows: int = 32, seconds: int = 15) -> DataFrame:
    """Ready with ``rows`` rows, or when the oldest has waited, or nothing more comes."""
    out = pending.agg(F.count("*").alias("pending"), F.min(at).alias("oldest"), F.bool_or(upstream_open).alias("_open"))
    ready = (F.col("pending") > 0) & ((F.col("pending") >= rows) | (F.col("oldest") <= as_of - F.expr(f"interval {seconds} seconds")) | ~F.col("_open"))
    return out.withColumn("ready", ready).drop("_open")


def rate_counts(df: DataFrame, at: str, keys: list[str], window: str, limit: int, delay: str = "1 minute") -> DataFrame:
    """T4: tumbling counts by key with ``limited`` and ``remaining``; for batch and stream frames."""
    out = (df.withWatermark(at, delay) if df.isStreaming else df).groupBy(F.window(at, window), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", (F.col("n") > limit).alias("limited"), F.greatest(F.lit(limit) - F.col("n"), F.lit(0)).alias("remaining"))


def cooldown(failures: Column) -> Column:
    """T5: seconds to wait: none under four failures, then 30, doubling every fourth, 300 at most."""
    return F.when(failures < 4, 0).otherwise(F.least(F.lit(300), F.lit(30) * F.pow(F.lit(2), F.floor((failures - 4) / 4)))).cast("int")


def trailing_failures(df: DataFrame, at: str, key: str, seconds: int = 900) -> DataFrame:
    """T5, batch: for each failure the number of its kind in the trailing seconds, itself included, and the cool-down. Kinds are dealt in
    stretches of that many seconds, which a failure shares with the next one; counts are differences of running ones."""
    second = F.unix_seconds(F.col(at).cast("timestamp"))
    place = F.floor(second / (seconds + 1))
    both = F.explode(F.array(F.struct(place.alias("_place"), F.lit(True).alias("_own")), F.struct((place + 1).alias("_place"), F.lit(False).alias("_own"))))
    rows = df.withColumns({"_second": second, "_both": both}).withColumns({"_place": F.col("_both._place"), "_own": F.col("_both._own")}).drop("_both")
    w = W.partitionBy(key, "_place").orderBy("_second")
    upto = F.count("*").over(w.rangeBetween(W.unboundedPreceding, 0))
    before = F.count("_second").over(w.rangeBetween(W.unboundedPreceding, -seconds - 1))
    out = rows.where(F.col("_own") | F.col("_second").isNotNull()).withColumn("failures", upto - F.when(F.col("_second").isNull(), 0).otherwise(before)).where("_own")
    return out.drop("_second", "_place", "_own").withColumn("cooldown", cooldown(F.col("failures")))


def sliding_failures(stream: DataFrame, at: str, key: str, delay: str = "1 minute") -> DataFrame:
    """T5, stream: failures by kind in sliding 15-minute windows, by minute."""
    rows = stream.withWatermark(at, delay) if stream.isStreaming else stream
    out = rows.groupBy(F.window(at, "15 minutes", "1 minute"), key).agg(F.count("*").alias("failures"))
    return out.select(F.col("window.end").alias("end"), key, "failures", cooldown(F.col("failures")).alias("cooldown"))


def distinct_transitions(stream: DataFrame, at: str, key: str, allowed: list[str], route: str, delay: str = "10 minutes") -> DataFrame:
    """Allowed transitions, each dedupe key once."""
    rows = stream.where(F.col(route).isin(allowed))
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark([key]) if stream.isStreaming else rows.dropDuplicates([key])


# States from which a new request queues a demand again.
AGAIN = ("failed", "published", "unresolved")
DEMAND = "status string, priority long, demand_count long, last_seen_at timestamp"


class _Demand(StatefulProcessor):
    """M4's state machine of one demand. What is kept, the last transition and the last request, doesn't depend on the order of rows, so
    files that come in another order end in the same state."""

    def __init__(self, key: str) -> None:
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.demand = handle.getValueState("demand", "status string, status_at long, asked_at long, priority long, n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        status, status_at, asked_at, priority, n = self.demand.get() if self.demand.exists() else ("", -1, -1, 0, 0)
        for f in rows:
            at, to = f["row_at"].to_numpy(), f["row_status"].to_numpy(dtype=object)
            moves = np.array([isinstance(x, str) for x in to], dtype=bool)
            if not moves.all():
                asked_at, most = max(asked_at, int(at[~moves].max())), int(f["row_p"].to_numpy()[~moves].max())
                priority, n = max(priority, most) if n else most, n + int((~moves).sum())
            if moves.any():
                latest = int(at[moves].max())
                status_at, status = max((status_at, status), (latest, max(to[moves & (at == latest)])))
        self.demand.update((status, status_at, asked_at, priority, n))
        if n:  # a demand begins with a request
            queued = not status or (status in AGAIN and asked_at > status_at)
            yield pd.DataFrame({self.key: [key[0]], "status": ["queued" if queued else status], "priority": [priority], "demand_count": [n], "last_seen_at": np.array([asked_at], dtype="datetime64[us]")})

    def close(self) -> None:
        pass


def demand_state(stream: DataFrame, key: str, at: str, priority: str, status: str | None = None) -> DataFrame:
    """M4 on a stream: (key, status, priority, demand_count, last_seen_at) after every batch that touches the demand, in update mode.
    Rows with a ``status`` are transitions, the others requests; a request after a failed, published or unresolved state queues the
    demand again, and the latest transition (of equal times the last name) is the state otherwise."""
    to = F.lit(None).cast("string") if status is None else F.col(status)
    rows = stream.select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("row_at"), F.coalesce(F.col(priority), F.lit(0)).cast("long").alias("row_p"), to.alias("row_status"))
    return rows.groupBy(key).transformWithStateInPandas(_Demand(key), f"{key} {dict(stream.dtypes)[key]}, {DEMAND}", "Update", "None")


class _Groups(StatefulProcessor):
    """Rows of a key in groups: closed when ``most`` rows are there, or by a timer ``wait`` milliseconds after the first row, or after
    the last one where ``idle``. Rows of a batch are taken in order of time, so where batches end changes nothing."""

    def __init__(self, key: str, most: int, wait: int, idle: bool) -> None:
        self.key, self.most, self.wait, self.idle = key, most, wait, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.group = handle.getValueState("group", "opened long, last long, n long")

    def _due(self, opened: int, last: int) -> int:
        return (last if self.idle else opened) + self.wait

    def _closed(self, key: Any, groups: list[tuple[int, int, int, str]]) -> Iterator[pd.DataFrame]:
        """Groups of a key (opened, closed, n, reason) as one frame: a frame a group would cost more than the groups."""
        if groups:
            opened, closed, n, reason = zip(*groups)
            yield pd.DataFrame({self.key: [key[0]] * len(n), "opened_at": np.array(opened, dtype="datetime64[ms]"), "closed_at": np.array(closed, dtype="datetime64[ms]"), "n": n, "reason": reason})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.group.get() if self.group.exists() else None
        if held is not None:
            self.handle.deleteTimer(self._due(held[0], held[1]))
        at = np.sort(np.concatenate([f["row_ms"].to_numpy(dtype=np.int64) for f in rows]))
        gaps = np.append(np.flatnonzero(np.diff(at) >= self.wait) + 1, len(at))  # where idle groups end
        closed, i = [], 0
        while i < len(at):
            if held is not None and at[i] >= self._due(held[0], held[1]):
                closed.append((held[0], self._due(held[0], held[1]), held[2], "waited"))
                held = None
            opened, n = (int(at[i]), 0) if held is None else (held[0], held[2])
            end = int(gaps[np.searchsorted(gaps, i, side="right")] if self.idle else np.searchsorted(at, opened + self.wait))
            end = min(end, i + self.most - n) if self.most else end
            held = (opened, int(at[end - 1]), n + end - i)
            i = end
            if held[2] == self.most:
                closed.append((opened, held[1], held[2], "full"))
                held = None
        if held is None:
            self.group.clear()
        else:
            self.group.update(held)
            self.handle.registerTimer(self._due(held[0], held[1]))
        yield from self._closed(key, closed)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.group.exists():
            opened, last, n = self.group.get()
            if self._due(opened, last) <= expiredTimerInfo.getExpiryTimeInMs():
                self.group.clear()
                yield from self._closed(key, [(opened, self._due(opened, last), n, "waited")])

    def close(self) -> None:
        pass


def _grouped(stream: DataFrame, key: str, at: str, most: int, seconds: int, idle: bool, delay: str) -> DataFrame:
    rows = stream.withWatermark(at, delay).select(key, at, F.unix_millis(F.col(at)).alias("row_ms"))
    schema = f"{key} {dict(stream.dtypes)[key]}, opened_at timestamp, closed_at timestamp, n long, reason string"
    return rows.groupBy(key).transformWithStateInPandas(_Groups(key, most, seconds * 1000, idle), schema, "Append", "EventTime")


def ready_groups(stream: DataFrame, key: str, at: str, rows: int = 32, seconds: int = 15, delay: str = "1 second") -> DataFrame:
    """T2, T3 in the stream: (key, opened_at, closed_at, n, reason): pending rows of a key go on as soon as ``rows`` are there (``full``), or by an
    event-time timer when the oldest has waited ``seconds`` (``waited``)."""
    return _grouped(stream, key, at, rows, seconds, False, delay)


def idle_keys(stream: DataFrame, key: str, at: str, seconds: int, delay: str = "1 second") -> DataFrame:
    """T9 in the stream: (key, opened_at, closed_at, n, reason): a key's state is dropped ``seconds`` after its last row, and it begins anew."""
    return _grouped(stream, key, at, 0, seconds, True, delay)


def lease_timeouts(stream: DataFrame, key: str, at: str, minutes: int, delay: str = "1 minute") -> DataFrame:
    """(key, expired_at, attempts) when a task's heartbeat has been silent for ``minutes`` of event time; a
    task that has expired five times is ``failed``, else ``retry``."""
    kind = dict(stream.dtypes)[key]

    def step(k: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, attempts = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            attempts += 1
            state.update((last, attempts))
            yield pd.DataFrame({key: [k[0]], "expired_at": [last + minutes * 60_000], "attempts": [attempts], "status": ["failed" if attempts >= 5 else "retry"]})
            return
        for f in frames:
            last = max(last, int(f["_ms"].max()))
        state.update((last, attempts))
        due = last + minutes * 60_000
        if due > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(due)

    rows = stream.withWatermark(at, delay).select(key, at, F.unix_millis(F.col(at)).alias("_ms"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, expired_at long, attempts long, status string", "last long, attempts long", "append", GroupStateTimeout.EventTimeTimeout)


def hourly_outcomes(stream: DataFrame, at: str, outcome: str, delay: str = "1 hour") -> DataFrame:
    """(hour, outcome, n) tumbling, for batch and stream frames."""
    rows = stream.withWatermark(at, delay) if stream.isStreaming else stream
    out = rows.groupBy(F.window(at, "1 hour"), outcome).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("hour"), outcome, "n")
