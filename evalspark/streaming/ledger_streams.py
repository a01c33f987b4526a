"""The ledger as a stream: ingest, dedupe, balances, windows, sessions, pairing and task states.

Functions that transform take and return a streaming DataFrame; the ``write_*`` functions start a
query that processes everything available and then stops. State is bounded by a watermark where
the result allows it.

Results that are still open - windows, sessions, prompts without a completion - come out at once and again whenever they
change: ``write_upserts`` keeps every batch in a folder of its own, so a repeated batch replaces itself, and
``read_upserts`` gives the newest row per key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evalspark.operators.ledger import DATASET_EPSILON, dedupe_latest
from evalspark.plans.keyed import add_missing


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _run(spark: SparkSession, writer) -> None:
    """Start the query with state on disk, which transformWithState needs and long keys are better off with, and wait for its end."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        query = writer.trigger(availableNow=True).start()  # takes its settings along
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
    query.awaitTermination()


def write_append(df: DataFrame, path: str, checkpoint: str) -> None:
    """Append finished rows to a parquet folder, exactly once through the file sink's log."""
    _run(df.sparkSession, df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint))


def write_upserts(df: DataFrame, path: str, checkpoint: str) -> None:
    """Write the rows that each batch makes or changes; a repeated batch replaces its own folder."""

    def load(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={number}")

    _run(df.sparkSession, df.writeStream.outputMode("update").foreachBatch(load).option("checkpointLocation", checkpoint))


def read_upserts(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The newest row of each key: one aggregate with partial maxima in every task."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).option("basePath", path).parquet(path)
    others = [f.name for f in schema.fields if f.name not in keys]
    newest = rows.groupBy(*keys).agg(F.max(F.struct("batch_id", *others)).alias("newest"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"newest.{c}").alias(c) for c in schema.fieldNames()])


def write_complete(df: DataFrame, path: str, checkpoint: str) -> None:
    """Replace a small result table by the complete result of every batch."""

    def replace(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = (
        df.writeStream.outputMode("complete")
        .foreachBatch(replace)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stream_ingest(events: DataFrame, target: str, checkpoint: str, key: str = "event_id") -> None:
    """Load new events into a parquet table partitioned by event date, each id once.

    A batch only reads the ids of the dates it holds, and a repeated batch adds nothing, so a
    restart after a failure is safe.
    """

    def load(batch: DataFrame, _epoch: int) -> None:
        spark = batch.sparkSession
        dated = dedupe_latest(batch, key, ["ingest_time"]).withColumn("event_date", F.to_date("event_time"))
        try:
            # joined on the partition column, so that only the partitions of the batch's dates are read
            known = spark.read.schema(dated.schema).parquet(target).join(dated.select("event_date").distinct(), "event_date", "left_semi")
            dated = add_missing(dated, known, [key])
        except Exception as error:  # the first batch has no target yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
        dated.write.mode("append").partitionBy("event_date").parquet(target)

    query = (
        events.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stream_dedupe(events: DataFrame, lateness: str = "1 hour", key: str = "event_id") -> DataFrame:
    """First arrival per id within the lateness; the batch form keeps the latest instead."""
    return events.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark([key])


def stream_trial_balance(postings: DataFrame) -> DataFrame:
    """Running net per account type and unit; the state is one row per slice."""
    return postings.groupBy("account_type", "unit").agg(
        F.sum("delta_numeric").alias("net"), F.count(F.lit(1)).alias("posting_count")
    )


def violations(balance: DataFrame, eps: float = DATASET_EPSILON) -> DataFrame:
    return balance.filter(F.abs("net") > eps)


def stream_kind_windows(
    events: DataFrame, length: str = "1 day", slide: str | None = None, lateness: str = "1 hour"
) -> DataFrame:
    """Kind counts per tumbling or sliding window: appended once a window is closed, upserted by window and kind before."""
    window = F.window("event_time", length, slide) if slide else F.window("event_time", length)
    counted = events.withWatermark("event_time", lateness).groupBy(window, "kind").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "kind", "n"
    )


class _Sessions(StatefulProcessor):
    """Open sessions of one key as (first, last event, events), times in microseconds; those out of the watermark's reach are forgotten."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, events long")

    def _keep(self, held: list[tuple], mark: int) -> None:
        kept = [one for one in held if one[1] + self.gap > mark * 1000]
        if kept:
            self.open.put(kept)
            self.handle.registerTimer(max(one[1] + self.gap for one in kept) // 1000 + 1)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        touched, gone = set(), set()
        for row in rows:
            first, last, events = row["micros"], row["micros"], 1
            apart = []
            for one in held:
                if one[0] - last >= self.gap or first - one[1] >= self.gap:
                    apart.append(one)
                else:  # within the pause on either side: one session
                    gone.add(one[0])
                    first, last, events = min(first, one[0]), max(last, one[1]), events + one[2]
            held = [*apart, (first, last, events)]
            touched.add(first)
        for first, last, events in sorted(held):
            if first in touched:
                yield Row(key=key[0], first=first, end=last + self.gap, events=events)
        for first in sorted(gone - {one[0] for one in held}):  # grew into a session with another start
            yield Row(key=key[0], first=first, end=first, events=0)
        self._keep(held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._keep([tuple(x) for x in self.open.get()] if self.open.exists() else [], expiredTimerInfo.getExpiryTimeInMs())
        return iter(())

    def close(self) -> None:
        pass


def _micros(interval: str) -> int:
    import pandas as pd

    return int(pd.Timedelta(interval).total_seconds() * 1_000_000)


def stream_sessions(events: DataFrame, key: str, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Upserts (by key and start) of sessions of activity per key, separated by pauses of at least ``gap``.

    A session comes out while it is open; one that merges into an earlier one comes out with no events, which
    ``sessions`` drops. The state of a key is its sessions within reach of the watermark, rows are folded one by one.
    """
    schema = T.StructType([T.StructField("key", events.schema[key].dataType), *[T.StructField(c, T.LongType()) for c in ("first", "end", "events")]])
    timed = events.select(key, "event_time", F.unix_micros("event_time").alias("micros")).withWatermark("event_time", lateness)
    found = timed.groupBy(key).transformWithState(_Sessions(_micros(gap)), schema, "Update", "EventTime")
    time = lambda c: F.timestamp_micros(c)
    return found.select(F.col("key").alias(key), time("first").alias("session_start"), time("end").alias("session_end"), "events")


def sessions(upserts: DataFrame) -> DataFrame:
    """The sessions there are, of the newest rows by key and start."""
    return upserts.filter("events > 0")


def stream_exchange_join(events: DataFrame, within: str = "2 hours", lateness: str = "1 hour") -> DataFrame:
    """Every prompt as it arrives, without completion, and every pair with a completion inside the time bound as it is found.

    Both are final rows, so nothing waits for the watermark; ``exchanges`` leaves out the first kind where there is the second.
    """
    timed = events.withColumn("exchange_id", F.get_json_object("payload_json", "$.exchange_id"))
    prompts = timed.filter(F.col("kind") == "model_prompt").select("exchange_id", F.col("event_id").alias("prompt_id"), F.col("event_time").alias("prompt_time"))
    done = (
        timed.filter(F.col("kind") == "model_completion")
        .select(
            F.col("exchange_id").alias("done_exchange"),
            F.col("event_id").alias("completion_id"),
            F.col("event_time").alias("completion_time"),
        )
        .withWatermark("completion_time", lateness)
    )
    cond = (
        (F.col("exchange_id") == F.col("done_exchange"))
        & (F.col("completion_time") >= F.col("prompt_time"))
        & (F.col("completion_time") <= F.col("prompt_time") + F.expr(f"interval {within}"))
    )
    columns = ["exchange_id", "prompt_id", "prompt_time", "completion_id", "completion_time"]
    pairs = prompts.withWatermark("prompt_time", lateness).join(done, cond).select(columns)
    alone = prompts.withColumn("completion_id", F.lit(None).cast("string")).withColumn("completion_time", F.lit(None).cast("timestamp"))
    return alone.select(columns).unionByName(pairs)


def exchanges(rows: DataFrame) -> DataFrame:
    """Prompts with each of their completions, or alone while they have none."""
    pairs = rows.filter("completion_id is not null")
    return rows.filter("completion_id is null").join(pairs.select("prompt_id"), "prompt_id", "left_anti").select(rows.columns).unionByName(pairs)


_MOVES = "task_id string, event_id string, micros long, from_state string, to_state string, verdict string"


class _TaskStates(StatefulProcessor):
    """Moves wait in the state by their time and are judged when the watermark passes it, so they are judged in time order.

    A timer fires per time of a move, and one when a task has been idle for long enough; a timer that is set for a time that the
    watermark has passed already fires with the next batch. What is held in memory is
    one row of the input, or the moves of one task in one millisecond.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long", "moves string")
        self.current = handle.getValueState("current", "state string, ended boolean, last long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for row in rows:
            if row["kind"] != "state_move":
                continue
            at = row["micros"] // 1000
            moves = json.loads(self.waiting.getValue((at,))[0]) if self.waiting.containsKey((at,)) else []
            moves.append([row["micros"], row["event_id"], row["from_state"], row["to_state"]])
            self.waiting.updateValue((at,), (json.dumps(moves),))
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        state, ended, last = self.current.get() if self.current.exists() else (None, False, None)
        if last is not None and now >= last + self.idle_ms:
            if not ended:
                yield Row(task_id=key[0], event_id=None, micros=None, from_state=state, to_state=None, verdict="timeout")
            state, ended, last = None, False, None
            self.current.clear()
        if not self.waiting.containsKey((now,)):
            return
        moves = sorted(json.loads(self.waiting.getValue((now,))[0]), key=lambda m: (m[0], m[1] or ""))
        self.waiting.removeKey((now,))
        for time, event_id, start, to in moves:
            if ended:
                verdict = "after_end"
            elif state is None and start != "NEW":
                verdict = "wrong_start"
            elif state is not None and start != state:
                verdict = "broken_chain"
            else:
                verdict = "legal"
            state, ended = to, ended or to in ("DONE", "FAILED")
            yield Row(task_id=key[0], event_id=event_id, micros=time, from_state=start, to_state=to, verdict=verdict)
        self.current.update((state, ended, now))
        self.handle.registerTimer(now + self.idle_ms)

    def close(self) -> None:
        pass


def stream_task_state(events: DataFrame, idle: str = "2 days", lateness: str = "1 hour", heartbeat: str = "heartbeat") -> DataFrame:
    """Verdict for every state move: legal, wrong start, broken chain, after the end; and timeouts.

    Moves come out in time order once the watermark has passed them. A task without a move for ``idle`` is reported as timed out
    unless it has ended, and starts anew with its next move.
    """
    # heartbeats move the watermark on where no task moves; Spark filters before it takes the watermark, so they pass the filter
    moves = events.withWatermark("event_time", lateness).filter(F.col("kind").isin("state_move", heartbeat)).select(
        "kind",
        F.col("actor_task_id").alias("task_id"),
        "event_id",
        "event_time",
        F.unix_micros("event_time").alias("micros"),
        F.get_json_object("payload_json", "$.from").alias("from_state"),
        F.get_json_object("payload_json", "$.to").alias("to_state"),
    )
    judged = moves.groupBy("task_id").transformWithState(_TaskStates(_micros(idle) // 1000), _MOVES, "Append", "EventTime")
    return judged.select("task_id", "event_id", F.timestamp_micros("micros").alias("event_time"), "from_state", "to_state", "verdict")


def late_data_report(events: DataFrame, allowed_minutes: int = 1) -> DataFrame:
    """Arrivals by delay, and how many came later than allowed; works on batches and streams."""
    delay = F.unix_timestamp("ingest_time") - F.unix_timestamp("event_time")
    bucket = (
        F.when(delay < 60, "<1m").when(delay < 120, "1-2m").when(delay < 180, "2-3m").otherwise(">=3m")
    )
    return events.groupBy(bucket.alias("delay_bucket")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(delay > allowed_minutes * 60).alias("late")
    )
