"""Stateful gates: recrawl gate, already-seen filter, alerts on silence, download quota.

The recrawl gate decides each event from the last one it let through, which no aggregate can express; its state
is one time per URL (RocksDB state store). The rows of a URL in a micro-batch are put in time order first, so verdicts do not
depend on how they arrive in chunks; what is held are their ids and times. A row that comes late, behind an event let
through, is a recent repeat.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.operators import bloom
from tidemark.operators.quota import running_quota, success_bytes
from tidemark.operators.scope import bypasses_quota
from tidemark.streaming.intake import each_batch, write_batch
from tidemark.streaming.versions import KeyedState

# Rows of a held bucket that are given out as one frame.
HELD_AT_ONCE = 10_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class RecrawlGate(StatefulProcessor):
    """Lets a URL through if it was let through no less than ``interval_seconds`` ago; forgets it after that time."""

    def __init__(self, interval_seconds: int):
        self.interval_seconds = interval_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat([chunk[["event_id", "ts"]] for chunk in rows]).sort_values(["ts", "event_id"], ignore_index=True)
        times = batch["ts"]
        gap = timedelta(seconds=self.interval_seconds)
        state = self.last.get()
        last = pd.Timestamp(state[0]) if state is not None else None
        passed = np.zeros(len(batch), dtype=bool)
        # from one event let through straight to the next
        at = 0 if last is None else int(times.searchsorted(last + gap))
        while at < len(batch):
            passed[at] = True
            last = times[at]
            at = int(times.searchsorted(last + gap)) if self.interval_seconds else at + 1
        yield pd.DataFrame({"event_id": batch["event_id"], "urlkey": key[0], "passed": passed})
        if passed.any():
            self.last.update((last.to_pydatetime(),))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(last.timestamp() * 1000) + self.interval_seconds * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def recrawl_gate(events: DataFrame, interval_seconds: int) -> DataFrame:
    """(event_id, urlkey, passed) for a stream with ``event_id``, ``urlkey``, ``ts`` (zoned).

    The watermark is as far behind as the gate's own memory, so only rows late by more than that whole interval get no verdict;
    a URL is forgotten one interval after that.
    """
    return (
        events.withWatermark("ts", f"{interval_seconds} seconds")
        .groupBy("urlkey")
        .transformWithStateInPandas(
            RecrawlGate(interval_seconds),
            outputStructType="event_id bigint, urlkey string, passed boolean",
            outputMode="append",
            timeMode="EventTime",
        )
    )


class SeenFilter(StatefulProcessor):
    """Lets each key through once; what it remembers is a Bloom filter of fixed size, one state entry per touched block."""

    def __init__(self, shape: bloom.Shape, key: str):
        self.shape, self.key_column = shape, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocks = handle.getMapState("blocks", "block bigint", "bits binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for chunk in rows:
            chunk = chunk.drop_duplicates(self.key_column)
            new = np.zeros(len(chunk), dtype=bool)
            found = bloom.places(chunk["a"].to_numpy(), chunk["b"].to_numpy(), self.shape.hashes)
            block_of = chunk["block"].to_numpy()
            for block in np.unique(block_of).tolist():
                mine = np.flatnonzero(block_of == block)
                bits = bloom.unpacked(bytes(self.blocks.getValue((block,))[0]) if self.blocks.containsKey((block,)) else None)
                new[mine] = bloom.add_to(bits, found[mine])
                if new[mine].any():
                    self.blocks.updateValue((block,), (bloom.packed(bits),))
            yield chunk.loc[new, [self.key_column]]

    def close(self) -> None:
        pass


def first_seen_bounded(stream: DataFrame, key: str, shape: bloom.Shape, shards: int = 64) -> DataFrame:
    """The stream's keys, each once, with a memory of fixed size: ``shape.bytes`` at most, however long the stream runs.

    No key comes twice; a new key is missed at the shape's rate at most. Rows are dealt by hash range into ``shards``, each of which
    keeps the blocks of its range and changes only those a batch touches. Null keys are left out.
    """
    shards = min(shards, shape.blocks)
    block = shape.block(key)
    rows = stream.where(F.col(key).isNotNull()).select(key, block.alias("block"), bloom.marks(key).alias("m"))
    rows = rows.select(key, "block", "m.*", F.floor(F.col("block") * shards / shape.blocks).alias("shard"))
    kind = stream.schema[key].dataType.simpleString()
    return rows.groupBy("shard").transformWithStateInPandas(
        SeenFilter(shape, key), outputStructType=f"`{key}` {kind}", outputMode="append", timeMode="None"
    )


class SilenceAlerts(StatefulProcessor):
    """Alerts per series on a trailing sum that stays under a bound; closed steps without a row count as 0.

    Steps are closed by the watermark. A timer stands at the end of the next step, so that steps pass and alerts
    fire also while a series has no rows at all.
    """

    def __init__(self, step: int, window_steps: int, below: int, hold: int):
        self.step, self.window_steps, self.below, self.hold = step, window_steps, below, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "at bigint", "n bigint")
        self.place = handle.getValueState("place", "next bigint, since bigint, samples bigint, fired boolean")

    def _advance(self, key: tuple, counts: dict[int, int], closed: int) -> list[tuple]:
        """Go through the steps that end at ``closed`` or before; rows (series, state, since, reached, samples)."""
        state = self.place.get()
        at, since, samples, fired = state if state is not None else (min(counts), None, 0, False)
        out = []
        last = closed // self.step * self.step - self.step  # start of the last closed step
        while at <= last:
            trailing = sum(counts.get(at - i * self.step, 0) for i in range(self.window_steps))
            run = 1
            if not trailing and fired:
                # nothing changes until the next step with a row
                ahead = min((c for c in counts if c > at), default=last + self.step)
                run = (min(ahead, last + self.step) - at) // self.step
            if trailing < self.below:
                since = at if since is None else since
                samples += run
                if not fired and at - since >= self.hold:
                    fired = True
                    out.append((*key, "firing", since, at, samples))
            else:
                if fired:
                    out.append((*key, "resolved", since, at - self.step, samples))
                since, samples, fired = None, 0, False
            at += run * self.step
        for old in [c for c in counts if c <= at - self.window_steps * self.step]:
            self.counts.removeKey((old,))
        self.place.update((at, since, samples, fired))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((at + self.step) * 1000)
        return out

    def _rows(self, found: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(found, columns=["series", "state", "since", "reached", "samples"])
        return out.assign(since=pd.to_datetime(out["since"], unit="s"), reached=pd.to_datetime(out["reached"], unit="s"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for chunk in rows:
            for at, n in zip(chunk["at"].tolist(), chunk["n"].tolist(), strict=True):
                known = self.counts.getValue((at,))[0] if self.counts.containsKey((at,)) else 0
                self.counts.updateValue((at,), (known + n,))
        yield self._rows(self._pass(key, timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._rows(self._pass(key, timerValues))

    def _pass(self, key, timerValues) -> list[tuple]:
        counts = {k[0]: v[0] for k, v in self.counts.iterator()}
        return self._advance(key, counts, timerValues.getCurrentWatermarkInMs() // 1000)

    def close(self) -> None:
        pass


def silence_alerts(
    events: DataFrame, ts: str, series: Column, watched: Column, delay: str, step_seconds: int = 3600, window_steps: int = 4,
    below: int = 10, hold_seconds: int = 3600,
) -> DataFrame:
    """(series, state, since, reached, samples): alerts while the stream runs, from counts per step of the rows that are ``watched``.

    A series is low at a step if it has fewer than ``below`` rows in that step and the ``window_steps - 1`` before it, the first row of
    the series being its begin. ``firing`` comes as soon as it has been low for ``hold_seconds`` (``reached``: that step), ``resolved`` after
    the last low step (``reached``: that step). Time is that of all events, watched or not: the watermark closes steps. A null series counts
    as an empty name.
    """
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    window = F.window(ts, f"{step_seconds} seconds")
    # unwatched rows go as far as the counts: a filter would be pushed below the watermark, and time would stand still with a silent series
    named = F.when(watched, F.coalesce(series.cast("string"), F.lit("")))
    counts = timed.groupBy(window.alias("w"), named.alias("series")).agg(F.count_if(watched).alias("n")).where("n > 0")
    steps = counts.select("series", F.window_time("w").alias("closed"), F.unix_timestamp("w.start").alias("at"), "n")
    return steps.groupBy("series").transformWithStateInPandas(
        SilenceAlerts(step_seconds, window_steps, below, hold_seconds),
        outputStructType="series string, state string, since timestamp, reached timestamp, samples bigint",
        outputMode="append",
        timeMode="EventTime",
    )


class HeldBuckets(StatefulProcessor):
    """Keeps the rows of a (key, time bucket) until the watermark has passed the bucket, then gives them out together.

    The rows of a chunk are one state value, column by column: a value per row would pass the state store's socket one by one.
    """

    def __init__(self, columns: list[str], whole: list[str], bucket_seconds: int):
        self.columns, self.whole, self.bucket_seconds = columns, whole, bucket_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getListState("chunks", "held binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for chunk in rows:
            # whole numbers beside nulls arrive as floats
            plain = chunk[self.columns].astype(dict.fromkeys(self.whole, "Int64")).astype(object)
            plain = plain.where(plain.notna(), None)
            self.chunks.appendValue((pickle.dumps([plain[c].tolist() for c in self.columns], protocol=5),))
        if not list(self.handle.listTimers()):
            self.handle.registerTimer((key[1] + 1) * self.bucket_seconds * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = []
        for (chunk,) in self.chunks.get():
            held.extend(zip(*pickle.loads(bytes(chunk)), strict=True))
            while len(held) >= HELD_AT_ONCE:
                yield self._frame(held[:HELD_AT_ONCE])
                held = held[HELD_AT_ONCE:]
        if held:
            yield self._frame(held)
        self.chunks.clear()

    def _frame(self, held: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(held, columns=self.columns).astype(dict.fromkeys(self.whole, "Int64"))

    def close(self) -> None:
        pass


def held_until_closed(stream: DataFrame, key: str, ts: str, delay: str, bucket_seconds: int) -> DataFrame:
    """The stream's rows, each given out when its (key, time bucket) is closed: rows up to ``delay`` late are with the others of their time.

    Later rows are dropped. All buckets of a key come in order over the batches. ``ts`` becomes a zoned time; a busy key is spread over its
    buckets. Null keys and times are left out.
    """
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    # times travel as microseconds, so that state hangs on no time zone; names that begin with an underscore would be lost on the way
    columns = [c for c in timed.columns if c != ts] + ["held_micros"]
    bucket = F.floor(F.unix_micros(ts) / (bucket_seconds * 1_000_000))
    rows = timed.withWatermark(ts, delay).withColumns({"held_micros": F.unix_micros(ts), "held_bucket": bucket})
    held = rows.select(*columns).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held)
    whole = [c for c in columns if isinstance(held[c].dataType, T.IntegralType)]
    given = rows.groupBy(key, "held_bucket").transformWithStateInPandas(
        HeldBuckets(columns, whole, bucket_seconds), outputStructType=schema, outputMode="append", timeMode="EventTime"
    )
    return given.withColumn(ts, F.timestamp_micros("held_micros").cast("timestamp_ntz")).drop("held_micros").select(*stream.columns)


QUOTA_STATE = T.StructType([T.StructField("host", T.StringType()), T.StructField("used", T.LongType())])


def quota_gate(
    stream: DataFrame, max_kb: int, output: str, state: str, checkpoint: str, available_now: bool = False,
    bucket_seconds: int = 3600, delay: str | None = None,
) -> StreamingQuery:
    """Running quota over a stream with ``event_id``, ``host``, ``ts``, ``status_code``, ``size``, ``hop_path``, ``launched``.

    A batch is worked off with the batch operator, which splits a busy server by time bucket; the bytes a server has used since its last
    launch are carried from batch to batch, and a batch writes those of the servers it has rows of. With ``delay`` rows are held
    until their time bucket is closed, so rows that are late by less get the verdict of their place in time, and so do the rows after
    them. Without it a server's events must come in time order over batches. Repeating a batch gives the same result.
    """
    carried_state = KeyedState(state, ["host"], QUOTA_STATE)

    def work(batch: DataFrame, batch_id: int) -> None:
        # the running quota reads its rows twice; rows out of held state are made once
        batch = batch.persist() if delay else batch
        rows = running_quota(
            batch, "host", "ts", "event_id", "status_code", "size", "hop_path", "launched", max_kb=-1,
            bucket_seconds=bucket_seconds,
        ).persist()
        carried = carried_state.read(batch.sparkSession, batch_id)
        # only rows before the batch's first launch of a server go on from the carried bytes
        total = F.when(F.col("launch_no") == 0, F.coalesce("used", F.lit(0))).otherwise(F.lit(0)) + F.col("used_bytes")
        judged = rows.join(carried, "host", "left").withColumn("used_bytes", total)
        full = F.lit(False) if max_kb < 0 else F.col("used_bytes") >= F.lit(max_kb * 1024)
        write_batch(
            judged.select("event_id", "host", "used_bytes", (full & ~bypasses_quota("hop_path")).alias("capped")),
            output,
            batch_id,
        )
        per_launch = rows.groupBy("host", "launch_no").agg(F.sum(success_bytes("status_code", "size")).alias("_sum"))
        newest = per_launch.groupBy("host").agg(F.max_by(F.struct("launch_no", "_sum"), F.col("launch_no")).alias("_l"))
        before = F.when(F.col("_l")["launch_no"] == 0, F.coalesce("used", F.lit(0))).otherwise(F.lit(0))
        after = newest.join(carried, "host", "left").select("host", (F.col("_l")["_sum"] + before).alias("used"))
        carried_state.write(after, batch_id)
        rows.unpersist()
        if delay:
            batch.unpersist()

    held = held_until_closed(stream, "host", "ts", delay, bucket_seconds) if delay else stream
    return each_batch(held, work, checkpoint, available_now)
