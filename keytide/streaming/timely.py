"""Streaming forms: keys reported in the micro-batch of their T-th row, with exact indexes."""

from __future__ import annotations

import itertools
import time
from collections import deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from keytide.operators import bias
from keytide.sources.streams import stops


class FirstRows:
    """What a key's state says, and what its new rows do to it: how many rows there were, the first, the T-th and the last place.

    Of the new rows only as many are held as are missing to the T-th, however many come at once. A row
    whose idx isn't over the last one of the batches before comes too late to be ordered and raises,
    unless ``late`` is "drop".
    """

    FIELDS = "n long, i0 long, it long, last long, ones long"

    def __init__(self, state, threshold: int, late: str):
        self.threshold, self.late = threshold, late
        self.n, self.i0, self.it, self.last, self.ones = state or (0, None, None, -1, 0)

    def add(self, name, frames: Iterator[pd.DataFrame]) -> int | None:
        """The T-th row's truth if it is among these rows."""
        need = max(0, self.threshold - self.n)
        held, before, least, most, rows = np.empty((0, 3), dtype=np.int64), self.last, None, self.last, 0
        for f in frames:
            new = f[["idx", "value", "truth"]].to_numpy(dtype=np.int64)
            late = new[:, 0] <= before
            if late.any():
                if self.late != "drop":
                    raise ValueError(f"key {name}: row {new[late][0, 0]} came after row {before}")
                new = new[~late]
            if not len(new):
                continue
            rows += len(new)
            least, most = min(int(new[:, 0].min()), most if least is None else least), max(most, int(new[:, 0].max()))
            held = np.concatenate([held, new])
            held = held[np.argsort(held[:, 0], kind="stable")[:need]]
        if not rows:
            return None
        if self.i0 is None:
            self.i0 = int(held[0, 0]) if need else least
        self.n, self.last, self.ones = self.n + rows, most, self.ones + int(held[:, 1].sum())
        if need and len(held) == need:
            self.it = int(held[-1, 0])
            return int(held[-1, 2])
        return None

    @property
    def state(self) -> tuple:
        return self.n, self.i0, self.it, self.last, self.ones


class ThresholdReporter(StatefulProcessor):
    """Counts a key's rows and reports it once, at its T-th."""

    def __init__(self, threshold: int, most_ones: int | None = None, late: str = "raise"):
        self.threshold, self.most_ones, self.late = threshold, most_ones, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("seen", FirstRows.FIELDS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = FirstRows(self.state.get() if self.state.exists() else None, self.threshold, self.late)
        truth, out = now.add(key[0], rows), []
        if truth is not None:
            biased = None if self.most_ones is None else now.ones <= self.most_ones
            out.append((key[0], now.i0, now.it, now.it - now.i0, now.ones, biased, truth))
        if now.n:
            self.state.update(now.state)
        yield pd.DataFrame(out, columns=["key", "i0", "it", "lifetime", "ones", "biased", "truth"])

    def close(self) -> None:
        pass


#: Event time is the place in the stream, a millisecond a row; a sender's STOP lies beyond all places. As pandas
#: has no later years than 2262, a stream with delayed reports has at most so many rows.
END = 9_000_000_000_000


class DelayedReporter(StatefulProcessor):
    """Reports a key once its place of report, under a policy, lies behind the watermark; a timer of the key waits for it."""

    def __init__(self, threshold: int, policy: str, alpha: float, chunk: int, late: str):
        self.threshold, self.policy, self.alpha, self.chunk, self.late = threshold, policy, alpha, chunk, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", FirstRows.FIELDS)

    def due(self, i0: int, it: int) -> int:
        if self.policy == "time":
            return it + int((it - i0) * self.alpha)
        return (it // self.chunk + 1) * self.chunk - 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = FirstRows(self.state.get() if self.state.exists() else None, self.threshold, self.late)
        rows = (f[f["idx"] < END] for f in rows)  # a STOP only moves the watermark
        if now.add(key[0], rows) is not None:
            self.handle.registerTimer(self.due(now.i0, now.it) + 1)
        if now.n:
            self.state.update(now.state)
        yield pd.DataFrame({"key": [], "i0": [], "it": [], "due": [], "swept": []}).astype({"key": "int64", "i0": "int64", "it": "int64", "due": "int64", "swept": "bool"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, i0, it, _, _ = self.state.get()
        yield pd.DataFrame({"key": [key[0]], "i0": [i0], "it": [it], "due": [self.due(i0, it)], "swept": [timerValues.getCurrentWatermarkInMs() >= END]})

    def close(self) -> None:
        pass


def closing(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of ``folder`` in which ``close_when_all_stopped`` tells that all senders have stopped."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return spark.readStream.schema("closed long").parquet(folder)


def with_closing(stream: DataFrame, closed: DataFrame) -> DataFrame:
    """One sender's ``stream`` (idx, key, value, truth), and a STOP for the rows of ``closed``."""
    stop = closed.select(F.lit(END).alias("idx"), F.lit(0).cast("long").alias("key"), F.lit(0).alias("value"), F.lit(0).alias("truth"))
    return stream.select("idx", "key", "value", "truth").unionByName(stop)


def delayed(senders: list[DataFrame], threshold: int, policy: str, alpha: float = 1.0, chunk: int = 1024, late: str = "raise") -> DataFrame:
    """A streaming (key, i0, it, due, swept) of keys that reached the threshold, each told at its place of report or later.

    ``time``: ``due`` is the last place that keeps the stretch of time within 1 + alpha. ``count``: it is
    the end of the key's chunk of rows. Each sender's stream has its own watermark, of which the least
    counts. A STOP (``with_closing``) puts them all beyond all places: what still waits is told then,
    with ``swept``. State, timers and the least watermark are part of the checkpoint; after a restart
    the watermark moves on once every sender was heard again, or by the STOP.
    """
    if policy not in ("time", "count"):
        raise ValueError("a delayed report is bounded in time or in count")
    spark = senders[0].sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "min")
    timed = [s.withColumn("at", F.timestamp_millis(F.col("idx") + 1)).withWatermark("at", "0 seconds") for s in senders]  # what lies at the watermark counts as late
    return reduce(DataFrame.unionByName, timed).groupBy("key").transformWithStateInPandas(
        statefulProcessor=DelayedReporter(threshold, policy, alpha, chunk, late),
        outputStructType="key long, i0 long, it long, due long, swept boolean",
        outputMode="Append",
        timeMode="EventTime",
    )


def settled(told: DataFrame, last: int) -> DataFrame:
    """(key, report_idx, via) of what ``delayed`` told of a stream whose last place is ``last``: what was due later is swept there."""
    late = F.col("due") > last
    return told.select("key", F.when(late, last).otherwise(F.col("due")).alias("report_idx"), F.when(late, "sweep").otherwise("timer").alias("via"))


def live_counts(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """(key, count, i0, it, last) of all keys in the state of a query of ``report`` or ``delayed``, after its last or the given batch.

    It is read from the checkpoint while the query runs: each partition of the state is a task.
    """
    reader = spark.read.format("statestore").option("stateVarName", "seen")
    if batch is not None:
        reader = reader.option("batchId", batch)
    return reader.load(checkpoint).select("key.key", F.col("value.n").alias("count"), "value.i0", "value.it", "value.last")


def live_point_query(spark: SparkSession, checkpoint: str, keys: DataFrame, batch: int | None = None) -> DataFrame:
    """(key, count, report_idx) of the wanted keys as the running query knows them: 0 and null for one that never came."""
    wanted = keys.select("key").distinct()
    known = live_counts(spark, checkpoint, batch).select("key", "count", F.col("it").alias("report_idx"))
    return wanted.join(known, "key", "left").select("key", F.coalesce("count", F.lit(0)).alias("count"), "report_idx")


class StoredTable:
    """A table in order of use, as ``bias`` keeps them, whose entries are state: what a batch doesn't touch is neither read nor written.

    An entry knows the place of its last use. A list of all uses in order tells the oldest entry: the
    first use that is still its key's last. Used up and outdated ones are cut off once they are half of the list.
    """

    def __init__(self, entries, uses, size: int = 0, head: int = 0, length: int = 0):
        self.entries, self.uses, self.size, self.head, self.length = entries, uses, size, head, length
        self.touched: dict[int, tuple | None] = {}
        self.new: list[tuple[int, int]] = []
        self.place = -1  # of the row at hand
        self.old = None  # uses before this batch, from the head on

    def __len__(self) -> int:
        return self.size

    def entry(self, key: int) -> tuple | None:
        if key not in self.touched:
            self.touched[key] = self.entries.getValue((key,))
        return self.touched[key]

    def pop(self, key: int, default: tuple) -> tuple:
        found = self.entry(key)
        if found is None:
            return default
        self.touched[key] = None
        self.size -= 1
        return found[1:]

    def __setitem__(self, key: int, value: tuple) -> None:
        self.touched[key] = (self.place, *value)
        self.new.append((self.place, key))
        self.size += 1

    def use(self, k: int) -> tuple:
        """The k-th use from the head this batch began with."""
        if self.old is None:
            self.old = itertools.islice(self.uses.get(), self.head, None)
        return next(self.old) if k < self.length else self.new[k - self.length]

    def popitem(self, last: bool = False) -> None:
        while True:
            place, key = self.use(self.head)
            self.head += 1
            found = self.entry(key)
            if found is not None and found[0] == place:
                self.touched[key] = None
                self.size -= 1
                return

    def save(self) -> tuple[int, int, int]:
        """Writes what was touched; (size, head, length) for the next batch."""
        for key, value in self.touched.items():
            if value is not None:
                self.entries.updateValue((key,), value)
            elif self.entries.containsKey((key,)):
                self.entries.removeKey((key,))
        if 2 * self.head > self.length + len(self.new):
            rest = [*itertools.islice(self.uses.get(), self.head, None), *self.new] if self.head < self.length else self.new[self.head - self.length :]
            self.uses.put(rest) if rest else self.uses.clear()
            return self.size, 0, len(rest)
        if self.new:
            self.uses.appendList(self.new)
        return self.size, self.head, self.length + len(self.new)


class BoundedTables(StatefulProcessor):
    """Judges keys of one shard in a bounded table, in order of idx; with ``outer`` its rows are parts of outer keys.

    Rows whose idx isn't over the last one of their shard raise, unless ``late`` is "drop".
    """

    def __init__(self, capacity: int, threshold: int, most_ones: int, outer: bool, late: str = "raise"):
        self.capacity, self.threshold, self.most_ones, self.outer, self.late = capacity, threshold, most_ones, outer, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.meta = handle.getValueState("meta", "last long, a0 long, a1 long, a2 long, b0 long, b1 long, b2 long")
        self.states = [(handle.getMapState(f"{n}_entries", "key long", "place long, x long, y long"), handle.getListState(f"{n}_uses", "place long, key long")) for n in ("outer", "inner")]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, *sizes = self.meta.get() if self.meta.exists() else (-1, 0, 0, 0, 0, 0, 0)
        outer, inner = bias.OuterTable(self.capacity), bias.BiasTable(self.capacity, self.threshold, self.most_ones)
        outer.live, inner.live = (StoredTable(*states, *sizes[3 * k : 3 * k + 3]) for k, states in enumerate(self.states))
        names = ["idx", "okey", "val", "cnt"] if self.outer else ["idx", "key", "value", "truth"]
        out = []
        for idx, *what in pd.concat([f[names] for f in rows]).sort_values("idx", kind="stable").itertuples(index=False):
            if idx <= last:
                if self.late == "drop":
                    continue
                raise ValueError(f"shard {key[0]}: row {idx} came after row {last}")
            last = outer.live.place = inner.live.place = int(idx)
            made = outer.part(int(what[0]), what[1], int(what[2])) if self.outer else (int(what[0]), int(what[1]), int(what[2]))
            if made and (judged := inner.row(*made)):
                out.append((made[0], last, judged[0], made[2], judged[1]))
        self.meta.update((last, *outer.live.save(), *inner.live.save()))
        yield pd.DataFrame(out, columns=["key", "idx", "ones", "truth", "label"])

    def close(self) -> None:
        pass


#: State variables and timers need this provider.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def report(stream: DataFrame, threshold: int, most_ones: int | None = None, late: str = "raise") -> DataFrame:
    """A streaming (key, i0, it, lifetime, ones, biased, truth) of ``stream`` (idx, key, value, truth)."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream.groupBy("key").transformWithStateInPandas(
        statefulProcessor=ThresholdReporter(threshold, most_ones, late),
        outputStructType="key long, i0 long, it long, lifetime long, ones long, biased boolean, truth int",
        outputMode="Append",
        timeMode="None",
    )


def bounded_bias(stream: DataFrame, capacity: int, shards: int, threshold: int = bias.T_DEFAULT, most_ones: int = bias.M_DEFAULT, late: str = "raise") -> DataFrame:
    """A streaming (key, idx, ones, truth, label) of keys judged in a bounded table for each shard (key modulo ``shards``)."""
    return _bounded(stream, "key", capacity, shards, threshold, most_ones, late)


def two_level_bias(parts: DataFrame, capacity: int, shards: int, threshold: int = bias.T_DEFAULT, most_ones: int = bias.M_DEFAULT, late: str = "raise") -> DataFrame:
    """The same for inner keys put together from a stream of parts (idx, okey, val, cnt), both tables bounded, sharded by outer key."""
    return _bounded(parts, "okey", capacity, shards, threshold, most_ones, late)


def _bounded(stream: DataFrame, by: str, capacity: int, shards: int, threshold: int, most_ones: int, late: str) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream.withColumn("shard", F.pmod(by, F.lit(shards)).cast("int")).groupBy("shard").transformWithStateInPandas(
        statefulProcessor=BoundedTables(capacity, threshold, most_ones, by == "okey", late),
        outputStructType="key long, idx long, ones long, truth int, label string",
        outputMode="Append",
        timeMode="None",
    )


def running_counts(stream: DataFrame) -> DataFrame:
    """A streaming (key, count) in update mode, by built-in aggregation."""
    return stream.groupBy("key").agg(F.count("*").alias("count"))


class Throughput(StreamingQueryListener):
    """Collects (rows so far, epoch milliseconds) of the last micro-batches; add with ``spark.streams.addListener``."""

    def __init__(self, most: int = 10_000):
        self.series: deque[tuple[int, int]] = deque(maxlen=most)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        rows = (self.series[-1][0] if self.series else 0) + event.progress.numInputRows
        self.series.append((rows, int(time.time() * 1000)))

    def onQueryTerminated(self, event) -> None:
        pass


def stopped_in_state(packets: DataFrame) -> DataFrame:
    """A streaming (sender, packets) of the senders that have sent STOP, in complete mode; who has is part of the checkpoint."""
    return stops(packets).groupBy("sender").agg(F.count("*").alias("packets"))


def close_when_all_stopped(folder: str, senders: int):
    """A ``foreachBatch`` function for ``stopped_in_state`` that tells a ``closing`` stream once all senders have stopped.

    A batch that is repeated tells it again, which changes nothing.
    """

    def run(batch: DataFrame, _: int) -> None:
        if batch.limit(senders).count() >= senders:
            batch.sparkSession.range(1).select(F.col("id").alias("closed")).write.mode("append").parquet(folder)

    return run


def stop_when_all_stopped(spark: SparkSession, query_name: str, senders: int):
    """A ``foreachBatch`` function for ``stopped_in_state`` that stops the named query of the session once all senders have stopped."""

    def run(batch: DataFrame, _: int) -> None:
        if batch.limit(senders).count() >= senders:
            for q in spark.streams.active:
                if q.name == query_name:
                    q.stop()

    return run
