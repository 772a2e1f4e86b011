"""Stateful operators on streams: clusters of close peaks, and a causal filter that carries its state from batch to batch.

Both give what a batch over the same rows gives, however the stream is cut into micro-batches. State lives in Spark's state
store (RocksDB, which such operators need), one entry a key, and survives restarts from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from wavelake.functions import dsp
from wavelake.session import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ready(spark: SparkSession) -> None:
    """Set the state store that these operators need."""
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class PeakClusters(StatefulProcessor):
    """Peaks wait until the watermark has passed them, so they are met in order of time; a cluster is given out once, when it can grow no more."""

    def __init__(self, gap_ms: int, least_ms: int):
        self.gap, self.least = gap_ms, least_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint")
        self.open = handle.getValueState("open", "first bigint, last bigint, n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [int(v) for part in rows for v in part["at"]]
        if new:
            self.waiting.appendList([(v,) for v in new])
            self.handle.registerTimer(max(new))  # until then none of them is sure to be in order
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        waiting = sorted(r[0] for r in self.waiting.get())
        due, rest = [v for v in waiting if v <= now], [v for v in waiting if v > now]
        current = tuple(self.open.get()) if self.open.exists() else None
        for v in due:
            if current and v - current[1] <= self.gap:
                current = (current[0], v, current[2] + 1)
            else:
                out.append(current)
                current = (v, v, 1)
        if current and now > current[1] + self.gap and not any(v - current[1] <= self.gap for v in rest):
            out.append(current)
            current = None
        if rest:
            self.waiting.put([(v,) for v in rest])
        else:
            self.waiting.clear()
        if current:
            self.open.update(current)
            self.handle.registerTimer(current[1] + self.gap + 1)
        else:
            self.open.clear()
        found = [(key[0], c[0], c[1], c[2]) for c in out if c and c[1] - c[0] >= self.least]
        if found:
            yield pd.DataFrame(found, columns=["rec", "first", "last", "n"])

    def close(self) -> None:
        pass


def peak_clusters(peaks: DataFrame, gap_ms: int, least_ms: int = 0, late: str = "10 seconds", time: str = "ts", key: str = "rec") -> DataFrame:
    """W6 on a stream: rec, first, last (milliseconds of the epoch), n of clusters whose neighbouring peaks are at most ``gap_ms`` apart and which span at least ``least_ms``.

    Peaks up to ``late`` behind the newest count wherever they arrive; later ones are dropped. A cluster comes out once the watermark is over its last
    peak by more than the gap. Times count in whole milliseconds; rows of a null time or key are left out."""
    ready(peaks.sparkSession)
    rows = peaks.where(F.col(time).isNotNull() & F.col(key).isNotNull()).withColumn("ts", F.col(time).cast("timestamp")).withWatermark("ts", late)
    rows = rows.select(F.col(key).cast("string").alias("rec"), "ts", F.unix_millis("ts").alias("at"))
    return rows.groupBy("rec").transformWithStateInPandas(PeakClusters(gap_ms, least_ms), "rec string, first bigint, last bigint, n bigint", "Append", "EventTime")


class CausalFilter(StatefulProcessor):
    """Second-order sections over epochs in order; an epoch that comes early waits for those before it."""

    def __init__(self, sos: np.ndarray, patience: int):
        self.sos, self.patience = sos, patience

    def init(self, handle) -> None:
        self.memory = handle.getValueState("memory", "next bigint, z array<double>")
        self.waiting = handle.getMapState("waiting", "epoch bigint", "samples array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.memory.get()) if self.memory.exists() else (None, [])
        upcoming, z = held[0], np.asarray(held[1], float)
        for part in rows:
            for epoch, x in zip(part["epoch"], part["samples"], strict=True):
                if upcoming is None or epoch >= upcoming:
                    if not self.waiting.containsKey((int(epoch),)):  # of repeated epochs the first counts
                        self.waiting.updateValue((int(epoch),), ([float(v) for v in x],))
        epochs = sorted(k[0] for k in self.waiting.keys())
        out = []
        while epochs:
            # the trace starts at its first epoch; a gap is given up once ``patience`` epochs wait behind it
            if upcoming is None and epochs[0] != 0 and len(epochs) <= self.patience:
                break
            if upcoming is not None and epochs[0] != upcoming and len(epochs) <= self.patience:
                break
            epoch = epochs.pop(0)
            x = np.array(self.waiting.getValue((epoch,))[0], float)
            self.waiting.removeKey((epoch,))
            if epoch != upcoming or not len(z):
                z = np.zeros(2 * len(self.sos))
            state = z.reshape(len(self.sos), 2, 1)
            y, z = run_sections(self.sos, x, state)
            out.append((*key, epoch, y))
            upcoming = epoch + 1
        if upcoming is not None:
            self.memory.update((int(upcoming), [float(v) for v in z.ravel()]))
        if out:
            yield pd.DataFrame(out, columns=["rec", "ch", "epoch", "samples"])

    def close(self) -> None:
        pass


def run_sections(sos: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[list[float], np.ndarray]:
    """Filter forward from a state (sections, 2, 1), and the state that is left."""
    y, left = [float(v) for v in x], np.zeros((len(sos), 2))
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        z1, z2 = float(state[i, 0, 0]), float(state[i, 1, 0])
        for t, v in enumerate(y):
            o = b0 * v + z1
            z1 = b1 * v - a1 * o + z2
            z2 = b2 * v - a2 * o
            y[t] = o
        left[i] = z1, z2
    return y, left


def causal_filter(epochs: DataFrame, low: float, high: float, fs: float, order: int = 4, patience: int = 4) -> DataFrame:
    """rec, ch, epoch, samples: a causal band-pass over a stream of epochs (rec, ch, epoch from 0, samples), as over the whole trace.

    An epoch that arrives before its predecessor waits for it; once more than ``patience`` epochs wait, those that are missing are given up, the filter
    starts anew behind the gap and an epoch of the gap that comes after all is dropped, as is a repeated one. Epochs with null keys or samples are left out."""
    ready(epochs.sparkSession)
    rows = epochs.where("rec is not null and ch is not null and epoch is not null and samples is not null")
    rows = rows.select(F.col("rec").cast("string").alias("rec"), "ch", F.col("epoch").cast("bigint").alias("epoch"), F.col("samples").cast("array<double>").alias("samples"))
    return rows.groupBy("rec", "ch").transformWithStateInPandas(CausalFilter(dsp.butter_sos(order, (low, high), fs), patience), "rec string, ch string, epoch bigint, samples array<double>", "Append", "None")
