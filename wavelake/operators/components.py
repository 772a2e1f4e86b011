"""Clean-up by independent components: moments of all samples summed in Spark, a rotation per recording, applied to each epoch.

A recording's traces are filtered in chunks with halos. The first pass sums outer products of the channels (their covariance), the
second the products of pairs of whitened components with pairs (their fourth moments). Both are matrices of the channels, of a size
that does not depend on the recording's length, so a fixed-point iteration on the fourth moments finds the rotation of
largest kurtosis as one over all samples would. No samples of a recording are gathered beyond a chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelake.functions import dsp
from wavelake.session import saved, ship

from .traces import filtered, settle

#: Channels at most: fourth moments of n of them are (n * n / 2) ** 2 numbers.
MAX_CHANNELS = 32
#: Components at most.
MAX_COMPONENTS = 15
#: Chunks whose sums are added in one group.
FAN_IN = 32


def pair_index(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n)


def rotate(moments: np.ndarray, n: int, starts: int = 8, steps: int = 200) -> np.ndarray:
    """Rows w of a rotation that make the kurtosis of w z extreme, one after the other, from the fourth moments of white z.

    ``moments`` holds E[z_i z_j z_k z_l] for pairs (i, j) by pairs (k, l). Each row is the best of ``starts`` seeded fixed points."""
    i, j = pair_index(n)
    weight = np.where(i == j, 1.0, 2.0)
    rng, rows = np.random.default_rng(11), np.zeros((0, n))

    def cubic(w):
        u = moments @ (weight * w[i] * w[j])
        full = np.zeros((n, n))
        full[i, j] = full[j, i] = u
        return full @ w

    for _ in range(n):
        best = None
        for _ in range(starts):
            w = rng.standard_normal(n)
            for _ in range(steps):
                w = w - rows.T @ (rows @ w)
                w /= np.linalg.norm(w)
                new = cubic(w) - 3 * w
                new = new - rows.T @ (rows @ new)
                size = np.linalg.norm(new)
                if size < 1e-12:
                    break
                done, w = abs(abs(new @ w) / size - 1) < 1e-13, new / size
                if done:
                    break
            kurtosis = abs(w @ cubic(w) - 3)
            if best is None or kurtosis > best[0] + 1e-9:
                best = (kurtosis, w)
        rows = np.vstack([rows, best[1] * (1.0 if best[1][np.abs(best[1]).argmax()] > 0 else -1.0)])
    return rows


def summed(parts: DataFrame, rec: str) -> DataFrame:
    """Sum rows (rec, chunk, n, m: a flat matrix) in groups of FAN_IN chunks, then of a recording."""
    import pyarrow as pa

    def add(t: pa.Table) -> pa.Table:
        m = np.sum([np.asarray(v.values) for v in t.column("m")], axis=0)
        return pa.table([pa.array([t.column(c)[0].as_py()], t.schema.field(c).type) for c in (rec, "chunk")] + [pa.array([sum(t.column("n").to_pylist())], pa.int64()), pa.array([m], pa.list_(pa.float64()))],
                        [rec, "chunk", "n", "m"])

    schema = f"{rec} {dict(parts.dtypes)[rec]}, chunk bigint, n bigint, m array<double>"
    near = parts.withColumn("chunk", F.expr(f"chunk div {FAN_IN}")).groupBy(rec, "chunk").applyInArrow(add, schema)
    return near.withColumn("chunk", F.lit(0).cast("bigint")).groupBy(rec).applyInArrow(add, schema).drop("chunk")


def independent_components(df: DataFrame, fs: float, per_epoch: int, frontal: Sequence[str], share: float = 0.6, high_pass: float = 1.0, core: int | None = None) -> DataFrame:
    """Rec, channels, mean, shares, removed, clean: the components of each recording and the matrix that takes the ocular ones out.

    ``df`` holds epochs (rec, ch, epoch, samples). Fitted on all chunks that every channel of the recording has, above ``high_pass``. A component
    is ocular if the ``frontal`` channels have at least ``share`` of its absolute weights. ``shares`` and ``removed`` are in order of falling
    kurtosis; ``clean`` is a matrix over ``channels``, row by row. Recordings of under three or over MAX_CHANNELS channels, with samples
    that are null or not finite, or without variance have no row.
    """
    import pyarrow as pa

    ship(df.sparkSession)
    sos, upper = dsp.butter_sos(2, high_pass, fs, "high"), {c.upper() for c in frontal}
    fine = F.coalesce(F.forall("samples", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    sane = df.groupBy("rec").agg(F.array_sort(F.collect_set("ch")).alias("channels"), F.every(fine).alias("fine"))  # MAX_CHANNELS names, or the recording goes
    sane = sane.where(F.col("fine") & F.size("channels").between(3, MAX_CHANNELS)).select("rec", "channels")
    chunks = filtered(df.join(sane.select("rec"), "rec"), lambda x, left, right: (dsp.sosfiltfilt(sos, x)[0],), ["y"], per_epoch, settle(sos), 0, core)
    wide = chunks.groupBy("rec", "chunk", "first").agg(F.array_sort(F.collect_list(F.struct("ch", "y"))).alias("x"))
    wide = wide.join(sane, "rec").where((F.size("x") == F.size("channels")) & (F.array_distinct(F.transform("x", lambda c: F.size(c.y))) == F.array(F.size(F.col("x")[0].y))))
    wide = saved(wide.select("rec", "chunk", F.transform("x", lambda c: c.y).alias("x")), "components")
    rec_kind = dict(df.dtypes)["rec"]

    def matrix(v) -> np.ndarray:
        return np.stack([np.asarray(row.values) for row in v.values])

    def sums(per):
        def run(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    n, m = per(batch, k)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in ("rec", "chunk")), pa.array([n], pa.int64()), pa.array([m.ravel()], pa.list_(pa.float64()))], ["rec", "chunk", "n", "m"])
        return run

    def second(batch, k):
        x = matrix(batch.column("x")[k])
        x = np.vstack([x, np.ones(x.shape[1])])  # the last row of products are the sums
        return x.shape[1], x @ x.T

    kind = f"rec {rec_kind}, chunk bigint, n bigint, m array<double>"
    cov = summed(wide.mapInArrow(sums(second), kind), "rec")

    def whitening(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                n, m = batch.column("n")[k].as_py(), np.asarray(batch.column("m")[k].values)
                c = int(np.sqrt(len(m))) - 1
                m = m.reshape(c + 1, c + 1) / n
                mean = m[c, :c]
                e, u = np.linalg.eigh(m[:c, :c] - np.outer(mean, mean))
                order = [i for i in np.argsort(-e, kind="stable")[: min(MAX_COMPONENTS, c - 1)] if e[i] > 1e-10 * max(e.max(), 0)]
                if order:
                    yield pa.RecordBatch.from_arrays([batch.column("rec").slice(k, 1), pa.array([mean], pa.list_(pa.float64())), pa.array([(u[:, order] / np.sqrt(e[order])).T.ravel()], pa.list_(pa.float64()))], ["rec", "mean", "white"])

    white = saved(cov.mapInArrow(whitening, f"rec {rec_kind}, mean array<double>, white array<double>"), "whitening")

    def fourth(batch, k):
        mean = np.asarray(batch.column("mean")[k].values)
        z = np.asarray(batch.column("white")[k].values).reshape(-1, len(mean)) @ (matrix(batch.column("x")[k]) - mean[:, None])
        i, j = pair_index(len(z))
        pairs = z[i] * z[j]
        return z.shape[1], pairs @ pairs.T

    moments = summed(wide.join(white, "rec").mapInArrow(sums(fourth), kind), "rec")

    def fit(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                n, names = batch.column("n")[k].as_py(), batch.column("channels")[k].as_py()
                mean, m = np.asarray(batch.column("mean")[k].values), np.asarray(batch.column("m")[k].values)
                size = int(np.sqrt(len(m)))
                keep = np.asarray(batch.column("white")[k].values).reshape(-1, len(mean))
                unmix = rotate(m.reshape(size, size) / n, len(keep)) @ keep
                mix = np.linalg.pinv(unmix)
                front = np.array([c.upper() in upper for c in names])
                part = np.abs(mix[front]).sum(axis=0) / np.abs(mix).sum(axis=0)
                gone = np.flatnonzero(part >= share)
                clean = np.eye(len(mean)) - mix[:, gone] @ unmix[gone]
                values = [mean, part, clean.ravel()]
                yield pa.RecordBatch.from_arrays([batch.column("rec").slice(k, 1), batch.column("channels").slice(k, 1), *(pa.array([v], pa.list_(pa.float64())) for v in values), pa.array([gone], pa.list_(pa.int32()))],
                                                 ["rec", "channels", "mean", "shares", "clean", "removed"])

    ready = moments.join(white, "rec").join(sane, "rec")
    return saved(ready.mapInArrow(fit, f"rec {rec_kind}, channels array<string>, mean array<double>, shares array<double>, clean array<double>, removed array<int>"), "rotation")


def apply_components(df: DataFrame, fitted: DataFrame) -> DataFrame:
    """rec, ch, epoch, samples, cleaned: every epoch of ``df`` without the components that ``fitted`` removes.

    An epoch that lacks a channel, or whose channels differ in length, cannot be unmixed and stays as it is (``cleaned`` is false), as do recordings
    that ``fitted`` does not hold."""
    import pyarrow as pa

    ship(df.sparkSession)
    held = df.groupBy("rec", "epoch").agg(F.array_sort(F.collect_list(F.struct("ch", "samples"))).alias("x")).join(fitted.select("rec", "channels", "mean", "clean"), "rec", "left")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                chans, names = batch.column("x")[k].as_py(), batch.column("channels")[k].as_py()
                ok = names is not None and [c["ch"] for c in chans] == names and len({len(c["samples"] or ()) for c in chans}) == 1 and all(c["samples"] is not None for c in chans)
                out = [c["samples"] for c in chans]
                if ok:
                    mean = np.asarray(batch.column("mean")[k].values)[:, None]
                    out = np.asarray(batch.column("clean")[k].values).reshape(len(names), -1) @ (np.array(out, float) - mean) + mean
                at = pa.array([k] * len(chans))
                yield pa.RecordBatch.from_arrays([batch.column("rec").take(at), pa.array([c["ch"] for c in chans], pa.string()), batch.column("epoch").take(at),
                                                  pa.array(list(out), pa.list_(pa.float64())), pa.array([ok] * len(chans))], ["rec", "ch", "epoch", "samples", "cleaned"])

    return held.mapInArrow(run, f"rec {dict(df.dtypes)['rec']}, ch string, epoch {dict(df.dtypes)['epoch']}, samples array<double>, cleaned boolean")
