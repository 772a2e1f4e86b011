"""Stateful streams give the batch result for any cut into micro-batches; late rows and gaps are defined."""

import random

import numpy as np
import pytest

from wavelake.functions import dsp
from wavelake.streaming import stateful


def stream(spark, tmp_path, batches, schema, build, name):
    """Feed batches of rows one by one, restarting the query from its checkpoint each time, and return all rows it gave."""
    src, out = str(tmp_path / f"{name}-in"), str(tmp_path / f"{name}-out")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = (build(spark.readStream.schema(schema).parquet(src)).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start(out))
        q.awaitTermination(240)
    return spark.read.parquet(out).collect()


def plain_clusters(times, gap, least):
    out = []
    for t in sorted(times):
        if out and t - out[-1][1] <= gap:
            out[-1] = (out[-1][0], t, out[-1][2] + 1)
        else:
            out.append((t, t, 1))
    return [c for c in out if c[1] - c[0] >= least]


@pytest.mark.parametrize("n_batches", [1, 4])
def test_peak_clusters_for_any_cut(spark, tmp_path, n_batches):
    rng = random.Random(3)
    times = {r: [rng.randrange(600_000) for _ in range(80)] for r in ("a", "b")}
    rows = sorted((t + rng.randrange(-2000, 2000), r, t) for r, ts in times.items() for t in ts)  # out of order by up to 4 s
    rows = [(r, t / 1000) for _, r, t in rows]
    cut = [rows[i * len(rows) // n_batches: (i + 1) * len(rows) // n_batches] for i in range(n_batches)]
    tail = [[("z", 2000.0)], [("z", 3000.0)], [("z", 3001.0), ("a", 1.0), (None, 1.0)]]  # the watermark moves on; a late row of "a" is dropped
    got = stream(spark, tmp_path, cut + tail, "rec string, s double", lambda df: stateful.peak_clusters(df.selectExpr("rec", "timestamp_millis(cast(round(s * 1000) as bigint)) AS ts"), 3000, 1000), f"c{n_batches}")
    want = sorted((r, *c) for r, ts in times.items() for c in plain_clusters(ts, 3000, 1000))
    assert sorted((r.rec, r.first, r.last, r.n) for r in got if r.rec != "z") == want and len(want) > 10


def test_causal_filter_for_any_cut(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal(640)
    rows = [("1", "C3", e, [float(v) for v in x[64 * e: 64 * e + 64]]) for e in range(10)]
    want = dsp.sosfilt(dsp.butter_sos(2, (2, 10), 64.0), x[None, :], np.zeros((2, 2, 1)))[0]
    order = [0, 2, 1, 3, 5, 6, 4, 9, 7, 8]
    for k, batches in enumerate(([rows], [[rows[i]] for i in order[:4]] + [[rows[i] for i in order[4:]] + [rows[0], ("1", None, 1, [1.0])]])):
        got = stream(spark, tmp_path, batches, "rec string, ch string, epoch long, samples array<double>", lambda df: stateful.causal_filter(df, 2, 10, 64.0, order=2), f"f{k}")
        assert sorted(r.epoch for r in got) == list(range(10))
        y = np.concatenate([r.samples for r in sorted(got, key=lambda r: r.epoch)])
        assert np.allclose(y, want, atol=1e-12)


def test_a_gap_is_given_up_after_a_while(spark, tmp_path):
    rows = [("1", "C3", e, [1.0, 2.0]) for e in (0, 1, 3, 4, 5)]
    got = stream(spark, tmp_path, [rows, [("1", "C3", 2, [9.0])]], "rec string, ch string, epoch long, samples array<double>", lambda df: stateful.causal_filter(df, 2, 10, 64.0, patience=2), "g")
    by = {r.epoch: r.samples for r in got}
    assert sorted(by) == [0, 1, 3, 4, 5] and by[3] == by[0]  # the filter starts anew behind the gap
