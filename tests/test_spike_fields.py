"""Averages around spikes and their widths, on planted spikes and against plain loops."""

import numpy as np
from pyspark.sql import functions as F

from wavelake.operators import detectors

FS, PER = 200.0, 2000
SCHEMA = "rec long, ch string, epoch long, samples array<double>"
KERNEL = -200.0 * np.exp(-0.5 * (np.arange(-20, 21) / 4.0) ** 2)
TIMES = [3.0 + 3 * k for k in range(15)]


def traces(inject, seed=3):
    rng = np.random.default_rng(seed)
    x = {f"C{i}": 3.0 * rng.standard_normal(12000) for i in range(4)}
    for ch, size in inject.items():
        for t in TIMES:
            x[ch][int(t * FS) - 20: int(t * FS) + 21] += size * KERNEL
    return x


def rows(rec, x):
    return [(rec, c, i // PER, [float(v) for v in s[i: i + PER]]) for c, s in x.items() for i in range(0, len(s), PER)]


def test_fields_of_planted_spikes(spark):
    data = {1: traces({"C3": 1}), 2: traces({"C2": 1, "C3": 1}), 3: traces({"C3": 1, "C2": 0.2}), 4: traces({"C1": 1, "C3": 1}), 5: traces({"C3": 1}), 6: {c: 0 * x for c, x in traces({}).items()}}
    data[5]["C0"][int(TIMES[0] * FS)] = np.nan
    df = spark.createDataFrame([r for k, x in data.items() for r in rows(k, x)], SCHEMA)
    events = spark.createDataFrame([(k, t) for k in data for t in [*TIMES, 0.01, 59.99, 500.0, None]] + [(1, TIMES[0]), (9, 1.0)], "rec long, t_s double")
    got = {r.rec: r for r in detectors.spike_average(events, df, FS, PER).collect()}
    assert {k: r.n_spikes for k, r in got.items()} == {1: 16, 2: 15, 3: 15, 4: 15, 5: 14, 6: 15}
    assert [got[k].field_spread for k in range(1, 7)] == ["focal", "bilateral", "focal", "regional", "focal", "n/a"]
    assert got[1].peak_channel == "C3" and abs(got[1].peak_latency_ms) <= 5
    for k in (1, 4, 5):
        at = [round(t * FS) for t in TIMES if k != 5 or t != TIMES[0]] + ([round(TIMES[0] * FS)] if k == 1 else [])
        mean = {c: np.mean([x[i - 20: i + 20] for i in at], axis=0) for c, x in data[k].items()}
        peak = int(np.argmax(sum(np.abs(m) for m in mean.values())))
        assert got[k].peak_latency_ms == (peak - 20) * 1000 / FS and all(abs(got[k].topography[c] - mean[c][peak]) < 1e-9 for c in mean)
    assert detectors.spike_average(events.limit(0), df, FS, PER).count() == 0


def test_widths_and_classes(spark):
    rng, x = np.random.default_rng(2), {}
    for name, sd in (("narrow", 2.5), ("broad", 6.0)):
        x[name] = 2.0 * rng.standard_normal(12000)
        for t in TIMES:
            x[name] += 300 * np.exp(-0.5 * ((np.arange(12000) - t * FS) / sd) ** 2)
    x["poly"] = x["narrow"] + sum(300 * np.exp(-0.5 * ((np.arange(12000) - (t + 0.15) * FS) / 2.5) ** 2) for t in TIMES)
    df = spark.createDataFrame(rows(1, x), SCHEMA)
    found = detectors.spikes(df, FS, PER, core=2)
    whole = detectors.spikes(df, FS, PER, core=50)
    a, b = (sorted((r.ch, r.t_s, r.width_ms) for r in f.collect()) for f in (found, whole))
    assert [v[:2] for v in a] == [v[:2] for v in b] and all(u[2] == v[2] for u, v in zip(a, b, strict=True))
    got = {r.ch: r for r in detectors.morphology(found).collect()}
    assert got["narrow"].classification == "predominantly_simple" and got["narrow"].interpretation == "benign_focal" and got["narrow"].pct_polyspike < 10
    assert got["poly"].pct_polyspike >= 20 and got["poly"].interpretation == "encephalopathic" and got["broad"].p50 > got["narrow"].p50
    for ch, r in got.items():
        w = [v[2] for v in a if v[0] == ch and v[2] is not None]
        t = [v[1] for v in a if v[0] == ch]
        assert np.allclose([r.p25, r.p50, r.p75], np.percentile(w, [25, 50, 75])) and abs(r.pct_polyspike - 100 * np.mean(np.diff(t) < 0.25)) < 1e-9
        assert abs(r.pct_simple - 100 * np.mean(np.array(w) < 70)) < 1e-9 and r.n_widths == len(w)


def test_sides_of_channels(spark):
    names = {"C3": "left", "C4": "right", "Cz": "mid", "Fp1": "left", "T10": "right", "O1-ref": "left"}
    df = spark.createDataFrame([(n,) for n in names], "ch string").select("ch", detectors.hemisphere(F.col("ch")).alias("side"))
    assert {r.ch: r.side for r in df.collect()} == names
