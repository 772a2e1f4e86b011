"""Screens for long rhythmic stretches on planted ones, against a plain loop."""

import numpy as np

from wavelake.operators import detectors

FS, PER = 200.0, 6000
SCHEMA = "rec long, ch string, epoch long, samples array<double>"


def rows(rec, ch, x):
    return [(rec, ch, i // PER, [float(v) for v in x[i: i + PER]]) for i in range(0, len(x), PER)]


def chirp(x, start, stop, f0, f1, size=150.0):
    t = np.arange(int((stop - start) * FS)) / FS
    x = x.copy()
    x[int(start * FS): int(stop * FS)] += size * np.sin(2 * np.pi * (f0 * t + 0.5 * (f1 - f0) / (stop - start) * t**2))
    return x


def plain(x):
    t, ll, hz = [], [], []
    for e in range(0, len(x), PER):
        for a in range(e, min(e + PER, len(x)) - 399, 200):
            w = x[a: a + 400]
            f, p = np.fft.rfftfreq(400, 1 / FS), np.abs(np.fft.rfft((w - w.mean()) * np.hanning(400)))
            ok = (f >= 2) & (f <= 25)
            t, ll, hz = [*t, a / FS], [*ll, np.abs(np.diff(w)).sum()], [*hz, f[ok][np.argmax(p[ok])]]
    ll = np.array(ll)
    mad = np.median(np.abs(ll - np.median(ll)))
    z, out, i = (ll - np.median(ll)) / (1.4826 * mad), [], 0
    while i < len(z):
        if z[i] < 3:
            i += 1
            continue
        j = i
        while j + 1 < len(z) and z[j + 1] >= 3 and t[j + 1] - t[j] <= 1.5:
            j += 1
        if t[j] + 2 - t[i] >= 10:
            out.append((t[i], t[j] + 2 - t[i], z[i: j + 1].max(), abs(hz[j] - hz[i])))
        i = j + 1
    return out


def test_planted_stretches(spark):
    rng = np.random.default_rng(0)
    noise = lambda: 5.0 * rng.standard_normal(int(120 * FS))
    data = {(1, "C3"): chirp(noise(), 40, 60, 8, 5), (2, "C3"): noise(), (3, "C3"): chirp(noise(), 40, 45, 8, 6), (4, "C3"): chirp(noise(), 62, 80, 6, 6), (5, "A"): chirp(noise(), 40, 58, 8, 5), (5, "B"): chirp(noise(), 42, 59, 8, 5, 300.0),
            (5, "C"): chirp(noise(), 95, 110, 7, 4), (6, "A"): 0 * noise(), **{(6, c): noise() for c in "BCDE"}, (6, "F"): chirp(noise(), 40, 60, 8, 5)}
    df = spark.createDataFrame([r for (rec, ch), x in data.items() for r in rows(rec, ch, x)] + [(7, "C3", 0, [float("nan")] * 10), (7, "C3", None, [1.0]), (8, "C3", 0, None)], SCHEMA)
    got = sorted((r.rec, r.start_s, r) for r in detectors.ictal_candidates(df, FS, PER).collect())
    assert [(g[0], g[2].ch) for g in got] == [(1, "C3"), (4, "C3"), (5, "B"), (5, "C")]
    for rec, start, r in got:
        want = [w for w in plain(data[rec, r.ch]) if abs(w[0] - start) < 1e-9][0]
        assert np.allclose((r.duration_s, r.peak_z, r.drift_hz), want[1:], rtol=1e-6) and r.confidence == ("moderate" if want[3] >= 1 else "low")
    assert got[0][2].confidence == "moderate" and got[1][2].confidence == "low"
    assert detectors.ictal_candidates(df.limit(0), FS, PER).count() == 0
