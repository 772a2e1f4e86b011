"""Detectors over whole traces, each against a plain version over the joined trace."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.functions import dsp
from wavelake.operators import detectors, traces
from wavelake.session import shared_dir

FS, PER = 64.0, 512
SCHEMA = "rec long, ch string, epoch long, samples array<double>"


def plain_filtfilt(sos, x):
    """Both directions sample by sample, with odd reflection and steady states, over a whole trace."""
    taps = 2 * len(sos) + 1 - min((sos[:, 2] == 0).sum(), (sos[:, 5] == 0).sum())
    pad = min(3 * taps, len(x) - 1)
    y = [*(2 * x[0] - x[pad:0:-1]), *x, *(2 * x[-1] - x[-2: -pad - 2: -1])]
    for _ in range(2):
        scale = y[0]
        for b0, b1, b2, _, a1, a2 in sos:
            gain = (b0 + b1 + b2) / (1 + a1 + a2)
            z2 = (b2 - a2 * gain) * scale
            z1 = (b1 - a1 * gain) * scale + z2
            scale *= gain
            for i, v in enumerate(y):
                o = b0 * v + z1
                z1 = b1 * v - a1 * o + z2
                z2 = b2 * v - a2 * o
                y[i] = o
        y = y[::-1]
    return np.array(y[pad: pad + len(x)])


def plain_envelope(x):
    spec = np.fft.fft(x, 16 * len(x))
    spec[1: 8 * len(x)] *= 2
    spec[8 * len(x) + 1:] = 0
    return np.abs(np.fft.ifft(spec)[: len(x)])


def mean_of(x, window):
    """Moving mean with zeros outside, as np.convolve places it."""
    padded = np.concatenate([np.zeros(window), x, np.zeros(window)])
    start = window - (window - 1 - (window - 1) // 2)
    return np.array([padded[start + i: start + i + window].mean() for i in range(len(x))])


def runs(flag):
    out, at = [], None
    for i, f in enumerate([*flag, False]):
        if f and at is None:
            at = i
        if not f and at is not None:
            out.append((at, i))
            at = None
    return out


def cut(x, rec, ch, first=0, per=PER):
    return [(rec, ch, first + i // per, [float(v) for v in x[i: i + per]]) for i in range(0, len(x), per)]


@pytest.fixture(scope="module")
def trace():
    """A trace of noise with a slow oscillation and loud stretches, two of them across the seams of epochs and chunks."""
    rng = np.random.default_rng(4)
    t = np.arange(22 * PER) / FS
    x = 15 * rng.standard_normal(len(t)) + 60 * np.sin(2 * np.pi * 0.7 * t) * (t < 90)
    for start, stop in ((31.5, 33.0), (63.2, 64.9), (95.0, 95.9), (126.0, 129.5), (140.0, 150.0)):
        x += 120 * np.sin(2 * np.pi * 13 * t) * ((t >= start) & (t < stop))
    return x


def test_chunks_equal_one_filter_over_the_joined_trace(spark, trace):
    df = spark.createDataFrame(cut(trace, 1, "A"), SCHEMA)
    for band, core in (((11.0, 16.0), 3), ((0.3, 1.5), 4)):
        sos = dsp.butter_sos(4, band, FS)
        want = plain_filtfilt(sos, trace)
        fade = int(3 * FS)
        kernel = lambda x, left, right, sos=sos, fade=fade: (dsp.sosfiltfilt(sos, x)[0], traces.envelope(dsp.sosfiltfilt(sos, x)[0], left, right, fade))
        rows = traces.filtered(df, kernel, ["y", "env"], PER, traces.settle(sos) + fade, 100, core).orderBy("first").collect()
        assert len(rows) == -(-22 // core)
        y = np.concatenate([r.y[r.before: r.before + r.n] for r in rows])
        assert np.abs(y - want).max() < 1e-6 * np.abs(want).max()
        if band[0] > 1:
            env, plain = np.concatenate([r.env[r.before: r.before + r.n] for r in rows]), plain_envelope(want)
            assert np.abs(env - plain).max() < 5e-5 * plain.max()  # what the abrupt ends of the trace add far away
        for r in rows:
            assert np.allclose(r.y, want[r["first"] - r.before: r["first"] - r.before + len(r.y)], atol=1e-6 * np.abs(want).max())


def test_spindles_against_the_joined_trace(spark, trace):
    df = spark.createDataFrame(cut(trace, 1, "A") + cut(trace[:5 * PER][::-1], 1, "B", 7), SCHEMA)
    got = sorted(map(tuple, detectors.spindles(df, FS, PER, core=3).collect()))
    want = []
    for ch, x, first in (("A", trace, 0), ("B", trace[:5 * PER][::-1], 7 * PER)):
        band = plain_filtfilt(dsp.butter_sos(4, (11, 16), FS), x)
        env = mean_of(plain_envelope(band), int(0.2 * FS))
        for a, b in runs(env > np.percentile(env, 90)):
            if int(0.5 * FS) <= b - a <= int(2.5 * FS):
                want.append((1, ch, (first + a) / FS, (first + b) / FS, (first + a + np.argmax(env[a:b])) / FS, (b - a) / FS, env[a:b].max()))
    assert [g[:6] for g in got] == [w[:6] for w in sorted(want)] and np.allclose([g[6] for g in got], [w[6] for w in sorted(want)], rtol=1e-4)
    assert any(g[2] < 64 < g[3] for g in got)  # over the seam of two epochs, once


def test_slow_waves_against_the_joined_trace(spark, trace):
    df = spark.createDataFrame(cut(trace, 3, "A") + cut(trace, 9, "A"), SCHEMA)
    got = sorted(map(tuple, detectors.slow_waves(df, FS, PER, F.when(F.col("rec") < 8, 60).otherwise(40), core=4).collect()))
    s = plain_filtfilt(dsp.butter_sos(4, (0.3, 1.5), FS), trace)
    want = []
    for rec, depth in ((3, 60), (9, 40)):
        for a, b in runs(s < -depth):
            if int(0.3 * FS) <= b - a <= int(1.5 * FS):
                low, crest = a + int(np.argmin(s[a:b])), s[b: 2 * b - a].max() if b < len(s) else 0.0
                want.append((rec, "A", a / FS, low / FS, b / FS, min(2 * b - a, len(s)) / FS, s[low], crest, crest - s[low], (b - a) / FS, -s[low] / ((b - low) / FS)))
    assert len(got) == len(want) > 60 and [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2:] for g in got], [w[2:] for w in want], atol=1e-3)
    t = np.arange(60 * 200) / 200
    sine = spark.createDataFrame(cut(np.where(t < 10 / 0.75, -100 * np.sin(2 * np.pi * 0.75 * t), 0), 1, "Fz", per=6000), SCHEMA)
    assert 8 <= detectors.slow_waves(sine, 200.0, 6000, F.lit(40)).count() <= 11


def test_bursts_of_any_length_against_the_joined_trace(spark, trace):
    other = trace * np.where((np.arange(len(trace)) / FS > 140) & (np.arange(len(trace)) / FS < 150), 5, 1) + 3
    df = spark.createDataFrame(cut(trace, 1, "A") + cut(other, 1, "B"), SCHEMA)
    got = sorted(map(tuple, detectors.bursts(df, FS, PER, core=1).collect()))  # chunks of 8 s: the burst of 10 s lies in two or three
    want, raw = [], {"A": trace, "B": other}
    usual = {c: np.median([np.ptp(x[i: i + 128]) for i in range(0, len(x) - 127, 128)]) for c, x in raw.items()}
    for ch, x in raw.items():
        y = plain_filtfilt(dsp.butter_sos(4, (5, 25), FS), x)
        for a, b in runs(mean_of(np.abs(y), int(0.25 * FS)) > 4 * np.median(np.abs(y - np.median(y)))):
            if b - a >= 3 * FS:
                f, p = np.fft.rfftfreq(b - a, 1 / FS), np.abs(np.fft.rfft(y[a:b]))
                ok = (f >= 1) & (f <= 15)
                ptp = {c: np.ptp(v[a:b]) for c, v in raw.items()}
                top = max(sorted(ptp), key=lambda c: ptp[c])
                want.append((1, ch, a / FS, b / FS, (b - a) / FS, f[ok][np.argmax(p[ok])], sum(ptp[c] > 3 * usual[c] for c in raw), top, ptp[top]))
    assert [(*g[:7], g[7]) for g in got] == [(*w[:7], w[7]) for w in sorted(want)] and np.allclose([g[8] for g in got], [w[8] for w in sorted(want)])
    assert any(g[4] > 9 and g[6] >= 1 and g[7] == "B" for g in got)


def test_spikes_against_the_joined_trace(spark):
    rng = np.random.default_rng(7)
    x = 5 * rng.standard_normal(10 * PER)
    for at in (100, 511, 512 * 4, 512 * 4 + 3, 3000, 512 * 9 + 500):
        x[at: at + 2] += 200
    got = sorted(map(tuple, detectors.spikes(spark.createDataFrame(cut(x, 1, "A"), SCHEMA), FS, PER, core=2).collect()))
    y, want = plain_filtfilt(dsp.butter_sos(4, (10, 30), FS), x), []
    for e in range(10):
        z = y[e * PER: (e + 1) * PER]
        least = max(6 * np.median(np.abs(z - np.median(z))), 3 * np.sqrt((z**2).mean()))
        m = np.abs(z)
        tops = [i for i in range(1, PER - 1) if m[i] > m[i - 1] and m[i] > m[i + 1] and m[i] >= least]
        kept = []
        for i in sorted(tops, key=lambda i: -m[i]):
            if all(abs(i - j) >= int(0.08 * FS) for j in kept):
                kept.append(i)
        want += [(1, "A", (e * PER + i) / FS, m[i]) for i in sorted(kept)]
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-6) and len(got) >= 4


def test_fast_oscillations_against_the_joined_trace(spark):
    fs, rng = 1024.0, np.random.default_rng(9)
    t = np.arange(30 * PER) / fs
    x = 2 * rng.standard_normal(len(t))
    planted = (1.31, 4.0, 7.513, 11.99)
    for at in planted:
        x += 30 * np.exp(-0.5 * ((t - at) / 0.015) ** 2) * np.sin(2 * np.pi * 140 * t)
    x += 60 * np.exp(-0.5 * ((t - 9.2) / 0.015) ** 2) * rng.standard_normal(len(t))  # broad band: an artefact
    got = sorted(map(tuple, detectors.fast_oscillations(spark.createDataFrame(cut(x, 1, "Cz"), SCHEMA), fs, PER, core=5).collect()))
    y = x
    for f in (50.0, 100.0):
        y = plain_filtfilt(dsp.notch_sos(f, 30, fs), y)

    def fir(band):
        h = dsp.fir_band(128, band, fs)
        pad = min(3 * len(h), len(y) - 1)
        z = np.concatenate([2 * y[0] - y[pad:0:-1], y, 2 * y[-1] - y[-2: -pad - 2: -1]])
        return np.convolve(np.convolve(z, h, mode="same"), h[::-1], mode="same")[pad: pad + len(y)]

    band, over = fir((80, 250)), fir((250, 500))
    rms = np.sqrt(np.maximum(mean_of(band**2, 6), 0))
    quiet, want = rms[rms <= np.percentile(rms, 50)], []
    limit = max(5 * quiet.std(), 1.0)
    for a, b in runs(rms > limit / 2):
        if rms[a:b].max() > limit and round(6 / 165 * fs) <= b - a <= round(0.2 * fs):
            f = np.fft.rfftfreq(b - a, 1 / fs)
            p = [(np.abs(np.fft.rfft(v[a:b]))[(f >= lo) & (f <= hi)] ** 2).sum() for v, lo, hi in ((band, 80, 250), (over, 250, 500))]
            if p[0] / p[1] >= 2:
                want.append((a / fs, b / fs, (a + np.argmax(rms[a:b])) / fs, (rms[a:b].max() - quiet.mean()) / quiet.std()))
    assert np.allclose([(g[2], g[3], g[4], g[7]) for g in got], want, rtol=1e-4)
    assert all(any(g[2] <= at <= g[3] and abs(g[6] - 140) < 20 for g in got) for at in planted) and not any(g[2] < 9.2 < g[3] for g in got)
    assert detectors.fast_oscillations(spark.createDataFrame(cut(x, 1, "Cz"), SCHEMA), 256.0, PER).count() == 0


def test_gaps_short_repeated_and_broken_epochs(spark, trace):
    sos = dsp.butter_sos(4, (11.0, 16.0), FS)
    rows = cut(trace[: 9 * PER], 1, "A")
    rows = rows[:3] + rows[4:6] + [(1, "A", 6, rows[6][3][:100])] + rows[7:] + [rows[0], (1, "A", None, [1.0]), (1, "A", 20, None), (1, "A", 30, []), (2, None, 0, [float("nan")] * PER)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = traces.filtered(df, lambda x, left, right: (dsp.sosfiltfilt(sos, x)[0],), ["y"], PER, traces.settle(sos), 0, 2).orderBy("rec", "first").collect()
    held = {}
    for r in got:
        held.update({(r.rec, r["first"] + i): v for i, v in enumerate(r.y)})
    for a, b in ((0, 3 * PER), (4 * PER, 6 * PER + 100), (7 * PER, 9 * PER)):
        want = plain_filtfilt(sos, trace[a:b])
        assert np.allclose([held.pop((1, i)) for i in range(a, b)], want, atol=1e-6 * np.abs(want).max())
    assert len(held) == PER and not any(held.values())  # the recording without a finite sample
    none = df.limit(0)
    for found in (detectors.spindles(none, FS, PER), detectors.bursts(none, FS, PER), detectors.spikes(none, FS, PER), detectors.slow_waves(none, FS, PER, F.lit(40))):
        assert found.count() == 0


def test_exact_quantiles_against_sorting(spark):
    rng = np.random.default_rng(2)
    data = {"a": [rng.standard_normal(500), rng.standard_normal(3)], "b": [np.zeros(40), -np.zeros(1), np.full(60, 7.25)], "c": [np.array([1e300, -1e300, 5e-324, 1.0])],
            "d": [np.array([4.0])], None: [rng.standard_normal(7) * 1e-8]}
    rows = [(k, [float(v) for v in x]) for k, parts in data.items() for x in parts] + [("e", []), ("e", None), ("e", [float("nan"), None]), ("d", [float("nan"), None])]
    probs = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]
    got = {r.k: tuple(r)[1:] for r in traces.exact_quantiles(spark.createDataFrame(rows, "k string, v array<double>"), ["k"], "v", probs).collect()}
    assert got.keys() == {"a", "b", "c", "d"}  # a null key joins nothing
    for k in got:
        x = np.concatenate(data[k])
        assert got[k][0] == len(x) and np.allclose(got[k][1:], np.quantile(x, probs), rtol=1e-12)


def test_kernels_run_from_any_working_directory(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from wavelake import catalog
for name in ("spindles", "slow_waves", "bursts", "spikes", "band_powers", "entropies", "wpli", "graph_metrics", "microstates", "hfo", "blinks", "spindle_density", "slow_wave_means"):
    catalog.queries()[name](spark, "/root/testdata/sf0.001").collect()
print("all ran")
"""
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=600, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert "all ran" in run.stdout, run.stderr[-2000:]


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master, _wavelake_dir = "spark://host:7077", None

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError):
        shared_dir(Session())
