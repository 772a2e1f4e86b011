"""Clean-up by independent components on planted sources."""

import numpy as np

import wavelake.catalog as catalog
from wavelake.operators import components

FS, PER = 100.0, 1000
SCHEMA = "rec long, ch string, epoch long, samples array<double>"


def planted(seconds=60, seed=0):
    rng, n = np.random.default_rng(seed), int(seconds * FS)
    t = np.arange(n) / FS
    blink = sum(np.exp(-0.5 * ((t - c) / 0.15) ** 2) for c in np.arange(2, seconds, 3))
    one, two = np.sin(2 * np.pi * 8 * t) + 0.3 * rng.standard_normal(n), np.sin(2 * np.pi * 11 * t) + 0.3 * rng.standard_normal(n)
    return blink, {"Fp1": 80 * blink + 10 * one, "fp2": 75 * blink + 10 * two, "C3": 3 * blink + 40 * one, "C4": 3 * blink + 40 * two}


def rows(rec, channels):
    return [(rec, c, i // PER, [float(v) for v in x[i: i + PER]]) for c, x in channels.items() for i in range(0, len(x), PER)]


def test_a_planted_frontal_source_goes_and_the_others_stay(spark):
    blink, channels = planted()
    bare = {c: x for c, x in channels.items() if c in ("C3", "C4")}
    broken = {c: x.copy() for c, x in channels.items()}
    broken["C3"][5] = np.nan
    quiet = {c: 0 * x for c, x in channels.items()}
    df = spark.createDataFrame(rows(1, channels) + rows(2, bare) + rows(3, broken) + rows(4, quiet) + [(1, "C3", 99, [1.0, 2.0])], SCHEMA)
    fitted = components.independent_components(df, FS, PER, ["FP1", "FP2"], core=2)
    got = fitted.collect()
    assert [r.rec for r in got] == [1] and len(got[0].removed) == 1 and got[0].channels == sorted(channels)
    out = {}
    for r in components.apply_components(df, fitted).collect():
        assert r.cleaned == (r.rec == 1 and r.epoch < 99)
        if r.rec == 1 and r.epoch < 99:
            out[r.ch, r.epoch] = r.samples
        elif r.epoch == 99:
            assert r.samples == [1.0, 2.0]
    clean = {c: np.concatenate([out[c, e] for e in range(6)]) for c in channels}
    for c in ("C3", "C4"):
        assert np.corrcoef(clean[c], channels[c] - 3 * blink)[0, 1] > 0.99
    for c, w in (("Fp1", 80), ("fp2", 75)):
        assert abs(np.corrcoef(clean[c], blink)[0, 1]) < 0.2 and clean[c].std() < 0.4 * channels[c].std()
        assert np.corrcoef(clean[c], channels[c] - w * blink)[0, 1] > 0.95
    assert components.independent_components(df.limit(0), FS, PER, ["FP1"]).count() == 0


def test_moments_of_chunks_are_those_of_the_whole_trace(spark):
    """The same matrix from chunks of two epochs and from one that holds everything."""
    df = spark.createDataFrame(rows(1, planted()[1]), SCHEMA)
    a, b = (components.independent_components(df, FS, PER, ["Fp1", "Fp2"], core=core).first() for core in (2, 50))
    assert np.allclose(a.clean, b.clean, atol=1e-5) and a.removed == b.removed


def test_query_takes_the_blinks_out(spark):
    for r in catalog.queries()["component_cleanup"](spark, "/root/testdata/sf0.01").collect():
        assert r.n_removed >= 1 and r.rms_after < r.rms_before
