"""Spectra by stage and microstates, against plain sums and planted maps."""

import numpy as np
import pytest

import wavelake.catalog as catalog
from wavelake.plans import kernels

SF = "/root/testdata/sf0.01"
STAGES = ("W", "N1", "N2", "N3", "N2", "REM")


@pytest.fixture(scope="module")
def data():
    import duckdb

    out = {}
    for i, v in duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall():
        out.setdefault((i // 512, f"C{i % 4}", i // 32 % 16), []).extend(400.0 * x for x in v)
    return {k: np.array(v) for k, v in out.items()}


def spectrum(x):
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256)
    parts = [x[i: i + 256] for i in range(0, len(x) - 255, 128)]
    p = np.mean([np.abs(np.fft.rfft((q - q.mean()) * win)) ** 2 for q in parts], axis=0)
    p[1:-1] *= 2
    return np.fft.rfftfreq(256, 1 / 64), p


def test_background_power_of_wake_epochs(spark, data):
    got = {r.rec: r for r in catalog.queries()["background_power"](spark, SF).collect()}
    for rec, r in got.items():
        own = {k: spectrum(x)[1] for k, x in data.items() if k[0] == rec and k[1] != "C0" and STAGES[k[2] % 6] == "W" and len(x) >= 256}
        f = spectrum(next(iter(data.values())))[0]
        p, left, right = (np.mean([v for k, v in own.items() if k[1] in chans], axis=0) for chans in (("C1", "C2", "C3"), ("C1", "C3"), ("C2",)))
        power = {n: p[(f >= a) & (f < b)].sum() for n, a, b in kernels.BANDS}
        assert np.allclose([r.delta_pct, r.theta_pct, r.alpha_pct, r.beta_pct], [100 * v / sum(power.values()) for v in power.values()], atol=1e-3)
        ok = (f >= 4) & (f <= 13)
        side = [v[(f >= 8) & (f < 13)].sum() for v in (left, right)]
        off = (side[0] - side[1]) / sum(side)
        assert r.pdr_hz == f[ok][np.argmax(p[ok])] and abs(r.dar - power["delta"] / power["alpha"]) < 1e-4 and abs(r.asymmetry - off) < 1e-4
        assert r.label == ("symmetric" if abs(off) < 0.05 else "marked_asymmetric" if abs(off) >= 0.2 else "lh_dominant" if off > 0 else "rh_dominant")
    assert got


def test_slopes_by_stage(spark, data):
    want = {}
    for (rec, ch, epoch), x in data.items():
        f, p = spectrum(x)
        ok = (f >= 2) & (f <= 30) & ((f < 3.5) | (f > 14))
        lx, ly = np.log10(f[ok]), np.log10(p[ok])
        chi = -((lx - lx.mean()) * (ly - ly.mean())).sum() / ((lx - lx.mean()) ** 2).sum()
        if 0.1 <= chi <= 5:
            want.setdefault((rec, ch, STAGES[epoch % 6]), []).append(chi)
    got = {(r.rec, r.ch, r.stage): r for r in catalog.queries()["aperiodic_by_stage"](spark, SF).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k].n == len(v) and np.allclose([got[k].p25, got[k].median, got[k].p75], np.percentile(v, [25, 50, 75]), atol=2e-5)
        norm = kernels.SLOPE_NORMS.get(k[2])
        assert got[k].z is None if norm is None else abs(got[k].z - (np.median(v) - norm[0]) / norm[1]) < 1e-3


def test_planted_microstates():
    """Four topographies of a second each in turn, of either polarity: 250 ms out of each second and 1,000 ms long."""
    rng, fs = np.random.default_rng(7), 64.0
    maps = np.linalg.qr(rng.standard_normal((8, 4)) - rng.standard_normal((8, 4)).mean(axis=0))[0].T
    maps = maps - maps.mean(axis=1, keepdims=True)
    t = np.arange(int(120 * fs))
    order = (t // int(fs)) % 4
    x = (maps[order] * (50 * np.sin(2 * np.pi * 10.3 * t / fs))[:, None]).T + 0.5 * rng.standard_normal((8, len(t)))
    rows = kernels.microstate_rows(x, fs)
    assert [r[0] for r in rows] == list("ABCD") and all(abs(r[1] - 25) < 3 for r in rows)
    assert kernels.microstate_rows(np.zeros((4, 100)), fs) == []
