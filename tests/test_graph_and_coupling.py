"""Weighted graphs against dense matrices, and the coupling of spindles to slow oscillations on planted phases."""

import numpy as np

from wavelake.functions import dsp
from wavelake.operators import detectors, graph


def dense(edges, g):
    names = sorted({v for k, i, j, _ in edges if k == g for v in (i, j)})
    w = np.zeros((len(names), len(names)))
    for k, i, j, s in edges:
        if k == g:
            w[names.index(i), names.index(j)] = w[names.index(j), names.index(i)] = s
    return names, w


def plain_clustering(w, i):
    near = np.flatnonzero(w[i])
    total = sum((w[i, a] * w[i, b] * w[a, b] / w.max() ** 3) ** (1 / 3) for x, a in enumerate(near) for b in near[x + 1:])
    return 2 * total / (len(near) * (len(near) - 1)) if len(near) > 1 else 0.0


def plain_efficiency(w):
    n = len(w)
    dist = {}
    for s in range(n):  # shortest paths from each node, edge by edge
        best = [np.inf] * n
        best[s] = 0
        for _ in range(n):
            for a in range(n):
                for b in range(n):
                    if w[a, b] > 0:
                        best[b] = min(best[b], best[a] + 1 / w[a, b])
        dist[s] = best
    return sum(1 / dist[a][b] for a in range(n) for b in range(n) if a != b and np.isfinite(dist[a][b])) / (n * (n - 1)) if n > 1 else 0.0


def test_weighted_graphs_against_dense_ones(spark):
    rng = np.random.default_rng(1)
    edges = [(g, f"n{i:02}", f"n{j:02}", float(rng.uniform(0.05, 0.9))) for g, n, p in ((1, 12, 0.5), (2, 9, 0.25), (3, 5, 1.0)) for i in range(n) for j in range(i + 1, n) if rng.random() < p]
    edges += [(4, "a", "b", 0.5), (5, "a", "b", 0.3), (5, "c", "d", 0.6)]
    df = spark.createDataFrame(edges, "g int, i string, j string, w double")
    c = {(r.g, r.node): r.clustering for r in graph.node_clustering(df, ["g"]).collect()}
    e = {(r.g, r.node): r.efficiency for r in graph.node_efficiency(df, ["g"]).collect()}
    sigma = {r.g: r.sigma for r in graph.small_world(df, ["g"]).collect()}
    for g in range(1, 6):
        names, w = dense(edges, g)
        for i, v in enumerate(names):
            near = np.flatnonzero(w[i])
            assert abs(c.pop((g, v)) - plain_clustering(w, i)) < 1e-12
            assert abs(e.pop((g, v)) - plain_efficiency(w[np.ix_(near, near)])) < 1e-12
        assert abs(graph.efficiency(w) - plain_efficiency(w)) < 1e-12
        cr, lr = [], []
        for draw in range(10):
            at, new = np.triu_indices(len(w), 1), np.zeros_like(w)
            new[at] = np.random.default_rng([0, draw]).permutation(w[at])
            new = new + new.T
            cr.append(np.mean([plain_clustering(new, i) for i in range(len(new))]))
            lr.append(graph.path_length(new))
        want = None if not np.mean(cr) else np.mean([plain_clustering(w, i) for i in range(len(w))]) / np.mean(cr) / (graph.path_length(w) / np.mean([v for v in lr if np.isfinite(v)]))
        assert (sigma[g] is None) == (want is None) and (want is None or abs(sigma[g] - want) < 1e-9)
    assert not c and not e


FS, PER, SECONDS = 100.0, 1000, 600


def test_coupling_of_planted_phases(spark):
    t = np.arange(int(FS * SECONDS)) / FS
    x = 100 * np.sin(2 * np.pi * 0.75 * t)
    rows = [(rec, ch, i // PER, [float(v) for v in x[i: i + PER]]) for rec, ch in ((1, "fixed"), (2, "spread"), (3, "half"), (4, "few"), (5, "none"), (6, "no waves")) for i in range(0, len(x), PER)]
    df = spark.createDataFrame(rows, "rec long, ch string, epoch long, samples array<double>")
    rng = np.random.default_rng(7)
    fixed = (np.arange(30) + 20 + 0.1) / 0.75
    peaks = {(1, "fixed"): fixed, (2, "spread"): rng.uniform(30, 560, 50), (3, "half"): np.concatenate([fixed[:12], rng.uniform(30, 560, 18)]), (4, "few"): fixed[:5], (6, "no waves"): fixed}
    troughs = [(rec, ch, float((k + 0.75) / 0.75)) for rec, ch in peaks if rec != 6 for k in range(int(SECONDS * 0.75) - 1)]
    found = spark.createDataFrame([(*k, float(v)) for k, ps in peaks.items() for v in ps] + [(1, "fixed", 5000.0), (1, "fixed", None)], "rec long, ch string, peak_s double")
    waves = spark.createDataFrame(troughs + [(5, "none", 1.0)], "rec long, ch string, neg_peak_s double")
    got = {r.rec: r for r in detectors.coupling(df, FS, PER, found, waves, core=7).collect()}
    assert [got[k].status for k in range(1, 7)] == ["ok", "ok", "ok", "insufficient_events", "no_spindles", "no_slow_waves"]
    h = dsp.fir_band(300, (0.5, 1.25), FS)
    y = dsp.firfiltfilt(h, x)
    spec = np.fft.fft(y, 8 * len(y))
    spec[1: 4 * len(y)] *= 2
    spec[4 * len(y) + 1:] = 0
    phase = np.angle(np.fft.ifft(spec)[: len(y)])
    for rec, key in ((1, (1, "fixed")), (2, (2, "spread")), (3, (3, "half"))):
        z = np.exp(1j * phase[[round(v * FS) for v in peaks[key]]])
        n, r = len(z), got[rec]
        assert r.n_coupled == n and abs(r.plv - abs(z.mean())) < 1e-3 and abs(abs(z.mean()) ** 2 * n - r.rayleigh_z) < 0.02
        assert abs((r.preferred_deg - np.angle(z.mean(), deg=True) + 180) % 360 - 180) < 0.1
    assert got[1].plv > 0.99 and got[1].rayleigh_p < 1e-6 and got[2].plv < 0.25 and got[2].rayleigh_p > 0.05 and 0.2 < got[3].plv < 0.75
    assert got[4].plv is None and got[1].n_spindles == 31
