"""Queries whose filters need numpy kernels, over stored epochs: one row of samples per recording, channel and epoch.

A kernel sees one epoch at a time, so what a worker holds is bounded by an epoch; what belongs to a recording is
summed or ranked by Spark. Detectors that need the whole trace are in ``detectors``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelake.functions import dsp
from wavelake.operators import graph
from wavelake.plans.base import FS, query, rounded, stage_of, stored_epochs
from wavelake.session import saved


def per_epoch(df: DataFrame, kernel, schema: str) -> DataFrame:
    """Apply a kernel (samples -> list of rows) to every epoch (rec, ch, epoch, samples)."""
    names = ["rec", "ch", "epoch", *[c.split()[0] for c in schema.split(", ")]]

    def run(parts):
        for part in parts:
            rows = [(rec, ch, epoch, *row) for rec, ch, epoch, x in part.itertuples(index=False) for row in kernel(np.asarray(x, float))]
            yield pd.DataFrame(rows, columns=names)

    return df.select("rec", "ch", "epoch", "samples").mapInPandas(run, f"rec bigint, ch string, epoch bigint, {schema}")


def epochs_by_channel(df: DataFrame) -> DataFrame:
    """rec, epoch, chans: the channels of an epoch together, in the order of their names."""
    return df.groupBy("rec", "epoch").agg(F.array_sort(F.collect_list(F.struct("ch", "samples"))).alias("chans"))


def band_rows(x: np.ndarray):
    """Band powers, delta over alpha, peak frequency, and the slope of the log spectrum."""
    f, p = dsp.welch(x, FS, int(4 * FS))
    p = p[0]
    power = {n: float(p[(f >= a) & (f < b)].sum()) for n, a, b in (("delta", 0.5, 4), ("theta", 4, 8), ("alpha", 8, 13), ("beta", 13, 30))}
    total = sum(power.values())
    ok = (f >= 4) & (f <= 13)
    fit = (f >= 2) & (f <= 30) & ((f < 3.5) | (f > 14)) & (p > 0)
    slope = -np.polyfit(np.log10(f[fit]), np.log10(p[fit]), 1)[0]
    stage = "N2" if power["alpha"] and np.sqrt(power["delta"] / power["alpha"]) > 3 else "N1" if power["alpha"] and np.sqrt(power["delta"] / power["alpha"]) > 1.5 else "W"
    return [(*(100 * power[n] / total for n in ("delta", "theta", "alpha", "beta")), power["delta"] / power["alpha"], float(f[ok][np.argmax(p[ok])]), float(slope), stage)]


def entropy_rows(x: np.ndarray):
    """Spectral and sample entropy, Higuchi dimension, Lempel-Ziv complexity of a whole epoch (of 2,000 samples at most)."""
    _, p = dsp.welch(x, FS, 256)
    q = p[0] / p[0].sum()
    q = q[q > 0]
    spectral = float(-(q * np.log2(q)).sum() / np.log2(len(p[0])))
    r = 0.2 * x.std()
    last = len(x) - 2
    two = np.abs(x[:last, None] - x[None, :last]) <= r
    two &= np.abs(x[1: last + 1, None] - x[None, 1: last + 1]) <= r
    three = two & (np.abs(x[2:, None] - x[None, 2:]) <= r)
    hits = [(near.sum() - last) / 2 for near in (two, three)]
    sample = float(-np.log(hits[1] / hits[0])) if hits[0] and hits[1] else None
    lengths, ks = [], range(1, 9)
    for k in ks:
        each = []
        for m in range(k):
            z = x[m::k]
            each.append(np.abs(np.diff(z)).sum() * (len(x) - 1) / ((len(z) - 1) * k) / k)
        lengths.append(np.mean(each))
    higuchi = float(np.polyfit(np.log(1 / np.array(ks)), np.log(lengths), 1)[0])
    bits = (x > np.median(x)).astype(np.int8).tobytes()
    i, n_words, size = 0, 0, 1
    while i + size <= len(bits):
        if bits[i: i + size] in bits[: i + size - 1]:
            size += 1
        else:
            n_words, i, size = n_words + 1, i + size, 1
    return [(spectral, sample, higuchi, float(n_words * np.log2(len(bits)) / len(bits)))]


def blink_rows(x: np.ndarray, y: np.ndarray, fs: float = FS):
    """The larger of two frontal channels at 0.5-4 Hz; peaks of 75 µV, 0.3 s apart."""
    sos = dsp.butter_sos(2, (0.5, 4), fs)
    both = np.maximum(np.abs(dsp.sosfiltfilt(sos, x)[0]), np.abs(dsp.sosfiltfilt(sos, y)[0]))
    return [(i / fs, float(both[i])) for i in dsp.find_peaks(both, 75.0, int(0.3 * fs))]


@query("band_powers")
def band_powers(spark, d):
    return rounded(per_epoch(stored_epochs(spark, d), band_rows, "delta_pct double, theta_pct double, alpha_pct double, beta_pct double, dar double, peak_hz double, aperiodic double, stage string"))


@query("entropies")
def entropies(spark, d):
    """Medians over the epochs of a channel."""
    rows = per_epoch(stored_epochs(spark, d), entropy_rows, "spectral double, sample double, higuchi double, lempel_ziv double")
    return rounded(rows.groupBy("rec", "ch").agg(*[F.median(c).alias(c) for c in ("spectral", "sample", "higuchi", "lempel_ziv")], F.count(F.lit(1)).alias("n_epochs")))


def cross_sums(x: np.ndarray, y: np.ndarray, low: float = 8.0, high: float = 13.0) -> tuple[float, float, float]:
    """Sums of the imaginary cross-spectrum of two channels over 2 s segments and the bins of a band: plain, squared, absolute."""
    n = int(2 * FS)
    f = np.fft.rfftfreq(n, 1 / FS)
    ok = (f >= low) & (f < high)
    parts = [z[: len(z) // n * n].reshape(-1, n) for z in (x, y)]
    a, b = (np.fft.rfft(z - z.mean(axis=1, keepdims=True), axis=1)[:, ok] for z in parts)
    im = (a * np.conj(b)).imag
    return float(im.sum()), float((im * im).sum()), float(np.abs(im).sum())


@query("wpli")
def wpli(spark, d):
    """Debiased weighted phase lag index of channel pairs; each epoch's sums are added up by Spark."""
    names = ["rec", "ch_i", "ch_j", "s", "q", "m"]

    def run(parts):
        for part in parts:
            rows = []
            for rec, chans in zip(part["rec"], part["chans"], strict=True):
                for i in range(len(chans)):
                    for j in range(i + 1, len(chans)):
                        x, y = (np.asarray(chans[k]["samples"], float) for k in (i, j))
                        n = min(len(x), len(y))
                        rows.append((rec, chans[i]["ch"], chans[j]["ch"], *cross_sums(x[:n], y[:n])))
            yield pd.DataFrame(rows, columns=names)

    sums = epochs_by_channel(stored_epochs(spark, d)).select("rec", "chans").mapInPandas(run, "rec bigint, ch_i string, ch_j string, s double, q double, m double")
    g = sums.groupBy("rec", "ch_i", "ch_j").agg(*[F.sum(c).alias(c) for c in ("s", "q", "m")])
    w = (F.col("s") ** 2 - F.col("q")) / F.when(F.col("m") ** 2 > F.col("q"), F.col("m") ** 2 - F.col("q"))
    return g.select("rec", "ch_i", "ch_j", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), w)), 5).alias("w"))


@query("graph_metrics")
def graph_metrics(spark, d):
    """Strength, path length and efficiency of each recording's weighted graph (a few channels, one group), its mean clustering and
    local efficiency, and how they stand to graphs of the same weights dealt anew."""
    e = saved(wpli(spark, d).where("w > 0").select("rec", F.col("ch_i").alias("i"), F.col("ch_j").alias("j"), "w"), "graph")

    def run(pdf):
        names = sorted(set(pdf.i) | set(pdf.j))
        at = {c: i for i, c in enumerate(names)}
        w = np.zeros((len(names), len(names)))
        w[[at[c] for c in pdf.i], [at[c] for c in pdf.j]] = pdf.w
        w = w + w.T
        return pd.DataFrame({"rec": [pdf.rec.iloc[0]], "strength": [2 * pdf.w.sum() / len(names)], "path_length": [graph.path_length(w)], "efficiency": [graph.efficiency(w)]})

    out = e.groupBy("rec").applyInPandas(run, "rec bigint, strength double, path_length double, efficiency double")
    nodes = graph.node_clustering(e, ["rec"]).groupBy("rec").agg(F.avg("clustering").alias("clustering"))
    local = graph.node_efficiency(e, ["rec"]).groupBy("rec").agg(F.avg("efficiency").alias("local_efficiency"))
    sigma = graph.small_world(e, ["rec"]).withColumnRenamed("sigma", "small_world_sigma")
    return rounded(out.join(nodes, "rec").join(local, "rec").join(sigma, "rec"))


#: Stages that a spectrum is read in, and what its slope usually is there: mean and deviation (conventions, no published norms).
SLOPE_NORMS = {"W": (1.25, 0.3), "N2": (1.75, 0.3), "N3": (2.0, 0.3)}
#: Slopes outside of these are no fit.
SLOPES = (0.1, 5.0)


@query("aperiodic_by_stage")
def aperiodic_by_stage(spark, d):
    """Quartiles of the spectral slope of each channel and stage, and how far the median is from what is usual."""
    rows = per_epoch(stored_epochs(spark, d), band_rows, "delta_pct double, theta_pct double, alpha_pct double, beta_pct double, dar double, peak_hz double, aperiodic double, own_stage string")
    rows = rows.withColumn("stage", stage_of("epoch")).where(F.col("aperiodic").between(*SLOPES))
    g = rows.groupBy("rec", "ch", "stage").agg(F.count(F.lit(1)).alias("n"), F.percentile("aperiodic", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    norm = F.create_map(*[v for k, (m, sd) in SLOPE_NORMS.items() for v in (F.lit(k), F.struct(F.lit(m).alias("m"), F.lit(sd).alias("sd")))])[F.col("stage")]
    return rounded(g.select("rec", "ch", "stage", "n", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), ((F.col("q")[1] - norm.m) / norm.sd).alias("z")))


BANDS = (("delta", 0.5, 4), ("theta", 4, 8), ("alpha", 8, 13), ("beta", 13, 30))
#: Channels that stand for the posterior ones, left and right.
POSTERIOR = {"C1": "left", "C2": "right", "C3": "left"}


@query("background_power")
def background_power(spark, d):
    """A2: the mean spectrum of a recording's posterior channels awake: shares of the bands (ratios of means), delta over alpha, the dominant frequency of 4-13 Hz,
    and how the sides differ in alpha: under 0.05 symmetric, from 0.2 on marked."""
    n = 4 * int(FS) // 2 + 1

    def spectrum(x):
        if len(x) < 4 * FS:
            return []
        return [(i, float(v)) for i, v in enumerate(dsp.welch(x, FS, int(4 * FS))[1][0])]

    e = stored_epochs(spark, d).where(F.col("ch").isin(*POSTERIOR)).where(stage_of("epoch") == "W")
    side = F.create_map(*[F.lit(v) for kv in POSTERIOR.items() for v in kv])[F.col("ch")]
    bins = per_epoch(e, spectrum, "bin int, p double").groupBy("rec", "bin").agg(F.avg("p").alias("p"), F.avg(F.when(side == "left", F.col("p"))).alias("l"), F.avg(F.when(side == "right", F.col("p"))).alias("r"))
    hz = F.col("bin") / F.lit(4.0)
    inside = lambda c, a, b: F.sum(F.when((hz >= a) & (hz < b), F.col(c)))
    top = F.max_by(hz, F.when((hz >= 4) & (hz <= 13), F.struct("p", (-hz).alias("h"))))
    g = bins.where(F.col("bin") < n).groupBy("rec").agg(*[inside("p", a, b).alias(k) for k, a, b in BANDS], top.alias("pdr_hz"), inside("l", 8, 13).alias("left"), inside("r", 8, 13).alias("right"))
    total = F.col("delta") + F.col("theta") + F.col("alpha") + F.col("beta")
    off = F.try_divide(F.col("left") - F.col("right"), F.col("left") + F.col("right"))
    label = F.when(off.isNull(), "not_computed").when(F.abs(off) >= 0.2, "marked_asymmetric").when(F.abs(off) < 0.05, "symmetric").when(off > 0, "lh_dominant").otherwise("rh_dominant")
    return rounded(g.select("rec", *[F.try_divide(100 * F.col(k), total).alias(f"{k}_pct") for k, _, _ in BANDS], F.try_divide("delta", "alpha").alias("dar"), "pdr_hz", off.alias("asymmetry"), label.alias("label")))


#: Starts of the clustering of topographies, and its states.
STARTS, STATES = 20, 4


def microstate_rows(x: np.ndarray, fs: float):
    """Name, coverage in percent, mean length in ms and occurrences a second of the states of a recording (channels by samples), largest first.

    Topographies at maxima of the global field are clustered without regard to polarity, the best of STARTS seeded starts; each sample then takes the state
    that it is most like."""
    x = x - x.mean(axis=0)
    at = dsp.find_peaks(x.std(axis=0), 0.0, 2)
    size = np.linalg.norm(x[:, at], axis=0)
    at, size = at[size > 0], size[size > 0]
    if not len(at):
        return []
    maps = (x[:, at] / size).T
    k, best = min(STATES, len(maps)), None
    for start in range(STARTS):
        c = maps[np.random.default_rng([42, start]).choice(len(maps), k, replace=False)]
        for _ in range(30):
            lab = np.abs(maps @ c.T).argmax(axis=1)
            c = np.stack([np.linalg.svd(maps[lab == j], full_matrices=False)[2][0] if (lab == j).any() else c[j] for j in range(k)])
        fit = (np.abs(maps @ c.T).max(axis=1) ** 2).mean()
        if best is None or fit > best[0] + 1e-12:
            best = (fit, c)
    state = np.abs((x / np.maximum(np.linalg.norm(x, axis=0), 1e-12)).T @ best[1].T).argmax(axis=1)
    rows = []
    for name, j in zip("ABCD", np.argsort(-np.bincount(state, minlength=k), kind="stable"), strict=False):
        runs = dsp.true_runs(state == j)
        rows.append((name, float((state == j).mean() * 100), float((runs[:, 1] - runs[:, 0]).mean() / fs * 1000) if len(runs) else 0.0, len(runs) / (x.shape[1] / fs)))
    return rows


@query("microstates")
def microstates(spark, d):
    """A14 on the recordings' joined epochs that hold all channels; a recording is at most 16 epochs here."""
    cols = ["rec", "state", "coverage_pct", "mean_ms", "per_s"]

    def run(pdf):
        pdf = pdf.sort_values("epoch")
        names = [tuple(c["ch"] for c in chans) for chans in pdf["chans"]]
        full = max(set(names), key=lambda v: (len(v), v))
        blocks = [np.stack([np.asarray(c["samples"], float) for c in chans]) for chans, n in zip(pdf["chans"], names, strict=True)
                  if n == full and len({len(c["samples"]) for c in chans}) == 1]
        rows = microstate_rows(np.concatenate(blocks, axis=1), FS) if len(full) >= 3 and blocks else []
        return pd.DataFrame([(pdf["rec"].iloc[0], *row) for row in rows], columns=cols)

    wide = epochs_by_channel(stored_epochs(spark, d))
    return rounded(wide.groupBy("rec").applyInPandas(run, "rec bigint, state string, coverage_pct double, mean_ms double, per_s double"))


@query("blinks")
def blinks(spark, d):
    """Blinks of an epoch from its first two channels, and whether the epoch is clean."""

    def run(parts):
        for part in parts:
            rows = []
            for rec, epoch, chans in part.itertuples(index=False):
                found = blink_rows(*(np.asarray(c["samples"], float) for c in chans[:2])) if len(chans) > 1 and len(chans[0]["samples"]) == len(chans[1]["samples"]) else []
                rows.append((rec, epoch, len(found), not found))
            yield pd.DataFrame(rows, columns=["rec", "epoch", "n_blinks", "clean"])

    return epochs_by_channel(stored_epochs(spark, d)).select("rec", "epoch", "chans").mapInPandas(run, "rec bigint, epoch bigint, n_blinks bigint, clean boolean")
