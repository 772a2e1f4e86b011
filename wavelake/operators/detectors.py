"""Event detectors over whole traces: filters in chunks with halos, thresholds from all samples of a channel, events across seams once.

Every detector takes epochs (rec, ch, epoch, samples) of one rate ``fs`` with ``per_epoch`` samples each, and gives times in seconds
from epoch 0 of its recording. Gaps of missing epochs end a trace; see ``traces`` for short, repeated and non-finite epochs. An empty
table, and a recording without events, give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wavelake.functions import dsp
from wavelake.session import saved, ship

from .joins import exists_within
from .recordings import event_windows, live_channels, merge_keep_larger
from .traces import analytic, core_of, envelope, exact_quantiles, filtered, joined_runs, per_row, settle

KEYS = ["rec", "ch"]


def band_peak(x: np.ndarray, fs: float, low: float, high: float) -> float | None:
    """Frequency of the largest Fourier magnitude inside a band, none if it holds no bin."""
    f = np.fft.rfftfreq(len(x), 1 / fs)
    ok = (f >= low) & (f <= high)
    return float(f[ok][np.argmax(np.abs(np.fft.rfft(x))[ok])]) if ok.any() else None


def own_runs(flag: np.ndarray, before: int, n: int):
    """Runs of true that start inside the core."""
    return [(a, b) for a, b in dsp.true_runs(flag).tolist() if before <= a < before + n]


#: Bands of spindles and slow waves, and the seconds that each may last.
SPINDLE_BAND, SPINDLE_S, SLOW_BAND, SLOW_S = (11.0, 16.0), (0.5, 2.5), (0.3, 1.5), (0.3, 1.5)


def spindle_kernel(fs: float):
    """The band, and its envelope averaged over 0.2 s."""
    sos, fade, window = dsp.butter_sos(4, SPINDLE_BAND, fs), int(3 * fs), max(1, int(0.2 * fs))

    def kernel(x, left, right):
        y = dsp.sosfiltfilt(sos, x)[0]
        return y, dsp.moving_average(envelope(y, left, right, fade), window)

    return kernel


def spindle_events(fs: float):
    least, most = (int(s * fs) for s in SPINDLE_S)

    def events(band, env, before, n, first, q0):
        for a, b in own_runs(env > q0, before, n):
            if least <= b - a <= most:
                top, t = a + int(np.argmax(env[a:b])), first - before
                yield (a + t) / fs, (b + t) / fs, (top + t) / fs, (b - a) / fs, float(env[top]), band_peak(band[a:b], fs, *SPINDLE_BAND)

    return events


def spindles(df: DataFrame, fs: float, per_epoch: int, core: int | None = None, percentile: float = 0.9) -> DataFrame:
    """Rec, ch, start_s, end_s, peak_s, duration_s, amplitude, peak_hz. The envelope of 11-16 Hz, averaged over 0.2 s, stays above its
    percentile over the whole trace for 0.5 to 2.5 s."""
    reach = settle(dsp.butter_sos(4, SPINDLE_BAND, fs)) + int(3 * fs) + max(1, int(0.2 * fs))
    held = saved(filtered(df, spindle_kernel(fs), ["band", "env"], per_epoch, reach, int(SPINDLE_S[1] * fs) + 2, core), "spindles")
    limit = exact_quantiles(held.select(*KEYS, core_of("env").alias("env")), KEYS, "env", [percentile])
    return per_row(held.join(limit, KEYS), KEYS, ["band", "env", "before", "n", "first", "q0"], spindle_events(fs),
                   "start_s double, end_s double, peak_s double, duration_s double, amplitude double, peak_hz double")


def slow_wave_events(fs: float):
    least, most = (int(s * fs) for s in SLOW_S)

    def events(band, before, n, first, depth):
        t = first - before
        for a, b in own_runs(band < -depth, before, n):
            if least <= b - a <= most:
                low, stop = a + int(np.argmin(band[a:b])), min(2 * b - a, len(band))
                trough, crest = float(band[low]), float(band[b:stop].max()) if stop > b else 0.0
                yield ((a + t) / fs, (low + t) / fs, (b + t) / fs, (stop + t) / fs, trough, crest, crest - trough, (b - a) / fs, -trough / max((b - low) / fs, 1e-6))

    return events


def slow_waves(df: DataFrame, fs: float, per_epoch: int, depth: Column, core: int | None = None) -> DataFrame:
    """Rec, ch, start_s, neg_peak_s, zero_cross_s, end_s, neg_peak_uv, pos_peak_uv, ptp_uv, duration_s, slope_uv_per_s. 0.3-1.5 Hz stays below
    -``depth`` (a column over the keys) for 0.3 to 1.5 s; the crest is sought in as many samples behind it."""
    sos = dsp.butter_sos(4, SLOW_BAND, fs)
    held = filtered(df, lambda x, left, right: (dsp.sosfiltfilt(sos, x)[0],), ["band"], per_epoch, settle(sos), 2 * int(SLOW_S[1] * fs) + 2, core).withColumn("depth", depth.cast("double"))
    return per_row(held, KEYS, ["band", "before", "n", "first", "depth"], slow_wave_events(fs), "start_s double, neg_peak_s double, zero_cross_s double, end_s double, neg_peak_uv double, "
                   "pos_peak_uv double, ptp_uv double, duration_s double, slope_uv_per_s double")


def bursts(df: DataFrame, fs: float, per_epoch: int, core: int = 16, band=(5.0, 25.0), times: float = 4.0, least_s: float = 3.0) -> DataFrame:
    """Rec, ch, start_s, end_s, duration_s, dominant_hz, n_involved, peak_channel, peak_ptp. The rectified band, averaged over 0.25 s, stays above
    ``times`` the band's median absolute deviation over the whole trace for ``least_s`` at least, over as many chunks as it takes.

    A channel of the recording is involved if its peak-to-peak range during the burst is over three times the median range of its 2 s tiles;
    the peak channel is the one of the largest range, the first by name on a tie. The samples of one burst are brought
    together for its spectrum."""
    sos, window = dsp.butter_sos(4, band, fs), max(1, int(0.25 * fs))

    def kernel(x, left, right):
        y = dsp.sosfiltfilt(sos, x)[0]
        return y, dsp.moving_average(np.abs(y), window)

    held = saved(filtered(df, kernel, ["band", "env"], per_epoch, settle(sos) + window, 0, core), "bursts")
    med = exact_quantiles(held, KEYS, "band", [0.5]).select(*KEYS, F.col("q0").alias("med"))
    off = held.join(med, KEYS).select(*KEYS, F.transform("band", lambda x: F.abs(x - F.col("med"))).alias("off"))
    limit = exact_quantiles(off, KEYS, "off", [0.5]).select(*KEYS, (times * F.col("q0")).alias("least"))

    def above(env, first, least):
        for a, b in dsp.true_runs(env > least).tolist():
            yield first + a, first + b

    runs = per_row(held.join(limit, KEYS), KEYS, ["env", "first", "least"], above, "start bigint, stop bigint")
    found = saved(joined_runs(runs, KEYS).where(F.col("stop") - F.col("start") >= int(least_s * fs)), "burst-runs")

    event = [*KEYS, "start", "stop"]
    size = core * per_epoch
    parts = found.withColumn("chunk", F.explode(F.expr(f"sequence(start div {size}, (stop - 1) div {size})"))).join(held, [*KEYS, "chunk"])
    lo, hi = F.greatest("start", "first"), F.least(F.col("stop"), F.col("first") + F.col("n"))
    parts = parts.where(lo < hi).select(*event, lo.alias("at"), F.slice("band", (lo - F.col("first") + 1).cast("int"), (hi - lo).cast("int")).alias("x"))
    whole = parts.groupBy(*event).agg(F.flatten(F.array_sort(F.collect_list(F.struct("at", "x"))).getField("x")).alias("x"))
    tone = per_row(whole, event, ["x"], lambda x: [(band_peak(x, fs, 1.0, 15.0),)], "dominant_hz double")

    tile = int(2 * fs)
    tiles = F.expr(f"transform(filter(sequence(0, size(samples) div {tile}), t -> (t + 1) * {tile} <= size(samples)), "
                   f"t -> cast(array_max(slice(samples, t * {tile} + 1, {tile})) - array_min(slice(samples, t * {tile} + 1, {tile})) as double))")
    usual = exact_quantiles(df.select(*KEYS, tiles.alias("ptp")), KEYS, "ptp", [0.5]).select("rec", F.col("ch").alias("other"), F.col("q0").alias("usual"))
    touched = found.withColumn("epoch", F.explode(F.expr(f"sequence(start div {per_epoch}, (stop - 1) div {per_epoch})")))
    seen = touched.join(df.select("rec", F.col("ch").alias("other"), "epoch", "samples"), ["rec", "epoch"])
    at = F.col("epoch") * per_epoch
    lo, hi = F.greatest(F.col("start"), at), F.least(F.col("stop"), at + F.size("samples"))
    cut = F.slice("samples", (lo - at + 1).cast("int"), (hi - lo).cast("int"))
    reach = seen.where(lo < hi).withColumn("cut", cut).groupBy(*event, "other").agg((F.max(F.array_max("cut")) - F.min(F.array_min("cut"))).alias("ptp"))
    reach = reach.join(usual, ["rec", "other"], "left").groupBy(*event).agg(
        F.count_if(F.col("ptp") > 3 * F.col("usual")).alias("n_involved"), F.min(F.struct((-F.col("ptp")).alias("down"), F.col("other").alias("peak_channel"))).alias("m"))
    out = found.join(tone, event).join(reach, event, "left")
    return out.select(*KEYS, (F.col("start") / fs).alias("start_s"), (F.col("stop") / fs).alias("end_s"), ((F.col("stop") - F.col("start")) / fs).alias("duration_s"), "dominant_hz",
                      "n_involved", "m.peak_channel", (-F.col("m.down")).alias("peak_ptp"))


def spikes(df: DataFrame, fs: float, per_epoch: int, core: int | None = None, band=(10.0, 30.0), broad=(1.0, 35.0)) -> DataFrame:
    """Rec, ch, t_s, height, width_ms. Peaks of the whole trace's band that stand above six local deviations and three root mean squares of their
    epoch, 80 ms apart inside it. The width is that of the broad band above half of its size at the peak, sought up to 0.3 s to each side; null unless
    between 20 and 600 ms. The broad band ends below the half of a low rate."""
    sos, wide, apart, reach = dsp.butter_sos(4, band, fs), dsp.butter_sos(4, (broad[0], min(broad[1], 0.45 * fs)), fs), max(1, int(0.08 * fs)), int(0.3 * fs)
    held = filtered(df, lambda x, left, right: (dsp.sosfiltfilt(sos, x)[0], dsp.sosfiltfilt(wide, x)[0]), ["band", "broad"], per_epoch, max(settle(sos), settle(wide)), reach, core)

    def width(x, at):
        x, at = np.abs(x[max(0, at - reach): at + reach]), min(at, reach)
        under = np.flatnonzero(x <= x[at] / 2)
        left, right = under[under <= at], under[under >= at]
        ms = ((right[0] if len(right) else len(x) - 1) - (left[-1] if len(left) else 0)) * 1000 / fs
        return float(ms) if 20 < ms < 600 else None

    def events(band, broad, before, n, first):
        for a in range(before, before + n, per_epoch):
            x = band[a: min(a + per_epoch, before + n)]
            if len(x) < 2 * apart:
                continue
            mad = np.median(np.abs(x - np.median(x)))
            least = max(6 * mad, 3 * float(np.sqrt((x * x).mean())))
            if least > 0 and np.isfinite(least):
                for i in dsp.find_peaks(np.abs(x), least, apart).tolist():
                    yield (first - before + a + i) / fs, float(abs(x[i])), width(broad, a + i)

    return per_row(held, KEYS, ["band", "broad", "before", "n", "first"], events, "t_s double, height double, width_ms double")


def morphology(found: DataFrame) -> DataFrame:
    """Rec, ch, n_peaks, n_widths, pct_simple, pct_sharp, pct_complex, pct_polyspike, p25, p50, p75, classification, interpretation of ``spikes``.

    Widths under 70 ms are simple, under 200 sharp, others complex; polyspikes are the share of intervals between neighbouring peaks under 250 ms."""
    gap = F.col("t_s") - F.lag("t_s").over(W.partitionBy(*KEYS).orderBy("t_s"))
    w = F.col("width_ms")
    part = lambda c: F.try_divide(100.0 * F.count_if(c), F.count("width_ms"))
    g = found.withColumn("gap", gap).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_peaks"), F.count("width_ms").alias("n_widths"), part(w < 70).alias("pct_simple"), part((w >= 70) & (w < 200)).alias("pct_sharp"), part(w >= 200).alias("pct_complex"),
        F.coalesce(F.try_divide(100.0 * F.count_if(F.col("gap") < 0.25), F.count("gap")), F.lit(0.0)).alias("pct_polyspike"))
    q = exact_quantiles(found, KEYS, "width_ms", [0.25, 0.5, 0.75]).select(*KEYS, F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"))
    kind = F.when(F.col("n_widths") == 0, "no_events").when(F.col("pct_simple") > 60, "predominantly_simple").when(F.col("pct_complex") > 50, "predominantly_complex").otherwise("mixed")
    meaning = F.when(F.col("n_widths") == 0, "benign_focal").when((F.col("pct_polyspike") >= 20) | (F.col("pct_complex") >= 50), "encephalopathic").when(F.col("pct_simple") > 60, "benign_focal").otherwise("epileptiform_spectrum")
    return g.join(q, KEYS, "left").withColumn("classification", kind).withColumn("interpretation", meaning)


def hemisphere(channel: Column) -> Column:
    """left, right or mid: the last digit of a channel's name is odd, even or missing."""
    digit = F.regexp_extract(channel, r"([0-9])[^0-9]*$", 1)
    return F.when(digit == "", "mid").when(digit.cast("int") % 2 == 1, "left").otherwise("right")


def spike_average(events: DataFrame, df: DataFrame, fs: float, per_epoch: int, before_ms: float = 100.0, after_ms: float = 100.0, focal: float = 0.6, bilateral: float = 0.3) -> DataFrame:
    """Rec, n_spikes, peak_channel, peak_latency_ms, field_spread, topography of the average around ``events`` (rec, t_s), over all channels of a recording.

    Windows of all channels around each event are added position by position, as whole arrays, and divided; the field is taken where the sum of absolute
    averages is largest (first of ties). It is focal if one channel has at least ``focal`` of it, else bilateral if both sides have ``bilateral``, else regional; n/a if it is 0.
    Events whose window leaves the recording, lacks a channel or holds a sample that is not finite are left out. A recording without any is left out too. An event that is given twice counts twice."""
    import pyarrow as pa

    ship(df.sparkSession)
    before, after = round(before_ms / 1000 * fs), round(after_ms / 1000 * fs)
    names = df.groupBy("rec").agg(F.array_sort(F.collect_set("ch")).alias("names"))  # the channels of a recording
    times = events.where("t_s is not null").groupBy("rec", F.bround(F.col("t_s") * fs).cast("bigint").alias("at")).agg(F.count(F.lit(1)).alias("times"))
    each = times.select("rec", "at").join(names, "rec").select("rec", F.explode("names").alias("ch"), "at")
    cut = event_windows(each, df, before, after - 1, per_epoch).withColumn("samples", F.col("samples").cast("array<double>"))
    sane = F.forall("samples", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (F.size("samples") == before + after)
    whole = cut.groupBy("rec", "at").agg(F.count_if(sane).alias("fine")).join(names, "rec").where(F.col("fine") == F.size("names")).select("rec", "at").join(times, ["rec", "at"])
    kept = cut.join(whole, ["rec", "at"])
    kind = dict(df.dtypes)["rec"]

    def add(batches):
        for batch in batches:
            sums: dict[tuple, list] = {}
            for i in range(batch.num_rows):
                key, n = (batch.column("rec")[i].as_py(), batch.column("ch")[i].as_py()), batch.column("times")[i].as_py()
                held = sums.setdefault(key, [0, 0.0])
                held[0], held[1] = held[0] + n, held[1] + n * np.asarray(batch.column("samples")[i].values)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], batch.schema.field("rec").type), pa.array([k[1] for k in sums], pa.string()), pa.array([v[0] for v in sums.values()], pa.int64()),
                                              pa.array([v[1] for v in sums.values()], pa.list_(pa.float64()))], ["rec", "ch", "n", "s"])

    def total(t: pa.Table) -> pa.Table:
        s = np.sum([np.asarray(v.values) for v in t.column("s")], axis=0)
        return pa.table([pa.array([t.column(c)[0].as_py()], t.schema.field(c).type) for c in ("rec", "ch")] + [pa.array([sum(t.column("n").to_pylist())], pa.int64()), pa.array([s], pa.list_(pa.float64()))], ["rec", "ch", "n", "s"])

    schema = f"rec {kind}, ch string, n bigint, s array<double>"
    mean = kept.select("rec", "ch", "times", "samples").mapInArrow(add, schema).groupBy("rec", "ch").applyInArrow(total, schema)
    field = mean.groupBy("rec").agg(F.max("n").alias("n_spikes"), F.array_sort(F.collect_list(F.struct("ch", F.transform("s", lambda x: x / F.col("n")).alias("x")))).alias("c"))
    power = F.aggregate(F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(0))), F.transform(F.element_at("c", 1).x, F.abs), lambda t, c: F.zip_with(t, c.x, lambda a, b: a + F.abs(b)))
    field = field.withColumn("power", power).withColumn("peak", F.array_position("power", F.array_max("power")).cast("int"))
    field = field.withColumn("topography", F.map_from_entries(F.transform("c", lambda c: F.struct(c.ch, F.element_at(c.x, F.col("peak")))))).withColumn("v", F.transform("c", lambda c: F.struct(c.ch.alias("ch"), F.abs(F.element_at(c.x, F.col("peak"))).alias("a"))))
    side = lambda name: F.aggregate(F.filter("v", lambda v: hemisphere(v.ch) == name), F.lit(0.0), lambda t, v: t + v.a)
    field = field.withColumn("all", F.aggregate("v", F.lit(0.0), lambda t, v: t + v.a)).withColumn("top", F.array_max(F.transform("v", lambda v: v.a))).withColumn("left", side("left")).withColumn("right", side("right"))
    spread = F.when(~(F.col("all") > 0), "n/a").when(F.col("top") >= focal * F.col("all"), "focal").when((F.col("left") >= bilateral * F.col("all")) & (F.col("right") >= bilateral * F.col("all")), "bilateral").otherwise("regional")
    return field.select("rec", "n_spikes", F.element_at(F.filter("v", lambda v: v.a == F.col("top")), 1).ch.alias("peak_channel"), ((F.col("peak") - 1 - before) * 1000 / F.lit(fs)).alias("peak_latency_ms"),
                        spread.alias("field_spread"), "topography")


#: The least rate at which fast oscillations can be sought.
LEAST_FS = 600.0


def fast_oscillations(df: DataFrame, fs: float, per_epoch: int, core: int | None = None, mains: float = 50.0, band=(80.0, 250.0)) -> DataFrame:
    """Rec, ch, start_s, end_s, peak_s, duration_ms, peak_hz, rms_z. After notches at the mains and its double, the 6 ms root mean square of 80-250 Hz
    exceeds five deviations of the trace's quieter half (1 at least); grown down to half of that it lasts 36 to 200 ms, and holds twice
    the power of 250-500 Hz (as far as the rate reaches). Growths that meet are one. A rate under LEAST_FS has no rows."""
    schema = "start_s double, end_s double, peak_s double, duration_ms double, peak_hz double, rms_z double"
    if fs < LEAST_FS:
        return df.sparkSession.createDataFrame([], ", ".join([f"{k} {dict(df.dtypes)[k]}" for k in KEYS]) + ", " + schema)
    notches = [dsp.notch_sos(f, 30, fs) for f in (mains, 2 * mains) if f < fs / 2]
    taps, top = int(2 * fs) // 16, min(500.0, fs / 2 - 1)
    low, high = dsp.fir_band(taps, band, fs), dsp.fir_band(taps, (band[1], top), fs)
    window, least, most = max(1, round(0.006 * fs)), max(1, round(6 / 165 * fs)), round(0.2 * fs)

    def kernel(x, left, right):
        for n in notches:
            x = dsp.sosfiltfilt(n, x)[0]
        y = dsp.firfiltfilt(low, x)
        return y, dsp.firfiltfilt(high, x), np.sqrt(np.maximum(dsp.moving_average(y * y, window), 0))

    held = saved(filtered(df, kernel, ["band", "over", "rms"], per_epoch, settle(*notches, low) + window, most + 2, core), "fast")
    half = exact_quantiles(held.select(*KEYS, core_of("rms").alias("rms")), KEYS, "rms", [0.5])

    def quiet(rms, before, n, q0):
        x = rms[before: before + n]
        x = x[x <= q0] - q0  # shifted by a value of their own size, so that squares lose no digits
        yield len(x), float(x.sum()), float((x * x).sum())

    sums = per_row(held.join(half, KEYS), [*KEYS, "q0"], ["rms", "before", "n", "q0"], quiet, "k bigint, s double, q double")
    base = sums.groupBy(*KEYS, "q0").agg(F.sum("k").alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    base = base.select(*KEYS, (F.col("q0") + F.col("s") / F.col("k")).alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("k") - (F.col("s") / F.col("k")) ** 2, F.lit(0.0))).alias("sd"))

    def events(band, over, rms, before, n, first, mean, sd):
        limit, t = max(5 * sd, 1.0), first - before
        for a, b in own_runs(rms > limit / 2, before, n):
            if not rms[a:b].max() > limit or not least <= b - a <= most:
                continue
            power = [float((np.abs(np.fft.rfft(v[a:b]))[in_band(b - a, *edges)] ** 2).sum()) for v, edges in ((band, (80.0, 250.0)), (over, (250.0, top)))]
            if power[1] > 0 and power[0] / power[1] < 2:
                continue
            at = a + int(np.argmax(rms[a:b]))
            yield (a + t) / fs, (b + t) / fs, (at + t) / fs, (b - a) / fs * 1000, band_peak(band[a:b] * np.hanning(b - a), fs, 80.0, 250.0), float((rms[at] - mean) / (sd or 1.0))

    def in_band(n, lo, hi):
        f = np.fft.rfftfreq(n, 1 / fs)
        return (f >= lo) & (f <= hi)

    return per_row(held.join(base, KEYS), KEYS, ["band", "over", "rms", "before", "n", "first", "mean", "sd"], events, schema)


#: Band of slow oscillations, and the least number of spindles on them that says anything.
OSCILLATION_BAND, LEAST_COUPLED = (0.5, 1.25), 10


def coupling(df: DataFrame, fs: float, per_epoch: int, found: DataFrame, waves: DataFrame, window_s: float = 1.2, core: int | None = None) -> DataFrame:
    """Rec, ch, status, n_spindles, n_slow_waves, n_coupled, plv, preferred_deg, rayleigh_z, rayleigh_p for each channel of ``df``.

    The phase of 0.5-1.25 Hz, filtered over the whole trace by a finite response of three seconds, is taken at the peaks of the spindles ``found`` (rec, ch, peak_s)
    that have a trough of the slow ``waves`` (rec, ch, neg_peak_s) within ``window_s``; peaks outside the trace do not count. p is the series of Mardia and Zar for
    the test of Rayleigh. Without spindles, slow waves, or LEAST_COUPLED of both together the status says so and the figures are null."""
    h, fade = dsp.fir_band(round(3 * fs), OSCILLATION_BAND, fs), int(27 * fs)
    reach = settle(h) + fade
    core = core or max(8, 4 * -(-reach // per_epoch))
    held = filtered(df, lambda x, left, right: (np.angle(analytic(dsp.firfiltfilt(h, x), left, right, fade)),), ["phase"], per_epoch, reach, 0, core)
    peaks, troughs = found.where("peak_s is not null").select(*KEYS, "peak_s"), waves.where("neg_peak_s is not null").select(*KEYS, "neg_peak_s")
    near = exists_within(peaks, troughs, KEYS, "peak_s", "neg_peak_s", window_s)
    near = near.withColumn("at", F.bround(F.col("peak_s") * fs).cast("bigint")).withColumn("chunk", F.expr(f"cast(floor(at / {core * per_epoch}) as bigint)"))
    at = near.join(held, [*KEYS, "chunk"]).where("at >= first and at < first + n").select(*KEYS, F.col("phase")[(F.col("at") - F.col("first")).cast("int")].alias("p"))
    sums = at.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_coupled"), F.sum(F.cos("p")).alias("c"), F.sum(F.sin("p")).alias("s"))
    out = df.select(*KEYS).distinct()
    for rows, name in ((peaks, "n_spindles"), (troughs, "n_slow_waves")):
        out = out.join(rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias(name)), KEYS, "left")
    out = out.join(sums, KEYS, "left").fillna(0, ["n_spindles", "n_slow_waves", "n_coupled"])
    status = F.when(F.col("n_spindles") == 0, "no_spindles").when(F.col("n_slow_waves") == 0, "no_slow_waves").when(F.col("n_coupled") < LEAST_COUPLED, "insufficient_events").otherwise("ok")
    n, size = F.col("n_coupled").cast("double"), F.sqrt(F.col("c") ** 2 + F.col("s") ** 2)
    z = F.try_divide(size**2, n)
    p = F.exp(-z) * (1 + F.try_divide(2 * z - z**2, 4 * n) - F.try_divide(24 * z - 132 * z**2 + 76 * z**3 - 9 * z**4, 288 * n**2))
    figures = {"plv": F.try_divide(size, n), "preferred_deg": F.degrees(F.atan2("s", "c")), "rayleigh_z": z, "rayleigh_p": F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))}
    return out.withColumn("status", status).select(*KEYS, "status", "n_spindles", "n_slow_waves", "n_coupled", *[F.when(F.col("status") == "ok", v).alias(k) for k, v in figures.items()])


def ictal_candidates(df: DataFrame, fs: float, per_epoch: int, channels: int = 4, window_s: float = 2.0, step_s: float = 1.0, least_s: float = 10.0, least_z: float = 3.0, least_drift: float = 1.0) -> DataFrame:
    """Rec, ch, start_s, duration_s, peak_z, drift_hz, confidence of stretches that a person should look at, on the first ``channels`` live channels by name.

    Windows of ``window_s`` move by ``step_s`` inside an epoch; the robust z of their line length over the whole trace stays at ``least_z`` for ``least_s``
    at least (windows more than one and a half steps apart end a stretch). The change of the dominant frequency from its first to its last window makes it moderate, else it
    is low. Of stretches of several channels that overlap or touch, the one of largest z stays. Samples that are not finite count as 0."""
    ship(df.sparkSession)
    size, step = max(2, int(window_s * fs)), max(1, int(step_s * fs))
    known = df.where("epoch is not null and samples is not null").select(*KEYS, "epoch", F.transform("samples", lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x.cast("double")).otherwise(F.lit(0.0))).alias("samples"))
    moments = F.expr("aggregate(samples, named_struct('n', 0D, 's', 0D, 'q', 0D), (a, x) -> named_struct('n', a.n + 1, 's', a.s + x, 'q', a.q + x * x), a -> if(a.n > 0, sqrt(greatest(a.q / a.n - (a.s / a.n) * (a.s / a.n), 0D)), null))")
    live = live_channels(known.select(*KEYS, "epoch", moments.alias("sd")), KEYS).where("live")
    used = live.withColumn("_k", F.row_number().over(W.partitionBy("rec").orderBy("ch"))).where(F.col("_k") <= channels).select(*KEYS)

    def windows(samples, epoch):
        for a in range(0, len(samples) - size + 1, step):
            x = samples[a: a + size]
            yield epoch * per_epoch / fs + a / fs, float(np.abs(np.diff(x)).sum()), 0.0 if np.allclose(x, x.mean(), rtol=0, atol=1e-8) else band_peak((x - x.mean()) * np.hanning(size), fs, 2.0, 25.0) or 0.0

    w = saved(per_row(known.join(used, KEYS), KEYS, ["samples", "epoch"], windows, "t double, ll double, hz double"), "windows")
    med = exact_quantiles(w, KEYS, "ll", [0.5]).select(*KEYS, F.col("q0").alias("med"))
    off = w.join(med, KEYS).withColumn("off", F.abs(F.col("ll") - F.col("med")))
    mad = exact_quantiles(off, KEYS, "off", [0.5]).select(*KEYS, F.col("q0").alias("mad"))
    sd = w.groupBy(*KEYS).agg(F.stddev_pop("ll").alias("sd"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    scale = F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    high = w.join(med.join(mad, KEYS).join(sd, KEYS), KEYS).withColumn("z", (F.col("ll") - F.col("med")) / scale).where(F.col("z") >= least_z)
    order = W.partitionBy(*KEYS).orderBy("t")
    fresh = F.coalesce(F.col("t") - F.lag("t").over(order) > 1.5 * step_s, F.lit(True)).cast("int")
    runs = high.withColumn("run", F.sum(fresh).over(order)).groupBy(*KEYS, "run").agg(
        F.min("t").alias("start_s"), (F.max("t") + window_s).alias("stop_s"), F.abs(F.max_by("hz", "t") - F.min_by("hz", "t")).alias("drift_hz"), F.max("z").alias("peak_z"))
    runs = runs.where(F.col("stop_s") - F.col("start_s") >= least_s).withColumn("score", F.struct("peak_z", "ch", "drift_hz"))
    kept = merge_keep_larger(runs, ["rec"], "start_s", "stop_s", "score", touching=True)  # a recording's candidates
    return kept.select("rec", "score.ch", "start_s", (F.col("stop_s") - F.col("start_s")).alias("duration_s"), "score.peak_z", "score.drift_hz", F.when(F.col("score.drift_hz") >= least_drift, "moderate").otherwise("low").alias("confidence"))
