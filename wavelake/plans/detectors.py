"""Events found on the whole traces of stored recordings, and what is counted of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelake.functions.tables import register_table_functions
from wavelake.operators import components, detectors, recordings
from wavelake.plans.base import FS, PER_EPOCH, query, rounded, stored_epochs

#: Labels from which on a block is loud: one in ten makes spindles of about a second, three in ten make bursts.
LOUD_SPINDLES, LOUD_BURSTS = 9, 7
#: Recordings of even number are read at the first rate, others at the second, at which no fast oscillation can be seen.
RATES = (1024.0, 256.0)


def age() -> Column:
    """Years of age of a recording: its number, here."""
    return F.col("rec") % 20


def found_spindles(spark, d) -> tuple[DataFrame, DataFrame]:
    e = stored_epochs(spark, d, LOUD_SPINDLES)
    return e, detectors.spindles(e, FS, PER_EPOCH)


@query("spindles")
def spindles(spark, d):
    return rounded(found_spindles(spark, d)[1])


@query("spindles_in_sql")
def spindles_in_sql(spark, d):
    """2.15: the same spindles from a table function over a partitioned table argument."""
    register_table_functions(spark)
    return rounded(spark.sql(f"SELECT * FROM spindles(TABLE(SELECT rec, ch, epoch, samples FROM {{e}}) PARTITION BY (rec, ch), {FS}D, {PER_EPOCH})", e=stored_epochs(spark, d, LOUD_SPINDLES)))


@query("slow_waves")
def slow_waves(spark, d):
    """60 µV under eight years of age, else 40."""
    return rounded(detectors.slow_waves(stored_epochs(spark, d, LOUD_BURSTS), FS, PER_EPOCH, F.when(age() < 8, 60).otherwise(40)))


@query("bursts")
def bursts(spark, d):
    return rounded(detectors.bursts(stored_epochs(spark, d, LOUD_BURSTS), FS, PER_EPOCH))


@query("spikes")
def spikes(spark, d):
    return rounded(detectors.spikes(stored_epochs(spark, d, LOUD_SPINDLES), FS, PER_EPOCH))


@query("hfo")
def hfo(spark, d):
    """A row for each fast oscillation of a recording whose rate allows it; the others have one row that says why there is none."""
    e = stored_epochs(spark, d, LOUD_SPINDLES).withColumn("fs", F.when(F.col("rec") % 2 == 0, RATES[0]).otherwise(RATES[1]))
    found = detectors.fast_oscillations(e.where(F.col("fs") == RATES[0]), RATES[0], PER_EPOCH).withColumn("status", F.lit("ok"))
    slow = e.where(F.col("fs") < detectors.LEAST_FS).select("rec").distinct().withColumn("status", F.lit("insufficient_rate"))
    return rounded(found.unionByName(slow, allowMissingColumns=True))


#: Spindles a minute that are usual, by age from that on.
SPINDLE_NORMS = ((0, 2.0), (5, 4.0), (12, 5.0), (18, 4.0))


@query("spindle_density")
def spindle_density(spark, d):
    """Spindles a minute of each channel against the norm of the recording's age."""
    e, found = found_spindles(spark, d)
    found = found.groupBy("rec", "ch").agg(F.count(F.lit(1)).alias("n"))
    minutes = e.groupBy("rec", "ch").agg((F.sum(F.size("samples")) / FS / 60).alias("minutes"))
    norm = F.lit(SPINDLE_NORMS[0][1])
    for start, value in SPINDLE_NORMS[1:]:
        norm = F.when(age() >= start, F.lit(value)).otherwise(norm)
    out = minutes.join(found, ["rec", "ch"], "left").select("rec", "ch", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("minutes")).alias("per_min"), norm.alias("norm"))
    label = F.when(F.col("per_min") < 0.5 * F.col("norm"), "low").when(F.col("per_min") > 1.5 * F.col("norm"), "high").otherwise("usual")
    return rounded(out.withColumn("label", label))


@query("slow_wave_means")
def slow_wave_means(spark, d):
    """Slow waves of live channels, their rate and mean shape; channels without any have nulls."""
    e = stored_epochs(spark, d, LOUD_BURSTS)
    sd = e.select("rec", "ch", "epoch", F.expr("aggregate(samples, named_struct('n', 0D, 's', 0D, 'q', 0D), (a, x) -> named_struct('n', a.n + 1, 's', a.s + x, 'q', a.q + x * x), "
                                               "a -> sqrt(greatest(a.q / a.n - (a.s / a.n) * (a.s / a.n), 0)))").alias("sd"))
    live = recordings.live_channels(sd, ["rec", "ch"]).where("live").select("rec", "ch")
    waves = detectors.slow_waves(e.join(live, ["rec", "ch"]), FS, PER_EPOCH, F.when(age() < 8, 60).otherwise(40))
    g = waves.groupBy("rec", "ch").agg(F.count(F.lit(1)).alias("n"), F.avg("ptp_uv").alias("ptp_uv"), F.avg("slope_uv_per_s").alias("slope_uv_per_s"))
    minutes = e.groupBy("rec", "ch").agg((F.sum(F.size("samples")) / FS / 60).alias("minutes")).join(live, ["rec", "ch"])
    return rounded(minutes.join(g, ["rec", "ch"], "left").select("rec", "ch", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("minutes")).alias("per_min"), "ptp_uv", "slope_uv_per_s"))


#: Channels that stand for the frontal ones, and how much of a blink each channel sees.
FRONTAL, BLINK_WEIGHTS = ("C0", "C1"), (("C0", 0.9), ("C1", 0.8), ("C2", 0.05), ("C3", 0.05))


def blinking_epochs(spark, d) -> DataFrame:
    """The stored epochs with a blink of 300 µV every third second, as each channel sees it."""
    weight = F.element_at(F.create_map(*[F.lit(v) for pair in BLINK_WEIGHTS for v in pair]), F.col("ch"))
    at = lambda i: (F.col("epoch") * PER_EPOCH + i) % 192
    blink = lambda x, i: x + weight * 300 * F.exp(-((at(i) - 96) / 9.0) ** 2 / 2)
    return stored_epochs(spark, d).withColumn("samples", F.transform("samples", blink))


@query("component_cleanup")
def component_cleanup(spark, d):
    """Every channel's deviation before and after ocular components are taken out, and how many were."""
    e = blinking_epochs(spark, d)
    fitted = components.independent_components(e, FS, PER_EPOCH, FRONTAL)
    after = components.apply_components(e, fitted)
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda t, x: t + x * x) / F.size(c)
    level = lambda df, name: df.groupBy("rec", "ch").agg(F.sqrt(F.avg(square("samples"))).alias(name))
    out = level(e, "rms_before").join(level(after.where("cleaned"), "rms_after"), ["rec", "ch"], "left").join(fitted.select("rec", F.size("removed").alias("n_removed")), "rec", "left")
    return out.select("rec", "ch", F.round("rms_before", 3).alias("rms_before"), F.round("rms_after", 3).alias("rms_after"), "n_removed")


@query("so_coupling")
def so_coupling(spark, d):
    """The phase of slow oscillations at which the spindles of a channel peak."""
    e, found = found_spindles(spark, d)
    waves = detectors.slow_waves(e, FS, PER_EPOCH, F.lit(40))
    return rounded(detectors.coupling(e, FS, PER_EPOCH, found, waves))


@query("spike_morphology")
def spike_morphology(spark, d):
    """Width classes of the spikes of every channel, and what they speak for."""
    return rounded(detectors.morphology(detectors.spikes(stored_epochs(spark, d, LOUD_SPINDLES), FS, PER_EPOCH)))


@query("spike_fields")
def spike_fields(spark, d):
    """The average field around the spikes of each recording's first channel."""
    e = stored_epochs(spark, d, LOUD_SPINDLES)
    found = detectors.spikes(e.where("ch = 'C0'"), FS, PER_EPOCH)
    out = detectors.spike_average(found, e, FS, PER_EPOCH)
    return out.withColumn("topography", F.transform_values("topography", lambda _, v: F.round(v, 4)).cast("string"))


@query("ictal_candidates")
def ictal_candidates(spark, d):
    """A rhythm that slows from 8 to 5 Hz in every sixth epoch of the stored recordings. A window stays inside its epoch of 8 s, so seven seconds are asked for here."""
    t = lambda i: i / F.lit(FS)
    rhythm = lambda x, i: x + F.when(F.col("epoch") % 6 == 3, 300 * F.sin(2 * math.pi * (8 * t(i) - 3 / 16 * t(i) * t(i)))).otherwise(0.0)
    e = stored_epochs(spark, d).withColumn("samples", F.transform("samples", rhythm))
    return rounded(detectors.ictal_candidates(e, FS, PER_EPOCH, least_s=7.0))
