"""Operators over stored recordings: windows of samples, channel choice, referencing and clean-up as Catalyst plans.

An epoch is a row (rec, ch, epoch, samples); series of samples are rows (keys, place, value). Nothing
here needs more than one epoch, or the two that a window touches, in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .sequences import MAD_SCALE, islands, series


def epochs_between(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Epochs start to stop - 1; those that are missing are skipped."""
    return df.where((F.col("epoch") >= start) & (F.col("epoch") < stop))


def sample_window(df: DataFrame, first: int, count: int, per_epoch: int) -> DataFrame:
    """rec, ch, samples: ``count`` samples from sample ``first`` of a recording on, across the seams of epochs.

    Only the epochs that the window touches are read. A recording that lacks one of them gives no row."""
    lo, hi = first // per_epoch, (first + count - 1) // per_epoch
    held = df.where(F.col("epoch").between(lo, hi)).groupBy("rec", "ch").agg(F.array_sort(F.collect_list(F.struct("epoch", "samples"))).alias("e"))
    return held.where(F.size("e") == hi - lo + 1).select("rec", "ch", F.slice(F.flatten("e.samples"), first - lo * per_epoch + 1, count).alias("samples"))


def event_windows(events: DataFrame, df: DataFrame, before: int, after: int, per_epoch: int) -> DataFrame:
    """Every event (rec, ch, at: its sample) with the samples from ``before`` before it to ``after`` behind it.

    An event meets the one or two epochs that its window touches; windows beyond the recording give no row."""
    e = events.withColumn("lo", F.expr(f"cast(floor((at - {before}) / {per_epoch}) as bigint)")).withColumn("hi", F.expr(f"cast(floor((at + {after}) / {per_epoch}) as bigint)"))
    need = e.withColumn("epoch", F.explode(F.array_distinct(F.array("lo", "hi"))))
    held = need.join(df, ["rec", "ch", "epoch"]).groupBy("rec", "ch", "at", "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("epoch", "samples"))).alias("e"))
    held = held.where(F.size("e") == F.col("hi") - F.col("lo") + 1)
    return held.select("rec", "ch", "at", F.slice(F.flatten("e.samples"), (F.col("at") - before - F.col("lo") * per_epoch + 1).cast("int"), F.lit(before + after + 1)).alias("samples"))


def live_channels(df: DataFrame, keys: Sequence[str], least: float = 1.5, probes: int = 3) -> DataFrame:
    """keys, sigma, live from (keys, epoch, sd): the median spread of ``probes`` epochs at even places is not under
    ``least``; an unknown spread counts as live."""
    w = W.partitionBy(*keys)
    at = df.withColumn("_i", F.row_number().over(w.orderBy("epoch")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    at = at.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(probes)))).where(F.expr(f"_i = _k * _n div {probes + 1}"))
    out = at.groupBy(*keys).agg(F.median("sd").alias("sigma"))
    return out.withColumn("live", F.coalesce(F.col("sigma") >= least, F.lit(True)))


def resolve_channel(live: DataFrame, key: str, channel: str, candidates: Sequence[str]) -> DataFrame:
    """key, channel, is_fallback: the first live candidate by rank, upper and lower case alike, else the first live channel by name."""
    rank = F.array_position(F.array(*[F.lit(c.upper()) for c in candidates]), F.upper(channel))
    first = F.min(F.struct((rank == 0).alias("other"), F.when(rank > 0, rank).alias("rank"), F.col(channel).alias("channel")))
    out = live.where("live").groupBy(key).agg(first.alias("c"))
    return out.select(key, F.col("c.channel").alias("channel"), F.col("c.other").alias("is_fallback"))


def average_reference(df: DataFrame, bad: Column, neighbours: dict[str, Sequence[str]]) -> DataFrame:
    """rec, ch, epoch, samples: samples less the mean of the good channels, position by position, and bad channels replaced by the mean
    of their good neighbours (as they are, if there is none).

    The channels of an epoch meet as arrays, which are added and divided whole; a channel that ends early counts as far as it goes."""
    c = F.struct("ch", bad.alias("bad"), "samples")
    held = df.select("rec", "epoch", c.alias("c")).groupBy("rec", "epoch").agg(F.array_sort(F.collect_list("c")).alias("c"))  # the channels of an epoch
    total = ("aggregate({of}, cast(array() as array<struct<s:double,n:int>>), (a, c) -> zip_with(a, c.samples, (p, x) -> "
             "named_struct('s', coalesce(p.s, 0D) + coalesce(cast(x as double), 0D), 'n', coalesce(p.n, 0) + if(x is null, 0, 1))))")
    held = held.withColumn("mean", F.expr("transform(" + total.format(of="filter(c, v -> not v.bad)") + ", p -> if(p.n > 0, p.s / p.n, 0D))"))
    held = held.withColumn("c", F.expr("transform(c, v -> named_struct('ch', v.ch, 'bad', v.bad, 'samples', slice(zip_with(v.samples, mean, (x, m) -> x - coalesce(m, 0D)), 1, size(v.samples))))"))
    near = F.create_map(*[v for k, ns in neighbours.items() for v in (F.lit(k), F.array(*[F.lit(n) for n in ns]))]) if neighbours else F.create_map().cast("map<string,array<string>>")
    rows = held.withColumn("v", F.explode("c")).withColumn("near", F.coalesce(near[F.col("v.ch")], F.array().cast("array<string>")))
    made = F.expr("slice(zip_with(v.samples, " + total.format(of="filter(c, u -> not u.bad and array_contains(near, u.ch))") + ", (x, p) -> if(p.n > 0, p.s / p.n, x)), 1, size(v.samples))")
    return rows.select("rec", "v.ch", "epoch", F.when(F.col("v.bad"), made).otherwise(F.col("v.samples")).alias("samples"))


def sane(value: Column, digits: int | None = None) -> Column:
    """A number, or null for what is not finite; ``digits`` rounds halves to even."""
    x = value.cast("double")
    x = F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)
    return x if digits is None else F.bround(x, digits)


def strict_cycles(df: DataFrame, keys: Sequence[str], order: str, stage: str, nrem: int, rem: int) -> DataFrame:
    """keys, n_cycles: runs of at least ``rem`` REM epochs that follow at least ``nrem`` NREM epochs since the last REM run.

    Wake does not break the NREM block, but it ends a REM run; any REM run starts the count of NREM anew."""
    w = series(keys, order)
    begins = (F.col(stage) == "REM") & ~F.coalesce(F.lag(stage).over(w) == "REM", F.lit(False))
    g = df.withColumn("_run", F.sum(begins.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = g.groupBy(*keys, "_run").agg(F.count_if(F.col(stage) == "REM").alias("_rem"), F.count_if(F.col(stage).isin("N1", "N2", "N3")).alias("_nrem"))
    ok = (F.col("_rem") >= rem) & (F.lag("_nrem").over(W.partitionBy(*keys).orderBy("_run")) >= nrem)
    return g.withColumn("_ok", ok).groupBy(*keys).agg(F.count_if("_ok").alias("n_cycles"))


def merge_keep_larger(df: DataFrame, keys: Sequence[str], start: str, stop: str, score: str, touching: bool = False) -> DataFrame:
    """Ordered fold over intervals: one that overlaps the last kept one replaces it if its score is larger, else it goes.

    The extent is replaced, not joined, so this is no island; keys must bound a group (a recording's day). With ``touching`` an interval that starts
    where the last one stops overlaps it. The score may be a struct, compared from its first field on."""
    items = F.array_sort(F.collect_list(F.struct(F.col(start).alias("lo"), F.col(stop).alias("hi"), F.col(score).alias("z"))))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    none = F.array().cast(f"array<struct<lo:{kinds[start]},hi:{kinds[stop]},z:{kinds[score]}>>")

    def step(kept, x):
        last = F.element_at(kept, -1)
        over = (F.size(kept) > 0) & ((x.lo <= last.hi) if touching else (x.lo < last.hi))
        front = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(over & (x.z > last.z), F.concat(front, F.array(x))).when(over, kept).otherwise(F.concat(kept, F.array(x)))

    out = df.groupBy(*keys).agg(F.aggregate(items, none, step).alias("_k"))
    return out.select(*keys, F.explode("_k").alias("_i")).select(*keys, F.col("_i.lo").alias(start), F.col("_i.hi").alias(stop), F.col("_i.z").alias(score))


def hysteresis(df: DataFrame, keys: Sequence[str], order: str, value: str, high: float, low: float) -> DataFrame:
    """keys, start, stop, length, peak: runs above ``low`` that reach ``high`` somewhere."""
    marked = islands(df.withColumn("_on", F.col(value) > low), keys, order, "_on").where("_on")
    out = marked.groupBy(*keys, "island").agg(F.min(order).alias("start"), (F.max(order) + 1).alias("stop"), F.count(F.lit(1)).alias("length"), F.max(value).alias("peak"))
    return out.where(F.col("peak") > high).drop("island")


def half_widths(df: DataFrame, keys: Sequence[str], order: str, value: str, peak: Column, reach: int) -> DataFrame:
    """keys, order, left, right for each peak: steps to the nearest value under half of it on either side, ``reach`` at most."""
    w = series(keys, order)
    side = lambda f: F.array(*[f(value, k).over(w) for k in range(1, reach + 1)])
    tops = df.withColumn("_before", side(F.lag)).withColumn("_behind", side(F.lead)).where(peak)

    def steps(column: str) -> Column:
        under = F.transform(F.col(column), lambda v: F.coalesce(v < F.col(value) / 2, F.lit(True)))  # an end of the series stops the walk
        at = F.array_position(under, F.lit(True))
        return F.when(at > 0, at).otherwise(F.lit(reach)).cast("int")

    return tops.select(*keys, order, steps("_before").alias("left"), steps("_behind").alias("right"))


def curvature(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Add ``d2``, the second difference (null at the ends), and ``sharp``: |d2| above median + 4 scaled MADs of the series."""
    w = series(keys, order)
    out = df.withColumn("d2", F.lead(value).over(w) - 2 * F.col(value) + F.lag(value).over(w))
    mag = out.where("d2 is not null").withColumn("_a", F.abs("d2"))
    med = mag.groupBy(*keys).agg(F.median("_a").alias("_med"))
    mad = mag.join(med, list(keys)).groupBy(*keys, "_med").agg(F.median(F.abs(F.col("_a") - F.col("_med"))).alias("_mad"))
    out = out.join(mad, list(keys), "left")
    return out.withColumn("sharp", F.coalesce(F.abs("d2") >= F.col("_med") + 4 * MAD_SCALE * F.col("_mad"), F.lit(False))).drop("_med", "_mad")

