"""Ordered operators: runs, gaps, clusters, ranks and robust statistics, all as window expressions.

Every function takes ``keys`` (the series) and ``order`` (its order), so work is partitioned by
series and stays inside Catalyst.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MAD_SCALE = 1.4826


def series(keys: Sequence[str], *order):
    return W.partitionBy(*keys).orderBy(*order)


def islands(df: DataFrame, keys: Sequence[str], order: str, flag: str, step: int | None = None, name: str = "island") -> DataFrame:
    """Number the runs of equal ``flag``; with ``step``, a jump in ``order`` also starts a run."""
    w = series(keys, order)
    new = ~F.col(flag).eqNullSafe(F.lag(flag).over(w))
    if step is not None:
        new = new | (F.col(order) - F.lag(order).over(w) != step)
    start = F.when(F.row_number().over(w) == 1, 1).otherwise(F.coalesce(new, F.lit(True)).cast("int"))
    return df.withColumn(name, F.sum(start).over(w.rowsBetween(W.unboundedPreceding, 0)))


def runs(df: DataFrame, keys: Sequence[str], order: str, flag: str, step: int | None = None) -> DataFrame:
    """One row per run: flag, start (its first place), stop (one past its last), length."""
    out = islands(df, keys, order, flag, step, "_island").groupBy(*keys, "_island", flag).agg(
        F.min(order).alias("start"), (F.max(order) + 1).alias("stop"), F.count(F.lit(1)).alias("length"))
    return out.drop("_island")


def bridge(df: DataFrame, keys: Sequence[str], order: str, flag: str, longest: int, name: str = "bridged") -> DataFrame:
    """Turn runs of false of at most ``longest`` rows between two runs of true into true."""
    marked = islands(df, keys, order, flag, name="_island")
    whole = W.partitionBy(*keys, "_island")
    last = F.max("_island").over(W.partitionBy(*keys))
    short = F.count(F.lit(1)).over(whole) <= longest
    inner = (F.col("_island") > 1) & (F.col("_island") < last)
    return marked.withColumn(name, F.col(flag) | (short & inner)).drop("_island")


def clusters(df: DataFrame, keys: Sequence[str], time: str, gap: float, name: str = "cluster") -> DataFrame:
    """Number groups of rows whose neighbours are at most ``gap`` apart."""
    w = series(keys, time)
    new = (F.col(time) - F.lag(time).over(w) > gap).cast("int")
    return df.withColumn(name, F.sum(F.coalesce(new, F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)))


def transitions(df: DataFrame, keys: Sequence[str], order: str, state: str) -> DataFrame:
    """Counts of changes from one state to the next, same states left out."""
    w = series(keys, order)
    return (df.withColumn("to_state", F.lead(state).over(w)).where(f"to_state is not null and to_state <> {state}")
            .groupBy(*keys, F.col(state).alias("from_state"), "to_state").agg(F.count(F.lit(1)).alias("n")))


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Rank from 1 with ties at the mean of their places."""
    ties = F.count(F.lit(1)).over(W.partitionBy(*keys, value))
    return df.withColumn(name, F.rank().over(series(keys, value)) + (ties - 1) / F.lit(2.0))


def median_mad(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, med, mad: two grouped passes, each combined by key."""
    med = df.groupBy(*keys).agg(F.median(value).alias("med"))
    return df.join(med, list(keys)).groupBy(*keys, "med").agg(F.median(F.abs(F.col(value) - F.col("med"))).alias("mad"))


def robust_z(df: DataFrame, keys: Sequence[str], value: str, name: str = "z") -> DataFrame:
    """(x - median) / (1.4826 MAD); the population deviation stands in for a MAD of 0, and 1 for that."""
    stats = median_mad(df, keys, value).join(df.groupBy(*keys).agg(F.stddev_pop(value).alias("_sd")), list(keys))
    scale = F.when(F.col("mad") > 0, F.col("mad") * MAD_SCALE).when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    return df.join(stats, list(keys)).withColumn(name, (F.col(value) - F.col("med")) / scale).drop("_sd")


def first_max(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """The row of the largest value per key, the first in order on ties."""
    w = W.partitionBy(*keys).orderBy(F.desc(value), F.asc(order))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def thin(df: DataFrame, keys: Sequence[str], order: str, most: int) -> DataFrame:
    """At most ``most`` rows per key, evenly spread by rank: every ceil(n / most)-th."""
    step = F.ceil(F.count(F.lit(1)).over(W.partitionBy(*keys)) / most)
    return (df.withColumn("_i", F.row_number().over(series(keys, order)) - 1).withColumn("_step", step)
            .where("_i % _step = 0").drop("_i", "_step"))


def moving_sum(value: str, keys: Sequence[str], order: str, before: int, after: int, size: int) -> Column:
    """Moving mean with zeros beyond the edges: the sum over the frame by its full size."""
    return F.sum(value).over(series(keys, order).rowsBetween(-before, after)) / F.lit(float(size))
