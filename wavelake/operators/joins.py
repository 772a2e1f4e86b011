"""Joins in time and by key hierarchy, written as equi-joins on bins wherever a range would do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wavelake.session import saved


def _row_of(df: DataFrame, keys: Sequence[str], date: str, tie: str) -> Column:
    return F.struct(date, tie, *[c for c in df.columns if c not in (*keys, date, tie)])


def before_after(df: DataFrame, pivots: DataFrame, keys: Sequence[str], date: str, pivot: str, tie: str) -> DataFrame:
    """For each pivot the last row before it and the first on or after it, as structs ``before`` and ``after``."""
    rows = df.select(*keys, _row_of(df, keys, date, tie).alias("_row"))
    joined = pivots.join(rows, list(keys), "left")
    earlier = F.col(f"_row.{date}") < F.col(pivot)
    return joined.groupBy(*pivots.columns).agg(
        F.max(F.when(earlier, F.col("_row"))).alias("before"), F.min(F.when(~earlier, F.col("_row"))).alias("after"))


def before_after_at(df: DataFrame, pivot: Column, keys: Sequence[str], date: str, tie: str) -> DataFrame:
    """``before_after`` for one pivot that all keys share: a grouped largest and smallest row, without a join."""
    row, earlier = _row_of(df, keys, date, tie), F.col(date) < pivot
    return df.groupBy(*keys).agg(F.max(F.when(earlier, row)).alias("before"), F.min(F.when(F.col(date) >= pivot, row)).alias("after"))


def _binned(df: DataFrame, keys: Sequence[str], time: str, width: float, spread: bool) -> DataFrame:
    b = F.floor(F.col(time) / F.lit(width))
    if not spread:
        return df.withColumn("_bin", b)
    return df.withColumn("_bin", F.explode(F.array(b - 1, b, b + 1)))


def nearest_within(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, other: str, tolerance: float, row: str) -> DataFrame:
    """Each left row with its nearest right row at most ``tolerance`` away, the earlier one on ties."""
    a = _binned(left, keys, time, tolerance, False)
    b = _binned(right, keys, other, tolerance, True)
    hit = a.join(b, [*keys, "_bin"]).withColumn("gap", F.abs(F.col(time) - F.col(other))).where(F.col("gap") <= tolerance)
    w = W.partitionBy(*keys, row).orderBy("gap", other)
    return hit.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_bin")


def exists_within(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, other: str, tolerance: float, slack: float = 1e-9, strict: bool = False) -> DataFrame:
    """Left rows with some right row within the tolerance: a semi join over neighbouring bins."""
    reach = tolerance if strict else tolerance + slack
    a = _binned(left, keys, time, reach, False)
    b = _binned(right.select(*keys, F.col(other).alias("_other")), keys, "_other", reach, True)
    near = F.abs(a[time] - b["_other"])
    cond = [a[k] == b[k] for k in keys] + [a["_bin"] == b["_bin"], near < reach if strict else near <= reach]
    return a.join(b, cond, "left_semi").drop("_bin")


def contained(events: DataFrame, epochs: DataFrame, keys: Sequence[str], time: str, epoch: str, seconds: float, states: Sequence[str], state: str = "stage") -> DataFrame:
    """Events inside epochs of these states; half-open epochs of equal length make it an equi-join."""
    return events.withColumn(epoch, F.floor(F.col(time) / F.lit(seconds)).cast("bigint")).join(
        epochs.where(F.col(state).isin(*states)), [*keys, epoch])


def lookup_bin(df: DataFrame, dim: DataFrame, value: Column, low: str = "lo", high: str = "hi") -> DataFrame:
    """Left join to a table of half-open ranges; the table is small by nature (norms by age)."""
    return df.join(F.broadcast(dim), (value >= F.col(low)) & (value < F.col(high)), "left")


def nearest_keys(df: DataFrame, at: str, table: DataFrame, key: str) -> DataFrame:
    """Every row of df with the columns of the row(s) of ``table`` whose key is nearest to ``at``, the lower one on a tie; keys at any distances.

    Distinct values and keys are sorted together by range, each range knows its own last and first key, and those of its neighbours
    fill what it lacks: an as-of join to both sides without one sorted task or a bound on either table. A null or NaN value,
    and an empty table, leave the columns null; null and NaN keys are nobody's nearest; repeated keys give a row each. No row is lost."""
    value = F.col(at).cast("double")
    places = table.select(F.col(key).cast("double").alias("v")).where("v is not null and not isnan(v)").distinct().withColumn("k", F.col("v"))
    asked = df.select(value.alias("v")).where("v is not null and not isnan(v)").distinct().withColumn("k", F.lit(None).cast("double"))
    both = saved(places.unionByName(asked).repartitionByRange(F.col("v")).withColumn("part", F.spark_partition_id()), "keys")
    ends = both.groupBy("part").agg(F.min("k").alias("low"), F.max("k").alias("high"))  # a row a range
    of = W.orderBy("part")
    ends = ends.select("part", F.last("high", True).over(of.rowsBetween(W.unboundedPreceding, -1)).alias("below"), F.last("low", True).over(W.orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)).alias("above"))
    # a frame that runs to the end is read anew for every row, so the key above is the last one in falling order
    inside, back = W.partitionBy("part").orderBy("v"), W.partitionBy("part").orderBy(F.desc("v"))
    near = both.withColumn("lo", F.last("k", True).over(inside.rangeBetween(W.unboundedPreceding, 0))).withColumn("hi", F.last("k", True).over(back.rangeBetween(W.unboundedPreceding, 0)))
    near = near.where("k is null").join(ends, "part").select("v", F.coalesce("lo", "below").alias("lo"), F.coalesce("hi", "above").alias("hi"))
    near = near.select(F.col("v").alias("_v"), F.when(F.col("hi").isNull() | (F.col("v") - F.col("lo") <= F.col("hi") - F.col("v")), F.col("lo")).otherwise(F.col("hi")).alias("_near"))
    held = df.join(near, value == F.col("_v"), "left")
    return held.join(table, F.col("_near") == table[key].cast("double"), "left").drop("_v", "_near")


def first_cell(df: DataFrame, cells: DataFrame, levels: Sequence[Sequence[str]], row: str) -> DataFrame:
    """The finest cell that exists: one equi-join per level, then the least level of each row."""
    found = None
    for rank, level in enumerate(levels):
        at = cells.where(F.col("level") == rank).select(*[F.col(c).alias(f"_{c}") for c in level], F.col("n").alias("cell_n"), F.col("stat").alias("cell_stat"))
        cond = [df[c].eqNullSafe(F.col(f"_{c}")) for c in level] or [F.lit(True)]
        hit = df.join(at, cond).select(df[row], F.lit(rank).alias("level"), "cell_n", "cell_stat")
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy(row).agg(F.min(F.struct("level", "cell_n", "cell_stat")).alias("cell"))
    return df.join(best, row, "left").select(df["*"], "cell.level", "cell.cell_n", "cell.cell_stat")
