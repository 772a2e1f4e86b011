"""Cohort statistics: grouping-set cells with a least size, percentile look-up, buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .traces import exact_quantiles


def cells(df: DataFrame, levels: Sequence[Sequence[str]], keys: Sequence[str], value: str, least: int = 5) -> DataFrame:
    """Statistics of each cell of the grouping sets; cells under ``least`` rows are withheld.

    Counts, means and ends are combined before their shuffle; percentiles come from counts of leading bits and then of the few values that share
    them, so the cell of all rows is no group of all its values either."""
    probs = (0.1, 0.25, 0.5, 0.75, 0.9)
    stats = df.groupingSets([[F.col(c) for c in level] for level in levels], *[F.col(k) for k in keys]).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.grouping_id().alias("level_id"))
    # a cell's name: which keys are rolled up, and the others' values; the bits of level_id, from the last key up
    name = lambda level_id, of: F.to_json(F.struct(level_id.alias("level"), *[of(k).alias(k) for k in keys]), {"ignoreNullFields": "false"})
    each = []
    for level in levels:
        rolled = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in level)
        each.append(name(F.lit(rolled).cast("bigint"), lambda k, level=level: F.col(k) if k in level else F.lit(None).cast(df.schema[k].dataType)))
    held = df.select(F.explode(F.array(*each)).alias("cell"), F.col(value).cast("double").alias("v"))
    q = exact_quantiles(held, ["cell"], "v", probs)
    stats = stats.where(F.col("n") >= least).withColumn("cell", name(F.col("level_id").cast("bigint"), F.col))
    return stats.join(q, "cell").select(*keys, "level_id", "n", "mean", "sd", *[F.col(f"q{i}").alias(n) for i, n in enumerate(("p10", "p25", "median", "p75", "p90"))], "lo", "hi")


def percentile_rank(value: Column, anchors: Sequence[tuple[Column, float]]) -> Column:
    """Percentile of a value between (value, percentile) anchors in order: linear between two anchors,
    clamped at the ends, the middle of a flat segment, null with fewer than two anchors."""
    pts = F.filter(F.array(*[F.struct(a.cast("double").alias("v"), F.lit(float(p)).alias("p")) for a, p in anchors]), lambda s: s["v"].isNotNull())
    first, last, n = F.element_at(pts, 1), F.element_at(pts, -1), F.size(pts)
    pairs = F.zip_with(F.slice(pts, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(pts, F.lit(2), F.greatest(n - 1, F.lit(0))),
                       lambda a, b: F.struct(a["v"].alias("v0"), a["p"].alias("p0"), b["v"].alias("v1"), b["p"].alias("p1")))
    seg = F.element_at(F.filter(pairs, lambda s: (value >= s["v0"]) & (value <= s["v1"])), 1)
    inside = F.when(seg["v1"] == seg["v0"], (seg["p0"] + seg["p1"]) / 2).otherwise(
        seg["p0"] + (value - seg["v0"]) / (seg["v1"] - seg["v0"]) * (seg["p1"] - seg["p0"]))
    return F.when((n < 2) | value.isNull(), F.lit(None).cast("double")).when(value < first["v"], first["p"]).when(value > last["v"], last["p"]).otherwise(inside)


def bucket(value: Column, edges: Sequence[float], labels: Sequence[str], zero: str | None = None) -> Column:
    """Label of the half-open bucket [edge, next edge); below the first edge and above the last have labels
    too, and an exact zero may have its own."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    if zero is not None:
        out = out.when(value == 0, F.lit(zero))
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(value < edge, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))
