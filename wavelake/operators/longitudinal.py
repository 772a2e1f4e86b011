"""Before/after changes, trends and rank correlation over repeated recordings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wavelake.session import saved, ship

from .sequences import average_rank

#: Values that the permutations of one batch hold.
BATCH = 1 << 18
#: Pairs of a group up to which groups of that size share their permutations in a task; at most 16 sizes are held.
SHARED = 64


def direction(delta_pct: Column, polarity: Column, dead_band: float) -> Column:
    """improved, worsened or unchanged by a metric's polarity (+1 more is better, -1 less is, 0 neither)."""
    return (F.when(delta_pct.isNull(), "not_evaluable").when(F.abs(delta_pct) < dead_band, "unchanged").when(polarity == 0, "changed")
            .when(delta_pct * polarity > 0, "improved").otherwise("worsened"))


def percent_change(before: Column, after: Column) -> Column:
    """Change in percent of the absolute baseline; null for a baseline of 0."""
    return F.when(before != 0, (after - before) / F.abs(before) * 100)


def verdict(improved: Column, worsened: Column, unchanged: Column) -> Column:
    total = improved + worsened + unchanged
    return (F.when(total == 0, "no_data").when((improved > 0) & (worsened == 0), "improved").when((worsened > 0) & (improved == 0), "worsened")
            .when(improved > worsened, "mostly_improved").when(worsened > improved, "mostly_worsened").when(improved + worsened == 0, "unchanged").otherwise("mixed"))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 4) -> DataFrame:
    """keys, n, rho: rank correlation with mean ranks for ties; null under ``least`` pairs or without variance."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(pairs, keys, x, "_rx"), keys, y, "_ry")
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.covar_pop("_rx", "_ry").alias("c"), F.stddev_pop("_rx").alias("sx"), F.stddev_pop("_ry").alias("sy"))
    fine = (F.col("n") >= least) & (F.col("sx") > 0) & (F.col("sy") > 0)
    return out.select(*keys, "n", F.when(fine, F.try_divide(F.col("c"), F.col("sx") * F.col("sy"))).alias("rho"))


@lru_cache(maxsize=16)
def _orders(n: int, least: int, draws: int) -> np.ndarray:
    """Orders of n places, a row each: all of them for ``least`` places, seeded ones above; the generator's own order does not depend on what is moved."""
    if n == least:
        return np.array(list(permutations(range(n))))
    rng, at_once = np.random.default_rng(0), max(1, BATCH // n)
    return np.concatenate([rng.permuted(np.tile(np.arange(n), (min(at_once, draws - i), 1)), axis=1) for i in range(0, draws, at_once)])


def _mean_ranks(v: np.ndarray) -> np.ndarray:
    """Ranks less their mean; ties at the mean of their places."""
    _, at, times = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(times) - (times - 1) / 2.0)[at] - (len(v) + 1) / 2.0


def _shared_orders(a: np.ndarray, b: np.ndarray, least: int, draws: int) -> float:
    """Share of the permutations; groups of one size share their orders."""
    n, seen = len(a), abs(a @ b) - 1e-12
    if n == least:
        return float((np.abs(np.take(b, _orders(n, least, draws)) @ a) >= seen).mean())
    if n <= SHARED:
        small, own = b.astype(np.float32), a.astype(np.float32)  # halves, and sums of their products under 2**22: exact
        hits = int((np.abs(np.take(small, _orders(n, least, draws)) @ own) >= seen).sum())
    else:
        rng, at_once, hits = np.random.default_rng(0), max(1, BATCH // n), 0
        for i in range(0, draws, at_once):
            each = np.abs(rng.permuted(np.tile(b, (min(at_once, draws - i), 1)), axis=1) @ a)
            hits += int((each >= seen).sum())
    return (hits + 1) / (draws + 1)


def permutation_p(df: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 8, draws: int = 20_000, order: str | None = None) -> DataFrame:
    """keys, p: share of permutations at least as far from 0 as the observed rank correlation; all
    permutations for ``least`` pairs, ``draws`` seeded ones (with the observed one counted) above.

    The pairs of a group are permuted from their order by ``order`` (by x and y without it), so partitions do not matter."""
    import pandas as pd

    ship(df.sparkSession)
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "p double"])
    fine = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pair = F.struct(*([F.col(order).alias("o")] if order else []), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = fine.groupBy(*keys).agg(F.array_sort(F.collect_list(pair)).alias("_r")).select(*keys, F.col("_r.x").alias("_x"), F.col("_r.y").alias("_y"))

    def run(parts):
        for part in parts:
            out = []
            for u, v in zip(part["_x"], part["_y"], strict=True):
                p = None
                if len(u) >= least:
                    a, b = _mean_ranks(np.asarray(u, float)), _mean_ranks(np.asarray(v, float))
                    if a.any() and b.any():
                        p = _shared_orders(a, b, least, draws)
                out.append(p)
            yield part[keys].assign(p=np.array(out, float))

    return rows.mapInPandas(run, schema).withColumn("p", F.nanvl("p", F.lit(None).cast("double")))


def slope_label(slope: Column, stable: float) -> Column:
    return F.when(slope.isNull(), "not_evaluable").when(F.abs(slope) < stable, "stable").when(slope > 0, "rising").otherwise("falling")


def _times(seed: int, own: int, draws: int) -> np.ndarray:
    """How often a block appears in each draw: Poisson of mean 1, from a generator that the block itself seeds."""
    return np.random.default_rng([seed, own % 2**64]).poisson(1.0, draws)


#: Values of a group that one task takes as arrays; larger groups are dealt in parts of about so many.
HELD = 1 << 15


def block_bootstrap_ci(df: DataFrame, keys: Sequence[str], block: str, value: str, draws: int = 1000, seed: int = 42, level: float = 0.95, aggregate: str = "mean", held: int = HELD) -> DataFrame:
    """keys, point, lo, hi: percentile bootstrap of the mean, sum or median with blocks drawn whole, for groups of any size.

    A block's number of appearances in each draw is Poisson of mean 1 from a generator seeded by the block itself, so partitions do not
    matter. A group of at most ``held`` values is one row of arrays, and its draws never leave the task; what is moved is the values. The blocks of
    larger groups are dealt in parts of about ``held`` values: a task adds up the draws of the blocks it holds, Spark the tasks'. A draw's sum is brought to
    the number of blocks that there are, as draws differ in how many they take. The median of a draw is exact both ways: see ``_drawn_medians``.
    Null and NaN values are left out; a draw without any block does not count."""
    if aggregate not in ("mean", "sum", "median"):
        raise ValueError(f"no bootstrap of the {aggregate}")
    ship(df.sparkSession)
    keys = list(keys)
    fine = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(block).alias("_b"), F.col(value).cast("double").alias("_v"))
    tail = (1 - level) / 2
    large = saved(fine.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > held).select(*keys, F.ceil(F.col("_n") / held).cast("int").alias("_parts")), "large")
    if large.isEmpty():
        return _bootstrap_held(fine, keys, draws, seed, tail, aggregate)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] or [F.lit(True)]
    small = fine.alias("a").join(large.alias("b"), same, "left_anti")
    rest = fine.alias("a").join(large.alias("b"), same).select("a.*", F.pmod(F.xxhash64("a._b"), F.col("b._parts")).alias("_part"))
    return _bootstrap_held(small, keys, draws, seed, tail, aggregate).unionByName(_bootstrap_dealt(rest, keys, draws, seed, tail, aggregate))


def _percentile(x: np.ndarray, p: float) -> float:
    """Between the two nearest of sorted values, as Spark has it."""
    at = (len(x) - 1) * p
    lo, hi = int(np.floor(at)), int(np.ceil(at))
    return float(x[lo] if x[lo] == x[hi] or lo == hi else (hi - at) * x[lo] + (at - lo) * x[hi])


def _bootstrap_held(fine: DataFrame, keys: list[str], draws: int, seed: int, tail: float, aggregate: str) -> DataFrame:
    """The bootstrap of groups that are each a row: its values by block, sorted, so that sums do not depend on partitions."""
    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in fine.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "point double, lo double, hi double"])
    rows = fine.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_b", "_v"))).alias("_x"))
    rows = rows.select(*keys, F.transform("_x", lambda x: F.xxhash64(*keys, x["_b"])).alias("_own"), F.col("_x._v").alias("_v"))

    def sums(own, v):
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        n, s = np.diff(np.r_[first, len(v)]).astype(float), np.add.reduceat(v, first)
        total = np.zeros((3, draws))
        for i in range(0, len(first), 1024):
            times = np.stack([_times(seed, int(o), draws) for o in own[first[i: i + 1024]]])
            total += [n[i: i + 1024] @ times, s[i: i + 1024] @ times, times.sum(axis=0)]
        drawn = total[:, total[0] > 0]
        if aggregate == "mean":
            return s.sum() / n.sum(), drawn[1] / drawn[0]
        return s.sum(), drawn[1] / drawn[2] * len(first)

    def medians(own, v):
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        times = np.stack([_times(seed, int(o), draws).astype(np.uint8) for o in own[first]])
        times = np.repeat(times, np.diff(np.r_[first, len(v)]), axis=0)
        order = np.argsort(v, kind="stable")
        v, times, out = v[order] + 0.0, times[order], []
        for i in range(0, draws, 64):
            upto = np.cumsum(times[:, i: i + 64], axis=0, dtype=np.int32)
            upto = upto[:, upto[-1] > 0]
            lo, hi = ((upto <= rank).sum(axis=0) for rank in ((upto[-1] - 1) // 2, upto[-1] // 2))
            out.append((v[lo] + v[hi]) / 2)
        return _percentile(v, 0.5), np.concatenate(out)

    def run(parts):
        for part in parts:
            found = []
            for own, v in zip(part["_own"], part["_v"], strict=True):
                point, drawn = (medians if aggregate == "median" else sums)(np.asarray(own), np.asarray(v, float))
                drawn = np.sort(drawn)
                found.append((float(point), *(_percentile(drawn, p) if len(drawn) else None for p in (tail, 1 - tail))))
            ends = pd.DataFrame(found, columns=["point", "lo", "hi"], index=part.index)
            yield pd.concat([part[keys], ends], axis=1)

    return rows.mapInPandas(run, schema)


def _bootstrap_dealt(fine: DataFrame, keys: list[str], draws: int, seed: int, tail: float, aggregate: str) -> DataFrame:
    """The bootstrap of large groups: a part of a group's blocks is in one task, so the draws of a group leave a task once for many values."""
    kinds = {f.name: f.dataType.simpleString() for f in fine.schema.fields}
    of = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    if aggregate == "median":
        drawn = _drawn_medians(fine, keys, "_b", draws, seed).withColumnRenamed("median", "_a")
        point = fine.groupBy(*keys).agg(F.median("_v").alias("point"))
    else:
        sums = fine.groupBy(*keys, "_part", "_b").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("_v").alias("s")).withColumn("_seed", F.xxhash64(*keys, "_b"))

        def run(parts):
            import pandas as pd

            for part in parts:
                held: dict[tuple, np.ndarray] = {}
                for row in part.itertuples(index=False):
                    key, (n, s, own) = tuple(row[: len(keys)]), row[len(keys):]
                    times = _times(seed, own, draws)
                    held[key] = held.get(key, 0.0) + np.stack([times * n, times * s, times])
                yield pd.DataFrame([(*k, *v) for k, v in held.items()], columns=[*keys, "n", "s", "b"])

        sums = saved(sums.repartition(*keys, "_part").sortWithinPartitions(*keys, "_part", "_seed").select(*keys, "n", "s", "_seed"), "blocks")
        drawn = sums.mapInPandas(run, f"{of}n array<double>, s array<double>, b array<double>")
        drawn = drawn.select(*keys, F.posexplode(F.arrays_zip("n", "s", "b")).alias("_d", "_x")).groupBy(*keys, "_d").agg(*[F.sum(f"_x.{c}").alias(c) for c in ("n", "s", "b")]).where("n > 0")
        point = sums.groupBy(*keys).agg((F.sum("s") / F.sum("n")).alias("mean"), F.sum("s").alias("sum"), F.count(F.lit(1)).alias("_blocks"))
        blocks = point.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_blocks")
        drawn = drawn.join(blocks, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys] or [F.lit(True)])
        drawn = drawn.withColumn("_a", F.col("s") / F.col("n") if aggregate == "mean" else F.col("s") / F.col("b") * F.col("_blocks"))
        point = point.withColumnRenamed(aggregate, "point")
    ends = drawn.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.percentile("_a", F.array(F.lit(tail), F.lit(1 - tail))).alias("_p"))
    out = point.join(ends, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys] or [F.lit(True)], "left")
    return out.select(*keys, "point", F.col("_p")[0].alias("lo"), F.col("_p")[1].alias("hi"))


def _drawn_medians(fine: DataFrame, keys: list[str], block: str, draws: int, seed: int) -> DataFrame:
    """keys, draw, median: the weighted median of every draw, exact.

    A value is an integer of the same order; its bytes are fixed from the first to the last. In each of eight passes the
    values that share a draw's bytes so far are counted by their next byte, with the draw's weights, and the byte that holds the middle is
    taken. What is merged is bounded by 256 counts for each draw and middle (a draw of even weight has two), whatever the number of values."""
    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in fine.schema.fields}
    of = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    held = fine.groupBy(*keys, "_part", block).agg(F.collect_list("_v").alias("_x")).withColumn("_seed", F.xxhash64(*keys, block))
    held = saved(held.repartition(*keys, "_part").select(*keys, "_seed", "_x"), "blocks")

    def weights(parts):
        for part in parts:
            out: dict[tuple, np.ndarray] = {}
            for row in part.itertuples(index=False):
                key = tuple(row[: len(keys)])
                out[key] = out.get(key, 0) + _times(seed, row[-2], draws) * row[-1]
            yield pd.DataFrame([(*k, d, int(v)) for k, w in out.items() for d, v in enumerate(w)], columns=[*keys, "d", "w"])

    total = held.select(*keys, "_seed", F.size("_x").alias("_n")).mapInPandas(weights, f"{of}, d int, w bigint").groupBy(*keys, "d").agg(F.sum("w").alias("w")).where("w > 0")
    state = total.select(*keys, F.explode(F.array(F.struct((F.col("d") * 2).alias("t"), F.floor((F.col("w") - 1) / 2).alias("rank")), F.struct((F.col("d") * 2 + 1).alias("t"), F.ceil((F.col("w") - 1) / 2).alias("rank")))).alias("_s"))
    state = saved(state.select(*keys, "_s.t", "_s.rank", F.lit(0).cast("bigint").alias("prefix")), "middles")

    for step in range(8):
        low = 56 - 8 * step

        def count(parts, step=step, low=low):
            for part in parts:
                key, t, table = None, None, None
                for row in part.itertuples(index=False):
                    own, x, middles, prefix = row[len(keys):]
                    if tuple(row[: len(keys)]) != key:  # keys come together: what is left behind is done
                        if key is not None:
                            yield flush(key, t, table)
                        key, t = tuple(row[: len(keys)]), np.asarray(middles)
                        table = np.zeros((len(t), 256), np.int64)
                    u = (np.asarray(x, float) + 0.0).view(np.int64)
                    u = (u ^ ((u >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.uint64) ^ np.uint64(1 << 63)
                    prefix, w = np.asarray(prefix).view(np.uint64), _times(seed, own, draws)[t // 2]
                    head = u >> np.uint64(low + 8) if step else np.zeros(len(u), np.uint64)
                    byte = ((u >> np.uint64(low)) & np.uint64(255)).astype(np.int64)
                    for h in np.unique(head):  # draws that have fixed these bytes take this count
                        same = prefix == h
                        if same.any():
                            table[same] += w[same][:, None] * np.bincount(byte[head == h], minlength=256)[None, :]
                if key is not None:
                    yield flush(key, t, table)

        def flush(key, t, table):
            i, j = np.nonzero(table)
            return pd.DataFrame([(*key, int(t[a]), int(b), int(table[a, b])) for a, b in zip(i, j, strict=True)], columns=[*keys, "t", "v", "w"])

        wanted = state.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", "prefix"))).alias("_a")).select(*keys, F.col("_a.t").alias("_t"), F.col("_a.prefix").alias("_p"))
        rows = held.join(wanted, keys).select(*keys, "_seed", "_x", "_t", "_p").sortWithinPartitions(*keys)
        counts = rows.mapInPandas(count, f"{of}, t int, v int, w bigint").groupBy(*keys, "t", "v").agg(F.sum("w").alias("w"))
        upto = F.sum("w").over(W.partitionBy(*keys, "t").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
        hit = counts.withColumn("upto", upto).join(state, [*keys, "t"]).where("rank >= upto - w and rank < upto")
        state = saved(hit.select(*keys, "t", (F.col("rank") - F.col("upto") + F.col("w")).alias("rank"), F.shiftleft("prefix", 8).bitwiseOR(F.col("v").cast("bigint")).alias("prefix")), "middles")

    def numbers(parts):
        for part in parts:
            u = part["prefix"].to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
            u = u.view(np.int64)
            part["x"] = (u ^ ((u >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)
            yield part[[*keys, "t", "x"]]

    return state.select(*keys, "t", "prefix").mapInPandas(numbers, f"{of}, t int, x double").groupBy(*keys, F.expr("t div 2").alias("draw")).agg(F.avg("x").alias("median"))


def bootstrap_ci(df: DataFrame, keys: Sequence[str], value: str, draws: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """keys, point, lo, hi: percentile bootstrap of the mean, one seeded generator per group."""

    def run(pdf):
        import pandas as pd

        x = pdf[value].to_numpy()
        rng = np.random.default_rng(seed)
        means = np.array([x[rng.integers(0, len(x), len(x))].mean() for _ in range(draws)])
        tail = (1 - level) / 2 * 100
        lo, hi = np.percentile(means, [tail, 100 - tail])
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {"point": [x.mean()], "lo": [lo], "hi": [hi]})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "point double, lo double, hi double"])
    return df.where(F.col(value).isNotNull()).select(*keys, value).groupBy(*keys).applyInPandas(run, schema)
