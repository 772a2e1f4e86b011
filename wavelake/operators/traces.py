"""Whole-trace analysis of stored epochs by chunks with halos.

A filter over a channel's whole trace forgets: its response dies out. A chunk of consecutive epochs that is filtered together with
enough of its neighbours (a halo) gives, inside, the samples that one filter over the whole trace gives, up to a stated
tolerance. So a trace of any length is filtered in bounded groups, with one shuffle; only the epochs of a halo are copied.
True ends of a trace, and gaps of missing epochs, are ends for the filter as well.

Thresholds over a whole trace come from exact quantiles of all its samples, found by counts and not by gathering them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wavelake.session import ship

#: What a filter may still hold of a sample that the halo leaves out.
TOLERANCE = 1e-9


def settle(*filters: np.ndarray) -> int:
    """Samples after which the zero-phase responses of filters (sections, or a finite response) run in turn are under TOLERANCE."""
    n = 0
    for f in filters:
        if f.ndim == 1:
            n += 2 * len(f)
            continue
        r = max(np.abs(np.roots(s[3:])).max() for s in f)
        n += math.ceil(1.25 * math.log(TOLERANCE) / math.log(r))
    return n


def smooth_ends(n: int, left: bool, right: bool, width: int) -> np.ndarray:
    """Weights of 1 that fall to 0 as an error function over ``width`` samples at ends that were cut."""
    w = np.ones(n)
    width = min(width, n // 2)
    if width > 1 and (left or right):
        ramp = np.array([0.5 + 0.5 * math.erf(12 * (i + 0.5) / width - 6) for i in range(width)])
        if left:
            w[:width] *= ramp
        if right:
            w[-width:] *= ramp[::-1]
    return w


def analytic(x: np.ndarray, left: bool, right: bool, width: int) -> np.ndarray:
    """The analytic signal of a band-passed trace, as if zeros surrounded it; cut ends are faded out, for a sharp cut would be felt
    everywhere. What the true ends of a trace add beyond a halo (about 1 in 10,000 of the value there) is not seen."""
    n = len(x)
    size = 1 << (4 * n - 1).bit_length()  # the more zeros, the nearer to none around a true end
    spectrum = np.fft.fft(x * smooth_ends(n, left, right, width), size)
    spectrum[1: size // 2] *= 2
    spectrum[size // 2 + 1:] = 0
    return np.fft.ifft(spectrum)[:n]


def envelope(x: np.ndarray, left: bool, right: bool, width: int) -> np.ndarray:
    return np.abs(analytic(x, left, right, width))


def pieces(epochs: Sequence[tuple[int, np.ndarray]], per_epoch: int, chunk: int, core: int, halo: int, context: int, kernel: Callable):
    """(first, before, n, arrays) for each run of consecutive epochs in a chunk: sample number of its first core sample, samples of context in front
    of it, core samples, and what the kernel makes of the run, cut to the core and its context.

    An epoch of under ``per_epoch`` samples ends a run, a longer one is cut; of repeated epochs the first counts; samples that
    are not finite count as 0."""
    runs: list[list] = []
    for e, x in sorted(epochs, key=lambda v: v[0]):
        x = np.nan_to_num(np.asarray(x, float)[:per_epoch], nan=0.0, posinf=0.0, neginf=0.0)
        if runs and runs[-1][-1][0] == e:
            continue
        if runs and runs[-1][-1][0] == e - 1 and len(runs[-1][-1][1]) == per_epoch:
            runs[-1].append((e, x))
        else:
            runs.append([(e, x)])
    for run in runs:
        x = np.concatenate([v for _, v in run])
        at, low, high = run[0][0] * per_epoch, chunk * core * per_epoch, (chunk + 1) * core * per_epoch
        a, b = max(at, low) - at, min(at + len(x), high) - at
        if a >= b:
            continue
        made = kernel(x, run[0][0] == chunk * core - halo, run[-1][0] == (chunk + 1) * core + halo - 1)
        lo, hi = max(0, a - context), min(len(x), b + context)
        yield at + a, a - lo, b - a, [np.asarray(m, float)[lo:hi] for m in made]


def filtered(df: DataFrame, kernel: Callable, names: Sequence[str], per_epoch: int, settle: int, context: int = 0, core: int | None = None,
             keys: Sequence[str] = ("rec", "ch")) -> DataFrame:
    """keys, chunk, first, before, n and an array for each of ``names``: what a kernel makes of the whole trace of every key, in chunks.

    ``df`` has the keys, epoch and samples. The kernel gets (samples, left end cut, right end cut) and returns arrays of their length that depend
    on no more than ``settle`` samples to either side. Arrays hold the ``n`` samples of the core from sample number ``first`` on, and up to ``context``
    more on each side (``before`` of them in front), so that an event can be seen whole by the chunk that it starts in.
    A group is ``core`` epochs and its halo; rows with a null epoch or null samples are left out.
    """
    import pyarrow as pa

    ship(df.sparkSession)
    keys = list(keys)
    halo = -(-(settle + context) // per_epoch)
    core = core or max(8, 4 * halo)
    near = F.expr(f"sequence(cast(floor((epoch - {halo}) / {core}) as bigint), cast(floor((epoch + {halo}) / {core}) as bigint))")
    dealt = df.where("epoch is not null and samples is not null").select(*keys, "epoch", "samples", F.explode(near).alias("chunk"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "chunk bigint, first bigint, before int, n int", *[f"{v} array<double>" for v in names]])

    def run(t: pa.Table) -> pa.Table:
        chunk = t.column("chunk")[0].as_py()
        epochs = list(zip(t.column("epoch").to_pylist(), [np.asarray(v.values) if v.values is not None else np.empty(0) for v in t.column("samples")], strict=True))
        rows = list(pieces(epochs, per_epoch, chunk, core, halo, context, kernel))
        fixed = [pa.array([t.column(k)[0].as_py()] * len(rows), t.schema.field(k).type) for k in keys]
        numbers = [pa.array([chunk] * len(rows), pa.int64()), *[pa.array([r[i] for r in rows], kind) for i, kind in ((0, pa.int64()), (1, pa.int32()), (2, pa.int32()))]]
        arrays = [pa.array([r[3][i] for r in rows], pa.list_(pa.float64())) for i in range(len(names))]
        return pa.table([*fixed, *numbers, *arrays], [*keys, "chunk", "first", "before", "n", *names])

    return dealt.groupBy(*keys, "chunk").applyInArrow(run, schema)


def core_of(name: str) -> Column:
    """The core samples of an array of ``filtered``, without its context."""
    return F.slice(F.col(name), F.col("before") + 1, F.col("n"))


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order."""
    u = (x + 0.0).view(np.int64)
    return u ^ ((u >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


#: Low bits that the first count of a quantile leaves out: what is left tells values apart to a part in 256.
LOW_BITS = 44


def exact_quantiles(df: DataFrame, keys: Sequence[str], values: str, probs: Sequence[float]) -> DataFrame:
    """keys, n_values, q0, q1, ...: exact quantiles (linear between neighbours) of all numbers of each key; ``values`` is a column of numbers or of arrays of them.

    Numbers are first counted by their leading bits, then only those that share the bits of a wanted rank are counted one by one, so no key's numbers
    are gathered and equal ones are one row. Nulls and NaN are left out; a key without any number has no row.
    """
    import pyarrow as pa

    ship(df.sparkSession)
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    of = ", ".join(f"{k} {kinds[k]}" for k in keys)
    rows = df.select(*keys, values)

    def numbers(batch, i: int) -> np.ndarray:
        x = batch.column(values)[i].values
        x = np.empty(0) if x is None else np.asarray(x.drop_null(), float)
        return x[~np.isnan(x)]

    def emit(batch, i, counts, **columns):
        at = pa.array(np.full(len(counts), i))
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *(pa.array(c) for c in columns.values()), pa.array(counts.astype(np.int64))], [*keys, *columns, "c"])

    def coarse(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                bins, c = np.unique(_ordered(numbers(batch, i)) >> LOW_BITS, return_counts=True)
                yield emit(batch, i, c, v=bins)

    def marked(batches):
        for batch in batches:
            x = batch.column(values)
            fine = np.isfinite(x.to_numpy(zero_copy_only=False)) | np.isinf(x.to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array(fine))
            bits = _ordered(batch.column(values).to_numpy(zero_copy_only=False)) >> LOW_BITS
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column(values), pa.array(bits)], [*keys, "v", "bin"])

    single = df.schema[values].dataType.typeName() != "array"
    if single:
        rows = rows.withColumn(values, F.col(values).cast("double")).where(F.col(values).isNotNull()).mapInArrow(marked, f"{of}, v double, bin bigint")
        counts = rows.groupBy(*keys, F.col("bin").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    else:
        counts = rows.mapInArrow(coarse, f"{of}, v bigint, c bigint").groupBy(*keys, "v").agg(F.sum("c").alias("c"))
    w = W.partitionBy(*keys)
    counts = counts.withColumn("n_values", F.sum("c").over(w)).withColumn("before", F.sum("c").over(w.orderBy("v").rowsBetween(W.unboundedPreceding, 0)) - F.col("c"))
    place = [F.col("n_values").cast("double") * p - p for p in probs]  # p * (n - 1)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in place])))
    wanted = counts.withColumn("ranks", F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("c")))).where(F.size("ranks") > 0)
    bins = wanted.groupBy(*keys).agg(F.collect_list("v").alias("bins"))  # two for each quantile at most

    def fine(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = numbers(batch, i)
                x = x[np.isin(_ordered(x) >> LOW_BITS, np.asarray(batch.column("bins")[i].values))]
                v, c = np.unique(x + 0.0, return_counts=True)
                yield emit(batch, i, c, v=v, bin=_ordered(v) >> LOW_BITS)

    if single:
        near = rows.join(wanted.select(*keys, F.col("v").alias("bin")), [*keys, "bin"]).groupBy(*keys, "bin", (F.col("v") + 0.0).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    else:
        near = rows.join(bins, keys).select(*keys, values, "bins").mapInArrow(fine, f"{of}, v double, bin bigint, c bigint").groupBy(*keys, "bin", "v").agg(F.sum("c").alias("c"))
    inside = W.partitionBy(*keys, "bin").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    near = near.join(wanted.select(*keys, F.col("v").alias("bin"), "n_values", "before", "ranks"), [*keys, "bin"])
    near = near.withColumn("upto", F.col("before") + F.sum("c").over(inside))
    hit = near.select(*keys, "n_values", "v", F.explode(F.filter("ranks", lambda r: (r >= F.col("upto") - F.col("c")) & (r < F.col("upto")))).alias("rank"))
    found = hit.groupBy(*keys, "n_values").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    out = []
    for i, p in enumerate(place):
        low, high = F.col("at")[F.floor(p)], F.col("at")[F.ceil(p)]
        out.append((low + (high - low) * (p - F.floor(p))).alias(f"q{i}"))
    return found.select(*keys, "n_values", *out)


def per_row(df: DataFrame, keys: Sequence[str], columns: Sequence[str], kernel: Callable, schema: str) -> DataFrame:
    """keys and the rows that a kernel makes of each row: kernel(values of ``columns`` by name) -> tuples of ``schema``. Arrays come as numpy arrays."""
    import pyarrow as pa

    keys, columns = list(keys), list(columns)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    each = [types.get(c.split()[1], pa.list_(pa.float64())) for c in schema.split(", ")]

    def value(v):
        if isinstance(v, (pa.ListScalar, pa.LargeListScalar)):
            return None if v.values is None else np.asarray(v.values)
        return v.as_py()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(kernel(**{c: value(batch.column(c)[i]) for c in columns}))
                if rows:
                    at = pa.array([i] * len(rows))
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *(pa.array(v, kind) for v, kind in zip(zip(*rows, strict=True), each, strict=True))], [*keys, *names])

    out = ", ".join([*[f"{k} {kinds[k]}" for k in keys], schema])
    return df.select(*keys, *[c for c in columns if c not in keys]).mapInArrow(run, out)


def joined_runs(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, start, stop: runs of samples [start, stop) that meet are one; runs inside one chunk never meet, so only seams are closed."""
    w = W.partitionBy(*keys).orderBy("start")
    fresh = F.coalesce(F.lag("stop").over(w) != F.col("start"), F.lit(True))
    marked = df.withColumn("_run", F.sum(fresh.cast("int")).over(w))
    return marked.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_run")
