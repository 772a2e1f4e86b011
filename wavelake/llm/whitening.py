"""Whitening of embeddings: covariance by upper-triangle column aggregates, eigenvectors by LAPACK.

One aggregation sums the entries of every dimension, a second one the centred products of every pair of dimensions,
each pair a generated Spark SQL expression. The covariance, a matrix of the dimensions and never of the rows, is
decomposed on the driver; rows are projected in Arrow batches by one matrix product.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship_package
from .topk import _matrix, usable_vector

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Dimensions at most: their pairs are the columns of one aggregation.
MAX_DIM = 256


def centred(n: int, sums: list[int], name: str = "x") -> list[Column]:
    """Entries less their mean, (n * x - S) / n: the difference is exact, so a large common shift costs no digits."""
    return [((F.coalesce(F.col(name)[i], F.lit(0)) * F.lit(n) - F.lit(s)).cast("double") * F.lit(1.0 / n)).alias(f"c{i}") for i, s in enumerate(sums)]


def pair_sums(df: DataFrame, names: list[str]) -> np.ndarray:
    """The symmetric matrix of sums of products of every pair of columns, each pair once, in one aggregation."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    columns = ", ".join(f"sum({names[i]} * {names[j]}) AS v{i}_{j}" for i, j in pairs)
    row = df.sparkSession.sql(f"SELECT {columns} FROM {{entries}}", entries=df).first()
    out = np.zeros((len(names), len(names)))
    for (i, j), v in zip(pairs, row, strict=True):
        out[i, j] = out[j, i] = v or 0.0
    return out


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of a covariance and their unit eigenvectors, the entry of largest size positive."""
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:most]
    e, u = e[order], u[:, order]
    return e, u * np.where(np.take_along_axis(u, np.abs(u).argmax(axis=0)[None, :], axis=0) < 0, -1.0, 1.0)


def whiten(df: DataFrame, most: int = 32, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Vectors that are null, empty or hold null or non-finite entries take no part, nor those with an entry beyond
    2**53 once scaled. All vectors have the length that most have (the longer on a tie); others take no part. Repeated
    rows and null ids are rows like others. A component without variance (an eigenvalue that rounding alone
    explains, as of fewer vectors than dimensions) has a null whitened value and is left out of identity_error; with no variance at
    all explained and identity_error are null. ``deviation`` is null where it exceeds a long. No vectors, no rows.

    The driver holds matrices of the dimensions, MAX_DIM at most.
    """
    import pyarrow as pa

    spark = df.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "whitening")
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fine = df.where(usable_vector(vector)).where(F.forall(vector, lambda c: F.abs(c.cast("double") * scale) < F.lit(2.0**53)))
    x = fine.select(F.col(key).alias("vec_id"), F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(shift)).alias("x"))
    lengths = x.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim, n = lengths
    if dim > MAX_DIM:
        raise ValueError(f"vectors of {dim} entries: the pairs of at most {MAX_DIM} are aggregated at once")
    x = scratch.save(x.where(F.size("x") == dim), "entries")
    sums = list(x.agg(*[F.sum(F.col("x")[i]) for i in range(dim)]).first())

    names = [f"c{i}" for i in range(dim)]
    v = pair_sums(x.select(*centred(n, sums)), names) / n
    e, u = components(v, min(most, dim))
    trace = float(np.trace(v))
    live = [k for k in range(len(e)) if e[k] > dim * np.finfo(float).eps * max(e[0], 0.0)]

    # n * x - S is exact; a square or a sum that leaves the range of a long makes the deviation null
    total = "".join(["aggregate(zip_with(x, array(", ", ".join(f"{s}L" for s in sums), f"), (a, s) -> a * {n}L - s), 0L, (t, d) -> try_add(t, try_multiply(d, d)))"])
    basis = (u[:, live] / np.sqrt(e[live])).T if live else np.zeros((0, dim))

    def project(batches):
        for batch in batches:
            d = _matrix(batch.column("x")) * np.int64(n) - np.array(sums, np.int64)
            w = np.full((len(d), len(e)), np.nan)
            w[:, live] = (d / n) @ basis.T
            values = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "deviation")), pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * len(e)), values)], ["vec_id", "deviation", "w"])

    rows = x.select("vec_id", F.expr(total).alias("deviation"), "x").mapInArrow(project, "vec_id bigint, deviation bigint, w array<double>")
    error = None
    if live:
        means = list(rows.agg(*[F.avg(F.col("w")[k]) for k in live]).first())
        white = rows.select(*[(F.coalesce(F.col("w")[k], F.lit(0.0)) - F.lit(m)).alias(f"w{k}") for k, m in zip(live, means, strict=True)])
        error = float(np.abs(pair_sums(white, [f"w{k}" for k in live]) / n - np.eye(len(live))).max())
    share = F.array(*[F.lit(float(v / trace) if trace > 0 else None).cast("double") for v in e])
    out = rows.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return out.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", F.get(share, F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
