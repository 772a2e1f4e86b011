"""Hard negatives by norm-bucketed search: rows of another label that score just under an anchor's positives.

Candidates are sorted by norm once and cut into buckets. By Cauchy and Schwarz no row of a bucket scores above the anchor's
norm times the bucket's largest one, so a bucket is skipped where that is under the lower limit of a window, or under the
k-th score that the window holds already. Buckets are visited from large norms to small ones in rounds that grow, so later
rounds know good k-th scores; inside a round each bucket is read in slices, also from large norms down, under the same rule.

The anchors of a block meet the candidates of a bucket in one task as matrices. Both are bounded in bytes, whatever
the data; with blocks of 2**22 components (65,536 rows of 64) the anchors, a hundredth of the rows here, are copied
once a bucket and the candidates once a block of anchors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, ship_package
from .topk import _matrix, usable_vector

#: Components of the anchors of a block, and of the candidates of a bucket.
BLOCK = 1 << 22
#: Candidates and anchors that are multiplied at a time.
SLICE, ANCHORS = 2048, 256
#: Each round visits so many times the buckets of the one before.
GROWTH = 8
#: Where no score is needed or known.
NONE = -(1 << 62)


class Windows:
    """The best ``k`` scores of every window (a row of limits for each anchor), found slice by slice."""

    def __init__(self, low: np.ndarray, high: np.ndarray, floor: np.ndarray, k: int):
        self.high, self.k = high, k
        self.least = np.maximum(low, floor)
        self.score = np.full((*low.shape, k), -np.inf)
        self.ids = np.full((*low.shape, k), np.iinfo(np.int64).max)

    def open(self, rows: slice, bound: np.ndarray) -> np.ndarray:
        """Anchors of which a window can still take a score of no more than ``bound``."""
        return np.flatnonzero((self.least[rows] <= np.minimum(self.high[rows], bound[:, None])).any(axis=1))

    def take(self, rows: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
        k = self.k
        for w in range(self.high.shape[1]):
            least = self.least[rows, w]
            fits = (s >= least[:, None]) & (s <= self.high[rows, w][:, None])
            if fits.sum() > 4 * k * len(rows) and s.shape[1] > k:
                top = np.partition(np.where(fits, s, -np.inf), -k, axis=1)[:, -k]
                fits &= s >= top[:, None]
            i, j = np.nonzero(fits)
            if not len(i):
                continue
            touched = np.unique(i)
            at = rows[touched]
            row = np.concatenate([np.repeat(touched, k), i])
            score = np.concatenate([self.score[at, w].ravel(), s[i, j]])
            known = np.concatenate([self.ids[at, w].ravel(), ids[j]])
            order = np.lexsort((known, -score, row))
            first = np.searchsorted(row[order], touched)
            best = order[first[:, None] + np.arange(k)]
            self.score[at, w], self.ids[at, w] = score[best], known[best]
            self.least[at, w] = np.maximum(self.least[at, w], self.score[at, w, -1])


def search_block(anchors: dict, found: dict, k: int, same: bool) -> tuple[Windows, int]:
    """Windows of a block of anchors over the candidates of a bucket, and the pairs that were scored."""
    order = np.argsort(-found["norm"], kind="stable")
    norm = np.sqrt(found["norm"][order])
    x, ids, label = found["v"][order].astype(float), found["id"][order], found["label"][order]
    q, reach, n_pairs = anchors["v"].astype(float), np.sqrt(anchors["norm"]) * (1 + 1e-9), 0
    windows = Windows(anchors["low"], anchors["high"], anchors["floor"], k)
    for a in range(0, len(q), ANCHORS):
        rows = slice(a, min(a + ANCHORS, len(q)))
        for c in range(0, len(x), SLICE):
            at = windows.open(rows, reach[rows] * norm[c]) + a  # norms fall, so c has the largest of this slice and of all that follow
            if not len(at):
                break
            s = q[at] @ x[c: c + SLICE].T
            n_pairs += s.size
            alike = anchors["label"][at][:, None] == label[None, c: c + SLICE]
            s[~alike | (anchors["id"][at][:, None] == ids[None, c: c + SLICE]) if same else alike] = np.nan
            windows.take(at, s, ids[c: c + SLICE])
    return windows, n_pairs


def numbered(df: DataFrame, size: Column, name: str, parts: int, scratch: Scratch, *order: Column) -> DataFrame:
    """Sort all rows by range and number blocks of ``size`` rows, however many partitions they lie in: saved with their place in
    their partition, which the rows of the partitions before it then shift."""
    row = F.monotonically_increasing_id()
    out = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    out = scratch.save(out.withColumn("_part", F.shiftright(row, 33)).withColumn("_row", F.pmod(row, F.lit(1 << 33))), name)
    counts = out.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    counts = scratch.save(counts.select("_part", before.alias("_before")), "places")
    return out.join(counts, "_part").withColumn(name, ((F.col("_before") + F.col("_row")) / size).cast("bigint")).drop("_part", "_row", "_before")


def best_in_windows(anchors: DataFrame, rows: DataFrame, buckets: DataFrame, k: int, same: bool, scratch: Scratch) -> DataFrame:
    """id, tag, w, hit, score: the ``k`` best rows of every window, ties to the smaller id.

    ``anchors``: id, tag, label, v, norm, dim, block, low, high (arrays, one entry a window). ``rows``: id, label, v, norm, dim, bucket.
    ``buckets``: dim, bucket, norm (the largest), place. With ``same`` rows of the anchor's label other than itself count, else those of others.
    """
    import pyarrow as pa

    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    n_buckets = buckets.agg(F.max("place")).first()[0] or 0
    found, start, size, part = None, 1, max(1, cores), "id bigint, tag bigint, w int, hit bigint, score bigint"

    def side(t: pa.Table) -> dict:
        out = {c: t.column(c).to_numpy() for c in ("id", "norm")}
        return out | {"v": _matrix(t.column("v")), "label": t.column("label").to_numpy(zero_copy_only=False)} | {c: _matrix(t.column(c)) for c in ("low", "high", "floor") if c in t.column_names}

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({c: pa.array([], pa.int32() if c == "w" else pa.int64()) for c in ("id", "tag", "w", "hit", "score")})
        a, c = side(left), side(right)
        codes = np.unique(np.concatenate([a["label"].astype(str), c["label"].astype(str)]), return_inverse=True)[1]
        a["label"], c["label"] = codes[: len(left)], codes[len(left):]
        got = search_block(a, c, k, same)[0]
        at, w, place = np.nonzero(np.isfinite(got.score))
        return pa.table({"id": a["id"][at], "tag": left.column("tag").to_numpy()[at], "w": w.astype(np.int32), "hit": got.ids[at, w, place], "score": got.score[at, w, place].astype(np.int64)})

    while start <= n_buckets:
        floors = anchors.withColumn("floor", F.transform("low", lambda _: F.lit(NONE)))
        if found is not None:
            kth = found.groupBy("id", "tag", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") >= k)
            kth = kth.groupBy("id", "tag").agg(F.map_from_entries(F.collect_list(F.struct("w", "s"))).alias("kth"))  # an entry a window
            floors = anchors.join(kth, ["id", "tag"], "left").withColumn("floor", F.transform("low", lambda _, i: F.coalesce(F.col("kth")[i], F.lit(NONE)))).drop("kth")
        # what a bucket's largest norm must reach: the least limit of a window over the anchor's norm
        need = F.array_min(F.transform(F.arrays_zip("low", "high", "floor"), lambda t: F.when(F.greatest(t.low, t.floor) <= t.high, F.greatest(t.low, t.floor).cast("double"))))
        floors = scratch.save(floors.withColumn("need", F.when(need <= 0, F.lit(0.0)).when(F.col("norm") > 0, need / (F.sqrt("norm") * (1 + 1e-9)))).where("need is not null"), "anchors")
        blocks = floors.groupBy("dim", "block").agg(F.min("need").alias("need"))
        near = buckets.where(F.col("place").between(start, start + size - 1))
        pairs = scratch.save(blocks.join(near, "dim").where(F.sqrt("norm") >= F.col("need")).select("dim", "block", "bucket"), "pairs")
        n = pairs.count()
        if n:
            keys = ["dim", "block", "bucket"]
            tasks = int(min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * cores)))
            left = floors.join(pairs, ["dim", "block"]).select(*keys, "id", "tag", "label", "v", "norm", "low", "high", "floor").repartition(tasks, *keys)
            right = rows.join(pairs, ["dim", "bucket"]).select(*keys, "id", "label", "v", "norm").repartition(tasks, *keys)
            got = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, part)
            rank = F.row_number().over(W.partitionBy("id", "tag", "w").orderBy(F.desc("score"), "hit"))
            got = got if found is None else got.unionByName(found)
            found = scratch.save(got.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"), "found")
        start, size = start + size, size * GROWTH
    return found if found is not None else spark.createDataFrame([], part)


def hard_negatives(df: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0,
                   key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows where ``anchor`` holds (an expression over ``df``). Components are floor(scale * x), a score is their integer inner
    product; higher scores come first, ties by smaller id. An anchor's positives are its first ``positives`` other rows of its label; for each
    of them the first ``negatives`` rows of other labels are returned whose score is ``low`` to ``high`` percent of the positive's, ends included.

    Rows with a null id or label, a null or empty vector, null or non-finite components take no part, nor those whose squared norm once
    scaled reaches 2**53 (below it every score is exact). Only vectors of one length are compared. Repeated candidates each count, repeated
    anchors are one; rows of an anchor's own id are none of its positives. A positive score under zero leaves no window. Empty in, empty out.
    """
    spark = df.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "negatives")
    cores = spark.sparkContext.defaultParallelism
    whole = df.where(F.col(key).isNotNull() & F.col(label).isNotNull() & usable_vector(vector)).select(
        F.col(key).cast("bigint").alias("id"), F.col(label).alias("label"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
        F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("v"))
    whole = whole.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda t, c: t + c * c)).where(F.col("norm") < 2.0**53)
    whole = whole.withColumn("v", F.col("v").cast("array<int>")).withColumn("dim", F.size("v"))
    clean = scratch.save(whole, "clean")
    n = clean.count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * cores)
    parts = max(1, min(tasks, -(-n // SLICE)), n >> 20)
    block = F.greatest(F.lit(1024), F.lit(BLOCK) / F.col("dim"))
    # equal norms (a large group of copies) are dealt by their ids; a small table still gives every core a bucket
    rows = numbered(clean, F.least(block, F.lit(float(max(SLICE, -(-n // tasks))))), "bucket", parts, scratch, F.desc("norm"), F.xxhash64("id"))
    scratch.drop(clean)
    buckets = rows.groupBy("dim", "bucket").agg(F.max("norm").alias("norm"))
    buckets = scratch.save(buckets.withColumn("place", F.row_number().over(W.partitionBy("dim").orderBy("bucket"))), "buckets")  # a row a bucket

    alone = rows.where("is_anchor").select("id", "label", "v", "norm", "dim").distinct().withColumn("tag", F.xxhash64("label", "v"))
    first = alone.withColumn("low", F.array(F.lit(NONE))).withColumn("high", F.array(F.lit(-NONE)))
    first = numbered(first, block, "block", 1 + parts // 8, scratch, F.desc("norm"), F.xxhash64("id"))
    near = best_in_windows(first, rows, buckets, positives, True, scratch)
    near = scratch.save(near.withColumn("w", F.row_number().over(W.partitionBy("id", "tag").orderBy(F.desc("score"), "hit")).cast("int") - 1)
                        .select("id", "tag", "w", F.col("hit").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # whole numbers from low to high percent of the positive's score
    least = F.expr(f"({low} * positive_score + pmod(-{low} * positive_score, 100L)) div 100")
    most = F.expr(f"({high} * positive_score - pmod({high} * positive_score, 100L)) div 100")
    limits = near.groupBy("id", "tag").agg(F.array_sort(F.collect_list(F.struct("w", least.alias("low"), most.alias("high")))).alias("l"))  # ``positives`` at most
    pad = lambda name, fill: F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.get(F.col(f"l.{name}"), i - 1), F.lit(fill)))
    then = first.drop("low", "high", "block").join(limits, ["id", "tag"]).withColumn("low", pad("low", 1)).withColumn("high", pad("high", 0)).drop("l")
    then = numbered(then, block, "block", 1 + parts // 8, scratch, F.col("low")[0] / F.sqrt(F.col("norm") + 1), F.xxhash64("id"))
    far = best_in_windows(then, rows, buckets, negatives, False, scratch)
    rank = F.row_number().over(W.partitionBy("id", "tag", "w").orderBy(F.desc("score"), "hit"))
    out = far.withColumn("rank", rank).join(near, ["id", "tag", "w"])
    return out.select(F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("hit").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
