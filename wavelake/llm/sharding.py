"""Extendible hashing: shards are hash-prefix buckets, split bit by bit until each fits a byte limit.

A row belongs to the bucket of the first ``d`` bits of its key hash, where ``d`` is the smallest
depth at which that bucket holds at most ``limit_bytes``. The directory is grown from the root: each
round looks at a few more bits, but only under the buckets that are still too large, and rows leave
the search with the round in which their bucket fits. Only hashes and sizes take part in this.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, carrying

#: Bits of the key hash (15 hexadecimal digits of an MD5 sum).
BITS = 60
#: Bits that a round of the directory looks at.
STEP = 4


def key_hash(*cols: Column) -> Column:
    """60-bit hash of the columns as text, the same in any SQL engine with md5."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _prefix(h: str, depth: Column) -> Column:
    return F.call_function("shiftright", F.col(h), (F.lit(BITS) - depth).cast("int"))


def _directory(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(h, bytes) of rows in buckets that are too large at depth low - 1 -> cell (the first ``high`` bits), depth, full.

    depth is that of the leaf, from low to high, that holds the cell, and full the leaf's bytes; both are null where the
    bucket of ``high`` bits is still too large. A bucket too large with a single hash cannot be split: its depth is BITS."""
    cells = rows.groupBy(_prefix("h", F.lit(high)).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    levels = cells.select("cell", "bytes", "lo", "hi", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    levels = levels.withColumn("p", F.call_function("shiftright", F.col("cell"), (F.lit(high) - F.col("depth")).cast("int")))
    buckets = levels.groupBy("depth", "p").agg(F.sum("bytes").alias("bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    over = F.col("bytes") > limit
    # a leaf fits and its parent does not; the parents of the first level are too large
    split = buckets.where(over).select((F.col("depth") + 1).alias("depth"), F.col("p").alias("up"))
    leaves = buckets.where(~over).withColumn("up", F.call_function("shiftright", F.col("p"), F.lit(1)))
    leaves = leaves.where(F.col("depth") == low).unionByName(leaves.join(split, ["depth", "up"], "left_semi"))
    stuck = buckets.where(over & (F.col("lo") == F.col("hi")) & (F.col("depth") == high))
    whole = (leaves.select("depth", "p", F.col("depth").alias("leaf"), "bytes")
             .unionByName(stuck.select("depth", "p", F.lit(BITS).alias("leaf"), "bytes")))
    at = levels.join(whole.withColumnRenamed("bytes", "full"), ["depth", "p"]).select("cell", "leaf", "full")
    return cells.select("cell").join(at, "cell", "left").select("cell", F.col("leaf").alias("depth"), "full")


def leaf_depths(hashes: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """(h, bytes), one row for each row to store -> (h, depth, full), one row for each hash: its leaf's depth and bytes."""
    open_rows, low, found = scratch.save(hashes, "hashes"), 0, []
    while True:
        high = min(BITS, low + STEP - 1)
        directory = scratch.save(_directory(open_rows, low, high, limit), "directory")
        n, left = directory.agg(F.count("depth"), F.count(F.lit(1)) - F.count("depth")).first()
        if n:
            dealt = scratch.save(open_rows.withColumn("cell", _prefix("h", F.lit(high))).join(directory, "cell").select("h", "bytes", "depth", "full"), "dealt")
            found.append(dealt.where("depth is not null").select("h", "depth", "full"))
            open_rows = dealt.where("depth is null").select("h", "bytes")
        scratch.drop(directory)
        if not left or high == BITS:
            break
        low = high + 1
    if left:  # alike in all bits
        last = open_rows.groupBy("h").agg(F.sum("bytes").alias("full")).select("h", F.lit(BITS).alias("depth"), "full")
        found.append(last)
    out = found[0] if found else hashes.limit(0).select("h", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("full"))
    for part in found[1:]:
        out = out.unionByName(part)
    return out.groupBy("h").agg(F.first("depth").cast("int").alias("depth"), F.first("full").alias("full"))


@carrying("key", "payload")
def assign_shards(df: DataFrame, limit_bytes: int, key: str = "doc_id", payload: str = "text") -> DataFrame:
    """Add n_bytes, shard (the leaf's prefix bits as text, and a page number where rows repeat), depth,
    shard_bytes and oversized to every row.

    The payload counts by its UTF-8 bytes, a null as 0. The key hash covers key and payload, so
    rows that share a key but not a payload can be told apart; null keys hash as an empty text.
    Rows alike in both are indistinguishable for hashing: when they alone exceed the limit they
    are dealt to numbered pages of the leaf. A single row above the limit has a shard of its own,
    marked oversized. An empty table gives an empty table; columns of the added names are replaced.
    Only built-in expressions are used.
    """
    added = ("n_bytes", "shard", "depth", "shard_bytes", "oversized")
    df = df.drop(*added, "_h", "_n", "_each", "_full")
    rows = df.withColumn("n_bytes", F.coalesce(F.octet_length(payload), F.lit(0)).cast("bigint")).withColumn(
        "_h", key_hash(F.col(key), F.md5(F.coalesce(F.col(payload), F.lit("")))))
    scratch = Scratch(df.sparkSession, "shards")
    leaves = scratch.save(leaf_depths(rows.select(F.col("_h").alias("h"), F.col("n_bytes").alias("bytes")), limit_bytes, scratch), "leaves")
    out = rows.join(leaves.select(F.col("h").alias("_h"), F.col("depth"), F.col("full").alias("_full")), "_h", "left")
    bucket = F.substring(F.lpad(F.bin("_h"), BITS, "0"), F.lit(1), F.col("depth"))

    def finish(part: DataFrame) -> DataFrame:
        return part.withColumn("oversized", F.col("shard_bytes") > limit_bytes).select(*df.columns, *added)

    # what no number of bits can divide: one long row, or rows alike in key and payload
    stuck = F.col("_full") > limit_bytes
    alike = leaves.where(F.col("full") > limit_bytes).select(F.col("h").alias("_h"))
    if alike.isEmpty():
        return finish(out.withColumn("shard", bucket).withColumn("shard_bytes", F.col("_full")))
    rest = finish(out.where(~stuck).withColumn("shard", bucket).withColumn("shard_bytes", F.col("_full")))
    # pages: the rows alike are numbered in two steps, within the partition that wrote them and over those;
    # they are stored with its number, for each branch of the plan would number partitions anew
    alike = scratch.save(out.where(stuck).withColumn("_part", F.spark_partition_id()), "alike")
    parts = alike.groupBy("_h", "_part").agg(F.count(F.lit(1)).alias("_c"), F.max("n_bytes").alias("_each"))
    of = W.partitionBy("_h")
    parts = (parts.withColumn("_before", F.coalesce(F.sum("_c").over(of.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
             .withColumn("_page", F.greatest(F.lit(1), F.floor(F.lit(limit_bytes) / F.max("_each").over(of)))).drop("_c", "_each"))
    alike = alike.join(parts, ["_h", "_part"], "left").withColumn(
        "_i", F.row_number().over(W.partitionBy("_h", "_part").orderBy("_part")) - 1 + F.col("_before"))
    alike = alike.withColumn("_page", F.floor(F.col("_i") / F.col("_page")))
    # a row above the limit that stands alone keeps the leaf's name
    shard = F.when(F.col("_full") == F.col("n_bytes"), bucket).otherwise(F.concat(bucket, F.lit("."), F.col("_page").cast("string")))
    alike = scratch.save(alike.withColumn("shard", shard), "pages")
    size = alike.groupBy(F.col("shard").alias("_s")).agg(F.sum("n_bytes").alias("shard_bytes"))
    return rest.unionByName(finish(alike.join(size, F.col("shard") == F.col("_s"))))


def write_shards(df: DataFrame, path: str, limit_bytes: int, key: str = "doc_id", payload: str = "text") -> DataFrame:
    """Write each shard as its own folder of Parquet files and return the directory (shard, depth, rows, bytes)."""
    out = assign_shards(df, limit_bytes, key, payload)
    out.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)
    back = df.sparkSession.read.parquet(path)
    return back.groupBy("shard", "depth").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))
