"""Mixing sources to target weights along a time-varying curriculum.

Every source has a target number of words. Its documents form a stream in a fixed pseudo-random
order, read from the start and at most twice. A source's share of the training stream changes
linearly over time; the integral of that schedule is its cumulative demand, and inverting the
demand at a document's offset in its stream gives the moment it is due.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, and the slopes of their schedules, both repeating.
WEIGHTS = (3.0, 1.0, 2.0)
SLOPES = (-0.5, 0.0, 0.5)
ADDED = ("size", "source_size", "target", "taken", "position", "position_again", "n_docs", "weight", "slope", "clock_a", "clock_b")


def _cycle(values, at):
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (at % F.lit(len(values)) + 1).cast("int"))


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS, slopes=SLOPES) -> DataFrame:
    """One row per source (source, source_size, n_docs) -> weight, slope, target and the clock's two sums.

    The sources share ``share`` times all words by weight; a target stops at ``cap`` times its
    source, and the excess goes to the others by weight until none is above. Water filling in
    closed form: in the order of cap over weight, the first k sources are full and the rest share
    what is left. One row per source meets in one task here; documents never do.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1)
    ranked = ranked.withColumn("weight", _cycle(weights, F.col("rank"))).withColumn("slope", _cycle(slopes, F.col("rank")))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("full_at", F.col("most") / F.col("weight"))
    order = W.orderBy("full_at", "rank")
    everything = W.partitionBy()
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    ranked = (ranked.withColumn("want", F.sum("source_size").over(everything) * F.lit(float(share)))
              .withColumn("most_before", F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
              .withColumn("weight_from", F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight")))
    # the level if all before this source are full and it is not
    ranked = ranked.withColumn("level_here", (F.col("want") - F.col("most_before")) / F.col("weight_from"))
    level = F.max(F.when(F.col("level_here") <= F.col("full_at"), F.col("level_here"))).over(everything)
    ranked = ranked.withColumn("target", F.least("most", F.col("weight") * F.coalesce(level, F.lit(float("inf")))))
    return (ranked.withColumn("clock_a", F.sum(F.col("target") * (1 - F.col("slope"))).over(everything))
            .withColumn("clock_b", F.sum(F.col("target") * F.col("slope")).over(everything))
            .select("source", "source_size", "n_docs", "weight", "slope", "target", "clock_a", "clock_b"))


def mix_sources(df: DataFrame, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS, slopes=SLOPES) -> DataFrame:
    """Add size, source_size, target, taken, position and position_again to every document.

    ``taken`` counts the words that the mix takes, repeats included: the source's stream is read
    up to its target, so the documents before that point are taken whole, the one at it in part,
    the later ones not at all; a target above the source's size reads the stream a second time.
    ``position`` is the document's place in the training stream in words (null if not taken), and
    ``position_again`` that of its second reading. A null text has 0 words and takes no part; a
    null source is a source of its own, the last. The order within a source is that of an MD5 sum
    of doc_id, so reruns agree; repeated rows are separate documents. An empty table stays empty.
    ``df`` needs doc_id, text and source; columns of the added names are replaced.

    A running sum over a whole source would meet in one task: rows are range-sorted instead, sums run over the
    ranges of a source and then inside each. A salt behind the sort key lets ranges end within rows that are alike in all.
    Words are counted once; the texts themselves do not move, and are not among the columns returned.
    """
    df = df.drop(*ADDED)
    kept = [c for c in df.columns if c != "text"]
    # other columns ride along in one struct, so no name can clash
    rest = [c for c in kept if c not in ("doc_id", "source")]
    packed = df.select("doc_id", "source", "text", *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")] if rest else []))
    out = place_documents(measured(packed).drop("text"), share, cap, weights, slopes)
    return out.select(*[F.col("rest").getField(c).alias(c) if c in rest else c for c in kept], *ADDED[:6])


def measured(df: DataFrame) -> DataFrame:
    """df with what placing needs of a text: size, its words, and _t, a hash that orders rows of one doc_id."""
    return df.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")).withColumn("_t", F.xxhash64("text"))


def place_documents(df: DataFrame, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS, slopes=SLOPES) -> DataFrame:
    """``mix_sources`` for rows that are measured already; they may carry anything in place of the text."""
    scratch = Scratch(df.sparkSession, "mix")
    docs = scratch.save(df.withColumn("_h", F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")), "measured")
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = scratch.save(source_targets(sizes, share, cap, weights, slopes).withColumnRenamed("source", "_source"), "targets")
    # stored with the number of its range, for another run of the plan may cut ranges elsewhere
    ordered = docs.withColumn("_salt", F.rand(7)).repartitionByRange("source", "_h", "doc_id", "_t", "_salt").withColumn("_part", F.spark_partition_id())
    ordered = scratch.save(ordered.drop("_salt"), "ordered")
    scratch.drop(docs)
    sums = ordered.groupBy(F.col("source").alias("_s"), F.col("_part").alias("_p")).agg(F.sum("size").alias("_n"))
    sums = sums.withColumn("_before", F.coalesce(
        F.sum("_n").over(W.partitionBy("_s").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    docs = ordered.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    docs = docs.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p"))).drop("_s", "_p")
    inside = W.partitionBy("source", "_part").orderBy("_h", "doc_id", "_t").rowsBetween(W.unboundedPreceding, 0)
    docs = docs.withColumn("_at", F.col("_before") + F.sum("size").over(inside) - F.col("size"))
    words = F.floor(F.col("target") + 0.5)
    first = F.greatest(F.lit(0), F.least(F.col("size"), words - F.col("_at")))
    second = F.greatest(F.lit(0), F.least(F.col("size"), words - F.col("source_size") - F.col("_at")))
    docs = docs.withColumn("taken", (first + second).cast("bigint"))

    def due(offset):
        """The demand of a source is target ((1 - slope) u + slope u^2) by the time u: the u at which it reaches the offset."""
        x = F.least(F.lit(1.0), offset / F.col("target"))
        k = F.col("slope")
        root = (k - 1 + F.sqrt((1 - k) * (1 - k) + 4 * k * x)) / (2 * k)
        u = F.when(k == 0, x).otherwise(root)
        return F.col("clock_a") * u + F.col("clock_b") * u * u

    docs = (docs.withColumn("position", F.when(first > 0, due(F.col("_at"))))
            .withColumn("position_again", F.when(second > 0, due(F.col("_at") + F.col("source_size")))))
    return docs.select(*[c for c in df.columns if c not in ("_t", "_h")], "source_size", "target", "taken", "position", "position_again")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per reading of a document, range-sorted by its training position (documents at a
    target's edge are kept whole here)."""
    places = F.filter(F.array("position", "position_again"), lambda p: p.isNotNull())
    rows = mixed.withColumn("_at", F.explode(places)).drop("position", "position_again").withColumnRenamed("_at", "position")
    return rows.orderBy("position", "doc_id")
