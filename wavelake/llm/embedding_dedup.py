"""Near-duplicate embeddings by a forest of random-projection trees with spill.

Each tree splits the unit sphere by random directions, one a level, near the medians of its nodes; a vector within the
spill of a split goes to both sides, so two vectors part only if they differ along the direction by more
than twice the spill. Unit vectors spread along a direction by one over the square root of their dimensions, and so does the spill.
Measured on random directions at cosine 0.98 and the greatest depth, 20: 82 of 100 pairs share a leaf of a tree (3 in 100,000 of none
of six), a vector is in 6 leaves a tree, alike in 64 and 256 dimensions. Vectors that share a leaf (and a label) are compared by their cosine.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components
from .topk import usable_vector

TREES = 6
#: Half of the difference along a direction that a split still keeps together, for unit vectors, times the square root of their dimensions.
SPILL = 0.112
#: Distinct vectors that the splits are fitted on at most; all vectors are routed.
SAMPLE = 10_000
#: Vectors of a leaf that are compared in one group; larger leaves are compared in pairs of blocks.
BLOCK = 1024
#: Depth grows with the logarithm of the input up to this one, 2 BLOCK vectors a leaf for 2 * 10**9 of them; a forest is
#: then a threshold for each of 2**20 nodes a tree, 25 MB in all.
MAX_DEPTH = 20
#: Sampled vectors that a node takes its own median from; with fewer, its level's median splits it.
NODE_SAMPLE = 8


class Forest:
    """A split direction for each level of a tree, and thresholds in heap order, one for each node."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int, spill: float, seed: int = 6):
        rng = np.random.default_rng(seed)
        self.depth, self.spill = depth, spill
        self.trees = []
        for _ in range(trees):
            direction = rng.standard_normal((depth, sample.shape[1]))
            direction /= np.linalg.norm(direction, axis=1, keepdims=True)
            threshold = np.zeros(2**depth - 1, np.float32)
            node = np.zeros(len(sample), np.int64)
            for level in range(depth):
                p = sample @ direction[level]
                threshold[2**level - 1: 2 ** (level + 1) - 1] = np.median(p)
                order = np.argsort(node, kind="stable")
                heads = np.flatnonzero(np.concatenate([[True], np.diff(node[order]) > 0])) if len(node) else []
                for i, j in zip(heads, [*heads[1:], len(node)], strict=True):
                    if j - i >= NODE_SAMPLE:
                        threshold[node[order[i]]] = np.median(p[order[i:j]])
                node = 2 * node + 1 + (p > threshold[node])
            if not np.isfinite(threshold).all():
                raise ValueError("a split without a finite threshold would drop vectors")
            self.trees.append((direction, threshold))

    def leaves(self, x: np.ndarray):
        """(tree, rows, leaves): every leaf that each unit vector reaches."""
        for t, (direction, threshold) in enumerate(self.trees):
            rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for level in range(self.depth):
                p = (x @ direction[level])[rows]
                left, right = p <= threshold[node] + self.spill, p >= threshold[node] - self.spill
                rows, node = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
            yield t, rows, node


def unit(lists) -> np.ndarray:
    """Vectors of length 1, of any that are finite and not zero."""
    x = np.array(lists, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # a square must not leave the range of a double
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_vectors(df: DataFrame, least: float = 0.98, trees: int = TREES, spill: float = SPILL, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label).

    Vectors are linked when their labels are equal and not null and their cosine in double
    precision is at least ``least``; only vectors of equal length are compared. Vectors that are
    null, empty, zero, or hold null or non-finite components link with nothing. n_links counts the other rows
    linked directly, component_id is the smallest id that links lead to. Equal vectors of a label
    are one node with a count from the start, so a group of copies is never paired out; repeated rows
    count as rows, a null id as larger than any other. An empty table stays empty.

    The splits come from at most SAMPLE distinct vectors; every vector is routed. The forest's size is
    bounded by MAX_DEPTH, so it may be broadcast.
    """
    import pyarrow as pa

    spark = df.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = df.select(F.col(key).alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    usable = F.col("label").isNotNull() & usable_vector("v") & F.exists("v", lambda x: x != 0)
    fine = rows.where(usable).withColumn("cid", F.xxhash64("label", "v"))
    classes = scratch.save(fine.groupBy("cid", "label", "v").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("low")), "classes")
    n = classes.count()
    if n == 0:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    depth = min(MAX_DEPTH, max(0, (n // (2 * BLOCK)).bit_length()))

    forests = {}
    sample = classes.select("v").orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).toArrow().column("v").to_pylist()
    for dim in {len(v) for v in sample}:
        x = np.array([v for v in sample if len(v) == dim], np.float64)
        forests[dim] = Forest(unit(x), depth, trees, spill / np.sqrt(dim))
    shared = spark.sparkContext.broadcast(forests)

    def route(batches):
        for batch in batches:
            cids, vs = batch.column("cid").to_numpy(), batch.column("v").to_pylist()
            dims = np.array([len(v) for v in vs])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                forest = shared.value.get(int(dim))
                parts = forest.leaves(unit([vs[i] for i in at])) if forest else [(0, np.arange(len(at)), np.zeros(len(at), np.int64))]
                for t, r, leaf in parts:
                    for k in range(0, len(r), 20_000):
                        piece = r[k: k + 20_000]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(cids[at[piece]]), batch.column("label").take(pa.array(at[piece])), pa.array(np.full(len(piece), t, np.int32)),
                             pa.array(leaf[k: k + 20_000]), pa.array(np.full(len(piece), dim, np.int32))], ["cid", "label", "tree", "leaf", "dim"])

    kind = rows.schema["label"].dataType.simpleString()
    routed = classes.select("cid", "label", "v").mapInArrow(route, f"cid bigint, label {kind}, tree int, leaf bigint, dim int")
    routed = scratch.save(routed, "routed")
    keys = ["label", "tree", "leaf", "dim"]
    sizes = routed.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nb")).where("nb > 1")
    routed = routed.join(sizes, keys, "left").withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn("b", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int"))
    routed = routed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    routed = routed.select(*keys, "cid", "b", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"))
    routed = routed.join(classes.select("cid", "v"), "cid")

    def compare(t: pa.Table) -> pa.Table:
        cid, b = t.column("cid").to_numpy(), t.column("b").to_numpy()
        x = unit(t.column("v").to_pylist())
        bi, bj = t.column("bi")[0].as_py(), t.column("bj")[0].as_py()
        p, q = (np.flatnonzero(b == bi), np.flatnonzero(b == bj))
        i, j = np.nonzero(x[p] @ x[q].T >= least - 1e-12)
        a, c = cid[p[i]], cid[q[j]]
        keep = a < c if bi == bj else np.ones(len(a), bool)
        a, c = a[keep], c[keep]
        exact = np.einsum("ij,ij->i", x[p[i[keep]]], x[q[j[keep]]]) >= least
        return pa.table({"a": np.minimum(a, c)[exact], "b": np.maximum(a, c)[exact]})

    pairs = scratch.save(routed.groupBy(*keys, "bi", "bj").applyInArrow(compare, "a bigint, b bigint").distinct(), "pairs")
    weight = classes.select("cid", "m")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(weight, both["b"] == weight["cid"]).groupBy("a").agg(F.sum("m").alias("d"))
    comps = scratch.save(connected_components(pairs, scratch), "components")
    nodes = (classes.select("cid", "m", "low").join(degree, F.col("cid") == F.col("a"), "left").join(comps, F.col("cid") == F.col("node"), "left")
             .select("cid", "low", (F.col("m") - 1 + F.coalesce("d", F.lit(0))).alias("links"), F.coalesce("comp", "cid").alias("comp")))
    least_id = nodes.groupBy("comp").agg(F.min("low").alias("component"))
    nodes = nodes.join(least_id, "comp").select(F.col("cid").alias("_cid"), "links", "component")
    ids = rows.withColumn("cid", F.when(usable, F.xxhash64("label", "v")))
    out = ids.join(nodes, F.col("cid") == F.col("_cid"), "left")
    component = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.col("vec_id").isNull() & component.isNull()).alias("kept"))
