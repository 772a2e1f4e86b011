"""Graph operators on edge lists."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelake.session import saved

def closed_triangles(edges: DataFrame, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """keys, u, v, w of every triangle once, from distinct undirected edges (keys, i < j); with ``weight`` also uv, uw, vw, the weights of its sides.

    Edges point from the node of smaller degree to that of larger, so a node starts at most about sqrt(2 m) of
    the m edges and a hub's wedges are never listed: each triangle is found once, at its smallest corner. A wedge is
    listed once, towards its larger end. The edges, and those that can close a wedge, are tables of their own."""
    keys = list(keys)
    ends = edges.select(*keys, F.explode(F.array("i", "j")).alias("node")).groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("k"))
    rank = lambda n: F.struct(F.col(f"k_{n}"), F.col(n))
    both = edges.join(ends.withColumnsRenamed({"node": "i", "k": "k_i"}), [*keys, "i"]).join(ends.withColumnsRenamed({"node": "j", "k": "k_j"}), [*keys, "j"])
    first = rank("i") < rank("j")
    side = [F.col(weight).alias("s")] if weight else []
    out = saved(both.select(*keys, F.when(first, F.col("i")).otherwise(F.col("j")).alias("u"), F.when(first, F.col("j")).otherwise(F.col("i")).alias("v"), F.greatest("k_i", "k_j").alias("k"), *side), "edges")
    name = lambda e, u, v, s, *more: e.select(*keys, F.col("u").alias(u), F.col("v").alias(v), *more, *([F.col("s").alias(s)] if weight else []))
    # only edges that start where another ends close a wedge: they are few where low nodes hang on hubs, and their own table shows that to the planner
    closing = saved(name(out.join(out.select(*keys, F.col("v").alias("u")).distinct(), [*keys, "u"], "left_semi"), "v", "w", "vw"), "closing")
    wedges = name(out, "u", "v", "uv", F.col("k").alias("k_v")).join(name(out, "u", "w", "uw", F.col("k").alias("k_w")), [*keys, "u"]).where(rank("v") < rank("w"))
    return wedges.drop("k_v", "k_w").join(closing, [*keys, "v", "w"])


def triangles(edges: DataFrame) -> DataFrame:
    """node, triangles from distinct undirected edges (i < j): the triangles that each node is a corner of."""
    closed = closed_triangles(edges)
    return closed.select(F.explode(F.array("u", "v", "w")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))


def node_clustering(edges: DataFrame, keys: Sequence[str], weight: str = "w") -> DataFrame:
    """keys, node, degree, clustering of weighted graphs: the mean over pairs of a node's neighbours of the cube root of the triangle's weights, each by
    the graph's largest (a pair that is no edge counts 0); 0 under two neighbours. Edges (keys, i < j) have positive weights."""
    keys = list(keys)
    closed = closed_triangles(edges, keys, weight)
    corner = closed.select(*keys, F.explode(F.array("u", "v", "w")).alias("node"), F.cbrt(F.col("uv") * F.col("uw") * F.col("vw")).alias("t")).groupBy(*keys, "node").agg(F.sum("t").alias("t"))
    degree = edges.select(*keys, F.explode(F.array("i", "j")).alias("node")).groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("degree"))
    top = edges.groupBy(*keys).agg(F.max(weight).alias("top"))
    out = degree.join(corner, [*keys, "node"], "left").join(top, keys)
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    return out.select(*keys, "node", "degree", F.coalesce(F.try_divide(F.col("t") / F.col("top"), pairs), F.lit(0.0)).alias("clustering"))


def shortest(dist: np.ndarray) -> np.ndarray:
    for k in range(len(dist)):
        dist = np.minimum(dist, dist[:, k: k + 1] + dist[k: k + 1, :])
    return dist


def efficiency(w: np.ndarray) -> float:
    """Mean inverse distance of all pairs, an edge of weight w being 1 / w long; pairs without a path count 0."""
    n = len(w)
    if n < 2:
        return 0.0
    with np.errstate(divide="ignore"):
        dist = np.where(w > 0, 1 / w, np.inf)
        np.fill_diagonal(dist, 0)
        dist = shortest(dist)
        return float(np.where(np.isfinite(dist) & (dist > 0), 1 / dist, 0).sum() / (n * (n - 1)))


def node_efficiency(edges: DataFrame, keys: Sequence[str], weight: str = "w") -> DataFrame:
    """keys, node, efficiency: that of the graph among a node's neighbours, without the node itself; 0 under two of them.

    The edges among neighbours are the far sides of the node's triangles, so what a group holds is bounded by the node's degree."""
    import pandas as pd

    keys = list(keys)
    closed = closed_triangles(edges, keys, weight)
    far = closed.select(*keys, F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("a"), F.col("w").alias("b"), F.col("vw").alias("s")), F.struct(F.col("v").alias("node"), F.col("u").alias("a"), F.col("w").alias("b"), F.col("uw").alias("s")),
                                                 F.struct(F.col("w").alias("node"), F.col("u").alias("a"), F.col("v").alias("b"), F.col("uv").alias("s")))).alias("e")).select(*keys, "e.*")
    degree = edges.select(*keys, F.explode(F.array("i", "j")).alias("node")).groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("k"))
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}

    def run(pdf):
        names = {v: i for i, v in enumerate(sorted(set(pdf.a) | set(pdf.b)))}
        k = int(pdf.k.iloc[0])
        w = np.zeros((len(names), len(names)))
        for a, b, s in zip(pdf.a, pdf.b, pdf.s, strict=True):
            w[names[a], names[b]] = w[names[b], names[a]] = s
        part = efficiency(w) * len(names) * (len(names) - 1) / (k * (k - 1))  # neighbours without an edge to another reach none
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in [*keys, "node"]}, "efficiency": [part]})

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], f"node {kinds['i']}, efficiency double"])
    found = far.join(degree, [*keys, "node"]).groupBy(*keys, "node").applyInPandas(run, schema)
    return degree.join(found, [*keys, "node"], "left").select(*keys, "node", F.coalesce("efficiency", F.lit(0.0)).alias("efficiency"))


def dense_clustering(w: np.ndarray) -> float:
    k = (w > 0).sum(axis=1)
    if len(w) < 3 or w.max() <= 0:
        return 0.0
    c = np.cbrt(w / w.max())
    around = np.diag(c @ c @ c)
    return float(np.where(k > 1, around / np.maximum(k * (k - 1), 1), 0).mean())


def path_length(w: np.ndarray) -> float:
    """Mean distance of the pairs that have a path, infinite if none has."""
    with np.errstate(divide="ignore"):
        dist = np.where(w > 0, 1 / w, np.inf)
    np.fill_diagonal(dist, 0)
    dist = shortest(dist)[~np.eye(len(w), dtype=bool)]
    return float(dist[np.isfinite(dist)].mean()) if np.isfinite(dist).any() else np.inf


#: Nodes of a graph that is held as a matrix: the channels of a recording.
MAX_NODES = 256


def small_world(edges: DataFrame, keys: Sequence[str], weight: str = "w", draws: int = 10, seed: int = 0) -> DataFrame:
    """keys, sigma: clustering over that of null graphs, by path length over theirs. A null graph deals the weights, and the missing edges, to all pairs
    anew; its generator is seeded by the number of the draw, so each draw of each graph is a task's and results do not depend on partitions.

    Graphs of at most MAX_NODES nodes; null where a null graph has no triangle or the graph no path."""
    import pandas as pd

    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}

    def matrix(pdf) -> np.ndarray:
        names = {v: i for i, v in enumerate(sorted(set(pdf.i) | set(pdf.j)))}
        if len(names) > MAX_NODES:
            raise ValueError(f"a graph of {len(names)} nodes: at most {MAX_NODES} are held as a matrix")
        w = np.zeros((len(names), len(names)))
        w[[names[v] for v in pdf.i], [names[v] for v in pdf.j]] = pdf["_w"]
        return w + w.T

    def run(pdf):
        w, draw = matrix(pdf), int(pdf["_draw"].iloc[0])
        if draw >= 0:
            at = np.triu_indices(len(w), 1)
            new = np.zeros_like(w)
            new[at] = np.random.default_rng([seed, draw]).permutation(w[at])
            w = new + new.T
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in keys}, "_draw": [draw], "c": [dense_clustering(w)], "l": [path_length(w)]})

    every = edges.select(*keys, "i", "j", F.col(weight).cast("double").alias("_w"), F.explode(F.sequence(F.lit(-1), F.lit(draws - 1))).alias("_draw"))
    each = every.groupBy(*keys, "_draw").applyInPandas(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "_draw int, c double, l double"]))
    own, null, finite = F.col("_draw") < 0, F.col("_draw") >= 0, F.col("l") < F.lit(float("inf"))
    g = each.groupBy(*keys).agg(F.max(F.when(own, F.col("c"))).alias("c"), F.max(F.when(own & finite, F.col("l"))).alias("l"), F.avg(F.when(null, F.col("c"))).alias("cr"), F.avg(F.when(null & finite, F.col("l"))).alias("lr"))
    return g.select(*keys, F.try_divide(F.try_divide("c", "cr"), F.try_divide("l", "lr")).alias("sigma"))
