"""Exact top-k search by inner product with cover trees over queries and candidates together.

The top levels of a cover tree over a bounded sample of the candidates give pivots. Every candidate and every query
goes to its nearest pivot; a cell's covering radius is taken over all its rows. A query's first k-th score is the one that
the sample gives, which its true one cannot be below. A group of queries visits only the cells where
the largest inner product that both covering radii allow reaches the worst k-th score of the group. Inside such
a pair of blocks two cover trees are descended together by the same rule, and leaves are compared as matrices.

Where the data do not cluster, as random directions of many dimensions, no ball can be left out and the search compares
each query with each candidate, in blocks; a node whose points halving the radius would not gather stays a leaf.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows of a candidate block and of a query block; larger cells are dealt to several blocks.
BLOCK = 4096
QUERY_BLOCK = 2048
#: Candidates that pivots and first thresholds are taken from at most, and pivots at most.
SAMPLE = 4096
PIVOTS = 1024
LEAF = 64
QUERY_LEAF = 8


class Node:
    __slots__ = ("center", "radius", "children", "points", "size")

    def __init__(self, center, radius, children, points):
        self.center, self.radius, self.children, self.points, self.size = center, radius, children, points, len(points)


def _split(x: np.ndarray, points: np.ndarray, center: int, dist: np.ndarray, radius: float, leaf: int) -> list[tuple[np.ndarray, int]]:
    """Parts of the points within half the radius of their centre, each centre farther than that from the earlier ones;
    none if the points do not gather."""
    half, most = radius / 2, 2 + 2 * len(points) // leaf
    near = dist <= half
    parts, rest = [(points[near], center)], points[~near]
    while len(rest):
        if len(parts) > most:
            return []
        c = int(rest[0])
        near = np.sqrt(((x[rest] - x[c]) ** 2).sum(axis=1)) <= half
        parts.append((rest[near], c))
        rest = rest[~near]
    return parts


def cover_tree(x: np.ndarray, points: np.ndarray, center: int | None = None, leaf: int = LEAF) -> Node:
    """Tree over the rows ``points`` of ``x``. The children of a node cover its points within half its
    radius, and their centres are farther apart than that; the first child keeps the node's centre."""
    center = int(points[0]) if center is None else center
    dist = np.sqrt(((x[points] - x[center]) ** 2).sum(axis=1))
    radius = float(dist.max())
    parts = _split(x, points, center, dist, radius, leaf) if len(points) > leaf and radius > 0 else []
    return Node(center, radius, [cover_tree(x, p, c, leaf) for p, c in parts], points)


def pivots(x: np.ndarray, most: int) -> np.ndarray:
    """Rows of ``x`` that are centres of the top levels of its cover tree, at most ``most``, widest nodes first."""
    level = [cover_tree(x, np.arange(len(x)))]
    while True:
        wide = max((n for n in level if n.children), key=lambda n: (n.radius, n.size), default=None)
        if wide is None or len(level) - 1 + len(wide.children) > most:
            return np.array(sorted({n.center for n in level}))
        level = [n for n in level if n is not wide] + wide.children


def reach(product, radius_q, norm_q, radius_x, norm_x):
    """Largest inner product of a point within radius_q of one centre and one within radius_x of another, with room for rounding."""
    top = product + radius_q * norm_x + radius_x * norm_q + radius_q * radius_x
    return top + 1e-9 * np.abs(top) + 1e-6


class Search:
    """The k best candidates of each query, by score and then by smaller id; none below the query's floor."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.q, self.q_ids, self.x, self.x_ids, self.k = q, q_ids, x, x_ids, k
        self.norm_q, self.norm_x = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
        self.score = np.full((len(q), k), -np.inf)
        self.best = np.full((len(q), k), np.iinfo(np.int64).max)
        self.least = np.full(len(q), -np.inf) if floor is None else floor.astype(np.float64)
        self.pairs = 0  # scores computed, for measurements
        if len(q) and len(x):
            self.descend(cover_tree(q, np.arange(len(q)), leaf=QUERY_LEAF), cover_tree(x, np.arange(len(x))))

    def bounds(self, a: Node, nodes: list[Node]) -> np.ndarray:
        """Largest inner product that any query under ``a`` can have with any point under each node."""
        c = np.array([n.center for n in nodes])
        r = np.array([n.radius for n in nodes])
        return reach(self.x[c] @ self.q[a.center], a.radius, self.norm_q[a.center], r, self.norm_x[c])

    def compare(self, a: Node, points: np.ndarray) -> None:
        rows, k = a.points, self.k
        s = self.q[rows] @ self.x[points].T
        self.pairs += s.size
        s[self.q_ids[rows][:, None] == self.x_ids[points][None, :]] = -np.inf
        least = self.least[rows]
        if s.shape[1] > k:
            least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k])
        i, j = np.nonzero((s >= least[:, None]) & np.isfinite(s))
        if not len(i):
            return
        touched = np.unique(i)
        row = np.concatenate([np.repeat(touched, k), i])
        score = np.concatenate([self.score[rows[touched]].ravel(), s[i, j]])
        ids = np.concatenate([self.best[rows[touched]].ravel(), self.x_ids[points[j]]])
        order = np.lexsort((ids, -score, row))
        first = np.searchsorted(row[order], touched)
        take = order[first[:, None] + np.arange(k)]
        self.score[rows[touched]], self.best[rows[touched]] = score[take], ids[take]
        self.least[rows] = np.maximum(self.least[rows], self.score[rows, -1])

    def worst(self, a: Node) -> float:
        return float(self.least[a.points].min())

    def descend(self, a: Node, b: Node) -> None:
        if self.bounds(a, [b])[0] < self.worst(a):
            return
        if a.children and (not b.children or a.radius >= b.radius):
            for child in a.children:
                self.descend(child, b)
            return
        if not b.children:
            self.compare(a, b.points)
            return
        top = self.bounds(a, b.children)
        ends: list[np.ndarray] = []  # leaves are compared together, best bounds first
        held = 0
        for i in np.argsort(-top, kind="stable"):
            if top[i] < self.worst(a):
                break
            child = b.children[i]
            if child.children or a.children:
                self.descend(a, child)
                continue
            ends.append(child.points)
            held += len(child.points)
            if held >= 4 * LEAF:
                self.compare(a, np.concatenate(ends))
                ends, held = [], 0
        if ends:
            self.compare(a, np.concatenate(ends))


def usable_vector(vector: str):
    """Whether a vector is not null or empty and has only finite components."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def _matrix(column) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix."""
    chunks = column.chunks if hasattr(column, "chunks") else [column]
    return np.concatenate([np.asarray(c.flatten()) for c in chunks]).reshape(len(column), -1)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, scale: float = 1024.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the ``k`` candidates of highest score of each query.

    Components are floor(scale * x); a score is their integer inner product (exact below 2**53),
    and ties go to the smaller id. A candidate with the query's own id is left out. Rows with a null id,
    a null or empty vector, or a null or non-finite component take no part; only vectors of equal
    length are compared. Repeated candidate rows are each a candidate, repeated query rows are
    one. Fewer candidates than ``k`` give fewer rows, none gives none.

    The driver takes a sample of at most SAMPLE candidates and one row for each of at most PIVOTS cells of a length.
    """
    import pyarrow as pa

    from .common import Scratch

    spark = queries.sparkSession
    scratch = Scratch(spark, "topk")

    def whole(df):
        return df.where(F.col(key).isNotNull() & usable_vector(vector)).select(
            F.col(key).cast("bigint").alias("id"), F.transform(vector, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("v")).withColumn("dim", F.size("v"))

    cand, quer = whole(candidates), whole(queries).distinct()
    sample: dict[int, tuple] = {}
    picked = cand.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    dims = picked.column("dim").to_numpy()
    for dim in np.unique(dims):
        part = picked.filter(pa.array(dims == dim))
        x = _matrix(part.column("v"))
        sample[int(dim)] = (part.column("id").to_numpy(), x, x[pivots(x, min(PIVOTS, 1 + len(x) // 8))])
    shared = spark.sparkContext.broadcast(sample)  # SAMPLE vectors at most

    def route(batches, floors: bool):
        """id, v, dim -> the same with the nearest pivot, the distance to it and, for queries, the k-th score over the sample."""
        for batch in batches:
            ids, dim_of = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("id", "dim"))
            lists = batch.column(batch.schema.get_field_index("v"))
            cell, dist, floor = np.full(len(ids), -1, np.int32), np.zeros(len(ids)), np.full(len(ids), -np.inf)
            for dim in np.unique(dim_of):
                known = shared.value.get(int(dim))
                if known is None:  # a length that the sample has not met: one cell without a bound
                    continue
                at = np.flatnonzero(dim_of == dim)
                for i in range(0, len(at), 1024):
                    some = at[i: i + 1024]
                    y = _matrix(lists.take(pa.array(some)))
                    p = known[2]
                    near = ((p * p).sum(axis=1)[None, :] - 2 * (y @ p.T)).argmin(axis=1)
                    cell[some] = near
                    dist[some] = np.sqrt(((y - p[near]) ** 2).sum(axis=1))
                    if floors and len(known[0]) > k:
                        s = y @ known[1].T
                        s[ids[some][:, None] == known[0][None, :]] = -np.inf
                        floor[some] = np.partition(s, -k, axis=1)[:, -k]
            cols = [*(batch.column(batch.schema.get_field_index(c)) for c in ("id", "v", "dim")), pa.array(cell), pa.array(dist)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(floor)] if floors else cols, ["id", "v", "dim", "cell", "dist", *["floor"] * floors])

    schema = "id bigint, v array<double>, dim int, cell int, dist double"
    cand = scratch.save(cand.mapInArrow(lambda b: route(b, False), schema), "candidates")
    quer = scratch.save(quer.mapInArrow(lambda b: route(b, True), schema + ", floor double"), "queries")

    cells = {(r.dim, r.cell): (r.radius, r.n) for r in cand.groupBy("dim", "cell").agg(F.max("dist").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
    cells = spark.sparkContext.broadcast(cells)  # PIVOTS cells of a length at most
    of = quer.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("nq"))
    quer = quer.join(of, ["dim", "cell"]).withColumn("qb", F.pmod(F.xxhash64("id"), F.col("nq")).cast("int")).drop("nq")
    groups = quer.groupBy("dim", F.col("cell").alias("qc"), "qb").agg(F.max("dist").alias("radius"), F.min("floor").alias("worst"))

    def visit(batches):
        """Groups of queries with the cells that their worst k-th score lets them visit, and the blocks of these."""
        for batch in batches:
            out: list[tuple] = []
            for g in batch.to_pylist():
                known = shared.value.get(g["dim"])
                mine = [(c, *v) for (d, c), v in cells.value.items() if d == g["dim"]]
                if known is not None and g["qc"] >= 0:
                    p = known[2]
                    norm = np.sqrt((p * p).sum(axis=1))
                    at = np.array([c for c, _, _ in mine if c >= 0], np.int64)
                    radius = np.array([r for c, r, _ in mine if c >= 0])
                    ok = dict(zip(at.tolist(), reach(p[at] @ p[g["qc"]], g["radius"], norm[g["qc"]], radius, norm[at]) >= g["worst"], strict=True))
                    mine = [m for m in mine if ok.get(m[0], True)]
                out += [(g["dim"], g["qc"], g["qb"], c, -(-n // BLOCK)) for c, _, n in mine]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in (zip(*out, strict=True) if out else [[]] * 5)], ["dim", "qc", "qb", "cell", "blocks"])

    pairs = scratch.save(groups.mapInArrow(visit, "dim int, qc int, qb int, cell int, blocks int"), "pairs")
    keys = ["dim", "qc", "qb", "cell", "cb"]
    left = quer.withColumnRenamed("cell", "qc").join(pairs, ["dim", "qc", "qb"]).withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = cand.drop("dist").join(pairs, ["dim", "cell"]).withColumn("cb", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        (qi, q), (xi, x) = ((t.column("id").to_numpy(), _matrix(t.column("v"))) for t in (left, right))
        order, by = np.argsort(qi, kind="stable"), np.argsort(xi, kind="stable")
        found = Search(q[order], qi[order], x[by], xi[by], k, left.column("floor").to_numpy()[order])
        hit = np.isfinite(found.score)
        return pa.table({"query_id": np.broadcast_to(qi[order][:, None], hit.shape)[hit], "vec_id": found.best[hit],
                         "score": found.score[hit].astype(np.int64)})

    # groups are small in bytes and large in work: a stated count keeps them from being merged into few tasks
    n = pairs.agg(F.coalesce(F.sum("blocks"), F.lit(1))).first()[0]
    tasks = int(min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)))
    left = left.select(*keys, "id", "v", "floor").repartition(tasks, *keys)
    right = right.select(*keys, "id", "v").repartition(tasks, *keys)
    part = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
