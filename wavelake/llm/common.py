"""Shared helpers: session settings, the shared scratch folder, and Arrow batch access."""

from __future__ import annotations

import ctypes
import uuid
from functools import wraps
from inspect import signature

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.session import shared_dir, ship

#: Bytes of an Arrow batch that a Python worker gets at a time; Spark's own default, 64 MiB, is too much beside a small heap.
ARROW_BYTES = 4 << 20


def ship_package(spark: SparkSession) -> None:
    """Make the package importable on every executor (once per application), and keep Arrow batches small
    where the session does not set their size itself."""
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if size not in spark.conf.getAll:
        spark.conf.set(size, str(ARROW_BYTES))
    ship(spark)


def carrying(*own: str):
    """For an operator DataFrame -> DataFrame: its plan sees only its own columns, named here (or by its arguments of these names). All others
    ride along in one struct, so none can clash with a name used inside; those of names that the operator adds are replaced."""

    def wrap(operator):
        @wraps(operator)
        def run(df: DataFrame, *args, **kwargs) -> DataFrame:
            bound = signature(operator).bind(df, *args, **kwargs)
            bound.apply_defaults()
            mine = [bound.arguments.get(c, c) for c in own]
            extra = [c for c in df.columns if c not in mine]
            if not extra:
                return operator(df, *args, **kwargs)
            core = [c for c in df.columns if c in mine]
            packed = df.select(*core, F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(extra)]).alias("_row"))
            out = operator(packed, *args, **kwargs)
            made = [c for c in out.columns if c != "_row" and c not in core]
            back = [F.col(f"`{c}`") if c in core else F.col("_row").getField(f"c{extra.index(c)}").alias(c) for c in df.columns if (c in extra or c in out.columns) and c not in made]
            return out.select(*back, *made)

        return run

    return wrap


def release() -> None:
    """Give back memory that is free inside this process. Workers outlive their tasks and stand beside those of other
    stages, so what a task's arrays left behind would count against the executor until the worker ends."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: nothing to do
        pass


def tidy(run):
    """A kernel over Arrow batches whose worker gives its free memory back at the end of each task."""

    @wraps(run)
    def kernel(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return kernel


class Scratch:
    """Tables written to the shared folder to cut lineage; each can be dropped once it is not needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.saved: list[DataFrame] = []

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._wavelake_path = path
        self.saved.append(out)
        return out

    def keep_only(self, df: DataFrame, name: str) -> DataFrame:
        """Save a last table and drop all those that it was made from."""
        before, self.saved = self.saved, []
        out = self.save(df, name)
        for old in before:
            self.drop(old)
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_wavelake_path", None)
        if path:
            df._wavelake_path = None
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for every node of the edges (a, b); comp is the smallest node that can be reached.

    Alternates the large-star and small-star steps until the edges are stars. Each step is a
    grouped minimum (combined before its shuffle) joined back on the same key, so a node with very
    many neighbours is a skewed join, which adaptive execution splits.
    """
    cur = scratch.save(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    while True:
        sym = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sym.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        nxt = scratch.save(small, "edges")
        scratch.drop(cur)
        cur = nxt
        # done when each node points at one other that points at none
        again = cur.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        if again.where("n > 1").isEmpty() and cur.join(cur.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
    comp = cur.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return comp.unionByName(comp.select(F.col("comp").alias("node"), "comp").distinct())


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null is an empty text."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0]: offsets[-1]] if len(offsets) else raw[:0], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int):
    """Ranges of rows with about ``limit`` bytes each (a longer text has a range of its own)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def batch_slices(column, limit: int):
    """Ranges of rows of an Arrow string or binary column with about ``limit`` bytes each, so that a worker holds
    what it makes of a batch for one of them at a time."""
    import pyarrow as pa

    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    yield from pieces(offsets - offsets[0], limit)


U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place)."""
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


class Rolling:
    """Polynomial hashes of substrings, modulo 2**64, over random 64-bit codes of the bytes (64-bit symbols are their own codes)."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.code = rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
        self.base = int(rng.integers(2**40, 2**60)) * 8 + 5
        self.inv = pow(self.base, -1, 2**64)
        self._pw = self._ip = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._pw) < n + 1:
            size = max(n + 1, 1 << 16)
            out = []
            for b in (self.base, self.inv):
                x = np.full(size, U(b))
                x[0] = 1
                out.append(np.cumprod(x))
            self._pw, self._ip = out
        return self._pw, self._ip

    def prefix(self, data: np.ndarray) -> np.ndarray:
        pw, _ = self.powers(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((self.code[data] if data.dtype == np.uint8 else data) * pw[: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, ip = self.powers(len(prefix) - 1)
        return mix((prefix[end] - prefix[start]) * ip[start])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word (a run of bytes other than space and 0x09-0x0D), words of each text."""
    gap = _SPACE[data]
    on = np.ones(len(data) + 1, bool)
    on[1:] = gap
    first = offsets[:-1][offsets[:-1] < len(data)]
    on[first] = True
    start = np.flatnonzero(~gap & on[:-1])
    off = np.ones(len(data) + 1, bool)
    off[:-1] = gap
    off[first] = True
    end = np.flatnonzero(~gap & off[1:]) + 1
    counts = np.diff(np.searchsorted(start, offsets))
    return start, end, counts
