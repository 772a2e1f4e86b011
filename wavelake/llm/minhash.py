"""MinHash near-dedup over word shingles, with the sketch filled by rounds of hashed bin placement.

Round i hashes every element of a set into one of t bins with a value in [i, i + 1); each bin
keeps its least value, and rounds go on until no bin is empty (from round t on, round i fills
bin i - t, so 2 t rounds always do). Equal coordinates then estimate the Jaccard similarity with
the concentration of t independent minima, in time near |set| + t log t.

Bands of two coordinates propose pairs; full shingle sets decide. A pair at similarity 0.75 agrees on
fewer than 18 of 64 bands with probability 4e-6, and two texts that agree on 18 bands share one of
the 47 rarest bands of either. Only those are looked at: bands that lie in a passage of very many
texts stay out of it unless the passage makes up half of a text.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, U, Rolling, carrying, connected_components, mix, pieces, text_bytes, tidy, words

SHINGLE = 5
BINS = 128
BANDS = 64
ROWS = BINS // BANDS
#: Bands that two linked texts agree on at least, and the rarest bands that are therefore enough.
AGREE = 18
RAREST = BANDS - AGREE + 1
#: Orders in which a bucket's first lead is chosen: a group of near copies, alike in most bands, meets about so many leads.
LEADS = 8
CHUNK = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_EMPTY = np.uint64(2**64 - 1)


class Shingles:
    """Distinct 64-bit hashes of the word shingles of each text of a batch, sorted."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.roll = Rolling(1)
        rng = np.random.default_rng(5)
        self.odd = rng.integers(1, 2**62, size + 1, dtype=np.uint64) * U(2) + U(1)

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        n, k = len(offsets) - 1, self.size
        none = np.empty(0, np.uint64)
        if not len(data):
            return [none] * n
        start, end, counts = words(data, offsets)
        if not len(start):
            return [none] * n
        w = self.roll.spans(self.roll.prefix(_LOWER[data]), start, end)
        cuts = np.concatenate([[0], np.cumsum(counts)])
        full = none
        if len(w) >= k:
            full = w[: len(w) - k + 1].copy()
            for j in range(1, k):
                full *= self.odd[k]
                full += w[j: len(w) - k + 1 + j]
            mix(full)
        out = []
        for i in range(n):
            a, b = cuts[i], cuts[i + 1]
            if b - a >= k:
                h = np.sort(full[a: b - k + 1])
                out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
            elif b > a:
                h = w[a:a + 1] * self.odd[b - a]
                for j in range(a + 1, b):
                    h = h * self.odd[k] + w[j]
                out.append(mix(h ^ self.odd[b - a]))
            else:
                out.append(none)
        return out

    def batch(self, column):
        data, offsets = text_bytes(column)
        for i, j in pieces(offsets, CHUNK):
            yield i, j, self.chunk(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` coordinates for each set that is not empty."""
    sizes = np.array([len(s) for s in sets])
    n = len(sets)
    out = np.full((n, bins), _EMPTY)
    flat = out.reshape(-1)
    element, row = np.concatenate(sets) if n else np.empty(0, np.uint64), np.repeat(np.arange(n), sizes)
    low, seeds = U(bins - 1), np.random.default_rng(7).integers(1, 2**63, 2 * bins, dtype=np.uint64)
    for i in range(2 * bins):
        if not len(element):
            break
        h = mix(element ^ seeds[i])
        place = (h & low).astype(np.int64) if i < bins else i - bins
        np.minimum.at(flat, row * bins + place, (h >> U(8)) | U(i << 56))
        open_rows = (out == _EMPTY).any(axis=1)
        keep = open_rows[row]
        if not keep.all():
            element, row = element[keep], row[keep]
    return out


def _bands(sketch: np.ndarray) -> np.ndarray:
    s = sketch.reshape(len(sketch), BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) << U(32), (len(sketch), BANDS)).copy()
    for j in range(ROWS):
        h = mix((h ^ s[:, :, j]) * U(0x9E3779B97F4A7C15) + U(j + 1))
    return h.view(np.int64)


def sketch_documents(df: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, sid (16-byte digest of the shingle set, null if
    empty), bands (one hash for each band) for every row of (doc_id, text)."""
    import pyarrow as pa

    kind = df.schema["doc_id"].dataType.simpleString()
    rows = df.select("doc_id", F.xxhash64("text").alias("th"), "text")

    def run(batches):
        shingles = Shingles()
        for batch in batches:
            for i, j, sets in shingles.batch(batch.column("text")):
                some = [x for x in sets if len(x)]
                bands = iter(_bands(sketches(some)).tolist()) if some else iter(())
                sid = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("th").slice(i, j - i),
                     pa.array([len(x) for x in sets], pa.int64()), pa.array(sid, pa.binary()),
                     pa.array([next(bands) if len(x) else None for x in sets], pa.list_(pa.int64()))],
                    ["doc_id", "th", "n_shingles", "sid", "bands"])

    return rows.mapInArrow(tidy(run), f"doc_id {kind}, th bigint, n_shingles bigint, sid binary, bands array<bigint>")


def _packed(df: DataFrame) -> DataFrame:
    """(doc_id, th, text) -> (doc_id, th, z): the text compressed, to move less of it."""
    import pyarrow as pa

    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = pa.array([press.compress((x.as_py() or "").encode()) for x in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), z], ["doc_id", "th", "z"])

    return df.select("doc_id", "th", "text").mapInArrow(tidy(run), f"doc_id {kind}, th bigint, z binary")


def _verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of set digests whose full sets reach the similarity."""
    import pyarrow as pa

    def run(batches):
        import zstandard

        shingles, unpress = Shingles(), zstandard.ZstdDecompressor()

        def parse(z):
            data = np.frombuffer(unpress.decompress(z), np.uint8)
            return shingles.chunk(data, np.array([0, len(data)]))[0]

        last, known = None, None
        for batch in batches:
            keep = []
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("b", "zb", "za")]
            for key, zb, za in zip(*cols, strict=True):
                if key.as_py() != last:
                    last, known = key.as_py(), parse(zb.as_py())
                x = parse(za.as_py())
                both = len(np.intersect1d(x, known, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(known) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    left = texts.select(F.col("sid").alias("a"), F.col("z").alias("za"))
    right = texts.select(F.col("sid").alias("b"), F.col("z").alias("zb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "za", "zb").mapInArrow(tidy(run), "a binary, b binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """band, sid: the bands of a set that other sets share, among its rarest RAREST."""
    rows = classes.select("h", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    mine = rows.join(shared, "band").groupBy("h").agg(F.sort_array(F.collect_list(F.struct("n", "band"))).alias("of"))
    # bands of no other set are the rarest; a set with RAREST of them has no partner
    left = F.size("of") - (BANDS - RAREST)
    mine = mine.where(left > 0).select("h", F.explode(F.slice("of", F.lit(1), left)).alias("x"))
    return mine.select("h", F.col("x.band").alias("band")).join(classes.select("h", "sid"), "h").select("band", "sid")


def _stars(buckets: DataFrame, lead: DataFrame) -> DataFrame:
    """(a, b): each member of a bucket with the bucket's lead."""
    return buckets.join(lead, "band").where("sid <> lead").select(F.greatest("sid", "lead").alias("a"), F.least("sid", "lead").alias("b"))


def _apart(buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """band, sid, comp of the buckets that hold several components."""
    named = buckets.join(comps, F.col("sid") == F.col("node"), "left").select("band", "sid", F.coalesce("comp", "sid").alias("comp"))
    split = named.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    return named.join(split.select("band"), "band")


def _close_pairs(apart: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets (sid, comp, n) of different components that may reach the similarity: all
    that do, and few others.

    With its shingles in order of rarity, a set of n shares one of its first n - ceil(t n) + 1 with one of the
    first m - ceil(2 t m / (1 + t)) + 1 of any smaller set of m at similarity t; shingles of no other set are
    rarest of all, so a set with many of its own drops out, however many sets resemble it from afar."""
    import pyarrow as pa

    def run(batches):
        import zstandard

        shingles, unpress = Shingles(), zstandard.ZstdDecompressor()
        for batch in batches:
            for sid, z in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("sid", "z")), strict=True):
                data = np.frombuffer(unpress.decompress(z.as_py()), np.uint8)
                x = shingles.chunk(data, np.array([0, len(data)]))[0]
                yield pa.RecordBatch.from_arrays([pa.array([sid.as_py()], pa.binary()).take(pa.array(np.zeros(len(x), np.int64))), pa.array(x.view(np.int64))], ["sid", "w"])

    rows = texts.join(apart.select("sid"), "sid", "left_semi").select("sid", "z").mapInArrow(tidy(run), "sid binary, w bigint")
    shared = rows.groupBy("w").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    of = rows.join(shared, "w").groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("f", "w"))).alias("of"))
    of = of.join(apart, "sid").withColumn("own", F.col("n") - F.size("of"))
    t = percent / 100
    probe, index = (F.col("n") - F.ceil(F.col("n") * F.lit(r) - F.lit(1e-9)) + 1 for r in (t, 2 * t / (1 + t)))
    of = of.select("sid", "comp", "n", "own", index.alias("index"), F.slice("of", F.lit(1), F.greatest(F.lit(0), probe - F.col("own")).cast("int")).alias("of"))
    heads = of.select("sid", "comp", "n", "own", "index", F.posexplode("of").alias("i", "x")).select(
        "sid", "comp", "n", "index", F.col("x.w").alias("w"), (F.col("own") + F.col("i")).alias("at"))
    x, y = heads.alias("x"), heads.where("at < index").alias("y")
    order = (F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.sid") > F.col("y.sid")))
    need = F.lit(t / (1 + t)) * (F.col("x.n") + F.col("y.n")) - F.lit(1e-9)
    room = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    close = (F.col("y.n") >= F.col("x.n") * F.lit(t) - F.lit(1e-9)) & (room >= need)
    pairs = x.join(y, (F.col("x.w") == F.col("y.w")) & (F.col("x.comp") != F.col("y.comp")) & order & close)
    return pairs.select(F.greatest("x.sid", "y.sid").alias("a"), F.least("x.sid", "y.sid").alias("b")).distinct()


def _grouped(df: DataFrame, percent: int) -> DataFrame:
    """doc_id, th, n_shingles, component_id, component_th for every row of (doc_id, text).

    Words are runs of bytes other than space and 0x09-0x0D after lower-casing A-Z; a text's set
    holds its distinct shingles of five words, or the whole sequence if it has fewer. Two texts are
    linked when 100 |A and B| >= percent |A or B| on the full sets (64-bit shingle hashes).
    component_id is the smallest doc_id that links lead to. Texts without words, and null texts,
    have an empty set and are linked with nothing: each is its own component. Texts with equal sets
    are one node from the start, whatever their number, and repeated rows likewise; a null doc_id
    takes part and counts as larger than any other. An empty table gives an empty table.

    In a band's bucket every text is first compared with one of them, then with its text of most links;
    where a bucket then still holds several components, its texts are compared in pairs of different components whose rarest shingles meet. Pairs that
    links already join are never listed, so a bucket of many near copies stays linear.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "minhash")
    found = scratch.save(sketch_documents(df), "sketches")
    rows = found.select("doc_id", "th", "n_shingles", "sid")
    classes = found.where("sid is not null").groupBy("sid").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("rep"),
        F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = scratch.save(classes.select("sid", F.xxhash64("sid").alias("h"), "n", "rep.doc_id", "rep.th", "bands"), "classes")
    buckets = scratch.save(_buckets(classes), "buckets")
    needed = buckets.select("sid").distinct().join(classes.select("sid", "doc_id", "th"), "sid")
    source = df.select("doc_id", F.xxhash64("text").alias("th"), "text")
    texts = _packed(source).alias("t").join(
        needed.alias("k"), F.col("t.th").eqNullSafe(F.col("k.th")) & F.col("t.doc_id").eqNullSafe(F.col("k.doc_id")))
    texts = scratch.save(texts.select("k.sid", "t.z"), "texts")

    # one text of each bucket against the others, first any and then the one of most links
    lead = buckets.groupBy("band").agg(F.max_by("sid", F.xxhash64(F.pmod("band", F.lit(LEADS)), "sid")).alias("lead"))
    stars = scratch.save(_stars(buckets, lead).distinct(), "stars")
    links = scratch.save(_verify(stars, texts, percent), "links")
    both = links.select(F.col("a").alias("sid")).unionByName(links.select(F.col("b").alias("sid"))).groupBy("sid").agg(F.count(F.lit(1)).alias("links"))
    weight = F.struct(F.coalesce("links", F.lit(0)), F.xxhash64("sid"))
    lead = buckets.join(both, "sid", "left").groupBy("band").agg(F.max_by("sid", weight).alias("lead"))
    hubs = scratch.save(_stars(buckets, lead).distinct().join(stars, ["a", "b"], "left_anti"), "hubs")
    tested = stars.unionByName(hubs)
    links = scratch.save(links.unionByName(_verify(hubs, texts, percent)), "links")
    comps = scratch.save(connected_components(links, scratch), "components")

    # what is still apart: the rarest shingles of the sets themselves rule out all but a few pairs
    apart = _apart(buckets, comps).select("sid", "comp").distinct().join(classes.select("sid", "n"), "sid")
    cross = scratch.save(_close_pairs(scratch.save(apart, "apart"), texts, percent), "pairs").join(tested, ["a", "b"], "left_anti")
    more = scratch.save(_verify(cross, texts, percent), "links")
    if not more.isEmpty():
        comps = scratch.save(connected_components(links.unionByName(more), scratch), "components")
    named = rows.join(comps, F.col("sid") == F.col("node"), "left").withColumn("group", F.coalesce("comp", "sid"))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    # stored, so that the join below is no more than a join, which adaptive execution splits where a group is large
    least = scratch.save(named.where("group is not null").groupBy("group").agg(F.min(key).alias("first")), "least")
    out = named.join(least, "group", "left").withColumn("first", F.coalesce("first", key))
    out = out.select("doc_id", "th", "n_shingles", F.col("first.doc_id").alias("component_id"), F.col("first.th").alias("component_th"))
    return scratch.keep_only(out, "groups")


def near_duplicates(df: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of (doc_id, text); see ``_grouped``.

    Repeated rows of the smallest doc_id are all marked kept; ``drop_near_duplicates`` keeps one."""
    out = _grouped(df, percent)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@carrying("doc_id", "text")
def drop_near_duplicates(df: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of df (doc_id, text and any others) without near copies: one row of each component,
    that of the smallest doc_id (and of several texts with that id, one by hash). Texts without words all stay."""
    found = _grouped(df.select("doc_id", "text"), percent)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("th").eqNullSafe(F.col("component_th")))
    keep = keep.groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg((F.count(F.lit(1)) > 1).alias("_again"))
    rows = df.withColumn("_th", F.xxhash64("text"))
    rows = rows.join(keep, F.col("_th").eqNullSafe(F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    again = rows.where("_again").dropDuplicates(["_th", "doc_id"])  # rows that are copies in all but other columns
    return rows.where("not _again").unionByName(again).select(*df.columns)
