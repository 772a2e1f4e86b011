"""Removal of long repeated byte strings from a corpus, by suffix arrays over the places that can repeat.

1. Anchors. Each window of ``width`` bytes names the 80-byte gram of least hash inside it, its
   anchor (a gram has a fifth of the width). Equal windows name equal anchors, so only windows of anchors that occur more than once
   can repeat. Anchors are counted by their hash; the texts themselves do not move for this.
2. Segments. For anchors that occur again, the bytes of all their windows are sent to one place,
   equal segments as one with a count.
3. Suffix arrays. Each task sorts the suffixes of its segments (two stages, see ``suffix``) and
   compares neighbours: windows that share ``width`` bytes repeat.
4. The windows' bytes are cut out of their texts.

An anchor with very many different segments (a passage that a great many texts share, each with
its own surroundings) would fill one task. Its windows are dealt again by a longer common core:
windows whose distance from the anchor falls into the same cell of 64, then 8, then 1 bytes share
all but that many of their bytes, and those bytes become the key.

Runs of words are sought in the same way, with 64-bit hashes of the words as symbols in place of bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, U, Rolling, carrying, mix, pieces, text_bytes, tidy, words
from .suffix import common_prefix_reaches, suffix_array

CHUNK = 1 << 19
#: Texts longer than this are cut into overlapping parts while anchors are sought.
PART = 1 << 20
#: Different segments of one key that a task takes; more are dealt again by a longer core.
CROWD = 256
#: Bytes of segments in one suffix array.
ARRAY_BYTES = 1 << 20
#: Bytes of a hash that stand for a word where repeats are counted in words.
WORD = 8
#: Type of a symbol by its bytes.
SYMBOL = {1: "u1", WORD: "<u8"}


def _at_spaces(data: np.ndarray):
    """Parts of a text of about ``CHUNK`` bytes that end at white space (a longer word stays whole)."""
    at = 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and data[end] not in (9, 10, 11, 12, 13, 32):
            end += 1
        yield data[at:end]
        at = end


def word_codes(column):
    """A binary column with ``WORD`` bytes of a hash in place of each word (run of bytes other than space and 0x09-0x0D)."""
    import pyarrow as pa

    roll = Rolling(12)
    data, offsets = text_bytes(column)
    codes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for i, j in pieces(offsets, CHUNK):
        part, off = data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]
        found = np.zeros(j - i, np.int64)
        for sub, cuts in [(part, off)] if j - i > 1 else ((x, np.array([0, len(x)])) for x in _at_spaces(part)):
            start, end, n = words(sub, cuts)
            codes.append(roll.spans(roll.prefix(sub), start, end))
            found += n
        counts.append(found)
    ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) * WORD
    return pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.concatenate(codes))])


class Anchors:
    """Anchors of windows of ``width`` symbols: bytes, or (``by_words``) codes of words."""

    def __init__(self, width: int, by_words: bool = False):
        self.width, self.roll, self.by_words = width, Rolling(8), by_words
        self.gram = max(1, width // 5)

    def runs(self, data: np.ndarray, offsets: np.ndarray):
        """Runs of windows with one anchor: text index, first window's symbol, windows, anchor hash, anchor's symbol."""
        width, n = self.width, len(data) - self.width + 1
        none = np.empty(0, np.int64)
        if n <= 0:
            return none, none, none, none, none
        h = self._hash(data)
        low = (h & ~U(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        span = width - self.gram + 1
        size = 1
        m = low
        while size * 2 <= span:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if size < span:
            m = np.minimum(m[: len(m) - (span - size)], m[span - size:])
        anchor = (m & U(0xFFFFFF)).astype(np.int64)
        doc = np.repeat(np.arange(len(offsets) - 1), np.maximum(0, np.diff(offsets) - width + 1))
        base = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(np.maximum(0, np.diff(offsets) - width + 1))])[:-1],
                         np.maximum(0, np.diff(offsets) - width + 1))
        start = np.arange(len(doc)) + base
        a = anchor[start]
        first = np.ones(len(start), bool)
        first[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(first)
        count = np.diff(np.append(at, len(start)))
        return doc[at], start[at], count, h[a[at]].view(np.int64), a[at]

    def _hash(self, data):
        p = self.roll.prefix(data)
        i = np.arange(len(data) - self.gram + 1)
        return self.roll.spans(p, i, i + self.gram)

    def batch(self, column):
        """(first row, symbols of the part, place of each text in the part, runs) for the texts of a batch."""
        data, offsets = text_bytes(word_codes(column) if self.by_words else column)
        if self.by_words:
            data, offsets = data.view(SYMBOL[WORD]), offsets // WORD
        for i, j in pieces(offsets, CHUNK):
            part, off = data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]
            if len(part) <= PART:
                yield i, part, off, self.runs(part, off)
            else:
                for k in range(0, len(part) - self.width + 1, PART):
                    x = part[k: k + PART + self.width - 1]
                    yield i, x, np.array([-k]), self.runs(x, np.array([0, len(x)]))


def anchor_counts(df: DataFrame, width: int, across: bool = False, by_words: bool = False) -> DataFrame:
    """doc_id, th, fp, n: how often each text names an anchor (once at most if only other texts matter)."""
    import pyarrow as pa

    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches):
        anchors = Anchors(width, by_words)
        for batch in batches:
            for i, _, _, (doc, _, _, fp, _) in anchors.batch(batch.column("text")):
                if not len(doc):
                    continue
                order = np.lexsort((fp, doc))
                d, f = doc[order], fp[order]
                f = f ^ batch.column("scope").to_numpy()[d + i]
                new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (f[1:] != f[:-1])]))
                rows = pa.array(d[new] + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("th").take(rows), pa.array(f[new]),
                     pa.array(np.minimum(np.diff(np.append(new, len(d))), 1 if across else 2).astype(np.int32))], ["doc_id", "th", "fp", "n"])

    return df.select("doc_id", "th", "scope", "text").mapInArrow(tidy(run), f"doc_id {kind}, th bigint, fp bigint, n int")


def pack_texts(df: DataFrame) -> DataFrame:
    """text -> z, the text's UTF-8 bytes compressed, to move less of it."""
    import pyarrow as pa

    kept = [c for c in df.columns if c != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema.fields), "z binary"])

    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            column = batch.column("text")
            z = pa.array([press.compress((x.as_py() or "").encode()) for x in column], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), z], [*kept, "z"])

    return df.select(*kept, "text").mapInArrow(tidy(run), schema)


def _segments(df: DataFrame, width: int, by_words: bool) -> DataFrame:
    """(doc_id, th, scope, z, fps) -> one row per run of windows of these anchors: key, dig, lead, cnt, pos and, where
    it is the first such in its batch, the bytes."""
    import pyarrow as pa

    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow.compute as pc
        import zstandard

        anchors, unpress, unit = Anchors(width, by_words), zstandard.ZstdDecompressor(), WORD if by_words else 1
        for batch in batches:
            seen: set[tuple[int, bytes]] = set()
            z, fps = (batch.column(batch.schema.get_field_index(c)) for c in ("z", "fps"))
            scopes = batch.column(batch.schema.get_field_index("scope")).to_numpy()
            # the anchors wanted of all rows in one array, each marked with its row
            mark = mix(np.arange(1, len(batch) + 1, dtype=U)).view(np.int64)
            n = pc.list_value_length(fps).to_numpy()
            ends = np.concatenate([[0], np.cumsum(n)])
            wanted = fps.flatten().to_numpy() ^ np.repeat(mark, n)

            def segments(first, texts):
                for i, part, at, (doc, start, cnt, fp, anchor) in anchors.batch(pa.array(texts, pa.binary())):
                    row = doc + (first + i)
                    fp = fp ^ scopes[row]
                    hit = np.flatnonzero(np.isin(fp ^ mark[row], wanted[ends[first]: ends[first + len(texts)]]))
                    raw, segs, digs = part.tobytes(), [], []
                    for key, lo, hi in zip(fp[hit].tolist(), (start[hit] * unit).tolist(), ((start + cnt + (width - 1))[hit] * unit).tolist(), strict=True):
                        seg = raw[lo:hi]
                        dig = hashlib.blake2b(seg, digest_size=16).digest()
                        digs.append(dig)
                        segs.append(None if (key, dig) in seen else seg)
                        seen.add((key, dig))
                    rows = pa.array(row[hit])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(rows), batch.column("th").take(rows), pa.array(fp[hit]), pa.array(digs, pa.binary()),
                         pa.array((anchor - start)[hit].astype(np.int32)), pa.array(cnt[hit].astype(np.int32)), pa.array((start - at[doc])[hit]),
                         pa.array(segs, pa.binary())], ["doc_id", "th", "key", "dig", "lead", "cnt", "pos", "seg"])

            texts, size = [], 0
            for r in range(len(batch)):
                texts.append(unpress.decompress(z[r].as_py()))
                size += len(texts[-1])
                if size >= CHUNK or r == len(batch) - 1:
                    yield from segments(r + 1 - len(texts), texts)
                    texts, size = [], 0

    return df.mapInArrow(tidy(run), f"doc_id {kind}, th bigint, key bigint, dig binary, lead int, cnt int, pos bigint, seg binary")


def repeats_in(segs: list[bytes], counts: np.ndarray, first: np.ndarray, last: np.ndarray, width: int, across: bool, keys: np.ndarray, unit: int = 1):
    """Runs (segment, lo, hi) of the windows that occur more than once among these segments.

    ``first`` and ``last`` are the least and greatest of the places at which a segment occurs;
    windows repeat if the places of all segments that hold them are not one and the same or, unless
    it must be another text (``across``), if there are several such windows. Equal windows of one
    scope are under one key; those under other keys are of other scopes and do not count."""
    sizes = np.array([len(s) // unit for s in segs])
    t = np.frombuffer(b"".join(segs), SYMBOL[unit])
    base = np.cumsum(sizes) - sizes
    own = np.zeros(len(t), bool)
    begin = np.zeros(len(t) + 1, np.int64)
    np.add.at(begin, base, 1)
    np.add.at(begin, base + counts, -1)
    own = np.cumsum(begin[:-1]) > 0
    again = np.zeros(len(t), bool)
    order = suffix_array(t, width)
    order = order[own[order]]
    same = common_prefix_reaches(t, order[:-1], order[1:], width)
    seg = np.searchsorted(base, order, side="right") - 1
    other = keys[seg[1:]] != keys[seg[:-1]]
    if (same & other).any():
        by = np.lexsort((keys[seg], np.cumsum(np.concatenate([[0], ~same]))))
        group = np.cumsum(np.concatenate([[0], ~same]))[by]
        order, seg = order[by], seg[by]
        same, other = group[1:] == group[:-1], keys[seg[1:]] != keys[seg[:-1]]
    head = np.flatnonzero(np.concatenate([[True], ~same | other]))
    least, most = np.minimum.reduceat(first[seg], head), np.maximum.reduceat(last[seg], head)
    size = np.diff(np.append(head, len(order)))
    again[order[np.repeat((least != most) | ((size > 1) & (not across)), size)]] = True
    edge = np.diff(np.concatenate([[0], again.astype(np.int8), [0]]))
    # a run never passes a segment's end: the last width - 1 symbols of a segment start no window
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    which = np.searchsorted(base, lo, side="right") - 1
    return which, lo - base[which], hi - base[which]


def _sort_segments(distinct: DataFrame, width: int, across: bool, unit: int) -> DataFrame:
    """(key, dig, seg, cnt, first, last) -> (key, dig, lo, hi): runs of windows that occur again."""
    import pyarrow as pa

    def run(batches):
        held: list[tuple] = []
        group: list[tuple] = []
        held_size = group_size = 0

        def solve(rows):
            which, lo, hi = repeats_in([r[2] for r in rows], *(np.array([r[k] for r in rows]) for k in (3, 4, 5)), width, across, np.array([r[0] for r in rows]), unit)
            return pa.RecordBatch.from_arrays(
                [pa.array([rows[i][0] for i in which], pa.int64()), pa.array([rows[i][1] for i in which], pa.binary()),
                 pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["key", "dig", "lo", "hi"])

        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "dig", "seg", "cnt", "first", "last")), strict=True):
                if group and row[0] != group[0][0]:
                    held += group
                    held_size += group_size
                    group, group_size = [], 0
                    if held_size >= ARRAY_BYTES:
                        yield solve(held)
                        held, held_size = [], 0
                group.append(row)
                group_size += len(row[2])
        held += group
        if held:
            yield solve(held)

    return (distinct.select("key", "dig", "seg", "cnt", "first", "last").repartition("key").sortWithinPartitions("key")
            .mapInArrow(tidy(run), "key bigint, dig binary, lo int, hi int"))


def _finer(distinct: DataFrame, cell: int, width: int, unit: int) -> DataFrame:
    """Parts of segments whose windows lie in one cell of distances from the anchor, keyed by their common core."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = []
            cols = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "dig", "seg", "lead", "cnt", "first", "last"))
            for key, dig, seg, lead, cnt, least, most in zip(*cols, strict=True):
                j = 0
                while j < cnt:
                    g = (lead - j) // cell
                    last = min(cnt - 1, lead - g * cell)
                    core = seg[(lead - g * cell) * unit: (lead - g * cell - cell + 1 + width) * unit]
                    name = hashlib.blake2b(core, digest_size=8, key=f"{key}:{g}".encode()).digest()
                    part = seg[j * unit: (last + width) * unit]
                    out.append((key, dig, j, int.from_bytes(name, "little", signed=True), hashlib.blake2b(part, digest_size=16).digest(),
                                part, lead - j, last - j + 1, least, most))
                    j = last + 1
            names = ["key", "dig", "shift", "key2", "dig2", "seg", "lead", "cnt", "first", "last"]
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out
                                             else [pa.array([], k) for k in kinds], names)

    return distinct.select("key", "dig", "seg", "lead", "cnt", "first", "last").mapInArrow(
        tidy(run), "key bigint, dig binary, shift int, key2 bigint, dig2 binary, seg binary, lead int, cnt int, first bigint, last bigint")


def _resolve(distinct: DataFrame, cells: tuple[int, ...], width: int, across: bool, unit: int, scratch: Scratch) -> DataFrame:
    """Repeated windows of distinct segments (key, dig, seg, lead, cnt, first, last)."""
    if not cells:
        return _sort_segments(distinct, width, across, unit)
    size = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("segs"), F.min("first").alias("lo"), F.max("last").alias("hi"),
                                       F.min(F.expr("first <> last")).alias("plain"))
    distinct = scratch.save(distinct.join(size.where("segs > 1 or lo <> hi").select("key", "segs", "plain"), "key"), "segments")
    # where each segment of a key occurs again as a whole, all windows do, and nothing is left to sort
    plain = distinct.where("plain").select("key", "dig", F.lit(0).alias("lo"), F.col("cnt").alias("hi"))
    distinct = distinct.where("not plain")
    few = _sort_segments(distinct.where(F.col("segs") <= CROWD), width, across, unit).unionByName(plain)
    crowded = distinct.where(F.col("segs") > CROWD)
    if crowded.isEmpty():
        return few
    parts = scratch.save(_finer(crowded, cells[0], width, unit), "parts")
    below = parts.groupBy(F.col("key2").alias("key"), F.col("dig2").alias("dig")).agg(
        F.max("seg").alias("seg"), F.first("lead").alias("lead"), F.first("cnt").alias("cnt"), F.min("first").alias("first"),
        (F.max("last") + (F.lit(0) if across else F.count(F.lit(1)) - 1)).alias("last"))
    found = _resolve(below, cells[1:], width, across, unit, scratch).select(F.col("key").alias("key2"), F.col("dig").alias("dig2"), "lo", "hi")
    back = parts.select("key", "dig", "shift", "key2", "dig2").join(found, ["key2", "dig2"]).select(
        "key", "dig", (F.col("lo") + F.col("shift")).alias("lo"), (F.col("hi") + F.col("shift")).alias("hi"))
    # saved level by level, so that no plan holds more than one level
    return scratch.save(few.unionByName(back), "found")


def unpack_texts(df: DataFrame) -> DataFrame:
    """z -> text, the reverse of ``pack_texts``."""
    import pyarrow as pa

    kept = [c for c in df.columns if c != "z"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema.fields), "text string"])

    def run(batches):
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            packed = batch.column(batch.schema.get_field_index("z"))
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                texts = pa.array([unpress.decompress(z.as_py()).decode() for z in packed.slice(i, 512)], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), texts], [*kept, "text"])

    return df.select(*kept, "z").mapInArrow(tidy(run), schema)


def repeated_spans(df: DataFrame, width: int, scratch: Scratch, across: bool = False, by_words: bool = False) -> DataFrame:
    """(doc_id, th, spans): for texts with repeated strings, the ranges of bytes (lo, hi) that they cover, unmerged.

    ``df`` has doc_id, th (a hash of the text), text and perhaps scope, a number: strings repeat
    within one scope only. ``across`` asks for another text, not just another place. With ``by_words`` texts are
    read as the codes of their words, and width and ranges count words."""
    if "scope" not in df.columns:
        df = df.withColumn("scope", F.lit(0).cast("bigint"))
    counts = scratch.save(anchor_counts(df, width, across, by_words), "anchors")
    again = counts.groupBy("fp").agg(F.sum("n").alias("n")).where("n > 1").select("fp")
    wanted = counts.join(again, "fp", "left_semi").groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.collect_set("fp").alias("fps"))
    packed = pack_texts(df.select("doc_id", "th", "scope", "text"))
    hits = packed.join(wanted, F.col("th").eqNullSafe(F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")))
    places = scratch.save(_segments(hits.select("doc_id", "th", "scope", "z", "fps"), width, by_words), "places")
    scratch.drop(counts)
    if across:
        place = F.xxhash64("doc_id", "th")
        first, last = F.min(place), F.max(place)
    else:  # any second occurrence will do, also of a repeated row
        first, last = F.lit(0).cast("bigint"), F.count(F.lit(1)) - 1
    distinct = places.groupBy("key", "dig").agg(
        F.max("seg").alias("seg"), F.first("lead").alias("lead"), F.first("cnt").alias("cnt"), first.alias("first"), last.alias("last"))
    cells = sorted({max(1, width * 4 // 25), max(1, width // 50), 1}, reverse=True)
    found = _resolve(distinct, tuple(cells), width, across, WORD if by_words else 1, scratch)
    # a row for each segment that repeats: a segment's own ranges travel together
    found = scratch.save(found.groupBy("key", "dig").agg(F.collect_list(F.struct("lo", "hi")).alias("found")), "ranges")
    spans = places.select("doc_id", "th", "key", "dig", "pos").join(found, ["key", "dig"])
    moved = F.transform("found", lambda f: F.struct((F.col("pos") + f.lo).alias("lo"), (F.col("pos") + f.hi + (width - 1)).alias("hi")))
    return spans.groupBy("doc_id", "th").agg(F.flatten(F.collect_list(moved)).alias("spans"))


def merge_spans(spans: np.ndarray) -> np.ndarray:
    """Sorted maximal ranges of (lo, hi) rows; touching ranges are one."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    top = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > top[:-1]])
    at = np.flatnonzero(new)
    return np.stack([spans[at, 0], top[np.append(at[1:] - 1, len(spans) - 1)]], axis=1)


def _bytes_of_words(text: bytes, spans: np.ndarray) -> np.ndarray:
    """Byte ranges of a text for ranges of its words."""
    start, end, _ = words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    return np.stack([start[spans[:, 0]], end[spans[:, 1] - 1]], axis=1)


def _cut(text: bytes, cut: np.ndarray) -> bytes:
    """What is left of a text outside these merged ranges."""
    ends = [0, *cut[:, 1].tolist()]
    return b"".join(text[a:b] for a, b in zip(ends, [*cut[:, 0].tolist(), len(text)], strict=True))


@carrying("doc_id", "text")
def remove_repeats(df: DataFrame, width: int = 400, as_text: bool = False, words: int | None = None, apart: bool = False) -> DataFrame:
    """Every row of df with n_bytes, n_removed, n_spans and kept (the remaining bytes).

    A byte of a text goes if a string of ``width`` bytes over it also starts at another place, in
    the same text or another; all occurrences go, and strings are judged on the input. With ``words``
    so do runs of that many words that occur at another place, whatever white space is between them and however short they are;
    with ``apart`` these runs go from a further column only, kept_text (what is left without either, as text), and the others tell of the bytes. Texts are
    UTF-8 bytes, a null is empty, matches never cross texts; what is left of a text may end inside
    a character, so it is binary (as text, the bytes of such a character are left out). Rows that are copies of each other repeat each other, with equal
    doc_id or not; null ids take part. An empty table stays empty; df needs doc_id and text, and
    columns of the added names are replaced.
    """
    import pyarrow as pa

    df = df.drop("n_bytes", "n_removed", "n_spans", "kept", "kept_text", "z", "spans", "in_words")

    def spans_of(width, by_words):
        """Saved before any other plan begins; of all that they were made from, the spans alone outlive this."""
        scratch = Scratch(df.sparkSession, "repeats")
        return scratch.keep_only(repeated_spans(texts, width, scratch, by_words=by_words), "spans")

    keyed = df.withColumn("_th", F.xxhash64("text"))
    texts = keyed.select("doc_id", F.col("_th").alias("th"), "text")
    spans = spans_of(width, False).withColumn("in_words", F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>"))
    if words is not None:
        runs = spans_of(words, True).withColumnRenamed("spans", "in_words")
        spans = spans.drop("in_words").unionByName(runs, allowMissingColumns=True).groupBy("doc_id", "th").agg(
            *[F.first(c, ignorenulls=True).alias(c) for c in ("spans", "in_words")])
    spans = spans.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "spans", "in_words")
    rest = [c for c in df.columns if c != "text"]
    packed = pack_texts(keyed.select(*rest, "_th", "text"))
    joined = packed.join(spans, F.col("_th").eqNullSafe(F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left").select(*rest, "z", "spans", "in_words")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema.fields),
                        "n_bytes bigint, n_removed bigint, n_spans bigint", "kept string" if as_text else "kept binary", *["kept_text string"] * apart])

    def run(batches):
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            z, found, found_words = (batch.column(batch.schema.get_field_index(c)) for c in ("z", "spans", "in_words"))
            done, first, size = [], 0, 0

            def flush(upto):
                part = batch.slice(first, upto - first)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary(), *[pa.string()] * apart]
                cols = [pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)]
                return pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in rest), *cols],
                                                  [*rest, "n_bytes", "n_removed", "n_spans", "kept", *["kept_text"] * apart])

            for i in range(len(batch)):
                text = unpress.decompress(z[i].as_py())
                got = [np.stack([v.field(0).to_numpy(), v.field(1).to_numpy()], axis=1) if x.is_valid and len(v := x.values) else None
                       for x in (found[i], found_words[i])]
                if got[1] is not None:
                    got[1] = _bytes_of_words(text, got[1])
                none = np.empty((0, 2), np.int64)
                both = merge_spans(np.concatenate([none, *(x for x in got if x is not None)]))
                cut = merge_spans(none if got[0] is None else got[0]) if apart else both
                left = _cut(text, cut)
                done.append((len(text), len(text) - len(left), len(cut), left.decode("utf-8", "ignore") if as_text else left,
                             *[_cut(text, both).decode("utf-8", "ignore")] * apart))
                size += len(text)
                if size > 4 << 20:
                    yield flush(i + 1)
                    done, first, size = [], i + 1, 0
            if done:
                yield flush(len(batch))

    return joined.mapInArrow(tidy(run), schema)
