"""Deterministic sharded WARC archives.

Records are range-sorted, so the same table gives the same files on every run. Each task writes its
range as files that roll at a compressed size, one gzip member for each record, with headers and digests made
anew from the payload. A file is written under a temporary name of its attempt and renamed when
it is complete; the manifest of the files that belong to the archive is written last, and a reader
takes only what the manifest names. A repeated or lost task therefore leaves nothing half-written in view.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batch_slices

#: Compressed bytes after which a file is closed.
FILE_BYTES = 32 << 20
#: Bytes of payload of a task's range, the ranges at most, and the rows sampled for each to find their ends.
SHARD_BYTES = 64 << 20
MAX_SHARDS = 4096
SAMPLES = 32
#: Payloads of at least so many bytes are stored once; later copies are revisits.
REVISIT_BYTES = 0
_DATE = "2000-01-01T00:00:00Z"  # a fixed date keeps reruns alike
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _store(path: str):
    """File system and path within it, for the schemes that Arrow opens (file, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str) -> str:
    """Id of a record from its page and payload, for pages may share an id."""
    return f"<urn:uuid:{uuid.uuid5(_URN, f'record:{page_id}:{digest}')}>"


def _clean(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def make_record(page_id, url: str | None, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One record: a response with its payload, or a revisit that names the record it repeats."""
    kind = "response" if refers_to is None else "revisit"
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", _DATE), ("X-Page-Id", "null" if page_id is None else str(page_id)),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(size)), ("Content-Type", "text/html; charset=utf-8")]
    if url is not None:
        head.append(("WARC-Target-URI", _clean(url)))
    if refers_to is not None:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))]
    else:
        head.append(("WARC-Block-Digest", f"sha1:{digest}"))
    head.append(("Content-Length", str(len(payload))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + payload + b"\r\n\r\n"


def parse_records(data: bytes):
    """(headers, payload) of each record; Content-Length alone says where a payload ends."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        start, size = end + 4, int(head["Content-Length"])
        yield head, data[start: start + size]
        at = start + size + 4


def payload_key(html):
    """SHA-256 of the payload's bytes; equal payloads are found by it."""
    return F.unhex(F.sha2(F.encode(F.coalesce(html, F.lit("")), "UTF-8"), 256))


def plan_revisits(digests: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, key, size) of all rows -> (page_id, key, refers_to), one row for each pair that is a revisit.

    Of equal payloads of at least ``revisit_bytes`` the row with the largest page_id is the response (several, if that
    id is repeated); the others, null ids among them, refer to it. Where all ids are null, all are responses. Counts are
    combined before the shuffle and joined back, so a group of any number of copies does not meet in one task."""
    rows = digests.where(F.col("size") >= revisit_bytes)
    groups = rows.groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    return rows.join(groups, "key").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "key", "refers_to").distinct()


def _order(page_ids, keys) -> np.ndarray:
    """Byte strings in the archive's order: null ids first, then by id, then by payload key."""
    out = np.empty(len(keys), "S17")
    for i, (page, key) in enumerate(zip(page_ids, keys, strict=True)):
        out[i] = (b"\x01" + bytes(8) if page is None else b"\x02" + (page + 2**63).to_bytes(8, "big")) + key[:8]
    return out


def _cuts(digests: DataFrame, shard_bytes: int) -> np.ndarray:
    """Places at which the ranges of the shards begin, from a sample by hash: the same rows give the same cuts on
    any run. The sample, at most about 2 SAMPLES for each of at most MAX_SHARDS shards, bounds what the driver takes."""
    n, total = digests.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = int(min(MAX_SHARDS, max(1, total // shard_bytes, n // 1_000_000)))
    every = max(1, n // (SAMPLES * shards))
    got = digests.where(F.pmod(F.xxhash64("page_id", "key"), F.lit(every)) == 0).select("page_id", "key").distinct().limit(4 * SAMPLES * MAX_SHARDS).toArrow()
    at = np.sort(_order(got.column("page_id").to_pylist(), got.column("key").to_pylist()))
    return np.unique(at[np.arange(1, shards) * len(at) // shards]) if len(at) else at


def write_archives(df: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write a record for each row of (page_id, url, html) under ``path`` and return the manifest:
    file, records, n_bytes, sha256, one row for each file.

    A null html is an empty payload, a null url has no target header, a null page_id sorts first.
    Rows may share an id: each keeps its own payload. An empty table writes a manifest without rows; other columns are ignored.

    Payloads move once, compressed, to the shard of their range. The decisions on revisits move to the same shard as
    small rows of their own and are sorted just before the records that they are about.
    """
    import pyarrow as pa

    spark = df.sparkSession
    pages = df.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    scratch = Scratch(spark, "warc-plan")
    digests = scratch.save(pages.select("page_id", payload_key(F.col("html")).alias("key"), F.octet_length(F.coalesce("html", F.lit(""))).cast("bigint").alias("size")), "digests")
    cuts = _cuts(digests, shard_bytes)
    revisits = plan_revisits(digests, revisit_bytes)
    schema = "shard int, page_id bigint, key binary, is_record boolean, refers_to bigint, url string, z binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def shards(page_ids, keys):
        return pa.array(np.searchsorted(cuts, _order(page_ids, keys), side="right").astype(np.int32))

    def pack(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for i, j in batch_slices(batch.column("html"), 4 << 20):
                part = batch.slice(i, j - i)
                raw = [(x.as_py() or "").encode() for x in part.column("html")]
                keys = [hashlib.sha256(x).digest() for x in raw]
                yield pa.RecordBatch.from_arrays(
                    [shards(part.column("page_id").to_pylist(), keys), part.column("page_id"), pa.array(keys, pa.binary()), pa.array([True] * len(raw)),
                     pa.nulls(len(raw), pa.int64()), part.column("url"), pa.array([press.compress(x) for x in raw], pa.binary())], names)

    def place(batches):
        for batch in batches:
            page, key, ref = (batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "key", "refers_to"))
            n = len(batch)
            yield pa.RecordBatch.from_arrays([shards(page.to_pylist(), key.to_pylist()), page, key, pa.array([False] * n, pa.bool_()), ref,
                                              pa.nulls(n, pa.string()), pa.nulls(n, pa.binary())], names)

    both = pages.mapInArrow(pack, schema).unionByName(revisits.mapInArrow(place, schema))
    ordered = both.repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("page_id", "key", "is_record", "url")

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        store, base = _store(path)
        store.create_dir(base, recursive=True)
        task, unpress = TaskContext.get(), zstandard.ZstdDecompressor()
        shard, attempt = task.partitionId(), task.taskAttemptId()
        held, size, count, number, out = io.BytesIO(), 0, 0, 0, []
        about, refers = None, None

        def close():
            nonlocal held, size, count, number
            data = held.getvalue()
            name = f"part-{shard:06d}-{number:04d}.warc.gz"
            temporary = f"{base}/.{name}.{attempt}.tmp"
            with store.open_output_stream(temporary) as f:
                f.write(data)
            _replace(store, temporary, f"{base}/{name}")
            out.append((name, count, len(data), hashlib.sha256(data).hexdigest()))
            held, size, count, number = io.BytesIO(), 0, 0, number + 1

        for batch in batches:
            for page, key, is_record, ref, url, z in zip(*(batch.column(batch.schema.get_field_index(c)) for c in names[1:]), strict=True):
                page, key = page.as_py(), key.as_py()
                if not is_record.as_py():
                    about, refers = (page, key), ref.as_py()
                    continue
                ref = refers if about == (page, key) else None
                payload = unpress.decompress(z.as_py())
                raw = make_record(page, url.as_py(), payload if ref is None else b"", payload_digest(payload), len(payload), ref)
                held.write(gzip.compress(raw, compresslevel=6, mtime=0))
                count += 1
                if held.tell() >= file_bytes:
                    close()
        if count:
            close()
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                                         ["file", "records", "n_bytes", "sha256"])

    manifest = ordered.mapInArrow(run, "file string, records bigint, n_bytes bigint, sha256 string")
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    scratch.drop(digests)
    return spark.read.schema(manifest.schema).parquet(f"{path}/manifest")


def _replace(store, temporary: str, name: str) -> None:
    """Rename a finished file. A repeated task finds its predecessor's file, which has the same bytes; some stores do not rename over it."""
    try:
        store.move(temporary, name)
    except OSError:
        store.delete_file(name)
        store.move(temporary, name)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the files that the manifest names: page_id, url, record_type, payload, payload_digest,
    payload_bytes, refers_to.

    Digest and length of a response are computed from the stored payload and must agree with its
    headers; those of a revisit are the ones it was written with.
    """
    import pyarrow as pa

    files = spark.read.schema("file string, records bigint, n_bytes bigint, sha256 string").parquet(f"{path}/manifest")
    # a stated number of tasks: the list is tiny, so adaptive execution would hand all of it to one
    files = files.repartition(max(1, min(MAX_SHARDS, files.count())), "file")
    names = ["page_id", "url", "record_type", "payload", "payload_digest", "payload_bytes", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        store, base = _store(path)
        for batch in batches:
            for name in batch.column(batch.schema.get_field_index("file")).to_pylist():
                rows, size = [], 0
                with store.open_input_file(f"{base}/{name}") as f:
                    for raw in _members(f):
                        for head, payload in parse_records(raw):
                            digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                            n, ref = int(head["X-Payload-Length"]), head.get("X-Refers-To-Page-Id")
                            if head["WARC-Type"] == "response":
                                found = payload_digest(payload)
                                if found != digest or len(payload) != n:
                                    raise ValueError(f"{name}: {head['WARC-Record-ID']} does not match its digest")
                            page = head["X-Page-Id"]
                            rows.append((None if page == "null" else int(page), head.get("WARC-Target-URI"), head["WARC-Type"], payload, digest, n,
                                         None if ref is None else int(ref)))
                            size += len(payload) + 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("file").mapInArrow(
        run, "page_id bigint, url string, record_type string, payload binary, payload_digest string, payload_bytes bigint, refers_to bigint")


def _members(f):
    """The gzip members of an open file, one at a time."""
    left = zlib.decompressobj(31)
    out = []
    pending = f.read(1 << 20)
    while pending:
        out.append(left.decompress(pending))
        if left.eof:
            yield b"".join(out)
            pending, out, left = left.unused_data or f.read(1 << 20), [], zlib.decompressobj(31)
        else:
            pending = f.read(1 << 20)
    if out:
        raise ValueError("a member is cut off")
