"""Writers of files that other programs read: annotated recordings and dataset folders, committed as a whole.

Tasks write to a staging folder inside the target; only when all have ended does the driver move the files of the attempts that
succeeded to their names and write a manifest, last. A failed or repeated task leaves nothing visible.
"""

from __future__ import annotations

import json
import math
import posixpath
import time
import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from wavelake.session import ship

MANIFEST = "_manifest.json"


def store_of(path: str):
    """The file system of a path, and the path inside it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)


class StagedWriter(DataSourceArrowWriter):
    """Commit and abort of files that tasks have staged; ``rows`` is what a writer adds."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def rows(self, batches, put) -> None:
        """Write files with put(name) -> binary stream."""
        raise NotImplementedError

    def write(self, iterator) -> Staged:
        from pyspark import TaskContext

        at = TaskContext.get()
        store, root = store_of(self.path)
        folder, out = posixpath.join(root, self.staging, f"{at.partitionId()}-{at.taskAttemptId()}"), Staged()

        def put(name: str):
            parts = name.split("/")
            if not name or name.startswith("/") or ".." in parts or any(p.startswith("_staging-") for p in parts):
                raise ValueError(f"not a name inside the target: {name!r}")
            staged = posixpath.join(folder, name)
            store.create_dir(posixpath.dirname(staged), recursive=True)
            out.files.append((staged, name))
            return store.open_output_stream(staged)

        self.rows(iterator, put)
        return out

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, root = store_of(self.path)
        files = [f for m in messages if m for f in m.files]
        names = [n for _, n in files]
        try:
            if len(set(names)) < len(names):
                raise ValueError("two rows write the same file")
            taken = [n for n, i in zip(names, store.get_file_info([posixpath.join(root, n) for n in names]), strict=True) if i.type != fs.FileType.NotFound]
            if taken and not self.overwrite:
                raise ValueError(f"files that exist are not replaced: {', '.join(sorted(taken)[:3])}")
            for staged, name in files:
                store.create_dir(posixpath.dirname(posixpath.join(root, name)), recursive=True)
                if name in taken:
                    store.delete_file(posixpath.join(root, name))
                store.move(staged, posixpath.join(root, name))
            store.create_dir(root, recursive=True)
            with store.open_output_stream(posixpath.join(root, MANIFEST)) as f:
                f.write(json.dumps({"files": sorted(names)}).encode())
        finally:
            self.abort(messages)

    def abort(self, messages) -> None:
        from pyarrow import fs

        store, root = store_of(self.path)
        for _ in range(20):  # a task that is about to be ended may still write there; what it leaves is hidden from readers
            try:
                if store.get_file_info(posixpath.join(root, self.staging)).type != fs.FileType.Directory:
                    return
                store.delete_dir(posixpath.join(root, self.staging))
            except OSError:
                pass
            time.sleep(0.1)


class _NamedFiles(StagedWriter):
    def rows(self, batches, put):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with put(name) as f:
                    f.write(content.encode() if isinstance(content, str) else content or b"")


class NamedFilesDataSource(DataSource):
    """``df.write.format("named_files")``: a file for each row (path, content), all of them or none."""

    @classmethod
    def name(cls):
        return "named_files"

    def schema(self):
        return "path string, content string"

    def writer(self, schema, overwrite):
        return _NamedFiles(self.options["path"], overwrite)


def limit_text(value: float, up: bool) -> str:
    """A limit in at most eight characters, not inside the range."""
    digits = max(0, min(4, 6 - len(str(int(abs(value))))))
    at = (math.ceil if up else math.floor)(value * 10**digits) / 10**digits
    text = f"{at:.{digits}f}"
    if len(text) > 8:
        raise ValueError(f"a physical limit of {value} does not fit a header")
    return text


class _Annotated(StagedWriter):
    """Rows of prepared epochs, in order of file, epoch and channel, as continuous files of 1 s records with annotations."""

    def rows(self, batches, put):
        out, name, head, held = None, None, None, {}

        def finish_epoch():
            nonlocal held
            if held:
                out.write(self.records(head, held))
                held = {}

        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != name:
                    if out:
                        finish_epoch()
                        out.close()
                    name, head, out = row["file"], row, put(row["file"])
                    out.write(self.header(row))
                elif held and row["epoch"] != held["epoch"]:
                    finish_epoch()
                held.setdefault("epoch", row["epoch"])
                held.setdefault("x", {})[row["place"]] = row["samples"]
                held["marks"] = held.get("marks") or row["marks"]
        if out:
            finish_epoch()
            out.close()

    @staticmethod
    def header(h: dict) -> bytes:
        pad = lambda v, k: str(v)[:k].encode("ascii", "replace").ljust(k)
        n, tal = len(h["channels"]) + 1, h["mark_bytes"]
        out = pad("0", 8) + pad("X X X X", 80) + pad("Startdate X X X X", 80) + pad("01.01.85", 8) + pad("00.00.00", 8) + pad(256 * (n + 1), 8) + pad("EDF+C", 44) + pad(h["n_records"], 8) + pad(1, 8) + pad(n, 4)
        ranges = [(limit_text(c["low"], False), limit_text(c["high"], True)) for c in h["channels"]]
        for values, k in (([c["channel"] for c in h["channels"]] + ["EDF Annotations"], 16), ([""] * n, 80), (["uV"] * (n - 1) + [""], 8), ([r[0] for r in ranges] + ["-1"], 8), ([r[1] for r in ranges] + ["1"], 8),
                          ([-32768] * n, 8), ([32767] * n, 8), ([""] * n, 80), ([h["rate"]] * (n - 1) + [-(-tal // 2)], 8), ([""] * n, 32)):
            out += b"".join(pad(v, k) for v in values)
        return out

    @staticmethod
    def records(h: dict, held: dict) -> bytes:
        rate, first = h["rate"], held["epoch"] * h["per_epoch"]
        n = min(h["per_epoch"], h["n_records"] - first)
        if n <= 0:
            return b""
        table = np.zeros((n, len(h["channels"]), rate), "<i2")
        for i, c in enumerate(h["channels"]):
            x = np.zeros(n * rate)
            got = np.nan_to_num(np.array([np.nan if v is None else v for v in held["x"].get(i) or []], float)[: n * rate], nan=0.0, posinf=0.0, neginf=0.0)
            x[: len(got)] = got
            low, high = float(limit_text(c["low"], False)), float(limit_text(c["high"], True))
            table[:, i] = np.clip(np.round((x - low) / (high - low) * 65535) - 32768, -32768, 32767).reshape(n, rate)
        size = 2 * -(-h["mark_bytes"] // 2)
        marks = {}
        for m in held.get("marks") or []:
            marks.setdefault(m["second"], b"")
            marks[m["second"]] += m["text"].encode()
        return b"".join(table[i].tobytes() + (f"+{first + i}\x14\x14\0".encode() + marks.get(first + i, b"")).ljust(size, b"\0") for i in range(n))


class AnnotatedDataSource(DataSource):
    """Files of rows that ``write_annotated`` prepares."""

    @classmethod
    def name(cls):
        return "annotated_edf"

    def schema(self):
        return "file string"

    def writer(self, schema, overwrite):
        return _Annotated(self.options["path"], overwrite)


def file_name(recording: Column) -> Column:
    """A recording's last path part without suffix, other characters than letters and digits as hyphens."""
    return F.regexp_replace(F.regexp_replace(F.element_at(F.split(recording, "/"), -1), r"\.[A-Za-z0-9]+$", ""), "[^A-Za-z0-9]+", "-")


def write_annotated(epochs: DataFrame, events: DataFrame, path: str, epoch_s: int = 30, mode: str = "append") -> None:
    """K7: every recording of ``epochs`` (recording_id, ch_idx, channel, epoch_idx, sfreq, samples) as an anonymous continuous file of 16-bit samples in 1 s records,
    with the ``events`` (recording_id, onset_s, duration_s, label) that lie in it as annotations.

    A channel's physical range is that of all its samples (1 µV to either side of a flat one), the rate the nearest whole number. Recordings end with the last
    whole second that every channel has. Missing epochs and samples that are not finite are 0. Events without a finite onset inside the recording are left out, a duration
    that is negative or not finite is 0, labels are cut to 40 characters. Recordings of under a second are left out. A recording is one task's
    at a time and an epoch of it is held at a time. Files that exist are replaced with ``mode`` overwrite only.
    """
    spark = epochs.sparkSession
    ship(spark)
    spark.dataSource.register(AnnotatedDataSource)
    sane = F.filter("samples", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = epochs.where("recording_id is not null and epoch_idx >= 0").withColumn("_sane", sane)
    channel = rows.groupBy("recording_id", "ch_idx").agg(
        F.first("channel").alias("channel"), F.min(F.array_min("_sane")).cast("double").alias("low"), F.max(F.array_max("_sane")).cast("double").alias("high"),
        F.max("sfreq").alias("fs"), F.max_by(F.size("samples"), "epoch_idx").alias("last"), F.max("epoch_idx").alias("end"))
    flat = F.coalesce(F.col("high") - F.col("low") < 1e-6, F.lit(True))
    channel = channel.withColumn("low", F.when(flat, F.coalesce("low", F.lit(0.0)) - 1).otherwise(F.col("low"))).withColumn("high", F.when(flat, F.coalesce("high", F.lit(0.0)) + 1).otherwise(F.col("high")))
    rate = F.max(F.round("fs")).cast("int")
    files = channel.groupBy("recording_id").agg(rate.alias("rate"), F.min(F.col("end") * epoch_s + F.expr("last div cast(round(fs) as int)")).cast("int").alias("n_records"),
                                                F.array_sort(F.collect_list(F.struct("ch_idx", "channel", "low", "high"))).alias("channels"))  # a row a channel
    files = files.where("n_records > 0 and rate > 0").withColumn("file", F.concat(file_name(F.col("recording_id")), F.lit(".edf")))

    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    number = lambda c: F.regexp_replace(F.format_string("%.4f", c), r"\.?0+$", "")
    marks = events.select("recording_id", F.col("onset_s").cast("double").alias("onset"), F.when(fine("duration_s") & (F.col("duration_s") > 0), F.col("duration_s")).otherwise(F.lit(0.0)).alias("duration"), "label")
    marks = marks.where(fine("onset") & (F.col("onset") >= 0)).join(files.select("recording_id", "n_records"), "recording_id").where("onset <= n_records")
    text = F.concat(F.lit("+"), number("onset"), F.when(F.col("duration") > 0, F.concat(F.lit("\x15"), number("duration"))).otherwise(F.lit("")), F.lit("\x14"),
                    F.translate(F.substring(F.coalesce("label", F.lit("event")), 1, 40), "\0\x14\x15", "   "), F.lit("\x14\0"))
    marks = marks.select("recording_id", F.least(F.floor("onset"), F.col("n_records") - 1).cast("int").alias("second"), "onset", text.alias("text"))
    room = marks.groupBy("recording_id", "second").agg(F.sum(F.octet_length("text")).alias("b")).groupBy("recording_id").agg(F.max("b").alias("room"))
    files = files.join(room, "recording_id", "left").withColumn("mark_bytes", (F.coalesce("room", F.lit(0)) + 16).cast("int"))
    marks = marks.groupBy("recording_id", F.expr(f"second div {epoch_s}").cast("int").alias("epoch")).agg(F.array_sort(F.collect_list(F.struct("second", "onset", "text"))).alias("marks"))  # an epoch's

    every = files.select("recording_id", F.explode(F.expr(f"sequence(0, (n_records - 1) div {epoch_s})")).alias("epoch"))
    held = rows.select("recording_id", F.col("epoch_idx").alias("epoch"), "ch_idx", "samples")
    held = every.join(held, ["recording_id", "epoch"], "left").join(marks, ["recording_id", "epoch"], "left").join(files.drop("room"), "recording_id")
    place = F.array_position(F.transform("channels", lambda c: c.ch_idx), F.col("ch_idx")) - 1
    out = held.select("file", "epoch", place.cast("int").alias("place"), F.col("samples").cast("array<double>").alias("samples"), "marks", "rate", "n_records", "channels", "mark_bytes", F.lit(epoch_s).alias("per_epoch"))
    out.repartition("file").sortWithinPartitions("file", "epoch", "place").write.format("annotated_edf").mode(mode).save(path)


def dataset_files(recordings: DataFrame, channels: DataFrame, events: DataFrame, name: str = "EEG export") -> DataFrame:
    """K6: path and content of the files of a dataset folder: description, README, participants, and for each recording its sidecar, channels and events.

    ``recordings``: subject, session (or null), task, sfreq, duration_s, line_hz, age, sex; ``channels``: subject, session, channel, kind, status;
    ``events``: subject, session, onset, duration, trial_type, channel, value. Labels keep letters and digits only; missing values are n/a. A subject that
    occurs often is one participant (its first age and sex by order). Events come in order of onset. Nothing that names a person or a date is written."""
    clean = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[^A-Za-z0-9]", "")
    na = lambda c: F.coalesce(F.translate(F.col(c).cast("string"), "\t\n\r", "   "), F.lit("n/a"))
    line = lambda *cols: F.concat_ws("\t", *[na(c) for c in cols])
    sub, ses = F.concat(F.lit("sub-"), F.when(clean("subject") == "", "unknown").otherwise(clean("subject"))), F.when(clean("session") != "", F.concat(F.lit("ses-"), clean("session")))
    folder = F.concat_ws("/", sub, ses, F.lit("eeg"))
    rec = recordings.select("*", sub.alias("sub"), folder.alias("folder"), F.concat_ws("_", sub, ses, F.concat(F.lit("task-"), F.when(clean("task") == "", "rest").otherwise(clean("task")))).alias("stem"))
    rec = rec.groupBy("sub", "folder", "stem").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("task", "sfreq", "duration_s", "line_hz", "age", "sex")])
    path = lambda tail: F.concat(F.col("folder"), F.lit("/"), F.col("stem"), F.lit(tail))
    n = channels.select(folder.alias("folder"), line("channel", "kind", "status").alias("line"), F.lit(1).alias("one"))
    n = n.groupBy("folder").agg(F.concat_ws("\n", F.array_sort(F.collect_list("line"))).alias("lines"), F.sum("one").alias("n_channels"))  # a recording's channels
    marks = events.select(folder.alias("folder"), F.struct(F.col("onset"), line("onset", "duration", "trial_type", "channel", "value").alias("line")).alias("m"))
    marks = marks.groupBy("folder").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list("m")), lambda m: m.line)).alias("lines"))  # a file of a recording's events
    tsv = lambda head: F.concat(F.lit("\t".join(head) + "\n"), F.when(F.coalesce("lines", F.lit("")) != "", F.concat(F.col("lines"), F.lit("\n"))).otherwise(F.lit("")))
    both = rec.join(n.select("folder", "n_channels"), "folder", "left")
    side = F.to_json(F.struct(F.coalesce("task", F.lit("rest")).alias("TaskName"), F.col("sfreq").alias("SamplingFrequency"), F.col("line_hz").alias("PowerLineFrequency"),
                              F.col("duration_s").alias("RecordingDuration"), F.coalesce("n_channels", F.lit(0)).alias("EEGChannelCount"), F.lit("n/a").alias("EEGReference")))
    parts = [both.select(path("_eeg.json").alias("path"), side.alias("content")),
             rec.join(n, "folder").select(path("_channels.tsv").alias("path"), tsv(("name", "type", "status")).alias("content")),
             rec.join(marks, "folder", "left").select(path("_events.tsv").alias("path"), tsv(("onset", "duration", "trial_type", "channel", "value")).alias("content"))]
    people = rec.groupBy("sub").agg(F.min(F.struct("stem", "age", "sex")).alias("p")).select("sub", "p.age", "p.sex")
    people = people.agg(F.concat_ws("\n", F.array_sort(F.collect_list(line("sub", "age", "sex")))).alias("lines"))  # one file, a line a subject
    parts.append(people.select(F.lit("participants.tsv").alias("path"), tsv(("participant_id", "age", "sex")).alias("content")))
    spark = recordings.sparkSession
    fixed = {"dataset_description.json": json.dumps({"Name": name, "BIDSVersion": "1.9.0", "DatasetType": "raw"}, indent=2),
             "README": "Recordings without names, dates of birth or dates of acquisition.\n"}
    out = spark.createDataFrame(list(fixed.items()), "path string, content string")
    for p in parts:
        out = out.unionByName(p)
    return out


def write_dataset(recordings: DataFrame, channels: DataFrame, events: DataFrame, path: str, mode: str = "append", **options) -> None:
    """Write ``dataset_files`` as one commit."""
    spark = recordings.sparkSession
    ship(spark)
    spark.dataSource.register(NamedFilesDataSource)
    dataset_files(recordings, channels, events, **options).write.format("named_files").mode(mode).save(path)

