"""EDF and BDF recordings as a Spark data source, and 16-bit raw recordings with a fixed frame.

``spark.read.format("edf").load(path)`` gives one row per channel and epoch:
recording_id, ch_idx, channel, epoch_idx, t0_s, sfreq, samples. A partition reads a range of data
records, so a long recording is read by many tasks; only the header is read while planning.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

EPOCH_S = 30.0
SCHEMA = "recording_id string, ch_idx int, channel string, epoch_idx int, t0_s double, sfreq double, samples array<float>"
#: Names of the 10-20 system.
TEN_TWENTY = set("FP1 FP2 F7 F3 FZ F4 F8 T7 C3 CZ C4 T8 P7 P3 PZ P4 P8 O1 O2 T3 T4 T5 T6 A1 A2 M1 M2".split())


def clean_label(label: str) -> str:
    """Channel name without a leading EEG and without what follows a hyphen."""
    return re.sub(r"^EEG\s+", "", label.strip(), flags=re.I).split("-")[0].strip()


def is_bipolar(labels: list[str]) -> list[str]:
    """Up to three labels whose halves are both electrode names."""
    pairs = [x for x in labels if len(p := re.sub(r"^EEG\s+", "", x.strip(), flags=re.I).upper().split("-")) == 2 and all(h.strip() in TEN_TWENTY for h in p)]
    return pairs[:3]


def parse_header(raw: bytes) -> dict:
    """Header fields, with one entry per signal for the signal fields."""
    wide = 3 if raw[:1] == b"\xff" else 2
    text = lambda a, b: raw[a:b].decode("latin-1").strip()
    n = int(text(252, 256))
    at, out = 256, {"bytes": int(text(184, 192)), "records": int(text(236, 244)), "record_s": float(text(244, 252)), "n": n, "width": wide, "start": f"{text(168, 176)} {text(176, 184)}"}
    for name, size in (("label", 16), ("transducer", 80), ("unit", 8), ("pmin", 8), ("pmax", 8), ("dmin", 8), ("dmax", 8), ("filter", 80), ("samples", 8), ("reserved", 32)):
        out[name] = [text(at + i * size, at + (i + 1) * size) for i in range(n)]
        at += n * size
    for name in ("pmin", "pmax", "dmin", "dmax"):
        out[name] = [float(x or 0) for x in out[name]]
    out["samples"] = [int(x) for x in out["samples"]]
    return out


def physical(raw: bytes, head: dict) -> list[np.ndarray]:
    """Samples of each signal, in physical units, over the records in ``raw``."""
    w, per = head["width"], np.array(head["samples"])
    if w == 2:
        flat = np.frombuffer(raw, "<i2").astype(np.float64)
    else:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        flat = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000).astype(np.float64) - 0x800000
    table = flat[: len(flat) // per.sum() * per.sum()].reshape(-1, per.sum())
    cuts = np.concatenate([[0], np.cumsum(per)])
    out = []
    for i in range(head["n"]):
        gain = (head["pmax"][i] - head["pmin"][i]) / ((head["dmax"][i] - head["dmin"][i]) or 1)
        scale = {"V": 1e6, "MV": 1e3}.get(head["unit"][i].upper(), 1.0)
        out.append(((table[:, cuts[i]: cuts[i + 1]].ravel() - head["dmin"][i]) * gain + head["pmin"][i]) * scale)
    return out


def _open(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return store.open_input_file(inner)


class _Records(InputPartition):
    def __init__(self, first: int, stop: int):
        self.first, self.stop = first, stop


class _EdfReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        with _open(self.path) as f:
            start = f.read(256)
            n = int(start[252:256].decode("latin-1"))
            self.head = parse_header(start + f.read(256 * n))
        self.per_epoch = max(1, round(EPOCH_S / self.head["record_s"]))
        self.epochs_per_task = int(options.get("epochsPerTask", "20"))

    def partitions(self):
        step = self.per_epoch * self.epochs_per_task
        return [_Records(i, min(i + step, self.head["records"])) for i in range(0, self.head["records"], step)]

    def read(self, partition):
        head = self.head
        size = sum(head["samples"]) * head["width"]
        with _open(self.path) as f:
            for rec in range(partition.first, partition.stop, self.per_epoch):
                stop = min(rec + self.per_epoch, partition.stop)
                f.seek(head["bytes"] + rec * size)
                for i, x in enumerate(physical(f.read((stop - rec) * size), head)):
                    if head["label"][i].upper().startswith(("EDF ANNOTATIONS", "BDF ANNOTATIONS")):
                        continue
                    yield (self.path, i, clean_label(head["label"][i]), rec // self.per_epoch, rec * head["record_s"],
                           head["samples"][i] / head["record_s"], [float(v) for v in x.astype(np.float32)])


class EdfDataSource(DataSource):
    @classmethod
    def name(cls):
        return "edf"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _EdfReader(self.options)


class _AnnotationReader(_EdfReader):
    """Annotations of the records of a file: onset, duration, text; the records' own times are left out."""

    def read(self, partition):
        head = self.head
        ends = np.cumsum(head["samples"]) * head["width"]
        with _open(self.path) as f:
            f.seek(head["bytes"] + partition.first * int(ends[-1]))
            for _ in range(partition.first, partition.stop):
                record = f.read(int(ends[-1]))
                for i, label in enumerate(head["label"]):
                    if not label.upper().startswith(("EDF ANNOTATIONS", "BDF ANNOTATIONS")):
                        continue
                    for mark in record[int(ends[i - 1]) if i else 0: int(ends[i])].split(b"\0"):
                        when, *texts = mark.split(b"\x14")
                        onset, _, duration = when.partition(b"\x15")
                        for text in texts:
                            if text:
                                yield (self.path, float(onset), float(duration or 0), text.decode("utf-8", "replace"))


class AnnotationDataSource(EdfDataSource):
    @classmethod
    def name(cls):
        return "edf_annotations"

    def schema(self):
        return "recording_id string, onset_s double, duration_s double, label string"

    def reader(self, schema):
        return _AnnotationReader(self.options)


class _RawReader(DataSourceReader):
    """Offset-binary 16-bit frames behind a header of fixed length; each epoch can be sought."""

    def __init__(self, options):
        self.path = options["path"]
        self.start, self.channels = int(options.get("dataStart", str(0x38E3))), int(options.get("channels", "29"))
        self.fs, self.unit = float(options.get("sfreq", "200")), float(options.get("microvoltsPerUnit", "0.09766"))
        with _open(self.path) as f:
            self.frames = max(0, (f.size() - self.start) // (2 * self.channels))

    def partitions(self):
        step = int(EPOCH_S * self.fs) * 20
        return [_Records(i, min(i + step, self.frames)) for i in range(0, self.frames, step)]

    def read(self, partition):
        size = int(EPOCH_S * self.fs)
        with _open(self.path) as f:
            for a in range(partition.first, partition.stop, size):
                b = min(a + size, partition.stop)
                f.seek(self.start + a * 2 * self.channels)
                raw = np.frombuffer(f.read((b - a) * 2 * self.channels), "<u2")
                x = (raw - np.uint16(0x8000)).view(np.int16).reshape(-1, self.channels).T * np.float32(self.unit)
                for i in range(self.channels):
                    yield (self.path, i, f"CH{i + 1}", a // size, a / self.fs, self.fs, [float(v) for v in x[i]])


class RawDataSource(EdfDataSource):
    @classmethod
    def name(cls):
        return "raw16"

    def reader(self, schema):
        return _RawReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(EdfDataSource)
    spark.dataSource.register(AnnotationDataSource)
    spark.dataSource.register(RawDataSource)


def sniff(head: bytes, path: str) -> str:
    """Format of a file from its first bytes, else its name."""
    if head[:4] == b"EEG-" or b"EEG-1" in head[:32]:
        return "raw16"
    if head[:8] == b"0       " or head[:8] == b"\xffBIOSEMI" or re.search(r"\.(edf|bdf)$", path, re.I):
        return "edf"
    raise ValueError(f"not a recording that can be read: {path}")


def anonymise(files):
    """path, content of EDF or BDF files (Spark's binaryFile) with patient, recording, date and time blanked in the header.

    Bytes 8 to 167 become the fixed texts of an unknown patient and recording, 168 to 183 a fixed date and time; all
    else stays byte for byte. A file shorter than a header is left out of the result, so nothing passes unseen."""
    from pyspark.sql import functions as F

    blank = "X X X X".ljust(80) + "Startdate X X X X".ljust(80) + "01.01.8500.00.00"
    content = F.concat(F.substring("content", 1, 8), F.encode(F.lit(blank), "ISO-8859-1"), F.expr("substring(content, 185)"))
    return files.where(F.octet_length("content") >= 256).withColumn("content", content)
