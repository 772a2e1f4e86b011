"""Readers on files made here, tables, and streams run to their end."""

import numpy as np
import pytest

from wavelake.sources import edf, tables
from wavelake.streaming import rates


def make_edf(path, signals, fs, record_s=1.0):
    n, per = len(signals), int(fs * record_s)
    records = len(signals[0]) // per
    pad = lambda x, k: str(x).ljust(k).encode()
    head = pad("0", 8) + pad("", 160) + pad("01.02.24", 8) + pad("03.04.05", 8) + pad(256 * (n + 1), 8) + pad("", 44) + pad(records, 8) + pad(record_s, 8) + pad(n, 4)
    for field, k in ((["EEG C3-REF", "EEG Cz-REF"][:n], 16), ([""] * n, 80), (["uV"] * n, 8), ([-3276.8] * n, 8), ([3276.7] * n, 8), ([-32768] * n, 8), ([32767] * n, 8), ([""] * n, 80), ([per] * n, 8), ([""] * n, 32)):
        head += b"".join(pad(x, k) for x in field)
    body = b"".join(np.round(s[r * per: (r + 1) * per] * 10).astype("<i2").tobytes() for r in range(records) for s in signals)
    path.write_bytes(head + body)


def test_edf_rows(spark, tmp_path):
    rng = np.random.default_rng(0)
    signals = [np.round(rng.standard_normal(7000) * 50, 1) for _ in range(2)]
    make_edf(tmp_path / "a.edf", signals, 100)
    edf.register(spark)
    rows = spark.read.format("edf").option("epochsPerTask", "1").load(str(tmp_path / "a.edf")).collect()
    assert sorted({r.channel for r in rows}) == ["C3", "Cz"] and len(rows) == 6
    for i in range(2):
        got = np.concatenate([r.samples for r in sorted((r for r in rows if r.ch_idx == i), key=lambda r: r.epoch_idx)])
        assert np.allclose(got, signals[i][: len(got)], atol=0.06) and len(got) == 7000
    assert edf.sniff((tmp_path / "a.edf").read_bytes()[:32], "a") == "edf"


def test_raw_rows(spark, tmp_path):
    x = np.arange(-3000, 3000, dtype=np.int16).reshape(-1, 3)
    (tmp_path / "b.eeg").write_bytes(b"h" * 16 + (x.view(np.uint16) + np.uint16(0x8000)).astype("<u2").tobytes())
    edf.register(spark)
    df = spark.read.format("raw16").options(dataStart="16", channels="3", sfreq="50", microvoltsPerUnit="1").load(str(tmp_path / "b.eeg"))
    rows = sorted((r for r in df.collect() if r.ch_idx == 1), key=lambda r: r.epoch_idx)
    assert np.concatenate([r.samples for r in rows]).tolist() == x[:, 1].tolist() and len(rows) == 2


@pytest.mark.parametrize("label, want", [("EEG C3-REF", "C3"), ("Fp1", "Fp1"), (" eeg O1 ", "O1")])
def test_labels(label, want):
    assert edf.clean_label(label) == want


def test_bipolar_names():
    assert edf.is_bipolar(["Fp1-F7", "C3", "EEG T3-C3", "C3-REF"]) == ["Fp1-F7", "EEG T3-C3"]


def test_event_table_round_trip_and_appends(spark, tmp_path):
    rows = [(2.34567, 0.5, "spike", "C3", 1.0, "d", None), (1.0, None, "burst", "Cz", 2.0, "d", "{}")]
    df = spark.createDataFrame(rows, "onset double, duration double, trial_type string, channel string, value double, detector string, attrs string")
    tables.write_events_tsv(df, str(tmp_path / "e"))
    back = tables.read_events_tsv(spark, str(tmp_path / "e")).orderBy("onset").collect()
    assert [r.onset for r in back] == [1.0, 2.346] and back[0].duration is None
    one = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, v string")
    for _ in range(2):
        tables.append_new(one, str(tmp_path / "t"), "id")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    good, bad = tables.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2]


def run_stream(spark, df, name, tmp_path):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{m:02d}:00", 7, float(i)) for i, m in enumerate((1, 5, 20, 59))] + [(9, "2024-01-01 12:00:00", 7, 1.0), (9, "2024-01-01 12:00:00", 7, 1.0)]
    src = spark.createDataFrame(rows, "event_id int, s string, user_id int, value double").selectExpr("event_id", "cast(s as timestamp) as ts", "user_id", "value")
    src.coalesce(1).write.parquet(str(tmp_path / "src"))
    stream = lambda: spark.readStream.schema(src.schema).parquet(str(tmp_path / "src"))
    got = run_stream(spark, rates.windowed_rates(stream()), "w", tmp_path)
    assert sorted(r.n for r in got) == [1, 3]
    assert len(run_stream(spark, rates.distinct_events(stream()), "d", tmp_path)) == 5
    assert [r.n for r in run_stream(spark, rates.sessions(stream()), "s", tmp_path)] == [4]


def test_anonymised_headers(spark, tmp_path):
    from wavelake.sources.edf import anonymise

    raw = b"0       " + b"Jane Doe 01-JAN-2001".ljust(80) + b"Startdate 02-MAR-2019 here".ljust(80) + b"02.03.1911.12.13" + b"256     " + bytes(range(256))
    (tmp_path / "a.edf").write_bytes(raw)
    (tmp_path / "short.edf").write_bytes(b"0       Jane Doe")
    got = anonymise(spark.read.format("binaryFile").load(f"file://{tmp_path}")).collect()
    assert len(got) == 1
    out = bytes(got[0].content)
    assert len(out) == len(raw) and out[:8] == raw[:8] and out[184:] == raw[184:]
    assert b"Jane" not in out and b"2019" not in out and out[168:184] == b"01.01.8500.00.00"


def test_aggregates_of_another_shape_are_refused(spark, tmp_path):
    from wavelake.sources.tables import read_aggregates

    (tmp_path / "a.json").write_text('{"version": 2,\n "cells": [{"n": 5}], "stamp": "x"}')
    needed = {"version": "number", "cells": "array", "stamp": "string"}
    assert read_aggregates(spark, f"file://{tmp_path}/a.json", needed).first().version == 2
    with pytest.raises(ValueError, match="cells, more"):
        read_aggregates(spark, f"file://{tmp_path}/a.json", {"cells": "string", "more": "number"})
