"""Annotated recordings and dataset folders: round trips, awkward rows, and tasks that fail."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.sources import edf, writers

SCHEMA = "recording_id string, ch_idx int, channel string, epoch_idx int, t0_s double, sfreq double, samples array<float>"
EVENTS = "recording_id string, onset_s double, duration_s double, label string"


def epochs(rec, channels, fs, seconds, skip=()):
    per = int(round(30 * fs))
    rows, data = [], {}
    for i, c in enumerate(channels):
        rng = np.random.default_rng(i)
        x = (rng.standard_normal(int(seconds * fs)) * 20 * (i + 1)).astype(np.float32) if c != "flat" else np.full(int(seconds * fs), 3, np.float32)
        data[c] = x
        rows += [(rec, 10 * i, c, k // per, float(k / fs), fs, [float(v) for v in x[k: k + per]]) for k in range(0, len(x), per) if k // per not in skip]
    return rows, data


def test_annotated_recordings_round_trip(spark, tmp_path):
    one, data = epochs("/in/a b.edf", ["C3", "flat", "Cz"], 100.0, 75.5)
    two, gap = epochs("r2", ["O1"], 99.6, 100, skip=(1,))
    two[0][6][3], two[0][6][4] = float("nan"), float("inf")
    events = [("/in/a b.edf", 1.0, 0.5, "spike C3"), ("/in/a b.edf", 1.25, -1.0, "HFO"), ("/in/a b.edf", 31.5, float("nan"), None), ("/in/a b.edf", 500.0, 0.0, "late"), ("/in/a b.edf", float("inf"), 0.0, "no"),
              ("/in/a b.edf", None, 0.0, "no"), ("/in/a b.edf", -1.0, 0.0, "no"), ("r2", 2.0, 0.0, "é" * 60), ("none", 1.0, 0.0, "x")] + [("/in/a b.edf", 40.0 + i / 100, 0.0, f"many {i}") for i in range(60)]
    df = spark.createDataFrame(one + two + [("short", 0, "C3", 0, 0.0, 100.0, [1.0] * 50), (None, 0, "C3", 0, 0.0, 100.0, [1.0])], SCHEMA)
    out = str(tmp_path / "out")
    writers.write_annotated(df, spark.createDataFrame(events, EVENTS), out)
    assert sorted(os.listdir(out)) == ["_manifest.json", "a-b.edf", "r2.edf"] and json.load(open(f"{out}/_manifest.json"))["files"] == ["a-b.edf", "r2.edf"]
    edf.register(spark)
    back = spark.read.format("edf").load(f"{out}/a-b.edf").collect()
    assert [c for _, c in sorted({(r.ch_idx, r.channel) for r in back})] == ["C3", "flat", "Cz"] and {r.sfreq for r in back} == {100.0}
    for c, x in data.items():
        got = np.concatenate([r.samples for r in sorted((r for r in back if r.channel == c), key=lambda r: r.epoch_idx)])
        assert len(got) == 7500 and np.abs(got - x[:7500]).max() <= (x.max() - x.min() + 2) / 65535
    marks = sorted((r.onset_s, r.duration_s, r.label) for r in spark.read.format("edf_annotations").option("epochsPerTask", "1").load(f"{out}/a-b.edf").collect())
    assert marks == sorted([(1.0, 0.5, "spike C3"), (1.25, 0.0, "HFO"), (31.5, 0.0, "event")] + [(40.0 + i / 100, 0.0, f"many {i}") for i in range(60)])
    r2 = sorted(spark.read.format("edf").load(f"{out}/r2.edf").collect(), key=lambda r: r.epoch_idx)
    got = np.concatenate([r.samples for r in r2])
    step = np.ptp(np.nan_to_num(gap["O1"])) / 65535
    assert len(got) == 9900 + 100 - len(got) % 100 or len(got) % 100 == 0
    assert np.abs(got[3000:6000]).max() <= step and np.abs(got[:2]).max() > 1 and np.abs(got[3:5]).max() <= step
    assert [r.label for r in spark.read.format("edf_annotations").load(f"{out}/r2.edf").collect()] == ["é" * 40]
    with pytest.raises(Exception, match="not replaced"):
        writers.write_annotated(df, spark.createDataFrame(events, EVENTS), out)
    writers.write_annotated(df.where("recording_id = 'r2'"), spark.createDataFrame([], EVENTS), out, mode="overwrite")
    assert spark.read.format("edf_annotations").load(f"{out}/r2.edf").count() == 0
    assert not any(n.startswith("_staging") for n in os.listdir(out))


def seen(path):
    return [n for n in os.listdir(path) if not n.startswith("_staging-")] if os.path.exists(path) else []


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(writers.NamedFilesDataSource)
    out = str(tmp_path / "out")
    good = spark.createDataFrame([(f"d{i % 3}/f{i}.txt", f"text {i}") for i in range(20)], "path string, content string").repartition(4)
    bad = good.withColumn("path", F.when(F.col("path") == "d1/f7.txt", "../out.txt").otherwise(F.col("path")))
    with pytest.raises(Exception, match="inside the target"):
        bad.write.format("named_files").mode("append").save(out)
    assert seen(out) == []
    with pytest.raises(Exception, match="same file"):
        good.unionByName(good).write.format("named_files").mode("append").save(out)
    assert seen(out) == []
    good.write.format("named_files").mode("append").save(out)
    assert sorted(os.path.relpath(os.path.join(d, f), out) for d, _, fs in os.walk(out) for f in fs) == sorted(["_manifest.json"] + [f"d{i % 3}/f{i}.txt" for i in range(20)])


def test_dataset_folder(spark, tmp_path):
    recs = spark.createDataFrame([("p 1", "v1", "rest", 200.0, 60.0, 50.0, 7, "F"), ("p 1", "v2", None, 100.0, 30.0, 50.0, None, None), ("p2", None, "sleep", 256.0, None, 60.0, 9, "M"), (None, None, None, 1.0, 1.0, None, None, None)],
                                 "subject string, session string, task string, sfreq double, duration_s double, line_hz double, age int, sex string")
    chans = spark.createDataFrame([("p 1", "v1", "C3", "EEG", "good"), ("p 1", "v1", "A\tB", "MISC", None), ("p2", None, "O1", "EEG", "bad")], "subject string, session string, channel string, kind string, status string")
    events = spark.createDataFrame([("p2", None, 9.5, 0.5, "spindle", "O1", 1.5), ("p2", None, 1.25, None, "spike", None, None)], "subject string, session string, onset double, duration double, trial_type string, channel string, value double")
    out = tmp_path / "ds"
    writers.write_dataset(recs, chans, events, str(out))
    names = {os.path.relpath(os.path.join(d, f), out) for d, _, fs in os.walk(out) for f in fs}
    stems = ["sub-p1/ses-v1/eeg/sub-p1_ses-v1_task-rest", "sub-p1/ses-v2/eeg/sub-p1_ses-v2_task-rest", "sub-p2/eeg/sub-p2_task-sleep", "sub-unknown/eeg/sub-unknown_task-rest"]
    assert names == {"_manifest.json", "README", "dataset_description.json", "participants.tsv", *(f"{s}_{k}" for s in stems for k in ("eeg.json", "events.tsv")), f"{stems[0]}_channels.tsv", f"{stems[2]}_channels.tsv"}
    assert (out / "participants.tsv").read_text() == "participant_id\tage\tsex\nsub-p1\t7\tF\nsub-p2\t9\tM\nsub-unknown\tn/a\tn/a\n"
    assert (out / f"{stems[2]}_events.tsv").read_text() == "onset\tduration\ttrial_type\tchannel\tvalue\n1.25\tn/a\tspike\tn/a\tn/a\n9.5\t0.5\tspindle\tO1\t1.5\n"
    assert (out / f"{stems[0]}_channels.tsv").read_text() == "name\ttype\tstatus\nA B\tMISC\tn/a\nC3\tEEG\tgood\n"
    side = json.loads((out / f"{stems[0]}_eeg.json").read_text())
    assert side["SamplingFrequency"] == 200.0 and side["EEGChannelCount"] == 2 and side["PowerLineFrequency"] == 50.0
    assert (out / f"{stems[3]}_events.tsv").read_text().count("\n") == 1
