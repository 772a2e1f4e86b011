"""Operators against plain Python, and their edge cases."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavelake.functions import dsp, text
from wavelake.operators import cohort, detectors, joins, longitudinal, sequences
from wavelake.plans import kernels


def test_runs_partition_the_sequence(spark):
    rng = random.Random(0)
    flags = [rng.random() < 0.5 for _ in range(60)]
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate(flags)], "k int, i long, flag boolean")
    got = sorted((r.start, r.stop, r.flag) for r in sequences.runs(df, ["k"], "i", "flag").collect())
    want, at = [], 0
    for f, g in itertools.groupby(flags):
        n = len(list(g))
        want.append((at, at + n, f))
        at += n
    assert got == want


def test_bridge_fills_only_inner_gaps(spark):
    bits = [0, 1, 0, 0, 1, 0, 0, 0, 1, 0]
    df = spark.createDataFrame([(1, i, bool(b)) for i, b in enumerate(bits)], "k int, i long, flag boolean")
    got = [int(r.bridged) for r in sequences.bridge(df, ["k"], "i", "flag", 2).orderBy("i").collect()]
    assert got == [0, 1, 1, 1, 1, 0, 0, 0, 1, 0]


def test_nearest_within_prefers_the_earlier(spark):
    left = spark.createDataFrame([(1, 0, 10.0), (1, 1, 50.0)], "k int, id int, t double")
    right = spark.createDataFrame([(1, 8.0), (1, 12.0), (1, 56.0)], "k int, u double")
    got = [(r.id, r.u) for r in joins.nearest_within(left, right, ["k"], "t", "u", 5.0, "id").collect()]
    assert got == [(0, 8.0)]


@pytest.mark.parametrize("strict, want", [(False, [0, 1]), (True, [0])])
def test_exists_within_at_the_edge(spark, strict, want):
    left = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.1)], "k int, id int, t double")
    right = spark.createDataFrame([(1, 1.1)], "k int, u double")
    got = joins.exists_within(left, right, ["k"], "t", "u", 1.0, strict=strict)
    assert sorted(r.id for r in got.collect()) == want


def test_before_after_puts_the_pivot_day_after(spark):
    df = spark.createDataFrame([(1, 1, 0, 5.0), (1, 3, 1, 6.0), (1, 3, 2, 7.0), (2, 9, 3, 8.0)], "k int, d int, id int, v double")
    piv = spark.createDataFrame([(1, 3), (2, 3)], "k int, p int")
    got = {r.k: (r.before and r.before.v, r.after and r.after.v) for r in joins.before_after(df, piv, ["k"], "d", "p", "id").collect()}
    assert got == {1: (5.0, 6.0), 2: (None, 8.0)}


@pytest.mark.parametrize("x, want", [(7.5, 50.0), (2.0, 0.0), (99.0, 100.0), (6.5, 10.0), (8.5, 90.0), (None, None)])
def test_percentile_rank_between_anchors(spark, x, want):
    a = [(F.lit(v), p) for v, p in ((4.0, 0.0), (6.5, 10.0), (7.0, 25.0), (7.5, 50.0), (8.0, 75.0), (8.5, 90.0), (12.0, 100.0))]
    assert spark.range(1).select(cohort.percentile_rank(F.lit(x).cast("double"), a).alias("p")).first().p == want
    one = cohort.percentile_rank(F.lit(1.0), [(F.lit(1.0), 0.0), (F.lit(None).cast("double"), 50.0)])
    assert spark.range(1).select(one.alias("p")).first().p is None


def test_spearman_and_permutations(spark):
    rows = [("a", float(x), float(y)) for x, y in zip((20, 16, 12, 8, 4), (10, 20, 35, 55, 80))] + [("b", 1.0, 1.0)] * 5 + [("c", float(i), float(i)) for i in range(8)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    rho = {r.k: r.rho for r in longitudinal.spearman(df, ["k"], "x", "y").collect()}
    assert rho["a"] == pytest.approx(-1) and rho["b"] is None and rho["c"] == pytest.approx(1)
    p = {r.k: r.p for r in longitudinal.permutation_p(df, ["k"], "x", "y").collect()}
    assert p["c"] == pytest.approx(2 / 40320) and p["a"] is None


def test_identifiers_in_text(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.org on 2024-01-02"), (2, "nothing"), (3, None)], "doc_id int, text string")
    got = {r.doc_id: (r.findings, r.clean) for r in text.scan(df, "text").collect()}
    assert got == {1: (["email", "date"], False), 2: ([], True), 3: ([], True)}


def response(sos, f, fs):
    z = np.exp(-2j * np.pi * f / fs)
    return abs(np.prod([np.polyval(s[2::-1], z) / np.polyval(s[:2:-1], z) for s in sos]))


@pytest.mark.parametrize("kind, band", [("low", 10.0), ("high", 10.0), ("band", (8.0, 13.0)), ("band", (0.3, 1.5))])
def test_filter_edges_are_at_minus_three_decibels(kind, band):
    sos = dsp.butter_sos(4, band, 100.0, kind)
    assert all(abs(response(sos, f, 100.0) - np.sqrt(0.5)) < 1e-6 for f in np.atleast_1d(band))


def test_zero_phase():
    t = np.arange(3000) / 100
    x = np.sin(2 * np.pi * 10 * t)
    y = dsp.sosfiltfilt(dsp.butter_sos(4, (8, 13), 100), np.stack([x, np.ones(3000)]))
    assert np.abs(y[0, 500:-500] - x[500:-500]).max() < 1e-5 and np.abs(y[1]).max() < 1e-9


def test_spectrum_keeps_the_power():
    x = np.sin(2 * np.pi * 10 * np.arange(3000) / 100)
    f, p = dsp.welch(x, 100, 400)
    assert f[p[0].argmax()] == 10 and p[0].sum() * f[1] == pytest.approx(0.5)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=40), st.integers(1, 5))
def test_peaks_are_maxima_and_apart(values, distance):
    at = dsp.find_peaks(np.array(values), 1, distance)
    assert all(values[i] >= 1 for i in at) and all(b - a >= distance for a, b in zip(at[:-1], at[1:], strict=True))


def one_trace(spark, x, per_epoch=512):
    return spark.createDataFrame([(1, "C3", i // per_epoch, [float(v) for v in x[i: i + per_epoch]]) for i in range(0, len(x), per_epoch)], "rec long, ch string, epoch long, samples array<double>")


def test_detectors_on_made_signals(spark):
    t = np.arange(int(kernels.FS * 60)) / kernels.FS
    quiet = np.random.default_rng(0).standard_normal(len(t))
    burst = quiet + 40 * np.exp(-((t - 30) ** 2) / 0.3) * np.sin(2 * np.pi * 13 * t)
    fs = kernels.FS
    assert any(abs(r.peak_s - 30) < 0.5 for r in detectors.spindles(one_trace(spark, burst), fs, 512).collect())
    long = quiet + 40 * np.exp(-((t - 30) ** 2) / 12) * np.sin(2 * np.pi * 8 * t)
    assert any(abs((r.start_s + r.end_s) / 2 - 30) < 1 and r.end_s - r.start_s >= 3 for r in detectors.bursts(one_trace(spark, long), fs, 512).collect())
    assert not detectors.bursts(one_trace(spark, burst), fs, 512).collect()
    wave = quiet + 100 * np.sin(2 * np.pi * 0.75 * t)
    assert detectors.slow_waves(one_trace(spark, wave), fs, 512, F.lit(40)).count() > 30 and not detectors.slow_waves(one_trace(spark, quiet), fs, 512, F.lit(40)).count()
    assert kernels.band_rows(quiet + 20 * np.sin(2 * np.pi * 10 * t))[0][5] == 10


def test_entropy_of_noise_is_higher_than_of_a_sine():
    t = np.arange(2000) / kernels.FS
    sine, noise = kernels.entropy_rows(np.sin(2 * np.pi * 5 * t))[0], kernels.entropy_rows(np.random.default_rng(0).standard_normal(2000))[0]
    assert all(a < b for a, b in zip(sine, noise, strict=True))


def test_fast_oscillations_blinks_and_their_filters(spark):
    fs = 1024.0
    t = np.arange(int(fs * 2)) / fs
    quiet = 0.4 * np.random.default_rng(0).standard_normal(len(t))  # its band stays under the floor of 1 µV, which holds where 5 deviations are less
    ripple = quiet + 30 * np.exp(-((t - 1) ** 2) / 0.0006) * np.sin(2 * np.pi * 150 * t)
    got = detectors.fast_oscillations(one_trace(spark, ripple), fs, 512).collect()
    assert len(got) == 1 and got[0].start_s < 1 < got[0].end_s and abs(got[0].peak_hz - 150) < 20
    assert not detectors.fast_oscillations(one_trace(spark, quiet), fs, 512).count() and not detectors.fast_oscillations(one_trace(spark, ripple), 256.0, 512).count()
    h = dsp.fir_band(256, (80, 250), fs)
    gain = lambda f: abs(h @ np.exp(-2j * np.pi * f / fs * np.arange(len(h))))
    assert len(h) % 2 and abs(gain(165) - 1) < 1e-3 and gain(40) < 0.01 and gain(350) < 0.01
    y = dsp.firfiltfilt(h, np.sin(2 * np.pi * 165 * t))
    assert np.abs(y - np.sin(2 * np.pi * 165 * t))[300:-300].max() < 0.01  # no delay
    mains = dsp.sosfiltfilt(dsp.notch_sos(50, 30, fs), np.sin(2 * np.pi * 50 * t) + np.sin(2 * np.pi * 80 * t))[0]
    assert abs(np.std(mains[512:-512]) - np.sqrt(0.5)) < 0.03
    slow = np.arange(int(kernels.FS * 20)) / kernels.FS
    wink = 150 * np.exp(-((slow - 5) ** 2) / 0.03) + 150 * np.exp(-((slow - 12) ** 2) / 0.03)
    assert [round(a) for a, _ in kernels.blink_rows(wink, np.zeros(len(slow)))] == [5, 12]


def test_submission_text_rules(spark):
    from wavelake.functions import text

    rows = {"1999-01-02": "iso_date", "3.4.2001": "numeric_date", "a@b.io": "email", "id 1234567": "long_number", "+49 170 123 4567": "phone", "see C:\\data\\x1": "path",
            "Jane Doe": "name_like", "my child": "narrative", "123-45-6789": "ssn", "A123456789": "insurance_number", "DE12ABCDEFGHIJK1": "iban", "x" * 81: "too_long", "\u0410nna": "foreign_letter"}
    df = spark.createDataFrame([(k,) for k in [*rows, "fine", "[-180,-135)", ""]], "t string")
    got = {r.t: list(r.f) for r in df.select("t", text.submission_findings(F.col("t")).alias("f")).collect()}
    assert all(name in got[k] for k, name in rows.items()) and got["fine"] == got[""] == got["[-180,-135)"] == []
    wide = spark.createDataFrame([("\uff11\uff12\uff13-45-6789",)], "t string")  # full-width digits
    both = wide.select(text.submission_findings(F.col("t")).alias("a"), text.submission_findings(F.col("t"), text.nfkc("t")).alias("b")).first()
    assert "ssn" in both.b and "ssn" not in both.a


def test_block_bootstrap_against_one_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(g, b, float(v)) for g in range(2) for b in range(40) for v in rng.normal(g, 1, 1 + b % 3)] + [(1, 3, None)]
    df = spark.createDataFrame(rows, "g long, b long, v double")
    got = {r.g: r for r in longitudinal.block_bootstrap_ci(df, ["g"], "b", "v", draws=400).collect()}
    seeds = {(r.g, r.b): r.h for r in df.select("g", "b", F.xxhash64("g", "b").alias("h")).distinct().collect()}
    for g in range(2):
        n, s = np.zeros(400), np.zeros(400)
        for b in range(40):
            v = [x for i, j, x in rows if (i, j) == (g, b) and x is not None]
            times = np.random.default_rng([42, seeds[g, b] % 2**64]).poisson(1.0, 400)
            n, s = n + times * len(v), s + times * sum(v)
        own = [x for i, _, x in rows if i == g and x is not None]
        assert abs(got[g].point - np.mean(own)) < 1e-9 and np.allclose([got[g].lo, got[g].hi], np.percentile(s / n, [2.5, 97.5]))
        assert got[g].lo < g < got[g].hi and abs((got[g].hi - got[g].lo) / (2 * 1.96 / np.sqrt(len(own))) - 1) < 0.5


def test_block_bootstrap_of_sums_and_medians_against_one_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(g, b, float(v)) for g in ("a", "b") for b in range(25) for v in rng.normal(0, 1, 1 + b % 4)] + [("a", 3, None), ("a", 4, float("nan")), ("c", 1, 5.0), ("c", 1, 5.0), ("d", 1, -0.0)]
    df = spark.createDataFrame(rows, "g string, b long, v double")
    seeds = {(r.g, r.b): r.h for r in df.select("g", "b", F.xxhash64("g", "b").alias("h")).distinct().collect()}
    for what in ("sum", "median"):
        got = {r.g: r for r in longitudinal.block_bootstrap_ci(df, ["g"], "b", "v", draws=200, aggregate=what).collect()}
        assert got.keys() == {"a", "b", "c", "d"}
        for g in got:
            own = {b: [x for i, j, x in rows if (i, j) == (g, b) and x is not None and x == x] for b in {j for i, j, _ in rows if i == g}}
            times = {b: np.random.default_rng([42, seeds[g, b] % 2**64]).poisson(1.0, 200) for b in own}
            drawn = []
            for d in range(200):
                x = [v for b, vs in own.items() for v in vs for _ in range(times[b][d])]
                if x:
                    drawn.append(np.median(x) if what == "median" else sum(x) / sum(times[b][d] for b in own) * len(own))
            whole = [v for vs in own.values() for v in vs]
            assert abs(got[g].point - (np.median(whole) if what == "median" else sum(whole))) < 1e-9
            assert np.allclose([got[g].lo, got[g].hi], np.percentile(drawn, [2.5, 97.5]), atol=1e-9)
    with pytest.raises(ValueError):
        longitudinal.block_bootstrap_ci(df, ["g"], "b", "v", aggregate="mode")


def test_triangles_against_all_triples(spark):
    from wavelake.operators.graph import triangles

    rng = random.Random(3)
    edges = {tuple(sorted(rng.sample(range(25), 2))) for _ in range(110)} | {(0, j) for j in range(1, 25)}
    want = {}
    for t in itertools.combinations(range(25), 3):
        if all(p in edges for p in itertools.combinations(t, 2)):
            for v in t:
                want[v] = want.get(v, 0) + 1
    assert {r.node: r.triangles for r in triangles(spark.createDataFrame(sorted(edges), "i long, j long")).collect()} == want


def test_nearest_keys_with_gaps_ties_and_nulls(spark):
    from wavelake.operators.joins import nearest_keys

    rng = random.Random(9)
    keys = [1.0, 2.0, 2.5, 40.0, 41.0, 1000.0, -7.0]
    values = [None, float("nan"), 1.5, 2.25, 21.25, 500.5, 1e9, -1e9, 2.0, 2.0, 40.5] + [rng.uniform(-50, 1200) for _ in range(200)] + [3.0] * 50
    df = spark.createDataFrame(list(enumerate(values)), "i int, at double").repartition(3)
    table = spark.createDataFrame([(k, f"n{k}") for k in keys] + [(None, "null"), (float("nan"), "nan")], "age double, norm string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.i: r for r in nearest_keys(df, "at", table, "age").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(values)
    for i, v in enumerate(values):
        want = None if v is None or v != v else min(sorted(keys), key=lambda k: abs(k - v))
        assert got[i].age == want and got[i].norm == (None if want is None else f"n{want}")
    none = nearest_keys(df, "at", table.limit(0), "age").collect()
    assert len(none) == len(values) and all(r.age is None for r in none)
    assert nearest_keys(df.limit(0), "at", table, "age").count() == 0
    assert nearest_keys(df.where("i = 2"), "at", table.unionByName(table), "age").count() == 2


def test_block_bootstrap_keeps_the_draws_of_a_group_in_its_task(spark):
    rng = np.random.default_rng(6)
    rows = [(g, b, float(v)) for g in ("a", "b", "c") for b in range(30 if g != "c" else 2) for v in rng.normal(0, 1, 1 + b % 4)]
    df = spark.createDataFrame(rows, "g string, b long, v double")
    for what in ("mean", "sum", "median"):
        near, far, mixed = (longitudinal.block_bootstrap_ci(df, ["g"], "b", "v", draws=120, aggregate=what, held=h) for h in (1000, 1, 10))
        plan = near._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Join" not in plan and plan.count("Aggregate") == 1, plan  # one row a group, no row a draw
        got, want, both = ({r.g: (r.point, r.lo, r.hi) for r in x.collect()} for x in (near, far, mixed))
        assert got.keys() == want.keys() == both.keys() == {"a", "b", "c"}
        assert all(np.allclose(got[g], want[g], atol=1e-9) and np.allclose(got[g], both[g], atol=1e-9) for g in got)


def test_nearest_keys_reads_no_frame_anew(spark):
    from wavelake.operators.joins import nearest_keys

    df, table = spark.createDataFrame([(1, 1.5)], "i int, at double"), spark.createDataFrame([(1.0,)], "age double")
    assert "unboundedfollowing" not in nearest_keys(df, "at", table, "age")._jdf.queryExecution().toString().lower()


def test_triangles_of_leaves_on_hubs_match_wedges_with_a_small_table(spark):
    from wavelake.operators.graph import triangles

    hubs = range(3)
    edges = [(i, j) for i in hubs for j in hubs if i < j] + [(h, 10 + 7919 * n) for h in hubs for n in range(4000)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4096")
    try:
        found = triangles(spark.createDataFrame(edges, "i long, j long").repartition(2))
        plan = found._jdf.queryExecution().sparkPlan().toString()
        got = {r.node: r.triangles for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin [v" in plan, plan  # not the edges: three can close a wedge
    assert got == {h: 3 * 4000 // 3 * 2 + 1 for h in hubs} | {10 + 7919 * n: 3 for n in range(4000)}


def test_submission_findings_seek_only_what_a_text_can_hold(spark):
    """The same names as every pattern over every text, with fewer passes: patterns of digits stand under one search for a digit."""
    rng = random.Random(5)
    parts = ["1999-01-02", "3.4.2001", "1-2/99", "a@b.io", "@", "1234567", "+49 170 123 4567", "(089) 123 4567", "089 123 456", "C:\\data\\x1", "D:/ab.c", "/usr/x", "\\\\", "Jane Doe", "Jane  Doe's", "mY Child", "PATIENT",
             "named", "unnamed", "Called", "123-45-6789", "A123456789", "DE12ABCDEFGHIJK1", "x" * 81, "\u0410nna", "\u00e9", "\u0661\u0662", "\u017fon", "_", ".", "", "fine", "\n", "my  son", "\U00010400", None]
    texts = [None if None in (row := rng.choices(parts, k=rng.randint(1, 4))) else rng.choice(["", " ", "_", "-", "\n"]).join(row) for _ in range(1500)] + parts
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    plain = [F.when(F.length(c) > text.LONGEST, "too_long"), *[F.when(c.rlike(p), n) for n, p in text.SUBMISSION_PATTERNS.items()], F.when(F.regexp_replace(c, "[A-Za-z]", "").rlike(r"\p{L}"), "foreign_letter")]
    found = df.select("t", text.submission_findings(c).alias("got"), F.array_compact(F.array(*plain)).alias("want"))
    assert found.where("not got <=> want").collect() == [] and found.where("size(got) > 2").count() > 100
    plan = found.select("got")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "[0-9]" in plan


def test_permutation_p_shares_orders_and_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(8)
    rows = [(k, i, float(rng.integers(0, 30)), float(rng.normal())) for k, n in enumerate((8, 9, 10, 10, 70, 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, i int, x double, y double")
    got, other = ({r.k: r.p for r in longitudinal.permutation_p(d, ["k"], "x", "y", draws=2000, order="i").collect()} for d in (df.repartition(7), df.orderBy(F.desc("y")).coalesce(1)))
    assert got == other and got[5] is None
    for k in range(1, 5):
        a, b = (np.array([r[c] for r in rows if r[0] == k]) for c in (2, 3))
        a, b = (np.array([(v < u).sum() + (v == u).sum() / 2 for u in v]) for v in (a, b))
        a, b = a - a.mean(), b - b.mean()
        each = np.abs(np.random.default_rng(0).permuted(np.tile(b, (2000, 1)), axis=1) @ a)
        assert got[k] == ((each >= abs(a @ b) - 1e-12).sum() + 1) / 2001
