"""Licence scans, whitening and hard negatives against plain versions, on small tables with awkward rows."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.llm import licenses, negatives, queries, whitening

NAN, INF = float("nan"), float("inf")


def plain_scan(texts):
    """The licence scan with loops over words, postings and offsets."""
    docs = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    held = [set(d) for d in docs]
    out = []
    for words in docs:
        places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i: i + len(p.split())] == p.split()]
        labels, score = {b for _, b in places}, 1.0 if places else 0.0
        for label, notice, phrases in licenses.TEMPLATES:
            own = notice.split()
            ranked = sorted(set(own), key=lambda w: (sum(w in h for h in held), w))
            k = min(licenses.RARE, len(ranked))
            rare = [w for w in ranked if w in words][:k]
            if len(rare) < k:
                continue
            cells = {}
            for i, w in enumerate(words):
                for p, v in enumerate(own):
                    if v == w and w in rare:
                        cells.setdefault((0, (i - p) // 5 * 5), set()).add(w)
                        cells.setdefault((1, (i - p + 2) // 5 * 5 - 2), set()).add(w)
            for (_, low), got in cells.items():
                if len(got) >= math.ceil(0.8 * k):
                    first = max(low - 2, 0)
                    span = " " + " ".join(words[first: first + len(own) + 9]) + " "
                    ok = all(f" {p} " in span for p in phrases)
                    labels |= {label} if ok else set()
                    score = max(score, len(got) / k * (1 if ok else 0.5))
        at = [i for i, _ in places]
        out.append((len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({b for _, b in places})), ",".join(sorted(labels)), score))
    return out


def test_license_scan_against_plain_loops(spark):
    rng = random.Random(11)
    vocabulary = licenses.vocabulary()
    notices = [t[1] for t in licenses.TEMPLATES]
    texts = [None, "", " \n--", "Under THE Mit, licensE!", "cc by nc cc-by-nc CC BY NC", "apache license version 2 0 " * 3, "É under the mit licenseé", "license", "under the mit license" * 2]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))) for _ in range(40)]
    for n in notices:
        words = n.split()
        texts += [f"x y {n}. tail", n.upper(), " ".join(words[:4] + ["really"] + words[4:]), " ".join(words[:3] + ["a"] * 9 + words[3:]), " ".join(reversed(words)), n.replace("license", "licence")]
    texts += ["word " * 30_000 + notices[1] + " the of" * 20_000, notices[0], notices[0]]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, words string").withColumn("a.b", F.lit(1))
    got = licenses.scan_licenses(df).orderBy("doc_id").collect()
    assert [r[4:] for r in got] == plain_scan(texts) and all(r.words == "kept" and r["a.b"] == 1 for r in got)
    found = {x for r in got for x in r.labels.split(",")}
    assert found >= {t[0] for t in licenses.TEMPLATES}
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    plan = licenses.scan_licenses(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_license_scan_reads_the_words_once_for_all_templates(spark, monkeypatch):
    templates = licenses.TEMPLATES + (("solo", "zeta", ("zeta",)), ("pair", "eta theta", ("eta theta",)), ("twice", "iota kappa iota kappa lambda mu iota", ("kappa lambda",)))
    monkeypatch.setattr(licenses, "TEMPLATES", templates)
    rng = random.Random(12)
    texts = ["this wor\u212a is licensed under the gnu general public license version 2", "\u0130SC permission TO use", "zeta", "eta Theta theta eta", "mu lambda kappa iota"]
    for _, notice, _ in templates:
        own = notice.split()
        for _ in range(12):  # words left out, put in, swapped, at the start, the end and over each other
            words = [w for w in own if rng.random() > 0.12]
            for _ in range(rng.randrange(4)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(own + ["x"]))
            around = [[rng.choice(own + ["y"] * 9) for _ in range(rng.choice((0, 0, 3, 40)))] for _ in range(2)]
            texts.append(" ".join(around[0] + words + around[1]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scanned = licenses.scan_licenses(df, templates=templates)
    assert [r[2:] for r in scanned.orderBy("doc_id").collect()] == plain_scan(texts)
    assert scanned._jdf.queryExecution().executedPlan().toString().count("transform(words#") == 1


def vector_rows(rng, n, dim=6):
    rows = [(i, [float(v) for v in rng.standard_normal(dim) * (i % 5 + 1)], int(i % 4)) for i in range(n)]
    return rows + [(n, None, 1), (n + 1, [], 1), (n + 2, [1.0, NAN] + [0.0] * (dim - 2), 1), (n + 3, [INF] * dim, 2), (n + 4, [1.0, None] + [0.0] * (dim - 2), 2), (n + 5, [1.0, 2.0], 0)]


def test_whitening_against_numpy(spark):
    rows = vector_rows(np.random.default_rng(12), 150)
    rows += [rows[0], (None, rows[1][1], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("component", F.lit("clash"))
    got = whitening.whiten(df, most=4).collect()
    fine = [(i, v) for i, v, _ in rows if v and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([v for _, v in fine])).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    c = x - sums / n
    cov = np.zeros((6, 6))
    for row in c:
        cov += np.outer(row, row)
    e, u = np.linalg.eigh(cov / n)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    u = u * np.where(u[np.abs(u).argmax(axis=0), range(4)] < 0, -1, 1)
    want = {}
    for (i, _), row, whole in zip(fine, c, x, strict=True):
        want.setdefault(i, []).append((int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(whole, sums, strict=True))), row @ u / np.sqrt(e)))
    assert len(got) == 4 * n and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    for r in got:
        assert any(r.deviation == d and abs(r.whitened - w[r.component - 1]) < 1e-8 for d, w in want[r.vec_id])
        assert abs(r.explained - e[r.component - 1] / np.trace(cov / n)) < 1e-12


def test_whitening_of_few_or_equal_or_extreme_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    make = lambda rows: spark.createDataFrame(rows, schema)
    assert whitening.whiten(make([])).count() == 0 and whitening.whiten(make([(1, None)])).count() == 0
    one = whitening.whiten(make([(1, [1.0, 2.0])])).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None), (2, 0, None, None, None)]
    flat = whitening.whiten(make([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)])).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in flat) and flat[0].identity_error < 1e-9
    large = whitening.whiten(make([(1, [1e300]), (2, [1e13]), (3, [-1e13]), (4, [0.0])])).collect()
    assert {r.vec_id for r in large} == {2, 3, 4} and all(r.deviation is None for r in large if r.vec_id != 4)
    with pytest.raises(ValueError):
        whitening.whiten(make([(1, [0.0] * 300)]))


def plain_negatives(rows, positives=5, negatives=10):
    fine = [(i, [math.floor(256 * c) for c in v], z) for i, v, z in rows
            if i is not None and z is not None and v and all(c is not None and math.isfinite(c) for c in v) and sum(math.floor(256 * c) ** 2 for c in v) < 2**53]
    out, done = [], []
    for i, v, z in fine:
        if i % 10 or (i, v, z) in done:
            continue
        done.append((i, v, z))
        score = [(sum(a * b for a, b in zip(v, w, strict=True)), j, y) for j, w, y in fine if len(w) == len(v)]
        first = sorted((-s, j) for s, j, y in score if y == z and j != i)[:positives]
        for p, j in first:
            fit = sorted((-s, k) for s, k, y in score if y != z and 30 * -p <= 100 * s <= 90 * -p)[:negatives]
            out += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_against_plain_loops(spark, monkeypatch, small):
    if small:  # many blocks, buckets and rounds
        for name, value in (("SLICE", 16), ("ANCHORS", 4), ("GROWTH", 2)):
            monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(13)
    rows = vector_rows(rng, 400) + [(None, [1.0] * 6, 1), (1000, [1.0] * 6, None), (1010, [1e290] * 6, 1), (1020, [0.0] * 6, 1), (1030, [1.0, 2.0], 0), (1031, [1.0, 1.0], 0), (1032, [0.5, 0.5], 1)]
    rows += [rows[20], rows[3], rows[3]] + [(2000 + i, rows[7][1], 3) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("norm", F.lit("clash"))
    got = sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()))
    assert got == plain_negatives(rows) and len(got) > 500
    assert negatives.hard_negatives(df.limit(0), F.lit(True)).count() == 0
    text = df.withColumn("label", F.concat(F.lit("é"), F.col("label").cast("string")))
    assert sorted(map(tuple, negatives.hard_negatives(text, F.col("vec_id") % 10 == 0).collect())) == got


def test_norm_buckets_leave_pairs_out():
    rng = np.random.default_rng(1)
    x = rng.integers(-100, 100, (6000, 8)) * rng.choice([1, 10, 100], (6000, 1))
    norm = (x.astype(float) ** 2).sum(axis=1)
    rows = {"id": np.arange(6000), "v": x, "norm": norm, "label": np.zeros(6000, int)}
    q = {k: v[:100] for k, v in rows.items()} | {"low": np.full((100, 1), 1), "high": np.full((100, 1), 1 << 60), "floor": np.full((100, 1), negatives.NONE)}
    got, n_pairs = negatives.search_block(q, rows, 5, True)
    s = x[:100] @ x.T
    s[np.arange(100), np.arange(100)] = -(1 << 40)
    want = np.sort(s, axis=1)[:, ::-1][:, :5]
    assert (got.score[:, 0] == np.where(want >= 1, want, -np.inf)).all() and n_pairs < 0.7 * s.size


def test_sql_of_the_scan_names_every_template():
    assert len({k.split("_")[0] for k in queries.queries()}) == len(queries.queries()) == 13 and set(queries.oracle_sql()) <= set(queries.queries())
    assert all(label in queries.license_sql() for label, _, _ in licenses.TEMPLATES)
