"""The pipeline's stages on a small corpus with planted cases."""

import random

import pytest


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(120)
    rows, labels = [], []
    for i in range(300):
        t = text(rng.randrange(40, 120))
        if i % 6 == 0:
            t = " ".join(w.upper() + "!!" for w in t.split())
        labels.append((i, int(i % 6 > 0), 0))
        rows.append((i, t, "en", f"src{i % 4}", len(t)))
    copies = [rows[1][1], rows[2][1] + " tail", rows[3][1]]
    rows += [(400 + i, t, "en", "src1", len(t)) for i, t in enumerate(copies)]
    rows += [(500 + i, f"{text(30)} {passage} {text(30)}", "en", "src2", 0) for i in range(3)]
    rows += [(600, None, None, None, None), (601, "", "en", "src0", 0)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "doc_id % 7 AS size", "lang AS kept", "'x' AS _th").coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    return str(d), passage


def test_stages(spark, corpus, tmp_path):
    import corpus_pipeline as p

    d, passage = corpus
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in p.STAGES:
        out = stage(spark, docs, d)
        if name != "encode":
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    ids = lambda n: {r.doc_id for r in seen[n]}
    shouted = {i for i in range(0, 300, 6)}
    assert not ids("quality") & shouted and len(ids("quality") & set(range(300))) == 250
    assert ids("near_dedup") == ids("quality") - {400, 401, 402}
    assert all(passage not in (r.text or "") for r in seen["passage_dedup"]) and ids("passage_dedup") == ids("near_dedup")
    assert ids("mix") <= ids("near_dedup") and len(seen["encode"]) == len(seen["mix"])
    assert all(r.size == (None if r.doc_id is None else r.doc_id % 7) and r.kept == r.lang and r._th == "x" for r in seen["mix"])
    assert p.run(spark, d).count() == len(seen["encode"])


def test_short_words_repeat_too(spark):
    import corpus_pipeline as p

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqé") for _ in range(rng.randrange(2, 5)))
    text = lambda n: [word() for _ in range(n)]
    rows, want = [], {}
    for n in (50, *range(51, 61)):
        passage = text(n)
        for k in range(2):
            head, tail = text(30), text(30)
            i = 2 * n + k
            rows.append((i, "  ".join([*head, *passage]) + "\n" + " ".join(tail) if k else " ".join([*head, *passage, *tail])))
            want[i] = head + (passage if n == 50 else []) + tail
            assert len(" ".join(passage).encode()) < 400
    rows.append((None, None))
    got = p.passage_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert {r.doc_id: r.text.split() for r in got} == want | {None: []}
