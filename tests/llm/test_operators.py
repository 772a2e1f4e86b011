"""Sharding, search, archives, pages, mixing, tokens and quality on small tables with awkward rows."""

import base64
import collections
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from wavelake.llm import quality, sharding, topk
from wavelake.llm.html_text import blocks_of, extract_text
from wavelake.llm.mixing import mix_sources, training_order
from wavelake.llm.queries import model_path
from wavelake.llm.sentencepiece_codec import ChunkTable, decode_ids, encode_documents, ids_array
from wavelake.llm.warc import read_archives, write_archives


def test_every_shard_fits_and_splits_only_when_it_must(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randrange(400)) for i in range(600)] + [(None, "n"), (7, None), (8, ""), (9, "y" * 5000)] + [(11, "same" * 50)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign_shards(df, 2000).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for r in got:
        size[r.shard] += r.n_bytes
    assert all(size[r.shard] == r.shard_bytes for r in got)
    assert [r.doc_id for r in got if r.oversized] == [9]
    hashes = collections.Counter()
    for r in got:
        hashes[r.shard.split(".")[0][:-1]] += 0
    whole = collections.Counter()
    for r in got:
        bits = r.shard.split(".")[0]
        for d in range(len(bits)):
            whole[bits[:d]] += r.n_bytes
    assert all(whole[r.shard.split(".")[0][:-1]] > 2000 for r in got if r.depth)
    assert sharding.assign_shards(df.limit(0), 2000).count() == 0


def test_alike_rows_stay_when_branches_of_the_plan_are_partitioned_differently(spark):
    rows = [(g, "same" * 50 + str(g), str(g) * 2000) for g in range(40) for _ in range(30)]
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
            "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string, extra string")
        got = sharding.assign_shards(df, 2000).collect()
        sizes = collections.Counter()
        for r in got:
            sizes[r.shard] += r.n_bytes
        assert collections.Counter((r.doc_id, r.text, r.extra) for r in got) == collections.Counter(rows)
        assert all(sizes[r.shard] == r.shard_bytes <= 2000 and not r.oversized for r in got)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_written_shards_hold_all_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, "t" * i) for i in range(100)], "doc_id long, text string")
    out = sharding.write_shards(df, str(tmp_path / "s"), 900)
    assert out.agg(F.sum("n_rows")).first()[0] == 100 and out.agg(F.max("n_bytes")).first()[0] <= 900


def brute_top(rows, k):
    v = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in e] for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)}
    out = []
    for q in v:
        if q % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q and len(v[c]) == len(v[q]))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(8) * (1 + i % 3)]) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(30)] + [(500, None), (510, []), (520, [float("inf")] * 8), (530, [None] * 8), (None, rows[1][1]), (540, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(df.where("vec_id % 10 = 0"), df, 10).collect())
    assert got == brute_top(rows, 10)
    assert topk.top_k(df.limit(0), df, 10).count() == 0


def test_two_trees_leave_pairs_out_where_data_cluster():
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((10, 16)) * 50
    x = np.floor(np.concatenate([c + rng.standard_normal((100, 16)) for c in centre]) * 16)
    ids = np.arange(len(x))
    s = topk.Search(x[::20], ids[::20], x, ids, 5)
    full = x[::20] @ x.T
    full[np.arange(50), ids[::20]] = -np.inf
    want = np.lexsort((np.broadcast_to(ids, full.shape), -full), axis=1)[:, :5]
    assert (s.best == want).all() and s.pairs < 0.5 * full.size


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "u", "same é"), (2, "u", "same é"), (2, None, "same é"), (3, "a b", None), (4, "u", ""), (None, "u", "same é"), (5, "ü", "x" * 50_000)]
    path = f"file://{tmp_path}/w"
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = write_archives(df, path, file_bytes=400).collect()
    assert sum(m.records for m in manifest) == len(rows) and len(manifest) > 1
    for m in manifest:
        assert hashlib.sha256((tmp_path / "w" / m.file).read_bytes()).hexdigest() == m.sha256
    got = {(r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in read_archives(spark, path).collect()}
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = {(1, "revisit", 7, digest("same é"), 2), (2, "response", 7, digest("same é"), None), (3, "revisit", 0, digest(""), 4), (4, "response", 0, digest(""), None),
            (None, "revisit", 7, digest("same é"), 2), (5, "response", 50_000, digest("x" * 50_000), None)}
    assert got == want
    again = f"file://{tmp_path}/v"
    assert {m.sha256 for m in write_archives(df.orderBy(F.rand()), again, file_bytes=400).collect()} == {m.sha256 for m in manifest}
    assert write_archives(df.limit(0), f"file://{tmp_path}/e").count() == 0 and read_archives(spark, f"file://{tmp_path}/e").count() == 0


def test_archive_of_null_ids_and_of_columns_of_its_own_names(spark, tmp_path):
    rows = [(None, "u", "a", 1), (None, "v", "a", 2), (None, "w", "b", 3)]
    write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, key int").withColumn("shard", F.lit(7)), f"file://{tmp_path}/n")
    got = sorted((r.url, r.record_type, bytes(r.payload), r.refers_to or 0) for r in read_archives(spark, f"file://{tmp_path}/n").collect())
    assert got == [("u", "response", b"a", 0), ("v", "response", b"a", 0), ("w", "response", b"b", 0)]


def test_archive_keeps_each_payload_of_a_repeated_id(spark, tmp_path):
    rows = [(1, "u", "shared"), (1, "u", "only here"), (2, "u", "shared"), (3, "u", "other"), (3, "v", "shared too"), (4, "v", "shared too")]
    write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    got = sorted((r.page_id, r.record_type, bytes(r.payload).decode(), r.refers_to or 0) for r in read_archives(spark, f"file://{tmp_path}/w").collect())
    assert got == [(1, "response", "only here", 0), (1, "revisit", "", 2), (2, "response", "shared", 0), (3, "response", "other", 0), (3, "revisit", "", 4), (4, "response", "shared too", 0)]


def test_blocks_of_pages():
    main = lambda h: [t for k, t in blocks_of(h) if k == "main"]
    assert main("<nav>m</nav><article><header><h1>T</h1></header><p>a &amp;amp; b<br>c  d<div class='ad'>x</div>e<aside>q</aside><footer>f</footer></article><footer>z</footer>") == ["T", "a &amp; b", "c d", "e"]
    assert main("<article><p>x<section id=comments><article>reader</article></section><form>f</form><script>'</p>'</script>y</article>") == ["x", "y"]
    assert main("<body class='has-sidebar'><main>k<div hidden>n</div></main>") == ["k"]
    assert main("<nav>open <article>1 &lt; 2 < 3</article>") == ["1 < 2 < 3"]
    assert blocks_of(None) == [] and blocks_of("") == []


def test_made_pages_give_back_their_articles(spark):
    """Pages are made from known articles and known surroundings; the articles must come back, whole and in order."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgéß") for _ in range(rng.randrange(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    around = ["<nav><ul><li><a href='/x'>{}</a></li></ul></nav>", "<div class='ad'>{}</div>", "<aside>{}</aside>", "<div id='cookie-notice'>{}</div>", "<form>{}<input></form>",
              "<script>var a = '<p>{}</p>';</script>", "<style>p{{}} /* {} */</style>", "<!-- {} -->", "<div class=\"sidebar\">{}</div>", "<header>{}</header>", "<footer>&copy; {}</footer>"]
    inside = ["<div class='share'>{}</div>", "<section class='comments'><p>{}</p></section>", "<script>{}</script>", "<aside>{}</aside>", "<!-- {} -->"]
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace("é", "&eacute;").replace("ß", "&#223;")
    rows, want = [], {}
    for i in range(60):
        blocks = [line(rng.randrange(1, 30)) + rng.choice(["", " & more", " a < b", "."]) for _ in range(rng.randrange(0, 8))]
        parts = []
        for b in blocks:
            if rng.random() < 0.3:
                parts.append(rng.choice(inside).format(line(5)))
            html = escape(b).replace(" ", rng.choice([" ", "\n  ", " <b>", "\t"]), 1)
            parts.append(f"<{'p' if '<b>' not in html else 'p'}>{html}{'</b>' if '<b>' in html else ''}</p>")
        before, after = ("".join(rng.choice(around).format(line(6)) for _ in range(3)) for _ in range(2))
        rows.append((i, f"https://h{i % 4}.example.org/{i}", f"<!DOCTYPE html><html><head><title>{line(3)}</title></head><body>{before}<article>{''.join(parts)}</article>{after}</body></html>"))
        want[i] = "\n".join(blocks)
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_text_without_a_marked_article_loses_what_pages_of_its_host_share(spark):
    nav = "<div><ul><li>Home page link</li><li>About our company</li><li>Contact the people here</li></ul></div>"
    page = lambda i: f"{nav}<div><p>Unique text {i} with words w{i * 7} and more {i * 13}.</p></div><p>All rights reserved by the company of this host, two thousand.</p>"
    rows = [(i, f"http://a.com/{i}", page(i)) for i in range(6)] + [(9, "http://a.com/1", page(1)), (10, None, None), (11, "http://b.com", page(3)), (12, "x", "<article>A</article>")]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in (*range(6), 9):
        k = 1 if i == 9 else i
        assert got[i] == f"Unique text {k} with words w{k * 7} and more {k * 13}."
    assert got[10] == "" and got[12] == "A" and "Home page link" in got[11]


def test_article_tags_without_an_article_leave_the_shared_strings_to_the_suffix_array(spark):
    footer = "<p>All rights reserved by the company of this host, two thousand and more.</p>"
    decoys = ["<!-- <article> -->", "<script>'<main>'</script>", "<article class='comment'><p>reader {i}</p></article>", "<article></article>"]
    rows = [(10 * k + i, f"http://h{k}.com/{i}", f"<div><p>Unique text {i} with words w{i * 7}.</p></div>{decoy.replace('{i}', str(i))}{footer}") for k, decoy in enumerate(decoys) for i in range(4)]
    rows += [(99, "http://h0.com/z", f"<article><p>Whole</p></article>{footer}"), (98, None, None), (97, "http://h0.com/e", "")]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {10 * k + i: f"Unique text {i} with words w{i * 7}." for k in range(4) for i in range(4)} | {99: "Whole", 98: "", 97: ""}


def test_every_page_meets_what_its_host_shares(spark):
    """n_shared against brute force; what footers and adverts have in common with an article takes nothing from it."""
    rng = random.Random(4)
    pool = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9))) for _ in range(12)) for _ in range(8)]
    hosts = {h: rng.choice(pool) for h in "abc"}
    rows, streams, want = [], {}, {}
    for i in range(60):
        h = rng.choice("abc")
        ad, footer = rng.choice([*pool, f"only on {i}"]), f"© {hosts[h]}" if i % 4 else ""
        blocks = [rng.choice(pool), f"Words of article {i}.", rng.choice(pool)]
        html = f"<body><div class='ad'>{ad}</div><article><h1>{blocks[0]}</h1><p>{blocks[1]}</p><p>{blocks[2]}</p></article><footer>{footer}</footer></body>"
        rows.append((i, f"http://{h}/{i}", html if i else "<article><p>Alone</p></article>"))
        streams[i] = (h, "\n".join(x for x in (ad, footer) if x).encode() if i else b"")
        want[i] = "\n".join(blocks) if i else "Alone"
    rows += [(60, rows[5][1], rows[5][2]), (61, None, None)]
    streams |= {60: streams[5], 61: ("", b"")}
    want |= {60: want[5], 61: ""}
    shared = {}
    for i, (h, x) in streams.items():
        others = {y[k: k + 48] for g, y in streams.values() if g == h and y != x for k in range(len(y) - 47)}
        shared[i] = len({j for k in range(len(x) - 47) if x[k: k + 48] in others for j in range(k, k + 48)})
    got = {r.page_id: (r.text, r.n_shared) for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: (want[i], shared[i]) for i in want} and sum(n > 0 for n in shared.values()) > 40
    empty = extract_text(spark.createDataFrame([], "page_id long, url string, html string"))
    assert empty.columns == ["page_id", "url", "text", "n_shared"] and empty.count() == 0


def water(sizes, weights, total):
    target, open_ = {s: 0.0 for s in sizes}, set(sizes)
    while open_:
        left = total - sum(target[s] for s in sizes if s not in open_)
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level > 2 * sizes[s]}
        if not full:
            for s in open_:
                target[s] = weights[s] * level
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
        open_ -= full
    return target


def test_mix_follows_the_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(60)), f"s{min(rng.randrange(14), 9)}") for i in range(900)]
    rows += [(1000, "a b c", None), (1001, None, "s0"), (1002, "", "empty"), (1003, "a b", "s1"), (1003, "a b", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(df).collect()
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    size = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in names}
    want = water(size, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(size.values()))
    taken = collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in names)
    order = training_order(mix_sources(df)).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    again = {(r.doc_id, r.taken) for r in mix_sources(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    assert mix_sources(df.limit(0)).count() == 0


def test_positions_invert_the_integral_of_the_schedule(spark):
    rows = [(i if i % 5 else None, " ".join(["w"] * (1 + i % 7)) + f" {i}", f"s{i % 3}", i) for i in range(300)] + [(7, "x y", "s0", -1)] * 60
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _h int")
    got = [r for r in mix_sources(df).collect() if r.taken]
    targets = {r.source: r.target for r in got}
    slope = {s: (-0.5, 0.0, 0.5)[i % 3] for i, s in enumerate(sorted(targets))}
    u = np.linspace(0, 1, 200_001)
    rate = {s: targets[s] * ((1 - k) + 2 * k * u) for s, k in slope.items()}  # words a source asks for at each time
    whole = sum(rate.values())
    clock = np.concatenate([[0], np.cumsum((whole[1:] + whole[:-1]) / 2 * np.diff(u))])
    for s in targets:
        own = np.concatenate([[0], np.cumsum((rate[s][1:] + rate[s][:-1]) / 2 * np.diff(u))])
        at, due = 0, []
        mine = sorted((r.position, r.size) for r in got if r.source == s and r.position is not None)
        for position, size in mine:  # in training order a source's documents are its stream
            due.append(np.interp(np.interp(at, own, u), u, clock))
            at += size
        assert np.allclose([p for p, _ in mine], due, rtol=1e-3, atol=1.0)
    assert sum(r.doc_id == 7 for r in mix_sources(df).collect()) == 61
    full = {(r.doc_id, r.size, r.position) for r in got}
    assert {(r.doc_id, r.size, r.position) for r in mix_sources(df.repartition(5)).collect() if r.taken} == full


def test_ids_equal_those_of_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    table, rng = ChunkTable(model_path()), random.Random(1)
    parts = [" ", "  ", "▁", "a", "b", "the", "é", "\n", "\x00", "😀", "͸", "\t", " a", "1", "..", "<s>", "<0x41>"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        ids = sp.encode(t, add_bos=True, add_eos=True)
        packed, text = table.encode([t])[0]
        assert np.frombuffer(packed, "<u4").tolist() == ids and text == sp.decode(ids)
    for t in [" ".join(f"w{i % 900}" for i in range(400_000)), "no-space" * 200_000, ("ab  ▁ c\n d" * 150_000)]:  # longer than a slice
        ids, text = table.encode([t])[0]
        want = sp.encode(t, add_bos=True, add_eos=True)
        assert ids.tolist() == want and text == sp.decode(want)
    rows = [(1, "Hello  there,\nwörld", 5), (2, None, 6), (3, "", 7), (3, "", 7), (4, "ab " * 20_000, 8)]
    out = encode_documents(spark.createDataFrame(rows, "doc_id long, text string, n_chars int"), model_path())
    for r in out.withColumn("ids", ids_array()).withColumn("again", decode_ids(model_path())).collect():
        assert list(r.ids) == sp.encode(r.text or "", add_bos=True, add_eos=True) and r.n_tokens == len(r.ids)
        assert r.decoded == r.again == (r.text or "") and r.n_chars is not None


def test_quality_on_held_out_rows(spark):
    rng = random.Random(0)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(3, 80)))
    rows, labels = [], []
    for i in range(400):
        t, y = good(), int(i % 4 > 0)
        t = t if y else [" ".join(w + "!!" for w in t.upper().split()), " ".join([t.split()[0]] * 40), " | ".join(t.split())][i % 3]
        rows.append((i, t, y))
        labels.append((i, y))
    labels += [(0, 1), (0, None), (None, 1)]
    docs = spark.createDataFrame(rows + [(500, None, 0), (501, "", 0)], "doc_id long, text string, label int")
    lab = spark.createDataFrame(labels, "doc_id long, label int")
    held = quality.held_out()
    model = quality.train(docs.select("doc_id", "text"), lab.where(~held))
    got = quality.score_documents(docs, model).withColumn("out", held).collect()
    right = [(r.score >= 0.3) == bool(r.label) for r in got if r.out and r.text]
    assert len(right) > 50 and sum(right) / len(right) > 0.9
    assert all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if not r.text}) == 1
    one = quality.train(docs.select("doc_id", "text"), lab.where("label = 1"))
    assert all(r.score > 0.9 for r in quality.score_documents(docs, one).collect())
    none = quality.train(docs.select("doc_id", "text"), lab.limit(0))
    assert all(r.score == 0.5 for r in quality.score_documents(docs, none).collect())
