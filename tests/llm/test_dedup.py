"""Near copies, repeated bytes and embeddings against brute force, with nulls, empty texts, ties and clashing columns."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.llm import repeats
from wavelake.llm.common import Scratch, connected_components
from wavelake.llm.embedding_dedup import near_vectors
from wavelake.llm.minhash import Shingles, drop_near_duplicates, near_duplicates, sketches
from wavelake.llm.suffix import common_prefix_reaches, suffix_array

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def components(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def shingle_set(text):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_groups(rows):
    sets = [shingle_set(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root = components(len(rows), links)
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return [(rows[i][0], len(sets[i]), least[root[i]]) for i in range(len(rows))]


def edited(words, rng, k):
    out = list(words)
    for i in rng.sample(range(len(out)), k):
        out[i] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


def corpus():
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**5)}" for _ in range(150)]
    texts = [edited(base, rng, rng.randrange(0, 9)) for _ in range(160)]  # a group whose ends resemble each other from afar
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 80))) for _ in range(80)]
    texts += ["", None, "  \n\t", "one two", "One TWO", "one two three four", "a b c d e", "a b c d e", "a  B c\td e", "É é", "é É"]
    texts += [" ".join(f"v{rng.randrange(50)}" for _ in range(3000))] * 2
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


def test_near_duplicates_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect())
    assert got == sorted(brute_groups(rows))
    kept = {r.doc_id for r in near_duplicates(df).where("kept").collect()}
    assert kept == {d for d, _, c in brute_groups(rows) if d == c}


def test_drop_near_duplicates_keeps_one_row_of_each_group(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, None, "z"), (4, "", "z"), (None, "q r s t u", None), (7, "q r s t u", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sid string")
    got = sorted(((r.doc_id, r.text, r.sid) for r in drop_near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, "a b c d e f", "x"), (3, None, "z"), (4, "", "z"), (7, "q r s t u", None)], key=str)


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketch_fills_every_coordinate_and_estimates_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64))
    b = np.concatenate([a[:2000], np.unique(rng.integers(0, 2**63, 2000, dtype=np.uint64))])
    s = sketches([a, b, a[:1]])
    assert (s != 2**64 - 1).all()
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((s[0] == s[1]).mean() - j) < 0.15


def test_shingles_of_whole_texts():
    texts = ["a b c d e f a b c d e", "x", "", "A b  C\nd e"]
    data = "".join(texts).encode()
    sizes = Shingles().chunk(np.frombuffer(data, np.uint8), np.cumsum([0] + [len(t) for t in texts]))
    assert [len(s) for s in sizes] == [len(shingle_set(t)) for t in texts]


def test_components_of_a_chain_and_a_star(spark, tmp_path):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.comp for r in connected_components(df, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}


@pytest.mark.parametrize("letters", [1, 2, 3, 256])
def test_suffix_array_orders_all_suffixes(letters):
    rng = np.random.default_rng(letters)
    for _ in range(150):
        t = rng.integers(0, letters, int(rng.integers(0, 70))).astype(np.uint8)
        b = t.tobytes()
        assert suffix_array(t).tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        d = int(rng.integers(1, 9))
        assert [b[i: i + d] for i in suffix_array(t, d)] == sorted(b[i: i + d] for i in range(len(b)))


def test_common_prefix():
    t = np.frombuffer(b"abcdefghijXabcdefghijY", np.uint8)
    assert common_prefix_reaches(t, np.array([0, 0]), np.array([11, 12]), 10).tolist() == [True, False]


def brute_repeats(texts, width):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i: i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if seen[b[i: i + width]] > 1:
                gone[i: i + width] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [256, 6])
def test_repeats_match_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)  # the small value sends the shared passage through finer cells
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abc déf ") for _ in range(n))
    passage, texts = word(70), []
    for i in range(150):
        texts.append(word(rng.randrange(60)) + (passage if i % 2 else "") + word(rng.randrange(60)))
    texts += ["xy" * 90, "z" * 130, None, "", passage, passage, "é" * 39]
    rows = [(i if i % 11 else None, t, 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, th int")
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.k) for r in
                              repeats.remove_repeats(df, 40).withColumn("k", F.sha2("kept", 256)).collect())
    want = brute_repeats([t for _, t, _ in rows + rows[:5]], 40)
    assert got == collections.Counter((d, *w) for (d, _, _), w in zip(rows + rows[:5], want, strict=True))


def test_planted_passages_by_bytes_and_by_words(spark):
    """400 bytes and more go by the byte rule; 51 short words go where repeats are also counted in words."""
    rng = np.random.default_rng(3)
    words = lambda n, k: " ".join("".join(rng.choice(list("abcdefghij"), k)) for _ in range(n))
    long, short = words(70, 6), words(51, 4)
    assert len(long) >= 400 > len(short)
    rows = [(i, f"{words(40, 6)} {(long, short)[i % 2]} {words(40, 6)}") for i in range(12)] + [(20, words(90, 6))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by_bytes = {r.doc_id: r for r in repeats.remove_repeats(df, 400, as_text=True).collect()}
    by_words = {r.doc_id: r for r in repeats.remove_repeats(df, 400, as_text=True, words=51).collect()}
    for i in range(12):
        assert ((long, short)[i % 2] in by_bytes[i].kept) == (i % 2 == 1) and by_bytes[i].n_spans == (i % 2 == 0)
        assert (long, short)[i % 2] not in by_words[i].kept and len(by_words[i].kept) >= 500
    assert by_bytes[20].kept == by_words[20].kept == rows[-1][1]


def test_op8_takes_repeated_passages_of_any_length_in_bytes_out_of_its_text(spark, tmp_path):
    """The contract's columns go by 400 bytes; in text, 51 short words go as well, and clean documents stay whole."""
    from wavelake.llm.queries import op8_suffix_array_dedup

    rng = np.random.default_rng(5)
    words = lambda n, k: " ".join("".join(rng.choice(list("abcdéfghij"), k)) for _ in range(n))
    long, short = words(70, 6), words(51, 4)
    assert len(long.encode()) >= 400 > len(short.encode())
    texts = [f"{words(40, 6)} {(long, short)[i % 2]} {words(40, 6)}" for i in range(8)] + [words(90, 6), words(50, 4), None, "", long, long]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op8_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for _, r in sorted(got.items())] == brute_repeats(texts, 400)
    for i in range(8):
        front, back = texts[i].split((long, short)[i % 2])
        assert got[i].text.startswith(front[:-8]) and got[i].text.endswith(back[8:]) and len(got[i].text) <= len(front + back)
    assert [got[i].text for i in range(8, 14)] == [texts[8], texts[9], "", "", "", ""]


@pytest.mark.parametrize("crowd", [256, 6])
def test_repeats_by_words_match_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rng = random.Random(2)
    words = lambda n: [rng.choice(["a", "bb", "cé", "ddd"]) for _ in range(n)]
    passage = words(14)
    rows = [words(rng.randrange(30)) + (passage if i % 2 else []) + words(rng.randrange(30)) for i in range(120)] + [["x"] * 40, ["y"] * 8, passage, passage, []]
    texts = [rng.choice([" ", "\n", " \t"]).join(w) for w in rows] + [None]
    at = collections.defaultdict(list)
    for i, w in enumerate(rows):
        for j in range(len(w) - 7):
            at[tuple(w[j: j + 8])].append((i, j))
    gone = [[False] * len(w) for w in rows]
    for places in at.values():
        for i, j in places if len(places) > 1 else []:
            gone[i][j: j + 8] = [True] * 8
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = {r.doc_id: (r.n_removed, r.kept) for r in repeats.remove_repeats(df, 400).collect()}
    got = {r.doc_id: r for r in repeats.remove_repeats(df, 400, words=8, apart=True).collect()}
    assert {i: (r.n_removed, r.kept) for i, r in got.items()} == plain
    for i, w in enumerate(rows):
        assert got[i].kept_text.split() == [x for x, g in zip(w, gone[i], strict=True) if not g], i
    assert got[len(rows)].kept_text == "" and sum(map(sum, gone)) > 1000


def test_suffix_array_of_wide_symbols():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 300):
        t = rng.integers(2**63, 2**63 + 3, n, dtype=np.uint64)
        assert suffix_array(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())
        order = suffix_array(t, 5)
        assert [t[i: i + 5].tolist() for i in order] == sorted(t[i: i + 5].tolist() for i in range(n))
        fits = order[order <= n - 5]
        same = [t[a: a + 5].tolist() == t[b: b + 5].tolist() for a, b in zip(fits[:-1], fits[1:], strict=True)]
        assert common_prefix_reaches(t, fits[:-1], fits[1:], 5).tolist() == same


def test_repeats_as_text_drop_half_characters(spark):
    df = spark.createDataFrame([(1, "é" * 30 + "A"), (2, "B" + "é" * 30)], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in repeats.remove_repeats(df, 40, as_text=True).collect()}
    assert got == {1: "A", 2: "B"}
    assert repeats.remove_repeats(df.limit(0), 40).count() == 0


def brute_vectors(rows):
    fine = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, n = [], collections.Counter()
    for a in fine:
        for b in fine:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], np.float32).astype(float), np.array(rows[b][1], np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links.append((a, b))
                    n[a] += 1
                    n[b] += 1
    root = components(len(rows), links)
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return sorted((rows[i][0], n[i], least[root[i]]) for i in range(len(rows)))


def test_vectors_match_brute_force(spark, monkeypatch):
    from wavelake.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)  # several splits and leaves in blocks
    rng = np.random.default_rng(3)
    centre, rows = rng.standard_normal((60, 32)), []
    for i in range(700):
        v = centre[i % 60] + rng.standard_normal(32) * [0.02, 0.12, 0.14, 0.5][i % 4]
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3)))
    rows += [(800 + i, rows[0][1], 0) for i in range(90)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 32, 1), (903, [float("nan")] * 32, 1), (904, rows[1][1], None), (905, [1.0, None], 1), (906, [2 * x for x in rows[0][1]], 0),
             (906, rows[0][1], 0), (907, [1.0, 2.0], 1), (908, [1.0, 2.01], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(df).collect())
    want = brute_vectors(rows)
    wrong = sum(a != b for a, b in zip(got, want, strict=True))
    assert wrong <= 0.01 * len(want)  # the forest's recall; no link is ever made up
    assert sum(g[1] for g in got) <= sum(w[1] for w in want)
    assert near_vectors(df.limit(0)).count() == 0


def test_forest_of_the_greatest_depth():
    """Pairs at cosine 0.98 meet in a leaf, and a vector is in few leaves a tree, at depth 20."""
    from wavelake.llm.embedding_dedup import SPILL, Forest, unit

    rng = np.random.default_rng(5)
    for dim in (64, 256):
        x = unit(rng.standard_normal((6000, dim)))
        a = x[:800]
        off = rng.standard_normal((800, dim))
        off = unit(off - (off * a).sum(axis=1, keepdims=True) * a)
        b = 0.98 * a + np.sqrt(1 - 0.98**2) * off
        forest, met, copies = Forest(x, 20, 6, SPILL / np.sqrt(dim)), np.zeros(800, bool), 0
        for (_, ra, la), (_, rb, lb) in zip(forest.leaves(a), forest.leaves(b), strict=True):
            both = np.intersect1d(ra.astype(np.int64) << 32 | la, rb.astype(np.int64) << 32 | lb)
            met[both >> 32] = True
            copies += len(ra)
        assert met.mean() >= 0.995 and copies / 800 / 6 < 7.5


def test_tiny_and_huge_vectors_keep_every_link(spark):
    from wavelake.llm.embedding_dedup import near_vectors

    rng = np.random.default_rng(8)
    base = rng.standard_normal((1500, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(2000 + i, (v * 1.5 + 1e-3).tolist()) for i, v in enumerate(base)]
    rows += [(5000, [1e-170] * 16), (5001, [2e-170] * 16), (5002, [1e200] * 16), (5003, [5e-324] + [0.0] * 15)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in near_vectors(df).collect()}
    assert all(got[2000 + i].component_id == got[i].component_id for i in range(1500))
    assert [got[i].component_id for i in (5000, 5001, 5002)] == [5000] * 3 and got[5000].n_links >= 2
