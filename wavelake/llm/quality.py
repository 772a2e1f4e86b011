"""Naive Bayes support vectors: a linear hinge-loss model over n-gram indicators scaled by class log-count ratios.

Indicators are hashed n-grams of a whole text: byte pairs, triples and quads, words and word
pairs (in a pair, a word that repeats the one before it counts as "again"). Each is scaled by the log of the ratio of its smoothed shares in the two classes; a text's
vector has unit length. The hinge loss is minimised by dual coordinate descent, and margins become
probabilities by a logistic fit on margins of held-out folds of the training rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Rolling, mix, pieces, release, text_bytes, tidy, words

#: Hash space of the indicators, as a power of two.
SPACE = 18
#: Labelled rows that the model is fitted on at most: those of smallest hash of doc_id.
MAX_TRAIN = 6000
#: Bytes of text worked on at a time (a longer text alone).
CHUNK = 1 << 19

_ORDERS = (2, 3, 4)
_SEEDS = [U(0x9E3779B97F4A7C15 * (i + 1) % 2**64) for i in range(8)]


class Features:
    """Distinct indicator ids of each text of a batch."""

    def __init__(self):
        self.roll = Rolling(10)

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        n = len(offsets) - 1
        found: list[list[np.ndarray]] = [[] for _ in range(n)]
        shift = U(64 - SPACE)

        def deal(ids: np.ndarray, cuts: np.ndarray) -> None:
            for i in range(n):
                if cuts[i + 1] > cuts[i]:
                    found[i].append(ids[cuts[i]: cuts[i + 1]])

        if len(data):
            gram = data.astype(np.uint64)
            for k in range(2, max(_ORDERS) + 1):
                if len(data) < k:
                    break
                gram = (gram[:-1] << U(8)) | data[k - 1:]
                if k in _ORDERS:
                    ids = (mix(gram ^ _SEEDS[k]) >> shift).astype(np.int32)
                    # n-grams that would cross into the next text are left out
                    for i in range(n):
                        a, b = offsets[i], offsets[i + 1] - k + 1
                        if b > a:
                            found[i].append(ids[a:b])
            start, end, counts = words(data, offsets)
            if len(start):
                h = self.roll.spans(self.roll.prefix(data), start, end)
                cuts = np.concatenate([[0], np.cumsum(counts)])
                deal((mix(h ^ _SEEDS[0]) >> shift).astype(np.int32), cuts)
                same = h[:-1] == h[1:]
                h[1:][same] = _SEEDS[6]  # a word said again, whichever it is
                pair = (mix((h[:-1] * _SEEDS[1]) ^ h[1:]) >> shift).astype(np.int32)
                for i in range(n):
                    if cuts[i + 1] - cuts[i] > 1:
                        found[i].append(pair[cuts[i]: cuts[i + 1] - 1])
        seen = np.zeros(1 << SPACE, bool)
        out = []
        for parts in found:
            if parts:
                for p in parts:
                    seen[p] = True
                ids = np.flatnonzero(seen).astype(np.int32)
                seen[ids] = False
            else:
                ids = np.empty(0, np.int32)
            out.append(ids)
        return out

    def batch(self, column):
        data, offsets = text_bytes(column)
        for i, j in pieces(offsets, CHUNK):
            yield i, j, self.chunk(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])


def _log_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = np.ones((2, 1 << SPACE))
    for ids, label in zip(rows, y, strict=True):
        counts[label, ids] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def _vector(ids: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    x = ratio[ids]
    size = np.sqrt(x @ x)
    return x / size if size > 0 else x


def _descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, rounds: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; the bias is one more coordinate of value 1.

    The cost of a class is inverse to its share, so the rarer class is not given up."""
    w, bias = np.zeros(1 << SPACE), 0.0
    xs = [_vector(ids, ratio) for ids in rows]
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.bincount(y, minlength=2) / len(y)
    top = cost * 0.5 / np.maximum(share[y], 1e-9)
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            ids, x = rows[i], xs[i]
            grad = sign[i] * (x @ w[ids] + bias) - 1.0
            new = min(max(alpha[i] - grad / (x @ x + 1.0), 0.0), top[i])
            step = new - alpha[i]
            if step:
                w[ids] += step * sign[i] * x
                bias += step * sign[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3 * cost:
            break
    return w, bias


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))) by damped Newton steps, with targets smoothed at the ends."""
    pos, neg = (y > 0).sum(), (y == 0).sum()
    t = np.where(y > 0, (pos + 1.0) / (pos + 2.0), 1.0 / (neg + 2.0))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        d, g = np.maximum(p * (1 - p), 1e-12), p - t
        h = np.array([[d @ (m * m) + 1e-6, d @ m], [d @ m, d.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([g @ m, g.sum()]))
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


class Model:
    def __init__(self, ratio, w, bias, a, b):
        self.ratio, self.weight, self.bias, self.a, self.b = ratio.astype(np.float32), (ratio * w).astype(np.float32), bias, a, b

    def score(self, ids: np.ndarray) -> float:
        r = self.ratio[ids].astype(np.float64)
        size = np.sqrt(r @ r)
        m = (self.weight[ids].astype(np.float64).sum() / size if size > 0 else 0.0) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.a * m + self.b, -30, 30))))


def fit(rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0, rounds: int = 30, folds: int = 3) -> Model:
    """Fit on lists of indicator ids. With one class only, every score is that class's smoothed share."""
    if len(set(y.tolist())) < 2:
        n1 = float(y.sum())
        p = (n1 + 1) / (len(y) + 2)
        zero = np.zeros(1 << SPACE)
        return Model(zero, zero, 0.0, 1.0, float(np.log(p / (1 - p))))
    margins = np.zeros(len(y))
    order = np.random.default_rng(1).permutation(len(y))
    done = np.zeros(len(y), bool)
    for k in range(folds):
        out = order[k::folds]
        rest = np.setdiff1d(np.arange(len(y)), out)
        if len(set(y[rest].tolist())) < 2:
            continue
        ratio = _log_ratio([rows[i] for i in rest], y[rest])
        w, bias = _descend([rows[i] for i in rest], y[rest], ratio, cost, rounds)
        for i in out:
            margins[i] = _vector(rows[i], ratio) @ w[rows[i]] + bias
        done[out] = True
    ratio = _log_ratio(rows, y)
    w, bias = _descend(rows, y, ratio, cost, rounds)
    a, b = _logistic(margins[done], y[done]) if done.any() and len(set(y[done].tolist())) == 2 else (1.0, 0.0)
    return Model(ratio, w, bias, a, b)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Model from documents (doc_id, text) and labels (doc_id, label 0 or 1).

    At most ``max_train`` labelled ids are used, those of smallest hash; this bounds what the
    driver gathers (their indicator ids) whatever the input. An id with several labels has the
    majority's, 0 on a tie; null ids or labels are left out. Without any label all scores are 0.5.
    """
    import pyarrow as pa

    picked = (labels.where("doc_id is not null and label is not null").groupBy("doc_id")
              .agg((F.avg("label") > 0.5).cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def run(batches):
        features = Features()
        for batch in batches:
            for i, j, ids in features.batch(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("label").slice(i, j - i), pa.array(ids, pa.list_(pa.int32()))],
                    ["doc_id", "label", "ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.select("doc_id", "text", "label").mapInArrow(tidy(run), f"doc_id {kind}, label int, ids array<int>").toArrow()
    y = got.column("label").to_numpy().astype(np.int64)
    x = [np.asarray(v.values, np.int32) for v in got.column("ids")]
    keys = got.column("doc_id").to_pylist()
    order = sorted(range(len(y)), key=lambda i: (keys[i], len(x[i]), x[i].tobytes()))
    model = fit([x[i] for i in order], y[order])
    del got, x
    release()
    return model


def score_documents(df: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """Add the probability of label 1 to every row; only the text is looked at.

    A null or empty text has no indicator and gets the score of the bias alone. All columns are
    kept; repeated rows get equal scores; an empty table stays empty.
    """
    import pyarrow as pa

    kept = [c for c in df.columns if c != score]
    out = df.select(*kept)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields), f"`{score}` double"])
    shared = df.sparkSession.sparkContext.broadcast(model)  # of a fixed size, the hash space

    def run(batches):
        features, m = Features(), shared.value
        for batch in batches:
            for i, j, ids in features.batch(batch.column(batch.schema.get_field_index(text))):
                part = batch.slice(i, j - i)
                scores = pa.array([m.score(x) for x in ids], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], [*part.schema.names, score])

    return out.mapInArrow(tidy(run), schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
