"""Quality classifier: random-indexing word vectors, a two-layer network.

Tokens are runs of letters and digits (A-Z lower-cased) and runs of other
visible ASCII; a word in capitals adds one more token. Tokens fall into
``BUCKETS`` hashed words. Every word has a sparse random index vector
(``ONES`` signs in ``DIM`` places, drawn from its bucket number); its word
vector is its own index vector and the sum of those of its neighbours within
``REACH`` tokens, over all documents, in log scale and of unit length. The sums
are integers added up per task and then by word, so they do not depend on the
order.

A document is the mean of its tokens' vectors, the mean over its distinct
words, the share of distinct words and its length in log scale. A two-layer
network is fitted with numpy on at most ``SAMPLE`` labelled texts of either
class; a fifth of them is kept apart to set the temperature of its output.

Edge cases: a null or empty text is scored like any other (its vectors are
zero); without labels of both classes every score is the share of label 1 (0
without labels); null labels and keys are not learned from; an empty table
gives no rows; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthvale.llm.common import ship, text_of
from hearthvale.llm.tokens import portions
from hearthvale.llm.toxicity import examples
from hearthvale.llm.wordhash import runs

BUCKETS, DIM, ONES, REACH = 8192, 64, 4, 2
SAMPLE, HIDDEN, EPOCHS, BATCH = 6000, 48, 30, 128
PORTION = 2 << 20     # bytes of text worked on at a time

_BYTES = np.arange(256)
_CLASS = np.where((_BYTES >= 0x80) | ((_BYTES >= 48) & (_BYTES < 58)) | ((_BYTES >= 65) & (_BYTES < 91))
                  | ((_BYTES >= 97) & (_BYTES < 123)), 1, np.where((_BYTES > 32) & (_BYTES < 127), 2, 0)).astype(np.uint8)
_CAPITAL = (_BYTES >= 65) & (_BYTES < 91)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each token, cut, text and bucket of the capitals' tokens).
    The last bucket is theirs alone."""
    h, start, end, cut, data = runs(texts, _CLASS)
    bucket = (h % np.uint64(BUCKETS - 1)).astype(np.int32)
    capitals = np.r_[0, np.cumsum(_CAPITAL[data])]
    loud = np.flatnonzero((capitals[end] - capitals[start] == end - start) & (end - start > 1))
    return bucket, cut, np.searchsorted(cut, loud, side="right") - 1, np.full(len(loud), BUCKETS - 1, np.int32)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every bucket's index vector."""
    rng = np.random.default_rng(11)
    places = np.array([rng.choice(DIM, ONES, replace=False) for _ in range(BUCKETS)])
    return places, rng.choice([-1.0, 1.0], (BUCKETS, ONES))


def add_contexts(total: np.ndarray, bucket: np.ndarray, text: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Add to ``total`` the index vectors of all neighbours within a text."""
    for d in range(1, REACH + 1):
        near = text[d:] == text[:-d]
        for me, other in ((bucket[d:][near], bucket[:-d][near]), (bucket[:-d][near], bucket[d:][near])):
            for k in range(ONES):
                total += np.bincount(me * DIM + places[other, k], signs[other, k], BUCKETS * DIM)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit vectors of all buckets, from all documents."""
    places, signs = index_vectors()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(BUCKETS * DIM), np.zeros(BUCKETS, bool)
        for b in batches:
            for p in portions(b.column(0), PORTION):
                bucket, cut, _, _ = tokens(b.column(0)[p])
                seen[bucket] = True
                add_contexts(total, bucket, np.repeat(np.arange(len(cut) - 1), np.diff(cut)), places, signs)
        rows = np.flatnonzero(seen)
        vecs = total.reshape(BUCKETS, DIM)[rows]
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), *(pa.array(vecs[:, j].astype(np.float32)) for j in range(DIM))],
                                         names=["w", *(f"v{j}" for j in range(DIM))])

    schema = "w int, " + ", ".join(f"v{j} float" for j in range(DIM))
    sums = (docs.select(text_of(docs, text_col).alias("text")).mapInArrow(run, schema)
            .groupBy("w").agg(*[F.sum(f"v{j}").alias(f"v{j}") for j in range(DIM)]).collect())     # at most BUCKETS rows
    out = np.zeros((BUCKETS, DIM))
    for r in sums:
        out[r[0]] = r[1:]
    out = np.sign(out) * np.log1p(np.abs(out))
    out /= np.maximum(np.linalg.norm(out, axis=1), 1e-9)[:, None]
    own = np.zeros((BUCKETS, DIM))
    np.put_along_axis(own, places, signs / np.sqrt(ONES), axis=1)
    out += own
    return (out / np.linalg.norm(out, axis=1)[:, None]).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """One feature row per text."""
    parts = [_pooled(texts[p], vectors) for p in portions(texts, PORTION)]
    return np.concatenate(parts) if parts else np.zeros((0, 2 * DIM + 2), np.float32)


def _pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    bucket, cut, loud_text, loud = tokens(texts)
    n = np.diff(cut)
    text = np.r_[np.repeat(np.arange(len(texts)), n), loud_text]
    key, count = np.unique(text * BUCKETS + np.r_[bucket, loud], return_counts=True)
    owner, word = key // BUCKETS, key % BUCKETS
    out = np.zeros((len(texts), 2 * DIM + 2), np.float32)
    begin = np.searchsorted(owner, np.arange(len(texts) + 1))
    kinds = np.diff(begin)
    some = np.flatnonzero(kinds)
    for i in range(0, len(some), 256):
        part = some[i:i + 256]
        a, b = begin[part[0]], begin[part[-1] + 1]
        v = vectors[word[a:b]]
        at = begin[part] - a
        total = np.add.reduceat(count[a:b], at)
        out[part, :DIM] = np.add.reduceat(v * count[a:b, None].astype(np.float32), at) / total[:, None]
        out[part, DIM:2 * DIM] = np.add.reduceat(v, at) / kinds[part][:, None]
        out[part, 2 * DIM] = kinds[part] / total
    out[:, 2 * DIM + 1] = np.log1p(n)
    return out


class Network:
    """Two layers and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, worth: np.ndarray, share: float):
        self.share, self.layers = share, None
        if not len(y) or y.min() == y.max():
            return
        rng = np.random.default_rng(3)
        order = rng.permutation(len(y))
        apart, train = order[:max(1, len(y) // 5)], order[max(1, len(y) // 5):]
        self.mean, self.spread = x[train].mean(0), x[train].std(0) + 1e-4
        z = (x - self.mean) / self.spread
        size = z.shape[1]
        w = [rng.normal(0, np.sqrt(2 / size), (size, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(EPOCHS):
            rng.shuffle(train)
            for i in range(0, len(train), BATCH):
                p = train[i:i + BATCH]
                h = np.maximum(z[p] @ w[0] + w[1], 0)
                d = worth[p] * (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - y[p]) / len(p)
                back = np.outer(d, w[2]) * (h > 0)
                grads = [z[p].T @ back + 1e-4 * w[0], back.sum(0), h.T @ d + 1e-4 * w[2], np.array([d.sum()])]
                t += 1
                for j, g in enumerate(grads):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    w[j] = w[j] - 0.003 * (m[j] / (1 - 0.9 ** t)) / (np.sqrt(v[j] / (1 - 0.999 ** t)) + 1e-8)
        self.layers, self.temperature = w, 1.0
        raw, best = self.raw(x[apart]), np.inf
        for temperature in np.geomspace(0.25, 8, 41):
            p = np.clip(1 / (1 + np.exp(-np.clip(raw / temperature, -30, 30))), 1e-6, 1 - 1e-6)
            loss = -(worth[apart] * (y[apart] * np.log(p) + (1 - y[apart]) * np.log(1 - p))).mean()
            if loss < best:
                best, self.temperature = loss, float(temperature)

    def raw(self, x: np.ndarray) -> np.ndarray:
        w = self.layers
        return np.maximum((x - self.mean) / self.spread @ w[0] + w[1], 0) @ w[2] + w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.raw(x) / self.temperature, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors and the network; ``learn``: which labels may be used."""
    ship(docs.sparkSession)
    vectors = word_vectors(docs, text_col)
    rows, share = examples(docs, labels, learn, id_col, text_col, label_col, sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pooled(b.column(2), vectors)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    kind = dict(rows.dtypes)["doc_id"]
    got = rows.select("doc_id", "y", "text").mapInArrow(features, f"doc_id {kind}, y int, x binary").collect()   # at most 2 x SAMPLE
    got = sorted(got, key=lambda r: r["doc_id"])
    x = np.array([np.frombuffer(r["x"], np.float32) for r in got], np.float64).reshape(len(got), 2 * DIM + 2)
    y = np.array([r["y"] for r in got], float)
    ones = max(y.sum(), 1e-9)
    worth = np.where(y > 0, share / ones, (1 - share) / max(len(y) - y.sum(), 1e-9)) * len(y)
    return vectors, Network(x, y, worth, share)


def with_scores(docs: DataFrame, model: tuple[np.ndarray, Network], text_col: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        vectors, network = held.value
        return pa.array(network.score(pooled(texts, vectors)))

    return docs.withColumn(score, of(text_of(docs, text_col)))
