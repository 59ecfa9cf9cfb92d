"""Quality classifier: supervised subword embeddings.

A text's features are its words, whether a word equals the word before it, and the 3- and 4-byte windows of its words
(with their edges), all hashed into buckets. Each bucket has a learned vector, a text is the mean of its vectors, and a
softmax over the classes is trained with it by stochastic gradient descent in numpy, on the driver, over a bounded
sample of labelled rows: the whole texts of at most SAMPLE rows a class. As the output is linear in the
mean, scoring needs one learned number a bucket: a table of fixed size that every task gets.

Edge cases: null and empty texts have no features and get the score of the bias alone; labels other than 0 and 1 and
null labels are left out, and of a document's several labels the smallest counts; without rows of both classes every
score is 0.5. Whole texts are scored, however long. Extra columns pass through; `score` is replaced if it exists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, drop, saved
from .hashing import pieces, word_hashes, words_of

BITS = 18
SAMPLE = 1500
#: Bytes of text that it may hold in all.
BYTES = 32 << 20
THRESHOLD = 0.3
_SAME = 1


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of its text) of all features."""
    words, counts = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    same = np.flatnonzero((words[1:] == words[:-1]) & (owner[1:] == owner[:-1])) + 1
    flat = [b" " + b" ".join(w) + b" " if w else b"" for w in map(words_of, texts)]
    data = np.frombuffer(b"".join(flat), np.uint8)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) for x in flat])
    d, space = data.astype(np.uint32), data == 32
    shift = np.uint32(32 - BITS)
    parts = [((words >> np.uint64(64 - BITS)).astype(np.uint32), owner), (np.full(len(same), _SAME, np.uint32), owner[same])]
    for n, odd in ((3, 2654435761), (4, 2246822519)):
        if len(d) >= n:
            key = d[: len(d) - n + 1].copy()
            inside = np.zeros(len(key), bool)
            for j in range(1, n):
                key |= d[j : j + len(key)] << np.uint32(8 * j)
                if j < n - 1:
                    inside |= space[j : j + len(key)]
            at = np.flatnonzero(~inside & (text[: len(key)] == text[n - 1 :]))
            parts.append(((key[at] * np.uint32(odd)) >> shift, text[at]))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


class Model:
    """One number a bucket and a bias: the difference of the two classes' outputs."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float32), bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        bucket, owner = features(texts)
        total = np.bincount(owner, self.weight[bucket], len(texts))
        mean = total / np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        return 1 / (1 + np.exp(-np.clip(mean + self.bias, -500, 500)))


def fit(texts: list[bytes], labels: list[int], dims: int = 8, epochs: int = 4, rate: float = 0.6, seed: int = 3) -> Model:
    """Learn bucket vectors and the softmax by stochastic gradient descent, one text at a time."""
    if len(set(labels)) < 2:
        return Model(np.zeros(1 << BITS), 0.0)
    r = np.random.default_rng(seed)
    vectors = r.uniform(-1 / dims, 1 / dims, (1 << BITS, dims))
    out, bias = np.zeros((2, dims)), np.zeros(2)
    rows = []
    for a, b in pieces(texts):
        bucket, owner = features(texts[a:b])
        order = np.argsort(owner, kind="stable")
        bucket, ends = bucket[order], np.searchsorted(owner[order], np.arange(b - a + 1))
        for i in range(b - a):
            ids, n = np.unique(bucket[ends[i] : ends[i + 1]], return_counts=True)
            rows.append((ids, (n / max(n.sum(), 1)).astype(np.float32), labels[a + i]))
    share = np.bincount(labels, minlength=2) / len(labels)
    total, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in r.permutation(len(rows)):
            ids, weight, label = rows[i]
            mean = weight @ vectors[ids]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            p *= 0.5 / share[label]  # both classes weigh the same
            lr = rate * (1 - step / total)
            back = p @ out
            out -= lr * 4 * np.outer(p, mean)
            bias -= lr * 0.05 * p
            vectors[ids] -= lr * 40 * weight[:, None] * back
            step += 1
    return Model(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Fit on a bounded sample of `labels` (key, label 0 or 1), drawn by the hash of the key, and their whole texts.

    The sample has at most SAMPLE keys a label and, in the order of the draw, as many as hold BYTES of text together; a key whose
    texts no longer fit is passed over.
    """
    known = labels.where(F.col("label").isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min("label").alias("_label"))
    drawn = None
    for label in (0, 1):
        some = known.where(F.col("_label") == label).orderBy(F.xxhash64("_k"), "_k").limit(SAMPLE)
        drawn = some if drawn is None else drawn.union(some)
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(text).cast("binary").alias("_t"))
    met = saved(texts.join(F.broadcast(drawn), "_k").select("_k", "_t", "_label"), "labelled")  # at most 2 * SAMPLE keys
    sizes = met.groupBy("_k").agg(F.sum(F.octet_length("_t")).cast("long").alias("n")).orderBy(F.xxhash64("_k"), "_k").collect()
    held, chosen = 0, []
    for r in sizes:
        if held + r.n <= BYTES:
            held += r.n
            chosen.append(r._k)
    kept = met if len(chosen) == len(sizes) else met.join(F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in chosen], docs.select(F.col(key).alias("_k")).schema)), "_k", "left_semi")
    rows = kept.toPandas().sort_values(["_k", "_t"])
    drop(met)
    return fit([bytes(t) for t in rows["_t"]], [int(x) for x in rows["_label"]])


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with a column `out`: the probability of label 1."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # a table of 2**BITS numbers
    rest = [f for f in docs.schema.fields if f.name != out]
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(x or "").encode() for x in b.column(at).to_pylist()]
            scores = np.concatenate([np.empty(0), *(shared.value.scores(texts[x:y]) for x, y in pieces(texts))])
            keep = [i for i, n in enumerate(b.schema.names) if n != out]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(scores)], [*(b.schema.names[i] for i in keep), out])

    return docs.mapInArrow(run, T.StructType([*rest, T.StructField(out, T.DoubleType())]))
