"""Quality classifier: supervised embeddings of words and character n-grams.

Every word and every run of 3 or 4 characters inside a word hashes to one of BUCKETS
learned vectors; a document is the average of the vectors of all its occurrences, and a
softmax layer turns that into label probabilities.  Stochastic gradient descent in numpy
fits vectors and layer together on the driver, from TRAIN_ROWS labelled documents or so,
and TRAIN_ENTRIES bucket counts of them at most (both in the order of a hash); nothing but
those counts is collected.

A trained model scores through one number a bucket (its vector along the softmax layer's
difference of labels), an array of fixed size that every task holds.

Defined cases: a null text is empty; a document without words has the bias's score; several
labels of one document count as their mean, label 1 from a half on; null labels teach
nothing, nor do documents behind the one that passes TRAIN_ENTRIES; with one label only, or none, the score is that label's share (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import hashing as H
from quern.llm.scratch import drop, stage
from quern.llm.workers import lean

BITS = 17
BUCKETS = 1 << BITS
DIM = 8
TRAIN_ROWS, TRAIN_ENTRIES = 4000, 16_000_000
EPOCHS, RATE, BATCH = 12, 0.5, 16
NGRAMS = (3, 4)
THRESHOLD = 0.7


def _char_grams(data: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of the runs of 3 or 4 characters without white space whose first one starts in
    the first ``size`` bytes, and where their first and last characters start."""
    start = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(start):
        return
    # a character's number is its bytes in UTF-8
    code, width = H._FOLD[data[start]].astype(H.U64), np.diff(start, append=len(data))
    for j in range(1, 4):
        more = np.flatnonzero(width > j)
        code[more] = code[more] << H.U64(8) | data[start[more] + j].astype(H.U64)
    solid = ~H._SPACE[data[start]]
    for n in NGRAMS:
        m = len(start) - n + 1
        if m <= 0:
            continue
        key, ok = np.full(m, H.U64(n)), start[:m] < size
        for i in range(n):
            key = key * H.U64(0xD1342543DE82EF95) + code[i : m + i]
            ok &= solid[i : m + i]
        at = np.flatnonzero(ok)
        yield H.mix(key[at]), start[at], start[at + n - 1]


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of (document index, bucket) of all features of the texts; the pieces bound
    memory, and together they hold every occurrence once."""
    words, first, _ = H.word_hashes(texts, lower=True)
    yield np.repeat(np.arange(len(texts)), np.diff(first)), (words >> H.U64(64 - BITS)).astype(np.int64)
    data, offsets = H.buffers(texts)
    for a in range(0, len(data), H.SLICE):
        size = min(H.SLICE, len(data) - a)
        for h, at, last in _char_grams(data[a : a + size + 4 * max(NGRAMS)], size):
            doc = np.searchsorted(offsets, at + a, "right") - 1
            same = doc == np.searchsorted(offsets, last + a, "right") - 1
            yield doc[same], (h[same] >> H.U64(64 - BITS)).astype(np.int64)


class Embeddings:
    def __init__(self, table: np.ndarray, layer: np.ndarray, bias: np.ndarray):
        self.table, self.layer, self.bias = table, layer, bias

    def along(self) -> tuple[np.ndarray, float]:
        """Each bucket's part in the log odds of label 1, and the constant."""
        return self.table @ (self.layer[:, 1] - self.layer[:, 0]), float(self.bias[1] - self.bias[0])


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Embeddings:
    """rows: each document's distinct buckets and counts.  Labels 0 and 1 are both there."""
    rng = np.random.RandomState(seed)
    table = rng.uniform(-1.0 / dim, 1.0 / dim, (BUCKETS, dim)).astype(np.float32)
    layer = rng.uniform(-0.1, 0.1, (dim, 2)).astype(np.float32)
    share = labels.mean()
    bias = np.log(np.array([1 - share, share], np.float32))
    weights = [(c / max(1, c.sum())).astype(np.float32) for _, c in rows]
    scale = np.float32(40.0)  # an average of n vectors moves slowly; this sets the step of the vectors
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            ids, w = rows[k][0], weights[k]
            lr = np.float32(rate * (1.0 - done / steps))
            done += 1
            h = w @ table[ids] if len(ids) else np.zeros(dim, np.float32)
            z = h @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1.0
            back = layer @ p
            layer -= lr * np.outer(h, p)
            bias -= lr * np.float32(0.1) * p
            if len(ids):
                table[ids] -= (lr * scale) * np.outer(w, back)
    return Embeddings(table, layer, bias)


def bucket_counts(df: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """label, unit, n, and n buckets and counts as 32-bit numbers, of every row; at most BUCKETS
    entries each."""
    source = df.select(df[label_col], df[text_col], df["_unit"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                keys = [np.zeros(0, np.int64)]
                for doc, bucket in features(part.column(1)):
                    keys.append(doc * BUCKETS + bucket)
                key, count = np.unique(np.concatenate(keys), return_counts=True)
                edges = np.searchsorted(key, np.arange(part.num_rows + 1) * BUCKETS)
                ids, count = (key % BUCKETS).astype("<i4"), count.astype("<i4")
                blobs = [[x[i:j].tobytes() for i, j in zip(edges, edges[1:])] for x in (ids, count)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int32()), part.column(2), pa.array(np.diff(edges)), *(pa.array(x, pa.binary()) for x in blobs)], ["label", "unit", "n", "buckets", "counts"])

    return source.mapInArrow(lean(run), "label int, unit double, n long, buckets binary, counts binary")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS):
    """A model from labelled documents; the labels given are all for training."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("int").alias("_label"))
    n = one.count()
    unit = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit("train")), 11) / float(1 << 53)
    # the hash keeps about `rows`; the limit makes that a proven bound for the broadcast
    chosen = one.withColumn("_unit", unit).where(F.col("_unit") < min(1.0, rows / max(1, n))).limit(2 * rows)
    found = docs.select(F.col(id_col), F.col(text_col)).join(F.broadcast(chosen), id_col)
    counted = stage(bucket_counts(found, id_col, text_col, "_label"), "buckets")
    got, held = [], 0
    for r in counted.orderBy("unit", "n", "buckets", "counts").toLocalIterator():
        held += r["n"]
        if held > TRAIN_ENTRIES and got:
            break
        got.append(r)
    drop(counted)
    y = np.array([r["label"] for r in got], np.int64)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
    model = train([tuple(np.frombuffer(r[c], "<i4").astype(kind) for c, kind in (("buckets", np.int64), ("counts", np.float32))) for r in got], y)
    return model.along()


def score(df: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (probability of label 1) of every row."""
    shared = df.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))  # BUCKETS numbers
    source = df.select(df[id_col], df[text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_of, bias = shared.value
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                total, count = np.zeros(part.num_rows), np.zeros(part.num_rows)
                for doc, bucket in features(part.column(1)):
                    total += np.bincount(doc, part_of[bucket], minlength=part.num_rows)
                    count += np.bincount(doc, minlength=part.num_rows)
                logit = total / np.maximum(count, 1) + bias
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1.0 / (1.0 + np.exp(-logit)))], [id_col, "score"])

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(lean(run), f"`{id_col}` {kind}, score double")
