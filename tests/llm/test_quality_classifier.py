import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import quality_classifier as Q

SCHEMA = "doc_id long, text string, score string"


def rows():
    rng = random.Random(3)
    good, bad = ["house", "garden", "river", "walked", "quietly"], ["$$$", "click!!", "BUY", "###", "xx|yy"]
    return [(k, " ".join(rng.choice(good if k % 2 else bad) for _ in range(40)), "s") for k in range(200)]


def test_learns_and_scores(spark):
    docs = spark.createDataFrame([*rows(), (900, None, "s"), (901, "", "s"), (902, " \n", None), (1, rows()[1][1], "s")], SCHEMA)
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 150)] + [(7, 0), (8, None), (None, 1)], "doc_id long, quality int")
    model = Q.fit(docs, labels)
    got = {}
    for r in Q.score(docs, model).collect():
        got.setdefault(r["doc_id"], []).append(r["score"])
    assert sum(map(len, got.values())) == 204 and all(0 <= s <= 1 for v in got.values() for s in v)
    assert all((got[k][0] >= 0.5) == bool(k % 2) for k in range(150, 200))
    assert got[900] == got[901] == got[902] and got[1][0] == got[1][1]


@pytest.mark.parametrize("labels, share", [([], 0.5), ([(1, 1)], 0.999), ([(2, 0)], 0.001)])
def test_one_label_or_none(spark, labels, share):
    docs = spark.createDataFrame(rows()[:5], SCHEMA)
    model = Q.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert all(abs(r["score"] - share) < 1e-6 for r in Q.score(docs, model).collect())


def test_features_do_not_depend_on_slices(monkeypatch):
    texts = pa.array([t for _, t, _ in rows()[:20]] + ["é" * 300, "日本語 xy" * 40, None, "", "a"])

    def all_of():
        return sorted((int(d), int(b)) for ds, bs in Q.features(texts) for d, b in zip(ds, bs))

    whole = all_of()
    monkeypatch.setattr(Q.H, "SLICE", 64)
    assert all_of() == whole


MASK = 2**64 - 1


def mixed(x):
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & MASK
    return x ^ x >> 31


def brute_buckets(text):
    """Buckets of a text's words and of its runs of 3 and 4 characters, one by one."""
    out = Counter()
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for w in re.findall(r"[^\x20\x09-\x0D]+", low):
        out[int(Q.H.word_hashes(pa.array([w]))[0][0]) >> 47] += 1
        for n in (3, 4):
            for k in range(len(w) - n + 1):
                key = n
                for c in w[k : k + n]:
                    key = (key * 0xD1342543DE82EF95 + int.from_bytes(c.encode(), "big")) & MASK
                out[mixed(key) >> 47] += 1
    return out


def test_features_are_words_and_runs_of_characters():
    for text in [t for _, t, _ in rows()[:10]] + ["Straße über 日本語の文字 é", "ab abc", "", None, "😀😀😀 x"]:
        got = Counter(int(b) for _, bs in Q.features(pa.array([text], pa.string())) for b in bs)
        assert got == brute_buckets(text)


def test_training_and_scores_against_plain_loops(spark):
    docs = rows()[:40] + [(50, None, ""), (51, "", ""), (52, "é 日本語", "")]
    labels = [(k, k % 2) for k in range(0, 30)] + [(50, 1)]
    part_of, bias = Q.fit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r["doc_id"]: r["score"] for r in Q.score(spark.createDataFrame(docs, SCHEMA), (part_of, bias)).collect()}

    # the same order of documents, then softmax regression over averaged vectors by plain loops
    text, label = {k: t for k, t, _ in docs}, dict(labels)
    unit = {r["k"]: r["u"] for r in spark.createDataFrame([(k,) for k in label], "k long").selectExpr("k", "shiftrightunsigned(xxhash64(k, 'train'), 11) / 9007199254740992D AS u").collect()}
    order = sorted(label, key=unit.get)
    rng = np.random.RandomState(7)
    vectors = rng.uniform(-1 / Q.DIM, 1 / Q.DIM, (Q.BUCKETS, Q.DIM)).tolist()
    layer = rng.uniform(-0.1, 0.1, (Q.DIM, 2)).tolist()
    share = sum(label.values()) / len(label)
    bias = [math.log(1 - share), math.log(share)]
    steps, done = Q.EPOCHS * len(order), 0

    def forward(seen):
        n = sum(seen.values())
        h = [sum(c * vectors[b][d] for b, c in seen.items()) / n if n else 0.0 for d in range(Q.DIM)]
        z = [sum(h[d] * layer[d][j] for d in range(Q.DIM)) + bias[j] for j in (0, 1)]
        e = [math.exp(x - max(z)) for x in z]
        return h, [x / sum(e) for x in e]

    counted = {k: brute_buckets(t) for k, t in text.items()}
    for _ in range(Q.EPOCHS):
        for i in rng.permutation(len(order)):
            k = order[i]
            rate, done = Q.RATE * (1 - done / steps), done + 1
            h, p = forward(counted[k])
            p[label[k]] -= 1
            back = [layer[d][0] * p[0] + layer[d][1] * p[1] for d in range(Q.DIM)]
            for j in (0, 1):
                for d in range(Q.DIM):
                    layer[d][j] -= rate * h[d] * p[j]
                bias[j] -= rate * 0.1 * p[j]
            n = sum(counted[k].values())
            for b, c in counted[k].items():
                for d in range(Q.DIM):
                    vectors[b][d] -= rate * 40.0 * c / n * back[d]
    assert all(abs(got[k] - forward(counted[k])[1][1]) < 2e-3 for k in text)


def test_training_counts_have_a_bound(spark, monkeypatch):
    docs, labels = spark.createDataFrame(rows(), SCHEMA), spark.createDataFrame([(k, k % 2) for k in range(150)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(Q, "TRAIN_ENTRIES", 1000)
    monkeypatch.setattr(Q, "train", lambda rows, y, **o: seen.append(sum(len(r[0]) for r in rows)) or Q.Embeddings(np.zeros((1, 2)), np.zeros((2, 2)), np.zeros(2)))
    Q.fit(docs, labels)
    assert 0 < seen[0] <= 1000
