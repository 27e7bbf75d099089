import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quern.llm import katz


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


class Brute:
    """Orders 2 and 3 in plain dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.uni, self.ctx = Counter(), [None, defaultdict(Counter), defaultdict(Counter)]
        for t in texts:
            h = ("<s>", "<s>")
            for w in tokens(t):
                self.uni[w] += 1
                self.ctx[1][h[1:]][w] += 1
                self.ctx[2][h][w] += 1
                h = (h[1], w)
        self.n = sum(self.uni.values())
        self.d = [self.discounts(self.uni.values()), *(self.discounts([c for x in self.ctx[k].values() for c in x.values()]) for k in (1, 2))]
        self.unknown = 1 - sum(self.star(c, 0) for c in self.uni.values()) / self.n

    @staticmethod
    def discounts(counts):
        n = Counter(counts)
        return katz.good_turing([float(n[r]) for r in range(1, katz.MAX_RANK + 2)])

    def star(self, c, k):
        return self.d[k][c - 1] * c if c <= katz.MAX_RANK else c - katz.TAIL

    def p(self, h, w):
        """P(w | h), h the words before it, the nearest last."""
        k = len(h)
        if not k:
            return self.star(self.uni[w], 0) / self.n if self.uni[w] else self.unknown
        seen = self.ctx[k].get(h)
        if not seen:
            return self.p(h[1:], w)
        total = sum(seen.values())
        if w in seen:
            return self.star(seen[w], k) / total
        left = 1 - sum(self.star(c, k) for c in seen.values()) / total
        return left / (1 - sum(self.p(h[1:], x) for x in seen)) * self.p(h[1:], w)

    def score(self, text):
        h, total = ("<s>", "<s>"), 0.0
        for w in tokens(text):
            total += math.log10(self.p(h[3 - self.order :], w))
            h = (h[1], w)
        return total


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "The", "and", "b", "cc", *(f"w{int(rng.paretovariate(0.7))}" for _ in range(300))]
    return [" ".join(rng.choice(words) if rng.random() < 0.6 else rng.choice(words[:4]) for _ in range(rng.choice([0, 1, 5, 30, 90]))) for _ in range(n)]


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("options", [{}, {"passes": 2, "hot": 64, "part_tokens": 50}, {"passes": 3, "hot": 10_000, "part_tokens": 4000}])
def test_against_brute_force(spark, options, order):
    train, other = corpus(1, 80), corpus(2, 30)
    rows = [(k, t, 0) for k, t in enumerate(train)]
    new = [(1000 + k, t, 1) for k, t in enumerate(other)] + [(2000, None, 1), (2001, "", 1), (None, "the of", 1), (7, "the of the", 1), (7, "the of the", 1)]
    df = spark.createDataFrame([*rows, *new], "doc_id long, text string, part int").repartition(3)
    model = katz.fit(df.where("part = 0"), order=order, **options)
    b = Brute(train, order)
    assert model.n == b.n and model.v == len(b.uni) and model.documents == 80
    assert abs(model.unknown - b.unknown) < 1e-9
    f = model.frequent
    if options.get("hot") == 64:  # frequent words, pairs and triples all take their own ways
        assert len(f.words.keys) and len(model.grams.keys) and bool(len(f.pairs.keys)) == (order > 2) and f.parts > 24
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in katz.score(model, df).collect()), key=str)
    v = len(b.uni)
    want = []
    for k, t, _ in [*rows, *new]:
        ts = tokens(t)
        want.append((k, len(ts), sum(b.uni[w] > 0 for w in ts), round(sum(math.log10((b.uni[w] + 1) / (b.n + v + 1)) for w in ts), 6), round(b.score(t), 6)))
    want.sort(key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    near = 1e-5 if order == 2 else 2e-4  # backoff weights of pairs are stored in single precision
    assert all(abs(x - y) < near for g, w in zip(got, want) for x, y in zip(g[3:], w[3:]))
    for h in [("<s>", "<s>"), ("the", "of"), ("of", "the"), ("w1", "cc"), ("never", "the"), ("the", "never")]:
        assert abs(sum(b.p(h, w) for w in b.uni) + b.p(h, "unseen word") - 1) < 1e-9


def test_empty(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert katz.score(katz.fit(df), df.limit(0)).count() == 0
    r = katz.score(katz.fit(df.limit(0)), df).first()
    assert (r["n_tokens"], r["n_known"], r["base_score"], r["score"]) == (3, 0, 0.0, 0.0)


@pytest.mark.parametrize("order", [2, 3])
def test_no_part_grows_with_a_frequent_word(spark, order):
    """One word at 5 % of all tokens, one pair at 2 %: their triples are spread over the parts."""
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        words = []
        while len(words) < 300:
            words += ["of", "the"] if rng.random() < 0.03 else ["the" if rng.random() < 0.04 else f"w{rng.randrange(4000)}"]
        texts.append(" ".join(words))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    model = katz.fit(df, order=order, passes=1, part_tokens=400)
    sizes = [len(katz._load(r)[0]) for t in model.tables for r in t.collect()]
    assert len(sizes) == model.frequent.parts > 40 and max(sizes) < 3 * 400
    contexts = [len(r["a"]) // 8 + len(r["f"]) // 5 for r in model.contexts.select("a", "f").collect()]
    assert max(contexts) < 3 * 400


def test_lookups():
    rng = np.random.RandomState(1)
    keys = np.unique(rng.randint(0, 2**63, 3000, dtype=np.int64).astype(np.uint64) * np.uint64(2))
    keys = np.unique(np.concatenate([keys, keys[:20] + np.uint64(1), keys[:20] + np.uint64(3)]))  # several in a slot
    few = katz.Few(keys, np.arange(len(keys)) + 1)
    wanted = np.concatenate([keys[::-1], rng.randint(0, 2**63, 5000, dtype=np.int64).astype(np.uint64)])
    at = {int(k): i + 1 for i, k in enumerate(keys)}
    want = [at.get(int(x), 0) for x in wanted]
    assert few.find(wanted)[1].tolist() == want == katz._find(keys, np.arange(len(keys)) + 1, wanted)[1].tolist()
    x = rng.randint(0, 2**40, 1000, dtype=np.int64).astype(np.uint64)
    assert (katz._unfive(katz._five(x), 1000) == x).all()
