import math
import random
from collections import Counter, defaultdict

import pytest

from quern.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string"


def rows():
    en, de = "the cat and the dog of the house", "der hund und die katze mit dem haus"
    return [(k, (en if k % 2 else de) + f" {k} " + "xyzzy" * (k % 3), "en" if k % 2 else "de", "c") for k in range(60)]


def test_words_and_backoff(spark):
    df = spark.createDataFrame([*rows(), (100, "123 ²³ -- !", "en", None), (101, None, "en", None), (102, "", None, None), (103, "the", None, "c")], SCHEMA)
    model = langid.fit(df)
    known = lambda w: int(langid.gram_keys([w], 0)[0][0]) in model.tables[0][0].tolist()
    assert model.languages == ["de", "en"] and known("the") and known("katze") and not known("house" * 2)
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    assert len(got) == 64 and all(got[k]["lang_pred"] == ("en" if k % 2 else "de") and 0.9 < got[k]["score"] <= 1 for k in range(60))
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (100, 101, 102))
    # an unseen word is judged by its longest known n-grams
    assert model.score(["katzen", "houses"]).argmax(axis=1).tolist() == [0, 1]
    assert model.score(["日本"]).tolist() == [[0.0, 0.0]]


def test_long_texts_extra_columns_and_nothing_learnt(spark):
    df = spark.createDataFrame([(1, "die katze " * 300_000, "de", "c"), (2, "the dog", "en", "d")], SCHEMA)
    model = langid.fit(spark.createDataFrame(rows(), SCHEMA))
    got = {r["doc_id"]: r for r in langid.identify(df, model, keep=("lang", "score")).collect()}
    assert got[1]["lang_pred"] == "de" and got[2]["_keep_score"] == "d"
    none = langid.fit(df.limit(0))
    assert [r["lang_pred"] for r in langid.identify(df, none).collect()] == ["und", "und"]


def test_the_sample_has_a_bound(spark):
    df = spark.createDataFrame([(k, f"text {k}", "en", "") for k in range(2000)], SCHEMA)
    n = langid.sample(df, "doc_id", "text", "lang", 200)[0].count()
    assert 120 < n < 280


def grams_of(word, n):
    if n == 0:
        return [word]
    word = f"_{word}_" if n > 1 else word
    return [word[i : i + n] for i in range(len(word) - n + 1)]


class Brute:
    """The same model in plain dictionaries."""

    def __init__(self, rows):
        self.counts = [defaultdict(Counter) for _ in range(langid.MAX_N + 1)]
        self.languages = sorted({x for _, t, x in rows if x is not None and langid.words_of(t or "")})
        self.total = [Counter() for _ in self.counts]
        for _, text, lang in rows:
            if lang is None or text is None:
                continue
            for w in langid.words_of(text):
                for n in range(langid.MAX_N + 1):
                    for g in grams_of(w, n):
                        self.counts[n][g][lang] += 1
                        self.total[n][lang] += 1

    def seen(self, n, g):
        return {x: c for x, c in self.counts[n].get(g, {}).items() if n or c >= langid.MIN_COUNT}

    def word(self, w):
        for n in (0, *range(langid.MAX_N, 0, -1)):
            known = [s for g in grams_of(w, n) if (s := self.seen(n, g))]
            if known:
                return [sum(math.log(s.get(x, langid.FLOOR)) - math.log(max(1, self.total[n][x])) for s in known) / len(known) for x in self.languages]
        return [0.0] * len(self.languages)

    def judge(self, text):
        words = langid.words_of(text or "")
        if not words or not self.languages:
            return "und", 0.0
        sums = [sum(x) / len(words) * min(len(words), langid.EVIDENCE) for x in zip(*map(self.word, words))]
        p = [math.exp(x - max(sums)) for x in sums]
        best = max(range(len(p)), key=lambda k: (p[k], -k))
        return self.languages[best], p[best] / sum(p)


@pytest.mark.parametrize("bounds", [{}, {"CACHE": 6000, "HELD": 3, "AT_ONCE": 700}])
def test_against_brute_force(spark, monkeypatch, bounds):
    """Many languages, ties between them, unseen words, words seen once, letters of any script."""
    for k, v in bounds.items():
        monkeypatch.setattr(langid, k, v)
    rng = random.Random(11)
    letters = ["abcde", "defgh", "abxyz", "日本語文字", "αβγδε", "абвгд", "äöüßé"]
    vocabulary = {f"l{k:02}": ["".join(rng.choice(letters[k % 7]) for _ in range(rng.choice([1, 2, 3, 5, 8]))) for _ in range(25)] for k in range(70)}
    rows = [(100 * k + j, " ".join(rng.choice(v) for _ in range(rng.choice([1, 6, 40]))), lang) for k, (lang, v) in enumerate(vocabulary.items()) for j in range(3)]
    rows += [(9001, "same words", "l01"), (9002, "same words", "l02"), (9003, "same words", "l01"), (9004, "same words", "l02"), (9005, None, "only"), (9006, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    more = [(1, "same words"), (2, "samé wordy zzz"), (3, "12 ²"), (4, None), (5, ""), (6, "Ⅷ五 日本 ABCDE"), (7, "qqqq"), *((k + 100_000, t) for k, t, _ in rows)]
    model, b = langid.fit(df), Brute(rows)
    assert model.languages == b.languages and len(b.languages) == 70
    got = langid.identify(spark.createDataFrame(more, "doc_id long, text string"), model).collect()
    want = {k: b.judge(t) for k, t in more}
    assert len(got) == len(more)
    for r in got:
        pred, score = want[r["doc_id"]]
        assert abs(r["score"] - score) < 1e-4, (r, want[r["doc_id"]], dict(more)[r["doc_id"]])
        assert r["lang_pred"] == pred or score < 0.51  # equal up to rounding


def test_a_larger_vocabulary_is_kept_whole(spark):
    """Beyond the 20,000 words and 5,000 n-grams a language that were kept once."""
    rng = random.Random(12)
    words = list({"".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(32_000)})
    df = spark.createDataFrame([(k, " ".join(words[k::50] * 2), "en") for k in range(50)], "doc_id long, text string, lang string")
    keys = langid.fit(df).tables
    assert len(keys[0][0]) == len(words) > 30_000
    assert len(keys[4][0]) == len({g for w in words for g in grams_of(w, 4)}) > 5_000
