import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import quality_rules as Q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(3)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def texts(n=300):
    rng = random.Random(4)
    bits = ["a", "b", "é", "#", " ", " ", "\n", "\n", "\t", "x|", "日本", " "]
    return ["".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 6, 30, 200]))) for _ in range(n)]


def test_base_columns():
    t = texts()
    got = Q.base_columns(t)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(int(got[c][k]) for c in names) for k in range(len(t))] == [brute(x) for x in t]


def test_slices_change_nothing(monkeypatch):
    t = texts(40)
    whole = [np.concatenate(x) for x in zip(*Q.gram_keys(t, 3))]
    monkeypatch.setattr(Q, "SLICE", 7)
    cut = [np.concatenate(x) for x in zip(*Q.gram_keys(t, 3))]
    assert all((a == b).all() for a, b in zip(whole, cut))


class Brute:
    """Interpolated modified Kneser-Ney in plain dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = [Counter() for _ in range(order + 1)]
        for t in texts:
            for g, _ in self.grams(t):
                self.counts[order][g] += 1
        for n in range(order - 1, 0, -1):
            for g in self.counts[n + 1]:
                self.counts[n][g[1:]] += 1
        self.d, self.context = [None], [None]
        for n in range(1, order + 1):
            seen = Counter(self.counts[n].values())
            n1, n2, n3, n4 = (max(0.5, seen[r]) for r in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2)
            d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
            self.d.append([min(max(x, low), high) for x, low, high in zip(d, (0.1, 0.2, 0.3), (0.9, 1.8, 2.7))])
            of = {}
            for g, c in self.counts[n].items():
                total = of.setdefault(g[:-1], [0, 0.0])
                total[0] += c
                total[1] += self.off(n, c)
            self.context.append(of)

    def off(self, n, c):
        return self.d[n][min(c, 3) - 1] if c else 0.0

    def grams(self, text):
        t = " " * (self.order - 1) + re.sub(r"[\x20\x09-\x0D]", " ", text or "")
        return [(t[k : k + self.order], None) for k in range(len(t) - self.order + 1)]

    def p(self, g):
        if not g:
            return 1 / 0x110000
        n, got = len(g), self.context[len(g)].get(g[:-1])
        if got is None:
            return self.p(g[1:])
        c = self.counts[n][g]
        return (c - self.off(n, c)) / got[0] + got[1] / got[0] * self.p(g[1:])

    def log_ppl(self, text):
        gs = self.grams(text)
        return -sum(math.log(self.p(g)) for g, _ in gs) / max(1, len(gs))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_model_against_brute_force(spark, monkeypatch, order):
    """Counts, continuation counts, discounts, perplexities; scripts are not folded together."""
    rng = random.Random(order)
    alphabets = ["abcde  .,", "абвгд  ,", "日本語文字の  。", "xyz\t\n "]
    rows = []
    for k in range(120):
        letters = alphabets[k % 4]
        rows.append((k, "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 40, 300]))), ["en", "ru", "ja", None][k % 4]))
    rows += [(200, None, "en"), (201, None, "none"), (3, rows[3][1], None), (3, rows[3][1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    models = {lang: Brute([t for _, t, x in rows if x == lang], order) for lang in {r[2] for r in rows}}
    want = sorted((k, round(models[x].log_ppl(t), 9)) for k, t, x in rows)
    told = lambda: sorted((r["doc_id"], round(r["log_ppl"], 9)) for r in Q.perplexities(df, "doc_id", "text", "lang", order).collect())
    got = told()
    assert len(got) == len(want) and all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-7 for a, b in zip(got, want))
    for name, n in (("PASS_ENTRIES", 60), ("HELD_ENTRIES", 20), ("READ_ENTRIES", 50), ("SLICE", 31)):
        monkeypatch.setattr(Q, name, n)
    parts = told()  # in many passes, languages cut among them
    assert len(parts) == len(want) and all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-7 for a, b in zip(parts, want))


def test_probabilities_sum_to_one():
    t = texts()
    b = Brute(t, 3)
    symbols = sorted({g[-1] for g in b.counts[1]})
    for context in ["  ", "a ", "日本", "éb", "zz", "#a"]:
        rest = 0x110000 - len(symbols)
        assert abs(sum(b.p(context + c) for c in symbols) + rest * b.p(context + "\U0010fffd") - 1) < 1e-9


def test_symbols_of_all_scripts_stay_apart():
    text = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя" + "ابتثجحخدذرزسشصضطظعغفقكلمنهوي" + "".join(map(chr, range(0x4E00, 0x4E00 + 2000)))
    assert len(np.unique(Q.symbols(np.array([ord(c) for c in text], np.uint32)))) == len(text)


def test_table(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["the", "cat", "sat", "on", "mats", "of", "old", "houses", "red"]) + rng.choice("abcdefgh") for _ in range(80)) for _ in range(60)]
    noise = " ".join("".join(chr(rng.randint(33, 126)) for _ in range(6)) for _ in range(90))
    rows = [(k, t, "en" if k % 3 else None, "c") for k, t in enumerate([*good, noise, "", None, "x y"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    got = {r["doc_id"]: r for r in Q.judge(df).collect()}
    assert len(got) == 64 and all(got[k]["kept"] for k in range(60))
    assert not got[60]["kept"] and not got[60]["base_failed"]
    assert all(got[k]["base_failed"] and not got[k]["kept"] for k in (61, 62, 63))
    assert Q.judge(df.limit(0)).count() == 0


def test_model_of_a_language_depends_on_its_own_rows_alone(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(k, " ".join("".join(rng.choice("abcdefg") for _ in range(3)) for _ in range(60)), f"l{k % 70:02}" if k % 70 else None) for k in range(140)]
    rows += [(140, "", "empty"), (141, None, "l05")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    told = lambda d: {r["doc_id"]: r for r in Q.judge(d).collect()}
    whole = told(df)
    assert len(whole) == 142
    for lang in ("l01", "l69"):
        for k, r in told(df.where(F.col("lang") == lang)).items():
            for c in ("perplexity", "low_perplexity", "high_perplexity"):
                assert abs(whole[k][c] - r[c]) < 1e-9
    # no bound of memory changes the result
    monkeypatch.setattr(Q, "PASS_ENTRIES", 5000)
    monkeypatch.setattr(Q, "HELD_ENTRIES", 50)
    monkeypatch.setattr(Q, "READ_ENTRIES", 700)
    parts = told(df)
    assert len(parts) == 142
    for k, r in whole.items():
        assert parts[k]["kept"] == r["kept"] and abs(parts[k]["perplexity"] - r["perplexity"]) < 1e-9


def test_each_side_of_a_band_follows_its_own_quartiles(spark):
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(4))
    rows = []
    for k in range(240):  # the share of rare words differs, and more so upwards
        rare, n = rng.random() ** 3 * 0.4, rng.choice([60, 400])
        rows.append((k, " ".join(word("vwxyzjkq") if rng.random() < rare else word("abcd") for _ in range(n)), "xy"[k % 2]))
    got = [r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect() if not r["base_failed"]]
    for lang in (0, 1):
        here = [r for r in got if r["doc_id"] % 2 == lang]
        p = np.sort(np.log([r["perplexity"] for r in here]))
        q1, median, q3 = (p[int(np.ceil(x * len(p))) - 1] for x in (0.25, 0.5, 0.75))
        low, high = ({round(float(np.log(r[c])), 9) for r in here} for c in ("low_perplexity", "high_perplexity"))
        assert len(low) == len(high) == 1  # whatever the length of a text
        assert abs(low.pop() - (q1 - max(0.05, 6 * (median - q1)))) < 1e-6
        top = high.pop()
        assert abs(top - (q3 + max(0.05, min(6 * (q3 - median), 3 * (q3 - q1))))) < 1e-6 and top <= q3 + max(0.1, 3 * (q3 - q1)) + 1e-6
        assert all(r["kept"] == (r["low_perplexity"] <= r["perplexity"] <= r["high_perplexity"]) for r in here)
