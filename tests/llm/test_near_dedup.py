import random
import re

import numpy as np

from quern.llm import near_dedup as N


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < n else frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def brute(rows, n, threshold):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i][0] is None or rows[j][0] is None:
                continue
            if rows[i][0] == rows[j][0] and a and b or a and b and 100 * len(a & b) >= threshold * len(a | b):
                parent[root(i)] = root(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[root(i)] = min(k, low.get(root(i), k))
    return sorted(((k, len(sets[i]), low.get(root(i)) if k is not None else None) for i, (k, _) in enumerate(rows)), key=str)


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows, k = [], 100
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 12, 40, 120]))]
        for _ in range(rng.choice([1, 2, 5, 12])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                t[rng.randrange(len(t))] = word()
            rows.append((k, rng.choice([" ", "\n", "  "]).join(t).upper() if rng.random() < 0.3 else " ".join(t)))
            k += rng.choice([1, 3])
    chain = [word() for _ in range(60)]
    for i in range(25):  # each is near the next, the ends are far apart
        chain = chain[2:] + [word(), word()]
        rows.append((rng.randrange(1000, 9999), " ".join(chain)))
    rows += [(5, None), (6, ""), (7, " \n"), (8, "One two"), (9, "one TWO"), (None, "one two"), (None, None), (9, "quite another text of some words"), (50, "quite another text of some words")]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n long, node string").repartition(3)
    got = N.near_dedup(df, words=4).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, 4, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert N.near_dedup(df.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.RandomState(2)
    pool = rng.randint(0, 2**63, 1300).astype(np.uint64) * np.uint64(2)
    a, b = np.sort(pool[:1000]), np.sort(pool[300:])
    s = N.signatures(np.concatenate([a, b]), np.array([0, 1000, 2000]), 512)
    assert abs((s[0] == s[1]).mean() - 700 / 1300) < 0.06
    assert len(set(s[0].tolist())) > 300


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (2000, 2000)], "a long, b long")
    got = {r["node"]: r["root"] for r in N.components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_links_of_an_id_with_different_texts(spark):
    rng = random.Random(12)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    rows = []
    for k in range(7, 67, 6):  # a short text with a near copy, and a long one nobody else has
        x = words(14)
        rows += [(k, " ".join(x)), (k, " ".join(words(104))), (k + 2, " ".join(x + words(1)))]
    x, y = words(30), words(60)  # links through both texts
    rows += [(100, " ".join(x)), (100, " ".join(y)), (101, " ".join(x[1:])), (102, " ".join(y[2:])), (103, " ".join(words(40)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in N.near_dedup(df).collect()), key=str)
    assert got == brute(rows, 5, 80)


def test_recall_on_documents(spark):
    """Every document whose id is divisible by 50, against all rows by plain sets: whatever is linked
    to it is in its component."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets, at = {r["doc_id"]: shingles(r["text"], 4) for r in df.select("doc_id", "text").collect()}, {}
    for k, x in sets.items():
        for s in x:
            at.setdefault(s, []).append(k)
    got = {r["doc_id"]: r["component_id"] for r in N.near_dedup(df, words=4, threshold=80).collect()}
    links = 0
    for k in sets:
        if k % 50 == 0:
            common = {}
            for s in sets[k]:
                for other in at[s]:
                    common[other] = common.get(other, 0) + 1
            for other, n in common.items():
                if other != k and 100 * n >= 80 * (len(sets[k]) + len(sets[other]) - n):
                    links += 1
                    assert got[k] == got[other]
    assert links > 0
