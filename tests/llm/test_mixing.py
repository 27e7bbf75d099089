import random

import pytest

from quern.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size string, rate string"


def shares(sizes, cap=3.0):
    """Step by step as the contract says."""
    order = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: [1, 2, 3][i % 3] for i, s in enumerate(order)}
    fixed = {}
    while True:
        rest = sum(sizes.values()) - sum(fixed.values())
        open_ = [s for s in order if s not in fixed]
        t = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if t[s] > cap * sizes[s]]
        if not over:
            return {**fixed, **t}
        fixed.update({s: cap * sizes[s] for s in over})


def test_shares(spark):
    rng = random.Random(1)
    many = {f"s{k:04}": rng.choice([0, 1, 10, 1000]) for k in range(500)} | {None: 7, "é": 3, "Z": 50}
    for sizes in ({"a": 10, "b": 1000, "c": 10, "d": 10, None: 5}, {"a": 0, "b": 7}, {None: 3}, {}, many):
        per = spark.createDataFrame(list(sizes.items()), "source string, words long")
        got = {r["source"]: r["target"] for r in M.shares(per).collect()}
        assert got == pytest.approx(shares(sizes))


def rows():
    rng = random.Random(8)
    out = [(k, " ".join(["w"] * rng.choice([1, 5, 20, 60])), "big" if rng.random() < 0.7 else rng.choice(["a", "b", None]), "x", "y") for k in range(900)]
    return [*out, (5000, None, "a", None, None), (5001, "", "b", None, None), (5002, " \n\t", "empty", None, None), (3, "w w w", "a", None, None), (None, "w w", "b", None, None)]


def test_mix(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = [r.asDict() for r in M.mix_to_targets(df).collect()]
    assert len(got) == len(data)
    size = {}
    for _, t, s, *_ in data:
        size[s] = size.get(s, 0) + len((t or "").split())
    want = shares(size)
    key = lambda r: (r["source_size"], round(r["target"], 6))
    total = {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        total[key(r)] = total.get(key(r), 0) + r["taken"]
    for s, t in want.items():
        assert abs(total[(size[s], round(t, 6))] - t) <= max(0.02 * t, 5), s
    again = sorted(M.mix_to_targets(df.repartition(5)).select("doc_id", "size", "taken").collect(), key=str)
    assert again == sorted(((r["doc_id"], r["size"], r["taken"]) for r in got), key=str)


def test_newton_meets_its_targets():
    import math

    import numpy as np

    size, n = np.arange(1.0, 50), np.full(49, 10.0)
    words = float((size * n).sum())
    for share in (0.001, 0.4, 1.0, 1.7, 2.99):
        lam = M.solve(size, n, share * words)
        assert sum(10 * s * min(3.0, math.exp(lam * s / 25.0)) for s in range(1, 50)) == pytest.approx(share * words, rel=1e-6)
    assert math.exp(M.solve(np.array([7.0]), np.array([3.0]), 2.5 * 21)) == pytest.approx(2.5, rel=1e-6)
    assert M.solve(size, n, 3 * words) == math.inf and M.solve(size, n, 0.0) == -math.inf == M.solve(np.zeros(0), np.zeros(0), 0.0)


def test_documents_come_as_often_as_taken(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    plan = {}
    for r in M.mix_to_targets(df).collect():
        plan[r["doc_id"]] = plan.get(r["doc_id"], 0) + r["copies"]
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    seen = {}
    for r in out.collect():
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert {k: v for k, v in plan.items() if v} == seen
    assert M.mix_to_targets(df.limit(0)).count() == 0


def test_columns_with_the_names_that_the_operator_uses(spark):
    names = ["source", "size", "row", "id", "lam", "mean", "cut", "more", "target", "copies", "rate", "unit", "place", "words", "_source", "_size", "_hash", "need"]
    names = [n for n in names if n != "source"]
    df = spark.createDataFrame([(k, "w " * (k % 9 + 1), "a" if k % 3 else None, *(f"{n}{k}" for n in names)) for k in range(60)], "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    for r in out.collect():
        assert all(r[n] == f"{n}{r['doc_id']}" for n in names)


def test_many_sources_and_repeated_ids(spark, monkeypatch):
    """Plans beyond what is copied to all tasks; one id that holds much of a source."""
    monkeypatch.setattr(M, "SMALL_PLAN", 10)
    rng = random.Random(4)
    data = [(k, "w " * rng.choice([3, 10, 40]), f"s{k % 150:03}") for k in range(3000)]
    data += [(99999, "w " * 25, "rep")] * 40 + [(k + 10**6, "w " * 11, "rep") for k in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    size, taken = {}, {}
    for _, t, s in data:
        size[s] = size.get(s, 0) + len(t.split())
    source = {k: s for k, _, s in data}
    got = M.mix_to_targets(df).collect()
    assert len(got) == len(data)
    for r in got:
        s = source[r["doc_id"]]
        taken[s] = taken.get(s, 0) + r["taken"]
    want = shares(size)
    assert all(abs(taken[s] - t) <= 45 for s, t in want.items() if s != "rep")
    assert taken["rep"] <= want["rep"] + 1 or abs(taken["rep"] - want["rep"]) <= 40 * 25
