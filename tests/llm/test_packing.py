import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quern.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def exact():
    t = Tokenizer.from_file(PATH)
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_library(exact):
    rng = random.Random(3)
    bits = ["a", "B", "é", " ", " ", " ", "\n", "\t", "1", "'s", "'", ".", ",", "!!", "  ", "\r\n", "日", "<|endoftext|>", "😀", "\x1c", "\x85", " ", "word", "Ærlig", "²"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 2, 3, 8, 40]))) for _ in range(5000)]
    texts += ["x" * 30_000, "é" * 5000, "ab " * 9000, " " * 3000]
    assert [list(x) for x in P.Coder(PATH).batch(texts)] == exact(texts)


def test_pieces_rebuild_the_documents(spark, exact):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "be.", "gamma", "delta,", "x"]) for _ in range(rng.choice([0, 3, 50, 400, 6000]))) for _ in range(60)] + [None, ""]
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)] + [(3, texts[3], 5)], "doc_id long, text string, start int").repartition(2)
    got = [r.asDict() for r in P.pack_documents(df, PATH).collect()]
    ids = [np.array([*x, 1], np.uint32) for x in exact([t or "" for t in texts])]
    seen = {}
    for r in got:
        x = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(x) == r["length"] > 0 and zlib.crc32(x.astype("<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
    assert seen == {k: len(x) * (2 if k == 3 else 1) for k, x in enumerate(ids)}
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["sequence_length"]))
    for parts in by.values():
        at = 0
        for o, n, _ in sorted(parts):
            assert o == at
            at += n
        assert at <= P.MAX_TOKENS and len(parts) <= P.MAX_SEGMENTS and parts[0][2] == P.padded_length(at, P.MAX_TOKENS)
    assert sum(map(len, ids)) >= 0.9 * sum(p[0][2] for p in by.values())
    assert P.pack_documents(df.limit(0), PATH).count() == 0


def test_instruction_data_keeps_all_limits(spark):
    rng = random.Random(2)
    rows = []
    for k in range(300):
        n = rng.choice([1, 5, 30, 90])
        rows.append((k, [rng.randrange(100) for _ in range(n)], [int(i >= n // 2) for i in range(n)]))
    rows += [(900, [], []), (901, None, None), (902, list(range(400)), [1] * 400)]
    df = spark.createDataFrame(rows, "k long, ids array<int>, loss array<int>").repartition(1)
    limits = P.Limits(tokens=128, segments=4, loss=50, cut=False)
    got = [r.asDict() for r in P.pack_examples(df, "k", "ids", "loss", limits).collect()]
    assert sorted(r["k"] for r in got) == [*range(300), 900, 901, 902]
    assert all((r["length"], r["doc_tokens"], r["sequence_id"], r["offset"]) == (0, 0, None, None) for r in got if r["k"] in (900, 901))
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
    for parts in by.values():
        assert sum(p["length"] for p in parts) <= 128 and len(parts) <= 4 and sum(p["n_loss"] for p in parts) <= 50
    assert all(r["length"] == r["doc_tokens"] for r in got if r["k"] != 902)


def test_no_id_of_instruction_data_is_lost(spark):
    rng = random.Random(4)
    rows = [(k, [rng.randrange(100) for _ in range(n)]) for k, n in enumerate([1, 30, 2048, 2049, 5000, 9001, 700])]
    got = P.pack_examples(spark.createDataFrame(rows, "k long, ids array<int>").repartition(1), "k", "ids").collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r["length"])
    assert all(sum(x) <= P.MAX_TOKENS for x in by.values())
    for k, ids in rows:
        pieces, at = sorted((r["start"], r["length"], r["ids_crc32"]) for r in got if r["k"] == k), 0
        for start, n, crc in pieces:
            assert start == at and n > 0 and zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()) == crc
            at += n
        assert at == len(ids) and len(pieces) == -(-len(ids) // P.MAX_TOKENS)


@pytest.mark.parametrize("kind, limits", [("length", (4000, 10_000, 100_000)), ("segments", (100_000, 5, 100_000)), ("n_loss", (100_000, 10_000, 2000))])
def test_each_limit_binds(spark, exact, kind, limits):
    """Conversations as instruction data: the ids of the assistant's turns bear loss."""
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()
    talks = {}
    for r in sorted(turns, key=lambda r: (r["conv_id"], r["turn"])):
        talks.setdefault(r["conv_id"], []).append(r)
    rows = []
    for k, rs in talks.items():
        parts = exact([r["text"] or "" for r in rs])
        ids = [i for p in parts for i in p]
        loss = [int(r["role"] == "assistant") for r, p in zip(rs, parts) for _ in p]
        if len(ids) <= limits[0] and sum(loss) <= limits[2]:
            rows.append((k, ids, loss))
    assert len(rows) > 20 and any(sum(x[2]) for x in rows)
    df = spark.createDataFrame(rows, "k long, ids array<int>, loss array<int>").repartition(1)
    got = P.pack_examples(df, "k", "ids", "loss", P.Limits(*limits, cut=False, remainder=True)).where("length > 0").collect()
    use = {}
    for r in got:
        u = use.setdefault(r["sequence_id"], {"length": 0, "segments": 0, "n_loss": 0})
        u["length"] += r["length"]
        u["segments"] += 1
        u["n_loss"] += r["n_loss"]
    bound = dict(zip(("length", "segments", "n_loss"), limits))
    assert all(u[c] <= bound[c] for u in use.values() for c in bound)
    # the tight limit decides the number of sequences, and the packing comes near it
    total = sum(u[kind] for u in use.values())
    assert -(-total // bound[kind]) <= len(use) <= 1 + 1.35 * total / bound[kind]
    assert sum(r["n_loss"] for r in got) == sum(sum(x[2]) for x in rows)
