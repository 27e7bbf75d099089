import binascii
import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from test_langid import Brute
from test_near_dedup import brute

from quern.llm import mixing


def key(row):
    return [(x is not None, x) if x is not None else (False, 0) for x in row]


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute_exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault(normal(r[1]), []).append(r)
    out = []
    for g in groups.values():
        ids = [r[0] for r in g if r[0] is not None]
        same = [r for r in g if r[0] == (min(ids) if ids else None)]
        out.append(min(same, key=lambda r: key((r[2], r[3], r[4], r[1]))))
    return out


def brute_near(rows):
    component = brute([r[:2] for r in rows], 5, 80)
    gone = {i for i, n, c in component if i is not None and n and c != i}
    return [r for r in rows if r[0] not in gone or not normal(r[1]).strip(" ")]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    out = []
    for k in range(10, 50, 4):
        x = words(rng.choice([20, 40]))
        out += [(k, " ".join(x)), (k + 1, "  ".join(x)), (k + 2, " ".join(x + words(1)))]
    x, y, z = (" ".join(words(25)) for _ in range(3))
    out += [(None, x), (None, x), (None, y), (60, y), (61, y), (61, z), (62, z), (None, None)]  # 61 is dropped for y, kept for z
    out += [(70, x + " more"), (5, None), (70, ""), (71, " "), (71, "one two")]
    out = [(k, t, rng.choice(["en", None]), "web", len(t or "")) for k, t in out]
    out += [out[0], out[0], (out[3][0], out[3][1], "de", None, 3)]
    rng.shuffle(out)
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_against_brute_force(spark, rows):
    told = lambda f, x: sorted(map(tuple, f(spark, spark.createDataFrame(x, SCHEMA).repartition(3), "").collect()), key=key)
    assert told(C.exact, rows) == sorted(brute_exact(rows), key=key)
    assert told(C.near, rows) == sorted(brute_near(rows), key=key)
    assert told(C.exact, []) == told(C.near, []) == []


def test_run_against_brute_force(spark, rows, tmp_path, monkeypatch):
    """The stages that have no model of the whole corpus, one after the other."""
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(C, "STAGES", [s for s in C.STAGES if s[0] in ("exact_dedup", "near_dedup", "packing")])
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(r[0], len(coder.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in brute_near(brute_exact(rows))]
    got = [(r["doc_id"], r["doc_tokens"]) for r in C.run(spark, str(tmp_path)).collect() if r["start"] == 0]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_all_five_stages(spark, rows, tmp_path):
    """The whole run: what the first three stages keep by brute force, then as often as the mix
    takes it, and every id of every copy packed once."""
    rng = random.Random(9)
    german = ["der", "und", "katze", "hund", "haus", "nicht", "strasse"]
    data = [(1000 + k, " ".join(rng.choice(german) for _ in range(30)) + f" nummer{k}", "de", rng.choice(["a", None]), 5) for k in range(60)]
    data += [(2000 + k, " ".join(rng.choice(["the", "cat", "dog", "house", "street", "with"]) for _ in range(30)) + f" number{k}", "en", "b", 5) for k in range(60)]
    data += [(3000, "12 34 !!", "en", "b", 1), (3001, None, None, None, None), *((None, data[k][1], "de", "a", 5) for k in (0, 0, 1)), data[5], data[70]]
    more = spark.createDataFrame([(*r, "x", 1) for r in data], SCHEMA + ", size string, row int").repartition(4)
    more.write.parquet(f"{tmp_path}/documents.parquet")

    crc = lambda k: binascii.crc32(("" if k is None else str(k)).encode()) % 5
    b = Brute([r[:3] for r in data if crc(r[0])])
    sure = [r for r in data if (got := b.judge(r[1]))[0] != "und" and got[1] >= C.MIN_SCORE]
    assert 100 < len(sure) < len(data)
    left = brute_near(brute_exact(sure))
    plan = mixing.mix_to_targets(spark.createDataFrame(left, SCHEMA)).where("copies > 0").collect()
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = {r[0]: len(coder.encode(r[1], add_special_tokens=False).ids) + 1 for r in left}
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, size[r["doc_id"]], r["copies"]) for r in plan)
    got = C.run(spark, str(tmp_path)).collect()
    heads, ids = {}, {}
    for r in got:
        heads[r["doc_id"]] = heads.get(r["doc_id"], 0) + (r["start"] == 0)
        ids[r["doc_id"]] = ids.get(r["doc_id"], 0) + r["length"]
    assert sorted((k is not None, k or 0, size[k], n) for k, n in heads.items()) == want
    assert all(ids[k] == n * size[k] for k, n in heads.items())
    empty = spark.createDataFrame([], SCHEMA)
    (tmp_path / "e").mkdir()
    empty.write.parquet(f"{tmp_path}/e/documents.parquet")
    assert C.run(spark, f"{tmp_path}/e").count() == 0
