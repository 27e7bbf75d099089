import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quern.llm import exact_dedup as E


def brute(rows):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    groups = {}
    for (k, _), t in zip(rows, norm):
        groups.setdefault(t, []).append(k)
    out = []
    for (k, _), t in zip(rows, norm):
        low = min((x for x in groups[t] if x is not None), default=None)
        out.append((k, low, len(groups[t]), k == low, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeioubcd") for _ in range(5))
    base = [" ".join(word() + rng.choice(["", ",", "."]) for _ in range(rng.choice([1, 30, 600, 3000]))) for _ in range(12)]
    rows = []
    for k in range(80):
        t = rng.choice(base)
        if rng.random() < 0.5:
            t = t.replace(" ", rng.choice(["\n", " \t", "  "]), 3)
        if rng.random() < 0.2:
            t += word()
        rows.append((k, t))
    shared = base[3]
    rows += [(200, None), (201, ""), (202, " "), (203, "\n \t"), (7, rows[7][1]), (None, "lone"), (None, "x"), (300, "x"), (301, "é" * 5000), (302, shared + " A" + shared), (303, shared + " B" + shared)]
    return rows


@pytest.mark.parametrize("bits", [64, 2])
def test_against_brute_force(spark, bits):
    """With 2-bit fingerprints nearly all chunks clash, and the results stay the same."""
    rows = corpus()
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, recipe string, id int").repartition(3)
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in E.exact_dedup(df, bits=bits).collect()]
    assert sorted(got, key=str) == brute(rows)
    assert E.exact_dedup(df.limit(0), bits=bits).count() == 0


def test_chunks_rebuild_the_text_and_follow_the_content(spark):
    text = next(t for _, t in corpus() if t and len(t) > 9000)
    df = spark.createDataFrame([(text,), ("zz " + text,)], "t string").select(E.chunks(E.normalised("t")).alias("c"))
    a, b = (r["c"] for r in df.collect())
    assert "".join(a) == re.sub("[\x20\x09-\x0d]+", " ", text) and all(len(x) <= E.MAX_CHARS for x in a)
    assert len(set(a) & set(b)) >= len(a) - 4


def test_the_query_runs_no_python(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = E.exact_dedup(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_cuts_follow_the_content_in_several_scripts(spark):
    """A passage behind different beginnings gives the same chunks but for the first few."""
    rng = random.Random(3)
    alphabets = {"latin": "abcdefghijklmnoprstu", "upper": "ABCDEFGHIJKLMNOPRSTU", "digits": "0123456789", "cyrillic": "абвгдежзиклмнопрстуф", "greek": "αβγδεζηθικλμνοπρστυφ", "arabic": "ابتثجحخدذرزسشصضوي", "han": "的了是在不人我他这中大来上国个到说们为子和你地出道也时年" * 9 + "".join(map(chr, range(0x4E00, 0x9FFF, 97)))}
    for name, letters in alphabets.items():
        word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
        text = lambda n: ("" if name == "han" else " ").join(word() for _ in range(n))
        passage = text(6000)
        df = spark.createDataFrame([(text(40) + passage,), (text(71) + passage,)], "t string")
        a, b = (r["c"] for r in df.select(E.chunks(F.col("t")).alias("c")).collect())
        assert "".join(a).endswith(passage) and "".join(b).endswith(passage)
        assert len(a) > 10 and len(set(a) & set(b)) > 0.6 * len(a), name
