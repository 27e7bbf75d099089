import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import hashing as H


def thue_morse(n, flip):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


@pytest.mark.parametrize("n", [2, 16, 64, 1024, 2048, 4096])
def test_words_of_a_structure_that_defeats_polynomials(n):
    h, _, _ = H.word_hashes(pa.array([thue_morse(n, 0), thue_morse(n, 1), "b" + thue_morse(n, 0)[1:]]))
    assert len(h) == 3 and h[0] != h[1]


@pytest.mark.parametrize("size", [1 << 19, 61])
def test_against_a_dictionary(monkeypatch, size):
    """Equal words have equal hashes and different ones different hashes, wherever they stand."""
    monkeypatch.setattr(H, "SLICE", size)
    rng = random.Random(9)
    bits = ["a", "B", "é", "日", " ", " ", "\t", "\n", "x" * 70, "y" * 300, "A"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 5, 40]))) for _ in range(400)] + [None, ""]
    for lower in (False, True):
        h, first, n = H.word_hashes(pa.array(texts), lower=lower)
        words = []
        for k, t in enumerate(texts):
            t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") if lower else t or ""
            found = re.findall(r"[^\x20\x09-\x0D]+", t)
            assert first[k + 1] - first[k] == len(found)
            words += found
        assert [len(w.encode()) for w in words] == n.tolist()
        assert len(set(zip(words, h.tolist()))) == len(set(words)) == len(np.unique(h))
