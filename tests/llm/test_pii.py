import random
import re

from quern.llm import pii


def brute(text):
    """The base spans as the patterns state them."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_base_spans_follow_the_patterns():
    rng = random.Random(5)
    bits = ["a", "Z", ".", "@", "@", "-", "1", "25", "0", " ", "é", "+", "(", "x@y.z", "10.0.0.1", "4111 1111 1111 1111", "+44 20 7946 0958", "%", ",", "\n", "300.1.1.1"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))
        got = [(k, a, b) for k, a, b, _ in pii.find_spans(text) if k in pii.BASE]
        assert got == brute(text), text


def test_checksums_and_context():
    assert [s[0] for s in pii.find_spans("pay to DE89 3704 0044 0532 0130 00 NOW please")] == ["iban"]
    assert pii.find_spans("pay to DE88 3704 0044 0532 0130 00 now") == []
    assert pii.find_spans("code 123-45-6789 end") == []
    assert [s[0] for s in pii.find_spans("her SSN is 123-45-6789.")] == ["ssn"]
    assert [s[0] for s in pii.find_spans("born on 1980-02-03 in")] == ["dob"]
    assert pii.find_spans(None) == [] == pii.find_spans("")


def test_redaction_and_long_texts():
    text = "mail a.b@c.org now"
    assert pii.redacted(text, pii.find_spans(text)) == "mail <email> now"
    assert pii.find_spans("a" * 200_000 + "@") == []
    assert pii.find_spans("1" * 50_000) == []


def test_table(spark):
    df = spark.createDataFrame([(1, "x@y.zz", "k"), (2, None, "k"), (2, "", None)], "doc_id long, text string, found string")
    rows = sorted((r["doc_id"], len(r["found"])) for r in pii.find_pii(df).collect())
    assert rows == [(1, 1), (2, 0), (2, 0)]
    assert pii.find_pii(df.limit(0)).count() == 0
