"""Personal data in texts: patterns propose spans, checks confirm them, context adjusts scores.

Every kind has a pattern that proposes spans.  A validator then confirms or drops each
(Luhn for cards, mod 97 for IBANs, ranges of octets, counts of digits, area rules), which
sets the span's score, and words within CONTEXT characters before it raise that score.  The
base kinds (email, ip, card, phone) score above the threshold when valid; the weaker kinds
(iban, ssn, date of birth, bare phone, bare account numbers) need their checksum or their
context to pass it.

Defined cases: a null or empty text has no spans; very long texts are scanned whole, in time
linear in their length; rows that repeat are scanned one by one; positions are code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.llm.workers import lean

#: Kinds in the order of the results; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "dob", "local_phone", "account")
BASE = KINDS[:4]
THRESHOLD = 0.5
CONTEXT = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_DATE = re.compile(r"(?<![0-9])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./](?:19|20)[0-9]{2})(?![0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])")
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9.-])[0-9]{8,17}(?![A-Za-z0-9.-])")

#: Base score of a valid span, and the words that raise it when they stand shortly before.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "dob": 0.1, "local_phone": 0.3, "account": 0.1}
CONTEXT_BONUS = 0.45
CONTEXT_WORDS = {
    "email": r"e-?mail|mail|correo|courriel",
    "ip": r"ip|address|host|server",
    "card": r"card|visa|master ?card|amex|credit|carte|tarjeta|karte",
    "phone": r"phone|tel|call|mobile|fax|t[ée]l[ée]phone|tel[ée]fono|telefon",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "ssn": r"ssn|social security|security number",
    "dob": r"born|birth|dob|geboren|n[ée]e? le|nacid[oa]|nacimiento|naissance",
    "local_phone": r"phone|tel|call|mobile|fax|t[ée]l[ée]phone|tel[ée]fono|telefon",
    "account": r"account|acct|konto|kontonummer|compte|cuenta|routing|passport|pasaporte|passeport|reisepass",
}
_CONTEXT = {k: re.compile(rf"(?<!\w)(?:{v})(?!\w)", re.IGNORECASE) for k, v in CONTEXT_WORDS.items()}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Same spans as ``[A-Za-z0-9._%+-]+@`` and the domain, found from each @ outwards."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def _card_ok(s: str) -> bool:
    d = _digits(s)
    return 13 <= len(d) <= 19 and luhn(d)


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and mod97(s)


def _ssn_ok(m: re.Match) -> bool:
    return m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"


def _date_ok(s: str) -> bool:
    parts = [int(p) for p in re.split(r"[./-]", s)]
    day, month = (parts[2], parts[1]) if parts[0] > 31 else (parts[0], parts[1])
    return 1 <= day <= 31 and 1 <= month <= 12 or 1 <= month <= 31 and 1 <= day <= 12


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the proposals that their validators confirm."""
    for a, b in _emails(text):
        yield "email", a, b
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    if not _HAS_DIGIT(text):
        return
    for m in _IP.finditer(text):
        if _ip_ok(m[0]):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and _card_ok(m[0]):
            yield "card", m.start(), m.end()
    for m in _IBAN.finditer(text):
        found = m[0]
        while len(found) >= 15:  # a word after the number may have been taken for part of it
            if _iban_ok(found):
                yield "iban", m.start(), m.start() + len(found)
                break
            if " " not in found:
                break
            found = found[: found.rindex(" ")]
    for m in _SSN.finditer(text):
        if _ssn_ok(m):
            yield "ssn", m.start(), m.end()
    for m in _DATE.finditer(text):
        if _date_ok(m[0]):
            yield "dob", m.start(), m.end()
    for m in _LOCAL_PHONE.finditer(text):
        if 7 <= len(_digits(m[0])) <= 11:
            yield "local_phone", m.start(), m.end()
    for m in _ACCOUNT.finditer(text):
        yield "account", m.start(), m.end()


_HAS_DIGIT = re.compile("[0-9]").search


def find_spans(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """Spans with scores, by kind in the order of KINDS, then start.  A span of a kind that
    is not base and overlaps a span of an earlier kind is dropped."""
    found = []
    for kind, a, b in candidates(text or ""):
        score = SCORES[kind]
        if score < 1.0 and _CONTEXT[kind].search(text, max(0, a - CONTEXT), a):
            score = min(1.0, score + CONTEXT_BONUS)
        if score >= threshold:
            found.append((KINDS.index(kind), a, b, score))
    found.sort()
    kept: list[tuple[int, int, int, float]] = []
    base = len(BASE)
    taken: list[tuple[int, int]] = []
    for k, a, b, s in found:
        if k >= base and any(a < y and x < b for x, y in taken):
            continue
        taken.append((a, b))
        kept.append((k, a, b, s))
    return [(KINDS[k], a, b, s) for k, a, b, s in kept]


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id and ``found``: array of (kind, start, end, score)."""
    source = df.select(df[id_col], df[text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                rows = [[dict(zip(("kind", "start", "end", "score"), s)) for s in find_spans(t.as_py(), threshold)] for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, span)], [id_col, "found"])

    schema = T.StructType([T.StructField(id_col, source.schema[id_col].dataType), T.StructField("found", T.ArrayType(_SPAN))])
    return source.mapInArrow(lean(run), schema)


def redacted(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < at:
            at = max(at, b)
            continue
        out += (text[at:a], f"<{kind}>")
        at = b
    return "".join([*out, text[at:]])


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
