"""Katz backoff language model of order 2 or 3 with Good-Turing discounts, kept in partitioned tables.

P(w | h2 h1) = c*(h2 h1 w) / c(h2 h1) for triples seen in training, else
backoff(h2 h1) * P(w | h1); P(w | h1), where a model of order 2 starts, likewise from pairs and
backoff(h1) * P(w); P(w) =
c*(w) / N for known words, else the mass that the known ones leave, all unknown words being
one class.  c* is the Good-Turing count up to MAX_RANK and c - TAIL beyond, with discounts of
each order, so that every context keeps some mass for what it has not shown; its backoff
weight divides exactly that mass by the exact probability of all words unseen after it.  A
text's words are lower-cased (A-Z), its contexts start with begin marks, and an end token
closes it.

Words are 64-bit hashes in numpy arrays (of the word before last 40 bits, which only tell
apart what stands before the same pair).  N-grams are dealt to parts by their last word, so a
part knows the counts of its words and of all their pairs and triples; contexts are dealt by
their last word too.  Scores need two hops: what a word's part knows of a token, and for
triples it has not seen, what the context's part knows: backoff weights and counts.

A word that holds more than an eighth of a part, or 1/HOT of all tokens, is dealt by the word
before it as well; with order 3, a pair as frequent as that by all three words.  Tokens of an
n-gram of the model's order that is as frequent are scored where they are read.  Tasks hold
the counts of these (MOST of each at most, in fact far fewer).  The exchange runs in PASSES
passes over the parts, which divides the disk that shuffles need.

Defined cases: a null text is empty, and has its end token only; rows that repeat are
scored and counted one by one; without training texts every word is unknown and the end
token too; other columns are ignored; an empty table gives an empty result.
"""

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import hashing as H
from quern.llm.scratch import drop, release_shuffles, stage
from quern.llm.workers import lean, release

MAX_RANK, TAIL = 5, 0.5
HOT, MOST = 4096, 1 << 20
ORDER = 2
PART_TOKENS, MIN_PARTS, PASSES = 2_000_000, 24, 2
CHUNK_TOKENS = 1_500_000
U64 = H.U64
BEGIN, END = U64(0x8BADF00D5EED0001), U64(0x8BADF00D5EED0002)
#: Bits of the hash of the word before last that are left out.
SHORT = U64(24)
_COLUMNS = "abcdefg"
_BLOBS = "part int, kind int, chunk long, " + ", ".join(f"{c} binary" for c in _COLUMNS)
_NAMES = ["part", "kind", "chunk", *_COLUMNS]
_C1, _C2, _C3 = U64(0xD1342543DE82EF95), U64(0x9E3779B97F4A7C15), U64(0xA0761D6478BD642F)


def pair_key(w: np.ndarray, h1: np.ndarray) -> np.ndarray:
    return H.mix(w * _C1 + h1)


def triple_key(pair: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return H.mix(pair * _C2 + h2)


def context_key(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return H.mix(h1 * _C3 + h2)


def good_turing(n: list[float], k: int = MAX_RANK) -> np.ndarray:
    """Discounts of the counts 1..k from n, the numbers of types with counts 1..k + 1.  A
    count whose Good-Turing discount is no proper fraction gets an absolute one."""
    n1, n2 = n[0], n[1]
    d = n1 / (n1 + 2 * n2) if n1 > 0 else 0.5
    d = min(max(d, 0.05), 0.95)
    out = np.array([(r - d) / r for r in range(1, k + 1)])
    if n1 > 0:
        common = (k + 1) * n[k] / n1
        for r in range(1, k + 1):
            if n[r - 1] > 0 and n[r] > 0 and common < 1:
                good = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common)
                if 0 < good < 1:
                    out[r - 1] = good
    return out


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    c = c.astype(np.float64)
    small = np.clip(c, 1, len(d)).astype(np.int64)
    return np.where(c <= len(d), d[small - 1] * c, c - TAIL)


def _tokens(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every token of the texts, end tokens included: its word, the word before, the one before
    that (40 bits; 0 in a model of order 2), and its text's index."""
    h, first, _ = H.word_hashes(texts, lower=True)
    w = np.insert(h, first[1:], END)
    h1 = np.insert(h, first[:-1], BEGIN)
    if order == 2:
        return w, h1, np.zeros(len(w), U64), np.repeat(np.arange(len(first) - 1), np.diff(first) + 1)
    h2 = np.empty_like(h1)
    h2[1:] = h1[:-1]
    h2[first[:-1] + np.arange(len(first) - 1)] = BEGIN
    return w, h1, h2 >> SHORT, np.repeat(np.arange(len(first) - 1), np.diff(first) + 1)


# -- arrays -------------------------------------------------------------------------------------


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each group starts in it."""
    order = np.argsort(key)
    s = key[order]
    return order, np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)


def _sums(order: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values[order], starts) if len(starts) else values[:0]


def _each(order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The group of every entry."""
    at = np.empty(len(order), np.int64)
    at[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    return at


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted are among the sorted keys, and their values, else 0.  Sorting them
    first makes neighbours of the places that are looked at."""
    if not len(keys) or not len(wanted):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), values.dtype)
    order = np.argsort(wanted)
    s = wanted[order]
    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
    same = keys[at] == s
    hit, value = np.empty(len(s), bool), np.empty(len(s), values.dtype)
    hit[order] = same
    value[order] = np.where(same, values[at], values.dtype.type(0))
    return hit, value


class Few:
    """Sorted keys, few enough to be looked up through a table of their first 20 bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        slot = (keys >> U64(44)).astype(np.int64)
        self.table = np.full(1 << 20, -1, np.int32)
        self.table[slot[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        self.rest = np.flatnonzero(self.table[slot] != np.arange(len(keys)))  # behind another in their slot

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys) or not len(wanted):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted), self.values.dtype)
        if len(self.rest) > 200:
            return _find(self.keys, self.values, wanted)
        at = self.table[(wanted >> U64(44)).astype(np.int64)]
        hit = self.keys[at] == wanted
        for k in self.rest:
            more = wanted == self.keys[k]
            at[more] = k
            hit |= more
        return hit, np.where(hit, self.values[at], self.values.dtype.type(0))

    def __reduce__(self):
        return Few, (self.keys, self.values)


def _starts(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _small(n: np.ndarray) -> bytes:
    """Counts, a byte each where all fit."""
    return n.astype(np.uint8 if not len(n) or n.max() < 256 else np.uint32).tobytes()


def _counts_of(blob: bytes, size: int) -> np.ndarray:
    return np.frombuffer(blob, np.uint8 if len(blob) == size else np.uint32).astype(np.int64)


def _runs(x: np.ndarray, starts: np.ndarray | None = None) -> tuple[bytes, bytes]:
    starts = _starts(x) if starts is None else starts
    return x[starts].tobytes(), _small(np.diff(np.append(starts, len(x))))


def _unrun(values: bytes, runs: bytes) -> np.ndarray:
    u = np.frombuffer(values, U64)
    return np.repeat(u, _counts_of(runs, len(u)))


def _five(x: np.ndarray) -> bytes:
    """The low 40 bits of every number; nothing where all are 0."""
    if not x.any():
        return b""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unfive(blob: bytes, size: int) -> np.ndarray:
    out = np.zeros((size, 8), np.uint8)
    if not len(blob):
        return out.view(U64).ravel()
    out[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(U64)


def _deal(part: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the entries by part, then by key, and each part's range in it."""
    order = np.argsort(key)
    order = order[np.argsort(part[order].astype(np.uint16 if not len(part) or part.max() < 65_536 else np.int64), kind="stable")]
    starts = _starts(part[order]) if len(part) else np.zeros(0, np.int64)
    return order, list(zip(part[order][starts].tolist(), starts.tolist(), np.append(starts[1:], len(part)).tolist()))


def _row(part: int, kind: int, chunk: int, *blobs: bytes) -> tuple:
    return (part, kind, chunk, *blobs, *[None] * (len(_COLUMNS) - len(blobs)))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * len(_COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], _NAMES)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES).astype({"part": "int32", "kind": "int32", "chunk": "int64"})


def _released(run: Callable) -> Callable:
    """A function for applyInPandas that gives memory back after each group."""

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        out = run(pdf)
        del pdf
        release(cycles=False)
        return out

    return group


# -- the model --------------------------------------------------------------------------------------


@dataclass
class Frequent:
    """Counts of the words, pairs and triples that are frequent."""

    words: Few
    pairs: Few  # by pair_key; with order 3 only
    pair: tuple[np.ndarray, np.ndarray]  # (w, h1) of the pairs, in their order
    contexts: Few  # counts of frequent words as contexts, the begin mark's among them
    parts: int
    order: int

    def keys(self, w: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the tokens' pairs, and of their n-grams of the model's order; and their parts."""
        pair = pair_key(w, h1)
        triple = triple_key(pair, h2) if self.order > 2 else pair
        hot, _ = self.words.find(w)
        key = np.where(hot, pair, w)
        if self.order > 2:
            both = np.flatnonzero(hot)
            more, _ = self.pairs.find(pair[both])
            key[both[more]] = triple[both[more]]
        return pair, triple, (H.mix(key ^ U64(0xA5A5)) % U64(self.parts)).astype(np.int64)

    def part_of_context(self, h1: np.ndarray, h2: np.ndarray | None = None) -> np.ndarray:
        key = h1
        if h2 is not None and self.order > 2:
            hot, _ = self.contexts.find(h1)
            key = np.where(hot, context_key(h1, h2), h1)
        return (H.mix(key ^ U64(0xC3C3)) % U64(self.parts)).astype(np.int64)


@dataclass
class Katz:
    n: int  # training tokens
    v: int  # distinct ones
    documents: int
    unknown: float
    discounts: list[np.ndarray]  # of words, pairs, triples
    frequent: Frequent
    grams: Few  # counts of frequent n-grams of the model's order
    backoff: Few  # of frequent words as contexts
    tables: list[DataFrame]  # by pass, a row a part: words, and their pairs' and triples' counts
    contexts: DataFrame  # a row a part: contexts, counts and backoff weights


def _chunks(batches: Iterator[pa.RecordBatch], text: int, order: int) -> Iterator[tuple[pa.RecordBatch, tuple]]:
    """Rows with their tokens, CHUNK_TOKENS or so at a time."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            sizes = b.column(text).slice(at, 4000)
            length = np.cumsum(np.diff(H.buffers(sizes)[1]))
            n = max(1, int(np.searchsorted(length, 4 * CHUNK_TOKENS, "right")))
            part = b.slice(at, n)
            yield part, _tokens(part.column(text), order)
            at += part.num_rows


def _word_table(source: DataFrame) -> DataFrame:
    """Words and their counts, a row a part, with the numbers of words of each small count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def rows():
            w, n = (np.concatenate(x) for x in zip(*held))
            order, starts = _groups(w)
            w, n = w[order][starts], _sums(order, starts, n)
            order, ranges = _deal((H.mix(w ^ U64(0xA5A5)) % U64(MIN_PARTS)).astype(np.int64), w)
            w, n = w[order], n[order]
            return _batch([_row(p, TABLE, 0, w[x:y].tobytes(), n[x:y].astype(np.int64).tobytes()) for p, x, y in ranges])

        for _, (w, _, _, _) in _chunks(batches, 0, 2):
            order, starts = _groups(w)
            held.append((w[order][starts], np.diff(np.append(starts, len(order)))))
            size += len(starts)
            if size > 2_000_000:
                yield rows()
                held, size = [], 0
        if size:
            yield rows()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        w = np.concatenate([np.frombuffer(a, U64) for a in pdf["a"]])
        order, starts = _groups(w)
        n = _sums(order, starts, np.concatenate([np.frombuffer(b, np.int64) for b in pdf["b"]]))
        w = w[order][starts]
        seen = np.bincount(np.minimum(n, MAX_RANK + 2), minlength=MAX_RANK + 3).astype(np.int64)
        more = n[n > MAX_RANK]
        return _frame([_row(int(pdf["part"].iloc[0]), TABLE, 0, w.tobytes(), n.tobytes(), seen.tobytes(), np.array([n.sum(), len(n), more.sum(), len(more)], np.int64).tobytes())])

    return source.mapInArrow(lean(run), _BLOBS).groupBy("part").applyInPandas(_released(merge), _BLOBS)


def _often(table: DataFrame, least: float, kind: str) -> tuple[np.ndarray, ...]:
    """Hashes and counts of the words (a, n), or n-grams (w, h1, h2, n), that occur ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                if kind == "words":
                    w, n = np.frombuffer(r["a"], U64), np.frombuffer(r["b"], np.int64)
                    h1 = h2 = np.zeros(len(w), U64)
                else:
                    w, h1, h2, n = _load(r)
                at = np.flatnonzero(n >= least)
                yield pa.RecordBatch.from_arrays([*(pa.array(H.signed(x[at])) for x in (w, h1, h2)), pa.array(n[at].astype(np.int64))], ["w", "h1", "h2", "n"])

    got = table.mapInArrow(lean(run), "w long, h1 long, h2 long, n long").toArrow()  # MOST at most
    return *(got.column(c).to_numpy().view(U64) for c in ("w", "h1", "h2")), got.column("n").to_numpy()


def _pair_counts(source: DataFrame, pick: Callable) -> DataFrame:
    """(a, b, n): summed counts of the pairs that ``pick`` takes from the tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (w, h1, _, _) in _chunks(batches, 0, 2):
            a, b = pick(w, h1)
            order, starts = _groups(pair_key(a, b))
            at, n = order[starts], np.diff(np.append(starts, len(order)))
            yield pa.RecordBatch.from_arrays([*(pa.array(H.signed(x[at])) for x in (a, b)), pa.array(n.astype(np.int64))], ["a", "b", "n"])

    return source.mapInArrow(lean(run), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _u64(rows, name: str) -> np.ndarray:
    return np.array([r[name] for r in rows], np.int64).view(U64)


def _sorted(keys: np.ndarray, values: np.ndarray, *columns: np.ndarray) -> tuple:
    order = np.argsort(keys)
    return Few(keys[order], values[order]), tuple(c[order] for c in columns)


TABLE, TOKENS, NEEDS, SUMS, LOWER, UPPER, WEIGHTS, ROWS = range(8)


def _table_exchange(source: DataFrame, f, g: int, passes: int) -> DataFrame:
    """The counted triples of the parts of pass g, a row a part; ``f`` is a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Frequent = f.value
        for _, (w, h1, h2, _) in _chunks(batches, 0, q.order):
            pair, triple, part = q.keys(w, h1, h2)
            mine = np.flatnonzero(part % passes == g)
            order, starts = _groups(triple[mine])
            n = np.diff(np.append(starts, len(order)))
            at = mine[order[starts]]
            order, ranges = _deal(part[at], w[at])
            at, n = at[order], n[order]
            rows = [_row(p, TABLE, 0, *_runs(w[at[x:y]]), h1[at[x:y]].tobytes(), _five(h2[at[x:y]]), _small(n[x:y])) for p, x, y in ranges]
            if rows:
                yield _batch(rows)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        q: Frequent = f.value
        w = np.concatenate([_unrun(a, b) for a, b in zip(pdf["a"], pdf["b"])])
        h1 = np.concatenate([np.frombuffer(c, U64) for c in pdf["c"]])
        h2 = np.concatenate([_unfive(d, len(c) // 8) for c, d in zip(pdf["c"], pdf["d"])])
        n = np.concatenate([_counts_of(e, len(c) // 8) for c, e in zip(pdf["c"], pdf["e"])])
        pair = pair_key(w, h1)
        order, starts = _groups(triple_key(pair, h2) if q.order > 2 else pair)
        at, n = order[starts], _sums(order, starts, n)
        w, h1, h2, pair = w[at], h1[at], h2[at], pair[at]
        # in the order of words, then of the words before; equal pairs side by side, nearly always
        word = _each(*_groups(w))
        order = np.argsort((word.astype(U64) << U64(40)) | (h1 >> SHORT))
        w, h1, h2, n, pair = w[order], h1[order], h2[order], n[order], pair[order]
        o, s = _groups(pair)
        whole = ~q.pairs.find(pair[o[s]])[0]  # frequent pairs are in several parts
        pairs = _sums(o, s, n)[whole]
        seen = [np.bincount(np.minimum(x, MAX_RANK + 2), minlength=MAX_RANK + 3).astype(np.int64) for x in (pairs, n)]
        return _frame([_row(int(pdf["part"].iloc[0]), TABLE, 0, *_runs(w), *_runs(h1, _starts(w, h1)), _five(h2), _small(n), np.stack(seen).tobytes())])

    return source.mapInArrow(lean(run), _BLOBS).groupBy("part").applyInPandas(_released(merge), _BLOBS)


def _load(r) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """w, h1, h2, n of a part's row."""
    w = _unrun(r["a"], r["b"])
    return w, _unrun(r["c"], r["d"]), _unfive(r["e"], len(w)), _counts_of(r["f"], len(w))


def _known(f: Frequent, w: np.ndarray, h1: np.ndarray, n: np.ndarray) -> tuple:
    """Of a part's triples: sorted words and counts; sorted pair keys and counts; each triple's
    pair count, and whether it is the first of its pair."""
    order, starts = _groups(w)
    words, c = w[order][starts], _sums(order, starts, n)
    hot, often = f.words.find(words)
    pair = pair_key(w, h1)
    order, starts = _groups(pair)
    keys, n2 = pair[order][starts], _sums(order, starts, n)
    heavy, many = f.pairs.find(keys)
    n2 = np.where(heavy, many, n2)
    first = np.zeros(len(w), bool)
    first[order[starts][~heavy]] = True  # frequent pairs are told elsewhere
    return words, np.where(hot, often, c), keys, n2, n2[_each(order, starts)], first


def _contexts(table: DataFrame, f, m: dict, heavy: DataFrame, g: int, passes: int) -> DataFrame:
    """Contexts of pass g: hashes, counts, and backoff weights."""
    d1, d2, d3 = [*m["discounts"], None][:3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Frequent = f.value
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                if r["kind"] == TABLE:
                    w, h1, h2, n = _load(r)
                    words, c, _, _, n2, first = _known(q, w, h1, n)
                    lower = (w[first], h1[first], n2[first])
                    c1 = c[np.searchsorted(words, lower[0])]
                else:  # the frequent pairs
                    w = h1 = h2 = np.zeros(0, U64)
                    n = n2 = np.zeros(0, np.int64)
                    lower = (*q.pair, q.pairs.values)
                    c1 = q.words.find(lower[0])[1]
                rows = []
                # of pairs: sums by the word before
                mine = q.part_of_context(lower[1]) % passes == g
                h, x, p = lower[1][mine], lower[2][mine].astype(np.float64), (discounted(c1[mine], d1) / m["n"])
                order, starts = _groups(h)
                if len(h):
                    key, sums = h[order][starts], [_sums(order, starts, y) for y in (x, discounted(x, d2), p)]
                    order, ranges = _deal(q.part_of_context(key), key)
                    key, sums = key[order], [y[order] for y in sums]
                    rows += [_row(t, LOWER, 0, key[x:y].tobytes(), *(s[x:y].tobytes() for s in sums)) for t, x, y in ranges]
                if q.order > 2:  # of triples: each with its pair's count
                    part = q.part_of_context(h1, h2)
                    at = np.flatnonzero(part % passes == g)
                    order, ranges = _deal(part[at], h1[at])
                    at = at[order]
                    rows += [_row(t, UPPER, 0, *_runs(h1[at[x:y]]), _five(h2[at[x:y]]), _small(n[at[x:y]]), _small(n2[at[x:y]])) for t, x, y in ranges]
                if rows:
                    yield _batch(rows)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        q: Frequent = f.value
        low, up = pdf[pdf["kind"] == LOWER], pdf[pdf["kind"] == UPPER]
        h = np.concatenate([np.zeros(0, U64), *(np.frombuffer(a, U64) for a in low["a"])])
        order, starts = _groups(h)
        h, (count, kept, p) = h[order][starts], (_sums(order, starts, np.concatenate([np.zeros(0), *(np.frombuffer(x, np.float64) for x in low[c])])) for c in "bcd")
        weight = (1.0 - kept / count) / np.maximum(1.0 - p, 1e-300)
        each = [_unrun(a, b) for a, b in zip(up["a"], up["b"])]
        h1 = np.concatenate([np.zeros(0, U64), *each])
        h2 = np.concatenate([np.zeros(0, U64), *(_unfive(c, len(x)) for c, x in zip(up["c"], each))])
        n3, n2 = (np.concatenate([np.zeros(0, np.int64), *(_counts_of(y, len(x)) for y, x in zip(up[col], each))]) for col in "de")
        often, total = q.contexts.find(h1)
        total = np.where(often, total, _find(h, count, h1)[1])
        order, starts = _groups(context_key(h1, h2))
        at = order[starts]
        c = _sums(order, starts, n3.astype(np.float64))
        kept = _sums(order, starts, discounted(n3, d3)) if len(n3) else c
        p = _sums(order, starts, discounted(n2, d2) / np.maximum(total, 1)) if len(n3) else c
        value = _log(c) + _log((1.0 - kept / c) / np.maximum(1.0 - p, 1e-300)) if len(c) else c
        h1, h2 = h1[at], h2[at]
        order = np.argsort(h1)
        h1, h2, value = h1[order], h2[order], value[order]
        return _frame([_row(int(pdf["part"].iloc[0]), WEIGHTS, 0, h.tobytes(), count.tobytes(), weight.tobytes(), *(_runs(h1) if len(h1) else (b"", b"")), _five(h2), value.astype(np.float32).tobytes())])

    return table.unionByName(heavy).mapInArrow(lean(run), _BLOBS).groupBy("part").applyInPandas(_released(merge), _BLOBS)


def _frequent_contexts(contexts: DataFrame, f) -> Few:
    """Backoff weights of the frequent words as contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Frequent = f.value
        for b in batches:
            for r in b.to_pylist():
                h, weight = np.frombuffer(r["a"], U64), np.frombuffer(r["c"], np.float64)
                hot, _ = q.contexts.find(h)
                yield pa.RecordBatch.from_arrays([pa.array(H.signed(h[hot])), pa.array(weight[hot])], ["h", "x"])

    got = contexts.select("a", "c").mapInArrow(lean(run), "h long, x double").toArrow()  # MOST at most
    return _sorted(got.column("h").to_numpy().view(U64), got.column("x").to_numpy())[0]


def fit(docs: DataFrame, text_col: str = "text", order: int = ORDER, passes: int = PASSES, hot: int = HOT, part_tokens: int = PART_TOKENS) -> Katz:
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    source = docs.select(text_col)
    words = stage(_word_table(source), "words")
    release_shuffles(spark)
    seen, sums = np.zeros((order, MAX_RANK + 3), np.int64), np.zeros(4, np.int64)
    for r in words.select("c", "d").collect():  # MIN_PARTS rows
        seen[0] += np.frombuffer(r["c"], np.int64)
        sums += np.frombuffer(r["d"], np.int64)
    n, v = int(sums[0]), int(sums[1])
    d1 = good_turing([float(x) for x in seen[0, 1 : MAX_RANK + 2]])
    kept = float((seen[0, 1 : MAX_RANK + 1] * d1 * np.arange(1, MAX_RANK + 1)).sum() + sums[2] - TAIL * sums[3])
    parts = max(MIN_PARTS, -(-n // part_tokens))
    least = max(2.0, min(n / hot, part_tokens / 8), n / MOST)
    top, _, _, count = _often(words, least, "words")
    often, _ = _sorted(top, count)
    documents = docs.count()  # each has one end token
    drop(words)
    begin = [BEGIN] if documents else []
    before, _ = _sorted(np.append(often.keys, np.array(begin, U64)), np.append(often.values, [documents] * len(begin)).astype(np.int64))
    heavy = []
    if order > 2 and len(top):
        heavy = _pair_counts(source, lambda w, h1: _where(often.find(w)[0] & before.find(h1)[0], w, h1)).where(F.col("n") >= least).collect()
    pw, ph = _u64(heavy, "a"), _u64(heavy, "b")
    pairs, pair = _sorted(pair_key(pw, ph), np.array([r["n"] for r in heavy], np.int64), pw, ph)
    frequent = Frequent(often, pairs, pair, before, int(parts), order)
    f = spark.sparkContext.broadcast(frequent)  # bounded by MOST

    tables = []
    for g in range(passes):
        tables.append(stage(_table_exchange(source, f, g, passes), "n-grams"))
        release_shuffles(spark)
    table = tables[0]
    for t in tables[1:]:
        table = table.unionByName(t)
    for r in table.select("g").toLocalIterator():  # a row a part
        seen[1:] += np.frombuffer(r["g"], np.int64).reshape(2, -1)[: order - 1]
    np.add.at(seen[1], np.minimum(pairs.values, MAX_RANK + 2), 1)
    discounts = [good_turing([float(x) for x in seen[k, 1 : MAX_RANK + 2]]) for k in range(order)]
    w, h1, h2, count = _often(table, least, "n-grams")
    key = pair_key(w, h1)
    grams, _ = _sorted(triple_key(key, h2) if order > 2 else key, count)
    m = {"n": n, "discounts": discounts}
    extra = spark.createDataFrame([_row(0, ROWS, 0)] if len(pw) else [], _BLOBS)
    weights, rounds = [], passes if order > 2 else 1  # those of pairs are small
    for g in range(rounds):
        weights.append(stage(_contexts(table, f, m, extra, g, rounds), "contexts"))
        release_shuffles(spark)
    contexts = weights[0]
    for t in weights[1:]:
        contexts = contexts.unionByName(t)
    return Katz(n, v, documents, 1.0 - kept / n if n else 1.0, discounts, frequent, grams, _frequent_contexts(contexts, f), tables, contexts)


def _where(mask: np.ndarray, *columns: np.ndarray) -> tuple:
    return tuple(c[mask] for c in columns)


def _log(x: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(x, 1e-300))


# -- scores ----------------------------------------------------------------------------------------------


def _doc_sums(doc: np.ndarray, c: np.ndarray, score: np.ndarray, m: dict) -> tuple[bytes, bytes, bytes, bytes]:
    """Texts; tokens and known tokens; base score; score: sums over a chunk's tokens."""
    n = np.bincount(doc)
    u = np.flatnonzero(n)
    known, base, total = np.bincount(doc, c > 0), np.bincount(doc, np.log10((c + 1.0) / (m["n"] + m["v"] + 1.0))), np.bincount(doc, score)
    return u.astype(np.uint32).tobytes(), np.stack([n[u], known[u].astype(np.int64)]).astype(np.uint32).tobytes(), base[u].tobytes(), total[u].tobytes()


def _token_exchange(source: DataFrame, f, m: dict, g: int, passes: int) -> DataFrame:
    """Tokens of pass g by part, with the ids and text keys of each chunk's rows and the
    sums of the tokens that need no part."""
    top = m["discounts"][-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        q: Frequent = f.value
        chunk = TaskContext.get().partitionId() << 32
        for rows_of, (w, h1, h2, doc) in _chunks(batches, 1, q.order):
            home = int(H.mix(np.array([chunk], U64))[0] % U64(q.parts))
            ids = rows_of.column(0).to_pylist()
            keys = b"".join(hashlib.blake2b((t or "").encode(), digest_size=16).digest() for t in rows_of.column(1).to_pylist())
            rows = [_row(home, ROWS, chunk, np.array([i or 0 for i in ids], np.int64).tobytes(), np.array([i is None for i in ids], np.uint8).tobytes(), keys)]
            pair, triple, part = q.keys(w, h1, h2)
            mine = np.flatnonzero(part % passes == g)
            heavy, n = m["grams"].find(triple[mine])
            if heavy.any():
                at = mine[heavy]
                c = q.words.find(w[at])[1]
                own = c if q.order == 2 else q.pairs.find(pair[at])[1]
                score = _log(discounted(n[heavy], top)) - np.where(w[at] == END, 0.0, _log(own))
                rows.append(_row(home, SUMS, chunk, *_doc_sums(doc[at], c, score, m)))
                mine = mine[~heavy]
            order, ranges = _deal(part[mine], w[mine])
            at = mine[order]
            texts = doc[at].astype(np.uint16 if rows_of.num_rows <= 65_536 else np.uint32)
            rows += [_row(p, TOKENS, chunk, *_runs(w[at[x:y]]), h1[at[x:y]].tobytes(), _five(h2[at[x:y]]), texts[x:y].tobytes()) for p, x, y in ranges]
            yield _batch(rows)
            chunk += 1

    return source.mapInArrow(lean(run), _BLOBS)


def _together(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours that have about ``most`` entries together."""
    first, held = 0, 0
    for k, n in enumerate(sizes):
        if held and held + n > most:
            yield first, k
            first, held = k, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def _score_part(f, m: dict) -> Callable:
    d1, d2, d3 = [*m["discounts"], None][:3]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q: Frequent = f.value
        stored, tokens = pdf[pdf["kind"] == TABLE], pdf[pdf["kind"] == TOKENS]
        out = list(pdf[pdf["kind"].isin([ROWS, SUMS])].itertuples(index=False, name=None))
        words, counts, keys, pairs = q.words.keys[:0], q.words.values[:0], np.zeros(0, U64), np.zeros(0, np.int64)
        triples, n = np.zeros(0, U64), np.zeros(0, np.int64)
        for _, r in stored.iterrows():  # one at most
            w, h1, h2, n = _load(r)
            words, counts, keys, pairs, _, _ = _known(q, w, h1, n)
            if q.order > 2:
                triples = triple_key(pair_key(w, h1), h2)
                order = np.argsort(triples)
                triples, n = triples[order], n[order]
            del w, h1, h2
        chunks, blobs = tokens["chunk"].to_numpy(), {c: list(tokens[c]) for c in "abcde"}
        for a, b in _together([len(x) // 8 for x in blobs["c"]], 2_000_000):
            w = np.concatenate([_unrun(x, y) for x, y in zip(blobs["a"][a:b], blobs["b"][a:b])])
            h1 = np.concatenate([np.frombuffer(x, U64) for x in blobs["c"][a:b]])
            sizes = [len(x) // 8 for x in blobs["c"][a:b]]
            h2 = np.concatenate([_unfive(x, k) for x, k in zip(blobs["d"][a:b], sizes)])
            doc = np.concatenate([np.frombuffer(x, np.uint16 if len(x) == 2 * k else np.uint32).astype(np.int64) for x, k in zip(blobs["e"][a:b], sizes)])
            hot, often = q.words.find(w)
            c = np.where(hot, often, _find(words, counts, w)[1])
            pair = pair_key(w, h1)
            heavy, many = q.pairs.find(pair)
            n2 = np.where(heavy, many, _find(keys, pairs, pair)[1])
            single = np.where(c > 0, discounted(np.maximum(c, 1), d1) / max(1, m["n"]), m["unknown"])
            score = np.where(n2 > 0, _log(discounted(np.maximum(n2, 1), d2)), _log(single))
            seen, own = n2 > 0, c
            if q.order > 2:
                seen, n3 = _find(triples, n, triple_key(pair, h2))
                score, own = np.where(seen, _log(discounted(np.maximum(n3, 1), d3)), score), n2
            # this is the next token's context and divides by its count; undone where that is not seen
            score -= np.where((own > 0) & (w != END), _log(own), 0.0)
            edges = np.cumsum([0, *sizes])
            for k in range(b - a):
                x, y = edges[k], edges[k + 1]
                out.append(_row(-1, SUMS, int(chunks[a + k]), *_doc_sums(doc[x:y], c[x:y], score[x:y], m)))
            # what a context's part is asked comes from all these chunks together
            open_ = np.flatnonzero(~seen)
            order, ranges = _deal(q.part_of_context(h1[open_], h2[open_]), h1[open_])
            open_ = open_[order]
            which = (np.searchsorted(edges, open_, "right") - 1).astype(np.uint16 if b - a < 65_536 else np.uint32)
            names = chunks[a:b].astype(np.int64).tobytes()
            for p, i, j in ranges:
                at = open_[i:j]
                out.append(_row(p, NEEDS, 0, *_runs(h1[at]), _five(h2[at]), (n2[at] > 0).astype(np.uint8).tobytes(), doc[at].astype(np.uint32).tobytes(), which[i:j].tobytes(), names))
        return _frame(out)

    return run


def _weigh(f, m: dict) -> Callable:
    """What contexts add to tokens whose n-grams were not seen: their count times backoff weight;
    with order 3, besides, the count of the word before where the pair was seen, else its
    backoff weight."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, backoff = f.value, m["backoff"]
        h, count, weight, keys, value = np.zeros(0, U64), np.zeros(0), np.zeros(0), np.zeros(0, U64), np.zeros(0, np.float32)
        for _, r in pdf[pdf["kind"] == WEIGHTS].iterrows():  # one at most
            h, count, weight = np.frombuffer(r["a"], U64), np.frombuffer(r["b"], np.float64), np.frombuffer(r["c"], np.float64)
            if q.order > 2:
                value = np.frombuffer(r["g"], np.float32)
                keys = context_key(_unrun(r["d"], r["e"]), _unfive(r["f"], len(value)))
                order = np.argsort(keys)
                keys, value = keys[order], value[order]
        out, need = [], pdf[pdf["kind"] == NEEDS]
        blobs = {c: list(need[c]) for c in "abcdefg"}
        sizes = [len(x) for x in blobs["d"]]
        for a, b in _together(sizes, 2_000_000):
            h1 = np.concatenate([_unrun(x, y) for x, y in zip(blobs["a"][a:b], blobs["b"][a:b])])
            doc = np.concatenate([np.frombuffer(x, np.uint32) for x in blobs["e"][a:b]])
            chunk = np.concatenate([np.frombuffer(g, np.int64)[np.frombuffer(x, np.uint16 if len(x) == 2 * k else np.uint32)] for g, x, k in zip(blobs["g"][a:b], blobs["f"][a:b], sizes[a:b])])
            often, n1 = q.contexts.find(h1)
            known, local = _find(h, count, h1)
            n1 = np.where(often, n1, local)
            x = np.where(often, backoff.find(h1)[1], _find(h, weight, h1)[1])
            if q.order > 2:
                h2 = np.concatenate([_unfive(y, k) for y, k in zip(blobs["c"][a:b], sizes[a:b])])
                paired = np.concatenate([np.frombuffer(y, np.uint8) for y in blobs["d"][a:b]]) > 0
                got = _find(keys, value, context_key(h1, h2))[1].astype(np.float64)
                got += np.where(paired, -_log(n1), np.where(often | known, _log(x), 0.0))
            else:
                got = np.where(often | known, _log(n1) + _log(x), 0.0)
            order = np.argsort(chunk, kind="stable")
            starts = np.append(_starts(chunk[order]), len(order))
            for i, j in zip(starts, starts[1:]):
                at = order[i:j]
                u = np.flatnonzero(np.bincount(doc[at]))
                out.append(_row(-1, SUMS, int(chunk[at[0]]), u.astype(np.uint32).tobytes(), np.zeros((2, len(u)), np.uint32).tobytes(), np.zeros(len(u)).tobytes(), np.bincount(doc[at], got[at])[u].tobytes()))
        return _frame(out)

    return run


def _gather(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sums of a chunk's rows."""
    head = pdf[pdf["kind"] == ROWS].iloc[0]
    ids, null = np.frombuffer(head["a"], np.int64), np.frombuffer(head["b"], np.uint8).astype(bool)
    size = len(ids)
    n, known, base, score = np.zeros(size), np.zeros(size), np.zeros(size), np.zeros(size)
    for a, b, c, d in zip(*(pdf[pdf["kind"] == SUMS][x] for x in "abcd")):
        u = np.frombuffer(a, np.uint32)
        k = np.frombuffer(b, np.uint32).reshape(2, -1)
        n[u] += k[0]
        known[u] += k[1]
        base[u] += np.frombuffer(c, np.float64)
        score[u] += np.frombuffer(d, np.float64)
    keys = [head["c"][16 * k : 16 * k + 16] for k in range(size)]
    return pd.DataFrame({"id": pd.Series(ids).astype("Int64").mask(null), "key": keys, "n": n.astype(np.int64), "known": known.astype(np.int64), "base": base, "score": score})


def score(model: Katz, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score, score of every row (log10)."""
    spark, passes = docs.sparkSession, len(model.tables)
    m = {"n": model.n, "v": model.v, "unknown": model.unknown, "discounts": model.discounts, "grams": model.grams, "backoff": model.backoff}
    f = spark.sparkContext.broadcast(model.frequent)  # bounded by MOST
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sums = []
    for g in range(passes):
        dealt = _token_exchange(source, f, m, g, passes).unionByName(model.tables[g])
        scored = stage(dealt.groupBy("part").applyInPandas(_released(_score_part(f, m)), _BLOBS), "scored")
        release_shuffles(spark)
        asked = scored.where(f"kind = {NEEDS}").unionByName(model.contexts)
        backed = stage(asked.groupBy("part").applyInPandas(_released(_weigh(f, m)), _BLOBS), "backed")
        known = scored.where(f"kind IN ({SUMS}, {ROWS})").unionByName(backed)
        sums.append(stage(known.groupBy("chunk").applyInPandas(_gather, "id long, key binary, n long, known long, base double, score double"), "sums"))
        drop(scored, backed)
        release_shuffles(spark)
    total = sums[0]
    for t in sums[1:]:
        total = total.unionByName(t)
    begin = math.log10(model.documents) if model.documents else 0.0
    # rows with the same id and text have the same sums; each pass has seen every row once
    out = total.groupBy("id", "key").agg((F.count("*") / passes).cast("int").alias("times"), *(F.sum(c).alias(c) for c in ("n", "known", "base", "score")))
    whole = [(F.col(c) / F.col("times")).cast("long").alias(a) for c, a in (("n", "n_tokens"), ("known", "n_known"))]
    out = out.select(F.col("id").alias(id_col), "times", *whole, (F.col("base") / F.col("times")).alias("base_score"), (F.col("score") / F.col("times") - begin).alias("score"))
    return out.withColumn("times", F.explode(F.array_repeat(F.lit(1), F.col("times")))).drop("times")
