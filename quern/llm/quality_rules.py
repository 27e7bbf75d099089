"""Quality rules: text statistics, and perplexity bands from a modified Kneser-Ney model.

The model is over characters, every code point for itself (white space is one symbol), since
tables of word n-grams have no bound that a task could hold.  Spark counts the n-grams of
every document by language, and from them the continuation counts of the lower orders and
each order's counts of counts, which give every language and order its own three discounts.
Every language has a model and a band of its own, of the same order at every size of the
input.  Tasks hold a model as sorted arrays of packed n-grams.  All n-grams after one
character belong together, whatever their order, so the table is cut by language and the
character before the last; it is worked through in passes of PASS_ENTRIES n-grams (or one
such group), each of which adds the log probabilities of the characters that it knows about.
So memory has a bound, and neither the bound nor other languages change a result.

A document's perplexity is compared with its language's band, each side of which follows
from the language's own quartiles: below the first, 2 * WIDTH times its distance from the
median; above the third, the same with its distance, but WIDTH times the quartile distance
at most.

Defined cases: null and empty texts have no words and fail the base rules; a null language
is a language of its own; one row a language reaches the driver; rows that repeat are
counted and judged one by one; very long texts are worked through in slices; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import hashing as H
from quern.llm.scratch import drop, release_shuffles, stage
from quern.llm.workers import lean

#: Bits of a symbol, symbols there can be, and symbols of an n-gram: three fit a 64-bit number.
SHIFT, SYMBOLS, ORDER = 21, 0x110000, 3
#: Groups of n-grams a language, by the character before the last.
GROUPS = 256
#: N-grams of the highest order in a pass (or one group's), n-grams that a task counts before
#: it hands them on, and n-grams read at once.
PASS_ENTRIES, HELD_ENTRIES, READ_ENTRIES = 3_000_000, 1_000_000, 4_000_000
WIDTH = 3.0
#: Least reach of a band beyond its quartiles in nats, so that a language of near copies does not
#: reject the rest.
LEAST_REACH = 0.05
#: Base rules: fewer words fail, and so does a larger share (percent) of words in repeated windows.
MIN_WORDS, MAX_REPEAT, WINDOW = 50, 50, 3
SLICE = 1 << 18  # characters worked on at once

_MARKS = "#*$%&|<>"
_IS_MARK = np.zeros(128, bool)
_IS_MARK[[ord(c) for c in _MARKS]] = True
_IS_SPACE = np.zeros(128, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SPACE = 32


def symbols(points: np.ndarray) -> np.ndarray:
    """Symbols of code points: themselves, but one for all white space."""
    return np.where(_IS_SPACE[np.minimum(points, 127)], _SPACE, points).astype(np.int64)


def _slices(texts: list[str], order: int) -> Iterator[tuple[int, str, str]]:
    """(index, what stands before, piece) of each text, in pieces of SLICE characters."""
    for k, t in enumerate(texts):
        for a in range(0, len(t), SLICE):
            yield k, t[max(0, a - order + 1) : a], t[a : a + SLICE]


def gram_keys(texts: list[str], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of (text index, packed key of the symbol at a place and the order - 1 before
    it) of all characters; white space stands before a text."""
    docs: list[int] = []
    held: list[str] = []
    sizes: list[int] = []
    room = 0

    def flush():
        points = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
        s = symbols(points)
        key = np.zeros(len(s), np.int64)
        for i in range(order):
            key[i:] |= s[: len(s) - i] << (SHIFT * i)
        n = np.array(sizes)
        doc = np.repeat(np.array(docs), n + order - 1)
        ends = np.cumsum(n + order - 1)
        first = np.repeat(ends - n - order + 1, n + order - 1)
        real = np.arange(len(s)) - first >= order - 1
        return doc[real], key[real]

    for k, before, piece in _slices(texts, order):
        docs.append(k)
        held.append((" " * (order - 1) + before)[len(before) :] + piece)
        sizes.append(len(piece))
        room += len(piece)
        if room >= SLICE:
            yield flush()
            docs, held, sizes, room = [], [], [], 0
    if held:
        yield flush()


def _group(key: Column) -> Column:
    """Group of a packed n-gram, by the character before the last."""
    return F.pmod(F.shiftright(key, SHIFT).bitwiseAND(F.lit((1 << SHIFT) - 1)), F.lit(GROUPS))


def _group_of(key: np.ndarray) -> np.ndarray:
    return (key >> SHIFT & ((1 << SHIFT) - 1)) % GROUPS


def _last(key, n: int):
    return key & ((1 << (SHIFT * n)) - 1)


class KneserNey:
    """A language's sorted keys and log probabilities of each order from 1 up, and log
    backoff weights of its contexts."""

    def __init__(self, order: int, grams: list[tuple[np.ndarray, np.ndarray]], backoff: list[tuple[np.ndarray, np.ndarray]]):
        self.order, self.grams, self.backoff = order, grams, backoff

    def log_prob(self, key: np.ndarray) -> np.ndarray:
        """log P of each key's last symbol after the ones before it."""
        out, left = np.zeros(len(key)), np.arange(len(key))
        for n in range(self.order, 0, -1):
            here = _last(key[left], n)
            hit, value = _find(*self.grams[n - 1], here)
            out[left[hit]] += value[hit]
            left, here = left[~hit], here[~hit]
            if not len(left):
                return out
            known, weight = _find(*self.backoff[n - 1], here >> SHIFT)
            out[left] += np.where(known, weight, 0.0)
        out[left] -= np.log(SYMBOLS)
        return out


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, values[at]


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """D1, D2, D3+ from the numbers of n-grams with counts 1 to 4, kept within (0, r)."""
    n1, n2, n3, n4 = (max(0.5, float(n)) for n in counts_of_counts)
    y = n1 / (n1 + 2 * n2)
    d = np.array([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0.1, 0.2, 0.3], [0.9, 1.8, 2.7])


def estimate(keys: np.ndarray, counts: np.ndarray, single: tuple[np.ndarray, np.ndarray], steps: list[np.ndarray], order: int) -> KneserNey:
    """Modified Kneser-Ney from the counts of the highest order, the continuation counts of
    single symbols and each order's discounts.  Each context's probabilities sum to 1 over
    SYMBOLS.  The keys are all of the language or all in some groups of it."""
    levels = [(keys, counts)]
    for n in range(order - 1, 1, -1):  # distinct left neighbours
        levels.append(np.unique(_last(levels[-1][0], n), return_counts=True))
    levels = [single, *reversed(levels)] if order > 1 else [(keys, counts)]
    grams: list[tuple[np.ndarray, np.ndarray]] = []
    backoff: list[tuple[np.ndarray, np.ndarray]] = []
    for n, (k, c) in enumerate(levels, 1):
        rank = np.argsort(k, kind="stable")
        k, c, d = k[rank], c[rank].astype(np.float64), steps[n - 1]
        off = np.where(c >= 3, d[2], np.where(c >= 2, d[1], d[0]))
        context, at = np.unique(k >> SHIFT, return_inverse=True)
        total, freed = np.bincount(at, c), np.bincount(at, off)
        gamma = freed / total if len(k) else freed
        lower = np.exp(KneserNey(n - 1, grams, backoff).log_prob(_last(k, n - 1)))
        grams.append((k, np.log((c - off) / total[at] + gamma[at] * lower)))
        backoff.append((context, np.log(gamma)))
    return KneserNey(order, grams, backoff)


def _languages(df: DataFrame, lang_col: str) -> dict[str | None, int]:
    """The number of each language, by size and then name."""
    sizes = df.groupBy(lang_col).count().orderBy(F.col("count").desc(), F.col(lang_col).asc_nulls_last()).collect()
    return {r[0]: k for k, r in enumerate(sizes)}


def _by_language(part: pa.RecordBatch, text: int, lang: int, languages: dict) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """(number, rows, texts) of each language of a batch."""
    texts = [t or "" for t in part.column(text).to_pylist()]
    number = np.array([languages[x] for x in part.column(lang).to_pylist()], np.int64)
    for k in np.unique(number):
        rows = np.flatnonzero(number == k)
        yield int(k), rows, [texts[r] for r in rows]


def count_grams(df: DataFrame, languages: dict, text_col: str, lang_col: str, order: int) -> DataFrame:
    """(lang, key, c) of all n-grams of all documents, pre-summed in every task."""
    source = df.select(df[lang_col], df[text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged():
            for lang, parts in held.items():
                keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                held[lang] = [(keys, np.bincount(at, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64))]
            return sum(len(p[0][0]) for p in held.values())

        def rows():
            for lang, parts in held.items():
                for keys, counts in parts:
                    for k in range(0, len(keys), 100_000):
                        some = keys[k : k + 100_000]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), lang)), pa.array(some), pa.array(counts[k : k + 100_000])], ["lang", "key", "c"])

        for b in batches:
            for k in range(0, b.num_rows, 500):
                for lang, _, texts in _by_language(b.slice(k, 500), 1, 0, languages):
                    for _, key in gram_keys(texts, order):
                        held.setdefault(lang, []).append(np.unique(key, return_counts=True))
                        size += len(held[lang][-1][0])
                if size > HELD_ENTRIES:
                    size = merged()
                    if 2 * size > HELD_ENTRIES:
                        yield from rows()
                        held, size = {}, 0
        merged()
        yield from rows()

    return source.mapInArrow(lean(run), "lang long, key long, c long").groupBy("lang", "key").agg(F.sum("c").alias("c"))


class Table:
    """The counted n-grams, and what Spark derives from them: continuation counts of single
    symbols, discounts by language and order, and ranges of groups that are scored together."""

    def __init__(self, grams: DataFrame, languages: int, order: int):
        self.grams, self.order = grams, order
        levels = [grams]
        for n in range(order - 1, 0, -1):
            levels.append(levels[-1].select("lang", _last_column("key", n).alias("key")).groupBy("lang", "key").agg(F.count("*").alias("c")))
        levels.reverse()
        self.single = stage(levels[0], "symbols") if order > 1 else grams
        self.steps: list[dict[int, np.ndarray]] = []
        for level in levels:
            seen = level.groupBy("lang").agg(*(F.sum((F.col("c") == r).cast("long")).alias(f"n{r}") for r in range(1, 5))).collect()
            self.steps.append({r["lang"]: discounts([r[f"n{x}"] for x in range(1, 5)]) for r in seen})
        # (first, end, n-grams) of ranges of lang * GROUPS + group, which cover all languages
        sizes = sorted((r["unit"], r["count"]) for r in grams.groupBy((F.col("lang") * GROUPS + _group(F.col("key"))).alias("unit")).count().collect())
        self.passes, first, held = [], 0, 0
        for unit, n in sizes:
            if held and held + n > PASS_ENTRIES:
                self.passes.append((first, unit, held))
                first, held = unit, 0
            held += n
        self.passes.append((first, languages * GROUPS, held))

    def models(self, first: int, end: int, n: int) -> dict[int, KneserNey]:
        """What a pass knows: the n-grams of its groups, by language."""
        langs = F.col("lang").between(first // GROUPS, (end - 1) // GROUPS)
        unit = F.col("lang") * GROUPS + _group(F.col("key"))
        rows = self.grams.where(langs & (unit >= first) & (unit < end))
        lang, keys, counts = _columns(rows, n)
        single = self.single.where(langs)
        lang1, keys1, counts1 = _columns(single, single.count())  # at most SYMBOLS a language
        out = {}
        for k in np.unique(lang1).tolist():
            here, here1 = lang == k, lang1 == k
            out[k] = estimate(keys[here], counts[here], (keys1[here1], counts1[here1]), [s[k] for s in self.steps], self.order)
        return out


def _last_column(key: str, n: int) -> Column:
    return F.col(key).bitwiseAND(F.lit((1 << (SHIFT * n)) - 1))


def _columns(table: DataFrame, n: int) -> list[np.ndarray]:
    """lang, key, c of the ``n`` rows of a table."""
    out, at, pieces = [np.empty(n, np.int64) for _ in range(3)], 0, n // READ_ENTRIES + 1
    for p in range(pieces):
        got = (table.where(F.pmod("key", F.lit(pieces)) == p) if pieces > 1 else table).select("lang", "key", "c").toArrow()
        for x, c in zip(out, ("lang", "key", "c")):
            x[at : at + got.num_rows] = got.column(c).to_numpy()
        at += got.num_rows
    return out


def base_columns(texts: list[str]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    arrow = pa.array(texts, pa.large_string())
    h, first, _ = H.word_hashes(arrow)
    n_words = np.diff(first)
    chars, marks = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    dup = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        for a in range(0, len(t), 1 << 22):
            low = np.minimum(np.frombuffer(t[a : a + (1 << 22)].encode("utf-32-le", "surrogatepass"), np.uint32), 127)
            chars[k] += len(low) - int(_IS_SPACE[low].sum())
            marks[k] += int(_IS_MARK[low].sum())
        if "\n" in t:
            seen: set[str] = set()
            for line in t.split("\n"):
                if line in seen:
                    dup[k] += 1
                elif line.strip(" \t\n\x0b\f\r"):
                    seen.add(line)
    windows, doc = H.windows(h, first, WINDOW)
    repeat = np.zeros(len(texts), np.int64)
    if len(windows):
        own = H.mix(windows + doc.astype(H.U64) * H.U64(0x9E3779B97F4A7C15))
        _, at, times = np.unique(own, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(np.diff(first) >= WINDOW)
        begin = np.concatenate([np.arange(first[k], first[k + 1] - WINDOW + 1) for k in starts])
        twice = begin[times[at] >= 2]
        covered = np.zeros(len(h), bool)
        for i in range(WINDOW):
            covered[twice + i] = True
        repeat = H.sums(covered.astype(np.int64), first)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": marks, "n_dup_lines": dup, "n_repeat_words": repeat}


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(df: DataFrame, models: dict[int, KneserNey], units: tuple[int, int], languages: dict, order: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, text_key, language number, the base columns, characters, and the sum of the log
    probabilities of the characters that the models' groups know about."""
    shared = df.sparkSession.sparkContext.broadcast((models, languages))  # bounded by PASS_ENTRIES
    source = df.select(df[id_col], df[text_col], df[lang_col])
    first, end = units
    whole = first == 0 and end >= len(languages) * GROUPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, langs = shared.value
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                size = part.num_rows
                total, n, lang = np.zeros(size), np.zeros(size, np.int64), np.zeros(size, np.int64)
                for number, rows, texts in _by_language(part, 1, 2, langs):
                    lang[rows] = number
                    for doc, key in gram_keys(texts, order):
                        n[rows] += np.bincount(doc, minlength=len(rows))
                        if not whole:
                            unit = number * GROUPS + _group_of(key)
                            mine = (unit >= first) & (unit < end)
                            doc, key = doc[mine], key[mine]
                        if number in m and len(key):
                            # n-grams recur, so each distinct one is looked up once
                            full, at = np.unique(key, return_inverse=True)
                            total[rows] += np.bincount(doc, m[number].log_prob(full)[at], len(rows))
                texts = [t or "" for t in part.column(1).to_pylist()]
                base = base_columns(texts)
                keys = [None if whole else hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(lang), *(pa.array(base[c].astype(np.int64)) for c in NAMES), pa.array(n), pa.array(total)], [id_col, "_text", "_lang", *NAMES, "_n", "_total"])

    fields = [source.schema[id_col], T.StructField("_text", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("_lang", *NAMES, "_n")), T.StructField("_total", T.DoubleType())]
    return source.mapInArrow(lean(run), T.StructType(fields))


def perplexities(df: DataFrame, id_col: str, text_col: str, lang_col: str, order: int) -> DataFrame:
    """id, _lang, the base columns and log_ppl of every row."""
    languages = _languages(df, lang_col)
    grams = stage(count_grams(df, languages, text_col, lang_col, order), "grams")
    table = Table(grams, len(languages), order)
    parts = []
    for first, end, n in table.passes:
        docs = df
        if len(table.passes) > 1:
            here = [x for x, k in languages.items() if first // GROUPS <= k <= (end - 1) // GROUPS]
            docs = df.where(F.col(lang_col).isin([x for x in here if x is not None]) | (F.col(lang_col).isNull() & F.lit(None in here)))
        parts.append(stage(measure(docs, table.models(first, end, n), (first, end), languages, order, id_col, text_col, lang_col), "perplexities"))
        if len(table.passes) > 1:
            release_shuffles(df.sparkSession)  # and the last pass's models
    drop(grams, table.single)
    rows = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            rows = rows.unionByName(part)
        # every pass over a language has seen each of its rows once; equal rows have equal sums
        times = {}
        for first, end, _ in table.passes:
            for k in range(first // GROUPS, (end - 1) // GROUPS + 1):
                times[k] = times.get(k, 0) + 1
        seen = F.element_at(F.create_map(*(F.lit(x) for kv in sorted(times.items()) for x in kv)), F.col("_lang").cast("int"))
        rows = rows.groupBy(id_col, "_text", "_lang", *NAMES, "_n").agg(F.sum("_total").alias("_total"), F.count("*").alias("_times"))
        copies = (F.col("_times") / seen).cast("int")
        rows = rows.withColumn("_total", F.col("_total") / copies).withColumn("_times", F.explode(F.array_repeat(F.lit(1), copies)))
    return rows.select(id_col, "_lang", *NAMES, (-F.col("_total") / F.greatest("_n", F.lit(1))).alias("log_ppl"))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", width: float = WIDTH, order: int = ORDER) -> DataFrame:
    """One row per input row: id, base columns, perplexity, the band, base_failed, kept."""
    rows = perplexities(df, id_col, text_col, lang_col, order)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    quartiles = F.percentile_approx("log_ppl", [0.25, 0.5, 0.75], 10_000)
    bands = rows.where("NOT base_failed").groupBy("_lang").agg(quartiles.alias("q"))
    q1, median, q3 = (F.col("q")[k] for k in range(3))
    below = F.greatest(F.lit(LEAST_REACH), 2 * width * (median - q1))
    above = F.greatest(F.lit(LEAST_REACH), F.least(2 * width * (q3 - median), width * (q3 - q1)))
    bands = bands.select("_lang", (q1 - below).alias("low"), (q3 + above).alias("high"))
    out = rows.join(F.broadcast(bands), "_lang", "left")  # a row a language
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(True))
    return out.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"),
        F.exp("log_ppl").alias("perplexity"), F.exp("low").alias("low_perplexity"), F.exp("high").alias("high_perplexity"),
    )
