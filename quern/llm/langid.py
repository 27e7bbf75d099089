"""Language identification: known words first, then ever shorter character n-grams.

The model is fitted on a sample of labelled documents, DOCS_PER_LANGUAGE a language at
most (by a hash of id and text, so reruns agree), and holds per language the log
frequencies of all words that the sample has MIN_COUNT times or more in a language, and of
all its character n-grams.  A word that the model knows scores by its log frequency in each
language.  An unknown word scores by its character n-grams of MAX_N characters; if none is
known, by those one shorter, and so on down to single characters.  Words and n-grams are
64-bit hashes in sorted arrays; what one language has shown is stored apart from the others,
so the model grows with the sample, not with its number of languages squared.

Defined cases: a text that is null or has no letter is ``und`` with score 0; documents with
a null language teach nothing; a null id counts as the empty string for the split; rows
that repeat are judged one by one; of languages that score the same the first by code point
is taken; without any labelled document everything is ``und``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import hashing as H
from quern.llm.scratch import drop, stage
from quern.llm.workers import lean

DOCS_PER_LANGUAGE = 3000
#: A word seen less often in a language is not known in it.
MIN_COUNT = 2
MAX_N = 4
#: A word or n-gram that a language has not shown counts as this many occurrences.
FLOOR = 0.1
#: Words that a posterior counts at most, so that long texts do not all score 1.
EVIDENCE = 12.0
#: Scores that a task keeps of words it has met (words x languages), entries that it counts before
#: it hands them on, and scores worked on at once.
CACHE, HELD, AT_ONCE = 800_000, 100_000, 400_000

#: Runs of letters, nearly: this takes in the few numerals that are neither digits nor letters.
_RUN = re.compile(r"[^\W\d_]+")
_MARK = ord("_")


def words_of(text: str) -> list[str]:
    runs = _RUN.findall(text.lower())
    if all(map(str.isalpha, runs)):
        return runs
    return [letters for w in runs if (letters := "".join(filter(str.isalpha, w)))]


def gram_keys(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words' character n-grams, and each one's word.  For n = 0 the words
    themselves; from n = 2 on, a mark stands on either side of a word."""
    if n == 0:
        key, _, _ = H.word_hashes(pa.array(words, pa.large_string()))
        return key, np.arange(len(words))
    points = np.frombuffer(("_" + "__".join(words) + "_").encode("utf-32-le", "surrogatepass"), np.uint32).astype(H.U64)
    word = np.cumsum(points == _MARK) // 2  # a word's own two marks lie around it
    word[points == _MARK] = np.repeat(np.arange(len(words)), 2)
    if n == 1:
        inside = points != _MARK
        return H.mix(points[inside] + H.U64(1 << 40)), word[inside]
    if len(points) < n:
        return np.zeros(0, H.U64), np.zeros(0, np.int64)
    key = np.full(len(points) - n + 1, H.U64(n << 40))
    for i in range(n):
        key = H.mix(key + points[i : len(points) - n + 1 + i])
    whole = word[: len(key)] == word[n - 1 :]
    return key[whole], word[: len(key)][whole]


def remainder(id_col: str, n: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = DOCS_PER_LANGUAGE) -> tuple[DataFrame, list[str]]:
    """(lang, text) of about ``per_language`` documents of each language (all, where there are
    fewer), and the languages."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL")
    counts = stage(rows.groupBy("lang").agg(F.count("text").alias("n")), "languages")
    languages = sorted(r["lang"] for r in counts.select("lang").collect())  # the classes of the model
    shares = counts.select(F.col("lang").alias("of"), (F.lit(float(per_language)) / F.greatest("n", F.lit(1))).alias("share"))
    unit = F.shiftrightunsigned(F.xxhash64("id", "text"), 11) / float(1 << 53)
    return rows.where("text IS NOT NULL").join(shares, (F.col("lang") == F.col("of")) & (unit < F.col("share"))).select("lang", "text"), languages


class LanguageModel:
    """For each n (0: words): sorted keys, the place of each key's first entry, the entries'
    languages and log frequencies above the floor, and every language's floor."""

    def __init__(self, languages: list[str], tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], floors: np.ndarray):
        self.languages, self.tables, self.floors = languages, tables, floors

    def _sums(self, n: int, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of known n-grams of each word, and the sums of their log frequencies."""
        size = len(self.languages)
        keys, first, lang, above = self.tables[n]
        total, count = np.zeros(len(words) * size), np.zeros(len(words), np.int64)
        if len(keys):
            wanted, word = gram_keys(words, n)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[at] == wanted
            at, word = at[hit], word[hit]
            count = np.bincount(word, minlength=len(words))
            many = first[at + 1] - first[at]
            entry = np.repeat(first[at] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            total = np.bincount(np.repeat(word, many) * size + lang[entry], above[entry], len(words) * size)
        return count, total.reshape(len(words), size) + count[:, None] * self.floors[n]

    def score(self, words: list[str]) -> np.ndarray:
        """A row a word: its score in each language."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        left = np.arange(len(words))
        for n in (0, *range(MAX_N, 0, -1)):
            if not len(left):
                break
            count, total = self._sums(n, [words[k] for k in left])
            known = count > 0
            out[left[known]] = total[known] / count[known, None]
            left = left[~known]
        return out


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = DOCS_PER_LANGUAGE) -> LanguageModel:
    """Fit on the rows of ``df`` that have a language."""
    chosen, languages = sample(df, id_col, text_col, lang_col, per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        held = 0

        def rows():
            for lang, c in seen.items():
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "c"])

        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    c = seen.setdefault(lang, Counter())
                    held -= len(c)
                    c.update(words_of(text))
                    held += len(c)
                    if held > HELD:
                        yield from rows()
                        seen, held = {}, 0
        yield from rows()

    words = stage(chosen.mapInArrow(lean(count), "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c")), "words")
    place = {lang: k for k, lang in enumerate(languages)}

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 20_000):
                part = b.slice(k, 20_000)
                lang = np.array([place[x] for x in part.column(0).to_pylist()], np.int64)
                found, c = part.column(1).to_pylist(), part.column(2).to_numpy(zero_copy_only=False)
                for n in range(MAX_N + 1):
                    key, word = gram_keys(found, n)
                    own = H.mix(key + lang[word].astype(H.U64) * H.U64(0xD6E8FEB86659FD93))
                    _, at, same = np.unique(own, return_index=True, return_inverse=True)
                    total = np.bincount(same, c[word], len(at)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), pa.array(H.signed(key[at])), pa.array(lang[word[at]]), pa.array(total)], ["n", "key", "lang", "c"])

    # the whole vocabulary of the sample, which DOCS_PER_LANGUAGE bounds
    got = words.mapInArrow(lean(grams), "n int, key long, lang long, c long").groupBy("n", "key", "lang").agg(F.sum("c").alias("c")).toArrow()
    order_of, key_of, lang_of, count_of = (got.column(c).to_numpy() for c in ("n", "key", "lang", "c"))
    drop(words)
    # a language that has shown no word is not learnt
    shown = np.unique(lang_of)
    languages = [languages[k] for k in shown]
    lang_of = np.searchsorted(shown, lang_of)
    tables, floors = [], np.zeros((MAX_N + 1, len(languages)))
    for n in range(MAX_N + 1):
        here = order_of == n
        key, lang, c = key_of[here].view(H.U64), lang_of[here], count_of[here]
        floors[n] = np.log(FLOOR) - np.log(np.maximum(1, np.bincount(lang, c, len(languages))))
        if n == 0:
            often = c >= MIN_COUNT
            key, lang, c = key[often], lang[often], c[often]
        order = np.lexsort((lang, key))
        keys, first = np.unique(key[order], return_index=True)
        tables.append((keys, np.append(first, len(key)).astype(np.int64), lang[order].astype(np.int32), (np.log(c[order]) - np.log(FLOOR)).astype(np.float32)))
    return LanguageModel(languages, tables, floors)


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, lang_pred, score of every row, with the columns in ``keep`` besides."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    source = df.select(df[id_col], df[text_col], *(df[c].alias(f"_keep_{c}") for c in keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        size = max(1, len(m.languages))
        room = max(1000, CACHE // size)
        at_once = max(100, AT_ONCE // size)
        known: dict[str, int] = {}
        rows = np.zeros((room + 1, size), np.float32)

        def place_of(piece: list[str]) -> list[int]:
            """Rows of the words, of which there are ``room`` at most."""
            new = list({w: None for w in piece if w not in known})
            if len(known) + len(new) > room:
                known.clear()
                new = list(dict.fromkeys(piece))
            for a in range(0, len(new), at_once):
                some = new[a : a + at_once]
                rows[len(known) : len(known) + len(some)] = m.score(some)
                known.update(zip(some, range(len(known), len(known) + len(some))))
            return [known[w] for w in piece]

        def totals(found: list[list[str]]) -> np.ndarray:
            """The summed scores of each list of words."""
            flat = [w for words in found for w in words]
            doc = np.repeat(np.arange(len(found)), [len(words) for words in found])
            out = np.zeros((len(found), size))
            for a in range(0, len(flat), room):
                got = rows[place_of(flat[a : a + room])]
                for lang in range(size):
                    out[:, lang] += np.bincount(doc[a : a + room], got[:, lang], len(found))
            return out

        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                found = [words_of(t) if t else [] for t in part.column(1).to_pylist()]
                preds, scores = ["und"] * len(found), np.zeros(len(found))
                if m.languages:
                    n = np.array([len(x) for x in found])
                    odds = totals(found) / np.maximum(n, 1)[:, None] * np.minimum(n, EVIDENCE)[:, None]
                    odds = np.exp(odds - odds.max(axis=1, keepdims=True))
                    best = odds.argmax(axis=1)
                    scores = np.where(n > 0, odds[np.arange(len(n)), best] / odds.sum(axis=1), 0.0)
                    preds = [m.languages[i] if c else "und" for i, c in zip(best, n)]
                extra = [part.column(i + 2) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), *extra], [id_col, "lang_pred", "score", *(f"_keep_{c}" for c in keep)])

    schema = T.StructType([source.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *source.schema.fields[2:]])
    return source.mapInArrow(lean(run), schema)
