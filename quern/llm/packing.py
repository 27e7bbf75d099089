"""Packing token sequences by vector bin packing with the dot-product heuristic.

Each example has a demand of three kinds: tokens, one segment, and loss-bearing tokens;
a sequence has a limit for each.  The open sequence takes, of the examples that fit, the
one whose demand has the largest dot product with the room that is left.  Where cutting is
allowed and nothing whole fits, the example with the largest dot product gives the piece
that fills the room.  A task packs the rows of its own partition through a window of
bounded size, so nothing is shuffled and memory does not grow with the input.  Which
examples share a sequence, and sequence_id, follow the input's split; the pieces' ids do not.

Defined cases: a null text is empty and has only its end token; rows that repeat an id are
examples of their own; an example over a limit is cut; where cutting is off, its first piece
stands alone and the rest follows in further pieces (``remainder``, the default of
``pack_examples``) or is left out, which length < doc_tokens shows; an example without ids
gives a row of length 0 in no sequence (null); an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.llm.workers import lean

#: Room of a sequence, limits of segments and of loss-bearing tokens in it.
MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 2048, 64, 2048
#: A task holds this many examples, or this many tokens, before it packs them.
WINDOW_ROWS, WINDOW_TOKENS = 2048, 4_000_000
#: A gap below this many tokens is left as padding rather than filled with a cut.
MIN_PIECE = 8
END = 1


@dataclass
class Limits:
    tokens: int = MAX_TOKENS
    segments: int = MAX_SEGMENTS
    loss: int = MAX_LOSS
    cut: bool = True
    min_piece: int = MIN_PIECE
    remainder: bool = False


@dataclass
class Item:
    """What is left of one example: its ids, which of them bear loss (None: all), and how
    many ids went into earlier pieces."""

    key: object
    ids: np.ndarray
    loss: np.ndarray | None = None
    at: int = 0
    cost: int = field(init=False)

    def __post_init__(self):
        self.cost = len(self.ids) if self.loss is None else int(self.loss.sum())


def _prefix(item: Item, tokens: int, loss: int) -> int:
    """Ids from the item's place on that keep within both rooms."""
    n = min(tokens, len(item.ids) - item.at)
    if item.loss is None:
        return min(n, loss)
    run = np.cumsum(item.loss[item.at : item.at + n])
    return int(np.searchsorted(run, loss, "right"))


def pack(items: list[Item], limits: Limits) -> Iterator[list[tuple[Item, int, int]]]:
    """Sequences as lists of (item, start, length), in the order they were closed."""
    size = np.array([len(i.ids) for i in items], np.float64)
    cost = np.array([i.cost for i in items], np.float64)
    room_of = np.array([limits.tokens, limits.segments, limits.loss], np.float64)
    alive = size > 0
    left = int(alive.sum())
    while left:
        room, chosen = room_of.copy(), []
        while left and room[1] >= 1 and room[0] >= 1:
            fits = alive & (size <= room[0]) & (cost <= room[2])
            score = (size * (room[0] / room_of[0] ** 2) + cost * (room[2] / room_of[2] ** 2)) + room[1] / room_of[1] ** 2
            best = int(np.argmax(np.where(fits, score, -1.0)))
            if fits[best]:
                item = items[best]
                n = int(size[best])
                chosen.append((item, item.at, n))
                room -= (n, 1, cost[best])
                alive[best] = False
                left -= 1
                continue
            if not limits.cut and chosen:
                break
            best = int(np.argmax(np.where(alive, np.minimum(size, room[0]) * room[0] + np.minimum(cost, room[2]) * room[2], -1.0)))
            item = items[best]
            n = _prefix(item, int(room[0]), int(room[2]))
            if n < (limits.min_piece if chosen else 1):
                break
            spent = n if item.loss is None else int(item.loss[item.at : item.at + n].sum())
            chosen.append((item, item.at, n))
            room -= (n, 1, spent)
            if limits.cut or limits.remainder:
                item.at += n
                size[best] -= n
                cost[best] -= spent
                if size[best] <= 0:
                    alive[best] = False
                    left -= 1
            else:
                alive[best] = False
                left -= 1
            if not limits.cut:  # alone and over a limit
                break
        yield chosen


def byte_bpe(path: str):
    """The byte-level BPE of a ``tokenizers`` file, run by tiktoken, which gives the same ids
    at three times the speed: its merges follow the order of the vocabulary."""
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in word): k for word, k in spec["model"]["vocab"].items() if word not in added}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


class Coder:
    """Ids of whole texts; added tokens of the file stand for themselves wherever a text has
    their content."""

    def __init__(self, path: str):
        self.model = byte_bpe(path)

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        encode = self.model.encode_to_numpy
        return [encode(t, allowed_special="all", disallowed_special=()) for t in texts]


_coders: dict[str, Coder] = {}


def tokenizer(path: str) -> Coder:
    """The coder of a file, one a worker."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


_FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("n_loss", pa.int64()), ("sequence_length", pa.int64())]


def padded_length(n: int, limit: int) -> int:
    """A sequence is padded to the limit, except at a power of two."""
    return n if n & (n - 1) == 0 else limit


def _emit(items: list[Item], limits: Limits, base: int, kind: pa.DataType, key: str) -> tuple[pa.RecordBatch, int]:
    cols: list[list] = [[] for _ in range(len(_FIELDS) + 1)]
    for chosen in pack(items, limits):
        at = 0
        total = sum(n for _, _, n in chosen)
        for item, start, n in chosen:
            ids = item.ids[start : start + n]
            loss = n if item.loss is None else int(item.loss[start : start + n].sum())
            for c, v in zip(cols, (item.key, start, n, zlib.crc32(ids.astype("<u4").tobytes()), len(item.ids), base, at, loss, padded_length(total, limits.tokens))):
                c.append(v)
            at += n
        base += 1
    for item in items:
        if not len(item.ids):  # in no sequence
            for c, v in zip(cols, (item.key, 0, 0, 0, 0, None, None, 0, 0)):
                c.append(v)
    arrays = [pa.array(cols[0], kind)] + [pa.array(c, t) for c, (_, t) in zip(cols[1:], _FIELDS)]
    return pa.RecordBatch.from_arrays(arrays, [key, *(n for n, _ in _FIELDS)]), base


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limits: Limits | None = None) -> DataFrame:
    """Pieces of all documents: id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, n_loss, sequence_length (with padding).  Every id bears loss."""
    limits = limits or Limits()
    source = df.select(df[id_col], df[text_col])
    kind = source.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = tokenizer(tokenizer_path)
        arrow = None
        base, items, held = TaskContext.get().partitionId() << 40, [], 0
        for b in batches:
            arrow = b.schema.field(0).type
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                keys = part.column(0).to_pylist()
                for key, ids in zip(keys, coder.batch([t or "" for t in part.column(1).to_pylist()])):
                    items.append(Item(key, np.append(ids, np.uint32(END))))
                    held += len(ids) + 1
                if len(items) >= WINDOW_ROWS or held >= WINDOW_TOKENS:
                    out, base = _emit(items, limits, base, arrow, id_col)
                    yield out
                    items, held = [], 0
        if items:
            yield _emit(items, limits, base, arrow, id_col)[0]

    schema = T.StructType([T.StructField(id_col, kind)] + [T.StructField(n, T.LongType()) for n, _ in _FIELDS])
    return source.mapInArrow(lean(run), schema)


def pack_examples(df: DataFrame, id_col: str, ids_col: str, loss_col: str | None = None, limits: Limits | None = None) -> DataFrame:
    """The same for examples that already are arrays of token ids, with an array of 0/1 that
    marks the ids that bear loss (instruction data).  By default only what is over a limit
    is cut, and no id is left out."""
    limits = limits or Limits(cut=False, remainder=True)
    source = df.select(df[id_col], df[ids_col], *([df[loss_col]] if loss_col else []))
    kind = source.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        arrow = None
        base, items, held = TaskContext.get().partitionId() << 40, [], 0
        for b in batches:
            arrow = b.schema.field(0).type
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist() if loss_col else [None] * b.num_rows)
            for key, ids, loss in rows:
                ids = np.array(ids or [], np.uint32)
                mask = None
                if loss_col:
                    mask = np.zeros(len(ids), np.int64)
                    got = np.array([x or 0 for x in loss or []][: len(ids)], np.int64)
                    mask[: len(got)] = got
                items.append(Item(key, ids, mask))
                held += len(ids)
                if len(items) >= WINDOW_ROWS or held >= WINDOW_TOKENS:
                    out, base = _emit(items, limits, base, arrow, id_col)
                    yield out
                    items, held = [], 0
        if items:
            yield _emit(items, limits, base, arrow, id_col)[0]

    schema = T.StructType([T.StructField(id_col, kind)] + [T.StructField(n, T.LongType()) for n, _ in _FIELDS])
    return source.mapInArrow(lean(run), schema)
