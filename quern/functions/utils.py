"""Comparison, parsing, formatting and map helpers, as column functions where data is meant."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import arrays as A

EPSILON = 1e-6


class QuernError(ValueError):
    """An error with the facts that explain it."""

    def __init__(self, message: str, **facts):
        super().__init__(f"{message} {facts}" if facts else message)
        self.facts = facts


def require(condition: object, message: str, **facts) -> None:
    if not condition:
        raise QuernError(message, **facts)


# -- comparison -----------------------------------------------------------------------------


def very_near(a: Column, b: Column, epsilon: float = EPSILON) -> Column:
    return F.abs(a - b) < epsilon


def approx_equal(tolerance: float, a: Column, b: Column, depth: int = 0, exact: bool = False) -> Column:
    """Whether numbers, or arrays nested ``depth`` deep, have the same form and numbers within
    a relative error; ``exact`` compares as whole numbers are compared."""
    if depth == 0:
        return a == b if exact else A.relative_error(a, b) <= tolerance
    inner = F.zip_with(a, b, lambda x, y: approx_equal(tolerance, x, y, depth - 1, exact))
    return (F.size(a) == F.size(b)) & F.forall(inner, lambda x: F.coalesce(x, F.lit(False)))


def approx_diff(a: Column, b: Column, depth: int = 0) -> Column:
    """The relative errors, in the form of the operands, which must have the same."""
    if depth == 0:
        return A.relative_error(a, b)
    same = F.assert_true(F.size(a) == F.size(b), F.lit("the operands differ in form"))
    return F.when(same.isNull(), F.zip_with(a, b, lambda x, y: approx_diff(x, y, depth - 1)))


# -- maps -------------------------------------------------------------------------------------


def args_to_map(pairs: Column) -> Column:
    """[k1, v1, k2, v2, ...] as a map, the last of equal keys; an odd number is an error."""
    even = F.assert_true(F.size(pairs) % 2 == 0, F.lit("an odd number of arguments"))
    entries = F.transform(F.sequence(F.lit(0), (F.size(pairs) / 2 - 1).cast("int")), lambda i: F.struct(F.element_at(pairs, (2 * i + 1).cast("int")).alias("key"), F.element_at(pairs, (2 * i + 2).cast("int")).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda f: f["key"] == e["key"]))
    empty = F.map_from_entries(F.slice(F.array(F.struct(F.lit("").alias("key"), F.lit("").alias("value"))), 1, 0))
    return F.when(even.isNull(), F.when(F.size(pairs) == 0, empty).otherwise(F.map_from_entries(last)))


def deep_merge(*maps: Column, depth: int = 1) -> Column:
    """Maps merged from left to right, nested ``depth`` deep; a null map is left out."""
    out = maps[0]
    for m in maps[1:]:

        def both(key, x, y):
            return F.coalesce(y, x) if depth <= 1 else F.when(x.isNotNull() & y.isNotNull(), deep_merge(x, y, depth=depth - 1)).otherwise(F.coalesce(y, x))

        out = F.when(out.isNotNull() & m.isNotNull(), F.map_zip_with(out, m, both)).otherwise(F.coalesce(m, out))
    return out


def merge_args(description: Column, pairs: Column) -> Column:
    return deep_merge(description, args_to_map(pairs))


def map_keys(f: Callable[[Column], Column], m: Column) -> Column:
    return F.transform_keys(m, lambda k, _: f(k))


def map_vals(f: Callable[[Column], Column], m: Column) -> Column:
    return F.transform_values(m, lambda _, v: f(v))


def get_or(m: Column, key: str, default: Column) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key)), default)


def merged(*maps: Mapping | None) -> object:
    """The same for Python dictionaries, as deep as they go."""
    if all(isinstance(m, Mapping) for m in maps):
        out: dict = {}
        for m in maps:
            for k, v in m.items():
                out[k] = merged(out[k], v) if k in out else v
        return out
    return merged(*maps[:-1]) if maps[-1] is None and len(maps) > 1 else maps[-1]


def vectorize(data: object) -> object:
    """Nested sequences, sets and arrays as lists; dictionaries keep their form."""
    if isinstance(data, Mapping):
        return {vectorize(k) if not isinstance(k, (list, set)) else tuple(vectorize(k)): vectorize(v) for k, v in data.items()}
    if isinstance(data, (str, bytes)) or not hasattr(data, "__iter__"):
        return data
    return [vectorize(x) for x in (data.tolist() if hasattr(data, "tolist") else data)]


def fresh_id(stem: str, taken: set[str]) -> str:
    """stem-N with the smallest N from 1 that is not taken."""
    n = 1
    while f"{stem}-{n}" in taken:
        n += 1
    return f"{stem}-{n}"


# -- parsing and formatting -----------------------------------------------------------------------


def _parsed(text: Column, pattern: str, kind: str) -> Column:
    bad = F.raise_error(F.concat(F.lit(f"not a {kind}: "), F.coalesce(text, F.lit("null")))).cast(kind)
    value = text.try_cast(kind)
    return F.when(text.rlike(pattern) & value.isNotNull(), value).otherwise(bad)


def parse_long(text: Column) -> Column:
    return _parsed(text, r"^[+-]?[0-9]+$", "bigint")


def parse_double(text: Column) -> Column:
    return _parsed(text, r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$", "double")


_SPECIFIER = re.compile(r"%(?:([1-9][0-9]*)\$)?([-#+ 0,(]*[0-9]*(?:\.[0-9]+)?[a-zA-Z%])")


class Each:
    """Marks an argument of ``sformat`` as an array, nested ``depth`` deep."""

    def __init__(self, column: Column, depth: int = 1):
        self.column, self.depth = column, depth


def _formatted(specifier: str, x: Column, depth: int) -> Column:
    if depth:
        parts = F.transform(x, lambda e: _formatted(specifier, e, depth - 1))
        return F.concat(F.lit("["), F.array_join(parts, " "), F.lit("]"))
    kind = specifier[-1]
    value = x.cast("double") if kind in "eEfgGaA" else x.cast("bigint") if kind in "doxX" else x
    return F.format_string("%" + specifier, value)


def sformat(form: str, *args: Column | Each) -> Column:
    """Like format; numbers are cast as the specifier needs, and arrays come out as [a b c]."""
    out, at, turn = [], 0, 0
    for m in _SPECIFIER.finditer(form):
        out.append(F.lit(form[at : m.start()]))
        at = m.end()
        if m[2][-1] in "%n":
            out.append(F.lit("%" if m[2][-1] == "%" else "\n"))
            continue
        if m[1]:
            arg = args[int(m[1]) - 1]
        else:
            arg, turn = args[turn], turn + 1
        out.append(_formatted(m[2], arg.column, arg.depth) if isinstance(arg, Each) else _formatted(m[2], arg, 0))
    return F.concat(*out, F.lit(form[at:]))


# -- the rest -------------------------------------------------------------------------------------


def row_ranges(parts: int, rows: int) -> list[tuple[int, int]]:
    """(start, length) of ``parts`` contiguous ranges of equal length, the last with the rest."""
    require(parts > 1, "more than one part is needed", parts=parts)
    size = rows // parts
    return [(k * size, size if k < parts - 1 else rows - size * (parts - 1)) for k in range(parts)]


def pack(vectors: Column) -> Column:
    """An array of vectors as one vector."""
    return F.flatten(vectors)


def unpack(packed: Column, lengths: Sequence[int]) -> Column:
    """Its inverse, for vectors of these lengths."""
    fits = F.assert_true(F.size(packed) == sum(lengths), F.lit("the lengths do not add up to the packed vector's"))
    return F.when(fits.isNull(), A.split_by(packed, lengths))


def cpu_time(work: Callable[[], object]) -> tuple[object, float]:
    """The result of ``work`` and the CPU seconds that it took."""
    start = time.process_time()
    got = work()
    return got, time.process_time() - start
