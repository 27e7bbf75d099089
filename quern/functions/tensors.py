"""Tensors: views by shape and stride over ARRAY<DOUBLE> columns, and matrix products.

``Dims`` says how the entries of a view lie in the array below it.  Reshaping, transposing,
selecting and broadcasting change only the Dims; ``view`` then gathers the entries with
index arithmetic inside the JVM.  Matrices too large for a row are tables (i, j, x).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import prod

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import arrays as A
from quern.functions.utils import require


@dataclass(frozen=True)
class Dims:
    """Extent and stride of every dimension; an extent may be a tuple of indexes, which are
    looked up before the stride applies."""

    shape: tuple
    strides: tuple[int, ...]
    offset: int = 0

    @staticmethod
    def of(*shape: int) -> Dims:
        return Dims(tuple(shape), tuple(prod(shape[k + 1 :]) for k in range(len(shape))))

    @property
    def extents(self) -> tuple[int, ...]:
        return tuple(len(s) if isinstance(s, tuple) else s for s in self.shape)

    @property
    def ecount(self) -> int:
        return prod(self.extents)

    @property
    def direct(self) -> bool:
        """No dimension goes through a list of indexes."""
        return not any(isinstance(s, tuple) for s in self.shape)

    @property
    def access_increasing(self) -> bool:
        """Addresses grow with the entry's number."""
        return self.direct and all(a >= b for a, b in zip(self.strides, self.strides[1:]))

    @property
    def dense(self) -> bool:
        """The entries are all those between the first and the last address."""
        if not self.direct:
            return False
        step = 1
        for n, s in sorted(zip(self.extents, self.strides), key=lambda p: p[1]):
            if n != 1:
                if s != step:
                    return False
                step *= n
        return True

    @property
    def batch_size(self) -> int:
        return self.extents[0]

    # -- views ----------------------------------------------------------------------------------

    def transpose(self, order: Sequence[int]) -> Dims:
        require(sorted(order) == list(range(len(self.shape))), "not an order of the dimensions", order=tuple(order))
        return Dims(tuple(self.shape[k] for k in order), tuple(self.strides[k] for k in order), self.offset)

    def select(self, *picks: int | None | Sequence[int]) -> Dims:
        """A number drops the dimension, None takes all of it, a sequence takes those indexes."""
        require(len(picks) == len(self.shape), "a pick for every dimension is needed", shape=self.shape)
        shape, strides, offset = [], [], self.offset
        for p, s, step in zip(picks, self.shape, self.strides):
            inner = list(s) if isinstance(s, tuple) else range(s)
            if p is None:
                shape.append(s)
                strides.append(step)
            elif isinstance(p, int):
                offset += step * inner[p]
            else:
                got = [inner[k] for k in p]
                if got == list(range(got[0], got[0] + len(got))):
                    offset += step * got[0]
                    shape.append(len(got))
                else:
                    shape.append(tuple(got))
                strides.append(step)
        return Dims(tuple(shape), tuple(strides), offset)

    def minimize(self) -> Dims:
        """The fewest dimensions that describe the same entries."""
        shape, strides = [], []
        for n, s in zip(self.extents, self.strides):
            if n == 1 and len(self.shape) > 1:
                continue
            if shape and strides[-1] == s * n:
                shape[-1], strides[-1] = shape[-1] * n, s
            else:
                shape.append(n)
                strides.append(s)
        return Dims(tuple(shape or [1]), tuple(strides or [1]), self.offset)

    def reshape(self, *shape: int) -> Dims:
        """Another shape over the same entries without moving them: of a dense view any shape
        that is not larger, of a strided one only what keeps its runs apart."""
        require(prod(shape) <= self.ecount, "the new shape is larger than the tensor", old=self.extents, new=shape)
        require(self.access_increasing, "transposed or indexed dimensions have no other shape in place", strides=self.strides)
        if self.dense:
            return Dims(tuple(shape), Dims.of(*shape).strides, self.offset)
        runs = [list(x) for x in zip(self.minimize().extents, self.minimize().strides)]
        strides: list[int] = []
        for n in reversed(shape):
            if n == 1:
                strides.append(strides[-1] if strides else 1)
                continue
            while runs and runs[-1][0] == 1:
                runs.pop()
            require(runs, "the old shape is used up", new=shape)
            left, step = runs[-1]
            require(left >= n and left % n == 0, "dimensions cannot be joined across gaps or cut unevenly", old=left, new=n)
            strides.append(step)
            runs[-1] = [left // n, step * n]
        return Dims(tuple(shape), tuple(reversed(strides)), self.offset)

    def as_row_vector(self) -> Dims:
        require(self.dense or self.extents[-1] == 1, "a vector needs dense entries or a single column")
        return Dims((self.ecount,), (1,), self.offset)

    def as_column_vector(self) -> Dims:
        require(self.dense or self.extents[-1] == 1, "a vector needs dense entries or a single column")
        return Dims((self.ecount, 1), (1, 1), self.offset)

    def as_batch_matrix(self) -> Dims:
        return self.reshape(self.extents[0], prod(self.extents[1:]))

    def as_2d_matrix(self) -> Dims:
        return self.reshape(prod(self.extents[:-1]), self.extents[-1])

    def as_dense(self) -> Dims | None:
        """The view itself where its entries can be copied as one block."""
        return self if self.dense and self.access_increasing else None

    # -- addresses --------------------------------------------------------------------------------

    def address(self, index: Column, within: Sequence[int] | None = None) -> Column:
        """Place in the array of the entry with this number; ``within`` is the shape that the
        view is repeated to."""
        whole = list(within or self.extents)
        own = [1] * (len(whole) - len(self.shape))
        at, left = F.lit(self.offset), index
        for n, s, step in reversed(list(zip(whole, [*own, *self.shape], [*([0] * len(own)), *self.strides]))):
            size = len(s) if isinstance(s, tuple) else s
            place = left % n % size
            if isinstance(s, tuple):
                place = F.element_at(F.array(*map(F.lit, s)), (place + 1).cast("int"))
            at = at + place * step
            left = F.floor(left / n)
        return at.cast("int")


def broadcast_shape(*all_: Dims) -> tuple[int, ...]:
    """The largest extent of every dimension; the others' must divide it."""
    rank = max(len(d.shape) for d in all_)
    padded = [(1,) * (rank - len(d.shape)) + d.extents for d in all_]
    out = tuple(max(p[k] for p in padded) for k in range(rank))
    for p in padded:
        require(all(n % m == 0 for n, m in zip(out, p)), "shapes do not divide the broadcast shape", shapes=padded)
    return out


def view(v: Column, dims: Dims, within: Sequence[int] | None = None) -> Column:
    """The view's entries, in order, as a dense array."""
    n = prod(within) if within else dims.ecount
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(v, dims.address(i, within) + 1))


def broadcast_binary(op: str, v: Column, dv: Dims, w: Column, dw: Dims, alpha: float = 1.0, beta: float = 1.0) -> Column:
    """Element-wise over any number of dimensions, with smaller extents repeated."""
    shape = broadcast_shape(dv, dw)
    n = prod(shape)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: A.binary(op, F.element_at(v, dv.address(i, shape) + 1), F.element_at(w, dw.address(i, shape) + 1), alpha, beta))


def rows(v: Column, dims: Dims) -> Column:
    """The rows of a view's 2-d form, an array of vectors."""
    d = dims.as_2d_matrix()
    return F.array(*(view(v, d.select(k, None)) for k in range(d.extents[0])))


def columns(v: Column, dims: Dims) -> Column:
    d = dims.as_2d_matrix()
    return F.array(*(view(v, d.select(None, k)) for k in range(d.extents[1])))


# -- making ------------------------------------------------------------------------------------------


def fill(v: Column, x: float) -> Column:
    """A tensor of the same length with one value."""
    return F.transform(v, lambda _: F.lit(float(x)))


def like(v: Column) -> Column:
    return fill(v, 0.0)


def numbers(op: str, a: float, b: float) -> float:
    """An operation on two plain numbers, folded before anything runs."""
    require(op in ("+", "-", "*", "/", "max", "min"), "no operation on two numbers", op=op)
    return {"+": a + b, "-": a - b, "*": a * b, "/": a / b if b else float("nan"), "max": max(a, b), "min": min(a, b)}[op]


def identity_matrix(spark: SparkSession, n: int) -> DataFrame:
    """(i, j, x)."""
    cell = spark.range(n * n)
    return cell.select(F.floor(F.col("id") / n).alias("i"), (F.col("id") % n).alias("j")).withColumn("x", F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))


def random_matrix(spark: SparkSession, rows: int, cols: int, seed: int = 0) -> DataFrame:
    """(i, j, x) of the standard normal distribution."""
    cell = spark.range(rows * cols)
    return cell.select(F.floor(F.col("id") / cols).alias("i"), (F.col("id") % cols).alias("j"), F.randn(seed).alias("x"))


def softmax_gradient(v: Column) -> Column:
    """diag(v) - v v', an array of rows."""
    return F.transform(v, lambda x, i: F.transform(v, lambda y, j: F.when(i == j, x).otherwise(0.0) - x * y))


def to_numpy(df: DataFrame, column: str, dtype=np.float64) -> np.ndarray:
    """The vectors of a (small) table as a matrix."""
    got = df.select(column).toPandas()[column]
    return np.stack([np.asarray(x, dtype) for x in got]) if len(got) else np.zeros((0, 0), dtype)


def checked(v: Column, ecount: int) -> Column:
    """v, which must have this many entries."""
    fits = F.assert_true(F.size(v) == ecount, F.lit(f"a vector of {ecount} entries is needed"))
    return F.when(fits.isNull(), v)


# -- products ----------------------------------------------------------------------------------------------


def gemm(a: Column, da: Dims, b: Column, db: Dims, alpha: float = 1.0, beta: float = 0.0, c: Column | None = None, trans_a: bool = False, trans_b: bool = False) -> Column:
    """alpha * A B + beta * C of matrices in the columns of a row, row by row; the transposes
    cost nothing but strides."""
    da, db = da.transpose((1, 0)) if trans_a else da, db.transpose((1, 0)) if trans_b else db
    (m, k), (k2, n) = da.extents, db.extents
    require(k == k2, "the inner dimensions differ", a=da.extents, b=db.extents)
    across = [db.transpose((1, 0)).select(j, None) for j in range(n)]
    lines = [da.select(i, None) for i in range(m)]

    def product(rows_: Column) -> Column:
        cells = [A.dot(rows_["a"][i], rows_["b"][j]) * alpha for i in range(m) for j in range(n)]
        out = F.array(*cells)
        return out if c is None or beta == 0 else F.zip_with(out, c, lambda x, y: x + beta * y)

    return A.let(F.struct(F.array(*(view(a, d) for d in lines)).alias("a"), F.array(*(view(b, d) for d in across)).alias("b")), product)


def gemv(a: Column, da: Dims, x: Column, alpha: float = 1.0, beta: float = 0.0, c: Column | None = None, trans: bool = False) -> Column:
    return gemm(a, da, x, Dims.of(da.extents[0] if trans else da.extents[1], 1), alpha, beta, c, trans)


def gemm_tables(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 0.0, c: DataFrame | None = None, trans_a: bool = False, trans_b: bool = False) -> DataFrame:
    """The same for matrices as tables (i, j, x), joined on the inner index; products are
    summed in the join's tasks before they are shuffled."""
    left = a.select(F.col("j" if trans_a else "i").alias("i"), F.col("i" if trans_a else "j").alias("k"), F.col("x").alias("p"))
    right = b.select(F.col("j" if trans_b else "i").alias("k"), F.col("i" if trans_b else "j").alias("j"), F.col("x").alias("q"))
    out = left.join(right, "k").groupBy("i", "j").agg((alpha * F.sum(F.col("p") * F.col("q"))).alias("x"))
    if c is None or beta == 0:
        return out
    whole = out.join(c.select("i", "j", F.col("x").alias("_c")), ["i", "j"], "full")
    return whole.select("i", "j", (F.coalesce("x", F.lit(0.0)) + beta * F.coalesce("_c", F.lit(0.0))).alias("x"))


def gram(df: DataFrame, column: str) -> DataFrame:
    """V' V over a table of vectors, (i, j, x): every task adds up its own rows' products."""
    cells = F.flatten(F.transform(column, lambda x, i: F.transform(column, lambda y, j: F.struct(i.alias("i"), j.alias("j"), (x * y).alias("x")))))
    return df.select(F.explode(cells).alias("c")).groupBy("c.i", "c.j").agg(F.sum("c.x").alias("x"))
