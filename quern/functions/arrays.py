"""Element-wise, reducing and matrix operations on ARRAY<DOUBLE> columns.

Each function takes and returns columns, so chains of them collapse into one projection
that the optimiser generates code for.  A name of an operation is a plain string.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- scalars ------------------------------------------------------------------------------


def round_half_up(x: Column) -> Column:
    """floor(x + 0.5): -2.5 becomes -2."""
    return F.floor(x + 0.5).cast("double")


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column) -> Column:
    """The inverse of the logistic function."""
    return F.log(p / (1.0 - p))


def logistic_gradient(p: Column) -> Column:
    """From the function's value."""
    return p * (1.0 - p)


UNARY: dict[str, Callable[[Column], Column]] = {
    "floor": lambda x: F.floor(x).cast("double"),
    "ceil": lambda x: F.ceil(x).cast("double"),
    "round": round_half_up,
    "-": lambda x: -x,
    "tanh": F.tanh,
    "logistic": logistic,
    "exp": F.exp,
    "sqrt": F.sqrt,
    "noop": lambda x: x,
}


def _int(x: Column) -> Column:
    return x.cast("int")


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: F.try_divide(a, b),
    # a NaN on the left loses the comparison and the right side is taken
    "max": lambda a, b: F.when(~F.isnan(a) & (a > b), a).otherwise(b),
    "min": lambda a, b: F.when(~F.isnan(a) & (a > b), b).otherwise(a),
    "bit-and": lambda a, b: _int(a).bitwiseAND(_int(b)).cast("double"),
    "bit-xor": lambda a, b: _int(a).bitwiseXOR(_int(b)).cast("double"),
    "eq": lambda a, b: _flag(a == b),
    ">": lambda a, b: _flag(a > b),
    ">=": lambda a, b: _flag(a >= b),
    "<": lambda a, b: _flag(a < b),
    "<=": lambda a, b: _flag(a <= b),
}


def unary(op: str, x: Column, alpha: float = 1.0) -> Column:
    return UNARY[op](alpha * x)


def binary(op: str, x: Column, y: Column, alpha: float = 1.0, beta: float = 1.0) -> Column:
    return BINARY[op](alpha * x, beta * y)


def select(x: Column, y: Column, z: Column, alpha: float = 1.0, beta: float = 1.0, gamma: float = 1.0) -> Column:
    """gamma * z where alpha * x is 0 or more, else beta * y."""
    return F.when(alpha * x >= 0, gamma * z).otherwise(beta * y)


def where(test: Column, then: Column, other: Column) -> Column:
    return F.when(test == 1, then).otherwise(other)


def clamp(low: Column, x: Column, high: Column) -> Column:
    return F.greatest(low, F.least(x, high))


def relative_error(a: Column, b: Column) -> Column:
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(top == 0, 0.0).otherwise(F.abs(a - b) / F.when(top == 0, 1.0).otherwise(top))


# -- arrays -------------------------------------------------------------------------------


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def map_unary(op: str, v: Column, alpha: float = 1.0) -> Column:
    return F.transform(v, lambda x: unary(op, x, alpha))


def map_binary(op: str, v: Column, w: Column, alpha: float = 1.0, beta: float = 1.0) -> Column:
    """Element-wise, with the shorter operand repeated; its length must divide the longer's."""
    n = F.greatest(F.size(v), F.size(w))

    def repeated(x: Column) -> Column:
        fits = F.assert_true(n % F.size(x) == 0, F.lit("a shape does not divide the broadcast shape"))
        return F.when(F.size(x) == n, x).otherwise(F.when(fits.isNull(), F.flatten(F.array_repeat(x, (n / F.size(x)).cast("int")))))

    return F.zip_with(repeated(v), repeated(w), lambda a, b: binary(op, a, b, alpha, beta))


def map_select(x: Column, y: Column, z: Column) -> Column:
    pairs = F.zip_with(y, z, lambda a, b: F.struct(a.alias("y"), b.alias("z")))
    return F.zip_with(x, pairs, lambda a, p: select(a, p["y"], p["z"]))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def reduce(op: str, v: Column, alpha: float = 1.0) -> Column:
    """min, max, sum, mean, magnitude or magnitude-squared of alpha * v, in element order."""
    v = F.transform(v, lambda x: alpha * x)
    if op == "min":
        return F.array_min(v)
    if op == "max":
        return F.array_max(v)
    if op == "sum":
        return total(v)
    if op == "mean":
        return F.try_divide(total(v), F.size(v))
    squares = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    if op == "magnitude-squared":
        return squares
    if op == "magnitude":
        return F.sqrt(squares)
    raise ValueError(f"unknown reduction {op}")


def dot(v: Column, w: Column) -> Column:
    return total(F.zip_with(v, w, lambda a, b: a * b))


def vector(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def gemv(matrix: Sequence[Sequence[float]], x: Column, alpha: float = 1.0, beta: float = 0.0, c: Column | None = None) -> Column:
    """alpha * A x + beta * c for a matrix of literals."""
    out = F.array(*(alpha * dot(vector(row), x) for row in matrix))
    return out if c is None or beta == 0 else F.zip_with(out, c, lambda a, b: a + beta * b)


def linear(weights: Sequence[Sequence[float]], bias: Sequence[float], x: Column) -> Column:
    return F.zip_with(gemv(weights, x), vector(bias), lambda a, b: a + b)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def argmax(v: Column) -> Column:
    """Index of the largest entry, the last one among equals; -1 for an empty array."""
    at = F.array_position(F.reverse(v), F.array_max(v))
    return F.coalesce(F.when(at > 0, F.size(v) - at), F.lit(-1)).cast("int")


def softmax(v: Column) -> Column:
    def scaled(v: Column) -> Column:
        return let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))

    return let(v, lambda v: let(scaled(v), lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s))))


def one_hot(index: Column, n: int) -> Column:
    inside = F.assert_true((index >= 0) & (index < n), F.lit("index outside the classes"))
    return F.when(inside.isNull(), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: _flag(i == index)))


def one_hot_label(classes: Sequence[str], label: Column, strict: bool = True) -> Column:
    """1 at the label's class; an unknown label is an error, or all zeros where not strict."""
    code = F.transform(F.array(*(F.lit(c) for c in classes)), lambda c: _flag(c == label))
    if not strict:
        return code
    return F.when(F.assert_true(label.isin(list(classes)), F.lit("unknown label")).isNull(), code)


def unit_vector(v: Column) -> Column:
    """One-hot of the largest entry."""
    at = argmax(v)
    return F.transform(v, lambda x, i: _flag(i == at))


def normalize(v: Column, radius: float = 1.0) -> Column:
    """v scaled to length ``radius``; 1e-6 keeps a zero vector finite."""
    return let(reduce("magnitude", v), lambda size: F.transform(v, lambda x: x * radius / (size + 1e-6)))


def constrain(v: Column, radius: float = 1.0) -> Column:
    """Only vectors longer than ``radius`` are shortened to it."""
    return let(reduce("magnitude", v), lambda size: F.transform(v, lambda x: x * radius / F.greatest(size, F.lit(radius))))


def nan_to_zero(v: Column) -> Column:
    return F.transform(v, lambda x: F.nanvl(x, F.lit(0.0)))


def nan_mask(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(F.isnan(x), 0.0).otherwise(1.0))


# -- activations: value, and gradient from the output ---------------------------------------

SELU_SCALE, SELU_ALPHA = 1.0507009873554805, 1.6732632423543772

ACTIVATIONS: dict[str, Callable[[Column], Column]] = {
    "logistic": logistic,
    "tanh": F.tanh,
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "swish": lambda x: x * logistic(x),
    "selu": lambda x: SELU_SCALE * F.when(x > 0, x).otherwise(SELU_ALPHA * F.exp(x) - SELU_ALPHA),
}

#: The swish and selu gradients are evaluated at the output, as the reference data expects.
GRADIENTS: dict[str, Callable[[Column], Column]] = {
    "logistic": lambda o: o * (1.0 - o),
    "tanh": lambda o: 1.0 - o * o,
    "relu": lambda o: _flag(o > 0),
    "swish": lambda o: logistic(o) + o * logistic(o) * (1.0 - logistic(o)),
    "selu": lambda o: SELU_SCALE * F.when(o > 0, F.lit(1.0)).otherwise(SELU_ALPHA * F.exp(o)),
}


def activate(name: str, v: Column) -> Column:
    return F.transform(v, ACTIVATIONS[name])


def activation_gradient(name: str, out: Column, grad: Column) -> Column:
    return F.zip_with(out, grad, lambda o, g: GRADIENTS[name](o) * g)


def prelu(v: Column, scale: float = 0.25) -> Column:
    return F.transform(v, lambda x: F.when(x >= 0, x).otherwise(scale * x))


def lrn(v: Column, n: int = 5, k: float = 2.0, alpha: float = 1e-4, beta: float = 0.75) -> Column:
    """Local response normalisation over n neighbouring channels of a vector of channels."""
    half = n // 2

    def one(x: Column, i: Column) -> Column:
        start = F.greatest(i - half, F.lit(0))
        near = F.slice(v, start + 1, F.least(i + half + 1, F.size(v)) - start)
        return x / F.pow(k + alpha / n * F.aggregate(near, F.lit(0.0), lambda a, y: a + y * y), F.lit(beta))

    return F.transform(v, one)


# -- losses of a row --------------------------------------------------------------------------


def mse_loss(v: Column, t: Column) -> Column:
    return F.aggregate(F.zip_with(v, t, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / F.size(v)


def mse_gradient(v: Column, t: Column) -> Column:
    return F.zip_with(v, t, lambda a, b: 2.0 / F.size(v) * (a - b))


def softmax_loss(v: Column, t: Column) -> Column:
    return -F.log(dot(v, t))


def censor_loss(v: Column, t: Column) -> Column:
    """Squared error over labels that are not NaN, divided by the number of all labels."""
    return total(F.zip_with(v, t, lambda a, b: F.when(F.isnan(b), 0.0).otherwise((a - b) * (a - b)))) / F.size(v)


def center_loss(v: Column, center: Column) -> Column:
    """Half the distance (not its square)."""
    return F.sqrt(total(F.zip_with(v, center, lambda a, b: (a - b) * (a - b)))) / 2.0


def l1_loss(w: Column) -> Column:
    return total(F.transform(w, F.abs))


def l2_loss(w: Column) -> Column:
    """Half the length (not its square)."""
    return reduce("magnitude", w) / 2.0


# -- views ------------------------------------------------------------------------------------


def subvector(v: Column, offset: int, length: int | None = None) -> Column:
    return F.slice(v, offset + 1, length if length is not None else F.size(v) - offset)


def gather(v: Column, indexes: Sequence[int]) -> Column:
    return F.array(*(F.element_at(v, i + 1) for i in indexes))


def submatrix(v: Column, columns: int, row: int, rows: int, column: int, width: int) -> Column:
    """A block of a row-major matrix with ``columns`` columns."""
    return F.concat(*(F.slice(v, (row + i) * columns + column + 1, width) for i in range(rows)))


def transpose(v: Column, rows: int, columns: int) -> Column:
    return gather(v, [i * columns + j for j in range(columns) for i in range(rows)])


def split_by(v: Column, counts: Sequence[int]) -> Column:
    """Consecutive slices of the given lengths."""
    at, out = 0, []
    for n in counts:
        out.append(F.slice(v, at + 1, n))
        at += n
    return F.array(*out)


def pad(v: Column, n: int, filler: Column) -> Column:
    """v, then entries of ``filler`` until there are n."""
    return F.slice(F.concat(v, filler), 1, n)


def interleave(*vs: Column) -> Column:
    """Round-robin over the arrays until all are exhausted."""
    zipped = F.arrays_zip(*(v.alias(f"v{i}") for i, v in enumerate(vs)))
    each = F.transform(zipped, lambda s: F.array(*(s.getField(f"v{i}") for i in range(len(vs)))))
    return F.filter(F.flatten(each), lambda x: x.isNotNull())


def join_vectors(op: str, v: Column, w: Column) -> Column:
    """"+" adds the narrower vector into a prefix; "*" multiplies the common prefix and leaves zeros."""
    if op == "+":
        return F.zip_with(v, w, lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
    return F.zip_with(v, w, lambda a, b: F.coalesce(a * b, F.lit(0.0)))
