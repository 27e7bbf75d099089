"""Registered queries over the driver's tables, with the same in plain SQL.

Every query reads whole tables.  Computed numbers are rounded to six places on both sides;
vectors come out in long form, one row an entry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import arrays as A
from quern.functions.objectives import OBJECTIVES
from quern.operators import detect, encode, metrics, rows, stats, tree
from quern.plans import network as N
from quern.plans import optimizers
from quern.sources.io import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _r(c: Column) -> Column:
    return F.round(c, 6)


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").withColumn("v", A.doubles(F.col("embedding"))).drop("embedding")


def _long(df: DataFrame, v: Column, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(v).alias("i", "x")).select(*keys, "i", _r(F.col("x")).alias("x"))


_E = "WITH e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS i FROM embeddings)"
_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_KEYS = ", ".join(_LINE)

# -- element-wise -------------------------------------------------------------------------------

_X = "((l_quantity - 25.5) / CAST(7 AS DOUBLE))"
_UNARY_SQL = {"floor": "floor({x})", "ceil": "ceil({x})", "round": "floor({x} + 0.5)", "-": "-{x}", "tanh": "(exp({x}) - exp(-{x})) / (exp({x}) + exp(-{x}))", "logistic": "1 / (1 + exp(-{x}))", "exp": "exp({x})", "sqrt": "sqrt(l_quantity)", "noop": "{x}"}
_UNARY_NAME = {"-": "negate"}


@register("unary_ops", f"SELECT {_KEYS}, " + ", ".join(f"round(CAST({s.format(x=_X)} AS DOUBLE), 6) AS u_{_UNARY_NAME.get(k, k)}" for k, s in _UNARY_SQL.items()) + " FROM lineitem")
def unary_ops(spark, sf):
    x = (F.col("l_quantity") - 25.5) / 7.0
    return table(spark, sf, "lineitem").select(*_LINE, *(_r(A.unary(k, F.col("l_quantity") if k == "sqrt" else x)).alias(f"u_{_UNARY_NAME.get(k, k)}") for k in A.UNARY))


_BINARY = {"+": ("add", "{a} + {b}"), "-": ("sub", "{a} - {b}"), "*": ("mul", "{a} * {b}"), "/": ("div", "{a} / {b}"), "max": ("max", "greatest({a}, {b})"), "min": ("min", "least({a}, {b})"), "bit-and": ("and", "CAST({a} AS INT) & CAST({b} AS INT)"), "bit-xor": ("xor", "xor(CAST({a} AS INT), CAST({b} AS INT))")}
_BINARY |= {k: (n, f"CASE WHEN {{a}} {s} {{b}} THEN 1 ELSE 0 END") for k, n, s in (("eq", "eq", "="), (">", "gt", ">"), (">=", "ge", ">="), ("<", "lt", "<"), ("<=", "le", "<="))}


@register("binary_ops", f"SELECT {_KEYS}, " + ", ".join(f"round(CAST({s.format(a='l_quantity', b='CAST(l_linenumber AS DOUBLE)')} AS DOUBLE), 6) AS b_{n}" for n, s in _BINARY.values()) + " FROM lineitem")
def binary_ops(spark, sf):
    a, b = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    return table(spark, sf, "lineitem").select(*_LINE, *(_r(A.binary(k, a, b)).alias(f"b_{n}") for k, (n, _) in _BINARY.items()))


@register("ternary_select", f"SELECT {_KEYS}, round(CASE WHEN l_quantity - 25 >= 0 THEN 2 * l_extendedprice ELSE 3 * l_discount END, 6) AS s FROM lineitem")
def ternary_select(spark, sf):
    return table(spark, sf, "lineitem").select(*_LINE, _r(A.select(F.col("l_quantity") - 25, F.col("l_discount"), F.col("l_extendedprice"), 1.0, 3.0, 2.0)).alias("s"))


@register("where_mask", f"SELECT {_KEYS}, round(CASE WHEN l_linenumber = 1 THEN l_tax ELSE l_discount END, 6) AS s FROM lineitem")
def where_mask(spark, sf):
    return table(spark, sf, "lineitem").select(*_LINE, _r(A.where(F.col("l_linenumber"), F.col("l_tax"), F.col("l_discount"))).alias("s"))


@register("clamp", f"SELECT {_KEYS}, greatest(10.0::DOUBLE, least(l_quantity, 40.0::DOUBLE)) AS c FROM lineitem")
def clamp(spark, sf):
    return table(spark, sf, "lineitem").select(*_LINE, A.clamp(F.lit(10.0), F.col("l_quantity"), F.lit(40.0)).alias("c"))


@register("relative_error", f"SELECT {_KEYS}, round(CASE WHEN greatest(abs(l_tax), abs(l_discount)) = 0 THEN 0 ELSE abs(l_tax - l_discount) / greatest(abs(l_tax), abs(l_discount)) END, 6) AS e FROM lineitem")
def relative_error(spark, sf):
    return table(spark, sf, "lineitem").select(*_LINE, _r(A.relative_error(F.col("l_tax"), F.col("l_discount"))).alias("e"))


@register("broadcast_mod_repeat", _E + " SELECT vec_id, i, round(v + (i % 4 + 1), 6) AS x FROM e")
def broadcast_mod_repeat(spark, sf):
    e = _embeddings(spark, sf)
    return _long(e, A.map_binary("+", F.col("v"), A.vector([1, 2, 3, 4])), "vec_id")


# -- reductions and products ------------------------------------------------------------------------

_REDUCE = {"min": "min(2 * v)", "max": "max(2 * v)", "sum": "sum(2 * v)", "mean": "avg(2 * v)", "magnitude": "sqrt(sum(4 * v * v))", "magnitude-squared": "sum(4 * v * v)"}
for _k, _s in _REDUCE.items():
    register("reduce_" + _k.replace("-", "_"), _E + f" SELECT vec_id, round({_s}, 6) AS x FROM e GROUP BY vec_id")(lambda spark, sf, k=_k: _embeddings(spark, sf).select("vec_id", _r(A.reduce(k, F.col("v"), 2.0)).alias("x")))


def _weight(r: int, i: int) -> float:
    return ((i * 7 + r * 3) % 11 - 5) / 10.0


_W = "(((i * 7 + r * 3) % 11 - 5) / CAST(10 AS DOUBLE))"


@register("gemv_embeddings", _E + f", w AS (SELECT unnest(range(3)) AS r) SELECT vec_id, CAST(r AS INT) AS i, round(2 * sum(v * {_W}), 6) AS x FROM e CROSS JOIN w GROUP BY vec_id, r")
def gemv_embeddings(spark, sf):
    return _long(_embeddings(spark, sf), A.gemv([[_weight(r, i) for i in range(64)] for r in range(3)], F.col("v"), alpha=2.0), "vec_id")


@register("gemm_linear", _E + f", w AS (SELECT unnest(range(4)) AS r) SELECT vec_id, CAST(r AS INT) AS i, round(sum(v * {_W}) + r, 6) AS x FROM e CROSS JOIN w GROUP BY vec_id, r")
def gemm_linear(spark, sf):
    return _long(_embeddings(spark, sf), A.linear([[_weight(r, i) for i in range(64)] for r in range(4)], range(4), F.col("v")), "vec_id")


_VEC3 = "l_quantity, l_extendedprice / 1000 AS p, l_discount * 100 AS d"


@register("normalize_hypersphere", f"WITH t AS (SELECT {_KEYS}, {_VEC3} FROM lineitem), m AS (SELECT *, 3 / (sqrt(l_quantity * l_quantity + p * p + d * d) + 0.000001) AS f FROM t) SELECT {_KEYS}, round(l_quantity * f, 6) AS x0, round(p * f, 6) AS x1, round(d * f, 6) AS x2 FROM m")
def normalize_hypersphere(spark, sf):
    return _three(spark, sf, lambda v: A.normalize(v, 3.0))


@register("constrain_hypersphere", f"WITH t AS (SELECT {_KEYS}, {_VEC3} FROM lineitem), m AS (SELECT *, 40 / greatest(sqrt(l_quantity * l_quantity + p * p + d * d), 40) AS f FROM t) SELECT {_KEYS}, round(l_quantity * f, 6) AS x0, round(p * f, 6) AS x1, round(d * f, 6) AS x2 FROM m")
def constrain_hypersphere(spark, sf):
    return _three(spark, sf, lambda v: A.constrain(v, 40.0))


def _three(spark, sf, f):
    t = table(spark, sf, "lineitem").withColumn("n", f(F.array("l_quantity", F.col("l_extendedprice") / 1000, F.col("l_discount") * 100)))
    return t.select(*_LINE, *(_r(F.col("n")[i]).alias(f"x{i}") for i in range(3)))


# -- views ---------------------------------------------------------------------------------------------


@register("select_gather", _E + " SELECT vec_id, CAST(CASE i WHEN 5 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS INT) AS i, round(v, 6) AS x FROM e WHERE i IN (5, 0, 63)")
def select_gather(spark, sf):
    return _long(_embeddings(spark, sf), A.gather(F.col("v"), [5, 0, 63]), "vec_id")


@register("transpose_embeddings", _E + " SELECT vec_id, CAST((i % 8) * 8 + i // 8 AS INT) AS i, round(v, 6) AS x FROM e")
def transpose_embeddings(spark, sf):
    return _long(_embeddings(spark, sf), A.transpose(F.col("v"), 8, 8), "vec_id")


@register("submatrix", _E + " SELECT vec_id, CAST((i // 8 - 2) * 4 + i % 8 - 1 AS INT) AS i, round(v, 6) AS x FROM e WHERE i // 8 BETWEEN 2 AND 4 AND i % 8 BETWEEN 1 AND 4")
def submatrix(spark, sf):
    return _long(_embeddings(spark, sf), A.submatrix(F.col("v"), 8, 2, 3, 1, 4), "vec_id")


@register("subvector", _E + " SELECT vec_id, CAST(i - 10 AS INT) AS i, round(v, 6) AS x FROM e WHERE i BETWEEN 10 AND 29")
def subvector(spark, sf):
    return _long(_embeddings(spark, sf), A.subvector(F.col("v"), 10, 20), "vec_id")


# -- network functions -----------------------------------------------------------------------------------


@register("softmax_rows", _E + ", m AS (SELECT vec_id, max(v) AS top FROM e GROUP BY vec_id), x AS (SELECT vec_id, i, exp(v - top) AS p FROM e JOIN m USING (vec_id)) SELECT vec_id, i, round(p / sum(p) OVER (PARTITION BY vec_id), 6) AS x FROM x")
def softmax_rows(spark, sf):
    return _long(_embeddings(spark, sf), A.softmax(F.col("v")), "vec_id")


@register("argmax_last", _E + ", m AS (SELECT vec_id, max(v) AS top FROM e GROUP BY vec_id) SELECT vec_id, CAST(max(i) AS INT) AS arg FROM e JOIN m USING (vec_id) WHERE v = top GROUP BY vec_id")
def argmax_last(spark, sf):
    return _embeddings(spark, sf).select("vec_id", A.argmax(F.col("v")).alias("arg"))


_S = "1 / (1 + exp(-y))"
_ACTIVATION_SQL = {
    "logistic": _S, "tanh": "(exp(y) - exp(-y)) / (exp(y) + exp(-y))", "relu": "greatest(y, 0)", "swish": f"y * {_S}",
    "selu": f"{A.SELU_SCALE}::DOUBLE * CASE WHEN y > 0 THEN y ELSE {A.SELU_ALPHA}::DOUBLE * exp(y) - {A.SELU_ALPHA}::DOUBLE END",
}
for _k, _s in _ACTIVATION_SQL.items():
    register(f"activation_{_k}", _E + f", t AS (SELECT vec_id, i, v * 8 AS y FROM e) SELECT vec_id, i, round(CAST({_s} AS DOUBLE), 6) AS x FROM t")(lambda spark, sf, k=_k: _long(_embeddings(spark, sf), A.activate(k, F.transform("v", lambda x: x * 8.0)), "vec_id"))


@register("activation_prelu", _E + " SELECT vec_id, i, round(CASE WHEN v >= 0 THEN v ELSE 0.25 * v END, 6) AS x FROM e")
def activation_prelu(spark, sf):
    return _long(_embeddings(spark, sf), A.prelu(F.col("v")), "vec_id")


@register("activation_gradients", _E + f", t AS (SELECT vec_id, i, v AS g, {_S} AS o FROM (SELECT *, v * 8 AS y FROM e)) SELECT vec_id, i, round(o * (1 - o) * g, 6) AS x FROM t")
def activation_gradients(spark, sf):
    return _long(_embeddings(spark, sf), A.activation_gradient("logistic", A.activate("logistic", F.transform("v", lambda x: x * 8.0)), F.col("v")), "vec_id")


@register("lrn_channels", _E + ", s AS (SELECT vec_id, i, v, sum(v * v) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS q FROM e) SELECT vec_id, i, round(v / pow(2 + 0.5::DOUBLE / 5 * q, 0.75::DOUBLE), 6) AS x FROM s")
def lrn_channels(spark, sf):
    return _long(_embeddings(spark, sf), A.lrn(F.col("v"), 5, 2.0, 0.5, 0.75), "vec_id")


_BATCH = "vec_id // 50"


@register("batch_norm_stats", _E + f" SELECT CAST({_BATCH} AS BIGINT) AS batch_id, i, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance, round(coalesce(var_samp(v), 0), 6) AS running FROM e GROUP BY 1, 2")
def batch_norm_stats(spark, sf):
    e = _embeddings(spark, sf).select(F.floor(F.col("vec_id") / 50).alias("batch_id"), F.posexplode("v").alias("i", "x"))
    return e.groupBy("batch_id", "i").agg(_r(F.avg("x")).alias("mean"), _r(F.var_pop("x")).alias("variance"), _r(F.coalesce(F.var_samp("x"), F.lit(0.0))).alias("running"))


@register("batch_norm_apply", _E + f", s AS (SELECT {_BATCH} AS b, i, avg(v) AS m, var_pop(v) AS q FROM e GROUP BY 1, 2) SELECT vec_id, e.i, round((v - m) / sqrt(q + 0.0001) * 2 + 1, 6) AS x FROM e JOIN s ON {_BATCH} = b AND e.i = s.i")
def batch_norm_apply(spark, sf):
    e = _embeddings(spark, sf).select("vec_id", F.floor(F.col("vec_id") / 50).alias("b"), F.posexplode("v").alias("i", "v"))
    s = e.groupBy("b", "i").agg(F.avg("v").alias("m"), F.var_pop("v").alias("q"))
    return e.join(s, ["b", "i"]).select("vec_id", "i", _r((F.col("v") - F.col("m")) / F.sqrt(F.col("q") + 1e-4) * 2.0 + 1.0).alias("x"))


def _image_net(layer) -> N.Network:
    return N.Network.build([N.input_(8, 8, 1, id="in"), layer])


_CELLS = "ox AS (SELECT unnest(range({n})) AS ox), oy AS (SELECT unnest(range({n})) AS oy), k AS (SELECT a, b FROM (SELECT unnest(range({k})) AS a) CROSS JOIN (SELECT unnest(range({k})) AS b)), c AS (SELECT vec_id, oy, ox, a, b, oy * {s} + a - {p} AS y, ox * {s} + b - {p} AS x FROM (SELECT DISTINCT vec_id FROM e) CROSS JOIN oy CROSS JOIN ox CROSS JOIN k), g AS (SELECT c.*, e.v FROM c LEFT JOIN e ON e.vec_id = c.vec_id AND y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7 AND e.i = y * 8 + x)"


def _apply(spark, sf, net: N.Network) -> DataFrame:
    e = _embeddings(spark, sf).select("vec_id", "v")
    return _long(net.transform(e, {"in": "v"}), F.col(net.leaves()[0]), "vec_id")


@register("conv2d", _E + ", " + _CELLS.format(n=8, k=3, s=1, p=1) + " SELECT vec_id, CAST(oy * 8 + ox AS INT) AS i, round(0.5 + sum(coalesce(v, 0) * (a * 3 + b - 4) / 10.0::DOUBLE), 6) AS x FROM g GROUP BY vec_id, oy, ox")
def conv2d(spark, sf):
    import numpy as np

    net = _image_net(N.convolutional(3, 1, 1, 1, id="conv"))
    net.parameters["conv.weights"] = (np.arange(9.0)[None] - 4) / 10
    net.parameters["conv.bias"] = np.array([0.5])
    return _apply(spark, sf, net)


for _op, _agg in (("max", "max(coalesce(v, 0))"), ("avg", "sum(coalesce(v, 0)) / 9"), ("avg-exc-pad", "avg(v)")):
    register("pool_" + _op.replace("-", "_"), _E + ", " + _CELLS.format(n=8, k=3, s=1, p=1) + f" SELECT vec_id, CAST(oy * 8 + ox AS INT) AS i, round({_agg}, 6) AS x FROM g GROUP BY vec_id, oy, ox")(lambda spark, sf, op=_op: _apply(spark, sf, _image_net(N.max_pooling(3, 1, 1, op=op, id="pool"))))


@register("network_columns", _E + f", w AS (SELECT unnest(range(3)) AS r), z AS (SELECT vec_id, r, greatest(sum(v * {_W}), 0) AS z FROM e CROSS JOIN w GROUP BY vec_id, r), p AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS p FROM z) SELECT vec_id, CAST(r AS INT) AS i, round(p / sum(p) OVER (PARTITION BY vec_id), 6) AS x FROM p")
def network_columns(spark, sf):
    import numpy as np

    net = N.Network.build([N.input_(64, id="in"), N.linear(3, id="fc"), N.relu(), N.dropout(0.5), N.softmax()])
    net.parameters["fc.weights"] = np.array([[_weight(r, i) for i in range(64)] for r in range(3)])
    return _long(net.project(_embeddings(spark, sf), "v"), F.col("output"), "vec_id")


# -- encoding, batches, samples --------------------------------------------------------------------------


@register("one_hot_columns", "SELECT o_orderkey, " + ", ".join(f"CASE WHEN o_orderstatus = '{s}' THEN 1 ELSE 0 END AS \"o_orderstatus_{s}\"" for s in "FOP") + " FROM orders")
def one_hot_columns(spark, sf):
    return encode.one_hot_columns(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])


@register("reverse_one_hot", "SELECT o_orderkey, o_orderpriority FROM orders")
def reverse_one_hot(spark, sf):
    coded = encode.one_hot_columns(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])
    return encode.reverse_one_hot(coded, ["o_orderpriority"])


@register("one_hot_vector", "WITH c AS (SELECT unnest(['F', 'O', 'P']) AS s, CAST(unnest(range(3)) AS INT) AS i) SELECT o_orderkey, i, CASE WHEN o_orderstatus = s THEN 1.0::DOUBLE ELSE 0 END AS x FROM orders CROSS JOIN c")
def one_hot_vector(spark, sf):
    o = table(spark, sf, "orders")
    return _long(o, A.one_hot_label(["F", "O", "P"], F.col("o_orderstatus")), "o_orderkey")


@register("batch_partition", "WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS n, count(*) OVER () AS c FROM embeddings) SELECT vec_id, CAST(n // 32 AS BIGINT) AS batch_id, CAST(n % 32 AS BIGINT) AS row_in_batch FROM r WHERE n < c // 32 * 32")
def batch_partition(spark, sf):
    return rows.batches(table(spark, sf, "embeddings").select("vec_id"), 32, "vec_id")


@register("pad_to_batch", "WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS n, count(*) OVER () AS c FROM embeddings) SELECT vec_id, CAST(n AS BIGINT) AS row FROM r UNION ALL SELECT vec_id, CAST(n + 48 AS BIGINT) FROM r WHERE n >= c - 48 AND n + 48 < c + (48 - c % 48) % 48")
def pad_to_batch(spark, sf):
    return rows.pad_to_batch(table(spark, sf, "embeddings").select("vec_id"), 48, "vec_id")


@register("label_inverse_counts", f"SELECT vec_id, {_BATCH} AS batch_id, label, round(1.0::DOUBLE / count(*) OVER (PARTITION BY {_BATCH}, label), 6) AS inverse_count FROM embeddings")
def label_inverse_counts(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 50).alias("batch_id"), "label")
    return rows.inverse_label_counts(e, "batch_id", "label").select("vec_id", "batch_id", "label", _r(F.col("inverse_count")).alias("inverse_count"))


@register("class_balanced_interleave", "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS turn FROM events")
def class_balanced_interleave(spark, sf):
    return rows.class_rounds(table(spark, sf, "events").select("event_id", "event_type"), "event_type", "event_id").withColumn("turn", F.col("turn").cast("long"))


@register("class_balanced_epoch", "WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS n, count(*) OVER (PARTITION BY o_orderstatus) AS c FROM orders), t AS (SELECT max(c) AS top FROM r) SELECT o_orderkey, o_orderstatus, CAST(n + k * c AS BIGINT) AS turn FROM (SELECT *, unnest(range((top - 1 - n) // c + 1)) AS k FROM r CROSS JOIN t)")
def class_balanced_epoch(spark, sf):
    return rows.balanced(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey").select("o_orderkey", "o_orderstatus", F.col("turn").cast("long").alias("turn"))


@register("holdout_split", "SELECT doc_id, (doc_id * 7919 % 1000003) % 100 < 90 AS is_train FROM documents")
def holdout_split(spark, sf):
    return rows.holdout(table(spark, sf, "documents").select("doc_id"), "doc_id")


@register("class_split", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.3::DOUBLE) AS is_test FROM orders")
def class_split(spark, sf):
    return rows.class_split(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey").select("o_orderkey", "is_test")


# -- statistics --------------------------------------------------------------------------------------------

_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("column_stats", " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n, round(sum({c}), 2) AS total, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS stddev, round(var_pop({c}) * count({c}) / 1000, 3) AS squares FROM lineitem" for c in _NUM))
def column_stats(spark, sf):
    s = stats.column_stats(table(spark, sf, "lineitem"), _NUM)
    return s.select("name", "n", F.round("total", 2).alias("total"), _r(F.col("mean")).alias("mean"), _r(F.col("stddev")).alias("stddev"), F.round(F.col("squares") / 1000, 3).alias("squares"))


@register("normalize_columns", f"SELECT {_KEYS}, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) AS n_{c[2:]}" for c in _NUM) + " FROM lineitem")
def normalize_columns(spark, sf):
    n = stats.normalize_columns(table(spark, sf, "lineitem").select(*_LINE, *_NUM), _NUM)
    return n.select(*_LINE, *(_r(F.col(c)).alias(f"n_{c[2:]}") for c in _NUM))


@register("global_whiten", _E + ", m AS (SELECT avg(v) AS m FROM e), q AS (SELECT sqrt(avg(v / m * (v / m))) AS q FROM e CROSS JOIN m) SELECT vec_id, i, round(v / m / q, 6) AS x FROM e CROSS JOIN m CROSS JOIN q")
def global_whiten(spark, sf):
    w = stats.global_whiten(_embeddings(spark, sf), "v")
    return _long(w, F.col("v"), "vec_id")


@register("mean_variance", "SELECT round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 6) AS variance FROM lineitem")
def mean_variance(spark, sf):
    return stats.mean_variance(table(spark, sf, "lineitem"), "l_quantity").select(_r(F.col("mean")).alias("mean"), _r(F.col("variance")).alias("variance"))


@register("ensure_gaussian", "WITH m AS (SELECT avg(value) AS m, sqrt(4.0 / var_pop(value)) AS f FROM events) SELECT event_id, round((value - m) * f + 1, 6) AS value FROM events CROSS JOIN m")
def ensure_gaussian(spark, sf):
    return stats.ensure_gaussian(table(spark, sf, "events").select("event_id", "value"), "value", 1.0, 4.0).select("event_id", _r(F.col("value")).alias("value"))


@register("gini_by_group", "WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS c FROM orders GROUP BY 1, 2) SELECT o_orderpriority, round(1 - sum(c * c) / pow(sum(c), 2), 6) AS gini, CAST(sum(c) AS BIGINT) AS n FROM c GROUP BY 1")
def gini_by_group(spark, sf):
    return stats.gini(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderstatus").withColumn("gini", _r(F.col("gini")))


# -- metrics ---------------------------------------------------------------------------------------------------


@register("confusion_matrix", "WITH n AS (SELECT DISTINCT c FROM (SELECT quality AS c FROM labels UNION ALL SELECT toxic FROM labels)), g AS (SELECT a.c AS actual, b.c AS predicted FROM n a CROSS JOIN n b) SELECT actual, predicted, (SELECT count(*) FROM labels WHERE quality = actual AND toxic = predicted) AS n FROM g")
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(table(spark, sf, "labels"), "quality", "toxic")


_B = "sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END)"
_FP = "sum(CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END)"


@register("binary_metrics", f"SELECT round(1 - avg(CASE WHEN quality <> toxic THEN 1 ELSE 0 END), 6) AS accuracy, round(avg(CASE WHEN quality <> toxic THEN 1 ELSE 0 END), 6) AS error_rate, round({_B} / sum(quality), 6) AS recall, round({_B} / ({_B} + {_FP}), 6) AS precision, round({_FP} / sum(CASE WHEN toxic <> 1 THEN 1 ELSE 0 END), 6) AS fpr, round({_B} / sum(toxic), 6) AS tpr, round(1 - {_B} / sum(toxic), 6) AS fnr FROM labels")
def binary_metrics(spark, sf):
    m = metrics.binary_metrics(table(spark, sf, "labels"), "quality", "toxic")
    return m.select(*(_r(F.col(c)).alias(c) for c in m.columns))


_ROC = """WITH s AS (SELECT quality AS y, least(n_chars / 8000.0::DOUBLE, 1) AS e FROM labels JOIN documents USING (doc_id)),
t AS (SELECT i, CAST(i AS DOUBLE) / 100 AS threshold FROM (SELECT unnest(range(101)) AS i)),
c AS (SELECT i, threshold, sum(CASE WHEN e >= threshold THEN 1 ELSE 0 END) AS p, sum(CASE WHEN e >= threshold THEN y ELSE 0 END) AS tp, count(*) AS n FROM s CROSS JOIN t GROUP BY 1, 2),
r AS (SELECT i, threshold, (p - tp) / (n - p) AS fpr, tp / p AS tpr FROM c WHERE p > 0 AND p < n),
d AS (SELECT *, lag(fpr) OVER (ORDER BY i) AS f0, lag(tpr) OVER (ORDER BY i) AS t0 FROM r), curve AS (SELECT threshold, fpr, tpr FROM d WHERE NOT (f0 IS NOT DISTINCT FROM fpr AND t0 IS NOT DISTINCT FROM tpr))"""


def _scored(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.least(F.col("n_chars") / F.lit(8000.0), F.lit(1.0)).alias("e"))
    return table(spark, sf, "labels").join(docs, "doc_id")


@register("roc_curve", _ROC + " SELECT round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM curve")
def roc_curve(spark, sf):
    c = metrics.roc_curve(_scored(spark, sf), "quality", "e")
    return c.select(*(_r(F.col(x)).alias(x) for x in ("threshold", "fpr", "tpr")))


@register("equal_error_point", _ROC + " SELECT round(threshold, 6) AS threshold, round(abs(fpr - (1 - tpr)), 6) AS gap FROM curve ORDER BY abs(fpr - (1 - tpr)), threshold DESC LIMIT 1")
def equal_error_point(spark, sf):
    return metrics.equal_error_point(_scored(spark, sf), "quality", "e").select(_r(F.col("threshold")).alias("threshold"), _r(F.col("gap")).alias("gap"))


@register("eer_accuracy", _ROC + ", b AS (SELECT threshold FROM curve ORDER BY abs(fpr - (1 - tpr)), threshold DESC LIMIT 1) SELECT round(1 - avg(CASE WHEN (e >= threshold) <> (y = 1) THEN 1 ELSE 0 END), 6) AS accuracy, round(max(threshold), 6) AS threshold FROM s CROSS JOIN b")
def eer_accuracy(spark, sf):
    return metrics.eer_accuracy(_scored(spark, sf), "quality", "e").select(_r(F.col("accuracy")).alias("accuracy"), _r(F.col("threshold")).alias("threshold"))


@register("topk_per_cell", "SELECT event_type, event_id, value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 100")
def topk_per_cell(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id", "value")
    return metrics.top_per_cell(e, ["event_type"], "value", "event_id")


# -- losses ----------------------------------------------------------------------------------------------------

_T = "CASE WHEN i = label * 6 THEN 1.0::DOUBLE ELSE 0 END"


def _target() -> Column:
    return F.transform(F.col("v"), lambda x, i: F.when(i == F.col("label") * 6, 1.0).otherwise(0.0))


@register("mse_loss", _E + f" SELECT vec_id, round(avg((v - {_T}) * (v - {_T})), 6) AS loss FROM e GROUP BY vec_id")
def mse_loss(spark, sf):
    return _embeddings(spark, sf).select("vec_id", _r(A.mse_loss(F.col("v"), _target())).alias("loss"))


@register("softmax_loss", _E + f", m AS (SELECT vec_id, max(v) AS top FROM e GROUP BY vec_id), x AS (SELECT vec_id, i, label, exp(v - top) AS p FROM e JOIN m USING (vec_id)) SELECT vec_id, round(-ln(sum(p * {_T}) / sum(p)), 6) AS loss FROM x GROUP BY vec_id")
def softmax_loss(spark, sf):
    return _embeddings(spark, sf).select("vec_id", _r(A.softmax_loss(A.softmax(F.col("v")), _target())).alias("loss"))


@register("censor_loss", _E + f" SELECT vec_id, round(sum(CASE WHEN i % 3 = 0 THEN 0 ELSE (v - {_T}) * (v - {_T}) END) / 64, 6) AS loss FROM e GROUP BY vec_id")
def censor_loss(spark, sf):
    t = F.transform(_target(), lambda x, i: F.when(i % 3 == 0, F.lit(float("nan"))).otherwise(x))
    return _embeddings(spark, sf).select("vec_id", _r(A.censor_loss(F.col("v"), t)).alias("loss"))


def _centroids(e: DataFrame) -> DataFrame:
    """label, center: the mean vector of each label, as an array."""
    means = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    pairs = F.array_sort(F.collect_list(F.struct("i", "m")))
    return means.groupBy("label").agg(F.transform(pairs, lambda p: p["m"]).alias("center"))


@register("center_loss", _E + ", c AS (SELECT label, i, avg(v) AS m FROM e GROUP BY 1, 2) SELECT vec_id, round(sqrt(sum((v - m) * (v - m))) / 2, 6) AS loss FROM e JOIN c ON e.label = c.label AND e.i = c.i GROUP BY vec_id")
def center_loss(spark, sf):
    e = _embeddings(spark, sf)
    return e.join(_centroids(e), "label").select("vec_id", _r(A.center_loss(F.col("v"), F.col("center"))).alias("loss"))


@register("regularization", _E + " SELECT vec_id, round(sum(abs(v)), 6) AS l1, round(sqrt(sum(v * v)) / 2, 6) AS l2 FROM e GROUP BY vec_id")
def regularization(spark, sf):
    return _embeddings(spark, sf).select("vec_id", _r(A.l1_loss(F.col("v"))).alias("l1"), _r(A.l2_loss(F.col("v"))).alias("l2"))


# -- boxes ------------------------------------------------------------------------------------------------------

_BOX = "o_custkey % 40 AS image, o_orderkey AS {id}, CAST(o_orderkey * 31 % 97 AS DOUBLE) AS x, CAST(o_orderkey * 17 % 89 AS DOUBLE) AS y, CAST(4 + o_custkey % 7 AS DOUBLE) AS w, CAST(4 + o_orderkey % 5 AS DOUBLE) AS h"


def _boxes(spark, sf, where: str, name: str) -> DataFrame:
    return table(spark, sf, "orders").where(where).selectExpr(*_BOX.format(id=name).split(", "), "o_orderpriority AS class", "o_totalprice AS score")


_LABELLED, _PREDICTED = "o_orderstatus <> 'O'", "o_orderstatus = 'O'"


def _iou_sql(a: str, b: str) -> str:
    n = f"(greatest(0, least({a}.x + {a}.w / 2, {b}.x + {b}.w / 2) - greatest({a}.x - {a}.w / 2, {b}.x - {b}.w / 2)) * greatest(0, least({a}.y + {a}.h / 2, {b}.y + {b}.h / 2) - greatest({a}.y - {a}.h / 2, {b}.y - {b}.h / 2)))"
    return f"({n} / ({a}.w * {a}.h + {b}.w * {b}.h - {n}))"


def _sides_sql(extra: str = "") -> str:
    return f"l AS (SELECT {_BOX.format(id='label_id')}{extra} FROM orders WHERE {_LABELLED}), p AS (SELECT {_BOX.format(id='pred_id')}{extra} FROM orders WHERE {_PREDICTED})"


def _greedy_sql(name: str, pairs: str, group: str) -> str:
    """CTEs: pairs in order, then one pair of every group a step, taken where both boxes are free."""
    return f"""{name}_k AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY iou DESC, label_id, pred_id) AS r FROM {pairs}),
{name}_w AS (SELECT {group} AS g, 0::BIGINT AS r, []::BIGINT[] AS ls, []::BIGINT[] AS ps, false AS free, NULL::BIGINT AS label_id, NULL::BIGINT AS pred_id, NULL::DOUBLE AS iou FROM (SELECT DISTINCT {group} FROM {pairs})
UNION ALL SELECT w.g, k.r, CASE WHEN w.free THEN list_append(w.ls, w.label_id) ELSE w.ls END, CASE WHEN w.free THEN list_append(w.ps, w.pred_id) ELSE w.ps END,
 NOT list_contains(CASE WHEN w.free THEN list_append(w.ls, w.label_id) ELSE w.ls END, k.label_id) AND NOT list_contains(CASE WHEN w.free THEN list_append(w.ps, w.pred_id) ELSE w.ps END, k.pred_id), k.label_id, k.pred_id, k.iou
 FROM {name}_w w JOIN {name}_k k ON k.{group} = w.g AND k.r = w.r + 1),
{name} AS (SELECT g, label_id, pred_id, iou FROM {name}_w WHERE free)"""


_PAIRS = f"j AS (SELECT l.image AS image, label_id, pred_id, round({_iou_sql('l', 'p')}, 9) AS iou FROM l JOIN p ON l.image = p.image WHERE {_iou_sql('l', 'p')} >= 0.2::DOUBLE)"


@register("iou_pairs", f"WITH {_sides_sql()}, {_PAIRS} SELECT image, label_id, pred_id, round(iou, 6) AS iou FROM j")
def iou_pairs(spark, sf):
    p = detect.iou_pairs(_boxes(spark, sf, _LABELLED, "label_id"), _boxes(spark, sf, _PREDICTED, "pred_id"), "image", "label_id", "pred_id", 0.2, digits=9)
    return p.withColumn("iou", _r(F.col("iou")))


def _matches(spark, sf) -> DataFrame:
    return detect.match_boxes(_boxes(spark, sf, _LABELLED, "label_id"), _boxes(spark, sf, _PREDICTED, "pred_id"), ["image"], "label_id", "pred_id", 0.2)


@register("box_greedy_match", f"WITH RECURSIVE {_sides_sql()}, {_PAIRS}, {_greedy_sql('m', 'j', 'image')} SELECT g AS image, label_id, pred_id, round(iou, 6) AS iou FROM m")
def box_greedy_match(spark, sf):
    return _matches(spark, sf).withColumn("iou", _r(F.col("iou")))


@register(
    "box_location_metrics",
    f"WITH RECURSIVE {_sides_sql()}, {_PAIRS}, {_greedy_sql('m', 'j', 'image')}, c AS (SELECT (SELECT count(*) FROM l) AS n, (SELECT count(*) FROM p) AS q, (SELECT count(*) FROM m) AS k) SELECT n AS n_labels, q AS n_predictions, k AS n_matches, round(k / n, 6) AS sensitivity, round(k / q, 6) AS precision, round(2 * k / (n + q), 6) AS f1 FROM c",
)
def box_location_metrics(spark, sf):
    labels, preds = _boxes(spark, sf, _LABELLED, "label_id"), _boxes(spark, sf, _PREDICTED, "pred_id")
    m = detect.location_metrics(labels, preds, _matches(spark, sf))
    return m.select("n_labels", "n_predictions", "n_matches", *(_r(F.col(c)).alias(c) for c in ("sensitivity", "precision", "f1")))


def _nms_sql(group: str) -> str:
    return f"""WITH RECURSIVE b AS (SELECT {_BOX.format(id='box_id')}, o_orderpriority AS class, o_totalprice AS score FROM orders), k AS (SELECT *, concat_ws('/', {group}) AS g, row_number() OVER (PARTITION BY {group} ORDER BY score DESC, box_id) AS r FROM b),
s AS (SELECT g, r, box_id, true AS kept, [{{'x': x, 'y': y, 'w': w, 'h': h}}] AS boxes FROM k WHERE r = 1
UNION ALL SELECT k.g, k.r, k.box_id, len(list_filter(s.boxes, lambda o: {_iou_sql('o', 'k')} >= 0.2::DOUBLE)) = 0, CASE WHEN len(list_filter(s.boxes, lambda o: {_iou_sql('o', 'k')} >= 0.2::DOUBLE)) = 0 THEN list_append(s.boxes, {{'x': k.x, 'y': k.y, 'w': k.w, 'h': k.h}}) ELSE s.boxes END FROM s JOIN k ON k.g = s.g AND k.r = s.r + 1)
SELECT b.* FROM b JOIN s ON b.box_id = s.box_id WHERE kept"""


@register("nms_by_class", _nms_sql("image, class"))
def nms_by_class(spark, sf):
    return detect.non_maximum_suppression(_boxes(spark, sf, "true", "box_id"), ["image", "class"], "score", "box_id", 0.2)


@register("nms_across_classes", _nms_sql("image"))
def nms_across_classes(spark, sf):
    return detect.non_maximum_suppression(_boxes(spark, sf, "true", "box_id"), ["image"], "score", "box_id", 0.2)


# -- trees ------------------------------------------------------------------------------------------------------


@register(
    "best_split",
    "WITH v AS (SELECT DISTINCT l_returnflag AS g, l_quantity AS t FROM lineitem), s AS (SELECT g, t, l_linestatus AS y, sum(CASE WHEN l_quantity <= t THEN 1 ELSE 0 END) AS l, sum(CASE WHEN l_quantity > t THEN 1 ELSE 0 END) AS r FROM v JOIN lineitem ON l_returnflag = g GROUP BY 1, 2, 3), q AS (SELECT g, t, sum(l) AS nl, sum(r) AS nr, sum(l * l) AS ql, sum(r * r) AS qr FROM s GROUP BY 1, 2) SELECT g AS l_returnflag, t AS threshold, round(CASE WHEN nl = 0 OR nr = 0 THEN 1 ELSE (1 - ql / (nl * nl) + 1 - qr / (nr * nr)) / 2 END, 6) AS score FROM q",
)
def best_split(spark, sf):
    s = tree.split_scores(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_linestatus")
    return s.withColumn("score", _r(F.col("score")))


def _features(spark, sf) -> tuple[DataFrame, list[str]]:
    names = [f"f{i}" for i in range(64)]
    return _embeddings(spark, sf).select("vec_id", "label", *(F.col("v")[i].alias(n) for i, n in enumerate(names))), names


def _order(seed: int) -> list[int]:
    """The features of a tree's levels, as ``tree.grow`` draws them."""
    import random

    names = [f"f{i}" for i in range(64)]
    return [int(n[1:]) for n in random.Random(seed).sample(names, 64)]


def _tree_sql(t: str, features: list[int], weight: str = "1") -> str:
    """CTEs that grow a tree on the embeddings, level by level, and {t}_p (vec_id, predicted)."""
    out = [f"{t}_0 AS (SELECT vec_id, label, {weight} AS c, 0 AS node, true AS open, {', '.join(f'CAST(embedding[{f + 1}] AS DOUBLE) AS v{f}' for f in features)} FROM embeddings)"]
    for n, f in enumerate(features):
        out.append(f"""{t}_u{n} AS (SELECT node FROM {t}_{n} WHERE open GROUP BY node HAVING count(DISTINCT label) FILTER (WHERE c > 0) > 1 AND sum(c) >= 2),
{t}_v{n} AS (SELECT DISTINCT node, v{f} AS v FROM {t}_{n} JOIN {t}_u{n} USING (node) WHERE open AND c > 0),
{t}_s{n} AS (SELECT v.node, v.v, label, sum(CASE WHEN v{f} <= v.v THEN c ELSE 0 END) AS l, sum(CASE WHEN v{f} > v.v THEN c ELSE 0 END) AS r FROM {t}_v{n} v JOIN {t}_{n} x ON x.node = v.node AND x.open GROUP BY 1, 2, 3),
{t}_q{n} AS (SELECT node, v, sum(l) AS nl, sum(r) AS nr, sum(l * l) AS ql, sum(r * r) AS qr FROM {t}_s{n} GROUP BY 1, 2),
{t}_c{n} AS (SELECT node, v AS cut FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(score, 12), v DESC) AS k FROM (SELECT node, v, CASE WHEN nl = 0 OR nr = 0 THEN 1 ELSE (1 - ql / (nl * nl) + 1 - qr / (nr * nr)) / 2 END AS score FROM {t}_q{n})) WHERE k = 1 AND score < 1),
{t}_{n + 1} AS (SELECT vec_id, label, c, CASE WHEN cut IS NULL THEN x.node WHEN v{f} <= cut THEN 2 * x.node + 1 ELSE 2 * x.node + 2 END AS node, open AND cut IS NOT NULL AS open, {', '.join(f'v{g}' for g in features)} FROM {t}_{n} x LEFT JOIN {t}_c{n} s ON s.node = x.node AND x.open)""")
    n = len(features)
    out.append(f"{t}_m AS (SELECT node, label AS predicted FROM (SELECT node, label, row_number() OVER (PARTITION BY node ORDER BY sum(c) DESC, CAST(label AS VARCHAR)) AS k FROM {t}_{n} WHERE c > 0 GROUP BY node, label) WHERE k = 1), {t}_p AS (SELECT vec_id, label, predicted FROM {t}_{n} LEFT JOIN {t}_m USING (node))")
    return ",\n".join(out)


@register("tree_classify", "WITH " + _tree_sql("t", _order(3)[:3]) + " SELECT vec_id, label, predicted FROM t_p")
def tree_classify(spark, sf):
    df, names = _features(spark, sf)
    t = tree.grow(df, names, "label", depth=3, seed=3)
    return df.select("vec_id", "label", t.column().alias("predicted"))


def _forest(seed: int, trees: int, depth: int) -> list[tuple[list[int], int]]:
    """Features of each tree's levels, and its seed, as ``tree.forest`` draws them."""
    import random

    rng, out = random.Random(seed), []
    for _ in range(trees):
        some, own = rng.sample([f"f{i}" for i in range(64)], 64), rng.randrange(1000)
        out.append(([int(n[1:]) for n in random.Random(own).sample(some, 64)[:depth]], own))
    return out


_FOREST = _forest(5, 3, 2)


@register(
    "forest_vote",
    "WITH " + ",\n".join(_tree_sql(f"t{k}", fs, f"CAST((vec_id * 7919 + {own} * 104729) % 1000003 % 3 AS INT)") for k, (fs, own) in enumerate(_FOREST)) + ", a AS (" + " UNION ALL ".join(f"SELECT vec_id, label, predicted FROM t{k}_p" for k in range(3)) + "), n AS (SELECT vec_id, label, predicted, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, predicted) AS k FROM a GROUP BY vec_id, label, predicted) SELECT vec_id, label, predicted FROM n WHERE k = 1",
)
def forest_vote(spark, sf):
    df, names = _features(spark, sf)
    return df.select("vec_id", "label", tree.vote(tree.forest(df, names, "label", trees=3, id_col="vec_id", depth=2, seed=5)).alias("predicted"))


# -- training -------------------------------------------------------------------------------------------------------

_G = "WITH g AS (SELECT avg(2 * (0.5 * l_quantity + 2 * l_discount - l_tax * 100) * l_quantity) AS g0, avg(2 * (0.5 * l_quantity + 2 * l_discount - l_tax * 100) * l_discount) AS g1 FROM lineitem)"


def _gradient(spark, sf) -> DataFrame:
    t = table(spark, sf, "lineitem")
    miss = 0.5 * F.col("l_quantity") + 2.0 * F.col("l_discount") - F.col("l_tax") * 100
    return t.agg(F.avg(2.0 * miss * F.col("l_quantity")).alias("g0"), F.avg(2.0 * miss * F.col("l_discount")).alias("g1"))


def _stepped(spark, sf, make) -> DataFrame:
    import numpy as np

    r = _gradient(spark, sf).first()
    opt, x = make(), np.array([0.5, 2.0])
    for _ in range(2):
        x = opt.step(x, np.array([r["g0"], r["g1"]]))
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(x)], "i int, x double")


def _both(f: str) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS i, round({f.format(g=f'g{i}', x=x)}, 6) AS x FROM g" for i, x in ((0, "0.5::DOUBLE"), (1, "2.0::DOUBLE")))


@register("sgd_step", _G + " " + _both("{x} - 0.0019::DOUBLE * {g} + 0.0009::DOUBLE * {g} - 1.9::DOUBLE * (0.0009::DOUBLE + 0.001::DOUBLE) * {g}"))
def sgd_step(spark, sf):
    """Two steps with the same gradient."""
    return _stepped(spark, sf, optimizers.SGD)


@register("adam_step", _G + " " + _both("{x} - 2 * 0.001::DOUBLE * {g} / (abs({g}) + 0.00000001::DOUBLE)"))
def adam_step(spark, sf):
    return _stepped(spark, sf, optimizers.Adam)


_D1 = "(-sqrt(0.000001::DOUBLE) / sqrt({g} * {g} * 0.05::DOUBLE + 0.000001::DOUBLE) * {g})"


@register("adadelta_step", _G + " " + _both("{x} + " + _D1 + " - sqrt(" + _D1 + " * " + _D1 + " * 0.05::DOUBLE + 0.000001::DOUBLE) / sqrt({g} * {g} * 0.05::DOUBLE * 1.95::DOUBLE + 0.000001::DOUBLE) * {g}"))
def adadelta_step(spark, sf):
    return _stepped(spark, sf, optimizers.Adadelta)


_RATE = 0.5
_TRAIN = f"""e0 AS (SELECT vec_id, label, i, v, row_number() OVER (PARTITION BY i ORDER BY vec_id) AS place, count(*) OVER (PARTITION BY i) AS n FROM e), t AS (SELECT vec_id, label, i, v FROM e0 WHERE place <= n // 50 * 50),
x AS (SELECT vec_id, label, i, v FROM t UNION ALL SELECT DISTINCT vec_id, label, 64, 1.0::DOUBLE FROM t), c AS (SELECT unnest(range(10)) AS r), z AS (SELECT count(DISTINCT vec_id) AS n FROM t),
w1 AS (SELECT r, i, sum({_RATE}::DOUBLE * 0.2::DOUBLE * CASE WHEN label = r THEN v ELSE 0 END) / max(n) AS w FROM x CROSS JOIN c CROSS JOIN z GROUP BY r, i),
g1 AS (SELECT vec_id, label, r, sum(w * v) - max(CASE WHEN label = r THEN 1.0::DOUBLE ELSE 0 END) AS d FROM x JOIN w1 USING (i) GROUP BY vec_id, label, r),
w2 AS (SELECT w1.r, w1.i, max(w) - sum({_RATE}::DOUBLE * 0.2::DOUBLE * d * v) / max(n) AS w FROM w1 JOIN g1 ON g1.r = w1.r JOIN x ON x.vec_id = g1.vec_id AND x.i = w1.i CROSS JOIN z GROUP BY w1.r, w1.i),
y AS (SELECT vec_id, label, i, v FROM e UNION ALL SELECT DISTINCT vec_id, label, 64, 1.0::DOUBLE FROM e)"""


@register("network_train", _E + ", " + _TRAIN + " SELECT vec_id, CAST(r AS INT) AS i, round(sum(w * v), 6) AS x FROM y JOIN w2 USING (i) GROUP BY vec_id, r")
def network_train(spark, sf):
    """Two steps of a linear network over all full batches, and its outputs."""
    import numpy as np

    e = _embeddings(spark, sf).withColumn("target", A.one_hot(F.col("label"), 10))
    net = N.Network.build([N.input_(64, id="in"), N.linear(10, id="out", weights=np.zeros(640), bias=np.zeros(10))])
    for _ in N.epochs(net, rows.full_batches(e, 50, "vec_id"), {"in": "v"}, {"out": "target"}, optimizers.PlainSGD(_RATE), 2, step=1_000_000):
        pass
    return _long(net.transform(e.select("vec_id", "v"), {"in": "v"}), F.col("out"), "vec_id")


# -- objectives --------------------------------------------------------------------------------------------------

_V = [f"(CAST(embedding[4 * block + {i + 1}] AS DOUBLE) + 0.5::DOUBLE)" for i in range(4)]
_a, _b, _c, _d = _V


def _sum(f: str) -> str:
    return "(" + " + ".join(f.format(x=x, n=i + 1) for i, x in enumerate(_V)) + ")"


_OBJECTIVE_SQL = {
    "cross_paraboloid": f"pow({_a} + {_b}, 2) + pow({_b} + {_c}, 2) + pow({_c} + {_d}, 2) + pow({_d} + {_a}, 2)",
    "de_jong": _sum("{x} * {x}"),
    "axis_parallel": _sum("{n} * {x} * {x}"),
    "rotated": f"pow({_a}, 2) + pow({_a} + {_b}, 2) + pow({_a} + {_b} + {_c}, 2) + pow({_a} + {_b} + {_c} + {_d}, 2)",
    "moved_axis": _sum("5 * {n} * {x} * {x}"),
    "rosenbrock": " + ".join(f"100 * pow({y} - {x} * {x}, 2) + pow(1 - {x}, 2)" for x, y in zip(_V, _V[1:])),
    "rastrigin": f"40 + {_sum('{x} * {x} - 10 * cos(2 * pi() * {x})')}",
    "schwefel": _sum("(-{x}) * sin(sqrt(abs({x})))"),
    "griewangk": f"{_sum('{x} * {x} / 4000')} - " + " * ".join(f"cos({x} / sqrt({i + 1}::DOUBLE))" for i, x in enumerate(_V)) + " + 1",
    "powers": _sum("pow(abs({x}), {n} + 1)"),
    "ackley": f"20 + exp(1.0::DOUBLE) - 20 * exp(-0.1::DOUBLE * sqrt({_sum('{x} * {x}')})) - exp(0.25::DOUBLE * {_sum('cos(2 * pi() * {x})')})",
    "michalewicz": f"-{_sum('sin({x}) * pow(sin({n} * {x} * {x} / pi()), 20)')}",
    "branin": f"pow({_b} + 5 / pi() * {_a} - 5.1::DOUBLE / (4 * pi() * pi()) * {_a} * {_a} - 6, 2) + 10 * (1 - 1 / (8 * pi())) * cos({_a}) + 10",
    "easom": f"-(cos({_a}) * cos({_b}) * exp(-(pow({_a} - pi(), 2) + pow({_b} - pi(), 2))))",
    "camel": f"(4 - 2.1::DOUBLE * {_a} * {_a} + pow({_a}, 4.0::DOUBLE / 3)) * {_a} * {_a} + {_a} * {_b} + (4 * {_b} * {_b} - 4) * {_b} * {_b}",
}


@register("objective_functions", "SELECT vec_id, CAST(block AS INT) AS block, " + ", ".join(f"round({s}, 6) AS f_{k}" for k, s in _OBJECTIVE_SQL.items()) + " FROM embeddings CROSS JOIN (SELECT unnest(range(16)) AS block)")
def objective_functions(spark, sf):
    """All entries of every vector, four at a time."""
    blocks = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: F.transform(F.slice("v", 4 * b + 1, 4), lambda x: x + 0.5))
    return _embeddings(spark, sf).select("vec_id", F.posexplode(blocks).alias("block", "p")).select("vec_id", "block", *(_r(f(F.col("p"))).alias(f"f_{k}") for k, f in OBJECTIVES.items()))


# -- flagship --------------------------------------------------------------------------------------------------------


@register(
    "centroid_confusion",
    _E
    + """, s AS (SELECT i, avg(v) AS m, stddev_samp(v) AS d FROM e GROUP BY i),
z AS (SELECT vec_id, label, e.i, (v - m) / CASE WHEN abs(d) < 0.000001 THEN 1 ELSE d END AS z FROM e JOIN s ON e.i = s.i),
c AS (SELECT label, i, avg(z) AS c FROM z GROUP BY 1, 2),
q AS (SELECT vec_id, z.label AS actual, c.label AS predicted, sqrt(sum((z - c) * (z - c))) AS dist FROM z JOIN c ON z.i = c.i GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(dist, 9), predicted DESC) AS k FROM q),
n AS (SELECT DISTINCT actual AS a FROM r WHERE k = 1 UNION SELECT DISTINCT predicted FROM r WHERE k = 1)
SELECT x.a AS actual, y.a AS predicted, (SELECT count(*) FROM r WHERE k = 1 AND actual = x.a AND predicted = y.a) AS n FROM n x CROSS JOIN n y""",
)
def centroid_confusion(spark, sf):
    """Standardise each dimension, find class centroids, classify by the nearest one (softmax
    of the negative distance, last argmax), and count the confusion matrix."""
    e = _embeddings(spark, sf)
    long = e.select("vec_id", "label", F.posexplode("v").alias("i", "x"))
    s = long.groupBy("i").agg(F.avg("x").alias("m"), stats.safe_divisor(F.stddev_samp("x")).alias("d"))
    vectors = s.agg(F.array_sort(F.collect_list(F.struct("i", "m", "d"))).alias("s"))  # a row of 64 entries
    z = e.crossJoin(F.broadcast(vectors)).select("vec_id", "label", F.zip_with("v", "s", lambda x, p: (x - p["m"]) / p["d"]).alias("v"))
    centers = _centroids(z).agg(F.array_sort(F.collect_list(F.struct("label", "center"))).alias("c"))  # a row of the classes
    near = z.crossJoin(F.broadcast(centers)).withColumn("p", F.transform("c", lambda c: -F.round(2.0 * A.center_loss(F.col("v"), c["center"]), 9)))
    labelled = near.select(F.col("label").alias("actual"), F.element_at("c", A.argmax(A.softmax(F.col("p"))) + 1)["label"].alias("predicted"))
    return metrics.confusion_matrix(labelled, "actual", "predicted")


from quern import registry_extra  # noqa: E402, F401 (adds its queries)
