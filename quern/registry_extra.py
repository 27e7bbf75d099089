"""More registered queries: tensor views, products, helpers, losses, detection, normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import arrays as A
from quern.functions import tensors as X
from quern.functions import utils as U
from quern.functions.objectives import GRADIENTS
from quern.operators import detect, rows
from quern.plans import network as N
from quern.plans import optimizers
from quern.registry import _BATCH, _BOX, _CELLS, _E, _S, _KEYS, _LABELLED, _LINE, _PREDICTED, _T, _W, _boxes, _embeddings, _greedy_sql, _iou_sql, _long, _r, _sides_sql, _target, _weight, register
from quern.sources.io import table

# -- views ------------------------------------------------------------------------------------------


@register("tensor_select_transposed", _E + " SELECT vec_id, CAST(CASE i % 8 WHEN 6 THEN 0 ELSE 8 END + i // 8 AS INT) AS i, round(v, 6) AS x FROM e WHERE i % 8 IN (6, 1)")
def tensor_select_transposed(spark, sf):
    dims = X.Dims.of(8, 8).transpose((1, 0)).select([6, 1], None)
    return _long(_embeddings(spark, sf), X.view(F.col("v"), dims), "vec_id")


@register("tensor_reshape", _E + " SELECT vec_id, CAST((i // 4 % 2) * 8 + i // 16 * 2 + i % 4 - 1 AS INT) AS i, round(v, 6) AS x FROM e WHERE i % 16 // 4 < 2 AND i % 4 IN (1, 2)")
def tensor_reshape(spark, sf):
    """(64) as (4, 4, 4), a block of it with its dimensions in another order."""
    dims = X.Dims.of(64).reshape(4, 4, 4).select(None, [0, 1], [1, 2]).transpose((1, 0, 2))
    return _long(_embeddings(spark, sf), X.view(F.col("v"), dims), "vec_id")


def _lines(df, lines):
    return df.select("vec_id", F.posexplode(lines).alias("line", "v")).select("vec_id", "line", F.posexplode("v").alias("i", "x")).withColumn("x", _r(F.col("x")))


@register("tensor_rows", _E + " SELECT vec_id, CAST(i // 16 AS INT) AS line, CAST(i % 16 AS INT) AS i, round(v, 6) AS x FROM e")
def tensor_rows(spark, sf):
    return _lines(_embeddings(spark, sf), X.rows(F.col("v"), X.Dims.of(2, 2, 16)))


@register("tensor_columns", _E + " SELECT vec_id, CAST(i % 16 AS INT) AS line, CAST(i // 16 AS INT) AS i, round(v, 6) AS x FROM e")
def tensor_columns(spark, sf):
    return _lines(_embeddings(spark, sf), X.columns(F.col("v"), X.Dims.of(4, 16)))


@register("broadcast_dimensions", _E + " SELECT vec_id, i, round(v * 2 * (10 * (i // 4 % 4) + 10), 6) AS x FROM e")
def broadcast_dimensions(spark, sf):
    made = X.broadcast_binary("*", F.col("v"), X.Dims.of(4, 4, 4), A.vector([10, 20, 30, 40]), X.Dims.of(4, 1), 2.0)
    return _long(_embeddings(spark, sf), made, "vec_id")


@register("index_address", f"WITH t AS (SELECT {_KEYS}, l_orderkey % 60 AS n FROM lineitem) SELECT {_KEYS}, CAST(n // 10 + CASE n // 5 % 2 WHEN 0 THEN 90 ELSE 0 END + n % 5 * 6 AS INT) AS address FROM t")
def index_address(spark, sf):
    dims = X.Dims.of(4, 5, 6).transpose((2, 0, 1)).select(None, [3, 0], None)
    return table(spark, sf, "lineitem").select(*_LINE, dims.address(F.col("l_orderkey") % 60).alias("address"))


@register("tensor_shape", "SELECT vec_id, CAST(len(embedding) AS INT) AS ecount, CAST(len(embedding) // 16 AS INT) AS batch, 'array<double>' AS datatype, true AS dense FROM embeddings")
def tensor_shape(spark, sf):
    dims = X.Dims.of(4, 16)
    e = _embeddings(spark, sf)
    return e.select("vec_id", F.size(X.checked(F.col("v"), dims.ecount)).alias("ecount"), F.lit(dims.batch_size).alias("batch"), F.typeof("v").alias("datatype"), F.lit(dims.dense).alias("dense"))


@register("tensor_fill", _E + " SELECT vec_id, i, 0.0::DOUBLE AS zero, 7.5::DOUBLE AS x FROM e")
def tensor_fill(spark, sf):
    both = F.arrays_zip(X.like(F.col("v")).alias("zero"), X.fill(F.col("v"), X.numbers("+", 2.5, 5.0)).alias("x"))
    return _embeddings(spark, sf).select("vec_id", F.posexplode(both).alias("i", "b")).select("vec_id", "i", "b.zero", "b.x")


@register("identity_matrix", "SELECT i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0 END AS x FROM (SELECT unnest(range(40)) AS i) CROSS JOIN (SELECT unnest(range(40)) AS j)")
def identity_matrix(spark, sf):
    return X.identity_matrix(spark, 40)


# -- products ------------------------------------------------------------------------------------------


@register("gemm_transposed", _E + ", p AS (SELECT a.vec_id, a.i % 8 * 8 + b.i % 8 AS i, sum(a.v * b.v) AS s FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i // 8 = b.i // 8 GROUP BY 1, 2) SELECT vec_id, CAST(i AS INT) AS i, round(0.5 * s + 2 * v, 6) AS x FROM p JOIN e USING (vec_id, i)")
def gemm_transposed(spark, sf):
    v, d = F.col("v"), X.Dims.of(8, 8)
    return _long(_embeddings(spark, sf), X.gemm(v, d, v, d, 0.5, 2.0, v, trans_a=True), "vec_id")


@register("gemv_transposed", _E + " SELECT vec_id, CAST(i % 16 AS INT) AS i, round(3 * sum(v * (i // 16 + 1)), 6) AS x FROM e GROUP BY vec_id, i % 16")
def gemv_transposed(spark, sf):
    return _long(_embeddings(spark, sf), X.gemv(F.col("v"), X.Dims.of(4, 16), A.vector([1, 2, 3, 4]), 3.0, trans=True), "vec_id")


@register("gram_matrix", _E + " SELECT CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, round(sum(a.v * b.v), 5) AS x FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2")
def gram_matrix(spark, sf):
    return X.gram(_embeddings(spark, sf), "v").withColumn("x", F.round("x", 5))


@register("gemm_tables", _E + " SELECT CAST(label AS BIGINT) AS i, CAST(e.i AS BIGINT) AS j, round(0.25 * sum(v) + CASE WHEN label = e.i THEN 3 ELSE 0 END, 5) AS x FROM e GROUP BY label, e.i")
def gemm_tables(spark, sf):
    """Class sums: (rows x classes)' times (rows x entries), plus an identity."""
    e = _embeddings(spark, sf)
    a = e.select(F.col("vec_id").alias("i"), F.col("label").cast("long").alias("j"), F.lit(1.0).alias("x"))
    b = e.select(F.col("vec_id").alias("i"), F.posexplode("v").alias("j", "x")).withColumn("j", F.col("j").cast("long"))
    return X.gemm_tables(a, b, 0.25, 3.0, X.identity_matrix(spark, 10), trans_a=True).withColumn("x", F.round("x", 5))


@register("softmax_gradient", _E + ", p AS (SELECT vec_id, i, exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id) AS p FROM e WHERE i < 6) SELECT a.vec_id, CAST(a.i AS INT) AS line, CAST(b.i AS INT) AS i, round(CASE WHEN a.i = b.i THEN a.p ELSE 0 END - a.p * b.p, 6) AS x FROM p a JOIN p b USING (vec_id)")
def softmax_gradient(spark, sf):
    e = _embeddings(spark, sf).withColumn("p", A.softmax(F.slice("v", 1, 6)))
    return _lines(e, X.softmax_gradient(F.col("p")))


# -- helpers ---------------------------------------------------------------------------------------------

_REL = "CASE WHEN greatest(abs({a}), abs({b})) = 0 THEN 0 ELSE abs({a} - {b}) / greatest(abs({a}), abs({b})) END"


@register("approx_compare", f"SELECT {_KEYS}, {_REL.format(a='l_tax', b='l_discount')} <= 0.25::DOUBLE AS near, abs(l_tax - l_discount) < 0.000001::DOUBLE AS very_near FROM lineitem")
def approx_compare(spark, sf):
    a, b = F.col("l_tax"), F.col("l_discount")
    return table(spark, sf, "lineitem").select(*_LINE, U.approx_equal(0.25, a, b).alias("near"), U.very_near(a, b).alias("very_near"))


@register("approx_vectors", _E + f", w AS (SELECT *, v + CASE WHEN i = vec_id % 64 THEN 0.01::DOUBLE ELSE 0 END AS u FROM e), r AS (SELECT *, {_REL.format(a='u', b='v')} AS q FROM w) SELECT vec_id, bool_and(q <= 0.05::DOUBLE) AS same, round(max(q), 6) AS worst FROM r GROUP BY vec_id")
def approx_vectors(spark, sf):
    e = _embeddings(spark, sf).withColumn("u", F.transform("v", lambda x, i: x + F.when(i == F.col("vec_id") % 64, 0.01).otherwise(0.0)))
    return e.select("vec_id", U.approx_equal(0.05, F.col("u"), F.col("v"), 1).alias("same"), _r(F.array_max(U.approx_diff(F.col("u"), F.col("v"), 1))).alias("worst"))


@register("map_helpers", "SELECT o_orderkey, o_orderkey * 2 AS a, CASE WHEN o_orderstatus = 'P' THEN o_custkey ELSE o_orderkey % 7 END * 2 AS b, CASE WHEN o_orderstatus = 'P' THEN -1 ELSE 2 END AS c, 'last' AS x, o_orderpriority AS y FROM orders")
def map_helpers(spark, sf):
    first = F.create_map(F.lit("a"), F.col("o_orderkey"), F.lit("b"), F.col("o_custkey"))
    second = F.when(F.col("o_orderstatus") != "P", F.create_map(F.lit("b"), F.col("o_orderkey") % 7, F.lit("c"), F.lit(1).cast("long")))
    m = U.map_vals(lambda v: v * 2, U.map_keys(F.upper, U.deep_merge(first, second)))
    args = U.args_to_map(F.array(F.lit("x"), F.col("o_orderstatus"), F.lit("y"), F.col("o_orderpriority"), F.lit("x"), F.lit("last")))
    none = F.lit(-1).cast("long")
    return table(spark, sf, "orders").select("o_orderkey", *(U.get_or(m, k.upper(), none).alias(k) for k in "abc"), *(U.get_or(args, k, F.lit("")).alias(k) for k in "xy"))


@register("deep_merge_nested", "SELECT o_orderkey, o_custkey AS x, o_orderkey % 5 AS y, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 9 END AS z FROM orders")
def deep_merge_nested(spark, sf):
    inner = lambda k, v: F.create_map(F.lit(k), v.cast("long"))
    a = F.create_map(F.lit("p"), inner("x", F.col("o_custkey")), F.lit("q"), inner("z", F.lit(1)))
    b = F.create_map(F.lit("p"), inner("y", F.col("o_orderkey") % 5))
    c = F.when(F.col("o_orderstatus") != "O", F.create_map(F.lit("q"), inner("z", F.lit(9))))
    t = table(spark, sf, "orders").withColumn("m", U.deep_merge(a, b, c, depth=2))
    return t.select("o_orderkey", F.col("m")["p"]["x"].alias("x"), F.col("m")["p"]["y"].alias("y"), F.col("m")["q"]["z"].alias("z"))


@register("parse_numbers", "SELECT o_orderkey, o_orderkey + 1 AS a, o_totalprice * 2 AS b FROM orders")
def parse_numbers(spark, sf):
    long, double = U.parse_long(F.col("o_orderkey").cast("string")), U.parse_double(F.col("o_totalprice").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", (long + 1).alias("a"), (double * 2.0).alias("b"))


@register("sformat", "SELECT o_orderkey, printf('%d|%.2f|[%.1f %.1f]|%s|100%%', o_orderkey, o_totalprice, CAST(o_custkey AS DOUBLE), CAST(o_orderkey AS DOUBLE), o_orderpriority) AS s FROM orders")
def sformat(spark, sf):
    made = U.sformat("%d|%.2f|%.1f|%s|100%%", F.col("o_orderkey"), F.col("o_totalprice"), U.Each(F.array("o_custkey", "o_orderkey")), F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", made.alias("s"))


@register("pack_unpack", _E + " SELECT vec_id, CAST(CASE WHEN i < 24 THEN 0 WHEN i < 25 THEN 1 ELSE 2 END AS INT) AS line, CAST(i - CASE WHEN i < 24 THEN 0 WHEN i < 25 THEN 24 ELSE 25 END AS INT) AS i, round(v, 6) AS x FROM e")
def pack_unpack(spark, sf):
    v = F.col("v")
    packed = U.pack(F.array(A.subvector(v, 0, 10), A.subvector(v, 10, 50), A.subvector(v, 60)))
    return _lines(_embeddings(spark, sf), U.unpack(packed, [24, 1, 39]))


@register("row_ranges", "WITH n AS (SELECT count(*) AS n FROM lineitem) SELECT k * (n // 7) AS start, CASE WHEN k = 6 THEN n - 6 * (n // 7) ELSE n // 7 END AS length FROM n CROSS JOIN (SELECT unnest(range(7)) AS k)")
def row_ranges(spark, sf):
    return spark.createDataFrame(U.row_ranges(7, table(spark, sf, "lineitem").count()), "start long, length long")


# -- losses --------------------------------------------------------------------------------------------------


@register("evaluate_mse", _E + f", d AS (SELECT vec_id, sqrt(sum((v - {_T}) * (v - {_T}))) AS d FROM e GROUP BY vec_id) SELECT round(avg(d), 6) AS distance FROM d")
def evaluate_mse(spark, sf):
    e = _embeddings(spark, sf).withColumn("t", _target())
    return N.evaluate_mse(e, "v", "t").select(_r(F.col("distance")).alias("distance"))


@register("evaluate_softmax", _E + ", m AS (SELECT vec_id, max(v) AS top FROM e WHERE i < 10 GROUP BY vec_id), a AS (SELECT vec_id, label, max(i) AS i FROM e JOIN m USING (vec_id) WHERE v = top AND i < 10 GROUP BY vec_id, label) SELECT round(avg(CASE WHEN i = label THEN 1 ELSE 0 END), 6) AS accuracy FROM a")
def evaluate_softmax(spark, sf):
    e = _embeddings(spark, sf).select(F.slice("v", 1, 10).alias("v"), A.one_hot(F.col("label"), 10).alias("t"))
    return N.evaluate_softmax(e, "v", "t").select(_r(F.col("accuracy")).alias("accuracy"))


_NET3 = f"w AS (SELECT r, i, {_W} AS w FROM (SELECT unnest(range(10)) AS r) CROSS JOIN (SELECT unnest(range(64)) AS i)), o AS (SELECT vec_id, label, r, sum(w * v) AS o FROM e JOIN w USING (i) GROUP BY 1, 2, 3)"


def _regularized() -> N.Network:
    weights = [[_weight(r, i) for i in range(64)] for r in range(10)]
    out = N.linear(10, id="out", weights={"buffer": weights, "l1_regularization": 0.5, "l2_regularization": {"weight": 0.25}}, l2_regularization=2.0)
    return N.Network.build([N.input_(64, id="in"), out])


@register(
    "loss_terms",
    _E + f", {_NET3} SELECT 'out' AS leaf, 'mse' AS loss, round(avg((o - CASE WHEN label = r THEN 1 ELSE 0 END) * (o - CASE WHEN label = r THEN 1 ELSE 0 END)), 6) AS value, 1.0::DOUBLE AS weight FROM o"
    " UNION ALL SELECT 'out', 'l2_regularization', round(2 * avg(d) / 2, 6), 2.0 FROM (SELECT sqrt(sum(o * o)) AS d FROM o GROUP BY vec_id)"
    " UNION ALL SELECT 'out', 'l1_regularization', round(0.5 * sum(abs(w)), 6), 0.5 FROM w UNION ALL SELECT 'out', 'l2_regularization', round(0.25 * sqrt(sum(w * w)) / 2, 6), 0.25 FROM w",
)
def loss_terms(spark, sf):
    e = _embeddings(spark, sf).withColumn("t", A.one_hot(F.col("label"), 10))
    return _regularized().evaluate(e, {"in": "v"}, {"out": "t"}).withColumn("value", _r(F.col("value")))


@register("loss_table", "SELECT * FROM (VALUES ('mse', 1.0::DOUBLE, 'out', 'output'), ('l2_regularization', 2.0, 'out', 'output'), ('l1_regularization', 0.5, 'out', 'weights'), ('l2_regularization', 0.25, 'out', 'weights')) AS t(type, weight, node, argument)")
def loss_table(spark, sf):
    return _regularized().loss_table(spark)


@register(
    "regularized_step",
    _E + f", {_NET3}, z AS (SELECT count(DISTINCT vec_id) AS n FROM e), g AS (SELECT r, e.i, sum((0.2 * (o - CASE WHEN o.label = r THEN 1 ELSE 0 END) + 2 * o) * v) AS g FROM o JOIN e USING (vec_id) GROUP BY 1, 2)"
    " SELECT CAST(r AS INT) AS line, CAST(i AS INT) AS i, round(w - 0.5::DOUBLE * (g + 0.5::DOUBLE * CASE WHEN w >= 0 THEN 1 ELSE -1 END + 0.25::DOUBLE * w) / n, 6) AS x FROM w JOIN g USING (r, i) CROSS JOIN z",
)
def regularized_step(spark, sf):
    """One step with all terms of the loss, on the whole table as one batch; the weights after it."""
    e = _embeddings(spark, sf).withColumn("t", A.one_hot(F.col("label"), 10)).withColumn("batch_id", F.lit(0))
    net = _regularized()
    net.train(e, {"in": "v"}, {"out": "t"}, optimizers.PlainSGD(0.5))
    w = net.parameters["out.weights"].tolist()
    return spark.createDataFrame([(r, i, round(x, 6)) for r, line in enumerate(w) for i, x in enumerate(line)], "line int, i int, x double")


# -- batch normalisation -----------------------------------------------------------------------------------------

_FULL = "e1 AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY vec_id) - 1 AS place, count(*) OVER (PARTITION BY i) AS n FROM e), t AS (SELECT vec_id, i, v, place // 50 AS b, n // 50 AS batches FROM e1 WHERE place < n // 50 * 50)"


@register(
    "batch_norm_spatial",
    _E + f", s AS (SELECT {_BATCH} AS b, i // 16 AS c, avg(v) AS m, var_pop(v) AS q FROM e GROUP BY 1, 2) SELECT vec_id, CAST(e.i AS INT) AS i, round((v - m) / sqrt(q + 0.0001::DOUBLE), 6) AS x FROM e JOIN s ON {_BATCH} = b AND e.i // 16 = c",
)
def batch_norm_spatial(spark, sf):
    """Each of four channels normalised over a batch's rows and its cells."""
    net = N.Network.build([N.input_(4, 4, 4, id="in"), N.batch_normalization(mode="spatial", id="bn")])
    e = _embeddings(spark, sf).select("vec_id", F.floor(F.col("vec_id") / 50).alias("b"), "v")
    return _long(net.batch_outputs(e, {"in": "v"}, "b", "vec_id"), F.col("bn"), "vec_id")


@register(
    "batch_norm_running",
    _E + f", {_FULL}, s AS (SELECT b, max(batches) AS k, i // 16 AS c, avg(v) AS m, var_samp(v) AS q FROM t GROUP BY 1, 3), f AS (SELECT *, CASE WHEN b = 0 THEN pow(0.9::DOUBLE, k - 1) ELSE 0.1::DOUBLE * pow(0.9::DOUBLE, k - 1 - b) END AS share FROM s) SELECT CAST(c AS INT) AS channel, round(sum(share * m), 6) AS mean, round(sum(share * q), 6) AS variance FROM f GROUP BY c",
)
def batch_norm_running(spark, sf):
    """The running moments after a step over all full batches, each of which counts in turn."""
    e = _embeddings(spark, sf).withColumn("t", F.col("v"))
    net = N.Network.build([N.input_(4, 4, 4, id="in"), N.batch_normalization(mode="spatial", id="bn")])
    net.train(rows.full_batches(e, 50, "vec_id"), {"in": "v"}, {"bn": "t"}, optimizers.PlainSGD(0.0), step=1_000_000)
    both = zip(net.state["bn.mean"].tolist(), net.state["bn.variance"].tolist())
    return spark.createDataFrame([(c, round(m, 6), round(q, 6)) for c, (m, q) in enumerate(both)], "channel int, mean double, variance double")


# -- detection ------------------------------------------------------------------------------------------------------


@register("select_anchor", _E + ", m AS (SELECT vec_id, max(v) AS top FROM e WHERE i < 5 GROUP BY vec_id) SELECT vec_id, CAST(i AS INT) AS i, CASE WHEN top > 0 AND v = top THEN 1.0::DOUBLE ELSE 0 END AS x FROM e JOIN m USING (vec_id) WHERE i < 5")
def select_anchor(spark, sf):
    return _long(_embeddings(spark, sf), detect.select_anchor(F.slice("v", 1, 5)), "vec_id")


def _side(x: str, y: str, op: str) -> str:
    return f"({x} {op} {y} / 2)"


_OVERLAP = " * ".join(f"greatest(0, least({_side(f'p{c}', f'p{s}', '+')}, {_side(f't{c}', f't{s}', '+')}) - greatest({_side(f'p{c}', f'p{s}', '-')}, {_side(f't{c}', f't{s}', '-')}))" for c, s in ((0, 2), (1, 3)))


@register(
    "detection_loss",
    _E
    + f""", x AS (SELECT vec_id, i // 16 AS cell, i // 8 % 2 AS anchor, i % 8 AS k, v, abs(lag(v, 1, 0.1) OVER (PARTITION BY vec_id ORDER BY i)) AS t FROM e),
f AS (SELECT vec_id, cell, anchor, k, t, CASE WHEN k IN (0, 1, 4) THEN 1 / (1 + exp(-v)) WHEN k IN (2, 3) THEN sqrt(exp(v) * (anchor + k - 1) / 2) ELSE exp(v) / sum(CASE WHEN k >= 5 THEN exp(v) END) OVER (PARTITION BY vec_id, cell, anchor) END AS p FROM x),
b AS (SELECT vec_id, cell, anchor, {", ".join(f"max(CASE WHEN k = {k} THEN {c} END) AS {c}{k}" for c in "pt" for k in range(4))} FROM f GROUP BY 1, 2, 3),
o AS (SELECT vec_id, cell, anchor, {_OVERLAP} AS n, p2 * p3 + t2 * t3 AS s FROM b), u AS (SELECT vec_id, cell, anchor, CASE WHEN s - n > 0 THEN n / (s - n) ELSE 0 END AS iou FROM o),
r AS (SELECT *, iou = max(iou) OVER (PARTITION BY vec_id, cell) AND iou > 0 AS mine FROM u)
SELECT vec_id, round(sum((p - t) * (p - t) * CASE WHEN mine THEN CASE WHEN k < 5 THEN 5 ELSE 1 END WHEN k = 4 THEN 0.5 ELSE 0 END), 6) AS loss FROM f JOIN r USING (vec_id, cell, anchor) GROUP BY vec_id""",
)
def detection_loss(spark, sf):
    """Vectors as the output of a 2 x 2 grid with two anchors and three classes; the truth is
    the sizes of the entries one place before."""
    d = detect.Detection((2, 2), ((1.0, 2.0), (2.0, 3.0)))
    e = _embeddings(spark, sf).withColumn("t", F.transform("v", lambda x, i: F.when(i == 0, 0.1).otherwise(F.abs(F.element_at("v", F.greatest(i, F.lit(1)))))))
    return d.table_loss(e, "v", "t").select("vec_id", _r(F.col("loss")).alias("loss"))


_M = "CASE WHEN {b} = 0 THEN 1 ELSE round({a} / {b}, 6) END"


@register(
    "box_all_metrics",
    f"""WITH RECURSIVE {_sides_sql(", o_orderpriority AS class")}, j AS (SELECT l.image AS image, label_id, pred_id, l.class AS lc, p.class AS pc, round({_iou_sql("l", "p")}, 9) AS iou FROM l JOIN p ON l.image = p.image WHERE {_iou_sql("l", "p")} >= 0.2::DOUBLE),
same AS (SELECT image || '/' || lc AS cell, lc AS class, label_id, pred_id, iou FROM j WHERE lc = pc), {_greedy_sql("m", "j", "image")}, {_greedy_sql("n", "same", "cell")},
a AS (SELECT (SELECT count(*) FROM l) AS l, (SELECT count(*) FROM p) AS p, count(*) AS m, coalesce(sum(CASE WHEN l.class = p.class THEN 1 ELSE 0 END), 0) AS c FROM m JOIN l ON l.label_id = m.label_id JOIN p ON p.pred_id = m.pred_id),
k AS (SELECT class, count(*) AS l, (SELECT count(*) FROM p WHERE p.class = l.class) AS p, (SELECT count(*) FROM n WHERE split_part(n.g, '/', 2) = l.class) AS m FROM l GROUP BY class)
SELECT NULL AS class, l AS n_labels, p AS n_predictions, m AS n_matches, {_M.format(a="m", b="l")} AS sensitivity, {_M.format(a="m", b="p")} AS precision, {_M.format(a="2 * m", b="(l + p)")} AS f1, {_M.format(a="c", b="m")} AS class_accuracy, {_M.format(a="2 * c", b="(l + p)")} AS global_f1 FROM a
UNION ALL SELECT class, l, p, m, {_M.format(a="m", b="l")}, {_M.format(a="m", b="p")}, {_M.format(a="2 * m", b="(l + p)")}, NULL, NULL FROM k""",
)
def box_all_metrics(spark, sf):
    m = detect.all_metrics(_boxes(spark, sf, _LABELLED, "label_id"), _boxes(spark, sf, _PREDICTED, "pred_id"), "image", "label_id", "pred_id", 0.2)
    return m.select("class", "n_labels", "n_predictions", "n_matches", *(_r(F.col(c)).alias(c) for c in ("sensitivity", "precision", "f1", "class_accuracy", "global_f1")))


# -- labels and columns ------------------------------------------------------------------------------------------------


@register("one_hot_index", "SELECT vec_id, CAST(i AS INT) AS i, CASE WHEN i = label THEN 1.0::DOUBLE ELSE 0 END AS x FROM embeddings CROSS JOIN (SELECT unnest(range(10)) AS i)")
def one_hot_index(spark, sf):
    return _long(_embeddings(spark, sf), A.one_hot(F.col("label"), 10), "vec_id")


@register("one_hot_silent", "WITH c AS (SELECT unnest(['F', 'O']) AS s, CAST(unnest(range(2)) AS INT) AS i) SELECT o_orderkey, i, CASE WHEN o_orderstatus = s THEN 1.0::DOUBLE ELSE 0 END AS x FROM orders CROSS JOIN c")
def one_hot_silent(spark, sf):
    return _long(table(spark, sf, "orders"), A.one_hot_label(["F", "O"], F.col("o_orderstatus"), strict=False), "o_orderkey")


@register("nan_labels", _E + " SELECT vec_id, i, CASE WHEN i % 3 = 0 THEN 0 ELSE round(v, 6) END AS x, CASE WHEN i % 3 = 0 THEN 0.0::DOUBLE ELSE 1 END AS mask FROM e")
def nan_labels(spark, sf):
    v = F.transform("v", lambda x, i: F.when(i % 3 == 0, F.lit(float("nan"))).otherwise(x))
    e = _embeddings(spark, sf).withColumn("t", v)
    both = F.arrays_zip(A.nan_to_zero(F.col("t")).alias("x"), A.nan_mask(F.col("t")).alias("mask"))
    return e.select("vec_id", F.posexplode(both).alias("i", "b")).select("vec_id", "i", _r(F.col("b.x")).alias("x"), F.col("b.mask").alias("mask"))


@register("unit_vector", _E + ", m AS (SELECT vec_id, max(v) AS top FROM e GROUP BY vec_id), a AS (SELECT vec_id, max(i) AS k FROM e JOIN m USING (vec_id) WHERE v = top GROUP BY vec_id) SELECT vec_id, i, CASE WHEN i = k THEN 1.0::DOUBLE ELSE 0 END AS x FROM e JOIN a USING (vec_id)")
def unit_vector(spark, sf):
    return _long(_embeddings(spark, sf), A.unit_vector(F.col("v")), "vec_id")


@register("batch_columns", f"SELECT CAST({_BATCH} AS BIGINT) AS batch_id, string_agg(label, ',' ORDER BY vec_id) AS labels, count(*) AS n FROM embeddings GROUP BY 1")
def batch_columns(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.floor(F.col("vec_id") / 50).alias("batch_id"))
    c = rows.to_columns(e, "batch_id", "vec_id", ["label"])
    return c.select("batch_id", F.array_join(F.col("label").cast("array<string>"), ",").alias("labels"), F.size("label").cast("long").alias("n"))


@register("columns_to_rows", f"SELECT CAST({_BATCH} AS BIGINT) AS batch_id, row_number() OVER (PARTITION BY {_BATCH} ORDER BY vec_id) - 1 AS place, vec_id, label FROM embeddings")
def columns_to_rows(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.floor(F.col("vec_id") / 50).alias("batch_id"))
    back = rows.to_rows(rows.to_columns(e, "batch_id", "vec_id", ["vec_id", "label"]), "batch_id", ["vec_id", "label"])
    return back.withColumn("place", F.col("place").cast("long"))


_CELL = "WITH b AS (SELECT " + _BOX.format(id="box_id") + ", o_orderpriority AS class FROM orders), c AS (SELECT *, (x + w / 2) / 110 * 13 AS cx, (y + h / 2) / 110 * 13 AS cy FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY image, floor(cx), floor(cy) ORDER BY box_id DESC) AS r FROM c)"


@register("box_label_cells", _CELL + " SELECT image, CAST(floor(cx) AS BIGINT) AS col, CAST(floor(cy) AS BIGINT) AS row, round(cx - floor(cx), 6) AS dx, round(cy - floor(cy), 6) AS dy, round(w / 110, 6) AS fw, round(h / 110, 6) AS fh, 1.0::DOUBLE AS confidence, class FROM k WHERE r = 1")
def box_label_cells(spark, sf):
    """Pixel boxes as the truth of a 13 x 13 grid; of the boxes in a cell the last stays."""
    cells = detect.realize_labels(_boxes(spark, sf, "true", "box_id"), "image", "box_id", (13, 13), 110.0, 110.0)
    return cells.select("image", "col", "row", *(_r(F.col(c)).alias(c) for c in ("dx", "dy", "fw", "fh")), "confidence", "class")


@register("box_corners", "SELECT box_id, x - w / 2 AS x0, y - h / 2 AS y0, x + w / 2 AS x1, y + h / 2 AS y1 FROM (SELECT " + _BOX.format(id="box_id") + " FROM orders)")
def box_corners(spark, sf):
    c = detect.corners(*(F.col(x) for x in detect.BOX))
    return _boxes(spark, sf, "true", "box_id").withColumn("c", c).select("box_id", *(F.col("c")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


_DECODED = """, x AS (SELECT vec_id, i // 32 AS c, i // 16 % 2 AS r, i // 8 % 2 AS a, i % 8 AS k, v FROM e),
b AS (SELECT vec_id, c, r, a, (c + 1 / (1 + exp(-max(CASE WHEN k = 0 THEN v END)))) / 2 AS x, (r + 1 / (1 + exp(-max(CASE WHEN k = 1 THEN v END)))) / 2 AS y, sqrt(exp(max(CASE WHEN k = 2 THEN v END)) * (a + 1) / 2) AS w, sqrt(exp(max(CASE WHEN k = 3 THEN v END)) * (a + 2) / 2) AS h, 1 / (1 + exp(-max(CASE WHEN k = 4 THEN v END))) AS conf FROM x GROUP BY 1, 2, 3, 4),
p AS (SELECT vec_id, c AS r, r AS c, a, k - 5 AS cls, exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id, c, r, a) AS p FROM x WHERE k >= 5), q AS (SELECT *, row_number() OVER (PARTITION BY vec_id, c, r, a ORDER BY p DESC, cls DESC) AS place FROM p)"""


@register("decode_boxes", _E + _DECODED + " SELECT vec_id, CAST(c * 4 + r * 2 + a AS INT) AS box_id, ['a', 'b', 'c'][cls + 1] AS class, round(conf * p, 6) AS score, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h FROM b JOIN q USING (vec_id, c, r, a) WHERE place = 1 AND conf * p > 0.15::DOUBLE")
def decode_boxes(spark, sf):
    """Vectors as detector output: boxes with their best class, where that is likely enough."""
    boxes = detect.decode_boxes(_embeddings(spark, sf), "vec_id", "v", (2, 2), ((1.0, 2.0), (2.0, 3.0)), ["a", "b", "c"], 0.15)
    return boxes.select("vec_id", "box_id", "class", *(_r(F.col(c)).alias(c) for c in ("score", *detect.BOX)))


# -- gradients and joins ----------------------------------------------------------------------------------------------------

_SIG = "1 / (1 + exp(-o))"
_GRADIENT_SQL = {
    "tanh": ("(exp(y) - exp(-y)) / (exp(y) + exp(-y))", "1 - o * o"),
    "relu": ("greatest(y, 0)", "CASE WHEN o > 0 THEN 1 ELSE 0 END"),
    "swish": (f"y * {_S}", f"{_SIG} + o * {_SIG} * (1 - {_SIG})"),
    "selu": (f"{A.SELU_SCALE}::DOUBLE * CASE WHEN y > 0 THEN y ELSE {A.SELU_ALPHA}::DOUBLE * exp(y) - {A.SELU_ALPHA}::DOUBLE END", f"{A.SELU_SCALE}::DOUBLE * CASE WHEN o > 0 THEN 1 ELSE {A.SELU_ALPHA}::DOUBLE * exp(o) END"),
}
for _k, (_o, _g) in _GRADIENT_SQL.items():
    register(f"gradient_{_k}", _E + f", t AS (SELECT vec_id, i, v AS g, {_o} AS o FROM (SELECT *, v * 8 AS y FROM e)) SELECT vec_id, i, round(({_g}) * g, 6) AS x FROM t")(
        lambda spark, sf, k=_k: _long(_embeddings(spark, sf), A.activation_gradient(k, A.activate(k, F.transform("v", lambda x: x * 8.0)), F.col("v")), "vec_id")
    )


@register("logit_round_trip", _E + " SELECT vec_id, i, round(v, 6) AS x, round(1 / (1 + exp(-v)) * (1 - 1 / (1 + exp(-v))), 6) AS slope FROM e")
def logit_round_trip(spark, sf):
    p = F.transform("v", lambda x: F.struct(A.logit(A.logistic(x)).alias("x"), A.logistic_gradient(A.logistic(x)).alias("slope")))
    return _embeddings(spark, sf).select("vec_id", F.posexplode(p).alias("i", "p")).select("vec_id", "i", _r(F.col("p.x")).alias("x"), _r(F.col("p.slope")).alias("slope"))


@register("mse_gradient", _E + f" SELECT vec_id, i, round(2.0 / 64 * (v - {_T}), 6) AS x FROM e")
def mse_gradient(spark, sf):
    return _long(_embeddings(spark, sf), A.mse_gradient(F.col("v"), _target()), "vec_id")


@register(
    "network_joins",
    _E + ", a AS (SELECT vec_id, i, greatest(v, 0) AS r, v * 1 / (1 + exp(-v)) AS s FROM e) SELECT vec_id, i, round(r + s, 6) AS x FROM a UNION ALL SELECT vec_id, CAST(i + 64 AS INT), round(v, 6) FROM e",
)
def network_joins(spark, sf):
    """split, two activations, a join of them, then a concatenation with the split's other branch;
    dropouts pass everything on."""
    net = N.Network.build([
        N.input_(64, id="in"), N.split(id="s"), N.relu(id="r", parents=["s"]), N.swish(id="w", parents=["s"]), N.join(operation="+", id="j", parents=["r", "w"]),
        N.multiplicative_dropout(0.3, id="d", parents=["s"]), N.concatenate(id="out", parents=["j", "d"]),
    ])
    return _long(net.project(_embeddings(spark, sf), "v"), F.col("output"), "vec_id")


def _back(spark, sf, layer, cells):
    """The input's gradient of an image layer whose output's gradient is the first ``cells`` entries."""
    net = N.Network.build([N.input_(8, 8, 1, id="in"), layer])
    e = _embeddings(spark, sf).select("vec_id", "v", F.slice("v", 1, cells).alias("g"))
    return _long(net.input_gradients(e, {"in": "v"}, {layer.id: "g"}, "vec_id"), F.col("in"), "vec_id")


_TILE = "i // 16 * 4 + i % 8 // 2"


@register("pool_gradient_avg", _E + f", t AS (SELECT *, {_TILE} AS c FROM e) SELECT t.vec_id, t.i, round(g.v / 4, 6) AS x FROM t JOIN e g ON g.vec_id = t.vec_id AND g.i = t.c")
def pool_gradient_avg(spark, sf):
    return _back(spark, sf, N.max_pooling(2, 0, 2, op="avg", id="pool"), 16)


@register("pool_gradient_max", _E + f", t AS (SELECT *, {_TILE} AS c FROM e), m AS (SELECT vec_id, c, max(v) AS top FROM t GROUP BY 1, 2) SELECT t.vec_id, t.i, round(CASE WHEN t.v = top THEN g.v ELSE 0 END, 6) AS x FROM t JOIN m USING (vec_id, c) JOIN e g ON g.vec_id = t.vec_id AND g.i = t.c")
def pool_gradient_max(spark, sf):
    return _back(spark, sf, N.max_pooling(2, 0, 2, id="pool"), 16)


@register("conv_gradient", _E + ", " + _CELLS.format(n=8, k=3, s=1, p=1) + ", o AS (SELECT vec_id, i // 8 AS oy, i % 8 AS ox, v AS d FROM e) SELECT vec_id, CAST(y * 8 + x AS INT) AS i, round(sum(d * (a * 3 + b - 4) / 10.0::DOUBLE), 6) AS x FROM c JOIN o USING (vec_id, oy, ox) WHERE y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7 GROUP BY vec_id, y, x")
def conv_gradient(spark, sf):
    layer = N.convolutional(3, 1, 1, 1, id="conv", weights=[(k - 4) / 10 for k in range(9)])
    return _back(spark, sf, layer, 64)


@register("linear_gradient", _E + f", w AS (SELECT r, i, {_W} AS w FROM (SELECT unnest(range(10)) AS r) CROSS JOIN (SELECT unnest(range(64)) AS i)), g AS (SELECT vec_id, i AS r, v AS d FROM e WHERE i < 10) SELECT vec_id, CAST(w.i AS INT) AS i, round(sum(d * w), 6) AS x FROM g JOIN w USING (r) GROUP BY vec_id, w.i")
def linear_gradient(spark, sf):
    layer = N.linear(10, id="out", weights=[[_weight(r, i) for i in range(64)] for r in range(10)])
    return _back(spark, sf, layer, 10)


# -- sequences ----------------------------------------------------------------------------------------------------------------


@register("interleave_vectors", _E + ", a AS (SELECT vec_id, CASE WHEN i < 5 THEN i * 10 ELSE (i - 5) * 10 + 1 END AS k, v FROM e WHERE i < 13) SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY k) - 1 AS INT) AS i, round(v, 6) AS x FROM a")
def interleave_vectors(spark, sf):
    """5 and 8 entries in turn, the rest of the longer one behind."""
    return _long(_embeddings(spark, sf), A.interleave(F.slice("v", 1, 5), F.slice("v", 6, 8)), "vec_id")


@register("pad_vectors", _E + " SELECT vec_id, i, round(v, 6) AS x FROM e WHERE i < 6 UNION ALL SELECT vec_id, CAST(i AS INT), 0.0 FROM (SELECT DISTINCT vec_id FROM e) CROSS JOIN (SELECT unnest(range(6, 9)) AS i)")
def pad_vectors(spark, sf):
    return _long(_embeddings(spark, sf), A.pad(F.slice("v", 1, 6), 9, F.array_repeat(F.lit(0.0), 9)), "vec_id")


_SLOPES = {
    "de_jong": "2 * v", "axis_parallel": "2 * n * v", "moved_axis": "10 * n * v", "rastrigin": "2 * v + 20 * pi() * sin(2 * pi() * v)",
    "powers": "(n + 1) * pow(abs(v), n) * sign(v)", "schwefel": "CASE WHEN v = 0 THEN 0 ELSE -sin(sqrt(abs(v))) - v * cos(sqrt(abs(v))) * sign(v) / (2 * sqrt(abs(v))) END",
}


@register("objective_gradients", _E + ", t AS (SELECT vec_id, CAST(i // 4 AS INT) AS block, CAST(i % 4 AS INT) AS i, i % 4 + 1 AS n, v + 0.5 AS v FROM e) SELECT vec_id, block, i, " + ", ".join(f"round({s}, 6) AS g_{k}" for k, s in _SLOPES.items()) + " FROM t")
def objective_gradients(spark, sf):
    blocks = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: F.transform(F.slice("v", 4 * b + 1, 4), lambda x: x + 0.5))
    e = _embeddings(spark, sf).select("vec_id", F.posexplode(blocks).alias("block", "p"))
    each = F.arrays_zip(*(GRADIENTS[k](F.col("p")).alias(k) for k in _SLOPES))
    return e.select("vec_id", "block", F.posexplode(each).alias("i", "g")).select("vec_id", "block", "i", *(_r(F.col("g")[k]).alias(f"g_{k}") for k in _SLOPES))
