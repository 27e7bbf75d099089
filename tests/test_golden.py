"""Golden values of single operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import arrays as A
from quern.functions import objectives
from quern.operators import detect, encode, metrics, rows, tree
from quern.plans import kernels as K
from quern.plans import network as N
from quern.plans import optimizers as O
from quern.sources import importers, io


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_softmax_select_reduce(spark):
    assert one(spark, A.softmax(A.vector([1, 2, 3, 4]))) == pytest.approx([0.03205860, 0.08714432, 0.23688282, 0.64391426], abs=1e-7)
    x, y, z = A.vector(range(-5, 5)), F.transform(A.vector(range(10)), lambda v: v * 2), A.vector([6] * 10)
    assert one(spark, A.map_select(x, y, z)) == [0, 2, 4, 6, 8, 6, 6, 6, 6, 6]
    v = A.vector([0, 3, 5, 2, 1, 9, 5, 7, 7, 2])
    assert one(spark, A.reduce("max", v, 2.0)) == 18 and one(spark, A.reduce("sum", v)) == 41
    assert one(spark, A.argmax(A.vector([1, 3, 3, 0]))) == 2 and one(spark, A.argmax(F.array().cast("array<double>"))) == -1


def test_arrays(spark):
    assert one(spark, A.map_binary("+", A.vector([1, 2, 3, 4]), A.vector([10, 20]))) == [11, 22, 13, 24]
    with pytest.raises(Exception, match="does not divide"):
        one(spark, A.map_binary("+", A.vector([1, 2, 3]), A.vector([10, 20])))
    assert one(spark, A.gemv([[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11]], A.vector([2, 2, 2]), 1.0, 1.0, A.vector([0, 1, 2, 3]))) == [6, 25, 44, 63]
    assert one(spark, A.linear([[1, 2], [3, 4]], [0, 10], A.vector([1, 2]))) == [5, 21]
    assert one(spark, A.interleave(A.vector([1, 2, 3]), A.vector([9]))) == [1, 9, 2, 3]
    assert one(spark, A.split_by(A.vector([1, 2, 3]), [1, 2])) == [[1], [2, 3]]
    assert one(spark, A.join_vectors("*", A.vector([2, 3]), A.vector([5, 7, 9]))) == [10, 21, 0]
    assert one(spark, A.one_hot_label(["a", "b"], F.lit("c"), strict=False)) == [0, 0]
    with pytest.raises(Exception, match="unknown label"):
        one(spark, A.one_hot_label(["a", "b"], F.lit("c")))
    got = one(spark, A.lrn(A.vector([1, 2]), 1, 1.0, 1.0, 1.0))
    assert got == pytest.approx([1 / 2, 2 / 5])
    assert one(spark, A.unary("round", F.lit(-2.5))) == -2.0


@pytest.mark.parametrize("name, at", [("logistic", (0.26894142, 0.73105858)), ("tanh", (-0.76159416, 0.76159416)), ("swish", (-0.26894142, 0.73105858)), ("selu", (-1.11133074, 1.05070099))])
def test_activations(spark, name, at):
    assert one(spark, A.activate(name, A.vector([-1, 1]))) == pytest.approx(at, abs=1e-7)
    net = N.Network.build([N.input_(2, id="in"), N.Layer(name)])
    assert net.forward({"in": [[-1.0, 1.0]]})[0][net.leaves()[0]][0] == pytest.approx(at, abs=1e-7)


def test_activation_gradients(spark):
    g = {"logistic": (-0.19661193, 0.19661193), "tanh": (-0.41997434, 0.41997434), "swish": (-0.36713291, 0.83540390), "selu": (-0.57862688, 1.05070099)}
    for name, want in g.items():
        assert one(spark, A.activation_gradient(name, A.activate(name, A.vector([-1, 1])), A.vector([-1, 1]))) == pytest.approx(want, abs=1e-6)


def test_pooling():
    net = lambda op, k, p, s, c, h: N.Network.build([N.input_(h, h, c, id="in"), N.max_pooling(k, p, s, op=op, id="p")])
    x = np.arange(1.0, 17.0)[None]
    assert net("max", 2, 0, 1, 4, 2).forward({"in": x})[0]["p"].tolist() == [[4, 8, 12, 16]]
    ones = np.ones((1, 4))
    assert net("avg", 2, 1, 1, 1, 2).forward({"in": ones})[0]["p"][0].tolist() == [0.25, 0.5, 0.25, 0.5, 1, 0.5, 0.25, 0.5, 0.25]
    assert net("avg-exc-pad", 2, 1, 1, 1, 2).forward({"in": ones})[0]["p"][0].tolist() == [1] * 9


def test_batch_normalisation():
    x = np.random.RandomState(0).normal(5, np.sqrt(20), (20, 20))
    net = N.Network.build([N.input_(20, id="in"), N.batch_normalization(id="bn")])
    out, kept = net.forward({"in": x}, training=True)
    assert abs(out["bn"].mean(axis=0)).max() < 1e-9 and abs(out["bn"].var(axis=0) - 1).max() < 1e-3
    assert kept["bn"]["variance"] == pytest.approx(x.var(axis=0, ddof=1))


def test_dropout_keeps_the_mean():
    net = N.Network.build([N.input_(100, id="in"), N.dropout(0.8, id="d")])
    total = np.mean([net.forward({"in": np.ones((1, 100))}, True, k)[0]["d"].sum() for k in range(30)])
    assert abs(total - 100) < 3


def test_gradients_of_all_layers():
    net = N.Network.build([N.input_(4, 4, 2, id="in"), N.convolutional(3, 1, 1, 3), N.tanh(), N.max_pooling(2, 0, 2), N.batch_normalization(), N.local_response_normalization(n=3, alpha=0.5), N.linear(5), N.logistic(id="a"), N.split(id="s"), N.linear(5, parents=["s"], id="b"), N.join(parents=["a", "b"], operation="*", id="j"), N.concatenate(parents=["j", "s"]), N.linear(3), N.softmax()], seed=3)
    rng = np.random.RandomState(0)
    x, t = rng.normal(size=(6, 32)), np.eye(3)[rng.randint(0, 3, 6)]
    leaf = net.leaves()[0]

    def loss(p):
        net.assign(p)
        return net.loss(net.forward({"in": x}, True)[0], {leaf: t})[0]

    p = net.flat()
    out, kept = net.forward({"in": x}, True)
    g = net.backward(out, kept, net.loss(out, {leaf: t})[1])
    assert np.abs(np.concatenate([g[k].ravel() for k in net.names()]) - O.numeric_gradient(loss, p, 1e-5)).max() < 1e-6


def test_adam():
    opt, x = O.Adam(), np.array([1.0, 2, 3, 4])
    assert opt.step(x, 2 * x) == pytest.approx([0.999000000005, 1.9990000000025, 2.9990000000016668, 3.99900000000125], abs=1e-13)


def test_center_update():
    labels = np.array([0, 2, 0, 3, 3, 0])
    features = 20.0 * np.eye(5)[labels]
    got = K.update_centers(np.ones((5, 5)), features, labels, 0.5, 10.0)
    want = np.full(5, 0.5)
    want[0] = 10.5
    assert got[0] == pytest.approx(want * 10 / np.linalg.norm(want), abs=1e-4) and got[1].tolist() == [1] * 5


def test_binary_metrics(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (1, 0), (0, 0)], "y int, h int")
    assert metrics.binary_metrics(df, "y", "h").first()["accuracy"] == 0.5


def test_one_hot_round_trip(spark):
    df = spark.createDataFrame([("left",), ("middle",), ("right",)], "a string")
    coded = encode.one_hot_columns(df, ["a"])
    assert coded.columns == ["a_left", "a_middle", "a_right"] and [tuple(r) for r in coded.collect()] == [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    assert [r["a"] for r in encode.reverse_one_hot(coded, ["a"]).collect()] == ["left", "middle", "right"]


def test_inverse_counts(spark):
    df = spark.createDataFrame([(0, k, c) for k, c in enumerate([0, 2, 0, 3])], "b int, k int, label int")
    assert [r["inverse_count"] for r in rows.inverse_label_counts(df, "b", "label").orderBy("k").collect()] == [0.5, 1, 0.5, 1]


def test_row_numbers_with_ties_and_an_empty_table(spark):
    df = spark.createDataFrame([(k % 3, k) for k in range(100)], "a int, b int")
    got = [(r["a"], r["b"]) for r in rows.number_rows(df, "a", "b").orderBy("row").collect()]
    assert got == sorted((k % 3, k) for k in range(100))
    assert rows.number_rows(df.limit(0), "a").count() == 0
    assert rows.pad_to_batch(df, 64, "a", "b").count() == 128 and rows.batches(df, 64, "a", "b").count() == 64
    assert rows.take(df, 7, "b", 1).count() == 7 and rows.take_with_replacement(df, 20, "b", 1).count() == 20
    assert [e.count() for e in rows.epochs(df, "b", 40, limit=3)] == [40, 40, 40]


def test_iou_and_suppression(spark):
    a, b = ({c: F.lit(float(v)) for c, v in zip(detect.BOX, box)} for box in ((0, 0, 2, 2), (1, 0, 2, 2)))
    assert one(spark, detect.iou(a, b)) == pytest.approx(1 / 3)
    boxes = np.array([[0, 0, 2, 2], [0.1, 0, 2, 2], [5, 5, 2, 2.0]])
    assert detect.suppress(boxes, np.array([0.5, 0.9, 0.1]), 0.2) == [1, 2]
    t = np.zeros((2, 2, 1, 7))
    t[..., 4] = -9
    t[1, 0, 0, 4] = 9
    t[..., 5] = 3
    found = detect.class_suppression(t, (2, 2), [(1.0, 1.0)], ["a", "b"], 0.2, 0.2)
    assert [(f["class"], f["box"][:2].tolist()) for f in found] == [("a", [0.75, 0.25])]


def test_tree_learns(spark):
    df = spark.createDataFrame([(float(x), float(y), int(x > 3) + 2 * int(y > 6)) for x in range(8) for y in range(10)], "x double, y double, c int")
    t = tree.grow(df, ["x", "y"], "c", depth=2)
    assert df.where(t.column() != F.col("c")).count() == 0 and len(t.nodes()) == 7
    f = tree.forest(df, ["x", "y"], "c", trees=3, depth=2, seed=1)
    assert df.where(tree.vote(f) == F.col("c")).count() > 50


def test_objectives(spark):
    zero = A.vector([0, 0, 0, 0])
    for name in ("cross_paraboloid", "de_jong", "axis_parallel", "rotated", "moved_axis", "rastrigin", "griewangk", "powers"):
        assert one(spark, objectives.OBJECTIVES[name](zero)) == pytest.approx(0, abs=1e-9)
    assert one(spark, objectives.OBJECTIVES["rosenbrock"](A.vector([1, 1, 1]))) == 0
    v = A.vector([0.3, -0.4, 0.5])
    for name in objectives.GRADIENTS:
        exact, close = one(spark, objectives.gradient(name, v, 3)), one(spark, objectives.numeric_gradient(objectives.OBJECTIVES[name], v, 3))
        assert exact == pytest.approx(close, abs=1e-5)


def test_network_on_tables(spark, tmp_path):
    corn = [(6, 4, 40), (10, 4, 44), (12, 5, 46), (14, 7, 48), (16, 9, 52), (18, 12, 58), (22, 14, 60), (24, 20, 68), (26, 21, 74), (32, 24, 80)]
    df = spark.createDataFrame([(k, [a / 32, b / 24], [y / 80]) for k, (a, b, y) in enumerate(corn)], "k long, data array<double>, label array<double>")
    dealt = rows.batches(df, 5, "k")
    net = N.Network.build([N.input_(2, id="in"), N.linear(1, id="out")], seed=2)
    opt = O.Adam(rate=0.05)
    losses = [loss for _, loss, _ in N.epochs(net, dealt, {"in": "data"}, {"out": "label"}, opt, 4)]
    assert losses[-1] < losses[0]
    io.save_network(net, spark, f"{tmp_path}/m", cv_loss=losses[-1])
    again, facts = io.load_network(spark, f"{tmp_path}/m")
    assert facts["cv_loss"] == losses[-1]
    a = [r["out"] for r in again.transform(df, {"in": "data"}).orderBy("k").collect()]
    b = [r["output"] for r in net.project(df, "data").orderBy("k").collect()]
    assert np.allclose(a, b)
    assert again.evaluate(df, {"in": "data"}, {"out": "label"}).first()["value"] >= 0
    assert [x.id for x in net.without("out").layers] == ["in"]


def test_importers():
    keras = '{"class_name": "Sequential", "config": [{"class_name": "Conv2D", "config": {"name": "c", "filters": 4, "kernel_size": [3, 3], "strides": [1, 1], "padding": "valid", "activation": "relu", "batch_input_shape": [null, 8, 8, 1]}}, {"class_name": "MaxPooling2D", "config": {"name": "p", "pool_size": [2, 2], "strides": [2, 2]}}, {"class_name": "Flatten", "config": {"name": "f"}}, {"class_name": "Dropout", "config": {"name": "d", "rate": 0.25}}, {"class_name": "Dense", "config": {"name": "o", "units": 10, "activation": "softmax"}}]}'
    net = N.Network.build(importers.keras_layers(keras))
    assert net.shapes["p"] == (4, 3, 3) and net.layer("d").options["keep"] == 0.75 and net.width(net.leaves()[0]) == 10
    caffe = 'name: "n"\ninput_dim: 1 input_dim: 3 input_dim: 8 input_dim: 8\nlayer { name: "c" type: "Convolution" convolution_param { num_output: 2 kernel_size: 3 } }\nlayer { name: "r" type: "ReLU" }\nlayer { name: "f" type: "InnerProduct" inner_product_param { num_output: 5 } }'
    assert N.Network.build(importers.caffe_layers(caffe)).width("f") == 5


def test_idx_files(spark, tmp_path):
    import gzip
    import struct

    (tmp_path / "i.gz").write_bytes(gzip.compress(struct.pack(">iiii", 2051, 2, 28, 28) + bytes([0, 255] * 784)))
    (tmp_path / "l").write_bytes(struct.pack(">ii", 2049, 2) + bytes([3, 9]))
    got = io.zip_columns(io.idx_images(spark, str(tmp_path / "i.gz")), io.idx_labels(spark, str(tmp_path / "l"))).orderBy("row").collect()
    assert got[0]["data"][:2] == [-0.5, 0.5] and got[0]["label"].index(1.0) == 3 and got[1]["label"].index(1.0) == 9


def test_streaming(spark, tmp_path):
    from quern.streaming.online import train_stream

    df = spark.createDataFrame([([float(k % 5), 1.0], [2.0 * (k % 5)]) for k in range(40)], "data array<double>, label array<double>")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    net = N.Network.build([N.input_(2, id="in"), N.linear(1, id="out")], seed=1)
    before = net.flat().copy()
    q = train_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), net, {"in": "data"}, {"out": "label"}, O.SGD(rate=0.01), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert not np.allclose(before, net.flat())
