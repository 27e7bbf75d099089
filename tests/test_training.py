"""Loss terms, normalisation, detection, descriptions and recovery, against plain formulas and
numeric gradients."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import detect, rows, tree
from quern.plans import kernels as K
from quern.plans import network as N
from quern.plans import optimizers as O
from quern.sources import staging


def numeric(net, data, truth, terms=True):
    def value(x):
        net.assign(x)
        out, _ = net.forward(data, True, 3)
        return net.loss(out, truth)[0] + (net.term_gradients(out, truth)[0] if terms else 0.0)

    x = net.flat().copy()
    g = O.numeric_gradient(value, x, 1e-5)
    net.assign(x)
    return g


def analytic(net, data, truth):
    out, kept = net.forward(data, True, 3)
    _, grads = net.loss(out, truth)
    _, nodes, own, _ = net.term_gradients(out, truth)
    for k, g in nodes.items():
        grads[k] = grads[k] + g if k in grads else g
    got = net.backward(out, kept, grads)
    for k, g in own.items():
        got[k] = got[k] + g
    return np.concatenate([got[k].ravel() for k in net.names()])


@pytest.mark.parametrize("mode, size", [("spatial", 2), ("elementwise", 18)])
def test_batch_normalisation_gradients(mode, size):
    rng = np.random.RandomState(1)
    net = N.Network.build([N.input_(3, 3, 2, id="in"), N.batch_normalization(mode=mode, id="bn"), N.linear(2, id="out")])
    net.assign(rng.normal(size=net.flat().size))
    assert net.parameters["bn.scale"].size == net.state["bn.mean"].size == size
    data, truth = {"in": rng.normal(size=(7, 18))}, {"out": rng.normal(size=(7, 2))}
    assert np.abs(analytic(net, data, truth) - numeric(net, data, truth)).mean() < 1e-6
    with pytest.raises(ValueError):
        N.Network.build([N.input_(3), N.batch_normalization(mode="other")])


def test_spatial_normalisation_is_by_channel():
    x = np.random.RandomState(2).normal(5, 3, (40, 3 * 4))
    net = N.Network.build([N.input_(2, 2, 3, id="in"), N.batch_normalization(mode="spatial", id="bn")])
    out, _ = net.forward({"in": x}, True)
    planes = out["bn"].reshape(40, 3, 4)
    assert np.abs(planes.mean(axis=(0, 2))).max() < 1e-9 and np.abs(planes.var(axis=(0, 2)) - 1).max() < 1e-3


def test_running_moments_take_every_batch_in_order(spark):
    rng = np.random.RandomState(3)
    data = rng.normal(2, 4, (120, 4))
    df = spark.createDataFrame([(int(k), int(k // 20), row.tolist()) for k, row in enumerate(data)], "k int, batch_id int, v array<double>").repartition(5)
    for step in (1, 2, 6):
        net = N.Network.build([N.input_(4, id="in"), N.batch_normalization(ave_factor=0.8, id="bn")])
        net.train(df, {"in": "v"}, {"bn": "v"}, O.PlainSGD(0.0), step=step)
        mean = var = None
        for b in range(6):
            x = data[20 * b : 20 * b + 20]
            mean = x.mean(axis=0) if mean is None else 0.8 * mean + 0.2 * x.mean(axis=0)
            var = x.var(axis=0, ddof=1) if var is None else 0.8 * var + 0.2 * x.var(axis=0, ddof=1)
        assert np.allclose(net.state["bn.mean"], mean) and np.allclose(net.state["bn.variance"], var)


def test_regularisation_terms():
    assert K.l1(np.array([3.0, -4.0, 0.0])) [0] == 7 and K.l1(np.array([3.0, -4.0, 0.0]))[1].tolist() == [1, -1, 1]
    assert K.l2(np.array([3.0, -4.0]))[0] == 2.5 and K.l2(np.array([3.0, -4.0]))[1].tolist() == [3, -4]
    net = N.Network.build([N.input_(3, id="in"), N.linear(2, id="a", l1_regularization=0.1, weights={"l2_regularization": {"weight": 0.5}}), N.linear(2, id="out")])
    assert [(t.type, t.node, t.argument, t.weight) for t in net.terms] == [("l1_regularization", "a", "", 0.1), ("l2_regularization", "a", "weights", 0.5)]
    rng = np.random.RandomState(4)
    data, truth = {"in": rng.normal(size=(5, 3))}, {"out": rng.normal(size=(5, 2))}
    out, _ = net.forward(data)
    value, nodes, own, _ = net.term_gradients(out, truth)
    assert value == pytest.approx(0.1 * np.abs(out["a"]).sum() + 0.5 * np.linalg.norm(net.parameters["a.weights"]) / 2)
    assert np.allclose(own["a.weights"], 0.5 * net.parameters["a.weights"]) and np.allclose(nodes["a"], 0.1 * np.sign(out["a"]))
    net.terms = [t for t in net.terms if t.type == "l1_regularization"]
    assert np.abs(analytic(net, data, truth) - numeric(net, data, truth)).mean() < 1e-6
    for bad in ("x", True, None):
        with pytest.raises(ValueError):
            N.Network.build([N.input_(3), N.linear(2, l1_regularization=bad)])


def test_centre_loss(spark):
    """Classes 0 2 0 3 3 0, features 20 at the class, centres of ones: gradient feature - 1."""
    labels = [0, 2, 0, 3, 3, 0]
    features = np.eye(5)[labels] * 20
    back, sums, n = K.center_terms(np.ones((5, 5)), features, np.array(labels))
    assert np.allclose(back, features - 1) and n.tolist() == [3, 0, 1, 2, 0]
    moved = K.moved_centers(np.ones((5, 5)), sums, n, 0.5, 10.0)
    want = np.full(5, 0.5)
    want[0] = 10.5
    assert np.allclose(moved[0], want * 10 / np.linalg.norm(want), atol=1e-5) and np.allclose(moved[1], np.ones(5) * 10 / np.sqrt(5), atol=1e-4)
    df = spark.createDataFrame([(k, 0, f.tolist(), np.eye(5)[c].tolist()) for k, (f, c) in enumerate(zip(features, labels))], "k int, batch_id int, v array<double>, t array<double>")
    net = N.Network.build([N.input_(5, id="in"), N.linear(5, id="mid", weights=np.eye(5), center_loss={"alpha": 0.5, "radius": 10}), N.softmax(id="out")])
    assert net.terms[0].weight == 0.1 and net.state["mid.centers"].shape == (5, 5)
    net.train(df, {"in": "v"}, {"out": "t"}, O.PlainSGD(0.0))
    got = net.state["mid.centers"]
    assert np.allclose(got[0], [10, 0, 0, 0, 0], atol=1e-4) and np.allclose(got[1], 0)
    told = {r["loss"]: r["value"] for r in net.evaluate(df, {"in": "v"}, {"out": "t"}).collect()}
    assert told["center_loss"] == pytest.approx(0.1 * 10 / 2, rel=1e-4)


def test_detection_loss_and_gradient():
    rng = np.random.RandomState(5)
    d = detect.Detection((2, 3), ((1.0, 2.0), (2.0, 1.5)))
    flat, truth = rng.normal(size=(2, 2 * 3 * 2 * 8)), np.abs(rng.normal(size=(2, 2 * 3 * 2 * 8))) * 0.5
    value, grad = d.loss(flat, truth)
    f = d.formatted(flat)
    w = d.weights(f, d.cells(truth))
    assert np.allclose(f[..., 5:].sum(axis=-1), 1) and set(np.unique(w)) <= {0.0, 0.5, 1.0, 5.0}
    fixed = lambda x: float((w * (d.formatted(x.reshape(flat.shape)) - d.cells(truth)) ** 2).sum())
    assert value.sum() == pytest.approx(fixed(flat))
    assert np.abs(O.numeric_gradient(fixed, flat.ravel().copy(), 1e-5) - grad.ravel()).mean() < 1e-6
    net = N.Network.build([N.input_(4, id="in"), N.linear(2 * 3 * 2 * 8, id="out", detection=d)])
    out, _ = net.forward({"in": rng.normal(size=(2, 4))})
    assert net.losses == {"out": "yolo2"} and net.loss(out, {"out": truth})[0] > 0
    assert detect.Detection().anchors.shape == (5, 2) and detect.GRID == (13, 13)


def test_rounds_give_what_one_task_gives(spark):
    rng = np.random.RandomState(6)
    boxes = [(int(k), int(k % 3), "ab"[k % 2], float(rng.randint(5)) / 4, *(float(x) for x in rng.uniform(0, 12, 2)), *(float(x) for x in rng.uniform(2, 5, 2))) for k in range(240)]
    df = spark.createDataFrame(boxes, "box_id long, image int, class string, score double, x double, y double, w double, h double")
    for group in (["image"], ["image", "class"]):
        one = detect.non_maximum_suppression(df, group, "score", "box_id", 0.3)
        many = detect.non_maximum_suppression(df, group, "score", "box_id", 0.3, small=0)
        assert 0 < one.count() < 240 and sorted(map(tuple, one.collect())) == sorted(map(tuple, many.select(*one.columns).collect()))
    left, right = df.where("box_id % 2 = 0").withColumnRenamed("box_id", "l"), df.where("box_id % 2 = 1").withColumnRenamed("box_id", "p")
    pairs = detect.iou_pairs(left, right, "image", "l", "p", 0.2).withColumn("iou", F.round("iou", 1))
    one, many = detect.greedy_match(pairs, "image", "l", "p"), detect.greedy_match(pairs, "image", "l", "p", small=0)
    assert one.count() > 10 and sorted(map(tuple, one.collect())) == sorted(map(tuple, many.select(*one.columns).collect()))


def test_descriptions():
    net = N.Network.build([N.input_(4, 4, 2, id="in"), N.convolutional(3, 1, 1, 3, id="conv"), N.relu(id="r"), N.linear(2, id="out", weights=np.arange(96.0), bias=[1, 2], learning_attenuation=0.5)])
    assert net.parameters["out.weights"].shape == (2, 48) and net.parameters["out.bias"].tolist() == [1, 2]
    assert net.children("conv") == ["r"] and net.edges()[0] == ("in", "conv") and net.dims("conv") == {"channels": 3, "height": 4, "width": 4}
    assert set(net.rates()) == {0.5, 1.0} and [a["key"] for a in net.arguments("out")] == ["r", "weights", "bias"]
    net.set_property("conv", "non_trainable", True)
    assert "conv.weights" not in net.names() and [k for k, _ in net.backward_pass()] == ["out"]
    net.set_property("conv", "non_trainable", False)
    net.set_property("out", "l2_regularization", 0.3)
    assert net.terms[0].weight == 0.3 and "conv.weights" in net.names()
    bigger = net.resize_input(6, 6, 2)
    assert bigger.shapes["out"] == (1, 1, 2) and bigger.parameters["out.weights"].shape == (2, 108)
    assert np.array_equal(bigger.parameters["conv.weights"], net.parameters["conv.weights"])
    late = N.Network.build([N.input_(2, id="in"), N.join(id="j", parents=["a", "b"]), N.linear(3, id="a", parents=["in"]), N.linear(3, id="b", parents=["in"])])
    assert [x.id for x in late.layers] == ["in", "a", "b", "j"]
    with pytest.raises(ValueError):
        N.Network.build([N.input_(2), N.linear(3, weights=[1.0, 2.0])])
    with pytest.raises(ValueError):
        N.Network.build([N.input_(2), N.linear(3, parents=["nobody"])])
    assert N.verify(net, {"in": np.ones((1, 32))}, {"out": net.forward({"in": np.ones((1, 32))})[0]["out"] + 0.1}) == {"out": pytest.approx(0.1)}


def test_constrained_weights():
    net = N.Network.build([N.input_(2, id="in"), N.linear(2, id="out", weights=[3, 4, 0.3, 0.4], l2_max_constraint=1.0)])
    net.constrain()
    assert np.allclose(net.parameters["out.weights"], [[0.6, 0.8], [0.3, 0.4]])


def test_batches_must_be_full(spark):
    df = spark.createDataFrame([(k, [float(k)], [2.0 * k]) for k in range(7)], "k int, v array<double>, t array<double>")
    net = N.Network.build([N.input_(1, id="in"), N.linear(1, id="out")])
    assert net.run(df, {"in": "v"}, 3, "k").count() == 6
    with pytest.raises(ValueError):
        net.run(df, {"in": "v"}, 8, "k")
    with pytest.raises(ValueError):
        net.train(df.withColumn("batch_id", F.lit(0)).limit(0), {"in": "v"}, {"out": "t"}, O.PlainSGD())
    wide = rows.augmented(df, {"twice": F.transform("v", lambda x: 2 * x), "n": lambda w: F.count("*").over(w)})
    assert all(r["n"] == 7 and r["twice"][0] == 2 * r["v"][0] for r in wide.collect())


def test_experiment(spark):
    rng = np.random.RandomState(7)
    data = [(k, (c := k % 2), [c + 0.3 * rng.normal(), -c + 0.3 * rng.normal()]) for k in range(200)]
    df = spark.createDataFrame([(k, list(map(float, v)), [float(1 - c), float(c)]) for k, c, v in data], "k int, v array<double>, t array<double>")
    net, told = N.perform_experiment([N.input_(2, id="in"), N.linear_softmax(2, id="out")], df.where("k < 150"), df.where("k >= 150"), {"in": "v"}, {"out": "t"}, O.PlainSGD(0.5), "k", size=25, count=4, step=2)
    assert [h["epoch"] for h in told] == [0, 1, 2, 3] and max(h["cv_accuracy"] for h in told) > 0.85 and told[0]["best"]
    assert len([h for h in told if h["best"]]) >= 1


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    """Two runs of a stream, each with a new network object, give what two steps give."""
    from quern.streaming.online import train_stream

    parts = [[(10 * b + k, [float(k % 5), 1.0], [2.0 * (k % 5) + b]) for k in range(10)] for b in range(4)]
    schema = "k long, data array<double>, label array<double>"
    build = lambda: N.Network.build([N.input_(2, id="in"), N.linear(1, id="out")], seed=1)
    for some in (parts[:2], parts[2:]):
        for part in some:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        net = build()
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
        q = train_stream(stream, net, {"in": "data"}, {"out": "label"}, O.SGD(rate=0.01), str(tmp_path / "c"), "k")
        assert q.awaitTermination(120)
    x = build()
    opt = O.SGD(rate=0.01)
    for some in (parts[:2], parts[2:]):
        data = [r for part in some for r in part]
        out, kept = x.forward({"in": np.array([r[1] for r in data])}, True)
        _, g = x.loss(out, {"out": np.array([r[2] for r in data])})
        flat = x.backward(out, kept, g)
        x.assign(opt.step(x.flat(), np.concatenate([flat[k].ravel() for k in x.names()]) / len(data)))
    assert np.allclose(net.flat(), x.flat())


def test_trees_grow_with_their_depth_only(spark):
    df = spark.createDataFrame([(k, *(float(k >> b & 1) for b in range(7)), int(bin(k).count("1") % 2)) for k in range(128)], "id long, " + ", ".join(f"f{b} double" for b in range(7)) + ", y int")
    t = tree.grow(df, [f"f{b}" for b in range(7)], "y", depth=7, splitter="random", seed=2)
    assert df.where(t.column() != F.col("y")).count() == 0
    assert tree.mode({}) is None and tree.mode({"b": 2, "a": 2}) == "a"


def test_row_numbers_within_classes(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2] if k % 5 else None, (k * 37) % 101) for k in range(300)], "id int, c string, key int")
    got = df.select("id", "c", "key").collect()
    want = {}
    for c in {r["c"] for r in got}:
        for n, r in enumerate(sorted((r for r in got if r["c"] == c), key=lambda r: (r["key"], r["id"]))):
            want[r["id"]] = n
    assert {r["id"]: r["turn"] for r in rows.class_rounds(df, "c", "key", "id").collect()} == want


def test_staging_needs_a_shared_folder():
    class Context:
        master, applicationId = "yarn", "a"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError):
        staging.shared_folder(Session())


def idx(path, magic, shape, data):
    import gzip
    import struct

    raw = struct.pack(f">{1 + len(shape)}i", magic, *shape) + bytes(data)
    path.write_bytes(gzip.compress(raw) if path.name.endswith(".gz") else raw)


def test_digits_and_weights(spark, tmp_path):
    from quern.sources import io

    rng = np.random.RandomState(8)
    images = {part: rng.randint(0, 256, (n, 784)) for part, n in (("train", 5), ("t10k", 3))}
    for part, x in images.items():
        idx(tmp_path / f"{part}-images-idx3-ubyte.gz", 2051, (len(x), 28, 28), x.astype(np.uint8).tobytes())
        idx(tmp_path / f"{part}-labels-idx1-ubyte", 2049, (len(x),), [k % 10 for k in range(len(x))])
    train, test = io.digits(spark, str(tmp_path), "train"), io.digits(spark, str(tmp_path), "test")
    assert train.count() == 5 and test.count() == 3
    assert np.allclose(np.array([r["data"] for r in test.orderBy("row").collect()]), images["t10k"] / 255 - 0.5)
    a, b = io.whitened_digits(spark, str(tmp_path))
    both = np.concatenate([np.array([r["data"] for r in x.orderBy("row").collect()]) for x in (a, b)])
    raw = np.concatenate([images["train"], images["t10k"]]) / 255 - 0.5
    raw = raw / raw.mean()
    assert np.allclose(both, raw / np.sqrt((raw**2).mean()))

    net = N.Network.build([N.input_(4, 4, 2, id="in"), N.convolutional(3, 1, 1, 5, id="c"), N.linear(2, id="out")])
    kernel, dense = rng.normal(size=(3, 3, 2, 5)), rng.normal(size=(80, 2))
    io.load_arrays(net, {"c.weights": kernel, "out.weights": dense, "c.bias": np.ones(5)})
    x = rng.normal(size=(1, 2, 4, 4))
    out, _ = net.forward({"in": x.reshape(1, -1)})
    padded = np.pad(x[0], ((0, 0), (1, 1), (1, 1)))
    want = sum(padded[c, 1 : 4, 2 : 5].ravel() @ kernel[:, :, c, 3].ravel() for c in range(2)) + 1
    assert out["c"].reshape(5, 4, 4)[3, 1, 2] == pytest.approx(want)
    assert np.allclose(out["out"], out["c"] @ dense)
    old = {"layers": [], "parameters": {"a": {"values": [1, 2, 3, 4], "shape": [2, 2]}, "a.gradient": {"values": [0], "shape": [1]}}, "gradients": 1}
    assert io.upgrade_network(old) == {"layers": [], "parameters": {"a": [[1.0, 2.0], [3.0, 4.0]]}}
    io.log_metrics(spark, str(tmp_path / "m"), 1, {"loss": 0.5, "w": np.array([1.0, 3.0])})
    assert {(r["name"], r["value"]) for r in spark.read.parquet(str(tmp_path / "m")).collect()} == {("loss", 0.5), ("w", 2.0)}


def test_plain_helpers():
    from quern.functions import tensors as X
    from quern.functions import utils as U

    assert U.merged({"a": {"b": 1}, "c": 2}, {"a": {"d": 3}}, None) == {"a": {"b": 1, "d": 3}, "c": 2}
    assert U.vectorize({"k": (1, [np.array([2, 3])], "s")}) == {"k": [1, [[2, 3]], "s"]}
    assert U.fresh_id("a", {"a-1", "a-2"}) == "a-3" and U.row_ranges(3, 10) == [(0, 3), (3, 3), (6, 4)]
    assert U.cpu_time(lambda: 5)[0] == 5
    with pytest.raises(U.QuernError):
        U.row_ranges(1, 10)
    d = X.Dims.of(4, 6)
    part = d.select([1, 2], [0, 1, 2])
    assert d.dense and not part.dense and part.access_increasing and part.as_dense() is None and d.as_dense() is d
    assert part.reshape(2, 1, 3).strides == (6, 1, 1) or part.reshape(2, 1, 3).extents == (2, 1, 3)
    for bad in ((7, 6), (5, 5)):
        with pytest.raises(U.QuernError):
            d.reshape(*bad)
    with pytest.raises(U.QuernError):
        part.reshape(6)
    with pytest.raises(U.QuernError):
        d.transpose((1, 0)).reshape(24)
    with pytest.raises(U.QuernError):
        X.broadcast_shape(X.Dims.of(4), X.Dims.of(3))
    assert X.broadcast_shape(X.Dims.of(4, 1), X.Dims.of(2, 3)) == (4, 3)
    assert d.as_row_vector().extents == (24,) and d.as_column_vector().extents == (24, 1) and X.Dims.of(2, 3, 4).as_batch_matrix().extents == (2, 12) and X.Dims.of(2, 3, 4).as_2d_matrix().extents == (6, 4)
    assert X.Dims.of(2, 3, 4).minimize().extents == (24,) and X.numbers("max", 2, 3) == 3
    with pytest.raises(U.QuernError):
        X.numbers("eq", 1, 1)


def test_random_matrix(spark):
    from quern.functions import tensors as X

    x = np.array([r["x"] for r in X.random_matrix(spark, 50, 40, 3).collect()])
    assert len(x) == 2000 and abs(x.mean()) < 0.1 and abs(x.std() - 1) < 0.1
    assert X.to_numpy(spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "v array<double>"), "v").tolist() == [[1, 2], [3, 4]]


def test_pictures(spark, tmp_path):
    from quern.operators import metrics
    from quern.sources import images, io

    rng = np.random.RandomState(9)
    for cls in ("cat", "dog"):
        (tmp_path / cls).mkdir()
        for k in range(4):
            rgb = rng.randint(0, 256, (6, 8, 3)).astype(np.uint8)
            (tmp_path / cls / f"{k}.ppm").write_bytes(b"P6\n# made here\n8 6\n255\n" + rgb.tobytes())
    (tmp_path / "cat" / "bad.ppm").write_bytes(b"P6 no picture")
    got = images.prepare(io.labelled_folder(spark, str(tmp_path), "*.ppm"), 2).collect()
    assert sorted(r["class"] for r in got) == ["cat"] * 4 + ["dog"] * 4 and all(len(r["data"]) == 4 for r in got)
    x = images.decode_netpbm((tmp_path / "dog" / "3.ppm").read_bytes())
    assert x.shape == (6, 8, 3)
    small = images.resized(images.grey(x), 2, 2)
    assert np.allclose(small, images.grey(x).reshape(2, 3, 2, 4).mean(axis=(1, 3)))
    assert any(np.allclose(r["data"], (small - 0.5).ravel()) for r in got)
    assert np.allclose(images.resized(np.ones((5, 7)), 3, 4), 1)
    df = spark.createDataFrame([(k, r["class"], r["data"]) for k, r in enumerate(got)], "k int, class string, data array<double>")
    train, test = images.train_and_test(df, "k")
    assert train.count() == test.count() == 4 and not {r["k"] for r in train.collect()} & {r["k"] for r in test.collect()}
    assert sorted((r["part"], r["count"]) for r in metrics.sample_view(train, test, "k", 3).groupBy("part").count().collect()) == [("test", 3), ("training", 3)]


def test_session(spark):
    from quern.session import session

    assert session().sparkContext is spark.sparkContext
