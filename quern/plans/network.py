"""Declarative layer graphs: description, shapes, inference and training over DataFrames.

A description is a list of layers; each takes the one before it, or the layers named in
``parents``.  Inference runs in Arrow batches with the parameters as one broadcast vector;
networks of linear and element-wise layers can also be turned into column expressions, which
stay inside the JVM.  Training evaluates the gradient of a step's batches in parallel, sums
it through a tree, and lets the driver take the optimiser's step.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import arrays as A
from quern.operators import rows
from quern.plans import kernels as K
from quern.sources.staging import drop, stage


@dataclass
class Layer:
    type: str
    id: str = ""
    parents: list[str] = field(default_factory=list)
    options: dict = field(default_factory=dict)


def _layer(kind: str, *names: str, **defaults):
    def make(*args, id: str = "", parents: list[str] | None = None, **options) -> Layer:
        return Layer(kind, id, list(parents or []), {**defaults, **dict(zip(names, args)), **options})

    return make


input_ = _layer("input", "width", "height", "channels", height=1, channels=1)
linear = _layer("linear", "size")
softmax = _layer("softmax", channels=1)
relu, swish, selu, logistic, tanh = (_layer(k) for k in ("relu", "swish", "selu", "logistic", "tanh"))
prelu = _layer("prelu", scale=0.25)
dropout = _layer("dropout", "keep")
multiplicative_dropout = _layer("multiplicative_dropout", "variance")
convolutional = _layer("convolutional", "kernel", "pad", "stride", "kernels", pad=0, stride=1)
max_pooling = _layer("pooling", "kernel", "pad", "stride", pad=0, stride=1, op="max")
batch_normalization = _layer("batch_normalization", ave_factor=0.9, epsilon=1e-4, mode="elementwise")
local_response_normalization = _layer("lrn", n=5, k=2.0, alpha=1e-4, beta=0.75)
concatenate, split = _layer("concatenate"), _layer("split")
join = _layer("join", "operation", operation="+")


def linear_then(kind: str):
    """A linear layer followed by an activation, whose id the pair bears."""

    def make(size: int, id: str = "") -> list[Layer]:
        return [linear(size), Layer(kind, id, [], {"channels": 1} if kind == "softmax" else {})]

    return make


linear_softmax, linear_relu, linear_swish, linear_selu, linear_tanh, linear_logistic = (linear_then(k) for k in ("softmax", "relu", "swish", "selu", "tanh", "logistic"))

_PASS_TRAIN_ONLY = {"dropout", "multiplicative_dropout", "split"}
_ELEMENTWISE = set(A.ACTIVATIONS)


#: Terms of the loss beside the leaves', and the weight each has unless another is given.
TERM_LAMBDA = {"l1_regularization": 0.001, "l2_regularization": 0.001, "center_loss": 0.1}


@dataclass
class Term:
    """A part of the loss on a layer's output or on one of its parameters."""

    type: str
    node: str
    argument: str = ""  # a parameter, or empty for the output
    weight: float = 1.0
    options: dict = field(default_factory=dict)


def _term(kind: str, node: str, argument: str, value) -> Term:
    if isinstance(value, dict):
        options = dict(value)
        return Term(kind, node, argument, float(options.pop("weight", TERM_LAMBDA[kind])), options)
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"{kind} of {node} must be a number or a dictionary")
    return Term(kind, node, argument, float(value))


@dataclass
class Network:
    layers: list[Layer]
    shapes: dict[str, tuple[int, int, int]]  # channels, height, width
    parameters: dict[str, np.ndarray]
    losses: dict[str, str]
    frozen: set[str] = field(default_factory=set)
    state: dict[str, np.ndarray] = field(default_factory=dict)
    terms: list[Term] = field(default_factory=list)
    detection: dict[str, object] = field(default_factory=dict)  # leaf -> its Detection
    attenuation: dict[str, float] = field(default_factory=dict)  # layer -> factor of its gradients

    # -- building -----------------------------------------------------------------------------

    @staticmethod
    def build(description: list, seed: int = 0) -> Network:
        flat: list[Layer] = []
        for x in description:
            flat += x if isinstance(x, list) else [x]
        layers, counts, last = [], {}, None
        for x in flat:
            n = counts[x.type] = counts.get(x.type, 0) + 1
            name = x.id or f"{x.type}-{n}"
            if any(y.id == name for y in layers):
                raise ValueError(f"two layers are named {name}")
            parents = list(x.parents) or ([last] if last and x.type != "input" else [])
            layers.append(Layer(x.type, name, parents, dict(x.options)))
            last = name
        layers = _sorted(layers)
        net = Network(layers, {}, {}, {})
        rng = np.random.RandomState(seed)
        for x in layers:
            net._shape(x, rng)
            net._embed(x)
        for leaf in net.leaves():
            net.losses[leaf] = "softmax" if net.layer(leaf).type == "softmax" else "mse"
        for x in layers:
            net._attach(x)
        return net

    def _embed(self, x: Layer) -> None:
        """Parameters given as literals, alone or as ``buffer`` beside terms of the loss."""
        for key in ("weights", "bias", "scale"):
            name, given = f"{x.id}.{key}", x.options.get(key)
            if name not in self.parameters or given is None or (key == "scale" and np.ndim(given) == 0 and not isinstance(given, dict)):
                continue
            if isinstance(given, dict):
                given = given.get("buffer")
            if given is not None:
                values = np.asarray(given, float)
                if values.size != self.parameters[name].size:
                    raise ValueError(f"{name} has {self.parameters[name].size} entries, not {values.size}")
                self.parameters[name] = values.reshape(self.parameters[name].shape)

    def _attach(self, x: Layer) -> None:
        """Terms of the loss, attenuation and freezing from the layer's options."""
        o = x.options
        for kind in TERM_LAMBDA:
            if kind in o:
                self.add_term(_term(kind, x.id, "", o[kind]))
        for key in ("weights", "bias", "scale"):
            if isinstance(o.get(key), dict):
                for kind in K.REGULARIZERS:
                    if kind in o[key]:
                        self.add_term(_term(kind, x.id, key, o[key][kind]))
        if "learning_attenuation" in o:
            self.attenuation[x.id] = float(o["learning_attenuation"])
        if o.get("non_trainable"):
            self.frozen.add(x.id)
        if "loss" in o:
            self.losses[x.id] = o["loss"]
        if "detection" in o:
            self.losses[x.id], self.detection[x.id] = "yolo2", o["detection"]

    def add_term(self, term: Term) -> None:
        if term.type not in TERM_LAMBDA:
            raise ValueError(f"unknown term {term.type}")
        if term.argument and f"{term.node}.{term.argument}" not in self.parameters:
            raise ValueError(f"{term.node} has no parameter {term.argument}")
        self.terms.append(term)
        if term.type == "center_loss":
            leaf = term.options.setdefault("labels", self.leaves()[-1])
            self.state[f"{term.node}.centers"] = np.zeros((self.width(leaf), self.width(term.node)))

    def set_property(self, name: str, key: str, value) -> None:
        """An option of a built network's layer: learning_attenuation, non_trainable, a term of
        the loss, l2_max_constraint, or any other."""
        x = self.layer(name)
        x.options[key] = value
        if key in TERM_LAMBDA:
            self.terms = [t for t in self.terms if (t.type, t.node, t.argument) != (key, name, "")]
        if key == "non_trainable" and not value:
            self.frozen.discard(name)
        self._attach(Layer(x.type, name, [], {key: value}))

    def resize_input(self, width: int, height: int, channels: int, name: str | None = None) -> Network:
        """The same description over another input; parameters whose shape stays are kept."""
        name = name or self.roots()[0]
        size = {"width": width, "height": height, "channels": channels}
        plain = lambda o: {k: {a: b for a, b in v.items() if a != "buffer"} if isinstance(v, dict) else v for k, v in o.items() if k not in ("weights", "bias") or isinstance(v, dict)}
        return self._like([Layer(x.type, x.id, x.parents, {**x.options, **size} if x.id == name else plain(x.options)) for x in self.layers])

    # -- looking at it ----------------------------------------------------------------------------

    def children(self, name: str) -> list[str]:
        return [x.id for x in self.layers if name in x.parents]

    def edges(self) -> list[tuple[str, str]]:
        return [(p, x.id) for x in self.layers for p in x.parents]

    def dims(self, name: str) -> dict[str, int]:
        return dict(zip(("channels", "height", "width"), self.shapes[name]))

    def input_dims(self, name: str) -> list[dict[str, int]]:
        return [self.dims(p) for p in self.layer(name).parents]

    def arguments(self, name: str) -> list[dict]:
        """What a layer, or a term of the loss on it, reads: outputs, parameters, state, labels."""
        out = [{"type": "node-output", "key": p, "shape": self.shapes[p]} for p in self.layer(name).parents]
        if not out:
            out = [{"type": "stream", "key": name, "shape": self.shapes[name]}]
        for kind, table in (("parameter", self.parameters), ("state", self.state)):
            out += [{"type": kind, "key": k.split(".", 1)[1], "shape": v.shape, "trainable": kind == "parameter" and name not in self.frozen} for k, v in table.items() if k.split(".")[0] == name]
        return out + [{"type": "stream", "key": t.options["labels"], "term": t.type} for t in self.terms if t.node == name and "labels" in t.options]

    def streams(self) -> dict[str, tuple[int, int, int]]:
        """The columns a training run needs: inputs, and a label for each leaf."""
        return {**{k: self.shapes[k] for k in self.roots()}, **{k: self.shapes[k] for k in self.leaves()}}

    def forward_pass(self, training: bool = False) -> list[tuple[list[str], str]]:
        """(inputs, layer) in the order of evaluation; what only training does is left out."""
        return [(x.parents, x.id) for x in self.layers if training or x.type not in _PASS_TRAIN_ONLY]

    def backward_pass(self) -> list[tuple[str, list[str]]]:
        """(layer, inputs) back to the first layers that learn: what lies before needs none."""
        learns = {k.split(".")[0] for k in self.names()}
        need: set[str] = set()
        for x in self.layers:
            if x.id in learns or need & set(x.parents):
                need.add(x.id)
        return [(x.id, [p for p in x.parents if p in need]) for x in reversed(self.layers) if x.id in need]

    def loss_table(self, spark) -> DataFrame:
        """type, weight, node, argument of every term of the loss."""
        rows = [(kind, 1.0, leaf, "output") for leaf, kind in self.losses.items()] + [(t.type, t.weight, t.node, t.argument or "output") for t in self.terms]
        return spark.createDataFrame(rows, "type string, weight double, node string, argument string")

    def layer(self, name: str) -> Layer:
        return next(x for x in self.layers if x.id == name)

    def leaves(self) -> list[str]:
        used = {p for x in self.layers for p in x.parents}
        return [x.id for x in self.layers if x.id not in used]

    def roots(self) -> list[str]:
        return [x.id for x in self.layers if not x.parents]

    def width(self, name: str) -> int:
        return int(np.prod(self.shapes[name]))

    def _shape(self, x: Layer, rng) -> None:
        o = x.options
        if x.type == "input":
            self.shapes[x.id] = (o["channels"], o["height"], o["width"])
            return
        ins = [self.shapes[p] for p in x.parents]
        c, h, w = ins[0]
        n_in = int(np.prod(ins[0]))
        if x.type == "linear":
            n = o["size"]
            self.shapes[x.id] = (1, 1, n)
            self.parameters[f"{x.id}.weights"] = initial(self._kind_of(x), (n, n_in), rng)
            self.parameters[f"{x.id}.bias"] = np.zeros(n)
        elif x.type == "convolutional":
            k, p, s = o["kernel"], o["pad"], o["stride"]
            self.shapes[x.id] = (o["kernels"], K.out_size(h, k, p, s), K.out_size(w, k, p, s))
            self.parameters[f"{x.id}.weights"] = initial(self._kind_of(x), (o["kernels"], c * k * k), rng)
            self.parameters[f"{x.id}.bias"] = np.zeros(o["kernels"])
        elif x.type == "pooling":
            k, p, s = o["kernel"], o["pad"], o["stride"]
            self.shapes[x.id] = (c, K.out_size(h, k, p, s, ceil=True), K.out_size(w, k, p, s, ceil=True))
        elif x.type == "concatenate":
            self.shapes[x.id] = (1, 1, sum(int(np.prod(i)) for i in ins))
        elif x.type == "join":
            widest = max(ins, key=lambda i: int(np.prod(i)))
            self.shapes[x.id] = widest
        else:
            self.shapes[x.id] = ins[0]
        if x.type == "batch_normalization":
            if o["epsilon"] < 1e-5:
                raise ValueError("epsilon must be 1e-5 or more")
            if o["mode"] not in ("elementwise", "spatial"):
                raise ValueError("batch normalisation is elementwise or spatial")
            n_own = c if o["mode"] == "spatial" else n_in
            self.parameters[f"{x.id}.scale"], self.parameters[f"{x.id}.bias"] = np.ones(n_own), np.zeros(n_own)
            self.state[f"{x.id}.mean"], self.state[f"{x.id}.variance"] = np.zeros(n_own), np.ones(n_own)
            self.state[f"{x.id}.seen"] = np.zeros(1)
        if x.type == "prelu":
            start = o["scale"] if np.ndim(o["scale"]) == 0 and not isinstance(o["scale"], dict) else 0.25
            self.parameters[f"{x.id}.scale"] = np.full(n_in if (h == 1 and w == 1) else c, float(start))

    def _kind_of(self, x: Layer) -> str:
        at = self.layers.index(x)
        after = self.layers[at + 1].type if at + 1 < len(self.layers) else ""
        return "relu" if after in ("relu", "swish") else "xavier"

    # -- parameters as one vector ---------------------------------------------------------------

    def names(self) -> list[str]:
        return [k for k in self.parameters if k.split(".")[0] not in self.frozen]

    def flat(self) -> np.ndarray:
        return np.concatenate([self.parameters[k].ravel() for k in self.names()] or [np.zeros(0)])

    def assign(self, x: np.ndarray) -> None:
        at = 0
        for k in self.names():
            n = self.parameters[k].size
            self.parameters[k] = x[at : at + n].reshape(self.parameters[k].shape).copy()
            at += n

    # -- one batch -------------------------------------------------------------------------------

    def forward(self, inputs: dict[str, np.ndarray], training: bool = False, seed: int = 0) -> tuple[dict, dict]:
        """Outputs of every layer (rows x width), and what the backward pass needs."""
        out, kept = {}, {}
        rng = np.random.RandomState(seed)
        for x in self.layers:
            if x.type == "input":
                out[x.id] = np.asarray(inputs[x.id], float)
                continue
            ins = [out[p] for p in x.parents]
            if not training and x.type in _PASS_TRAIN_ONLY:
                out[x.id] = ins[0]
                continue
            out[x.id], kept[x.id] = K.forward(self, x, ins, training, rng)
        return out, kept

    def backward(self, out: dict, kept: dict, grads: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Gradients of the parameters from those of the leaves; frozen layers get none."""
        grads = dict(grads)
        result = {k: np.zeros_like(v) for k, v in self.parameters.items()}
        for x in reversed(self.layers):
            if x.type == "input" or x.id not in grads:
                continue
            back, own = K.backward(self, x, [out[p] for p in x.parents], out[x.id], kept.get(x.id), grads[x.id])
            for k, g in own.items():
                result[f"{x.id}.{k}"] += g
            for p, g in zip(x.parents, back):
                grads[p] = grads[p] + g if p in grads else g
        return result

    def rates(self) -> np.ndarray:
        """The attenuation of every trained parameter."""
        return np.concatenate([np.full(self.parameters[k].size, self.attenuation.get(k.split(".")[0], 1.0)) for k in self.names()] or [np.zeros(0)])

    def constrain(self) -> None:
        """Weight rows of layers with l2_max_constraint are shortened to it."""
        for x in self.layers:
            most = x.options.get("l2_max_constraint")
            if most and f"{x.id}.weights" in self.parameters and x.id not in self.frozen:
                self.parameters[f"{x.id}.weights"] = K.constrain_rows(self.parameters[f"{x.id}.weights"], float(most))

    def loss(self, out: dict, labels: dict[str, np.ndarray]) -> tuple[float, dict]:
        """Sum over rows of all leaves' losses, and the leaves' gradients a row."""
        value, grads = 0.0, {}
        for leaf, kind in self.losses.items():
            of = self.detection[leaf].loss if kind == "yolo2" else K.LOSSES[kind]
            v, g = of(out[leaf], np.asarray(labels[leaf], float))
            value += float(v.sum())
            grads[leaf] = g
        return value, grads

    def term_gradients(self, out: dict, labels: dict[str, np.ndarray]) -> tuple[float, dict, dict, dict]:
        """Of a batch, the other terms' weighted value, gradients of outputs and of parameters,
        and what centres need: summed distances and numbers by class."""
        value, nodes, own, centers = 0.0, {}, {}, {}
        for t in self.terms:
            if t.type == "center_loss":
                at = np.asarray(labels[t.options["labels"]], float)
                k = at.shape[1] - 1 - np.argmax(at[:, ::-1], axis=1)
                g, sums, n = K.center_terms(self.state[f"{t.node}.centers"], out[t.node], k)
                value += t.weight * float(np.linalg.norm(g, axis=1).sum()) / 2.0
                centers[t.node] = np.concatenate([sums, n[:, None]], axis=1)
            else:
                x = self.parameters[f"{t.node}.{t.argument}"] if t.argument else out[t.node]
                v, g = K.REGULARIZERS[t.type](x)
                value += t.weight * v
            into, key = (own, f"{t.node}.{t.argument}") if t.argument else (nodes, t.node)
            into[key] = into.get(key, 0.0) + t.weight * g
        return value, nodes, own, centers

    # -- DataFrames ------------------------------------------------------------------------------

    def project(self, df: DataFrame, input_col: str, output: str = "output") -> DataFrame:
        """Adds the (last) leaf's output by column expressions alone: linear and element-wise
        layers, softmax, joins.  A layer is a projection of its own, which the optimiser merges
        only where that repeats no work."""
        col = {x.id: F.col(f"_layer_{x.id}") for x in self.layers}
        kept = list(df.columns)
        for x in self.layers:
            ins = [col[p] for p in x.parents]
            if x.type == "input":
                made = A.doubles(F.col(input_col))
            elif x.type in _PASS_TRAIN_ONLY:
                made = ins[0]
            elif x.type == "linear":
                made = A.linear(self.parameters[f"{x.id}.weights"].tolist(), self.parameters[f"{x.id}.bias"].tolist(), ins[0])
            elif x.type in _ELEMENTWISE:
                made = A.activate(x.type, ins[0])
            elif x.type == "softmax" and x.options.get("channels", 1) == 1:
                made = A.softmax(ins[0])
            elif x.type == "concatenate":
                made = F.concat(*ins)
            elif x.type == "join" and len(ins) == 2:
                made = A.join_vectors(x.options["operation"], *ins)
            else:
                raise ValueError(f"{x.type} has no column form")
            df = df.withColumn(f"_layer_{x.id}", made)
        return df.select(*kept, col[self.leaves()[-1]].alias(output))

    def transform(self, df: DataFrame, inputs: dict[str, str], prefix: str = "") -> DataFrame:
        """Adds an ARRAY<DOUBLE> column for each leaf, named prefix + leaf."""
        leaves = self.leaves()
        shared = df.sparkSession.sparkContext.broadcast(self)
        pick = F.struct(*(A.doubles(F.col(c)).alias(k) for k, c in inputs.items()))

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            net = shared.value
            data = {k: np.stack([np.asarray(v, float) for v in rows[k]]) for k in inputs} if len(rows) else {k: np.zeros((0, net.width(k))) for k in inputs}
            out, _ = net.forward(data)
            return pd.DataFrame({k: list(out[k]) for k in leaves})

        schema = "struct<" + ", ".join(f"`{k}`: array<double>" for k in leaves) + ">"
        run.__annotations__ = {"rows": pd.DataFrame, "return": pd.DataFrame}
        got = df.withColumn("_out", F.pandas_udf(run, schema)(pick))
        return got.select(*df.columns, *(F.col("_out").getField(k).alias(prefix + k) for k in leaves))

    def run(self, df: DataFrame, inputs: dict[str, str], size: int, key: str, prefix: str = "") -> DataFrame:
        """``transform`` of the rows of full batches only; an error where there is none."""
        return self.transform(rows.full_batches(df, size, key), inputs, prefix)

    def batch_outputs(self, df: DataFrame, inputs: dict[str, str], batch: str, key: str, seed: int = 0) -> DataFrame:
        """key, and the leaves' outputs as training computes them, a batch at a time."""
        leaves = self.leaves()
        shared = df.sparkSession.sparkContext.broadcast(self)

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            data = {k: np.stack([np.asarray(v, float) for v in pdf[c]]) for k, c in inputs.items()}
            out, _ = shared.value.forward(data, True, seed + int(pdf[batch].iloc[0]))
            return pd.DataFrame({key: pdf[key], **{k: list(out[k]) for k in leaves}})

        schema = f"`{key}` {df.schema[key].dataType.simpleString()}, " + ", ".join(f"`{k}` array<double>" for k in leaves)
        return df.select(key, batch, *dict.fromkeys(inputs.values())).groupBy(batch).applyInPandas(one, schema)

    def input_gradients(self, df: DataFrame, inputs: dict[str, str], grads: dict[str, str], key: str) -> DataFrame:
        """key, and for each input the gradient that the leaves' gradients (columns by leaf) give."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            net = shared.value
            for pdf in parts:
                if not len(pdf):
                    continue
                out, kept = net.forward({k: np.stack([np.asarray(v, float) for v in pdf[c]]) for k, c in inputs.items()}, True)
                got = {k: np.stack([np.asarray(v, float) for v in pdf[c]]) for k, c in grads.items()}
                for x in reversed(net.layers):
                    if x.type != "input" and x.id in got:
                        back, _ = K.backward(net, x, [out[p] for p in x.parents], out[x.id], kept.get(x.id), got[x.id])
                        for p, g in zip(x.parents, back):
                            got[p] = got[p] + g if p in got else g
                yield pd.DataFrame({key: pdf[key], **{k: list(got[k]) for k in inputs}})

        schema = f"`{key}` {df.schema[key].dataType.simpleString()}, " + ", ".join(f"`{k}` array<double>" for k in inputs)
        return df.select(key, *dict.fromkeys([*inputs.values(), *grads.values()])).mapInPandas(run, schema)

    def _followed(self) -> tuple[list[str], list[str]]:
        """Layers whose running moments, and layers whose centres, a step moves."""
        moments = [x.id for x in self.layers if x.type == "batch_normalization"]
        return moments, list(dict.fromkeys(t.node for t in self.terms if t.type == "center_loss"))

    def step_gradient(self, df: DataFrame, inputs: dict[str, str], labels: dict[str, str], batch: str, seed: int) -> tuple[np.ndarray, float, int]:
        """Summed gradient, loss and number of rows of the batches of ``df``.  A task works on
        one batch; sums over 16 lanes meet before the driver adds them.  Running moments take
        every batch in the order of its number; centres move once, by all rows of the step."""
        shared = df.sparkSession.sparkContext.broadcast(self)
        moments, centred = self._followed()
        sizes = [2 * self.state[f"{k}.mean"].size for k in moments] + [self.state[f"{k}.centers"].size + len(self.state[f"{k}.centers"]) for k in centred]
        numbers = sorted(r[0] for r in df.select(batch).distinct().collect()) if moments else []  # a step's batches
        behind = {b: len(numbers) - 1 - k for k, b in enumerate(numbers)}

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            net, number = shared.value, int(pdf[batch].iloc[0])
            data = {k: np.stack([np.asarray(v, float) for v in pdf[c]]) for k, c in inputs.items()}
            truth = {k: np.stack([np.asarray(v, float) for v in pdf[c]]) for k, c in labels.items()}
            out, kept = net.forward(data, True, seed + number)
            value, grads = net.loss(out, truth)
            more, nodes, own, centers = net.term_gradients(out, truth)
            for k, g in nodes.items():
                grads[k] = grads[k] + g if k in grads else g
            g = net.backward(out, kept, grads)
            for k, x in own.items():
                g[k] = g[k] + x
            parts = [g[k].ravel() for k in net.names()]
            for k in moments:
                f = net.layer(k).options["ave_factor"]
                first = behind[number] == len(behind) - 1 and not net.state[f"{k}.seen"][0]
                share = f ** behind[number] * (1.0 if first else 1.0 - f)
                parts.append(share * np.concatenate([kept[k]["mean"], kept[k]["variance"]]))
            parts += [centers[k].ravel() for k in centred]
            return pd.DataFrame({"lane": [number % 16], "g": [np.concatenate(parts or [np.zeros(0)]).tobytes()], "loss": [value + more], "rows": [len(pdf)]})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            g = np.sum([np.frombuffer(x) for x in pdf["g"]], axis=0)
            return pd.DataFrame({"lane": [pdf["lane"].iloc[0]], "g": [g.tobytes()], "loss": [pdf["loss"].sum()], "rows": [pdf["rows"].sum()]})

        schema = "lane int, g binary, loss double, rows long"
        parts = df.groupBy(batch).applyInPandas(one, schema).groupBy("lane").applyInPandas(add, schema).collect()  # 16 rows
        n = len(self.flat())
        if not parts:
            return np.zeros(n), 0.0, 0
        total = sum(np.frombuffer(p["g"]) for p in sorted(parts, key=lambda p: p["lane"]))
        at = n
        for i, (k, size) in enumerate(zip([*moments, *centred], sizes)):
            got, at = total[at : at + size], at + size
            if i < len(moments):
                old = self.layer(k).options["ave_factor"] ** len(numbers) if self.state[f"{k}.seen"][0] else 0.0
                mean, variance = got.reshape(2, -1)
                self.state[f"{k}.mean"] = old * self.state[f"{k}.mean"] + mean
                self.state[f"{k}.variance"] = old * self.state[f"{k}.variance"] + variance
                self.state[f"{k}.seen"] = np.ones(1)
            else:
                o = next(t for t in self.terms if t.type == "center_loss" and t.node == k).options
                held = self.state[f"{k}.centers"]
                both = got.reshape(len(held), -1)
                self.state[f"{k}.centers"] = K.moved_centers(held, both[:, :-1], both[:, -1], float(o.get("alpha", 0.5)), float(o.get("radius") or 1.0))
        return total[:n], float(sum(p["loss"] for p in parts)), int(sum(p["rows"] for p in parts))

    def train(self, batches: DataFrame | Steps, inputs: dict[str, str], labels: dict[str, str], optimizer, batch: str = "batch_id", step: int = 1, seed: int = 0) -> float:
        """One epoch: ``step`` batches at a time give one optimiser step.  Mean loss a row.
        Give ``Steps`` where several epochs read the same batches."""
        own = not isinstance(batches, Steps)
        steps = Steps(batches, batch, step) if own else batches
        if not steps.numbers:
            raise ValueError("there is no batch to train on")
        total, rows = 0.0, 0
        rates = self.rates()
        for k in steps.numbers:
            g, value, count = self.step_gradient(steps.read(k), inputs, labels, steps.batch, seed + k * steps.step)
            if count:
                self.assign(optimizer.step(self.flat(), rates * g / count))
                self.constrain()
                total, rows = total + value, rows + count
        if own:
            steps.close()
        return total / max(1, rows)

    def evaluate(self, df: DataFrame, inputs: dict[str, str], labels: dict[str, str]) -> DataFrame:
        """leaf, loss, value, weight: the mean loss of every leaf, and the other terms' values
        after their weight."""
        leaves = df.sparkSession.sparkContext.broadcast(self)
        names = [*(f"leaf {k}" for k in self.losses), *(f"term {i}" for i in range(len(self.terms)))]
        pick = F.struct(*(A.doubles(F.col(c)).alias(f"in {k}") for k, c in inputs.items()), *(A.doubles(F.col(c)).alias(f"of {k}") for k, c in labels.items()))

        def one(part: pd.DataFrame) -> pd.DataFrame:
            net = leaves.value
            if not len(part):
                return pd.DataFrame({k: np.zeros(0) for k in names})
            data = {k: np.stack([np.asarray(v, float) for v in part[f"in {k}"]]) for k in inputs}
            truth = {k: np.stack([np.asarray(v, float) for v in part[f"of {k}"]]) for k in labels}
            out, _ = net.forward(data)
            got = {}
            for leaf, kind in net.losses.items():
                of = net.detection[leaf].loss if kind == "yolo2" else K.LOSSES[kind]
                got[f"leaf {leaf}"] = of(out[leaf], truth[leaf])[0]
            for i, t in enumerate(net.terms):
                if t.type == "center_loss":
                    k = truth[t.options["labels"]]
                    k = k.shape[1] - 1 - np.argmax(k[:, ::-1], axis=1)
                    v = np.linalg.norm(out[t.node] - net.state[f"{t.node}.centers"][k], axis=1) / 2.0
                elif t.argument:
                    v = np.full(len(part), K.REGULARIZERS[t.type](net.parameters[f"{t.node}.{t.argument}"])[0])
                else:
                    v = np.array([K.REGULARIZERS[t.type](x)[0] for x in out[t.node]])
                got[f"term {i}"] = t.weight * v
            return pd.DataFrame(got)[names]

        schema = "struct<" + ", ".join(f"`{k}`: double" for k in names) + ">"
        one.__annotations__ = {"part": pd.DataFrame, "return": pd.DataFrame}
        means = df.select(F.pandas_udf(one, schema)(pick).alias("v")).agg(*(F.avg(F.col("v").getField(k)).alias(k) for k in names))
        facts = [*((k, leaf, kind, 1.0) for k, (leaf, kind) in zip(names, self.losses.items())), *((f"term {i}", t.node, t.type, t.weight) for i, t in enumerate(self.terms))]
        table = F.array(*(F.struct(F.lit(leaf).alias("leaf"), F.lit(kind).alias("loss"), F.col(f"`{k}`").alias("value"), F.lit(w).alias("weight")) for k, leaf, kind, w in facts))
        return means.select(F.explode(table).alias("r")).select("r.*")

    # -- description ---------------------------------------------------------------------------

    def without(self, first_removed: str) -> Network:
        """A network without this layer and all that depend on it, parameters kept."""
        gone = {first_removed}
        for x in self.layers:
            if gone & set(x.parents):
                gone.add(x.id)
        return self._like([x for x in self.layers if x.id not in gone])

    def append(self, more: list) -> Network:
        if len(self.leaves()) != 1:
            raise ValueError("only a network with one leaf can grow")
        return self._like([*self.layers, *more])

    def _like(self, layers: list) -> Network:
        net = Network.build(layers)
        net.parameters.update({k: v for k, v in self.parameters.items() if k in net.parameters and net.parameters[k].shape == v.shape})
        net.state.update({k: v for k, v in self.state.items() if k in net.state})
        net.frozen = {k for k in self.frozen if any(x.id == k for x in net.layers)}
        net.attenuation = {k: v for k, v in self.attenuation.items() if any(x.id == k for x in net.layers)}
        return net

    def summary(self) -> list[tuple]:
        return [(x.id, x.type, self.shapes[x.id], sum(v.size for k, v in self.parameters.items() if k.split(".")[0] == x.id)) for x in self.layers]

    def to_json(self) -> str:
        return json.dumps({"layers": [x.__dict__ for x in self.layers], "losses": self.losses, "frozen": sorted(self.frozen)})


def _sorted(layers: list[Layer]) -> list[Layer]:
    """Parents first; otherwise in the order given."""
    names = {x.id for x in layers}
    for x in layers:
        for p in x.parents:
            if p not in names:
                raise ValueError(f"{x.id} has no parent {p}")
    out: list[Layer] = []
    left = list(layers)
    while left:
        done = {x.id for x in out}
        ready = next((x for x in left if set(x.parents) <= done), None)
        if ready is None:
            raise ValueError("the layers go in a circle")
        out.append(ready)
        left.remove(ready)
    return out


class Steps:
    """Batches written once, a folder a step, so that a step reads its own rows only."""

    def __init__(self, batches: DataFrame, batch: str = "batch_id", step: int = 1):
        self.batch, self.step = batch, step
        marked = batches.withColumn("_step", F.floor(F.col(batch) / step).cast("int"))
        self.table = stage(marked.repartition("_step"), "steps", by="_step")
        self.numbers = sorted(r[0] for r in self.table.select("_step").distinct().collect())  # an optimiser step each

    def read(self, number: int) -> DataFrame:
        return self.table.where(F.col("_step") == number).drop("_step")

    def close(self) -> None:
        drop(self.table)


def initial(kind: str, shape: tuple[int, int], rng) -> np.ndarray:
    """Weights with exact mean 0 and the variance of the named rule."""
    out, n = shape
    variance = {"xavier": 1.0 / n, "relu": 2.0 / n, "bengio-glorot": 2.0 / (n + out)}
    if kind == "orthogonal":
        q, _ = np.linalg.qr(rng.normal(size=(max(shape), min(shape))))
        return np.sqrt(2.0) * (q if q.shape == shape else q.T)
    w = rng.normal(size=shape)
    w = w - w.mean()
    spread = w.std()
    return w * np.sqrt(variance[kind]) / (spread if spread > 0 else 1.0)


def epochs(net: Network, batches: DataFrame, inputs, labels, optimizer, count: int, test=None, step: int = 1) -> Iterator[tuple[int, float, float | None]]:
    """(epoch, training loss, test value); the parameters of the best test value are kept."""
    best, held, steps = None, None, Steps(batches, step=step)
    for k in range(count):
        loss = net.train(steps, inputs, labels, optimizer, seed=k * 1_000_003)
        value = test(net) if test else None
        if value is not None and (best is None or value < best):
            best, held = value, net.flat().copy()
        yield k, loss, value
    steps.close()
    if held is not None:
        net.assign(held)


def evaluate_mse(df: DataFrame, guess: str, answer: str) -> DataFrame:
    """The mean distance between guesses and answers."""
    gap = F.aggregate(F.zip_with(guess, answer, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return df.agg(F.avg(F.sqrt(gap)).alias("distance"))


def evaluate_softmax(df: DataFrame, guess: str, answer: str) -> DataFrame:
    """The share of rows whose guess, as a unit vector, is the answer."""
    same = F.forall(F.zip_with(A.unit_vector(F.col(guess)), answer, lambda a, b: F.abs(a - b) < 1e-6), lambda x: x)
    return df.agg(F.avg(same.cast("double")).alias("accuracy"))


def classification_listener(net: Network, train: DataFrame, test: DataFrame, inputs: dict[str, str], labels: dict[str, str]):
    """Called after every epoch: accuracy and loss on the test rows, and whether this is the
    best network so far."""
    leaf, best = next(iter(labels)), [-1.0]

    def told(net: Network, epoch: int, loss: float) -> dict:
        out = net.transform(test, inputs, "_p_")
        accuracy = evaluate_softmax(out, f"_p_{leaf}", labels[leaf]).first()["accuracy"] or 0.0
        keep = accuracy > best[0]
        best[0] = max(best[0], accuracy)
        return {"epoch": epoch, "train_loss": loss, "cv_accuracy": accuracy, "best": keep}

    return told


def perform_experiment(description: list, train: DataFrame, test: DataFrame, inputs: dict[str, str], labels: dict[str, str], optimizer, key: str, listener=classification_listener, size: int = 50, count: int = 5, step: int = 1, seed: int = 0) -> tuple[Network, list[dict]]:
    """Build, train epoch by epoch, ask the listener after each; the parameters of the last
    epoch that it calls best, and what it said."""
    net = Network.build(description, seed)
    told, history, held = listener(net, train, test, inputs, labels), [], None
    steps = Steps(rows.full_batches(train, size, key), step=step)
    for k in range(count):
        loss = net.train(steps, inputs, labels, optimizer, seed=seed + k * 1_000_003)
        history.append(told(net, k, loss))
        if history[-1].get("best", True):
            held = net.flat().copy()
    steps.close()
    if held is not None:
        net.assign(held)
    return net, history


def verify(net: Network, inputs: dict[str, np.ndarray], expected: dict[str, np.ndarray], tolerance: float = 1e-3) -> dict[str, float]:
    """Layers whose outputs differ from an imported model's by more than the tolerance on
    average, and by how much."""
    out, _ = net.forward(inputs)
    gaps = {k: float(np.abs(out[k] - np.asarray(v, float).reshape(out[k].shape)).mean()) for k, v in expected.items()}
    return {k: g for k, g in gaps.items() if not g <= tolerance}
