"""Network descriptions from other tools' model files: Keras JSON and Caffe prototxt."""

from __future__ import annotations

import json
import re

from quern.plans import network as N
from quern.plans.network import Layer

_KERAS_ACTIVATIONS = {"relu": "relu", "softmax": "softmax", "tanh": "tanh", "sigmoid": "logistic", "linear": None, "selu": "selu"}


def _one(x):
    """A size given for both directions, which must agree."""
    if isinstance(x, (list, tuple)):
        flat = [y for z in x for y in (z if isinstance(z, (list, tuple)) else [z])]
        if len(set(flat)) > 1:
            raise ValueError(f"sizes differ by direction: {x}")
        return flat[0]
    return x


def keras_layers(text: str) -> list[Layer]:
    """Layers of a Keras model saved as JSON, sequential or functional."""
    spec = json.loads(text)
    layers = spec["config"] if isinstance(spec["config"], list) else spec["config"]["layers"]
    out: list[Layer] = []
    name: dict[str, str] = {}  # where a Keras layer's output is found
    pad = 0
    last = None
    for x in layers:
        kind, c = x["class_name"], x["config"]
        ins = [n[0] for n in (x.get("inbound_nodes") or [[]])[0]] if x.get("inbound_nodes") else []
        parents = [name[i] for i in ins] or ([last] if last else [])
        own = c.get("name", f"layer{len(out)}")
        shape = c.get("batch_input_shape") or c.get("batch_shape")
        if shape and not any(y.type == "input" for y in out):
            h, w, ch = (shape[1:] + [1, 1, 1])[:3] if len(shape) == 4 else (1, shape[1], 1)
            out.append(N.input_(w, h, ch, id="input"))
            parents = ["input"]
        made: Layer | None = None
        if kind == "Conv2D":
            p = pad if c["padding"] == "valid" else (_one(c["kernel_size"]) - 1) // 2
            made = N.convolutional(_one(c["kernel_size"]), p, _one(c["strides"]), c["filters"], id=own, parents=parents)
            pad = 0
        elif kind in ("MaxPooling2D", "AveragePooling2D"):
            op = "max" if kind[0] == "M" else "avg"
            made = N.max_pooling(_one(c["pool_size"]), pad, _one(c["strides"]), op=op, id=own, parents=parents)
            pad = 0
        elif kind == "Dense":
            made = N.linear(c["units"], id=own, parents=parents)
        elif kind == "Dropout":
            made = N.dropout(1.0 - c["rate"], id=own, parents=parents)
        elif kind == "BatchNormalization":
            made = N.batch_normalization(epsilon=max(c["epsilon"], 1e-5), ave_factor=c["momentum"], id=own, parents=parents)
        elif kind == "Add":
            made = N.join(operation="+", id=own, parents=parents)
        elif kind == "Concatenate":
            made = N.concatenate(id=own, parents=parents)
        elif kind == "ZeroPadding2D":
            pad = _one(c["padding"])
        elif kind == "Activation":
            if (to := _KERAS_ACTIVATIONS[c["activation"]]) is not None:
                made = Layer(to, own, parents, {"channels": 1} if to == "softmax" else {})
        elif kind not in ("Flatten", "InputLayer"):
            raise ValueError(f"unknown layer {kind}")
        where = parents[0] if parents else None
        if made is not None:
            out.append(made)
            where = made.id
            if kind in ("Dense", "Conv2D") and (to := _KERAS_ACTIVATIONS[c.get("activation", "linear")]) is not None:
                out.append(Layer(to, f"{own}-activation", [own], {"channels": 1} if to == "softmax" else {}))
                where = f"{own}-activation"
        if kind == "InputLayer":
            where = "input"
        name[own] = last = where
    return out


def parse_prototxt(text: str) -> list[tuple[str, object]]:
    """(key, value) pairs of a message in text form; nested messages are such lists."""
    words = re.findall(r'"[^"]*"|[{}:]|[^\s{}:"#]+', re.sub(r"#.*", "", text))
    at = 0

    def value(w: str):
        if w[0] == '"':
            return w[1:-1]
        for kind in (int, float):
            try:
                return kind(w)
            except ValueError:
                pass
        return {"true": True, "false": False}.get(w, w)

    def message():
        nonlocal at
        out = []
        while at < len(words) and words[at] != "}":
            key = words[at]
            at += 1
            if words[at] == ":":
                at += 1
            if words[at] == "{":
                at += 1
                out.append((key, message()))
                at += 1
            else:
                out.append((key, value(words[at])))
                at += 1
        return out

    return message()


def caffe_layers(text: str) -> list[Layer]:
    """Layers of a Caffe network; a layer type that is not known is an error."""
    out: list[Layer] = []
    for key, body in parse_prototxt(text):
        if key == "input_dim" and not out:
            dims = [v for k, v in parse_prototxt(text) if k == "input_dim"]
            out.append(N.input_(dims[3], dims[2], dims[1], id="data"))
        if key != "layer":
            continue
        d = dict(body)
        sub = lambda k: dict(d.get(k, []))
        kind, own = d["type"], d["name"]
        if kind == "Input":
            dims = [v for k, v in sub("input_param")["shape"] if k == "dim"]
            out.append(N.input_(dims[3], dims[2], dims[1], id=own))
        elif kind == "Convolution":
            c = sub("convolution_param")
            out.append(N.convolutional(c["kernel_size"], c.get("pad", 0), c.get("stride", 1), c["num_output"], id=own))
        elif kind == "Pooling":
            c = sub("pooling_param")
            out.append(N.max_pooling(c["kernel_size"], c.get("pad", 0), c.get("stride", 1), op="max" if c.get("pool", "MAX") == "MAX" else "avg", id=own))
        elif kind == "InnerProduct":
            out.append(N.linear(sub("inner_product_param")["num_output"], id=own))
        elif kind == "LRN":
            c = sub("lrn_param")
            out.append(N.local_response_normalization(n=c.get("local_size", 5), k=c.get("k", 1.0), alpha=c.get("alpha", 1.0), beta=c.get("beta", 0.75), id=own))
        elif kind == "Dropout":  # the ratio is handed on as the share that is kept
            out.append(N.dropout(sub("dropout_param").get("dropout_ratio", 0.5), id=own))
        elif kind in ("ReLU", "Softmax", "PReLU", "TanH", "Sigmoid"):
            to = {"ReLU": "relu", "Softmax": "softmax", "PReLU": "prelu", "TanH": "tanh", "Sigmoid": "logistic"}[kind]
            out.append(Layer(to, own, [], {"softmax": {"channels": 1}, "prelu": {"scale": 0.25}}.get(to, {})))
        else:
            raise ValueError(f"unknown layer {kind}")
    return out
