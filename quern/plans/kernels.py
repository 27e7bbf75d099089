"""Numpy kernels of the layers, on batches of rows x width (planar: channel, row, column)."""

from __future__ import annotations

import math

import numpy as np

from quern.functions.arrays import SELU_ALPHA, SELU_SCALE


def out_size(n: int, kernel: int, pad: int, stride: int, ceil: bool = False) -> int:
    x = (n + 2 * pad - kernel) / stride
    return int(math.ceil(x) if ceil else math.floor(x)) + 1


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _taps(shape, kernel, pad, stride, ceil):
    """For every output cell, the flat input index under each kernel tap, -1 for padding and
    -2 for taps beyond the padded image."""
    c, h, w = shape
    oh, ow = out_size(h, kernel, pad, stride, ceil), out_size(w, kernel, pad, stride, ceil)
    y = np.arange(oh)[:, None, None, None] * stride - pad + np.arange(kernel)[None, None, :, None]
    x = np.arange(ow)[None, :, None, None] * stride - pad + np.arange(kernel)[None, None, None, :]
    y, x = np.broadcast_arrays(y, x)
    inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
    beyond = (y >= h + pad) | (x >= w + pad)
    return np.where(inside, y * w + x, np.where(beyond, -2, -1)).reshape(oh * ow, kernel * kernel), oh, ow


def _gathered(planes: np.ndarray, taps: np.ndarray, fill: float) -> np.ndarray:
    """planes (n, c, h*w) -> (n, c, cells, taps)."""
    got = planes[:, :, np.maximum(taps, 0)]
    return np.where(taps >= 0, got, fill)


def _scatter(grad: np.ndarray, taps: np.ndarray, size: int) -> np.ndarray:
    """Adjoint of _gathered."""
    n, c = grad.shape[:2]
    out = np.zeros((n * c, size))
    flat = grad.reshape(n * c, -1)
    ok = taps.ravel() >= 0
    np.add.at(out, (slice(None), taps.ravel()[ok]), flat[:, ok])
    return out.reshape(n, c, size)


def _lrn(x: np.ndarray, o: dict) -> tuple[np.ndarray, np.ndarray]:
    """x (n, c, cells); the squares of n channels around each."""
    half, c = o["n"] // 2, x.shape[1]
    run = np.concatenate([np.zeros_like(x[:, :1]), np.cumsum(x * x, axis=1)], axis=1)
    i = np.arange(c)
    sums = run[:, np.minimum(i + half + 1, c)] - run[:, np.maximum(i - half, 0)]
    base = o["k"] + o["alpha"] / o["n"] * sums
    return x * base ** -o["beta"], base


def _channels_last(x: np.ndarray, shape) -> np.ndarray:
    """(rows, channels * cells) -> (rows * cells, channels)."""
    return x.reshape(len(x), shape[0], -1).transpose(0, 2, 1).reshape(-1, shape[0])


def _planes(x: np.ndarray, n: int, shape) -> np.ndarray:
    """Its inverse."""
    return x.reshape(n, -1, shape[0]).transpose(0, 2, 1).reshape(n, -1)


def forward(net, layer, ins, training, rng):
    o, kind, x = layer.options, layer.type, ins[0]
    p = {k.split(".", 1)[1]: v for k, v in net.parameters.items() if k.startswith(layer.id + ".")}
    shape = net.shapes[layer.parents[0]]
    n = len(x)
    if kind == "linear":
        return x @ p["weights"].T + p["bias"], None
    if kind == "relu":
        return np.maximum(x, 0), None
    if kind == "logistic":
        return _sigmoid(x), None
    if kind == "tanh":
        return np.tanh(x), None
    if kind == "swish":
        return x * _sigmoid(x), None
    if kind == "selu":
        return SELU_SCALE * np.where(x > 0, x, SELU_ALPHA * np.exp(np.minimum(x, 0)) - SELU_ALPHA), None
    if kind == "prelu":
        s = np.repeat(p["scale"], x.shape[1] // len(p["scale"]))
        return np.where(x >= 0, x, s * x), None
    if kind == "softmax":
        c = o.get("channels", 1)
        if c == 1:
            return softmax(x), None
        planes = x.reshape(n, c, -1).transpose(0, 2, 1)
        return softmax(planes).transpose(0, 2, 1).reshape(n, -1), None
    if kind == "dropout":
        mask = (rng.random_sample(x.shape) < o["keep"]) / o["keep"]
        return x * mask, mask
    if kind == "multiplicative_dropout":
        mask = rng.normal(1.0, math.sqrt(o["variance"]), x.shape)
        return x * mask, mask
    if kind == "convolutional":
        taps, oh, ow = _taps(shape, o["kernel"], o["pad"], o["stride"], False)
        cols = _gathered(x.reshape(n, shape[0], -1), taps, 0.0).transpose(0, 2, 1, 3).reshape(n, oh * ow, -1)
        return (cols @ p["weights"].T + p["bias"]).transpose(0, 2, 1).reshape(n, -1), (cols, taps)
    if kind == "pooling":
        taps, oh, ow = _taps(shape, o["kernel"], o["pad"], o["stride"], True)
        got = _gathered(x.reshape(n, shape[0], -1), taps, 0.0)
        if o["op"] == "max":  # padding counts as 0
            got = np.where(taps == -2, -np.inf, got)
            return got.max(axis=3).reshape(n, -1), (got, taps)
        count = (taps >= 0).sum(axis=1) if o["op"] == "avg-exc-pad" else np.full(len(taps), taps.shape[1])
        return (got.sum(axis=3) / np.maximum(count, 1)).reshape(n, -1), (count, taps)
    if kind == "batch_normalization":
        x = _channels_last(x, shape) if o["mode"] == "spatial" else x
        if training:
            mean, var = x.mean(axis=0), x.var(axis=0)
            sample = var * len(x) / max(1, len(x) - 1)
        else:
            mean, var, sample = net.state[f"{layer.id}.mean"], net.state[f"{layer.id}.variance"], None
        hat = (x - mean) / np.sqrt(var + o["epsilon"])
        out = hat * p["scale"] + p["bias"]
        if o["mode"] == "spatial":
            out = _planes(out, n, shape)
        return out, {"hat": hat, "mean": mean, "variance": sample, "used": var} if training else None
    if kind == "lrn":
        y, base = _lrn(x.reshape(n, shape[0], -1), o)
        return y.reshape(n, -1), base
    if kind == "concatenate":
        return np.concatenate(ins, axis=1), None
    if kind == "join":
        wide, narrow = max(i.shape[1] for i in ins), min(i.shape[1] for i in ins)
        if o["operation"] == "+":
            out = np.zeros((n, wide))
            for i in ins:
                out[:, : i.shape[1]] += i
            return out, None
        out = np.zeros((n, wide))
        out[:, :narrow] = np.prod([i[:, :narrow] for i in ins], axis=0)
        return out, None
    if kind == "split":
        return x, None
    raise ValueError(f"unknown layer {kind}")


def backward(net, layer, ins, out, kept, g):
    """Gradients for the inputs, and for the layer's own parameters."""
    o, kind, x = layer.options, layer.type, ins[0]
    p = {k.split(".", 1)[1]: v for k, v in net.parameters.items() if k.startswith(layer.id + ".")}
    shape = net.shapes[layer.parents[0]]
    n = len(x)
    if kind == "linear":
        return [g @ p["weights"]], {"weights": g.T @ x, "bias": g.sum(axis=0)}
    if kind == "relu":
        return [g * (out > 0)], {}
    if kind == "logistic":
        return [g * out * (1 - out)], {}
    if kind == "tanh":
        return [g * (1 - out * out)], {}
    if kind == "swish":  # evaluated at the output
        s = _sigmoid(out)
        return [g * (s + out * s * (1 - s))], {}
    if kind == "selu":  # evaluated at the output
        return [g * SELU_SCALE * np.where(out > 0, 1.0, SELU_ALPHA * np.exp(np.minimum(out, 0)))], {}
    if kind == "prelu":
        s = np.repeat(p["scale"], x.shape[1] // len(p["scale"]))
        own = (g * x).sum(axis=0).reshape(len(p["scale"]), -1).sum(axis=1)  # over all inputs, not only negative ones
        return [g * np.where(x >= 0, 1.0, s)], {"scale": own}
    if kind in ("softmax", "split"):
        return [g], {}
    if kind in ("dropout", "multiplicative_dropout"):
        return [g * kept], {}
    if kind == "convolutional":
        cols, taps = kept
        planes = g.reshape(n, o["kernels"], -1)
        weights = np.einsum("nkc,ncd->kd", planes, cols)
        back = (planes.transpose(0, 2, 1) @ p["weights"]).reshape(n, -1, shape[0], taps.shape[1]).transpose(0, 2, 1, 3)
        return [_scatter(back, taps, shape[1] * shape[2]).reshape(n, -1)], {"weights": weights, "bias": planes.sum(axis=(0, 2))}
    if kind == "pooling":
        data, taps = kept
        planes = g.reshape(n, shape[0], -1, 1)
        if o["op"] == "max":  # every input that equals the maximum gets the gradient
            back = (data == out.reshape(n, shape[0], -1, 1)) * planes
        else:
            back = np.broadcast_to(planes / np.maximum(data, 1)[None, None, :, None], (*planes.shape[:3], taps.shape[1]))
        return [_scatter(back, taps, shape[1] * shape[2]).reshape(n, -1)], {}
    if kind == "batch_normalization":
        spatial = o["mode"] == "spatial"
        g = _channels_last(g, shape) if spatial else g
        hat, d = kept["hat"], g * p["scale"]
        back = (d - d.mean(axis=0) - hat * (d * hat).mean(axis=0)) / np.sqrt(kept["used"] + o["epsilon"])
        return [_planes(back, n, shape) if spatial else back], {"scale": (g * hat).sum(axis=0), "bias": g.sum(axis=0)}
    if kind == "lrn":
        v, gg, b = x.reshape(n, shape[0], -1), g.reshape(n, shape[0], -1), kept
        t = gg * v * b ** (-o["beta"] - 1)
        half, c = o["n"] // 2, shape[0]
        run = np.concatenate([np.zeros_like(t[:, :1]), np.cumsum(t, axis=1)], axis=1)
        i = np.arange(c)
        near = run[:, np.minimum(i + half + 1, c)] - run[:, np.maximum(i - half, 0)]
        return [(gg * b ** -o["beta"] - 2 * o["alpha"] * o["beta"] / o["n"] * v * near).reshape(n, -1)], {}
    if kind == "concatenate":
        edges = np.cumsum([0, *(i.shape[1] for i in ins)])
        return [g[:, a:b] for a, b in zip(edges, edges[1:])], {}
    if kind == "join":
        if o["operation"] == "+":
            return [g[:, : i.shape[1]] for i in ins], {}
        narrow, back = min(i.shape[1] for i in ins), []
        for k, i in enumerate(ins):
            rest = [j[:, :narrow] for m, j in enumerate(ins) if m != k]
            d = np.zeros_like(i)
            d[:, :narrow] = g[:, :narrow] * (np.prod(rest, axis=0) if rest else 1.0)
            back.append(d)
        return back, {}
    raise ValueError(f"unknown layer {kind}")


def _mse(v, t):
    return ((v - t) ** 2).mean(axis=1), 2.0 / v.shape[1] * (v - t)


def _softmax_loss(v, t):
    return -np.log(np.maximum((v * t).sum(axis=1), 1e-300)), v - t


def _censor(v, t):
    ok = ~np.isnan(t)
    d = np.where(ok, v - np.nan_to_num(t), 0.0)
    return (d * d).mean(axis=1), 2.0 / v.shape[1] * d


LOSSES = {"mse": _mse, "softmax": _softmax_loss, "censor": _censor}


def l1(x: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum of sizes, and its gradient (1 at 0)."""
    return float(np.abs(x).sum()), np.where(x >= 0, 1.0, -1.0)


def l2(x: np.ndarray) -> tuple[float, np.ndarray]:
    """Half the length (not its square), and the gradient x that goes with it."""
    return float(np.linalg.norm(x)) / 2.0, x


REGULARIZERS = {"l1_regularization": l1, "l2_regularization": l2}


def center_terms(centers: np.ndarray, features: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows' gradients, and by class the summed distances and numbers of rows."""
    back = features - centers[labels]
    sums, n = np.zeros_like(centers), np.zeros(len(centers))
    np.add.at(sums, labels, back)
    np.add.at(n, labels, 1.0)
    return back, sums, n


def moved_centers(centers: np.ndarray, sums: np.ndarray, n: np.ndarray, alpha: float, radius: float) -> np.ndarray:
    """Centres of the classes that occurred, moved towards their rows' mean; all scaled to
    length radius."""
    out = centers + (1 - alpha) * sums / np.maximum(n, 1.0)[:, None]
    return out * radius / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-6)


def constrain_rows(w: np.ndarray, most: float) -> np.ndarray:
    """Rows longer than ``most`` shortened to it."""
    size = np.linalg.norm(w, axis=1, keepdims=True)
    return w * most / np.maximum(size, most)


def update_centers(centers: np.ndarray, features: np.ndarray, labels: np.ndarray, alpha: float = 0.5, radius: float = 1.0) -> np.ndarray:
    """Centres moved towards their rows' mean, then scaled to length radius."""
    out = centers.copy()
    for k in np.unique(labels):
        out[k] += (1 - alpha) * (features[labels == k] - centers[k]).mean(axis=0)
        out[k] *= radius / (np.linalg.norm(out[k]) + 1e-6)
    return out
