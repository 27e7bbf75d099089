"""Pictures as vectors: binary netpbm files (P5 grey, P6 colour) in grey, at a common size."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.rows import class_split
from quern.sources.io import decode_rows

_HEADER = re.compile(rb"(P[56])(?:\s+|\s*#[^\n]*\n)+(\d+)(?:\s+|\s*#[^\n]*\n)+(\d+)(?:\s+|\s*#[^\n]*\n)+(\d+)\s")


def decode_netpbm(content: bytes) -> np.ndarray:
    """(height, width, channels) of numbers from 0 to 1."""
    m = _HEADER.match(content)
    if not m:
        raise ValueError("not a binary netpbm file")
    channels = 3 if m[1] == b"P6" else 1
    width, height, top = int(m[2]), int(m[3]), int(m[4])
    kind = np.uint8 if top < 256 else np.dtype(">u2")
    pixels = np.frombuffer(content, kind, width * height * channels, m.end())
    return pixels.reshape(height, width, channels) / top


def grey(image: np.ndarray) -> np.ndarray:
    return image.mean(axis=2)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean of what each new cell covers of the old ones."""

    def weights(old: int, new: int) -> np.ndarray:
        edge = np.arange(new + 1) * old / new
        low, high = edge[:-1, None], edge[1:, None]
        k = np.arange(old)
        share = np.clip(np.minimum(high, k + 1) - np.maximum(low, k), 0, None)
        return share / share.sum(axis=1, keepdims=True)

    return weights(image.shape[0], height) @ image @ weights(image.shape[1], width).T


def prepare(files: DataFrame, side: int) -> DataFrame:
    """class, data (side * side greys, less a half) of files (class, content); others go."""

    def one(content: bytes):
        return ((resized(grey(decode_netpbm(content)), side, side) - 0.5).ravel().tolist(),)

    return decode_rows(files, one, "data array<double>")


def train_and_test(images: DataFrame, id_col: str, test: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Each class's rows, its first ``test`` share by id for testing, the rest for training."""
    marked = class_split(images, "class", id_col, test)
    return marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")
