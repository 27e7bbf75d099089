"""Python workers outlive their tasks: what a task leaves behind counts against the executor."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


def release(cycles: bool = True) -> None:
    """Give freed memory back to the system; ``cycles``: after a search for objects that only
    refer to each other, which takes a twentieth of a second."""
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def lean(run: Callable) -> Callable:
    """A function for mapInArrow that releases memory however its task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task
