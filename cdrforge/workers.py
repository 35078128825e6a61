"""Python workers between tasks.

Spark keeps a worker for later tasks, and an allocator keeps what a task took. Beside
a full heap that is memory which the executor needs, so tasks of large arrays give it back.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Free memory goes from Arrow's pool and from the C library to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """``run`` over a task's batches, with what it took given back at the end."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied
