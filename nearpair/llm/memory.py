"""Memory of Python workers, which Spark keeps for the tasks that follow."""

from __future__ import annotations

import ctypes
import functools
import inspect
from collections.abc import Callable

import pyarrow as pa


@functools.cache
def _trim() -> Callable[[], object]:
    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # not the GNU C library
        return lambda: None
    return lambda: trim(0)


def give_back() -> None:
    """Hands free memory back to the system. Else a worker stays as large as its largest task was,
    beside those of all later stages."""
    pa.default_memory_pool().release_unused()
    _trim()()


def released(run: Callable) -> Callable:
    """`run`, for mapInArrow or applyInArrow, with memory given back at its end."""
    if inspect.isgeneratorfunction(run):

        def over_batches(batches):
            try:
                yield from run(batches)
            finally:
                give_back()

        return over_batches

    def over_group(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back()

    return over_group
