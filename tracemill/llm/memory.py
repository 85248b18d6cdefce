"""What a reused Python worker keeps: tables remembered by one kind of work are freed before another kind begins."""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable

import pyarrow as pa

_remembered: list[Callable[[], object]] = []
_work: list[str] = [""]


def remembered(clear: Callable[[], object]) -> None:
    """Register how a module forgets what it remembers between tasks."""
    _remembered.append(clear)


def begin(kind: str | None) -> None:
    """Before a task: another kind of work than the last one starts without its tables."""
    if kind is not None and kind != _work[0]:
        for clear in _remembered:
            clear()
        _work[0] = kind
        trim()


def trim() -> None:
    """Give freed memory back to the system, Arrow's and that of the C library where it can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        pass


def bounded(kind: str | None, func: Callable) -> Callable:
    """A task function (of a group, or from batches to batches) that begins and ends like this; kind None keeps the tables."""
    if inspect.isgeneratorfunction(func):
        def batches(arrived):
            begin(kind)
            try:
                yield from func(arrived)
            finally:
                trim()

        return batches
    if len(inspect.signature(func).parameters) == 2:
        def pair(left, right):
            begin(kind)
            try:
                return func(left, right)
            finally:
                trim()

        return pair

    def group(table):
        begin(kind)
        try:
            return func(table)
        finally:
            trim()

    return group
