"""What a Python worker keeps from task to task: one object at a time, and no freed memory.

Spark uses its Python workers again for later stages and queries. A table of known
words that an earlier stage filled would stay beside those of all later ones, so
a worker holds one such object, and stages that need none let it go. Memory that a
task has freed goes back to the system when the task ends, as a worker may stand
idle beside those of the next stage.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Hashable

import pyarrow as pa

_held: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], object]):
    """The object of this key; it is made, and any other let go, when the worker has not got it."""
    if key not in _held:
        _held.clear()
        tidy()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Lets go of whatever this worker holds."""
    if _held:
        _held.clear()
        tidy()


def tidy() -> None:
    """Gives freed memory back to the system, where its library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(task):
    """A function of a task's batches that tidies up behind itself."""

    @functools.wraps(task)
    def run(batches, *args, **options):
        try:
            yield from task(batches, *args, **options)
        finally:
            tidy()

    return run
