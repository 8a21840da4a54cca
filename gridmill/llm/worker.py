"""What a Python worker keeps from one task to the next.

Spark uses a worker again for the tasks of all steps of a session. What one step remembers, and what its allocators
hold for it, would stay beside the memory of every step after it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

#: By step: what empties a memory of that step.
_memories: dict[str, list[Callable[[], None]]] = {}


def remembered_by(step: str) -> Callable:
    """Marks a function with ``cache_clear`` as a memory that only tasks of ``step`` may leave in a worker."""

    def mark(cached):
        _memories.setdefault(step, []).append(cached.cache_clear)
        return cached

    return mark


def forget_others(step: str) -> None:
    for other, clears in _memories.items():
        if other != step:
            for clear in clears:
                clear()


def give_back() -> None:
    """Return memory that is no longer used to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], step: str = ""):
    """``run`` for ``mapInArrow``: other steps' memories go before it, free memory after each batch and at the end."""

    @wraps(run)
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(step)
        give_back()

        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                give_back()

        yield from run(each())
        give_back()

    return own
